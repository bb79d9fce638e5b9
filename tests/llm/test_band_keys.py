"""Band keys of documents: shuffled once, a hot key as a row a batch, with the groups of a plain closure."""

import random

import numpy as np
import pyarrow as pa

from ledgerloom.llm import line_templates as L

from .test_line_rule import closure


def test_groups_without_a_second_shuffle(spark, monkeypatch):
    rng, rows = random.Random(7), []
    for doc in rng.sample(range(-10_000, 10_000), 600):
        own = [rng.getrandbits(60) for _ in range(L.BANDS)]
        if doc % 3 == 0:
            own[doc % L.BANDS] = 5  # a hot key of a third of all documents
        elif doc % 7 == 0:
            own[0] = -(doc // 70)
        rows += [(doc, own)] * (2 if doc % 11 == 0 else 1) + [(doc, None)]
    names, before = [], L.stored
    monkeypatch.setattr(L, "stored", lambda df, name, share=1: names.append(name) or before(df, name, share))
    df = spark.createDataFrame(rows, "doc long, sketch array<long>").repartition(5)
    got = {r["doc"]: r["group"] for r in L._groups(df).collect()}
    by_key: dict[int, list[int]] = {}
    for doc, keys in rows:
        for key in keys or ():
            by_key.setdefault(key, []).append(doc)
    links = [(docs[0], d) for docs in by_key.values() for d in docs if d != docs[0]]
    root = closure({d for d, _ in rows}, links)
    least = {r: min(d for d in root if root[d] == r) for r in set(root.values())}
    assert got == {d: least[root[d]] for pair in links for d in pair}
    assert names == []  # keys were stored, counted by a shuffle and joined by another


def test_a_hot_key_is_a_row_a_batch():
    keys = np.arange(300 * L.BANDS).reshape(300, -1)
    keys[:, 3] = 7
    batch = pa.record_batch([pa.array(range(300, 0, -1), pa.int64()), pa.array(keys.tolist(), pa.list_(pa.int64()))], names=["doc", "sketch"])
    heads, links = (next(L._stars(h)(iter([batch]))).to_pylist() for h in (True, False))
    assert [r["doc"] for r in heads if r["key"] == 7] == [1] and len(heads) == len(np.unique(keys))
    assert sorted((r["u"], r["v"]) for r in links) == [(u, 1) for u in range(2, 301)]
