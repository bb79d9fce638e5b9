"""Epoch orders of records: permutations, tokens, shards, pruning."""

import json

import numpy as np
import pytest
from pyspark.sql import types as T

from ledgerloom.sources import epochs as E

KIND = T.StructType([T.StructField("id", T.LongType())])


@pytest.fixture()
def folder(tmp_path):
    at = tmp_path / "lines"
    at.mkdir()
    (at / "a.jsonl").write_text("\n".join(json.dumps({"id": k, "t": "x" * (k % 90)}) for k in range(211)))
    (at / "b.jsonl").write_text("".join(json.dumps({"id": 211 + k}) + "\n\n" for k in range(96)))
    (at / "c.jsonl").write_text("")
    return str(at)


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4097])
def test_permutations(n):
    keys = E.round_keys(5, 1)
    x = np.arange(n)
    there = E.permuted(x, n, keys, 3)
    assert sorted(there) == list(x) and list(E.original(there, n, keys, 3)) == list(x)
    if n >= 64:
        assert abs(np.corrcoef(x, there)[0, 1]) < 0.3 and (there == x).mean() < 0.1
        assert (E.permuted(x, n, keys, 4) != there).mean() > 0.8 and (E.permuted(x, n, E.round_keys(5, 2), 3) != there).mean() > 0.8


def test_places_beyond_32_bits():
    n, keys = 5 * 10**11 + 7, E.round_keys(0, 0)
    x = np.random.default_rng(0).integers(0, n, 2000)
    there = E.permuted(x, n, keys)
    assert there.min() >= 0 and there.max() < n and list(E.original(there, n, keys)) == list(x)
    assert abs(there.mean() / n - 0.5) < 0.05


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_an_epoch_has_every_row_once_in_order(spark, folder):
    order = E.EpochOrder(spark, folder, KIND, seed=1, group=20, size=300)
    assert order.n == 307
    got, token = order.take(E.Token())
    got = rows(got)
    assert token == E.Token(1, 0)
    assert [r[0] for r in got] == list(range(307))  # partitions and rows come in order
    assert all(r[1] == r[2] for r in got) and sorted(r[1] for r in got) == list(range(307))
    other = rows(E.EpochOrder(spark, folder, KIND, seed=1, group=20, size=1 << 20).take(E.Token())[0])
    assert got == other  # the bytes of a range do not matter
    assert [r[1] for r in rows(order.take(E.Token(1))[0])] != [r[1] for r in got]


def test_broken_off_and_taken_up(spark, folder):
    order = E.EpochOrder(spark, folder, KIND, group=20, size=300)
    whole, parts, token = rows(order.take(E.Token(3))[0]), [], E.Token(3)
    while token.epoch == 3:
        some, token = order.take(token, 83)
        parts.append(rows(some))
    assert [len(p) for p in parts] == [83, 83, 83, 58] and sum(parts, []) == whole and token == E.Token(4, 0)


@pytest.mark.parametrize("shards", [2, 3, 40])
def test_shards_share_an_epoch(spark, folder, shards):
    order = E.EpochOrder(spark, folder, KIND, group=20, size=300)
    parts = [rows(order.take(E.Token(0, 30), shard=k, shards=shards)[0]) for k in range(shards)]
    assert sorted(sum(parts, [])) == rows(order.take(E.Token(0, 30))[0])
    assert all(p == sorted(p) for p in parts)


def test_positions_leave_out_groups(spark, folder):
    order = E.EpochOrder(spark, folder, KIND, group=20, size=300)
    assert order.lines(0).rdd.getNumPartitions() == 16
    late = order.lines(0).where("position >= 300")
    assert late.rdd.getNumPartitions() == 1 and late.count() == 7
    assert order.lines(0, 45, 62).rdd.getNumPartitions() <= 3
    assert order.lines(0).where("position = 9").count() == 1
    assert order.lines(0).where("position > 400").count() == 0


def test_runs_of_groups(spark, folder, monkeypatch):
    monkeypatch.setattr(E, "MOST_RANGES", 4)
    order = E.EpochOrder(spark, folder, KIND, group=20, size=300)
    reader = E.EpochReader({"path": folder, "range": "300", "group": "20", "counts": json.dumps(order.counts), "shard": "1", "shards": "2", "start": "25"})
    got = [p for part in reader.partitions() for batch in reader.read(part) for p in batch.column(0).to_pylist()]
    assert len(reader.partitions()) <= 4
    monkeypatch.undo()
    assert got == [r[0] for r in rows(order.lines(0, 25, shard=1, shards=2))]


def test_no_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n\n")
    order = E.EpochOrder(spark, str(tmp_path), KIND)
    got, token = order.take(E.Token(2))
    assert got.count() == 0 and token == E.Token(2) and order.n == 0


def test_broken_lines_give_nulls(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\nnot json\n{"id": 3')
    got = rows(E.EpochOrder(spark, str(tmp_path), KIND).take(E.Token())[0])
    assert sorted((o, i) for _, o, i in got if o < 2) == [(0, 1), (1, None)] and len(got) == 3
