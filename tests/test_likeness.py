"""Near texts in blocks: tiles, the greedy rule and the rounds of its graph against plain loops."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import cleaning as C
from ledgerloom.operators import likeness as L

WORDS = "how do i save for a house car trip with my money when rent is due each month and debts grow".split()


def questions(n, seed):
    """Texts of a few families, each a text with edits, all with one beginning."""
    rnd, out = random.Random(seed), []
    families = [[rnd.choice(WORDS) for _ in range(rnd.randrange(4, 22))] for _ in range(9)]
    while len(out) < n:
        words = list(rnd.choice(families))
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        text = list("what is " + " ".join(words))
        for _ in range(rnd.randrange(4)):
            text[rnd.randrange(8, len(text))] = rnd.choice("abcxyz ")
        text = " ".join("".join(text).split())
        if text not in out:
            out.append(text)
    return out


def one_by_one(texts, threshold):
    kept, dropped = [], set()
    for k, t in enumerate(texts):
        if any(SequenceMatcher(None, t, o).ratio() >= threshold for o in kept):
            dropped.add(k)
        else:
            kept.append(t)
    return dropped


@pytest.mark.parametrize("head, chunk", [(512, 2048), (5, 7), (1, 20)])
def test_greedy_rule_over_heads_tiles_and_rounds(spark, head, chunk):
    a, b = questions(130, 3), questions(40, 4)
    rows = spark.createDataFrame([("a", k, t) for k, t in enumerate(a)] + [("b", k, t) for k, t in enumerate(b)] + [("c", 0, "alone")], "block string, ord long, text string").repartition(5)
    got = {(r["block"], r["ord"]) for r in L.greedy_dropped(rows, 0.92, head, chunk).collect()}
    want = {("a", k) for k in one_by_one(a, 0.92)} | {("b", k) for k in one_by_one(b, 0.92)}
    assert got == want and 20 < len(want) < 150


def test_greedy_rule_of_no_rows(spark):
    rows = spark.createDataFrame([], "block string, ord long, text string")
    assert L.greedy_dropped(rows, 0.92).count() == 0
    assert L.near_edges(rows, 1.2, lambda n, m: n + m).count() == 0


def test_independent_set_is_the_first_one(spark):
    rng = np.random.default_rng(6)
    edges = {(int(min(p)), int(max(p))) for p in rng.integers(0, 60, (90, 2)) if p[0] != p[1]} | {(k, k + 1) for k in range(100, 112)}
    dropped = set()
    for v in range(120):
        if any(b == v and a not in dropped for a, b in edges):
            dropped.add(v)
    rows = spark.createDataFrame([*edges, *list(edges)[:5]], "a long, b long")
    assert {r["id"] for r in L.first_independent(rows).collect()} == dropped
    assert L.first_independent(rows.limit(0)).count() == 0


def test_bounds_leave_every_near_pair():
    texts = questions(120, 9)
    lengths, counts = L.profiles(texts)
    for k, t in enumerate(texts):
        left = set(L.possible(lengths, counts, lengths[k], counts[k], lambda n, m: L.edits_allowed(n, m, 0.92)).tolist())
        assert {j for j, o in enumerate(texts) if SequenceMatcher(None, t, o).ratio() >= 0.92} <= left


def test_near_pairs_of_one_large_block(spark):
    texts = questions(150, 12)
    rows = spark.createDataFrame(list(enumerate(texts)), "ord long, question string").withColumn("block", F.lit(1))
    got = {(r["a"], r["b"]): r["distance"] for r in C.near_pairs(rows).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            m = int(max(len(a), len(texts[j])) * 0.08)
            if abs(len(a) - len(texts[j])) <= m and (d := edits(a, texts[j])) <= m:
                want[i, j] = d
    assert got == want and want


def test_fuzzy_kinds_with_sources_that_share_numbers(spark):
    q = "How should I budget my money every month, please?"
    rows = spark.createDataFrame([(0, "s", q, "a"), (0, "t", q + "!", "a"), (1, "s", q + "!", "a"), (1, "t", q, "b"), (2, "s", q + "!", "c"), (3, "s", "", "a")], "ord long, source string, question string, answer string")
    got = {(r["source"], r["ord"]): r["kind"] for r in C.dedup_fuzzy(rows).collect()}
    assert got == {("s", 0): "kept", ("t", 0): "kept", ("s", 1): "fuzzy", ("t", 1): "fuzzy", ("s", 2): "fuzzy", ("s", 3): None}
