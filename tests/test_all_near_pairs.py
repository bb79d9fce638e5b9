"""Near pairs wherever their texts differ, against a table for each pair."""

import random

import numpy as np
import pytest

from ledgerloom.operators import cleaning as C
from ledgerloom.operators import likeness as L


def _table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def _edited(rnd, text, n):
    t = list(text)
    for _ in range(n):
        at = rnd.randrange(len(t))
        t[at : at + rnd.randrange(2)] = rnd.choice(("", "x", "yz", "é\U0001F600"))
    return "".join(t)


def test_pairs_that_differ_at_the_beginning(spark):
    rows = [(0, "How do I save money for a house this year?"), (1, "So how do I save money for a house this year?"), (2, "XYw do I save money for a house this year?"), (3, "ow do I save money for a house this year"),
            (4, "twelve chars"), (5, "dwelve chars"), (6, "thirteen char"), (7, "dhirteen char"), (8, ""), (9, " "), (10, None), (11, "twelve chars")]
    got = {(r["a"], r["b"]): r["distance"] for r in C.near_pairs(spark.createDataFrame(rows, "ord long, question string")).collect()}
    assert got == {(0, 1): 3, (0, 2): 2, (0, 3): 2, (2, 3): 3, (4, 11): 0, (6, 7): 1}


def test_all_pairs_of_families(spark):
    rnd = random.Random(5)
    bases = ["".join(rnd.choice(("the ", "of ", "sav", "ing ", "é", "rent ", "!! ")) for _ in range(n)) for n in (3, 6, 9, 20, 40, 90)] + ["the " * 60]
    texts = [_edited(rnd, rnd.choice(bases), rnd.randrange(6)) for _ in range(160)]
    keys = [" ".join(t.split()) for t in texts]
    want = {}
    for b in range(len(keys)):
        for a in range(b):
            m = int(max(len(keys[a]), len(keys[b])) * 0.08)
            if abs(len(keys[a]) - len(keys[b])) <= m and (d := _table(keys[a], keys[b])) <= m:
                want[a, b] = d
    got = C.near_pairs(spark.createDataFrame(list(enumerate(texts)), "ord long, question string").repartition(3)).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): r["distance"] for r in got} == want
    assert any(keys[a][:8] != keys[b][:8] for a, b in want) and len(want) > 100


@pytest.mark.parametrize("most", [0.03, 0.08, 0.2, 0.5])
def test_near_texts_share_pieces(most):
    rnd = random.Random(8)
    for _ in range(1500):
        a = "".join(rnd.choice("abc é") for _ in range(rnd.randrange(1, 300)))
        b = _edited(rnd, a, rnd.randrange(int(len(a) * most) + 1))
        x, y = sorted((a, b), key=len)
        if not x or L.edit_distance(x, y, int(np.floor(len(y) * most))) < 0:
            continue
        _, own, times = L.pieces([y], most, True)
        _, other, _ = L.pieces([x], most, False)
        need = L.needed(np.array([len(y)]), most)[0]
        assert need >= 1 and times[np.isin(own, other)].sum() >= need


def test_no_texts(spark):
    assert C.near_pairs(spark.createDataFrame([], "ord long, question string")).count() == 0
