"""Edit distances by bits equal the table's, and long near texts are compared in little time."""

import random
import time

from ledgerloom.operators import cleaning as C
from ledgerloom.operators import likeness as L


def _table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_distance_is_the_tables():
    r = random.Random(7)
    for _ in range(3000):
        a = "".join(r.choice("abé\U0001F600") for _ in range(r.randrange(90)))
        b = "".join(r.choice("abé\U0001F600") for _ in range(r.randrange(90))) if r.random() < 0.4 else "".join(
            r.choice(("", c, c + "b", "x")) if r.random() < 0.2 else c for c in a)
        want, most = _table(a, b), r.randrange(60)
        assert L.edit_distance(a, b, 200) == want == L.edit_distance(b, a, want)
        assert L.edit_distance(a, b, most) == (want if want <= most else -1)


def test_long_near_texts(spark):
    """Sixty-six pairs of 20,000 characters: a table of each would take minutes."""
    r = random.Random(1)
    text = [r.choice("abcdefgh ") for _ in range(20_000)]
    rows = [(k, "a question " + "".join(text[: 1000 * k + 99] + ["xyz"] + text[1000 * k + 100 :])) for k in range(12)]
    begin = time.time()
    got = C.near_pairs(spark.createDataFrame(rows, "ord long, question string")).collect()
    assert time.time() - begin < 60
    assert len(got) == 66 and {g["distance"] for g in got} <= {4, 5, 6}
