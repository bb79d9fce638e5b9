"""Texts of a batch become Python strings a slice at a time, with the same results."""

import tracemalloc
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.functions import text as T


def test_a_batch_is_never_held_as_strings():
    texts = [None if k % 7 == 0 else f"{k} ﬁ … " + "é" * 4000 for k in range(3000)]
    given = pa.array(texts)
    tracemalloc.start()
    clean = T.by_slices(T._nfkc, pa.string())(given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20  # all texts at once are 24 MB, and as much again when done
    assert clean.to_pylist() == [None if x is None else unicodedata.normalize("NFKC", x) for x in texts]
    assert T.by_slices(T._nfkc_changes, pa.int32())(given).to_pylist() == [None if x is None else 2 for x in texts]
    assert len(T.by_slices(T._nfkc, pa.string())(pa.array([], pa.string()))) == 0


def test_columns(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["plain", None, "ﬁ½ “x”", ""])], "k int, t string")
    got = df.select("k", T.normalize_unicode(F.col("t")).alias("n"), T.encoding_changes(F.col("t")).alias("c")).orderBy("k").collect()
    assert [(r["n"], r["c"]) for r in got] == [("plain", 0), (None, 0), ('fi1⁄2 "x"', 2), ("", 0)]
