"""Near-duplicate removal moves the texts of documents that may go, not of those that stay."""

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm.work import split_by


def _shuffled(node, column):
    """Rows written by the exchanges of an executed plan that hold the column."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled(node.executedPlan(), column)
    if kind.endswith("QueryStageExec"):
        return _shuffled(node.plan(), column)
    own = 0
    if kind == "ShuffleExchangeExec" and f"{column}#" in node.output().mkString(","):
        own = node.metrics().apply("shuffleRecordsWritten").value()
    below = node.children()
    return own + sum(_shuffled(below.apply(k), column) for k in range(below.size()))


def test_kept_texts_are_not_shuffled(spark, tmp_path):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(20))
    rows = [(k, words(k if k < 380 else k - 380)) for k in range(400)] + [(0, words(0)), (None, words(7))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.near_dedup(spark, docs, "")
        got = out.collect()
        moved = _shuffled(out._jdf.queryExecution().executedPlan(), "text")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((-1 if r[0] is None else r[0], r[1]) for r in got) == sorted([(k, words(k)) for k in range(380)] + [(-1, words(7))])
    # 20 copies that go, and the two rows of an id, which an exchange each joins and counts.
    assert 20 <= moved <= 60


def test_split_is_exact_after_the_join(spark):
    rows = spark.range(-3000, 3000).withColumnRenamed("id", "k").withColumn("bits", F.col("k") * 2)
    few = spark.range(-3000, 3000, 7).withColumnRenamed("id", "k")
    alone, others = split_by(rows, few, "k")
    assert alone.columns == others.columns == rows.columns
    kept = alone.union(others.join(few, "k", "left_anti").select(*rows.columns))
    assert sorted(map(tuple, kept.collect())) == [(k, 2 * k) for k in range(-3000, 3000) if (k + 3000) % 7]
    assert others.count() < 900 and split_by(rows, few.limit(0), "k")[0].count() == 6000
