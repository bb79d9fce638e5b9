"""Lines of other sources are found in one pass over the lines, by rule."""

from ledgerloom.plans import store


def test_each_line_is_keyed_once(spark, tmp_path):
    texts = [("a", "Hello there\nonly a"), ("a", "hello  there 7\nabc"), ("b", "- HELLO there.\nabc\nonly b\nonly b"), (None, "hello there\nonly none"), ("c", None), (None, "only a"), ("c", "only b")]
    spark.createDataFrame(texts, "source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = store.echoed_lines(spark, str(tmp_path))
    assert {r["source"]: r["n"] for r in df.collect()} == {"a": 2, "b": 3, "c": 1, None: 1}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # The lines were split for the join's either side, and a key was made for its filter and again for its value.
    assert plan.count("Join") == 0 and plan.count("split(") == plan.count("lower(") == 1
