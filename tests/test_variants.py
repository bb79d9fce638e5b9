"""VARIANT columns: raw records, stored tables, messages."""

import json

from pyspark.sql import functions as F

from ledgerloom.operators import variants as V

LINES = [
    '{"input": "q", "output": "a", "n": 3, "m": {"x": [1, 2.5]}, "z": null}', '{"input": 5, "output": "a", "n": "w"}', "bad", "[1]", None, '{"input": "q", "input": "r", "n": 1, "n": 2}', "{}", '{"input": null}']


def lines(spark):
    return spark.createDataFrame(list(enumerate(LINES)), "k int, value string")


def parsed(df):
    return [(r["question"], r["answer"], None if r["aux"] is None else json.loads(r["aux"])) for r in df.withColumn("aux", F.to_json("aux")).orderBy("k").collect()]


def test_raw_records(spark):
    got = parsed(V.parse_raw_variant(lines(spark), "fingpt-fiqa-qa"))
    assert got == [
        ("q", "a", {"n": 3, "m": {"x": [1, 2.5]}, "z": None}), (None, "a", {"n": "w"}), (None, None, None), (None, None, None), (None, None, None), ("r", None, {"n": 2}), (None, None, {}), (None, None, {})]


def test_unknown_source_keeps_all_in_aux(spark):
    got = parsed(V.parse_raw_variant(lines(spark), "elsewhere"))
    assert all(q is None and a is None for q, a, _ in got) and got[1][2] == {"input": 5, "output": "a", "n": "w"}


def test_clashing_columns_and_no_rows(spark):
    df = lines(spark).withColumns({"aux": F.lit(1), "source": F.lit("x"), "a.b": F.lit(2)})
    assert V.parse_raw_variant(df, "fingpt-fiqa-qa").columns == ["k", "a.b", "source", "question", "answer", "aux"]
    assert V.parse_raw_variant(df.where("false"), "fingpt-fiqa-qa").count() == 0


def test_kinds_of_fields(spark):
    rows = V.field_kinds(V.parse_raw_variant(lines(spark), "fingpt-fiqa-qa")).collect()
    assert [(r["source"], r["n"]) for r in rows] == [("fingpt-fiqa-qa", 5)] and "n: VARIANT" in rows[0]["kinds"]


def test_stored_fields_are_pruned_and_filters_pushed(spark, tmp_path):
    rows = spark.range(500).select("id", F.try_parse_json(F.to_json(F.struct(F.col("id").alias("a"), F.concat(F.lit("t"), "id").alias("b"), F.struct((F.col("id") % 3).alias("d")).alias("c")))).alias("v"))
    before = spark.conf.get("spark.sql.variant.writeShredding.enabled")
    V.write_variants(rows, str(tmp_path / "t"))
    assert spark.conf.get("spark.sql.variant.writeShredding.enabled") == before
    some = V.with_fields(spark.read.parquet(str(tmp_path / "t")), "v", {"a": ("$.a", "bigint"), "d": ("$.c.d", "int")}).where("a >= 490").select("id", "a", "d")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(v.`" in plan and "t1" not in plan
    assert sorted(map(tuple, some.collect())) == [(k, k, k % 3) for k in range(490, 500)]
    assert {r["t"] for r in spark.read.parquet(str(tmp_path / "t")).select(F.variant_get("v", "$.b", "string").alias("t")).collect()} == {f"t{k}" for k in range(500)}


def test_mixed_kinds_read_back(spark, tmp_path):
    values = ['{"a": 1}', '{"a": "x"}', '{"a": {"b": [null, true]}}', "7", None, "[]"]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string").select("k", F.try_parse_json("t").alias("v"))
    V.write_variants(rows.coalesce(1), str(tmp_path / "t"))
    back = {r["k"]: r["t"] for r in spark.read.parquet(str(tmp_path / "t")).select("k", F.to_json("v").alias("t")).collect()}
    assert {k: None if t is None else json.loads(t) for k, t in back.items()} == {k: None if v is None else json.loads(v) for k, v in enumerate(values)}


def test_messages(spark):
    texts = ['[{"role": "user", "content": "x", "t": 1}, {"role": "assistant", "content": "é\\n"}]', "{", "7", "[]", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, messages string")
    rows = V.messages_as_variant(df).withColumn("m", V.messages_of(F.col("messages"))).orderBy("k").collect()
    assert [r["m"] if r["m"] is None else [tuple(x) for x in r["m"]] for r in rows] == [[("user", "x"), ("assistant", "é\n")], None, None, [], None]
    typed = df.select(F.from_json("messages", V.MESSAGES).alias("messages")).limit(1)
    assert json.loads(V.messages_as_variant(typed).select(V.messages_as_json(F.col("messages"))).first()[0])[1] == {"role": "assistant", "content": "é\n"}
