"""Labels are found by one search of a key, with the results of comparing it with each of them."""

from pyspark.sql import functions as F

from ledgerloom.functions.money import DEBT_LABELS, INCOME_LABELS, SAVING_LABELS, stands_for


def test_labels_by_one_search(spark):
    keys = ["take-home", "my take-home", "takeXhome", "prepay", "monthly  pay", "pay off", "pay\n", " pay", "", "401k", "my 401k", "x401k", "emergency fund", "the credit cards", "credit card debt", None]
    keys += [f"{p}{x}" for x in (*INCOME_LABELS, *DEBT_LABELS, *SAVING_LABELS) for p in ("", "old ", "old")]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    for labels in (INCOME_LABELS, DEBT_LABELS, SAVING_LABELS):
        found = df.select("key", stands_for(F.col("key"), labels).alias("is"))
        plain = lambda k: None if k is None else any(k == x or k.endswith(" " + x) for x in labels)
        assert [r["is"] for r in found.collect()] == [plain(k) for k in keys]
        # A list of the labels would be gone through for each key.
        assert "exists" not in found._jdf.queryExecution().optimizedPlan().toString()
