"""JSON-lines sources and sinks: raw sources, chat files, cleaned and split output."""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import METRICS, category_of
from ..lineage import cut

CLEANED = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("question", T.StringType()), T.StructField("answer", T.StringType()),
    T.StructField("aux", T.MapType(T.StringType(), T.StringType()))])
CHAT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("messages", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])))])


CURATED = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "source", "question", "category", "gold")])
MOST_BLOCKS = 100_000


def read_raw(spark: SparkSession, path: str, schema: T.StructType | None = None, first: int | None = None) -> DataFrame:
    """Records of a JSON-lines file or folder with ``ord``, their place from 0.

    Blank lines are skipped. Places follow the order of file names, then of lines. A scan
    numbers rows in the order of a block of a file, whatever blocks share a partition; how many
    rows the blocks before have, a row for each block, gives the rest.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").where(F.trim("value") != "").withColumn("__id", F.monotonically_increasing_id())
    block = ["file_path", "file_block_start"]
    sizes = lines.groupBy(*block).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(sizes.select(*block, (before - F.col("__first")).alias("__shift")))
    kind = schema or spark.read.json(path).schema
    # A row for each block of a file; beyond that number Spark is left to choose.
    few = F.broadcast(offsets) if offsets.count() <= MOST_BLOCKS else offsets
    rows = lines.join(few, block).select((F.col("__id") + F.col("__shift")).alias("ord"), F.from_json("value", kind).alias("r"))
    return (rows if first is None else rows.where(F.col("ord") < first)).select("ord", "r.*")


def read_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CLEANED).json(f"{folder}/*.jsonl")


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHAT).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_evaluation(spark: SparkSession, tests: Iterable[str], curated: Iterable[str] = ()) -> DataFrame:
    """(id, source, category, question, gold) of chat files and of curated questions.

    A chat record counts with its first user and first assistant message, if it has the
    former. Curated records have question and perhaps id, source, category and gold. A missing
    file is left out with a warning.
    """
    out = spark.createDataFrame([], "id string, source string, category string, question string, gold string")
    of = lambda role: F.get(F.filter("messages", lambda m: m["role"] == role), F.lit(0))["content"]

    def default(column: str, other: Column) -> Column:
        return F.coalesce(F.col(column), other).alias(column)

    for paths, chat in ((tests, True), (curated, False)):
        for path in paths:
            if not _exists(spark, path):
                warnings.warn(f"no file {path}, left out", stacklevel=2)
                continue
            if chat:
                rows = read_chat(spark, path).select("id", F.lit("test").alias("source"), of("user").alias("question"), of("assistant").alias("gold"), F.lit(None).cast("string").alias("category"))
            else:
                rows = spark.read.schema(CURATED).json(path)
            rows = rows.where("question is not null")
            out = out.unionByName(rows.select(
                default("id", F.lit("test-?" if chat else "curated-?")), default("source", F.lit("curated")), default("category", category_of(F.col("question"))), "question", "gold"))
    return out


def write_sample(df: DataFrame, path: str, n: int = 300, order: str = "ord") -> None:
    df.orderBy(order).limit(n).drop(order).write.mode("overwrite").json(path)


def write_samples(spark: SparkSession, sources: dict[str, DataFrame], folder: str, n: int = 300, order: str = "ord") -> DataFrame:
    """A sample of each source in a folder of its own, and what was written: (source, path, rows)."""
    rows = []
    for name, df in sources.items():
        path = f"{folder}/{name}"
        write_sample(df, path, n, order)
        rows.append((name, path, spark.read.text(path).count()))
    manifest = spark.createDataFrame(rows, "source string, path string, rows long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


def write_cleaned(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").partitionBy("source").json(folder)


def write_splits(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").partitionBy("split").json(folder)


#: Columns of the result table; the judge's are null where no judge was asked.
RESULT_COLUMNS = ("id", "source", "category", "question", "gold", "generated", *METRICS, "judge_relevance", "judge_helpfulness")


def result_rows(rows: DataFrame) -> DataFrame:
    """The columns of the result table, those that are missing as nulls."""
    kinds = {"judge_relevance": "int", "judge_helpfulness": "int"}
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in RESULT_COLUMNS])


def write_results(rows: DataFrame, summary: DataFrame, folder: str, categories: DataFrame | None = None) -> None:
    """Result rows as JSON and CSV, the summary by metric, and by category if given, as fixed-width text.

    categories: (category, n, rubric, relevance, keyword_coverage, coherence, share).
    """
    out = result_rows(rows)
    out.write.mode("overwrite").json(f"{folder}/results.json")
    out.write.mode("overwrite").option("header", "true").csv(f"{folder}/results.csv")
    line = F.format_string("%-20s %8d %8.3f %8.3f %8.3f", "metric", "n", "mean", "median", "stdev")
    text = summary.select(F.lit(1).alias("part"), F.col("metric").alias("name"), line.alias("value"))
    if categories is not None:
        by = F.format_string("%-18s %5d %8.3f %8.3f %8.3f %8.3f %7.1f%%", "category", "n", "rubric", "relevance", "keyword_coverage", "coherence", F.col("share") * 100)
        head = categories.sparkSession.createDataFrame([(2, "", "%-18s %5s %8s %8s %8s %8s %8s" % ("category", "n", "rubric", "rel", "cov", "coh", "good%"))], "part int, name string, value string")
        text = text.union(head).union(categories.select(F.lit(3).alias("part"), F.col("category").alias("name"), by.alias("value")))
    text.coalesce(1).sortWithinPartitions("part", "name").select("value").write.mode("overwrite").text(f"{folder}/summary.txt")


def write_loss_log(log: DataFrame, path: str) -> None:
    """Training log entries that have a loss, as (step, epoch, loss) lines."""
    log.where("loss is not null").select("step", "epoch", "loss").write.mode("overwrite").json(path)
