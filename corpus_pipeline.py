"""From raw documents to packed training sequences, in five stages.

Every stage reads all that the one before it kept, written as Parquet in between. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.jaccard_join import jaccard_join
from ledgerloom.llm.line_templates import drop_recurring_lines
from ledgerloom.llm.mixing import mixed_documents
from ledgerloom.llm.packing import pack
from ledgerloom.llm.quality import classify, fit_evidence
from ledgerloom.llm.work import discard, leftovers, split_by, stored, table

_left: list[DataFrame] = []


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what the stages before it left in the shared folder: their
    results were written down and read again. What its docs still read stays."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles() if _left else []
        needed = [f for f in _left if any(f.stored_path in file for file in files)]
        discard(*(f for f in _left if not any(f is n for n in needed)))
        _left[:] = needed
        with leftovers(_left):
            return function(spark, docs, sf_dir)

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    labels = table(spark, sf_dir, "labels")
    return classify(docs, fit_evidence(docs, labels), labels).where("quality_kept").select(*docs.columns)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines from the texts; n_chars follows."""
    out = drop_recurring_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked ones, that with the smallest id.

    Rows without an id have no group and stay; of rows that repeat an id one stays. Most
    documents stay as they are, and their texts are not shuffled.
    """
    counts = jaccard_join(docs).where("doc_id is not null").groupBy("doc_id").agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("n"))
    marked = stored(counts.where("n != 1"), "marked", 16)
    alone, others = split_by(docs.where("doc_id is not null"), marked, "doc_id")
    out = alone.union(others.join(marked, "doc_id", "left_anti").select(*docs.columns))
    if marked.where("n > 1").limit(1).count():
        again = others.join(marked.where("n > 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
        out = out.union(again.dropDuplicates(["doc_id"]))
    return out.union(docs.where("doc_id is null"))


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and as far, as the target weights of their sources take them."""
    return mixed_documents(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Model fitting, similarity search and tokenizing have no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
        discard(before)  # the last stage has stored its result
    return docs
