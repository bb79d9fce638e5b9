"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_text import extract
from .jaccard_join import jaccard_join
from .language import identify, learn
from .line_templates import drop_recurring_lines
from .mixing import mixed_sizes
from .near_vectors import near_vectors
from .oracles import PREFIX_TRIE
from .packing import pack
from .periodic_runs import periodic_runs
from .prefix_trie import prefix_trie
from .quality import classify, fit_evidence
from .toxicity import learn as learn_toxicity
from .toxicity import toxicity
from .url_filter import judge_urls
from .vector_graph import nearest
from .work import crc_of_id, table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents whose crc32 leaves 0 or 2 modulo 3; predicts all."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_of_id(F.col("doc_id")) % 3 == 1
    model = learn(docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang"))
    out = identify(docs, model, held_out=held_out)
    model.forget()
    return out


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the posterior that the document is good, and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    labels = table(spark, sf_dir, "labels")
    return classify(docs, fit_evidence(docs, labels), labels, keep_text=False).select("doc_id", "quality_score", "quality_kept")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the places of the lines that went, their number, and the text that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_recurring_lines(docs).select("doc_id", "dropped_lines", F.size("dropped_lines").alias("n_dropped"), "text")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents whose crc32 does not leave 0 modulo 5; scores all."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_of_id(F.col("doc_id")) % 5 == 0
    return toxicity(docs, learn_toxicity(docs.where(~held_out), labels.where(~held_out)), held_out)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"), rebuild=True)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose ids ask for it are rewritten first."""
    return periodic_runs(table(spark, sf_dir, "documents"), loop=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    known = (op1_embedding_near_dedup, op2_language_id, op3_packing, op4_url_filter, op5_nearest_neighbours, op6_quality_classifier, op7_mixing, op8_html_extraction, op9_line_dedup, op10_ngram_jaccard_join, op11_toxicity, op12_prefix_trie, op13_periodic_runs)
    return {f.__name__: f for f in known}


def oracle_sql() -> dict[str, str]:
    return {"op12_prefix_trie": PREFIX_TRIE}
