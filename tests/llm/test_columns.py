"""Extra columns whose names operators use inside: results stay, and so do the columns."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.jaccard_join import jaccard_join
from ledgerloom.llm.language import identify, learn
from ledgerloom.llm.line_templates import _dropped_by_join, drop_recurring_lines, recurring_lines
from ledgerloom.llm.mixing import mixed_sizes
from ledgerloom.llm.packing import pack
from ledgerloom.llm.quality import classify, fit_evidence

from ..conftest import SMALL

NAMES = (
    "mix_hash", "mix_check", "mix_slot", "mix_length", "mix_size", "evidence", "host", "path", "key", "check", "gone", "site", "row", "id", "n", "label", "group", "template", "part", "word", "sid",
    "before", "rep", "kind", "x", "rows", "Key", "_1", "a b")


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 120")
    names = [n for k, n in enumerate(NAMES) if n.lower() not in {m.lower() for m in NAMES[:k]}]
    return docs, docs.withColumns({n: F.col("doc_id") * 3 for n in names}), names


def by_id(df, columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in df.select(*columns).collect())


def test_results_do_not_depend_on_other_columns(spark, tables):
    docs, clashing, _ = tables
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    evidence = fit_evidence(docs, labels)
    model = learn(docs.where("text is not null and lang is not null").select("text", "lang"))
    for run, columns in (
            (jaccard_join, ["doc_id", "n_shingles", "component_id"]), (lambda d: identify(d, model), ["doc_id", "lang_pred"]), (lambda d: pack(d.coalesce(1)), ["doc_id", "start", "length", "ids_crc32"]),
            (lambda d: classify(d, evidence, labels), ["doc_id", "quality_kept"]), (drop_recurring_lines, ["doc_id", "text", "dropped_lines"]), (mixed_sizes, ["doc_id", "size", "source_size", "target"])):
        assert by_id(run(docs), columns) == by_id(run(clashing), columns)
    model.forget()


def test_other_columns_pass(spark, tables):
    docs, clashing, names = tables
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, SMALL)
        assert out.columns == clashing.columns, name
        assert out.where(" or ".join(f"`{n}` != 3 * doc_id" for n in names)).count() == 0 and out.count() > 0, name
    drop, _ = recurring_lines(clashing)
    joined = _dropped_by_join(clashing, drop, "text")
    assert joined.columns == [*clashing.columns, "dropped_lines"] and joined.where("key != 3 * doc_id or gone != 3 * doc_id").count() == 0


def test_session_settings_stay(spark, tables):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    pack(tables[0])
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
