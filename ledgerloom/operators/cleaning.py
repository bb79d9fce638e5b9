"""Corpus cleaning: normalise, give each record its first reason to go, deduplicate, count."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import alpha_ratio, encoding_changes, fix_replacement, lexicon_hits, n_words, squeeze, with_normal_text, with_pii_count
from ..lineage import cut
from .likeness import greedy_dropped, within_edits

#: Why a record goes, in the order that counts.
REASONS = ("unparseable", "question_too_short", "question_too_long", "answer_too_short", "answer_too_long", "low_alpha_ratio", "non_financial", "profiling")


def parse_raw(raw: DataFrame, source: str, field_map: Mapping[str, tuple[str, str]] = K.FIELD_MAP) -> DataFrame:
    """(ord kept, source, question, answer, aux) of one source; unknown sources give nulls.

    aux maps the other fields to their texts; values that are not text keep their JSON form.
    """
    fields = field_map.get(source)
    kinds = dict(raw.dtypes)
    others = [c for c in raw.columns if c not in (*(fields or ()), "ord")]
    as_text = lambda c: F.col(c) if kinds[c] == "string" else F.to_json(c) if kinds[c].startswith(("struct", "array", "map")) else F.col(c).cast("string")
    aux = F.map_from_arrays(F.array(*[F.lit(c) for c in others]), F.array(*[as_text(c) for c in others])) if others else F.create_map().cast("map<string,string>")
    field = lambda k: F.col(fields[k]) if fields and kinds.get(fields[k]) == "string" else F.lit(None).cast("string")
    keep = ["ord"] if "ord" in raw.columns else []
    return raw.select(*keep, F.lit(source).alias("source"), field(0).alias("question"), field(1).alias("answer"), aux.alias("aux"))


def is_profiling(question: Column) -> Column:
    """Does the text ask for a person's own salary, worth, score and the like?"""
    out = F.lit(False)
    for pattern in K.PROFILING:
        out = out | question.rlike(pattern)
    return F.coalesce(out, F.lit(False))


def _limit(name: str, by_source: Mapping[str, Mapping[str, float]], limits: Mapping[str, float]) -> Column:
    out = F.lit(limits[name])
    for source, own in by_source.items():
        if name in own:
            out = F.when(F.col("source") == source, F.lit(own[name])).otherwise(out)
    return out


def with_reason(
    records: DataFrame, lexicon: Sequence[str] = K.FINANCIAL_LEXICON, limits: Mapping[str, float] = K.CLEANING,
    by_source: Mapping[str, Mapping[str, float]] = K.CLEANING_BY_SOURCE, profiling: bool = True,
) -> DataFrame:
    """Rows (…, question, answer normalised, pii, encoding, reason); reason is null for the kept.

    pii counts personal data in the text before normalisation, encoding the characters that
    NFKC changes.
    """
    q, a = F.col("question"), F.col("answer")
    whole = q.isNotNull() & a.isNotNull()
    given = records.withColumns({"__whole": whole, "__q": F.when(whole, fix_replacement(q)), "__a": F.when(whole, fix_replacement(a))})
    counted = with_pii_count(given, ("__q", "__a"), "pii").withColumn("encoding", F.when(F.col("__whole"), encoding_changes(q) + encoding_changes(a)).otherwise(0))
    out = with_normal_text(counted.drop("__q", "__a"), ("question", "answer"))
    at = lambda name: _limit(name, by_source, limits)
    tests = (
        ~F.col("__whole"), F.length(q) < at("min_question_chars"), F.length(q) > at("max_question_chars"),
        (F.length(a) < 1) | (n_words(a) < at("min_answer_words")), F.length(a) > at("max_answer_chars"),
        alpha_ratio(q) < at("min_alpha_ratio"), lexicon_hits(q, lexicon) + lexicon_hits(a, lexicon) < at("min_financial_hits"),
        is_profiling(q) if profiling else F.lit(False))
    reason = F.coalesce(*[F.when(test, name) for name, test in zip(REASONS, tests)])
    return out.withColumn("reason", reason).drop("__whole")


def record_id(source: Column, ord_: Column) -> Column:
    return F.format_string("%s-%04d", source, ord_)


def reason_counts(flagged: DataFrame) -> DataFrame:
    counts = flagged.groupBy("source", "reason").agg(F.count("reason").alias("n"))
    return counts.where("n > 0")


def reason_pivot(flagged: DataFrame) -> DataFrame:
    return flagged.where("reason is not null").groupBy("source").pivot("reason", list(REASONS)).count().na.fill(0)


def corpus_summary(flagged: DataFrame) -> DataFrame:
    """(source, n_before, n_kept, n_pii, n_encoding), with a TOTAL row."""
    out = flagged.rollup("source").agg(
        F.count("*").alias("n_before"), F.count_if(F.col("reason").isNull()).alias("n_kept"), F.sum("pii").alias("n_pii"), F.sum("encoding").alias("n_encoding"),
        F.grouping("source").alias("g"))
    return out.withColumn("source", F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("source"))).drop("g")


def question_key(c: Column) -> Column:
    return squeeze(F.lower(c))


def dedup_exact(records: DataFrame, order: str = "ord") -> DataFrame:
    """Adds ``kind``: kept, exact (a question and answer seen before) or same_question.

    The first record of a source and question stays, whatever the partitioning. Its place and
    answer come from a partial aggregate, so a question that fills a source does not meet in
    one task. Records with an empty question get a null kind.
    """
    keyed = records.withColumn("__q", question_key(F.col("question"))).withColumn("__a", question_key(F.col("answer")))
    first = keyed.where("__q != ''").groupBy("source", "__q").agg(F.min(F.struct(order, "__a")).alias("__first"))
    same = F.when(F.col(order) == F.col(f"__first.{order}"), "kept").when(F.col("__a") == F.col("__first.__a"), "exact").otherwise("same_question")
    return keyed.join(first, ["source", "__q"], "left").withColumn("kind", F.when(F.col("__first").isNotNull(), same)).select(*records.columns, "kind")


def dedup_fuzzy(records: DataFrame, order: str = "ord", threshold: float = K.FUZZY_THRESHOLD, prefix: int = K.BLOCK_PREFIX) -> DataFrame:
    """As :func:`dedup_exact`, with kind ``fuzzy`` for questions near an earlier kept one.

    A question is compared with the kept ones of its source that share its first ``prefix``
    characters, in order. Only distinct questions are compared; copies of a fuzzy question are
    fuzzy. ``order`` is a number, distinct within a source.
    """
    exact = dedup_exact(records, order).withColumn("__q", question_key(F.col("question")))
    block = F.to_json(F.struct("source", F.left("__q", F.lit(prefix))))
    distinct = cut(exact.where("kind = 'kept'").select("source", block.alias("block"), F.col(order).cast("long").alias("ord"), F.col("__q").alias("text")))
    near = distinct.join(greedy_dropped(distinct, threshold), ["block", "ord"], "left_semi").select("source", F.col("text").alias("__q"), F.lit(True).alias("__near"))
    return exact.join(near, ["source", "__q"], "left").withColumn("kind", F.when(F.col("__near"), "fuzzy").otherwise(F.col("kind"))).select(*records.columns, "kind")


def near_pairs(texts: DataFrame, most: float = 0.08) -> DataFrame:
    """(a, b, distance): all pairs whose Levenshtein distance is at most ``most`` of the longer, wherever they differ.

    texts has (ord, question) with distinct numbers; questions that are empty are left out.
    """
    rows = texts.select(F.col("ord").cast("long").alias("ord"), question_key(F.col("question")).alias("text")).where("text != ''")
    return within_edits(rows, most)


def dedup_counts(kinds: DataFrame) -> DataFrame:
    return kinds.where("kind is not null").groupBy("source", "kind").agg(F.count("*").alias("n"))
