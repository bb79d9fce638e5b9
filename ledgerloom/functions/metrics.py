"""Response-quality metrics as Column expressions over tokens computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import GOOD_RUBRIC, QUESTION_CATEGORIES
from .text import contained, from_argmax, named_once, plain_words, strip, word_list

TERMS = sorted({t for words in QUESTION_CATEGORIES.values() for t in words}, key=lambda t: (-len(t), t))
METRICS = ("word_count", "char_count", "length_adequacy", "repetition_score", "punctuation_score", "coherence", "keyword_coverage", "relevance", "rubric")


def category_of(question: Column) -> Column:
    """The category with most key phrases in the question; general without any."""
    return named_once(F.lower(question), lambda q: from_argmax(
        [(k, contained(q, words)) for k, words in QUESTION_CATEGORIES.items()], lambda name, top: F.when(top > 0, name).otherwise(F.lit("general"))))


def matched_terms(question: Column) -> Column:
    q = F.lower(question)
    return F.filter(word_list(TERMS), lambda t: F.contains(q, t))


def rouge1(reference: Column, generated: Column) -> Column:
    """F1 of the distinct words of two word arrays; 0 if either is empty."""
    a, b = F.array_distinct(reference), F.array_distinct(generated)
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (both == 0), 0.0).otherwise(
        2 * (both / F.size(b)) * (both / F.size(a)) / (both / F.size(b) + both / F.size(a)))


def length_adequacy(n: Column, least: int = 15, most: int = 250) -> Column:
    return F.when(n < least, n / least).when(n <= most, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (n - most) / 250.0))


def repetition(words: Column) -> Column:
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    again = F.size(pairs) - F.size(F.array_distinct(pairs))
    return F.when(n < 4, 0.8).otherwise(F.greatest(F.lit(0.0), 1 - again / F.size(pairs) * 4.0))


def punctuation(text: Column, n: Column) -> Column:
    ends = F.regexp_count(strip(text), F.lit(r"(?U)[.!?](?=\s|$)"))
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), ends / F.greatest(F.lit(1), F.ceil(n / 15))))


def with_metrics(df: DataFrame, question: str = "question", response: str = "response") -> DataFrame:
    """Adds the nine metrics, rounded to three places (the rubric to two first)."""
    out = df.withColumns({"__q": plain_words(F.col(question)), "__r": plain_words(F.col(response)), "__terms": matched_terms(F.col(question))})
    out = out.withColumns({"__n": F.size("__r"), "__rouge": rouge1(F.col("__q"), F.col("__r"))})
    n, answer = F.col("__n"), F.lower(F.col(response))
    covered = F.size(F.filter("__terms", lambda t: F.contains(answer, t)))
    out = out.withColumns({
        "__len": length_adequacy(n), "__rep": repetition(F.col("__r")), "__pun": punctuation(F.col(response), n),
        "__cov": F.when(F.size("__terms") == 0, F.col("__rouge")).otherwise(covered / F.size("__terms")),
    })
    out = out.withColumns({
        "__coh": 0.55 * F.col("__rep") + 0.45 * F.col("__pun"),
        "__rel": F.when(F.size("__terms") > 0, 0.6 * F.col("__cov") + 0.4 * F.col("__rouge")).otherwise(F.col("__cov")),
    })
    overall = 0.5 * F.col("__rel") + 0.3 * F.col("__coh") + 0.2 * F.col("__len")
    values = (
        n.cast("double"), F.length(strip(F.col(response))).cast("double"), F.round("__len", 3), F.round("__rep", 3), F.round("__pun", 3),
        F.round("__coh", 3), F.round("__cov", 3), F.round("__rel", 3), F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.round(overall * 5, 2))))
    return out.withColumns(dict(zip(METRICS, values))).select(*df.columns, *METRICS)


def long_form(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.unpivot(keys, list(METRICS), "metric", "value")


def summarise(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, n, mean, median, stdev, min, max), all rounded to three places."""
    r = lambda c: F.round(c, 3)
    return long_form(df, keys).groupBy(*keys, "metric").agg(
        F.count("value").alias("n"), r(F.avg("value")).alias("mean"), r(F.median("value")).alias("median"),
        r(F.stddev_pop("value")).alias("stdev"), r(F.min("value")).alias("min"), r(F.max("value")).alias("max"))


def quality_share(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, n_good, share) of rows whose rubric reaches GOOD_RUBRIC."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("rubric") >= GOOD_RUBRIC).alias("n_good"),
        F.round(F.coalesce(F.try_divide(F.count_if(F.col("rubric") >= GOOD_RUBRIC), F.count("*")), F.lit(0.0)), 3).alias("share"))
