"""Many phrases looked for in one pass over a text.

The expressions of :mod:`metrics` and of the advice topics look a text through once for each
phrase. Here an automaton of all phrases (Aho and Corasick) reads it once, in Arrow batches,
and gives which phrases occur and how often; overlapping phrases are all found, and a phrase's
own occurrences count without overlaps, from the left. Categories, terms and topics follow from these
few numbers by expressions, so several questions to one text share its pass. Worth it for long
texts; for a short one ``contains`` is as good.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import ADVICE_CATEGORIES, DEFINITION, QUESTION_CATEGORIES
from .metrics import TERMS
from .text import argmax

MENTIONS = "array<struct<phrase:int,n:int>>"
#: All phrases of categories and topics, each once.
PHRASES = tuple(dict.fromkeys(p for sets in (QUESTION_CATEGORIES, ADVICE_CATEGORIES) for words in sets.values() for p in words))


def mentions(text: Column, phrases: Sequence[str] = PHRASES) -> Column:
    """(phrase, n) of each phrase that a text contains, by its place among the phrases; null for null.

    The texts are taken as they are: lower them first where case does not count.
    """
    phrases = list(phrases)
    if not all(phrases) or len(set(phrases)) < len(phrases):
        raise ValueError("phrases must be different and not empty")

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, p in enumerate(phrases):
            automaton.add_word(p, (k, len(p)))
        if phrases:
            automaton.make_automaton()
        for texts in batches:
            offsets, ids, counts = [0], [], []
            for t in texts.to_pylist():
                if t is None:
                    offsets[-1] = None
                    offsets.append(len(ids))
                    continue
                n, free = {}, {}
                for end, (k, size) in automaton.iter(t) if phrases else ():
                    if end - size >= free.get(k, -1):
                        free[k] = end
                        n[k] = n.get(k, 0) + 1
                for k in sorted(n):
                    ids.append(k)
                    counts.append(n[k])
                offsets.append(len(ids))
            yield pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(ids, pa.int32()), pa.array(counts, pa.int32())], ["phrase", "n"]))

    scan.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scan, MENTIONS)(text)


def _ids(words: Sequence[str], phrases: Sequence[str]) -> list[int]:
    at = {p: k for k, p in enumerate(phrases)}
    return [at[w] for w in words]


def _among(words: Sequence[str], phrases: Sequence[str]) -> Column:
    return F.array(*[F.lit(k) for k in _ids(words, phrases)])


def distinct_hits(found: Column, words: Sequence[str], phrases: Sequence[str] = PHRASES) -> Column:
    """How many of the words were found."""
    own = _among(words, phrases)
    return F.size(F.filter(found, lambda m: F.array_contains(own, m["phrase"])))


def total_hits(found: Column, words: Sequence[str], phrases: Sequence[str] = PHRASES) -> Column:
    """How often any of the words was found."""
    own = _among(words, phrases)
    return F.aggregate(F.filter(found, lambda m: F.array_contains(own, m["phrase"])), F.lit(0), lambda a, m: a + m["n"])


def _largest(sets: Mapping[str, Sequence[str]], score) -> tuple[Column, Column]:
    return argmax([(name, score(words)) for name, words in sets.items()])


def category_found(found: Column) -> Column:
    """:func:`metrics.category_of`, from what was found in the lower-cased question."""
    name, top = _largest(QUESTION_CATEGORIES, lambda words: distinct_hits(found, words))
    return F.when(top > 0, name).otherwise(F.lit("general"))


def terms_found(found: Column) -> Column:
    """:func:`metrics.matched_terms`: the terms, longest first."""
    own = _ids(TERMS, PHRASES)
    ranked = F.array(*[F.lit(own.index(k)) if k in own else F.lit(None).cast("int") for k in range(len(PHRASES))])
    names = F.array(*[F.lit(t) for t in TERMS])
    places = F.array_sort(F.filter(F.transform(found, lambda m: F.get(ranked, m["phrase"])), lambda r: r.isNotNull()))
    return F.transform(places, lambda r: F.get(names, r))


def topic_found(found: Column, whole: Column) -> Column:
    """The advice topic of a text with most mentions, the first of equals; definitions are Concepts."""
    name, top = _largest(ADVICE_CATEGORIES, lambda words: total_hits(found, words))
    asks = whole.rlike("(?U)(?i)" + DEFINITION)
    return F.when(top == 0, F.when(asks, "Concepts").otherwise("General")).when(asks & (top <= 2), "Concepts").otherwise(name)


def with_phrases(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds category, terms and topic of a text that is read through once; a null text gives nulls.

    What was found comes out of a generator: filters on the results would else scan again.
    """
    found = df.select("*", mentions(F.lower(F.col(text))).alias("__found")).select("*", F.inline(F.array(F.struct(F.col("__found").alias("__once"))))).drop("__found")
    once, given = F.col("__once"), F.col(text).isNotNull()
    return found.withColumns({
        "category": F.when(given, category_found(once)), "terms": F.when(given, terms_found(once)), "topic": F.when(given, topic_found(once, F.col(text)))}).drop("__once")
