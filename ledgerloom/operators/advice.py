"""Advice items: the gate, the topic, a title and the sentence that matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ADVICE_CATEGORIES, ADVICE_MARKERS, DEFINITION
from ..functions.text import from_argmax, n_words, named_once, occurrences, sentences, strip, truncate, word_list

# Marks that make a short reply advice, and role marks of models.
GATE_MARKERS = [
    "pay off", "pay down", "save", "invest", "start", "should", "make sure", "consider", "reduce", "create", "build", "contribute", "set up", "avoid",
    "track", "cut back", "rebalance", "choose", "keep", "add", "review"]
ROLE_MARKS = ["<|im_end|>", "<|endoftext|>", "</s>"]
TITLE = 64
RECOMMENDATION = 180
#: All topics of advice.
TOPICS = (*ADVICE_CATEGORIES, "Concepts", "General")


def is_advice(reply: Column, least: int = 12, short: int = 4) -> Column:
    """Long replies are advice; short ones are if they say something to do."""
    n, low = n_words(reply), F.lower(reply)
    return F.when(n < short, False).when(n >= least, True).otherwise(F.exists(word_list(GATE_MARKERS), lambda m: F.contains(low, m)))


def topic(text: Column, question: Column | None = None) -> Column:
    """The topic with most mentions, the first of equals; definitions are Concepts."""
    whole = text if question is None else F.concat_ws(" ", F.when(text != "", text), F.when(question != "", question))
    asks = whole.rlike("(?U)(?i)" + DEFINITION)
    return named_once(F.lower(whole), lambda low: from_argmax(
        [(k, sum((occurrences(low, w) for w in words), F.lit(0))) for k, words in ADVICE_CATEGORIES.items()],
        lambda name, top: F.when(top == 0, F.when(asks, "Concepts").otherwise("General")).when(asks & (top <= 2), "Concepts").otherwise(name)))


def clean(raw: Column) -> Column:
    c = F.coalesce(raw, F.lit(""))
    for mark in ROLE_MARKS:
        c = F.replace(c, F.lit(mark), F.lit(""))
    c = strip(F.regexp_replace(c, r"(?U)\s*\n\s*", "\n"))
    return strip(F.regexp_replace(c, r"[ \t]{2,}", " "))


def _opening(text: Column) -> Column:
    """The first sentence of four words or more, else the start of the text."""
    return F.coalesce(F.get(F.filter(sentences(text), lambda s: n_words(s) >= 4), F.lit(0)), truncate(text, TITLE))


def title(text: Column, category: Column) -> Column:
    fallback = F.concat(category, F.lit(" guidance"))
    first = _opening(text)
    bare = F.regexp_replace(first, r"(?U)(?i)^(yes\.\s*|there (are|is)\s+|there's\s+|here are\s+)", "")
    name = truncate(F.regexp_replace(bare, r"[.:;]+$", ""), TITLE)
    return F.when((first == "") | (name == ""), fallback).otherwise(F.concat(F.upper(F.left(name, F.lit(1))), F.substr(name, F.lit(2))))


def recommendation(text: Column) -> Column:
    """The sentence with most marks of advice, then most words, the first of equals."""
    parts = sentences(text)
    marks = lambda s: sum((occurrences(F.lower(s), m) for m in ADVICE_MARKERS), F.lit(0))
    ranked = F.transform(parts, lambda s, k: F.struct(marks(s).alias("marks"), n_words(s).alias("words"), (-k).alias("k"), s.alias("s")))
    best = F.array_max(ranked)
    chosen = F.when(best["marks"] == 0, F.when(_opening(text) != "", _opening(text)).otherwise(best["s"])).otherwise(best["s"])
    return F.when(F.size(parts) == 0, truncate(text, RECOMMENDATION)).otherwise(truncate(F.regexp_replace(chosen, r"[.:;]+$", ""), RECOMMENDATION))


def structured(pairs: DataFrame, raw: str = "response", question: str = "question") -> DataFrame:
    """Adds category, short_title, key_recommendation, full_text; empty bodies go."""
    body = pairs.withColumn("full_text", clean(F.col(raw))).where("full_text != ''")
    body = body.withColumn("category", topic(F.col("full_text"), F.coalesce(F.col(question), F.lit(""))))
    return body.withColumns({"short_title": title(F.col("full_text"), F.col("category")), "key_recommendation": recommendation(F.col("full_text"))})


def valid_advice() -> Column:
    """Are all texts there and is the category known, after its first letter is raised?"""
    texts = [F.coalesce(F.length(c) > 0, F.lit(False)) for c in ("short_title", "key_recommendation", "full_text", "source_question")]
    return texts[0] & texts[1] & texts[2] & texts[3] & F.coalesce(F.initcap(F.lower("category")).isin(*TOPICS), F.lit(False))
