"""Money in text: amounts, labels, and matches with their places."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import named_once, strip

# A labelled amount, and hints near it.
PAIR = r"(?U)([A-Za-z][A-Za-z0-9 &'()/%-]{1,40}?)[ \t]*[:=][ \t]*\$?[ \t]*([\d,]+(?:\.\d{1,2})?)\b"
ANNUAL = r"(?U)(?i)\b(year|annual(?:ly)?|per year|a year)\b"
MONTHLY = r"(?i)(/month|/mo|monthly|per month|each month|a month|every month)"
APR = r"(?U)(?i)\b(\d{1,3}(?:\.\d{1,2})?)\s*%"
INCOME_PHRASE = (
    r"(?U)(?i)\b(?:my\s+|our\s+|i\s+(?:make|earn|bring in|take home)\s+)?(?:income|salary|wages|take[- ]home pay|paycheck)\b"
    r"[^\d$]{0,40}?\$?\s*([\d,]+(?:\.\d{1,2})?)")
INCOME_VERB = r"(?U)(?i)\b(?:i|we)\s+(?:make|earn|bring in|take home)\s+\$?\s*([\d,]+(?:\.\d{1,2})?)"
HAVE_FUNDS = (
    r"(?U)(?i)\b(?:i|we)\s+have\s+\$?\s*([\d,]+(?:\.\d{1,2})?)(?![\d,])"
    r"(?!\s*(?:of|in|on|for)?\s*(?:a|an|some)?\s*(?:credit|debt|loan|mortgage|card(?:s)?|balance|owed|owing)\b)")
# What labels stand for; a label also counts with words before it.
INCOME_LABELS = [
    "income", "monthly income", "net income", "gross income", "salary", "monthly salary", "wages", "take-home", "take home pay", "earnings",
    "pay", "monthly pay", "paycheck"]
DEBT_LABELS = [
    "debt", "debt payment", "debt payments", "loan", "loans", "loan payment", "loan payments", "credit card", "credit card debt", "credit cards",
    "credit card payment", "credit card payments", "minimum payment", "minimum payments", "mortgage", "student loan", "student loans",
    "car loan", "car payment", "car payments", "balance", "balances"]
SAVING_LABELS = [
    "savings", "saving", "savings balance", "savings contribution", "savings contributions", "retirement contribution", "contribution",
    "contributions", "investments", "investment", "401k", "ira", "emergency fund", "savings rate"]

SPAN = "array<struct<all:string,groups:array<string>,start:int,end:int>>"


def spans(text: Column, pattern: str, groups: int = 1) -> Column:
    """All matches of a pattern in order: (all, groups, start, end), places from 0.

    The engine returns matches without places. They follow from the pieces between the
    matches: a match starts after all earlier pieces and matches.
    """
    empty = F.array().cast(SPAN)

    def placed(m: Column) -> Column:
        rows = F.transform(m["hits"], lambda h, k: F.struct(
            h.alias("all"), F.array(*[F.get(m[f"g{j}"], k) for j in range(groups)]).alias("groups"), F.length(F.get(m["between"], k)).alias("gap"), F.length(h).alias("size")))

        def add(acc: Column, r: Column) -> Column:
            start = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)) + r["gap"]
            return F.concat(acc, F.array(F.struct(r["all"].alias("all"), r["groups"].alias("groups"), start.alias("start"), (start + r["size"]).alias("end"))))

        return F.aggregate(rows, empty, add)

    # A lambda computes what it names for each element anew, so matches, pieces and groups are bound first;
    # a text without a match is looked through once.
    found = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    parts = lambda hits: F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("between"), *[found(j + 1).alias(f"g{j}") for j in range(groups)])
    return named_once(found(0), lambda hits: F.when(F.size(hits) > 0, named_once(parts(hits), placed)).otherwise(F.when(hits.isNotNull(), empty)))


def amount(raw: Column) -> Column:
    """A number with thousands commas, null beyond 0 to 1e9."""
    value = F.replace(raw, F.lit(","), F.lit("")).try_cast("double")
    return F.when(value.between(0, 1e9), value)


def around(text: Column, start: Column, end: Column, reach: int = 40) -> Column:
    low = F.greatest(start - reach, F.lit(0))
    return F.substr(text, low + 1, end + reach - low)


def monthly(text: Column, end: Column, value: Column) -> Column:
    """A twelfth of the value if the next 80 characters speak of a year."""
    return F.when(F.substr(text, end + 1, F.lit(80)).rlike(ANNUAL), value / 12.0).otherwise(value)


def label_key(label: Column) -> Column:
    c = F.regexp_replace(F.lower(strip(label)), r"(?U)\s*[/(](monthly|per month|/month|/mo|month)\)?\s*$", "")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^[ :\t-]+|[ :\t-]+$", "")


def stands_for(key: Column, labels: list[str]) -> Column:
    """Is the key one of the labels, or words and then one? One search, not two comparisons a label."""
    return key.rlike("(?:^| )(?:" + "|".join(re.escape(x) for x in labels) + r")\z")


def dollars(value: Column) -> Column:
    """$1,234 or $1,234.50, with a leading minus below zero."""
    v = F.round(value, 2)
    text = F.regexp_replace(F.format_number(F.abs(v), 2), r"\.00$", "")
    return F.when(value.isNotNull(), F.concat(F.when(v < 0, "-$").otherwise("$"), text))


def short_number(value: Column) -> Column:
    """A number without a trailing .0."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def payoff_months(balance: Column, apr: Column, payment: Column) -> Column:
    """Months until a balance with monthly interest is paid; null if it never is."""
    rate = apr / 100.0 / 12.0
    interest = balance * rate
    return F.when(balance <= 0, 0).when(apr.isNull() | payment.isNull() | (payment <= 0) | (payment <= interest), None).when(
        rate == 0, F.ceil(balance / payment)).otherwise(F.ceil(-F.log(1 - interest / payment) / F.log(1 + rate))).cast("int")
