"""Text functions as Column expressions. All take and return columns unless noted."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import PII

# Typographic characters and their plain forms, applied after NFKC.
PUNCTUATION = {
    "‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"',
    "–": "-", "—": "-", "−": "-", "…": "...", " ": " ",
}


def strip(c: Column) -> Column:
    """Both ends without white space of any script."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, ends stripped."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def collapse_light(c: Column, max_newlines: int = 2) -> Column:
    """Runs of blanks to one, three or more newlines to ``max_newlines``, ends stripped."""
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n" * max_newlines))


def named_once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), where the plan holds c only once however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def fix_replacement(c: Column) -> Column:
    """U+FFFD between letters to an apostrophe, elsewhere to nothing."""
    return named_once(c, lambda x: F.when(F.contains(x, F.lit("�")), _fixed(x)).otherwise(x))


def _fixed(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, "(?<=[A-Za-z])�(?=[A-Za-z])", "'"), F.lit("�"), F.lit(""))


def count_replacement(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("�"), F.lit("")))


_SLICE = 256  # texts of an Arrow batch that are Python objects at once


def by_slices(f: Callable[[str], object], kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    """f of each text of an Arrow array, a slice after another: a batch of long texts, held as Python
    strings before and after, is several times as large as it is in Arrow."""
    def run(texts: pa.Array) -> pa.Array:
        done = [pa.array([None if x is None else f(x) for x in texts.slice(k, _SLICE).to_pylist()], kind) for k in range(0, len(texts), _SLICE)]
        return pa.concat_arrays(done) if done else pa.array([], kind)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return run


def _nfkc(x: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFKC", x)


def _nfkc_changes(x: str) -> int:
    import re
    import unicodedata
    from collections import Counter

    return sum(n for c, n in Counter(re.findall(_NOT_ASCII, x)).items() if unicodedata.normalize("NFKC", c) != c)


_NOT_ASCII = r"[^\x00-\x7F]"


def normalize_unicode(c: Column) -> Column:
    """NFKC, then plain punctuation. Only texts beyond ASCII go to Python.

    Give it a column rather than an expression, which it would name three times.
    """
    c = F.coalesce(F.arrow_udf(by_slices(_nfkc, pa.string()), "string")(F.when(c.rlike(_NOT_ASCII), c)), c)
    single = {k: v for k, v in PUNCTUATION.items() if len(v) == 1}
    c = F.translate(c, "".join(single), "".join(single.values()))
    for k, v in PUNCTUATION.items():
        if len(v) > 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    return c


def encoding_changes(c: Column) -> Column:
    """How many characters NFKC would change."""
    return F.coalesce(F.arrow_udf(by_slices(_nfkc_changes, pa.int32()), "int")(F.when(c.rlike(_NOT_ASCII), c)), F.lit(0))


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]{1,256}>", " ")


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(?i)https?://\S+", " ")


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def redact_pii(c: Column) -> Column:
    """Personal data to [KIND], kind after kind."""
    for kind, pattern in PII:
        c = F.regexp_replace(c, pattern, f"[{kind}]")
    return c


def count_pii(c: Column) -> Column:
    """How many replacements :func:`redact_pii` makes."""
    total = F.lit(0)
    for kind, pattern in PII:
        total = total + F.regexp_count(c, F.lit(pattern))
        c = F.regexp_replace(c, pattern, f"[{kind}]")
    return total


def _redacted(c: Column, kind: str, pattern: str) -> Column:
    """One kind of personal data to its mark; texts without an @ or a digit are passed by."""
    held = (lambda x: F.contains(x, F.lit("@"))) if kind == "EMAIL" else lambda x: x.rlike("[0-9]")
    return named_once(c, lambda x: F.when(held(x), F.regexp_replace(x, pattern, f"[{kind}]")).otherwise(x))


def with_pii_count(df: DataFrame, texts: Sequence[str], name: str) -> DataFrame:
    """Adds how many replacements :func:`redact_pii` makes in some columns of texts.

    One chain of replacements, a step at a time, so that no step is computed twice: what a
    step replaces is how many of its marks are new.
    """
    columns, out = df.columns, df.withColumn(name, F.lit(0))
    now = {t: F.coalesce(F.col(t), F.lit("")) for t in texts}
    for n, (kind, pattern) in enumerate(PII):
        mark = f"[{kind}]"
        before = {t: f"__{n}_{k}" for k, t in enumerate(texts)}
        after = {t: f"__{n}_{k}_" for k, t in enumerate(texts)}
        out = out.withColumns({before[t]: now[t] for t in texts}).withColumns({after[t]: _redacted(F.col(before[t]), kind, pattern) for t in texts})
        more = [occurrences(F.col(after[t]), mark) - occurrences(F.col(before[t]), mark) for t in texts]
        out = out.withColumn(name, sum(more, F.col(name)))
        now = {t: F.col(after[t]) for t in texts}
    return out.select(*[c for c in columns if c != name], name)


#: Steps of the normalisation, and what a text must contain for one to change it.
_STEPS = {"control": (strip_control, None), "html": (strip_html, "<"), "urls": (strip_urls, "://")}


def with_normal_text(df: DataFrame, texts: Sequence[str], light: bool = False, unicode: bool = True, pii: bool = True, max_newlines: int = 2, **on: bool) -> DataFrame:
    """The texts normalised in place, null to an empty text: replacement characters, Unicode,
    control characters, HTML, URLs, personal data, white space. A step whose name is given
    as False is left out. A filter on the result is not moved before it, where it would
    compute the texts anew for each time that it names them: they come out of a generator.
    """
    out = df.withColumns({t: fix_replacement(F.coalesce(F.col(t), F.lit(""))) for t in texts})
    if unicode:
        out = out.withColumns({t: normalize_unicode(F.col(t)) for t in texts})

    def rest(c: Column) -> Column:
        for name, (step, mark) in _STEPS.items():
            if on.get(name, True):
                c = named_once(c, lambda x: F.when(F.contains(x, F.lit(mark)), step(x)).otherwise(x)) if mark else step(c)
        for kind, pattern in PII if pii else ():
            c = _redacted(c, kind, pattern)
        return collapse_light(c, max_newlines) if light else squeeze(c)

    normal = F.struct(*[rest(F.col(t)).alias(t) for t in texts])
    return out.select(*[c for c in df.columns if c not in texts], F.inline(F.array(normal))).select(*df.columns)


def alpha_ratio(c: Column) -> Column:
    """Share of ASCII letters among characters that are not white space; 0 without any."""
    dense = F.regexp_replace(c, r"(?U)\s+", "")
    letters = F.length(F.regexp_replace(dense, "[^A-Za-z]", ""))
    return F.coalesce(F.try_divide(letters, F.length(dense)), F.lit(0.0))


def word_list(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lexicon_hits(c: Column, lexicon: Sequence[str]) -> Column:
    """How many different lexicon words occur among the tokens."""
    tokens = F.array_distinct(F.split(F.lower(c), r"[^a-z0-9$.-]+"))
    return F.size(F.array_intersect(tokens, word_list(lexicon)))


def plain_words(c: Column) -> Column:
    """The lower-cased words of two or more ASCII letters that no other letter or digit touches."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[a-z]{2,}$"))


def occurrences(c: Column, phrase: str) -> Column:
    """How often the phrase occurs, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def contained(c: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases the text contains."""
    return F.size(F.filter(word_list(phrases), lambda p: F.contains(c, p)))


def argmax(scores: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """(name, score) of the largest score, the first of equals."""
    top = F.greatest(*[s for _, s in scores]) if len(scores) > 1 else scores[0][1]
    name = F.lit(scores[-1][0])
    for label, score in reversed(scores[:-1]):
        name = F.when(score == top, F.lit(label)).otherwise(name)
    return name, top


def from_argmax(scores: Sequence[tuple[str, Column]], f: Callable[[Column, Column], Column]) -> Column:
    """f(name, score) of :func:`argmax`, where each score is computed once a row."""
    names, last = word_list([label for label, _ in scores]), F.lit(scores[-1][0])

    def told(values: Column) -> Column:
        top = F.array_max(values)
        return f(F.coalesce(F.get(names, F.array_position(values, top).cast("int") - 1), last), top)

    return named_once(F.array(*[s for _, s in scores]), told)


def sentences(c: Column, newlines: bool = False) -> Column:
    """Sentences by end marks and white space (and newlines), blank ones dropped."""
    parts = F.split(c, r"(?U)(?<=[.!?])\s+|\n" if newlines else r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def truncate(c: Column, limit: int) -> Column:
    c = strip(c)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(F.left(c, F.lit(limit - 1)), r"(?U)\s+$", ""), F.lit("…")))


def n_words(c: Column) -> Column:
    """The number of runs between white space."""
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
