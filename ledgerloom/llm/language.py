"""Language identification: word first, then character n-grams of falling length.

Learning counts all words by language over all training documents, and their n-grams, in
tables that grow with the input. A word of a new text that the table knows adds its log
frequency in each language. Any other word is taken apart: the longest n-grams (from
``LONGEST`` down to 1, with marks at both ends) that are known stand for it, with the mean of
their log frequencies. The language with the largest sum, prior included, wins.

The most frequent words (``CELLS`` scores at most, at least ``LEAST_KEYS`` words) go to all tasks, which add
up what they know of a text; its other words are looked up in the tables by joins, each
distinct word once. Where the line between the two runs does not change a prediction.

Words are runs of letters and the marks that combine with them, lower-cased.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import contained, discard, join_hot, stored

LONGEST = 5
CELLS = 1 << 20
LEAST_KEYS = 1 << 12
BLOCK = 400_000
UNSEEN = 0.1  # what a word or n-gram counts in a language that does not have it
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_BEYOND = re.compile("[^\x00-\u02ff]")  # combining marks are all beyond
_MARKED = regex.compile(r"[^\W\d_]+")  # marks are word characters to this module


# Texts within Latin-1 are cut on bytes: what is no letter there is a space.
_LATIN = bytes(k if _LETTERS.match(chr(k)) else 32 for k in range(256))


def words(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        pass
    return (_MARKED if _BEYOND.search(text) else _LETTERS).findall(text)


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


def _table(counts: Counter) -> pa.RecordBatch:
    langs, keys = zip(*counts) if counts else ((), ())
    return pa.record_batch([pa.array(langs, pa.int32()), pa.array(keys, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "key", "n"])


_COUNTS = "lang int, key string, n long"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
            for word, n in Counter(words(text.as_py())).items():
                counts[lang, word] += n
            if len(counts) > BLOCK:
                yield _table(counts)
                counts.clear()
    yield _table(counts)


def _by_key(counts: DataFrame, tasks: int) -> DataFrame:
    """(key, counts): one row for each key, with (lang, n) for the languages that have it."""
    # Dealt by key once: neither grouping moves rows again.
    return counts.repartition(tasks, "key").groupBy("lang", "key").agg(F.sum("n").alias("n")).groupBy("key").agg(F.collect_list(F.struct("lang", "n")).alias("counts"))


def _pieces(marked: Column, n: int) -> Column:
    """The n-grams of a marked word, one after another."""
    last = F.length(marked) - (n - 1)
    return F.transform(F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), lambda k: F.substring(marked, k, F.lit(n)))


def _gram_counts(word_counts: DataFrame) -> DataFrame:
    """(lang, key, n) of the n-grams of counted words."""
    marked = F.concat(F.lit("<"), F.col("key"), F.lit(">"))
    each = word_counts.select(marked.alias("marked"), F.explode("counts").alias("c")).select("marked", "c.lang", "c.n")
    every = F.concat(*[_pieces(F.col("marked"), n) for n in range(1, LONGEST + 1)])
    return each.select("lang", F.explode(every).alias("key"), "n").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, room: int) -> pd.DataFrame:
    """The rows (lang, key, n) of the most frequent keys, of at most ``room`` keys."""
    all_ = F.aggregate("counts", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    total = counts.withColumn("c", F.floor(F.log2(all_) * 4).cast("int"))
    least, left = None, room
    for r in total.groupBy("c").count().orderBy(F.desc("c")).collect():
        if (left := left - r["count"]) < 0:
            break
        least = r["c"]
    if least is None:
        return pd.DataFrame({"lang": [], "key": [], "n": []})
    return total.where(F.col("c") >= least).select("key", F.inline("counts")).toArrow().to_pandas()


def _gain(n):
    """What n sightings add to the log frequency of an unseen key."""
    return F.log1p(n / UNSEEN) if isinstance(n, Column) else np.log1p(n / UNSEEN)


@dataclass
class LanguageModel:
    """Languages with their log shares of documents; tables (key, counts by language) of words and n-grams;
    the log frequencies of unseen keys by language; the frequent words and their gains."""

    langs: list[str]
    prior: np.ndarray
    words: DataFrame | None = None
    grams: DataFrame | None = None
    no_word: np.ndarray = field(default_factory=lambda: np.empty(0))
    no_gram: np.ndarray = field(default_factory=lambda: np.empty(0))
    frequent: dict[str, int] = field(default_factory=dict)
    gains: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))

    def forget(self) -> None:
        """Deletes the tables; the model is of no use after that."""
        discard(*(t for t in (self.words, self.grams) if t is not None))


def _unseen(counts: DataFrame, langs: int) -> np.ndarray:
    sums = {r["lang"]: r["n"] for r in counts.select(F.inline("counts")).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    keys = counts.count()
    return np.log(UNSEEN / (np.array([sums.get(k, 0) for k in range(langs)], float) + UNSEEN * (keys + 1)))


def learn(training: DataFrame) -> LanguageModel:
    """A model from rows (text, lang), neither null. No rows make a model that knows nothing."""
    docs = {r["lang"]: r["count"] for r in training.groupBy("lang").count().collect()}
    langs = sorted(docs)
    if not langs:
        return LanguageModel([], np.empty(0))
    spark = training.sparkSession
    number = F.broadcast(spark.createDataFrame(list(zip(langs, range(len(langs)))), "lang string, number int"))
    texts = training.select("text", F.col("lang").cast("string").alias("lang")).join(number, "lang").select("text", "number")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    word_counts = stored(_by_key(texts.mapInArrow(_count_words, _COUNTS), tasks), "words")
    # Read back in few splits, so dealt anew: taking words apart is work. By size, so that a look-up reads its own.
    gram_counts = _by_key(_gram_counts(word_counts.repartition(tasks)), tasks).withColumn("size", F.length("key"))
    gram_counts = stored(gram_counts.sortWithinPartitions("size"), "grams")
    found = _most_frequent(word_counts, max(LEAST_KEYS, CELLS // len(langs)))
    codes, names = pd.factorize(found["key"])
    gains = np.zeros((len(names), len(langs)))
    gains[codes, found["lang"].to_numpy(int)] = _gain(found["n"].to_numpy(float))
    n = np.array([docs[lang] for lang in langs], float)
    return LanguageModel(
        langs, np.log((n + 1) / (n + 1).sum()), word_counts, gram_counts, _unseen(word_counts, len(langs)), _unseen(gram_counts, len(langs)), dict(zip(names, range(len(names)))), gains)


_PARTIAL = "doc_id long, held_out boolean, n long, letters boolean, known long, gains array<double>, other array<struct<word:string,n:int>>"
_SLICE = 1000


def _partial(value):
    """For each text what the frequent words give, and the other words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, gains = value.value
        for batch in batches:
            for begin in range(0, batch.num_rows, _SLICE):
                part = batch.slice(begin, _SLICE)
                split = [words(t) for t in part.column(2).to_pylist()]
                flat = [w for s in split for w in s]
                held = np.empty(len(flat), dtype=object)
                held[:] = flat
                codes, unique = pd.factorize(held)
                at = np.fromiter((frequent.get(w, -1) for w in unique), np.int64, len(unique))
                own = np.concatenate([np.zeros((1, gains.shape[1])), gains])[at + 1]
                known, sums, other, letters, pos = [], [], [], [], 0
                for s in split:
                    mine = codes[pos : pos + len(s)]
                    pos += len(s)
                    known.append(int((at[mine] >= 0).sum()))
                    sums.append(own[mine].sum(axis=0).tolist())
                    rest, n = np.unique(mine[at[mine] < 0], return_counts=True)
                    other.append([{"word": unique[k], "n": c} for k, c in zip(rest.tolist(), n.tolist())])
                    letters.append(any(c.isalpha() for w in s for c in w))
                yield pa.record_batch([
                    part.column(0), part.column(1), pa.array(list(map(len, split)), pa.int64()), pa.array(letters, pa.bool_()), pa.array(known, pa.int64()), pa.array(sums, pa.list_(pa.float64())),
                    pa.array(other, pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())])))], names=["doc_id", "held_out", "n", "letters", "known", "gains", "other"])

    return rows


def _looked_up(found: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows (word, n, whole, gains) for rows (word, n): gains of the word itself (whole) or the
    mean of those of its longest known n-grams. Words without any have no row."""
    marked = stored(found.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "other", 4)
    gains = F.transform("counts", lambda c: F.struct(c["lang"].alias("lang"), _gain(c["n"]).alias("gain"))).alias("gains")
    known = marked.join(model.words.withColumnRenamed("key", "word"), "word").select("id", F.lit(True).alias("whole"), gains)
    parts = [stored(known, "known", 4)]
    rest = stored(marked.join(parts[0].select("id"), "id", "left_anti").select("id", F.concat(F.lit("<"), "word", F.lit(">")).alias("marked")), "rest", 4)
    for n in range(LONGEST, 0, -1):
        if not rest.limit(1).count():
            break
        cut = rest.select("id", F.explode(_pieces(F.col("marked"), n)).alias("key"))
        each = cut.join(model.grams.where(F.col("size") == n).select("key", gains), "key").groupBy("id").agg(F.count("*").alias("of"), F.flatten(F.collect_list("gains")).alias("all"))
        mean = each.select("id", "of", F.explode("all").alias("g")).groupBy("id", "g.lang").agg((F.sum("g.gain") / F.first("of")).alias("gain"))
        parts.append(stored(mean.groupBy("id").agg(F.collect_list(F.struct("lang", "gain")).alias("gains")).select("id", F.lit(False).alias("whole"), "gains"), "grams", 4))
        left = stored(rest.join(parts[-1].select("id"), "id", "left_anti"), "rest", 4)
        discard(rest)
        rest = left
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    return marked.join(every, "id").select("word", "n", "whole", "gains")


@contained
def identify(documents: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one for each input row.

    Null texts and texts without a letter are ``und`` with score 0, as is everything to a
    model without languages. Ties go to the first language by code point. The columns lang
    and source, if there, are not looked at; ids only pass through.
    """
    spark = documents.sparkSession
    flag = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), flag.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    if not model.langs:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast((model.frequent, model.gains))
    partial = stored(rows.mapInArrow(_partial(shared), _PARTIAL).withColumn("row", F.monotonically_increasing_id()), "partial")
    other = partial.select("row", F.explode("other").alias("o")).select("row", "o.word", F.col("o.n").alias("times"))
    found = _looked_up(other.groupBy("word").agg(F.count("*").alias("n")), model)
    met = stored(join_hot(other, stored(found, "found", 4), "word", "n").select("row", "times", "whole", "gains"), "met", 2)
    counts = met.groupBy("row").agg(F.sum(F.when(F.col("whole"), F.col("times")).otherwise(0)).alias("whole"), F.sum(F.when(F.col("whole"), 0).otherwise(F.col("times"))).alias("taken"))
    sums = met.select("row", "times", F.explode("gains").alias("g")).groupBy("row", "g.lang").agg(F.sum(F.col("times") * F.col("g.gain")).alias("gain"))
    sums = sums.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("lang", "gain"))).alias("more"))
    full = partial.select("row", "doc_id", "held_out", "n", "letters", "known", "gains").join(counts, "row", "left").join(sums, "row", "left")
    vector = lambda v: F.array(*[F.lit(float(x)) for x in v])
    terms = F.struct(vector(model.prior).alias("prior"), vector(model.no_word).alias("no_word"), vector(model.no_gram).alias("no_gram"))
    at = lambda c, k: F.get(c, k)
    # Words are not independent: evidence counts as that of sqrt(n) words at most.
    total = F.transform(F.sequence(F.lit(0), F.lit(len(model.langs) - 1)), lambda k: at(F.col("t.prior"), k) + (
        at(F.col("gains"), k) + F.coalesce(F.try_element_at("more", k), F.lit(0.0)) + (F.col("known") + F.coalesce("whole", F.lit(0))) * at(F.col("t.no_word"), k)
        + F.coalesce("taken", F.lit(0)) * at(F.col("t.no_gram"), k)) / F.greatest(F.lit(1.0), F.sqrt("n")))
    judged = full.withColumn("t", terms).withColumn("total", total).withColumn("top", F.array_max("total"))
    names = F.array(*[F.lit(lang) for lang in model.langs])
    best = F.get(names, (F.array_position("total", F.col("top")) - 1).cast("int"))
    score = 1 / F.aggregate("total", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    return judged.select(
        "doc_id", "held_out", F.when(F.col("letters"), best).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("letters"), score).otherwise(0.0).alias("score"))
