"""Toxicity: a weighted finite-state pattern grammar over clauses, with learned insults.

* Words become symbols: insults of four strengths, threat verbs, targets, negations, verbs of
  reported speech, commas, sentence ends, all others. Insults are a short fixed list and the
  words that labelled documents show to be toxic: those whose log-odds between toxic and clean
  documents stay above ``RATIO`` by ``DEVIATIONS`` standard deviations, each distinct text once.
* Five transducers are composed: insults weigh their strength, more in a row; a threat
  counts if its target follows; an insult near a target weighs more; one shortly after a
  negation or in reported speech weighs less. A sentence scores as its heaviest reading.
* A document's sentences give its evidence (heaviest, total, number, density); a logistic model
  over it, fitted on a fold of the labelled documents that the words were not learned from,
  gives the probability. The words are then learned from all folds.

Labelled rows: at most ``TOXIC`` and ``CLEAN``, those with the smallest hashes of their ids; words:
the ``WORDS`` strongest. Both bounds make the model small enough to broadcast. Every document is
scored whole, in one narrow pass.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .transducers import Scorer, Transducer
from .work import contained, discard, leftovers, stored

TOXIC = 20_000
CLEAN = 40_000
WORDS = 20_000
RATIO = 4.0
DEVIATIONS = 1.25
FOLDS = 4
STRENGTHS = 4

# Words of the grammar's classes.
INSULTS = ("bastard", "clown", "disgusting", "dumb", "fool", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
THREATS = ("beat", "destroy", "hurt", "kill", "murder", "punch", "shoot", "smash", "stab", "strangle")
TARGETS = ("du", "dich", "eres", "euch", "he", "her", "him", "ihr", "she", "them", "they", "toi", "tu", "u", "usted", "vous", "you", "your", "you're", "yourself")
NEGATIONS = ("aren't", "isn't", "jamais", "kein", "keine", "never", "nicht", "no", "not", "nunca", "pas", "wasn't", "without")
REPORTS = ("called", "calling", "claimed", "dice", "dijo", "dit", "quote", "quoted", "reported", "sagte", "said", "saying", "says", "told", "wrote")

_PIECE = 1 << 20  # characters cut into words at once
_ODD = re.compile(r"[^\x00-\x7f\w]+|[^\x00-\x7f\W\D]+")  # beyond ASCII: neither letters nor marks of them
_END, _COMMA, _OTHER = ".", "c", "o"
_MARKS = {b".": _END, b",": _COMMA}
# Bytes of a lower-cased text: sentence ends, commas, letters and what UTF-8 has beyond ASCII, spaces.
_BYTES = bytes(ord(".") if chr(k) in ".!?;\n" else ord(",") if chr(k) in ",:\"" else k if k >= 128 or chr(k).isalpha() or chr(k) == "'" else 32 for k in range(256))
_LEVELS = "123456789"[:STRENGTHS]
_COUNTS = re.compile(f"[{_LEVELS}t]")
NEAR, REPORTED = 3, 8  # words that a target, a negation, and a report reach
ROW, THREAT, DIRECTED, DENIED, QUOTED = 0.5, 3.0, 1.0, -2.5, -1.5
_READ = "ocynrt"

EVIDENCE = 5


def _same(states: range, symbols: str) -> dict:
    return {(s, c): [(max(0, s - 1), c, 0.0)] for s in states for c in symbols}


def insults() -> Transducer:
    """Writes i for an insult of any strength, heavier right after another."""
    arcs = {(s, c): [(0, c, 0.0)] for s in (0, 1) for c in _READ}
    arcs |= {(s, c): [(1, "i", k + 1 + ROW * s)] for s in (0, 1) for k, c in enumerate(_LEVELS)}
    return Transducer(arcs, {0, 1})


def threats() -> Transducer:
    """Writes i for a threat whose target follows, o for one whose does not. State k: it has to follow within k words."""
    arcs = {(0, c): [(0, c, 0.0)] for c in "ocynri"}
    arcs[0, "t"] = [(0, _OTHER, 0.0), (NEAR, "i", THREAT)]
    for k in range(1, NEAR + 1):
        arcs |= {(k, c): [(k - 1, c, 0.0)] for c in "onri"} if k > 1 else {}
        arcs[k, "y"] = [(0, "y", 0.0)]
        if k > 1:
            arcs[k, "t"] = [(k - 1, _OTHER, 0.0)]
    return Transducer(arcs, {0})


def targets() -> Transducer:
    """Writes d for an insult with a target near before or after it. States 1 to NEAR: words that a
    target still reaches; those beyond: it has to come within as many."""
    arcs = _same(range(NEAR + 1), "onr")
    for s in range(NEAR + 1):
        arcs[s, "c"], arcs[s, "y"] = [(0, "c", 0.0)], [(NEAR, "y", 0.0)]
        arcs[s, "i"] = [(max(0, s - 1), "d", DIRECTED)] if s else [(0, "i", 0.0), (2 * NEAR, "d", DIRECTED)]
    for k in range(1, NEAR + 1):
        arcs[NEAR + k, "y"] = [(NEAR, "y", 0.0)]
        if k > 1:
            arcs |= {(NEAR + k, c): [(NEAR + k - 1, c, 0.0)] for c in "onr"}
            arcs[NEAR + k, "i"] = [(NEAR + k - 1, "d", DIRECTED)]
    return Transducer(arcs, set(range(NEAR + 1)))


def negations() -> Transducer:
    """Takes weight from what stands shortly after a negation."""
    arcs = _same(range(NEAR + 1), "oyr")
    for s in range(NEAR + 1):
        arcs[s, "c"], arcs[s, "n"] = [(0, "c", 0.0)], [(NEAR, _OTHER, 0.0)]
        arcs |= {(s, c): [(max(0, s - 1), c, DENIED if s else 0.0)] for c in "id"}
    return Transducer(arcs, set(range(NEAR + 1)))


def reports() -> Transducer:
    """Takes weight from what a verb of speech or writing introduces, also behind a comma or a quotation mark."""
    arcs = _same(range(REPORTED + 1), "oy")
    for s in range(REPORTED + 1):
        arcs[s, "c"], arcs[s, "r"] = [(s, "c", 0.0)], [(REPORTED, _OTHER, 0.0)]
        arcs |= {(s, c): [(max(0, s - 1), c, QUOTED if s else 0.0)] for c in "id"}
    return Transducer(arcs, set(range(REPORTED + 1)))


def grammar() -> Scorer:
    whole = insults().compose(threats()).compose(targets()).compose(negations()).compose(reports())
    return Scorer(whole, _OTHER, REPORTED)


def tokens(text: str) -> Iterator[list[bytes]]:
    """Lower-cased words and marks of a text in UTF-8, a piece at a time; an apostrophe inside a word belongs to it."""
    at, text = 0, text.lower()
    while at < len(text):
        cut = _BREAK.search(text, at + _PIECE) if at + _PIECE < len(text) else None
        end = cut.end() if cut else len(text)
        piece = text[at:end] if at or end < len(text) else text
        if not piece.isascii():
            piece = _ODD.sub(" ", piece.replace("’", "'"))
        plain = piece.encode("utf-8", "replace").translate(_BYTES)
        plain = b" " + plain.replace(b".", b" . ").replace(b",", b" , ") + b" "
        if b"'" in plain:
            while b" '" in plain or b"' " in plain:
                plain = plain.replace(b" '", b" ").replace(b"' ", b" ")
        yield plain.split()
        at = end


def symbol_table(strengths: dict[str, int]) -> dict[bytes, str]:
    """Symbols of words, in UTF-8, and marks; the grammar's own words keep their class."""
    out = {w: _LEVELS[k - 1] for w, k in strengths.items()} | {w: _LEVELS[-1] for w in INSULTS}
    for words, c in ((THREATS, "t"), (TARGETS, "y"), (NEGATIONS, "n"), (REPORTS, "r")):
        out |= dict.fromkeys(words, c)
    return {w.encode(): c for w, c in out.items()} | _MARKS


def evidence(text: str | None, table: dict[bytes, str], score: Scorer) -> list[float]:
    """Of a document's matched sentences: the heaviest, log total, log number, log density, log length; all zero without any."""
    symbols = "".join("".join(map(table.get, piece, repeat(_OTHER))) for piece in tokens(text or ""))
    if not _COUNTS.search(symbols):
        return [0.0] * EVIDENCE
    found = [s for s in (score(x) for x in symbols.split(_END) if _COUNTS.search(x)) if s > 0]
    if not found:
        return [0.0] * EVIDENCE
    words, total = len(symbols) - symbols.count(_END) - symbols.count(_COMMA), sum(found)
    return [max(found), math.log1p(total), math.log1p(len(found)), math.log1p(100 * total / words), math.log1p(words)]


def fit_logistic(rows: np.ndarray, outcome: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of the columns and a constant, by Newton's method."""
    x = np.concatenate([rows, np.ones((len(rows), 1))], 1)
    out, penalty = np.zeros(x.shape[1]), np.diag([*[ridge] * rows.shape[1], 1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (outcome - p)) - penalty @ out)
        out += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return out


@dataclass
class Model:
    strengths: dict[str, int]
    weights: np.ndarray

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights[:-1] + self.weights[-1], -30, 30)))


#: Where the labels show no toxic or no clean document, heavy sentences decide.
_UNLABELLED = np.array([1.5, 0.0, 0.0, 0.0, 0.0, -3.0])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic, fold) -> (word, toxic and clean texts that have it, the same in the fold kept apart)."""
    for batch in batches:
        counts = [Counter() for _ in range(4)]
        for text, toxic, apart in zip(*(batch.column(k).to_pylist() for k in range(3))):
            words = set().union(*tokens(text)).difference(_MARKS)
            counts[1 - toxic].update(words)
            if apart:
                counts[3 - toxic].update(words)
        words = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)], ["word", "t", "c", "ta", "ca"])


def _lower_bound(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    odds = F.log((toxic + 0.5) / (n_toxic + 1.0)) - F.log((clean + 0.5) / (n_clean + 1.0))
    return odds - DEVIATIONS * F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def _strengths(counts: DataFrame, toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> dict[str, int]:
    strongest = counts.select("word", _lower_bound(toxic, clean, n_toxic, n_clean).alias("low")).where(F.col("low") >= math.log(RATIO)).orderBy(F.desc("low"), "word").limit(WORDS)
    return {r["word"]: max(1, min(STRENGTHS, int(r["low"]))) for r in strongest.collect()}


def _measured(table: dict[bytes, str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = grammar()
        for batch in batches:
            got = np.array([evidence(t, table, score) for t in batch.column(0).to_pylist()]).reshape(-1, EVIDENCE)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(got[:, k]) for k in range(EVIDENCE))], ["toxic", *(f"e{k}" for k in range(EVIDENCE))])

    return rows


def learn(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Model:
    """The model of labelled documents. Labels and documents without id, label or text are passed
    by; of several labels of an id the highest counts; a text that comes again counts once for each label."""
    held: list[DataFrame] = []
    with leftovers(held):
        marks = labels.where(F.col(id_col).isNotNull() & F.col(toxic_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(toxic_col) > 0).cast("int")).alias("toxic"))
        dealt = F.xxhash64(F.col("id").cast("string"))
        few = marks.where("toxic = 1").orderBy(dealt, "id").limit(TOXIC).union(marks.where("toxic = 0").orderBy(dealt, "id").limit(CLEAN))
        few = F.broadcast(stored(few.withColumn("apart", F.pmod(F.xxhash64(F.lit("fold"), F.col("id").cast("string")), F.lit(FOLDS)) == 0), "labelled", 16))
        rows = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(few, "id")
        # At most TOXIC + CLEAN texts and their repetitions.
        rows = stored(rows.groupBy(F.sha2("text", 256).alias("hash"), "toxic").agg(F.first("text").alias("text"), F.min("apart").alias("apart")).drop("hash"), "texts", 4)
        sizes = {(r["toxic"], r["apart"]): r["n"] for r in rows.groupBy("toxic", "apart").agg(F.count("*").alias("n")).collect()}
        total = dict(marks.groupBy("toxic").count().collect())
        counts = rows.select("text", "toxic", "apart").mapInArrow(_word_counts, "word string, t long, c long, ta long, ca long")
        counts = stored(counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("t", "c", "ta", "ca"))).where(f"t >= {RATIO / 2}"), "words", 4)
        of = lambda toxic, *folds: sum(sizes.get((toxic, f), 0) for f in folds)
        without = _strengths(counts, F.col("t") - F.col("ta"), F.col("c") - F.col("ca"), of(1, False), of(0, False))
        got = rows.where("apart").select("text", "toxic").mapInArrow(_measured(symbol_table(without)), "toxic int, " + ", ".join(f"e{k} double" for k in range(EVIDENCE))).collect()
        weights, outcome = _UNLABELLED, np.array([r[0] for r in got])
        if len(got) and 0 < outcome.sum() < len(got):
            # Sampled classes weigh as much as all their labelled documents.
            share = np.where(outcome == 1, total.get(1, 0) / of(1, True, False), total.get(0, 0) / of(0, True, False))
            weights = fit_logistic(np.array([r[1:] for r in got]), outcome, share / share.mean())
        model = Model(_strengths(counts, F.col("t"), F.col("c"), of(1, True, False), of(0, True, False)), weights)
    discard(*held)
    return model


def _scored(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, score = symbol_table(model.strengths), grammar()
        for batch in batches:
            got = np.array([evidence(t, table, score) for t in batch.column(2).to_pylist()]).reshape(-1, EVIDENCE)
            probability = model.probability(got)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(probability), pa.array((probability >= 0.5).astype(np.int32)), pa.array(got[:, 2].round(6))], ["doc_id", "held_out", "score", "predicted", "evidence"])

    return rows


@contained
def toxicity(documents: DataFrame, model: Model, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence: log of one more than the matched sentences).

    A null, empty or blank text has no evidence and the score of a text without toxic words.
    Null ids are kept; repeated rows are scored alike; an empty table gives no rows; other
    columns are ignored.
    """
    mark = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), mark.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double, predicted int, evidence double")

