"""Quality classifier: document evidence shrunk through host and path by empirical Bayes.

* Evidence. Surface features of the whole text (letter case, symbols, repetition, line and
  word shapes) are cut at quantiles into bins, and a logistic model over the bins, fitted on
  at most ``LABELLED`` labelled rows, gives the log-odds that a document is good.
* Sites. Outcomes are summed by host and by path within a host, partial sums before the
  shuffle: every labelled document as it is labelled, and every document's evidence at
  ``SOFT`` of that. The spread of the rates between hosts, beyond what chance gives, sets how many
  documents the prior is worth (method of moments), so a host with few documents stays at the
  global rate and a path with few at its host's.
* Posterior. The log-odds of a document move by those of its path's shrunk rate over the
  global rate, where the document's own evidence is left out of the sums. Below ``KEEP`` the
  document is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import contained_lazy, free_names, join_hot, stored

LABELLED = 40_000
BINS = 12
KEEP = 0.5
SOFT = 0.2
BROADCAST_SITES = 50_000
MOST_PRIOR = 1e6

FEATURES = ("log_words", "upper", "symbols", "digits", "spread", "top_word", "echo", "line_repeat", "word_length", "odd_words", "pair_repeat", "long_words")


def _classes() -> np.ndarray:
    """Code points below 0x250: 1 lower-case, 2 upper-case, 3 digit, 4 space, 5 symbol."""
    out = np.zeros(0x250, np.uint8)
    for k in range(0x250):
        c = chr(k)
        out[k] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c.isspace() else 5 if not c.isalnum() else 0
    return out


_CLASS = _classes()


def features(text: str | None) -> list[float]:
    """The features of one text, all zero for a null or blank one."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds = np.bincount(_CLASS[points[points < 0x250]], minlength=6)
    chars = max(1, len(points) - int(kinds[4]))
    letters = max(1, int(kinds[0] + kinds[1] + kinds[2]))
    n = len(words)
    counts = Counter(words)
    echo = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    odd = sum(1 for w in counts if len(w) > 1 and not w[-1].isalnum() and not w[-2].isalnum())
    bare = sum(c for w, c in counts.items() if not any(x.isalnum() for x in w))
    pairs = len(set(zip(words, words[1:])))
    return [
        float(np.log1p(n)), kinds[2] / letters, kinds[5] / chars, kinds[3] / chars, len(counts) / n, max(counts.values()) / n,
        echo / n, 1 - len(set(lines)) / max(1, len(lines)), chars / n, (odd + bare) / n, 1 - pairs / max(1, n - 1) if n > 1 else 0.0,
        sum(c for w, c in counts.items() if len(w) > 20) / n,
    ]


class Evidence:
    """A logistic model over binned features."""

    def __init__(self, cuts: np.ndarray, weights: np.ndarray):
        self.cuts, self.weights = cuts, weights

    @staticmethod
    def _design(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        columns = [np.ones(len(x))]
        for k in range(x.shape[1]):
            for cut in cuts[k]:
                columns.append((x[:, k] > cut).astype(float))
        return np.stack(columns, axis=1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Evidence:
        if not len(y):
            return cls(np.zeros((len(FEATURES), 0)), np.zeros(1))
        good, bad = x[y == 1], x[y == 0]
        q = np.linspace(0, 1, BINS // 2 + 2)[1:-1]
        # Cuts from either class, so that a rare class is resolved as well.
        parts = [np.quantile(part, q, axis=0).T for part in (good, bad) if len(part)]
        cuts = np.sort(np.concatenate(parts, axis=1), axis=1)
        d = cls._design(x, cuts)
        w = np.zeros(d.shape[1])
        w[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        ridge = np.full(d.shape[1], 1.0)
        ridge[0] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + np.diag(ridge), d.T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return cls(cuts, w)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x, self.cuts) @ self.weights, -20, 20)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


def fit_evidence(documents: DataFrame, labels: DataFrame) -> Evidence:
    """Fitted on the labelled documents, at most LABELLED, picked by a hash of the id."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    share = min(1.0, LABELLED / max(n, 1))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < share * (1 << 20))
    # Only picked documents are measured; their number is bounded, so the ids go to the scan.
    picked = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(known) if n * share < 200_000 else known, "doc_id", "left_semi")
    data = picked.mapInArrow(_measure, "doc_id long, x array<double>").join(known, "doc_id").select("doc_id", "x", "quality").toArrow()
    order = np.argsort(data.column("doc_id").to_numpy(), kind="stable")
    x = data.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if data.num_rows else np.empty((0, len(FEATURES)))
    return Evidence.fit(x[order], (data.column("quality").to_numpy() > 0).astype(float)[order])


def _scorer(model_value, at: int, keep: list[int], name: str):
    """The kept columns and the evidence for each text, null for null or blank ones."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_value.value
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(at)]).reshape(-1, len(FEATURES))
            odds = pa.array(model.log_odds(x), mask=x[:, 0] == 0)
            yield pa.record_batch([*(batch.column(k) for k in keep), odds], names=[*(batch.schema.names[k] for k in keep), name])

    return rows


def _prior_worth(rates: DataFrame, n: str, p: str, centre) -> float:
    """How many documents the prior is worth, from the spread of the rates (moments)."""
    r = rates.select(
        F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(F.col(n) * F.pow(F.col(p) - centre, 2)).alias("ss"),
        F.sum(F.pow(n, 2)).alias("n2"), F.sum(F.col(n) * centre * (1 - centre)).alias("noise")).first()
    if not r["k"] or r["k"] < 2 or not r["n"]:
        return MOST_PRIOR
    noise = r["noise"] / r["n"]
    between = max(0.0, (r["ss"] - (r["k"] - 1) * noise) / max(1e-9, r["n"] - r["n2"] / r["n"]))
    return float(min(MOST_PRIOR, max(1.0, noise / between - 1))) if between > 0 else MOST_PRIOR


def site_rates(scored: DataFrame, labels: DataFrame | None = None) -> tuple[DataFrame, float, float, float]:
    """(sites, global rate, worth of the prior by host, by path) from rows (doc_id, host, path, p).

    sites has one row for each (host, path): rows, its sums n and good, and those of its host, hn and hgood.
    """
    soft = scored.groupBy("host", "path").agg(F.count("*").alias("rows"), (SOFT * F.count("p")).alias("n"), (SOFT * F.coalesce(F.sum("p"), F.lit(0.0))).alias("good"))
    if labels is not None:
        known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max((F.col("quality") > 0).cast("double")).alias("y"))
        hard = scored.select("doc_id", "host", "path").join(known, "doc_id").groupBy("host", "path").agg(F.lit(0).cast("long").alias("rows"), F.count("*").cast("double").alias("n"), F.sum("y").alias("good"))
        soft = soft.unionByName(hard).groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in ("rows", "n", "good")])
    paths = stored(soft, "paths", 16)
    totals = paths.select(F.sum("n"), F.sum("good")).first()
    centre = ((totals[1] or 0) + 1) / ((totals[0] or 0) + 2)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood"))
    k_host = _prior_worth(hosts.where("hn > 0").withColumn("r", F.col("hgood") / F.col("hn")), "hn", "r", F.lit(centre))
    sites = stored(paths.join(hosts, "host"), "sites", 16)
    host_rate = (F.col("hgood") + k_host * centre) / (F.col("hn") + k_host)
    k_path = _prior_worth(sites.where("n > 0").withColumn("r", F.col("good") / F.col("n")), "n", "r", host_rate)
    return sites, centre, k_host, k_path


@contained_lazy
def classify(
    documents: DataFrame, evidence: Evidence, labels: DataFrame | None = None, text_col: str = "text", host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id",
    keep_text: bool = True,
) -> DataFrame:
    """All rows and columns (or all but the text) with ``quality_score`` (0 to 1) and ``quality_kept``.

    A null or blank text gets score 0 and is rejected. Null hosts and paths are sites of their
    own. Repeated rows count as often as they come. Without labels all texts score alike and are
    kept. An empty table gives no rows. Columns of the two result names are replaced, others
    pass through whatever their names. Each text is measured once.
    """
    spark = documents.sparkSession
    docs = documents.drop("quality_score", "quality_kept").withColumn(text_col, F.col(text_col).cast("string"))
    columns = [c for c in docs.columns if keep_text or c != text_col]
    odds, host, path = free_names(docs, "evidence", "host", "path")
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)
    scorer = _scorer(spark.sparkContext.broadcast(evidence), docs.columns.index(text_col), [docs.columns.index(c) for c in columns], odds)
    site = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    measured = stored(docs.mapInArrow(scorer, f"{kinds}, {odds} double"), "measured").withColumns({host: site(host_col), path: site(path_col)})
    p = lambda c: 1 / (1 + F.exp(-c))
    sites, centre, k_host, k_path = site_rates(measured.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), F.col(path).alias("path"), p(F.col(odds)).alias("p")), labels)
    packed = sites.select(F.struct("host", "path").alias("key"), "rows", F.struct("n", "good", "hn", "hgood").alias("site"))
    rows = measured.select(F.struct(F.col(host).alias("host"), F.col(path).alias("path")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(odds).alias("odds"))
    met = rows.join(F.broadcast(packed.drop("rows")), "key") if sites.count() <= BROADCAST_SITES else join_hot(rows, packed, "key", "rows")
    # What the site says without this document.
    less, mine = F.when(F.col("odds").isNull(), 0.0).otherwise(SOFT), F.coalesce(SOFT * p(F.col("odds")), F.lit(0.0))
    s = lambda c: F.col("site")[c]
    host_rate = (s("hgood") - mine + k_host * centre) / (s("hn") - less + k_host)
    rate = (s("good") - mine + k_path * host_rate) / (s("n") - less + k_path)
    safe = F.least(F.greatest(rate, F.lit(1e-4)), F.lit(1 - 1e-4))
    shift = F.log(safe / (1 - safe)) - float(np.log(centre / (1 - centre)))
    score = F.when(F.col("odds").isNull(), 0.0).otherwise(p(F.col("odds") + shift))
    return met.select("row.*", score.alias("quality_score")).withColumn("quality_kept", F.col("quality_score") >= KEEP)
