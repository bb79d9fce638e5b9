"""URL filter: host and path rules, and character language models where no rule fits.

The urls that rules accept and reject train two variable-order Markov models over the url
without its scheme. The probability of a character after its last ``ORDER`` characters is
interpolated with that of shorter contexts, down to single characters, each context counting
as much as it was seen. A url's score is the mean over its characters of the difference of
the two log-probabilities. The threshold is calibrated on rule-judged urls that training
left out (on all rule-judged urls where those lack a class): it has the least balanced
error, the mean of the two classes' error rates, and lies in the middle of the scores that do.

DataFrame operations only. Windows of ORDER + 1 characters are counted over all urls with
partial sums before the shuffle; the models are evaluated once for each distinct window.
What goes to the driver is a histogram of scores of ``BINS`` bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import contained, discard, join_hot, stored

ORDER = 4
WORTH = 2.0  # how many sightings the shorter context counts for
ALPHABET = 256.0
FOLDS = 4
BINS = 4000
WIDEST = 10.0  # scores beyond count as this
# (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, all that follows the scheme); empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), rest


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest rule that fits; both null if none does."""
    text = verdict = None
    for say, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        verdict = F.when(fits, say) if verdict is None else verdict.when(fits, say)
    if text is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return text, verdict


def _windows(text: Column) -> Column:
    """All windows of ORDER + 1 characters over the padded text, one for each character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    padded = F.concat(F.array_repeat(F.lit("\x02"), ORDER), chars, F.array(F.lit("\x03")))
    return F.transform(F.sequence(F.lit(1), F.size(padded) - ORDER), lambda k: F.array_join(F.slice(padded, k, ORDER + 1), ""))


def _models(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(w, gain): log-probability of the window's last character, accepted less rejected.

    ``counts`` has (w, yes, no); ``wanted`` the distinct windows to evaluate.
    """
    totals = F.broadcast(counts.agg(F.coalesce(F.sum("yes"), F.lit(0)).alias("ty"), F.coalesce(F.sum("no"), F.lit(0)).alias("tn")))
    out = wanted.select("w").crossJoin(totals)  # one row of totals
    last = F.right("w", F.lit(1))
    single = counts.groupBy(last.alias("g0")).agg(F.sum("yes").alias("y"), F.sum("no").alias("n"))
    out = out.withColumn("g0", F.right("w", F.lit(1))).join(single, "g0", "left")
    for side, total in (("y", "ty"), ("n", "tn")):
        out = out.withColumn(f"p{side}", (F.coalesce(side, F.lit(0)) + WORTH / ALPHABET) / (F.col(total) + WORTH))
    out = out.select("w", "py", "pn")
    for k in range(1, ORDER + 1):
        gram, context = F.right("w", F.lit(k + 1)), F.left(F.right("w", F.lit(k + 1)), F.lit(k))
        grams = counts.groupBy(gram.alias("g"), context.alias("c")).agg(F.sum("yes").alias("gy"), F.sum("no").alias("gn"))
        contexts = grams.groupBy("c").agg(F.sum("gy").alias("cy"), F.sum("gn").alias("cn"))
        out = out.withColumn("g", gram).withColumn("c", context).join(grams.drop("c"), "g", "left").join(contexts, "c", "left")
        for side in ("y", "n"):
            seen, around = F.coalesce(f"g{side}", F.lit(0)), F.coalesce(f"c{side}", F.lit(0))
            out = out.withColumn(f"p{side}", (seen + WORTH * F.col(f"p{side}")) / (around + WORTH))
        out = out.select("w", "py", "pn")
    return out.select("w", (F.log("py") - F.log("pn")).alias("gain"))


def least_error(rows: list[tuple[int, int, int]]) -> float | None:
    """The cut between bins (bin, accepted, rejected) with the least balanced error; None
    if there is none accepted or none rejected. Ties: the middle of the widest stretch.

    A bin below the cut is rejected. Bins are numbered from 0; the cut is between numbers.
    """
    yes, no = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not yes or not no:
        return None
    rows = sorted(rows)
    cuts = []  # (error, from, to): all cuts in between part the bins alike
    lost, gone, before = 0, 0, rows[0][0] - 1
    for bin_, y, n in [*rows, (rows[-1][0] + 2, 0, 0)]:
        cuts.append((lost / yes + (no - gone) / no, before + 1, bin_))
        lost, gone, before = lost + y, gone + n, bin_
    least = min(c[0] for c in cuts) + 1e-12
    _, low, high = max((c for c in cuts if c[0] <= least), key=lambda c: (c[2] - c[1], -c[1]))
    return (low + high) / 2


def threshold(scores: DataFrame) -> float:
    """The calibrated threshold for rows (said, fold, score); -inf where a class has no url."""
    step = 2 * WIDEST / BINS
    bins = F.floor((F.least(F.greatest("score", F.lit(-WIDEST)), F.lit(WIDEST)) + WIDEST) / step).cast("int")
    counted = scores.where("said is not null").groupBy(bins.alias("bin"), (F.col("fold") == 0).alias("out")).agg(
        F.count_if(F.col("said") == "allow").alias("yes"), F.count_if(F.col("said") == "block").alias("no")).collect()
    for rows in ([r for r in counted if r["out"]], counted):
        cut = least_error([(r["bin"], r["yes"], r["no"]) for r in rows])
        if cut is not None:
            return cut * step - WIDEST
    return float("-inf")


@contained
def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, score), one for each input row.

    A null url, or one without ``://``, has empty parts, no rule and no score, and is allowed.
    Without urls that rules accept, or without such as they reject, there is nothing to
    compare and what no rule judges is allowed. Repeated rows come back as often as they
    came; an empty table gives no rows; other columns are not looked at.
    """
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    host, path, rest = url_parts(F.col("url"))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select(
        "page_id", host.alias("host"), path.alias("path"), rest.alias("rest"))
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "host", "path", "rest", rule.alias("rule"), said.alias("said"))
    texts = base.where("rest != ''").groupBy("rest", "said").agg(F.count("*").alias("n"))
    texts = stored(texts.select(F.monotonically_increasing_id().alias("id"), "rest", "said", "n", F.pmod(F.xxhash64("rest", F.lit(1)), F.lit(FOLDS)).alias("fold")), "urls")
    # Short rows, but each makes many windows: dealt anew, as they come in few splits.
    windows = stored(texts.repartition(tasks).select("id", "said", "fold", "n", F.explode(_windows(F.col("rest"))).alias("w")), "windows")
    trained = windows.where("said is not null and fold != 0")
    counts = stored(trained.groupBy("w").agg(
        F.sum(F.when(F.col("said") == "allow", F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("said") == "block", F.col("n")).otherwise(0)).alias("no")), "counts", 4)
    seen = windows.groupBy("w").agg(F.count("*").alias("seen"))
    gains = stored(_models(counts, seen).join(seen, "w"), "gains", 4)
    means = join_hot(windows.select("id", "w"), gains, "w", "seen").groupBy("id").agg(F.avg("gain").alias("score"))
    scores = stored(texts.join(means, "id"), "scores", 4)
    discard(windows, counts, gains)
    method = F.when(F.coalesce("score", F.lit(float("inf"))) >= threshold(scores), "allow").otherwise("block")
    # A url is in as many rows as it has pages, so the frequent ones are joined apart.
    some = join_hot(base.where("rest != ''"), scores.select("rest", "n", "score"), "rest", "n").select("page_id", "host", "path", "rule", "said", "score")
    none = base.where("rest = ''").select("page_id", "host", "path", "rule", "said", F.lit(None).cast("double").alias("score"))
    return some.union(none).select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "score")
