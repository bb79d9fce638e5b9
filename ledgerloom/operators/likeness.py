"""Near texts within blocks, without a block in one task.

* Bound. Texts whose matched characters reach a share t of both lengths differ by at most
  (1 - t) * (n + m) insertions and deletions, and each changes one letter count by one. So the
  letter counts, folded into ``CLASSES`` classes, differ by no more than that in sum, and the longer
  text has at most (2 - t) / t times the shorter's length. Both bounds are exact; what they
  leave is compared character by character. An edit distance comes from a text's columns of the
  table as bits of one number, a step for each character of the other text.
* Tiles. A block's texts fall into length classes, and each class into chunks of ``CHUNK``. Near
  texts are in one class or in neighbouring ones, so tiles of two chunks meet all of them;
  a tile is a task's unit and its size does not depend on the block's.
* Pieces. Without blocks, an edit spoils one of a text's disjoint pieces at most, so of two texts within m edits
  the shorter has all but m of the longer's pieces, each at most m characters away from its place. Pieces and what
  stands at each place of the shorter meet by hash, length class and stretch of places; pairs that share enough are
  compared. A phrase that many texts of about one length have in about one place gives a row a pair of them.
* Greedy rule. "Drop a text near an earlier kept one" is the lexicographically first maximal
  independent set of the graph of near pairs. Each block's first ``HEAD`` texts are decided one by one,
  which settles small blocks; the others are compared with the kept ones among those. What is left
  becomes a graph, whose rounds keep every text without an undecided earlier neighbour and
  drop the neighbours of the kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..skew import join_counted, runs_of

CHUNK = 2048
HEAD = 512
CLASSES = 32
PIECE = 11  # longer pieces are rarer, but fewer of them are left by the edits
AT_ONCE = 1 << 20  # characters whose pieces are made at once
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def profiles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, counts of characters by class) of texts."""
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) % CLASSES
    at = np.repeat(np.arange(len(texts)), lengths) * CLASSES + points
    return lengths, np.bincount(at, minlength=len(texts) * CLASSES).reshape(-1, CLASSES).astype(np.int32)


def edits_allowed(n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    return (1 - threshold) * (n + m) + 1e-9


def possible(lengths: np.ndarray, counts: np.ndarray, n: int, profile: np.ndarray, allowed: Callable) -> np.ndarray:
    """Which texts the bounds leave as near to one of length n."""
    most = allowed(lengths, n)
    near = np.flatnonzero(np.abs(lengths - n) <= most)
    return near[np.abs(counts[near] - profile).sum(axis=1) <= most[near]]


def ratio_reaches(later: str, earlier: str, threshold: float) -> bool:
    m = SequenceMatcher(None, later, earlier)
    return m.quick_ratio() >= threshold and m.ratio() >= threshold


def edit_distance(a: str, b: str, most: int) -> int:
    """The Levenshtein distance, -1 beyond ``most``.

    A column of the table is two numbers: where it grows by one from row to row, and where it
    falls (Myers; Hyyrö). So a step costs as much as adding numbers of so many bits.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return -1
    if a == b:
        return 0
    begin, end = 0, len(a)
    while begin < end and a[begin] == b[begin]:
        begin += 1
    more = len(b) - end
    while end > begin and a[end - 1] == b[end + more - 1]:
        end -= 1
    a, b = a[begin:end], b[begin : end + more]
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    top, whole, stop = len(a) - 1, (1 << len(a)) - 1, most + len(b) - 1
    up, down, d = whole, 0, len(a)
    for k, c in enumerate(b):
        x = at.get(c, 0)
        same = ((((x & up) + up) ^ up) | x | down) & whole
        rise, fall = down | ((same | up) ^ whole), same & up
        if rise >> top:
            d += 1
        elif fall >> top:
            d -= 1
        if d + k > stop:
            return -1
        rise = (rise << 1 | 1) & whole
        up, down = (fall << 1 & whole) | ((same | rise) ^ whole), rise & same
    return d


def first_kept(texts: list[str], threshold: float) -> list[bool]:
    """The greedy rule over texts in order."""
    lengths, counts = profiles(texts)
    allowed = lambda n, m: edits_allowed(n, m, threshold)
    kept: list[int] = []
    out = []
    for k, text in enumerate(texts):
        near = possible(lengths[kept], counts[kept], lengths[k], counts[k], allowed) if kept else ()
        hit = any(ratio_reaches(text, texts[kept[j]], threshold) for j in near)
        out.append(not hit)
        if not hit:
            kept.append(k)
    return out


def _length_class(n: Column, reach: float) -> Column:
    # A little wider than the reach, so that rounding never parts neighbours by two classes.
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.lit(math.log(reach * 1.0001))).cast("int")


def tiles(rows: DataFrame, reach: float, chunk: int = CHUNK) -> DataFrame:
    """(tile, block, side, ord, text): each row once for every tile of two chunks that its near ones may be in.

    rows has (block string, ord long, text) with distinct ord in a block. Pairs are to be made of side 0
    with side 1, or within a tile whose rows are all of side 2.
    """
    sized = rows.withColumn("class", _length_class(F.length("text"), reach)).withColumn("key", F.struct("block", "class"))
    counts = sized.groupBy("block", "class").agg(F.count("*").alias("n"), F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    counts = cut(counts)
    above = counts.select("block", (F.col("class") - 1).alias("class"), F.col("chunks").alias("up"))
    below = counts.select("block", (F.col("class") + 1).alias("class"), F.col("chunks").alias("down"))
    plan = counts.join(above, ["block", "class"], "left").join(below, ["block", "class"], "left").na.fill(0, ["up", "down"])
    # A row of a class alone has nothing to meet.
    plan = plan.where("n > 1 or up > 0 or down > 0").select(F.struct("block", "class").alias("key"), "n", "chunks", "up", "down")
    placed = join_counted(sized, plan, "key", "n").withColumn("x", F.pmod(F.xxhash64("ord"), F.col("chunks")).cast("int"))
    x, c = F.col("x"), F.col("class")
    tile = lambda a, p, b, q, side: F.struct(a.alias("a"), p.alias("p"), b.alias("b"), q.alias("q"), side.alias("side"))
    span = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own = F.transform(span(F.col("chunks")), lambda y: tile(c, F.least(x, y), c, F.greatest(x, y), F.when(x == y, 2).when(x < y, 0).otherwise(1)))
    up = F.transform(span(F.col("up")), lambda y: tile(c, x, c + 1, y, F.lit(0)))
    down = F.transform(span(F.col("down")), lambda y: tile(c - 1, y, c, x, F.lit(1)))
    out = placed.select("block", "ord", "text", F.explode(F.concat(own, up, down)).alias("t"))
    return out.select(F.concat_ws(" ", "t.a", "t.p", "t.b", "t.q", "block").alias("tile"), "block", "t.side", "ord", "text")


def _tile_pairs(allowed: Callable, near: Callable | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (blocks, sides, ords, texts) in runs_of(batches):
            if len(ords) < 2:
                continue
            side, found = np.array(sides), []
            lengths, counts = profiles(texts)
            left, right = (np.flatnonzero(side == 2),) * 2 if (side == 2).any() else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            own_l, own_c = lengths[right], counts[right]
            for i in left.tolist():
                for j in right[possible(own_l, own_c, lengths[i], counts[i], allowed)].tolist():
                    if side[i] == 2 and j <= i:
                        continue
                    a, b = (i, j) if ords[i] < ords[j] else (j, i)
                    distance = 0 if near is None else near(texts[b], texts[a])
                    if distance >= 0:
                        found.append((blocks[0], ords[a], ords[b], distance))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int64(), pa.int32()))], ["block", "a", "b", "distance"])

    return rows


def near_edges(rows: DataFrame, reach: float, allowed: Callable, near: Callable | None = None, chunk: int = CHUNK) -> DataFrame:
    """(block, a, b, distance): pairs of a block, earlier first, that the bounds leave and ``near(later, earlier)``
    confirms by a distance, which is below 0 for others.

    allowed(n, m) is the most by which the letter counts of near texts of these lengths differ
    in sum; reach the most by which the longer of them is longer. Pairs are compared where they
    meet: their texts, of which many pairs repeat one, are not moved again.
    """
    met = tiles(rows, reach, chunk)
    return met.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tile_pairs(allowed, near), "block string, a long, b long, distance int")


def _class_of(n: np.ndarray, reach: float) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / math.log(reach * 1.0001)).astype(np.int64)


def _piece_length(m: np.ndarray, most: float) -> np.ndarray:
    """Characters of the pieces of a text in which m edits are allowed: it has more than m of them. Never falls as m grows."""
    return np.clip(np.floor(m / most / (m + 1)), 1, PIECE).astype(np.int64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * _ODD[1]
    return (h ^ h >> np.uint64(29)) * _ODD[2]


def _hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each place."""
    h = np.full(max(0, len(points) - q + 1), q, np.uint64)
    for k in range(q if len(h) else 0):
        h = h * _ODD[0] + points[k : len(h) + k] + np.uint64(1)
    return _mixed(h)


def _dealt(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within the owner) of counts[owner] things each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _keys(h: np.ndarray, length_class: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    return _mixed(h ^ (length_class.astype(np.uint64) << np.uint64(40) | stretch.astype(np.uint64)) * _ODD[1])


def _stretch(length_class: np.ndarray, most: float, base: float) -> np.ndarray:
    """Characters of a stretch of places: about as many as those in which a piece may be found."""
    return np.maximum(1, 1.5 * np.floor(most * np.ceil(base ** (length_class + 1.0)))).astype(np.int64)


def pieces(texts: list[str], most: float, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, times): the keys of texts and how often each has them.

    whole: of a text's disjoint pieces, with all places and length classes where a shorter near text may have them;
    else of what stands at each place. Texts within ``most`` edits of the longer share, counted by times, at
    least :func:`needed` keys of the longer's.
    """
    reach = 1 / (1 - most)
    base = reach * 1.0001
    n = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin, classes, m = np.cumsum(n) - n, _class_of(n, reach), np.floor(n * most).astype(np.int64)
    owners, keys = [], []
    # No edit: the text itself is its only piece.
    for length in np.unique(n[m == 0]).tolist():
        t = np.flatnonzero(n == length)
        owners.append(t)
        keys.append(_keys(_hashes(points, length)[begin[t]], classes[t], np.zeros(len(t), np.int64)))
    if whole:
        q = _piece_length(m, most)
        for length in np.unique(q[m > 0]).tolist():
            some = np.flatnonzero((q == length) & (m > 0))
            t, k = _dealt(n[some] // length)
            t, h = some[t], _hashes(points, length)
            for lower in (0, 1):
                c = classes - lower
                short, long = np.floor(base ** c.astype(float)) - 1, np.ceil(base ** (c + 1.0)) + 1
                least, largest = np.maximum(0, n - long), np.minimum(m, n - short)  # by how much the other text is shorter
                use = ((c >= 0) & (least <= m))[t]
                u, p, w = t[use], k[use] * length, _stretch(c, most, base)
                back, on = np.floor((m + largest) / 2).astype(np.int64), np.floor((m - least) / 2).astype(np.int64)
                first, last = np.maximum(0, p - back[u]) // w[u], (p + on[u]) // w[u]
                at, more = _dealt(last - first + 1)
                owners.append(u[at])
                keys.append(_keys(h[begin[u[at]] + p[at]], c[u[at]], first[at] + more))
    else:
        longest = np.floor((n + 1) / (1 - most)) + 1
        low, high = _piece_length(np.maximum(m, 1), most), _piece_length(np.maximum(1, np.floor(longest * most)), most)
        w = _stretch(classes, most, base)
        for length in range(int(low.min()), int(high.max()) + 1) if len(n) else ():
            some = np.flatnonzero((low <= length) & (length <= high))
            t, p = _dealt(np.maximum(0, n[some] - length + 1))
            t = some[t]
            owners.append(t)
            keys.append(_keys(_hashes(points, length)[begin[t] + p], classes[t], p // w[t]))
    owner, key = np.concatenate([*owners, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*keys, np.zeros(0, np.uint64)]).astype(np.uint64)
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])])) if len(key) else np.zeros(0, np.int64)
    return owner[new], key[new], np.diff(np.append(new, len(key)))


def needed(n: np.ndarray, most: float) -> np.ndarray:
    """How many pieces of a text of length n are left by as many edits as are allowed."""
    m = np.floor(n * most).astype(np.int64)
    return np.where(m > 0, n // _piece_length(m, most) - m, 1)


def _with_pieces(most: float, whole: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ords, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            ends, begin = np.cumsum([len(t) for t in texts]), 0
            while begin < len(texts):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + AT_ONCE, "right")))
                part = texts[begin:end]
                owner, key, times = pieces(part, most, whole)
                n = np.array([len(t) for t in part], np.int64)
                for k in range(0, len(key), 1 << 16):
                    own = owner[k : k + (1 << 16)]
                    columns = [pa.array(key[k : k + (1 << 16)].view(np.int64)), pa.array(ords[begin:end][own]), pa.array(n[own].astype(np.int32))]
                    if whole:
                        columns += [pa.array(times[k : k + (1 << 16)].astype(np.int32)), pa.array(needed(n, most)[own].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "y", "y_n", "times", "need"] if whole else ["key", "x", "x_n"])
                begin = end

    return rows


def _distances(most: float):
    allowed = lambda n: np.floor(n * most)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                a, b, first, second = (c.to_pylist() for c in batch.slice(k, 256).columns)
                (n, p), (m, q) = profiles(first), profiles(second)
                limit = allowed(np.maximum(n, m))
                near = np.flatnonzero(np.abs(p - q).sum(axis=1) <= 2 * limit).tolist()
                found = [(min(a[j], b[j]), max(a[j], b[j]), d) for j in near if (d := edit_distance(first[j], second[j], int(limit[j]))) >= 0]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int32()))], ["a", "b", "distance"])

    return rows


def within_edits(texts: DataFrame, most: float) -> DataFrame:
    """(a, b, distance): all pairs, smaller number first, whose Levenshtein distance is at most ``most`` of the longer.

    texts has (ord long, text) with distinct numbers and no empty text; most is above 0 and below 1.
    """
    rows = cut(texts.select("ord", "text"))
    longer = rows.mapInArrow(_with_pieces(most, True), "key long, y long, y_n int, times int, need int")
    shorter = rows.mapInArrow(_with_pieces(most, False), "key long, x long, x_n int")
    met = longer.join(shorter, "key").where((F.col("x_n") < F.col("y_n")) | (F.col("x_n") == F.col("y_n")) & (F.col("x") < F.col("y"))).where(F.col("y_n") - F.col("x_n") <= F.floor(F.col("y_n") * F.lit(most)))
    pairs = met.groupBy("x", "y", "need").agg(F.sum("times").alias("times")).where("times >= need").select("x", "y")
    both = pairs.join(rows.select(F.col("ord").alias("x"), F.col("text").alias("first")), "x").join(rows.select(F.col("ord").alias("y"), F.col("text").alias("second")), "y")
    return both.select("x", "y", "first", "second").mapInArrow(_distances(most), "a long, b long, distance int")


def first_independent(edges: DataFrame) -> DataFrame:
    """(id): the nodes that the greedy rule drops, from edges (a, b) with a before b.

    A node without edges is kept and need not be named. Repeated edges are allowed. The rounds
    end after as many steps as the longest chain of decisions that depend on each other.
    """
    rest, dropped = cut(edges.select("a", "b").distinct()), None
    while rest.limit(1).count():
        kept = rest.select("a").distinct().join(rest.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        out = cut(rest.join(kept, "a", "left_semi").select(F.col("b").alias("id")).distinct())
        dropped = out if dropped is None else dropped.union(out)
        rest = cut(rest.join(out.withColumnRenamed("id", "a"), "a", "left_anti").join(out.withColumnRenamed("id", "b"), "b", "left_anti").join(kept, "a", "left_anti"))
    return dropped if dropped is not None else rest.select(F.col("b").alias("id"))


def _decided_heads(threshold: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, ids, kept = [], [], []

        def told():
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.string()), pa.array(ids, pa.int64()), pa.array(kept, pa.bool_())], ["block", "ord", "keeps"])

        for block, (ords, texts) in runs_of(batches):
            flags = first_kept(texts, threshold) if len(ords) > 1 else [True]
            blocks += [block] * len(ords)
            ids += ords
            kept += flags
            if len(ids) > 4096:
                yield told()
                blocks, ids, kept = [], [], []
        if ids:
            yield told()

    return rows


def _near_heads(threshold: float):
    allowed = lambda n, m: edits_allowed(n, m, threshold)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for batch in batches:
            hits = []
            for block, text, heads in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if block not in known:
                    known = {block: profiles(heads)}  # rows of a block mostly come together
                lengths, counts = profiles([text])
                near = possible(*known[block], lengths[0], counts[0], allowed)
                hits.append(any(ratio_reaches(text, heads[j], threshold) for j in near))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.bool_())], ["block", "ord", "near"])

    return rows


def greedy_dropped(rows: DataFrame, threshold: float, head: int = HEAD, chunk: int = CHUNK) -> DataFrame:
    """(block, ord) of the rows (block string, ord long, text) that are near an earlier kept row of their block.

    Texts and ord are distinct within a block. Equals taking the rows of a block one after
    another; see the module for how no block meets in one task.
    """
    at = ["block", "ord"]
    nth = F.row_number().over(Window.partitionBy("block").orderBy("ord"))
    first = rows.withColumn("nth", nth).where(F.col("nth") <= head).select(*at, "text")
    ordered = first.repartition("block").sortWithinPartitions(*at)
    decided = cut(ordered.mapInArrow(_decided_heads(threshold), "block string, ord long, keeps boolean"))
    out = decided.where("not keeps").select(*at)
    large = cut(rows.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > head))
    if not large.limit(1).count():
        return out
    heads = rows.join(decided.where("keeps"), at, "left_semi").join(large, "block").groupBy("block").agg(F.collect_list("text").alias("heads"), F.first("n").alias("n"))  # head texts at most
    rest = join_counted(rows, heads, "block", "n").join(decided, at, "left_anti")
    met = cut(rest.select(*at, "text", "heads").mapInArrow(_near_heads(threshold), "block string, ord long, near boolean"))
    still = rows.join(met.where("not near"), at, "left_semi")
    edges = near_edges(still, (2 - threshold) / threshold, lambda n, m: edits_allowed(n, m, threshold), lambda b, a: 0 if ratio_reaches(b, a, threshold) else -1, chunk)
    node = lambda c: F.struct("block", F.col(c).alias("ord")).alias(c)
    return out.union(met.where("near").select(*at)).union(first_independent(edges.select(node("a"), node("b"))).select("id.*"))
