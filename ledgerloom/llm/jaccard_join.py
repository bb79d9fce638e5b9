"""N-gram Jaccard join: an exact similarity join in the metric space of shingle sets.

The distance d = 1 - |x & y| / |x | y| is a metric, and documents link when d <= 1/4.

* Pivots. Nearly all documents are at distance 1 from any given document, so the first
  level takes single shingles as pivots: x lies at distance 1 - 1/|x| from the pivots it
  contains and at 1 from all others. Ties between its pivots are broken by one global
  order, rare shingles first, and the first of them is x's home region.
* Windows. A neighbour y of x misses at most a quarter of x, hence x and y share a pivot
  within the first floor(|x|/4) + 1 of x and the same of y; x is replicated to exactly
  those regions. Within a region the ranks i, j of the pivot bound the overlap:
  7 (|x| - i) >= 3 (|x| + |y|) for both sides, else the pair is met elsewhere or is none.
* Recursion. A region of more than ``SMALL`` documents gets a document as pivot p, the
  member with the fewest shingles before the region's own. Distances to p are computed for
  all its members. Those within 1/4 of p are joined through p, and pairs of them need no
  look. The rest, and what the triangle inequality |d(x,p) - d(y,p)| <= 1/4 leaves for
  them, go to the next round with new pivots out of the rest, until no region holds a pair
  that is neither joined nor compared.

A pair is dropped if one-bit sketches of the two sets show more than (|x| + |y|) / 7
shingles that only one of them has, which no linked pair has; every other pair is compared on
the whole sets. The result is the exact transitive
closure; copies of one set are one node, so a group of copies never makes pairs. A node is
named by a fingerprint of its set; where a second, independent one tells sets of one name
apart, they are named by the second (63-bit names alone would meet at some 10^9 sets).

Which shingles count as frequent only steers the order and never the result. It is taken
from all documents: each block of ``BLOCK`` shingles reports those it has at least
``OFTEN`` times, and the sums are read back, at most ``MOST_HOT`` of them (8 bytes each).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import fingerprint, second_fingerprint, shingle_sets
from .work import contained, discard, join_hot, mix64, stored

SMALL = 64
BLOCK = 1 << 22
OFTEN = 3
MOST_HOT = 1 << 20
BITS = 1 << 23
HOT = 8
SALT = 64
ROUND_PIVOTS = 16
ROUND_PAIRS = 20_000_000
ROUND_MOST = 1_000_000_000


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    yield from zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist()))


def _name(s: np.ndarray, clashes: frozenset[int]) -> int:
    first = fingerprint(s)
    return second_fingerprint(s) if first in clashes else first


def _sketch(s: np.ndarray) -> bytes:
    """A bit for each shingle, in the smallest power of two of bits that the set may fill."""
    m = 1 << max(3, int(len(s) - 1).bit_length()) if len(s) else 8
    bits = np.zeros(m, np.uint8)
    bits[(s & np.uint64(m - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """At least how many shingles are in one set only, from their sketches."""
    a, b = (np.frombuffer(z, np.uint8) for z in sorted((x, y), key=len))
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that may link: 7 |x - y| <= |x| + |y| for what the sketches tell of |x - y|."""
    for batch in batches:
        a, b = batch.column(0), batch.column(1)
        n = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
        apart = np.fromiter((_apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())), np.int64, len(n))
        ok = pa.array(7 * apart <= n)
        yield pa.record_batch([a.filter(ok), b.filter(ok)], names=["a", "b"])


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind 0: doc_id, size, fingerprints, sketch) and (kind 1: -, count, shingle)."""
    held: list[np.ndarray] = []
    seen: set[int] = set()
    size = 0
    names = ["kind", "doc_id", "n", "fp", "fp2", "sketch"]

    def frequent() -> pa.RecordBatch:
        every = np.concatenate(held) if held else np.empty(0, np.uint64)
        held.clear()
        every.sort()
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(every)), bool), every[1:] != every[:-1]]))
        count = np.diff(starts, append=len(every))
        shingle, count = every[starts[count >= OFTEN]], count[count >= OFTEN]
        n = len(shingle)
        return pa.record_batch([pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.array(count.astype(np.int64)), pa.array(shingle.view(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=names)

    for batch in batches:
        ids, sizes, prints, second, sketches = [], [], [], [], []
        for doc, s in _sets(batch):
            fp = fingerprint(s)
            sketches.append(_sketch(s))
            ids.append(doc)
            sizes.append(len(s))
            prints.append(fp)
            second.append(second_fingerprint(s))
            if len(s) and fp not in seen:
                seen.add(fp)
                held.append(s)
                size += len(s)
                if size >= BLOCK:
                    yield frequent()
                    seen, size = set(), 0
        yield pa.record_batch([pa.array(np.zeros(len(ids), np.int32)), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(second, pa.int64()), pa.array(sketches, pa.binary())], names=names)
    yield frequent()


def _hot(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent shingles and their classes (log2 of the count), at most MOST_HOT."""
    total = stored(counts.groupBy("fp").agg(F.sum("n").alias("n")).select("fp", F.floor(F.log2("n")).cast("int").alias("c")), "frequent", 16)
    by_class = {r["c"]: r["count"] for r in total.groupBy("c").count().collect()}
    room, least = MOST_HOT, None
    for c in sorted(by_class, reverse=True):
        if (room := room - by_class[c]) < 0:
            break
        least = c
    if least is None:
        discard(total)
        return np.empty(0, np.uint64), np.empty(0, np.uint8)
    got = total.where(F.col("c") >= least).toArrow()
    discard(total)
    shingle = got.column("fp").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(shingle)
    return shingle[order], got.column("c").to_numpy().astype(np.uint8)[order]


def _classes(s: np.ndarray, hot: np.ndarray, cls: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(s), np.uint8)
    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    return np.where(hot[at] == s, cls[at], 0).astype(np.uint8)


def _window_rows(hot_value):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hot, cls), clashes = hot_value.value
        seen: set[int] = set()
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            size = 0
            for _, s in _sets(batch):
                fp = _name(s, clashes)
                if not len(s) or fp in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(fp)
                n = len(s)
                c = _classes(s, hot, cls)
                first = np.lexsort((s, c))[: n // 4 + 1]
                k = len(first)
                for to, values in zip(cols, (s[first].view(np.int64), np.full(k, fp, np.int64), np.full(k, n, np.int32), np.arange(k, dtype=np.int32), c[first].astype(np.int32))):
                    to.append(values)
                size += k
                if size > 500_000:
                    yield _record(cols)
                    cols, size = [[], [], [], [], []], 0
            if size:
                yield _record(cols)

    return rows


def _record(cols: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate(c)) for c in cols], names=["s", "id", "n", "pos", "hot"])


def _admissible(n1, i, n2, j):
    both = 3 * (n1 + n2)
    return (7 * (n1 - i) >= both) & (7 * (n2 - j) >= both) & (7 * (i + j) <= n1 + n2)


_MET = "s long, a long, b long, nb int, posb int, big boolean, first boolean"

_NAMES = ["s", "a", "b", "nb", "posb", "big", "first"]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of (s, salt) to candidate pairs (a, b), or members of large regions (big).

    A run of one frequent shingle, or of more than SMALL rows, yields its members for the
    recursion; any other run yields its admissible pairs, ``first`` set for those with the
    run's pivot, the row of least rank. At most SMALL rows of a run are
    held from one batch to the next.
    """
    names = ["s", "id", "n", "pos", "hot"]
    keep: list[np.ndarray] | None = None  # the open run
    long_run = False

    def members(rows: list[np.ndarray], at) -> pa.RecordBatch:
        s, d, n, pos = (c[at] for c in rows[:4])
        return pa.record_batch([pa.array(s), pa.nulls(len(s), pa.int64()), pa.array(d), pa.array(n), pa.array(pos), pa.array(np.ones(len(s), bool)), pa.nulls(len(s), pa.bool_())], names=_NAMES)

    def small(rows: list[np.ndarray], starts: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        for length in np.unique(lengths):
            if length < 2:
                continue
            at = starts[lengths == length]
            i, j = np.triu_indices(length, 1)
            x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            _, d, n, pos = (c.astype(np.int64) for c in rows[:4])
            ok = (d[x] != d[y]) & _admissible(n[x], pos[x], n[y], pos[y])
            u, v, star = np.minimum(d[x], d[y])[ok], np.maximum(d[x], d[y])[ok], np.tile(i == 0, len(at))[ok]
            for first in (True, False):
                pair = np.unique(np.stack([u[star == first], v[star == first]]), axis=1)
                k = pair.shape[1]
                if k:
                    yield pa.record_batch([pa.nulls(k, pa.int64()), pa.array(pair[0]), pa.array(pair[1]), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.array(np.zeros(k, bool)), pa.array(np.full(k, first))], names=_NAMES)

    for batch in batches:
        rows = [batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in names]
        if not len(rows[0]):
            continue
        if keep is not None:
            if long_run:
                k = int(np.argmax(rows[0] != keep[0][0])) if (rows[0] != keep[0][0]).any() else len(rows[0])
                if k:
                    yield members(rows, slice(0, k))
                if k == len(rows[0]):
                    continue
                rows = [c[k:] for c in rows]
            else:
                rows = [np.concatenate([p, c]) for p, c in zip(keep, rows)]
        edge = np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1
        starts = np.concatenate([[0], edge]).astype(np.int64)
        lengths = np.diff(np.concatenate([starts, [len(rows[0])]]))
        large = (lengths > SMALL) | (rows[4][starts] >= HOT)
        inner = np.arange(len(starts)) < len(starts) - 1
        yield from small(rows, starts[inner & ~large], lengths[inner & ~large])
        if large.any():
            yield members(rows, np.repeat(large, lengths))
        last = int(starts[-1])
        long_run = bool(large[-1])
        keep = [c[last : last + 1] for c in rows] if long_run else [c[last:] for c in rows]
    if keep is not None and not long_run:
        yield from small(keep, np.array([0]), np.array([len(keep[0])]))


def _blobs(bits_value):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, clashes = bits_value.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if batch.column(0).null_count:
                continue_ids = np.array([-1 if x is None else x for x in batch.column(0).to_pylist()], dtype=np.int64)
                valid = ~np.array(batch.column(0).is_null())
            else:
                continue_ids, valid = ids.astype(np.int64), np.ones(len(ids), bool)
            slot = (mix64(continue_ids.view(np.uint64)) & np.uint64(BITS - 1)).astype(np.int64)
            hit = np.flatnonzero(valid & ((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool))
            for at in range(0, len(hit), 2000):
                part = hit[at : at + 2000]
                got = batch.take(pa.array(part))
                docs, prints, sets = [], [], []
                for doc, s in _sets(got):
                    docs.append(doc)
                    prints.append(_name(s, clashes))
                    sets.append(s.tobytes())
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(prints, pa.int64()), pa.array(sets, pa.binary())], names=["rep", "id", "blob"])

    return rows


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        slot = np.unique((mix64(ids.view(np.uint64)) & np.uint64(BITS - 1)).astype(np.int64))
        yield pa.record_batch([pa.array(slot.astype(np.int32))], names=["slot"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0), batch.column(1)
        left, right = batch.column(2), batch.column(3)
        both = []
        for x, y in zip(left, right):
            both.append(len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True)))
        na = np.array([len(x.as_buffer()) // 8 for x in left], np.int64)
        nb = np.array([len(y.as_buffer()) // 8 for y in right], np.int64)
        inter = np.array(both, np.int64)
        union = na + nb - inter
        yield pa.record_batch([a, b, pa.array(1 - inter / np.maximum(union, 1)), pa.array(100 * inter >= 75 * union)], names=["a", "b", "d", "link"])


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, clashes: frozenset[int]) -> DataFrame:
    """Exact distances of the pairs (a < b, fingerprints) that may link: a, b, d, link. Stored."""
    spark = docs.sparkSession
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    pairs = stored(pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_possible, "a long, b long"), "possible", 16)
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = stored(wanted.join(nodes.select("id", "rep"), "id"), "wanted", 16)
    bits = np.zeros(BITS // 8, np.uint8)
    slots = wanted.select("rep").mapInArrow(_slots, "slot int").distinct().toArrow().column("slot").to_numpy()
    np.bitwise_or.at(bits, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    shared = spark.sparkContext.broadcast((bits, clashes))
    blobs = docs.mapInArrow(_blobs(shared), "rep long, id long, blob binary")
    # The bits pass some documents too many, and a repeated id may bring other texts.
    blobs = stored(blobs.join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"]).select("id", "blob"), "sets", 4)
    full = pairs.join(blobs.select(F.col("id").alias("a"), F.col("blob").alias("x")), "a").join(
        blobs.select(F.col("id").alias("b"), F.col("blob").alias("y")), "b").select("a", "b", "x", "y")
    done = stored(full.mapInArrow(_compare, "a long, b long, d double, link boolean"), "distances", 16)
    discard(wanted, blobs, pairs)
    shared.unpersist()
    return done


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label): the component of each linked fingerprint, named by the smallest rep."""
    reps = nodes.select("id", "rep")
    ends = links.join(reps.withColumnRenamed("id", "a").withColumnRenamed("rep", "u"), "a").join(
        reps.withColumnRenamed("id", "b").withColumnRenamed("rep", "v"), "b").select("u", "v")
    # Fingerprints may share a rep only if a doc_id is repeated with other texts.
    return reps.join(components(ends).withColumnRenamed("node", "rep"), "rep").select("id", F.col("component").alias("label"))


def _heads(regions: DataFrame) -> DataFrame:
    return regions.groupBy("s").agg(F.min(F.struct("posb", "b", "nb")).alias("p")).select(
        "s", F.col("p.b").alias("p"), F.col("p.nb").alias("np"), F.col("p.posb").alias("posp"))


def _rounds(docs: DataFrame, nodes: DataFrame, regions: DataFrame, known: DataFrame, clashes: frozenset[int]) -> DataFrame:
    """The recursion of large regions; returns every distance that was computed.

    A round takes twice as many pivots of a region as the one before, as far as ROUND_MOST
    pairs allow, so the number of rounds grows with the logarithm of a region's size.
    """
    turn = 0
    while True:
        turn += 1
        label = stored(_labels(nodes, known.where("link").select("a", "b")), "labels", 16)
        near = known.select("a", "b", "d")
        at = regions.join(label.withColumnRenamed("id", "b").withColumnRenamed("label", "t"), "b", "left").select(
            "s", "b", "nb", "posb", F.struct(F.col("t").isNull().alias("alone"), F.coalesce("t", F.col("b")).alias("t")).alias("t"))
        mixed = at.groupBy("s").agg(F.min("t").alias("x"), F.max("t").alias("y"), F.count("*").alias("size"), F.min(F.struct("posb", "b", "t")).alias("p")).where("x != y")
        at = at.join(mixed.select("s", F.col("p.b").alias("p"), F.col("p.t").alias("pt"), "size"), "s")
        # What is known of the distance to the region's pivot; the pivot itself is at 0.
        at = at.withColumn("u", F.least("p", "b")).withColumn("v", F.greatest("p", "b")).join(
            near.withColumnRenamed("a", "u").withColumnRenamed("b", "v"), ["u", "v"], "left").select(
            "s", "b", "nb", "posb", "t", "pt", "size", F.when(F.col("p") == F.col("b"), 0.0).otherwise(F.col("d")).alias("d"))
        at = stored(at, "regions", 16)
        rest = at.where("t != pt")
        many = rest.groupBy("s").agg(F.count("*").alias("left"), F.max("size").alias("size"))
        estimate = many.select(F.sum(F.col("left") * F.col("size"))).first()[0] or 0
        if estimate > ROUND_PAIRS:
            pivots = F.least(F.lit(ROUND_PIVOTS << min(turn - 1, 40)), F.greatest(F.lit(ROUND_PIVOTS), F.floor(ROUND_MOST / F.col("all"))))
            share = F.greatest(F.lit(1), F.floor(F.col("left") / pivots))
            rest = rest.join(many.select("s", "left", F.col("size").alias("all")), "s").where(F.pmod(F.xxhash64("b", F.lit(turn)), share) == 0).drop("left", "all")
        x = rest.select("s", F.col("b").alias("a"), F.col("nb").alias("na"), F.col("posb").alias("posa"), F.col("t").alias("ta"), F.col("d").alias("da"))
        met = x.join(at, "s").where("a != b and ta != t").where(
            "7 * (na - posa) >= 3 * (na + nb) and 7 * (nb - posb) >= 3 * (na + nb) and 7 * (posa + posb) <= na + nb").where(
            "da is null or d is null or abs(da - d) <= 0.2500001")
        new = stored(_ordered(met).join(near.select("a", "b"), ["a", "b"], "left_anti"), "pairs", 16)
        known = stored(known.union(_verified(docs, nodes, new, clashes)), "known", 16)
        last = estimate <= ROUND_PAIRS
        if not last:
            regions = stored(regions.join(rest.select("s", "b"), ["s", "b"], "left_anti"), "regions", 16)
        discard(label, at, new)
        if last:
            return known


@contained
def jaccard_join(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each input row.

    Null or blank texts have no shingles and link with nothing; a null id keeps its row, with
    the component of an equal text if there is one (such rows link nothing else). Repeated rows come back as often as they came. An empty table
    gives an empty result; other columns are not looked at.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    survey = stored(docs.mapInArrow(_survey, "kind int, doc_id long, n long, fp long, fp2 long, sketch binary"), "survey")
    own = survey.where("kind = 0").select("doc_id", "n", "fp", "fp2", "sketch")
    sets = stored(own.where("n > 0").groupBy("fp", "fp2").agg(
        F.min("doc_id").alias("rep"), F.first("n").cast("int").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")), "nodes", 16)
    # Different sets of one fingerprint: about (sets / 2^32)^2 / 4 of them are to be expected.
    clashes = frozenset(r["fp"] for r in sets.groupBy("fp").count().where("count > 1").select("fp").collect())
    name = F.when(F.col("fp").isin(*clashes), F.col("fp2")).otherwise(F.col("fp")) if clashes else F.col("fp")
    sets = sets.withColumn("id", name)
    nodes = sets.where("rep is not null").select("id", "rep", "n", "sketch")
    hot = spark.sparkContext.broadcast((_hot(survey.where("kind = 1")), clashes))
    windows = docs.where("doc_id is not null").mapInArrow(_window_rows(hot), "s long, id long, n int, pos int, hot int")
    windows = windows.withColumn("salt", F.when(F.col("hot") >= HOT, F.pmod(F.col("id"), F.lit(SALT))).otherwise(0).cast("int"))
    met = stored(windows.repartition("s", "salt").sortWithinPartitions("s", "pos", "id").mapInArrow(_meet, _MET), "met")
    regions = stored(met.where("big").select("s", "b", "nb", "posb").distinct(), "members", 16)
    stars = regions.join(_heads(regions), "s").where("b != p").where(
        "7 * (np - posp) >= 3 * (np + nb) and 7 * (nb - posb) >= 3 * (np + nb) and 7 * (posp + posb) <= np + nb")
    pairs = stored(_ordered(met.where("first").select("a", "b").union(stars.select(F.col("p").alias("a"), "b"))), "pairs", 16)
    known = _verified(docs, nodes, pairs, clashes)
    # Other pairs of small regions, unless their pivots have joined them already.
    label = stored(_labels(nodes, known.where("link").select("a", "b")), "labels", 16)
    other = met.where("not big and not first").select("a", "b").distinct().join(
        label.select(F.col("id").alias("a"), F.col("label").alias("la")), "a", "left").join(
        label.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b", "left").where("la is null or lb is null or la != lb")
    more = stored(other.select("a", "b").join(pairs, ["a", "b"], "left_anti"), "pairs", 16)
    known = stored(known.union(_verified(docs, nodes, more, clashes)), "known", 16)
    discard(met, pairs, label, more)
    if regions.limit(1).count():
        known = _rounds(docs, nodes, regions, known, clashes)
    label = _labels(nodes, known.where("link").select("a", "b"))
    named = stored(sets.select("id", "rep", "copies").join(label, "id", "left").select("id", "copies", F.coalesce("label", "rep").alias("component_id")), "named", 16)
    some = join_hot(own.where("n > 0").select("doc_id", F.col("n").alias("n_shingles"), name.alias("id")), named, "id", "copies").select("doc_id", "n_shingles", "component_id")
    return some.union(own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
