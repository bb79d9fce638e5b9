"""The prefix trie of all conversations, built in shards by double arrays.

* Order. Turns are sorted into ranges by conversation and turn and numbered as they stream by;
  a conversation that goes on in the next range gets its first numbers from a table of one row
  a range, so no conversation has to fit a task.
* Nodes. A node's 128-bit key is the exclusive or of hashes of (place, turn) along its path, so
  the keys of a long conversation, cut every ``SEGMENT`` turns, come from partial sums.
* Shards. Equal segments are counted once. The others are sorted into ranges by where they
  start and their turns, so a range is a set of neighbouring prefixes, however many
  conversations share one. A task turns each ``SHARD`` turns into a double array over dense
  turn numbers and follows all segments through it. Nodes inside a shard are finished there;
  those that may reach beyond (the paths of its first and last segment, and paths that
  a further segment extends) leave with partial aggregates.
* Upper nodes. The partial aggregates are merged by key, and subtree sums run up by pointer
  doubling: after round i a node holds what lies less than 2^i below it.

Memory per task: one shard; the driver sees one row a range and counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .double_array import DoubleArray
from .work import contained, crc_of_id, discard, join_hot, stored

SEGMENT = 256
SHARD = 1 << 18
BORROWED = 6  # a conversation takes less than so many turns from its group's first
GROUP = 100
TIE = 64  # characters of a text that order rows with the same turn and role
PIECE = 2000  # conversation ids written into one string

_EMPTY = sha256(b"").hexdigest()
_PARTIAL = "shared boolean, a long, b long, pa long, pb long, depth long, n long, m long, size long, children long, leaves long, saved long, pm long"


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the turns of each conversation within a sorted range."""
    last, seen, part = None, 0, TaskContext.get().partitionId()
    for batch in batches:
        conv = batch.column(0).to_numpy()
        if not len(conv):
            continue
        starts = np.flatnonzero(np.diff(conv, prepend=conv[0] - 1))
        place = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv))))
        if conv[0] == last:
            place[: len(conv) if len(starts) == 1 else starts[1]] += seen
        last, seen = conv[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(place), batch.column(1), batch.column(2), pa.array(np.full(len(conv), part, np.int32))], ["conv", "place", "t", "size", "part"])


def numbered_turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, place from 0, t: 128-bit hash of role and text, size: code points of the text)."""
    spark = conversations.sparkSession
    said, who = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text, role))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), who.alias("role"), F.substring(said, 1, TIE).alias("head"),
        F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said))).alias("t"), F.length(said).cast("long").alias("size"))
    order = [F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("head").asc(), F.col("t").asc()]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "t", "size")
    now = stored(ranges.mapInArrow(_numbers, "conv long, place long, t binary, size long, part int"), "turns")
    marks = now.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "place")).alias("last")).collect()
    shifts, carried = [], (None, 0)  # one row a range
    for part, first, (conv_id, place) in sorted(marks):
        before = carried[1] if carried[0] == first else 0
        if before:
            shifts.append((part, first, before))
        carried = conv_id, place + 1 + (before if conv_id == first else 0)
    if not shifts:
        return now.drop("part")
    moved = F.broadcast(spark.createDataFrame(shifts, "part int, conv long, before long"))
    return now.join(moved, ["part", "conv"], "left").select("conv", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "t", "size")


def _sized(turns: DataFrame) -> DataFrame:
    """(conv, h, owned, borrowed, total): how many turns each conversation has before and after it is rebuilt."""
    owned = turns.groupBy("conv").agg(F.count("*").alias("owned"))
    return owned.select("conv", F.lit(0).alias("h"), "owned", F.lit(0).alias("borrowed"), F.col("owned").alias("total"))


def _rebuilt_sizes(turns: DataFrame) -> DataFrame:
    base, h = F.col("conv") - F.col("conv") % GROUP, (crc_of_id(F.col("conv")) % BORROWED).cast("int")
    owned = stored(turns.groupBy("conv").agg(F.count("*").alias("owned")), "owned", 16)
    lenders = owned.where(F.col("conv") % GROUP == 0).select(F.col("conv").alias("base"), F.col("owned").alias("lent"))
    sized = owned.withColumns({"base": base, "h": h}).join(lenders, "base", "left")
    sized = sized.withColumn("borrowed", F.least("h", F.coalesce("lent", F.lit(0))))
    return sized.select("conv", "h", "owned", "borrowed", (F.col("borrowed") + F.greatest(F.col("owned") - F.col("h"), F.lit(0))).alias("total"))


def rebuilt_turns(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv, place, t, size, total) with the first turns taken from the group's first conversation."""
    own = join_hot(turns.where(F.col("place") >= crc_of_id(F.col("conv")) % BORROWED), sizes.where("owned > h"), "conv", "owned")
    own = own.select("conv", (F.col("place") - F.col("h") + F.col("borrowed")).alias("place"), "t", "size", "total")
    lent = turns.where((F.col("conv") % GROUP == 0) & (F.col("place") < BORROWED - 1)).select(F.col("conv").alias("base"), "place", "t", "size")
    takers = sizes.where("borrowed > 0").select("conv", "borrowed", "total", (F.col("conv") - F.col("conv") % GROUP).alias("base"))
    # A base has at most twice GROUP takers and lends BORROWED turns at most.
    return own.union(lent.join(takers, "base").where("place < borrowed").select("conv", "place", "t", "size", "total"))


def _segments(turns: DataFrame, sizes: DataFrame, segment: int) -> DataFrame:
    """(conv, k, sa, sb, ea, eb, total, turns): pieces of so many turns with the keys of the nodes where they start and end."""
    hashed = turns.withColumns({"x": F.xxhash64("place", "t"), "y": F.xxhash64(F.lit("y"), "t", "place"), "k": F.floor(F.col("place") / segment)})
    cut = hashed.groupBy("conv", "k").agg(
        F.bit_xor("x").alias("dx"), F.bit_xor("y").alias("dy"), F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("place", "t", "x", "y", "size"))).alias("turns"))
    cut = cut.withColumn("turns", F.transform("turns", lambda s: F.struct(s.t, s.x, s.y, s["size"])))
    bare = F.array().cast(cut.schema["turns"].dataType)
    none = sizes.where("total = 0").select("conv", F.lit(0).cast("long").alias("k"), *(F.lit(0).cast("long").alias(c) for c in ("dx", "dy", "total")), bare.alias("turns"))
    cut = stored(cut.union(none), "segments")
    at, zero = ["conv", "k"], F.lit(0).cast("long")
    first = cut.where("k = 0").withColumns({"sa": zero, "sb": zero})
    if cut.where("k > 0").limit(1).count():
        so_far = Window.partitionBy("conv").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        full = cut.where(F.col("total") > (F.col("k") + 1) * segment).select("conv", (F.col("k") + 1).alias("k"), F.bit_xor("dx").over(so_far).alias("sa"), F.bit_xor("dy").over(so_far).alias("sb"))
        first = first.unionByName(cut.where("k > 0").join(full, at))
    return first.select(*at, "sa", "sb", F.col("sa").bitwiseXOR(F.col("dx")).alias("ea"), F.col("sb").bitwiseXOR(F.col("dy")).alias("eb"), "total", "turns")


class Shard:
    """Neighbouring segments as a double array, with what their nodes add up to."""

    def __init__(self, table: pa.Table, segment: int) -> None:
        self.segment, table = segment, table.combine_chunks()
        self.k, self.sa, self.sb, self.n, self.m = (table.column(c).to_numpy() for c in ("k", "sa", "sb", "n", "m"))
        lists = table.column("turns").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        self.ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
        self.begin = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        turns = lists.flatten()
        hashes = turns.field("t").cast(pa.binary(16))
        pairs = np.frombuffer(hashes.buffers()[1], np.uint64)[2 * hashes.offset : 2 * (hashes.offset + len(hashes))].reshape(-1, 2) if len(hashes) else np.empty((0, 2), np.uint64)
        self.x, self.y, self.size = (turns.field(c).to_numpy() for c in ("x", "y", "size"))
        symbols, starts = _dense(pairs), _dense(np.stack([self.sa, self.sb], 1))
        self._build(symbols, starts + (symbols.max(initial=-1) + 1), table.column("more").to_numpy(zero_copy_only=False))

    def _build(self, symbols: np.ndarray, starts: np.ndarray, more: np.ndarray) -> None:
        lengths, self.trie = self.ends - self.begin, DoubleArray()
        most, width = int(lengths.max()), int(starts.max()) + 1
        # The segments' first symbol stands for the node where they start.
        active, state, levels = np.arange(len(starts)), np.zeros(len(starts), np.int64), []
        for level in range(most + 1):
            now = starts if level == 0 else symbols[self.begin[active] + level - 1]
            pairs, which = np.unique(state * width + now, return_inverse=True)
            self.trie.add(pairs // width, pairs % width)
            levels.append((active, state, now))
            state = self.trie.step(state, now)
            going = lengths[active] > level
            active, state = active[going], state[going]
        places = len(self.trie.check)
        self.count, self.least = np.zeros(places, np.int64), np.full(places, np.iinfo(np.int64).max)
        self.ka, self.kb, self.depth, self.wide = (np.zeros(places, np.int64) for _ in range(4))
        self.shared = np.zeros(places, bool)
        border = np.zeros(len(starts), bool)
        border[[0, -1]] = True
        border |= more
        a, b, self.by_level = self.sa.copy(), self.sb.copy(), []
        for level, (active, state, now) in enumerate(levels):
            node = self.trie.step(state, now)
            if level:
                at = self.begin[active] + level - 1
                a[active] ^= self.x[at]
                b[active] ^= self.y[at]
                self.wide[node] = self.size[at]
            np.add.at(self.count, node, self.n[active])
            np.minimum.at(self.least, node, self.m[active])
            self.ka[node], self.kb[node], self.depth[node] = a[active], b[active], self.k[active] * self.segment + level
            self.shared[node[border[active]]] = True
            self.by_level.append(np.unique(node))
        self.shared[self.by_level[0]] = True

    def rows(self) -> pa.RecordBatch:
        children, leaves, saved = (np.zeros(len(self.count), np.int64) for _ in range(3))
        for nodes in reversed(self.by_level[1:]):
            inner = nodes[~self.shared[nodes]]
            leaves[inner] += children[inner] == 0
            saved[inner] += (self.count[inner] - 1) * self.wide[inner]
            above = self.trie.check[inner]
            np.add.at(children, above, 1)
            np.add.at(leaves, above, leaves[inner])
            np.add.at(saved, above, saved[inner])
        top, below = self.by_level[0], np.concatenate([np.empty(0, np.int64), *self.by_level[1:]])
        nodes, parents = np.concatenate([top, below]), self.trie.check[below]
        joint = np.arange(len(nodes)) < len(top)
        counted = ~joint | (self.depth[nodes] == 0)  # what starts in the middle was counted where it ended
        blank = np.zeros(len(top), np.int64)

        def column(values, known=None):
            return pa.array(values, mask=None if known is None else ~known)

        of_parent = lambda values: np.concatenate([blank, values[parents]])
        return pa.RecordBatch.from_arrays([
            column(self.shared[nodes]), column(self.ka[nodes]), column(self.kb[nodes]), column(of_parent(self.ka), ~joint), column(of_parent(self.kb), ~joint), column(self.depth[nodes]),
            column(np.where(counted, self.count[nodes], 0)), column(self.least[nodes], counted), column(self.wide[nodes], counted), column(children[nodes]), column(leaves[nodes]), column(saved[nodes]),
            column(of_parent(self.least), ~joint & ~of_parent(self.shared).astype(bool))], [c.split()[0] for c in _PARTIAL.split(", ")])


def _dense(pairs: np.ndarray) -> np.ndarray:
    """Numbers 0, 1, ... for the distinct pairs."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    along = pairs[order]
    out = np.empty(len(pairs), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], (along[1:] != along[:-1]).any(axis=1)])[: len(pairs)])
    return out


def _shards(segment: int, shard: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                turns += len(batch.column(batch.schema.get_field_index("turns")).flatten())
            if turns >= shard:
                yield Shard(pa.Table.from_batches(held), segment).rows()
                held, turns = [], 0
        if held:
            yield Shard(pa.Table.from_batches(held), segment).rows()

    return rows


def _merged(shared: DataFrame) -> DataFrame:
    """(a, b, pa, pb, depth, n, m, children, leaves, saved) of the nodes that several shards may have."""
    whole = stored(shared.groupBy("a", "b").agg(
        *(F.max(c).alias(c) for c in ("pa", "pb", "depth", "size")), F.min("m").alias("m"), *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved"))), "upper", 16)
    upper = whole.where("pa is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("more"))
    whole = whole.join(upper, ["a", "b"], "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).drop("more")
    whole = stored(whole.withColumns({
        "leaves": F.col("leaves") + (F.col("children") == 0).cast("long"), "saved": F.col("saved") + (F.col("n") - 1) * F.col("size")}), "upper", 16)
    sums = whole.select("a", "b", "pa", "pb", "leaves", "saved")
    while sums.where("pa is not null").limit(1).count():
        rising = sums.where("pa is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = sums.where("pa is not null").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
        new = sums.join(rising, ["a", "b"], "left").join(above, ["pa", "pb"], "left")
        new = stored(new.select(
            "a", "b", F.col("qa").alias("pa"), F.col("qb").alias("pb"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "sums", 16)
        if sums is not whole:
            discard(sums)
        sums = new
    return whole.drop("leaves", "saved", "size").join(sums.drop("pa", "pb"), ["a", "b"])


def _id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (a, b, conv) as strings of at most PIECE ids of a node."""
    for batch in batches:
        a, b, conv = (batch.column(k).to_numpy() for k in range(3))
        if not len(a):
            continue
        starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        starts = np.unique(np.concatenate([np.arange(s, e, PIECE) for s, e in zip(starts, np.append(starts[1:], len(a)))]))
        told = [",".join(map(str, conv[s:e].tolist())) for s, e in zip(starts, np.append(starts[1:], len(a)))]
        yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), pa.array(conv[starts]), pa.array(told)], ["a", "b", "first", "ids"])


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node from its pieces in order, a piece at a time."""
    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["a", "b", "sha"])

    node, digest = None, None
    for batch in batches:
        done = []
        for a, b, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))):
            if (a, b) != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (a, b), sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield batch_of(done)
    if node is not None:
        yield batch_of([(*node, digest.hexdigest())])


def _end_digests(ends: DataFrame) -> DataFrame:
    """(a, b, sha) of the nodes at which conversations end. A node's ids meet in one task as
    strings of PIECE ids that stream by: a digest has to see them in order."""
    pieces = ends.repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv").mapInArrow(_id_pieces, "a long, b long, first long, ids string")
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").select("a", "b", "ids").mapInArrow(_hashed_ids, "a long, b long, sha string")


@contained
def prefix_trie(conversations: DataFrame, rebuild: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT, shard: int = SHARD) -> DataFrame:
    """One row per distinct sequence of first turns, the empty one included.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. rebuild: conversations first take less than BORROWED turns from
    the one whose id is theirs rounded down to a multiple of GROUP.

    Turns are ordered with null first; rows of a conversation with the same turn by role, the
    first TIE characters of the text, then a hash; repeated rows stay. A null role or text is
    empty; rows without a conversation id are ignored. An empty table gives no rows, and other
    columns are ignored.
    """
    turns = numbered_turns(conversations, conv_col, turn_col, role_col, text_col)
    sizes = stored(_rebuilt_sizes(turns) if rebuild else _sized(turns), "sizes", 16)
    whole = rebuilt_turns(turns, sizes) if rebuild else join_hot(turns, sizes, "conv", "owned").select("conv", "place", "t", "size", "total")
    segments = _segments(whole, sizes, segment)
    last = F.col("total") <= (F.col("k") + 1) * segment
    distinct = segments.groupBy("k", "sa", "sb", "ea", "eb").agg(
        F.count("*").alias("n"), F.min("conv").alias("m"), F.max(~last).alias("more"), F.first("turns").alias("turns"))
    order = ["k", "sa", "sb", "turns"]
    partial = stored(distinct.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_shards(segment, shard), _PARTIAL), "partial")
    upper = stored(_merged(partial.where("shared")), "upper", 16)
    columns = ["a", "b", "depth", "n", "m", "children", "leaves", "saved"]
    inner = partial.where("not shared")
    open_ends = inner.where("pm is null").select(*columns, "pa", "pb").union(upper.where("pa is not null").select(*columns, "pa", "pb"))
    parents = upper.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("m").alias("pm"), F.greatest("children", F.lit(1)).alias("weight"))
    nodes = inner.where("pm is not null").select(*columns, "pm").union(join_hot(open_ends, parents, ["pa", "pb"], "weight").select(*columns, "pm")).union(
        upper.where("pa is null").select(*columns, F.lit(None).cast("long").alias("pm")))
    ends = _end_digests(segments.where(last).select(F.col("ea").alias("a"), F.col("eb").alias("b"), "conv"))
    return nodes.join(ends, ["a", "b"], "left").select(
        F.col("m").alias("conv_id"), "depth", F.col("pm").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(_EMPTY)).alias("ends_sha256"))
