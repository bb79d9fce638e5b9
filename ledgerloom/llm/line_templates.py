"""Line dedup: a log-template tree over all lines, recurring templates dropped.

The tree has a fixed depth: token count, then the first ``DEPTH`` tokens, where a token with
a digit is a variable field. Lines of one leaf that agree in at least ``ALIKE`` of their
tokens, place by place, are alike. Two lines that differ in d places agree in one of d + 1
stretches of places, so a leaf is divided by what stands in each stretch, and within such a
part every line that is like the part's most frequent line joins its template; the places
where the lines of a template differ are its variable fields. No part is held by a task.

A template recurs when it stands in documents that have nothing else in common. Documents
are grouped first: those that agree in all ``ROWS`` min-hashes of any of ``BANDS`` bands, over
all their 3-word shingles (words with a digit are all one word), are near copies, and so is
whatever such links reach. If at least ``LEAST`` distinct documents with a template are outside its largest
group, its lines are dropped, in every document. A group counts as one context however large
it is, and neighbours do not matter, so all lines of a shared passage fare alike. Lines that
only copies and near copies of a document share are kept. A document's only line is kept.

Three passes over the documents, none of which moves texts between executors: leaves are
counted; lines of leaves with ``LEAST`` lines are listed by document, with the document's bands;
lines are dropped. Each cuts a batch of texts into lines and tokens in numpy. Tokens are runs of bytes other than
space and U+0009..U+000D, digits are 0 to 9; hashes of lines and leaves have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .work import contained, discard, free_names, join_hot, mix64, stored

DEPTH = 3
ALIKE = 0.7
LEAST = 3
BANDS = 16
ROWS = 5
BITS = 1 << 23
BROADCAST_LINES = 1 << 21
_FIELD = "\x00"
_PIECE = 1 << 18
_SEEN_TEXTS = 1 << 17  # hashes of texts, and of lines, that a task remembers in order not to say things twice
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_DIGITS = np.isin(np.arange(256), np.arange(48, 58))
_BYTES = np.where(_SPACES, np.uint64(0), mix64(np.arange(1, 257, dtype=np.uint64)))
_STEP = 0x9E3779B97F4A7C15
_FLIP, _TIMES = mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)).astype(np.uint32).reshape(2, -1) | np.uint32(1)


def _powers(step: int, n: int) -> np.ndarray:
    out = np.full(n, step, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_STEP, 2 * _PIECE), _powers(pow(_STEP, -1, 1 << 64), 2 * _PIECE)


@dataclass
class Lines:
    """The lines with tokens of some texts, and their tokens, in order."""

    token: np.ndarray  # a hash of each token, 0 for a variable field
    token_text: np.ndarray  # the number of its text
    text: np.ndarray  # of each line: the number of its text
    place: np.ndarray  # its place among all lines of the text
    first: np.ndarray  # its first token
    size: np.ndarray  # how many tokens it has
    path: np.ndarray  # its leaf
    line: np.ndarray  # its masked tokens

    def combined(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A hash of each run of tokens; the runs do not overlap."""
        if not len(first):
            return np.empty(0, np.uint64)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(first, size) + place
        power = _UP if not len(place) or place.max() < len(_UP) else _powers(_STEP, int(place.max()) + 1)
        total = np.add.reduceat((self.token[at] + np.uint64(1)) * power[place], np.cumsum(size) - size)
        return mix64(total ^ mix64(size.astype(np.uint64)))


def _cut(data: np.ndarray, ends: np.ndarray) -> Lines:
    """The lines of texts that stand one after another in ``data`` and end at ``ends``."""
    space = _SPACES[data]
    first = ~space
    first[1:] &= space[:-1]
    begins = np.concatenate([[0], ends[:-1]])
    inside = begins[begins < len(data)]
    first[inside] = ~space[inside]
    start = np.flatnonzero(first)
    none = np.empty(0, np.int64)
    if not len(start):
        return Lines(none.astype(np.uint64), none, none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    up, down = (_UP, _DOWN) if len(data) <= len(_UP) else (_powers(_STEP, len(data)), _powers(pow(_STEP, -1, 1 << 64), len(data)))
    token = mix64(np.add.reduceat(_BYTES[data] * up[: len(data)], start) * down[start])
    token[np.logical_or.reduceat(_DIGITS[data], start)] = 0
    text = np.searchsorted(ends, start, "right")
    newline = np.flatnonzero(data == 10)
    row = np.searchsorted(newline, start)
    change = np.ones(len(start), bool)
    change[1:] = (row[1:] != row[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(change)
    size = np.diff(np.append(head, len(start)))
    out = Lines(token, text, text[head], row[head] - np.searchsorted(newline, begins)[text[head]], head, size, none, none)
    path = mix64(size.astype(np.uint64))
    for k in range(DEPTH):
        path = mix64(path ^ (np.where(size > k, token[np.minimum(head + k, len(token) - 1)], np.uint64(0)) * np.uint64(_STEP) + np.uint64(k)))
    out.path, out.line = path, out.combined(head, size)
    return out


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, Lines]]:
    """(first text, first text after it, lines) of stretches of a string column."""
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PIECE, "right")) - 1)
        yield at, to, _cut(data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at])
        at = to


def _minima(token: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """BANDS * ROWS min-hashes over the 3-word shingles of each of n texts."""
    out = np.zeros((n, BANDS * ROWS), np.uint32)
    if not len(token):
        return out
    shingle = token * np.uint64(_STEP)
    for k, factor in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        shingle[-k:] += np.uint64(k)
        if len(token) > k:
            shingle[:-k] += np.where(text[k:] == text[:-k], token[k:] * np.uint64(factor), np.uint64(k))
    shingle = mix64(shingle).astype(np.uint32)
    some, begin = np.unique(text, return_index=True)
    for k in range(BANDS * ROWS):
        out[some, k] = np.minimum.reduceat((shingle ^ _FLIP[k]) * _TIMES[k], begin)
    return out


def _bands(minima: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each text; near copies share at least one of them."""
    low = minima.astype(np.uint64)
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(low), 1))
    for k in range(ROWS):
        keys = mix64(keys ^ (low[:, k::ROWS] << np.uint64(16)))
    return keys.view(np.int64)


def _bit(values: np.ndarray) -> np.ndarray:
    return (mix64(values.view(np.uint64)) & np.uint64(BITS - 1)).astype(np.int64)


def _once(*columns: np.ndarray) -> np.ndarray:
    """The places of the first of equal rows."""
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = mix64(key ^ c.astype(np.uint64)) + np.uint64(1)
    return np.sort(np.unique(key, return_index=True)[1])


def _count_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each leaf, how many texts of a stretch have a line of it."""
    for batch in batches:
        for _, _, lines in _pieces(batch.column(0)):
            path, n = np.unique(lines.path[_once(lines.text, lines.path)], return_counts=True)
            yield pa.record_batch([pa.array(path.view(np.int64)), pa.array(n.astype(np.int64))], names=["path", "n"])


_SEEN = "path long, line long, body string, doc long, sketch array<long>"
_BODY_FORM = "line long, nth int, part long"


def _body(text: bytes, place: int) -> str:
    """The masked tokens of a line."""
    tokens = text.split(b"\n")[place].split()
    return " ".join(_FIELD if any(48 <= c < 58 for c in t) else t.decode() for t in tokens)


def _occurrences(bits_value):
    """Distinct (line, document) of busy leaves; the first of a document has its sketch, and
    the first of a line in a task its tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bits_value.value
        known: set[int] = set()
        texts: set[int] = set()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            column = batch.column(0)
            for at, to, lines in _pieces(column):
                slot = _bit(lines.path)
                of_text = np.bincount(lines.text, minlength=to - at)
                keep = (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool) & (of_text[lines.text] > 1)
                keep = np.flatnonzero(keep)
                keep = keep[_once(lines.text[keep], lines.line[keep])] if len(keep) else keep
                some = np.unique(lines.text[keep])
                if not len(some):
                    continue
                raw = {t: column[at + t].as_buffer().to_pybytes() for t in some.tolist()}
                docs = {t: xxhash.xxh3_64_intdigest(b) for t, b in raw.items()}
                fresh = np.zeros(to - at, bool)
                for t, doc in docs.items():
                    if doc not in texts:  # copies of a text say nothing more
                        texts.add(doc)
                        fresh[t] = True
                if len(texts) > _SEEN_TEXTS:
                    texts.clear()
                mine = fresh[lines.token_text]
                bands = _bands(_minima(lines.token[mine], lines.token_text[mine], to - at))
                columns: list[list] = [[], [], [], [], []]
                last = -1
                for k in keep[fresh[lines.text[keep]]].tolist():
                    t, line = int(lines.text[k]), int(lines.line[k].view(np.int64))
                    body = None
                    if line not in known:
                        known.add(line)
                        body = _body(raw[t], int(lines.place[k]))
                    for c, value in zip(columns, (int(lines.path[k].view(np.int64)), line, body, int(np.uint64(docs[t]).view(np.int64)), None if t == last else bands[t].tolist())):
                        c.append(value)
                    last = t
                if len(known) > _SEEN_TEXTS:
                    known.clear()
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "line", "body", "doc", "sketch"])

    return rows


def different(size: int) -> int:
    """In how many of so many places alike lines may differ."""
    return size - int(np.ceil(ALIKE * size - 1e-9))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (line, nth, part): what stands in each stretch of the places after the leaf's tokens."""
    for batch in batches:
        lines, nths, parts = [], [], []
        for line, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = body.split(" ")
            rest, d = tokens[DEPTH:], different(len(tokens))
            stretches = d + 1 if d < len(rest) else 1
            cuts = [len(rest) * k // stretches for k in range(stretches + 1)]
            for k in range(stretches):
                own = rest[cuts[k] : cuts[k + 1]] if stretches > 1 or d < len(rest) else []
                lines.append(line)
                nths.append(k)
                parts.append(int(np.uint64(xxhash.xxh3_64_intdigest(" ".join(own))).view(np.int64)))
        yield pa.record_batch([pa.array(lines, pa.int64()), pa.array(nths, pa.int32()), pa.array(parts, pa.int64())], names=["line", "nth", "part"])


def templates(lines: DataFrame) -> DataFrame:
    """(line, n, template) for rows (path, line, body, n), each line of the leaves once.

    A template is named by the smallest of its lines. A line that heads a large share of all
    links is joined apart.
    """
    parts = stored(lines.select("line", "body").mapInArrow(_parts, _BODY_FORM).join(lines.select("line", "path", "n"), "line").withColumn(
        "key", F.xxhash64("path", "nth", "part")), "parts", 4)
    heads = parts.groupBy("key").agg(F.max(F.struct("n", "line")).alias("h"), F.count("*").alias("rows")).where("rows > 1").select("key", F.col("h.line").alias("head"), "rows")
    links = join_hot(parts.select("key", "line"), stored(heads, "heads", 16), "key", "rows").where("line != head").select("line", "head").distinct()
    links = stored(links, "links", 4)
    body = lines.select("line", F.split("body", " ").alias("tokens"))
    others = links.groupBy("head").agg(F.count("*").alias("n")).join(body.select(F.col("line").alias("head"), F.col("tokens").alias("other")), "head")
    both = join_hot(links, stored(others, "others", 16), "head", "n").join(body, "line")
    same = F.size(F.filter(F.zip_with("tokens", "other", lambda x, y: x == y), lambda e: e))
    alike = (F.size("tokens") == F.size("other")) & (same >= F.ceil(F.size("tokens") * ALIKE - 1e-9))
    found = components(both.where(alike).select(F.col("line").alias("u"), F.col("head").alias("v")))
    discard(parts, links)
    return lines.select("line", "n").join(found.withColumnRenamed("node", "line"), "line", "left").select("line", "n", F.coalesce("component", "line").alias("template"))


def _stars(heads: bool):
    """Of the band keys of a batch of documents: each key with its smallest document, or that document's
    links to the key's others. A key of very many documents is a row a batch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc = batch.column(1).flatten().to_numpy(), np.repeat(batch.column(0).to_numpy(), BANDS)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            if heads:
                yield pa.record_batch([pa.array(key[head]), pa.array(doc[head])], names=["key", "doc"])
                continue
            first = doc[head][np.cumsum(head) - 1]
            u, v = doc[doc != first], first[doc != first]
            own = _once(u, v)
            yield pa.record_batch([pa.array(u[own]), pa.array(v[own])], names=["u", "v"])

    return rows


def _groups(seen: DataFrame) -> DataFrame:
    """Rows (doc, group) of the documents that are linked to another one. The keys are shuffled once."""
    sketches = seen.where("sketch is not null").select("doc", "sketch")
    heads = sketches.mapInArrow(_stars(True), "key long, doc long").withColumn("first", F.min("doc").over(Window.partitionBy("key")))
    met = heads.where("doc != first").select(F.col("doc").alias("u"), F.col("first").alias("v")).union(sketches.mapInArrow(_stars(False), "u long, v long"))
    found = components(met)
    return found.select(F.col("node").alias("doc"), F.col("component").alias("group"))


def recurring_lines(documents: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(line ids to drop, counts by template: template, docs, outside)."""
    spark = documents.sparkSession
    texts = documents.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"))
    busy = texts.mapInArrow(_count_paths, "path long, n long").groupBy("path").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    slots = busy.select("path").mapInArrow(
        lambda it: (pa.record_batch([pa.array(np.unique(_bit(b.column(0).to_numpy().astype(np.int64))).astype(np.int32))], names=["slot"]) for b in it), "slot int").distinct()
    bits = np.zeros(BITS // 8, np.uint8)
    at = slots.toArrow().column("slot").to_numpy()
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    seen = stored(texts.mapInArrow(_occurrences(spark.sparkContext.broadcast(bits)), _SEEN), "lines")
    lines = seen.groupBy("path", "line").agg(F.max("body").alias("body"), F.count_distinct("doc").alias("n"))
    leaf = lines.groupBy("path").agg(F.sum("n").alias("all")).where(F.col("all") >= LEAST)
    lines = stored(lines.join(leaf, "path").select("path", "line", "body", "n"), "distinct", 16)
    template = stored(templates(lines), "templates", 16)
    met = stored(join_hot(seen.select("line", "doc"), template, "line", "n").select("template", "doc").distinct(), "met", 16)
    by_group = met.join(_groups(seen), "doc", "left").groupBy("template", F.coalesce("group", "doc").alias("group")).agg(F.count("*").alias("n"))
    counts = by_group.groupBy("template").agg(F.sum("n").alias("docs"), (F.sum("n") - F.max("n")).alias("outside"))
    recur = stored(counts.where(F.col("outside") >= LEAST), "recurring", 16)
    drop = stored(template.join(recur.select("template"), "template").select("line", "template"), "dropped", 16)
    discard(seen, met, template, lines)
    return drop, recur


def _gone(lines: Lines, hit: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """(text, places) of what goes from each text: its hits, but never its last or only line."""
    of_text = np.bincount(lines.text)
    hit = hit & (of_text[lines.text] > 1)
    for t in np.unique(lines.text[hit]).tolist():
        at = np.flatnonzero(hit & (lines.text == t)) if len(of_text) == 1 else np.arange(*np.searchsorted(lines.text, [t, t + 1]))
        at = at[hit[at]]
        places = lines.place[at].tolist()
        yield t, places[:-1] if len(places) == of_text[t] else places


def _dropper(value, at: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = value.value
        for batch in batches:
            column = batch.column(at)
            changed: dict[int, tuple[str, list[int]]] = {}
            for begin, _, lines in _pieces(column):
                slot = np.minimum(np.searchsorted(ids, lines.line), max(len(ids) - 1, 0))
                hit = ids[slot] == lines.line if len(ids) else np.zeros(len(lines.line), bool)
                if not hit.any():
                    continue
                for t, places in _gone(lines, hit):
                    gone = set(places)
                    text = "\n".join(x for k, x in enumerate(column[begin + t].as_py().split("\n")) if k not in gone)
                    changed[begin + t] = (text, places)
            columns = list(batch.columns)
            if changed:
                texts = column.to_pylist()
                for k, (text, _) in changed.items():
                    texts[k] = text
                columns[at] = pa.array(texts, pa.string())
            places = pa.array([changed[k][1] if k in changed else [] for k in range(batch.num_rows)], pa.list_(pa.int32()))
            yield pa.record_batch([*columns, places], names=[*batch.schema.names, "dropped_lines"])

    return rows


@contained
def drop_recurring_lines(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, the text without recurring lines, and ``dropped_lines``: the
    places (from 0, among all lines) of the lines that went.

    A null text stays null and an empty one empty. Rows that repeat a text count once and
    fare alike. An empty table gives no rows. Other columns pass through, whatever their
    names, except that an input column ``dropped_lines`` is replaced.
    """
    spark = documents.sparkSession
    docs = documents.drop("dropped_lines").withColumn(text_col, F.col(text_col).cast("string"))
    drop, _ = recurring_lines(docs, text_col)
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema) + ", dropped_lines array<int>"
    at = docs.columns.index(text_col)
    if drop.count() <= BROADCAST_LINES:
        ids = np.sort(drop.select("line").toArrow().column("line").to_numpy().astype(np.int64).view(np.uint64))
        return docs.mapInArrow(_dropper(spark.sparkContext.broadcast(ids), at), kinds)
    return _dropped_by_join(docs, drop, text_col)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, check, line, place, of) of texts with more than one line."""
    for batch in batches:
        for at, to, lines in _pieces(batch.column(2)):
            of = np.bincount(lines.text, minlength=to - at)[lines.text]
            some = np.flatnonzero(of > 1)
            own = pa.array(at + lines.text[some])
            yield pa.record_batch([
                batch.column(0).take(own), batch.column(1).take(own), pa.array(lines.line[some].view(np.int64)), pa.array(lines.place[some].astype(np.int32)),
                pa.array(of[some].astype(np.int32))], names=["key", "check", "line", "place", "of"])


def _dropped_by_join(docs: DataFrame, drop: DataFrame, text_col: str) -> DataFrame:
    """The same result where the dropped lines are too many to broadcast: by equi-joins.

    Texts are known by 128 bits of their hashes.
    """
    key, check, gone = free_names(docs, "key", "check", "gone")
    hashes = {key: F.xxhash64(text_col), check: F.xxhash64(F.lit(3), text_col)}
    lines = docs.where(F.col(text_col).isNotNull()).select(hashes[key].alias("key"), hashes[check].alias("check"), F.col(text_col).alias("text")).mapInArrow(
        _places, "key long, check long, line long, place int, of int").distinct()
    places = lines.join(drop.select("line"), "line").groupBy("key", "check").agg(F.sort_array(F.collect_set("place")).alias("gone"), F.max("of").alias("of"))
    places = places.select(
        F.col("key").alias(key), F.col("check").alias(check), F.when(F.size("gone") == F.col("of"), F.slice("gone", 1, F.size("gone") - 1)).otherwise(F.col("gone")).alias(gone))
    both = docs.withColumns(hashes).join(places, [key, check], "left").withColumn("dropped_lines", F.coalesce(gone, F.array().cast("array<int>")))
    kept = F.filter(F.transform(F.split(text_col, "\n"), lambda x, k: F.struct(x.alias("x"), k.alias("k"))), lambda s: ~F.array_contains("dropped_lines", s["k"]))
    text = F.when(F.size("dropped_lines") == 0, F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    return both.withColumn(text_col, text).drop(key, check, gone)
