"""Packing: bounded-space online best-fit packing of token sequences.

Each partition keeps ``OPEN`` windows of ``SIZE`` tokens. A document's whole windows leave at
once; its rest goes to the open window with the least room that still holds it. When none
does, the fullest window is topped up with a cut of the document (unless the gap is under
``GAP`` tokens) and emitted. Windows still open at the end of a partition carry their ids to
a tree of merges, ``FAN`` partitions to a task, that packs them the same way; the windows
left at the root are filled up one after another, and the last is cut at powers of two,
which need no padding.

Memory per task: one batch of text, ``OPEN`` windows, and in a merge FAN * OPEN windows.
"""

from __future__ import annotations

import os
import re
import threading
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import contained, stored

SIZE = 2048
OPEN = 64
GAP = 8
FAN = 16
END_ID = 1
_CACHE = 150_000
_SLICE = 1 << 21
# White space to Python's str.split only: the tokenizer sees these as characters.
_ODD = re.compile("[\x1c-\x1f]")
# Where lower-casing character by character is str.lower, and no special token can stand.
_MARK = " \x01 "
_PLAIN = re.compile("[\x00-\x1b\x20-\u012f\u0131-\u024f]*")
# A run of letters with symbols after it: two tokens' worth of text that never mix.
_WORD = re.compile("([a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\\[-`{-~]+)")
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, ids binary"


def _gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of the pool, one after another."""
    total = int(lengths.sum())
    return pool[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)]


class WordEncoder:
    """Token ids of whole texts, with the ids of each distinct word kept.

    The tokenizer lower-cases, drops white space and never lets a token span it, so a text's
    ids are its lower-cased chunks' ids in a row; a chunk of letters and symbols is its
    letters' ids and its symbols'. Texts beyond the Latin blocks keep their case and chunks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For lower-case letters alone nothing is to be normalised or divided but by spaces.
        self.whole = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.bare = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.pool = np.empty(0, np.uint32)
        self.starts = np.zeros(1, np.int64)
        self.lengths = np.zeros(1, np.int64)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of letters one after another, and each word's number of ids."""
        lines = [" ".join(words[k : k + 400]) for k in range(0, len(words), 400)]
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.bare
        try:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        finally:
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.whole
        ids = np.fromiter(chain.from_iterable(got), np.uint32, sum(map(len, got)))
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)

    def _learn(self, parts: list[str]) -> None:
        plain = [p for p in parts if _LETTERS.fullmatch(p)]
        if plain:
            ids, lengths = self._words(plain)
            if len(lengths) == len(plain) and lengths.sum() == len(ids):
                self._add(plain, ids, lengths)
                parts = [p for p in parts if p not in self.known]
        got = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        self._add(parts, np.fromiter(chain.from_iterable(got), np.uint32, int(lengths.sum())), lengths)

    def _add(self, parts: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.pool = np.concatenate([self.pool, ids])
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts))))

    def _parts(self, chunks: list[str]) -> np.ndarray:
        """The codes of each chunk's letters and symbols, or of the chunk and of nothing."""
        found = list(map(_WORD.fullmatch, chunks))
        heads = [m[1] if m else c for m, c in zip(found, chunks)]
        tails = [m[2] if m else "" for m in found]
        if len(self.known) > _CACHE:
            self._reset()
        new = list({c for c in chain(heads, tails) if c not in self.known})
        if new:
            self._learn(new)
        code = self.known.__getitem__
        return np.stack([np.fromiter(map(code, heads), np.int64, len(heads)), np.fromiter(map(code, tails), np.int64, len(tails))], axis=1)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        joined = _MARK.join(["", *texts, ""])
        if _PLAIN.fullmatch(joined, 1) and "<|" not in joined and joined.count("\x01") == len(texts) + 1:
            flat = [None if c == "\x01" else c for c in joined.lower().split()]
        else:
            flat = [None]
            for t in texts:
                whole = _ODD.search(t) or "\x01" in t
                # What white space does not divide safely is one part.
                flat += [t] if whole else t.split()
                flat.append(None)
        held = np.empty(len(flat), dtype=object)
        held[:] = flat
        codes, unique = pd.factorize(held)  # -1 for the marks between texts
        parts = np.concatenate([self._parts(list(unique)), [[0, 0]]])
        own = parts[codes].ravel()
        lengths = self.lengths[own]
        ids = _gather(self.pool, self.starts[own], lengths)
        ends = np.cumsum(lengths)[1::2][codes < 0]
        return [ids[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]


_ENCODERS: dict[str, WordEncoder] = {}
_IDLE_S = 10.0
_clearing: list[threading.Timer] = []


def encoder_for(path: str) -> WordEncoder:
    """One encoder for each Python worker and vocabulary, so that tasks share what it knows."""
    while _clearing:
        _clearing.pop().cancel()
    if path not in _ENCODERS:
        # A task has one core; the library's own threads would only wait for it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def forget_when_idle(path: str) -> None:
    """Gives the encoder's memory back once the worker has packed nothing for a while."""
    timer = threading.Timer(_IDLE_S, _ENCODERS.pop, (path, None))
    timer.daemon = True
    _clearing.append(timer)
    timer.start()


def _slices(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list[str]]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < _SLICE):
            size += len(texts[end] or "")
            end += 1
        yield ids[at:end], [t or "" for t in texts[at:end]]
        at = end


class Packer:
    """The open windows of one task. Pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, base: int):
        self.windows: list[tuple[int, list]] = []  # (tokens, pieces)
        self.next = base
        self.closed: list[tuple] = []

    def close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.closed.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= SIZE:
            self.close([(doc, start, ids[:SIZE], total)])
            start, ids = start + SIZE, ids[SIZE:]
        while len(ids):
            n = len(ids)
            fit = max((w for w in range(len(self.windows)) if self.windows[w][0] + n <= SIZE), key=lambda w: self.windows[w][0], default=None)
            if fit is None and len(self.windows) >= OPEN:
                full = max(range(len(self.windows)), key=lambda w: self.windows[w][0])
                held, pieces = self.windows.pop(full)
                gap = SIZE - held
                if gap >= GAP:
                    pieces.append((doc, start, ids[:gap], total))
                    start, ids = start + gap, ids[gap:]
                self.close(pieces)
                continue
            if fit is None:
                self.windows.append((n, [(doc, start, ids, total)]))
            else:
                held, pieces = self.windows[fit]
                pieces.append((doc, start, ids, total))
                if held + n == SIZE:
                    self.windows.pop(fit)
                    self.close(pieces)
                else:
                    self.windows[fit] = (held + n, pieces)
            return

    def finish(self) -> None:
        """Fill up what is open; cut the last window at powers of two."""
        items = [p for _, pieces in sorted(self.windows, key=lambda w: -w[0]) for p in pieces]
        self.windows, room, row = [], SIZE, []
        rest = sum(len(p[2]) for p in items)
        if rest < SIZE:
            room = 1 << rest.bit_length() - 1 if rest else SIZE
        for doc, start, ids, total in items:
            while len(ids):
                k = min(room, len(ids))
                row.append((doc, start, ids[:k], total))
                start, ids, room, rest = start + k, ids[k:], room - k, rest - k
                if not room:
                    self.close(row)
                    row = []
                    room = SIZE if rest >= SIZE else 1 << max(rest.bit_length() - 1, 0)

    def batch(self, part: int, with_open: bool) -> pa.RecordBatch:
        rows = [(*r, None, None) for r in self.closed]
        self.closed = []
        if with_open:
            rows += [(d, s, len(i), None, t, w, None, part, i.astype("<u4").tobytes()) for w, (_, pieces) in enumerate(self.windows) for d, s, i, t in pieces]
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
        columns = list(zip(*rows)) if rows else [()] * 9
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"])


def _pack(path: str | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        file = path or public_tokenizers.path("word_bpe_49k.json")
        encoder = encoder_for(file)
        part = TaskContext.get().partitionId()
        packer = Packer(part << 32)
        for batch in batches:
            for docs, texts in _slices(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for doc, ids in zip(docs, encoder.encode(texts)):
                    packer.add(doc, 0, np.append(ids, np.uint32(END_ID)), len(ids) + 1)
                if len(packer.closed) > 5000:
                    yield packer.batch(part, False)
        forget_when_idle(file)
        yield packer.batch(part, True)

    return rows


def _merge(level: int, last: bool):
    def rows(key, data):
        packer = Packer((1 << 62) + (level << 56) + (key[0].as_py() << 32))
        data = data.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        columns = [data.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")]
        for doc, start, ids, total in zip(*columns):
            packer.add(doc, start, np.frombuffer(ids, "<u4"), total)
        if last:
            packer.finish()
        return pa.Table.from_batches([packer.batch(key[0].as_py(), True)])

    return rows


@contained
def pack(documents: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A null or empty text is the end id alone. A null id is kept as it is; repeated rows are
    packed as often as they come. An empty table gives no pieces. Other columns are ignored.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = docs.rdd.getNumPartitions()
    now = stored(docs.mapInArrow(_pack(tokenizer_path), PIECES), "pieces")
    done = now.where("part is null")
    level = 0
    while True:
        level += 1
        last = parts <= FAN
        merged = now.where("part is not null").withColumn("to", F.floor(F.col("part") / FAN).cast("int")).groupBy("to").applyInArrow(_merge(level, last), PIECES)
        now = stored(merged, "pieces", 16)
        done = done.union(now.where("part is null"))
        parts = -(-parts // FAN)
        if last:
            break
    return done.drop("part", "ids")
