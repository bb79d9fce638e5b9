"""Periodic runs of words, found by block convolution at dyadic scales.

A run is a stretch of consecutive words with smallest period q, at least ``max(LEAST, POWER * q)``
words long, that no neighbouring word extends.

* Scales. A run with a period from B to 2B - 1 keeps its period over 2q words at least, so one of
  the blocks of B words on a fixed grid lies whole in it and comes again q words later. The
  smallest scale, ``BASE``, takes all shorter periods too. A scale looks at those blocks only
  whose words all come again within 2B words, which is necessary and told by one pass over the
  distances to each word's next place.
* Convolution. For such a block, the sums of squared differences with the windows that follow
  are A + Y - 2C: C is a correlation, computed by a number theoretic transform modulo as many
  primes as the largest possible sum needs, so a zero is exactly a window without mismatch.
  Equal blocks with equal surroundings are transformed once.
* Extension. The distance of a zero seeds an extension word by word to both sides. A distance
  that is a multiple of a known run's period inside that run gives that run again and is left out.

Documents of a batch are laid end to end with words of their own each, so no run crosses from
one to the next. Spark deals the documents; a task holds one batch of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import contained

LEAST = 24
POWER = 3
BASE = 8  # with LEAST and POWER as they are, the smallest scale finds all periods below 2 * BASE
PRIMES = ((998244353, 3), (469762049, 3), (167772161, 3))  # each with a primitive root
_SLICE = 1 << 21  # bytes of text laid end to end
_CELLS = 1 << 20  # numbers transformed at once
_FAR = np.iinfo(np.int64).max
_NEAR_RUNS = 8  # known runs before a block that are asked whether they hold it

RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Transform:
    """The number theoretic transform of rows of n numbers modulo a prime."""

    def __init__(self, n: int, prime: int, root: int) -> None:
        self.n, self.prime = n, np.uint64(prime)
        unit = pow(root, (prime - 1) // n, prime)
        self.forward = self._powers(unit, n, prime)
        self.backward = self._powers(pow(unit, -1, prime), n, prime)
        self.share = np.uint64(pow(n, -1, prime))

    @staticmethod
    def _powers(unit: int, n: int, prime: int) -> np.ndarray:
        out = np.ones(max(1, n // 2), np.uint64)
        have = 1
        while have < len(out):  # the second half is the first times a power
            step = np.uint64(pow(unit, have, prime))
            out[have : 2 * have] = out[:have] * step % np.uint64(prime)
            have *= 2
        return out

    def there(self, rows: np.ndarray) -> np.ndarray:
        """Frequencies in the order that :meth:`back` takes; rows become scratch."""
        p, size = self.prime, self.n
        while size > 1:
            part = rows.reshape(len(rows), -1, size)
            low, high = part[..., : size // 2], part[..., size // 2 :]
            less = (low + (p - high)) * self.forward[:: self.n // size] % p
            low[...] = (low + high) % p
            high[...] = less
            size //= 2
        return rows

    def back(self, rows: np.ndarray) -> np.ndarray:
        p, size = self.prime, 2
        while size <= self.n:
            part = rows.reshape(len(rows), -1, size)
            low, high = part[..., : size // 2], part[..., size // 2 :]
            turned = high * self.backward[:: self.n // size] % p
            high[...] = (low + (p - turned)) % p
            low[...] = (low + turned) % p
            size *= 2
        return rows * self.share % p


def _ranks(rows: np.ndarray) -> np.ndarray:
    """The numbers of each row, renamed 0, 1, ... within the row."""
    order = np.argsort(rows, axis=1, kind="stable")
    along = np.take_along_axis(rows, order, 1)
    named = np.zeros_like(rows)
    np.cumsum(along[:, 1:] != along[:, :-1], axis=1, out=named[:, 1:])
    out = np.empty_like(rows)
    np.put_along_axis(out, order, named, 1)
    return out


def matches(rows: np.ndarray, block: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, distance) at which the first ``block`` numbers of a row come again, for distances from least to most - 1.

    Rows have block + most - 1 numbers.
    """
    rows = _ranks(rows)
    top = int(rows.max(initial=0))
    head, window = rows[:, :block], rows[:, least:]
    n = 1 << (window.shape[1] - 1).bit_length()
    squares = np.zeros((len(rows), window.shape[1] + 1), np.int64)
    np.cumsum(window * window, axis=1, out=squares[:, 1:])
    own = (head * head).sum(axis=1, keepdims=True) + squares[:, block:] - squares[:, :-block]
    zero = np.ones(own.shape, bool)
    reach = 1
    for prime, root in PRIMES:
        transform = Transform(n, prime, root)
        a, b = (np.zeros((len(rows), n), np.uint64) for _ in range(2))
        a[:, :block] = head[:, ::-1]
        b[:, : window.shape[1]] = window
        crossed = transform.back(transform.there(a) * transform.there(b) % np.uint64(prime))[:, block - 1 : block - 1 + most - least]
        zero &= (own - 2 * crossed.astype(np.int64)) % prime == 0
        reach *= prime
        if reach > block * top * top:
            break
    row, lag = np.nonzero(zero)
    return row, lag + least


def _next_gaps(words: np.ndarray) -> np.ndarray:
    """The distance from each place to the next with the same word."""
    order = np.argsort(words, kind="stable")
    gaps = np.full(len(words), _FAR)
    same = words[order[1:]] == words[order[:-1]]
    gaps[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gaps


def _stretch(words: np.ndarray, at: int, distance: int) -> tuple[int, int]:
    """The widest stretch about ``at`` in which words that far apart are identical."""
    low, step = at, 64
    while low > 0:
        begin = max(0, low - step)
        odd = np.flatnonzero(words[begin:low] != words[begin + distance : low + distance])
        if len(odd):
            low = begin + int(odd[-1]) + 1
            break
        low, step = begin, 2 * step
    high, step, end = at, 64, len(words) - distance
    while high < end:
        stop = min(end, high + step)
        odd = np.flatnonzero(words[high:stop] != words[high + distance : stop + distance])
        if len(odd):
            high += int(odd[0])
            break
        high, step = stop, 2 * step
    return low, high + distance


class _Found:
    """The runs found so far, by place."""

    def __init__(self) -> None:
        self.period: dict[tuple[int, int], int] = {}
        self._sorted = 0

    def add(self, start: int, end: int, period: int) -> None:
        if end - start >= max(LEAST, POWER * period):
            self.period.setdefault((start, end), period)

    def inside(self, at: np.ndarray, end: np.ndarray, distance: int) -> np.ndarray:
        """Whether a known run, whose period divides the distance, holds all from at to end."""
        if self._sorted != len(self.period):
            self._sorted = len(self.period)
            self._runs = np.array(sorted((s, e, q) for (s, e), q in self.period.items()), np.int64).reshape(-1, 3)
        held = np.zeros(len(at), bool)
        if self._sorted:
            last = np.searchsorted(self._runs[:, 0], at, "right") - 1
            for k in range(min(_NEAR_RUNS, self._sorted)):
                s, e, q = self._runs[np.maximum(last - k, 0)].T
                held |= (last >= k) & (end <= e) & (s <= at) & (distance % q == 0)
        return held


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of a sequence of non-negative numbers, in order."""
    n, found, block = len(words), _Found(), BASE
    if n < LEAST:
        return []
    gaps = _next_gaps(words)
    widest = gaps[: n // block * block].reshape(-1, block).max(axis=1)
    while 3 * block <= n and len(widest):
        least, most = (1, 2 * block) if block == BASE else (block, 2 * block)
        at = np.flatnonzero(widest < most) * block
        if len(at):
            width = block + most - 1
            padded = np.concatenate([words, np.full(width, -1, words.dtype)])
            places, distances = [], []
            for k in range(0, len(at), max(1, _CELLS // width)):
                own = at[k : k + max(1, _CELLS // width)]
                rows = padded[own[:, None] + np.arange(width)]
                first: dict[bytes, int] = {}
                kind = np.array([first.setdefault(r.tobytes(), j) for j, r in enumerate(rows)])
                distinct, kind = np.unique(kind, return_inverse=True)
                row, distance = matches(rows[distinct], block, least, most)
                order = np.argsort(kind, kind="stable")
                low, high = np.searchsorted(kind[order], row), np.searchsorted(kind[order], row, "right")
                count = high - low
                inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                places.append(own[order[np.repeat(low, count) + inner]])
                distances.append(np.repeat(distance, count))
            _extend(words, np.concatenate(places), np.concatenate(distances), block, found)
        even = len(widest) // 2 * 2
        widest, block = np.maximum(widest[0:even:2], widest[1:even:2]), 2 * block
    return sorted((s, e - s, q) for (s, e), q in found.period.items())


def _extend(words: np.ndarray, places: np.ndarray, distances: np.ndarray, block: int, found: _Found) -> None:
    order = np.lexsort((places, distances))
    places, distances = places[order], distances[order]
    cuts = np.flatnonzero(np.diff(distances, prepend=-1, append=-1))
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        distance, at = int(distances[low]), places[low:high]
        at = at[~found.inside(at, at + distance + block, distance)]
        k = 0
        while k < len(at):
            start, end = _stretch(words, int(at[k]), distance)
            found.add(start, end, distance)
            k = int(np.searchsorted(at, max(end - distance, int(at[k]) + 1)))


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word each place takes, where the id asks for it; None for no change."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + np.arange(n - a) % p
    return out


def _row(doc: int | None, words: list[bytes], taken: np.ndarray | None, runs: list[tuple[int, int, int]]) -> tuple:
    kept = words if taken is None else [words[k] for k in taken.tolist()]
    if runs:
        stays = np.ones(len(kept), bool)
        for s, length, q in runs:
            stays[s + q : s + length] = False
        kept = [kept[k] for k in np.flatnonzero(stays).tolist()]
    best = None
    for s, length, q in runs:  # in order of start and period: only more is better
        if best is None or length * best[2] > best[1] * q:
            best = s, length, q
    told = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    places = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return doc, len(runs), *places, sha256(told.encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest()


def _of_documents(ids: list[int | None], split: list[list[bytes]], loop: bool) -> list[tuple]:
    sizes = np.array([len(w) for w in split], np.int64)
    ends = np.cumsum(sizes)
    held = np.empty(int(sizes.sum()), dtype=object)
    held[:] = [w for words in split for w in words]
    codes = pd.factorize(held)[0] if len(held) else np.empty(0, np.int64)
    codes = codes.astype(np.int64) + np.repeat(np.arange(len(split)), sizes) * (codes.max(initial=0) + 1)
    takes = [looped(doc, n) if loop else None for doc, n in zip(ids, sizes.tolist())]
    for k, taken in enumerate(takes):
        if taken is not None:
            begin = int(ends[k] - sizes[k])
            codes[begin : ends[k]] = codes[begin + taken]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
    for s, length, q in find_runs(codes):
        k = int(np.searchsorted(ends, s, "right"))
        runs[k].append((s - int(ends[k] - sizes[k]), length, q))
    return [_row(*x) for x in zip(ids, split, takes, runs)]


def _digests(loop: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
        for batch in batches:
            ids, texts, k = batch.column(0).to_pylist(), batch.column(1), 0
            while k < len(ids):
                split, size, begin = [], 0, k
                while k < len(ids) and size < _SLICE:
                    text = texts[k].as_py() or b""
                    split.append(text.split())
                    size += len(text)
                    k += 1
                out = _of_documents(ids[begin:k], split, loop)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), kind)], schema=kind)

    return rows


@contained
def periodic_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", loop: bool = False) -> DataFrame:
    """Per document its number of runs, its most repeated one, and digests of all runs and of the text without repetitions.

    loop: documents are first rewritten as :func:`looped` says by their ids.
    A null, empty or blank text has no word and no run: four nulls, digests of the empty string.
    A null id is kept as it is and never rewritten; repeated rows give a row each; an empty
    table gives no rows; other columns are ignored. Of runs with the same exponent the first
    counts, then that of the smaller period. Words are compared as they are written.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return docs.mapInArrow(_digests(loop), RESULT)
