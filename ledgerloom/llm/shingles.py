"""Word shingles as 64-bit hashes, computed in numpy over whole texts.

A word is a run of characters other than space and U+0009..U+000D, with A-Z lower-cased;
both are exactly what ``bytes.lower`` and ``bytes.split`` do on UTF-8. A shingle's hash is
a polynomial over its words' 64-bit hashes, so two different shingles agree with
probability 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash

from .work import mix64

WIDTH = 5
_STEP = np.uint64(0x9FB21C651E98DF25)
_OTHER = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 21  # bytes of text hashed at once


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def _word_hashes(flat: list[bytes]) -> np.ndarray:
    held = np.empty(len(flat), dtype=object)
    held[:] = flat
    codes, unique = pd.factorize(held)
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in unique), dtype=np.uint64, count=len(unique))[codes]


def _windows(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    acc = h[:n].copy()
    for k in range(1, width):
        acc *= _STEP
        acc += h[k : k + n]
    return acc


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty for null or blank texts.

    A text of fewer words than ``width`` has its whole word sequence as its only shingle.
    """
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size < _CHUNK):
            part.append(words_of(texts[at]))
            size += len(texts[at] or "")
            at += 1
        counts = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        ends = np.cumsum(counts)
        flat = [w for words in part for w in words]
        if not flat:
            yield from (np.empty(0, np.uint64) for _ in part)
            continue
        h = _word_hashes(flat)
        spread = mix64(_windows(h, width) + np.uint64(width)) if len(h) >= width else np.empty(0, np.uint64)
        for n, end in zip(counts.tolist(), ends.tolist()):
            if n == 0:
                yield np.empty(0, np.uint64)
            elif n < width:
                yield mix64(_windows(h[end - n : end], n) + np.uint64(n))
            else:
                yield np.unique(spread[end - n : end - width + 1])


def fingerprint(shingles: np.ndarray) -> int:
    """A fingerprint of 63 bits of a set, as a signed long; 0 for the empty set only."""
    return _sum(shingles, _STEP)


def second_fingerprint(shingles: np.ndarray) -> int:
    """Another one, independent of the first: both together have 126 bits."""
    return _sum(shingles, _OTHER)


def _sum(shingles: np.ndarray, step: np.uint64) -> int:
    if not len(shingles):
        return 0
    total = np.uint64(len(shingles)) + np.add.reduce(mix64(shingles ^ step))
    return int(np.array([total | np.uint64(1)], dtype=np.uint64).view(np.int64)[0])
