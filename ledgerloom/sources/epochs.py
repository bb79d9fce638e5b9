"""Records in a shuffled order that is known without a shuffle, and that any reader can take up again.

The order of an epoch is a formula. Places among all lines are cut into groups of neighbours; a
keyed permutation deals the groups, another the rows of each, so

    position = rows of the groups dealt before + permuted place within the group.

A task therefore reads its positions straight from the byte ranges that hold them: nothing is
sorted or exchanged, a start at (epoch, position) leaves out what comes before without reading
it, and a reader that was lost gives the same rows again. The permutation is a swap-or-not
shuffle: in each round x may change with k - x (mod n), as a hash of the larger of the two
tells. It works for any n, and its inverse takes the rounds from the last to the first.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .jsonl import CLEANED
from .records import MOST_RANGES, MOST_TASKS, RANGE, _filesystem, count_ranges, lines, listed, ranges

NAME = "records_epoch"
LINE = "position long, ord long, value string"
GROUP = 8192
ROUNDS = 24
PRIME = (1 << 31) - 1


@dataclass(frozen=True)
class Token:
    """Where to go on: the next position of an epoch."""

    epoch: int = 0
    position: int = 0


def round_keys(seed: int, epoch: int) -> list[tuple[int, int, int, int, int]]:
    """(shift, step, a, b, c) of each round, from a hash of seed, epoch and round."""
    out = []
    for k in range(ROUNDS):
        d = hashlib.sha256(f"{seed}|{epoch}|{k}".encode()).digest()
        whole = lambda at: int.from_bytes(d[at : at + 8], "little")
        shift, bits = whole(0) >> 3, whole(8)
        out.append((shift, (bits & 0xFFFFFFF) + 1, (bits >> 28) % (PRIME - 1) + 1, whole(16) % PRIME, whole(24) % PRIME))
    return out


def permuted(x: np.ndarray, n: int, keys: list[tuple[int, ...]], lane: int = 0) -> np.ndarray:
    """Places 0 to n - 1 permuted. Lanes of the same keys are permutations of their own."""
    x = np.asarray(x, dtype=np.int64)
    for shift, step, a, b, c in keys:
        own = lane % PRIME * step
        y = ((shift + own) % n + n - x) % n
        u = (np.maximum(x, y) + own + b) % PRIME
        x = np.where((u * u % PRIME * a + c) % PRIME < PRIME // 2, y, x)
    return x


def original(x: np.ndarray, n: int, keys: list[tuple[int, ...]], lane: int = 0) -> np.ndarray:
    """The inverse of :func:`permuted`."""
    return permuted(x, n, keys[::-1], lane)


@dataclass
class Run(InputPartition):
    """Groups dealt to the places first to last - 1."""

    first: int
    last: int


class EpochReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        number = lambda name, default: int(options.get(name, default))
        self.path, self.size, self.group = options["path"], number("range", RANGE), number("group", GROUP)
        self.keys = round_keys(number("seed", 0), number("epoch", 0))
        self.shard, self.shards = number("shard", 0), number("shards", 1)
        self.files, self.counts = listed(self.path), json.loads(options["counts"])
        self.before = [0, *accumulate(self.counts)]
        self.n = self.before[-1]
        self.groups = -(-self.n // self.group)
        self.short = self.groups * self.group - self.n  # what the last group lacks
        self.last = int(permuted(self.groups - 1, self.groups, self.keys)) if self.short else 0  # the place it is dealt to
        self.low, self.high = number("start", 0), min(self.n, number("stop", self.n))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on position leave out groups; Spark still tests every row."""
        for f in filters:
            if getattr(f, "attribute", None) == ("position",):
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            yield f

    def begin(self, place: int) -> int:
        """The first position of the group dealt to a place."""
        short = self.short and place > self.last
        return place * self.group - (self.short if short else 0)

    def partitions(self) -> list[Run]:
        """Runs of one group, longer ones where that would be more than MOST_TASKS or MOST_RANGES."""
        step = self.groups // min(MOST_TASKS, MOST_RANGES) + 1
        out = [Run(k, min(k + step, self.groups)) for k in range(0, self.groups, step)] if self.low < self.high else []
        out = [r for r in out if self.begin(r.first) < self.high and self.low < self.begin(r.last) and (step > 1 or r.first % self.shards == self.shard)]
        return out or [Run(0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        """One group at a time is held, in the order of positions."""
        system, _ = _filesystem(self.path)
        parts = ranges(self.files, self.size)
        for place in range(partition.first, partition.last):
            begin = self.begin(place)
            g = int(original(place, self.groups, self.keys))
            first = g * self.group
            n = min(self.group, self.n - first)
            if place % self.shards != self.shard or begin >= self.high or begin + n <= self.low:
                continue
            held, k = [], bisect_right(self.before, first) - 1
            while len(held) < n:
                held += [v for _, v in islice(lines(system, parts[k]), max(0, first - self.before[k]), first + n - self.before[k])]
                k += 1
            order = original(np.arange(max(0, self.low - begin), min(n, self.high - begin)), n, self.keys, g + 1)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(max(begin, self.low), min(begin + n, self.high))), pa.array(first + order),
                pa.array([held[j].decode("utf-8", "replace") for j in order], pa.string())], ["position", "ord", "value"])


class Epochs(DataSource):
    """Options: path, range, counts as for records; seed, epoch, group; start and stop, positions; shard, shards."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LINE

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return EpochReader(dict(self.options))


class EpochOrder:
    """Records of a file or folder in the order of their epochs, taken up at any token.

    seed and group (rows dealt together, held by a task) belong to the order: other values give
    another one. size, the bytes of a range, does not. Blank lines do not count, and a line that is
    no JSON gives nulls. The files must not change meanwhile. Lines are counted once.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType = CLEANED, seed: int = 0, group: int = GROUP, size: int = RANGE) -> None:
        self.spark, self.path, self.schema, self.seed, self.group, self.size = spark, path, schema, seed, group, size
        spark.dataSource.register(Epochs)
        self.counts = count_ranges(spark, path, size)
        self.n = sum(self.counts)

    def lines(self, epoch: int, start: int = 0, stop: int | None = None, shard: int = 0, shards: int = 1) -> DataFrame:
        """(position, ord, value) of an epoch's positions, in their order over partitions and rows.

        Shards take every shards-th group; together they give all rows, each once.
        """
        options = {
            "path": self.path, "range": self.size, "counts": json.dumps(self.counts), "seed": self.seed, "epoch": epoch, "group": self.group, "start": start,
            "stop": self.n if stop is None else stop, "shard": shard, "shards": shards}
        return self.spark.read.format(NAME).options(**options).load()

    def take(self, token: Token, rows: int | None = None, shard: int = 0, shards: int = 1) -> tuple[DataFrame, Token]:
        """The next rows of the token's epoch (all that are left, without a number), and where to go on.

        A take ends with its epoch. Without any record it is empty, and the token stays.
        """
        stop = self.n if rows is None else min(self.n, token.position + rows)
        out = self.lines(token.epoch, token.position, stop, shard, shards).select("position", "ord", F.from_json("value", self.schema).alias("r"))
        after = Token(token.epoch, stop) if stop < self.n or not self.n else Token(token.epoch + 1, 0)
        return out.select("position", "ord", "r.*"), after
