"""Joins and groups with hot keys, for the engine's own operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000


def join_counted(left: DataFrame, right: DataFrame, on: str, weight: str, how: str = "inner") -> DataFrame:
    """A join with a frame of one row for each key, whose ``weight`` counts the key's rows on the left.

    Keys with a share of 1 / HOT_SHARE of all rows are HOT_SHARE at most: they are broadcast,
    and only the rows of the others are shuffled. Inner and left joins alone.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT_SHARE >= total
    few, rest = F.broadcast(right.where(hot).drop(weight)), right.where(~hot).drop(weight)
    if how == "inner":
        return left.join(few, on).unionByName(left.join(rest, on))
    found = left.join(few, on).unionByName(left.join(few.select(on), on, "left_anti").join(rest, on, "left"))
    return found


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[list]]]:
    """(key, columns) for each run of rows with the same first column, over the batches of a sorted partition."""
    key, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        n, at = batch.num_rows, 0
        while at < n:
            here, end = columns[0][at], at + 1
            while end < n and columns[0][end] == here:
                end += 1
            part = [c[at:end] for c in columns[1:]]
            if held is not None and here == key:
                for own, more in zip(held, part):
                    own.extend(more)
            else:
                if held is not None:
                    yield key, held
                key, held = here, part
            at = end
    if held is not None:
        yield key, held
