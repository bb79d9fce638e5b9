"""Shared plumbing of the training-data operators: the work folder, column hygiene, hashing.

Intermediate results that are read more than once are written as Parquet below the folder
named by ``spark.checkpoint.dir``, which the driver and all executors share, so a lost
executor costs a re-read and never a recomputation of the whole lineage.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDER = "ledgerloom-work"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_ROWS = 2000
HOT_SHARE = 1000
SLOTS = 1 << 25
_BITMAP = 1 << 15  # bits of bitmap_construct_agg

_own: dict[str, str] = {}
_scopes: list[list[DataFrame]] = []  # what the running operators have stored, the innermost last


def work_dir(spark: SparkSession) -> str:
    """The shared folder of this session; a local one only where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="ledgerloom-")
        _own[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{_FOLDER}"


def stored(df: DataFrame, name: str, share: int = 1) -> DataFrame:
    """Write a frame to the shared folder and read it back: a cut in the lineage.

    share: the frame is about so many times smaller than what is shuffled elsewhere, and is
    written in so many times fewer files.
    """
    spark = df.sparkSession
    if share > 1:
        df = df.coalesce(max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // share))
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again.stored_path = path
    if _scopes:
        _scopes[-1].append(again)
    return again


def contained(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that leaves nothing behind but its result.

    The result is stored, all else that was stored on the way is deleted, and the session's
    Arrow batch size, small meanwhile, is put back: texts in a batch are held several times
    over by a Python worker, and 10,000 of them are a lot.
    """
    return _contained(operator, True)


def contained_lazy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """As :func:`contained`, for results with texts: they are not stored, and what they read
    stays. No Python may run in the last step."""
    return _contained(operator, False)


def _contained(operator: Callable[..., DataFrame], store: bool) -> Callable[..., DataFrame]:
    @wraps(operator)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        spark = df.sparkSession
        before = spark.conf.get(_BATCH, "10000")
        spark.conf.set(_BATCH, str(min(int(before), _BATCH_ROWS) if int(before) > 0 else _BATCH_ROWS))
        held: list[DataFrame] = []
        try:
            with leftovers(held):
                result = operator(df, *args, **kwargs)
            if store:
                result = stored(result, operator.__name__)
                discard(*held)
            elif _scopes:
                _scopes[-1].extend(held)
            return result
        finally:
            spark.conf.set(_BATCH, before)

    return run


@contextmanager
def leftovers(into: list[DataFrame]) -> Iterator[None]:
    """Collects the frames that are stored meanwhile."""
    _scopes.append(into)
    try:
        yield
    finally:
        _scopes.pop()


def discard(*frames: DataFrame) -> None:
    """Delete frames made by :func:`stored` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "stored_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where the frame has such a column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_hot(left: DataFrame, right: DataFrame, on: str | list[str], weight: str) -> DataFrame:
    """An inner join with a frame of one row for each key, whose ``weight`` column counts the key's rows on the left.

    Keys with at least 1 / HOT_SHARE of all rows are HOT_SHARE at most, so they are
    broadcast; only the others are shuffled.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT_SHARE >= total
    few, rest = right.where(hot).drop(weight), right.where(~hot).drop(weight)
    return left.join(F.broadcast(few), on).unionByName(left.join(rest, on))


def split_by(rows: DataFrame, few: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose integer key is surely not among the keys of ``few``, and the other rows.

    A bit of ``SLOTS`` is set for each key of few; the bits are broadcast (4 MB), so wide rows
    are split where they are, and only the second part needs a join by key. The more
    keys few has, the more rows are in the second part; which ones never changes a result.
    """
    slot = F.pmod(F.xxhash64(F.col(on).cast("long")), F.lit(SLOTS))
    bucket, place, bits = free_names(rows, "bucket", "place", "bits")
    placed = lambda df: df.withColumns({bucket: F.floor(slot / _BITMAP).cast("int"), place: F.pmod(slot, F.lit(_BITMAP))})
    maps = placed(few.select(on)).repartition(bucket).groupBy(bucket).agg(F.bitmap_construct_agg(place).alias(bits))
    at = placed(rows).join(F.broadcast(maps), bucket, "left")
    byte = F.conv(F.hex(F.expr(f"substring({bits}, cast({place} div 8 + 1 as int), 1)")), 16, 10).cast("int")
    found = F.coalesce(F.bit_get(byte, F.expr(f"cast({place} % 8 as int)")) == 1, F.lit(False))
    return at.where(~found).select(*rows.columns), at.where(found).select(*rows.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def crc_of_id(column: Column) -> Column:
    """crc32 of the decimal text of an id, as an unsigned long."""
    return F.crc32(column.cast("string").cast("binary"))
