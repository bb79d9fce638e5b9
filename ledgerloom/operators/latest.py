"""The latest view of a change log, kept up to date: only buckets that changes touch are rewritten.

What a key's changes say so far is a state that merges: the newest insert or deletion, the
newest version, and for each column its newest value with the version. So a batch of
changes, also one with late or repeated versions, is summed up, joined to the states of its
buckets by one more grouping, and the view is the same as that of the whole log.

Buckets are folders. A batch writes its buckets aside and then one small file that says where
each bucket is and which batch was the last; a batch that runs again finds itself there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
_STATE = "state-"


def _payload(columns: list[str], key: str) -> list[str]:
    return [c for c in columns if c not in (key, "version", "op")]


def state_of(changes: DataFrame, key: str) -> DataFrame:
    """(key, born, version, columns): what the changes (key, version, op, columns) say of each key.

    Every column is (version, value) of its newest value; born is (version, op) of the newest insert or deletion.
    """
    newest = lambda c: F.max_by(F.struct("version", F.col(c).alias("value")), F.when(F.col(c).isNotNull(), F.col("version"))).alias(c)
    born = F.max(F.when(F.col("op") != "U", F.struct("version", "op"))).alias("born")
    return changes.groupBy(key).agg(born, F.max("version").alias("version"), *[newest(c) for c in _payload(changes.columns, key)])


def merged_states(states: DataFrame, key: str) -> DataFrame:
    columns = [c for c in states.columns if c not in (key, "born", "version")]
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(f"{c}.version"))).alias(c)
    return states.groupBy(key).agg(F.max("born").alias("born"), F.max("version").alias("version"), *[newest(c) for c in columns])


def view_of(states: DataFrame, key: str) -> DataFrame:
    """The rows that are there: inserted and not deleted since, with the values since then."""
    columns = [c for c in states.columns if c not in (key, "born", "version")]
    value = lambda c: F.when(F.col(f"{c}.version") >= F.col("born.version"), F.col(f"{c}.value")).alias(c)
    return states.where("born.op = 'I'").select(key, "version", *[value(c) for c in columns])


class LatestTable:
    """States by bucket under a folder. One writer at a time; readers see whole batches."""

    def __init__(self, spark: SparkSession, folder: str, kind: T.StructType, key: str, buckets: int = BUCKETS) -> None:
        """kind: the schema of the changes, with key, version (long) and op."""
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.kind = state_of(spark.createDataFrame([], kind), key).schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _state(self) -> dict:
        """{number, batch, buckets: {bucket: folder}} of the last batch."""
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self.folder))] if self._files.exists(self._path(self.folder)) else []
        last = max((n for n in names if n.startswith(_STATE)), default=None)
        if last is None:
            return {"number": 0, "batch": -1, "buckets": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/{last}", wholetext=True).first()["value"])

    def _say(self, state: dict) -> None:
        aside, name = self._path(f"{self.folder}/_aside-{uuid.uuid4().hex}"), self._path(f"{self.folder}/{_STATE}{state['number']:012d}")
        out = self._files.create(aside)
        out.write(json.dumps(state).encode())
        out.close()
        if not self._files.rename(aside, name):
            raise RuntimeError(f"{name} is there already: another writer was at work")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _read(self, state: dict, buckets: set[int] | None = None) -> DataFrame:
        paths = [p for k, p in state["buckets"].items() if buckets is None or int(k) in buckets]
        return self.spark.read.schema(self.kind).parquet(*[f"{self.folder}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], self.kind)

    def apply(self, changes: DataFrame, batch: int) -> bool:
        """Takes a batch of changes in. Batches have growing numbers; one that was taken before is left alone."""
        state = self._state()
        if batch <= state["batch"]:
            return False
        new = state_of(changes, self.key)
        touched = {r["b"] for r in changes.select(self._bucket().alias("b")).distinct().collect()}  # buckets at most
        into = f"batch-{batch}-{uuid.uuid4().hex}"
        both = merged_states(new.unionByName(self._read(state, touched)), self.key)
        both.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{into}")
        places = state["buckets"] | {str(b): f"{into}/bucket={b}" for b in touched}
        self._say({"number": state["number"] + 1, "batch": batch, "buckets": places})
        return True

    def states(self) -> DataFrame:
        return self._read(self._state())

    def view(self) -> DataFrame:
        return view_of(self.states(), self.key)

    def tidy(self) -> None:
        """Deletes what no bucket of the last batch lies in. No reader may be at work on older batches."""
        state = self._state()
        used = {p.split("/")[0] for p in state["buckets"].values()} | {f"{_STATE}{state['number']:012d}"}
        for s in self._files.listStatus(self._path(self.folder)):
            if s.getPath().getName() not in used:
                self._files.delete(s.getPath(), True)


def follow(changes: DataFrame, table: LatestTable, checkpoint: str):
    """A stream of changes into the table, as a writer to start: every micro-batch once."""
    return changes.writeStream.foreachBatch(lambda df, batch: table.apply(df, batch)).option("checkpointLocation", checkpoint)
