"""A mutable store on immutable files: an append-only change log and its latest view.

Every change is a row (key, version, op, payload): op is I for a new row, U for an update, whose
null payload columns keep what was there, and D for a deletion. The latest view of a key
takes, for every column, the newest value since the last insert, and nothing after a D.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ChangeLog:
    """Tables by name under a folder; rows are only ever appended."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, T.StructType]):
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), schemas

    def _schema(self, name: str) -> T.StructType:
        own = self.schemas[name]
        return T.StructType([T.StructField("version", T.LongType()), T.StructField("op", T.StringType()), *own.fields])

    def append(self, name: str, rows: DataFrame, op: str) -> None:
        """Adds rows; columns of the table that they lack are null. ``version`` orders them."""
        out = rows.withColumn("op", F.lit(op))
        have = set(out.columns)
        out = out.select(*[F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in self._schema(name)])
        out.write.mode("append").parquet(f"{self.folder}/{name}")

    def changes(self, name: str) -> DataFrame:
        """All changes. Files written before a column was added read as null there."""
        return self.spark.read.schema(self._schema(name)).option("mergeSchema", "true").parquet(f"{self.folder}/{name}")

    def latest(self, name: str, key: str) -> DataFrame:
        return latest_view(self.changes(name), key)


    def exists(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def compact(self, name: str, key: str) -> None:
        """Replaces the changes by the current rows, each inserted at its last version. Nothing
        else may write to the table meanwhile; frames read before must be read anew."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        new, old = f"{self.folder}/.{name}-{uuid.uuid4().hex}", f"{self.folder}/{name}"
        rows = self.latest(name, key).withColumn("op", F.lit("I"))
        rows.select(*[f.name for f in self._schema(name).fields]).write.parquet(new)
        files = path(old).getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.delete(path(old), True)
        files.rename(path(new), path(old))


def latest_view(changes: DataFrame, key: str) -> DataFrame:
    """The current rows of a change log. Partial maxima only; no window over a key's changes."""
    payload = [c for c in changes.columns if c not in (key, "version", "op")]
    born = changes.where("op != 'U'").groupBy(key).agg(F.max("version").alias("__born"), F.max_by("op", "version").alias("__op"))
    live = changes.join(born, key, "left").where("(__born is null and op = 'U') or (__op = 'I' and version >= __born)")
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("version"))).alias(c)
    return live.where("__born is not null").groupBy(key).agg(*[newest(c) for c in payload], F.max("version").alias("version")).select(*[c for c in changes.columns if c != "op"])


def delete_cascade(parents: DataFrame, children: DataFrame, doomed: DataFrame, key: str, owner: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """(parents, children) without the doomed (key, owner) and their children.

    A parent goes only if the owner matches; children go only with a parent.
    """
    hit = parents.join(doomed.select(key, owner), [key, owner], "left_semi").select(key)
    return parents.join(hit, key, "left_anti"), children.join(hit, key, "left_anti")


def patched(rows: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the non-null values of a patch by key; patches without a row are ignored."""
    values = [c for c in patch.columns if c not in keys]
    renamed = patch.select(*keys, *[F.col(c).alias(f"__{c}") for c in values])
    return rows.join(renamed, keys, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in values else F.col(c) for c in rows.columns])
