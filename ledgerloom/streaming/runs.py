"""Running a stream over what its sources hold now, with its result as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..lineage import shared_folder
from .memories import STATE_STORE

# Counting a store's rows would read each key before it is written or removed.
_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"


def run_now(stream: DataFrame, at: str) -> DataFrame:
    """Everything the sources hold, through the stream, as written to a folder that all executors share.

    The folder also has the checkpoint: another call with it goes on with what is new since.
    State is kept in RocksDB.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, whether it is a file or a folder."""
    kind = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(kind).parquet(f"{sf_dir}/{name}.parque[t]")  # a single file has to be a pattern
