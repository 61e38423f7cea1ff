"""Incremental ingest of variant files.

Files that arrive in a folder are read once, typed, freed of duplicates and
appended to the variant table.  The stream's own checkpoint remembers which
files were read, and its state store which keys were stored; so a batch reads and
writes its own rows only, however much is stored already.  A batch that is run again
after a failure overwrites its own folder, so nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.operators.ordering import shuffles_dropped
from varloom.roles import VARIANT_FILE_SCHEMA, col
from varloom.sources.delimited import typed_positions


def variant_stream(
    spark: SparkSession, folder: str, schema: T.StructType = VARIANT_FILE_SCHEMA, sep: str = "\t",
    files_per_batch: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("sep", sep).option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return typed_positions(reader.csv(folder))


#: Keeps the keys of all stored rows on disk, not in memory, logs a batch's changes only, and keeps the versions
#: that a retry may need: the last batch and the one before.  Counting the keys would look each one up once more
#: as it is written; preallocated files would take more disk than what is in them.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}


def first_seen(stream: DataFrame, key: Sequence[str]) -> DataFrame:
    """Of the rows with one key the smallest one of the first batch that had any.

    A streaming aggregate holds, for each key, the least of (time of the batch, row).  In
    update mode a batch emits the keys it has rows of; those whose least row is of this
    batch's time are new, and all others were emitted before.  The time of a batch is in
    the checkpoint, so a batch that is run again finds the same rows.
    """
    now = F.current_timestamp()
    rest = [col(c) for c in stream.columns if c not in key]
    least = F.min(F.struct("_at", *rest)).alias("_row")
    fresh = stream.withColumn("_at", now).groupBy(*[col(k) for k in key]).agg(least).filter(F.col("_row._at") == now)
    return fresh.select(*[col(c) if c in key else F.col(f"_row.`{c}`") for c in stream.columns])


def ingest_available(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    key: Sequence[str] = ("table_name", "variant_id"),
    partition_by: Sequence[str] = ("table_name",),
) -> None:
    """Append everything that has arrived and stop.

    Rows whose key was stored by an earlier batch or run are left out by the state in
    ``checkpoint``, which belongs to ``target``; the batch folder is the unit of retry.  A
    batch's shuffle files go when it is written.
    """
    spark = stream.sparkSession

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{target}/batch={batch_id}")

    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        with shuffles_dropped(spark):
            query = (
                first_seen(stream, key).writeStream.outputMode("update").foreachBatch(write_batch)
                .option("checkpointLocation", checkpoint)
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def ingested(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The table written by :func:`ingest_available`."""
    out_schema = T.StructType([T.StructField("batch", T.LongType()), *schema.fields])
    return spark.read.schema(out_schema).parquet(target).drop("batch")
