"""Structured Streaming: incremental ingest, progress windows, deduplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tables import discard, exists, materialize, release, scratch

KEY_BUCKETS = 64

#: Keys that a stream remembers lie on the executors' disks, beside so many MB of memory for all of an executor; Spark's own choice holds every key in the heap.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files as a stream, schema taken from what is there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str = "Id", transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append what is new to a Parquet table, batch by batch, until the source is used up.

    A batch skips keys already in the table (so a replayed batch adds nothing)
    and repeats inside the batch.  The table lies in folders by hash of the key:
    a batch reads the keys of the folders it touches, and within them those in
    the range of its own keys.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = transform(batch) if transform else batch
        rows = materialize(rows.dropDuplicates([key]).withColumn("key_bucket", F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")))
        new = rows
        if exists(spark, target):
            span = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.collect_set("key_bucket").alias("b")).first()  # at most KEY_BUCKETS numbers
            held = spark.read.parquet(target).filter(F.col("key_bucket").isin(span["b"]) & F.col(key).between(span["lo"], span["hi"])).select(key)
            new = rows.join(held, key, "left_anti")
        new.repartition("key_bucket").write.mode("append").partitionBy("key_bucket").parquet(target)
        release(rows)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(stream: DataFrame, ts: str, width: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Rows of each window; rows later than ``late`` behind the newest are left out."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width), *keys).count()


def sliding_sums(stream: DataFrame, ts: str, value: str, width: str, step: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width, step), *keys).agg(F.sum(value).alias("total"))


def sessions(stream: DataFrame, ts: str, gap: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).count()


def deduplicated(stream: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and give the result, which the driver holds: for few rows, such as counts of windows."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame) -> DataFrame:
    """Run a stream that only appends over what is there and give the result as a table of any size.

    The executors write its rows to the shared folder, so none pass the driver,
    and keep its state as ``STATE`` says where the session sets nothing else.
    The table is removed as those of :func:`materialize` are.
    """
    spark = stream.sparkSession
    rows, marks = scratch(spark), scratch(spark)
    unset = [k for k in STATE if spark.conf.get(k, None) is None]
    try:
        for k in unset:
            spark.conf.set(k, STATE[k])
        q = stream.writeStream.format("parquet").option("path", rows).option("compression", "zstd").option("checkpointLocation", marks).trigger(availableNow=True).start()
    finally:  # a stream keeps the settings it was started with
        for k in unset:
            spark.conf.unset(k)
    q.awaitTermination()
    discard(marks)
    out = spark.read.schema(stream.schema).parquet(rows)
    out._written_path = rows
    return out
