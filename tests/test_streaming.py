import threading

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from folioforge.operators.tables import exists, release
from folioforge.plans.catalog import QUERIES
from folioforge.streaming import ingest


def test_deduplicated_rows_stay_off_the_driver(spark, tmp_path):
    """Repeats far apart, in several files, without id or time; the rows lie in files and the keys on disk, not in the driver's or the executors' heap."""
    first = spark.range(0, 4000).selectExpr("if(id % 1000 = 7, null, id) AS event_id", "if(id % 900 = 5, null, timestamp_seconds(1704067200 + id * 60)) AS ts", "'x' AS event_type")
    again = first.filter("event_id % 3 = 0").selectExpr("event_id", "ts + INTERVAL 20 DAYS AS ts", "event_type")
    first.union(again).withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(7).write.parquet(f"{tmp_path}/events.parquet")

    seen, ended = [], threading.Event()

    class Sinks(StreamingQueryListener):
        def onQueryStarted(self, event):  # noqa: N802
            pass

        def onQueryProgress(self, event):  # noqa: N802
            seen.append(event.progress.json)

        def onQueryTerminated(self, event):  # noqa: N802
            ended.set()

    listener = Sinks()
    spark.streams.addListener(listener)
    try:
        got = QUERIES["stream_deduplicated"](spark, str(tmp_path))
        assert ended.wait(60)
    finally:
        spark.streams.removeListener(listener)
    assert [r.n for r in got.collect()] == [3996]
    assert seen and not any("MemorySink" in p for p in seen) and all("rocksdb" in p for p in seen)
    assert all(spark.conf.get(k, None) is None for k in ingest.STATE)


def test_table_of_an_empty_stream(spark, tmp_path):
    spark.range(0).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts").write.parquet(f"{tmp_path}/in")
    out = ingest.run_to_table(ingest.deduplicated(ingest.read_stream(spark, f"{tmp_path}/in"), "ts", ["event_id"]))
    assert out.columns == ["event_id", "ts"] and out.count() == 0
    release(out)
    assert not exists(spark, out._written_path)
