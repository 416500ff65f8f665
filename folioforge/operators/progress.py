"""Progress of builds: windows, rates, moving averages, remaining time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windowed(reports: DataFrame, ts: str, width: str = "2 seconds", *keys: str) -> DataFrame:
    """Reports in time windows, combined per partition before the shuffle."""
    return reports.groupBy(F.window(ts, width).alias("w"), *keys)


def deltas(reports: DataFrame, by: list[str], ts: str, total: str) -> DataFrame:
    """Seconds and rows since the report before: ``dt``, ``dc`` (null on the first)."""
    w = Window.partitionBy(*by).orderBy(ts, total)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    return reports.withColumn("dt", seconds - F.lag(seconds).over(w)).withColumn("dc", F.col(total) - F.lag(total).over(w))


def moving_average(values: Column, alpha: float) -> Column:
    """Exponential moving average over an ordered array; the first value starts it."""
    first = F.element_at(values, 1)
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), first.cast("double"), lambda s, x: s * (1 - alpha) + x * alpha)


def latest_per_worker(reports: DataFrame, worker: list[str], ts: str) -> DataFrame:
    order = F.struct(ts, "logged_at") if "logged_at" in reports.columns else F.col(ts)
    return reports.groupBy(*worker).agg(F.max_by(F.struct(*[c for c in reports.columns if c not in worker]), order).alias("r")).select(*worker, "r.*")


def overall(latest: DataFrame, *by: str) -> DataFrame:
    """Sums over workers: done, total, rate, and remaining seconds from the cumulative rates."""
    done = F.coalesce("docs", F.lit(0)) + F.coalesce("empty", F.lit(0)) + F.coalesce("failed", F.lit(0)) + F.coalesce("skipped", F.lit(0)) + F.coalesce("repaired", F.lit(0))
    rate = F.when(F.col("elapsed") > 0, done / F.col("elapsed")).otherwise(F.lit(0.0))
    left = F.greatest(F.coalesce("total", done) - done, F.lit(0))
    return latest.groupBy(*by).agg(
        F.sum(done).alias("done"),
        F.sum(F.coalesce("total", done)).alias("expected"),
        F.sum(rate).alias("rate"),
        F.when(F.sum(rate) > 0, F.sum(left) / F.sum(rate)).alias("eta"),
        F.max("elapsed").alias("elapsed"),
        ((F.max("elapsed") < 120) | (F.sum(done) < 0.005 * F.sum(F.coalesce("total", done)))).alias("warming_up"),
    )
