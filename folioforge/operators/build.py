"""Building and updating document tables: sources, resume, repair, upsert, counters, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def prepare_target(spark: SparkSession, name: str, on_existing: str, model: str | None = None, held_model: str | None = None) -> bool:
    """Whether to build: "keep" leaves a filled table alone, "drop" starts over, "resume" goes on with the same model."""
    if on_existing not in ("keep", "drop", "resume"):
        raise ValueError("on_existing must be keep, drop or resume")
    if not table_exists(spark, name):
        return True
    if on_existing == "drop":
        spark.sql(f"DROP TABLE {name}")
        return True
    if on_existing == "resume" and model is not None and held_model is not None and model != held_model:
        raise ValueError(f"table {name} holds vectors of model {held_model!r}, not {model!r}")
    return on_existing == "resume"


def resolve_source(spark: SparkSession, sibling: str | None, dump: str | None):
    """The sibling table if it exists, else the dump, else an error."""
    if sibling and table_exists(spark, sibling):
        return "table", spark.table(sibling).select("Id", "Title", "Doc")
    if dump:
        from ..sources.mediawiki import read_pages, read_siteinfo, render_articles

        return "dump", render_articles(read_pages(spark, dump), read_siteinfo(spark, dump)).filter("error is null").select("Id", "Title", "Doc")
    raise FileNotFoundError("neither a sibling table nor a dump to build from")


def pending(source: DataFrame, done: DataFrame, key: str = "Id", filled: str = "Vec") -> DataFrame:
    """Source rows without a filled row in ``done``; only the key column of ``done`` is read beside the filter."""
    return source.join(done.filter(F.col(filled).isNotNull()).select(key).distinct(), key, "left_anti")


def actions(source: DataFrame, target: DataFrame, key: str = "Id", text: str = "Doc", filled: str = "Vec") -> DataFrame:
    """What a resumed build does with each source row: ``skipped``, ``repair``, ``empty`` or ``insert``.

    A row without text that is there already, without vector, is ``skipped``:
    there is nothing to repair.
    """
    held = target.groupBy(key).agg(F.max(F.col(filled).isNotNull()).alias("_filled"))
    joined = source.join(held, key, "left")
    blank = F.col(text).isNull() | (F.length(F.trim(text)) == 0)
    act = (
        F.when(F.col("_filled"), "skipped")
        .when(F.col("_filled").isNotNull() & blank, "skipped")
        .when(F.col("_filled").isNotNull(), "repair")
        .when(blank, "empty")
        .otherwise("insert")
    )
    return joined.withColumn("action", act).drop("_filled")


def upsert(base: DataFrame, changes: DataFrame, key: str = "Id") -> DataFrame:
    """Rows of ``changes`` replace those of ``base`` with their key; both keep one pass each."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def write_bucketed(rows: DataFrame, table: str, key: str = "Id", buckets: int = 64) -> None:
    """A new table in folders by hash of the key (column ``key_bucket``, the last), so that an update touches few of them."""
    rows.withColumn("key_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition("key_bucket").write.partitionBy("key_bucket").saveAsTable(table)


def update_bucketed(spark: SparkSession, table: str, changes: DataFrame, key: str = "Id", buckets: int = 64) -> int:
    """Put ``changes`` in place of the rows with their keys; only the folders they fall in are read and written.  Returns their number."""
    from .tables import materialize, release

    new = materialize(changes.withColumn("key_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    touched = [r["key_bucket"] for r in new.select("key_bucket").distinct().collect()]  # at most ``buckets``
    if touched:
        held = spark.table(table).filter(F.col("key_bucket").isin(touched))
        image = materialize(upsert(held, new.select(held.columns), key))
        mode = "spark.sql.sources.partitionOverwriteMode"
        former = spark.conf.get(mode)
        spark.conf.set(mode, "dynamic")  # else the folders without changes would go
        try:
            image.repartition("key_bucket").write.mode("overwrite").insertInto(table)
        finally:
            spark.conf.set(mode, former)
        release(image)
    release(new)
    return len(touched)


def counters(acted: DataFrame) -> DataFrame:
    """Rows of each action, counted per partition first."""
    return acted.groupBy("action").agg(F.count("*").alias("rows"))


def slices(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """Row's slice in an exact division into ``n`` runs of ``ceil(total / n)`` rows, the last ones possibly empty.

    A global place needs sizes of the range partitions first; they are one row a
    partition, so the places come from sums and no task holds all rows.
    """
    parts = rows.repartitionByRange(max(1, n), *order).withColumn("_p", F.spark_partition_id())
    inside = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = inside.groupBy("_p").agg(F.count("*").alias("_c"))
    offset = sizes.withColumn("_o", F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_o", F.lit(0)).alias("_o"))
    total = sizes.agg(F.sum("_c").alias("_t"))
    placed = inside.join(F.broadcast(offset), "_p").crossJoin(F.broadcast(total))
    width = F.ceil(F.col("_t") / n)
    return placed.withColumn("slice", F.floor((F.col("_o") + F.col("_i") - 1) / width).cast("int")).drop("_p", "_i", "_o", "_t")


def last_written(rows: DataFrame, keys: list[str], *newest: Column | str) -> DataFrame:
    """One row a key: the first by ``newest``."""
    w = Window.partitionBy(*keys).orderBy(*newest)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def follow(moves: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """``(source, final, hops)``: the end of each chain of redirects, however long; what runs into a cycle is left out.

    Every round doubles the hops of all open rows, so a chain of n links takes
    about log2(n) rounds; what is open after that many rounds of all links is in
    a cycle or leads to one.  Of several targets of a source the smallest counts.
    """
    from .tables import materialize, release

    edges = moves.select(F.col(source).alias("source"), F.col(target).alias("target")).filter("source <> target").groupBy("source").agg(F.min("target").alias("target"))
    edges = materialize(edges)
    ends = edges.select(F.col("source").alias("target"), F.lit(True).alias("goes_on"))
    at = materialize(edges.join(ends, "target", "left").select("source", F.col("target").alias("at"), F.lit(1).cast("long").alias("hops"), F.col("goes_on").isNull().alias("done")))
    for _ in range(max(1, edges.count()).bit_length() + 1):
        if at.filter("not done").isEmpty():
            break
        step = at.select(F.col("source").alias("at"), F.col("at").alias("then"), F.col("hops").alias("more"), F.col("done").alias("ended"))
        moved = at.filter("not done").join(step, "at").select("source", F.col("then").alias("at"), (F.col("hops") + F.col("more")).alias("hops"), F.col("ended").alias("done"))
        former, at = at, materialize(at.filter("done").unionByName(moved))
        release(former)
    return at.filter("done").select("source", F.col("at").alias("final"), "hops")
