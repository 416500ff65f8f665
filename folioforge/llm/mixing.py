"""Mixing sources to target weights by weighted fair queueing.

Every copy of every shuffled document gets a virtual finish time: the tokens of
its source up to and including it, divided by the source's weight.  The copies
are range-sorted by finish time and the order is cut where the running total of
tokens reaches the budget.

Running sums are two-level everywhere: over a source (sums of slices of the
shuffle order, then inside a slice), so a source holding a third of all rows is
never one task, and over the sorted order (sums of its ranges, then inside a
range).  A bound on the finish time at which the budget can end follows from one
row a source, so copies far beyond it are not sorted.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tables import materialize, pick, rows_at_most
from .packing import byte_tokens

SLICE_ROWS = 50_000
RANGE_ROWS = 500_000
#: Listed sources of one mixture; more are refused.
MAX_SOURCES = 10_000
SALT = "17"


def source_key(name: str | Column) -> Column:
    """Spelling-free key: case, outer blanks and blank, hyphen or underscore do not matter."""
    c = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s\p{Z}_-]+", "_")


def shuffle_order(doc_id: str | Column) -> Column:
    """A fixed random order of documents: 128 bits of their id, in hexadecimal."""
    return F.md5(F.concat((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(":" + SALT)))


class Mixture:
    """A mixture; nothing but one row for each listed source is held here."""

    def __init__(self, docs: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, budget: int | None = None) -> None:
        self.spark = docs.sparkSession
        named = pick(targets, name="source", weight="weight", max_repeat="max_repeat").filter("name is not null").select("name", source_key("name").alias("k"), "weight", "max_repeat")
        if not rows_at_most(named, MAX_SOURCES):
            raise ValueError(f"more than {MAX_SOURCES} listed sources")
        items = pick(docs, id=id_col, source=source_col, text=text_col).select("id", source_key("source").alias("k"), byte_tokens("text").alias("n_tokens"))
        items = items.filter("id is not null and n_tokens > 0").join(F.broadcast(named.select("k").distinct()), "k", "left_semi")
        self.items = materialize(items.groupBy("id").agg(F.max(F.struct("n_tokens", "k")).alias("m")).select("id", "m.k", "m.n_tokens"))
        sizes = self.items.groupBy("k").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("docs"), F.max("n_tokens").alias("longest"))
        rows = named.join(F.broadcast(sizes), "k", "left").fillna(0, ["size", "docs", "longest"])
        self.rows = [r.asDict() for r in rows.collect()]  # at most MAX_SOURCES
        total = sum(r["size"] for r in self.rows)
        self.budget = total if budget is None else budget

    def _latest(self) -> float:
        """A finish time by which the copies amount to the budget, or all have finished (water filling over the sources' ends).

        At time t a source has given its weight times t, short of at most one document.
        """
        live = [r for r in self.rows if r["size"] and r["weight"] > 0 and r["max_repeat"] > 0]
        ends = sorted((r["max_repeat"] * r["size"] / r["weight"], r["weight"], r["longest"]) for r in live)
        left, now = float(self.budget), 0.0
        active, slack = sum(w for _, w, _ in ends), sum(x for _, _, x in ends)
        for stop, w, longest in ends:
            if active * (stop - now) >= left + slack:
                return now + (left + slack) / active
            left -= active * (stop - now)
            now, active, slack = stop, active - w, slack - longest
        return now

    @cached_property
    def _queue(self) -> DataFrame:
        """Copies within the budget, range-sorted: ``(id, source, copy, n_tokens, finish, at_token)``."""
        kinds = "id long, source string, copy int, n_tokens long, finish double, at_token long"
        live = [r for r in self.rows if r["size"] and r["weight"] > 0 and r["max_repeat"] > 0]
        if not live:
            return self.spark.createDataFrame([], kinds)
        slices = max(1, -(-sum(r["docs"] for r in live) // SLICE_ROWS))
        named = F.broadcast(self.spark.createDataFrame([(r["k"], r["name"], float(r["weight"]), int(r["max_repeat"]), int(r["size"])) for r in live], "k string, source string, weight double, max_repeat int, size long"))
        # slices follow the shuffle order, so sums of slices before give the tokens before
        o = shuffle_order("id")
        shuffled = self.items.withColumn("o", o).withColumn("slice", F.floor(F.conv(F.substring("o", 1, 7), 16, 10).cast("long") * slices / (1 << 28)).cast("int"))
        before = shuffled.groupBy("k", "slice").agg(F.sum("n_tokens").alias("s")).withColumn("before", F.sum("s").over(Window.partitionBy("k").orderBy("slice")) - F.col("s")).drop("s")
        inside = F.sum("n_tokens").over(Window.partitionBy("k", "slice").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, 0))
        placed = shuffled.withColumn("inside", inside).join(before, ["k", "slice"]).join(named, "k").withColumn("upto", F.col("before") + F.col("inside"))
        copies = F.least(F.floor((F.lit(self._latest()) * (1 + 1e-9) * F.col("weight") - F.col("upto")) / F.col("size")) + 1, F.col("max_repeat")).cast("int")
        taken = placed.withColumn("copies", copies).filter("copies > 0").select("*", F.explode(F.expr("sequence(0, copies - 1)")).alias("copy"))
        finish = (F.col("copy") * F.col("size") + F.col("upto")) / F.col("weight")
        order = ["finish", "source", "id", "copy"]
        ranges = max(1, int(self.budget // max(1, sum(r["size"] for r in live) // sum(r["docs"] for r in live)) // RANGE_ROWS) + 1)
        queue = materialize(taken.select("id", "source", "copy", "n_tokens", finish.alias("finish")).repartitionByRange(max(ranges, self.spark.sparkContext.defaultParallelism), *order).withColumn("part", F.spark_partition_id()))
        offset = queue.groupBy("part").agg(F.sum("n_tokens").alias("s")).withColumn("offset", F.sum("s").over(Window.orderBy("part")) - F.col("s")).drop("s")  # one row a range
        upto = F.sum("n_tokens").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        placed = queue.withColumn("at_token", upto).join(F.broadcast(offset), "part").withColumn("at_token", F.col("at_token") + F.col("offset"))
        return placed.filter(F.col("at_token") <= self.budget).select("id", "source", "copy", "n_tokens", "finish", "at_token")

    def documents(self) -> DataFrame:
        """``(id, source, copy, n_tokens, finish, at_token)`` of every copy in the mixture, in order of finish time; ``at_token`` is the running total."""
        return self._queue.orderBy("at_token")

    def shares(self) -> DataFrame:
        """One row a listed source: target and actual share, tokens, passes, and whether the queue gave it its share.

        A source falls short where the queue took every copy of it and that is
        less than its weight of the budget.
        """
        named = self.spark.createDataFrame([(r["name"], float(r["weight"]), int(r["max_repeat"]), int(r["size"]), int(r["docs"])) for r in self.rows], "source string, target_share double, max_repeat int, source_tokens long, source_docs long")
        used = self._queue.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), (F.max("copy") + 1).alias("passes"))
        both = named.join(F.broadcast(used), "source", "left").fillna(0, ["tokens", "passes"])
        total = both.agg(F.sum("tokens").alias("all_tokens"))
        short = (F.col("tokens") >= F.col("max_repeat") * F.col("source_tokens")) & (F.col("tokens") < F.col("target_share") * F.lit(self.budget))
        return both.join(F.broadcast(total)).select("source", "target_share", F.round(F.col("tokens") / F.greatest("all_tokens", F.lit(1)), 6).alias("actual_share"), "tokens", "passes", "max_repeat", "source_tokens", "source_docs", (~short).alias("reachable"))


def mix_sources(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None) -> Mixture:
    """Mixture of ``docs`` after ``targets(source, weight, max_repeat)``.

    ``budget`` (tokens) defaults to the size of all documents of listed sources,
    each once.  Null and empty texts have size 0 and are not mixed; null or
    unlisted sources are left out; of several rows of an id the longest counts
    (ties by source); a listed source without documents has share 0; empty
    tables give an empty mixture; more than :data:`MAX_SOURCES` listed sources
    are refused.
    """
    return Mixture(docs, targets, id_col, text_col, source_col, budget)
