"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import materialize, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node of the component each node belongs to: ``(node, component)``.

    ``edges`` holds one row per link; direction, repeats, self-links and nulls
    do not matter, and an empty table gives an empty result.  Every round joins
    each node to the least node of its neighbourhood (large star, then small
    star), so a chain of n links takes O(log n) rounds and a hub sends each
    neighbour one row, never all pairs.  The links live in a written table; only
    one sum leaves the cluster per round.
    """
    e = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = materialize(e)
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    while True:  # ends when a round changes no link
        # large star: neighbours above a node are linked to the least of its neighbourhood
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # small star: a node and its lower neighbours are linked to the least of them
        e2 = large.distinct()
        low = e2.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            e2.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s"))
            .select("s.u", "s.v")
            .filter("u <> v")
            .distinct()
        )
        old, e = e, materialize(small)
        release(old)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    nodes = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))
