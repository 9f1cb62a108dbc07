"""Connected components over an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, staged


def _stars(edges: DataFrame, both_ways: bool, n: int) -> DataFrame:
    """One step: each node hands its neighbours (large star: the greater ones; small star: the smaller ones) to the least of them.

    ``n``: the rows of ``edges``. A node with more edges than a task should have is a hub. There are fewer hubs than shuffle partitions, so they are
    broadcast, and their edges stay where they are.
    """
    if both_ways:
        edges, n = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * n
    hub = max(64, n // partitions(edges.sparkSession))
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hubs = F.broadcast(least.where(F.col("n") > hub).select("u", F.col("m").alias("hub")))
    near = edges.join(hubs, "u", "left")
    met = near.where("hub is null").join(least.where(F.col("n") <= hub).select("u", "m"), "u").select("u", "v", "m")
    met = met.unionAll(near.where("hub is not null").select("u", "v", F.col("hub").alias("m")))
    if both_ways:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable, for every node that an edge between different nodes meets.

    Edges with a null end are left out; repeated and reversed edges count once; no edges give no rows. Nothing but counts
    reaches the driver; each round ends in a table in the shared folder. Rounds go on until nothing changes, which takes about
    log2(nodes) of them.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    now = staged(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), "edges")
    n, mark = now.count(), None
    while True:
        large = staged(_stars(now, True, n).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "large-stars")
        now = staged(_stars(large, False, n), "stars")
        n, *rest = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("cast(pmod(xxhash64(v, u), 1000003) as long)"))).first()
        if (n, *rest) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
        mark = (n, *rest)
