"""Bounded queues over a drained batch, and reading the latest value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import last_known, matched


def bounded(df: DataFrame, keys: list[str], order: list[str], capacity: int = 1, policy: str = "pop") -> DataFrame:
    """The rows that stay in each key's queue of ``capacity``: ``pop`` drops the oldest, ``reject`` the newest.

    ``fault`` keeps what reject keeps and adds ``overflow``, the number of rows its key lost. Spark keeps ``capacity`` rows a
    key and task before the shuffle.
    """
    if policy not in ("pop", "reject", "fault"):
        raise ValueError(f"unknown policy {policy!r}")
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) if policy == "pop" else F.asc(c) for c in order])
    kept = df.withColumn("rank_", F.row_number().over(w)).where(F.col("rank_") <= capacity).drop("rank_")
    if policy != "fault":
        return kept
    counts = df.groupBy(*keys).agg(F.greatest(F.count(F.lit(1)) - capacity, F.lit(0)).alias("overflow"))
    return matched(kept, counts, keys)


def strict(df: DataFrame, keys: list[str], capacity: int) -> DataFrame:
    """The rows as they are; the query fails if a key has more than ``capacity``."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"))
    checked = counts.select(*keys, F.when(F.col("n_") > capacity, F.raise_error(F.lit("queue overflow"))).otherwise(F.lit(True)).alias("fits_"))
    return matched(df, checked, keys).where("fits_").drop("fits_")


def latest_value(consumers: DataFrame, producers: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str) -> DataFrame:
    """Each consumer row with the last producer ``value`` at or before it (``latest``), and whether the row before it read the same (``is_old``).

    ``order`` begins with the time; producers of the same time come first. ``bucket`` is coarser than the time (see ordering).
    """
    cols = [*keys, *order]
    p = producers.select(*cols, F.lit(0).alias("side_"), F.struct(F.struct(*order).alias("at"), F.col(value).alias("value")).alias("got_"))
    c = consumers.select(*cols, F.lit(1).alias("side_"), F.lit(None).cast(p.schema["got_"].dataType).alias("got_"))
    tagged = last_known(p.unionAll(c), keys, [order[0], "side_", *order[1:]], bucket, F.col("got_"), "read_")
    read = tagged.where("side_ = 1")
    # a message was read before if a consumer row lies between it and this one
    firsts = read.where("read_ is not null").groupBy(*keys, F.col("read_.at").alias("at_")).agg(F.min(F.struct(*order)).alias("first_"))
    joined = matched(read.withColumn("at_", F.col("read_.at")), firsts, [*keys, "at_"], "left")
    return joined.select(*cols, F.col("read_.value").alias("latest"), F.coalesce(F.struct(*order) > F.col("first_"), F.lit(False)).alias("is_old"))
