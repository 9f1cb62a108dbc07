"""Order-dependent columns over large groups: numbers, running sums and last known values without one task a key.

Spark's windows put a whole partition key into one task. These helpers take a coarse ``bucket`` besides, any column that never
falls as the order goes on (a day, a range of ids). One summary row a (key, bucket) is made first; a window over these rows says what
came before each bucket; they are joined to the rows, and a window inside (key, bucket) does the rest. Join and window are on the
same struct, so the full rows are shuffled once. A struct with a null field equals another one: null keys are keys like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without time zone (the latter as in UTC sessions)."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def day(ts: str) -> Column:
    return F.floor(micros(ts) / F.lit(DAY_US)).cast("long")


def matched(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``df`` with the other columns of ``other``, joined on equal keys; null equals null."""
    own = other.select(F.struct(*keys).alias("k_"), *[c for c in other.columns if c not in keys])
    return df.withColumn("k_", F.struct(*keys)).join(own, "k_", how).drop("k_")


def _bucketed(df: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    return df.withColumn("k_", F.struct(*keys, bucket.alias("bucket_")))


def _key(keys: list[str]) -> list[Column]:
    return [F.col("k_")[k] for k in keys]


def _before(keys: list[str]):
    return Window.partitionBy(*_key(keys)).orderBy("k_.bucket_").rowsBetween(Window.unboundedPreceding, -1)


def _after(keys: list[str]):
    return Window.partitionBy(*_key(keys)).orderBy("k_.bucket_").rowsBetween(1, Window.unboundedFollowing)


def _inside(order: list[str | Column], first: int, last: int):
    return Window.partitionBy("k_").orderBy(*order).rowsBetween(first, last)


def running_sum(df: DataFrame, keys: list[str], order: list[str | Column], bucket: Column, value: Column, name: str, inclusive: bool = False) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before (``inclusive``: and of) each row of its key, 0 at first."""
    df = _bucketed(df, keys, bucket).withColumn("value_", value)
    totals = df.groupBy("k_").agg(F.sum("value_").alias("sum_")).select("k_", F.coalesce(F.sum("sum_").over(_before(keys)), F.lit(0)).alias("base_"))
    own = F.coalesce(F.sum("value_").over(_inside(order, Window.unboundedPreceding, 0 if inclusive else -1)), F.lit(0))
    return df.join(totals, "k_").withColumn(name, own + F.col("base_")).drop("k_", "base_", "value_")


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], bucket: Column, name: str = "n", total: str | None = None) -> DataFrame:
    """``df`` with each row's number in its key, from 1, and with how many rows its key has, if ``total`` names a column for it."""
    df = _bucketed(df, keys, bucket)
    counts = df.groupBy("k_").agg(F.count(F.lit(1)).alias("count_"))
    all_ = [F.sum("count_").over(Window.partitionBy(*_key(keys))).alias(total)] if total else []
    counts = counts.select("k_", F.coalesce(F.sum("count_").over(_before(keys)), F.lit(0)).alias("base_"), *all_)
    own = F.row_number().over(Window.partitionBy("k_").orderBy(*order))
    return df.join(counts, "k_").withColumn(name, (own + F.col("base_")).cast("long")).drop("k_", "base_")


def highest_before(df: DataFrame, keys: list[str], order: list[str | Column], bucket: Column, value: Column, name: str) -> DataFrame:
    """``df`` with the greatest ``value`` of the rows before each row of its key; null at first."""
    df = _bucketed(df, keys, bucket).withColumn("value_", value)
    tops = df.groupBy("k_").agg(F.max("value_").alias("top_")).select("k_", F.max("top_").over(_before(keys)).alias("base_"))
    own = F.max("value_").over(_inside(order, Window.unboundedPreceding, -1))
    return df.join(tops, "k_").withColumn(name, F.greatest(own, F.col("base_"))).drop("k_", "base_", "value_")


def known(df: DataFrame, keys: list[str], order: list[str | Column], bucket: Column, last: tuple[Column, str] | None = None, next_: tuple[Column, str] | None = None) -> DataFrame:
    """``df`` with the last value that is not null up to each row of its key, and the first one after it: each a (value, name)."""
    df = _bucketed(df, keys, bucket)
    aggs, bases, made = [], [], []
    if last:
        df = df.withColumn("last_", last[0])
        aggs.append(F.max_by("last_", F.when(F.col("last_").isNotNull(), F.struct(*order))).alias("end_"))
        bases.append(F.last("end_", ignorenulls=True).over(_before(keys)).alias("past_"))
        made.append((last[1], F.coalesce(F.last("last_", ignorenulls=True).over(_inside(order, Window.unboundedPreceding, 0)), "past_")))
    if next_:
        df = df.withColumn("next_", next_[0])
        aggs.append(F.min_by("next_", F.when(F.col("next_").isNotNull(), F.struct(*order))).alias("start_"))
        bases.append(F.first("start_", ignorenulls=True).over(_after(keys)).alias("later_"))
        made.append((next_[1], F.coalesce(F.first("next_", ignorenulls=True).over(_inside(order, 1, Window.unboundedFollowing)), "later_")))
    summary = df.groupBy("k_").agg(*aggs).select("k_", *bases)
    return df.join(summary, "k_").withColumns(dict(made)).drop("k_", "last_", "next_", "past_", "later_")


def last_known(df: DataFrame, keys: list[str], order: list[str | Column], bucket: Column, value: Column, name: str) -> DataFrame:
    """``df`` with the last ``value`` that is not null up to each row of its key."""
    return known(df, keys, order, bucket, last=(value, name))


def next_known(df: DataFrame, keys: list[str], order: list[str | Column], bucket: Column, value: Column, name: str) -> DataFrame:
    """``df`` with the first ``value`` that is not null after each row of its key."""
    return known(df, keys, order, bucket, next_=(value, name))
