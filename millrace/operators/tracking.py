"""Latency reports over paths of operators, job statistics, and filters for data logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: The most paths whose bounds and extremes, a row each, are broadcast; for more of them the rows are shuffled.
FEW = 1 << 16
#: Shares into which a key's rows are dealt to find a bound of its first and last rows.
SHARES = 1 << 10


def _few(df: DataFrame, keys: list[str]) -> bool:
    return df.select(*keys).distinct().limit(FEW + 1).count() <= FEW


def _with(df: DataFrame, other: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Joined with a table of one row a key."""
    return df.join(F.broadcast(other) if few else other, keys)


def _edges(df: DataFrame, keys: list[str], order: list[str], n: int, last: bool, name: str, few: bool) -> DataFrame:
    """The order of the n-th row of each key from one end; keys with fewer rows have their last.

    Of the ends of SHARES shares of a key the n-th one bounds its n-th row, so only the rows up to there are sorted: about n, and those that are equal in
    the first order column.
    """
    end, up = (F.max, F.desc) if last else (F.min, F.asc)
    first, w = F.col(order[0]), Window.partitionBy(*keys)
    ends = df.groupBy(*keys, F.pmod(F.xxhash64(*order), F.lit(SHARES)).alias("share_")).agg(end(order[0]).alias("end_"))
    bound = ends.withColumn("rank_", F.row_number().over(w.orderBy(up("end_")))).where(F.col("rank_") <= n).groupBy(*keys).agg((F.min if last else F.max)("end_").alias("bound_"))
    near = _with(df.select(*keys, *order), bound, keys, few).where(F.coalesce(first >= F.col("bound_") if last else first <= F.col("bound_"), F.lit(True)))
    edge = (F.min if last else F.max)(F.struct(*order))
    return near.withColumn("rank_", F.row_number().over(w.orderBy(*[up(c) for c in order]))).where(F.col("rank_") <= n).groupBy(*keys).agg(edge.alias(name))


def trimmed(df: DataFrame, keys: list[str], order: list[str], skip: int, discard: int) -> DataFrame:
    """Without the first ``skip`` and the last ``discard`` rows of each key, by ``order`` (unique in a key)."""
    few = bool(skip or discard) and _few(df, keys)
    if skip:
        df = _with(df, _edges(df, keys, order, skip, False, "from_", few), keys, few).where(F.struct(*order) > F.col("from_")).drop("from_")
    if discard:
        # counted among all rows, as the rows skipped come first
        df = _with(df, _edges(df, keys, order, discard, True, "to_", few), keys, few).where(F.struct(*order) < F.col("to_")).drop("to_")
    return df


def latency_report(df: DataFrame, path: str, latency: str, order: list[str], threshold: float = 0.0, skip: int = 10, discard: int = 10) -> DataFrame:
    """(path, n, max_ms, max_no, min_ms, min_no, avg_ms) of each path's messages.

    Latencies below ``threshold`` are left out first, then the first ``skip`` messages and the last ``discard``. Numbers
    count the messages that are left, from 1; of equal extremes the latest counts. Paths without messages left have no row.
    Aggregates are of plain numbers, so that they are hashed; structs would have all rows sorted.
    """
    rows = df.where(F.col(latency) >= threshold).select(F.col(path).alias("path"), F.col(latency).alias("latency"), *order)
    kept, few = trimmed(rows, ["path"], order, skip, discard), _few(rows, ["path"])
    found = kept.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("latency").alias("max_ms"), F.min("latency").alias("min_ms"), F.avg("latency").alias("avg_ms"))
    # the latest of equal extremes, one order column after the other
    ends = ("max", "min")
    for i, c in enumerate(order):
        at = {e: reduce(lambda a, b: a & b, [F.col(o).eqNullSafe(F.col(f"{e}_{k}_")) for k, o in enumerate(order[:i])], F.col("latency") == F.col(f"{e}_ms")) for e in ends}
        latest = _with(kept, found, ["path"], few).groupBy("path").agg(*[F.max(F.when(at[e], F.col(c))).alias(f"{e}_{i}_") for e in ends])
        found = _with(found, latest, ["path"], few)
    # a message's number is how many come up to it
    at = {e: F.struct(*[F.col(f"{e}_{i}_").alias(c) for i, c in enumerate(order)]) for e in ends}
    numbers = _with(kept, found, ["path"], few).groupBy("path").agg(*[F.count_if(F.struct(*order) <= at[e]).alias(f"{e}_no") for e in ends])
    return _with(found, numbers, ["path"], few).select("path", "n", "max_ms", "max_no", "min_ms", "min_no", "avg_ms")


def source_counts(df: DataFrame, operator: str, port: str) -> DataFrame:
    """(source, n): messages of each operator and port."""
    return df.groupBy(F.concat_ws("->", operator, port).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def path_name(hops: Column) -> Column:
    """Comma-joined operator names of an array of struct(op, rec_us, pub_us)."""
    return F.array_join(F.transform(hops, lambda h: h["op"]), ",")


def path_latency_ms(hops: Column) -> Column:
    """From the first receipt to the last publication."""
    return (F.element_at(hops, -1)["pub_us"] - hops[0]["rec_us"]) / 1000.0


def ends_only(hops: Column) -> Column:
    """The first and last hop of a path (limited tracking)."""
    return F.when(F.size(hops) > 2, F.array(hops[0], F.element_at(hops, -1))).otherwise(hops)


def closed_cycle(hops: Column) -> Column:
    """A path that comes back to its first operator ends there, with that operator's own time left out."""
    last = F.element_at(hops, -1)
    shut = F.struct(last["op"].alias("op"), last["rec_us"].alias("rec_us"), last["rec_us"].alias("pub_us"))
    return F.when((F.size(hops) > 1) & (last["op"] == hops[0]["op"]), F.concat(F.slice(hops, F.lit(1), F.size(hops) - 1), F.array(shut))).otherwise(hops)


def log_line(hops: Column) -> Column:
    """``(op,rec,pub) -> (op,rec,pub)``."""
    return F.array_join(F.transform(hops, lambda h: F.concat(F.lit("("), F.concat_ws(",", h["op"], h["rec_us"].cast("string"), h["pub_us"].cast("string")), F.lit(")"))), " -> ")


def job_statistics(df: DataFrame, keys: list[str], order: list[str], value: str, history: int = 100) -> DataFrame:
    """(keys, n, median, most) over the last ``history`` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    last = df.select(*keys, *order, value).withColumn("rank_", F.row_number().over(w)).where(F.col("rank_") <= history)
    return last.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile(value, F.lit(0.5)).alias("median"), F.max(value).alias("most"))


def _any(name: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [name.rlike(p) for p in patterns])


def log_filter(name: Column, allow: list[str] | None = None, deny: list[str] | None = None) -> Column:
    """Whether a name is logged: not if a deny pattern is found in it; else if there are no allow patterns or one is found."""
    out = F.lit(True)
    if deny:
        out = out & ~_any(name, deny)
    if allow:
        out = out & _any(name, allow)
    return out
