"""When a batch is ready: by count, by age, by period, and the algebra that combines conditions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import highest_before, matched, numbered, running_sum

#: Chains of a key that are summed up together.
CHAINS = 4096


def count_batches(df: DataFrame, keys: list[str], order: list[str], bucket: Column, size: int, name: str = "batch") -> DataFrame:
    """``df`` with its batch number, from 0: ``size`` rows of a key make a batch; the rows of an unfilled last one are left out."""
    rows = numbered(df, keys, order, bucket, "n_", total="all_")
    return rows.where(F.col("n_") <= F.floor(F.col("all_") / size) * size).withColumn(name, F.floor((F.col("n_") - 1) / size).cast("long")).drop("n_", "all_")


def per_port_batches(df: DataFrame, port: str, order: list[str], bucket: Column, sizes: dict[str, int]) -> DataFrame:
    """Rounds in which every port has its number of rows: (batch, port columns); a round counts once all ports have filled it."""
    parts = df.where(F.col(port).isin(*sizes))
    size = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(v))])
    rows = numbered(parts, [port], order, bucket, "n_").withColumn("batch", F.floor((F.col("n_") - 1) / size[F.col(port)]).cast("long")).drop("n_")
    full = parts.groupBy(port).agg(F.count(F.lit(1)).alias("n")).select(F.floor(F.col("n") / size[F.col(port)]).alias("n")).agg(F.min("n").alias("n_"), F.count(F.lit(1)).alias("ports_"))
    whole = F.when(F.col("ports_") == len(sizes), F.col("n_")).otherwise(0)
    return rows.crossJoin(F.broadcast(full)).where(F.col("batch") < whole).drop("n_", "ports_")  # one row


def _folded(df: DataFrame, keys: list[str], at: str, order: list[str], start, name: str) -> DataFrame:
    """Numbers from ``start()``, a function of each row's time in turn, over the sorted rows of a key: streamed, a key at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            out = []
            # Arrow keeps nulls apart from numbers, so a null key is one key
            for *key, t in zip(*(batch.column(k).to_pylist() for k in [*keys, at]), strict=True):
                if step is None or key != now:
                    now, step = key, start()
                out.append(step(t))
            yield batch.append_column(name, pa.array(out, pa.int64()))

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, df.schema.add(name, "long"))


def _chains(df: DataFrame, keys: list[str], at: str, order: list[str], bucket: Column, apart: Column) -> DataFrame:
    """``df`` with the number of the ``chain_`` each row is in: a chain ends where ``apart`` of (time, time before) holds."""
    rows = highest_before(df, keys, order, bucket, F.col(at), "before_")
    return running_sum(rows, keys, order, bucket, apart.cast("long"), "chain_", inclusive=True).drop("before_")


def expiring_batches(df: DataFrame, keys: list[str], at: str, order: list[str], bucket: Column, size: int, delay: int, name: str = "batch") -> DataFrame:
    """Greedy batches: one begins when none is open, when it holds ``size`` rows, or when a row is more than ``delay`` later than its first.

    ``order`` begins with ``at``. After a gap longer than ``delay`` a batch begins whatever came before, so the chains of rows
    between such gaps are folded apart, in tasks of their own, and their numbers of batches are summed up. A chain is one
    sequence; nothing but its open batch is held.
    """

    def start():
        batch, first, n = -1, 0, 0

        def step(t: int) -> int:
            nonlocal batch, first, n
            if not n or n >= size or t - first > delay:
                batch, first, n = batch + 1, t, 0
            n += 1
            return batch

        return step

    rows = _chains(df, keys, at, order, bucket, F.coalesce(F.col(at) - F.col("before_") > delay, F.lit(False)))
    rows = _folded(rows, [*keys, "chain_"], at, order, start, "own_")
    batches = rows.groupBy(*keys, "chain_").agg((F.max("own_") + 1).alias("n_"))
    before = running_sum(batches, keys, ["chain_"], F.floor(F.col("chain_") / CHAINS), F.col("n_"), "earlier_").drop("n_")
    return matched(rows, before, [*keys, "chain_"]).withColumn(name, F.col("own_") + F.col("earlier_")).drop("own_", "earlier_", "chain_")


def timeout_batches(df: DataFrame, keys: list[str], at: str, order: list[str], size: int, period: int, name: str = "batch") -> DataFrame:
    """Batches that end with the row that fills them, or once ``period`` has gone by since the last batch ended (the first: since the first row)."""

    def start():
        batch, last, n = 0, None, 0

        def step(t: int) -> int:
            nonlocal batch, last, n
            if last is None:
                last = t
            if n and t - last > period:  # the open batch was due before this row
                batch, last, n = batch + 1, last + period, 0
            n += 1
            own = batch
            if n >= size:
                batch, last, n = batch + 1, t, 0
            return own

        return step

    return _folded(df, keys, at, order, start, name)


def min_gap_ticks(df: DataFrame, keys: list[str], at: str, order: list[str], bucket: Column, period: int) -> DataFrame:
    """The rows at which a tick runs if ticks keep ``period`` apart: the first, then each that is at least that later than the last that ran.

    ``order`` begins with ``at``. After a gap of ``period`` a tick runs whatever came before, so the chains between such gaps are folded apart.
    """

    def start():
        due = None

        def step(t: int) -> int:
            nonlocal due
            if due is None or t >= due:
                due = t + period
                return 1
            return 0

        return step

    rows = _chains(df, keys, at, order, bucket, F.coalesce(F.col(at) - F.col("before_") >= period, F.lit(False)))
    return _folded(rows, [*keys, "chain_"], at, order, start, "ran_").where("ran_ = 1").drop("ran_", "chain_")


def _cells(df: DataFrame, keys: list[str], at: str, period: int) -> DataFrame:
    begin = df.groupBy(*keys).agg(F.min(at).alias("begin_"))
    return matched(df, begin, keys).withColumn("cell_", F.floor((F.col(at) - F.col("begin_")) / period).cast("long")).drop("begin_")


def grid_ticks(df: DataFrame, keys: list[str], at: str, order: list[str], period: int) -> DataFrame:
    """The rows at which a tick runs if missed ticks are not caught up: the first row in each period, counted from the key's first row."""
    w = Window.partitionBy(*keys, "cell_").orderBy(*order)
    return _cells(df, keys, at, period).withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_", "cell_")


def catch_up_ticks(df: DataFrame, keys: list[str], at: str, order: list[str], period: int, bucket: Column) -> DataFrame:
    """The rows at which a tick runs if missed ticks are caught up: each row runs one while fewer have run than periods begun.

    With c[i] periods begun at row i, the ticks run by then are i + min(c[j] - j, j <= i), so a running minimum decides.
    """
    rows = numbered(_cells(df, keys, at, period), keys, order, bucket, "n_")
    # the least of c - j before, as the greatest of its negative
    rows = highest_before(rows, keys, order, bucket, F.col("n_") - 1 - F.col("cell_"), "ahead_")
    before = F.least(F.lit(0), F.coalesce(-F.col("ahead_"), F.lit(0)))
    # run by the row before: n - 1 + before; this row runs one if a period more has begun
    ran = F.col("n_") - 1 + before < F.col("cell_") + 1
    return rows.where(ran).drop("n_", "cell_", "ahead_")


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows; all of them if ``n`` is negative."""
    return df if n < 0 else df.orderBy(*order).limit(n)


#: The states of a condition, the strongest first where all must hold.
STATES = ("NEVER", "WAIT_EVENT", "WAIT", "WAIT_TIME", "READY")


def _latest(state: Column, at: Column, name: str) -> Column:
    return F.max(F.when(state == name, at))


def all_of(df: DataFrame, keys: list[str], state: str, at: str) -> DataFrame:
    """(keys, state, at): conditions that must all hold. The strongest state wins; its time is the latest, 0 unless it is WAIT_TIME or READY."""
    s, t = F.col(state), F.col(at)
    has = {x: F.bool_or(s == x) for x in STATES}
    out = df.groupBy(*keys).agg(*[h.alias(f"{x}_") for x, h in has.items()], _latest(s, t, "WAIT_TIME").alias("wait_at_"), _latest(s, t, "READY").alias("ready_at_"))
    found = F.coalesce(*[F.when(F.col(f"{x}_"), F.lit(x)) for x in STATES])
    return out.select(*keys, found.alias("state"), F.when(found == "WAIT_TIME", F.col("wait_at_")).when(found == "READY", F.col("ready_at_")).otherwise(F.lit(0)).alias("at"))


def any_of(df: DataFrame, keys: list[str], state: str, at: str) -> DataFrame:
    """(keys, state, at): conditions of which one is enough. NEVER wins; then READY (latest), WAIT_EVENT, WAIT_TIME (latest), WAIT."""
    s, t = F.col(state), F.col(at)
    rank = ("NEVER", "READY", "WAIT_EVENT", "WAIT_TIME", "WAIT")
    out = df.groupBy(*keys).agg(*[F.bool_or(s == x).alias(f"{x}_") for x in rank], _latest(s, t, "WAIT_TIME").alias("wait_at_"), _latest(s, t, "READY").alias("ready_at_"))
    found = F.coalesce(*[F.when(F.col(f"{x}_"), F.lit(x)) for x in rank])
    return out.select(*keys, found.alias("state"), F.when(found == "WAIT_TIME", F.col("wait_at_")).when(found == "READY", F.col("ready_at_")).otherwise(F.lit(0)).alias("at"))
