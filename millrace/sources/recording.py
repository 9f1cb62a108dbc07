"""Recording a stream as Parquet with an index of its entities, and replaying it on a schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import running_sum


def index_of(df: DataFrame, order: list[str], bucket: Column, size: Column, log_time: Column) -> DataFrame:
    """(order, log_time, data_size, data_offset): an entity's offset is the sum of the sizes before it."""
    rows = df.select(*order, log_time.alias("log_time"), size.cast("long").alias("data_size"), bucket.alias("b_"))
    return running_sum(rows, [], order, F.col("b_"), F.col("data_size"), "data_offset").drop("b_")


def record(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def replay(spark: SparkSession, path: str, schema=None, stream: bool = False, files_per_trigger: int = 1) -> DataFrame:
    """The recorded rows, as a batch or as a stream that takes up to ``files_per_trigger`` files at a time."""
    if stream:
        return spark.readStream.schema(schema or spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)


def schedule(df: DataFrame, frame: str, at_us: Column, frame_rate: float = 0.0, repeat: int = 1, count: int = 0, corrupt: Column | None = None) -> DataFrame:
    """``df`` with loop and due_us, when each frame is shown after the start: nothing sleeps.

    ``frame`` numbers the frames from 0. With ``frame_rate`` frames are that far apart, else as recorded; each of ``repeat``
    loops starts where the last one ended, a frame's mean distance after its last frame. ``count`` > 0 stops after so many
    frames. Corrupt frames keep their place in time and are left out.
    """
    rows = df.withColumn("at_", at_us)
    ends = rows.agg(F.min("at_").alias("from_"), F.max("at_").alias("to_"), F.count(F.lit(1)).alias("frames_"))
    rows = rows.crossJoin(F.broadcast(ends))  # one row
    rows = rows.withColumn("loop", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
    shown = F.col("loop").cast("long") * F.col("frames_") + F.col(frame)
    if frame_rate:
        due = F.floor(shown * (1e6 / frame_rate))
    else:
        lap = F.col("to_") - F.col("from_")
        lap = lap + F.when(F.col("frames_") > 1, F.floor(lap / (F.col("frames_") - 1))).otherwise(0)
        due = F.col("at_") - F.col("from_") + F.col("loop") * lap
    out = rows.withColumn("due_us", due.cast("long"))
    if count:
        out = out.where(shown < count)
    if corrupt is not None:
        out = out.where(~F.coalesce(corrupt, F.lit(False)))
    return out.drop("at_", "from_", "to_", "frames_")


def export_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Rows as quoted CSV with a header; the columns must be there."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    df.select(*columns).write.mode("append").option("header", True).csv(path)
