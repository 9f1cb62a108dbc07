"""Wiring streams: fan-out, fan-in, routing by predicate, round robin, and questions about a graph of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import numbered


def routed(df: DataFrame, edges: dict[str, Column], name: str = "edge") -> DataFrame:
    """A row for each edge whose predicate holds: none, one or several; rows that no edge takes are dropped."""
    takes = F.filter(F.array(*[F.when(p, F.lit(k)) for k, p in edges.items()]), lambda x: x.isNotNull())
    return df.withColumn(name, F.explode(takes))


def round_robin(df: DataFrame, order: list[str], bucket: Column, ports: int) -> DataFrame:
    """``df`` with round and port (both from 0): row i in order goes to port i mod ``ports``."""
    rows = numbered(df, [], order, bucket, "n_")
    return rows.withColumn("round", F.floor((F.col("n_") - 1) / ports).cast("long")).withColumn("port", ((F.col("n_") - 1) % ports).cast("int")).drop("n_")


def gathered(parts: list[DataFrame], ports: int) -> DataFrame:
    """Rows of round-robin ports as one stream, with their number from 1 in the order they had."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("n", F.col("round") * ports + F.col("port") + 1)


def zipped(df: DataFrame, port: str, ports: list[str], order: list[str], bucket: Column, value: str) -> DataFrame:
    """(n, values): the n-th messages of all ports together, in the order of ``ports``; messages without partners on every port are left out."""
    rows = numbered(df.where(F.col(port).isin(*ports)), [port], order, bucket, "n")
    values = F.array(*[F.max(F.when(F.col(port) == p, F.col(value))) for p in ports])
    return rows.groupBy("n").agg(F.count(F.lit(1)).alias("have_"), values.alias("values")).where(F.col("have_") == len(ports)).drop("have_")


def frame_numbers(df: DataFrame, root: str, order: list[str], bucket: Column) -> DataFrame:
    """``df`` with a counter from 1 for each root."""
    return numbered(df, [root], order, bucket, "frame")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out, is_root, is_leaf) of a graph given as edges (source, target)."""
    ends = edges.select(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(edges.select(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    out = ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return out.withColumn("is_root", F.col("n_in") == 0).withColumn("is_leaf", F.col("n_out") == 0)
