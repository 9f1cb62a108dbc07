"""Generated streams: counters, constant tensors, one row of every payload type."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def counter(spark: SparkSession, n: int, start: int = 1) -> DataFrame:
    """``n`` rows with ``value`` from ``start``."""
    return spark.range(start, start + n).withColumnRenamed("id", "value")


def ticking(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """The same as a stream: (timestamp, value)."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().withColumn("value", F.col("value") + 1)


#: Spark's type for each element type of a tensor.
ELEMENTS = {"int8_t": "tinyint", "int16_t": "smallint", "int32_t": "int", "int64_t": "bigint", "uint8_t": "smallint", "uint16_t": "int", "uint32_t": "bigint", "uint64_t": "decimal(20,0)", "float": "float", "double": "double", "complex<float>": "struct<re:float,im:float>", "complex<double>": "struct<re:double,im:double>"}


def tensors(spark: SparkSession, n: int, shape: list[int], element: str = "uint8_t", data: list | None = None, name: str = "tensor") -> DataFrame:
    """``n`` rows (msg_id, tensor struct(shape, dtype, data)); without ``data`` the elements are 0."""
    if element not in ELEMENTS:
        raise ValueError(f"unknown element type {element!r}")
    size = 1
    for x in shape:
        size *= x
    if data is not None and len(data) != size:
        raise ValueError(f"{len(data)} elements do not fill {shape}")
    kind = ELEMENTS[element]
    if data is not None:
        values = F.array(*[F.lit(x) for x in data])
    else:
        zero = F.lit(0) if not kind.startswith("struct") else F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
        values = F.array_repeat(zero, size)
    tensor = F.struct(F.array(*[F.lit(x) for x in shape]).alias("shape"), F.lit(element).alias("dtype"), values.cast(f"array<{kind}>").alias("data"))
    return counter(spark, n).select(F.col("value").alias("msg_id"), tensor.alias(name))


def described(df: DataFrame, name: str = "tensor") -> DataFrame:
    """(msg_id, shape, dtype, elements) of tensor messages."""
    t = F.col(name)
    return df.select("msg_id", t["shape"].alias("shape"), t["dtype"].alias("dtype"), F.size(t["data"]).alias("elements"))


def payload_types(spark: SparkSession) -> DataFrame:
    """One row with a column of every payload type: scalars, their lists and lists of lists, and a map."""
    scalars = {"bool": (T.BooleanType(), True), "byte": (T.ByteType(), 1), "short": (T.ShortType(), 2), "int": (T.IntegerType(), 3), "long": (T.LongType(), 4), "ulong": (T.DecimalType(20, 0), None), "float": (T.FloatType(), 1.5), "double": (T.DoubleType(), 2.5), "string": (T.StringType(), "text"), "time": (T.TimestampType(), datetime.datetime(2024, 1, 1))}
    fields, values = [], []
    for name, (kind, value) in scalars.items():
        for suffix, k, v in (("", kind, value), ("_list", T.ArrayType(kind), [value]), ("_lists", T.ArrayType(T.ArrayType(kind)), [[value], []])):
            fields.append(T.StructField(name + suffix, k))
            values.append(v)
    fields.append(T.StructField("map", T.MapType(T.StringType(), T.StringType())))
    values.append({"key1": "value1", "key2": "value2"})
    return spark.createDataFrame([tuple(values)], T.StructType(fields))
