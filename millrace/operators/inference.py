"""Models over tensor columns: batches through a session that each worker opens once, decimation and activation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..functions.ordering import last_known, numbered

Load = Callable[[], Callable[[np.ndarray], np.ndarray]]


def onnx_model(content: bytes) -> Load:
    """A model of one input and one output, run on the CPU with one thread a task."""

    def load():
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        session = onnxruntime.InferenceSession(content, options, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda x: session.run(None, {name: x})[0]

    return load


def checked(models: dict[str, object], inputs: dict[str, str], every: dict[str, int] | None = None) -> None:
    """Complain about a configuration that cannot run."""
    if not models:
        raise ValueError("no models")
    if set(models) != set(inputs):
        raise ValueError(f"models and inputs differ: {sorted(set(models) ^ set(inputs))}")
    if any(not str(c) for c in inputs.values()):
        raise ValueError("an input has no name")
    for k, n in (every or {}).items():
        if k not in models:
            raise ValueError(f"unknown model {k!r}")
        if int(n) < 1:
            raise ValueError(f"{k} cannot run every {n} frames")


def infer(df: DataFrame, models: dict[str, Load], inputs: dict[str, str]) -> DataFrame:
    """``df`` with a column array<float> for each model, of its output for the array column that ``inputs`` names. A null input gives null."""
    checked(models, inputs)
    schema = StructType([*df.schema.fields, *[StructField(m, ArrayType(FloatType())) for m in models]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = {m: load() for m, load in models.items()}
        for frame in frames:
            for m, model in loaded.items():
                have = frame[inputs[m]].notna()
                out = pd.Series([None] * len(frame), index=frame.index, dtype=object)
                if have.any():
                    x = np.stack(frame.loc[have, inputs[m]].to_numpy()).astype(np.float32)
                    y = np.asarray(model(x), np.float32).reshape(len(x), -1)
                    out[have] = pd.Series(list(y), index=frame.index[have])
                frame[m] = out
            yield frame

    return df.mapInPandas(run, schema)


def decimated(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, every: int, name: str) -> DataFrame:
    """``df`` with ``value`` as of the last frame whose number in its key (from 1) ``every`` divides; null before the first."""
    rows = numbered(df, keys, order, bucket, "frame_")
    return last_known(rows, keys, order, bucket, F.when(F.col("frame_") % every == 0, value), name).drop("frame_")


def activated(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, flag: Column, name: str) -> DataFrame:
    """``df`` with ``value`` as of the last frame on which the model was on: ``flag`` 0 skips a frame, anything else (null too) runs it."""
    return last_known(df, keys, order, bucket, F.when(F.coalesce(flag, F.lit(1)) != 0, value), name)
