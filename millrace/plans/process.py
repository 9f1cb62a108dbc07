"""Array operations by name: a small configuration of what to compute from each array column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tensors

#: An operation takes the array column and its options.
OPERATIONS: dict[str, Callable[..., Column]] = {
    "argmax_classes": tensors.argmax_classes,
    "sigmoid_classes": tensors.sigmoid_classes,
    "max_positions": tensors.max_positions,
    "binary_class": tensors.binary_class,
    "binary_class_row": tensors.binary_class_row,
    "printed": tensors.printed,
    "rescale_up": tensors.rescale_up,
    "rescale_down": tensors.rescale_down,
    "reorder_channels": tensors.reorder_channels,
    "add_alpha": tensors.add_alpha,
    "drop_alpha": tensors.drop_alpha,
    "primitives": tensors.primitives,
    "depth_points": tensors.depth_points,
}


def process(df: DataFrame, steps: dict[str, tuple[str, list[tuple[str, dict]]]], operations: dict[str, Callable[..., Column]] | None = None) -> DataFrame:
    """``df`` with a column for each entry of ``steps``: output -> (input column, [(operation, options), ...]), applied one after the other.

    Everything is checked before anything is computed.
    """
    known = OPERATIONS | (operations or {})
    if not steps:
        raise ValueError("nothing to process")
    made: dict[str, Column] = {}
    for output, (source, chain) in steps.items():
        if not output or output in df.columns:
            raise ValueError(f"{output!r} is no new column")
        if source not in df.columns:
            raise ValueError(f"no column {source!r}")
        if not chain:
            raise ValueError(f"no operation for {output!r}")
        value = F.col(source)
        for name, options in chain:
            if name not in known:
                raise ValueError(f"unknown operation {name!r}")
            value = known[name](value, **options)
        made[output] = value
    return df.withColumns(made)
