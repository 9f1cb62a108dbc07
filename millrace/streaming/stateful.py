"""Stateful forms of the batch operators, for streams: age-limited batches, latest values, running latencies, bounded queues.

Rows of one trigger are put in order by their time; a row that comes in a later trigger counts as later. State is a few numbers
a key (for :func:`latest`, the last value), kept in Spark's state store. To put them in order, a key's rows of one trigger are held in
memory, so a source with hot keys needs a limit on its triggers (maxFilesPerTrigger, maxOffsetsPerTrigger); :func:`first_in` holds no more
rows than it admits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _batches(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, *, key_name: str, at: str, id_col: str, size: int, delay: int) -> Iterator[pd.DataFrame]:
    batch, first, n = state.get if state.exists else (-1, 0, 0)
    rows = pd.concat(list(frames)).sort_values([at, id_col])
    out = []
    for t in rows[at].tolist():
        if not n or n >= size or t - first > delay:
            batch, first, n = batch + 1, t, 0
        n += 1
        out.append(batch)
    state.update((batch, first, n))
    yield pd.DataFrame({key_name: rows[key_name], id_col: rows[id_col], "batch": out})


def expiring_batches(stream: DataFrame, key: str, at: str, id_col: str, size: int, delay: int) -> DataFrame:
    """(key, id, batch): a batch of ``size`` rows at most, begun at most ``delay`` before its last row; numbers go on from trigger to trigger."""
    fold = partial(_batches, key_name=key, at=at, id_col=id_col, size=size, delay=delay)
    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} long, {id_col} long, batch long", "batch long, first long, n long", "append", GroupStateTimeout.NoTimeout)


def _latest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, *, key_name: str, at: str, id_col: str, side: str, value: str) -> Iterator[pd.DataFrame]:
    last, told = state.get if state.exists else (None, False)
    rows = pd.concat(list(frames)).sort_values([at, side, id_col])
    ids, values, old = [], [], []
    for i, is_consumer, x in zip(rows[id_col].tolist(), rows[side].tolist(), rows[value].tolist(), strict=True):
        if is_consumer:
            ids.append(i)
            values.append(last)
            old.append(bool(told and last is not None))
            told = True
        else:
            last, told = float(x), False
    state.update((last, told))
    yield pd.DataFrame({key_name: [key[0]] * len(ids), id_col: ids, "latest": pd.Series(values, dtype="float64"), "is_old": pd.Series(old, dtype=bool)})


def latest(stream: DataFrame, key: str, at: str, id_col: str, side: str, value: str) -> DataFrame:
    """(key, id, latest, is_old): for each consumer row (``side`` true) the last ``value`` of a producer row; producers of the same time come first."""
    fold = partial(_latest, key_name=key, at=at, id_col=id_col, side=side, value=value)
    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} long, {id_col} long, latest double, is_old boolean", "last double, told boolean", "append", GroupStateTimeout.NoTimeout)


def _report(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, *, order: list[str], latency: str, skip: int, threshold: float) -> Iterator[pd.DataFrame]:
    seen, n, total, most, most_no, least, least_no = state.get if state.exists else (0, 0, 0.0, None, 0, None, 0)
    rows = pd.concat(list(frames)).sort_values(order)
    for x in rows.loc[rows[latency] >= threshold, latency].tolist():
        seen += 1
        if seen <= skip:
            continue
        n, total = n + 1, total + x
        if most is None or x >= most:
            most, most_no = x, n
        if least is None or x <= least:
            least, least_no = x, n
    state.update((seen, n, total, most, most_no, least, least_no))
    if n:
        yield pd.DataFrame({"path": [key[0]], "n": [n], "max_ms": [most], "max_no": [most_no], "min_ms": [least], "min_no": [least_no], "avg_ms": [total / n]})


def latency_report(stream: DataFrame, path: str, latency: str, order: list[str], skip: int = 10, threshold: float = 0.0) -> DataFrame:
    """The running latency report of each path, a row whenever it changes. The last messages are not set aside, as a stream has no end."""
    fold = partial(_report, order=order, latency=latency, skip=skip, threshold=threshold)
    fields = "path string, n long, max_ms double, max_no long, min_ms double, min_no long, avg_ms double"
    return stream.groupBy(path).applyInPandasWithState(fold, fields, "seen long, n long, total double, most double, most_no long, least double, least_no long", "update", GroupStateTimeout.NoTimeout)


def _admitted(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, *, columns: list[str], order: list[str], capacity: int) -> Iterator[pd.DataFrame]:
    (n,) = state.get if state.exists else (0,)
    rows = None
    for frame in frames:
        rows = (frame if rows is None else pd.concat([rows, frame])).sort_values(order).head(max(0, capacity - n))
    if rows is not None:
        state.update((n + len(rows),))
        yield rows[columns]


def first_in(stream: DataFrame, key: str, order: list[str], capacity: int) -> DataFrame:
    """The first ``capacity`` rows of each key that arrive; later ones are rejected."""
    fold = partial(_admitted, columns=stream.columns, order=order, capacity=capacity)
    return stream.groupBy(key).applyInPandasWithState(fold, stream.schema, "n long", "append", GroupStateTimeout.NoTimeout)
