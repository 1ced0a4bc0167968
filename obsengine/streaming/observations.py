"""Streaming forms of the sequence operators, which come to the batch answers once the watermark has passed."""

from __future__ import annotations

import json
from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(stream: DataFrame, keys: list[str], time: str, max_gap_us: int, late: str = "1 hour") -> DataFrame:
    """(keys, first, last, n): runs with gaps of up to max_gap_us, the gap included (a session's window ends just after it)."""
    gap = f"{max_gap_us + 1} microseconds"
    grouped = stream.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap))
    return grouped.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n")).drop("session_window")


def debounced(stream: DataFrame, keys: list[str], time: str, debounce_us: int, late: str = "1 hour") -> DataFrame:
    found = sessions(stream, keys, time, 2 * debounce_us, late)
    return found.filter(F.unix_micros("last") - F.unix_micros("first") >= debounce_us)


def running_average(stream: DataFrame, key: str, order: str, value: str, alpha: float = 0.35) -> DataFrame:
    """(key, n, average) after each batch that has rows of the key: the recursive average of all its rows so far.

    Rows of a batch are taken in order; the input is a file that was decoded in order, so none come late.
    """
    kind = dict(stream.dtypes)[key]

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, average = state.get if state.exists else (0, 0.0)
        for x in pd.concat(list(frames)).sort_values(order)[value]:
            average = float(x) if n == 0 else (1 - alpha) * average + alpha * float(x)
            n += 1
        state.update((n, average))
        yield pd.DataFrame({key: [k[0]], "n": [n], "average": [average]})

    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, n long, average double", "n long, average double", "update", GroupStateTimeout.NoTimeout
    )


def _in_order(frames: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    rows = pd.concat(list(frames))
    return sorted(zip(*(rows[c] for c in columns)))


def spaced(stream: DataFrame, key: str, order: str, row_id: str, spacing: int) -> DataFrame:
    """(key, id, t) of the rows kept: each at least `spacing` after the one kept before it, across batches."""
    types = dict(stream.dtypes)

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for t, i in _in_order(frames, "t", "id"):
            if last is None or t - last >= spacing:
                kept.append((k[0], i, t))
                last = t
        state.update((int(last),))
        yield pd.DataFrame(kept, columns=[key, "id", "t"])

    rows = stream.select(key, F.col(order).cast("long").alias("t"), F.col(row_id).alias("id"))
    schema = f"{key} {types[key]}, id {types[row_id]}, t long"
    return rows.groupBy(key).applyInPandasWithState(update, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def trailing(stream: DataFrame, key: str, order: str, row_id: str, value: str, length: int) -> DataFrame:
    """(key, id, n_trailing, shift): each row with the count of the rows up to `length` before it, itself included, and how
    far the median of their last third is from that of their first. The state holds no more than such a range."""
    types = dict(stream.dtypes)

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        out = []
        for t, i, v in _in_order(frames, "t", "id", "v"):
            held = [x for x in held if x[0] >= t - length] + [[int(t), float(v)]]
            third = max(1, len(held) // 3)
            values = [x[1] for x in held]
            out.append((k[0], i, len(held), abs(median(values[-third:]) - median(values[:third]))))
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=[key, "id", "n_trailing", "shift"])

    rows = stream.select(key, F.col(order).cast("long").alias("t"), F.col(row_id).alias("id"), F.col(value).cast("double").alias("v"))
    schema = f"{key} {types[key]}, id {types[row_id]}, n_trailing long, shift double"
    return rows.groupBy(key).applyInPandasWithState(update, schema, "held string", "append", GroupStateTimeout.NoTimeout)
