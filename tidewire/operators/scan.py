"""Prefix scans: for every position of a stream the merged state of all earlier ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.session import settle

Merge = Callable[[np.ndarray, np.ndarray], np.ndarray]
STATE = T.ArrayType(T.DoubleType())
FAN = 256  # states a task merges in a row


def exclusive_scan(states: DataFrame, merge: Merge, *, stream: Sequence[str] = (), position: str = "position", fan: int = FAN) -> DataFrame:
    """``states`` (stream, position, state) with ``before``: the merged state of all earlier positions, null for the first.

    States are arrays of doubles, ``merge`` joins two neighbours, the earlier one first; a stream's positions are unique
    numbers from 0, gaps are fine. Groups of ``fan`` positions are merged side by side, their totals are scanned the same way one
    level up, so a stream of any length takes a few levels, and no task holds more than ``fan`` states.
    """
    top = states.agg(F.max(position)).first()[0]
    return _level(states.select(*stream, F.col(position).alias("_at"), "state"), merge, list(stream), fan, int(top or 0)).withColumnRenamed("_at", position)


def _level(states: DataFrame, merge: Merge, stream: list[str], fan: int, top: int) -> DataFrame:
    keys = [*stream, "_group"]
    grouped = states.withColumn("_group", F.floor(F.col("_at") / F.lit(fan)))
    out = grouped.select(*keys, "_at").schema.add("state", STATE).add("before", STATE).add("_total", "boolean")

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at")
        before, held = [], None
        for state in rows["state"]:
            before.append(held)
            held = np.asarray(state) if held is None else merge(held, np.asarray(state))
        total = rows.iloc[[-1]].assign(state=[held], before=[None], _total=True)
        return pd.concat([rows.assign(before=before, _total=False), total])[out.fieldNames()]

    merged = grouped.groupBy(*keys).applyInPandas(inside, out)
    if top < fan:
        return merged.where("NOT _total").select(*stream, "_at", "state", "before")
    merged = settle(merged)
    totals = merged.where("_total").select(*stream, F.col("_group").alias("_at"), "state")
    ahead = _level(totals, merge, stream, fan, top // fan).select(*stream, F.col("_at").alias("_group"), F.col("before").alias("_ahead"))
    joined = merged.where("NOT _total").join(ahead, keys, "left").select(*stream, "_at", "state", "before", "_ahead")

    def both(batches):
        for rows in batches:
            pairs = zip(rows["_ahead"], rows["before"], strict=True)
            yield rows.drop(columns="_ahead").assign(before=[a if b is None else b if a is None else merge(np.asarray(a), np.asarray(b)) for a, b in pairs])

    return joined.mapInPandas(both, joined.drop("_ahead").schema)
