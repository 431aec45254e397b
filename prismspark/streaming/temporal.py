"""Temporal screens of live series: (series, at TIMESTAMP, id, value).

A whole-series median cannot be kept on a stream; the screen takes the median of the last `MEMORY` changes of a series.
State per series is bounded by that number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prismspark.functions import thresholds as T

MEMORY = 256
LEAST = 3
OUTPUT = "series STRING, id BIGINT, at TIMESTAMP, change DOUBLE, gap DOUBLE, duplicate BOOLEAN, anomaly BOOLEAN, late BOOLEAN, timing_gap BOOLEAN"
STATE = "last_at DOUBLE, last_value DOUBLE, changes ARRAY<DOUBLE>, gaps ARRAY<DOUBLE>"


def windows(events: DataFrame, width: str = "1 day", delay: str = "2 hours") -> DataFrame:
    """Per series and window: count, mean, deviation, bounds; rows later than delay are dropped."""
    aged = events.withWatermark("at", delay)
    return aged.groupBy(F.window("at", width), "series").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high")
    ).select("series", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean", "std", "low", "high")


def judge(seconds: float, value: float, state: list) -> tuple:
    """One frame against the state [last time, last value, changes, gaps], which it updates."""
    last_at, last_value, changes, gaps = state
    change = gap = None
    duplicate = anomaly = timing = late = False
    if last_at is not None:
        late = seconds < last_at
        if not late:
            change, gap = abs(value - last_value), seconds - last_at
            duplicate = change <= T.DUPLICATE_MAD
            if len(changes) >= LEAST:
                mid = float(np.median(changes))
                anomaly = change >= max(T.TRANSITION_FLOOR, mid + T.ROBUST_SIGMA * T.MAD_SCALE * float(np.median(np.abs(np.array(changes) - mid))))
                usual = sorted(gaps)[len(gaps) // 2]
                timing = usual > 0 and gap > T.GAP_FACTOR * usual
            state[2], state[3] = (changes + [change])[-MEMORY:], (gaps + [gap])[-MEMORY:]
    if not late:
        state[0], state[1] = seconds, value
    return change, gap, duplicate, anomaly, late, timing


def advance(key: tuple, chunks: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    state = list(held.get) if held.exists else [None, None, [], []]
    state[2], state[3] = list(state[2]), list(state[3])
    # Rows of one trigger may come in any order.
    rows = pd.concat(list(chunks)).sort_values(["at", "id"])
    out = []
    for at, i, value in rows[["at", "id", "value"]].itertuples(index=False):
        out.append((key[0], i, at, *judge(at.timestamp(), value, state)))
    held.update(tuple(state))
    yield pd.DataFrame(out, columns=[part.split()[0] for part in OUTPUT.split(", ")])


def screen(events: DataFrame) -> DataFrame:
    """Each frame with its change, and whether it duplicates its predecessor, departs from the recent ones, follows a
    gap, or came too late to be compared. Rows with null parts are left out."""
    whole = events.select(F.col("series").cast("string").alias("series"), "at", "id", F.col("value").cast("double").alias("value")).dropna()
    return whole.groupBy("series").applyInPandasWithState(advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Run a stream over what is there, into folder/out/batch=N: a repeated batch replaces its own rows."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
