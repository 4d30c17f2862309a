"""Streams of predictions: sessions of activity with late rows, and a stateful on/off switch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(stream: DataFrame, gap: str = "1 second", late: str = "10 seconds", time: str = "ts") -> DataFrame:
    """Stretches of prediction 1 of each track without a pause of ``gap``: ``source, ID, t0, t1, n``.

    Rows later than ``late`` are dropped by the watermark.
    """
    on = stream.where("prediction = 1").withWatermark(time, late)
    grouped = on.groupBy("source", "ID", F.session_window(time, gap).alias("s")).agg(F.min(time).alias("t0"), F.max(time).alias("t1"), F.count("*").alias("n"))
    return grouped.drop("s")


def switch(stream: DataFrame, on: float, off: float) -> DataFrame:
    """Rows with the state of a track's on/off switch, which outlives micro-batches: ``source, ID, frame, state``.

    It goes on at ``prob >= on`` and off at ``prob <= off`` (with ``off < on``); null keeps it; a track starts off.
    Rows of a track must come in order of frames from batch to batch.
    """
    if not off < on:
        raise ValueError("off must be less than on")

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = held.get[0] if held.exists else 0
        rows = pd.concat(list(batches)).sort_values("frame", kind="stable")
        forced = pd.Series(float("nan"), index=rows.index).mask(rows["prob"] >= on, 1.0).mask(rows["prob"] <= off, 0.0)
        states = forced.ffill().fillna(float(state)).astype(int)
        held.update((int(states.iloc[-1]),))
        yield pd.DataFrame({"source": key[0], "ID": key[1], "frame": rows["frame"].astype("int64"), "state": states})

    return stream.groupBy("source", "ID").applyInPandasWithState(run, "source string, ID long, frame long, state int", "state int", "append", GroupStateTimeout.NoTimeout)
