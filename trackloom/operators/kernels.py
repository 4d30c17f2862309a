"""Rules over the rows of a track that are sequential or need every window's rows, in NumPy, one row shard at a time.

Shards are bounded (``operators.tracks.row_shards``), so no group grows with the data. Greedy event picking restarts at
a shard's margin; within a track of one shard the result is exact, and a seam can differ only where events follow each
other without a pause for a whole margin.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.operators.tracks import TRACK, group_quantiles, with_key
from trackloom.plans.staging import stage

TURN_STATS = ("turn_event_count", "turn_event_gap_mean_bl", "turn_event_gap_max_bl", "turn_event_amp_mean", "turn_event_interval_cv", "turn_event_alternation")
AMPLITUDE_QUANTILE = 0.75
TURN_PAUSE_S = 0.5


def turn_events(amp: np.ndarray, threshold: float, pause: int) -> np.ndarray:
    """Rows of local maxima at or above the threshold, each at least ``pause`` rows after the one before."""
    if len(amp) < 3:
        return np.empty(0, dtype=int)
    middle, left, right = amp[1:-1], amp[:-2], amp[2:]
    peaks = 1 + np.flatnonzero((middle >= threshold) & (middle >= left) & (middle >= right))
    # from each peak the next one that is far enough away
    allowed = np.searchsorted(peaks, peaks + pause)
    picked, at = [], 0
    while at < len(peaks):
        picked.append(at)
        at = int(allowed[at])
    return peaks[picked].astype(int)


def turn_stats(x: np.ndarray, y: np.ndarray, amp: np.ndarray, side: np.ndarray, length: float, n: int, threshold: float, pause: int) -> np.ndarray:
    """The six statistics of the turn events in rows i - n//2 to i + n//2 of every row i."""
    rows, half = len(amp), n // 2
    out = np.zeros((rows, 6))
    events = turn_events(amp, threshold, pause)
    if not len(events):
        return out
    first = np.searchsorted(events, np.arange(rows) - half, side="left")
    stop = np.searchsorted(events, np.arange(rows) + half, side="right")
    count = stop - first
    run = lambda v: np.concatenate([[0.0], np.cumsum(v)])
    amps = run(amp[events])
    out[:, 0] = count
    some = count > 0
    out[some, 3] = (amps[stop] - amps[first])[some] / count[some]
    if len(events) > 1:
        gap = np.hypot(np.diff(x[events]), np.diff(y[events]))
        wait = np.diff(events).astype(float)
        turned = (side[events][1:] * side[events][:-1] < 0).astype(float)
        pairs = count >= 2
        a, b, m = first[pairs], stop[pairs] - 1, (count[pairs] - 1).astype(float)
        gaps, waits, squares, turns = run(gap), run(wait), run(wait * wait), run(turned)
        out[pairs, 1] = (gaps[b] - gaps[a]) / m / (length + 1e-6)
        widest = [gap[i:j].max() for i, j in zip(a, b, strict=True)]
        out[pairs, 2] = np.array(widest) / (length + 1e-6)
        mean = (waits[b] - waits[a]) / m
        out[pairs, 4] = np.sqrt(np.maximum((squares[b] - squares[a]) / m - mean * mean, 0)) / (mean + 1e-6)
        out[pairs, 5] = (turns[b] - turns[a]) / m
    return out


def revisit(x: np.ndarray, y: np.ndarray, w: int) -> np.ndarray:
    """Smallest distance of row i to the rows 1 to w - 1 before it; 0 for the first w rows."""
    best = np.full(len(x), np.inf)
    for k in range(1, w):
        best[k:] = np.fmin(best[k:], np.hypot(x[k:] - x[:-k], y[k:] - y[:-k]))
    best[:w] = 0.0
    return np.where(np.isfinite(best), best, 1e9)


def trailing_mean(values: np.ndarray, n: int) -> np.ndarray:
    """Mean of row i and up to n - 1 rows before it; values of 1e9 are summed apart, so that they take no digits from others."""
    far = values >= 1e9
    run = lambda v: np.concatenate([[0.0], np.cumsum(v)])
    near, many = run(np.where(far, 0.0, values)), run(far)
    stop = np.arange(1, len(values) + 1)
    start = np.maximum(stop - n, 0)
    return (near[stop] - near[start] + 1e9 * (many[stop] - many[start])) / (stop - start)


def path_efficiency(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Furthest distance from the window's first row over the path length, rows i - n//2 to i + n//2."""
    rows, half = len(x), n // 2
    i = np.arange(rows)
    start, stop = np.maximum(i - half, 0), np.minimum(i + half, rows - 1)
    step = np.concatenate([[0.0], np.hypot(np.diff(x), np.diff(y))])
    path = np.cumsum(np.nan_to_num(step))
    length = path[stop] - path[start]
    furthest = np.zeros(rows)
    for k in range(1, 2 * half + 1):
        j = start + k
        inside = j <= stop
        d = np.hypot(x[j[inside]] - x[start[inside]], y[j[inside]] - y[start[inside]])
        furthest[inside] = np.fmax(furthest[inside], d)
    return np.where(stop == start, 1.0, np.divide(furthest, length, out=np.zeros(rows), where=length > 1e-6))


def dominant_frequency(signal: np.ndarray, n: int, fps: float) -> np.ndarray:
    """Frequency of the largest magnitude in a sliding spectrum (Tukey window of 0.25, mean removed, edges repeated)."""
    rows = len(signal)
    if rows < n or n < 2:
        return np.zeros(rows)
    taper = np.ones(n)
    edge = int(np.floor(0.25 * n / 2.0))
    k = np.arange(edge + 1)
    ramp = 0.5 * (1 + np.cos(np.pi * (-1 + 2.0 * k / 0.25 / n)))
    taper[: edge + 1], taper[n - edge - 1 :] = ramp, ramp[::-1]
    windows = np.lib.stride_tricks.sliding_window_view(np.nan_to_num(signal), n)
    best = np.empty(len(windows), dtype=int)
    for at in range(0, len(windows), 4096):
        part = windows[at : at + 4096]
        best[at : at + 4096] = np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * taper, axis=1)).argmax(axis=1)
    found = np.fft.rfftfreq(n, 1 / fps)[best]
    # a row takes the spectrum centred on it, at the ends the nearest one there is
    return found[np.clip(np.arange(rows) - (rows - len(found)) // 2, 0, len(found) - 1)]


def median_filter(values: np.ndarray, n: int) -> np.ndarray:
    """Sliding median of ``n`` rows with mirrored ends; the upper one of two."""
    if n <= 1 or not len(values):
        return values.copy()
    before = n // 2
    padded = np.pad(values, (before, n - 1 - before), mode="symmetric")
    return np.sort(np.lib.stride_tricks.sliding_window_view(padded, n), axis=1)[:, n // 2]


def with_kernels(df: DataFrame, wanted: Iterable[tuple[str, int]], fps: float) -> DataFrame:
    """Kernel columns ``_k{w}_...`` of a table of base signals in row shards."""
    wanted = sorted(wanted)
    amp = F.greatest(F.col("omega_heading"), F.radians("omega_relative"))
    rows = df.drop("_k").withColumn("_amp", amp)
    if any(k == "turns" for k, _ in wanted):
        held, _ = stage(rows.where("core").select("source", F.col("_amp").alias("_limit")), "amplitudes")
        limit = group_quantiles(held, ["source"], ["_limit"], AMPLITUDE_QUANTILE)
        rows = rows.alias("r").join(limit.alias("l"), F.col("r.source").eqNullSafe(F.col("l.source")), "left").select("r.*", "l._limit")
    names = {"turns": list(TURN_STATS), "frequency": ["frequency"], "efficiency": ["efficiency"], "revisit": ["revisit"], "revisit_rows": ["revisit_mean"]}
    added = [f"_k{w}_{c}" for k, w in wanted for c in names[k]]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in added]])

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("idx", kind="stable").reset_index(drop=True)
        x, y = shard["x"].to_numpy(float), shard["y"].to_numpy(float)
        columns = {}
        for kernel, w in wanted:
            n = int(w * fps)
            if kernel == "turns":
                stats = turn_stats(x, y, shard["_amp"].to_numpy(float), np.nan_to_num(shard["bend_side"].to_numpy(float)), float(shard["group_medians"].iloc[0]), n, float(shard["_limit"].iloc[0]), max(1, int(TURN_PAUSE_S * fps)))
                columns |= {f"_k{w}_{c}": stats[:, i] for i, c in enumerate(TURN_STATS)}
            elif kernel == "frequency":
                columns[f"_k{w}_frequency"] = dominant_frequency(shard["bending"].to_numpy(float), n, fps)
            elif kernel == "efficiency":
                columns[f"_k{w}_efficiency"] = path_efficiency(x, y, n)
            elif kernel == "revisit_rows":
                columns[f"_k{w}_revisit_mean"] = trailing_mean(revisit(x, y, n), n)
            else:
                columns[f"_k{w}_revisit"] = revisit(x, y, w)
        return pd.concat([shard, pd.DataFrame(columns, index=shard.index)], axis=1)

    return with_key(rows.groupBy(*TRACK, "shard").applyInPandas(run, schema).drop("_amp", "_limit"), TRACK)
