"""Irregular readings onto a regular grid of frames.

Each track is cut into time shards. Every shard is summarised by its first and last reading, a prefix scan over the
summaries (a few rows per track) hands each shard the last reading before it, and all shards are then filled
independently of each other. No task ever holds a whole track.

Defined results: rows without a usable ``et`` or without both coordinates (null or NaN) hold no reading; tracks with a
null source or ID are tracks of their own; an empty table gives an empty result; of several readings of one frame the
one nearest to the beat counts, then the earliest, then the smallest coordinates; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.frames import FPS, frame_number, is_number, need

TRACK = ["source", "ID"]


def frame_readings(df: DataFrame, fps: float = FPS) -> DataFrame:
    """One row per track and frame that has a reading: ``source, ID, frame, x, y``."""
    need(df, ["source", "ID", "et", "x", "y"])
    rows = df.select(*TRACK, F.col("et").cast("double").alias("et"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rows = rows.withColumn("frame", frame_number(F.col("et"), fps)).where(F.col("frame").isNotNull() & is_number(F.col("x")) & is_number(F.col("y")))
    best = F.min(F.struct(F.abs(F.col("et") * fps - F.col("frame")).alias("off"), "et", "x", "y"))
    return rows.groupBy(*TRACK, "frame").agg(best.alias("r")).select(*TRACK, "frame", "r.x", "r.y")


def _carried(readings: DataFrame, shard_frames: int) -> DataFrame:
    """Each reading with the one before it (``p_frame, p_x, p_y``), found inside its shard or carried in by the scan."""
    sharded = readings.withColumn("shard", F.floor(F.col("frame") / F.lit(shard_frames)))
    inside = Window.partitionBy(*TRACK, "shard").orderBy("frame")
    reading = F.struct("frame", "x", "y")
    summaries = sharded.groupBy(*TRACK, "shard").agg(F.max(reading).alias("last"))
    over_shards = Window.partitionBy(*TRACK).orderBy("shard")
    carries = summaries.select(*TRACK, "shard", F.lag("last").over(over_shards).alias("carry"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in TRACK] + [F.col("a.shard") == F.col("b.shard")]
    local = sharded.withColumn("before", F.lag(reading).over(inside)).alias("a")
    joined = local.join(carries.alias("b"), same, "left")
    before = F.coalesce(F.col("a.before"), F.col("b.carry"))
    return joined.select(*[F.col(f"a.{c}") for c in [*TRACK, "shard", "frame", "x", "y"]], before.alias("p")).select(
        *TRACK, "shard", "frame", "x", "y", F.col("p.frame").alias("p_frame"), F.col("p.x").alias("p_x"), F.col("p.y").alias("p_y")
    )


def missing_runs(df: DataFrame, fps: float = FPS, silence_s: float = 600.0, shard_frames: int = 8192) -> DataFrame:
    """Longest runs of frames without reading between two readings at most ``silence_s`` apart.

    Columns: ``source, id, first_frame, last_frame``.
    """
    pairs = _carried(frame_readings(df, fps), shard_frames)
    apart = F.col("frame") - F.col("p_frame")
    return pairs.where((apart > 1) & (apart <= F.lit(int(silence_s * fps)))).select(
        "source", F.col("ID").alias("id"), (F.col("p_frame") + 1).alias("first_frame"), (F.col("frame") - 1).alias("last_frame")
    )


def regular_grid(df: DataFrame, fps: float = FPS, silence_s: float = 600.0, bridge_s: float = 1.0, shard_frames: int = 8192) -> DataFrame:
    """One row per frame number of every recording: ``source, id, frame, x, y, state``.

    ``state`` is ``read`` (a reading), ``filled`` (in a hole whose readings are at most ``bridge_s`` apart; linear
    between them) or ``missing`` (in a longer hole; coordinates null). Frames of a silence longer than ``silence_s``
    belong to no recording and get no row. One row is made per frame of at most ``silence_s`` at a time.
    """
    pairs = _carried(frame_readings(df, fps), shard_frames)
    apart = F.col("frame") - F.col("p_frame")
    hole = (apart > 1) & (apart <= F.lit(int(silence_s * fps)))
    begin = F.when(hole, F.col("p_frame") + 1).otherwise(F.col("frame"))
    grid = pairs.select("*", F.explode(F.sequence(begin, F.col("frame"))).alias("at"))
    is_read, bridged = F.col("at") == F.col("frame"), (F.col("frame") - F.col("p_frame")) <= F.lit(int(bridge_s * fps))
    share = (F.col("at") - F.col("p_frame")) / (F.col("frame") - F.col("p_frame"))

    def value(c: str):
        between = F.col(f"p_{c}") + (F.col(c) - F.col(f"p_{c}")) * share
        return F.when(is_read, F.col(c)).when(bridged, between).alias(c)

    state = F.when(is_read, "read").when(bridged, "filled").otherwise("missing").alias("state")
    return grid.select("source", F.col("ID").alias("id"), F.col("at").alias("frame"), value("x"), value("y"), state)
