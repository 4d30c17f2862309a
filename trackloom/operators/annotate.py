"""Batch operations of an annotation tool: adding, filling, deleting and navigating intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.text import canonical_tags, tag_tokens
from trackloom.operators.periods import gaps_between, merged_periods
from trackloom.operators.ranges import _buckets, nearest, overlaps
from trackloom.operators.tracks import TRACK, same, with_key


def bounds(frames: DataFrame, time: str = "et") -> DataFrame:
    """First and last time of each track."""
    return frames.groupBy(*TRACK).agg(F.min(time).alias("begin"), F.max(time).alias("end"))


def add_intervals(new: DataFrame, frames: DataFrame, existing: DataFrame, fps: float = 6.0, bucket_s: float = 60.0) -> DataFrame:
    """Intervals ready to store: clamped to their track, snapped to the nearest frame, at least a frame long.

    Adds ``t0_frame``, ``t1_frame`` and ``overlaps``, the number of existing intervals that it overlaps. Only intervals
    of unknown tracks are dropped: the nearest frame counts however far it is. ``new`` needs ``annotation_id``.
    """
    clamp = lambda c: F.greatest(F.least(F.col(c), F.col("end")), F.col("begin"))
    ends = bounds(frames)
    inside = new.join(ends, TRACK).withColumns({"t0": clamp("t0"), "t1": clamp("t1")}).drop("begin", "end")
    points = frames.select(*TRACK, "et", "frame").distinct()
    for c in ("t0", "t1"):
        near = nearest(inside, points, ["frame"], left_time=c)
        inside = near.withColumn(c, F.col("matched_at")).withColumnRenamed("frame", f"{c}_frame").drop("matched_at")
    long = inside.withColumn("t1", F.when(F.col("t1") <= F.col("t0"), F.col("t0") + 1 / fps).otherwise(F.col("t1"))).withColumn("t1_frame", F.greatest("t1_frame", F.col("t0_frame") + 1))
    # a pair meets in each bucket that both touch and counts in that of the later start, which lies in the track
    past = F.col("end") + 1 / fps
    near = existing.select(*TRACK, "t0", "t1").join(ends, TRACK).where(overlaps(F.col("t0"), F.col("t1"), F.col("begin"), past))
    there = near.select(*TRACK, "t0", "t1", F.explode(_buckets(F.greatest("t0", "begin"), F.least("t1", past), bucket_s)).alias("_bucket"))
    here = long.select("annotation_id", *TRACK, "t0", "t1", F.explode(_buckets(F.col("t0"), F.col("t1"), bucket_s)).alias("_bucket"))
    later = F.floor(F.greatest("n.t0", "e.t0") / F.lit(bucket_s)).cast("long")
    meet = same("n", "e", [*TRACK, "_bucket"]) & overlaps(F.col("n.t0"), F.col("n.t1"), F.col("e.t0"), F.col("e.t1"), False) & (F.col("n._bucket") == later)
    hits = here.alias("n").join(there.alias("e"), meet).groupBy("n.annotation_id").agg(F.count("*").alias("overlaps"))
    tagged = long.withColumn("tags", canonical_tags(F.col("tags"))) if "tags" in long.columns else long
    return tagged.join(hits, "annotation_id", "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0)))


def coverage(labels: DataFrame, frames: DataFrame, slack_s: float = 1.1 / 6) -> DataFrame:
    """Labelled seconds and share of each track, and its number of periods."""
    periods = merged_periods(labels, slack_s).groupBy(*TRACK).agg(F.sum(F.col("t1") - F.col("t0")).alias("labelled_s"), F.count("*").alias("periods"))
    got = bounds(frames).join(periods, TRACK, "left")
    seconds = F.coalesce("labelled_s", F.lit(0.0))
    return got.select(*TRACK, seconds.alias("labelled_s"), F.coalesce("periods", F.lit(0)).alias("periods"), F.try_divide(seconds, F.col("end") - F.col("begin")).alias("share"))


def gaps(labels: DataFrame, frames: DataFrame, slack_s: float = 1.1 / 6) -> DataFrame:
    """Unlabelled stretches of each track, also before its first and after its last period."""
    inner = gaps_between(labels, slack_s)
    whole = with_key(labels.where((F.col("t1") > F.col("t0")) & F.col("ID").isNotNull()), TRACK).groupBy("_k").agg(F.min("t0").alias("first"), F.max("t1").alias("last"))
    ends = with_key(bounds(frames), TRACK).join(whole, "_k", "left")
    pair = lambda a, b: F.struct(F.col(a).alias("gap_start"), F.coalesce(*b).alias("gap_end"))
    outer = ends.select(*TRACK, F.explode(F.array(pair("begin", [F.col("first"), F.col("end")]), F.when(F.col("last").isNotNull(), pair("last", [F.col("end")])))).alias("g")).select(*TRACK, "g.*")
    # inner gaps of tracks with frames
    known = with_key(inner, TRACK).join(ends.select("_k"), "_k", "left_semi").select(*TRACK, F.col("t0").alias("gap_start"), F.col("t1").alias("gap_end"))
    return known.unionByName(outer).where(F.col("gap_end") - F.col("gap_start") > slack_s)


def fill_gaps(labels: DataFrame, frames: DataFrame, behavior: str, slack_s: float = 1.1 / 6) -> DataFrame:
    """New intervals of one behaviour for every unlabelled stretch."""
    new = gaps(labels, frames, slack_s).select(*TRACK, F.col("gap_start").alias("t0"), F.col("gap_end").alias("t1"), F.lit(behavior).alias("Behavior"))
    return new.withColumn("annotation_id", F.substring(F.md5(F.concat_ws("|", "source", F.col("ID").cast("string"), F.col("t0").cast("string"), F.lit(behavior))), 1, 13))


def set_track(frames: DataFrame, track: tuple, behavior: str) -> DataFrame:
    """One new interval of a behaviour over a whole track; none for an unknown track."""
    own = bounds(frames.where(F.col("source").eqNullSafe(F.lit(track[0])) & F.col("ID").eqNullSafe(F.lit(track[1]))))
    new = own.select(*TRACK, F.col("begin").alias("t0"), F.col("end").alias("t1"), F.lit(behavior).alias("Behavior"))
    return new.withColumn("annotation_id", F.substring(F.md5(F.concat_ws("|", "source", F.col("ID").cast("string"), F.lit("whole"), F.lit(behavior))), 1, 13))


def next_gap(labels: DataFrame, frames: DataFrame, after: DataFrame, slack_s: float = 1.1 / 6) -> DataFrame:
    """For each position ``source, ID, at`` the first gap of its track that ends later: ``source, ID, at, gap_start, gap_end``."""
    open_ = with_key(gaps(labels, frames, slack_s), TRACK).drop(*TRACK)
    met = with_key(after, TRACK).join(open_, "_k").where(F.col("gap_end") > F.col("at"))
    return met.groupBy(*TRACK, "at").agg(F.min(F.struct("gap_start", "gap_end")).alias("g")).select(*TRACK, "at", "g.*")


def undo(labels: DataFrame, added: DataFrame, steps: int = 1) -> DataFrame:
    """Without the last ``steps`` additions; ``added`` has ``annotation_id`` and ``step``, counted upwards."""
    last = added.agg(F.max("step")).first()[0]
    return labels if last is None else delete(labels, added.where(F.col("step") > last - steps))


def tracks_with(labels: DataFrame, behavior: str) -> DataFrame:
    """Tracks that have an interval of a behaviour."""
    return labels.where(F.col("Behavior") == behavior).select(*TRACK).distinct()


def delete(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the intervals of the given ``annotation_id``."""
    return labels.join(ids.select("annotation_id").distinct(), "annotation_id", "left_anti")


def tag_memory(labels: DataFrame, most: int = 10) -> DataFrame:
    """The tags used with each behaviour, most used first, ``most`` at the most (a report)."""
    used = labels.select("Behavior", F.explode(F.transform(tag_tokens(F.col("tags")), lambda t: F.lower(t))).alias("tag")).groupBy("Behavior", "tag").agg(F.count("*").alias("n"))
    w = Window.partitionBy("Behavior").orderBy(F.col("n").desc(), "tag")
    return used.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
