"""Range and as-of joins between frames and intervals of the same track.

All of them meet on equality: time is cut into buckets, the narrower side keeps its bucket, the wider one is copied to
each bucket it touches. Buckets also part hot tracks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.frames import is_number
from trackloom.operators.tracks import TRACK, same, with_key


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column, inclusive: bool = True) -> Column:
    """Whether two intervals overlap."""
    return (a0 <= b1) & (b0 <= a1) if inclusive else (a0 < b1) & (b0 < a1)


def _buckets(low: Column, high: Column, width: float) -> Column:
    return F.sequence(F.floor(low / F.lit(width)).cast("long"), F.floor(high / F.lit(width)).cast("long"))


def clipped(intervals: DataFrame, frames: DataFrame, keys: Sequence[str], time: str, low: Column, high: Column) -> DataFrame:
    """Adds ``_low`` and ``_high``, the interval cut to the times its track has; intervals without any are left out.

    So an interval with an absurd end is copied to no more buckets than the track has.
    """
    ends = with_key(frames, keys).groupBy("_k").agg(F.min(time).alias("_begin"), F.max(time).alias("_end"))
    met = with_key(intervals, keys).join(ends, "_k").withColumns({"_low": F.greatest(low, F.col("_begin")), "_high": F.least(high, F.col("_end"))})
    return met.where("_low <= _high").drop("_k", "_begin", "_end")


def label_frames(frames: DataFrame, intervals: DataFrame, order: Sequence[Column], add: Sequence[str], keys: Sequence[str] = TRACK, time: str = "et", start: str = "t0", end: str = "t1", bucket_s: float = 60.0, how: str = "last") -> DataFrame:
    """Frames inside intervals, start included and end not, with the columns ``add`` of the interval.

    A frame in several intervals takes the last by ``order`` (``how="last"``) or all (``how="all"``); frames in none
    are dropped. ``frames`` must not have repeated rows if ``how`` is ``last``.
    """
    keys = list(keys)
    wide = intervals.select(*keys, start, end, F.struct(*order).alias("_ord"), F.struct(*[F.col(c) for c in add]).alias("_add"))
    wide = clipped(wide, frames, keys, time, F.col(start), F.col(end)).withColumn("_bucket", F.explode(_buckets(F.col("_low"), F.col("_high"), bucket_s)))
    narrow = frames.withColumn("_bucket", F.floor(F.col(time) / F.lit(bucket_s)).cast("long"))
    inside = (F.col(f"f.{time}") >= F.col(f"i.{start}")) & (F.col(f"f.{time}") < F.col(f"i.{end}"))
    met = narrow.alias("f").join(wide.alias("i"), same("f", "i", [*keys, "_bucket"]) & inside)
    columns = [F.col(f"f.{c}") for c in frames.columns]
    if how == "all":
        return met.select(*columns, *[F.col(f"i._add.{c}").alias(c) for c in add])
    best = met.groupBy(*columns).agg(F.max(F.struct("i._ord", "i._add")).alias("_best"))
    return best.select(*frames.columns, *[F.col(f"_best._add.{c}").alias(c) for c in add])


def asof_nearest(left: DataFrame, right: DataFrame, tolerance: float, left_key: Sequence[str], add: Sequence[str], keys: Sequence[str] = TRACK, left_time: str = "et", right_time: str = "et", how: str = "left") -> DataFrame:
    """Each left row with the nearest right row of its track within ``tolerance``, both ends included.

    Of two equally near rows the earlier wins, of rows at one time the one with the larger ``add`` values.
    ``left_key`` are the left columns that tell its rows apart.
    """
    keys, left_key = list(keys), list(left_key)
    points = right.select(*keys, F.col(right_time).alias("_at"), F.struct(*add).alias("_add"))
    points = points.withColumn("_bucket", F.explode(_buckets(F.col("_at") - tolerance, F.col("_at") + tolerance, 2 * tolerance)))
    rows = left.withColumn("_bucket", F.floor(F.col(left_time) / F.lit(2 * tolerance)).cast("long"))
    off = F.abs(F.col("r._at") - F.col(f"l.{left_time}"))
    met = rows.alias("l").join(points.alias("r"), same("l", "r", [*keys, "_bucket"]) & (off <= F.lit(tolerance)))
    nearest = F.min(F.struct(off.alias("off"), F.col("r._at").alias("at"))).alias("near")
    best = met.groupBy(*[F.col(f"l.{c}") for c in left_key]).agg(nearest, F.max_by(F.col("r._add"), F.struct(-off, -F.col("r._at"), F.col("r._add"))).alias("_add"))
    wanted = best.select(*left_key, F.col("near.at").alias("matched_at"), *[F.col(f"_add.{c}").alias(c) for c in add])
    return left.alias("l").join(wanted.alias("w"), same("l", "w", left_key), how).select("l.*", "w.matched_at", *[f"w.{c}" for c in add])


def nearest(left: DataFrame, right: DataFrame, add: Sequence[str], keys: Sequence[str] = TRACK, left_time: str = "et", right_time: str = "et", block_s: float = 60.0) -> DataFrame:
    """Each left row with the nearest right row of its track, however far: adds ``matched_at`` and ``add``.

    Of two equally near rows the earlier wins, of rows at one time the one with the larger ``add`` values. Every left
    row stays once, with nulls if its track has no right row or its time is no number. Both sides are put in one order
    inside blocks of time; the last point before a block and the first one after it are carried in by a scan.
    """
    keys, time = list(keys), F.col("_t")
    at = right.select(*keys, F.col(right_time).cast("double").alias("_t"), F.struct(*add).alias("_add")).where(is_number(time))
    points = at.groupBy(*keys, "_t").agg(F.max("_add").alias("_add")).select(*keys, "_t", F.struct("_t", "_add").alias("_point"))
    rows = left.select(*keys, F.col(left_time).cast("double").alias("_t"), F.struct(*left.columns).alias("_row"))
    both = rows.unionByName(points, allowMissingColumns=True).withColumn("_block", F.floor(time / F.lit(block_s)))
    over, inside = Window.partitionBy(*keys), Window.partitionBy(*keys, "_block")
    # up to a row and those at its time, in both directions
    upto = lambda order: inside.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = both.withColumns({"_before": F.last("_point", True).over(upto(time)), "_after": F.last("_point", True).over(upto(time.desc()))}).where("_row IS NOT NULL")
    ends = both.groupBy(*keys, "_block").agg(F.min("_point").alias("_first"), F.max("_point").alias("_last"))
    ahead = lambda order: over.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "_block", F.last("_last", True).over(ahead(F.col("_block"))).alias("_behind"), F.last("_first", True).over(ahead(F.col("_block").desc())).alias("_ahead"))
    joined = local.alias("a").join(carry.alias("b"), same("a", "b", [*keys, "_block"]))
    found = joined.select("a._row", "a._t", F.coalesce("a._before", "b._behind").alias("_before"), F.coalesce("a._after", "b._ahead").alias("_after"))
    earlier = F.col("_after").isNull() | (time - F.col("_before._t") <= F.col("_after._t") - time)
    near = found.withColumn("_near", F.when(is_number(time), F.when(earlier, F.col("_before")).otherwise(F.col("_after"))))
    return near.select("_row.*", F.col("_near._t").alias("matched_at"), *[F.col(f"_near._add.{c}").alias(c) for c in add])


def padded_frames(frames: DataFrame, events: DataFrame, pad_s: float, event_id: str, frame_key: Sequence[str], keys: Sequence[str] = TRACK, time: str = "et", start: str = "t0", end: str = "t1", bucket_s: float = 60.0) -> DataFrame:
    """Frames within ``pad_s`` of an event, both ends included, each once: as target of an event if it lies in one.

    Of several events the one a frame is a target of wins, then the smaller ``event_id``. Adds it and ``is_target``.
    """
    keys = list(keys)
    wide = clipped(events.select(*keys, start, end, event_id), frames, keys, time, F.col(start) - pad_s, F.col(end) + pad_s)
    wide = wide.withColumn("_bucket", F.explode(_buckets(F.col("_low"), F.col("_high"), bucket_s)))
    narrow = frames.withColumn("_bucket", F.floor(F.col(time) / F.lit(bucket_s)).cast("long"))
    at, a, b = F.col(f"f.{time}"), F.col(f"e.{start}"), F.col(f"e.{end}")
    met = narrow.alias("f").join(wide.alias("e"), same("f", "e", [*keys, "_bucket"]) & (at >= a - pad_s) & (at <= b + pad_s))
    target = (at >= a) & (at <= b)
    best = met.groupBy(*[F.col(f"f.{c}") for c in frame_key]).agg(F.min(F.struct((~target).alias("out"), F.col(f"e.{event_id}").alias("event"))).alias("best"))
    return best.select(*frame_key, F.col("best.event").alias(event_id), (~F.col("best.out")).alias("is_target"))
