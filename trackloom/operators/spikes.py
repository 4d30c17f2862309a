"""Implausible spikes, stuck values and impossible readings in positions.

KLL quantile sketches of the coordinates and of the step lengths are built per source and hour in every partition and
merged into hours and sources; no other source has a say. Readings are judged against

* fences: a coordinate beyond the expanded interquartile fence of its source at its hour is impossible;
* rate of change: steps above the expanded fence of the source at that hour cut a track into segments, and a short
  segment that cannot be reached from the long segments beside it at that rate is an excursion;
* zero variance: positions that repeat exactly for ``stuck_s`` or longer are a standstill, all but its first frame.

Tracks are cut into time shards with a margin on both sides, so that no task needs a whole track.

Defined results: rows without a usable ``et`` are ignored; missing coordinates (null or NaN) are never flagged and
break nothing; of several rows of a frame one counts (nearest to the beat, then the smallest values), infinite
coordinates are impossible; tracks with null source or ID are judged like others; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.frames import FPS, frame_number, is_number, need

TRACK = ["source", "ID"]
POINTS = {"centroid": ("x", "y"), "head": ("xspine_0", "yspine_0")}
FINITE = 1e300


def _frames(df: DataFrame, fps: float) -> DataFrame:
    coords = [c for pair in POINTS.values() for c in pair]
    need(df, [*TRACK, "et", *coords])
    number = lambda c: F.when(is_number(F.col(c).cast("double")), F.greatest(F.least(F.col(c).cast("double"), F.lit(FINITE)), F.lit(-FINITE)))
    rows = df.select(*TRACK, F.col("et").cast("double").alias("et"), *[number(c).alias(c) for c in coords])
    rows = rows.withColumn("frame", frame_number(F.col("et"), fps)).where(F.col("frame").isNotNull())
    best = F.min(F.struct(F.abs(F.col("et") * fps - F.col("frame")).alias("off"), *[F.struct(F.col(a), F.col(b)).alias(p) for p, (a, b) in POINTS.items()]))
    return rows.groupBy(*TRACK, "frame").agg(best.alias("r")).select(*TRACK, "frame", *[f"r.{p}" for p in POINTS])


def points(df: DataFrame, fps: float = FPS) -> DataFrame:
    """One row per frame and point with a position: ``source, ID, frame, point, px, py``."""
    pairs = [F.struct(F.lit(p).alias("point"), F.col(f"{p}.{a}").alias("px"), F.col(f"{p}.{b}").alias("py")) for p, (a, b) in POINTS.items()]
    rows = _frames(df, fps).select(*TRACK, "frame", F.explode(F.array(*pairs)).alias("p")).select(*TRACK, "frame", "p.*")
    return rows.where(F.col("px").isNotNull() & F.col("py").isNotNull())


def _quartiles(sketch: str) -> Column:
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.array(F.lit(0.25), F.lit(0.75)))


def limits(stepped: DataFrame, fps: float, place_k: float, step_k: float, prior_tracks: float, reach_s: float) -> DataFrame:
    """``source, point, hour, x_low, x_high, y_low, y_high, step_high`` from sketches of that source alone.

    An hour's quartiles are drawn towards the source's as if ``prior_tracks`` more tracks of it had been there: frames of
    one track tell little about where others can be. A fence of places reaches at least as far beyond the quartiles as a
    brisk animal (the third quartile of steps) gets in ``reach_s``; that of steps is wider where steps are few.
    """
    hour = F.floor(F.col("frame") / F.lit(int(3600 * fps)))
    sketches = stepped.withColumn("hour", hour).groupBy("source", "point", "hour").agg(
        F.kll_sketch_agg_double("px").alias("xs"), F.kll_sketch_agg_double("py").alias("ys"), F.kll_sketch_agg_double(F.when(F.col("apart") == 1, F.col("step"))).alias("steps"), F.approx_count_distinct("ID").alias("tracks")
    )
    merged = sketches.groupBy("source", "point").agg(*[F.kll_merge_agg_double(c).alias(c) for c in ("xs", "ys", "steps")])
    some = lambda: F.kll_sketch_get_n_double(F.col("steps")) > 0
    quartiles = [_quartiles("xs").alias("x"), _quartiles("ys").alias("y"), F.when(some(), _quartiles("steps")).alias("step")]
    hours = sketches.select("source", "point", "hour", "tracks", F.struct(*quartiles).alias("h"))
    sources = merged.select("source", "point", F.struct(*quartiles, F.kll_sketch_get_n_double(F.col("steps")).alias("n")).alias("s"))
    both = hours.alias("a").join(sources.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.point") == F.col("b.point"))).select("a.*", "b.s")
    own = F.col("tracks") / (F.col("tracks") + F.lit(prior_tracks))
    drawn = lambda c, i: own * F.coalesce(F.get(f"h.{c}", F.lit(i)), F.get(f"s.{c}", F.lit(i))) + (1 - own) * F.get(f"s.{c}", F.lit(i))
    reach = F.coalesce(drawn("step", 1), F.lit(0.0)) * F.lit(reach_s * fps)
    width = lambda c: F.greatest(F.lit(place_k) * (drawn(c, 1) - drawn(c, 0)), reach)
    few = 1 + 5 / F.sqrt(F.greatest(F.col("s.n"), F.lit(1)))
    return both.select(
        "source", "point", "hour", *[e for c in "xy" for e in ((drawn(c, 0) - width(c)).alias(f"{c}_low"), (drawn(c, 1) + width(c)).alias(f"{c}_high"))],
        (drawn("step", 1) + F.lit(step_k) * few * (drawn("step", 1) - drawn("step", 0))).alias("step_high"),
    )


def implausible_frames(
    df: DataFrame, fps: float = FPS, place_k: float = 3.0, step_k: float = 6.0, stuck_s: float = 1.0, excursion_frames: int = 7,
    break_frames: int = 60, shard_frames: int = 4096, margin: int = 96, prior_tracks: float = 8.0, reach_s: float = 60.0,
) -> DataFrame:
    """Flagged frames with the reasons: ``source, id, frame, reasons`` (of ``impossible``, ``excursion``, ``stuck``).

    ``place_k`` and ``step_k`` expand the interquartile fences of places and steps, ``prior_tracks`` and ``reach_s`` steady
    them (see :func:`limits`); ``excursion_frames`` is the longest segment that can be an excursion; readings more than
    ``break_frames`` apart aren't compared; ``margin`` frames of the neighbouring shards are copied to each shard.
    """
    shard = F.floor(F.col("frame") / F.lit(shard_frames))
    near = F.array_distinct(F.array(shard, F.floor((F.col("frame") - margin) / F.lit(shard_frames)), F.floor((F.col("frame") + margin) / F.lit(shard_frames))))
    rows = points(df, fps).select("*", shard.alias("home"), F.explode(near).alias("shard"))
    place = [*TRACK, "point", "shard"]
    inside = Window.partitionBy(*place).orderBy("frame")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = lambda c: F.lag(c).over(inside)
    distance = lambda a, b: F.sqrt((a["px"] - b["px"]) * (a["px"] - b["px"]) + (a["py"] - b["py"]) * (a["py"] - b["py"]))
    step = F.sqrt((F.col("px") - before("px")) * (F.col("px") - before("px")) + (F.col("py") - before("py")) * (F.col("py") - before("py")))
    stepped = rows.withColumn("apart", F.col("frame") - before("frame")).withColumn("step", step)
    known = limits(stepped.where(F.col("home") == F.col("shard")), fps, place_k, step_k, prior_tracks, reach_s)
    hour = F.floor(F.col("frame") / F.lit(int(3600 * fps)))
    with_limits = stepped.withColumn("hour", hour).alias("r").join(
        known.alias("k"), F.col("r.source").eqNullSafe(F.col("k.source")) & (F.col("r.point") == F.col("k.point")) & (F.col("r.hour") == F.col("k.hour")), "left"
    ).select("r.*", "x_low", "x_high", "y_low", "y_high", "step_high")
    allowed = lambda apart: F.col("step_high") * (1 + 0.5 * (apart - 1))
    outside = (F.col("px") < F.col("x_low")) | (F.col("px") > F.col("x_high")) | (F.col("py") < F.col("y_low")) | (F.col("py") > F.col("y_high"))
    breaks = F.col("apart").isNull() | (F.col("apart") > break_frames)
    cut = F.coalesce(breaks | (F.col("step") > allowed(F.col("apart"))), F.lit(True))
    still = int(stuck_s * fps)
    repeats = F.coalesce((F.col("step") == 0) & (F.col("apart") <= still), F.lit(False))
    marked = with_limits.select("*", F.coalesce(outside, F.lit(False)).alias("impossible"), breaks.alias("breaks"), cut.alias("cut"), repeats.alias("repeats"), F.row_number().over(inside).alias("at"))
    numbered = marked.select(
        "*", F.sum(F.col("cut").cast("int")).over(so_far).alias("seg"), F.sum(F.col("breaks").cast("int")).over(so_far).alias("recording"),
        (F.col("at") - F.last(F.when(F.col("cut"), F.col("at")), True).over(so_far)).alias("in_seg"), F.last(F.when(~F.col("repeats"), F.col("frame")), True).over(so_far).alias("rest_from"),
    )
    # a standstill is long enough if this row or one of the next ones of it is late enough; those are few rows ahead
    long_rest = F.col("frame") - F.col("rest_from") >= still
    for k in range(1, still + 1):
        later = F.lead(F.struct("rest_from", "frame"), k).over(inside)
        long_rest = long_rest | F.coalesce((later["rest_from"] == F.col("rest_from")) & (later["frame"] - F.col("rest_from") >= still), F.lit(False))
    rested = numbered.withColumn("stuck", F.col("repeats") & F.coalesce(long_rest, F.lit(False)))
    # segments once, with the rows that may be flagged: no more than a shard has
    spot = F.struct("recording", "frame", "px", "py")
    here, plain = F.col("home") == F.col("shard"), ~F.col("impossible")
    shown = here & (F.col("impossible") | F.col("stuck") | (F.col("in_seg") < excursion_frames))
    segments = rested.groupBy(*place, "seg").agg(
        (F.count("*") > excursion_frames).alias("long"), F.min(spot).alias("head"), F.max(spot).alias("tail"), F.min(F.when(plain, spot)).alias("first"), F.max(F.when(plain, spot)).alias("last"),
        F.first("step_high").alias("step_high"), F.collect_list(F.when(shown, F.struct("frame", "impossible", "stuck"))).alias("shown"),
    )
    order = Window.partitionBy(*place)
    behind = F.last(F.when(F.col("long"), F.col("last")), True).over(order.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.last(F.when(F.col("long"), F.col("first")), True).over(order.orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, -1))

    def reach(end: str, side: str) -> Column:
        apart = F.abs(F.col(f"{end}.frame") - F.col(f"{side}.frame"))
        close = (F.col(f"{side}.recording") == F.col(f"{end}.recording")) & (apart <= break_frames)
        return F.when(close, distance(F.col(end), F.col(side)) <= allowed(apart))

    # the ends of a short segment are held against the long segments beside it
    anchored = segments.withColumns({"behind": behind, "ahead": ahead})
    reached = F.greatest(reach("head", "behind"), reach("tail", "ahead"))
    judged = anchored.where(F.size("shown") > 0).select(*place, F.explode("shown").alias("f"), (~F.col("long") & ~F.coalesce(reached, F.lit(True))).alias("excursion"))
    flags = judged.select(*TRACK, "f.*", "excursion")
    reasons = F.array_compact(F.array(*[F.when(F.col(r), F.lit(r)) for r in ("impossible", "excursion", "stuck")]))
    flagged = flags.where(reduce(lambda a, b: a | b, [F.col("impossible"), F.col("excursion"), F.col("stuck")]))
    return flagged.groupBy(*TRACK, "frame").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(reasons)))).alias("reasons")).select("source", F.col("ID").alias("id"), "frame", "reasons")
