"""Summaries of bouts, positions and directions: the tables behind the plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import text
from trackloom.operators.islands import event_ids, with_previous
from trackloom.operators.tracks import TRACK, group_quantiles, ordered, same, with_key
from trackloom.plans.staging import stage


def duration_summary(df: DataFrame, sets: dict[str, Column], duration: Column) -> DataFrame:
    """``n, shortest, median, longest`` of durations per named set; a row may be in several sets."""
    named = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in sets.items()]))
    rows = df.select(duration.alias("d"), F.explode(named).alias("tag_set"))
    ends = rows.groupBy("tag_set").agg(F.count("*").alias("n"), F.min("d").alias("shortest"), F.max("d").alias("longest"))
    middle = group_quantiles(rows, ["tag_set"], ["d"]).withColumnRenamed("d", "median")
    return ends.join(middle, "tag_set", "left").select("tag_set", "n", "shortest", "median", "longest")


def track_summary(df: DataFrame, value: str, keys: Sequence[str] = TRACK) -> DataFrame:
    """Mean, deviation and median of a value per track, and transforms of the mean."""
    v = F.col(value).cast("double")
    out = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.median(v).alias("median"), F.count(v).alias("n"))
    return out.withColumns({"log_mean": F.log(F.col("mean") + 1e-3), "cbrt_mean": F.cbrt("mean")})


def hurdle(per_track: DataFrame, value: str = "mean", by: Sequence[str] = ("source",)) -> DataFrame:
    """Share of tracks above 0 in percent, and quartiles of those."""
    # written, since the quantiles read it more than once
    held, _ = stage(per_track.select(*by, F.col(value).alias("_value")), "hurdle")
    above = F.col("_value") > 0
    out = held.groupBy(*by).agg((F.avg(above.cast("double")) * 100).alias("percent_above"), F.count("*").alias("n"))
    positive = held.where(above)
    for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
        found = group_quantiles(positive, by, ["_value"], p)
        out = out.alias("a").join(found.alias("b"), same("a", "b", by), "left").select("a.*", F.col("b._value").alias(name))
    return out.select(*by, "percent_above", "q1", "median", "q3", "n")


def mean_interval(per_track: DataFrame, value: str = "mean", by: Sequence[str] = ("source",), z: float = 1.96) -> DataFrame:
    """Mean with a normal interval; no bounds for a single value."""
    half = z * F.stddev_samp(value) / F.sqrt(F.count(value))
    return per_track.groupBy(*by).agg(F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"), F.count(value).alias("n"))


def bout_table(df: DataFrame, value: str = "prediction", gap_s: float | None = None, order: str = "frame", time: str = "et") -> DataFrame:
    """Bouts of 1 per track with the row before and after: ``first, last, t0, t1, n, duration, x0, y0``."""
    rows = event_ids(df, [value], gap_s, TRACK, time, order)
    bouts = rows.where(F.col(value) == 1).groupBy(*TRACK, "event_id").agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.min(time).alias("t0"), F.max(time).alias("t1"), F.count("*").alias("n"), F.min_by("x", order).alias("x0"), F.min_by("y", order).alias("y0")
    )
    return bouts.withColumn("duration", F.col("t1") - F.col("t0"))


def bout_counts(frames: DataFrame, bouts: DataFrame, most: int = 4) -> DataFrame:
    """Share of tracks of each source by their number of bouts, ``most`` and above together."""
    per = frames.select(*TRACK).distinct().join(bouts.groupBy(*TRACK).agg(F.count("*").alias("k")), TRACK, "left").withColumn("k", F.coalesce("k", F.lit(0)))
    label = F.when(F.col("k") >= most, f"{most}+").otherwise(F.col("k").cast("string"))
    counted = per.groupBy("source", label.alias("bouts")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("source")))


def latency(frames: DataFrame, bouts: DataFrame, time: str = "et") -> DataFrame:
    """Seconds from a track's first row to its first bout; tracks without bouts have none."""
    begins = frames.groupBy(*TRACK).agg(F.min(time).alias("begin"))
    return bouts.groupBy(*TRACK).agg(F.min("t0").alias("first_bout")).join(begins, TRACK).select(*TRACK, (F.col("first_bout") - F.col("begin")).alias("latency"))


def ecdf(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with the share of rows at or below them, counted per distinct value first."""
    counted = with_key(df.where(F.col(value).isNotNull()), list(by)).groupBy("_k", value).agg(F.count("*").alias("n"))
    cut = ordered(counted, F.col("_k"), F.col(value), name="ecdf")
    every = Window.partitionBy("_k")
    ahead = F.coalesce(F.sum("_n").over(every.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = cut.groupBy("_k", "_b").agg(F.sum("n").alias("_n")).select("_k", "_b", ahead.alias("_ahead"), F.sum("_n").over(every).alias("_all"))
    upto = F.sum("n").over(Window.partitionBy("_k", "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    joined = cut.withColumn("_upto", upto).join(ranges, ["_k", "_b"])
    return joined.select(*[F.col(f"_k.{c}").alias(c) for c in by], value, ((F.col("_upto") + F.col("_ahead")) / F.col("_all")).alias("share"))


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """Number of the bin from 0; the right edge belongs to the last bin; null outside."""
    cell = F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1))
    return F.when((value >= low) & (value <= high), cell).cast("int")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """``bin, n`` of the bins that hold something."""
    return df.withColumn("bin", bin_of(F.col(value), low, high, bins)).where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count("*").alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, low: float, high: float, bins: int = 30, by: Sequence[str] = (), least: int = 10) -> DataFrame:
    """``bx, by, n`` of the cells that hold something, for groups of more than ``least`` rows."""
    cells = df.withColumns({"bx": bin_of(F.col(x), low, high, bins), "by": bin_of(F.col(y), low, high, bins)}).where("bx IS NOT NULL AND by IS NOT NULL")
    counted = cells.groupBy(*by, "bx", "by").agg(F.count("*").alias("n"))
    return counted.withColumn("_all", F.sum("n").over(Window.partitionBy(*by))).where(F.col("_all") > least).drop("_all")


def density(df: DataFrame, value: str, low: float, high: float, points: int = 50, by: Sequence[str] = ("source",), narrow: float = 0.7, cells: int = 400) -> DataFrame:
    """Gaussian kernel density on a grid, bandwidth by Scott's rule times ``narrow``: ``point, density``.

    Values are counted in fine cells first, so the work per group is cells times points, whatever the rows.
    """
    by, width = list(by), (high - low) / cells
    rows = df.where(F.col(value).between(low, high))
    counted = rows.groupBy(*by, bin_of(F.col(value), low, high, cells).alias("cell")).agg(F.count("*").alias("n"))
    scale = rows.groupBy(*by).agg((F.stddev_samp(value) * F.pow(F.count("*"), F.lit(-0.2)) * narrow).alias("h"), F.count("*").alias("total"))
    grid = F.sequence(F.lit(0), F.lit(points - 1))
    spread = counted.join(scale, by).where("h > 0").withColumn("i", F.explode(grid))
    point = F.lit(low) + F.col("i") * ((high - low) / (points - 1))
    off = (point - (F.lit(low) + (F.col("cell") + 0.5) * width)) / F.col("h")
    kernel = F.exp(-off * off / 2) / (F.col("h") * (2 * F.lit(3.141592653589793)) ** 0.5)
    return spread.groupBy(*by, point.alias("point")).agg((F.sum(F.col("n") * kernel) / F.first("total")).alias("density"))


def spatial_mean(df: DataFrame, position: str, value: str, width: float = 10.0, by: Sequence[str] = ("source",)) -> DataFrame:
    """Mean of a value by position bins, named by their centres."""
    centre = F.floor(F.col(position) / width) * width + width / 2
    return df.where(F.col(position).isNotNull()).groupBy(*by, centre.alias("centre")).agg(F.avg(F.col(value).cast("double")).alias("mean"), F.count("*").alias("n"))


def wrapped(angle: Column) -> Column:
    """An angle brought to [-pi, pi)."""
    return F.pmod(angle + F.pi(), 2 * F.pi()) - F.pi()


def turn_dynamics(df: DataFrame, heading: str, value: str = "prediction", order: str = "frame", time: str = "et") -> DataFrame:
    """Heading in the row before and after each bout: ``before, after, turn, size, gain, x0``.

    ``gain`` is how much nearer the heading comes to direction 0. Bouts at the ends of a track have no neighbour and
    are left out, as are missing headings.
    """
    rows = event_ids(df, [value], None, TRACK, time, order)
    here = rows.groupBy(*TRACK, "event_id").agg(F.first(value).alias(value), F.min_by(heading, order).alias("head_first"), F.max_by(heading, order).alias("head_last"), F.min_by("x", order).alias("x0"))
    linked = with_previous(here, ["head_last", value], TRACK, "event_id")
    following = here.select(*TRACK, (F.col("event_id") - 1).alias("event_id"), F.col("head_first").alias("after"))
    both = linked.where(F.col(value) == 1).select(*TRACK, "event_id", F.col("prev.head_last").alias("before"), "x0").join(following, [*TRACK, "event_id"])
    kept = both.where(F.col("before").isNotNull() & F.col("after").isNotNull())
    turn = wrapped(F.col("after") - F.col("before"))
    return kept.select(*TRACK, "event_id", "before", "after", turn.alias("turn"), F.abs(turn).alias("size"), (F.abs(wrapped(F.col("before"))) - F.abs(wrapped(F.col("after")))).alias("gain"), "x0")


def track_range(df: DataFrame, q: float = 0.75, stretch: float = 1.25) -> DataFrame:
    """A quantile over tracks of the wider of their x and y ranges, stretched: ``span``."""
    per = df.groupBy(*TRACK).agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("range"))
    return group_quantiles(per, [], ["range"], q).select((F.col("range") * stretch).alias("span"))


def pivot_counts(df: DataFrame, by: Sequence[str], column: str, values: Sequence[str], share: bool = False) -> DataFrame:
    """Counts of each value per group as columns, or their shares in percent."""
    wide = df.groupBy(*by).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    if not share:
        return wide
    total = sum((F.col(v) for v in values), F.lit(0))
    return wide.select(*by, *[F.try_divide(F.col(v) * 100.0, total).alias(v) for v in values])


def event_windows(events: DataFrame, pad_s: float = 35.0, start: str = "t0", end: str = "t1") -> DataFrame:
    """Adds ``w0`` and ``w1``: ``pad_s`` around each event, cut at the end of the one before and the start of the next."""
    # both neighbours, block by block of the starts; rows that start together are told apart by their ends
    cut = ordered(with_key(events, TRACK), F.col("_k"), F.col(start), F.col(end), name="windows")
    inside = Window.partitionBy("_k", "_b").orderBy(start, end)
    over = Window.partitionBy("_k").orderBy("_b")
    ends = cut.groupBy("_k", "_b").agg(F.min(F.struct(start, end)).alias("_f"), F.max(F.struct(start, end)).alias("_l"))
    beside = ends.select("_k", "_b", F.lag(F.col(f"_l.{end}")).over(over).alias("_p"), F.lead(F.col(f"_f.{start}")).over(over).alias("_q"))
    local = cut.withColumns({"_before": F.lag(end).over(inside), "_after": F.lead(start).over(inside)}).join(beside, ["_k", "_b"])
    near = local.withColumns({"w0": F.greatest(F.col(start) - pad_s, F.coalesce("_before", "_p")), "w1": F.least(F.col(end) + pad_s, F.coalesce("_after", "_q"))})
    return near.select(*events.columns, "w0", "w1")


def tag_tallies(labels: DataFrame, behavior: str = "behavior", tags: str = "tags") -> DataFrame:
    """Intervals by main behaviour and tag: ``behavior, tag, n``; those without a tag count as ``(no tag)``."""
    tokens = text.tag_tokens(F.col(tags))
    each = labels.select(F.coalesce(text.main_behavior(F.col(behavior)), F.lit("other")).alias("behavior"), F.explode(F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit("(no tag)")))).alias("tag"))
    return each.groupBy("behavior", "tag").agg(F.count("*").alias("n"))


def most_frequent(df: DataFrame, value: str, keys: Sequence[str] = TRACK) -> DataFrame:
    """The most frequent value of each group, the smallest of equals, and how often it occurs."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = counted.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(value))).alias("b"))
    return best.select(*keys, F.col(f"b.{value}").alias(value), (-F.col("b.k")).alias("n"))


def retention(raw: DataFrame, fed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of each group before and after a selection, and the share kept."""
    there = raw.groupBy(*by).agg(F.count("*").alias("raw"))
    kept = fed.groupBy(*by).agg(F.count("*").alias("fed"))
    both = there.join(kept, list(by), "left").withColumn("fed", F.coalesce("fed", F.lit(0)))
    return both.withColumn("share", F.col("fed") / F.col("raw"))
