"""Tracks: frame tables, windows over rows of a track, and quantiles of groups, all without whole tracks in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trackloom.operators.frames import FPS, frame_number, need
from trackloom.plans.staging import stage

TRACK = ["source", "ID"]
SPINE = [f"{axis}spine_{i}" for i in range(11) for axis in "xy"]
COORDS = ["x", "y", *SPINE]


def same(a: str, b: str, keys: Sequence[str]) -> Column:
    """Null-safe equality of the keys of two aliased tables."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def clean_rows(df: DataFrame, coords: Sequence[str] = COORDS, fps: float = FPS, limit: float = 1000.0) -> DataFrame:
    """Rows with a usable time: ``source, ID, frame, off, et`` and the coordinates; ``off`` is the distance to the beat.

    NaN, infinite and absurd coordinates (``limit`` or more from the origin) become null.
    """
    need(df, [*TRACK, "et", *coords])
    number = lambda c: f"CASE WHEN abs(CAST({c} AS DOUBLE)) < {float(limit)!r}D THEN CAST({c} AS DOUBLE) END AS {c}"  # noqa: E731 - NaN is larger than any limit
    rows = df.selectExpr(*TRACK, "CAST(et AS DOUBLE) AS et", *[number(c) for c in coords])
    rows = rows.withColumn("frame", frame_number(F.col("et"), fps)).where(F.col("frame").isNotNull())
    return rows.select(*TRACK, "frame", F.abs(F.col("et") * fps - F.col("frame")).alias("off"), "et", *coords)


def frame_table(df: DataFrame, coords: Sequence[str] = COORDS, fps: float = FPS, limit: float = 1000.0) -> DataFrame:
    """One row per track and frame: ``source, ID, frame, et`` and the coordinates, cleaned by :func:`clean_rows`.

    Of several rows of a frame the one nearest to the beat counts, then the earliest, then the smallest coordinates,
    null before any.
    """
    best = F.min(F.struct("off", "et", *coords)).alias("r")
    return clean_rows(df, coords, fps, limit).groupBy(*TRACK, "frame").agg(best).select(*TRACK, "frame", "r.et", *[f"r.{c}" for c in coords])


def with_key(df: DataFrame, keys: Sequence[str], order: str | None = None, block: int = 8192) -> DataFrame:
    """Adds ``_k``, the keys as one value that is never null, and with ``order`` the ``_block`` of the row.

    Windows, groups and joins on ``_k`` and the block share one shuffle, also where keys are null.
    """
    out = df.withColumn("_k", F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all")))
    return out if order is None else out.withColumn("_block", F.floor(F.col(order) / F.lit(block)))


def ordered(df: DataFrame, *order: Column, name: str = "ordered") -> DataFrame:
    """``df`` cut into ranges of the given order, numbered by ``_b``; written, so that every reader sees the same cuts.

    Running values over all rows are taken inside the ranges and carried over one row per range. Spark samples the
    order for cuts of like size, as many as its shuffles have partitions, so ranges don't outgrow a task.
    """
    return stage(df.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()), name)[0]


def row_shards(df: DataFrame, keys: Sequence[str] = TRACK, order: str = "frame", rows: int = 20_000, margin: int = 1_000, block: int = 8192) -> DataFrame:
    """Cut long tracks into shards of ``rows`` rows with ``margin`` rows of their neighbours on both sides.

    Adds ``idx`` (the row's number in its track from 0), ``shard``, ``core`` (whether the row belongs to the shard or to
    its margin) and ``_k``. Rows are numbered by blocks of the order column and a prefix scan over the blocks' row counts.
    """
    blocked = with_key(df, keys, order, block)
    inside = Window.partitionBy("_k", "_block").orderBy(order)
    flat = numbered_rows(blocked.withColumn("_rn", F.row_number().over(inside)), blocked.groupBy("_k", "_block").agg(F.count("*").alias("_n")))
    return spread_shards(flat.drop("_block", "_rn"), rows, margin)


def numbered_rows(local: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``idx`` to rows numbered inside blocks (``_k, _block, _rn`` from 1), by a prefix scan of the blocks' counts ``_n``."""
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("*", ahead.alias("_ahead")).drop("_n")
    return local.join(offsets, ["_k", "_block"]).withColumn("idx", F.col("_ahead") + F.col("_rn") - 1).drop("_ahead")


def spread_shards(flat: DataFrame, rows: int, margin: int) -> DataFrame:
    """Copies numbered rows to each ``shard`` whose rows or margin they are in; adds ``core``."""
    home = F.floor(F.col("idx") / F.lit(rows))
    near = F.array_distinct(F.array(home, F.floor((F.col("idx") - margin) / F.lit(rows)), F.floor((F.col("idx") + margin) / F.lit(rows))))
    spread = flat.select("*", home.alias("_home"), F.explode(F.filter(near, lambda s: s >= 0)).alias("shard"))
    return spread.withColumn("core", F.col("_home") == F.col("shard")).drop("_home")


def shard_window(order: str = "idx") -> WindowSpec:
    return Window.partitionBy("_k", "shard").orderBy(order)


def core(df: DataFrame) -> DataFrame:
    """Without the margins."""
    return df.where("core").drop("core", "shard", "idx", "_k")


def group_quantiles(df: DataFrame, keys: Sequence[str], values: Sequence[str], q: float = 0.5, bins: int = 20, span: float = 0.05) -> DataFrame:
    """Exact quantiles (linear between neighbours) of the non-null values of each group: ``keys`` and ``values``.

    A merged KLL sketch per group gives cut points within ``span`` of the wanted rank. One pass counts values between
    them; in the cells that hold the wanted ranks distinct values are then counted and sorted. So no task sorts a whole
    group; where a sketch is off, a cell is larger, but the result stays exact. ``df`` is read three times.
    """
    keys = list(keys)
    pair = [F.struct(F.lit(v).alias("_v"), F.col(v).cast("double").alias("_x")) for v in values]
    long = df.select(*keys, F.explode(F.array(*pair)).alias("_e")).select(*keys, "_e._v", "_e._x").where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    long = with_key(long, [*keys, "_v"]).select("_k", "_x")
    points = sorted({min(max(q + span * (2 * i / bins - 1), 0.0), 1.0) for i in range(bins + 1)})
    sketches = long.groupBy("_k").agg(F.kll_sketch_agg_double("_x").alias("_sketch"), F.count("*").alias("_n"))
    # written, since a sketch computed again may cut elsewhere
    cuts, _ = stage(sketches.select("_k", "_n", F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit(p) for p in points])).alias("_cuts")), "cuts")
    cell = sum((F.when(F.col("_x") >= F.get("_cuts", F.lit(i)), 1).otherwise(0) for i in range(len(points))), F.lit(0))
    binned = long.join(cuts, "_k").select("_k", "_x", "_n", cell.alias("_bin"))
    counts = binned.groupBy("_k").agg(F.first("_n").alias("_n"), F.array(*[F.count_if(F.col("_bin") == i) for i in range(len(points) + 1)]).alias("_c"))
    at = (F.col("_n") - 1) * F.lit(q)
    low, high = F.floor(at), F.ceil(at)
    # per cell the values before it; cells are few
    before = F.transform(F.sequence(F.lit(0), F.lit(len(points))), lambda b: F.struct(b.alias("_bin"), F.aggregate(F.slice("_c", F.lit(1), b), F.lit(0).cast("long"), lambda t, v: t + v).alias("_before"), F.get("_c", b).alias("_in")))
    wanted = counts.select("_k", F.explode(F.filter(before, lambda e: (e["_before"] <= high) & (e["_before"] + e["_in"] > low))).alias("_w")).select("_k", "_w._bin", "_w._before")
    held = binned.join(wanted, ["_k", "_bin"]).groupBy("_k", "_bin", "_x").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"), F.first("_before").alias("_before"))
    upto = F.sum("_c").over(Window.partitionBy("_k", "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = held.withColumn("_upto", F.col("_before") + upto).withColumn("_from", F.col("_upto") - F.col("_c"))
    picked = ranked.where(((F.col("_from") <= low) & (F.col("_upto") > low)) | ((F.col("_from") <= high) & (F.col("_upto") > high)))
    exact = picked.groupBy("_k").agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"), F.first(at - low).alias("_share"))
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share")
    found = exact.select(*[F.col(f"_k.{k}").alias(k) for k in keys], F.col("_k._v").alias("_v"), value.alias("_q"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_v") == v, F.col("_q"))).alias(v) for v in values])
