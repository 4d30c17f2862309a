"""Gaps and islands: events, runs, segments and their clean-up.

Rows of a track are compared with the row before them inside blocks of the order column; the last row of the block
before is carried in by a prefix scan over the blocks. Later steps work on runs, which are far fewer than rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.tracks import TRACK, with_key
from trackloom.plans.staging import stage


def _carried(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows with ``prev`` inside their block, and per block its first row (flat), ``prev`` from the block before and ``_last``."""
    rows = with_key(df, keys, order, block)
    row = F.struct(*columns)
    local = rows.withColumn("prev", F.lag(row).over(Window.partitionBy("_k", "_block").orderBy(order)))
    at = lambda pick: pick(F.struct(F.col(order).alias("_o"), row.alias("_r")))
    ends = local.groupBy("_k", "_block").agg(at(F.min).alias("_first"), at(F.max).alias("_last"))
    heads = ends.select("_k", "_block", "_first._r.*", F.lag("_last._r").over(Window.partitionBy("_k").orderBy("_block")).alias("prev"))
    return local, heads


def with_previous(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = TRACK, order: str = "frame", block: int = 8192) -> DataFrame:
    """Adds ``prev``, a struct of ``columns`` of the row before in the track."""
    local, heads = _carried(df, columns, keys, order, block)
    joined = local.alias("a").join(heads.select("_k", "_block", F.col("prev").alias("_carry")).alias("b"), ["_k", "_block"])
    return joined.select(*[f"a.{c}" for c in df.columns], F.coalesce("a.prev", "_carry").alias("prev"))


def numbered(df: DataFrame, columns: Sequence[str], opens: Column, name: str = "event_id", keys: Sequence[str] = TRACK, order: str = "frame", block: int = 8192) -> DataFrame:
    """Numbers from 1 in each track, one more at each row that ``opens``; a null opens too.

    ``opens`` is over ``columns`` of the row and ``prev``, those of the row before (null for a track's first). Rows are
    shuffled once: a block's own count leaves out its first row, which is judged when the blocks' ends have met.
    """
    columns = list(dict.fromkeys(columns))
    local, heads = _carried(df, columns, keys, order, block)
    flag = F.coalesce(opens, F.lit(True)).cast("long")
    counted = local.withColumn("_opens", F.when(F.row_number().over(Window.partitionBy("_k", "_block").orderBy(order)) == 1, 0).otherwise(flag))
    inside = Window.partitionBy("_k", "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counts = counted.groupBy("_k", "_block").agg(F.sum("_opens").alias("_n"))
    judged = heads.select("_k", "_block", flag.alias("_open")).join(counts, ["_k", "_block"])
    before = Window.partitionBy("_k").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = judged.select("_k", "_block", (F.coalesce(F.sum(F.col("_n") + F.col("_open")).over(before), F.lit(0)) + F.col("_open")).alias("_ahead"))
    joined = counted.withColumn("_local", F.sum("_opens").over(inside)).alias("a").join(offsets.alias("b"), ["_k", "_block"])
    return joined.select(*[f"a.{c}" for c in df.columns], (F.col("a._local") + F.col("b._ahead")).alias(name))


def _event_opens(alike: Sequence[str], gap_s: float | None, time: str, null_breaks: bool = False) -> Column:
    changed = F.col("prev").isNull()
    for c in alike:
        differs = ~F.col(c).eqNullSafe(F.col(f"prev.{c}"))
        changed = changed | (differs | F.col(c).isNull() if null_breaks else differs)
    return changed if gap_s is None else changed | F.coalesce(F.col(time) - F.col(f"prev.{time}") > gap_s, F.lit(True))


def event_ids(df: DataFrame, alike: Sequence[str], gap_s: float | None = 0.5, keys: Sequence[str] = TRACK, time: str = "et", order: str = "frame", null_breaks: bool = False, block: int = 8192) -> DataFrame:
    """Adds ``event_id``: a new event where a column of ``alike`` changes or the time step is longer than ``gap_s``.

    Two nulls are alike unless ``null_breaks``.
    """
    return numbered(df, [*alike, time], _event_opens(alike, gap_s, time, null_breaks), "event_id", keys, order, block)


def runs(df: DataFrame, value: str, gap_s: float | None = 0.5, keys: Sequence[str] = TRACK, time: str = "et", order: str = "frame") -> DataFrame:
    """Runs of equal values: ``keys, event_id, value, first, last, t0, t1, n``."""
    return event_ids(df, [value], gap_s, keys, time, order).groupBy(*keys, "event_id").agg(
        F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.min(time).alias("t0"), F.max(time).alias("t1"), F.count("*").alias("n")
    )


def _joined(table: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Runs of equal values that follow each other in one segment, joined."""
    w = Window.partitionBy(*keys, "segment").orderBy("first")
    opens = F.coalesce(F.lag(value).over(w) != F.col(value), F.lit(True)).cast("int")
    part = table.withColumn("_o", opens).withColumn("_p", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy(*keys, "segment", "_p").agg(F.first(value).alias(value), F.min("first").alias("first"), F.max("last").alias("last"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("n").alias("n")).drop("_p")


def close_and_open(df: DataFrame, value: str, close: int | Column, open_: int | Column, gap_s: float | None = 0.5, keys: Sequence[str] = TRACK, time: str = "et", order: str = "frame") -> DataFrame:
    """Runs of a 0/1 column after closing inner 0-runs shorter than ``close`` rows and dropping 1-runs shorter than ``open_``.

    0-runs at the ends of a segment (a stretch without a longer time step) stay; sizes up to 1 do nothing. Null counts
    as 0. Columns as of :func:`runs`, with ``segment``. Sizes may be expressions over the keys.
    """
    keys = list(keys)
    flat = df.select(*keys, order, time, F.coalesce(F.col(value).cast("int"), F.lit(0)).alias(value))
    # written, since the next step reads it more than once
    in_segments, _ = stage(numbered(flat, [time], _event_opens([], gap_s, time), "segment", keys, order), "segments")
    first = event_ids(in_segments, [value, "segment"], None, keys, time, order).groupBy(*keys, "segment", "event_id").agg(
        F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.min(time).alias("t0"), F.max(time).alias("t1"), F.count("*").alias("n")
    )
    w = Window.partitionBy(*keys, "segment").orderBy("first")
    inner = F.lag(value).over(w).isNotNull() & F.lead(value).over(w).isNotNull()
    closed = _joined(first.withColumn(value, F.when((F.col(value) == 0) & inner & (F.col("n") < close), 1).otherwise(F.col(value))), value, keys)
    opened = closed.withColumn(value, F.when((F.col(value) == 1) & (F.col("n") < open_), 0).otherwise(F.col(value)))
    return _joined(opened, value, keys)


def hysteresis(df: DataFrame, prob: str, on: float | Column, off: float | Column, out: str = "state", keys: Sequence[str] = TRACK, order: str = "frame", block: int = 8192) -> DataFrame:
    """Adds a 0/1 state: it goes on at ``prob >= on`` and off at ``prob <= off``; it starts off; null keeps it.

    Where both hold (``on <= prob <= off``) the state turns over at every row. Needs rows of one segment per key. A
    block of rows is summed up by the turns in it and the last forced state; a scan over the blocks carries them on.
    """
    high, low = F.coalesce(F.col(prob) >= on, F.lit(False)), F.coalesce(F.col(prob) <= off, F.lit(False))
    forced = F.when(high & ~low, 1).when(low & ~high, 0)
    rows = with_key(df, keys, order, block).withColumns({"_turn": (high & low).cast("long"), "_set": forced})
    inside = Window.partitionBy("_k", "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_turns", F.sum("_turn").over(inside))
    local = local.withColumn("_last", F.last(F.when(F.col("_set").isNotNull(), F.struct("_set", "_turns")), True).over(inside))
    # a block's forced state with the turns after it, and its turns
    ends = local.groupBy("_k", "_block").agg(F.max_by("_last", order).alias("_l"), F.sum("_turn").alias("_all"))
    before = Window.partitionBy("_k").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_ahead", F.coalesce(F.sum("_all").over(before), F.lit(0)))
    placed = F.when(F.col("_l").isNotNull(), F.struct(F.col("_l._set").alias("_set"), (F.col("_l._turns") + F.col("_ahead")).alias("_turns")))
    carry = ends.withColumn("_placed", placed).withColumn("_carry", F.last("_placed", True).over(before)).select("_k", "_block", "_ahead", "_carry")
    joined = local.alias("a").join(carry.alias("b"), ["_k", "_block"])
    turns = F.col("a._turns") + F.col("b._ahead")
    own = F.col("a._last").isNotNull()
    state = F.when(own, F.col("a._last._set")).otherwise(F.coalesce("b._carry._set", F.lit(0)))
    since = F.when(own, F.col("a._turns") - F.col("a._last._turns")).otherwise(turns - F.coalesce("b._carry._turns", F.lit(0)))
    return joined.select(*[f"a.{c}" for c in df.columns], ((state + since) % 2).cast("int").alias(out))


def initiations(df: DataFrame, value: str, keys: Sequence[str] = TRACK, order: str = "frame") -> DataFrame:
    """Rows where a 0/1 column goes from 0 to 1; a track's first row never counts."""
    linked = with_previous(df, [value], keys, order)
    return linked.where((F.col(value) == 1) & (F.col(f"prev.{value}") == 0)).drop("prev")


def filled(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = TRACK, order: str = "frame", block: int = 8192) -> DataFrame:
    """Nulls filled from the last value before in the track, then the first one after, then 0."""
    blocked = with_key(df, keys, order, block)
    ends = blocked.groupBy("_k", "_block").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_l_{c}") for c in columns], *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_f_{c}") for c in columns]
    )
    over = Window.partitionBy("_k")
    back, on = over.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1), over.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("_k", "_block", *[F.last(f"_l_{c}", True).over(back).alias(f"_b_{c}") for c in columns], *[F.last(f"_f_{c}", True).over(on).alias(f"_a_{c}") for c in columns])
    inside = Window.partitionBy("_k", "_block")
    before, after = inside.orderBy(order).rowsBetween(Window.unboundedPreceding, 0), inside.orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked
    for c in columns:
        local = local.withColumns({f"_p_{c}": F.last(c, True).over(before), f"_q_{c}": F.last(c, True).over(after)})
    joined = local.alias("a").join(carry.alias("b"), ["_k", "_block"])
    value = lambda c: F.coalesce(f"a._p_{c}", f"b._b_{c}", f"a._q_{c}", f"b._a_{c}", F.lit(0.0)).alias(c)
    return joined.select(*[value(c) if c in columns else F.col(f"a.{c}") for c in df.columns])


def iterations(df: DataFrame, number: str, keys: Sequence[str] = ("source",), order: str = "ID") -> DataFrame:
    """Adds ``iteration``: one more each time ``number`` falls from one row to the next."""
    falls = F.coalesce(F.col(number) < F.col(f"prev.{number}"), F.lit(False)) | F.col("prev").isNull()
    return numbered(df, [number], falls, "iteration", keys, order)
