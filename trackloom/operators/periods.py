"""Overlapping and gapped time intervals.

A mergeable summary of intervals is a list of sorted disjoint intervals. Lists are built per track, time block and
salt, and are then combined in a reduction tree: each level joins ``fan_in`` neighbouring blocks with one sorted linear
merge (a running maximum of ends), so every level sees only what the level below could not join. A list is held as
rows sorted inside its key, not as an array, so that Spark can spill it. The tree stops at blocks of bounded length; at
its top only the ends of these blocks meet, in a prefix scan, and the periods and their complements are emitted.

Defined results: rows with null ``ID``, ``t0`` or ``t1`` (or NaN), or without ``t1 > t0``, are left out; ``source`` is
compared without surrounding white space and in upper case, a null source stays a null source; repeated rows change
nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.frames import is_number, need
from trackloom.operators.tracks import TRACK, with_key


def clean_source(source: Column) -> Column:
    """Without surrounding white space (any kind), upper case."""
    return F.upper(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))


def _merge(rows: DataFrame, key: list[str], slack: float) -> DataFrame:
    """The sorted linear merge of each key's list: intervals at most ``slack`` apart are joined."""
    ordered = Window.partitionBy(*key).orderBy("t0", "t1")
    reach = F.max("t1").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("t0") - reach > F.lit(slack)), 1).otherwise(0)
    run = F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    numbered = rows.withColumn("opens", opens).withColumn("run", run)
    return numbered.groupBy(*key, "run").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("run")


def _lists(df: DataFrame, slack_s: float, block_s: float, fan_in: int, salts: int, levels: int) -> DataFrame:
    """The merged lists of each track's time blocks after the tree's ``levels``: ``_k, source, ID, _block, t0, t1``."""
    need(df, ["source", "ID", "t0", "t1"])
    rows = df.select(clean_source(F.col("source")).alias("source"), "ID", F.col("t0").cast("double").alias("t0"), F.col("t1").cast("double").alias("t1"))
    rows = rows.where(F.col("ID").isNotNull() & is_number(F.col("t0")) & is_number(F.col("t1")) & (F.col("t1") > F.col("t0")))
    rows = with_key(rows, TRACK, "t0", block_s).withColumn("_salt", F.pmod(F.xxhash64("t0", "t1"), F.lit(salts))).drop(*TRACK)
    lists = _merge(rows, ["_k", "_block", "_salt"], slack_s).drop("_salt")
    for level in range(levels + 1):
        parent = F.floor(F.col("_block") / F.lit(fan_in)) if level else F.col("_block")
        lists = _merge(lists.withColumn("_block", parent), ["_k", "_block"], slack_s)
    return lists


def _scanned(lists: DataFrame, slack: float) -> DataFrame:
    """The tree's top: lists with ``past``, how far the track reached before, and ``run``, the number of the period.

    Blocks hand on their furthest end and the number of periods that open in them, one row per block; so no task sees a
    whole track, however many periods it has.
    """
    over = Window.partitionBy("_k").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    reach = lists.groupBy("_k", "_block").agg(F.max("t1").alias("_reach")).select("_k", "_block", F.max("_reach").over(over).alias("_before"))
    inside = Window.partitionBy("_k", "_block").orderBy("t0", "t1")
    past = F.greatest("_before", F.max("t1").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    met = lists.join(reach, ["_k", "_block"]).withColumn("past", past)
    opened = met.withColumn("opens", (F.col("past").isNull() | (F.col("t0") - F.col("past") > F.lit(slack))).cast("long"))
    ahead = opened.groupBy("_k", "_block").agg(F.sum("opens").alias("_n")).select("_k", "_block", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_ahead"))
    run = F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn("_run", run).join(ahead, ["_k", "_block"]).select("_k", "t0", "t1", "past", "opens", (F.col("_ahead") + F.col("_run")).alias("run"))


def _periods(df: DataFrame, slack_s: float, block_s: float = 600.0, fan_in: int = 8, salts: int = 8, levels: int = 2) -> DataFrame:
    """Periods ``_k, run, t0, t1`` with ``past``, the end of the one before."""
    rows = _scanned(_lists(df, slack_s, block_s, fan_in, salts, levels), slack_s)
    return rows.groupBy("_k", "run").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.max(F.when(F.col("opens") == 1, F.col("past"))).alias("past"))


def merged_periods(df: DataFrame, slack_s: float, **tree) -> DataFrame:
    """Continuous periods ``source, ID, t0, t1`` of each track."""
    return _periods(df, slack_s, **tree).select("_k.source", "_k.ID", "t0", "t1")


def gaps_between(df: DataFrame, slack_s: float, **tree) -> DataFrame:
    """What lies between two successive periods of a track: ``source, ID, t0, t1``."""
    return _periods(df, slack_s, **tree).where("past IS NOT NULL").select("_k.source", "_k.ID", F.col("past").alias("t0"), F.col("t0").alias("t1"))


def periods_and_gaps(df: DataFrame, slack_s: float = 1.1 / 6, **tree) -> DataFrame:
    """Periods and the gaps between successive periods: ``source, id, kind, start_ms, end_ms``."""
    ms = lambda c: F.rint(c * 1000).cast("long")
    spans = [F.struct(F.lit("period").alias("kind"), F.col("t0").alias("a"), F.col("t1").alias("b")), F.when(F.col("past").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("past").alias("a"), F.col("t0").alias("b")))]
    both = _periods(df, slack_s, **tree).select("_k.source", F.col("_k.ID").alias("id"), F.explode(F.array_compact(F.array(*spans))).alias("s"))
    return both.select("source", "id", "s.kind", ms(F.col("s.a")).alias("start_ms"), ms(F.col("s.b")).alias("end_ms"))
