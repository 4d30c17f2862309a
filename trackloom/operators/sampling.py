"""Samples, splits and folds of tracks and events. All choices follow a seeded hash, so they survive recomputation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.text import tag_tokens
from trackloom.operators.tracks import TRACK, ordered, same, with_key


def shuffle_key(seed: int, *columns: str) -> Column:
    """An order that looks random and is the same in any engine with MD5."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def ratio_sample(events: DataFrame, group: str, size: str, target: float, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Per group, events in shuffled order until their sizes reach the target; each event once.

    Rows are cut into ranges of the shuffled order, with the running sizes carried through, so that no task sorts a
    whole group.
    """
    rows = with_key(events, [group]).withColumn("_r", shuffle_key(seed, *key))
    cut = ordered(rows, F.col("_k"), F.col("_r"), *[F.col(k) for k in key], name="sample")
    inside = Window.partitionBy("_k", "_b").orderBy("_r", *key).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_k", "_b").agg(F.sum(size).alias("_t"))
    ahead = F.coalesce(F.sum("_t").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.coalesce(F.sum(size).over(inside), F.lit(0))
    placed = cut.withColumn("_local", before).join(totals.select("_k", "_b", ahead.alias("_ahead")), ["_k", "_b"])
    return placed.where(F.col("_local") + F.col("_ahead") < target).select(*events.columns)


def weighted_pick(df: DataFrame, weight: Column, key: Sequence[str], by: Sequence[str], seed: int = 42) -> DataFrame:
    """One row per group, chosen with probability proportional to its weight."""
    share = F.conv(F.substring(shuffle_key(seed, *key), 1, 12), 16, 10).cast("double") / float(16**12)
    race = -F.log(F.greatest(share, F.lit(1e-15))) / F.greatest(weight, F.lit(1e-9))
    return df.groupBy(*by).agg(F.min(F.struct(race.alias("_race"), *[c for c in df.columns if c not in by])).alias("_p")).select(*by, *[f"_p.{c}" for c in df.columns if c not in by])


def positions(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Adds ``position`` from 0 in the given order; ranges of it are counted first."""
    rows = ordered(df, *order, name="positions")
    counts = rows.groupBy("_b").agg(F.count("*").alias("_c"))
    # one row per range
    ahead = F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    joined = local.join(counts.select("_b", ahead.alias("_ahead")), "_b")
    return joined.withColumn("position", F.col("_rn") + F.col("_ahead") - 1).drop("_b", "_rn", "_ahead")


def folds(tracks: DataFrame, k: int, seed: int | None = 42, size: str | None = None, keys: Sequence[str] = TRACK) -> DataFrame:
    """A fold from 0 to k - 1 per track: round robin in shuffled order, or from the largest ``size`` on if ``seed`` is None."""
    distinct = tracks.groupBy(*keys).agg(*([F.max(size).alias(size)] if size else [F.lit(1).alias("_one")]))
    if seed is not None:
        placed = positions(distinct, [shuffle_key(seed, *keys), *[F.col(c) for c in keys]])
    else:
        placed = positions(distinct, [F.col(size).desc(), *[F.col(c) for c in keys]])
    return placed.select(*keys, *([size] if size else []), (F.col("position") % k).cast("int").alias("fold"))


def tag_matrix(intervals: DataFrame, keys: Sequence[str] = TRACK, least: int = 5) -> DataFrame:
    """``keys, tag, n``: how many intervals of a track have a tag, for tags on at least ``least`` intervals."""
    tagged = intervals.select(*keys, F.explode(F.array_distinct(F.transform(tag_tokens(F.col("tags")), F.lower))).alias("tag"))
    frequent = tagged.groupBy("tag").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return tagged.join(frequent, "tag").groupBy(*keys, "tag").agg(F.count("*").alias("n"))


def unknown_tracks(tracks: DataFrame, registry: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Tracks that the registry doesn't have."""
    return tracks.select(*keys).distinct().alias("a").join(registry.select(*keys).distinct().alias("b"), same("a", "b", keys), "left_anti")


def search_split(matrix: DataFrame, locked: DataFrame, share: float = 0.7, draws: int = 5000, seed: int = 42, keys: Sequence[str] = TRACK) -> DataFrame:
    """Train or test for each track, so that every tag and the events come near the share; locked tracks keep theirs.

    Candidates are numbered; each puts a track into train by a hash of the number and the track. A track's choices are
    one vector; Spark sums the vectors by tag, weighted with the tag's intervals. The candidate with the smallest
    squared error wins.
    """
    fixed = with_key(locked.where(F.col("split").isin("train", "test")), keys).groupBy("_k").agg(F.max("split").alias("fixed"))
    tracks = with_key(matrix.select(*keys).distinct(), keys).join(fixed, "_k", "left")
    chance = lambda d: F.pmod(F.xxhash64(F.lit(seed), d, *keys), F.lit(1_000_000)) / 1e6
    chosen = lambda d: F.when(F.when(F.col("fixed").isNotNull(), F.col("fixed") == "train").otherwise(chance(d) < share), 1.0).otherwise(0.0)
    vectors = tracks.select("_k", array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), chosen)).alias("_v"))
    rows = with_key(matrix, keys).join(vectors, "_k")
    per_tag = rows.groupBy("tag").agg(vector_to_array(Summarizer.sum(F.col("_v"), F.col("n").cast("double"))).alias("_t"), F.sum("n").alias("all")).select("all", F.posexplode("_t").alias("draw", "train"))
    off = F.col("train") / F.col("all") - share
    errors = per_tag.groupBy("draw").agg((F.avg(off * off) + F.pow(F.sum("train") / F.sum("all") - share, F.lit(2))).alias("error"))
    best = errors.orderBy("error", "draw").first()
    number = F.lit(best["draw"] if best else 0)
    return tracks.select(*keys, F.coalesce("fixed", F.when(chance(number) < share, "train").otherwise("test")).alias("split"))


def wilcoxon(a: Sequence[float], b: Sequence[float]) -> float:
    """Two-sided p of the exact signed-rank test of paired values, for a few dozen pairs at most (seeds of an experiment)."""
    d = np.asarray(a, float) - np.asarray(b, float)
    d = d[d != 0]
    if not len(d):
        return 1.0
    order = np.argsort(np.abs(d), kind="stable")
    ranks = np.empty(len(d))
    size = np.abs(d)[order]
    for value in np.unique(size):
        at = np.flatnonzero(size == value)
        ranks[order[at]] = at.mean() + 1
    doubled = np.rint(2 * ranks).astype(int)
    ways = np.zeros(doubled.sum() + 1)
    ways[0] = 1.0
    for r in doubled:
        ways[r:] += ways[:-r].copy() if r else ways
    ways /= 2.0 ** len(d)
    low = min(doubled[d > 0].sum(), doubled[d < 0].sum())
    return float(min(1.0, 2 * ways[: low + 1].sum()))
