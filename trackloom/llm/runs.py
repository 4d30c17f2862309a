"""Repeated consecutive events in sequences, by pointer doubling.

Every event that matches its predecessor points to it. A combiner contracts the pointers inside short time shards, as a
partial aggregation does; what is left are pieces that point to the piece before them in another shard. Logarithmically
many self-joins then replace these pointers by their pointers' pointers until all point to the start of their run. No
task holds a whole sequence.

Defined results: events without time or value are ignored; events of one frame are one event, whose value is the larger
one where they differ; a null key makes a sequence of its own; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.frames import FPS, frame_number, is_number, need
from trackloom.operators.tracks import with_key
from trackloom.plans.staging import discard, stage


def _pieces(rows: DataFrame, reach: int, tolerance: float, shard_frames: int) -> DataFrame:
    """Chains contracted inside shards: ``_k, node, last, n, value, ptr``; ``node`` is the piece's first frame.

    ``rows`` has ``_k, frame, value`` and is shuffled once, by key and shard; rows of one frame become one event.
    """
    inside = Window.partitionBy("_k", "shard").orderBy("frame")
    event = F.struct("frame", "value")
    placed = rows.withColumn("shard", F.floor(F.col("frame") / F.lit(shard_frames))).repartition("_k", "shard")
    local = placed.groupBy("_k", "shard", "frame").agg(F.max("value").alias("value")).withColumn("before", F.lag(event).over(inside))

    def matches(before: str) -> Column:
        close = (F.col("frame") - F.col(f"{before}.frame") <= reach) & (F.abs(F.col("value") - F.col(f"{before}.value")) <= tolerance)
        return F.coalesce(close, F.lit(False))

    starts = F.sum((~matches("before")).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    chained = local.withColumn("piece", starts).groupBy("_k", "shard", "piece").agg(
        F.min("frame").alias("node"), F.max("frame").alias("last"), F.count("*").alias("n"), F.min(event).alias("head"), F.max(event).alias("tail")
    )
    # a shard's first piece may continue the last piece of the shard before: the step is shorter than a shard
    ends = chained.groupBy("_k", (F.col("shard") + 1).alias("shard")).agg(F.max(F.struct("tail", "node")).alias("end"))
    joined = chained.join(ends, ["_k", "shard"], "left")
    into = F.when(F.col("piece") == 1, F.col("end"))
    flat = joined.select("_k", "node", "last", "n", F.col("head.value").alias("value"), F.col("node").alias("frame"), into["tail"].alias("before"), into["node"].alias("into"))
    return flat.select("_k", "node", "last", "n", "value", F.when(matches("before"), F.col("into")).otherwise(F.col("node")).alias("ptr"))


def resolve(links: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Links ``keys, node, ptr, ...`` with each ``ptr`` at the start of its chain, and the rounds that took.

    A start is a node without a link. Each round replaces the pointers that still move by their pointers' pointers.
    What has reached a start is set aside, so it is not rewritten, and the pointers that still move all differ: no start
    of a long chain becomes a key that many rows share.
    """
    spark, rest = links.sparkSession, [c for c in links.columns if c not in keys]
    moving, path = stage(with_key(links, keys).drop(*keys), "links")
    finished, old, rounds = None, [], 0
    while not moving.isEmpty():
        nodes = moving.select("_k", "node", F.col("ptr").alias("further"), F.lit(False).alias("at_start"))
        if finished is not None:
            nodes = nodes.unionByName(finished.select("_k", "node", F.col("ptr").alias("further"), F.lit(True).alias("at_start")))
        met = moving.alias("p").join(nodes.alias("q"), (F.col("p._k") == F.col("q._k")) & (F.col("p.ptr") == F.col("q.node")), "left")
        jumped = met.select("p._k", *[F.coalesce("q.further", "p.ptr").alias("ptr") if c == "ptr" else F.col(f"p.{c}") for c in rest], F.coalesce("q.at_start", F.lit(True)).alias("done"))
        following, new_path = stage(jumped, "links")
        part = following.where("done").drop("done")
        finished = part if finished is None else finished.unionByName(part)
        old.append(path)
        moving, path, rounds = following.where("NOT done").drop("done"), new_path, rounds + 1
        if rounds == 1:
            discard(spark, old.pop())  # the links as they came; later tables hold finished ones
    return (finished if finished is not None else moving).select(*[F.col(f"_k.{k}").alias(k) for k in keys], *rest), rounds


def collapse_runs(
    df: DataFrame, keys: list[str] = ["source", "ID"], time: str = "et", value: str = "prediction", fps: float = FPS, step_s: float = 0.5,
    tolerance: float = 0.0, least: int = 2, shard_frames: int = 64,
) -> DataFrame:
    """One row per run of at least ``least`` frames: ``keys, value, first_frame, last_frame, n_frames, duration_s``.

    Frames match their predecessor if they are at most ``step_s`` apart and their values differ by at most
    ``tolerance`` (0: identical). ``shard_frames`` is the reach of the combiner.
    """
    need(df, [*keys, time, value])
    reach = int(step_s * fps)
    if reach >= shard_frames:
        raise ValueError("shards must be longer than a step")
    rows = with_key(df, keys).select("_k", frame_number(F.col(time).cast("double"), fps).alias("frame"), F.col(value).cast("double").alias("value"))
    rows = rows.where(F.col("frame").isNotNull() & is_number(F.col("value")))
    flat = _pieces(rows, reach, tolerance, shard_frames)
    pieces, _ = stage(flat.select(*[F.col(f"_k.{k}").alias(k) for k in keys], *[c for c in flat.columns if c != "_k"]), "runs")
    linked, _ = resolve(pieces.where("ptr <> node"), keys)
    # starts and what points to them; rows of one run are summed up before they meet
    every = pieces.where("ptr = node").unionByName(linked)
    runs = every.groupBy(*keys, F.col("ptr").alias("first_frame")).agg(F.max("last").alias("last_frame"), F.sum("n").alias("n_frames"), F.min_by("value", "node").alias("value"))
    return runs.where(F.col("n_frames") >= least).select(*keys, "value", "first_frame", "last_frame", "n_frames", ((F.col("last_frame") - F.col("first_frame")) / F.lit(fps)).alias("duration_s"))
