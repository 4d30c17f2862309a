"""From probabilities to bouts: median filter, threshold or switch, closing and opening, as one configuration."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.operators import islands
from trackloom.operators.frames import FPS
from trackloom.operators.kernels import median_filter
from trackloom.operators.tracks import TRACK, core, row_shards, same, with_key
from trackloom.plans.staging import stage


def medians(df: DataFrame, value: str, sizes: Iterable[int], order: str = "frame") -> DataFrame:
    """Adds ``value_{n}`` per size, the sliding median of ``value`` over ``n`` rows (mirrored at the ends, null as 0)."""
    sizes = sorted(set(sizes))
    wide = [n for n in sizes if n > 1]
    plain = {f"{value}_{n}": F.coalesce(F.col(value).cast("double"), F.lit(0.0)) for n in sizes if n <= 1}
    if not wide:
        return df.withColumns(plain)
    shards = row_shards(df, TRACK, order, rows=max(20_000, 8 * max(wide)), margin=2 * max(wide)).drop("_k")
    schema = T.StructType([*shards.schema.fields, *[T.StructField(f"{value}_{n}", T.DoubleType()) for n in wide]])

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("idx", kind="stable")
        values = np.nan_to_num(shard[value].to_numpy(float))
        return shard.assign(**{f"{value}_{n}": median_filter(values, n) for n in wide})

    return core(shards.groupBy(*TRACK, "shard").applyInPandas(run, schema)).withColumns(plain)


def filtered(df: DataFrame, value: str, n: int, order: str = "frame") -> DataFrame:
    """``value`` replaced by its sliding median over ``n`` rows of the track."""
    made = medians(df, value, [n], order)
    return made.withColumn(value, F.col(f"{value}_{n}")).drop(f"{value}_{n}") if n > 1 else df


@dataclass(frozen=True)
class PostProcess:
    """Seconds of the median filter, probabilities that switch on and off, seconds of closing and opening.

    With ``off`` None, frames above ``on`` are on. Sizes of 0 do nothing.
    """

    median_s: float = 1.0
    on: float = 0.5
    off: float | None = None
    close_s: float = 1.0
    open_s: float = 1.5
    fps: float = FPS

    def get_id(self) -> str:
        switch = f"{self.on:g}" if self.off is None else f"{self.on:g}-{self.off:g}"
        return f"m{self.median_s:g}_t{switch}_c{self.close_s:g}_o{self.open_s:g}"

    def states(self, df: DataFrame) -> DataFrame:
        """``source, ID, frame, et, state`` before closing and opening; needs ``prob``."""
        rows = filtered(df.select(*TRACK, "frame", "et", F.coalesce("prob", F.lit(0.0)).alias("prob")), "prob", int(self.median_s * self.fps))
        if self.off is None:
            return rows.select(*TRACK, "frame", "et", (F.col("prob") > self.on).cast("int").alias("state"))
        cut, _ = stage(islands.event_ids(rows, []).withColumnRenamed("event_id", "segment"), "segments")
        return islands.hysteresis(cut, "prob", self.on, self.off, keys=[*TRACK, "segment"]).select(*TRACK, "frame", "et", "state")

    def bouts(self, df: DataFrame) -> DataFrame:
        """Runs of 1: ``source, ID, first, last, t0, t1, n``."""
        states, _ = stage(self.states(df), "states")
        runs = islands.close_and_open(states, "state", int(self.close_s * self.fps), int(self.open_s * self.fps))
        return runs.where("state = 1").select(*TRACK, "first", "last", "t0", "t1", "n")

    def predictions(self, df: DataFrame) -> DataFrame:
        """The rows with ``prediction`` 1 inside bouts, else 0. Bouts are met by blocks of frames."""
        width = 256
        bouts, _ = stage(self.bouts(df), "bouts")
        spread = bouts.withColumn("_b", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
        rows = df.withColumn("_b", F.floor(F.col("frame") / width))
        inside = (F.col("r.frame") >= F.col("b.first")) & (F.col("r.frame") <= F.col("b.last"))
        met = rows.alias("r").join(spread.alias("b"), same("r", "b", [*TRACK, "_b"]) & inside, "left")
        return met.select(*[F.col(f"r.{c}") for c in df.columns if c != "prediction"], F.col("b.first").isNotNull().cast("int").alias("prediction"))


#: fixed values: the settings that a search draws from
SPACE = {"median_s": (4, 4.5, 5), "on": (0.6, 0.65, 0.7), "off": (0.5, 0.55, 0.6, 0.65), "close_s": (4, 5.5), "open_s": (13, 15, 18)}


def drawn(n: int = 20, space: dict[str, Iterable[float]] = SPACE, seed: int = 42) -> list[PostProcess]:
    """``n`` different settings of the space, or all if it has no more."""
    every = [PostProcess(**dict(zip(space, map(float, values), strict=True))) for values in product(*space.values())]
    return [every[i] for i in np.random.default_rng(seed).permutation(len(every))[:n]]


def search(df: DataFrame, configs: Iterable[PostProcess]) -> DataFrame:
    """``config, tp, fp, fn, f1`` of each configuration over frames with a ``truth``; all of them in one plan.

    Frames are read once; the configuration is a column of what follows. A configuration's bouts meet the frames by
    blocks, and frames outside all bouts need no row of their own: truths are counted once.
    """
    configs = list(dict.fromkeys(configs))
    size = lambda c: int(c.median_s * c.fps)
    narrow = df.select(*TRACK, "frame", "et", F.coalesce("prob", F.lit(0.0)).alias("prob"))
    rows, _ = stage(islands.event_ids(medians(narrow, "prob", [size(c) for c in configs]), []).withColumnRenamed("event_id", "segment"), "medians")

    def entry(c: PostProcess):
        fields = {"id": F.lit(c.get_id()), "on": F.lit(float(c.on)), "off": F.lit(None if c.off is None else float(c.off)).cast("double"), "close": F.lit(int(c.close_s * c.fps)), "open": F.lit(int(c.open_s * c.fps))}
        return F.struct(F.struct(*[v.alias(k) for k, v in fields.items()]).alias("config"), F.col(f"prob_{size(c)}").alias("prob"))

    if not configs:
        return df.sparkSession.createDataFrame([], "config string, tp long, fp long, fn long, f1 double")
    each = rows.select(*TRACK, "frame", "et", "segment", F.explode(F.array(*map(entry, configs))).alias("e")).select(*TRACK, "frame", "et", "segment", "e.*")
    keys = [*TRACK, "config"]
    switched = islands.hysteresis(each.where("config.off IS NOT NULL"), "prob", F.col("config.on"), F.col("config.off"), keys=[*keys, "segment"])
    plain = each.where("config.off IS NULL").withColumn("state", (F.col("prob") > F.col("config.on")).cast("int"))
    states = switched.select(*keys, "frame", "et", "state").unionByName(plain.select(*keys, "frame", "et", "state"))
    bouts = islands.close_and_open(states, "state", F.col("config.close"), F.col("config.open"), keys=keys).where("state = 1")
    width = 256
    spread = bouts.select(*TRACK, F.col("config.id").alias("config"), "first", "last", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))).alias("_b"))
    truths = df.where("truth IS NOT NULL").select(*TRACK, "frame", "truth", F.floor(F.col("frame") / width).alias("_b"))
    inside = (F.col("frame") >= F.col("first")) & (F.col("frame") <= F.col("last"))
    hits = with_key(truths, TRACK).drop(*TRACK).join(with_key(spread, TRACK).drop(*TRACK), ["_k", "_b"]).where(inside).groupBy("config").agg(F.count_if(F.col("truth") == 1).alias("tp"), F.count_if(F.col("truth") == 0).alias("fp"))
    whole = truths.agg(F.count_if(F.col("truth") == 1).alias("p"))
    ids = df.sparkSession.createDataFrame([(c.get_id(),) for c in configs], "config string")
    cells = ids.join(hits, "config", "left").join(whole).select("config", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("fp", F.lit(0)).alias("fp"), (F.col("p") - F.coalesce("tp", F.lit(0))).alias("fn"))
    return cells.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))
