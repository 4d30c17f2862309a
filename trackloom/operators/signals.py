"""Per-frame base signals of body posture and motion, as Catalyst expressions.

Input is a frame table in row shards (``operators.tracks``); every signal needs the row itself and its neighbours in
the track. Differences at a track's first row are null and flags there 0; a track of one row turns at speed 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.frames import FPS
from trackloom.operators.tracks import COORDS, SPINE, TRACK, clean_rows, group_quantiles, numbered_rows, shard_window, spread_shards, with_key
from trackloom.plans.staging import stage

PAUSE_SPEED = 0.15
TURN_SPEED = 0.35
BLOCK = 8192


def hypot(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def _sql_hypot(a: str, b: str) -> str:
    return f"sqrt(({a}) * ({a}) + ({b}) * ({b}))"


def _between(i: int, j: int) -> tuple[str, str]:
    """The vector from body point ``j`` to body point ``i``, as SQL."""
    return f"(xspine_{i} - xspine_{j})", f"(yspine_{i} - yspine_{j})"


def vector_angle(a: tuple[str, str], b: tuple[str, str]) -> str:
    """Degrees between two vectors as SQL, 90 for a vector without length."""
    cosine = f"(({a[0]} * {b[0]} + {a[1]} * {b[1]}) / ({_sql_hypot(*a)} * {_sql_hypot(*b)} + 1e-6D))"
    return f"degrees(acos(greatest(least({cosine}, 1.0D), -1.0D)))"


def wrapped(angle: Column) -> Column:
    """An angle difference brought to [-pi, pi)."""
    return F.pmod(angle + F.pi(), 2 * F.pi()) - F.pi()


def geometry(df: DataFrame) -> DataFrame:
    """Signals of the single row."""
    body, front, back, neck = _between(10, 0), _between(0, 5), _between(10, 5), _between(2, 0)
    chord = _sql_hypot(*body)
    columns = {
        "body_len": " + ".join(_sql_hypot(*_between(i + 1, i)) for i in range(10)),
        "chord": chord,
        "bending": vector_angle(front, back),
        "head_bend": vector_angle(neck, back),
        "angle_body": f"coalesce(atan2({_between(0, 10)[1]}, {_between(0, 10)[0]}), 0.0D)",
        "angle_head": f"coalesce(atan2({front[1]}, {front[0]}), 0.0D)",
        "asymmetry": f"abs({body[0]} * {front[1]} - {front[0]} * {body[1]}) / ({chord} + 1e-6D)",
        "bend_side": f"signum({front[0]} * {back[1]} - {front[1]} * {back[0]})",
    }
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def motion(df: DataFrame, fps: float = FPS, pause_speed: float = PAUSE_SPEED) -> DataFrame:
    """Signals that need neighbouring rows: velocities, turning speeds and flags."""
    w = shard_window()
    diff = lambda c: F.col(c) - F.lag(c).over(w)
    speed = lambda a, b: hypot(diff(a), diff(b)) * fps
    one = df.withColumns(
        {
            "v_head": speed("xspine_0", "yspine_0"),
            "v_mid": speed("xspine_5", "yspine_5"),
            "v_tail": speed("xspine_10", "yspine_10"),
            "v_com": speed("x", "y"),
            "dx": diff("x"),
            "dy": diff("y"),
            "bending_vel": diff("bending") * fps,
            "u_body": wrapped(diff("angle_body")),
            "u_head": wrapped(diff("angle_head")),
            "_first": F.lag(F.lit(1)).over(w).isNull(),
            "_last": F.lead(F.lit(1)).over(w).isNull(),
            "is_peak": F.coalesce((F.col("bending") > F.lag("bending").over(w)) & (F.col("bending") > F.lead("bending").over(w)), F.lit(False)).cast("int"),
        }
    )
    two = one.withColumns(
        {
            "angle_heading": F.coalesce(F.atan2("dy", "dx"), F.lit(0.0)),
            "is_paused": F.coalesce(F.col("v_com") < pause_speed, F.lit(False)).cast("int"),
            "bending_diff": F.abs("bending_vel"),
            "ht_ratio": (F.col("v_head") + 1e-3) / (F.col("v_tail") + 1e-3),
            "hc_ratio": (F.col("v_head") + 1e-3) / (F.col("v_mid") + 1e-3),
        }
    )
    lag = int(fps)
    dot = F.col("dx") * F.lag("dx", lag).over(w) + F.col("dy") * F.lag("dy", lag).over(w)
    size = hypot(F.col("dx"), F.col("dy")) * F.sqrt(F.lag("dx", lag).over(w) * F.lag("dx", lag).over(w) + F.lag("dy", lag).over(w) * F.lag("dy", lag).over(w))
    three = two.withColumns(
        {
            "u_heading": wrapped(diff("angle_heading")),
            "has_neighbor": F.coalesce((F.col("is_paused") == 1) & ((F.coalesce(F.lag("is_paused").over(w), F.lit(0)) == 1) | (F.coalesce(F.lead("is_paused").over(w), F.lit(0)) == 1)), F.lit(False)).cast("int"),
            "autocorr_1s": F.coalesce(dot / (size + 1e-6), F.lit(0.0)),
        }
    )

    def turning(u: str) -> Column:
        ahead = F.lead(u).over(w)
        inside = (F.col(u) + ahead) / 2
        return F.abs(F.when(F.col("_first") & F.col("_last"), 0.0).when(F.col("_first"), ahead).when(F.col("_last"), F.col(u)).otherwise(inside)) * fps

    four = three.withColumns({"omega_body": turning("u_body"), "omega_head": turning("u_head"), "omega_heading": turning("u_heading"), "omega_relative": F.abs("bending_vel")})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # before the first value the first value counts
    first = F.min_by("omega_relative", F.when(F.col("omega_relative").isNotNull(), F.col("idx"))).over(Window.partitionBy("_k", "shard"))
    filled = {"omega_relative": F.coalesce("omega_relative", F.last("omega_relative", True).over(upto), first, F.lit(0.0))}
    five = four.withColumns(filled)
    return five.withColumn("is_turning", (F.col("omega_heading") > TURN_SPEED).cast("int")).drop("_first", "_last")


def numbered_frames(df: DataFrame, fps: float = FPS, length_metric: str = "body_len") -> DataFrame:
    """The frame table with ``idx``, the row's number in its track, its ``_length`` and ``_bend`` (change of bending).

    Rows are shuffled once, by track and block of frames, which serves repeated rows, the numbering and the differences;
    only the blocks' counts and last rows meet over a whole track. Written once: everything else reads this table.
    """
    keyed = with_key(clean_rows(df, fps=fps), TRACK, "frame", BLOCK).drop(*TRACK)
    # no column and no filter that only one of the two readers has, else each would read and shuffle for itself
    spread = keyed.where(F.col("_block").isNotNull()).repartition("_k", "_block")
    first = F.row_number().over(Window.partitionBy("_k", "_block", "frame").orderBy("off", "et", *COORDS))
    frames = spread.withColumn("_n", first).where("_n = 1").drop("_n", "off")
    inside = Window.partitionBy("_k", "_block").orderBy("frame")
    ends = frames.groupBy("_k", "_block").agg(F.count("*").alias("_n"), F.max_by(F.struct(*SPINE), "frame").alias("_end"))
    before = F.lag("_last").over(Window.partitionBy("_k").orderBy("_block"))
    counts = geometry(ends.select("_k", "_block", "_n", "_end.*")).select("_k", "_block", "_n", F.col("bending").alias("_last")).withColumn("_before", before).drop("_last")
    posed = geometry(frames)
    local = posed.withColumns({"_rn": F.row_number().over(inside), "_prior": F.lag("bending").over(inside)})
    numbered = numbered_rows(local, counts)
    prior = F.when(F.col("_rn") == 1, F.col("_before")).otherwise(F.col("_prior"))
    bend = F.abs((F.col("bending") - prior) * fps)
    made = numbered.select(*[F.col(f"_k.{k}").alias(k) for k in TRACK], "frame", "et", *COORDS, "idx", F.col(length_metric).alias("_length"), bend.alias("_bend"))
    return stage(made, "frames")[0]


def base_signals(df: DataFrame, fps: float = FPS, pause_speed: float = PAUSE_SPEED, length_metric: str = "body_len", rows: int = 20_000, margin: int = 1_000) -> DataFrame:
    """Numbered frames in row shards with geometry, motion and the tracks' medians, margins included.

    ``length_metric`` is ``body_len`` (sum of the segments) or ``chord`` (head to tail). A value more than ``margin``
    rows away is not carried into holes of the turning speeds.
    """
    frames = numbered_frames(df, fps, length_metric)
    medians = group_quantiles(frames.select(*TRACK, F.col("_length").alias("group_medians"), F.col("_bend").alias("bend_median")), TRACK, ["group_medians", "bend_median"])
    # a track's medians go to each of its shards, so that they meet the rows where these are already
    shards = with_key(frames.groupBy(*TRACK).agg(F.max("idx").alias("_most")), TRACK)
    spread = shards.join(with_key(medians, TRACK).drop(*TRACK), "_k", "left").select("_k", "group_medians", "bend_median", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_most") / F.lit(rows)))).alias("shard"))
    per_shard, _ = stage(spread, "medians")
    placed = spread_shards(with_key(frames.drop("_length", "_bend"), TRACK), rows, margin).join(per_shard, ["_k", "shard"])
    moving = motion(geometry(placed), fps, pause_speed)
    norm = {f"{v}_norm": F.col(v) / (F.col("group_medians") + 1e-6) for v in ("v_head", "v_mid", "v_tail", "v_com")}
    return moving.withColumns(
        norm
        | {
            "curvature_index": F.col("body_len") / (F.col("chord") + 1e-6),
            "asym_norm": F.col("asymmetry") / (F.col("group_medians") + 1e-6),
            "high_bend_activity": F.coalesce(F.col("bending_diff") > F.col("bend_median"), F.lit(False)).cast("int"),
        }
    )
