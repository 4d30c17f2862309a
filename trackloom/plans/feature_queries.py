"""Queries over windowed features, each group with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import features, kernels, legacy
from trackloom.operators.signals import base_signals
from trackloom.operators.tracks import core
from trackloom.plans.catalogue import FRAMES, rounded
from trackloom.sources.tables import table

W, N = 5, 30  # seconds and rows of the windows here
A, B, H = N // 2, (N - 1) // 2, N // 2


def _sum_of(terms: list[str]) -> str:
    return " + ".join(terms)


def _hyp(a: str, b: str) -> str:
    return f"sqrt(({a}) * ({a}) + ({b}) * ({b}))"


def _angle(ax: str, ay: str, bx: str, by: str) -> str:
    return f"degrees(acos(greatest(least((({ax}) * ({bx}) + ({ay}) * ({by})) / ({_hyp(ax, ay)} * {_hyp(bx, by)} + 1e-6::DOUBLE), 1.0::DOUBLE), -1.0::DOUBLE)))"


def _wrap(a: str) -> str:
    return f"(({a}) + pi() - 2 * pi() * floor((({a}) + pi()) / (2 * pi())) - pi())"


_S = lambda i: (f"xspine_{i}", f"yspine_{i}")
_SEGMENTS = [_hyp(f"xspine_{i + 1} - xspine_{i}", f"yspine_{i + 1} - yspine_{i}") for i in range(10)]
_TRACKS = "PARTITION BY source, ID ORDER BY frame"

#: the base signals in SQL, as far as the queries here need them
SIGNALS = f"""{FRAMES},
g0 AS (SELECT *, {_sum_of(_SEGMENTS)} AS body_len, {_hyp('xspine_10 - xspine_0', 'yspine_10 - yspine_0')} AS chord,
  {_angle('xspine_0 - xspine_5', 'yspine_0 - yspine_5', 'xspine_10 - xspine_5', 'yspine_10 - yspine_5')} AS bending,
  {_angle('xspine_2 - xspine_0', 'yspine_2 - yspine_0', 'xspine_10 - xspine_5', 'yspine_10 - yspine_5')} AS head_bend,
  coalesce(atan2(yspine_0 - yspine_10, xspine_0 - xspine_10), 0) AS angle_body, coalesce(atan2(yspine_0 - yspine_5, xspine_0 - xspine_5), 0) AS angle_head,
  abs((xspine_10 - xspine_0) * (yspine_0 - yspine_5) - (xspine_0 - xspine_5) * (yspine_10 - yspine_0)) / ({_hyp('xspine_10 - xspine_0', 'yspine_10 - yspine_0')} + 1e-6::DOUBLE) AS asymmetry FROM fr),
g1 AS (SELECT *, {_hyp('xspine_0 - lag(xspine_0) OVER w', 'yspine_0 - lag(yspine_0) OVER w')} * 6 AS v_head, {_hyp('xspine_5 - lag(xspine_5) OVER w', 'yspine_5 - lag(yspine_5) OVER w')} * 6 AS v_mid,
  {_hyp('xspine_10 - lag(xspine_10) OVER w', 'yspine_10 - lag(yspine_10) OVER w')} * 6 AS v_tail, {_hyp('x - lag(x) OVER w', 'y - lag(y) OVER w')} * 6 AS v_com,
  x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, (bending - lag(bending) OVER w) * 6 AS bending_vel, {_wrap('angle_body - lag(angle_body) OVER w')} AS u_body, {_wrap('angle_head - lag(angle_head) OVER w')} AS u_head,
  row_number() OVER w = 1 AS is_first, lead(frame) OVER w IS NULL AS is_last, CASE WHEN bending > lag(bending) OVER w AND bending > lead(bending) OVER w THEN 1 ELSE 0 END AS is_peak FROM g0 WINDOW w AS ({_TRACKS})),
g2 AS (SELECT *, coalesce(atan2(dy, dx), 0) AS angle_heading, CASE WHEN v_com < 0.15 THEN 1 ELSE 0 END AS is_paused, abs(bending_vel) AS bending_diff, (v_head + 1e-3::DOUBLE) / (v_tail + 1e-3::DOUBLE) AS ht_ratio, (v_head + 1e-3::DOUBLE) / (v_mid + 1e-3::DOUBLE) AS hc_ratio FROM g1),
g3 AS (SELECT *, {_wrap('angle_heading - lag(angle_heading) OVER w')} AS u_heading, CASE WHEN is_paused = 1 AND (coalesce(lag(is_paused) OVER w, 0) = 1 OR coalesce(lead(is_paused) OVER w, 0) = 1) THEN 1 ELSE 0 END AS has_neighbor,
  coalesce((dx * lag(dx, 6) OVER w + dy * lag(dy, 6) OVER w) / ({_hyp('dx', 'dy')} * {_hyp('lag(dx, 6) OVER w', 'lag(dy, 6) OVER w')} + 1e-6::DOUBLE), 0) AS autocorr_1s FROM g2 WINDOW w AS ({_TRACKS})),
g4 AS (SELECT *, {', '.join(f"abs(CASE WHEN is_first AND is_last THEN 0 WHEN is_first THEN lead(u_{k}) OVER w WHEN is_last THEN u_{k} ELSE (u_{k} + lead(u_{k}) OVER w) / 2 END) * 6 AS omega_{k}" for k in ('body', 'head', 'heading'))},
  coalesce(abs(bending_vel), last_value(abs(bending_vel) IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), first_value(abs(bending_vel) IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS omega_relative FROM g3 WINDOW w AS ({_TRACKS})),
md AS (SELECT source, ID, median(body_len) AS gm, median(bending_diff) AS bm FROM g4 GROUP BY ALL),
sg AS (SELECT g4.*, gm, CASE WHEN bending_diff > bm THEN 1 ELSE 0 END AS high_bend_activity, v_mid / (gm + 1e-6::DOUBLE) AS v_mid_norm, body_len / (chord + 1e-6::DOUBLE) AS curvature_index,
  asymmetry / (gm + 1e-6::DOUBLE) AS asym_norm, CASE WHEN omega_heading > 0.35 THEN 1 ELSE 0 END AS is_turning FROM g4 JOIN md USING (source, ID))"""
_ROLL = f"WINDOW w AS ({_TRACKS}), r AS ({_TRACKS} ROWS BETWEEN {A} PRECEDING AND {B} FOLLOWING), k AS ({_TRACKS} ROWS BETWEEN {H} PRECEDING AND {H} FOLLOWING)"
_DISP = _hyp(f"coalesce(lead(x, {H}) OVER w, x) - coalesce(lag(x, {H}) OVER w, x)", f"coalesce(lead(y, {H}) OVER w, y) - coalesce(lag(y, {H}) OVER w, y)")


def _mean(c: str) -> str:
    return f"avg({c}) OVER r"


#: expressions over the signals
EXPRESSIONS = {
    "larva_body_length": "gm", "vel_mean": _mean("v_com"), "vel_norm_mean": _mean("v_mid_norm"), "head_vel_mean": _mean("v_head"), "omega_body_mean": _mean("omega_body"),
    "omega_relative_mean": _mean("omega_relative"), "omega_heading_mean": _mean("omega_heading"), "hc_ratio_mean": _mean("hc_ratio"), "ht_ratio_mean": _mean("ht_ratio"), "reversal_rate": _mean("high_bend_activity"),
    "curvature_index_mean": _mean("curvature_index"), "turn_fraction": _mean("is_turning"), "vel_autocorr": _mean("autocorr_1s"), "pause_fraction": f"coalesce({_mean('is_paused')}, 0)",
    "head_bend_max": "max(head_bend) OVER r", "omega_heading_max": "max(omega_heading) OVER r", "posture_asymmetry_max": "max(asym_norm) OVER r",
    "vel_std": "coalesce(stddev_samp(v_com) OVER r, 0)", "head_vel_std": "coalesce(stddev_samp(v_head) OVER r, 0)", "bending_std": "coalesce(stddev_samp(bending) OVER r, 0)", "omega_head_std": "coalesce(stddev_samp(omega_head) OVER r, 0)",
    "rog": "sqrt(coalesce(var_samp(x) OVER r, 0) + coalesce(var_samp(y) OVER r, 0)) / (gm + 1e-6::DOUBLE)",
    "tortuosity": f"(sum(v_com) OVER r) / 6 / ({_DISP} + 0.1::DOUBLE * gm)", "msd": f"{_DISP} * {_DISP} / {W}", "msd_norm": f"{_DISP} * {_DISP} / ({W} * gm * gm + 1e-6::DOUBLE)", "net_displacement_norm": f"{_DISP} / (gm + 1e-6::DOUBLE)",
    "coverage": f"(count(v_com) OVER r) / {float(W)}::DOUBLE", "bend_peaks_rate": "(sum(is_peak) OVER r)::DOUBLE / ((count(v_com) OVER r) + 1e-6::DOUBLE)", "path_length_norm": "(sum(v_com) OVER r) / 6 / (gm + 1e-6::DOUBLE)",
    "pause_run_frac": f"{_mean('has_neighbor')} / ({_mean('is_paused')} + 1e-6::DOUBLE)",
}

GROUPS = {
    "features_speed": (["larva_body_length", "vel_mean", "vel_norm_mean", "head_vel_mean", "coverage", "path_length_norm", "pause_fraction", "pause_run_frac", "vel_autocorr"], 6),
    "features_turning": (["omega_body_mean", "omega_relative_mean", "omega_heading_mean", "omega_heading_max", "turn_fraction", "reversal_rate", "bend_peaks_rate"], 6),
    "features_shape": (["hc_ratio_mean", "ht_ratio_mean", "curvature_index_mean", "head_bend_max", "posture_asymmetry_max"], 5),
    "features_path": (["msd", "msd_norm", "net_displacement_norm"], 8),
    "features_spread": (["vel_std", "head_vel_std", "bending_std", "omega_head_std", "rog", "tortuosity"], 6),
}
TREND = ["vel_lag", "vel_lead", "omega_body_mean_slope_smooth", "tort_slope_smooth"]


def _column(f: str) -> str:
    return features.column_name(f, None if features.REGISTRY.features[f].is_base else W)


def _wanted(spark: SparkSession, d: str, names: list[str], digits: int) -> DataFrame:
    got = features.compute_columns(table(spark, d, "long_df"), [_column(f) for f in names])
    return rounded(got.drop("et").withColumnRenamed("ID", "id"), digits)


def _query(names: list[str], digits: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _wanted(spark, d, names, digits)


def _select(columns: dict[str, str], source: str, digits: int) -> str:
    return f"SELECT source, ID AS id, frame, {', '.join(f'round({e}, {digits}) + 0.0::DOUBLE AS {c}' for c, e in columns.items())} FROM {source}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(names, digits) for name, (names, digits) in GROUPS.items()}
SQL: dict[str, str] = {name: f"WITH {SIGNALS} {_select({_column(f): EXPRESSIONS[f] for f in names}, 'sg', digits)} {_ROLL}" for name, (names, digits) in GROUPS.items()}


def features_trend(spark: SparkSession, d: str) -> DataFrame:
    return _wanted(spark, d, TREND, 5)


def features_kernels(spark: SparkSession, d: str) -> DataFrame:
    """Features with a sequential rule: turn events, revisits, path efficiency, dominant frequency, ellipses."""
    names = [*kernels.TURN_STATS, "revisitation_mean", "revisitation_mean_norm", "revis_slope_smooth", "path_efficiency", "bend_freq_rolling", "pca_ratio", "pca_area_norm", "angular_tortuosity", "rog_slope_smooth"]
    return _wanted(spark, d, names, 4)


def features_legacy(spark: SparkSession, d: str) -> DataFrame:
    """The first-generation features over all of their windows."""
    got = features.compute_columns(table(spark, d, "long_df"), [c for w in legacy.WINDOWS for c in legacy.columns(w)], registry=legacy.LEGACY, **legacy.SIGNALS)
    return rounded(got.drop("et").withColumnRenamed("ID", "id"), 4)


def signals(spark: SparkSession, d: str) -> DataFrame:
    got = core(base_signals(table(spark, d, "long_df")))
    names = ["body_len", "bending", "v_head", "v_com", "bending_vel", "angle_body", "angle_heading", "omega_body", "omega_heading", "ht_ratio", "is_paused", "has_neighbor", "is_peak"]
    return rounded(got.select("source", F.col("ID").alias("id"), "frame", *names), 5)


QUERIES |= {f.__name__: f for f in (features_trend, features_kernels, features_legacy, signals)}
_STEP = 5
_SLOPES = f"coalesce(coalesce(lead({{c}}, {_STEP}) OVER w, last_value({{c}}) OVER e) - coalesce(lag({{c}}, {_STEP}) OVER w, first_value({{c}}) OVER e), 0)"
SQL["features_trend"] = (
    f"WITH {SIGNALS}, f0 AS (SELECT source, ID, frame, {EXPRESSIONS['vel_mean']} AS vm, {EXPRESSIONS['omega_body_mean']} AS om, {EXPRESSIONS['tortuosity']} AS tt FROM sg {_ROLL}) "
    + _select({"w5_vel_lag": f"coalesce(lag(vm, {_STEP}) OVER w, 0)", "w5_vel_lead": f"coalesce(lead(vm, {_STEP}) OVER w, 0)", "w5_omega_body_mean_slope_smooth": _SLOPES.format(c="om"), "w5_tort_slope_smooth": _SLOPES.format(c="tt")}, "f0", 5)
    + f" WINDOW w AS ({_TRACKS}), e AS ({_TRACKS} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
)
_PLAIN = ["body_len", "bending", "v_head", "v_com", "bending_vel", "angle_body", "angle_heading", "omega_body", "omega_heading", "ht_ratio"]
SQL["signals"] = f"WITH {SIGNALS} SELECT source, ID AS id, frame, {', '.join(f'round({c}, 5) AS {c}' for c in _PLAIN)}, is_paused, has_neighbor, is_peak FROM sg"
