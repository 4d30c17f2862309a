"""The first generation of windowed features, where it differs: frames as units, raw radius, fixed windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.operators.features import REGISTRY, FeatureDef, Registry, Rolling, column_name

#: fixed values: the windows in seconds and the features of each
WINDOWS = (11, 30, 50, 75)
EVERY = ["omega_body_mean", "omega_head_std", "omega_relative_mean", "rog", "tortuosity", "msd"]
SHORTEST = ["bending_std", "hc_ratio_mean", "ht_ratio_mean", "omega_body_mean_slope_smooth"]
FROM_30 = ["vel_mean", "vel_std", "vel_norm_mean", "head_vel_mean", "head_vel_std", "omega_heading_mean", "coverage", "bend_peaks_rate", "pause_run_frac", "reversal_rate", "angular_tortuosity", "revisitation_mean", "revis_slope_smooth", "rog_slope_smooth", "tort_slope_smooth"]
FROM_50 = ["omega_body_mean_slope_smooth", "bending_std", "hc_ratio_mean", "ht_ratio_mean", "vel_lag", "vel_lead"]
LONGEST = ["bend_freq_rolling"]


def _rog(r: Rolling, w: int, n: int) -> Column:
    return F.sqrt(F.coalesce(r.var("x", n), F.lit(0.0)) + F.coalesce(r.var("y", n), F.lit(0.0)))


def _coverage(r: Rolling, w: int, n: int) -> Column:
    return r.count("v_com", n) / F.lit(float(n))


def _angular_tortuosity(r: Rolling, w: int, n: int) -> Column:
    return REGISTRY.features["angular_tortuosity"].build(r, n, n)


def _revisitation(r: Rolling, w: int, n: int) -> Column:
    return F.col(f"_k{w}_revisit_mean")


LEGACY = Registry(
    REGISTRY.features
    | {
        "rog": FeatureDef("rog", 1, _rog),
        "coverage": FeatureDef("coverage", 1, _coverage),
        "angular_tortuosity": FeatureDef("angular_tortuosity", 1, _angular_tortuosity),
        "revisitation_mean": FeatureDef("revisitation_mean", 1, _revisitation, "revisit_rows"),
    }
)
#: head to tail as length, and the higher speed below which an animal pauses
SIGNALS = {"length_metric": "chord", "pause_speed": 0.3}


def columns(w: int) -> list[str]:
    """The columns of a window; raises for another window."""
    if w not in WINDOWS:
        raise ValueError(f"windows are {WINDOWS}")
    names = [*EVERY, *(SHORTEST if w == 11 else []), *(FROM_30 if w >= 30 else []), *(FROM_50 if w >= 50 else []), *(LONGEST if w == 75 else [])]
    return [column_name(f, w) for f in names]
