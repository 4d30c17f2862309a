import math
import random
import re

import numpy as np
import pandas as pd
import pytest

from trackloom.operators import features, kernels, signals, tracks
from trackloom.operators.features import Registry, compute_columns
from trackloom.operators.tracks import COORDS, group_quantiles

SCHEMA = "source string, ID long, et double, " + ", ".join(f"{c} double" for c in COORDS)


def walk(source, track, n, seed, still=False):
    r = random.Random(seed)
    out, x, y, a = [], 40.0, 40.0, 0.0
    for f in range(n):
        if not still:
            a += r.gauss(0, 0.3)
            x, y = x + 0.3 * math.cos(a), y + 0.3 * math.sin(a)
        spine = [v for i in range(11) for v in (x - 0.3 * (i - 5) * math.cos(a + 0.02 * i), y - 0.3 * (i - 5) * math.sin(a + 0.02 * i))]
        out.append((source, track, f / 6, x if f % 17 else None, y, *spine))
    return out


@pytest.fixture(scope="module")
def frames(spark):
    data = walk("A", 1, 160, 1) + walk("A", 2, 90, 2) + walk("B", 1, 1, 3) + walk("B", 2, 2, 4) + walk("B", 3, 40, 5, still=True) + [("C", 1, None, *[1.0] * 24)]
    return spark.createDataFrame(data + data[:25], SCHEMA)


def test_rolling_equals_pandas_and_shards_change_nothing(frames):
    wanted = ["w2_vel_mean", "w2_vel_std", "w3_coverage", "w2_bending_std", "w3_head_bend_max", "w2_rog", "w3_tortuosity", "w3_rog_slope_smooth"]
    one = compute_columns(frames, [*wanted, "larva_body_length"]).toPandas().sort_values(["source", "ID", "frame"], ignore_index=True)
    original, small = tracks.row_shards, 300
    two = compute_columns(frames, [*wanted, "larva_body_length"], rows=small).toPandas().sort_values(["source", "ID", "frame"], ignore_index=True)
    pd.testing.assert_frame_equal(one, two, rtol=1e-9, atol=1e-7)
    assert original is tracks.row_shards and list(one.columns) == ["source", "ID", "frame", "et", *wanted, "larva_body_length"]
    for (s, i), g in frames.toPandas().dropna(subset=["et"]).drop_duplicates().sort_values("et").groupby(["source", "ID"]):
        v = np.hypot(g["x"].diff(), g["y"].diff()) * 6
        rolled = v.rolling(12, center=True, min_periods=1)
        found = one[(one["source"] == s) & (one["ID"] == i)]
        np.testing.assert_allclose(found["w2_vel_mean"].to_numpy(float), rolled.mean().to_numpy(), rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(found["w2_vel_std"].to_numpy(float), rolled.std().fillna(0).to_numpy(), rtol=1e-6, atol=1e-6)


def test_short_tracks_and_unknown_columns(frames):
    with pytest.warns(UserWarning, match="w2_nothing"):
        made = compute_columns(frames.where("source = 'B'"), ["w2_omega_body_mean", "w2_nothing", "w2_rog_slope_smooth"])
    r = {(x["ID"], x["frame"]): x for x in made.collect()}
    assert r[(1, 0)]["w2_omega_body_mean"] == 0.0 and r[(1, 0)]["w2_rog_slope_smooth"] == 0.0 and len(r) == 43


def test_kernels_and_empty_table(spark, frames):
    made = compute_columns(frames, ["w2_turn_event_count", "w2_path_efficiency", "w3_revisitation_mean_norm", "w2_bend_freq_rolling", "w2_pca_ratio"])
    assert made.count() == 293 and made.where("w2_path_efficiency < 0 OR w2_pca_ratio < 0").count() == 0
    assert compute_columns(frames.limit(0), ["w2_vel_mean", "larva_body_length"]).count() == 0


def test_registry():
    r = Registry()
    r.register("a", prereqs=["b"])(lambda *x: None)
    with pytest.raises(ValueError, match="already"):
        r.register("a")(lambda *x: None)
    r.register("b", prereqs=["a"])(lambda *x: None)
    with pytest.raises(ValueError, match="cycle"):
        r.ordered(["a"])
    assert len(features.REGISTRY.features) == 49
    with pytest.raises(ValueError):
        features.full_sweep(None, [])


def test_quantiles_are_exact(spark):
    r = random.Random(9)
    data = [(k, r.choice([None, float("nan"), round(r.gauss(0, 1), 2)])) for k in ("a", "b", None) for _ in range(700)] + [("c", 1.0), ("d", None)]
    for q in (0.0, 0.25, 0.5, 0.75, 1.0):
        found = {x["k"]: x["v"] for x in group_quantiles(spark.createDataFrame(data, "k string, v double"), ["k"], ["v"], q, bins=16).collect()}
        for k in ("a", "b", None, "c"):
            values = [v for g, v in data if g == k and v is not None and not math.isnan(v)]
            assert found[k] == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_turn_events_by_hand():
    amp = np.array([9.0, 1, 5, 1, 5, 5, 1, 1, 7, 1, 2, 8])
    # ends are no maxima; both rows of a plateau are; 4 is too near to 2, 5 is not
    assert kernels.turn_events(amp, 4, 3).tolist() == [2, 5, 8]
    assert kernels.turn_events(amp, 4, 1).tolist() == [2, 4, 5, 8]
    assert kernels.turn_events(amp, 6, 1).tolist() == [8] and kernels.turn_events(amp, 10, 1).tolist() == []
    assert kernels.turn_events(amp[:2], 0, 1).tolist() == [] and kernels.turn_events(np.array([]), 0, 1).tolist() == []


def test_turn_statistics_by_hand():
    amp, side = np.zeros(24), np.ones(24)
    amp[[4, 8, 16]], side[8] = [2.0, 4.0, 6.0], -1.0
    x = np.arange(24.0)
    stats = kernels.turn_stats(x, 0 * x, amp, side, 2.0, 16, 1.0, 2)
    count, gap, widest, mean, spread, turned = stats[8]  # rows 0 to 16 hold all three
    assert (count, mean, turned) == (3, 4.0, 1.0)
    assert gap == pytest.approx(6 / 2, rel=1e-5) and widest == pytest.approx(8 / 2, rel=1e-5) and spread == pytest.approx(2 / 6, rel=1e-5)
    assert stats[0].tolist()[:4] == [2, pytest.approx(2, rel=1e-5), pytest.approx(2, rel=1e-5), 3.0] and stats[0][4] == 0.0
    assert stats[23].tolist() == [1, 0, 0, 6.0, 0, 0]


def test_other_kernels_against_loops():
    r = np.random.default_rng(5)
    x, y = np.cumsum(r.normal(size=60)), np.cumsum(r.normal(size=60))
    near = kernels.revisit(x, y, 7)
    for i in range(60):
        assert near[i] == pytest.approx(min(math.hypot(x[i] - x[i - j], y[i] - y[i - j]) for j in range(1, 7)) if i >= 7 else 0.0)
    straight = kernels.path_efficiency(np.arange(50.0), np.zeros(50), 10)
    assert np.allclose(straight, 1.0)
    wave = np.sin(2 * np.pi * 1.0 * np.arange(120) / 6)
    assert np.allclose(kernels.dominant_frequency(wave, 36, 6.0), 1.0) and not kernels.dominant_frequency(wave[:10], 36, 6.0).any()
    assert kernels.median_filter(np.array([0, 0, 1, 0, 1, 1, 0, 1]), 4).tolist() == [0, 0, 0, 1, 1, 1, 1, 1]


def test_frames_are_shuffled_once_and_code_of_variances_is_compiled(spark, frames, capsys, monkeypatch):
    plans, write = [], signals.stage

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(signals, "stage", seen)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = compute_columns(frames.where("ID < 9"), ["w5_vel_mean", "w5_rog", "w5_pause_fraction"])
        made.explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert dict(plans)["frames"].count("ReusedExchange") == 1
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert len(sizes) > 5 and max(sizes) < 8000  # the JVM never compiles longer methods
