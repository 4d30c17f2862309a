import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_features import SCHEMA as FRAME_SCHEMA
from test_features import walk
from test_islands import closed_and_opened
from trackloom.operators import bouts, legacy, metrics
from trackloom.operators.features import compute_columns
from trackloom.operators.kernels import median_filter
from trackloom.operators.postprocess import PostProcess, drawn, search

SCHEMA = "source string, ID long, frame long, et double, prob double, truth int"


@pytest.fixture(scope="module")
def data():
    r = random.Random(3)
    return [("A", t, f, f / 6, r.choice([None, *[round(r.random(), 2)] * 6]), int(40 <= f < 90)) for t in range(5) for f in range(150)]


def test_bouts_and_predictions_match_loops(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    config = PostProcess(median_s=0.5, on=0.6, close_s=0.5, open_s=0.7)
    expected = {}
    for t in range(5):
        probs = median_filter(np.array([p or 0.0 for _, k, _, _, p, _ in data if k == t]), 3)
        for f, v in enumerate(closed_and_opened([int(p > 0.6) for p in probs], 3, 4)):
            expected[(t, f)] = v
    assert {(r["ID"], r["frame"]): r["prediction"] for r in config.predictions(df).collect()} == expected
    assert sum(r["n"] for r in config.bouts(df).collect()) == sum(expected.values())
    assert config.get_id() == "m0.5_t0.6_c0.5_o0.7"
    assert config.bouts(df.limit(0)).count() == 0


def test_search_orders_by_f1(spark, data):
    """One plan for all settings gives what each setting gives by itself."""
    df = spark.createDataFrame(data, SCHEMA)
    configs = [PostProcess(0, 2.0, None, 0, 0), PostProcess(0, 0.1, 0.05, 0, 0), PostProcess(0.5, 0.6, 0.4, 0.5, 0.7), PostProcess(0.5, 0.5, None, 1.0, 0.3)]
    scores = {r["config"]: r for r in search(df, configs).collect()}
    assert len(scores) == 4 and scores["m0_t2_c0_o0"]["f1"] == 0.0
    for c in configs:
        cells = metrics.derived(metrics.confusion(c.predictions(df))).first()
        r = scores[c.get_id()]
        assert (r["tp"], r["fp"], r["fn"]) == (cells["tp"], cells["fp"], cells["fn"]) and r["f1"] == pytest.approx(cells["f1"] or 0.0)
    assert search(df, []).count() == 0 and len(set(drawn())) == 20 and len(drawn(10**6)) == 216


def test_contributing_events(spark):
    truth, pred = [0] * 10 + [1] * 10 + [0] * 10 + [1] * 10, [1] * 5 + [0] * 10 + [1] * 3 + [0] * 12 + [1] * 2 + [0] * 8
    df = spark.createDataFrame([("A", 1, i, i / 6, t, p) for i, (t, p) in enumerate(zip(truth, pred, strict=True))], "source string, ID long, frame long, et double, truth int, prediction int")
    events = metrics.contributing_events(df)
    assert sorted((r["kind"], round(r["share"], 3)) for r in events.collect()) == [("fn", 0.2), ("fp", 1.0), ("fp", 1.0), ("tp", 0.3)]
    scores = metrics.event_scores(events).first()
    assert (scores["tp"], scores["fp"], scores["fn"]) == (1, 2, 1) and scores["f1"] == pytest.approx(0.4)


def test_windows_and_modes(spark, got):
    events = spark.createDataFrame([("A", 1, 100.0, 110.0), ("A", 1, 120.0, 130.0), ("A", 2, 50.0, 60.0)], "source string, ID long, t0 double, t1 double")
    assert got(bouts.event_windows(events), "ID", "w0", "w1") == [(1, 65.0, 120.0), (1, 110.0, 165.0), (2, 15.0, 95.0)]
    tags = spark.createDataFrame([("A", 1, t) for t in ["b", "a", "b", "a", None, None, None]], "source string, ID long, v string")
    assert got(bouts.most_frequent(tags, "v")) == [("A", 1, "a", 2)]


def test_legacy_features(spark):
    with pytest.raises(ValueError):
        legacy.columns(12)
    frames = spark.createDataFrame(walk("A", 1, 200, 1), FRAME_SCHEMA)
    wanted = [c for c in legacy.columns(30) if "coverage" in c or "rog" in c or "angular" in c]
    made = compute_columns(frames, wanted, registry=legacy.LEGACY, **legacy.SIGNALS)
    assert made.count() == 200 and made.where("w30_coverage > 1 OR w30_coverage <= 0").count() == 0


def test_legacy_revisits_look_back_a_window_of_frames(spark):
    data = [(*row[:3], row[3] if row[3] is not None or row[2] < 100 else row[5], *row[4:]) for row in walk("A", 1, 4400, 7)] + walk("A", 2, 100, 8)
    wanted = [f"w{w}_{f}" for w in (30, 75) for f in ("revisitation_mean", "revis_slope_smooth")]
    assert set(wanted) <= {*legacy.columns(30), *legacy.columns(75)} and "w11_revisitation_mean" not in legacy.columns(11)
    made = compute_columns(spark.createDataFrame(data, FRAME_SCHEMA), wanted, registry=legacy.LEGACY, rows=100, **legacy.SIGNALS).toPandas()
    for track in (1, 2):
        found = made[made["ID"] == track].sort_values("frame")
        x, y = (np.array([row[c] for row in data if row[1] == track], dtype=float) for c in (3, 4))
        for w in (30, 75):
            n, k, rows = 6 * w, w, len(x)
            near = [np.nan_to_num(np.hypot(x[i] - x[i - n + 1 : i], y[i] - y[i - n + 1 : i]), nan=1e9).min() if i >= n else 0.0 for i in range(rows)]
            mean = np.array([np.mean(near[max(i - n + 1, 0) : i + 1]) for i in range(rows)])
            slope = mean[np.minimum(np.arange(rows) + k, rows - 1)] - mean[np.maximum(np.arange(rows) - k, 0)]
            np.testing.assert_allclose(found[f"w{w}_revisitation_mean"].to_numpy(float), mean, rtol=1e-9, atol=1e-6)
            np.testing.assert_allclose(found[f"w{w}_revis_slope_smooth"].to_numpy(float), slope, rtol=1e-9, atol=1e-6)


def test_summaries_hold_no_group_in_one_buffer(spark, got):
    r = random.Random(9)
    tracks = [(s, k, r.choice([0.0, round(r.random(), 3)])) for s in ("A", None) for k in range(60)] + [("Z", 1, 0.0), ("Z", 2, None)]
    made = bouts.hurdle(spark.createDataFrame(tracks, "source string, ID long, mean double"))
    expected = []
    for s in (None, "A", "Z"):
        v = [m for q, _, m in tracks if q == s]
        up = [m for m in v if m]
        expected.append((s, pytest.approx(100 * len(up) / sum(m is not None for m in v)), *(pytest.approx(np.quantile(up, p)) if up else None for p in (0.25, 0.5, 0.75)), len(v)))
    assert got(made) == expected
    spans = spark.createDataFrame([(d,) for d in (4.0, 1.0, 2.0, 9.0)] + [(None,)], "d double")
    durations = bouts.duration_summary(spans, {"all": F.lit(True), "long": F.col("d") > 3, "none": F.col("d").isNull()}, F.col("d"))
    assert got(durations) == [("all", 5, 1.0, 3.0, 9.0), ("long", 2, 4.0, 6.5, 9.0), ("none", 1, None, None, None)]
    places = spark.createDataFrame([("A", k, x, 0.0) for k in range(4) for x in (0.0, float(k))] + [("A", 9, None, None)], "source string, ID long, x double, y double")
    span = bouts.track_range(places)
    assert span.first()["span"] == pytest.approx(2.25 * 1.25) and got(bouts.track_range(places.limit(0))) == [(None,)]
    for df in (made, durations, span):
        assert "percentile" not in (plan := df._jdf.queryExecution().toString().lower()) and "median(" not in plan
