"""Outputs of models and searches, tallies, filters and staged tables."""

import gc
import math
import os

import pytest
from pyspark.sql import functions as F

from trackloom.operators import annotate, bouts, features, metrics, ml
from trackloom.plans import staging
from trackloom.sources import files


def test_outputs_come_back(spark, tmp_path):
    df = spark.createDataFrame([("A", i % 3, i, i % 2, float(i % 2)) for i in range(60)], "source string, ID long, frame long, label int, good double")
    path = files.write_predictions(df, str(tmp_path), "m1_t0.5")
    assert path.endswith("m1_t0.5_predictions") and files.read_predictions(spark, str(tmp_path), "m1_t0.5").count() == 60
    model = ml.train(df, ["good"], trees=3, depth=2, leaf=1)
    files.write_model(model, df, f"{tmp_path}/model")
    again, metadata = files.read_model(spark, f"{tmp_path}/model")
    assert metadata.where("true_behavior = 1").count() == 30 and ml.infer(again, df, ["good"]).count() == 60
    files.write_ranking(spark.createDataFrame([("good", 1.0)], "feature string, importance double"), f"{tmp_path}/ranking")
    assert spark.read.option("header", True).csv(f"{tmp_path}/ranking").first()["feature"] == "good"
    store = f"{tmp_path}/trials"
    assert files.read_trials(spark, store, "a") is None
    files.append_trials(spark, store, "a", [{"trees": 3, "score": 0.5}])
    files.append_trials(spark, store, "a", [{"trees": 4, "score": 0.6}, {"trees": 5, "score": 0.1}])
    files.append_trials(spark, store, "b", [{"trees": 9, "score": 0.9}])
    assert [(r["number"], r["setting"]) for r in files.read_trials(spark, store, "a").orderBy("number").collect()] == [(0, '{"trees": 3}'), (1, '{"trees": 4}'), (2, '{"trees": 5}')]
    files.append_log(spark, f"{tmp_path}/log", "save", {"rows": 3}, "ok")
    assert spark.read.parquet(f"{tmp_path}/log").first()["payload_json"] == '{"rows": 3}'


def test_tallies_and_tagged_confusion(spark, got):
    labels = spark.createDataFrame([("dwell", "a; b"), ("dwelling", ""), ("odd", None), ("dwelling", "a")], "behavior string, tags string")
    assert got(bouts.tag_tallies(labels)) == [("dwelling", "(no tag)", 1), ("dwelling", "a", 2), ("dwelling", "b", 1), ("other", "(no tag)", 1)]
    rows = spark.createDataFrame([(1, 1, "a; b"), (1, 0, "a"), (0, 0, None), (0, 1, ""), (None, 1, "a"), (1, None, "a")], "truth int, prediction int, tags string")
    assert got(metrics.tagged_confusion(rows)) == [(0, "None", 1, 1, 50.0, 50.0), (1, "a", 1, 1, 50.0, 50.0), (1, "b", 0, 1, 0.0, 100.0)]
    assert metrics.tagged_confusion(rows.limit(0)).count() == 0


def test_coverage_filter_and_counts(spark):
    rows = spark.createDataFrame([(0.1, 0.9, 0.9, True), (0.9, 0.9, 0.4, True), (0.9, 0.9, None, True), (0.1, 0.9, 0.9, None)], "w11_coverage double, w30_coverage double, w50_coverage double, is_target boolean")
    judged = features.covered(rows, 0.5)
    assert tuple(features.coverage_counts(judged).first()) == (4, 3, 2, 1)


def test_log_loss_and_mean_roc(spark):
    rows = spark.createDataFrame([("a", 1, 0.8), ("a", 0, 0.2), ("a", 0, 0.0), ("b", 1, 0.3), ("b", 0, 0.3), ("c", 1, 0.9), ("c", None, 0.4)], "fold string, truth int, prob double")
    assert metrics.log_loss(rows.where("fold = 'a'")).first()[0] == pytest.approx(-(2 * math.log(0.8)) / 3)
    curve = {r["point"]: r for r in metrics.mean_roc(rows, "fold", points=5).collect()}
    assert [curve[k]["mean_tpr"] for k in range(5)] == pytest.approx([(1 + k / 4) / 2 for k in range(5)]) and curve[0]["folds"] == 2
    assert metrics.log_loss(rows.limit(0)).first()[0] is None and metrics.mean_roc(rows.limit(0), "fold").count() == 0


def test_annotation_steps(spark, got):
    frames = spark.createDataFrame([("A", 1, f, f / 6) for f in range(61)], "source string, ID long, frame long, et double")
    held = spark.createDataFrame([("a", "A", 1, 2.0, 4.0), ("b", "A", 1, 5.0, 6.0)], "annotation_id string, source string, ID long, t0 double, t1 double")
    whole = annotate.set_track(frames, ("A", 1), "other").first()
    assert (whole["t0"], whole["t1"], whole["Behavior"]) == (0.0, 10.0, "other") and annotate.set_track(frames, ("B", 1), "other").count() == 0
    at = spark.createDataFrame([("A", 1, 1.0), ("A", 1, 2.5), ("A", 1, 7.0), ("A", 1, 10.0)], "source string, ID long, at double")
    assert got(annotate.next_gap(held, frames, at), "at", "gap_start", "gap_end") == [(1.0, 0.0, 2.0), (2.5, 4.0, 5.0), (7.0, 6.0, 10.0)]
    steps = spark.createDataFrame([("a", 1), ("b", 2)], "annotation_id string, step int")
    assert got(annotate.undo(held, steps), "annotation_id") == [("a",)] and annotate.undo(held, steps.limit(0)).count() == 2


def test_staged_tables_go_when_nothing_reads_them(spark):
    folder = staging.shared_folder(spark).removeprefix("file:")
    staging.sweep(every=True)
    table, path = staging.stage(spark.range(10).select(F.col("id").alias("v")), "kept")
    derived = table.where("v > 3")
    del table
    gc.collect()
    spark._jvm.System.gc()
    staging.sweep()
    assert derived.count() == 6  # still readable through what was made of it
    del derived
    for _ in range(20):
        gc.collect()
        spark._jvm.System.gc()
        staging.sweep()
        if not os.path.exists(path.removeprefix("file:")):
            break
    assert not os.path.exists(path.removeprefix("file:")) and os.path.isdir(folder)


def test_features_read_the_frames_once(spark, tmp_path):
    """One scan of the trajectories over all jobs; what follows reads the table written from it."""
    from test_features import SCHEMA, walk

    spark.createDataFrame(walk("A", 1, 300, 1) + walk("B", 2, 200, 2), SCHEMA).write.parquet(f"{tmp_path}/frames")
    made = features.compute_columns(spark.read.parquet(f"{tmp_path}/frames"), ["w2_vel_mean", "w2_vel_std", "larva_body_length"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert f"{tmp_path}/frames" not in plan and plan.count("Exchange hashpartitioning") <= 8 and made.count() == 500
