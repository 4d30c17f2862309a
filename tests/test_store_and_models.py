import random

import numpy as np
import pytest

from test_features import SCHEMA, walk
from trackloom.operators import annotate, labels, ml
from trackloom.operators.features import Registry, REGISTRY
from trackloom.sources.files import read_annotation_csv, read_trajectories, write_split
from trackloom.sources.store import FeatureSetConfig, FeatureStore


def test_store(spark, tmp_path):
    frames = spark.createDataFrame(walk("A", 1, 60, 1) + walk("B", 1, 30, 2), SCHEMA)
    store = FeatureStore(spark, str(tmp_path / "store"))
    assert store.update(frames, ["w2_vel_mean", "larva_body_length"]) == ["w2_vel_mean", "larva_body_length"]
    assert store.update(frames, ["w2_vel_mean", "w2_rog"]) == ["w2_rog"] and store.stale() == []
    made = store.load(["w2_rog", "w2_vel_mean"], sources=["A"])
    assert made.columns == ["source", "ID", "frame", "w2_rog", "w2_vel_mean"] and made.count() == 60
    with pytest.raises(KeyError):
        store.load(["w9_rog"])
    assert store.load(["w9_rog", "w2_rog"], fill=0.0).where("w9_rog <> 0").count() == 0
    newer = Registry({**REGISTRY.features, "rog": REGISTRY.features["rog"].__class__("rog", 9, REGISTRY.features["rog"].build)})
    assert FeatureStore(spark, store.root, registry=newer).stale() == ["w2_rog"]
    config = FeatureSetConfig.from_columns(["larva_body_length", "w2_rog", "w3_rog"], "mine")
    config.save(spark, str(tmp_path / "set.json"))
    again = FeatureSetConfig.load(spark, str(tmp_path / "set.json"))
    assert again == config and again.get_id() == config.get_id() and again.windows_of("rog") == [2, 3]
    assert store.validate(config) == ["w3_rog"] and store.validate(config, frames) == []
    assert store.health(frames.where("source = 'A'")) == {"not_stored": [], "not_in_frames": ["B"], "stale": [], "code_changed": []}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("File,AN,ID,t0_sec,t1_sec,behavior,Tag\n GA1 ,1,7,0.5,2,Dwell,slow\nGA1,1,x,0,1,run,\n")
    (tmp_path / "b.csv").write_text("source,ID,t0,t1,Behavior,tags,notes\nga1,7,2,1,turn,,\nga1,8,2,3,,a,\nga1,9,2,3,Arc,a,n\n")
    both = read_annotation_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    clean = labels.annotations(both)
    assert sorted((r["source"], r["ID"], r["Behavior"], r["file_order"]) for r in clean.collect()) == [("GA1", 7, "dwelling", 0), ("GA1", 9, "nondwelling", 1)]
    old = spark.createDataFrame([("A", "1", 0.0, 1.0), ("B", "z", 0.0, 1.0)], "source string, ID string, et double, spinex_0 double")
    old.write.parquet(str(tmp_path / "old.parquet"))
    assert [tuple(r) for r in read_trajectories(spark, str(tmp_path / "old.parquet"), ["B"]).collect()] == [("B", None, 0.0, 1.0)]
    write_split(spark.createDataFrame([("A", 1, "train"), ("A", 2, None)], "source string, ID long, split string"), str(tmp_path / "split"))
    assert spark.read.option("header", True).csv(str(tmp_path / "split")).count() == 1


def test_annotation_tool(spark, got):
    frames = spark.createDataFrame([("A", 1, f, f / 6) for f in range(61)], "source string, ID long, frame long, et double")
    held = spark.createDataFrame([("a", "A", 1, 2.0, 4.0, "dwelling", "Slow; fast;slow")], "annotation_id string, source string, ID long, t0 double, t1 double, Behavior string, tags string")
    new = spark.createDataFrame([("n1", "A", 1, -5.0, 2.01, "X;x"), ("n2", "A", 1, 5.0, 5.0, ""), ("n3", "A", 1, 3.0, 99.0, None), ("n4", "Z", 1, 0.0, 1.0, "")], "annotation_id string, source string, ID long, t0 double, t1 double, tags string")
    added = {r["annotation_id"]: (r["t0_frame"], r["t1_frame"], r["overlaps"]) for r in annotate.add_intervals(new, frames, held).collect()}
    assert added == {"n1": (0, 12, 0), "n2": (30, 31, 0), "n3": (18, 60, 1)}
    assert got(annotate.gaps(held, frames), "gap_start", "gap_end") == [(0.0, 2.0), (4.0, 10.0)]
    assert annotate.fill_gaps(held, frames, "other").count() == 2
    assert annotate.coverage(held, frames).first()["share"] == pytest.approx(0.2)
    assert annotate.delete(held, held.select("annotation_id")).count() == 0 and annotate.tracks_with(held, "dwelling").count() == 1
    assert [(r["tag"], r["n"]) for r in annotate.tag_memory(held).orderBy("place").collect()] == [("slow", 2), ("fast", 1)]


def test_intervals_in_holes_of_a_track_are_snapped(spark):
    seen = [*range(31), *range(1200, 1231)]
    frames = spark.createDataFrame([("A", 1, f, f / 6) for f in seen], "source string, ID long, frame long, et double")
    held = spark.createDataFrame([("a", "A", 1, 200.0, 201.0)], "annotation_id string, source string, ID long, t0 double, t1 double")
    new = spark.createDataFrame([("n1", "A", 1, 40.0, 60.0), ("n2", "A", 1, 2.0, 180.0), ("n3", "A", 1, 102.5, 300.0)], "annotation_id string, source string, ID long, t0 double, t1 double")
    added = {r["annotation_id"]: (r["t0_frame"], r["t1_frame"], r["overlaps"]) for r in annotate.add_intervals(new, frames, held).collect()}
    assert added == {"n1": (30, 31, 0), "n2": (12, 1200, 0), "n3": (30, 1230, 1)}


def test_overlaps_count_once_and_meet_in_buckets(spark, capsys):
    frames = spark.createDataFrame([("A", 1, f, f / 6) for f in range(3001)], "source string, ID long, frame long, et double")
    r = random.Random(6)
    spans = [(str(k), "A", 1, a / 6, b / 6) for k in range(80) for a in [r.randrange(2900)] for b in [min(a + r.choice([3, 60, 1500]), 3000)]]
    kind = "annotation_id string, source string, ID long, t0 double, t1 double"
    held = [*spans, ("x", "A", 1, -50.0, float("inf")), ("y", "A", 1, 900.0, float("inf")), ("z", "A", 1, 60.0, 60.0)]
    added = annotate.add_intervals(spark.createDataFrame(spans, kind), frames, spark.createDataFrame(held, kind))
    expected = {k: sum(a < d and c < b for _, _, _, c, d in held) for k, _, _, a, b in spans}
    assert {x["annotation_id"]: x["overlaps"] for x in added.collect()} == expected
    added.explain()
    assert any("Join" in line and line.count("_bucket") >= 2 for line in capsys.readouterr().out.splitlines())


def test_models(spark):
    r = random.Random(1)
    data = [("A", k % 10, i, k % 2, (k % 2) + r.gauss(0, 0.4), r.gauss(0, 1)) for i, k in enumerate(range(1200))]
    data = [(s, t, i, y, x if i % 50 else None, z) for s, t, i, y, x, z in data]
    df = spark.createDataFrame(data, "source string, ID long, frame long, label int, good double, noise double")
    forest = {"trees": 8, "depth": 4, "leaf": 5}
    folds = spark.createDataFrame([("A", i, int(i in (0, 1, 4, 5))) for i in range(10)], "source string, ID long, fold int")
    assert all(s["auroc"] > 0.8 for s in ml.cross_validate(df, ["good", "noise"], folds, **forest))
    model = ml.train(df, ["good", "noise"], **forest)
    assert ml.importances(model, ["good", "noise"])[0][0] == "good"
    lost = {r["feature"]: r for r in ml.permutation_importance(model, df, ["good", "noise"], repeats=3, bucket_rows=300).collect()}
    assert set(lost) == {"good", "noise"} and lost["good"]["loss"] > 0.3 > 0.05 > abs(lost["noise"]["loss"])
    assert ml.representatives(df, ["good", "noise"]) == ["good", "noise"]
    assert ml.clusters(np.array([[1, 0.9, 0], [0.9, 1, 0], [0, 0, 1]])) == [[0, 1], [2]]
