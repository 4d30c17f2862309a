"""Forests against brute force, and what their fits cost."""

import random

import numpy as np
import pytest

from trackloom.operators import forest, ml


def data(rows: int = 3000, features: int = 4, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    codes = r.integers(0, forest.BINS, (rows, features)).astype(np.uint8)
    return (r.random(rows) < 0.2 + 0.6 * (codes[:, 1] > 12)).astype(np.uint8), codes


def frames(spark, rows: int = 900):
    r = random.Random(3)
    made = [("A", i % 9, i, i % 2, (i % 2) + r.gauss(0, 0.6), r.gauss(0, 1) if i % 40 else None) for i in range(rows)]
    return spark.createDataFrame(made, "source string, ID long, frame long, label int, good double, noise double")


def test_splits_are_the_best_and_leaves_hold_their_shares():
    label, codes = data()
    weights = np.array([1.0, 2.5])
    tree = forest.grow(label, codes, weights, (7, 0), 3, 50, "all")
    times = np.random.default_rng([7, 0]).poisson(1.0, len(label))
    base = np.arange(len(label)) * codes.shape[1]
    left, cut, feature = tree.nodes >> 24, tree.nodes >> 16 & 255, tree.nodes & 0xFFFF
    held = {0: np.flatnonzero(times)}
    for node in range(len(tree.nodes)):
        rows = held[node]
        weight = times[rows] * weights[label[rows]]
        assert tree.prob[node] == pytest.approx((weight * label[rows]).sum() / weight.sum(), rel=1e-5)
        if left[node] == node:
            assert (tree.leaves(codes.ravel(), base)[rows] == node).all()
            continue

        def impurity(part):
            w = times[part] * weights[label[part]]
            p = (w * label[part]).sum() / w.sum()
            return w.sum() * 2 * p * (1 - p)

        found = {}
        for f in range(codes.shape[1]):
            for t in range(forest.BINS - 1):
                a, b = rows[codes[rows, f] <= t], rows[codes[rows, f] > t]
                if times[a].sum() >= 50 and times[b].sum() >= 50:
                    found[f, t] = impurity(rows) - impurity(a) - impurity(b)
        f, t = feature[node], cut[node]
        assert found[f, t] == pytest.approx(max(found.values()), rel=1e-9)
        held[left[node]], held[left[node] + 1] = rows[codes[rows, f] <= t], rows[codes[rows, f] > t]


def test_permuted_rows_are_scored_as_if_written_out(monkeypatch):
    label, codes = data()
    trees = [forest.grow(label, codes, np.ones(2), (1, i), 9, 10, "0.5") for i in range(5)]
    own = codes[:700]
    given = np.stack([own[np.random.default_rng(k).permutation(700)] for k in range(7)], axis=1)
    for most in (63, 5):  # one mask, several
        monkeypatch.setattr(forest, "VARIANTS", most)
        found = forest.permuted_scores(trees, own, given)
        assert found.shape == (700, 1 + 7 * 4) and np.allclose(found[:, 0], forest.scores(trees, own))
        for k in range(7):
            for f in range(4):
                written = own.copy()
                written[:, f] = given[:, k, f]
                assert np.allclose(found[:, 1 + 4 * k + f], forest.scores(trees, written))


def test_cuts_lie_between_distinct_values():
    assert forest.cut_points(np.array([0.0, 0, 0, 1, 1, 4])).tolist() == [0.5, 2.5]
    assert forest.cut_points(np.array([3.0, 3.0])).tolist() == [] and forest.cut_points(np.array([])).tolist() == []
    skewed = np.sort(np.concatenate([np.zeros(900), np.arange(1, 101)]))
    assert len(forest.cut_points(skewed)) <= 31 and forest.cut_points(skewed)[0] == 0.5
    even = forest.cut_points(np.arange(3200.0))
    assert len(even) == 31 and (np.diff(even) == 100).all()
    bins = forest.Binning(("a",), (2.0,), (np.array([1.5, 2.5]),))
    assert bins.codes([np.array([1.5, 1.6, 9.0, np.nan, np.inf, -np.inf])]).ravel().tolist() == [0, 1, 2, 1, 2, 0]


def test_permutations_score_each_row_in_one_pass(spark):
    df = frames(spark)
    model = ml.train(df, ["good", "noise"], trees=6, depth=4, leaf=5)
    lost = ml.permutation_importance(model, df, ["good", "noise"], repeats=4, bucket_rows=300)
    plan = lost._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 2 and "Generate" not in plan  # AQE shows a plan twice at most
    found = {r["feature"]: r["loss"] for r in lost.collect()}
    assert set(found) == {"good", "noise"} and found["good"] > 0.15 > abs(found["noise"])


def jobs(spark, name: str, run) -> tuple[object, int]:
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_folds_take_few_jobs_whatever_the_depth(spark):
    df = frames(spark)
    folds = spark.createDataFrame([("A", i, i % 3) for i in range(9)], "source string, ID long, fold int")
    shallow = jobs(spark, "shallow", lambda: ml.cross_validate(df, ["good", "noise"], folds, trees=4, depth=2, leaf=5))
    deep = jobs(spark, "deep", lambda: ml.cross_validate(df, ["good", "noise"], folds, trees=12, depth=12, leaf=2))
    assert deep[1] <= shallow[1] + 2  # not one job per level
    cells = [{"n": s["tp"] + s["fp"] + s["fn"] + s["tn"], "fold": s["fold"]} for s in deep[0]]
    assert cells == [{"n": 300, "fold": f} for f in range(3)] and all(s["auroc"] > 0.75 for s in deep[0])


def test_a_fold_without_labels_keeps_its_row(spark):
    df = frames(spark)
    folds = spark.createDataFrame([*[("A", i, i % 2) for i in range(9)], ("Z", 1, 2)], "source string, ID long, fold int")
    found = ml.cross_validate(df, ["good"], folds, trees=3, depth=3, leaf=5)
    assert [s["fold"] for s in found] == [0, 1, 2] and found[2]["tp"] == 0 and found[2]["auroc"] is None and found[0]["auroc"] > 0.75


def test_settings_of_a_search_share_their_jobs(spark):
    df = frames(spark)
    folds = spark.createDataFrame([("A", i, i % 3) for i in range(9)], "source string, ID long, fold int")
    space = {"trees": (3, 5), "depth": (2, 4), "leaf": (5, 20), "subset": ("0.5", "all")}
    one = jobs(spark, "one", lambda: ml.random_search(df, ["good", "noise"], folds, space, draws=1))
    six = jobs(spark, "six", lambda: ml.random_search(df, ["good", "noise"], folds, space, draws=6))
    assert six[1] <= one[1] + 2 and len(six[0]) == 6
    best = six[0][0]
    alone = ml.cross_validate(df, ["good", "noise"], folds, **{k: best[k] for k in space})
    assert best["score"] == pytest.approx(np.mean([s["average_precision"] for s in alone])) and best["score"] >= six[0][-1]["score"]


def test_scores_are_those_of_the_trees_and_cost_no_jobs_by_level(spark, tmp_path):
    df = frames(spark)
    shallow = jobs(spark, "few", lambda: ml.train(df, ["good", "noise"], trees=4, depth=2, leaf=5))
    model, n = jobs(spark, "many", lambda: ml.train(df, ["good", "noise"], trees=12, depth=14, leaf=1))
    assert n <= shallow[1] + 2 and max(t.depth for t in model.trees) > 8
    found = {r["frame"]: r["prob"] for r in ml.infer(model, df, ["good", "noise"], ["frame"]).collect()}
    rows = df.collect()
    columns = [np.array([np.nan if r[c] is None else r[c] for r in rows]) for c in ("good", "noise")]
    expected = forest.scores(model.trees, model.bins.codes(columns))
    assert len(found) == 900 and np.allclose([found[r["frame"]] for r in rows], expected)
    model.save(spark, str(tmp_path / "model"))
    again = forest.Forest.load(spark, str(tmp_path / "model"))
    assert np.allclose(forest.scores(again.trees, again.bins.codes(columns)), expected)


def test_rows_alike_are_held_once_with_their_number(spark):
    df = frames(spark)
    bins = forest.binning(df.select("good", "noise"), ["good", "noise"])
    label, codes, times = forest.packed(df, "label", bins)
    label2, codes2, times2 = forest.packed(df.unionByName(df).unionByName(df).repartition(5), "label", bins)
    assert (label == label2).all() and (codes == codes2).all() and (3 * times == times2).all() and times.sum() == 900
    rows = df.collect()
    columns = [np.array([np.nan if r[c] is None else r[c] for r in rows]) for c in ("good", "noise")]
    written = sorted((r["label"], *c) for r, c in zip(rows, bins.codes(columns).tolist(), strict=True))
    assert written == sorted(row for row, n in zip(zip(label.tolist(), *codes.T.tolist(), strict=True), times.tolist(), strict=True) for _ in range(n))


def test_a_row_with_a_count_weighs_as_that_many_and_blocks_change_nothing(monkeypatch):
    label, codes = data(6000, 3)
    rows, counts = forest.counted(np.column_stack([label, codes // 4]), np.ones(6000, np.int64))
    assert len(rows) < 2000 and counts.sum() == 6000
    label, codes, weights = rows[:, 0], np.ascontiguousarray(rows[:, 1:]), np.array([1.0, 1.5])
    whole = forest.grow(label, codes, weights, (3, 1), 8, 20, "all", counts=counts)
    times = np.random.default_rng([3, 1]).poisson(counts)
    at = whole.leaves(codes.ravel(), np.arange(len(codes)) * 3)
    for leaf in np.unique(at):
        inside = (at == leaf) & (times > 0)
        weight = times[inside] * weights[label[inside]]
        assert times[inside].sum() >= 20 and whole.prob[leaf] == pytest.approx((weight * label[inside]).sum() / weight.sum(), rel=1e-5)
    monkeypatch.setattr(forest, "BLOCK", 64)
    cut = forest.grow(label, codes, weights, (3, 1), 8, 20, "all", counts=counts)
    assert len(cut.nodes) == len(whole.nodes) > 50 and cut.depth == whole.depth and np.allclose(cut.gains, whole.gains)
    assert np.array_equal(forest.scores([cut], codes), forest.scores([whole], codes))
    inner = np.flatnonzero(cut.nodes >> 24 != np.arange(len(cut.nodes)))
    assert (cut.nodes[inner] >> 24 > inner).all()  # children come after their parents


def fitted(monkeypatch) -> list[int]:
    """Gets the number of rows that each fit goes by."""
    seen, packed = [], forest.packed

    def counting(*args):
        found = packed(*args)
        seen.append(int(found[2].sum()))
        return found

    monkeypatch.setattr(forest, "packed", counting)
    return seen


def many(spark, rows: int):
    """A track of so many rows and two small ones."""
    small = spark.range(40).selectExpr("'A' AS source", "1 + id % 2 AS ID", "id AS frame", "CAST(id DIV 2 % 2 AS INT) AS label", "CAST(id DIV 2 % 3 AS DOUBLE) AS x")
    return spark.range(rows).selectExpr("'A' AS source", "0L AS ID", "id AS frame", "CAST(id % 2 AS INT) AS label", "CAST(id % 7 AS DOUBLE) AS x").unionByName(small)


def test_a_fit_goes_by_every_labelled_row(spark, monkeypatch):
    seen, rows = fitted(monkeypatch), 6_000_000  # more than fits were once cut to
    ml.train(many(spark, rows), ["x"], trees=2, depth=3)
    folds = spark.createDataFrame([("A", i, int(i > 0)) for i in range(3)], "source string, ID long, fold int")
    ml.cross_validate(many(spark, rows), ["x"], folds, trees=2, depth=3)
    assert seen == [rows + 40, 40, rows]


def test_a_search_goes_by_every_labelled_row(spark, monkeypatch):
    seen, rows = fitted(monkeypatch), 6_000_000
    folds = spark.createDataFrame([("A", i, int(i > 0)) for i in range(3)], "source string, ID long, fold int")
    found = ml.random_search(many(spark, rows), ["x"], folds, {"trees": (1, 2), "depth": (2,)}, draws=2)
    assert seen == [40, rows] and len(found) == 2
