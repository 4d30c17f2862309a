import random

import numpy as np
import pytest

from trackloom.operators import metrics, sampling
from trackloom.operators.sampling import folds, ratio_sample, search_split, wilcoxon

SCHEMA = "source string, ID long, frame long, et double, truth int, prediction int, prob double"


def test_ranked_metrics_and_scores(rows):
    r = random.Random(1)
    data = [("A", 1, i, i / 6, r.choice([0, 1, None]), r.choice([0, 1, None]), r.choice([None, round(r.random(), 1)])) for i in range(400)]
    df = rows(SCHEMA, data)
    pairs = [(t, p) for *_, t, _, p in data if t is not None and p is not None]
    pos, neg = [p for t, p in pairs if t], [p for t, p in pairs if not t]
    auroc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap, tp, fp = 0.0, 0, 0
    for v in sorted({p for _, p in pairs}, reverse=True):
        hit = sum(1 for t, p in pairs if p == v and t)
        tp, fp = tp + hit, fp + sum(1 for t, p in pairs if p == v and not t)
        ap += hit * tp / (tp + fp)
    m = metrics.ranked_metrics(df).first()
    assert m["auroc"] == pytest.approx(auroc) and m["average_precision"] == pytest.approx(ap / len(pos))
    s = metrics.probability_scores(df).first()
    assert s["brier"] == pytest.approx(np.mean([(t - p) ** 2 for t, p in pairs]))
    c = metrics.confusion(df).first()
    assert sum(c) == sum(1 for *_, t, p, _ in data if t is not None and p is not None)


def test_empty_tables(rows):
    empty = rows(SCHEMA, [])
    assert metrics.ranked_metrics(empty).first()["auroc"] is None and metrics.derived(metrics.confusion(empty)).first()["f1"] is None and metrics.event_confusion(empty).count() == 0


def test_event_confusion(rows):
    def frames(truth, pred):
        return rows(SCHEMA, [("A", 1, i, i / 6, t, p, 0.0) for i, (t, p) in enumerate(zip(truth, pred, strict=True))])

    def kinds(*a, **o):
        return sorted(r["kind"] for r in metrics.event_confusion(frames(*a), **o).collect())

    half = [0] * 50 + [1] * 10 + [0] * 200
    assert kinds(half, [0] * 50 + [1] * 5 + [0] * 205) == ["fn"]  # exactly half isn't more than half
    assert kinds(half, [0] * 50 + [1] * 6 + [0] * 204) == ["tp"]
    assert kinds(half, [0] * 50 + [1] * 5 + [0] * 205, strict=False) == ["tp"]
    assert kinds(half, [0] * 60 + [1] * 30 + [0] * 170) == ["fn"]  # within 30 rows of the true event
    assert kinds(half, [0] * 90 + [1] + [0] * 169) == ["fn", "fp"]
    assert kinds(half, [1] * 9 + [0] * 251) == ["fn"]  # the ends of a negative run
    assert kinds(half, [1] * 10 + [0] * 250) == ["fn", "fp"]


def test_false_events_are_stretches(rows, got):
    """One predicted run over a true event gives a false event on each side, with ends of its own."""
    truth, pred = [int(100 <= i < 120) for i in range(400)], [int(20 <= i < 200) for i in range(400)]
    data = [("A", 1, i, i / 6, t, p, 0.0) for i, (t, p) in enumerate(zip(truth, pred, strict=True))]
    frames = lambda r: (r["kind"], round(r["t0"] * 6), round(r["t1"] * 6))
    events = metrics.event_confusion(rows(SCHEMA, data))
    assert sorted(map(frames, events.collect())) == [("fp", 20, 69), ("fp", 150, 199), ("tp", 100, 119)]
    r = random.Random(4)
    values, t, data, expected = [], 0, [], []
    while len(values) < 1500:
        values += [(t, r.random() < 0.5)] * r.randint(1, 40 if t else 150)
        t = 1 - t
    for i, (t, p) in enumerate(values):
        data.append(("B", 2, i, i / 6 + (i // 300), t, int(p), 0.0))
    for a in range(0, len(data), 300):  # the time jumps here
        part = data[a : a + 300]
        near = [any(q[4] for q in part[max(k - 30, 0) : k + 31]) for k in range(len(part))]
        same = lambda k, j, part=part: 0 <= j < len(part) and all(q[4] == 0 for q in part[min(j, k) : max(j, k) + 1])
        loose = [q[5] == 1 and not near[k] and same(k, k - 9) and same(k, k + 9) for k, q in enumerate(part)]
        for k, v in enumerate(loose):
            if v and not (k and loose[k - 1]):
                expected.append(a + k)
    made = metrics.event_confusion(rows(SCHEMA, data)).where("kind = 'fp'").collect()
    starts = sorted(next(q[2] for q in data if abs(q[3] - e["t0"]) < 1e-9) for e in made)
    assert starts == expected and len(expected) > 3
    listed = metrics.event_list(metrics.event_confusion(rows(SCHEMA, data)), rows("source string, ID long", [("B", 2), ("B", 2)]))
    assert listed.count() == listed.where("is_unseen AND kind <> 'tp'").count() > 0


def test_leak(rows):
    a, b = rows("source string, ID long", [("A", 1), ("B", 2)]), rows("source string, ID long", [("B", 2), ("C", 3)])
    with pytest.raises(ValueError):
        metrics.no_leak(a, b)
    metrics.no_leak(a, b.where("source = 'C'"))


def test_samples_and_splits(rows, got):
    events = rows("g string, k long, size long, extra string", [(g, k, 3, "") for g in "ab" for k in range(200)])
    picked = ratio_sample(events, "g", "size", 50, ["g", "k"])
    assert {r["g"]: r["count"] for r in picked.groupBy("g").count().collect()} == {"a": 17, "b": 17}
    assert got(ratio_sample(events.repartition(3), "g", "size", 50, ["g", "k"])) == got(picked)
    tracks = rows("source string, ID long, n long", [("A", i, i * i) for i in range(103)])
    for options in ({}, {"seed": None, "size": "n"}):
        sizes = [r["count"] for r in folds(tracks, 5, **options).groupBy("fold").count().collect()]
        assert sorted(sizes) == [20, 20, 21, 21, 21]
    matrix = rows("source string, ID long, tag string, n long", [("A", i, t, 1 + i % 3) for i in range(40) for t in ("x", "y")])
    locked = rows("source string, ID long, split string", [("A", 0, "test"), ("A", 1, "train"), ("A", 2, None)])
    split = {r["ID"]: r["split"] for r in search_split(matrix, locked, draws=100).collect()}
    assert split[0] == "test" and split[1] == "train" and 20 <= sum(v == "train" for v in split.values()) <= 35
    assert sampling.unknown_tracks(tracks, locked).count() == 100


def test_wilcoxon():
    assert wilcoxon([1, 2, 3, 4, 5], [0, 0, 0, 0, 0]) == pytest.approx(0.0625)
    assert wilcoxon([1, 1], [1, 1]) == 1.0
