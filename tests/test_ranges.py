import random

from pyspark.sql import functions as F

from trackloom.operators import ranges

FRAMES = "source string, ID long, frame long, et double, junk string"
SPANS = "source string, ID long, t0 double, t1 double, name string, junk string"


def test_half_open_and_last_wins(rows, got):
    frames = rows(FRAMES, [("A", 1, f, float(f), "") for f in range(0, 130, 10)])
    spans = rows(SPANS, [("A", 1, 10.0, 120.0, "long", ""), ("A", 1, 20.0, 30.0, "short", ""), ("A", 1, 20.0, 30.0, "short", ""), ("A", 2, 0.0, 500.0, "other", ""), (None, 1, 0.0, 500.0, "null", "")])
    found = got(ranges.label_frames(frames, spans, [F.col("t0"), F.col("name")], ["name"]), "frame", "name")
    assert found == [(f, "short" if f == 20 else "long") for f in range(10, 120, 10)]
    assert ranges.label_frames(frames, spans, [F.col("t0")], ["name"], how="all").count() == 13
    assert ranges.label_frames(frames, spans.limit(0), [F.col("t0")], ["name"]).count() == 0


def test_asof_tolerance_ties_and_repeated_rows(rows, got):
    left = rows(FRAMES, [("A", 1, 1, 10.0, ""), ("A", 1, 2, 20.0, ""), ("A", 1, 3, 30.0, ""), (None, None, 4, 10.0, "")])
    right = rows("source string, ID long, et double, v int", [("A", 1, 9.75, 1), ("A", 1, 10.25, 2), ("A", 1, 20.5, 3), ("A", 1, 20.5, 4), ("A", 1, 30.625, 5), (None, None, 10.5, 6)])
    found = ranges.asof_nearest(left, right, 0.5, ["source", "ID", "frame"], ["v"])
    assert {r["frame"]: (r["matched_at"], r["v"]) for r in found.collect()} == {1: (9.75, 1), 2: (20.5, 4), 3: (None, None), 4: (10.5, 6)}


def test_padding_prefers_targets(rows, got):
    frames = rows(FRAMES, [("A", 1, f, float(f), "") for f in range(20)])
    spans = rows(SPANS, [("A", 1, 5.0, 7.0, "b", ""), ("A", 1, 9.0, 10.0, "a", "")])
    found = got(ranges.padded_frames(frames, spans, 2.0, "name", ["source", "ID", "frame"]), "frame", "name", "is_target")
    assert found == [(3, "b", False), (4, "b", False), (5, "b", True), (6, "b", True), (7, "b", True), (8, "a", False), (9, "a", True), (10, "a", True), (11, "a", False), (12, "a", False)]


def test_label_frames_matches_brute_force(rows):
    r = random.Random(2)
    frames = [("A", r.randrange(3), f, round(r.uniform(0, 300), 2), "") for f in range(200)]
    spans = [("A", r.randrange(3), a, a + round(r.expovariate(0.02), 2) + 0.01, str(k), "") for k in range(40) for a in [round(r.uniform(0, 300), 2)]]
    expected = set()
    for s, i, f, t, _ in frames:
        hits = [(a, n) for q, j, a, b, n, _ in spans if (q, j) == (s, i) and a <= t < b]
        if hits:
            expected.add((f, max(hits)[1]))
    found = ranges.label_frames(rows(FRAMES, frames), rows(SPANS, spans), [F.col("t0"), F.col("name")], ["name"], bucket_s=17.0)
    assert {(x["frame"], x["name"]) for x in found.collect()} == expected


def test_nearest_has_no_limit_and_matches_brute_force(rows):
    r = random.Random(4)
    points = [("A", k, t, v) for k in range(2) for t in [round(r.choice([r.uniform(0, 50), r.uniform(4000, 4050)]), 1) for _ in range(60)] for v in (1, 2)] + [(None, 5, 7.0, 1), ("A", 3, None, 1), ("A", 3, float("nan"), 1)]
    left = [("A", k, f, round(r.uniform(-900, 5000), 1), "") for k in range(4) for f in range(60)] + [(None, 5, 60, 1e6, ""), ("A", 0, 61, None, ""), ("A", 0, 62, float("nan"), "")]
    expected = {}
    for s, k, f, t, _ in left:
        near = [(abs(p - t), p) for q, j, p, _ in points if (q, j) == (s, k) and p is not None and p == p] if t is not None and t == t else []
        expected[(k, f)] = (min(near)[1], 1 if s is None else 2) if near else (None, None)
    found = ranges.nearest(rows(FRAMES, left), rows("source string, ID int, et double, v int", points), ["v"], block_s=20.0).collect()
    assert len(found) == len(left) and {(x["ID"], x["frame"]): (x["matched_at"], x["v"]) for x in found} == expected
    tie = ranges.nearest(rows(FRAMES, [("A", 1, 1, 100.0, "")]), rows("source string, ID long, et double, v int", [("A", 1, 0.0, 1), ("A", 1, 200.0, 2)]), ["v"]).first()
    assert (tie["matched_at"], tie["v"]) == (0.0, 1)
