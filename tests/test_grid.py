import math
import random

from trackloom.operators.grid import missing_runs, regular_grid

SCHEMA = "source string, ID long, et double, x double, y double, extra string, frame string"


def brute(data, silence=3600):
    out = []
    for key in {(s, i) for s, i, *_ in data}:
        frames = sorted({round(t * 6) for s, i, t, x, y, *_ in data if (s, i) == key and t is not None and x is not None and y is not None and not math.isnan(x) and not math.isnan(y)})
        out += [(*key, a + 1, b - 1) for a, b in zip(frames, frames[1:]) if 1 < b - a <= silence]
    return out


def table(random_, n=300):
    data = []
    for _ in range(n):
        f = random_.randrange(0, 5000) if random_.random() < 0.1 else random_.randrange(0, 200)
        x, y = random_.choice([1.0, 2.5, None, float("nan"), 1e6]), random_.choice([1.0, 3.0, None])
        data.append((random_.choice(["A", "B", None]), random_.choice([1, 2, None]), f / 6 + random_.uniform(-0.05, 0.05), x, y, "e", "f"))
    return data + data[:20] + [("A", 1, None, 1.0, 1.0, "e", "f")]


def test_missing_runs_match_brute_force_across_shards(rows, got):
    data = table(random.Random(1))
    for shard in (3, 64, 100_000):
        found = [tuple(r) for r in missing_runs(rows(SCHEMA, data), shard_frames=shard).collect()]
        assert sorted(map(str, found)) == sorted(map(str, brute(data)))


def test_silence_ends_a_recording(rows, got):
    data = [("A", 1, f / 6, 1.0, 1.0, "", "") for f in (0, 3600, 7201)]
    assert got(missing_runs(rows(SCHEMA, data))) == [("A", 1, 1, 3599)]


def test_grid_has_a_row_per_frame_and_fills_short_holes(rows, got):
    data = [("A", 1, f / 6, float(f), 0.0, "", "") for f in (10, 12, 30)] + [("A", 1, 10 / 6 + 0.04, 99.0, 0.0, "", "")]
    found = {r["frame"]: (r["x"], r["state"]) for r in regular_grid(rows(SCHEMA, data)).collect()}
    assert sorted(found) == list(range(10, 31))
    assert found[10] == (10.0, "read") and found[11] == (11.0, "filled") and found[20] == (None, "missing") and found[30] == (30.0, "read")


def test_empty(rows):
    empty = rows(SCHEMA, [])
    assert missing_runs(empty).count() == 0 and regular_grid(empty).count() == 0
