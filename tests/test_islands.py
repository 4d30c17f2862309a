import random

from trackloom.operators import islands

SCHEMA = "source string, ID long, frame long, et double, v int, prob double"


def test_event_ids_across_blocks(rows):
    r = random.Random(5)
    frames = sorted(r.sample(range(400), 250))
    data = [("A", 1, f, f / 6, r.choice([0, 1, None]), 0.0) for f in frames]
    expected, event, before = {}, 0, None
    for _, _, f, t, v, _ in data:
        if before is None or before[1] != v or t - before[0] > 0.5:
            event += 1
        expected[f], before = event, (t, v)
    data += [(None, None, *row[2:]) for row in data]  # null keys are a track too
    for block in (7, 8192):
        found = islands.event_ids(rows(SCHEMA, data), ["v"], block=block).collect()
        assert len(found) == len(data) and all(expected[x["frame"]] == x["event_id"] for x in found)
    before = {b: a for a, b in zip(frames, frames[1:])}
    for x in islands.with_previous(rows(SCHEMA, data), ["frame"], block=7).collect():
        assert (x["prev"]["frame"] if x["prev"] else None) == before.get(x["frame"])
    data = data[: len(frames)]
    assert {x["frame"]: x["event_id"] for x in islands.event_ids(rows(SCHEMA, data), ["v"]).collect()} == expected


def runs_of(values):
    out = []
    for i, v in enumerate(values):
        if out and out[-1][0] == v:
            out[-1][2] = i
        else:
            out.append([v, i, i])
    return out


def closed_and_opened(values, close, open_):
    values = list(values)
    spans = runs_of(values)
    for k, (v, a, b) in enumerate(spans):
        if v == 0 and 0 < k < len(spans) - 1 and b - a + 1 < close:
            values[a : b + 1] = [1] * (b - a + 1)
    for v, a, b in runs_of(values):
        if v == 1 and b - a + 1 < open_:
            values[a : b + 1] = [0] * (b - a + 1)
    return values


def test_close_and_open_matches_brute_force(rows):
    r = random.Random(6)
    data, expected = [], {}
    for track in range(12):
        values = [int(r.random() < 0.5) for _ in range(80)]
        data += [("A", track, i, i / 6, v, 0.0) for i, v in enumerate(values)]
        expected[track] = closed_and_opened(values, 4, 5)
    found = {t: [None] * 80 for t in range(12)}
    for x in islands.close_and_open(rows(SCHEMA, data), "v", 4, 5).collect():
        for i in range(x["first"], x["last"] + 1):
            found[x["ID"]][i] = x["v"]
    assert found == expected


def test_hysteresis_matches_a_loop(rows):
    r = random.Random(7)
    for on, off in ((0.6, 0.4), (0.4, 0.6), (0.5, 0.5)):
        data, expected = [], {}
        for track in range(6):
            state = 0
            for f in range(60):
                p = r.choice([None, round(r.random(), 2)])
                if p is not None:
                    state = (1 if p >= on else 0) if not state else (0 if p <= off else 1)
                data.append(("A", track, f, f / 6, 0, p))
                expected[(track, f)] = state
        for block in (7, 8192):
            found = {(x["ID"], x["frame"]): x["state"] for x in islands.hysteresis(rows(SCHEMA, data), "prob", on, off, block=block).collect()}
            assert found == expected


def test_fill_and_initiations(rows, got):
    data = [("A", 1, f, 0.0, v, p) for f, v, p in [(0, 1, None), (1, 0, 2.0), (20, 1, None), (40, 1, 3.0), (41, 0, None)]] + [("B", 1, 0, 0.0, 1, None)]
    assert got(islands.filled(rows(SCHEMA, data), ["prob"], block=8), "source", "frame", "prob") == [("A", 0, 2.0), ("A", 1, 2.0), ("A", 20, 2.0), ("A", 40, 3.0), ("A", 41, 3.0), ("B", 0, 0.0)]
    assert got(islands.initiations(rows(SCHEMA, data), "v"), "source", "frame") == [("A", 20)]


def test_empty(rows):
    empty = rows(SCHEMA, [])
    assert islands.event_ids(empty, ["v"]).count() == 0 and islands.close_and_open(empty, "v", 3, 3).count() == 0 and islands.filled(empty, ["prob"]).count() == 0
