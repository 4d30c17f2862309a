import math
import random

from trackloom.operators.spikes import implausible_frames

SCHEMA = "source string, ID long, et double, x double, y double, xspine_0 double, yspine_0 double, reasons string"


def walk(seed, n=900):
    r = random.Random(seed)
    out = []
    for f in range(n):
        a = f / 150
        x, y = 40 + 20 * math.cos(a) + r.gauss(0, 0.01), 40 + 20 * math.sin(a) + r.gauss(0, 0.01)
        out.append([f, x, y, x + 1.5 + r.gauss(0, 0.02), y + r.gauss(0, 0.02)])
    return out


def run(rows, tracks, **options):
    data = [(s, i, f / 6, *v, "e") for (s, i), t in tracks.items() for f, *v in t]
    return {(r["source"], r["id"], r["frame"]): set(r["reasons"]) for r in implausible_frames(rows(SCHEMA, data + data[:50]), **options).collect()}


def test_planted_cases_are_found_and_nothing_else(rows):
    tracks = {("A", i): walk(i) for i in range(4)}
    t, expected = tracks[("A", 1)], {}
    for f in (100, 101, 102):
        t[f][1:] = [v + 12 for v in t[f][1:]]
        expected[("A", 1, f)] = {"excursion"}
    t[200][1] = -9999.0
    t[300][3:] = [5.0, 5.0]
    expected |= {("A", 1, 200): {"impossible", "excursion"}, ("A", 1, 300): {"excursion"}}
    for f in range(400, 412):
        t[f][1:] = t[400][1:]
        if f > 400:
            expected[("A", 1, f)] = {"stuck"}
    for f in range(500, 503):
        t[f][1:] = t[500][1:]
    t[600][1] = float("nan")
    for options in ({}, {"shard_frames": 256, "margin": 64}):
        assert run(rows, tracks, **options) == expected


def test_recordings_stopped_and_resumed_are_no_spikes(rows):
    a = walk(1, 300)
    b = [[f + 5000, *[v + 15 for v in p]] for f, *p in walk(2, 300)]
    assert run(rows, {("A", 1): a + b, ("A", 2): walk(3)}) == {}


def test_missing_values_and_empty(rows):
    assert run(rows, {("A", 1): [[f, None, None, None, None] for f in range(30)], (None, None): [[1, 1.0, 1.0, 1.0, 1.0]]}) == {}
    assert implausible_frames(rows(SCHEMA, [])).count() == 0


def test_a_narrow_source_is_held_to_its_own_places(rows):
    """A wide source beside it changes nothing, and a narrow hour of a wide source doesn't narrow it much."""
    scaled = lambda t, k: [[f, *[40 + (v - 40) * k for v in p]] for f, *p in t]
    narrow = {("N", i): scaled(walk(i), 0.1) for i in range(4)}
    for f in range(300, 330):
        narrow[("N", 2)][f][1:] = [v + 30 for v in narrow[("N", 2)][f][1:]]
    expected = {("N", 2, f): {"impossible"} for f in range(300, 330)}
    wide = {("W", i): scaled(walk(i), 3) for i in range(4)}
    assert run(rows, narrow) == run(rows, narrow | wide) == expected
    late = {("W", 9): [[f + 30_000, *p] for f, *p in scaled(walk(5), 0.1)] + [[f + 33_000, *p] for f, *p in scaled(walk(6), 3)]}
    assert run(rows, wide | late) == {}
