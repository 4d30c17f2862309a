import random

from trackloom.operators.periods import periods_and_gaps

SCHEMA = "source string, ID long, t0 double, t1 double, kind string, block string"
SLACK = 1.1 / 6


def brute(data):
    tracks = {}
    for s, i, a, b, *_ in data:
        if i is not None and a is not None and b is not None and b > a:
            tracks.setdefault((None if s is None else s.strip().upper(), i), []).append((a, b))
    out = []
    for key, spans in tracks.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a - merged[-1][1] <= SLACK:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(*key, "period", round(a * 1000), round(b * 1000)) for a, b in merged]
        out += [(*key, "gap", round(p[1] * 1000), round(q[0] * 1000)) for p, q in zip(merged, merged[1:])]
    return out


def test_matches_brute_force_for_any_tree(rows):
    r = random.Random(3)
    data = []
    for _ in range(400):
        a = round(r.uniform(-50, 4000), 3)
        data.append((r.choice(["ga1", " GA1\t", "EA", None]), r.choice([1, 2, None]), r.choice([a, a, a, None]), r.choice([a + round(r.expovariate(0.2), 3), a + 1, a - 1, a, None]), "k", "b"))
    data += data[:30]
    for options in ({}, {"block_s": 7.0, "fan_in": 2, "salts": 3}, {"block_s": 1e6, "salts": 1}):
        found = [tuple(x) for x in periods_and_gaps(rows(SCHEMA, data), **options).collect()]
        assert sorted(map(str, found)) == sorted(map(str, brute(data)))


def test_nested_touching_and_slack(rows, got):
    data = [("A", 1, 0.0, 10.0, "", ""), ("A", 1, 2.0, 3.0, "", ""), ("A", 1, 10.0, 11.0, "", ""), ("A", 1, 11.183, 12.0, "", ""), ("A", 1, 12.184, 13.0, "", "")]
    assert got(periods_and_gaps(rows(SCHEMA, data))) == [("A", 1, "gap", 12000, 12184), ("A", 1, "period", 0, 12000), ("A", 1, "period", 12184, 13000)]


def test_empty(rows):
    assert periods_and_gaps(rows(SCHEMA, [])).count() == 0
