import random

from trackloom.llm.runs import collapse_runs, resolve

SCHEMA = "source string, ID long, et double, prediction int, value string, n long"


def brute(data):
    frames = {}
    for s, i, t, p, *_ in data:
        if t is not None and p is not None:
            k = (s, i, round(t * 6))
            frames[k] = max(frames.get(k, p), p)
    out, current = [], None
    for (s, i, f), p in sorted(frames.items(), key=lambda x: (str(x[0][0]), str(x[0][1]), x[0][2])):
        if current and current[:2] == [s, i] and current[2] == p and f - current[4] <= 3:
            current[4], current[5] = f, current[5] + 1
        else:
            current = [s, i, p, f, f, 1]
            out.append(current)
    return [(s, i, float(p), a, b, n) for s, i, p, a, b, n in out if n >= 2]


def found(df, **options):
    return [(r["source"], r["ID"], r["value"], r["first_frame"], r["last_frame"], r["n_frames"]) for r in collapse_runs(df, **options).collect()]


def test_matches_brute_force_whatever_the_shards(rows):
    r = random.Random(1)
    data = [(r.choice(["A", None]), r.choice([1, None]), r.randrange(300) / 6 + r.uniform(-0.05, 0.05), r.choice([0, 0, 0, 0, 0, 1, None]), "v", 1) for _ in range(500)]
    data += [("B", 1, f / 6, 1, "v", 1) for f in range(400)] + data[:40] + [("B", 1, None, 1, "v", 1)]
    r.shuffle(data)
    for shard in (4, 16, 64):
        assert sorted(map(str, found(rows(SCHEMA, data), shard_frames=shard))) == sorted(map(str, brute(data)))


def test_pointers_double(rows):
    """A chain of n links takes about log2(n) rounds; branches and other keys don't disturb it."""
    for n, least, most in ((1, 1, 1), (5, 3, 4), (100, 7, 8)):
        chain = [("A", 1, k, k - 1, "x") for k in range(1, n + 1)] + [(None, 1, k, k - 1, "y") for k in range(1, 4)]
        done, rounds = resolve(rows("source string, ID long, node long, ptr long, extra string", chain), ["source", "ID"])
        assert least <= rounds <= max(most, 3) and {(r["source"], r["node"], r["ptr"]) for r in done.collect()} == {(s, k, 0) for s, _, k, *_ in chain}
    none, rounds = resolve(rows("source string, node long, ptr long", []), ["source"])
    assert rounds == 0 and none.columns == ["source", "node", "ptr"] and none.count() == 0


def test_a_long_run_over_many_shards(rows):
    data = [("A", 1, f / 6, 1, "", 1) for f in range(5000)] + [("A", 1, f / 6, 0, "", 1) for f in range(5000, 5100)]
    assert sorted(x[3:] for x in found(rows(SCHEMA, data), shard_frames=16)) == [(0, 4999, 5000), (5000, 5099, 100)]


def test_steps_and_durations(rows):
    data = [("A", 1, f / 6, 1, "", 1) for f in (0, 3, 6, 10, 11)]
    assert sorted((r["first_frame"], r["last_frame"], r["n_frames"], r["duration_s"]) for r in collapse_runs(rows(SCHEMA, data)).collect()) == [(0, 6, 3, 1.0), (10, 11, 2, 1 / 6)]


def test_near_identical_events_and_empty(rows):
    data = [("A", 1, f / 6, v, "", 1) for f, v in enumerate([1, 2, 3, 9, 9])]
    assert sorted(x[3:] for x in found(rows(SCHEMA, data), tolerance=1.0)) == [(0, 2, 3), (3, 4, 2)]
    assert found(rows(SCHEMA, [])) == []
