import numpy as np
import pytest

from trackloom.llm.mixing import mix, pivot, shares

SIZES = "doc_id long, source string, n_tokens long, copies string"
TARGETS = "source string, target_share double, max_repeats int, part string"


def test_pivot_keeps_the_size_and_the_expectation():
    r = np.random.default_rng(1)
    size = r.integers(1, 100, 40).astype(float)
    total, runs = np.zeros(40), 3000
    for _ in range(runs):
        out = pivot(np.full(40, 0.3), size, r.random(40))
        assert ((out == 0) | (out == 1)).sum() >= 39 and (out * size).sum() == pytest.approx(0.3 * size.sum())
        total += out
    assert np.abs(total / runs - 0.3).max() < 0.05


def test_shares_are_met_and_caps_kept(rows):
    r = np.random.default_rng(2)
    data = [(i, s, int(r.integers(1, 200)), "x") for i, s in enumerate(["a"] * 900 + ["b"] * 300 + ["c"] * 60 + ["z"] * 20)]
    data += [(5000, None, 10, "x"), (5001, "a", 0, "x")]
    sized = rows(SIZES, data)
    targets = rows(TARGETS, [("a", 0.5, 1, ""), ("b", 0.3, 2, ""), ("c", 0.2, 4, ""), (None, 0.0, 1, "")])
    for options in ({}, {"shard_rows": 20, "fan_in": 2}, {"size_tokens": 20_000}):
        made = mix(sized, targets, **options)
        used = {s["source"]: s for s in shares(sized, made, targets).collect()}
        tokens = sum(s["tokens_used"] for s in used.values())
        for s, share, cap in (("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)):
            assert abs(used[s]["tokens_used"] - share * tokens) <= 400 and used[s]["most_copies"] <= cap
        assert used["z"]["docs_used"] == used[None]["docs_used"] == 0 and used["z"]["target_share"] == 0.0
        assert made.where("copies < 1 OR n_tokens = 0").count() == 0
    assert sorted(map(tuple, mix(sized, targets).collect())) == sorted(map(tuple, mix(sized.repartition(5), targets).collect()))


def test_a_size_that_caps_cannot_carry(rows):
    """A larger size than all shares allow is an error, or is filled up by the sources that can."""
    sized = rows(SIZES, [(i, s, 10, "x") for i, s in enumerate(["a"] * 400 + ["b"] * 200 + ["c"] * 10)])
    targets = rows(TARGETS, [("a", 0.4, 1, ""), ("b", 0.4, 2, ""), ("c", 0.2, 3, "")])
    with pytest.raises(ValueError, match="1500 can"):
        mix(sized, targets, 5000)
    made = mix(sized, targets, 5000, short="fill")
    used = {r["source"]: r for r in shares(sized, made, targets, 5000).collect()}
    assert used["c"]["tokens_used"] == 300 and used["c"]["most_copies"] == 3
    assert abs(used["a"]["tokens_used"] - 2350) <= 10 and abs(used["b"]["tokens_used"] - 2350) <= 10
    assert used["a"]["size_asked"] == 5000 and abs(used["a"]["size_reached"] - 5000) <= 20
    every = mix(sized, targets, 10**9, short="fill")
    assert {r["source"]: (r["tokens_used"], r["most_copies"]) for r in shares(sized, every, targets).collect()} == {"a": (4000, 1), "b": (4000, 2), "c": (300, 3)}


def test_empty_source_and_tables(rows):
    sized = rows(SIZES, [(1, "a", 10, ""), (2, "a", 10, "")])
    targets = rows(TARGETS, [("a", 0.5, 2, ""), ("b", 0.5, 2, "")])
    made = mix(sized, targets)
    assert [(r["doc_id"], r["copies"]) for r in made.orderBy("doc_id").collect()] == [(1, 2), (2, 2)]
    assert {r["source"]: r["actual_share"] for r in shares(sized, made, targets).collect()} == {"a": 1.0, "b": 0.0}
    assert mix(sized.limit(0), targets).count() == 0 and mix(sized, targets.limit(0)).count() == 0
