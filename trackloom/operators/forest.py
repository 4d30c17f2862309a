"""Random forests of two classes in NumPy: every tree is grown by one task, trees in parallel.

Rows are binned once to a byte per feature, and rows with the same label and bins become one with its count. A task has the
binned rows of the fit, all of them (55 to 75 MB at 5 million rows of six features that all differ), and grows its
trees level by level from counts per node, bin and class, so a fit reads the table twice, whatever the trees' number
and depth. Below a level, nodes are taken on in blocks whose rows stay in the processor's cache. As in Spark's forests, rows
are drawn by Poisson counts (a row that stands for many by the sum of theirs), each node looks at its own draw of features,
and a side of a split has ``leaf`` drawn rows at least. Leaves keep their shares; none are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINS = 32
#: points of the sketch from which cuts are taken
POINTS = 1000
#: rows of nodes that are grown together
BLOCK = 32_768
#: bits of a mask of variants; the lowest is the row as it is
VARIANTS = 63


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


@dataclass(frozen=True)
class Binning:
    """Cuts of each feature and the value that stands for a missing one."""

    features: tuple[str, ...]
    medians: tuple[float, ...]
    cuts: tuple[np.ndarray, ...]

    def codes(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """A byte per row and feature: how many cuts lie below the value."""
        out = np.empty((len(columns[0]), len(columns)), np.uint8)
        for i, (x, median, cuts) in enumerate(zip(columns, self.medians, self.cuts, strict=True)):
            out[:, i] = np.searchsorted(cuts, np.where(np.isnan(x), median, x))
        return out


def cut_points(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Up to ``bins - 1`` cuts between distinct ones of sorted values: all of them, or those nearest to equal shares."""
    distinct, counts = np.unique(values, return_counts=True)
    with np.errstate(invalid="ignore", over="ignore"):
        middle = distinct[:-1] / 2 + distinct[1:] / 2
    middle = np.where((middle > distinct[:-1]) & (middle < distinct[1:]), middle, distinct[:-1])
    if len(middle) < bins:
        return middle
    stride, upto, chosen = len(values) / bins, np.cumsum(counts), []
    for i in range(len(middle)):
        target = stride * (len(chosen) + 1)
        if len(chosen) < bins - 1 and abs(upto[i] - target) < abs(upto[i + 1] - target):
            chosen.append(i)
    return middle[chosen]


def binning(df: DataFrame, features: Sequence[str]) -> Binning:
    """Cuts and medians from a sketch of all rows."""
    grid = df.approxQuantile(list(features), [0.5, *(np.arange(POINTS + 1) / POINTS).tolist()], 0.5 / POINTS)
    held = [np.asarray(v[1:], float) for v in grid]
    return Binning(tuple(features), tuple(v[0] if v else 0.0 for v in grid), tuple(cut_points(v) for v in held))


def counted(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of bytes in order, with the sum of their ``times``."""
    order = np.lexsort(rows.T)
    rows = rows[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    starts = np.flatnonzero(first)
    return rows[starts], np.add.reduceat(times[order], starts) if len(starts) else times


def packed(df: DataFrame, label: str, bins: Binning) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels and codes of all distinct rows and how often each is there, in an order that doesn't depend on the partitions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            truth = numbers(batch.column(0))
            if not np.isin(truth, (0, 1)).all():
                raise ValueError("labels must be 0 or 1")
            block = np.column_stack([truth.astype(np.uint8), bins.codes([numbers(c) for c in batch.columns[1:]])])
            block, times = counted(block, np.ones(len(block), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (block, times.astype(np.uint32))], names=["rows", "times"])

    width = 1 + len(bins.features)
    blocks = df.select(F.col(label).cast("double"), *bins.features).mapInArrow(run, "rows binary, times binary").collect()
    rows = np.frombuffer(b"".join(r[0] for r in blocks), np.uint8).reshape(-1, width)
    times = np.frombuffer(b"".join(r[1] for r in blocks), np.uint32).astype(np.int64)
    rows, times = counted(rows, times)
    return np.ascontiguousarray(rows[:, 0]), np.ascontiguousarray(rows[:, 1:]), times


def drawn_features(subset: str, n: int) -> int:
    """Features that a node looks at, named as for Spark's forests."""
    named = {"all": n, "auto": math.ceil(math.sqrt(n)), "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n))), "onethird": math.ceil(n / 3)}
    if subset in named:
        return named[subset]
    return min(n, int(subset)) if subset.isdigit() else max(1, min(n, math.ceil(float(subset) * n)))


@dataclass(frozen=True)
class Tree:
    """``nodes`` holds ``left child << 24 | bin << 16 | feature``; rows above the bin go to the child after the left one, a leaf is its own child."""

    nodes: np.ndarray
    prob: np.ndarray
    depth: int
    gains: np.ndarray

    def leaves(self, flat: np.ndarray, base: np.ndarray) -> np.ndarray:
        at = np.zeros(len(base), np.int64)
        for _ in range(self.depth):
            r = self.nodes.take(at)
            at = (r >> 24) + (flat.take(base + (r & 0xFFFF)) > ((r >> 16) & 255))
        return at


def _impurity(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Gini impurity times the weight."""
    held = counts * weights
    whole = held.sum(-1)
    return 2 * held[..., 0] * held[..., 1] / np.maximum(whole, 1e-300)


def grow(label: np.ndarray, codes: np.ndarray, weights: np.ndarray, seed: Sequence[int], depth: int, leaf: float, subset: str, counts: np.ndarray | None = None) -> Tree:
    """One tree from a draw of the rows; ``weights`` by class, ``leaf`` below 1 is a share of the weight, ``counts`` says how many rows each stands for."""
    random = np.random.default_rng(list(seed))
    n = codes.shape[1]
    look = drawn_features(subset, n)
    hits = [random.poisson(1.0 if counts is None else counts[a:b], b - a).astype(np.uint32) for a, b in _slices(len(label))]
    kept = np.concatenate([a + np.flatnonzero(t) for (a, _), t in zip(_slices(len(label)), hits, strict=True)])
    held, y, w = codes[kept], label[kept], np.concatenate([t[t > 0] for t in hits])
    del hits, kept
    at = np.zeros(len(y), np.int32)
    totals = sum(np.bincount(y[a:b], w[a:b], 2) for a, b in _slices(len(y)))[None, :]
    least_rows, least_weight = (1.0, leaf * float((totals * weights).sum())) if leaf < 1 else (float(int(leaf)), 0.0)
    ids, size, deep = np.zeros(1, np.int64), 1, 0
    nodes, share, gains = [np.array([255 << 16])], [_share(totals, weights)], np.zeros(n)
    where = [ids]
    # blocks of nodes that are still to be split: their level, numbers and totals, and the codes, node, label and weight of each row
    waiting = [(0, ids, totals, held, at, y, w)] if (totals > 0).all() and totals.sum() >= 2 * least_rows else []
    while waiting:
        level, ids, totals, held, at, y, w = waiting.pop()
        if level >= depth:
            continue
        m, parts = len(ids), list(_slices(len(at)))
        base = np.arange(min(len(at), BLOCK)) * n
        best = np.zeros(m)
        feature, cut, left = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros((m, 2))
        drawn = np.argpartition(random.random((m, n)), look - 1, axis=1)[:, :look] if look < n else np.tile(np.arange(n), (m, 1))
        parent = _impurity(totals, weights)
        for slot in range(look):
            f = np.ascontiguousarray(drawn[:, slot])
            cells = np.zeros(m * BINS * 2)
            for a, b in parts:
                spot = f.take(at[a:b])
                spot += base[: b - a]
                cell = held[a:b].ravel().take(spot).astype(np.int64)
                cell += at[a:b].astype(np.int64) * BINS
                cell <<= 1
                cell += y[a:b]
                cells += np.bincount(cell, w[a:b], len(cells))
            low = cells.reshape(m, BINS, 2).cumsum(axis=1)[:, :-1]
            high = totals[:, None] - low
            gain = parent[:, None] - _impurity(low, weights) - _impurity(high, weights)
            fits = (low.sum(-1) >= least_rows) & (high.sum(-1) >= least_rows)
            if least_weight:
                fits &= ((low * weights).sum(-1) >= least_weight) & ((high * weights).sum(-1) >= least_weight)
            gain = np.where(fits, gain, 0.0)
            t = gain.argmax(axis=1)
            found = gain[np.arange(m), t]
            better = found > best
            best, feature, cut = np.where(better, found, best), np.where(better, f, feature), np.where(better, t, cut)
            left = np.where(better[:, None], low[np.arange(m), t], left)
        split = best > 1e-9 * np.maximum((totals * weights).sum(axis=1), 1e-300)
        if not split.any():
            continue
        deep = max(deep, level + 1)
        gains += np.bincount(feature[split], best[split], n)
        pairs = np.cumsum(split) - 1
        first = size + 2 * pairs[split]
        where.append(ids[split])
        nodes.append(first << 24 | cut[split] << 16 | feature[split])
        # children, left and right by turns
        children = np.stack([left[split], totals[split] - left[split]], axis=1).reshape(-1, 2)
        fresh = size + np.arange(len(children))
        where.append(fresh)
        nodes.append(fresh << 24 | 255 << 16)
        share.append(_share(children, weights))
        size += len(children)
        goes_on = (children > 0).all(axis=1) & (children.sum(axis=1) >= 2 * least_rows)
        if level + 1 >= depth or not goes_on.any():
            continue
        # by node and side: the child's place among those that go on
        number = np.full((m, 2), -1, np.int32)
        number[split] = np.where(goes_on, np.cumsum(goes_on) - 1, -1).reshape(-1, 2)
        for a, b in parts:
            here = at[a:b].astype(np.int64)
            spot = feature.take(here)
            spot += base[: b - a]
            at[a:b] = number.ravel().take(2 * here + (held[a:b].ravel().take(spot) > cut.take(here)))
        stays = np.flatnonzero(at >= 0)
        at, ids, totals = at.take(stays), fresh[goes_on], children[goes_on]
        for rows, a, b in _blocks(at, len(ids)):
            chosen = stays if rows is None else stays.take(rows)
            waiting.append((level + 1, ids[a:b], totals[a:b], held.take(chosen, axis=0), at if rows is None else at.take(rows) - a, y.take(chosen), w.take(chosen)))
    table = np.empty(size, np.int64)
    for i, values in zip(where, nodes, strict=True):
        table[i] = values
    return Tree(table, np.concatenate(share), deep, gains)


def _slices(rows: int) -> Iterator[tuple[int, int]]:
    """Rows by ``BLOCK``, so that what is worked out for each is held for a few only."""
    return ((a, min(a + BLOCK, rows)) for a in range(0, max(rows, 1), BLOCK))


def _blocks(at: np.ndarray, nodes: int) -> Iterator[tuple[np.ndarray | None, int, int]]:
    """Nodes in blocks of about ``BLOCK`` rows: the block's rows, None for all, its first node and the one after its last."""
    if len(at) <= BLOCK or nodes == 1:
        yield None, 0, nodes
        return
    ends = np.bincount(at, minlength=nodes).cumsum()
    block = np.unique((ends - 1) // BLOCK, return_inverse=True)[1]
    order = block.astype(np.uint16).take(at).argsort(kind="stable")
    begins = np.flatnonzero(np.diff(block, prepend=-1))
    for a, b in zip(begins, [*begins[1:], nodes], strict=True):
        yield order[ends[a - 1] if a else 0 : ends[b - 1]], int(a), int(b)


def _share(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    held = counts * weights
    return (held[:, 1] / np.maximum(held.sum(axis=1), 1e-300)).astype(np.float32)


@dataclass
class Forest:
    """A fitted forest; ``shared`` sends it to the executors once."""

    bins: Binning
    trees: list[Tree]
    _sent: object = field(default=None, repr=False)

    def shared(self, spark: SparkSession):  # noqa: ANN201 - a broadcast variable
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast((self.bins, self.trees))
        return self._sent

    def release(self) -> None:
        """Take the forest back from the executors; what it was to score must have been read."""
        if self._sent is not None:
            self._sent.destroy()
            self._sent = None

    def importances(self) -> np.ndarray:
        """Shares of the impurity decrease: of each tree, then their mean."""
        each = [t.gains / t.gains.sum() for t in self.trees if t.gains.sum() > 0]
        total = np.sum(each, axis=0) if each else np.zeros(len(self.bins.features))
        return total / total.sum() if total.sum() > 0 else total

    def save(self, spark: SparkSession, path: str) -> None:
        columns = [(i, f, m, c.tolist()) for i, (f, m, c) in enumerate(zip(self.bins.features, self.bins.medians, self.bins.cuts, strict=True))]
        spark.createDataFrame(columns, "place int, feature string, median double, cuts array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
        trees = [(i, bytearray(t.nodes.tobytes()), bytearray(t.prob.tobytes()), t.depth, t.gains.tolist()) for i, t in enumerate(self.trees)]
        spark.createDataFrame(trees, "tree int, nodes binary, prob binary, depth int, gains array<double>").write.mode("overwrite").parquet(f"{path}/trees")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        columns = spark.read.parquet(f"{path}/columns").orderBy("place").collect()
        trees = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()
        return cls(Binning(tuple(c.feature for c in columns), tuple(c.median for c in columns), tuple(np.array(c.cuts, float) for c in columns)), [_tree(t) for t in trees])


def _tree(r) -> Tree:  # noqa: ANN001 - a row
    return Tree(np.frombuffer(r.nodes, np.int64), np.frombuffer(r.prob, np.float32), r.depth, np.array(r.gains, float))


def fit(df: DataFrame, features: Sequence[str], label: str, settings: Sequence[dict]) -> list[Forest]:
    """A balanced forest for each of the settings (``trees, depth, leaf, subset, seed``), all grown in one job."""
    spark = df.sparkSession
    bins = binning(df, features)
    truth, codes, times = packed(df, label, bins)
    if not len(truth):
        raise ValueError("no labelled rows to fit on")
    counts = np.bincount(truth, times, 2)
    weights = np.where(counts > 0, counts.sum() / (np.count_nonzero(counts) * np.maximum(counts, 1)), 0.0)
    jobs = [(k, i) for k, s in enumerate(settings) for i in range(s["trees"])]
    held = spark.sparkContext.broadcast((truth, codes, weights, times))
    options = [dict(s) for s in settings]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                k, i = jobs[at]
                s = options[k]
                label, codes, weights, times = held.value
                t = grow(label, codes, weights, counts=times, seed=(s["seed"], i), depth=s["depth"], leaf=s["leaf"], subset=s["subset"])
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in ((at, pa.int64()), (t.nodes.tobytes(), pa.binary()), (t.prob.tobytes(), pa.binary()), (t.depth, pa.int32()), (t.gains.tolist(), pa.list_(pa.float64())))], names=["at", "nodes", "prob", "depth", "gains"])

    parts = min(len(jobs), 4 * spark.sparkContext.defaultParallelism)
    # numbers are dealt out, so that costly settings don't meet in one task
    dealt = spark.range(parts, numPartitions=parts).select(F.explode(F.sequence(F.col("id"), F.lit(len(jobs) - 1), F.lit(parts))).alias("at"))
    grown = {r.at: _tree(r) for r in dealt.mapInArrow(run, "at long, nodes binary, prob binary, depth int, gains array<double>").collect()}
    held.destroy()
    out: list[Forest] = [Forest(bins, []) for _ in settings]
    for at, (k, _) in enumerate(jobs):
        out[k].trees.append(grown[at])
    return out


def scores(trees: Sequence[Tree], codes: np.ndarray) -> np.ndarray:
    """Mean of the trees' probabilities of class 1."""
    flat, base, total = codes.ravel(), np.arange(len(codes)) * codes.shape[1], np.zeros(len(codes))
    for t in trees:
        total += t.prob.take(t.leaves(flat, base))
    return total / max(len(trees), 1)


def permuted_scores(trees: Sequence[Tree], own: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Probabilities of rows by variant: 0 is the row as it is, ``1 + k * features + f`` has feature ``f`` of ``given[:, k]``.

    Variants go down a tree together, as bits of a mask, until a split on their own feature parts them.
    """
    rows, repeats, n = given.shape
    out = np.empty((rows, 1 + repeats * n))
    variants = [(f, k) for f in range(n) for k in range(repeats)]
    for start in range(0, len(variants), VARIANTS):
        part = variants[start : start + VARIANTS]
        full = np.uint64((1 << (len(part) + 1)) - 1)
        bits: dict[int, list[tuple[int, int]]] = {}
        for b, (f, k) in enumerate(part):
            bits.setdefault(f, []).append((b + 1, k))
        right: dict[tuple[int, int], np.ndarray] = {}

        def goes(f: int, t: int) -> np.ndarray:
            """Bits of each row's variants above bin ``t`` of feature ``f``."""
            if (f, t) not in right:
                mine = np.uint64(sum(1 << b for b, _ in bits.get(f, ())))
                found = np.where(own[:, f] > t, full & ~mine, np.uint64(0))
                for b, k in bits.get(f, ()):
                    found |= (given[:, k, f] > t).astype(np.uint64) << np.uint64(b)
                right[f, t] = found
            return right[f, t]

        total, first = np.zeros(rows * 64), np.repeat(np.arange(rows) << 6, len(part) + 1)
        for tree in trees:
            left = (tree.nodes >> 24).tolist()
            cut, feature = ((tree.nodes >> 16) & 255).tolist(), (tree.nodes & 0xFFFF).tolist()
            held: dict[int, tuple[np.ndarray, np.ndarray]] = {0: (np.arange(rows), np.full(rows, full))}
            ended = []
            for node in range(len(left)):  # children come after their parents
                if node not in held:
                    continue
                r, mask = held.pop(node)
                if left[node] == node:
                    ended.append((r, mask, tree.prob[node]))
                    continue
                up = goes(feature[node], cut[node]).take(r)
                up &= mask
                mask = mask ^ up
                for child, m in ((left[node], mask), (left[node] + 1, up)):
                    some = m.astype(bool).nonzero()[0]
                    if len(some):
                        held[child] = (r, m) if len(some) == len(r) else (r.take(some), m.take(some))
            # by row: every variant of a row is in one leaf, so a row has as many set bits as there are variants
            r = np.concatenate([e[0] for e in ended])
            order = (r.astype(np.uint16) if rows <= 1 << 16 else r).argsort(kind="stable")
            mask = np.concatenate([e[1] for e in ended]).take(order)
            p = np.repeat(np.array([e[2] for e in ended], float), [len(e[0]) for e in ended]).take(order)
            spot = np.unpackbits(mask.astype("<u8", copy=False).view(np.uint8), bitorder="little").view(bool).nonzero()[0]
            spot &= 63
            spot += first
            total[spot] += np.repeat(p, np.bitwise_count(mask))
        mean = total.reshape(rows, 64) / max(len(trees), 1)
        out[:, 0] = mean[:, 0]
        for b, (f, k) in enumerate(part):
            out[:, 1 + k * n + f] = mean[:, b + 1]
    return out
