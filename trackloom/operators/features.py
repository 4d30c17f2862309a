"""Registry of windowed features, computed in one logical plan.

A feature is a builder of a Catalyst expression over base signals, or a column of a per-shard kernel where the rule is
sequential. Rolling sums and means come from running sums (each window is a difference of two of them), variances from
running sums inside chunks of the window's length, so their cost doesn't grow with the window. Columns are named ``w{seconds}_{feature}``, base features by their bare name.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators import kernels
from trackloom.operators.frames import FPS
from trackloom.operators.signals import base_signals, hypot
from trackloom.operators.tracks import TRACK, core, shard_window

GM = "group_medians"
PLACE = ["_k", "shard"]


class Rolling:
    """Centred windows over the rows of a track: ``n`` rows are the ``n // 2`` before a row up to ``(n - 1) // 2`` after it.

    Builders ask for sums, means and shifts and get columns back; what they asked for is collected, each once, and
    computed in stages: terms, running sums and totals, differences and shifts. Features are then plain projections.
    """

    def __init__(self, fps: float = FPS):
        self.fps, self.w = fps, shard_window()
        self.whole = self.w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        self.chunks: dict[int, dict[str, tuple]] = {}
        self.terms: dict[str, Column] = {}
        self.windows: dict[str, Column] = {}

    def _running(self, name: str, term: Column) -> str:
        self.terms.setdefault(name, term)
        return name

    def _window(self, name: str, value: Column) -> Column:
        self.windows.setdefault(name, value)
        return F.col(name)

    def _between(self, name: str, before: int, after: int) -> Column:
        upper = F.coalesce(F.lead(name, after).over(self.w), F.col(f"{name}_all")) if after else F.col(name)
        return self._window(f"{name}_{before}_{after}", upper - F.coalesce(F.lag(name, before + 1).over(self.w), F.lit(0)))

    def count(self, c: str, n: int) -> Column:
        return self._between(self._running(f"_n_{c}", F.col(c).isNotNull().cast("int")), n // 2, (n - 1) // 2)

    def sum(self, c: str, n: int) -> Column:
        total = self._between(self._running(f"_s_{c}", F.coalesce(F.col(c).cast("double"), F.lit(0.0))), n // 2, (n - 1) // 2)
        return F.when(self.count(c, n) > 0, total)

    def mean(self, c: str, n: int) -> Column:
        return F.try_divide(self.sum(c, n), self.count(c, n))

    def trailing_mean(self, c: str, n: int) -> Column:
        rows, total = self._running(f"_n_{c}", F.col(c).isNotNull().cast("int")), self._running(f"_s_{c}", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
        held = self._between(rows, n - 1, 0)
        return F.try_divide(self._between(total, n - 1, 0), held)

    def var(self, c: str, n: int) -> Column:
        """Sample variance; null for fewer than two values."""
        rows, squares = self._moments((c,), n // 2, (n - 1) // 2)
        # the condition is on the divisor: Spark shares what is always computed, but writes out the branches of a CASE,
        # and a method of more than 8000 bytes of code is never compiled
        return F.try_divide(squares[c + c], F.when(rows > 1, rows - 1))

    def _moments(self, cs: tuple[str, ...], before: int, after: int) -> tuple[Column, dict[str, Column]]:
        """Rows with all of ``cs`` in the window, and the sums of squares and products about their means there.

        Rows are cut into chunks as long as the window, which so lies in at most two. Inside a chunk sums run over
        differences from the chunk's first value, so no large squares cancel; what the window has of either chunk is
        turned into counts, means and squares, and the two are combined.
        """
        n = before + after + 1
        name, pairs = f"_z_{'_'.join(cs)}_{before}_{after}", [(a, b) for i, a in enumerate(cs) for b in cs[i:]]
        held = F.lit(True)
        for c in cs:
            held = held & F.col(c).isNotNull()
        self.chunks.setdefault(n, {})[name] = (cs, pairs, held)
        # the window's last row, or the track's, and the row before its first
        end = self._window(f"{name}_end", F.coalesce(F.lead(name, after).over(self.w), F.col(f"{name}_tail")) if after else F.col(name))
        out = self._window(f"{name}_out", F.lag(name, before + 1).over(self.w))
        alike = F.coalesce(end["chunk"] == out["chunk"], F.lit(False))
        beside = F.coalesce(end["chunk"] == out["chunk"] + 1, F.lit(False))
        zero = F.lit(0.0)
        part = lambda p, f, to, off: F.coalesce(to[f], zero) - F.when(p, F.coalesce(off[f], zero)).otherwise(0.0)
        right = {f: part(alike, f, end, out) for f in ["rows", *cs, *[a + b for a, b in pairs]]}
        left = {f: F.when(beside, F.coalesce(out[f"all_{f}"], zero) - F.coalesce(out[f], zero)).otherwise(0.0) for f in right}
        rows = right["rows"] + left["rows"]
        mean = lambda side, c: F.coalesce(F.try_divide(side[c], side["rows"]), zero)
        gap = {c: mean(right, c) + F.coalesce(end[f"first_{c}"], zero) - mean(left, c) - F.coalesce(out[f"first_{c}"], zero) for c in cs}
        weight = F.coalesce(F.try_divide(right["rows"] * left["rows"], rows), zero)
        about = lambda side, a, b: side[a + b] - side[a] * mean(side, b)
        squares = {a + b: about(right, a, b) + about(left, a, b) + weight * gap[a] * gap[b] for a, b in pairs}
        squares |= {a + b: F.greatest(v, zero) for (a, b), v in zip(pairs, squares.values(), strict=True) if a == b}
        return rows, squares

    def _with_chunks(self, df: DataFrame) -> DataFrame:
        """Per chunk length one struct for each set of columns, with the running sums of the chunk and its totals."""
        out = df
        for n, wanted in self.chunks.items():
            chunk = F.floor(F.col("idx") / F.lit(n))
            inside = Window.partitionBy(*PLACE, "_chunk").orderBy("idx")
            # in order, so that rows are sorted once for all of these
            upto, whole = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            out = out.withColumn("_chunk", chunk)
            firsts, terms, sums, structs = {}, {}, {}, {}
            for name, (cs, pairs, held) in wanted.items():
                both = lambda v, held=held: F.when(held, v).otherwise(0.0)
                at = F.when(held, F.col("idx"))
                for c in cs:
                    firsts[f"{name}_first_{c}"] = F.min_by(c, at).over(whole)
                off = {c: F.col(c).cast("double") - F.col(f"{name}_first_{c}") for c in cs}
                parts = {"rows": F.when(held, 1.0).otherwise(0.0)} | {c: both(off[c]) for c in cs} | {a + b: both(off[a] * off[b]) for a, b in pairs}
                terms |= {f"{name}_t_{f}": v for f, v in parts.items()}
                sums |= {f"{name}_s_{f}": F.sum(f"{name}_t_{f}").over(upto) for f in parts} | {f"{name}_a_{f}": F.sum(f"{name}_t_{f}").over(whole) for f in parts}
                fields = [F.col("_chunk").alias("chunk"), *[F.col(f"{name}_first_{c}").alias(f"first_{c}") for c in cs]]
                fields += [F.col(f"{name}_s_{f}").alias(f) for f in parts] + [F.col(f"{name}_a_{f}").alias(f"all_{f}") for f in parts]
                structs[name] = F.struct(*fields)
            out = out.withColumns(firsts).withColumns(terms).withColumns(sums).withColumns(structs).drop(*firsts, *terms, *sums, "_chunk")
        tails = {f"{name}_tail": F.max_by(name, "idx").over(self.whole) for wanted in self.chunks.values() for name in wanted}
        return out.withColumns(tails) if tails else out

    def std(self, c: str, n: int) -> Column:
        return F.sqrt(self.var(c, n))

    def max(self, c: str, n: int) -> Column:
        return self._window(f"_max_{c}_{n}", F.max(c).over(self.w.rowsBetween(-(n // 2), (n - 1) // 2)))

    def lag(self, c: str, k: int) -> Column:
        return self._window(f"_lag_{c}_{k}", F.lag(c, k).over(self.w))

    def lead(self, c: str, k: int) -> Column:
        return self._window(f"_lead_{c}_{k}", F.lead(c, k).over(self.w))

    def end(self, c: str, last: bool) -> Column:
        """The value of the shard's first or last row."""
        every = self.w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return self._window(f"_end_{c}_{last}", (F.last if last else F.first)(c).over(every))

    def displacement(self, n: int) -> Column:
        """Distance between the ends of the window; an end beyond the track is the row itself."""
        k = n // 2
        ends = [F.coalesce(self.lead(c, k), F.col(c)) - F.coalesce(self.lag(c, k), F.col(c)) for c in ("x", "y")]
        return hypot(*ends)

    def scatter(self, n: int) -> tuple[Column, Column, Column, Column]:
        """Sums of squares and products about the window's mean over rows i - n//2 to i + n//2, and the rows there."""
        rows, squares = self._moments(("x", "y"), n // 2, n // 2)
        return squares["xx"], squares["yy"], squares["xy"], rows

    def apply(self, df: DataFrame, built: dict[str, Column]) -> DataFrame:
        """``df`` with the built columns, by way of what they asked for."""
        terms = {f"{name}_t": term for name, term in self.terms.items()}
        upto = self.w.rowsBetween(Window.unboundedPreceding, 0)
        sums = {name: F.sum(f"{name}_t").over(upto) for name in self.terms} | {f"{name}_all": F.sum(f"{name}_t").over(self.whole) for name in self.terms}
        out = self._with_chunks(df)
        for stage in (terms, sums, self.windows, built):
            if stage:
                out = out.withColumns(stage)
        held = [name for wanted in self.chunks.values() for name in wanted]
        return out.drop(*held, *[f"{name}_tail" for name in held], *terms, *sums, *self.windows)


@dataclass(frozen=True)
class FeatureDef:
    name: str
    version: int
    build: Callable[..., Column] | None
    kernel: str | None = None
    prereqs: tuple[str, ...] = ()
    is_base: bool = False


@dataclass
class Registry:
    """Features by name; names are unique and prerequisites free of cycles."""

    features: dict[str, FeatureDef] = field(default_factory=dict)

    def register(self, name: str, version: int = 1, prereqs: Iterable[str] = (), kernel: str | None = None, is_base: bool = False):
        """Decorator for a builder ``(rolling, seconds, rows) -> Column``."""

        def add(build: Callable[..., Column]) -> Callable[..., Column]:
            if name in self.features:
                raise ValueError(f"feature {name} is registered already")
            self.features[name] = FeatureDef(name, version, build, kernel, tuple(prereqs), is_base)
            return build

        return add

    def versions(self) -> dict[str, int]:
        return {name: f.version for name, f in self.features.items()}

    def ordered(self, names: Iterable[str]) -> list[str]:
        """The features and their prerequisites, prerequisites first."""
        out: list[str] = []
        open_: list[str] = []

        def visit(name: str) -> None:
            if name in out:
                return
            if name in open_:
                raise ValueError("cycle: " + " -> ".join([*open_, name]))
            open_.append(name)
            for p in self.features[name].prereqs:
                visit(p)
            open_.pop()
            out.append(name)

        for name in names:
            visit(name)
        return out


REGISTRY = Registry()
register = REGISTRY.register


def column_name(feature: str, w: int | None) -> str:
    return feature if w is None else f"w{w}_{feature}"


def parse_column(name: str) -> tuple[str, int | None]:
    """Feature and window of a column name."""
    m = re.fullmatch(r"w(\d+)_(.+)", name)
    return (m.group(2), int(m.group(1))) if m else (name, None)


def _plain(name: str, signal: str, how: str, version: int = 1, fill: bool = False) -> None:
    @register(name, version)
    def build(r: Rolling, w: int, n: int) -> Column:
        value = getattr(r, how)(signal, n)
        return F.coalesce(value, F.lit(0.0)) if fill else value


register("larva_body_length", is_base=True)(lambda r, w, n: F.col(GM))
_plain("omega_body_mean", "omega_body", "mean")
_plain("omega_head_std", "omega_head", "std", fill=True)
_plain("omega_relative_mean", "omega_relative", "mean")
_plain("omega_heading_mean", "omega_heading", "mean")
_plain("vel_mean", "v_com", "mean")
_plain("vel_std", "v_com", "std", fill=True)
_plain("vel_norm_mean", "v_mid_norm", "mean")
_plain("head_vel_mean", "v_head", "mean")
_plain("head_vel_std", "v_head", "std", fill=True)
_plain("bending_std", "bending", "std", fill=True)
_plain("hc_ratio_mean", "hc_ratio", "mean")
_plain("ht_ratio_mean", "ht_ratio", "mean")
_plain("reversal_rate", "high_bend_activity", "mean")
_plain("head_bend_max", "head_bend", "max")
_plain("curvature_index_mean", "curvature_index", "mean")
_plain("omega_heading_max", "omega_heading", "max")
_plain("pause_fraction", "is_paused", "mean", fill=True)
_plain("posture_asymmetry_max", "asym_norm", "max")
_plain("turn_fraction", "is_turning", "mean")
_plain("vel_autocorr", "autocorr_1s", "mean")


@register("rog")
def _rog(r: Rolling, w: int, n: int) -> Column:
    spread = F.coalesce(r.var("x", n), F.lit(0.0)) + F.coalesce(r.var("y", n), F.lit(0.0))
    return F.sqrt(spread) / (F.col(GM) + 1e-6)


@register("tortuosity", version=2)
def _tortuosity(r: Rolling, w: int, n: int) -> Column:
    return F.try_divide(r.sum("v_com", n) / r.fps, r.displacement(n) + 0.1 * F.col(GM))


@register("msd", version=2)
def _msd(r: Rolling, w: int, n: int) -> Column:
    return r.displacement(n) * r.displacement(n) / w


@register("msd_norm", version=2)
def _msd_norm(r: Rolling, w: int, n: int) -> Column:
    return r.displacement(n) * r.displacement(n) / (w * F.col(GM) * F.col(GM) + 1e-6)


@register("net_displacement_norm", version=2)
def _net_displacement_norm(r: Rolling, w: int, n: int) -> Column:
    return r.displacement(n) / (F.col(GM) + 1e-6)


@register("angular_tortuosity")
def _angular_tortuosity(r: Rolling, w: int, n: int) -> Column:
    """The half width is half the seconds, counted in rows; an end beyond the track is the row itself."""
    # net is a window of its own, since the running sum isn't kept beside the features
    turned, k = r._running("_s_u_body", F.coalesce("u_body", F.lit(0.0))), w // 2
    ahead, behind = F.coalesce(F.lead(turned, k).over(r.w), F.col(turned)), F.coalesce(F.lag(turned, k).over(r.w), F.col(turned))
    net = r._window(f"_net_u_body_{k}", ahead - behind) if k else F.lit(0.0)
    return r.sum("omega_body", n) / r.fps / (F.abs(net) + 0.01)


@register("bend_peaks_rate")
def _bend_peaks_rate(r: Rolling, w: int, n: int) -> Column:
    return r.sum("is_peak", n) / (r.count("v_com", n) + 1e-6)


@register("coverage")
def _coverage(r: Rolling, w: int, n: int) -> Column:
    return r.count("v_com", n) / F.lit(float(w))


@register("pause_run_frac")
def _pause_run_frac(r: Rolling, w: int, n: int) -> Column:
    return r.mean("has_neighbor", n) / (r.mean("is_paused", n) + 1e-6)


@register("path_length_norm")
def _path_length_norm(r: Rolling, w: int, n: int) -> Column:
    return r.sum("v_com", n) / r.fps / (F.col(GM) + 1e-6)


def _pca(r: Rolling, n: int) -> tuple[Column, Column, Column]:
    xx, yy, xy, rows = r.scatter(n)
    trace, det = xx + yy, xx * yy - xy * xy
    root = F.sqrt(F.greatest(trace * trace - 4 * det, F.lit(0.0)))
    return (trace + root) / 2, F.greatest((trace - root) / 2, F.lit(0.0)), rows


@register("pca_ratio", version=2)
def _pca_ratio(r: Rolling, w: int, n: int) -> Column:
    first, second, rows = _pca(r, n)
    return F.coalesce(F.when((rows >= 3) & (first > 1e-6), F.try_divide(second, first)), F.lit(0.0))


@register("pca_area_norm", version=2)
def _pca_area_norm(r: Rolling, w: int, n: int) -> Column:
    first, second, rows = _pca(r, n)
    area = F.when((rows >= 3) & (first > 1e-6), F.pi() * F.sqrt(first * second)).otherwise(0.0)
    return area / (F.col(GM) * F.col(GM) + 1e-6)


def _step(r: Rolling, w: int) -> int:
    return max(1, int(w / 6 * r.fps))


@register("vel_lag", prereqs=["vel_mean"])
def _vel_lag(r: Rolling, w: int, n: int) -> Column:
    return F.coalesce(r.lag(column_name("vel_mean", w), _step(r, w)), F.lit(0.0))


@register("vel_lead", prereqs=["vel_mean"])
def _vel_lead(r: Rolling, w: int, n: int) -> Column:
    return F.coalesce(r.lead(column_name("vel_mean", w), _step(r, w)), F.lit(0.0))


def _slope(name: str, of: str) -> None:
    @register(name, prereqs=[of])
    def build(r: Rolling, w: int, n: int) -> Column:
        """Value ``k`` rows ahead less ``k`` rows behind; beyond the track its last and first value; without values 0."""
        c, k = column_name(of, w), _step(r, w)
        return F.coalesce(F.coalesce(r.lead(c, k), r.end(c, True)) - F.coalesce(r.lag(c, k), r.end(c, False)), F.lit(0.0))


_slope("omega_body_mean_slope_smooth", "omega_body_mean")
_slope("revis_slope_smooth", "revisitation_mean")
_slope("rog_slope_smooth", "rog")
_slope("tort_slope_smooth", "tortuosity")

for _name in kernels.TURN_STATS:
    register(_name, kernel="turns")(lambda r, w, n, name=_name: F.col(f"_k{w}_{name}"))
register("bend_freq_rolling", kernel="frequency")(lambda r, w, n: F.col(f"_k{w}_frequency"))
register("path_efficiency", version=2, kernel="efficiency")(lambda r, w, n: F.col(f"_k{w}_efficiency"))
register("revisitation_mean", version=2, kernel="revisit")(lambda r, w, n: r.trailing_mean(f"_k{w}_revisit", w))


@register("revisitation_mean_norm", version=2, prereqs=["revisitation_mean"])
def _revisitation_mean_norm(r: Rolling, w: int, n: int) -> Column:
    return F.col(column_name("revisitation_mean", w)) / (F.col(GM) + 1e-6)


def compute_columns(df: DataFrame, columns: Iterable[str], fps: float = FPS, registry: Registry = REGISTRY, keep: Iterable[str] = (), rows: int = 20_000, **signals) -> DataFrame:
    """The keys (``source, ID, frame, et``) and exactly the wanted feature columns.

    Unknown columns are warned of and left out; prerequisites are computed and dropped.
    """
    wanted = list(dict.fromkeys(columns))
    parsed = {c: parse_column(c) for c in wanted}
    for c in [c for c, (f, w) in parsed.items() if f not in registry.features or registry.features[f].is_base != (w is None)]:
        warnings.warn(f"unknown feature column {c}", stacklevel=2)
        del parsed[c]
    windows = sorted({w for _, w in parsed.values() if w is not None})
    # the slope of a trailing mean over a look-back of a window needs two windows and a step
    margin = 2 * max([int(w * fps) for w in windows], default=0) + max([int(w / 6 * fps) for w in windows], default=0) + int(fps) + 64
    out = base_signals(df, fps, rows=max(rows, 4 * margin), margin=margin, **signals)
    plans = [(w, registry.ordered([f for f, v in parsed.values() if v == w])) for w in [None, *windows]]
    kernels_wanted = {(registry.features[f].kernel, w) for w, names in plans for f in names if registry.features[f].kernel}
    if kernels_wanted:
        out = kernels.with_kernels(out, kernels_wanted, fps)
    depth = {f: 0 for f in registry.features}
    for f in registry.ordered(registry.features):
        depth[f] = max([depth[p] + 1 for p in registry.features[f].prereqs], default=0)
    for level in range(max(depth.values()) + 1):
        rolling = Rolling(fps)
        built = {column_name(f, w): registry.features[f].build(rolling, w, int(w * fps) if w else 0) for w, names in plans for f in names if depth[f] == level}
        if built:
            out = rolling.apply(out, built)
    return core(out.select(*TRACK, "frame", "et", *keep, *parsed, "core", "shard", "idx", "_k"))


def full_sweep(df: DataFrame, windows: Iterable[int], fps: float = FPS, registry: Registry = REGISTRY, **options) -> DataFrame:
    """Every registered feature for every window."""
    windows = list(windows)
    if not windows:
        raise ValueError("windows are needed")
    columns = [column_name(f.name, w) for f in registry.features.values() for w in ([None] if f.is_base else windows)]
    return compute_columns(df, columns, fps, registry, **options)


def covered(df: DataFrame, least: float = 0.5, target: str | None = "is_target", shortest: int = 25) -> DataFrame:
    """Adds ``coverage_ok`` (all ``w{s}_coverage`` columns of windows from ``shortest`` seconds on reach ``least``) and ``fed``.

    Rows are fed to a model if they are also targets (a null flag is no target). Without such a column all are covered.
    """
    names = [c for c in df.columns if parse_column(c)[0] == "coverage" and (parse_column(c)[1] or 0) >= shortest]
    ok = F.lit(True)
    for c in names:
        ok = ok & F.coalesce(F.col(c) >= least, F.lit(False))
    wanted = F.coalesce(F.col(target).cast("boolean"), F.lit(False)) if target else F.lit(True)
    return df.withColumn("coverage_ok", ok).withColumn("fed", F.col("coverage_ok") & wanted)


def coverage_counts(judged: DataFrame, target: str | None = "is_target", by: Iterable[str] = ()) -> DataFrame:
    """Counters of :func:`covered`: ``total, targets, covered, fed``."""
    wanted = F.coalesce(F.col(target).cast("boolean"), F.lit(False)) if target else F.lit(True)
    counts = [F.count("*").alias("total"), F.count_if(wanted).alias("targets"), F.count_if("coverage_ok").alias("covered"), F.count_if("fed").alias("fed")]
    return judged.groupBy(*by).agg(*counts)
