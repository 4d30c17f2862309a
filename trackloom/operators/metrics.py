"""Frame and event metrics of predictions against truth.

Ranked metrics never use one global window: rows are first counted per distinct probability, probabilities are cut into
buckets, and running sums go through the buckets' totals, a table of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.text import strip
from trackloom.operators.islands import event_ids
from trackloom.operators.tracks import TRACK, core, ordered, row_shards, same, with_key
from trackloom.plans.staging import stage


def _over(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def confusion(df: DataFrame, truth: str = "truth", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """``tp, fp, fn, tn`` over rows with a truth and a prediction."""
    rows = df.where(F.col(truth).isNotNull() & F.col(prediction).isNotNull())
    cell = lambda t, p, name: F.count_if((F.col(truth) == t) & (F.col(prediction) == p)).alias(name)
    cells = [cell(1, 1, "tp"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(0, 0, "tn")]
    return rows.groupBy(*by).agg(*cells) if by else rows.agg(*cells)


def derived(cells: DataFrame, beta: float = 0.5) -> DataFrame:
    """Metrics of confusion cells; null where a ratio has no ground."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    tpr, tnr, ppv, npv = _over(tp, tp + fn), _over(tn, tn + fp), _over(tp, tp + fp), _over(tn, tn + fn)
    n = tp + fp + fn + tn
    chance = _over((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    agreed = _over(tp + tn, n)
    b2 = beta * beta
    return cells.withColumns(
        {
            "accuracy": agreed, "balanced_accuracy": (tpr + tnr) / 2, "tpr": tpr, "tnr": tnr, "fpr": 1 - tnr, "fnr": 1 - tpr, "ppv": ppv, "npv": npv, "fdr": 1 - ppv,
            "f1": _over(2 * tp, 2 * tp + fp + fn), "f_beta": _over((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp), "fm": F.sqrt(ppv * tpr),
            "mcc": _over(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "dor": _over(tp * tn, fp * fn), "csi": _over(tp, tp + fn + fp),
            "kappa": _over(agreed - chance, 1 - chance), "informedness": tpr + tnr - 1, "markedness": ppv + npv - 1, "prevalence": _over(tp + fn, n),
        }
    )


def thresholds(df: DataFrame, truth: str = "truth", prob: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """Per distinct probability: ``prob, pos, neg`` there and ``tp, fp`` at and above it, with the totals ``p, n``, by group."""
    by = list(by)
    rows = df.where(F.col(truth).isNotNull() & F.col(prob).isNotNull() & ~F.isnan(prob))
    each = with_key(rows, by).groupBy("_k", F.col(prob).alias("prob")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    cut = ordered(each, F.col("_k"), F.col("prob").desc(), name="probabilities")
    # one row per group and range
    totals = cut.groupBy("_k", "_b").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    every = Window.partitionBy("_k")
    above = every.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_k", "_b", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_fp"), F.sum("_p").over(every).alias("p"), F.sum("_n").over(every).alias("n"))
    inside = Window.partitionBy("_k", "_b").orderBy(F.col("prob").desc()).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({"_lp": F.sum("pos").over(inside), "_ln": F.sum("neg").over(inside)})
    return local.join(offsets, ["_k", "_b"]).select(*[F.col(f"_k.{c}").alias(c) for c in by], "prob", "pos", "neg", (F.col("_lp") + F.col("_tp")).alias("tp"), (F.col("_ln") + F.col("_fp")).alias("fp"), "p", "n")


def ranked_metrics(df: DataFrame, truth: str = "truth", prob: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """``auroc`` (ties count half) and ``average_precision``, by group."""
    at = thresholds(df, truth, prob, by)
    wins = F.sum(F.col("pos") * (F.col("n") - F.col("fp")) + F.col("pos") * F.col("neg") / 2)
    precision = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    p, n = F.max("p"), F.max("n")
    found = [_over(wins, p * n).alias("auroc"), _over(precision, p).alias("average_precision")]
    return at.groupBy(*by).agg(*found) if by else at.agg(*found)


def curves(df: DataFrame, truth: str = "truth", prob: str = "prob") -> DataFrame:
    """Points of the ROC, precision-recall, DET, gain and lift curves, one per distinct probability."""
    at = thresholds(df, truth, prob)
    tpr, fpr = _over(F.col("tp"), F.col("p")), _over(F.col("fp"), F.col("n"))
    shown = (F.col("tp") + F.col("fp")) / (F.col("p") + F.col("n"))
    return at.select("prob", tpr.alias("tpr"), fpr.alias("fpr"), (1 - tpr).alias("fnr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), shown.alias("shown"), _over(tpr, shown).alias("lift"))


def best_threshold(df: DataFrame, truth: str = "truth", prob: str = "prob") -> DataFrame:
    """The probability with the largest informedness (the larger of equals)."""
    return curves(df, truth, prob).agg(F.max(F.struct((F.col("tpr") - F.col("fpr")).alias("informedness"), "prob")).alias("b")).select(F.col("b.prob").alias("threshold"), "b.informedness")


def mean_roc(df: DataFrame, fold: str, truth: str = "truth", prob: str = "prob", points: int = 200) -> DataFrame:
    """The folds' ROC curves on one grid: ``point, fpr, mean_tpr, std_tpr, folds``; folds of one class have no curve.

    The curve of a fold is linear between its points; where it rises straight up its upper end counts.
    """
    at = thresholds(df, truth, prob, [fold]).where("p > 0 AND n > 0")
    last = F.lit(points - 1)
    # the grid from the point before up to this one, which only moves to the right if it has negatives
    low, high = F.ceil((F.col("fp") - F.col("neg")) / F.col("n") * last), F.ceil(F.col("fp") / F.col("n") * last) - 1
    spots = at.where("neg > 0").select("*", F.explode(F.when(low <= high, F.sequence(low, high))).alias("point"))
    share = (F.col("point") / last * F.col("n") - (F.col("fp") - F.col("neg"))) / F.col("neg")
    inner = spots.select(fold, "point", ((F.col("tp") - F.col("pos") + share * F.col("pos")) / F.col("p")).alias("tpr"))
    ends = at.select(fold).distinct().select(fold, F.lit(points - 1).cast("long").alias("point"), F.lit(1.0).alias("tpr"))
    every = inner.unionByName(ends)
    return every.groupBy("point").agg(F.avg("tpr").alias("mean_tpr"), F.stddev_pop("tpr").alias("std_tpr"), F.count("*").alias("folds")).select("point", (F.col("point") / last).alias("fpr"), "mean_tpr", "std_tpr", "folds")


def log_loss(df: DataFrame, truth: str = "truth", prob: str = "prob", least: float = 1e-15, by: Sequence[str] = ()) -> DataFrame:
    """Mean negative log-likelihood of the truth, probabilities kept ``least`` away from 0 and 1."""
    rows = df.where(F.col(truth).isNotNull() & F.col(prob).isNotNull() & ~F.isnan(prob))
    p = F.greatest(F.least(F.col(prob), F.lit(1 - least)), F.lit(least))
    loss = F.avg(-F.when(F.col(truth) == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss")
    return rows.groupBy(*by).agg(loss) if by else rows.agg(loss)


def tagged_confusion(df: DataFrame, truth: str = "truth", prediction: str = "prediction", tags: str = "tags") -> DataFrame:
    """Rows by truth and tag with the predictions: ``truth, tag, negative, positive`` and their shares in percent.

    A row with several tags counts under each of them, one without (or with an empty one) under ``None``.
    """
    rows = df.where(F.col(truth).isNotNull() & F.col(prediction).isNotNull())
    tag = F.transform(F.split(F.coalesce(tags, F.lit("None")), ";"), lambda t: F.coalesce(F.nullif(strip(t), F.lit("")), F.lit("None")))
    each = rows.select(F.col(truth).alias("truth"), F.explode(tag).alias("tag"), F.col(prediction).alias("_p"))
    counts = each.groupBy("truth", "tag").agg(F.count_if(F.col("_p") == 0).alias("negative"), F.count_if(F.col("_p") == 1).alias("positive"))
    whole = F.col("negative") + F.col("positive")
    return counts.select("*", (_over(F.col("negative"), whole) * 100).alias("negative_pct"), (_over(F.col("positive"), whole) * 100).alias("positive_pct"))


def summary(scores: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Of each score over seeds or folds: ``score, runs, median, mean, std, least, most``. One row per run comes in."""
    long = scores.select(*by, F.explode(F.array(*[F.struct(F.lit(v).alias("score"), F.col(v).cast("double").alias("v")) for v in values])).alias("e")).select(*by, "e.*")
    return long.where(F.col("v").isNotNull()).groupBy(*by, "score").agg(F.count("v").alias("runs"), F.median("v").alias("median"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("most"))


def calibration(df: DataFrame, truth: str = "truth", prob: str = "prob", bins: int = 10) -> DataFrame:
    """``bin, n, mean_prob, share`` of uniform bins; 1 belongs to the last one."""
    rows = df.where(F.col(truth).isNotNull() & F.col(prob).isNotNull() & ~F.isnan(prob))
    cell = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(cell.alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("mean_prob"), F.avg(F.col(truth).cast("double")).alias("share"))


def probability_scores(df: DataFrame, truth: str = "truth", prob: str = "prob", bins: int = 10) -> DataFrame:
    """``brier`` and expected calibration error ``ece``."""
    cells = calibration(df, truth, prob, bins)
    ece = cells.agg((F.sum(F.abs(F.col("mean_prob") - F.col("share")) * F.col("n")) / F.sum("n")).alias("ece"))
    rows = df.where(F.col(truth).isNotNull() & F.col(prob).isNotNull() & ~F.isnan(prob))
    brier = rows.agg(F.avg((F.col(truth) - F.col(prob)) * (F.col(truth) - F.col(prob))).alias("brier"))
    return brier.withColumn("_k", F.lit(1)).join(ece.withColumn("_k", F.lit(1)), "_k").drop("_k")


def _runs_of_both(rows: DataFrame, gap_s: float, time: str, order: str) -> DataFrame:
    """Numbers of the segment and of the runs of ``truth`` and ``pred`` inside it; each step is written, the next reads it more than once."""
    cut, _ = stage(event_ids(rows, [], gap_s, TRACK, time, order).withColumnRenamed("event_id", "segment"), "segments")
    marked, _ = stage(event_ids(cut, ["truth", "segment"], None, TRACK, time, order).withColumnRenamed("event_id", "t_run"), "truth-runs")
    return stage(event_ids(marked, ["pred", "segment"], None, TRACK, time, order).withColumnRenamed("event_id", "p_run"), "both-runs")[0]


def event_confusion(df: DataFrame, truth: str = "truth", prediction: str = "prediction", least: float = 0.5, strict: bool = True, grace: int = 30, edge: int = 9, gap_s: float = 0.5, time: str = "et", order: str = "frame") -> DataFrame:
    """Events of each track: ``kind`` ``tp``, ``fn`` or ``fp`` with ``source, ID, t0, t1, share``.

    A true event is found if more than ``least`` of its rows (at least, unless ``strict``) are predicted. Rows are safe
    in true events widened by ``grace`` rows and in the first and last ``edge`` rows of each negative run; every stretch
    of predicted rows that aren't safe is a false event with its own ends (``share`` 1), so one predicted run can give
    several. Runs, stretches and widening don't cross time steps longer than ``gap_s``; rows without truth count as no
    event.
    """
    rows = df.select(*TRACK, order, time, F.col(truth).alias("truth"), F.coalesce(F.col(prediction).cast("int"), F.lit(0)).alias("pred"))
    cut, _ = stage(event_ids(rows, [], gap_s, TRACK, time, order).withColumnRenamed("event_id", "segment"), "segments")
    both, _ = stage(event_ids(cut, ["truth", "segment"], None, TRACK, time, order).withColumnRenamed("event_id", "t_run"), "truth-runs")
    true_events = both.where("truth = 1").groupBy(*TRACK, "t_run").agg(F.min(time).alias("t0"), F.max(time).alias("t1"), F.avg(F.col("pred").cast("double")).alias("share"))
    found = (F.col("share") > least) if strict else (F.col("share") >= least)
    hits = true_events.select(*TRACK, "t0", "t1", "share", F.when(found, "tp").otherwise("fn").alias("kind"))
    # rows near a true event or near the ends of a negative run are safe; looked at in shards with a margin of that size
    shards = row_shards(both, TRACK, order, margin=max(grace, edge))
    near = Window.partitionBy("_k", "shard", "segment").orderBy("idx")
    beside = lambda k: F.coalesce(F.lag("t_run", k).over(near) != F.col("t_run"), F.lit(True)) if k > 0 else F.coalesce(F.lead("t_run", -k).over(near) != F.col("t_run"), F.lit(True))
    at_edge = (F.col("truth") == 0) & (beside(edge) | beside(-edge)) if edge > 0 else F.lit(False)
    near_true = F.max((F.coalesce("truth", F.lit(0)) == 1).cast("int")).over(near.rowsBetween(-grace, grace)) == 1
    judged = core(shards.withColumn("loose", ((F.col("pred") == 1) & ~near_true & ~F.coalesce(at_edge, F.lit(False))).cast("int")))
    seen, _ = stage(judged.select(*TRACK, "segment", order, time, "loose"), "judged-rows")
    stretches = event_ids(seen, ["loose", "segment"], None, TRACK, time, order).where("loose = 1").groupBy(*TRACK, "event_id").agg(F.min(time).alias("t0"), F.max(time).alias("t1"))
    return hits.unionByName(stretches.select(*TRACK, "t0", "t1", F.lit(1.0).alias("share"), F.lit("fp").alias("kind")))


def event_list(events: DataFrame, unseen: DataFrame, kinds: Sequence[str] = ("fp", "fn")) -> DataFrame:
    """The false events with ``is_unseen``, whether their track is one of ``unseen`` (such as the validation tracks)."""
    known = with_key(unseen.select(*TRACK), TRACK).select("_k", F.lit(True).alias("is_unseen")).distinct()
    listed = with_key(events.where(F.col("kind").isin(*kinds)), TRACK).join(known, "_k", "left")
    return listed.select(*events.columns, F.coalesce("is_unseen", F.lit(False)).alias("is_unseen"))


def contributing_events(df: DataFrame, truth: str = "truth", prediction: str = "prediction", least: float = 0.3, gap_s: float = 0.5, time: str = "et", order: str = "frame") -> DataFrame:
    """The other rule of events, in the form of :func:`event_confusion`.

    A true event is found if at least ``least`` of its rows are predicted; a predicted event is false unless it shares
    a row with a found event. ``share`` of a false event is 1.
    """
    rows = df.select(*TRACK, order, time, F.col(truth).alias("truth"), F.coalesce(F.col(prediction).cast("int"), F.lit(0)).alias("pred"))
    both = _runs_of_both(rows, gap_s, time, order)
    # rows per pair of runs, then per run: the runs that meet are few
    pairs = both.groupBy(*TRACK, "truth", "t_run", "pred", "p_run").agg(F.min(time).alias("t0"), F.max(time).alias("t1"), F.count("*").alias("n"))
    events = pairs.where("truth = 1").groupBy(*TRACK, "t_run").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), (F.sum(F.when(F.col("pred") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    judged = events.withColumn("kind", F.when(F.col("share") >= least, "tp").otherwise("fn"))
    found = pairs.where("truth = 1 AND pred = 1").join(judged.where("kind = 'tp'").select(*TRACK, "t_run"), [*TRACK, "t_run"], "left_semi").select(*TRACK, "p_run").distinct()
    predicted = pairs.where("pred = 1").groupBy(*TRACK, "p_run").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    false_events = predicted.join(found, [*TRACK, "p_run"], "left_anti").select(*TRACK, "t0", "t1", F.lit(1.0).alias("share"), F.lit("fp").alias("kind"))
    return judged.select(*TRACK, "t0", "t1", "share", "kind").unionByName(false_events)


def event_scores(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``tp, fp, fn, precision, recall, f1`` of a list of events."""
    cells = [F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")]
    table = events.groupBy(*by).agg(*cells) if by else events.agg(*cells)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return table.withColumns({"precision": _over(tp, tp + fp), "recall": _over(tp, tp + fn), "f1": _over(2 * tp, 2 * tp + fp + fn)})


def leaked_tracks(train: DataFrame, evaluated: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Tracks in both tables."""
    return evaluated.select(*keys).distinct().alias("a").join(train.select(*keys).distinct().alias("b"), same("a", "b", keys), "left_semi")


def no_leak(train: DataFrame, evaluated: DataFrame, keys: Sequence[str] = TRACK) -> None:
    """Raise if a track was trained on and is evaluated."""
    found = leaked_tracks(train, evaluated, keys).limit(5).collect()
    if found:
        raise ValueError(f"tracks both trained on and evaluated, such as {[tuple(r) for r in found]}")


def assess(df: DataFrame, train: DataFrame, truth: str = "truth", prediction: str = "prediction", prob: str = "prob") -> DataFrame:
    """All scores of evaluated frames in one table, ``metric, value``: frames, events, ranking, calibration.

    Raises if a track of ``train`` is among the frames.
    """
    no_leak(train, df)
    judged, _ = stage(df.where(F.col(truth).isNotNull()), "assessed")
    events = event_scores(event_confusion(judged, truth, prediction)).select(*[F.col(c).alias(f"event_{c}") for c in ("tp", "fp", "fn", "precision", "recall", "f1")])
    parts = [derived(confusion(judged, truth, prediction)), events, ranked_metrics(judged, truth, prob), probability_scores(judged, truth, prob), log_loss(judged, truth, prob)]
    long = [p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in p.columns])).alias("e")).select("e.*") for p in parts]
    out = long[0]
    for more in long[1:]:
        out = out.unionByName(more)
    return out
