"""Queries over annotation tools, models and the feature store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import text
from trackloom.operators import annotate, features, legacy, metrics, ml, ranges, sampling
from trackloom.plans.catalogue import ANN, PRED, ann, pred_frames, rounded, strip_sql
from trackloom.plans.feature_queries import SIGNALS
from trackloom.plans.staging import stage
from trackloom.sources.tables import table

FEATURES = ["larva_body_length", "w5_vel_mean", "w5_omega_body_mean", "w5_rog", "w5_curvature_index_mean", "w5_pause_fraction"]
FOREST = {"trees": 300, "depth": 16, "leaf": 100}
#: smaller forests where many are fitted
SEARCHED = {"trees": 50, "depth": 8, "leaf": 100}


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Features of frames with the label of their behaviour, written once."""
    truth = pred_frames(spark, d).select("source", "ID", "frame", text.truth_label(F.col("behavior"), F.col("tags")).alias("label"))
    made = features.compute_columns(table(spark, d, "long_df"), FEATURES)
    return stage(made.drop("et").join(truth, ["source", "ID", "frame"], "left"), "labelled")[0]


def rf_scores(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities of the frames of tracks outside the train split."""
    rows, registry = labelled(spark, d), table(spark, d, "split_registry")
    train = registry.where("split = 'train'").select("source", "ID").distinct()
    model = ml.train(rows.join(train, ["source", "ID"], "left_semi"), FEATURES, **FOREST)
    others = rows.join(train, ["source", "ID"], "left_anti")
    return rounded(ml.infer(model, others, FEATURES).withColumnRenamed("ID", "id"))


def rf_folds(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each of three folds of tracks."""
    rows = labelled(spark, d)
    scores = ml.cross_validate(rows, FEATURES, sampling.folds(table(spark, d, "split_registry"), 3), **FOREST)
    names = ["fold", "tp", "fp", "fn", "tn", "f1", "balanced_accuracy", "auroc", "average_precision"]
    return spark.createDataFrame([tuple(s[n] for n in names) for s in scores], "fold int, tp long, fp long, fn long, tn long, f1 double, balanced_accuracy double, auroc double, average_precision double")


def feature_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Features with their importance, loss by permutation in tracks not fitted on, and rank correlation with the label."""
    rows = labelled(spark, d).where("label IS NOT NULL")
    train = table(spark, d, "split_registry").where("split = 'train'").select("source", "ID").distinct()
    model = ml.train(rows.join(train, ["source", "ID"], "left_semi"), FEATURES, **FOREST)
    lost = ml.permutation_importance(model, rows.join(train, ["source", "ID"], "left_anti"), FEATURES)
    with_label = ml.spearman(rows, [*FEATURES, "label"])[:-1, -1]
    ranks = spark.createDataFrame([(f, float(v), float(with_label[FEATURES.index(f)])) for f, v in ml.importances(model, FEATURES)], "feature string, importance double, spearman double")
    return rounded(ranks.join(lost, "feature", "left").withColumnsRenamed({"loss": "permutation", "std": "permutation_std"}))


def rf_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Scores over seeds and folds, summed up."""
    scores = ml.seeded_validation(labelled(spark, d), FEATURES, table(spark, d, "split_registry"), **SEARCHED)
    names = ["f1", "log_loss", "auroc", "average_precision"]
    runs = spark.createDataFrame([(s["seed"], s["fold"], *[s[n] for n in names]) for s in scores], "seed int, fold int, f1 double, log_loss double, auroc double, average_precision double")
    return rounded(metrics.summary(runs, names))


def rf_search(spark: SparkSession, d: str) -> DataFrame:
    """Settings of the forest drawn at random, by average precision over folds of tracks."""
    space = {"trees": (20, 50), "depth": (4, 8, 16), "leaf": (20, 100), "subset": ("0.3", "sqrt")}
    trials = ml.random_search(labelled(spark, d), FEATURES, sampling.folds(table(spark, d, "split_registry"), 3), space, draws=6)
    return rounded(spark.createDataFrame([(t["trees"], t["depth"], t["leaf"], t["subset"], t["score"]) for t in trials], "trees int, depth int, leaf int, subset string, score double"))


def rf_elimination(spark: SparkSession, d: str) -> DataFrame:
    """Sets of features, the least important dropped in each step, with their mean F1 over folds."""
    steps = ml.eliminate(labelled(spark, d), FEATURES, sampling.folds(table(spark, d, "split_registry"), 3), step=2, least=2, **SEARCHED)
    return rounded(spark.createDataFrame([(len(s["features"]), ";".join(s["features"]), s["f1"]) for s in steps], "n int, features string, f1 double"))


def feature_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Of features that rank frames alike, the one that goes best with the label."""
    rows = labelled(spark, d).where("label IS NOT NULL")
    return spark.createDataFrame([(f,) for f in ml.representatives(rows, FEATURES)], "feature string")


def coverage_counts(spark: SparkSession, d: str) -> DataFrame:
    """Frames by source that lie in an annotation and are covered over 30 s on both counts."""
    made = features.compute_columns(table(spark, d, "long_df"), ["w30_coverage"], registry=legacy.LEGACY, **legacy.SIGNALS)
    events = ann(spark, d).groupBy("annotation_id").agg(*[F.min(c).alias(c) for c in ("source", "ID", "t0", "t1")])
    targets = ranges.padded_frames(made, events, 0.0, "annotation_id", ["source", "ID", "frame"]).select("source", "ID", "frame", "is_target")
    judged = features.covered(made.join(targets, ["source", "ID", "frame"], "left"), 0.95)
    return features.coverage_counts(judged, by=["source"])


def label_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(annotate.coverage(ann(spark, d), pred_frames(spark, d)).withColumnRenamed("ID", "id"), 5)


def label_gaps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(annotate.gaps(ann(spark, d), pred_frames(spark, d)).withColumnRenamed("ID", "id"), 5)


def tag_memory(spark: SparkSession, d: str) -> DataFrame:
    return annotate.tag_memory(ann(spark, d).withColumnRenamed("behavior", "Behavior")).select(F.col("Behavior").alias("behavior"), "tag", "n", "place")


def snapped_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Annotations as if they were added again: clamped to their track and snapped to frames."""
    labels = ann(spark, d)
    new = labels.groupBy("annotation_id").agg(*[F.min(c).alias(c) for c in ("source", "ID", "t0", "t1", "tags")])
    added = annotate.add_intervals(new, pred_frames(spark, d), labels)
    return rounded(added.select("annotation_id", "source", F.col("ID").alias("id"), "t0", "t1", "t0_frame", "t1_frame", "overlaps"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (rf_scores, rf_folds, rf_seeds, rf_search, rf_elimination, feature_ranks, feature_clusters, coverage_counts, label_coverage, label_gaps, tag_memory, snapped_intervals)}

_PERIODS = f"""{PRED}, {ANN}, rn AS (SELECT *, max(t1) OVER (PARTITION BY source, ID ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM an),
ro AS (SELECT *, sum(CASE WHEN reach IS NULL OR t0 - reach > 1.1::DOUBLE / 6 THEN 1 ELSE 0 END) OVER (PARTITION BY source, ID ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS run FROM rn),
pe AS (SELECT source, ID, min(t0) AS t0, max(t1) AS t1 FROM ro GROUP BY source, ID, run), tb AS (SELECT source, ID, min(et) AS begin_, max(et) AS end_ FROM pf GROUP BY ALL)"""
SQL: dict[str, str] = {
    "label_coverage": f"""WITH {_PERIODS}, s AS (SELECT source, ID, sum(t1 - t0) AS l, count(*) AS n FROM pe GROUP BY ALL)
SELECT tb.source, tb.ID AS id, round(coalesce(l, 0), 5) AS labelled_s, coalesce(n, 0) AS periods, round(coalesce(l, 0) / nullif(end_ - begin_, 0), 5) AS share FROM tb LEFT JOIN s USING (source, ID)""",
    "label_gaps": f"""WITH {_PERIODS}, j AS (SELECT tb.source, tb.ID, begin_, end_, t0, t1, lag(t1) OVER (PARTITION BY tb.source, tb.ID ORDER BY t0) AS p FROM tb LEFT JOIN pe USING (source, ID)),
g AS (SELECT source, ID, coalesce(p, begin_) AS a, coalesce(t0, end_) AS b FROM j UNION ALL SELECT source, ID, max(t1), max(end_) FROM j GROUP BY source, ID HAVING max(t1) IS NOT NULL)
SELECT source, ID AS id, round(a, 5) AS gap_start, round(b, 5) AS gap_end FROM g WHERE b - a > 1.1::DOUBLE / 6""",
    "snapped_intervals": f"""WITH {PRED}, {ANN}, tb AS (SELECT source, ID, min(et) AS begin_, max(et) AS end_ FROM pf GROUP BY ALL),
nw AS (SELECT annotation_id, min(source) AS source, min(ID) AS ID, min(t0) AS t0, min(t1) AS t1 FROM an GROUP BY annotation_id),
cl AS (SELECT annotation_id, source, ID, begin_, end_, greatest(least(t0, end_), begin_) AS t0, greatest(least(t1, end_), begin_) AS t1 FROM nw JOIN tb USING (source, ID)),
pt AS (SELECT source, ID, et, max(frame) AS frame FROM pf GROUP BY ALL),
b0 AS (SELECT cl.*, p.et AS e, p.frame AS f FROM cl ASOF JOIN pt p ON cl.source = p.source AND cl.ID = p.ID AND cl.t0 >= p.et),
a0 AS (SELECT b0.*, p.et AS e2, p.frame AS f2 FROM b0 ASOF JOIN pt p ON b0.source = p.source AND b0.ID = p.ID AND b0.t0 <= p.et),
s0 AS (SELECT annotation_id, source, ID, begin_, end_, t1, CASE WHEN t0 - e <= e2 - t0 THEN e ELSE e2 END AS t0, CASE WHEN t0 - e <= e2 - t0 THEN f ELSE f2 END AS t0_frame FROM a0),
b1 AS (SELECT s0.*, p.et AS e, p.frame AS f FROM s0 ASOF JOIN pt p ON s0.source = p.source AND s0.ID = p.ID AND s0.t1 >= p.et),
a1 AS (SELECT b1.*, p.et AS e2, p.frame AS f2 FROM b1 ASOF JOIN pt p ON b1.source = p.source AND b1.ID = p.ID AND b1.t1 <= p.et),
s1 AS (SELECT annotation_id, source, ID, begin_, end_, t0, t0_frame, CASE WHEN t1 - e <= e2 - t1 THEN e ELSE e2 END AS t1, CASE WHEN t1 - e <= e2 - t1 THEN f ELSE f2 END AS t1_frame FROM a1),
fin AS (SELECT annotation_id, source, ID, t0, t0_frame, CASE WHEN t1 <= t0 THEN t0 + 1 / 6.0::DOUBLE ELSE t1 END AS t1, greatest(t1_frame, t0_frame + 1) AS t1_frame FROM s1)
SELECT annotation_id, source, ID AS id, round(t0, 6) AS t0, round(t1, 6) AS t1, t0_frame, t1_frame, (SELECT count(*) FROM an e WHERE e.source = fin.source AND e.ID = fin.ID AND e.t0 < fin.t1 AND fin.t0 < e.t1) AS overlaps FROM fin""",
    "coverage_counts": f"""WITH {SIGNALS}, {ANN}, e AS (SELECT annotation_id, min(source) AS source, min(ID) AS ID, min(t0) AS t0, min(t1) AS t1 FROM an GROUP BY annotation_id),
c AS (SELECT source, ID, frame, et, (count(v_com) OVER (PARTITION BY source, ID ORDER BY frame ROWS BETWEEN 90 PRECEDING AND 89 FOLLOWING)) / 180.0::DOUBLE >= 0.95 AS ok FROM sg),
j AS (SELECT c.*, EXISTS (SELECT 1 FROM e WHERE e.source = c.source AND e.ID = c.ID AND c.et >= e.t0 AND c.et <= e.t1) AS tg FROM c)
SELECT source, count(*) AS total, count_if(tg)::BIGINT AS targets, count_if(ok)::BIGINT AS covered, count_if(ok AND tg)::BIGINT AS fed FROM j GROUP BY source""",
    "tag_memory": f"""WITH {ANN}, t AS (SELECT behavior, unnest(list_filter(list_transform(string_split(coalesce(tags, ''), ';'), lambda v: lower({strip_sql('v')})), lambda v: v <> '')) AS tag FROM an),
c AS (SELECT behavior, tag, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY behavior ORDER BY n DESC, tag) AS place FROM c) SELECT behavior, tag, n, place FROM r WHERE place <= 10""",
}
