"""Queries over frames, predictions and annotations, each with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import text
from trackloom.operators import bouts, islands, labels, metrics, periods, postprocess, ranges, sampling, tracks
from trackloom.operators.frames import FPS, frame_number, is_number
from trackloom.plans.staging import stage
from trackloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for results that don't hang on the order of additions; negative zero is zero."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def pred_frames(spark: SparkSession, d: str) -> DataFrame:
    """Predictions, one row per frame: the row nearest to the beat."""
    p = table(spark, d, "predictions")
    rows = p.select("source", "ID", "et", F.when(is_number(F.col("prob")), F.col("prob")).alias("prob"), "prediction", "behavior", "tags").withColumn("frame", frame_number(F.col("et"))).where("frame IS NOT NULL")
    best = F.min(F.struct(F.abs(F.col("et") * FPS - F.col("frame")).alias("off"), "et", "prob", "prediction", "behavior", "tags")).alias("r")
    return rows.groupBy("source", "ID", "frame").agg(best).select("source", "ID", "frame", "r.et", "r.prob", "r.prediction", "r.behavior", "r.tags")


_BEAT = "CAST(round_even(et * 6, 0) AS BIGINT)"
PRED = f"""pf AS (
  SELECT source, ID, {_BEAT} AS frame, et, CASE WHEN isnan(prob) THEN NULL ELSE prob END AS prob, prediction, behavior, tags FROM predictions WHERE et IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY source, ID, {_BEAT} ORDER BY abs(et * 6 - {_BEAT}), et, prob NULLS FIRST, prediction NULLS FIRST, behavior NULLS FIRST, tags NULLS FIRST) = 1)"""


def coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Positions of centroid and head and tail, one row per frame."""
    return tracks.frame_table(table(spark, d, "long_df"), ["x", "y", "xspine_0", "yspine_0", "xspine_10", "yspine_10"])


def _clean(c: str) -> str:
    return f"CASE WHEN NOT isnan({c}) AND abs({c}) < 1000 THEN {c} END AS {c}"


FRAMES = f"""fr0 AS (SELECT source, ID, {_BEAT} AS frame, et, {', '.join(_clean(c) for c in tracks.COORDS)} FROM long_df WHERE et IS NOT NULL),
fr AS (
  SELECT * FROM fr0
  QUALIFY row_number() OVER (PARTITION BY source, ID, frame ORDER BY abs(et * 6 - frame), et, x NULLS FIRST, y NULLS FIRST, xspine_0 NULLS FIRST, yspine_0 NULLS FIRST) = 1)"""

def strip_sql(c: str) -> str:
    """Without white space of any kind at both ends, in SQL."""
    return f"regexp_replace({c}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')"


_TRIM = f"upper({strip_sql('source')})"
_KEY = f"lower({strip_sql('Behavior')})"
_KNOWN = f"CASE {_KEY} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.BEHAVIORS.items()) + f" ELSE {_KEY} END"
ANN = f"""an AS (
  SELECT DISTINCT annotation_id, {_TRIM} AS source, AN, ID, t0, t1, {_KNOWN} AS behavior, tags, annotator FROM annotations
  WHERE ID IS NOT NULL AND t0 IS NOT NULL AND t1 IS NOT NULL AND t1 > t0 AND Behavior IS NOT NULL)"""


def ann(spark: SparkSession, d: str) -> DataFrame:
    rows = labels.annotations(table(spark, d, "annotations"))
    return rows.select("annotation_id", "source", "AN", "ID", "t0", "t1", F.col("Behavior").alias("behavior"), "tags", "annotator").distinct()


# --- scans, projections and filters


@query("SELECT source, ID AS id, count(*) AS n, min(et) AS t_first, max(et) AS t_last FROM long_df WHERE source IN ('GA1', 'GA2', 'EA') GROUP BY ALL")
def scan_tracks(spark, d):
    rows = table(spark, d, "long_df").where(F.col("source").isin("GA1", "GA2", "EA"))
    return rows.groupBy("source", F.col("ID").alias("id")).agg(F.count("*").alias("n"), F.min("et").alias("t_first"), F.max("et").alias("t_last"))


@query(
    f"""WITH {ANN}, t AS (SELECT *, list_filter(list_transform(string_split(coalesce(tags, ''), ';'), lambda v: lower({strip_sql('v')})), lambda v: v <> '') AS l FROM an)
SELECT annotation_id, source, ID AS id, t0, t1, round(t1 - t0, 6) AS duration, behavior,
  CASE WHEN behavior IN ('dwelling', 'nondwelling', 'crawling', 'turning', 'other') THEN behavior ELSE 'other' END AS main_behavior,
  array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ';') AS tags, coalesce(nullif({strip_sql('annotator')}, ''), 'unknown') AS annotator FROM t"""
)
def clean_annotations(spark, d):
    rows = ann(spark, d)
    return rounded(
        rows.select(
            "annotation_id", "source", F.col("ID").alias("id"), "t0", "t1", (F.col("t1") - F.col("t0")).alias("duration"), "behavior", text.main_behavior(F.col("behavior")).alias("main_behavior"),
            text.canonical_tags(F.col("tags")).alias("tags"), text.annotator(F.col("annotator")).alias("annotator"),
        )
    )


@query(
    f"""WITH {ANN} SELECT source, count(*) AS n,
  count_if(len(list_filter(list_transform(string_split(coalesce(tags, ''), ';'), lambda v: {strip_sql('v')}), lambda v: v IN ('wonderful', 'long'))) > 0)::BIGINT AS by_token,
  count_if(coalesce(contains(lower(tags), 'turn'), false))::BIGINT AS by_part, count_if(coalesce(tags IN ('wonderful', 'slow'), false))::BIGINT AS by_text FROM an GROUP BY source"""
)
def tag_rules(spark, d):
    t = F.col("tags")
    return ann(spark, d).groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(text.has_tag(t, "wonderful", "long")).alias("by_token"), F.count_if(text.tags_contain(t, "turn")).alias("by_part"), F.count_if(text.tags_are(t, "wonderful", "slow")).alias("by_text")
    )


@query(f"WITH {ANN} SELECT annotation_id, source, ID AS id FROM an WHERE (source = 'GA1' AND ID BETWEEN 100 AND 150) OR (source = 'EA' AND ID >= 120)")
def id_slices(spark, d):
    return labels.id_slices(ann(spark, d), {"GA1": (100, 150), "EA": (120, None)}).select("annotation_id", "source", F.col("ID").alias("id"))


@query("SELECT DISTINCT source, ID AS id FROM long_df WHERE (source LIKE 'GA%' OR source LIKE 'OCT%') AND (source > 'GA2' OR (source = 'GA2' AND ID >= 120))")
def cursor_and_prefix(spark, d):
    rows = table(spark, d, "long_df").select("source", "ID").distinct()
    return labels.after_cursor(rows.where(labels.source_starts(F.col("source"), "GA", "OCT")), "GA2", 120).select("source", F.col("ID").alias("id"))


# --- joins


@query(
    f"""WITH {PRED}, {ANN} SELECT p.source, p.ID AS id, p.frame, a.behavior AS label, a.annotation_id FROM pf p JOIN an a
ON p.source = a.source AND p.ID = a.ID AND p.et >= a.t0 AND p.et < a.t1
QUALIFY row_number() OVER (PARTITION BY p.source, p.ID, p.frame ORDER BY a.t0 DESC, a.annotation_id DESC) = 1"""
)
def interval_last_wins(spark, d):
    frames = pred_frames(spark, d).select("source", "ID", "frame", "et")
    intervals = ann(spark, d).select("source", "ID", "t0", "t1", "annotation_id", F.col("behavior").alias("label"))
    got = ranges.label_frames(frames, intervals, [F.col("t0"), F.col("annotation_id")], ["label", "annotation_id"])
    return got.select("source", F.col("ID").alias("id"), "frame", "label", "annotation_id")


@query(
    f"""WITH {PRED}, {ANN} SELECT a.behavior AS label, count(*) AS frames, count(DISTINCT a.annotation_id) AS intervals FROM pf p JOIN an a
ON p.source = a.source AND p.ID = a.ID AND p.et >= a.t0 AND p.et < a.t1 GROUP BY ALL"""
)
def interval_all(spark, d):
    frames = pred_frames(spark, d).select("source", "ID", "frame", "et")
    intervals = ann(spark, d).select("source", "ID", "t0", "t1", "annotation_id", F.col("behavior").alias("label"))
    got = ranges.label_frames(frames, intervals, [F.col("t0")], ["label", "annotation_id"], how="all")
    return got.groupBy("label").agg(F.count("*").alias("frames"), F.countDistinct("annotation_id").alias("intervals"))


@query(
    f"""WITH {PRED}, {FRAMES}, m AS (
  SELECT f.source, f.ID, f.frame, p.et AS matched_at, p.prob FROM fr f JOIN pf p ON f.source = p.source AND f.ID = p.ID AND abs(p.et - f.et) <= 0.1
  QUALIFY row_number() OVER (PARTITION BY f.source, f.ID, f.frame ORDER BY abs(p.et - f.et), p.et, p.prob DESC NULLS LAST) = 1)
SELECT f.source, f.ID AS id, f.frame, round(m.matched_at, 6) AS matched_at, round(m.prob, 6) AS prob FROM fr f LEFT JOIN m USING (source, ID, frame)"""
)
def asof_nearest(spark, d):
    frames = coordinates(spark, d).select("source", "ID", "frame", "et")
    got = ranges.asof_nearest(frames, pred_frames(spark, d).select("source", "ID", "et", "prob"), 0.1, ["source", "ID", "frame"], ["prob"])
    return rounded(got.select("source", F.col("ID").alias("id"), "frame", "matched_at", "prob"))


@query(
    f"""WITH {PRED}, {ANN} SELECT p.source, p.ID AS id, p.frame, a.annotation_id, p.et BETWEEN a.t0 AND a.t1 AS is_target FROM pf p JOIN an a
ON p.source = a.source AND p.ID = a.ID AND p.et >= a.t0 - 2.5 AND p.et <= a.t1 + 2.5
QUALIFY row_number() OVER (PARTITION BY p.source, p.ID, p.frame ORDER BY NOT (p.et BETWEEN a.t0 AND a.t1), a.annotation_id) = 1"""
)
def padding_join(spark, d):
    got = ranges.padded_frames(pred_frames(spark, d).select("source", "ID", "frame", "et"), ann(spark, d), 2.5, "annotation_id", ["source", "ID", "frame"])
    return got.select("source", F.col("ID").alias("id"), "frame", "annotation_id", "is_target")


@query(
    f"""WITH {PRED}, {ANN}, q AS (SELECT a.annotation_id, a.source, a.ID, a.t0, p.frame, abs(p.et - a.t0) AS off, p.et FROM an a JOIN pf p ON p.source = a.source AND p.ID = a.ID AND abs(p.et - a.t0) <= 1)
SELECT annotation_id, source, ID AS id, frame FROM q QUALIFY row_number() OVER (PARTITION BY annotation_id, source, ID, t0 ORDER BY off, et, frame DESC) = 1"""
)
def nearest_frame(spark, d):
    events = ann(spark, d).select("annotation_id", "source", "ID", "t0").distinct()
    got = ranges.asof_nearest(events, pred_frames(spark, d).select("source", "ID", "et", "frame"), 1.0, ["annotation_id", "source", "ID", "t0"], ["frame"], left_time="t0", how="inner")
    return got.select("annotation_id", "source", F.col("ID").alias("id"), "frame")


@query(
    f"""WITH {PRED}, {ANN}, e AS (SELECT DISTINCT annotation_id, source, ID, t0 FROM an),
b AS (SELECT e.*, p.frame AS f0, p.et AS e0 FROM e ASOF LEFT JOIN pf p ON e.source = p.source AND e.ID = p.ID AND e.t0 >= p.et),
c AS (SELECT b.*, p.frame AS f1, p.et AS e1 FROM b ASOF LEFT JOIN pf p ON b.source = p.source AND b.ID = p.ID AND b.t0 <= p.et)
SELECT annotation_id, source, ID AS id, CASE WHEN f1 IS NULL OR t0 - e0 <= e1 - t0 THEN f0 ELSE f1 END AS frame FROM c"""
)
def nearest_frame_any(spark, d):
    """The nearest frame however far; annotations of unknown tracks stay, without a frame."""
    events = ann(spark, d).select("annotation_id", "source", "ID", "t0").distinct()
    got = ranges.nearest(events, pred_frames(spark, d).select("source", "ID", "et", "frame"), ["frame"], left_time="t0")
    return got.select("annotation_id", "source", F.col("ID").alias("id"), "frame")


@query("SELECT source, ID AS id, count(*) AS n FROM long_df l WHERE EXISTS (SELECT 1 FROM split_registry r WHERE r.source = l.source AND r.ID = l.ID AND r.split = 'train') GROUP BY ALL")
def semi_train(spark, d):
    train = table(spark, d, "split_registry").where("split = 'train'")
    return table(spark, d, "long_df").join(train, ["source", "ID"], "left_semi").groupBy("source", F.col("ID").alias("id")).agg(F.count("*").alias("n"))


@query(f"WITH {ANN} SELECT DISTINCT source, ID AS id FROM an WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.source = an.source AND p.ID = an.ID)")
def anti_orphans(spark, d):
    return sampling.unknown_tracks(ann(spark, d), table(spark, d, "predictions")).select("source", F.col("ID").alias("id"))


@query(
    """WITH s AS (SELECT source, ID, avg(prob) AS mean_prob FROM predictions WHERE NOT isnan(prob) GROUP BY ALL), a AS (SELECT upper(trim(source)) AS source, ID, count(*) AS intervals FROM annotations GROUP BY ALL)
SELECT coalesce(s.source, a.source) AS source, coalesce(s.ID, a.ID) AS id, round(mean_prob, 6) AS mean_prob, intervals FROM s FULL JOIN a ON s.source IS NOT DISTINCT FROM a.source AND s.ID IS NOT DISTINCT FROM a.ID"""
)
def outer_null_safe(spark, d):
    s = table(spark, d, "predictions").where(is_number(F.col("prob"))).groupBy("source", "ID").agg(F.avg("prob").alias("mean_prob"))
    a = table(spark, d, "annotations").groupBy(F.upper(F.trim("source")).alias("source"), "ID").agg(F.count("*").alias("intervals"))
    got = s.alias("s").join(a.alias("a"), tracks.same("s", "a", ["source", "ID"]), "full")
    return rounded(got.select(F.coalesce("s.source", "a.source").alias("source"), F.coalesce("s.ID", "a.ID").alias("id"), "mean_prob", "intervals"))


@query(f"WITH {PRED} SELECT p.source, p.ID AS id, coalesce(any_value(r.split), 'validation') AS split, count(*) AS frames FROM pf p LEFT JOIN split_registry r ON p.source = r.source AND p.ID = r.ID GROUP BY ALL")
def split_lookup(spark, d):
    registry = table(spark, d, "split_registry").groupBy("source", "ID").agg(F.first("split", True).alias("split"))
    return pred_frames(spark, d).groupBy("source", "ID").agg(F.count("*").alias("frames")).join(registry, ["source", "ID"], "left").select("source", F.col("ID").alias("id"), F.coalesce("split", F.lit("validation")).alias("split"), "frames")


@query(
    f"""WITH {ANN} SELECT a.annotation_id, count(DISTINCT b.annotation_id) AS others FROM an a JOIN an b ON a.source = b.source AND a.ID = b.ID AND a.annotation_id <> b.annotation_id AND a.t0 < b.t1 AND b.t0 < a.t1 GROUP BY ALL"""
)
def overlapping_annotations(spark, d):
    rows = ann(spark, d).select("annotation_id", "source", "ID", "t0", "t1").withColumn("bucket", F.explode(ranges._buckets(F.col("t0"), F.col("t1"), 60.0)))
    meet = tracks.same("a", "b", ["source", "ID", "bucket"]) & (F.col("a.annotation_id") != F.col("b.annotation_id")) & ranges.overlaps(F.col("a.t0"), F.col("a.t1"), F.col("b.t0"), F.col("b.t1"), False)
    return rows.alias("a").join(rows.alias("b"), meet).groupBy("a.annotation_id").agg(F.countDistinct("b.annotation_id").alias("others"))


# --- aggregations


@query(f"WITH {ANN} SELECT source, {', '.join(f"count_if(behavior = '{b}')::BIGINT AS {b}" for b in text.MAIN_BEHAVIORS)} FROM an GROUP BY source")
def pivot_behaviors(spark, d):
    return bouts.pivot_counts(ann(spark, d), ["source"], "behavior", text.MAIN_BEHAVIORS)


@query(
    f"""WITH {ANN}, w AS (SELECT source, {', '.join(f"count_if(behavior = '{b}')::BIGINT AS {b}" for b in text.MAIN_BEHAVIORS)} FROM an GROUP BY source)
SELECT source, {', '.join(f"round({b} * 100.0::DOUBLE / nullif({' + '.join(text.MAIN_BEHAVIORS)}, 0), 6) AS {b}" for b in text.MAIN_BEHAVIORS)} FROM w"""
)
def pivot_share(spark, d):
    return rounded(bouts.pivot_counts(ann(spark, d), ["source"], "behavior", text.MAIN_BEHAVIORS, share=True))


@query(
    f"""WITH {ANN}, t AS (SELECT *, list_distinct(list_filter(list_transform(string_split(coalesce(tags, ''), ';'), lambda v: lower({strip_sql('v')})), lambda v: v <> '')) AS l FROM an)
SELECT source, ID AS id, tag, count(*) AS n FROM (SELECT source, ID, unnest(l) AS tag FROM t) WHERE tag IN (SELECT tag FROM (SELECT unnest(l) AS tag FROM t) GROUP BY tag HAVING count(*) >= 5) GROUP BY ALL"""
)
def tag_matrix(spark, d):
    return sampling.tag_matrix(ann(spark, d)).select("source", F.col("ID").alias("id"), "tag", "n")


@query(
    f"""WITH {ANN}, s AS (
  SELECT 'dwelling' AS tag_set, t1 - t0 AS d FROM an WHERE behavior = 'dwelling' UNION ALL SELECT 'untagged', t1 - t0 FROM an WHERE tags IS NULL UNION ALL SELECT 'turns', t1 - t0 FROM an WHERE coalesce(contains(lower(tags), 'turn'), false))
SELECT tag_set, count(*) AS n, round(min(d), 6) AS shortest, round(median(d), 6) AS median, round(max(d), 6) AS longest FROM s GROUP BY tag_set"""
)
def duration_summary(spark, d):
    sets = {"dwelling": F.col("behavior") == "dwelling", "untagged": F.col("tags").isNull(), "turns": text.tags_contain(F.col("tags"), "turn")}
    return rounded(bouts.duration_summary(ann(spark, d), sets, F.col("t1") - F.col("t0")))


@query(
    f"""WITH {PRED}, g AS (SELECT source, ID AS id, avg(prediction) AS mean, stddev_samp(prediction) AS std, median(prediction) AS median, count(prediction) AS n FROM pf GROUP BY ALL)
SELECT source, id, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6) AS median, n, round(ln(mean + 1e-3), 6) AS log_mean, round(cbrt(mean), 6) AS cbrt_mean FROM g"""
)
def track_summary(spark, d):
    return rounded(bouts.track_summary(pred_frames(spark, d), "prediction").withColumnRenamed("ID", "id"))


@query(
    f"""WITH {PRED}, g AS (SELECT source, ID, avg(prediction) AS mean FROM pf GROUP BY ALL), p AS (SELECT *, CASE WHEN mean > 0 THEN mean END AS pos FROM g)
SELECT source, round(avg(CASE WHEN mean > 0 THEN 1.0::DOUBLE WHEN mean <= 0 THEN 0.0::DOUBLE END) * 100, 6) AS percent_above, round(quantile_cont(pos, 0.25), 6) AS q1, round(quantile_cont(pos, 0.5), 6) AS median, round(quantile_cont(pos, 0.75), 6) AS q3, count(*) AS n FROM p GROUP BY source"""
)
def hurdle(spark, d):
    return rounded(bouts.hurdle(bouts.track_summary(pred_frames(spark, d), "prediction")))


@query(
    f"""WITH {PRED}, g AS (SELECT source, ID, avg(prediction) AS m FROM pf GROUP BY ALL)
SELECT source, round(avg(m), 6) AS mean, round(avg(m) - 1.96 * stddev_samp(m) / sqrt(count(m)), 6) AS low, round(avg(m) + 1.96 * stddev_samp(m) / sqrt(count(m)), 6) AS high, count(m) AS n FROM g GROUP BY source"""
)
def mean_interval(spark, d):
    return rounded(bouts.mean_interval(bouts.track_summary(pred_frames(spark, d), "prediction")))


def _bouts(spark: SparkSession, d: str) -> DataFrame:
    """Bouts of frames that have a prediction, with the track's position there."""
    frames = pred_frames(spark, d).where("prediction IS NOT NULL").select("source", "ID", "frame", "et", "prediction")
    return bouts.bout_table(frames.join(coordinates(spark, d).select("source", "ID", "frame", "x", "y"), ["source", "ID", "frame"], "left"))


BOUTS = f"""{PRED}, {FRAMES}, pp AS (SELECT p.source, p.ID, p.frame, p.et, p.prediction, f.x, f.y FROM pf p LEFT JOIN fr f USING (source, ID, frame) WHERE prediction IS NOT NULL),
po AS (SELECT *, CASE WHEN prediction = lag(prediction) OVER w THEN 0 ELSE 1 END AS o FROM pp WINDOW w AS (PARTITION BY source, ID ORDER BY frame)),
pr AS (SELECT *, sum(o) OVER (PARTITION BY source, ID ORDER BY frame ROWS UNBOUNDED PRECEDING) AS event_id FROM po),
bo AS (SELECT source, ID, event_id, min(frame) AS first, max(frame) AS last, min(et) AS t0, max(et) AS t1, count(*) AS n, arg_min_null(x, frame) AS x0, arg_min_null(y, frame) AS y0 FROM pr WHERE prediction = 1 GROUP BY ALL)"""


@query(f"WITH {BOUTS} SELECT source, ID AS id, CAST(event_id AS BIGINT) AS event_id, first, last, n, round(t1 - t0, 6) AS duration, x0, y0 FROM bo")
def bout_table(spark, d):
    return rounded(_bouts(spark, d).select("source", F.col("ID").alias("id"), "event_id", "first", "last", "n", "duration", "x0", "y0"))


@query(
    f"""WITH {BOUTS}, k AS (SELECT t.source, t.ID, count(b.event_id) AS k FROM (SELECT DISTINCT source, ID FROM pf) t LEFT JOIN bo b USING (source, ID) GROUP BY ALL),
c AS (SELECT source, CASE WHEN k >= 4 THEN '4+' ELSE CAST(k AS VARCHAR) END AS bouts, count(*) AS n FROM k GROUP BY ALL)
SELECT source, bouts, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share FROM c"""
)
def bout_counts(spark, d):
    return rounded(bouts.bout_counts(pred_frames(spark, d), _bouts(spark, d)))


@query(f"WITH {BOUTS}, f AS (SELECT source, ID, min(et) AS begin_ FROM pf GROUP BY ALL) SELECT b.source, b.ID AS id, round(min(t0) - any_value(begin_), 6) AS latency FROM bo b JOIN f USING (source, ID) GROUP BY ALL")
def latency(spark, d):
    return rounded(bouts.latency(pred_frames(spark, d), _bouts(spark, d)).withColumnRenamed("ID", "id"))


@query(
    f"""WITH {BOUTS}, e AS (SELECT source, round(t1 - t0, 4) AS duration FROM bo), c AS (SELECT source, duration, count(*) AS n FROM e GROUP BY ALL)
SELECT source, duration, round(sum(n) OVER (PARTITION BY source ORDER BY duration) / sum(n) OVER (PARTITION BY source), 6) AS share FROM c"""
)
def ecdf(spark, d):
    return rounded(bouts.ecdf(_bouts(spark, d).withColumn("duration", F.round("duration", 4)), "duration", ["source"]))


@query(f"WITH {PRED} SELECT source, CAST(least(floor(prob * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM pf WHERE prob BETWEEN 0 AND 1 GROUP BY ALL")
def histogram(spark, d):
    return bouts.histogram(pred_frames(spark, d), "prob", 0.0, 1.0, 20, ["source"])


@query(
    f"""WITH {FRAMES}, c AS (SELECT source, CAST(least(floor(x / 90.0::DOUBLE * 30), 29) AS INTEGER) AS bx, CAST(least(floor(y / 90.0::DOUBLE * 30), 29) AS INTEGER) AS "by", count(*) AS n FROM fr WHERE x BETWEEN 0 AND 90 AND y BETWEEN 0 AND 90 GROUP BY ALL)
SELECT source, bx, "by", n FROM c QUALIFY sum(n) OVER (PARTITION BY source) > 10"""
)
def histogram_2d(spark, d):
    return bouts.histogram_2d(coordinates(spark, d), "x", "y", 0.0, 90.0, 30, ["source"])


@query(
    f"""WITH {FRAMES}, r AS (SELECT source, x, CAST(least(floor(x / 90.0::DOUBLE * 400), 399) AS INTEGER) AS cell FROM fr WHERE x BETWEEN 0 AND 90),
c AS (SELECT source, cell, count(*) AS n FROM r GROUP BY ALL), s AS (SELECT source, stddev_samp(x) * pow(count(*), -0.2) * 0.7 AS h, count(*) AS total FROM r GROUP BY source),
g AS (SELECT c.source, n, h, total, 0.0::DOUBLE + i * (90.0::DOUBLE / 49) AS point, ((0.0::DOUBLE + i * (90.0::DOUBLE / 49)) - (cell + 0.5::DOUBLE) * (90.0::DOUBLE / 400)) / h AS o FROM c JOIN s USING (source), generate_series(0, 49) t(i) WHERE h > 0)
SELECT source, round(point, 6) AS point, round(sum(n * exp(-o * o / 2) / (h * sqrt(2 * pi()))) / any_value(total), 6) AS density FROM g GROUP BY source, point"""
)
def density(spark, d):
    return rounded(bouts.density(coordinates(spark, d), "x", 0.0, 90.0))


@query(f"WITH {PRED}, {FRAMES} SELECT source, floor(x / 10) * 10 + 5 AS centre, round(avg(prediction), 6) AS mean, count(*) AS n FROM fr JOIN pf USING (source, ID, frame) WHERE x IS NOT NULL GROUP BY ALL")
def spatial_mean(spark, d):
    rows = coordinates(spark, d).select("source", "ID", "frame", "x").join(pred_frames(spark, d).select("source", "ID", "frame", "prediction"), ["source", "ID", "frame"])
    return rounded(bouts.spatial_mean(rows, "x", "prediction"))


@query(
    f"""WITH {PRED}, {FRAMES}, h AS (SELECT p.source, p.ID, p.frame, p.prediction, f.x, atan2(yspine_0 - yspine_10, xspine_0 - xspine_10) AS heading FROM pf p JOIN fr f USING (source, ID, frame) WHERE prediction IS NOT NULL),
o AS (SELECT *, CASE WHEN prediction = lag(prediction) OVER w THEN 0 ELSE 1 END AS o FROM h WINDOW w AS (PARTITION BY source, ID ORDER BY frame)),
r AS (SELECT *, sum(o) OVER (PARTITION BY source, ID ORDER BY frame ROWS UNBOUNDED PRECEDING) AS event_id FROM o),
n AS (SELECT *, lag(heading) OVER w AS before_, lead(heading) OVER w AS after_, row_number() OVER (PARTITION BY source, ID, event_id ORDER BY frame) AS rn, row_number() OVER (PARTITION BY source, ID, event_id ORDER BY frame DESC) AS rd FROM r WINDOW w AS (PARTITION BY source, ID ORDER BY frame)),
b AS (SELECT source, ID, event_id, max(before_) FILTER (rn = 1) AS before_, max(after_) FILTER (rd = 1) AS after_, max(x) FILTER (rn = 1) AS x0 FROM n WHERE prediction = 1 GROUP BY ALL),
m AS (SELECT *, after_ - before_ AS d FROM b WHERE before_ IS NOT NULL AND after_ IS NOT NULL),
t AS (SELECT *, d + pi() - 2 * pi() * floor((d + pi()) / (2 * pi())) - pi() AS turn FROM m)
SELECT source, ID AS id, CAST(event_id AS BIGINT) AS event_id, round(before_, 6) AS before, round(after_, 6) AS after, round(turn, 6) AS turn, round(abs(turn), 6) AS size, round(abs(before_) - abs(after_), 6) AS gain, x0 FROM t"""
)
def turn_dynamics(spark, d):
    heading = F.atan2(F.col("yspine_0") - F.col("yspine_10"), F.col("xspine_0") - F.col("xspine_10"))
    rows = pred_frames(spark, d).where("prediction IS NOT NULL").join(coordinates(spark, d).drop("et"), ["source", "ID", "frame"]).withColumn("heading", heading)
    return rounded(bouts.turn_dynamics(rows, "heading").withColumnRenamed("ID", "id"))


@query(f"WITH {FRAMES}, r AS (SELECT greatest(max(x) - min(x), max(y) - min(y)) AS range_ FROM fr GROUP BY source, ID) SELECT round(quantile_cont(range_, 0.75) * 1.25, 6) AS span FROM r")
def track_range(spark, d):
    return rounded(bouts.track_range(coordinates(spark, d)))


@query(
    f"""WITH {FRAMES}, b AS (SELECT source, ID, sqrt((xspine_10 - xspine_0) * (xspine_10 - xspine_0) + (yspine_10 - yspine_0) * (yspine_10 - yspine_0)) AS chord FROM fr)
SELECT source, ID AS id, round(median(chord), 6) AS chord FROM b WHERE chord IS NOT NULL GROUP BY ALL"""
)
def group_median(spark, d):
    chord = F.sqrt((F.col("xspine_10") - F.col("xspine_0")) * (F.col("xspine_10") - F.col("xspine_0")) + (F.col("yspine_10") - F.col("yspine_0")) * (F.col("yspine_10") - F.col("yspine_0")))
    return rounded(tracks.group_quantiles(coordinates(spark, d).withColumn("chord", chord), ["source", "ID"], ["chord"]).withColumnRenamed("ID", "id"))


@query(f"WITH {FRAMES} SELECT source, round(quantile_cont(x, 0.75), 6) AS x, round(quantile_cont(y, 0.75), 6) AS y FROM fr GROUP BY source")
def source_quantile(spark, d):
    return rounded(tracks.group_quantiles(coordinates(spark, d), ["source"], ["x", "y"], 0.75))


# --- events, runs and states


@query(
    f"""WITH {PRED}, o AS (SELECT *, CASE WHEN behavior IS NOT DISTINCT FROM lag(behavior) OVER w AND tags IS NOT DISTINCT FROM lag(tags) OVER w AND et - lag(et) OVER w <= 0.5 THEN 0 ELSE 1 END AS o FROM pf WINDOW w AS (PARTITION BY source, ID ORDER BY frame)),
e AS (SELECT *, sum(o) OVER (PARTITION BY source, ID ORDER BY frame ROWS UNBOUNDED PRECEDING) AS event_id FROM o)
SELECT source, ID AS id, CAST(event_id AS BIGINT) AS event_id, min(frame) AS first, max(frame) AS last, count(*) AS n, round(max(et) - min(et), 6) AS duration FROM e GROUP BY ALL"""
)
def event_segments(spark, d):
    events = islands.event_ids(pred_frames(spark, d), ["behavior", "tags"])
    got = events.groupBy("source", F.col("ID").alias("id"), "event_id").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n"), (F.max("et") - F.min("et")).alias("duration"))
    return rounded(got)


@query(
    f"""WITH {PRED}, o AS (SELECT *, CASE WHEN et - lag(et) OVER w <= 0.5 THEN 0 ELSE 1 END AS o FROM pf WINDOW w AS (PARTITION BY source, ID ORDER BY frame)),
e AS (SELECT *, sum(o) OVER (PARTITION BY source, ID ORDER BY frame ROWS UNBOUNDED PRECEDING) AS segment FROM o)
SELECT source, ID AS id, CAST(segment AS BIGINT) AS segment, min(frame) AS first, max(frame) AS last, count(*) AS n FROM e GROUP BY ALL"""
)
def gap_split(spark, d):
    events = islands.event_ids(pred_frames(spark, d), [])
    return events.groupBy("source", F.col("ID").alias("id"), F.col("event_id").alias("segment")).agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n"))


_SEGMENTS = f"""{PRED}, o AS (SELECT source, ID, frame, et, coalesce(prediction, 0) AS v, prob, CASE WHEN et - lag(et) OVER w <= 0.5 THEN 0 ELSE 1 END AS o FROM pf WINDOW w AS (PARTITION BY source, ID ORDER BY frame)),
s AS (SELECT *, sum(o) OVER (PARTITION BY source, ID ORDER BY frame ROWS UNBOUNDED PRECEDING) AS segment FROM o)"""


def _runs_sql(source: str, value: str, out: str) -> str:
    return f"""{out}0 AS (SELECT *, CASE WHEN {value} = lag({value}) OVER (PARTITION BY source, ID, segment ORDER BY frame) THEN 0 ELSE 1 END AS ro FROM {source}),
{out}1 AS (SELECT *, sum(ro) OVER (PARTITION BY source, ID, segment ORDER BY frame ROWS UNBOUNDED PRECEDING) AS rid FROM {out}0),
{out} AS (SELECT *, count(*) OVER (PARTITION BY source, ID, segment, rid) AS rn, rid = 1 AS is_first, rid = max(rid) OVER (PARTITION BY source, ID, segment) AS is_last FROM {out}1)"""


@query(
    f"""WITH {_SEGMENTS}, {_runs_sql('s', 'v', 'a')},
c AS (SELECT source, ID, segment, frame, et, CASE WHEN v = 0 AND NOT is_first AND NOT is_last AND rn < 6 THEN 1 ELSE v END AS v FROM a), {_runs_sql('c', 'v', 'b')}
SELECT source, ID AS id, min(frame) AS first, max(frame) AS last, count(*) AS n, round(max(et) - min(et), 6) AS duration FROM b WHERE v = 1 AND rn >= 9 GROUP BY source, ID, segment, rid"""
)
def close_open_bouts(spark, d):
    got = islands.close_and_open(pred_frames(spark, d), "prediction", 6, 9).where("prediction = 1")
    return rounded(got.select("source", F.col("ID").alias("id"), "first", "last", "n", (F.col("t1") - F.col("t0")).alias("duration")))


@query(
    f"""WITH {_SEGMENTS}, h AS (SELECT *, CASE WHEN prob >= 0.6 THEN 1 WHEN prob <= 0.4 THEN 0 END AS st FROM s),
k AS (SELECT source, ID, segment, frame, coalesce(last_value(st IGNORE NULLS) OVER (PARTITION BY source, ID, segment ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS v FROM h)
SELECT source, ID AS id, count(*) AS n, sum(v)::BIGINT AS on_frames FROM k GROUP BY ALL"""
)
def hysteresis(spark, d):
    cut = islands.event_ids(pred_frames(spark, d), []).withColumnRenamed("event_id", "segment")
    got = islands.hysteresis(cut, "prob", 0.6, 0.4, keys=["source", "ID", "segment"])
    return got.groupBy("source", F.col("ID").alias("id")).agg(F.count("*").alias("n"), F.sum("state").alias("on_frames"))


@query(f"WITH {PRED}, l AS (SELECT *, lag(prediction) OVER (PARTITION BY source, ID ORDER BY frame) AS before_ FROM pf WHERE prediction IS NOT NULL) SELECT source, ID AS id, frame FROM l WHERE prediction = 1 AND before_ = 0")
def initiations(spark, d):
    return islands.initiations(pred_frames(spark, d).where("prediction IS NOT NULL"), "prediction").select("source", F.col("ID").alias("id"), "frame")


@query(
    f"""WITH {FRAMES} SELECT source, ID AS id, frame,
  coalesce(x, last_value(x IGNORE NULLS) OVER p, first_value(x IGNORE NULLS) OVER n, 0) AS x, coalesce(xspine_0, last_value(xspine_0 IGNORE NULLS) OVER p, first_value(xspine_0 IGNORE NULLS) OVER n, 0) AS head
FROM fr WINDOW p AS (PARTITION BY source, ID ORDER BY frame ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY source, ID ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
)
def fill_forward_back(spark, d):
    rows = coordinates(spark, d).select("source", "ID", "frame", "x", F.col("xspine_0").alias("head"))
    return islands.filled(rows, ["x", "head"]).withColumnRenamed("ID", "id")


@query(
    f"""WITH a AS (SELECT DISTINCT {_TRIM} AS source, AN, ID, annotation_id FROM annotations WHERE ID IS NOT NULL AND AN IS NOT NULL),
g AS (SELECT source, ID, min(AN) AS AN FROM a GROUP BY ALL), o AS (SELECT *, CASE WHEN AN < lag(AN) OVER w OR lag(AN) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM g WINDOW w AS (PARTITION BY source ORDER BY ID))
SELECT source, ID AS id, AN AS an, CAST(sum(o) OVER (PARTITION BY source ORDER BY ID ROWS UNBOUNDED PRECEDING) AS BIGINT) AS iteration FROM o"""
)
def iterations(spark, d):
    rows = table(spark, d, "annotations").where("ID IS NOT NULL AND AN IS NOT NULL").groupBy(periods.clean_source(F.col("source")).alias("source"), "ID").agg(F.min("AN").alias("AN"))
    return islands.iterations(rows, "AN").select("source", F.col("ID").alias("id"), F.col("AN").alias("an"), "iteration")


@query(
    f"""WITH {ANN}, n AS (SELECT DISTINCT source, ID, t0, t1 FROM an), r AS (SELECT *, max(t1) OVER (PARTITION BY source, ID ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM n)
SELECT source, ID AS id, round(reach, 6) AS gap_start, round(t0, 6) AS gap_end FROM r WHERE t0 - reach > 1.1::DOUBLE / 6"""
)
def unlabelled_gaps(spark, d):
    merged = periods.periods_and_gaps(ann(spark, d)).where("kind = 'gap'")
    return merged.select("source", "id", (F.col("start_ms") / 1000).alias("gap_start"), (F.col("end_ms") / 1000).alias("gap_end")).transform(rounded)


# --- metrics


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return pred_frames(spark, d).withColumn("truth", text.truth_label(F.col("behavior"), F.col("tags")))


JUDGED = f"{PRED}, ju AS (SELECT *, CASE WHEN behavior = 'dwelling' THEN 1 WHEN behavior = 'nondwelling' THEN 0 END AS truth FROM pf)"


@query(
    f"""WITH {JUDGED}, c AS (SELECT source, count_if(truth = 1 AND prediction = 1)::DOUBLE AS tp, count_if(truth = 0 AND prediction = 1)::DOUBLE AS fp, count_if(truth = 1 AND prediction = 0)::DOUBLE AS fn, count_if(truth = 0 AND prediction = 0)::DOUBLE AS tn
  FROM ju WHERE truth IS NOT NULL AND prediction IS NOT NULL GROUP BY source)
SELECT source, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / nullif(tp + fn, 0), 6) AS tpr, round(tp / nullif(tp + fp, 0), 6) AS ppv,
  round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy FROM c"""
)
def frame_metrics(spark, d):
    got = metrics.derived(metrics.confusion(_judged(spark, d), by=["source"]))
    return rounded(got.select("source", "tp", "fp", "fn", "tn", "accuracy", "tpr", "ppv", "f1", "mcc", "balanced_accuracy"))


@query(
    f"""WITH {JUDGED}, r AS (SELECT truth, prob, least(floor(prob * 10), 9) AS bin FROM ju WHERE truth IS NOT NULL AND prob IS NOT NULL), b AS (SELECT bin, count(*) AS n, abs(avg(prob) - avg(truth)) AS off FROM r GROUP BY bin)
SELECT (SELECT round(avg((truth - prob) * (truth - prob)), 6) FROM r) AS brier, (SELECT round(sum(off * n) / sum(n), 6) FROM b) AS ece"""
)
def probability_scores(spark, d):
    return rounded(metrics.probability_scores(_judged(spark, d)))


_RANKED = f"""{JUDGED}, e AS (SELECT prob, count_if(truth = 1)::BIGINT AS pos, count_if(truth = 0)::BIGINT AS neg FROM ju WHERE truth IS NOT NULL AND prob IS NOT NULL GROUP BY prob),
k AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM e WINDOW w AS (ORDER BY prob DESC))"""


@query(f"WITH {_RANKED} SELECT round(sum(pos * (n - fp) + pos * neg / 2.0::DOUBLE) / (max(p) * max(n)), 6) AS auroc, round(sum(pos * tp / (tp + fp)::DOUBLE) / max(p), 6) AS average_precision FROM k")
def ranked_metrics(spark, d):
    return rounded(metrics.ranked_metrics(_judged(spark, d)))


@query(
    f"""WITH {_RANKED} SELECT prob, round(tp / p, 6) AS tpr, round(fp / n, 6) AS fpr, round(1 - tp / p, 6) AS fnr, round(tp / (tp + fp), 6) AS precision, round((tp + fp) / (p + n), 6) AS shown, round((tp / p) / ((tp + fp) / (p + n)), 6) AS lift FROM k"""
)
def curve_points(spark, d):
    return rounded(metrics.curves(_judged(spark, d)))


@query(f"WITH {_RANKED} SELECT prob AS threshold, round(tp / p - fp / n, 6) AS informedness FROM k ORDER BY tp / p - fp / n DESC, prob DESC LIMIT 1")
def best_threshold(spark, d):
    return rounded(metrics.best_threshold(_judged(spark, d)))


_BOTH = f"""{JUDGED}, sg0 AS (SELECT source, ID, frame, et, truth, coalesce(prediction, 0) AS pred, CASE WHEN et - lag(et) OVER w <= 0.5 THEN 0 ELSE 1 END AS o FROM ju WINDOW w AS (PARTITION BY source, ID ORDER BY frame)),
sg AS (SELECT *, sum(o) OVER (PARTITION BY source, ID ORDER BY frame ROWS UNBOUNDED PRECEDING) AS segment FROM sg0), {_runs_sql('sg', 'truth', 'tr')},
tn AS (SELECT source, ID, frame, et, truth, pred, segment, rid AS t_run, rn AS t_n, row_number() OVER (PARTITION BY source, ID, segment, rid ORDER BY frame) AS t_at FROM tr)"""
_EVENTS = f"""{_BOTH}, ev AS (SELECT source, ID, min(et) AS t0, max(et) AS t1, avg(pred) AS share FROM tn WHERE truth = 1 GROUP BY source, ID, segment, t_run),
lo AS (SELECT source, ID, frame, et, segment, CASE WHEN pred = 1 AND max(CASE WHEN truth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source, ID, segment ORDER BY frame ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) = 0
  AND NOT coalesce(truth = 0 AND (t_at <= 9 OR t_n - t_at < 9), false) THEN 1 ELSE 0 END AS loose FROM tn), {_runs_sql('lo', 'loose', 'lr')},
ec AS (SELECT source, ID, t0, t1, share, CASE WHEN share > 0.5 THEN 'tp' ELSE 'fn' END AS kind FROM ev
  UNION ALL SELECT source, ID, min(et), max(et), 1.0::DOUBLE, 'fp' FROM lr WHERE loose = 1 GROUP BY source, ID, segment, rid)"""
_SCORES = "sum(kind = 'tp')::BIGINT AS tp, sum(kind = 'fp')::BIGINT AS fp, sum(kind = 'fn')::BIGINT AS fn"


@query(f"WITH {_EVENTS} SELECT source, ID AS id, round(t0, 6) AS t0, round(t1, 6) AS t1, round(share, 6) AS share, kind FROM ec")
def event_confusion(spark, d):
    return rounded(metrics.event_confusion(_judged(spark, d)).withColumnRenamed("ID", "id"))


@query(f"WITH {_EVENTS} SELECT source, ID AS id, round(t0, 6) AS t0, round(t1, 6) AS t1, kind, EXISTS (SELECT 1 FROM split_registry r WHERE r.source = ec.source AND r.ID = ec.ID AND r.split = 'validation') AS is_unseen FROM ec WHERE kind <> 'tp'")
def event_list(spark, d):
    """False events, those of validation tracks marked."""
    unseen = table(spark, d, "split_registry").where("split = 'validation'")
    return rounded(metrics.event_list(metrics.event_confusion(_judged(spark, d)), unseen).drop("share").withColumnRenamed("ID", "id"))


# --- samples and splits


@query(
    f"""WITH {ANN}, r AS (SELECT annotation_id, behavior, t1 - t0 AS size, md5('42|' || annotation_id) AS k FROM an), o AS (SELECT *, coalesce(sum(round(size, 3)) OVER (PARTITION BY behavior ORDER BY k, annotation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM r)
SELECT annotation_id, behavior FROM o WHERE behavior IN ('dwelling', 'nondwelling', 'crawling') AND round(before_, 3) < 300"""
)
def ratio_sample(spark, d):
    events = ann(spark, d).where(F.col("behavior").isin("dwelling", "nondwelling", "crawling")).select("annotation_id", "behavior", F.round(F.col("t1") - F.col("t0"), 3).cast("decimal(18,3)").alias("size"))
    return sampling.ratio_sample(events, "behavior", "size", 300, ["annotation_id"]).select("annotation_id", "behavior")


@query(
    """WITH t AS (SELECT DISTINCT source, ID FROM split_registry), k AS (SELECT *, md5('42|' || source || '|' || CAST(ID AS VARCHAR)) AS k FROM t)
SELECT source, ID AS id, CAST((row_number() OVER (ORDER BY k, source, ID) - 1) % 5 AS INTEGER) AS fold FROM k"""
)
def group_folds(spark, d):
    return sampling.folds(table(spark, d, "split_registry"), 5).withColumnRenamed("ID", "id")


@query(
    """WITH n AS (SELECT source, ID, count(*) AS n FROM predictions GROUP BY ALL), w AS (SELECT *, 5 / greatest(sqrt(n), 1e-9) AS w, CAST(('0x' || substr(md5('42|' || source || '|' || CAST(ID AS VARCHAR)), 1, 12)) AS BIGINT) / pow(16::DOUBLE, 12) AS share FROM n)
SELECT source, ID AS id, n FROM w QUALIFY row_number() OVER (PARTITION BY source ORDER BY -ln(greatest(share, 1e-15)) / greatest(w, 1e-9), ID) = 1"""
)
def weighted_pick(spark, d):
    rows = table(spark, d, "predictions").groupBy("source", "ID").agg(F.count("*").alias("n"))
    got = sampling.weighted_pick(rows, 5 / F.greatest(F.sqrt("n"), F.lit(1e-9)), ["source", "ID"], ["source"])
    return got.select("source", F.col("ID").alias("id"), "n")


@query()
def split_search(spark, d):
    matrix = sampling.tag_matrix(ann(spark, d))
    return sampling.search_split(matrix, table(spark, d, "split_registry").where("split = 'test'")).withColumnRenamed("ID", "id")


@query(f"WITH {PRED}, c AS (SELECT source, ID, tags, count(*) AS n FROM pf WHERE tags IS NOT NULL GROUP BY ALL) SELECT source, ID AS id, tags, n FROM c QUALIFY row_number() OVER (PARTITION BY source, ID ORDER BY n DESC, tags) = 1")
def label_mode(spark, d):
    return bouts.most_frequent(pred_frames(spark, d), "tags").select("source", F.col("ID").alias("id"), "tags", "n")


@query(
    f"""WITH {BOUTS}, w AS (SELECT *, lag(t1) OVER w AS p, lead(t0) OVER w AS q FROM bo WINDOW w AS (PARTITION BY source, ID ORDER BY t0, t1))
SELECT source, ID AS id, CAST(event_id AS BIGINT) AS event_id, round(greatest(t0 - 35, p), 6) AS w0, round(least(t1 + 35, q), 6) AS w1 FROM w"""
)
def event_windows(spark, d):
    return rounded(bouts.event_windows(_bouts(spark, d)).select("source", F.col("ID").alias("id"), "event_id", "w0", "w1"))


@query(
    f"""WITH {ANN}, r AS (SELECT annotation_id, behavior, t1 - t0 AS size, md5('42|' || annotation_id) AS k FROM an WHERE behavior IN ('dwelling', 'nondwelling', 'crawling')),
o AS (SELECT *, coalesce(sum(round(size, 3)) OVER (PARTITION BY behavior ORDER BY k, annotation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM r)
SELECT behavior, count(*) AS raw, count_if(round(before_, 3) < 300)::BIGINT AS fed, round(count_if(round(before_, 3) < 300) / count(*), 6) AS share FROM o GROUP BY behavior"""
)
def retention(spark, d):
    raw = ann(spark, d).where(F.col("behavior").isin("dwelling", "nondwelling", "crawling"))
    return rounded(bouts.retention(raw, ratio_sample(spark, d), ["behavior"]))


@query(
    f"""WITH {_BOTH}, {_runs_sql('tn', 'pred', 'pr_')},
ev AS (SELECT source, ID, segment, t_run, min(et) AS t0, max(et) AS t1, avg(pred) AS share FROM pr_ WHERE truth = 1 GROUP BY source, ID, segment, t_run),
fo AS (SELECT DISTINCT p.source, p.ID, p.segment, p.rid FROM pr_ p JOIN ev e ON e.source = p.source AND e.ID = p.ID AND e.segment = p.segment AND e.t_run = p.t_run WHERE p.truth = 1 AND p.pred = 1 AND e.share >= 0.3),
pp_ AS (SELECT source, ID, segment, rid, min(et) AS t0, max(et) AS t1 FROM pr_ WHERE pred = 1 GROUP BY ALL)
SELECT source, ID AS id, round(t0, 6) AS t0, round(t1, 6) AS t1, round(share, 6) AS share, CASE WHEN share >= 0.3 THEN 'tp' ELSE 'fn' END AS kind FROM ev
UNION ALL SELECT source, ID, round(t0, 6), round(t1, 6), 1.0::DOUBLE, 'fp' FROM pp_ ANTI JOIN fo USING (source, ID, segment, rid)"""
)
def contributing_events(spark, d):
    return rounded(metrics.contributing_events(_judged(spark, d)).withColumnRenamed("ID", "id"))


@query(
    f"""WITH {_EVENTS}, s AS (SELECT source, {_SCORES} FROM ec GROUP BY source)
SELECT source, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM s"""
)
def event_scores(spark, d):
    return rounded(metrics.event_scores(metrics.event_confusion(_judged(spark, d)), ["source"]))


@query(
    f"""WITH {PRED}, ix AS (SELECT source, ID, frame, et, coalesce(prob, 0) AS prob, row_number() OVER (PARTITION BY source, ID ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY source, ID) AS n FROM pf),
pl AS (SELECT source, ID, frame, et, ((i + k) % (2 * n) + 2 * n) % (2 * n) AS m, n FROM ix, (SELECT unnest(range(-4, 5)) AS k)),
md AS (SELECT pl.source, pl.ID, pl.frame, pl.et, median(q.prob) AS prob FROM pl JOIN ix q ON q.source = pl.source AND q.ID = pl.ID AND q.i = CASE WHEN m >= pl.n THEN 2 * pl.n - 1 - m ELSE m END GROUP BY ALL),
o AS (SELECT *, CASE WHEN et - lag(et) OVER (PARTITION BY source, ID ORDER BY frame) <= 0.5 THEN 0 ELSE 1 END AS o FROM md),
s0 AS (SELECT *, sum(o) OVER (PARTITION BY source, ID ORDER BY frame ROWS UNBOUNDED PRECEDING) AS segment FROM o),
s AS (SELECT source, ID, frame, et, segment, coalesce(last_value(CASE WHEN prob >= 0.6 THEN 1 WHEN prob <= 0.4 THEN 0 END IGNORE NULLS) OVER (PARTITION BY source, ID, segment ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS v FROM s0), {_runs_sql('s', 'v', 'a')},
c AS (SELECT source, ID, segment, frame, et, CASE WHEN v = 0 AND NOT is_first AND NOT is_last AND rn < 6 THEN 1 ELSE v END AS v FROM a), {_runs_sql('c', 'v', 'b')}
SELECT source, ID AS id, min(frame) AS first, max(frame) AS last, round(min(et), 6) AS t0, round(max(et), 6) AS t1, count(*) AS n FROM b WHERE v = 1 AND rn >= 9 GROUP BY source, ID, segment, rid"""
)
def postprocess_bouts(spark, d):
    return rounded(postprocess.PostProcess(1.5, 0.6, 0.4, 1.0, 1.5).bouts(pred_frames(spark, d)).withColumnRenamed("ID", "id"))


@query()
def postprocess_search(spark, d):
    """Twenty settings drawn from the space, judged over frames with a truth."""
    return rounded(postprocess.search(_judged(spark, d).drop("behavior", "tags"), postprocess.drawn()))


_TAGS = f"unnest(list_transform(string_split(coalesce(tags, 'None'), ';'), lambda v: CASE WHEN {strip_sql('v')} = '' THEN 'None' ELSE {strip_sql('v')} END))"


@query(
    f"""WITH {JUDGED}, t AS (SELECT truth, {_TAGS} AS tag, prediction FROM ju WHERE truth IS NOT NULL AND prediction IS NOT NULL),
c AS (SELECT truth, tag, count_if(prediction = 0)::BIGINT AS negative, count_if(prediction = 1)::BIGINT AS positive FROM t GROUP BY ALL)
SELECT truth, tag, negative, positive, round(100.0::DOUBLE * negative / (negative + positive), 6) AS negative_pct, round(100.0::DOUBLE * positive / (negative + positive), 6) AS positive_pct FROM c"""
)
def tagged_confusion(spark, d):
    return rounded(metrics.tagged_confusion(_judged(spark, d)))


@query(
    f"""WITH {ANN}, m AS (SELECT CASE WHEN behavior IN ({', '.join(repr(b) for b in text.MAIN_BEHAVIORS)}) THEN behavior ELSE 'other' END AS behavior,
  list_filter(list_transform(string_split(coalesce(tags, ''), ';'), lambda v: {strip_sql('v')}), lambda v: v <> '') AS tg FROM an),
t AS (SELECT behavior, unnest(CASE WHEN len(tg) > 0 THEN tg ELSE ['(no tag)'] END) AS tag FROM m)
SELECT behavior, tag, count(*) AS n FROM t GROUP BY ALL"""
)
def tag_tallies(spark, d):
    return bouts.tag_tallies(ann(spark, d))


@query(f"WITH {JUDGED} SELECT source, round(avg(-CASE WHEN truth = 1 THEN ln(greatest(least(prob, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE)) ELSE ln(1 - greatest(least(prob, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE)) END), 6) AS log_loss FROM ju WHERE truth IS NOT NULL AND prob IS NOT NULL GROUP BY source")
def log_loss(spark, d):
    return rounded(metrics.log_loss(_judged(spark, d), by=["source"]))


@query(
    f"""WITH {JUDGED}, s AS (SELECT source, count_if(truth = 1 AND prediction = 1) AS tp, count_if(truth = 0 AND prediction = 1) AS fp, count_if(truth = 1 AND prediction = 0) AS fn, count(*) AS n FROM ju WHERE truth IS NOT NULL AND prediction IS NOT NULL GROUP BY source),
r AS (SELECT 2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM s)
SELECT 'f1' AS score, count(f1) AS runs, round(median(f1), 6) AS median, round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS std, round(min(f1), 6) AS least, round(max(f1), 6) AS most FROM r"""
)
def score_summary(spark, d):
    """F1 over sources: one run each."""
    return rounded(metrics.summary(metrics.derived(metrics.confusion(_judged(spark, d), by=["source"])), ["f1"]))


@query(
    f"""WITH {JUDGED}, e AS (SELECT source, prob, count_if(truth = 1)::BIGINT AS pos, count_if(truth = 0)::BIGINT AS neg FROM ju WHERE truth IS NOT NULL AND prob IS NOT NULL GROUP BY ALL),
k AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY source) AS p, sum(neg) OVER (PARTITION BY source) AS n FROM e WINDOW w AS (PARTITION BY source ORDER BY prob DESC)),
u AS (SELECT * FROM k WHERE p > 0 AND n > 0), g AS (SELECT unnest(range(0, 200)) AS point),
i AS (SELECT source, point, CASE WHEN point = 199 THEN 1.0::DOUBLE ELSE (tp - pos + (point / 199.0::DOUBLE * n - (fp - neg)) / neg * pos) / p END AS tpr
  FROM u, g WHERE (neg > 0 AND point >= ceil((fp - neg) / n * 199) AND point <= ceil(fp / n * 199) - 1 AND point < 199) OR (point = 199 AND fp = n AND tp = p AND NOT EXISTS (SELECT 1 FROM u v WHERE v.source = u.source AND v.prob < u.prob)))
SELECT point, round(point / 199.0::DOUBLE, 6) AS fpr, round(avg(tpr), 6) AS mean_tpr, round(stddev_pop(tpr), 6) AS std_tpr, count(*) AS folds FROM i GROUP BY point"""
)
def mean_roc(spark, d):
    """ROC curves of the sources on one grid."""
    return rounded(metrics.mean_roc(_judged(spark, d), "source"))


_HELD = _EVENTS.replace("AS truth FROM pf)", "AS truth FROM pf WHERE NOT EXISTS (SELECT 1 FROM split_registry r WHERE r.source = pf.source AND r.ID = pf.ID AND r.split = 'train') AND behavior IN ('dwelling', 'nondwelling'))")


@query(
    f"""WITH {_HELD}, c AS (SELECT count_if(truth = 1 AND prediction = 1) AS tp, count_if(truth = 0 AND prediction = 1) AS fp, count_if(truth = 1 AND prediction = 0) AS fn, count_if(truth = 0 AND prediction = 0) AS tn FROM ju),
v AS (SELECT count_if(kind = 'tp') AS tp, count_if(kind = 'fp') AS fp, count_if(kind = 'fn') AS fn FROM ec),
e AS (SELECT prob, count_if(truth = 1)::BIGINT AS pos, count_if(truth = 0)::BIGINT AS neg FROM ju WHERE prob IS NOT NULL GROUP BY prob),
k AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM e WINDOW w AS (ORDER BY prob DESC)),
b AS (SELECT least(floor(prob * 10), 9) AS bin, count(*) AS n, abs(avg(prob) - avg(truth)) AS off FROM ju WHERE prob IS NOT NULL GROUP BY 1),
m AS (
SELECT 'tp' AS metric, tp::DOUBLE AS value FROM c UNION ALL SELECT 'fp', fp FROM c UNION ALL SELECT 'fn', fn FROM c UNION ALL SELECT 'tn', tn FROM c
UNION ALL SELECT 'f1', 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE FROM c UNION ALL SELECT 'accuracy', (tp + tn) / (tp + fp + fn + tn)::DOUBLE FROM c
UNION ALL SELECT 'balanced_accuracy', (tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2 FROM c
UNION ALL SELECT 'mcc', (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) FROM c
UNION ALL SELECT 'event_tp', tp FROM v UNION ALL SELECT 'event_fp', fp FROM v UNION ALL SELECT 'event_fn', fn FROM v UNION ALL SELECT 'event_f1', 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE FROM v
UNION ALL SELECT 'auroc', sum(pos * (n - fp) + pos * neg / 2.0::DOUBLE) / (max(p) * max(n)) FROM k UNION ALL SELECT 'average_precision', sum(pos * tp / (tp + fp)::DOUBLE) / max(p) FROM k
UNION ALL SELECT 'brier', avg((truth - prob) * (truth - prob)) FROM ju WHERE prob IS NOT NULL UNION ALL SELECT 'ece', sum(off * n) / sum(n) FROM b
UNION ALL SELECT 'log_loss', avg(-CASE WHEN truth = 1 THEN ln(greatest(least(prob, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE)) ELSE ln(1 - greatest(least(prob, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE)) END) FROM ju WHERE prob IS NOT NULL)
SELECT metric, round(value, 6) AS value FROM m"""
)
def assessment(spark, d):
    """The scores of frames outside the train split that have a truth."""
    train = table(spark, d, "split_registry").where("split = 'train'").select("source", "ID")
    held = _judged(spark, d).where("truth IS NOT NULL").alias("j").join(train.distinct().alias("t"), tracks.same("j", "t", ["source", "ID"]), "left_anti")
    shown = ["tp", "fp", "fn", "tn", "f1", "accuracy", "balanced_accuracy", "mcc", "event_tp", "event_fp", "event_fn", "event_f1", "auroc", "average_precision", "brier", "ece", "log_loss"]
    return rounded(metrics.assess(held, train).where(F.col("metric").isin(*shown)))
