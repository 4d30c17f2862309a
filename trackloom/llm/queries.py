"""Queries over event sequences and text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.text import BEHAVIORS
from trackloom.llm import canonical, encoding, mixing, personal, runs
from trackloom.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(table(spark, d, "predictions")).select("source", F.col("ID").alias("id"), "first_frame", "last_frame", "n_frames")


def p2_bouts(spark: SparkSession, d: str) -> DataFrame:
    found = runs.collapse_runs(table(spark, d, "predictions"))
    return found.select("source", F.col("ID").alias("id"), F.col("value").cast("int").alias("prediction"), "first_frame", "last_frame", "n_frames", F.round("duration_s", 6).alias("duration_s"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_values(table(spark, d, "annotations"), table(spark, d, "behavior_ref"), synonyms=BEHAVIORS)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document comes back from its ids."""
    documents = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("written"))
    back = encoding.decode_ids(encoding.encode(table(spark, d, "documents")))
    return documents.join(back, "doc_id").select("doc_id", (F.col("written") == F.col("text")).alias("same"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(mixing.sized_documents(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sized, targets = mixing.sized_documents(table(spark, d, "documents")), table(spark, d, "mix_targets")
    return mixing.shares(sized, mixing.mix(sized, targets), targets)


def p9_filled(spark: SparkSession, d: str) -> DataFrame:
    """Twice the size that meets every share: small sources at their caps, the others fill up."""
    sized, targets = mixing.sized_documents(table(spark, d, "documents")), table(spark, d, "mix_targets")
    planned = mixing.plan(sized, targets)
    size = int(2 * sum(s["rate"] * s["tokens"] for s in planned))
    return mixing.shares(sized, mixing.mix(sized, targets, size, short="fill"), targets, size)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.find(table(spark, d, "documents"))


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    return personal.sanitise(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_bouts, p3_found, p8_ids, p8_round_trip, p9_mix, p9_shares, p9_filled, p10_found, p10_clean)}

_BOUTS = """
WITH frames AS (
  SELECT source, ID, CAST(round_even(et * 6, 0) AS BIGINT) AS frame, max(prediction) AS value FROM predictions
  WHERE et IS NOT NULL AND NOT isnan(et) AND prediction IS NOT NULL GROUP BY ALL),
marked AS (
  SELECT *, CASE WHEN frame - lag(frame) OVER w <= 3 AND value = lag(value) OVER w THEN 0 ELSE 1 END AS opens FROM frames WINDOW w AS (PARTITION BY source, ID ORDER BY frame)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY source, ID ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM marked),
bouts AS (
  SELECT source, ID AS id, any_value(value) AS prediction, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n_frames
  FROM numbered GROUP BY source, ID, run HAVING count(*) >= 2)
"""

SQL: dict[str, str] = {
    "p2_found": _BOUTS + "SELECT source, id, first_frame, last_frame, n_frames FROM bouts",
    "p2_bouts": _BOUTS + "SELECT source, id, prediction, first_frame, last_frame, n_frames, round((last_frame - first_frame) / 6.0::DOUBLE, 6) AS duration_s FROM bouts",
}
