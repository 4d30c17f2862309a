"""Readers and writers of files around the tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.operators.forest import Forest
from trackloom.operators.labels import rename_aliases, union_annotations
from trackloom.operators.tracks import COORDS, TRACK

#: another spelling of the spine columns in older files
SPINE_ALIASES = {f"{a}spine_{i}": f"spine{a}_{i}" for a in "xy" for i in range(11)}
ANNOTATION_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("source", "AN", "ID", "t0", "t1", "Behavior", "tags", "notes", "annotator")])


def read_trajectories(spark: SparkSession, path: str, sources: Iterable[str] | None = None, extra: Sequence[str] = (), coords: Sequence[str] = COORDS) -> DataFrame:
    """Frames with the wanted columns only; filter and columns reach the scan. IDs that are no numbers become null."""
    df = spark.read.parquet(path)
    for name, alias in SPINE_ALIASES.items():
        if name not in df.columns and alias in df.columns:
            df = df.withColumnRenamed(alias, name)
    if sources is not None:
        df = df.where(F.col("source").isin(*sources))
    rest = [c for c in ["et", *coords, *extra] if c in df.columns]
    return df.select("source", F.col("ID").cast("string").try_cast("long").alias("ID"), *rest)


def read_annotation_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Annotation files, aliases resolved, later files after earlier ones in ``file_order``; all values as written."""
    return union_annotations([rename_aliases(spark.read.option("header", True).csv(p)) for p in paths])


def write_probabilities(df: DataFrame, path: str, append: bool = True) -> None:
    """One distributed write, partitioned by source."""
    df.write.mode("append" if append else "overwrite").partitionBy("source").parquet(path)


def write_split(df: DataFrame, path: str) -> None:
    """Train and test lists of tracks as CSV, a folder each."""
    df.select(*TRACK, "split").where(F.col("split").isNotNull()).repartition("split").write.mode("overwrite").partitionBy("split").option("header", True).csv(path)


def write_predictions(df: DataFrame, folder: str, config: str) -> str:
    """The predictions of one configuration, partitioned by source; the folder is named after it. Returns the path."""
    path = f"{folder}/{config}_predictions"
    df.write.mode("overwrite").partitionBy("source").parquet(path)
    return path


def read_predictions(spark: SparkSession, folder: str, config: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{config}_predictions")


def write_model(model: Forest, fitted: DataFrame, folder: str, label: str = "label") -> None:
    """A model beside the keys and labels of the rows it was fitted on."""
    model.save(fitted.sparkSession, f"{folder}/model")
    fitted.select(*TRACK, "frame", F.col(label).alias("true_behavior")).write.mode("overwrite").parquet(f"{folder}/metadata")


def read_model(spark: SparkSession, folder: str) -> tuple[Forest, DataFrame]:
    return Forest.load(spark, f"{folder}/model"), spark.read.parquet(f"{folder}/metadata")


def write_ranking(ranking: DataFrame, path: str) -> None:
    """A ranking of features as one CSV file; it has a row per feature."""
    ranking.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_trials(spark: SparkSession, path: str, study: str, trials: Sequence[dict]) -> None:
    """Trials of a search at the end of a store: ``study, number, setting`` (JSON) ``, score``; a search can be resumed."""
    done = read_trials(spark, path, study)
    first = 0 if done is None else done.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
    rows = [(study, first + i, json.dumps({k: v for k, v in t.items() if k != "score"}, sort_keys=True, default=str), float(t["score"])) for i, t in enumerate(trials)]
    spark.createDataFrame(rows, "study string, number int, setting string, score double").write.mode("append").parquet(path)


def read_trials(spark: SparkSession, path: str, study: str) -> DataFrame | None:
    """The trials of a study, or None where nothing has been stored yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(path).where(F.col("study") == study)


def append_log(spark: SparkSession, path: str, action: str, payload: dict, result: str, message: str = "") -> None:
    """A row of the audit log: ``log_id, timestamp_iso, action, payload_json, result, message``."""
    row = (uuid.uuid4().hex[:13], datetime.now(timezone.utc).isoformat(), action, json.dumps(payload, sort_keys=True, default=str), result, message)
    spark.createDataFrame([row], "log_id string, timestamp_iso string, action string, payload_json string, result string, message string").write.mode("append").parquet(path)
