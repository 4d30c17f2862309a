"""Versioned feature store: Parquet fragments beside a manifest.

Each batch of columns is a dataset of its own, partitioned by source and keyed by track and frame. New and outdated
columns are added as further batches; the manifest knows which batch holds the current version of a column.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import time
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.features import REGISTRY, Registry, column_name, compute_columns, parse_column
from trackloom.operators.frames import FPS
from trackloom.operators.tracks import TRACK, same

KEY = [*TRACK, "frame"]


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file of any file system that Spark knows; None if it isn't there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


@dataclass
class FeatureSetConfig:
    """A named set of feature columns."""

    name: str = "features"
    base_features: list[str] = field(default_factory=list)
    windowed_features: dict[str, list[int]] = field(default_factory=dict)
    description: str = ""

    def columns(self) -> list[str]:
        return [*self.base_features, *[column_name(f, w) for f, windows in self.windowed_features.items() for w in windows]]

    def get_id(self) -> str:
        """The name with 12 signs that stand for the columns."""
        return f"{self.name}-{hashlib.md5(';'.join(sorted(self.columns())).encode()).hexdigest()[:12]}"

    def windows_of(self, feature: str) -> list[int]:
        return sorted(self.windowed_features.get(feature, []))

    @classmethod
    def from_columns(cls, columns: Iterable[str], name: str = "features") -> FeatureSetConfig:
        """A set from plain column names."""
        out = cls(name)
        for c in columns:
            f, w = parse_column(c)
            if w is None:
                out.base_features.append(f)
            else:
                out.windowed_features.setdefault(f, []).append(w)
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        write_text(spark, path, json.dumps(asdict(self), indent=1))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureSetConfig:
        text = read_text(spark, path)
        if text is None:
            raise FileNotFoundError(path)
        return cls(**json.loads(text))


class FeatureStore:
    """Features of frames under one folder."""

    def __init__(self, spark: SparkSession, root: str, fps: float = FPS, registry: Registry = REGISTRY):
        self.spark, self.root, self.fps, self.registry = spark, root.rstrip("/"), fps, registry

    def logic_hash(self) -> str:
        """Twelve signs that stand for the code of the features."""
        code = "".join(inspect.getsource(f.build) for f in self.registry.features.values() if f.build and f.build.__code__.co_filename != "<stdin>")
        return hashlib.md5(code.encode()).hexdigest()[:12]

    def manifest(self) -> dict:
        text = read_text(self.spark, f"{self.root}/manifest.json")
        return json.loads(text) if text else {"columns": {}, "batches": [], "fps": self.fps, "created_at": time.time()}

    def _write(self, frames: DataFrame, columns: list[str], manifest: dict) -> None:
        batch = f"batch-{len(manifest['batches']):04d}"
        made = compute_columns(frames, columns, self.fps, self.registry)
        stored = made.select(*[F.col(c).cast("float").alias(c) if t == "double" and c not in (*KEY, "et") else F.col(c) for c, t in made.dtypes])
        stored.write.mode("overwrite").option("maxRecordsPerFile", 5_000_000).partitionBy("source").parquet(f"{self.root}/{batch}")
        manifest["batches"].append(batch)
        for c in columns:
            manifest["columns"][c] = {"version": self.registry.features[parse_column(c)[0]].version, "batch": batch, "added_at": time.time()}
        manifest |= {"updated_at": time.time(), "logic_hash": self.logic_hash()}
        write_text(self.spark, f"{self.root}/manifest.json", json.dumps(manifest, indent=1))

    def update(self, frames: DataFrame, columns: Iterable[str], force: bool = False) -> list[str]:
        """Compute the columns that are missing or outdated (all, if ``force``); returns them."""
        manifest = self.manifest()
        stale = set(self.stale())
        wanted = [c for c in dict.fromkeys(columns) if force or c not in manifest["columns"] or c in stale]
        if wanted:
            self._write(frames, wanted, manifest)
        return wanted

    def stale(self) -> list[str]:
        """Stored columns whose feature has a newer version or is no longer registered."""
        now = self.registry.versions()
        return [c for c, m in self.manifest()["columns"].items() if m["version"] < now.get(parse_column(c)[0], float("inf"))]

    def columns(self) -> list[str]:
        return list(self.manifest()["columns"])

    def load(self, columns: Iterable[str], sources: Iterable[str] | None = None, fill: float | None = None) -> DataFrame:
        """The key and the columns in the order asked for; missing columns raise, unless ``fill`` stands in for them.

        Each batch is read for its own columns and sources only; batches meet on the key.
        """
        manifest, wanted = self.manifest(), list(columns)
        missing = [c for c in wanted if c not in manifest["columns"]]
        if missing and fill is None:
            raise KeyError(f"not stored: {', '.join(missing)}")
        by_batch: dict[str, list[str]] = {}
        for c in wanted:
            if c not in missing:
                by_batch.setdefault(manifest["columns"][c]["batch"], []).append(c)
        if not by_batch:
            raise KeyError("none of the columns is stored")
        out = None
        for batch, names in by_batch.items():
            part = self.spark.read.parquet(f"{self.root}/{batch}").select(*KEY, *names)
            if sources is not None:
                part = part.where(F.col("source").isin(*sources))
            out = part if out is None else out.alias("a").join(part.alias("b"), same("a", "b", KEY), "left").select("a.*", *[f"b.{c}" for c in names])
        value = lambda c: F.lit(fill).cast("float").alias(c) if c in missing else (F.col(c) if fill is None else F.coalesce(F.col(c), F.lit(fill)).alias(c))
        return out.select(*KEY, *[value(c) for c in wanted])

    def validate(self, config: FeatureSetConfig, frames: DataFrame | None = None) -> list[str]:
        """Columns of the config that aren't stored up to date; they are computed first, if ``frames`` are given."""
        if frames is not None:
            self.update(frames, config.columns())
        have, stale = set(self.columns()), set(self.stale())
        return [c for c in config.columns() if c not in have or c in stale]

    def health(self, frames: DataFrame) -> dict[str, list[str]]:
        """Sources missing from the store or from the frames, stale columns, and whether the code changed."""
        manifest = self.manifest()
        names = lambda df: {r[0] for r in df.select("source").distinct().collect()}
        stored = names(self.spark.read.parquet(f"{self.root}/{manifest['batches'][0]}")) if manifest["batches"] else set()
        there = names(frames)
        return {"not_stored": sorted(there - stored), "not_in_frames": sorted(stored - there), "stale": self.stale(), "code_changed": [] if manifest.get("logic_hash") == self.logic_hash() else ["yes"]}
