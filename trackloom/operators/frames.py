"""Frame numbers and track keys shared by the frame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FPS = 6.0


def frame_number(et: Column, fps: float = FPS) -> Column:
    """``et`` times the frame rate, rounded to the nearest whole number; null for null, NaN and infinite times."""
    beat = et.cast("double") * F.lit(fps)
    usable = et.isNotNull() & ~F.isnan(et.cast("double")) & (F.abs(beat) < F.lit(9e15))
    return F.when(usable, F.rint(beat).cast("long"))


def is_number(value: Column) -> Column:
    """Neither null nor NaN."""
    return value.isNotNull() & ~F.isnan(value)


def need(df: DataFrame, columns: list[str]) -> None:
    """Raise where required columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
