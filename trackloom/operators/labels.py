"""Annotation tables: reading several spellings of columns, cleaning and filtering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import text
from trackloom.operators.frames import is_number, need
from trackloom.operators.periods import clean_source

#: fixed values: other names of annotation columns
COLUMN_ALIASES = {"File": "source", "source_file": "source", "t0_sec": "t0", "t1_sec": "t1", "behavior": "Behavior", "Tag": "tags", "tag": "tags"}


def rename_aliases(df: DataFrame, aliases: dict[str, str] = COLUMN_ALIASES) -> DataFrame:
    """Rename aliases; where the canonical column is there too, fill its nulls from the alias and drop that."""
    have, out = set(df.columns), df
    for alias, name in aliases.items():
        if alias not in have:
            continue
        if name in have:
            out = out.withColumn(name, F.coalesce(F.col(name), F.col(alias))).drop(alias)
        else:
            out = out.withColumnRenamed(alias, name)
            have.add(name)
    return out


def union_annotations(tables: Sequence[DataFrame]) -> DataFrame:
    """All tables by column name; ``file_order`` keeps which one a row is from, for later rows to win."""
    out = None
    for i, t in enumerate(tables):
        t = rename_aliases(t).withColumn("file_order", F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out


def annotations(df: DataFrame, sources: Sequence[str] | None = None, without: Sequence[str] = ()) -> DataFrame:
    """Usable intervals: clean source, numeric bounds, canonical behaviour and tags.

    Rows with null ID, bounds or behaviour (or NaN), or without ``t1 > t0``, are dropped; ``sources`` allows and
    ``without`` denies behaviours. Rows delivered twice count once.
    """
    df = rename_aliases(df)
    need(df, ["source", "ID", "t0", "t1", "Behavior", "tags"])
    number = lambda c, kind: F.col(c).cast("string").try_cast(kind)
    rows = df.withColumns({"source": clean_source(F.col("source")), "ID": number("ID", "long"), "t0": number("t0", "double"), "t1": number("t1", "double"), "Behavior": text.behavior(F.col("Behavior"))})
    rows = rows.where(F.col("ID").isNotNull() & is_number(F.col("t0")) & is_number(F.col("t1")) & (F.col("t1") > F.col("t0")) & F.col("Behavior").isNotNull())
    if sources is not None:
        rows = rows.where(F.col("source").isin(*sources))
    if without:
        rows = rows.where(~F.col("Behavior").isin(*without))
    return rows.distinct()


def source_starts(source: Column, *prefixes: str) -> Column:
    """Whether the source begins with one of the prefixes."""
    out = F.lit(False)
    for p in prefixes:
        out = out | F.coalesce(source.startswith(p), F.lit(False))
    return out


def id_slices(df: DataFrame, slices: dict[str, tuple[int | None, int | None]]) -> DataFrame:
    """Tracks whose ID lies in the slice of their source, both ends included; an open end is no bound."""
    out = F.lit(False)
    for source, (low, high) in slices.items():
        here = F.col("source") == source
        if low is not None:
            here = here & (F.col("ID") >= low)
        if high is not None:
            here = here & (F.col("ID") <= high)
        out = out | here
    return df.where(out)


def after_cursor(df: DataFrame, source: str, track: int) -> DataFrame:
    """Rows from a track on, in the order of source and ID."""
    return df.where((F.col("source") > source) | ((F.col("source") == source) & (F.col("ID") >= track)))


def context_report(frames: DataFrame, labels: DataFrame) -> DataFrame:
    """What is wrong with a set of labels: ``issue, n``: dwelling without tags, tracks without frames."""
    untagged = labels.where((F.col("Behavior") == "dwelling") & (F.size(text.tag_tokens(F.col("tags"))) == 0)).agg(F.lit("untagged dwelling").alias("issue"), F.count("*").alias("n"))
    keys = labels.select("source", "ID").distinct()
    orphans = keys.join(frames.select("source", "ID").distinct(), ["source", "ID"], "left_anti").agg(F.lit("track without frames").alias("issue"), F.count("*").alias("n"))
    return untagged.unionByName(orphans)
