"""Mixing sources to target weights, by pivotal dependent rounding.

The mix is the largest one in which every source can have its target share without any record being used more often than
its source allows, or one of a given size (see :func:`plan`). Each record of a source then has the same expected number of copies; its
whole part is given, and its fraction is rounded dependently: two fractions are paired and mass, measured in tokens,
goes randomly from one to the other until one of them is 0 or 1. The sum of the tokens stays what it was, so a source
misses its target by less than one record. Pairs are formed inside shards of bounded size; the one fraction left over
by each shard goes up a reduction tree.

Defined results: records without tokens (null, empty) are never used; records whose source is null or has no target
aren't used, and the report shows such sources with target 0; a target without any tokens reaches share 0, and the
others share its part in proportion; repeated rows are records of their own; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.encoding import count_tokens
from trackloom.operators.frames import need
from trackloom.plans.staging import stage


def pivot(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Fractions rounded in pairs; all but at most one of the results are 0 or 1."""
    out, held = p.copy(), -1
    for i in range(len(out)):
        if not 0.0 < out[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = out[held], out[i]
        give = min(a * size[held], (1 - b) * size[i])  # from the held one
        take = min((1 - a) * size[held], b * size[i])  # to the held one
        if draw[i] * (give + take) < take:
            first = a * size[held] <= (1 - b) * size[i]
            out[held], out[i] = (0.0, b + give / size[i]) if first else (a - give / size[held], 1.0)
        else:
            first = (1 - a) * size[held] <= b * size[i]
            out[held], out[i] = (1.0, b - take / size[i]) if first else (a + take / size[held], 0.0)
        for k in (held, i):
            if out[k] < 1e-12:
                out[k] = 0.0
            elif out[k] > 1 - 1e-12:
                out[k] = 1.0
        held = next((k for k in (held, i) if 0.0 < out[k] < 1.0), -1)
    return out


def _round_groups(pending: DataFrame, level: int, seed: int, close: bool) -> DataFrame:
    """One level of the tree: the fractions of each source and group are rounded, the last one too if ``close``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "n_tokens"], kind="stable")
        key = f"{seed}/{level}/{rows['source'].iloc[0]}/{rows['part'].iloc[0]}"
        random = np.random.default_rng(zlib.crc32(key.encode()))
        p = pivot(rows["p"].to_numpy(float), rows["n_tokens"].to_numpy(float), random.random(len(rows)))
        if close:
            p = np.where((p > 0) & (p < 1), random.random() < p, p).astype(float)
        return rows.assign(p=p)

    return pending.groupBy("source", "part").applyInPandas(run, pending.schema)


def sized_documents(documents: DataFrame, **tokenizer) -> DataFrame:
    """``doc_id, source, n_tokens``, written once: counting tokens is the dear part."""
    need(documents, ["doc_id", "source", "text"])
    return stage(count_tokens(documents, ["doc_id", "source"], **tokenizer), "sizes")[0]


def plan(sized: DataFrame, targets: DataFrame, size_tokens: int | None = None, short: str = "raise") -> list[dict]:
    """How often each source is used: ``source, share, cap, tokens, rows, rate``, one entry per target with tokens.

    Without ``size_tokens`` the mix is the largest one that meets every share. A larger size than that raises an error,
    unless ``short`` is ``"fill"``: then sources too small for their part are used up to their caps, and the others
    share what is missing in proportion to their targets, as far as their own caps go.
    """
    need(targets, ["source", "target_share", "max_repeats"])
    wanted = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    held = sized.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0))
    # one row per target: as few as somebody wrote down
    found = [r.asDict() for r in held.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")).join(wanted, "source").collect()]
    if not found:
        return []
    most = {s["source"]: float(s["tokens"] * s["cap"]) for s in found}
    exact = min(most[s["source"]] / s["share"] for s in found)
    level = exact if size_tokens is None else size_tokens / sum(s["share"] for s in found)
    if size_tokens is not None and level > exact * (1 + 1e-12):
        if short != "fill":
            raise ValueError(f"a mix of {size_tokens} tokens can't meet every share; {int(exact * sum(s['share'] for s in found))} can")
        left, open_ = float(size_tokens), sorted(found, key=lambda s: most[s["source"]] / s["share"])
        while open_ and most[open_[0]["source"]] / open_[0]["share"] <= left / sum(s["share"] for s in open_):
            left -= most[open_.pop(0)["source"]]
        level = left / sum(s["share"] for s in open_) if open_ else float("inf")
    for s in found:
        rate = min(s["share"] * level / s["tokens"], float(s["cap"]))
        # a number of copies that is whole but for the last bits of a double is whole
        s["rate"] = float(round(rate)) if abs(rate - round(rate)) < 1e-9 else rate
    return found


def mix(sized: DataFrame, targets: DataFrame, size_tokens: int | None = None, seed: int = 7, shard_rows: int = 5000, fan_in: int = 16, short: str = "raise") -> DataFrame:
    """The records of the mix: ``doc_id, source, n_tokens, copies`` (at least one copy); sizes as in :func:`plan`."""
    spark, planned = sized.sparkSession, plan(sized, targets, size_tokens, short)
    rates = spark.createDataFrame([(s["source"], s["rate"], math.ceil(s["rows"] / shard_rows)) for s in planned], "source string, rate double, parts long")
    rows = sized.where("n_tokens > 0").join(rates, "source").select(
        "doc_id", "source", "n_tokens", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"), F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("parts")).alias("part")
    )
    parts = max([math.ceil(s["rows"] / shard_rows) for s in planned if s["rate"] % 1], default=0)
    # copies of a whole number need no rounding
    decided, pending, depth = [rows.where("p = 0")], rows.where("p > 0"), 0
    while parts:
        close = parts <= 1
        done, _ = stage(_round_groups(pending, depth, seed, close), "rounded")
        integral = (F.col("p") == 0) | (F.col("p") == 1)
        decided.append(done.where(integral))
        if close:
            break
        pending = done.where(~integral).withColumn("part", F.floor(F.col("part") / F.lit(fan_in)))
        parts, depth = math.ceil(parts / fan_in), depth + 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("p").cast("long")).cast("int").alias("copies")).where("copies > 0")


def shares(sized: DataFrame, mixed: DataFrame, targets: DataFrame, size_tokens: int | None = None) -> DataFrame:
    """The shares reached: one row per source of the records or the targets.

    ``source, target_share, actual_share, tokens_there, tokens_used, docs_there, docs_used, most_copies, max_repeats``,
    and ``size_asked`` (null if none was) and ``size_reached`` of the whole mix.
    """
    there = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens_there"), F.count("*").alias("docs_there"))
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_used"), F.count("*").alias("docs_used"), F.max("copies").alias("most_copies"))
    wanted = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    whole = used.agg(F.sum("tokens_used")).first()[0]
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    both = there.alias("t").join(wanted.alias("w"), same("t", "w"), "full").select(F.coalesce("t.source", "w.source").alias("source"), "tokens_there", "docs_there", "target_share", "max_repeats")
    rows = both.alias("b").join(used.alias("u"), same("b", "u"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select(
        F.col("b.source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), (F.coalesce("tokens_used", F.lit(0)) / F.lit(float(whole or 1))).alias("actual_share"),
        F.lit(size_tokens).cast("long").alias("size_asked"), F.lit(whole or 0).cast("long").alias("size_reached"), *[zero(c) for c in ("tokens_there", "tokens_used", "docs_there", "docs_used", "most_copies", "max_repeats")],
    )
