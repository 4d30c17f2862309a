"""Mapping freely typed values to a canonical list, by token-level repair.

Distinct values are cut into tokens. Each distinct token is joined to the vocabulary of the reference entries by edit
distance: token and vocabulary meet on common strings left after up to two deletions (an equality join, complete for
distances up to two), and the distance of each meeting is then computed. The repaired tokens are combined with soft
TF-IDF, which ranks whole entries; a value too far from every entry is ``unmatched``.

A value is also held as a single token without its separators against entries without theirs, since separators are
mistyped like other signs.

Defined results: null and blank values are no cases, nor are values that are an entry letter for letter; values of
signs only are ``unmatched``; equal ranks go to the entry that comes first in the alphabet; rows with the same key and
value count once; an empty reference makes every case ``unmatched``; extra columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.operators.frames import need
from trackloom.plans.staging import stage

#: fixed values: rows of keys on common keyboards
KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
MOST_EDITS, LEAST_REST = 2, 3


def beside(a: str, b: str) -> bool:
    """Whether two keys touch on a keyboard."""
    spots = {k: (r, c) for r, row in enumerate(KEYBOARD) for c, k in enumerate(row)}
    if a not in spots or b not in spots:
        return False
    (r, c), (s, d) = spots[a], spots[b]
    return abs(r - s) <= 1 and abs(c + r / 2 - d - s / 2) <= 1.1


NEAR = {(a, b) for a in "".join(KEYBOARD) for b in "".join(KEYBOARD) if a != b and beside(a, b)}


def distance(a: str, b: str) -> float:
    """Edits from a to b: insert, delete, replace, swap neighbours. A key beside the right one costs a little less."""
    two: list[float] = []
    one = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        now = [float(i)]
        for j, y in enumerate(b, 1):
            cost = 0.0 if x == y else 0.9 if (x, y) in NEAR else 1.0
            best = min(now[j - 1] + 1, one[j] + 1, one[j - 1] + cost)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, two[j - 2] + 1)
            now.append(best)
        two, one = one, now
    return one[-1]


@F.pandas_udf(T.DoubleType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def normal(value: Column) -> Column:
    """Lower case, signs as single blanks, a leading negation written together with what it negates."""
    words = F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(words, r"\b(?:non|not) (?=\p{L})", "non")


def _less(word: Column) -> Column:
    """The word with each of its letters left out once."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def deletions(word: Column, most: Column) -> Column:
    """The word and what is left of it after up to ``most`` deletions (none, one or two)."""
    none = F.array().cast("array<string>")
    once = F.when((F.length(word) > 0) & (most > 0), F.array_distinct(_less(word))).otherwise(none)
    twice = F.when(most > 1, F.flatten(F.transform(F.filter(once, lambda w: F.length(w) > 0), _less))).otherwise(none)
    return F.array_distinct(F.concat(F.array(word), once, twice))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _inflected(words: pd.Series) -> pd.Series:
    """Other forms of a word that ends in -ing: its stem and the stem's endings."""

    def forms(word: str) -> list[str]:
        if not word.endswith("ing") or len(word) < 6:
            return []
        stem = word[:-3]
        stems = {stem} | ({stem[:-1]} if stem[-1] == stem[-2] else set())
        return sorted({s + e for s in stems for e in ("", "s", "es", "e", "ed", "er", "al")})

    return words.map(forms)


def vocabulary(reference: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """Words of the reference: ``word, label, token, edits, kind``.

    ``token`` is the entry's token that ``word`` is a spelling of, ``edits`` the most edits allowed (by the length of
    the word, none for inflected forms and short forms), ``kind`` ``word`` or ``whole`` (an entry without separators).
    """
    entries = reference.where("label IS NOT NULL").select("label", "short_form", normal(F.col("label")).alias("text")).distinct()
    allowed = lambda w: F.when(F.length(w) <= 3, 0).when(F.length(w) == 4, 1).otherwise(MOST_EDITS)
    tokens = entries.select("label", F.explode(F.split("text", " ")).alias("token")).where("token <> ''")
    exact = tokens.select(F.col("token").alias("word"), "label", "token", allowed(F.col("token")).alias("edits"), F.lit("word").alias("kind"))
    forms = tokens.select("label", "token", F.explode(_inflected("token")).alias("word")).select("word", "label", "token", F.when(F.length("word") >= 6, 1).otherwise(0).alias("edits"), F.lit("word").alias("kind"))
    joined = F.replace(F.col("text"), F.lit(" "), F.lit(""))
    last = F.explode(F.concat(F.array(F.element_at(F.split("text", " "), -1)), _inflected(F.element_at(F.split("text", " "), -1))))
    wholes = entries.withColumn("joined", joined).withColumn("end", last).select(
        "label", "joined", F.concat(F.substring("text", F.lit(1), F.length("text") - F.length(F.element_at(F.split("text", " "), -1))), F.col("end")).alias("word"), F.col("end")
    )
    word = F.replace(F.col("word"), F.lit(" "), F.lit(""))
    wholes = wholes.select(word.alias("word"), "label", F.col("joined").alias("token"), F.when(word == F.col("joined"), allowed(word)).otherwise(F.when(F.length(word) >= 6, 1).otherwise(0)).alias("edits"), F.lit("whole").alias("kind"))
    joined_token = F.replace(normal(F.col("label")), F.lit(" "), F.lit(""))
    short = entries.where("short_form IS NOT NULL").select(normal(F.col("short_form")).alias("word"), "label", joined_token.alias("token"), F.lit(0).alias("edits"), F.lit("whole").alias("kind"))
    out = exact.unionByName(forms).unionByName(wholes).unionByName(short)
    if synonyms:
        pairs = F.explode(F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair]))
        meant = entries.select("label", "text", pairs.alias("written", "stands_for")).where("stands_for = text").withColumn("word", F.replace(normal(F.col("written")), F.lit(" "), F.lit("")))
        out = out.unionByName(meant.select("word", "label", joined_token.alias("token"), F.lit(0).alias("edits"), F.lit("whole").alias("kind")))
    return out.where("word <> ''").distinct()


def repair(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Tokens met with vocabulary words within the allowed edits: ``piece, kind, label, token, likeness``."""
    # no word of up to three letters may be edited, so no rest that decides is shorter: there are no short, common rests
    spelled = words.groupBy("word", "kind").agg(F.max("edits").alias("most"))
    meant = spelled.select("word", "kind", "most", F.explode(deletions(F.col("word"), F.col("most"))).alias("rest"))
    longest = F.lit(words.agg(F.max(F.length("word"))).first()[0] or 0)
    # a longer token is further from every word than any edits allowed; it has no deletions, wherever they are evaluated
    short = F.when(F.length("piece") <= longest + MOST_EDITS, F.col("piece"))
    rests = F.filter(deletions(short, F.lit(MOST_EDITS)), lambda r: (F.length(r) >= LEAST_REST) | (r == F.col("piece")))
    typed = tokens.select("piece", "kind", F.explode(rests).alias("rest"))
    met = typed.join(meant, ["rest", "kind"]).select("piece", "word", "kind", "most").distinct()
    # a swap is two plain edits: pairs beyond that are told apart before Python measures the rest
    plain = F.levenshtein("piece", "word", 2 * MOST_EDITS)
    measured = met.where((plain >= 0) & (plain <= 2 * F.col("most"))).withColumn("edits_made", _distance("piece", "word"))
    near = measured.join(words, ["word", "kind"]).where(F.col("edits_made") <= F.col("edits"))
    likeness = 1 - F.col("edits_made") / F.greatest(F.length("piece"), F.length("word"), F.lit(1))
    return near.groupBy("piece", "kind", "label", "token").agg(F.max(likeness).alias("likeness"))


def canonical(values: DataFrame, reference: DataFrame, synonyms: dict[str, str] | None = None, least: float = 0.6) -> DataFrame:
    """``typed, label`` of distinct values in the column ``typed``; ``unmatched`` where no entry reaches ``least``.

    ``synonyms`` are words in use and the label each stands for.
    """
    # written tables keep the plans of the steps that use them again and again small
    words, _ = stage(vocabulary(reference, synonyms or {}), "words")
    # a short key stands for the value, which may be long
    cut = values.select("typed").distinct().select("typed", F.md5("typed").alias("id"), normal(F.col("typed")).alias("text"))
    as_words = cut.select("id", F.explode(F.array_distinct(F.split("text", " "))).alias("piece"), F.lit("word").alias("kind"))
    as_whole = cut.select("id", F.replace("text", F.lit(" "), F.lit("")).alias("piece"), F.lit("whole").alias("kind"))
    pieces, _ = stage(as_words.unionByName(as_whole).where("piece <> ''").distinct(), "pieces")
    near, _ = stage(repair(pieces.select("piece", "kind").distinct(), words), "repaired")
    # how telling a token is: the fewer entries have it, the more
    weights = words.groupBy("kind", "token").agg(F.countDistinct("label").alias("df"))
    entries = words.agg(F.countDistinct("label")).first()[0] or 1
    idf = F.log(F.lit(1.0 + entries) / F.col("df"))
    weighted = weights.select("kind", "token", idf.alias("idf"))
    of_label = words.select("label", "kind", "token").distinct().join(weighted, ["kind", "token"])
    # an entry in one piece may have several spellings, of which one is met
    norms = of_label.groupBy("label", "kind").agg(F.when(F.first("kind") == "whole", F.max(F.col("idf") * F.col("idf"))).otherwise(F.sum(F.col("idf") * F.col("idf"))).alias("label_norm"))
    unknown = F.lit(math.log(1.0 + entries))
    met = pieces.join(near, ["piece", "kind"]).join(weighted, ["kind", "token"])
    best_idf = met.groupBy("id", "kind", "piece").agg(F.max("idf").alias("piece_idf"))
    of_piece = pieces.join(best_idf, ["id", "kind", "piece"], "left").select("id", "kind", F.coalesce("piece_idf", unknown).alias("piece_idf"))
    typed_norms = of_piece.groupBy("id", "kind").agg(F.sum(F.col("piece_idf") * F.col("piece_idf")).alias("typed_norm"))
    per_token = met.groupBy("id", "kind", "label", "token").agg(F.max(F.col("likeness") * F.col("idf") * F.col("idf")).alias("part"))
    dots = per_token.groupBy("id", "kind", "label").agg(F.sum("part").alias("dot"))
    ranked = dots.join(norms, ["label", "kind"]).join(typed_norms, ["id", "kind"]).withColumn("score", F.col("dot") / F.sqrt(F.col("label_norm") * F.col("typed_norm")))
    best = ranked.where(F.col("score") >= least).groupBy("id").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "label")).alias("b"))
    return cut.select("typed", "id").join(best, "id", "left").select("typed", F.coalesce("b.label", F.lit("unmatched")).alias("label"))


def map_values(df: DataFrame, reference: DataFrame, key: str = "annotation_id", field: str = "Behavior", **options) -> DataFrame:
    """``key, label`` of each case."""
    need(df, [key, field])
    need(reference, ["label", "short_form"])
    filled = df.select(F.col(key).alias("key"), F.col(field).alias("typed")).where(F.col("typed").isNotNull() & (F.regexp_replace("typed", r"(?U)\s+", "") != "")).distinct()
    cases = filled.join(reference.select(F.col("label").alias("typed")).distinct(), "typed", "left_anti")
    found = canonical(cases.select("typed").distinct(), reference, **options)
    return cases.join(found, "typed").select(F.col("key").alias(key), "label")
