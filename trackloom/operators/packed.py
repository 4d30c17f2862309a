"""Several values packed in one field.

The separators in use are inferred per source. Every candidate is scored on the pieces next to its occurrences outside
quotes: how regular they are (pieces and types of pieces that stand as whole fields or between other separators too, so
that a sign inside values scores low) and how consistent the piece counts are. Fields are then split by their source's separators and exploded with
their position.

Defined results: null, empty and blank fields and empty pieces give no row; positions count non-empty values from 1;
a field that is a JSON list of scalars is read as one; single or double quotes around a whole value are removed and
doubled quotes inside it are halved; an unclosed quote is an ordinary sign; repeated rows count once; a null source is a
source of its own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.frames import need
from trackloom.operators.periods import clean_source

#: fixed values: the white space of Unicode
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CANDIDATES = (";", "|", ",", "/", "+", "\t", "\n", "\r", "；", "、")


def _class(signs: str) -> str:
    """A regular-expression class of the given signs."""
    return "".join(f"\\x{{{ord(s):x}}}" for s in signs)


def _pieces_pattern(signs: Column) -> Column:
    """Matches quoted values, plain pieces and single separators; ``signs`` is the inside of a class."""
    blank, rest = r"[^\S\t\n\r]*", F.concat(F.lit(r"(?=["), signs, F.lit(r"]|$)"))
    double = F.concat(F.lit(blank + r'"(?:[^"]|"")*"' + blank), rest)
    single = F.concat(F.lit(blank + r"'(?:[^']|'')*'" + blank), rest)
    return F.concat(double, F.lit("|"), single, F.lit("|[^"), signs, F.lit("]+|["), signs, F.lit("]"))


def _strip(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def _unquoted(bare: Column) -> Column:
    """A piece without outer blanks, without its quoting and the blanks inside it."""
    inner = F.substring(bare, F.lit(2), F.length(bare) - 2)
    twice = F.length(bare) >= 2
    return _strip(
        F.when(twice & bare.startswith('"') & bare.endswith('"'), F.replace(inner, F.lit('""'), F.lit('"')))
        .when(twice & bare.startswith("'") & bare.endswith("'"), F.replace(inner, F.lit("''"), F.lit("'")))
        .otherwise(bare)
    )


def piece_type(piece: Column) -> Column:
    """The form of a piece: ``a`` for letters, ``9`` for digits, a blank for blanks, other signs as they are; repeats once."""
    letters = F.regexp_replace(F.regexp_replace(piece, r"[\p{L}\p{M}]+", "a"), r"\p{N}+", "9")
    return F.regexp_replace(F.regexp_replace(letters, r"(?U)\s+", " "), r"a( a)+", "a a")


def separator_scores(fields: DataFrame, candidates: tuple[str, ...] = CANDIDATES, prior: float = 5.0, least_type: float = 0.01) -> DataFrame:
    """``src, sign, uses, regularity, consistency, score`` of each candidate in each source.

    ``fields`` has ``src`` and ``packed``. A use is regular, by half each, if its piece stands elsewhere too and if its
    type (:func:`piece_type`) makes up ``least_type`` of the pieces away from the sign. ``prior`` pseudo-uses with the sign's score over all sources are added to
    each source, and as many regular ones to each sign, so that little evidence decides little.
    """
    every = _class("".join(candidates))
    tokens = F.expr("regexp_extract_all(packed, pattern, 0)")
    split = fields.where(~_strip(F.col("packed")).startswith("[")).withColumn("pattern", _pieces_pattern(F.lit(every))).withColumn("tokens", tokens)
    is_sign = lambda t: t.isin(*candidates)
    # what stands on a side of a piece: a sign, nothing at an end of the field, null for another piece
    edge = lambda c: F.when(c.isNull(), F.lit("")).when(is_sign(c), c)
    beside = lambda t, i: F.struct(_strip(t).alias("bare"), is_sign(t).alias("sign"), edge(F.when(i > 0, F.get("tokens", i - 1))).alias("l"), edge(F.get("tokens", i + 1)).alias("r"))
    rows = split.select("src", F.transform("tokens", beside).alias("beside"))
    rows = rows.select("src", F.filter("beside", lambda t: ~t["sign"] & (t["bare"] != "")).alias("beside"))
    # an outer explode, since a plain one has its input judged before it, with the search of the pattern in every element
    each = rows.select("src", F.size("beside").alias("pieces"), F.explode_outer("beside").alias("t"))
    # alike pieces are counted first, so that the commonest one is a few rows; both sides of the scores read this
    found = each.groupBy("src", "pieces", F.lower(_unquoted(F.col("t.bare"))).alias("piece"), F.col("t.l").alias("l"), F.col("t.r").alias("r")).agg(F.count("*").alias("n")).where("piece <> ''")
    # no filter and no column less than the others read, so that the three readers share one shuffle
    known = found.groupBy("piece").agg(F.collect_set(F.when(F.col("l").isNotNull() & F.col("r").isNotNull() & (F.col("n") > 0), F.struct("l", "r"))).alias("beside"))
    # how common each type of piece is away from a sign
    away = found.groupBy(piece_type(F.col("piece")).alias("type"), "l", "r").agg(F.sum("n").alias("n")).withColumn("sign", F.explode(F.array(*[F.lit(c) for c in candidates])))
    away = away.where("l <> sign AND r <> sign").groupBy("sign", "type").agg(F.sum("n").alias("n"))
    types = away.join(away.groupBy("sign").agg(F.sum("n").alias("whole")), "sign").select("sign", "type", (F.col("n") / F.col("whole") >= least_type).alias("typical"))
    uses = found.select("src", "pieces", "piece", "n", F.explode(F.array("l", "r")).alias("sign")).where("sign <> ''")
    uses = uses.groupBy("src", "sign", "piece", "pieces").agg(F.sum("n").alias("n")).withColumn("type", piece_type(F.col("piece")))
    seen = F.coalesce(F.exists("beside", lambda b: (b["l"] != F.col("sign")) & (b["r"] != F.col("sign"))), F.lit(False))
    regular = (seen.cast("double") + F.coalesce("typical", F.lit(False)).cast("double")) / 2
    judged = uses.join(known, "piece", "left").join(types, ["sign", "type"], "left").withColumn("_regular", F.col("n") * regular)
    counted = judged.groupBy("src", "sign").agg(
        F.sum("n").alias("uses"), F.sum("_regular").alias("regular"), (F.sum(F.col("n") * F.col("pieces")) / F.sum("n")).alias("mean"), (F.sum(F.col("n") * F.col("pieces") * F.col("pieces")) / F.sum("n")).alias("squares")
    )
    overall = counted.groupBy("sign").agg(((F.sum("regular") + prior) / (F.sum("uses") + prior)).alias("overall"))
    regularity = (F.col("regular") + prior * F.col("overall")) / (F.col("uses") + prior)
    consistency = 1 / (1 + F.greatest(F.col("squares") - F.col("mean") * F.col("mean"), F.lit(0.0)) / F.col("mean"))
    scored = counted.join(overall, "sign").select("src", "sign", "uses", regularity.alias("regularity"), consistency.alias("consistency"))
    return scored.withColumn("score", F.col("regularity") * (0.5 + 0.5 * F.col("consistency")))


def unpack(df: DataFrame, key: str = "annotation_id", field: str = "tags", source: str = "source", least_score: float = 0.3) -> DataFrame:
    """One row per value of ``field``: ``key, pos, tag``."""
    need(df, [key, field, source])
    fields = df.select(F.col(key).alias("key"), clean_source(F.col(source)).alias("src"), F.col(field).alias("packed"))
    fields = fields.where(F.col("packed").isNotNull() & (_strip(F.col("packed")) != "")).distinct()
    chosen = separator_scores(fields).where(F.col("score") >= least_score)
    code = F.concat(F.lit("\\x{"), F.lower(F.hex(F.ascii("sign").cast("bigint"))), F.lit("}"))
    signs = chosen.groupBy("src").agg(F.array_join(F.sort_array(F.collect_set(code)), "").alias("signs"), F.array_join(F.collect_set("sign"), "").alias("chars"))
    left = fields.alias("f").join(signs.alias("s"), F.col("f.src").eqNullSafe(F.col("s.src")), "left").select("key", "packed", F.coalesce("signs", F.lit(_class(";"))).alias("signs"), F.coalesce("chars", F.lit(";")).alias("chars"))
    split = F.expr("regexp_extract_all(packed, pattern, 0)")
    listed = F.when(_strip(F.col("packed")).startswith("["), F.from_json(_strip(F.col("packed")), "array<string>"))
    rows = left.withColumn("pattern", _pieces_pattern(F.col("signs"))).withColumn("listed", listed).withColumn("split", split)
    is_sign = lambda t: (F.length(t) == 1) & F.contains(F.col("chars"), t)
    plain = F.transform(F.transform(F.filter("split", lambda t: ~is_sign(t)), _strip), _unquoted)
    values = F.filter(F.coalesce(F.transform("listed", _strip), plain), lambda v: v.isNotNull() & (v != ""))
    out = rows.select("key", F.posexplode(values).alias("at", "tag"))
    return out.select(F.col("key").alias(key), (F.col("at") + 1).cast("long").alias("pos"), "tag").distinct()
