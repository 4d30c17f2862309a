"""Schemas that drift between files: rescue-column ingestion.

Every line is mapped onto a target schema: keys are resolved by an alias table without regard to case, values are cast
to the target types, and whatever is unknown, repeated, unreadable or cannot be cast stays in a JSON rescue column.
Approved fields are promoted to typed columns later, and their rescued values are replayed into them. The changes of
fields between successive files of a series are read off the ingested table, which keeps every key as it was written.

Defined results: every line gives a row; a line that isn't one JSON object (cut off, null, another value, more behind
the object, a key repeated inside a nested object) goes whole into ``rescued`` as ``unreadable``; of a repeated key the
first value counts and the others are rescued; lines delivered twice count once; a field whose values are all null in a
file has no type there and isn't ``retyped``; lines without ``series`` or ``file_no`` are ingested, but no file is
compared with theirs; empty tables give empty results; extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.frames import need
from trackloom.plans.staging import stage

#: fixed values: the spellings of annotation columns that the project's loaders know, lower case
KNOWN_ALIASES = {
    "source": ["source", "file", "source_file"],
    "AN": ["an"],
    "ID": ["id"],
    "t0": ["t0", "t0_sec"],
    "t1": ["t1", "t1_sec"],
    "Behavior": ["behavior"],
    "tags": ["tags", "tag"],
    "notes": ["notes"],
    "annotator": ["annotator"],
}
#: fixed values: spellings approved for session files, as :func:`propose_aliases` shows them
APPROVED_ALIASES = {
    "source": ["recording", "src"],
    "AN": ["animal_no"],
    "ID": ["larva", "track_id"],
    "t0": ["t_start", "start_s", "onset"],
    "t1": ["t_end", "end_s", "offset_s"],
    "Behavior": ["behaviour", "beh", "label"],
    "tags": ["tag_list", "keywords"],
    "notes": ["note", "comment"],
    "annotator": ["user", "scored_by"],
}
ALIASES = {field: [*KNOWN_ALIASES[field], *APPROVED_ALIASES[field]] for field in KNOWN_ALIASES}
TARGET = {"source": "string", "AN": "long", "ID": "long", "t0": "seconds", "t1": "seconds", "Behavior": "string", "tags": "packed", "notes": "string", "annotator": "string"}
#: what values of the target types of our own are stored as
PLAIN_TYPES = {"seconds": "double", "packed": "string"}
LINE = ["file_id", "series", "file_no", "line_no"]
RESCUED = "array<struct<field:string,key:string,kind:string,text:string,reason:string>>"
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _canonical(key: Column, aliases: dict[str, list[str]]) -> Column:
    pairs = [F.lit(x) for field, names in aliases.items() for name in names for x in (name.lower(), field)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(key)), key)


def _json_type(kind: Column) -> Column:
    """Of a variant's schema: ``number``, ``string``, ``boolean``, ``array``, ``object``, or null for a JSON null."""
    named = F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
    return F.when(kind == "VOID", F.lit(None).cast("string")).otherwise(F.coalesce(named, F.lit("number")))


def read_fields(records: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Every line: its key, ``record`` and ``fields``, an array of ``field, key, kind, text``, null where unreadable."""
    need(records, [*LINE, "record"])
    # inside brackets, so that anything behind the object is seen too; a map keeps repeated keys
    objects = F.from_json(F.concat(F.lit("["), F.col("record"), F.lit("]")), "array<map<string,variant>>", STRICT)
    # in steps, so that a value's schema is read once
    schemas = F.transform(F.map_entries(F.get("objects", F.lit(0))), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.when(F.is_variant_null(e["value"]), "VOID").otherwise(F.schema_of_variant(e["value"])).alias("schema")))
    typed = F.transform(schemas, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), _json_type(e["schema"]).alias("kind")))
    text = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    field = F.transform(typed, lambda e: F.struct(_canonical(e["key"], aliases).alias("field"), e["key"].alias("key"), e["kind"].alias("kind"), F.when(e["kind"].isNotNull(), text(e["value"])).alias("text")))
    parsed = records.select(*LINE, "record", objects.alias("objects"))
    return parsed.select(*LINE, "record", F.when(F.size("objects") == 1, field).alias("fields"))


def _seconds(text: Column) -> Column:
    """Seconds from ``12.5``, ``12,5``, ``1:02.5`` or ``1:02:03.5``; null for anything else."""
    parts = F.split(F.replace(text, F.lit(","), F.lit(".")), ":")
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    usable = (F.size(parts) <= 3) & ~F.exists(numbers, lambda n: n.isNull() | F.isnan(n))
    return F.when(usable, F.aggregate(numbers, F.lit(0.0), lambda total, n: total * 60 + n))


def _packed(text: Column) -> Column:
    """A JSON list as one ``;``-separated string, values that hold a separator or quote in quotes."""
    quote = lambda v: F.when(F.regexp_like(v, F.lit('[;"]')), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    return F.coalesce(F.array_join(F.transform(F.from_json(text, "array<string>"), quote), ";"), text)


def _cast(text: Column, kind: Column, wanted: str) -> Column:
    if wanted == "seconds":
        return F.when(kind.isin("number", "string"), _seconds(text))
    if wanted == "packed":
        return F.when(kind == "array", _packed(text)).when(kind.isin("string", "number"), text)
    if wanted == "string":
        return F.when(kind.isin("string", "number", "boolean"), text)
    return F.when(kind.isin("number", "string", "boolean"), text.try_cast(wanted))


def ingest(records: DataFrame, aliases: dict[str, list[str]] = ALIASES, target: dict[str, str] = TARGET, once: bool = True) -> DataFrame:
    """One row per line: the line's key, the target columns, ``written`` and ``rescued``.

    ``written`` lists ``field, key, kind`` of the values in the target columns, the key as written and its JSON type.
    ``rescued`` is a JSON list of the rest, ``field, key, kind, text, reason``, or null: the ``reason`` is ``unknown`` (a
    field that the target doesn't have), ``repeated`` (the record had that column before), ``uncastable``, or
    ``unreadable`` for a whole line. ``seconds`` and ``packed`` are target types for times in several spellings and for
    lists. Without ``once`` lines delivered twice stay two rows.
    """
    lines = records.select(*LINE, "record").distinct() if once else records
    fields = read_fields(lines, aliases)
    first = lambda name: F.get(F.filter("fields", lambda e: e["field"] == name), F.lit(0))
    chosen = fields.select("*", *[first(name).alias(f"_{name}") for name in target])
    cast = [_cast(F.col(f"_{name}.text"), F.col(f"_{name}.kind"), wanted).alias(name) for name, wanted in target.items()]
    typed = chosen.select(*LINE, "record", "fields", *[f"_{name}" for name in target], *cast)
    failed = F.array_compact(F.array(*[F.when(F.col(f"_{n}.kind").isNotNull() & F.col(n).isNull(), n) for n in target]))
    written = F.array_compact(F.array(*[F.when(F.col(f"_{n}").isNotNull(), F.struct(F.lit(n).alias("field"), F.col(f"_{n}.key").alias("key"), F.col(f"_{n}.kind").alias("kind"))) for n in target]))

    def reason(e: Column, i: Column) -> Column:
        known = F.when(F.array_position("names", e["field"]) != i + 1, "repeated").when(F.array_contains("failed", e["field"]), "uncastable")
        return F.when(e["field"].isin(*target), known).otherwise("unknown")

    judged = F.transform("fields", lambda e, i: F.struct(e["field"].alias("field"), e["key"].alias("key"), e["kind"].alias("kind"), e["text"].alias("text"), reason(e, i).alias("reason")))
    none = F.lit(None).cast("string")
    whole = F.array(F.struct(none.alias("field"), none.alias("key"), none.alias("kind"), F.col("record").alias("text"), F.lit("unreadable").alias("reason")))
    rest = typed.withColumns({"names": F.col("fields.field"), "failed": failed}).withColumn("rest", F.when(F.col("fields").isNull(), whole).otherwise(F.filter(judged, lambda e: e["reason"].isNotNull())))
    return rest.select(*LINE, *target, written.alias("written"), F.when(F.size("rest") > 0, F.to_json("rest")).alias("rescued"))


def promote(table: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Give ``table`` typed columns for approved ``fields`` and replay their rescued values into them.

    An existing column keeps its values, in the approved type, and is only filled where it is null. Of several rescued
    values the first that can be cast counts. What could be replayed moves from ``rescued`` to ``written``, and so does
    a JSON null.
    """
    out = table.withColumn("_r", F.from_json("rescued", RESCUED))
    for name, wanted in fields.items():
        out = _replay(out, name, wanted)
    return out.withColumn("rescued", F.when(F.size("_r") > 0, F.to_json("_r"))).drop("_r", "_e", "_kept")


def _replay(table: DataFrame, name: str, wanted: str) -> DataFrame:
    mine = F.filter("_r", lambda e: e["field"].eqNullSafe(F.lit(name)))
    fits = F.get(F.filter(mine, lambda e: _cast(e["text"], e["kind"], wanted).isNotNull()), F.lit(0))
    empty = F.get(F.filter(mine, lambda e: e["kind"].isNull()), F.lit(0))
    kept = F.col(name).cast("string").try_cast(PLAIN_TYPES.get(wanted, wanted)) if name in table.columns else F.lit(None)
    # an existing value stays, and what was rescued beside it too
    out = table.withColumns({"_kept": kept, "_e": F.when(kept.isNull(), F.coalesce(fits, empty))})
    moved = F.struct(F.col("_e.field").alias("field"), F.col("_e.key").alias("key"), F.col("_e.kind").alias("kind"))
    none = F.col("_e").isNull()
    return out.withColumns(
        {
            name: F.coalesce("_kept", _cast(F.col("_e.text"), F.col("_e.kind"), wanted)),
            "written": F.when(none, F.col("written")).otherwise(F.array_append("written", moved)),
            "_r": F.when(none, F.col("_r")).otherwise(F.filter("_r", lambda e, i: i + 1 != F.array_position("_r", F.col("_e")))),
        }
    )


def file_fields(ingested: DataFrame) -> DataFrame:
    """One row per file: ``series, file_no, file_id`` and ``seen``, per field its keys as written and its JSON types."""
    known = F.transform("written", lambda e: F.struct(e["field"], e["key"], e["kind"]))
    rescued = F.transform(F.filter(F.from_json("rescued", RESCUED), lambda e: e["reason"] != "unreadable"), lambda e: F.struct(e["field"], e["key"], e["kind"]))
    both = F.concat(known, F.coalesce(rescued, F.array().cast("array<struct<field:string,key:string,kind:string>>")))
    # a file without readable records still stands between its neighbours
    each = ingested.where("series IS NOT NULL AND file_no IS NOT NULL").select("series", "file_no", "file_id", F.explode_outer(both).alias("e"))
    # alike fields of a file are counted as one first, in a hash aggregate; sets would be sorted
    each = each.select("series", "file_no", "file_id", "e.field", "e.key", "e.kind").distinct()
    seen = each.groupBy("series", "file_no", "file_id", "field").agg(
        F.sort_array(F.collect_set("key")).alias("keys"), F.sort_array(F.collect_set("kind")).alias("kinds")
    )
    return seen.groupBy("series", "file_no", "file_id").agg(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "keys", "kinds"))).alias("seen"))


def changes(records: DataFrame, aliases: dict[str, list[str]] = ALIASES, target: dict[str, str] = TARGET) -> DataFrame:
    """Changes of fields between a file and the one before it in its series: ``file_id, field, change``.

    ``change`` is ``added``, ``removed``, ``renamed`` (key written differently) or ``retyped`` (other JSON type). They
    are read off the table that :func:`ingest` gives; sets of keys don't need lines delivered twice taken out.
    """
    files = file_fields(ingest(records, aliases, target, once=False))
    steps = files.withColumn("past", F.lag("seen").over(Window.partitionBy("series").orderBy("file_no"))).where(F.col("past").isNotNull())
    other = lambda side, e: F.get(F.filter(side, lambda o: o["field"] == e["field"]), F.lit(0))

    def judged(e: Column) -> Column:
        before = other("past", e)
        typed = (F.size(before["kinds"]) > 0) & (F.size(e["kinds"]) > 0) & (before["kinds"] != e["kinds"])
        found = F.array(F.when(before.isNull(), "added"), F.when(before["keys"] != e["keys"], "renamed"), F.when(typed, "retyped"))
        return F.transform(F.array_compact(found), lambda c: F.struct(e["field"].alias("field"), c.alias("change")))

    gone = F.transform(F.filter("past", lambda e: other("seen", e).isNull()), lambda e: F.struct(e["field"].alias("field"), F.lit("removed").alias("change")))
    return steps.select("file_id", F.explode(F.concat(F.flatten(F.transform("seen", judged)), gone)).alias("c")).select("file_id", "c.field", "c.change")


def propose_aliases(ingested: DataFrame, target: dict[str, str] = TARGET, least: float = 0.5) -> DataFrame:
    """Target columns that unknown fields may stand for: ``field, column, overlap``.

    ``overlap`` is the share of the field's values that also occur in the column. A field that stands beside the column
    in some record is no spelling of it. Of the columns left the one with the largest overlap is proposed.
    """
    unknown = F.filter(F.from_json("rescued", RESCUED), lambda e: (e["reason"] == "unknown"))
    # written, since it is read three times
    rows, _ = stage(ingested.select(unknown.alias("u"), F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in target]).alias("k"), F.col("written.field").alias("beside")), "proposed")
    fields = rows.select(F.explode("u").alias("e"), "beside")
    plain = lambda v: F.coalesce(v.try_cast("double").cast("string"), v)
    mine = fields.where("e.kind IS NOT NULL").groupBy(F.col("e.field").alias("field"), plain(F.col("e.text")).alias("value")).agg(F.count("*").alias("n"))
    known = rows.select(F.explode("k").alias("e")).where("e.value IS NOT NULL").select("e.column", plain(F.col("e.value")).alias("value")).distinct()
    total = mine.groupBy("field").agg(F.sum("n").alias("total"))
    met = mine.join(known, "value").groupBy("field", "column").agg(F.sum("n").alias("met"))
    together = fields.select(F.col("e.field").alias("field"), F.explode("beside").alias("column")).distinct()
    scored = met.join(together, ["field", "column"], "left_anti").join(total, "field").select("field", "column", (F.col("met") / F.col("total")).alias("overlap"))
    best = scored.where(F.col("overlap") >= least).groupBy("field").agg(F.max(F.struct("overlap", "column")).alias("b"))
    return best.select("field", "b.column", "b.overlap")
