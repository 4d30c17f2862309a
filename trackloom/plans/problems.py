"""Queries over the general data problems: drift, grids, packed fields, intervals and spikes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import drift, grid, packed, periods, spikes
from trackloom.sources.tables import table

#: fields of later files that the project approved as columns
APPROVED = {"confidence": "double", "reviewed": "boolean", "t0_frame": "long", "t1_frame": "long", "an_iteration": "long", "behavior_version": "string", "fps": "double", "inclusive_bounds": "boolean", "rig": "string"}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "session_records"))


def _listed(ingested: DataFrame) -> DataFrame:
    """``written`` and ``rescued`` as one string each."""
    entry = lambda *parts: F.concat_ws(":", *[F.coalesce(p, F.lit("")) for p in parts])
    written = F.transform("written", lambda e: entry(e["field"], e["key"], e["kind"]))
    rest = F.transform(F.from_json("rescued", drift.RESCUED), lambda e: entry(e["reason"], e["field"], e["key"], e["kind"], F.when(e["kind"] != "number", e["text"])))
    return ingested.withColumns({"written": F.array_join(F.array_sort(written), "|"), "rescued": F.array_join(F.array_sort(rest), "|")})


def p1_ingested(spark: SparkSession, d: str) -> DataFrame:
    return _listed(drift.ingest(table(spark, d, "session_records")))


def p1_promoted(spark: SparkSession, d: str) -> DataFrame:
    return _listed(drift.promote(drift.ingest(table(spark, d, "session_records")), APPROVED))


def p1_aliases(spark: SparkSession, d: str) -> DataFrame:
    """What the loaders' own spellings leave unknown, and the columns it may stand for."""
    made = drift.ingest(table(spark, d, "session_records"), drift.KNOWN_ALIASES)
    return drift.propose_aliases(made).withColumn("overlap", F.round("overlap", 6))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return grid.missing_runs(table(spark, d, "long_df"))


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = grid.regular_grid(table(spark, d, "long_df"))
    return rows.withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.unpack(table(spark, d, "annotations"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return periods.periods_and_gaps(table(spark, d, "annotations"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible_frames(table(spark, d, "long_df")).select("source", "id", "frame")


def p7_reasons(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible_frames(table(spark, d, "long_df")).withColumn("reasons", F.array_join("reasons", ";"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_ingested, p1_promoted, p1_aliases, p4_found, p4_grid, p5_found, p6_found, p7_found, p7_reasons)
}

_FIELD = "CASE " + " ".join(f"WHEN lower(key) IN ({', '.join(repr(n) for n in names)}) THEN '{field}'" for field, names in drift.ALIASES.items()) + " ELSE key END"

def _seconds(text: str) -> str:
    """Seconds of a text with up to two colons."""
    part = lambda i: f"TRY_CAST(split_part(replace({text}, ',', '.'), ':', {i}) AS DOUBLE)"
    return f"CASE len(string_split({text}, ':')) WHEN 1 THEN {part(1)} WHEN 2 THEN {part(1)} * 60 + {part(2)} WHEN 3 THEN ({part(1)} * 60 + {part(2)}) * 60 + {part(3)} END"


_VALUE = {
    "string": "CASE WHEN kind IN ('string', 'number', 'boolean') THEN text END",
    "long": "TRY_CAST(text AS BIGINT)",
    "seconds": f"CASE WHEN kind IN ('number', 'string') THEN {_seconds('text')} END",
    "packed": "CASE WHEN kind = 'array' THEN (SELECT string_agg(CASE WHEN contains(v, ';') OR contains(v, '\"') THEN '\"' || replace(v, '\"', '\"\"') || '\"' ELSE v END, ';') FROM (SELECT unnest(from_json(CASE WHEN kind = 'array' THEN text ELSE '[]' END, '[\"VARCHAR\"]')) AS v)) WHEN kind IN ('string', 'number') THEN text END",
}
_TYPED = ", ".join(f"max(CASE WHEN field = '{n}' AND place = 1 THEN {_VALUE[t]} END) AS \"{n}\"" for n, t in drift.TARGET.items())
_FAILS = " OR ".join(f"(field = '{n}' AND ({_VALUE[t]}) IS NULL)" for n, t in drift.TARGET.items())

SQL: dict[str, str] = {
    "p1_ingested": f"""
WITH lines AS (SELECT DISTINCT file_id, series, file_no, line_no, record FROM session_records),
judged AS (SELECT *, coalesce(json_valid(record) AND json_type(CASE WHEN json_valid(record) THEN record END) = 'OBJECT', false) AS readable FROM lines),
keys AS (
  SELECT file_id, series, file_no, line_no, record, unnest(json_keys(record)) AS key, generate_subscripts(json_keys(record), 1) AS nth FROM judged WHERE readable),
typed AS (SELECT *, {_FIELD} AS field, json_type(record, '$."' || key || '"') AS jt, json_extract_string(record, '$."' || key || '"') AS text FROM keys),
kinds AS (
  SELECT *, CASE WHEN jt IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN 'number' WHEN jt = 'VARCHAR' THEN 'string' WHEN jt = 'NULL' THEN NULL ELSE lower(jt) END AS kind,
         row_number() OVER (PARTITION BY file_id, series, file_no, line_no, record, field ORDER BY nth) AS place FROM typed),
reasons AS (
  SELECT *, CASE WHEN field NOT IN ({", ".join(repr(n) for n in drift.TARGET)}) THEN 'unknown' WHEN place > 1 THEN 'repeated' WHEN kind IS NOT NULL AND ({_FAILS}) THEN 'uncastable' END AS reason FROM kinds),
made AS (
  SELECT file_id, series, file_no, line_no, record, {_TYPED},
    string_agg(CASE WHEN reason IS NULL OR reason = 'uncastable' THEN field || ':' || key || ':' || coalesce(kind, '') END, '|' ORDER BY field || ':' || key || ':' || coalesce(kind, '')) AS written,
    string_agg(reason || ':' || field || ':' || key || ':' || coalesce(kind, '') || ':' || CASE WHEN kind <> 'number' THEN text ELSE '' END, '|'
      ORDER BY reason || ':' || field || ':' || key || ':' || coalesce(kind, '') || ':' || CASE WHEN kind <> 'number' THEN text ELSE '' END) FILTER (WHERE reason IS NOT NULL) AS rescued
  FROM reasons GROUP BY ALL)
SELECT j.file_id, j.series, j.file_no, j.line_no, {", ".join(f'm."{n}"' for n in drift.TARGET)},
  coalesce(m.written, '') AS written, CASE WHEN j.readable THEN m.rescued ELSE 'unreadable::::' END AS rescued
FROM judged j LEFT JOIN made m ON j.file_id = m.file_id AND j.line_no = m.line_no AND j.record = m.record AND j.series = m.series AND j.file_no = m.file_no
""",
    "p1_found": f"""
WITH lines AS (
  SELECT DISTINCT file_id, series, file_no, line_no, record FROM session_records
  WHERE json_valid(record) AND json_type(CASE WHEN json_valid(record) THEN record END) = 'OBJECT'),
keys AS (SELECT *, unnest(json_keys(record)) AS key FROM lines),
typed AS (SELECT series, file_no, file_id, {_FIELD} AS field, key, json_type(record, '$."' || key || '"') AS jt FROM keys),
seen AS (
  SELECT series, file_no, file_id, field, list_sort(list_distinct(list(key))) AS ks,
         list_sort(list_distinct(list(CASE WHEN jt IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN 'number' WHEN jt = 'NULL' THEN NULL ELSE jt END))) AS ts
  FROM typed GROUP BY ALL),
files AS (SELECT DISTINCT series, file_no, file_id FROM session_records),
steps AS (SELECT * FROM (SELECT *, lag(file_no) OVER (PARTITION BY series ORDER BY file_no) AS prior_no FROM files) WHERE prior_no IS NOT NULL),
now AS (SELECT st.series, st.file_no, st.file_id, field, ks, ts FROM steps st JOIN seen USING (series, file_no, file_id)),
past AS (SELECT st.series, st.file_no, st.file_id, field, ks, ts FROM steps st JOIN seen s ON s.series = st.series AND s.file_no = st.prior_no),
both_ AS (
  SELECT coalesce(n.file_id, p.file_id) AS file_id, coalesce(n.field, p.field) AS field, n.ks AS k1, n.ts AS t1, p.ks AS k0, p.ts AS t0
  FROM now n FULL JOIN past p ON n.file_id = p.file_id AND n.field = p.field)
SELECT file_id, field, 'added' AS change FROM both_ WHERE k0 IS NULL
UNION ALL SELECT file_id, field, 'removed' FROM both_ WHERE k1 IS NULL
UNION ALL SELECT file_id, field, 'renamed' FROM both_ WHERE k0 <> k1
UNION ALL SELECT file_id, field, 'retyped' FROM both_ WHERE len(t0) > 0 AND len(t1) > 0 AND t0 <> t1
""",
    "p4_found": """
WITH frames AS (
  SELECT DISTINCT source, ID, CAST(round_even(et * 6, 0) AS BIGINT) AS frame FROM long_df
  WHERE et IS NOT NULL AND NOT isnan(et) AND x IS NOT NULL AND NOT isnan(x) AND y IS NOT NULL AND NOT isnan(y)),
pairs AS (SELECT *, lag(frame) OVER (PARTITION BY source, ID ORDER BY frame) AS prior FROM frames)
SELECT source, ID AS id, prior + 1 AS first_frame, frame - 1 AS last_frame FROM pairs WHERE frame - prior > 1 AND frame - prior <= 3600
""",
    "p4_grid": """
WITH readings AS (
  SELECT source, ID, CAST(round_even(et * 6, 0) AS BIGINT) AS frame, et, x, y FROM long_df
  WHERE et IS NOT NULL AND NOT isnan(et) AND x IS NOT NULL AND NOT isnan(x) AND y IS NOT NULL AND NOT isnan(y)),
frames AS (
  SELECT source, ID, frame, x, y FROM readings
  QUALIFY row_number() OVER (PARTITION BY source, ID, frame ORDER BY abs(et * 6 - frame), et, x, y) = 1),
pairs AS (
  SELECT *, lag(frame) OVER w AS pf, lag(x) OVER w AS px, lag(y) OVER w AS py FROM frames WINDOW w AS (PARTITION BY source, ID ORDER BY frame)),
grid AS (
  SELECT *, unnest(generate_series(CASE WHEN frame - pf > 1 AND frame - pf <= 3600 THEN pf + 1 ELSE frame END, frame)) AS spot FROM pairs)
SELECT source, ID AS id, spot AS frame,
  round(CASE WHEN spot = frame THEN x WHEN frame - pf <= 6 THEN px + (x - px) * (CAST(spot - pf AS DOUBLE) / CAST(frame - pf AS DOUBLE)) END, 6) AS x,
  round(CASE WHEN spot = frame THEN y WHEN frame - pf <= 6 THEN py + (y - py) * (CAST(spot - pf AS DOUBLE) / CAST(frame - pf AS DOUBLE)) END, 6) AS y,
  CASE WHEN spot = frame THEN 'read' WHEN frame - pf <= 6 THEN 'filled' ELSE 'missing' END AS state
FROM grid
""",
    "p6_found": """
WITH rows_ AS (
  SELECT upper(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS source, ID, t0, t1 FROM annotations
  WHERE ID IS NOT NULL AND t0 IS NOT NULL AND t1 IS NOT NULL AND t1 > t0),
reach AS (
  SELECT *, max(t1) OVER (PARTITION BY source, ID ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ FROM rows_),
runs AS (
  SELECT *, sum(CASE WHEN before_ IS NULL OR t0 - before_ > 1.1::DOUBLE / 6 THEN 1 ELSE 0 END) OVER (PARTITION BY source, ID ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS run FROM reach),
periods AS (SELECT source, ID, min(t0) AS t0, max(t1) AS t1 FROM runs GROUP BY source, ID, run),
next_ AS (SELECT *, lead(t0) OVER (PARTITION BY source, ID ORDER BY t0) AS nt FROM periods)
SELECT source, ID AS id, 'period' AS kind, CAST(round_even(t0 * 1000, 0) AS BIGINT) AS start_ms, CAST(round_even(t1 * 1000, 0) AS BIGINT) AS end_ms FROM periods
UNION ALL
SELECT source, ID, 'gap', CAST(round_even(t1 * 1000, 0) AS BIGINT), CAST(round_even(nt * 1000, 0) AS BIGINT) FROM next_ WHERE nt IS NOT NULL
""",
}
