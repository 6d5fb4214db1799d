"""All queries of the core library by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import flatten
from ..sources import bad_records, schema_drift
from . import q_clones, q_deltas, q_extract, q_misc, q_more, q_rules, q_symbols, q_text, q_topology
from .session import table, written

_families = (q_topology, q_symbols, q_clones, q_text, q_deltas, q_misc, q_extract, q_more, q_rules)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten.flatten_messages(table(spark, d, "compiler_messages"), payloads=False).select("message_id", "node_path", "parent_path")


def _p2_tables(spark: SparkSession, d: str) -> DataFrame:
    """The tagged rows of all tables, emitted and written once; whichever of them is asked for reads its own folder."""
    return written(spark, f"p2:{d}", lambda path: flatten.write_tables(flatten.flatten_messages(table(spark, d, "compiler_messages")), path))


def _p2_table(tag: str):
    return lambda spark, d: flatten.typed_table(_p2_tables(spark, d), tag)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return bad_records.failing_lines(table(spark, d, "runs"), table(spark, d, "raw_coverage"))


def p3_loaded_coverage(spark: SparkSession, d: str) -> DataFrame:
    return bad_records.load_csv_records(table(spark, d, "raw_coverage")).where("reason IS NULL").drop("reason", "detail")


def p3_loaded_events(spark: SparkSession, d: str) -> DataFrame:
    return bad_records.load_json_lines(table(spark, d, "runs")).where("ok").select("run_id", "line_no", "event", "line").distinct()


def p3_run_status(spark: SparkSession, d: str) -> DataFrame:
    return bad_records.run_status(table(spark, d, "runs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.schema_changes(table(spark, d, "artifact_files"), table(spark, d, "contract_fields"))


def _p4_table(producer: str):
    return lambda spark, d: schema_drift.consistent_table(table(spark, d, "artifact_files"), table(spark, d, "contract_fields"), producer)


QUERIES: dict = {f.__name__: f for f in (p2_found, p3_found, p4_found, p3_loaded_coverage, p3_loaded_events, p3_run_status)}
QUERIES |= {f"p2_{tag}s": _p2_table(tag) for tag in flatten.SCHEMAS}
QUERIES |= {f"p4_{p.replace('-', '_')}": _p4_table(p) for p in ("discipline", "rust-health", "rank-fixes")}
#: nodes by recursion over JSON values: a child is a path, a tag and a value; what is null is no node
_KIDS = """list_filter(list_concat(
  CASE WHEN tag = 'diagnostic' AND json_type(v, '$.children') = 'ARRAY' THEN list_transform(range(json_array_length(v, '$.children')::BIGINT), lambda i: {'p': '.children[' || i || ']', 't': 'diagnostic', 'i': i::INT, 'v': json_extract(v, '$.children[' || i || ']')}) ELSE [] END,
  CASE WHEN tag = 'diagnostic' AND json_type(v, '$.spans') = 'ARRAY' THEN list_transform(range(json_array_length(v, '$.spans')::BIGINT), lambda i: {'p': '.spans[' || i || ']', 't': 'span', 'i': i::INT, 'v': json_extract(v, '$.spans[' || i || ']')}) ELSE [] END,
  CASE WHEN tag = 'span' AND json_type(v, '$.text') = 'ARRAY' THEN list_transform(range(json_array_length(v, '$.text')::BIGINT), lambda i: {'p': '.text[' || i || ']', 't': 'text', 'i': i::INT, 'v': json_extract(v, '$.text[' || i || ']')}) ELSE [] END,
  CASE WHEN tag = 'span' THEN [{'p': '.expansion', 't': 'expansion', 'i': 0, 'v': json_extract(v, '$.expansion')}] WHEN tag = 'expansion' THEN [{'p': '.span', 't': 'span', 'i': 0, 'v': json_extract(v, '$.span')}, {'p': '.def_site_span', 't': 'span', 'i': 0, 'v': json_extract(v, '$.def_site_span')}] ELSE [] END),
  lambda k: k.v IS NOT NULL AND json_type(k.v) <> 'NULL')"""
_NODES = f"""WITH RECURSIVE m AS (SELECT DISTINCT message_id, payload::JSON AS payload FROM compiler_messages WHERE json_valid(payload)),
n AS (SELECT message_id, 'diagnostic' AS tag, 'message' AS node_path, '' AS parent_path, 0 AS ordinal, json_extract(payload, '$.message') AS v FROM m WHERE json_type(payload, '$.message') = 'OBJECT'
  UNION ALL SELECT message_id, k.t, parent || k.p, parent, k.i, k.v FROM (SELECT message_id, node_path AS parent, unnest({_KIDS}) AS k FROM n))"""


def _p2_sql(tag: str) -> str:
    """The flat table of a tag: its fields with the types of its schema, null where a value has another type."""
    cols = []
    for field in (x.strip() for x in flatten.SCHEMAS[tag].replace("struct<code string, explanation string>", "struct").split(",")):
        name, kind = field.split()
        if kind == "bigint":
            cols.append(f"CASE WHEN json_type(v, '$.{name}') IN ('UBIGINT', 'BIGINT') THEN TRY_CAST(json_extract(v, '$.{name}') AS BIGINT) END AS {name}")
        elif kind == "boolean":
            cols.append(f"CASE WHEN json_type(v, '$.{name}') = 'BOOLEAN' THEN json_extract(v, '$.{name}')::BOOLEAN END AS {name}")
        else:
            cols.append(f"json_extract_string(v, '$.{name}') AS {name}")
    return f"{_NODES} SELECT message_id, node_path, parent_path, ordinal, {', '.join(cols)} FROM n WHERE tag = '{tag}'"


#: lines of streams, and whether one is a JSON object and nothing else
_LINES = """WITH ln AS (SELECT run_id, line_no, line, CASE WHEN json_valid(line) AND NOT regexp_matches(regexp_replace(line, '"(?:[^"\\\\]|\\\\.)*"', '""', 'g'), ',\\s*[}\\]]|NaN|Infinity|/[*/]') THEN json_type(line) = 'OBJECT' ELSE false END AS good FROM (SELECT run_id, unnest(range(1, len(a) + 1)) AS line_no, regexp_replace(unnest(a), '\r$', '') AS line
  FROM (SELECT run_id, string_split(stdout, chr(10)) AS a FROM runs WHERE stdout <> '')) WHERE NOT regexp_full_match(line, '[ \t]*'))"""
_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_LOADED = """SELECT raw_id, file_name, line_no, f[1]::BIGINT AS run_id, f[2] AS coverage_kind, f[3] AS status, f[4] AS stream_parse_status, nullif(f[5], '')::BIGINT AS invalid_json_line_count, nullif(f[6], '')::INT AS exit_code, f[7]::BIGINT AS elapsed_ms,
      replace(CASE WHEN f[8][1] = '"' THEN f[8][2:-2] ELSE f[8] END, '""', '"') AS command, strptime(f[9], '%Y-%m-%dT%H:%M:%SZ') AS observed_at, nullif(f[10], '')::BOOLEAN AS clean
      FROM (SELECT raw_id, file_name, line_no, list_transform(list_zip(range(10), g), lambda x: CASE WHEN x[1] <> 7 AND x[2][1] = '"' THEN x[2][2:-2] ELSE x[2] END) AS f FROM (SELECT *, regexp_extract_all(',' || raw_line, ',("(?:[^"]|"")*"|[^",]*)', 1) AS g FROM raw_coverage)
      WHERE regexp_full_match(raw_line, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*)){9}'))
      WHERE regexp_full_match(f[1], '[0-9]+') AND TRY_CAST(f[1] AS BIGINT) IS NOT NULL AND f[2] IN ('event-stream', 'absence-clean') AND f[3] IN ('complete', 'partial', 'unavailable', 'skipped') AND f[4] IN ('complete', 'invalid-json', 'no-json-events', 'not-run', '')
        AND regexp_full_match(f[5], '[0-9]*') AND (f[5] = '' OR TRY_CAST(f[5] AS BIGINT) IS NOT NULL) AND regexp_full_match(f[6], '(?:-?[0-9]+)?') AND (f[6] = '' OR TRY_CAST(f[6] AS INT) IS NOT NULL) AND regexp_full_match(f[7], '[0-9]+') AND TRY_CAST(f[7] AS BIGINT) IS NOT NULL
        AND regexp_full_match(f[9], '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z') AND try_strptime(f[9], '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL AND f[10] IN ('true', 'false', '')"""
SQL: dict[str, str] = {
    "p2_found": f"{_NODES} SELECT message_id, node_path, parent_path FROM n",
    **{f"p2_{tag}s": _p2_sql(tag) for tag in ("span", "text", "expansion")},
    "p3_found": f"""{_LINES} SELECT DISTINCT 'runs' AS origin, run_id AS row_id, line_no, 'json' AS reason FROM ln WHERE NOT good
      UNION ALL SELECT 'raw_coverage', raw_id, line_no, CASE WHEN raw_line IS NULL THEN 'columns' WHEN NOT regexp_full_match(raw_line, '{_FIELD}(?:,{_FIELD})*') THEN 'quoting' WHEN NOT regexp_full_match(raw_line, '{_FIELD}(?:,{_FIELD}){{9}}') THEN 'columns' ELSE 'value' END
      FROM raw_coverage r WHERE NOT EXISTS (SELECT 1 FROM ({_LOADED}) l WHERE l.raw_id = r.raw_id)""",
    "p3_loaded_events": f"{_LINES} SELECT DISTINCT run_id, line_no, CASE WHEN json_type(line, '$.reason') = 'VARCHAR' THEN json_extract_string(line, '$.reason') END AS event, line FROM ln WHERE good",
    "p3_run_status": f"""{_LINES}, c AS (SELECT run_id, count(*) FILTER (good) AS events, count(*) FILTER (NOT good) AS bad FROM (SELECT DISTINCT run_id, line_no, good FROM ln) GROUP BY 1),
      s AS (SELECT run_id, max(stream_parse_status) AS recorded_status, max(invalid_json_line_count) AS recorded_bad_lines FROM runs GROUP BY 1)
      SELECT s.run_id, coalesce(events, 0) AS events, coalesce(bad, 0) AS bad_lines, recorded_status, recorded_bad_lines, CASE WHEN bad > 0 THEN 'invalid-json' WHEN events > 0 THEN 'complete' ELSE 'no-json-events' END AS status,
        coalesce(coalesce(bad, 0) = recorded_bad_lines AND recorded_status = CASE WHEN bad > 0 THEN 'invalid-json' WHEN events > 0 THEN 'complete' ELSE 'no-json-events' END, false) AS agrees FROM s LEFT JOIN c USING (run_id)""",
    "p3_loaded_coverage": _LOADED,
}

for _m in _families:
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
