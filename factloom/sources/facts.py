"""Fact relations over the test tables: one SQL text per relation, run by Spark as a plan over the source tables and by the SQL check
as a common table expression. Operators never read files; these adapters never classify.

A text names the tables and relations it reads in braces. Where the two SQL dialects differ (exploding arrays), there are two texts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..plans.session import table

_IDENT = "[A-Za-z_][A-Za-z0-9_]*"
_FUNCTION = "(?:export )?(?:async )?function " + _IDENT + "[(][^)]*[)][^{]*[{](?s:.*?)\n[}]"

_RUST_FUNCTION = "fn " + _IDENT + "[^{{{{;]*[{{{{](?s:.*?)\\n(?:    )?[}}}}]"

TEXTS: dict[str, str | tuple[str, str]] = {
    # ---- source files, each once
    "files": """
SELECT DISTINCT source_file_id AS file_id, repo, file AS path, split_part(file, '/', 1) AS submodule,
       lower(regexp_replace(file, '^.*[.]', '')) AS ext, replace(text, chr(13), '') AS text, loc, coalesce(parse_status = 'error', false) AS parse_error
FROM {source_files}""",
    # ---- dependency graph: orders of customers from suppliers; duplicates are kept and count
    "edges": """
SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, l_returnflag = 'R' AS type_only, l_linenumber AS line
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey""",
    "nodes": """
SELECT 'c' || c_custkey AS file, 'n' || c_nationkey AS submodule, CAST(round(abs(c_acctbal)) AS BIGINT) AS loc, c_acctbal < 0 AS parse_error FROM {customer}
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, CAST(round(abs(s_acctbal)) AS BIGINT), s_acctbal < 0 FROM {supplier}""",
    # ---- a sparse walk over all events: every event is an edge between two of fifty stations of two users; it has cycles and unreachable parts
    "walk": """
SELECT user_id * 50 + event_id % 50 AS src, ((user_id * 7 + event_id % 11) % (SELECT count(DISTINCT user_id) FROM {events})) * 50 + (event_id * 7 + user_id) % 50 AS dst, event_type = 'view' AS type_only FROM {events}""",
    "walk_entries": "SELECT DISTINCT user_id * 50 + event_id % 50 AS file FROM {events} WHERE user_id % 50 = 3",
    "walk_nodes": "SELECT src AS file FROM {walk} UNION SELECT dst FROM {walk}",
    # ---- definitions and their consumers
    # every part defines two names: one that all its line items consume, and one that those consume whose quantity is its size.
    # "sized" pairs all line items with all parts on two equal columns, so it is sparse without leaving a row out
    "defs": """
SELECT p_brand || '/' || p_type AS file, 'p' || p_partkey AS name, CASE p_type WHEN 'STANDARD' THEN 'TSInterfaceDeclaration' WHEN 'PROMO' THEN 'ClassDeclaration' ELSE 'FunctionDeclaration' END AS kind, p_size AS line FROM {part}
UNION ALL SELECT p_brand || '/' || p_type, 'r' || p_partkey, CASE p_type WHEN 'STANDARD' THEN 'TSTypeAliasDeclaration' ELSE 'FunctionDeclaration' END, p_size + 50 FROM {part}""",
    "sized": """
SELECT p_brand || '/' || p_type AS file, p_partkey AS part, p_size AS size, l_suppkey AS supplier, l_returnflag AS flag, l_linestatus AS status, l_discount AS discount, l_tax AS tax
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey AND p_size = l_quantity""",
    "consumers": """
SELECT p_brand || '/' || p_type AS def_file, 'p' || p_partkey AS symbol, 's' || l_suppkey AS consumer, CASE WHEN l_returnflag = 'R' THEN 'type' ELSE 'value' END AS space
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
UNION ALL SELECT file, CASE WHEN status = 'F' THEN 'r' ELSE 'q' END || part, 's' || supplier, 'value' FROM {sized}""",
    "namespace_users": "SELECT DISTINCT file AS def_file, 's' || supplier AS consumer FROM {sized} WHERE discount = 0 AND tax = 0",
    "own_uses": "SELECT file, 'r' || part AS name, count(*) AS uses FROM {sized} WHERE flag = 'N' GROUP BY 1, 2",
    # ---- functions of TypeScript and JavaScript files
    "functions": (
        f"""
SELECT file_id, path AS owner_file, regexp_extract(f, 'function ({_IDENT})', 1) AS name, f AS source,
       regexp_replace(regexp_replace(f, '^[^{{{{]*[{{{{]', ''), '[ \n]+', ' ') AS body, f LIKE '%async function%' AS is_async,
       CAST(length(f) - length(replace(f, chr(10), '')) + 1 AS BIGINT) AS body_loc, CAST(length(f) - length(replace(f, ';', '')) AS BIGINT) AS statement_count,
       CAST(CASE WHEN regexp_extract(f, '[(]([^)]*)[)]', 1) = '' THEN 0 ELSE length(regexp_extract(f, '[(]([^)]*)[)]', 1)) - length(replace(regexp_extract(f, '[(]([^)]*)[)]', 1), ',', '')) + 1 END AS BIGINT) AS param_count,
       regexp_extract(f, '[(]([^)]*)[)]', 1) AS params, path LIKE '%_gen%' AS generated
FROM (SELECT file_id, path, explode(regexp_extract_all(text, '{_FUNCTION.replace("{", "{{{{").replace("}", "}}}}")}', 0)) AS f FROM {{files}} WHERE ext IN ('ts', 'js', 'mjs'))""",
        f"""
SELECT file_id, path AS owner_file, regexp_extract(f, 'function ({_IDENT})', 1) AS name, f AS source,
       regexp_replace(regexp_replace(f, '^[^{{{{]*[{{{{]', ''), '[ \n]+', ' ', 'g') AS body, f LIKE '%async function%' AS is_async,
       CAST(length(f) - length(replace(f, chr(10), '')) + 1 AS BIGINT) AS body_loc, CAST(length(f) - length(replace(f, ';', '')) AS BIGINT) AS statement_count,
       CAST(CASE WHEN regexp_extract(f, '[(]([^)]*)[)]', 1) = '' THEN 0 ELSE length(regexp_extract(f, '[(]([^)]*)[)]', 1)) - length(replace(regexp_extract(f, '[(]([^)]*)[)]', 1), ',', '')) + 1 END AS BIGINT) AS param_count,
       regexp_extract(f, '[(]([^)]*)[)]', 1) AS params, path LIKE '%_gen%' AS generated
FROM (SELECT file_id, path, unnest(regexp_extract_all(text, '{_FUNCTION.replace("{", "{{{{").replace("}", "}}}}")}', 0)) AS f FROM {{files}} WHERE ext IN ('ts', 'js', 'mjs'))""",
    ),
    "function_facts": (
        f"""
SELECT file_id || ':' || name || ':' || row_number() OVER (PARTITION BY file_id, name ORDER BY source) AS identity, owner_file, name, body_loc, statement_count, param_count, is_async, generated,
       md5(regexp_replace(body, '[0-9]+', '0')) AS exact_hash, md5(regexp_replace(regexp_replace(body, '{_IDENT}', '@'), '[0-9]+', '0')) AS structure_hash, CASE WHEN params LIKE '%:%' THEN md5(array_join(regexp_extract_all(params, ':[ ]?([^,=]*)', 1), ',')) END AS signature_hash,
       array_distinct(regexp_extract_all(body, '({_IDENT})[(]', 1)) AS call_tokens
FROM {{functions}}""",
        f"""
SELECT file_id || ':' || name || ':' || row_number() OVER (PARTITION BY file_id, name ORDER BY source) AS identity, owner_file, name, body_loc, statement_count, param_count, is_async, generated,
       md5(regexp_replace(body, '[0-9]+', '0', 'g')) AS exact_hash, md5(regexp_replace(regexp_replace(body, '{_IDENT}', '@', 'g'), '[0-9]+', '0', 'g')) AS structure_hash, CASE WHEN params LIKE '%:%' THEN md5(array_to_string(regexp_extract_all(params, ':[ ]?([^,=]*)', 1), ',')) END AS signature_hash,
       list_distinct(regexp_extract_all(body, '({_IDENT})[(]', 1)) AS call_tokens
FROM {{functions}}""",
    ),
    # ---- functions of Rust files, at the margin or in an impl
    "rust_function_facts": (
        rf"""
SELECT file_id || ':' || name || ':' || row_number() OVER (PARTITION BY file_id, name ORDER BY f) AS identity, owner_file, name, CAST(length(f) - length(replace(f, chr(10), '')) + 1 AS BIGINT) AS body_loc,
       CAST(length(f) - length(replace(f, ';', '')) AS BIGINT) AS statement_count, owner_file LIKE '%_gen%' AS generated, md5(regexp_replace(regexp_replace(regexp_replace(body, '{_IDENT}', '@'), '[0-9]+', '0'), '[ 
]+', ' ')) AS structure_hash
FROM (SELECT file_id, path AS owner_file, f, regexp_extract(f, 'fn ({_IDENT})', 1) AS name, regexp_replace(f, '^[^{{{{]*[{{{{]', '') AS body FROM (SELECT file_id, path, explode(regexp_extract_all(text, '{_RUST_FUNCTION}', 0)) AS f FROM {{files}} WHERE ext = 'rs'))""",
        rf"""
SELECT file_id || ':' || name || ':' || row_number() OVER (PARTITION BY file_id, name ORDER BY f) AS identity, owner_file, name, CAST(length(f) - length(replace(f, chr(10), '')) + 1 AS BIGINT) AS body_loc,
       CAST(length(f) - length(replace(f, ';', '')) AS BIGINT) AS statement_count, owner_file LIKE '%_gen%' AS generated, md5(regexp_replace(regexp_replace(regexp_replace(body, '{_IDENT}', '@', 'g'), '[0-9]+', '0', 'g'), '[ 
]+', ' ', 'g')) AS structure_hash
FROM (SELECT file_id, path AS owner_file, f, regexp_extract(f, 'fn ({_IDENT})', 1) AS name, regexp_replace(f, '^[^{{{{]*[{{{{]', '') AS body FROM (SELECT file_id, path, unnest(regexp_extract_all(text, '{_RUST_FUNCTION}', 0)) AS f FROM {{files}} WHERE ext = 'rs'))""",
    ),
    # ---- type shapes: interfaces of TypeScript files with their fields
    "shapes": (
        f"""
SELECT file_id || '::' || regexp_extract(s, 'interface ({_IDENT})', 1) AS identity, path AS owner_file, regexp_extract(s, 'interface ({_IDENT})', 1) AS exported_name,
       array_sort(array_distinct(regexp_extract_all(s, '\n  (?:readonly )?({_IDENT})[?]?: [^\n]*;', 1))) AS fields, array_sort(array_distinct(regexp_extract_all(s, '\n  (?:readonly )?{_IDENT}[?]?: ([^\n]*);', 1))) AS types
FROM (SELECT file_id, path, explode(regexp_extract_all(text, 'interface {_IDENT}(?:<[^>{{{{]*>)?(?: extends [^{{{{]*)? *[{{{{][^}}}}]*[}}}}]', 0)) AS s FROM {{files}} WHERE ext = 'ts')""",
        f"""
SELECT file_id || '::' || regexp_extract(s, 'interface ({_IDENT})', 1) AS identity, path AS owner_file, regexp_extract(s, 'interface ({_IDENT})', 1) AS exported_name,
       list_sort(list_distinct(regexp_extract_all(s, '\n  (?:readonly )?({_IDENT})[?]?: [^\n]*;', 1))) AS fields, list_sort(list_distinct(regexp_extract_all(s, '\n  (?:readonly )?{_IDENT}[?]?: ([^\n]*);', 1))) AS types
FROM (SELECT file_id, path, unnest(regexp_extract_all(text, 'interface {_IDENT}(?:<[^>{{{{]*>)?(?: extends [^{{{{]*)? *[{{{{][^}}}}]*[}}}}]', 0)) AS s FROM {{files}} WHERE ext = 'ts')""",
    ),
    # ---- static imports of TypeScript and JavaScript files
    "imports": (
        """
SELECT file_id, repo, path, regexp_extract(i, ' from .([^\n]*).;$', 1) AS spec, regexp_extract(i, '^import [{{]?([^\n]*?)[}}]? from', 1) AS names
FROM (SELECT file_id, repo, path, explode(regexp_extract_all(text, 'import [^\n;]* from [^\n;]*;', 0)) AS i FROM {files} WHERE ext IN ('ts', 'js', 'mjs'))""",
        """
SELECT file_id, repo, path, regexp_extract(i, ' from .([^\n]*).;$', 1) AS spec, regexp_extract(i, '^import [{{]?([^\n]*?)[}}]? from', 1) AS names
FROM (SELECT file_id, repo, path, unnest(regexp_extract_all(text, 'import [^\n;]* from [^\n;]*;', 0)) AS i FROM {files} WHERE ext IN ('ts', 'js', 'mjs'))""",
    ),
    # ---- type escapes before and after a cut in time: a multiset of occurrences
    "escapes": """
SELECT md5('u' || user_id || '|' || event_type) AS occurrence_key, 'u' || user_id AS file, event_type AS escape_kind, event_id AS line,
       hour(ts) < 16 AS before, hour(ts) >= 8 AS after, CAST(minute(ts) AS INT) AS minute FROM {events}""",
    # ---- packages: every supplier declares the brands it delivers; line items whose quantity is the size of the part observe them
    "declarations": """
SELECT 's' || l_suppkey AS package_dir, p_brand AS dependency, p_brand AS dep_root, CASE WHEN min(l_discount) > 0.04 THEN 'peer' WHEN max(l_tax) < 0.05 THEN 'optional' ELSE 'prod' END AS section,
       min(p_size) > 10 AS script_tool, max(p_size) < 42 AS type_package FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY l_suppkey, p_brand""",
    "observed_deps": "SELECT DISTINCT 's' || supplier AS package_dir, split_part(file, '/', 1) AS dep_root FROM {sized}",
    "touches": "SELECT 'p' || l_partkey AS symbol, l_shipdate AS ts FROM {lineitem}",
    # ---- coverage: executions of definitions
    "hits": "SELECT 'p' || l_partkey AS symbol, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS hits FROM {lineitem} GROUP BY l_partkey",
    "covered_functions": "SELECT file, size - 1 AS start, size + 1 AS end_line, sum(CASE WHEN flag = 'A' THEN 1 ELSE 0 END) AS hits FROM {sized} WHERE tax = 0 GROUP BY file, size",
    "covered_statements": "SELECT file, size + 70 AS line, CASE WHEN flag = 'A' THEN 1 ELSE 0 END AS hits FROM {sized} WHERE tax = 0",
    # ---- findings, each once
    "findings": """
SELECT DISTINCT finding_id, source_file_id, oracle_id, diagnostic_code, message, parse_status, primary_span_count, action_tier FROM {semantic_findings}""",
}

TABLES = frozenset(
    "region nation customer supplier part orders lineitem events documents embeddings source_files symbol_extractions semantic_findings compiler_messages runs raw_coverage artifact_files pattern_offenders contract_fields mix_targets pack_sizes".split()
)
_NAME = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")


def fact(spark: SparkSession, sf_dir: str, name: str, _made: dict | None = None) -> DataFrame:
    """A fact relation (or a table) as a DataFrame."""
    made = {} if _made is None else _made
    if name not in made:
        if name in TABLES:
            made[name] = table(spark, sf_dir, name)
        else:
            text = TEXTS[name]
            text = text if isinstance(text, str) else text[0]
            parts = {n: fact(spark, sf_dir, n, made) for n in set(_NAME.findall(text))}
            made[name] = spark.sql(text, **parts)
    return made[name]


def _needs(text: str, out: list[str]) -> None:
    for n in sorted(set(re.findall(r"\b[a-z_]+\b", text)) & TEXTS.keys()):
        if n not in out:
            t = TEXTS[n]
            for m in sorted(set(_NAME.findall(t if isinstance(t, str) else t[1]))):
                if m in TEXTS:
                    _needs(m, out)
            out.append(n)


def sql(text: str) -> str:
    """A query for the SQL check: the relations it names become common table expressions before it."""
    names: list[str] = []
    _needs(text, names)
    ctes = []
    for n in names:
        t = TEXTS[n]
        t = t if isinstance(t, str) else t[1]
        ctes.append(f"{n} AS ({_NAME.sub(lambda m: m[1], t).replace('{{', '{').replace('}}', '}').strip()})")
    body = text.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(ctes)}, {body[5:]}"
    return f"WITH {', '.join(ctes)} {body}"
