"""Queries of the symbol family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import symbols
from ..sources.facts import fact, sql

NOW = "2000-01-01 00:00:00"
IDENT = "[A-Za-z_][A-Za-z0-9_]*"


def fan_in(s, d):
    return symbols.fan_in(fact(s, d, "defs"), fact(s, d, "consumers"), fact(s, d, "namespace_users"))


def fan_in_top(s, d):
    return fan_in(s, d).orderBy(F.col("fan_in").desc(), "file", "name").limit(50)


def dead(s, d):
    barrels = fact(s, d, "defs").where("file LIKE 'Brand#11/%'").select("file").distinct()
    return symbols.dead_candidates(fact(s, d, "defs"), fact(s, d, "consumers"), fact(s, d, "namespace_users"), barrels)


def dead_classes(s, d):
    j = dead(s, d).join(fact(s, d, "own_uses"), ["file", "name"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    return j.select("file", "name", "uses", symbols.dead_category(F.col("uses")).alias("category"))


def internal_uses(s, d):
    defs = fact(s, d, "functions").select("file_id", "name").distinct()
    return symbols.internal_uses(defs, fact(s, d, "files"))


def unused_deps(s, d):
    return symbols.unused_dependencies(fact(s, d, "declarations"), fact(s, d, "observed_deps"))


def unused_deps_summary(s, d):
    return unused_deps(s, d).groupBy("status", "reason").agg(F.count("*").alias("n"))


def staleness(s, d):
    return symbols.staleness(fact(s, d, "defs"), fact(s, d, "touches"), NOW)


def runtime(s, d):
    return symbols.runtime_evidence(fact(s, d, "defs"), fact(s, d, "covered_statements"), fact(s, d, "covered_functions").withColumnRenamed("end_line", "end"))


def packages(s, d):
    """The deepest directory with a JSON file around every source file."""
    f = fact(s, d, "files").select("repo", "path")
    folders = f.where("path LIKE '%.json'").select("repo", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("package_dir"))
    tops = folders.select("repo", F.split("package_dir", "/")[0].alias("package_dir"))
    return symbols.containing_package(f, folders.unionByName(tops))


def _calls(s, d):
    f = fact(s, d, "functions")
    return f.select(F.col("file_id").alias("caller_file"), F.explode(F.regexp_extract_all("body", F.lit(f"({IDENT})[(]"), F.lit(1))).alias("callee"))


def _callees(s, d):
    return fact(s, d, "functions").select("name", F.col("file_id").alias("file")).distinct()


def call_graph(s, d):
    return symbols.call_graph(_calls(s, d), _callees(s, d))


def call_fan_in(s, d):
    return symbols.callee_fan_in(_callees(s, d), call_graph(s, d))


def top_callees(s, d):
    g = call_graph(s, d).groupBy("callee").agg(F.sum("calls").alias("calls"), F.count_distinct("from_file").alias("files"))
    return g.orderBy(F.col("calls").desc(), "callee").limit(100)


def call_breakdown(s, d):
    return call_graph(s, d).groupBy("outcome").agg(F.count("*").alias("edges"), F.sum("calls").alias("calls"))


def owner_calls(s, d):
    """Calls of methods by owner: nested counts, one map per owner."""
    m = fact(s, d, "functions").select(F.explode(F.regexp_extract_all("body", F.lit(f"({IDENT}[.]{IDENT})[(]"), F.lit(1))).alias("m"))
    parts = F.split("m", "[.]")
    per = m.groupBy(parts[0].alias("owner"), parts[1].alias("method")).agg(F.count("*").alias("n"))
    maps = per.groupBy("owner").agg(F.sum("n").alias("calls"), F.array_sort(F.collect_list(F.concat("method", F.lit("="), F.col("n").cast("string")))).alias("methods"))
    return maps.select("owner", "calls", F.array_join("methods", ",").alias("methods"))


def semi_dead(s, d):
    i = fact(s, d, "imports").select("file_id", F.explode(F.regexp_extract_all("names", F.lit(f"({IDENT})"), F.lit(1))).alias("name"))
    return symbols.semi_dead_imports(i, fact(s, d, "files"))


QUERIES = {
    "symbol_fan_in": fan_in,
    "symbol_fan_in_top": fan_in_top,
    "dead_export_candidates": dead,
    "dead_classification": dead_classes,
    "file_internal_uses": internal_uses,
    "unused_dependencies": unused_deps,
    "unused_dependencies_summary": unused_deps_summary,
    "staleness_tiers": staleness,
    "runtime_evidence": runtime,
    "call_graph": call_graph,
    "call_fan_in": call_fan_in,
    "call_top_callees": top_callees,
    "call_resolution_breakdown": call_breakdown,
    "call_owner_methods": owner_calls,
    "semi_dead_imports": semi_dead,
    "package_containment": packages,
}

_DEAD = """
dead AS (SELECT d.file, d.name, d.kind, d.line, n.def_file IS NOT NULL AS namespace_shadowed, n.def_file IS NULL AS truly_dead FROM defs d
  LEFT JOIN (SELECT DISTINCT def_file FROM namespace_users) n ON n.def_file = d.file
  WHERE d.file NOT LIKE 'Brand#11/%' AND NOT EXISTS (SELECT 1 FROM consumers c WHERE c.def_file = d.file AND c.symbol = d.name))"""
_FAN = """
fan AS (SELECT coalesce(k.file, c.def_file) AS file, coalesce(k.name, c.symbol) AS name, coalesce(k.kind, 'unknown') AS kind, coalesce(c.f, 0) AS fan_in, coalesce(c.v, 0) AS value_fan_in, coalesce(c.t, 0) AS type_fan_in,
  coalesce(b.n, 0) AS broad_fan_in
  FROM (SELECT file, name, min(kind) AS kind FROM defs GROUP BY 1, 2) k
  FULL JOIN (SELECT def_file, symbol, count(DISTINCT consumer) AS f, count(DISTINCT CASE WHEN space <> 'type' THEN consumer END) AS v, count(DISTINCT CASE WHEN space = 'type' THEN consumer END) AS t FROM consumers GROUP BY 1, 2) c
    ON k.file = c.def_file AND k.name = c.symbol
  LEFT JOIN (SELECT def_file, count(DISTINCT consumer) AS n FROM namespace_users GROUP BY 1) b ON b.def_file = coalesce(k.file, c.def_file))"""
_DEPS = """
deps AS (SELECT package_dir, dependency, CASE WHEN o.dep_root IS NOT NULL THEN 'import-consumer' WHEN script_tool THEN 'script-tool' WHEN section = 'peer' THEN 'peer-dependency' WHEN section = 'optional' THEN 'optional-dependency'
  WHEN type_package THEN 'type-package' ELSE 'no-observed-consumer' END AS reason FROM declarations LEFT JOIN observed_deps o USING (package_dir, dep_root)),
st AS (SELECT package_dir, dependency, CASE reason WHEN 'import-consumer' THEN 'used' WHEN 'no-observed-consumer' THEN 'review-unused' ELSE 'muted' END AS status, reason FROM deps)"""
_CALLS = f"""
calls AS (SELECT file_id AS caller_file, unnest(regexp_extract_all(body, '({IDENT})[(]', 1)) AS callee FROM functions),
one AS (SELECT name, min(file_id) AS to_file FROM functions GROUP BY name HAVING count(DISTINCT file_id) = 1),
graph AS (SELECT caller_file AS from_file, to_file, callee, count(*) AS calls, CASE WHEN to_file IS NULL THEN 'unresolved' WHEN to_file = caller_file THEN 'internal-same-file' ELSE 'internal' END AS outcome
  FROM calls LEFT JOIN one ON one.name = callee GROUP BY ALL)"""

SQL = {
    "symbol_fan_in": sql(f"WITH {_FAN} SELECT * FROM fan"),
    "symbol_fan_in_top": sql(f"WITH {_FAN} SELECT * FROM fan ORDER BY fan_in DESC, file, name LIMIT 50"),
    "dead_export_candidates": sql(f"WITH {_DEAD} SELECT * FROM dead"),
    "dead_classification": sql(
        f"""WITH {_DEAD} SELECT file, name, coalesce(uses, 0) AS uses, CASE WHEN coalesce(uses, 0) = 0 THEN 'C' WHEN uses <= 2 THEN 'A' ELSE 'B' END AS category FROM dead LEFT JOIN own_uses USING (file, name)"""
    ),
    "file_internal_uses": sql(f"WITH w AS (SELECT file_id, unnest(regexp_extract_all(text, '{symbols.IDENTIFIER}')) AS name FROM files) SELECT f.file_id, f.name, greatest(0, (SELECT count(*) FROM w WHERE w.file_id = f.file_id AND w.name = f.name) - 1) AS uses FROM (SELECT DISTINCT file_id, name FROM functions) f"),
    "unused_dependencies": sql(f"WITH {_DEPS} SELECT * FROM st"),
    "unused_dependencies_summary": sql(f"WITH {_DEPS} SELECT status, reason, count(*) AS n FROM st GROUP BY 1, 2"),
    "staleness_tiers": sql(
        f"""SELECT file, name, a AS age_days, CASE WHEN a IS NULL THEN 'unknown' WHEN a >= 365 THEN 'fossil' WHEN a >= 90 THEN 'stale' ELSE 'recent' END AS tier
        FROM (SELECT file, name, floor((epoch(TIMESTAMP '{NOW}') - epoch(ts)) / 86400)::BIGINT AS a FROM defs LEFT JOIN (SELECT symbol, max(ts) AS ts FROM touches GROUP BY 1) ON symbol = name)"""
    ),
    "runtime_evidence": sql(
        """WITH pt AS (SELECT DISTINCT file, line FROM defs), own AS (SELECT p.file, p.line, arg_min(f.hits, (end_line - start, start)) AS hits FROM pt p JOIN covered_functions f ON f.file = p.file AND p.line BETWEEN start AND end_line GROUP BY 1, 2),
        near AS (SELECT p.file, p.line, sum(t.hits) AS hits FROM pt p JOIN covered_statements t ON t.file = p.file AND abs(t.line - p.line) <= 50 GROUP BY 1, 2),
        j AS (SELECT d.file, name, kind, d.file IN (SELECT file FROM covered_statements) AS covered, coalesce(own.hits, near.hits, 0) AS hits FROM defs d LEFT JOIN own USING (file, line) LEFT JOIN near USING (file, line))
        SELECT file, name, CASE WHEN kind IN ('TSInterfaceDeclaration', 'TSTypeAliasDeclaration', 'TSModuleDeclaration') THEN 'type-only' WHEN NOT covered THEN 'uncovered' WHEN hits > 0 THEN 'executed' ELSE 'dead-confirmed' END AS status,
          CASE WHEN kind IN ('TSInterfaceDeclaration', 'TSTypeAliasDeclaration', 'TSModuleDeclaration') OR NOT covered THEN 'medium' WHEN hits > 0 THEN 'low' ELSE 'high' END AS confidence FROM j"""
    ),
    "call_graph": sql(f"WITH {_CALLS} SELECT * FROM graph"),
    "call_fan_in": sql(f"WITH {_CALLS} SELECT f.name, count(DISTINCT from_file) AS callers, coalesce(sum(calls), 0)::BIGINT AS calls FROM (SELECT DISTINCT name FROM functions) f LEFT JOIN graph ON callee = f.name AND to_file IS NOT NULL GROUP BY 1"),
    "call_top_callees": sql(f"WITH {_CALLS} SELECT callee, count(*) AS calls, count(DISTINCT caller_file) AS files FROM calls GROUP BY 1 ORDER BY calls DESC, callee LIMIT 100"),
    "call_resolution_breakdown": sql(f"WITH {_CALLS} SELECT outcome, count(*) AS edges, sum(calls)::BIGINT AS calls FROM graph GROUP BY 1"),
    "call_owner_methods": sql(
        f"""WITH m AS (SELECT unnest(regexp_extract_all(body, '({IDENT}[.]{IDENT})[(]', 1)) AS m FROM functions), per AS (SELECT split_part(m, '.', 1) AS owner, split_part(m, '.', 2) AS method, count(*) AS n FROM m GROUP BY 1, 2)
        SELECT owner, sum(n)::BIGINT AS calls, string_agg(method || '=' || n, ',' ORDER BY method || '=' || n) AS methods FROM per GROUP BY 1"""
    ),
    "package_containment": sql(
        """WITH j AS (SELECT DISTINCT repo, regexp_extract(path, '^(.*)/[^/]*$', 1) AS p FROM files WHERE path LIKE '%.json'), k AS (SELECT repo, p FROM j UNION SELECT repo, split_part(p, '/', 1) FROM j)
        SELECT f.repo, f.path, arg_max(p, length(p)) AS package_dir FROM (SELECT DISTINCT repo, path FROM files) f LEFT JOIN k ON k.repo = f.repo AND (p = '' OR starts_with(path, p || '/')) GROUP BY 1, 2"""
    ),
    "semi_dead_imports": sql(
        f"""WITH i AS (SELECT DISTINCT file_id, name FROM (SELECT file_id, unnest(regexp_extract_all(names, '({IDENT})', 1)) AS name FROM imports))
        SELECT file_id, name FROM i JOIN files USING (file_id) WHERE len(list_filter(regexp_extract_all(text, '"""
        + symbols.IDENTIFIER
        + """'), lambda w: w = name)) <= 1"""
    ),
}
