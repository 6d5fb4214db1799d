"""Queries of the topology family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, topology
from ..sources.facts import fact, sql

RUNTIME = "coalesce(type_only, false) = false"


def fan_in(s, d):
    return topology.fan(fact(s, d, "edges"), "dst")


def fan_out(s, d):
    return topology.fan(fact(s, d, "edges"), "src")


def summary(s, d):
    return topology.summary(fact(s, d, "edges"), fact(s, d, "nodes"))


def cross(s, d):
    return topology.cross_submodule(fact(s, d, "edges"), fact(s, d, "nodes"))


def largest(s, d):
    return topology.largest_files(fact(s, d, "nodes"))


def lens(s, d):
    e = fact(s, d, "edges").groupBy("src").agg(F.count("*").alias("all_edges"), F.count_if(~F.col("type_only")).alias("runtime_edges"))
    return e.select(F.col("src").alias("file"), "all_edges", "runtime_edges", F.round(F.col("runtime_edges") / F.col("all_edges"), 3).alias("runtime_share"))


def sccs(s, d):
    return graph.component_list(graph.components(fact(s, d, "walk").where(RUNTIME)))


def scc_members(s, d):
    return graph.components(fact(s, d, "walk"))


def reach(s, d):
    """Reachability by lens: over runtime edges, over all edges, and their union."""
    walk, entries = fact(s, d, "walk"), fact(s, d, "walk_entries")
    run = graph.reachable(walk.where(RUNTIME), entries).select("file", F.lit(True).alias("runtime"))
    every = graph.reachable(walk, entries).select("file", F.lit(True).alias("any_kind"))
    return fact(s, d, "walk_nodes").join(run, "file", "left").join(every, "file", "left").na.fill(False).withColumn("unreachable", ~(F.col("runtime") | F.col("any_kind")))


def reach_depth(s, d):
    return graph.reachable(fact(s, d, "walk"), fact(s, d, "walk_entries"))


def unreachable_sccs(s, d):
    """What a reachable node leads to is reachable, so a component is so as a whole or not at all: edges to reachable nodes are left out first."""
    walk = fact(s, d, "walk")
    seen = graph.reachable(walk, fact(s, d, "walk_entries"))
    parts = graph.components(walk.where(RUNTIME).join(seen.select(F.col("file").alias("dst")), "dst", "left_anti"))
    return graph.component_list(parts, None)


def submodule_labels(s, d):
    edges, nodes = fact(s, d, "edges"), fact(s, d, "nodes")
    return topology.degree_classes(edges, nodes, nodes.where("submodule IN ('n3', 'n9')"))


def submodules(s, d):
    files = fact(s, d, "files").select("file_id", "path")
    work = s.createDataFrame([("src/api",), ("packages/web",), ("services/mail",), ("src",)], "workspace string")
    return topology.submodule_of(files, work, 4)


def entry_surface(s, d):
    f = fact(s, d, "files")
    parts = [
        f.where("path LIKE '%index.%'").select("file_id", F.lit("public").alias("source")),
        f.where("path LIKE 'cmd/%' OR path LIKE 'scripts/%'").select("file_id", F.lit("script").alias("source")),
        f.where("ext = 'json'").select("file_id", F.lit("config").alias("source")),
        f.where("path LIKE 'apps/%'").select("file_id", F.lit("framework").alias("source")),
    ]
    return topology.entry_surface(*(p.withColumnRenamed("file_id", "file") for p in parts)).withColumnRenamed("file", "file_id")


QUERIES = {
    "topology_fan_in_top": fan_in,
    "topology_fan_out_top": fan_out,
    "topology_summary": summary,
    "topology_cross_submodule": cross,
    "topology_largest_files": largest,
    "topology_lens": lens,
    "topology_scc_top": sccs,
    "topology_scc_members": scc_members,
    "reachability": reach,
    "reachability_depth": reach_depth,
    "reachability_unreachable_sccs": unreachable_sccs,
    "topology_submodule_labels": submodule_labels,
    "submodule_of_path": submodules,
    "entry_surface": entry_surface,
}

_PAIRS = """
pairs AS (SELECT a.submodule AS from_module, b.submodule AS to_module, count(*) AS n FROM edges JOIN nodes a ON a.file = src JOIN nodes b ON b.file = dst WHERE a.submodule <> b.submodule GROUP BY 1, 2)"""
_CLOSURE = """
reach_all AS (SELECT file AS v FROM walk_entries UNION SELECT dst FROM walk JOIN reach_all ON v = src),
reach_run AS (SELECT file AS v FROM walk_entries UNION SELECT dst FROM walk JOIN reach_run ON v = src WHERE NOT type_only)"""


def _scc(where: str) -> str:
    return f"""
rt AS (SELECT DISTINCT src, dst FROM walk WHERE src <> dst {where}),
pair AS (SELECT src AS a, dst AS b FROM rt UNION SELECT a, dst FROM pair JOIN rt ON b = src),
scc AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM pair x JOIN pair y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)"""


def _rec(text: str) -> str:
    out = sql("WITH " + text)
    return "WITH RECURSIVE " + out[5:]


SQL = {
    "topology_fan_in_top": sql("SELECT dst AS file, count(*) AS n FROM edges GROUP BY dst ORDER BY n DESC, file LIMIT 15"),
    "topology_fan_out_top": sql("SELECT src AS file, count(*) AS n FROM edges GROUP BY src ORDER BY n DESC, file LIMIT 15"),
    "topology_summary": sql(
        """SELECT * FROM (SELECT count(*) AS files, coalesce(sum(loc), 0)::BIGINT AS total_loc, round(sum(loc) / count(*), 2) AS mean_loc, count(*) FILTER (parse_error OR loc IS NULL) AS parse_errors FROM nodes),
        (SELECT count(*) AS internal_edges, count(*) FILTER (type_only) AS type_only_edges, count(*) FILTER (NOT type_only) AS runtime_edges FROM edges)"""
    ),
    "topology_cross_submodule": sql(f"WITH {_PAIRS} SELECT from_module, to_module, n FROM pairs ORDER BY n DESC, from_module, to_module LIMIT 30"),
    "topology_largest_files": sql("SELECT file, loc, loc >= 1000 AS oversize FROM nodes WHERE loc >= 400 ORDER BY loc DESC, file LIMIT 20"),
    "topology_lens": sql("SELECT src AS file, count(*) AS all_edges, count(*) FILTER (NOT type_only) AS runtime_edges, round(count(*) FILTER (NOT type_only) / count(*), 3) AS runtime_share FROM edges GROUP BY src"),
    "topology_scc_top": _rec(_scc("AND NOT type_only") + " SELECT component, count(*) AS size FROM scc GROUP BY 1 ORDER BY size DESC, component LIMIT 10"),
    "topology_scc_members": _rec(_scc("") + " SELECT node, component FROM scc"),
    "reachability": _rec(
        _CLOSURE
        + """ SELECT file, r.v IS NOT NULL AS runtime, a.v IS NOT NULL AS any_kind, r.v IS NULL AND a.v IS NULL AS unreachable FROM walk_nodes
        LEFT JOIN reach_run r ON r.v = file LEFT JOIN reach_all a ON a.v = file"""
    ),
    "reachability_depth": _rec("r AS (SELECT file AS v, 0 AS k FROM walk_entries UNION SELECT dst, k + 1 FROM walk JOIN r ON v = src WHERE k < 150) SELECT v AS file, min(k) AS depth FROM r GROUP BY v"),
    "reachability_unreachable_sccs": _rec(
        _CLOSURE + "," + _scc("AND NOT type_only") + """ SELECT component, count(*) AS size FROM scc GROUP BY 1 HAVING count(*) FILTER (node IN (SELECT v FROM reach_all)) = 0"""
    ),
    "topology_submodule_labels": sql(
        f"""WITH {_PAIRS},
        i AS (SELECT to_module AS submodule, count(*) AS fan_in FROM pairs GROUP BY 1), o AS (SELECT from_module AS submodule, count(*) AS fan_out FROM pairs GROUP BY 1),
        m AS (SELECT submodule, count(*) AS files, max(loc) AS largest FROM nodes GROUP BY 1)
        SELECT submodule, files, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out,
          CASE WHEN submodule IN ('n3', 'n9') THEN 'cyclic-submodule' WHEN fan_in IS NULL AND fan_out IS NULL THEN 'isolated-submodule' WHEN fan_in >= 5 THEN 'shared-submodule' WHEN fan_out IS NULL THEN 'leaf-submodule' ELSE 'scoped-submodule' END AS label,
          largest >= 1000 AS oversize
        FROM m LEFT JOIN i USING (submodule) LEFT JOIN o USING (submodule)"""
    ),
    "submodule_of_path": sql(
        """SELECT file_id, path, CASE WHEN path LIKE 'src/api/%' THEN 'src/api' WHEN path LIKE 'packages/web/%' THEN 'packages/web' WHEN path LIKE 'services/mail/%' THEN 'services/mail' WHEN path LIKE 'src/%' THEN 'src'
        WHEN path NOT LIKE '%/%' THEN 'root' WHEN regexp_matches(path, '^(apps|packages)/[^/]*/') THEN regexp_extract(path, '^[^/]*/[^/]*') ELSE split_part(path, '/', 1) END AS submodule FROM files"""
    ),
    "entry_surface": sql(
        """SELECT file_id, min(source) AS source, count(DISTINCT source) AS sources FROM (
        SELECT file_id, 'public' AS source FROM files WHERE path LIKE '%index.%' UNION ALL SELECT file_id, 'script' FROM files WHERE path LIKE 'cmd/%' OR path LIKE 'scripts/%'
        UNION ALL SELECT file_id, 'config' FROM files WHERE ext = 'json' UNION ALL SELECT file_id, 'framework' FROM files WHERE path LIKE 'apps/%') GROUP BY 1"""
    ),
}
