"""Queries of the extraction, resolution, lookup and drift families."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import deltas, graph, ranking
from ..sources import extract
from ..sources.facts import fact, sql

ALIASES = (("./record", "src/core/record"), ("./m*", "packages/m*"), ("./ma*", "packages/shared/ma*"), ("@/*", "src/*"))
ID = extract.ID
#: files observed before are those seen first
FIRST_HALF = "2025-08-17 00:00:00"


def _defs(language):
    return lambda s, d: extract.definitions(fact(s, d, "files"), language)


def uses(s, d):
    return extract.uses(fact(s, d, "files"))


def outcomes(s, d):
    from .q_text import resolved

    r = resolved(s, d).select("file_id", "spec", "target")
    u = uses(s, d).join(r, ["file_id", "spec"], "left")
    return u.groupBy("kind", extract.outcome(F.col("kind"), F.col("spec"), F.col("target")).alias("outcome")).agg(F.count("*").alias("n"))


def aliases(s, d):
    a = s.createDataFrame(list(ALIASES), "pattern string, target string")
    i = fact(s, d, "imports").select("spec")
    return extract.resolve_aliases(i.where("spec LIKE './%'").select(F.col("spec")).unionByName(i.select(F.regexp_replace("spec", "^[.]/", "@/").alias("spec"))), a).where("stage <> 'relative'")


def rust_unused(s, d):
    f = fact(s, d, "files").where("ext = 'rs' AND text IS NOT NULL")
    words = f.select("file_id", F.col("path").contains("test").alias("is_test"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("word")).groupBy("file_id", "is_test", "word").agg(F.count("*").alias("n"))
    return extract.unused_by_name(extract.definitions(f, "rs").where("kind <> 'impl'"), words)


def reexports(s, d):
    """Final owner of every name that is handed on: the end of each chain of parts of one brand, by size."""
    p = fact(s, d, "part").select("p_partkey", "p_brand", "p_size").where("p_brand IS NOT NULL")
    link = p.where("p_size <= 25").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") - F.col("p_size")).alias("dst")).where("dst >= 0")
    return graph.chain_ends(link).select(F.col("src").alias("name"), F.col("end").alias("owner"), F.col("steps").cast("int").alias("steps"))


def taints(s, d):
    """Taints of findings: blocking where the defining file does not parse, soft for missing evidence; confidence by the worst."""
    bad = fact(s, d, "files").select(F.col("file_id").alias("source_file_id"), "parse_error")
    f = fact(s, d, "findings").join(bad, "source_file_id", "left")
    t = F.array_compact(F.array(F.when(F.col("parse_error"), "defining-file-parse-error"), F.when(F.col("source_file_id").isNull(), "no-file"), F.when(F.col("message").isNull(), "no-message"), F.when(F.col("primary_span_count") == 0, "no-span")))
    conf = F.when(F.col("parse_error") | F.col("source_file_id").isNull(), "low").when(F.size(t) > 0, "medium").otherwise("high")
    return f.select("finding_id", F.array_join(t, ",").alias("taints"), conf.alias("confidence"))


def helper_labels(s, d):
    """Labels of helper functions by callers: central, shared, or local; names of several owners are flagged first."""
    from .q_symbols import call_graph

    g = call_graph(s, d).groupBy(F.col("callee").alias("name")).agg(F.count_distinct("from_file").alias("callers"))
    f = fact(s, d, "functions").groupBy("name").agg(F.count_distinct("file_id").alias("owners")).join(g, "name", "left").fillna({"callers": 0})
    label = F.when(F.col("owners") > 1, "HELPER_COLLISION").when(F.col("callers") >= 3, "central-helper").when(F.col("callers") >= 1, "shared-helper").otherwise("zero-internal-fan-in-helper")
    return f.select("name", "owners", "callers", label.alias("label"))


def naming_drift(s, d):
    """Convention of every cohort in the files seen first against all of them: shifted, appeared, vanished."""
    items = fact(s, d, "files").select(F.concat("submodule", F.lit(":"), "ext").alias("cohort"), text.basename(F.col("path")).alias("name"), "file_id")
    seen = fact(s, d, "source_files").groupBy(F.col("source_file_id").alias("file_id")).agg((F.min("observed_at") < F.lit(FIRST_HALF).cast("timestamp")).alias("early"))
    items = items.join(seen, "file_id").drop("file_id")
    old, new = text.dominance(items.where("early")), text.dominance(items.where("NOT early"))
    j = old.select("cohort", F.col("dominant").alias("before"), F.lit(True).alias("o")).join(new.select("cohort", F.col("dominant").alias("after"), F.lit(True).alias("n")), "cohort", "full_outer")
    drift = F.when(F.col("o").isNull(), "cohort-added").when(F.col("n").isNull(), "cohort-removed").when(~F.col("before").eqNullSafe(F.col("after")), "convention-shift").otherwise("same")
    return j.select("cohort", "before", "after", drift.alias("drift"))


def topology_drift(s, d):
    """Edges between submodules that come and go between the type-only and the runtime view of the graph."""
    from ..operators.topology import cross_submodule

    n, e = fact(s, d, "nodes"), fact(s, d, "edges")
    old = cross_submodule(e.where("type_only"), n, None).select(F.concat_ws("->", "from_module", "to_module").alias("name"), F.lit("edge").alias("owner"), F.when(F.col("n") >= 20, "strong").otherwise("weak").alias("label"))
    new = cross_submodule(e.where("NOT type_only"), n, None).select(F.concat_ws("->", "from_module", "to_module").alias("name"), F.lit("edge").alias("owner"), F.when(F.col("n") >= 50, "strong").otherwise("weak").alias("label"))
    return deltas.canon_drift(old, new).groupBy("drift").agg(F.count("*").alias("n"))


def shape_lookup(s, d):
    """Every shape looked up by the hash of its fields among those of other repositories."""
    f = fact(s, d, "shapes").withColumn("hash", F.md5(F.array_join("fields", "|")))
    n = f.groupBy("hash").agg(F.count("*").alias("n"), F.count_distinct("owner_file").alias("files"))
    return f.join(n, "hash").select("identity", F.when(F.size("fields") == 0, "UNAVAILABLE").when(F.col("files") > 1, "SHAPE_MATCH").otherwise("NOT_OBSERVED").alias("result"))


def cues(s, d):
    """One cue per name from several lanes: the strongest tier, its lane, and how many lanes agree."""
    lanes = [
        fact(s, d, "functions").select("name", F.lit("exact-name").alias("lane"), F.lit(1).alias("rank")),
        fact(s, d, "function_facts").where("body_loc >= 8").select("name", F.lit("large-body").alias("lane"), F.lit(2).alias("rank")),
        fact(s, d, "function_facts").where("is_async").select("name", F.lit("async").alias("lane"), F.lit(3).alias("rank")),
    ]
    u = ranking.sarif(*lanes).distinct().groupBy("name").agg(F.min(F.struct("rank", "lane")).alias("b"), F.count("*").alias("lanes"))
    tier = F.when(F.col("lanes") >= 2, "SAFE").when(F.col("b.rank") == 1, "AGENT_REVIEW").otherwise("MUTED")
    return u.select("name", "b.lane", "lanes", tier.alias("tier"))


def framework_lanes(s, d):
    """Lane of every file by its place, grounded where the nearest package of the file declares the framework."""
    f = fact(s, d, "files").select("file_id", "repo", "path", "submodule")
    lane = F.when(F.col("path").rlike("^apps/"), "application").when(F.col("path").rlike("^(cmd|scripts)/"), "command").when(F.col("path").rlike("^tests/"), "test").when(F.col("path").rlike("^examples/"), "scaffold").otherwise("library")
    owns = f.where("path LIKE '%.json'").groupBy("repo", "submodule").agg(F.count("*").alias("manifests"))
    return f.withColumn("lane", lane).join(owns, ["repo", "submodule"], "left").groupBy("lane").agg(F.count("*").alias("files"), F.count("manifests").alias("grounded"))


def artifact_latest(s, d):
    """Newest artifact of every feed, with the fields a summary needs; missing ones stay null."""
    a = fact(s, d, "artifact_files").select("artifact_id", "feed_id", "producer", "written_at", "payload").distinct()
    n = a.groupBy("feed_id", "producer").agg(F.max_by(F.struct("artifact_id", "payload"), "written_at").alias("x"))
    return n.select("feed_id", "producer", "x.artifact_id", F.get_json_object("x.payload", "$.summary.files").try_cast("bigint").alias("files"), F.get_json_object("x.payload", "$.meta.tool").alias("tool"))


def artifact_sizes(s, d):
    a = fact(s, d, "artifact_files").select("artifact_id", "producer", "payload").distinct()
    return a.groupBy("producer").agg(F.count("*").alias("artifacts"), F.sum(F.octet_length("payload")).alias("bytes"), F.max(F.octet_length("payload")).alias("largest"))


def extraction_errors(s, d):
    """Recorded parse errors of extractions against the status of the files: agreement per repo."""
    e = fact(s, d, "symbol_extractions")
    ids = e.select("repo", "extraction_id", F.explode("file_ids").alias("file_id"), F.coalesce("parse_error_file_ids", F.array().cast("array<bigint>")).alias("bad"))
    flagged = ids.select("repo", "file_id", F.array_contains("bad", F.col("file_id")).alias("flagged"))
    f = fact(s, d, "files").select("file_id", "parse_error")
    return flagged.join(f, "file_id").groupBy("repo").agg(F.count("*").alias("files"), F.count_if("flagged").alias("flagged"), F.count_if(F.col("flagged") & F.col("parse_error")).alias("both"))


def supports(s, d):
    """Evidence for removing a definition: unreachable from entries, and no observed caller; absent evidence is null."""
    walk = fact(s, d, "walk")
    seen = graph.reachable(walk, fact(s, d, "walk_entries")).select("file", F.lit(True).alias("r"))
    called = walk.groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("callers"))
    n = fact(s, d, "walk_nodes").join(seen, "file", "left").join(called, "file", "left")
    return n.select("file", F.col("r").isNull().alias("entry_unreachable"), F.col("callers").isNull().alias("no_observed_callers"), F.when(F.col("r").isNull() & F.col("callers").isNull(), "high").when(F.col("r").isNull() | F.col("callers").isNull(), "medium").otherwise("none").alias("support"))


def pattern_totals(s, d):
    """Offenders per repo and pattern, repeats once: totals and the share of the worst file."""
    p = fact(s, d, "pattern_offenders").select("offender_id", "repo", "pattern", "file", "offender_count").distinct()
    f = p.groupBy("repo", "pattern", "file").agg(F.sum("offender_count").alias("n"))
    g = f.groupBy("repo", "pattern").agg(F.sum("n").alias("total"), F.count("*").alias("files"), F.max("n").alias("worst"))
    return g.select("repo", "pattern", "total", "files", F.round(F.try_divide("worst", "total"), 4).alias("worst_share"))


def finding_projection(s, d):
    """Findings per file with their recorded status, files without findings included."""
    f = fact(s, d, "findings").where("source_file_id IS NOT NULL").groupBy(F.col("source_file_id").alias("file_id")).agg(F.count("*").alias("findings"), F.sum("primary_span_count").alias("spans"), F.count_if(F.col("parse_status") == "error").alias("errors"))
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("findings", "spans", "errors")]
    return fact(s, d, "files").select("file_id").join(f, "file_id", "left").select("file_id", *zero)


def rollup(s, d):
    """Beyond the reference: totals by repo and language with subtotals."""
    f = fact(s, d, "files")
    return f.rollup("submodule", "ext").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.grouping_id().alias("level"))


def first_seen(s, d):
    """First delivery of every offender's file per repo, by arrival and id."""
    w = Window.partitionBy("repo", "file").orderBy("ingested_at", "offender_id")
    p = fact(s, d, "pattern_offenders").select("repo", "file", "offender_id", "ingested_at").withColumn("r", F.row_number().over(w))
    return p.where("r = 1").select("repo", "file", "offender_id")


QUERIES = {
    "js_definitions": _defs("js"),
    "rust_definitions": _defs("rs"),
    "go_definitions": _defs("go"),
    "js_uses": uses,
    "edge_outcomes": outcomes,
    "alias_resolution": aliases,
    "rust_unused_definitions": rust_unused,
    "reexport_owners": reexports,
    "finding_taints": taints,
    "canon_helper_labels": helper_labels,
    "naming_drift": naming_drift,
    "topology_drift": topology_drift,
    "shape_lookup": shape_lookup,
    "cue_tiers": cues,
    "framework_lanes": framework_lanes,
    "artifact_latest": artifact_latest,
    "artifact_sizes": artifact_sizes,
    "extraction_errors": extraction_errors,
    "evidence_supports": supports,
    "pattern_totals": pattern_totals,
    "finding_projection": finding_projection,
    "language_rollup": rollup,
    "offender_first_seen": first_seen,
}

_LINES = "ln AS (SELECT file_id, ext, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS body FROM files)"


def _def_sql(language: str) -> str:
    exts = ", ".join(f"'{e}'" for e, lang in extract.LANGUAGE.items() if lang == language)
    rules = extract.DEFINITIONS[language]
    name = "CASE " + " ".join(f"WHEN regexp_matches(body, '{rx}') THEN regexp_extract(body, '{rx}', 1)" for _, rx in rules) + " END"
    kind = "CASE " + " ".join(f"WHEN regexp_matches(body, '{rx}') THEN '{k}'" for k, rx in rules) + " END"
    public = {"js": "starts_with(body, 'export ')", "rs": "starts_with(ltrim(body, ' '), 'pub ')", "go": "regexp_matches(name, '^[A-Z]')"}[language]
    return f"{_LINES}, df_{language} AS (SELECT *, {public} AS exported FROM (SELECT file_id, line, body, {name} AS name, {kind} AS kind FROM ln WHERE ext IN ({exts})) WHERE kind IS NOT NULL)"


_USES = f"""{_LINES}, us AS (SELECT file_id, line, regexp_extract(body, '(?:from |import |import[(]|require[(])[''"]([^''"]*)[''"]', 1) AS spec, CASE WHEN regexp_matches(body, '^export [*] from ') THEN 'reExportAll' WHEN regexp_matches(body, '^export [{{][^}}]*[}}] from ') THEN 'reExportNamed'
  WHEN regexp_matches(body, '^import type ') THEN 'import-type' WHEN regexp_matches(body, '^import [*] as ') THEN 'namespace' WHEN regexp_matches(body, '^import [{{]') THEN 'import' WHEN regexp_matches(body, '^import [''"]') THEN 'import-side-effect'
  WHEN regexp_matches(body, '^import {ID}') THEN 'default' WHEN regexp_matches(body, '(^|[^A-Za-z0-9_.])import[(][''"]') THEN 'dynamic-literal' WHEN regexp_matches(body, '(^|[^A-Za-z0-9_.])import[(]') THEN 'dynamic-opaque' WHEN regexp_matches(body, '(^|[^A-Za-z0-9_.])require[(]') THEN 'require' END AS kind FROM ln WHERE ext IN ('ts', 'js', 'mjs'))"""
_OUT = """CASE WHEN kind = 'dynamic-opaque' THEN 'opaque' WHEN regexp_matches(u.spec, '^(node:|https?:)') THEN 'external' WHEN NOT starts_with(u.spec, '.') AND NOT regexp_matches(u.spec, '^[@~]/') THEN 'external'
 WHEN regexp_matches(u.spec, '[.](css|svg|png|json)$') THEN 'non-source-asset' WHEN target IS NOT NULL THEN 'internal' ELSE 'unresolved' END"""


def _more() -> dict[str, str]:
    from .q_symbols import _CALLS
    from .q_text import _BASE, _CONV, _RES

    def dom(name: str, where: str) -> str:
        return f"""c_{name} AS (SELECT cohort, {_CONV} AS c, count(*) AS n FROM it WHERE {where} GROUP BY 1, 2), b_{name} AS (SELECT cohort, sum(n)::BIGINT AS m, max(n) FILTER (c <> 'mixed') AS top FROM c_{name} GROUP BY 1),
        d_{name} AS (SELECT cohort, CASE WHEN m >= 3 AND top / m >= 0.6 THEN (SELECT min(c) FROM c_{name} x WHERE x.cohort = b.cohort AND c <> 'mixed' AND n = top) END AS dominant FROM b_{name} b)"""

    cross = "SELECT a.submodule || '->' || b.submodule AS name, CASE WHEN count(*) >= {k} THEN 'strong' ELSE 'weak' END AS label FROM edges JOIN nodes a ON a.file = src JOIN nodes b ON b.file = dst WHERE a.submodule <> b.submodule AND {w} GROUP BY 1"
    return {
        "edge_outcomes": sql(f"WITH {_RES}, {_USES} SELECT kind, {_OUT} AS outcome, count(*) AS n FROM us u LEFT JOIN rs ON rs.file_id = u.file_id AND rs.spec = u.spec WHERE kind IS NOT NULL GROUP BY 1, 2"),
        "canon_helper_labels": sql(
            f"""WITH {_CALLS}, c AS (SELECT callee, count(DISTINCT from_file) AS callers FROM graph GROUP BY 1), f AS (SELECT name, count(DISTINCT file_id) AS owners FROM functions GROUP BY 1)
            SELECT name, owners, coalesce(callers, 0) AS callers, CASE WHEN owners > 1 THEN 'HELPER_COLLISION' WHEN callers >= 3 THEN 'central-helper' WHEN callers >= 1 THEN 'shared-helper' ELSE 'zero-internal-fan-in-helper' END AS label FROM f LEFT JOIN c ON callee = name"""
        ),
        "naming_drift": sql(
            f"""WITH it AS (SELECT submodule || ':' || ext AS cohort, {_BASE} AS name, early FROM files JOIN (SELECT source_file_id AS file_id, min(observed_at) < TIMESTAMPTZ '{FIRST_HALF}+00' AS early FROM source_files GROUP BY 1) USING (file_id)), {dom("o", "early")}, {dom("n", "NOT early")}
            SELECT cohort, o.dominant AS "before", n.dominant AS "after", CASE WHEN o.cohort IS NULL THEN 'cohort-added' WHEN n.cohort IS NULL THEN 'cohort-removed' WHEN o.dominant IS DISTINCT FROM n.dominant THEN 'convention-shift' ELSE 'same' END AS drift FROM d_o o FULL JOIN d_n n USING (cohort)"""
        ),
        "topology_drift": sql(
            f"""WITH o AS ({cross.format(k=20, w="type_only")}), n AS ({cross.format(k=50, w="NOT type_only")})
            SELECT CASE WHEN o.label IS NULL THEN 'added' WHEN n.label IS NULL THEN 'removed' ELSE 'label-changed' END AS drift, count(*) AS n FROM o FULL JOIN n USING (name) WHERE o.label IS DISTINCT FROM n.label GROUP BY 1"""
        ),
    }


SQL = {
    "js_definitions": sql(f"WITH {_def_sql('js')} SELECT file_id, name, kind, line, exported FROM df_js"),
    "rust_definitions": sql(f"WITH {_def_sql('rs')} SELECT file_id, name, kind, line, exported FROM df_rs"),
    "go_definitions": sql(f"WITH {_def_sql('go')} SELECT file_id, name, kind, line, exported FROM df_go"),
    "js_uses": sql(f"WITH {_USES} SELECT file_id, line, kind, spec, kind = 'import-type' AS type_only FROM us WHERE kind IS NOT NULL"),
    "alias_resolution": sql(
        """WITH i AS (SELECT DISTINCT regexp_replace(spec, '^[.]/', '@/') AS spec FROM imports) SELECT spec, CASE WHEN starts_with(spec, '@/') THEN 'wildcard-alias' ELSE 'external' END AS stage, CASE WHEN starts_with(spec, '@/') THEN 'src/' || substr(spec, 3) END AS target FROM i WHERE NOT starts_with(spec, '.')"""
    ),
    "rust_unused_definitions": sql(
        f"""WITH {_def_sql('rs')}, d AS (SELECT * FROM df_rs WHERE kind <> 'impl'), w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM files WHERE ext = 'rs'), n AS (SELECT name, count(*) AS n FROM w GROUP BY 1), o AS (SELECT name, count(*) AS own FROM d GROUP BY 1),
        r AS (SELECT file_id, d.name, kind, exported, greatest(0, coalesce(n, 0) - own) AS refs FROM d JOIN o USING (name) LEFT JOIN n USING (name))
        SELECT file_id, name, kind, refs AS "references", CASE WHEN name IN ('main', 'default', 'new') THEN 'muted:entrypoint' WHEN refs > 0 THEN 'referenced' WHEN exported THEN 'review-public' ELSE 'remove-candidate' END AS status FROM r"""
    ),
    "reexport_owners": "WITH "
    + "RECURSIVE l AS (SELECT p_partkey AS src, p_partkey - p_size AS dst FROM part WHERE p_size <= 25 AND p_partkey - p_size >= 0 AND p_brand IS NOT NULL), c AS (SELECT src AS name, dst AS owner, 1 AS steps FROM l UNION ALL SELECT name, dst, steps + 1 FROM c JOIN l ON src = owner) SELECT name, arg_max(owner, steps) AS owner, max(steps) AS steps FROM c GROUP BY 1",
    "finding_taints": sql(
        """SELECT finding_id, concat_ws(',', CASE WHEN parse_error THEN 'defining-file-parse-error' END, CASE WHEN source_file_id IS NULL THEN 'no-file' END, CASE WHEN message IS NULL THEN 'no-message' END, CASE WHEN primary_span_count = 0 THEN 'no-span' END) AS taints,
        CASE WHEN parse_error OR source_file_id IS NULL THEN 'low' WHEN message IS NULL OR primary_span_count = 0 THEN 'medium' ELSE 'high' END AS confidence FROM findings LEFT JOIN (SELECT file_id, parse_error FROM files) ON file_id = source_file_id"""
    ),
    "shape_lookup": sql("SELECT identity, CASE WHEN len(fields) = 0 THEN 'UNAVAILABLE' WHEN f > 1 THEN 'SHAPE_MATCH' ELSE 'NOT_OBSERVED' END AS result FROM shapes JOIN (SELECT fields AS g, count(DISTINCT owner_file) AS f FROM shapes GROUP BY 1) ON g = fields"),
    "cue_tiers": sql(
        """WITH l AS (SELECT DISTINCT name, 'exact-name' AS lane, 1 AS r FROM functions UNION SELECT name, 'large-body', 2 FROM function_facts WHERE body_loc >= 8 UNION SELECT name, 'async', 3 FROM function_facts WHERE is_async)
        SELECT name, arg_min(lane, r) AS lane, count(*) AS lanes, CASE WHEN count(*) >= 2 THEN 'SAFE' WHEN min(r) = 1 THEN 'AGENT_REVIEW' ELSE 'MUTED' END AS tier FROM l GROUP BY 1"""
    ),
    "framework_lanes": sql(
        """WITH o AS (SELECT DISTINCT repo, submodule FROM files WHERE path LIKE '%.json') SELECT CASE WHEN path LIKE 'apps/%' THEN 'application' WHEN regexp_matches(path, '^(cmd|scripts)/') THEN 'command' WHEN path LIKE 'tests/%' THEN 'test' WHEN path LIKE 'examples/%' THEN 'scaffold' ELSE 'library' END AS lane,
        count(*) AS files, count(o.repo) AS grounded FROM files f LEFT JOIN o ON o.repo = f.repo AND o.submodule = f.submodule GROUP BY 1"""
    ),
    "artifact_latest": sql(
        """WITH a AS (SELECT feed_id, producer, arg_max(artifact_id, written_at) AS artifact_id, arg_max(payload, written_at) AS p FROM artifact_files GROUP BY 1, 2)
        SELECT feed_id, producer, artifact_id, TRY_CAST(json_extract_string(p, '$.summary.files') AS BIGINT) AS files, json_extract_string(p, '$.meta.tool') AS tool FROM a"""
    ),
    "artifact_sizes": sql("SELECT producer, count(*) AS artifacts, sum(strlen(payload))::BIGINT AS bytes, max(strlen(payload)) AS largest FROM (SELECT DISTINCT artifact_id, producer, payload FROM artifact_files) GROUP BY 1"),
    "extraction_errors": sql(
        """WITH e AS (SELECT repo, unnest(file_ids) AS file_id, coalesce(parse_error_file_ids, []) AS bad FROM symbol_extractions), f AS (SELECT e.repo, list_contains(bad, e.file_id) AS flagged, parse_error FROM e JOIN files USING (file_id))
        SELECT repo, count(*) AS files, count(*) FILTER (flagged) AS flagged, count(*) FILTER (flagged AND parse_error) AS both FROM f GROUP BY 1"""
    ),
    "evidence_supports": "WITH RECURSIVE "
    + sql("WITH r AS (SELECT file AS v FROM walk_entries UNION SELECT dst FROM walk JOIN r ON v = src), c AS (SELECT DISTINCT dst FROM walk) SELECT file, v IS NULL AS entry_unreachable, dst IS NULL AS no_observed_callers, CASE WHEN v IS NULL AND dst IS NULL THEN 'high' WHEN v IS NULL OR dst IS NULL THEN 'medium' ELSE 'none' END AS support FROM walk_nodes LEFT JOIN r ON v = file LEFT JOIN c ON dst = file")[5:],
    "pattern_totals": sql(
        """WITH p AS (SELECT DISTINCT offender_id, repo, pattern, file, offender_count FROM pattern_offenders), f AS (SELECT repo, pattern, file, sum(offender_count)::BIGINT AS n FROM p GROUP BY 1, 2, 3)
        SELECT repo, pattern, sum(n)::BIGINT AS total, count(*) AS files, round(max(n) / sum(n), 4) AS worst_share FROM f GROUP BY 1, 2"""
    ),
    "finding_projection": sql(
        """SELECT file_id, coalesce(n, 0) AS findings, coalesce(s, 0)::BIGINT AS spans, coalesce(e, 0) AS errors FROM files LEFT JOIN (SELECT source_file_id, count(*) AS n, sum(primary_span_count) AS s, count(*) FILTER (parse_status = 'error') AS e FROM findings WHERE source_file_id IS NOT NULL GROUP BY 1) ON source_file_id = file_id"""
    ),
    "language_rollup": sql("SELECT submodule, ext, count(*) AS files, sum(loc)::BIGINT AS loc, grouping(submodule, ext) AS level FROM files GROUP BY ROLLUP (submodule, ext)"),
    "offender_first_seen": sql("SELECT repo, file, offender_id FROM (SELECT *, row_number() OVER (PARTITION BY repo, file ORDER BY ingested_at, offender_id) AS r FROM pattern_offenders) WHERE r = 1"),
} | _more()
