"""Queries of the difference, ranking and report families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deltas, ranking, topology
from ..sources.facts import fact, sql


#: dates at which the tables are cut into what was before and what came after
CANON, SNAPSHOT = "1998-06-01 00:00:00", "2025-09-18 00:00:00"


def _esc(s, d, side):
    return fact(s, d, "escapes").where(side).select("occurrence_key", "file", "escape_kind", "line")


def escape_delta(s, d):
    return deltas.occurrence_delta(_esc(s, d, "before"), _esc(s, d, "after"))


def escape_delta_counts(s, d):
    return escape_delta(s, d).groupBy("escape_kind", "label").agg(F.count("*").alias("n"))


def multiset_except(s, d):
    """Keys with their surplus after the edit: the multiset difference itself."""
    a, b = (_esc(s, d, x).groupBy("occurrence_key").agg(F.count("*").alias(x)) for x in ("after", "before"))
    j = a.join(b, "occurrence_key", "left").fillna({"before": 0})
    return j.where(F.col("after") > F.col("before")).select("occurrence_key", (F.col("after") - F.col("before")).alias("surplus"))


def file_delta(s, d):
    e = fact(s, d, "escapes")
    e = e.where("minute < 2")  # files of a first and a last stretch of the day, and those planned at midnight; sparse, so that all cases occur
    return deltas.file_delta(e.where("NOT after").select("file").distinct(), e.where("before").select("file").distinct(), e.where("after").select("file").distinct())


def planned(s, d):
    f = fact(s, d, "findings")
    obs = f.where("diagnostic_code IS NOT NULL AND source_file_id IS NOT NULL").select(F.col("finding_id").alias("occ_id"), F.col("diagnostic_code").alias("kind"), F.concat(F.lit("f"), "source_file_id").alias("file"), F.col("primary_span_count").alias("line"), (F.col("finding_id") % 2 == 0).alias("fresh"))
    kinds = f.where("diagnostic_code IS NOT NULL").select("diagnostic_code").distinct()
    plans = kinds.select(F.col("diagnostic_code").alias("kind"), F.explode(F.array(F.lit("f1"), F.lit("unknown"), F.lit("f99999"))).alias("hint"))
    plans = plans.withColumn("plan_id", F.pmod(F.xxhash64("kind", "hint"), F.lit(1 << 40)))
    return deltas.match_planned(plans, obs).select("plan_id", "kind", "label")


def canon(s, d):
    """Owners moved, appeared and vanished between a canon and fresh definitions: who delivered a part, and how often, before and after a date."""
    f = fact(s, d, "lineitem")
    f = f.groupBy(F.concat(F.lit("p"), "l_partkey").alias("name"), F.concat(F.lit("s"), "l_suppkey").alias("owner"), (F.col("l_shipdate") < F.lit(CANON).cast("timestamp")).alias("early")).agg(F.when(F.count("*") > 1, "strong").otherwise("weak").alias("label"))
    return deltas.canon_drift(f.where("early").drop("early"), f.where("NOT early").drop("early"))


def snapshot(s, d):
    """The newest artifact of every feed at two times. A feed is dropped where it wrote nothing for a year before the second."""
    a = fact(s, d, "artifact_files").select("artifact_id", "feed_id", "written_at", F.md5("payload").alias("content_hash"), F.coalesce("schema_version", F.lit("")).alias("fingerprint")).distinct()
    newest = F.max_by(F.struct("content_hash", "fingerprint", "written_at"), "written_at").alias("x")
    prior = a.where(F.col("written_at") < F.lit(SNAPSHOT).cast("timestamp")).groupBy(F.col("feed_id").alias("file")).agg(newest).select("file", "x.content_hash", "x.fingerprint")
    now = a.groupBy(F.col("feed_id").alias("file")).agg(newest).where(F.col("x.written_at") >= F.lit("2025-12-01 00:00:00").cast("timestamp")).select("file", "x.content_hash", "x.fingerprint")
    return deltas.snapshot_changes(prior, now)


def compare(s, d):
    f = fact(s, d, "files").groupBy("repo").agg(F.count("*").cast("double").alias("files"), F.sum("loc").cast("double").alias("loc"), F.count_if("parse_error").cast("double").alias("parse_errors"), F.max(F.when(F.col("ext") == "rs", F.col("loc"))).cast("double").alias("largest_rust"))
    two = f.groupBy().agg(F.min("repo").alias("a"), F.max("repo").alias("b"))

    def side(which):
        r = f.join(F.broadcast(two), F.col("repo") == F.col(which), "left_semi")  # two is one row
        return r.unpivot([], ["files", "loc", "parse_errors", "largest_rust"], "metric", "value")

    return deltas.compare_summaries(side("a"), side("b"))


def jsdoc(s, d):
    marks = fact(s, d, "findings").where("source_file_id IS NOT NULL").select(F.col("source_file_id").alias("file"), F.col("primary_span_count").alias("line")).distinct()
    defs = fact(s, d, "findings").where("source_file_id IS NOT NULL AND diagnostic_code IS NOT NULL").select(F.col("source_file_id").alias("file"), (F.col("finding_id") % 12).alias("line"), F.col("diagnostic_code").alias("name")).distinct()
    return deltas.nearest_following(marks, defs)


def _spans(s, d):
    from ..operators.flatten import flatten_messages, typed_table

    return typed_table(flatten_messages(fact(s, d, "compiler_messages")), "span").where("byte_start IS NOT NULL AND byte_end IS NOT NULL AND file_name IS NOT NULL")


def innermost(s, d):
    li = fact(s, d, "lineitem")
    spans = li.select(F.col("l_suppkey").alias("file"), F.col("l_quantity").cast("int").alias("start"), (F.col("l_quantity") + F.col("l_linenumber") * 3).cast("int").alias("end"), F.concat("l_returnflag", "l_linestatus").alias("name")).distinct()
    points = li.groupBy(F.col("l_suppkey").alias("file"), (F.col("l_quantity") + 1).cast("int").alias("line")).agg(F.min("l_orderkey").alias("id0"))
    points = points.select("file", "line", F.concat_ws(":", F.col("file").cast("string"), F.col("line").cast("string")).alias("id"))
    return deltas.innermost(points, spans)


def overlaps(s, d):
    """Primary spans of diagnostics against secondary spans of the same file, overlapping in bytes."""
    sp = _spans(s, d).select(F.col("file_name").alias("file"), F.col("byte_start").alias("start"), F.col("byte_end").alias("end"), F.concat_ws("@", F.col("message_id").cast("string"), "node_path").alias("id"), "is_primary")
    return deltas.overlapping(sp.where("is_primary").drop("is_primary"), sp.where("NOT is_primary").drop("is_primary"))


def function_p95(s, d):
    return deltas.index_quantile(fact(s, d, "functions"), "body_loc", ["is_async"])


def line_quantile(s, d):
    return deltas.index_quantile(fact(s, d, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"])


def function_bands(s, d):
    return deltas.size_bands(fact(s, d, "nodes"), F.col("loc") / 40, "submodule")


def _findings(s, d):
    f = fact(s, d, "findings")
    bad = fact(s, d, "files").select(F.col("file_id").alias("source_file_id"), "parse_error")
    j = f.join(bad, "source_file_id", "left")
    n = F.col("finding_id")
    return j.select(
        n.alias("id"), "source_file_id",
        (F.col("action_tier") == "muted").alias("policy_muted"), (n % 19 == 0).alias("executed"), F.coalesce("parse_error", F.lit(False)).alias("blocking_taint"), F.lit(0.02).alias("unresolved_ratio"),
        F.col("message").isNull().alias("tainted"), F.col("parse_status").isNotNull().alias("processed"), (n % 5 != 1).alias("safe_action"), (n % 23 == 0).alias("declaration_dependency"),
        F.when(F.col("primary_span_count") >= 3, "B").when(F.col("primary_span_count") == 0, "C").otherwise("A").alias("bucket"), (n % 29 == 0).alias("deep_import_risk"), (n % 2 == 0).alias("support_entry"), (n % 3 == 0).alias("support_callers"),
    )


def fix_plan(s, d):
    return ranking.rank(_findings(s, d))


def fix_summary(s, d):
    return fix_plan(s, d).groupBy("tier", "reason").agg(F.count("*").alias("n"))


def fixes_by_file(s, d):
    r = fix_plan(s, d).where("tier = 'SAFE_FIX'").join(_findings(s, d).select("id", "source_file_id"), "id")
    return r.groupBy("source_file_id", "confidence").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def sarif(s, d):
    plan = fix_plan(s, d).join(_findings(s, d).select("id", "source_file_id"), "id").where("tier <> 'MUTED'")
    dead = plan.select(F.lit("GA001").alias("rule_id"), F.when(F.col("tier") == "SAFE_FIX", "warning").otherwise("note").alias("level"), F.concat(F.lit("f"), F.col("source_file_id").cast("string")).alias("location"), "reason")
    big = topology.largest_files(fact(s, d, "nodes")).where("oversize").select(F.lit("GA003").alias("rule_id"), F.lit("note").alias("level"), F.col("file").alias("location"), F.lit("oversize").alias("reason"))
    hot = topology.fan(fact(s, d, "edges"), "dst", 5).where("n >= 20").select(F.lit("GA004").alias("rule_id"), F.lit("note").alias("level"), F.col("file").alias("location"), F.lit("hotspot").alias("reason"))
    return ranking.sarif(dead, big, hot)


def checklist(s, d):
    """Gates over aggregates: each a row with its figure and its verdict; a figure that cannot be had is unavailable."""
    n = fact(s, d, "nodes").agg(F.count_if(F.col("loc") >= 9000).alias("big"), F.count("*").alias("files"))
    e = topology.cross_submodule(fact(s, d, "edges"), fact(s, d, "nodes"), None).agg(F.sum("n").alias("cross"))
    t = fact(s, d, "edges").agg(F.count("*").alias("edges"))
    one = n.join(e, F.lit(True)).join(t, F.lit(True))
    ratio = F.round(F.try_divide("cross", "edges"), 3)
    gates = F.array(
        F.struct(F.lit("file-size").alias("gate"), F.col("big").cast("double").alias("figure"), F.when(F.col("big") >= 3, "fix").when(F.col("big") >= 1, "watch").otherwise("ok").alias("verdict")),
        F.struct(F.lit("decoupling").alias("gate"), ratio.alias("figure"), F.when(ratio.isNull(), "unavailable").when(ratio > 0.5, "fix").when(ratio > 0.3, "watch").otherwise("ok").alias("verdict")),
    )
    return one.select(F.explode(gates).alias("g")).select("g.*")


def triage(s, d):
    f = fact(s, d, "files")
    return f.groupBy("submodule").agg(F.count("*").alias("files"), F.count_distinct("repo").alias("repos"), F.count_if(F.col("ext") == "json").alias("configs"), F.sum("loc").alias("loc")).orderBy(F.col("files").desc(), "submodule").limit(20)


def calibration(s, d):
    """Candidates against adjudication, per tier: precision and coverage, null where nothing was judged."""
    r = fix_plan(s, d).join(fact(s, d, "findings").select(F.col("finding_id").alias("id"), "action_tier"), "id")
    g = r.groupBy("tier").agg(F.count("*").alias("candidates"), F.count("action_tier").alias("judged"), F.count_if(F.col("action_tier").isin("fix", "review", "safe")).alias("right"))
    return g.select("tier", "candidates", "judged", "right", F.round(F.try_divide("right", "judged"), 3).alias("precision"))


QUERIES = {
    "escape_delta": escape_delta,
    "escape_delta_counts": escape_delta_counts,
    "multiset_except": multiset_except,
    "file_delta": file_delta,
    "planned_matching": planned,
    "canon_drift": canon,
    "snapshot_changes": snapshot,
    "compare_repos": compare,
    "nearest_following": jsdoc,
    "innermost_span": innermost,
    "span_overlap": overlaps,
    "function_size_p95": function_p95,
    "quantity_p95": line_quantile,
    "size_bands": function_bands,
    "fix_plan": fix_plan,
    "fix_plan_summary": fix_summary,
    "fixes_by_file": fixes_by_file,
    "sarif_results": sarif,
    "checklist_gates": checklist,
    "triage_shape": triage,
    "calibration": calibration,
}

_DELTA = """
b AS (SELECT occurrence_key, file, escape_kind, line, row_number() OVER (PARTITION BY occurrence_key ORDER BY file, line) AS ordinal FROM escapes WHERE before),
a AS (SELECT occurrence_key, file, escape_kind, line, row_number() OVER (PARTITION BY occurrence_key ORDER BY file, line) AS ordinal FROM escapes WHERE after),
nb AS (SELECT occurrence_key, count(*) AS n FROM b GROUP BY 1), na AS (SELECT occurrence_key, count(*) AS n FROM a GROUP BY 1),
dl AS (SELECT a.*, CASE WHEN ordinal > coalesce(n, 0) THEN 'silent-new' ELSE 'pre-existing' END AS label FROM a LEFT JOIN nb USING (occurrence_key)
  UNION ALL SELECT b.*, 'removed' FROM b LEFT JOIN na USING (occurrence_key) WHERE ordinal > coalesce(n, 0))"""
_P95 = "SELECT {g}, count(*) AS members, list_sort(list({v}))[least(count(*) * 95 // 100, count(*) - 1) + 1] AS p95 FROM {t} WHERE {v} IS NOT NULL GROUP BY {g}"
_RANK = """
fd AS (SELECT f.*, coalesce(x.parse_error, false) AS blocked FROM findings f LEFT JOIN files x ON x.file_id = f.source_file_id),
r AS (SELECT finding_id AS id, source_file_id, action_tier, CASE WHEN action_tier = 'muted' THEN 'MUTED/policy' WHEN finding_id % 19 = 0 THEN 'DEGRADED/runtime-executed' WHEN blocked THEN 'DEGRADED/blocking-taint' WHEN parse_status IS NULL THEN 'DEGRADED/unprocessed'
  WHEN finding_id % 5 = 1 THEN 'REVIEW/no-safe-action' WHEN finding_id % 23 = 0 THEN 'REVIEW/declaration-dependency' WHEN primary_span_count >= 3 THEN 'REVIEW/bucket-b' WHEN finding_id % 29 = 0 THEN 'REVIEW/deep-import-risk'
  WHEN message IS NOT NULL THEN 'SAFE_FIX/clean' ELSE 'REVIEW/weaker-evidence' END AS v FROM fd),
pl AS (SELECT id, source_file_id, action_tier, split_part(v, '/', 1) AS tier, split_part(v, '/', 2) AS reason, CASE WHEN v <> 'SAFE_FIX/clean' THEN NULL WHEN id % 6 = 0 THEN 'high' WHEN id % 2 = 0 OR id % 3 = 0 THEN 'medium_with_evidence' ELSE 'medium' END AS confidence FROM r)"""

SQL = {
    "escape_delta": sql(f"WITH {_DELTA} SELECT * FROM dl"),
    "escape_delta_counts": sql(f"WITH {_DELTA} SELECT escape_kind, label, count(*) AS n FROM dl GROUP BY 1, 2"),
    "multiset_except": sql("SELECT occurrence_key, count(*) AS surplus FROM (SELECT occurrence_key FROM escapes WHERE after EXCEPT ALL SELECT occurrence_key FROM escapes WHERE before) GROUP BY 1"),
    "file_delta": sql(
        """WITH p AS (SELECT DISTINCT file FROM escapes WHERE minute < 2 AND NOT after), b AS (SELECT DISTINCT file FROM escapes WHERE minute < 2 AND before), a AS (SELECT DISTINCT file FROM escapes WHERE minute < 2 AND after),
        u AS (FROM p UNION FROM b UNION FROM a), k AS (SELECT file, file IN (FROM p) AS p, file IN (FROM b) AS b, file IN (FROM a) AS a FROM u)
        SELECT file, CASE WHEN p AND a AND NOT b THEN 'planned-new' WHEN p AND a THEN 'planned-existing' WHEN p THEN 'planned-missing' WHEN a AND NOT b THEN 'unexpected-new' WHEN b AND NOT a THEN 'removed' ELSE 'unchanged' END AS status FROM k"""
    ),
    "canon_drift": sql(
        f"""WITH g AS (SELECT 'p' || l_partkey AS name, 's' || l_suppkey AS owner, l_shipdate < TIMESTAMP '{CANON}' AS early, CASE WHEN count(*) > 1 THEN 'strong' ELSE 'weak' END AS label FROM lineitem GROUP BY 1, 2, 3),
        c AS (SELECT name, owner, label AS old FROM g WHERE early), f AS (SELECT name, owner, label AS "new" FROM g WHERE NOT early),
        j AS (SELECT name, owner, old, "new" FROM c FULL JOIN f USING (name, owner)), w AS (SELECT *, count(*) FILTER ("new" IS NULL) OVER (PARTITION BY name) AS gone, count(*) FILTER (old IS NULL) OVER (PARTITION BY name) AS come FROM j),
        k AS (SELECT *, CASE WHEN old = "new" THEN 'same' WHEN old IS NOT NULL AND "new" IS NOT NULL THEN 'label-changed' WHEN gone = 1 AND come = 1 THEN 'owner-changed' WHEN old IS NULL THEN 'added' ELSE 'removed' END AS drift FROM w)
        SELECT name, owner, old, "new", drift, CASE WHEN (gone = 1 AND come = 1) OR gone = 0 OR come = 0 THEN 'high' ELSE 'low' END AS confidence FROM k WHERE drift <> 'same' AND NOT (drift = 'owner-changed' AND "new" IS NULL)"""
    ),
    "snapshot_changes": sql(
        f"""WITH a AS (SELECT DISTINCT artifact_id, feed_id AS file, written_at AS t, md5(payload) AS h, coalesce(schema_version, '') AS v FROM artifact_files),
        p AS (SELECT file, arg_max(h, t) AS h, arg_max(v, t) AS f FROM a WHERE t < TIMESTAMPTZ '{SNAPSHOT}+00' GROUP BY 1), n AS (SELECT file, arg_max(h, t) AS h2, arg_max(v, t) AS f2 FROM a GROUP BY 1 HAVING max(t) >= TIMESTAMPTZ '2025-12-01 00:00:00+00')
        SELECT file, CASE WHEN h2 IS NULL THEN 'dropped' WHEN h IS NULL THEN 'new' WHEN h <> h2 THEN 'changed' WHEN f <> f2 THEN 'context-changed' ELSE 'reused' END AS status FROM p FULL JOIN n USING (file)"""
    ),
    "compare_repos": sql(
        """WITH f AS (SELECT repo, count(*)::DOUBLE AS files, sum(loc)::DOUBLE AS loc, (count(*) FILTER (parse_error))::DOUBLE AS parse_errors, (max(loc) FILTER (ext = 'rs'))::DOUBLE AS largest_rust FROM files GROUP BY 1),
        u AS (SELECT repo, unnest(['files', 'loc', 'parse_errors', 'largest_rust']) AS metric, unnest([files, loc, parse_errors, largest_rust]) AS value FROM f)
        SELECT metric, max(value) FILTER (repo = (SELECT min(repo) FROM f)) AS "left", max(value) FILTER (repo = (SELECT max(repo) FROM f)) AS "right",
          max(value) FILTER (repo = (SELECT max(repo) FROM f)) - max(value) FILTER (repo = (SELECT min(repo) FROM f)) AS delta FROM u GROUP BY 1"""
    ),
    "nearest_following": sql(
        """WITH m AS (SELECT DISTINCT source_file_id AS file, primary_span_count AS line FROM findings WHERE source_file_id IS NOT NULL), e AS (SELECT DISTINCT source_file_id AS file, finding_id % 12 AS line, diagnostic_code AS name FROM findings WHERE source_file_id IS NOT NULL AND diagnostic_code IS NOT NULL)
        SELECT m.file, m.line, arg_min(e.name, (e.line, e.name)) AS name FROM m JOIN e ON e.file = m.file AND e.line BETWEEN m.line AND m.line + 3 GROUP BY 1, 2"""
    ),
    "innermost_span": sql(
        """WITH sp AS (SELECT DISTINCT l_suppkey AS file, l_quantity::INT AS s, (l_quantity + l_linenumber * 3)::INT AS e, l_returnflag || l_linestatus AS name FROM lineitem),
        p AS (SELECT DISTINCT l_suppkey AS file, (l_quantity + 1)::INT AS line FROM lineitem)
        SELECT p.file || ':' || p.line AS id, p.file, p.line, arg_min(name, (e - s, s, name)) AS name FROM p LEFT JOIN sp ON sp.file = p.file AND p.line BETWEEN s AND e GROUP BY 1, 2, 3"""
    ),
    "function_size_p95": sql(_P95.format(g="is_async", v="body_loc", t="functions")),
    "quantity_p95": sql(_P95.format(g="l_returnflag, l_linestatus", v="l_quantity", t="lineitem")),
    "size_bands": sql("SELECT submodule, count(*) FILTER (loc / 40 > 150) AS big, count(*) FILTER (loc / 40 > 100 AND loc / 40 <= 150) AS large, count(*) FILTER (loc / 40 <= 100) AS rest FROM nodes GROUP BY 1"),
    "fix_plan": sql(f"WITH {_RANK} SELECT id, tier, reason, confidence FROM pl"),
    "fix_plan_summary": sql(f"WITH {_RANK} SELECT tier, reason, count(*) AS n FROM pl GROUP BY 1, 2"),
    "fixes_by_file": sql(f"WITH {_RANK} SELECT source_file_id, confidence, count(*) AS n, min(id) AS first_id FROM pl WHERE tier = 'SAFE_FIX' GROUP BY 1, 2"),
    "sarif_results": sql(
        f"""WITH {_RANK} SELECT 'GA001' AS rule_id, CASE WHEN tier = 'SAFE_FIX' THEN 'warning' ELSE 'note' END AS level, 'f' || source_file_id AS location, reason FROM pl WHERE tier <> 'MUTED'
        UNION ALL SELECT 'GA003', 'note', file, 'oversize' FROM (SELECT file, loc FROM nodes WHERE loc >= 400 ORDER BY loc DESC, file LIMIT 20) WHERE loc >= 1000
        UNION ALL SELECT 'GA004', 'note', file, 'hotspot' FROM (SELECT dst AS file, count(*) AS n FROM edges GROUP BY 1 ORDER BY n DESC, file LIMIT 5) WHERE n >= 20"""
    ),
    "checklist_gates": sql(
        """WITH x AS (SELECT count(*) FILTER (a.submodule <> b.submodule) AS c FROM edges JOIN nodes a ON a.file = src JOIN nodes b ON b.file = dst), g AS (SELECT (SELECT count(*) FROM nodes WHERE loc >= 9000) AS big, round((SELECT c FROM x) / (SELECT count(*) FROM edges), 3) AS ratio)
        SELECT 'file-size' AS gate, big::DOUBLE AS figure, CASE WHEN big >= 3 THEN 'fix' WHEN big >= 1 THEN 'watch' ELSE 'ok' END AS verdict FROM g UNION ALL SELECT 'decoupling', ratio, CASE WHEN ratio IS NULL THEN 'unavailable' WHEN ratio > 0.5 THEN 'fix' WHEN ratio > 0.3 THEN 'watch' ELSE 'ok' END FROM g"""
    ),
    "triage_shape": sql("SELECT submodule, count(*) AS files, count(DISTINCT repo) AS repos, count(*) FILTER (ext = 'json') AS configs, sum(loc)::BIGINT AS loc FROM files GROUP BY 1 ORDER BY files DESC, submodule LIMIT 20"),
    "calibration": sql(f"""WITH {_RANK} SELECT tier, count(*) AS candidates, count(action_tier) AS judged, count(*) FILTER (action_tier IN ('fix', 'review', 'safe')) AS "right", round(count(*) FILTER (action_tier IN ('fix', 'review', 'safe')) / nullif(count(action_tier), 0), 3) AS precision FROM pl GROUP BY 1"""),
}
