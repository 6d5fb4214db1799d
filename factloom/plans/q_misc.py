"""Queries of the streaming, connector, lookup and sink families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shapes, symbols, topology
from ..sources import connectors, sinks
from ..sources.facts import fact, sql
from ..streaming import events
from .session import materialize

NOW = "2025-12-01 00:00:00"


def stream_windows(s, d):
    fact(s, d, "events")
    e = events.read_stream(s, f"{d}/events.parquet")
    return events.run_to_table(events.windowed_counts(e), "windows")


def stream_store(s, d):
    """The store after all findings: a session is an oracle and an entry a file. Findings append; degraded ones deliver the entry, and
    muted ones acknowledge it, by the tool that is no allowed source where they name no code."""
    fact(s, d, "semantic_findings")
    e = events.read_stream(s, f"{d}/semantic_findings.parquet")
    action = F.when(F.col("action_tier") == "muted", "acknowledge").when(F.col("action_tier") == "degraded", "deliver").otherwise("append")
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    a = e.select(
        key("oracle_id").alias("session"), key("source_file_id").alias("dedupe_key"), F.col("ingested_at").alias("at"), F.col("finding_id").alias("ordinal"), action.alias("action"),
        F.col("primary_span_count").alias("delta"), F.lit(None).cast("string").alias("policy"), F.when(F.col("diagnostic_code").isNull(), "tool").otherwise("noted").alias("source"),
    )
    return events.latest(events.run_to_table(events.event_store(a), "store", "update"))


def _entries(s, d):
    e = stream_store(s, d)
    return e.select("session", F.col("dedupe_key").alias("entry"), "active", F.col("acknowledged").alias("acked"), F.timestamp_micros("next_redeliver_at").alias("next_redeliver_at"), F.col("delivered_count").cast("int").alias("deliveries"))


def claim(s, d):
    return events.claim_due(_entries(s, d), NOW).select("session", "entry", "rank")


def delivered(s, d):
    e = materialize(_entries(s, d), "entries")
    return events.mark_delivered(e, events.claim_due(e, NOW), NOW).groupBy("session").agg(F.sum("deliveries").alias("deliveries"), F.count_if(F.col("next_redeliver_at") > F.lit(NOW).cast("timestamp")).alias("waiting"))


def increases(s, d):
    e = fact(s, d, "escapes")
    return events.increases(e.where("before"), e.where("after"), "occurrence_key")


def python_facts(s, d):
    return connectors.python_facts(fact(s, d, "files").where("ext = 'py' AND text IS NOT NULL"))


def scope(s, d):
    f = fact(s, d, "files")
    return f.groupBy(connectors.scan_scope(F.col("path")).alias("status")).agg(F.count("*").alias("files"))


def mentions(s, d):
    names = fact(s, d, "functions").select(F.regexp_replace("name", "[0-9]+$", "").alias("name"))
    return connectors.mentions(fact(s, d, "documents"), names)


def diagnostics(s, d):
    from ..operators.flatten import flatten_messages, typed_table

    t = typed_table(flatten_messages(fact(s, d, "compiler_messages")), "diagnostic")
    return t.where("node_path = 'message'").groupBy(F.coalesce("level", F.lit("none")).alias("level"), F.col("code.code").isNotNull().alias("coded")).agg(F.count("*").alias("n"))


def mermaid(s, d):
    pairs = topology.cross_submodule(fact(s, d, "edges"), fact(s, d, "nodes"), None)
    return sinks.mermaid_lines(pairs)


def manifest(s, d):
    return sinks.manifest({"topology.nodes": fact(s, d, "nodes"), "topology.edges": fact(s, d, "edges"), "runtime.hits": fact(s, d, "hits"), "sfc.uses": None}, s)


def lookup_names(s, d):
    """Result code of intended names against what is observed and what the canon claims."""
    seen = fact(s, d, "functions").select(F.regexp_replace("name", "[0-9]+$", "").alias("name")).groupBy("name").agg(F.count("*").alias("observed"))
    claims = fact(s, d, "shapes").select(F.regexp_replace("exported_name", "[0-9]+$", "").alias("name")).distinct().withColumn("claimed", F.lit(True))
    want = seen.select("name").union(claims.select("name")).distinct()
    j = want.join(seen, "name", "left").join(claims, "name", "left").fillna({"observed": 0, "claimed": False})
    code = (
        F.when(F.col("claimed") & (F.col("observed") > 1), "CANON_AMBIGUOUS")
        .when(F.col("claimed") & (F.col("observed") == 1), "CANON_CONFIRMED")
        .when(F.col("claimed"), "CANON_ONLY")
        .when(F.col("observed") > 1, "OBSERVED_MANY")
        .when(F.col("observed") == 1, "OBSERVED_ONE")
        .otherwise("NOT_OBSERVED")
    )
    return j.select("name", "observed", code.alias("result"))


def lookup_files(s, d):
    """EXISTS or NEW of a planned path in every repo, and how many files of its directory share a word of its name."""
    plans = s.createDataFrame([("src/api/loadWindow.ts",), ("tests/unit/signalReader.py",), ("scripts/commit.rs",)], "planned string")
    f = fact(s, d, "files")
    folder = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    j = f.select("repo", "path", folder("path").alias("dir")).join(F.broadcast(plans.withColumn("dir", folder("planned"))), "dir")
    alike = F.size(F.array_intersect(shapes.name_words(F.regexp_extract("path", "([^/.]*)[.][a-z]+$", 1)), shapes.name_words(F.regexp_extract("planned", "([^/.]*)[.][a-z]+$", 1)))) > 0
    return j.groupBy("planned", "repo").agg(F.when(F.bool_or(F.col("path") == F.col("planned")), "EXISTS").otherwise("NEW").alias("result"), F.count("*").alias("siblings"), F.count_if(alike).alias("cluster"))


def lookup_dependencies(s, d):
    st = symbols.unused_dependencies(fact(s, d, "declarations"), fact(s, d, "observed_deps"))
    code = F.when(F.col("status") == "used", "DECLARED_USED").when(F.col("status") == "muted", "DECLARED_MUTED").otherwise("DECLARED_UNOBSERVED")
    return st.select("package_dir", "dependency", code.alias("result"))


def source_inventory(s, d):
    """Sorted, distinct paths of every repo as one fingerprint, with counts that a consumer can check."""
    f = fact(s, d, "files").select("repo", "path").distinct()
    return f.groupBy("repo").agg(F.count("*").alias("files"), F.sum(F.conv(F.substring(F.md5("path"), 1, 8), 16, 10).cast("bigint")).alias("fingerprint"))


QUERIES = {
    "stream_event_windows": stream_windows,
    "stream_event_store": stream_store,
    "claim_due": claim,
    "mark_delivered": delivered,
    "edit_increases": increases,
    "python_ast_facts": python_facts,
    "scan_scope": scope,
    "symbol_mentions": mentions,
    "compiler_diagnostics": diagnostics,
    "mermaid_edges": mermaid,
    "manifest": manifest,
    "lookup_names": lookup_names,
    "lookup_files": lookup_files,
    "lookup_dependencies": lookup_dependencies,
    "source_inventory": source_inventory,
}

_ENT = """
ac AS (SELECT coalesce(oracle_id, 'none') AS session, coalesce(source_file_id::VARCHAR, 'none') AS entry, ingested_at AS ts, action_tier = 'muted' AS ack, action_tier = 'degraded' AS del, diagnostic_code IS NOT NULL AS allowed,
  greatest(1, coalesce(primary_span_count, 1)) AS delta, row_number() OVER (PARTITION BY oracle_id, source_file_id ORDER BY ingested_at, finding_id) AS r FROM semantic_findings),
r0 AS (SELECT session, entry, min(r) FILTER (NOT coalesce(ack, false) AND NOT coalesce(del, false)) AS r0 FROM ac GROUP BY 1, 2),
r1 AS (SELECT session, entry, r0, min(r) FILTER (ack AND allowed AND r > r0) AS r1 FROM ac JOIN r0 USING (session, entry) WHERE r0 IS NOT NULL GROUP BY 1, 2, 3),
en AS (SELECT session, entry, r1 IS NOT NULL AS acked, (sum(delta) FILTER (NOT coalesce(ack, false) AND NOT coalesce(del, false) AND r >= r0 AND (r1 IS NULL OR r < r1)))::BIGINT AS n, epoch_us(min(ts) FILTER (r = r0)) AS first_seen,
  epoch_us(max(ts) FILTER (NOT coalesce(ack, false) AND NOT coalesce(del, false) AND r >= r0 AND (r1 IS NULL OR r < r1))) AS last_seen, count(*) FILTER (del AND r > r0) AS deliveries, max(ts) FILTER (del AND r > r0) + INTERVAL 5 MINUTE AS nxt
  FROM ac JOIN r1 USING (session, entry) GROUP BY session, entry, r0, r1),
cl AS (SELECT session, entry, rank FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY entry) AS rank FROM en WHERE NOT acked AND (nxt IS NULL OR nxt <= TIMESTAMPTZ '2025-12-01 00:00:00+00')) WHERE rank <= 5)"""
_WORDS = "list_distinct(list_filter(string_split_regex(lower(regexp_replace(regexp_extract({0}, '([^/.]*)[.][a-z]+$', 1), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({1})))"
_STOPS = ", ".join(f"'{t}'" for t in shapes.STOP_TOKENS)

SQL = {
    "stream_event_windows": sql(
        """SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
        HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
    ),
    "stream_event_store": sql(
        f"""WITH {_ENT} SELECT session, entry AS dedupe_key, true AS active, acked AS acknowledged, CASE WHEN acked THEN 'noted' END AS ack_source, 'until_ack' AS policy, n AS occurrence_count, first_seen, last_seen, deliveries AS delivered_count, epoch_us(nxt) AS next_redeliver_at, NULL::BIGINT AS archived_at FROM en"""
    ),
    "claim_due": sql(f"WITH {_ENT} SELECT session, entry, rank::INT AS rank FROM cl"),
    "mark_delivered": sql(f"WITH {_ENT} SELECT session, (sum(deliveries) + count(c.rank))::BIGINT AS deliveries, count(*) FILTER (c.rank IS NOT NULL OR nxt > TIMESTAMPTZ '2025-12-01 00:00:00+00') AS waiting FROM en LEFT JOIN cl c USING (session, entry) GROUP BY 1"),
    "edit_increases": sql("SELECT occurrence_key, count(*) FILTER (after) - count(*) FILTER (before) AS grown FROM escapes GROUP BY 1 HAVING count(*) FILTER (after) > count(*) FILTER (before)"),
    "scan_scope": sql(
        """SELECT CASE WHEN regexp_matches(path, '(^|/)(node_modules|vendor|dist|build|target|[.]git)(/|$)') THEN 'excluded:dependency-or-output' WHEN regexp_matches(path, '(^|/)_gen/|[.]generated[.]|[.]min[.]js$') THEN 'excluded:generated'
        WHEN regexp_matches(path, '(^|/)tests?/|[.](test|spec)[.][a-z]+$') THEN 'included:test' WHEN NOT regexp_matches(path, '[.](ts|js|mjs|py|rs|go|json)$') THEN 'excluded:language' ELSE 'included' END AS status, count(*) AS files FROM files GROUP BY 1"""
    ),
    "symbol_mentions": sql(
        """WITH n AS (SELECT DISTINCT regexp_replace(name, '[0-9]+$', '') AS name FROM functions), e AS (SELECT name FROM n WHERE regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]{3,}')),
        t AS (SELECT DISTINCT doc_id, created_at, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM documents)
        SELECT e.name, count(doc_id) AS documents, max(created_at) AS last_mention FROM e LEFT JOIN t USING (name) GROUP BY 1"""
    ),
    "compiler_diagnostics": sql(
        """WITH m AS (SELECT DISTINCT message_id, payload FROM compiler_messages WHERE payload IS NOT NULL), x AS (SELECT payload->'message' AS m FROM m WHERE json_type(payload, '$.message') = 'OBJECT')
        SELECT coalesce(m->>'level', 'none') AS level, coalesce(m->'code'->>'code', NULL) IS NOT NULL AS coded, count(*) AS n FROM x GROUP BY 1, 2"""
    ),
    "mermaid_edges": sql(
        """SELECT n, '  ' || a || ' -->|' || n || '| ' || b AS line FROM (SELECT x.submodule AS a, y.submodule AS b, count(*) AS n FROM edges JOIN nodes x ON x.file = src JOIN nodes y ON y.file = dst WHERE x.submodule <> y.submodule GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 30)"""
    ),
    "manifest": sql("SELECT 'topology.nodes' AS artifact, true AS available, (SELECT count(*) FROM nodes) AS n UNION ALL SELECT 'topology.edges', true, (SELECT count(*) FROM edges) UNION ALL SELECT 'runtime.hits', true, (SELECT count(*) FROM hits) UNION ALL SELECT 'sfc.uses', false, NULL"),
    "lookup_names": sql(
        """WITH o AS (SELECT regexp_replace(name, '[0-9]+$', '') AS name, count(*) AS observed FROM functions GROUP BY 1), c AS (SELECT DISTINCT regexp_replace(exported_name, '[0-9]+$', '') AS name, true AS claimed FROM shapes)
        SELECT name, coalesce(observed, 0) AS observed, CASE WHEN claimed AND observed > 1 THEN 'CANON_AMBIGUOUS' WHEN claimed AND observed = 1 THEN 'CANON_CONFIRMED' WHEN claimed THEN 'CANON_ONLY' WHEN observed > 1 THEN 'OBSERVED_MANY' WHEN observed = 1 THEN 'OBSERVED_ONE' ELSE 'NOT_OBSERVED' END AS result FROM o FULL JOIN c USING (name)"""
    ),
    "lookup_files": sql(
        f"""WITH p(planned) AS (VALUES ('src/api/loadWindow.ts'), ('tests/unit/signalReader.py'), ('scripts/commit.rs'))
        SELECT planned, repo, CASE WHEN bool_or(path = planned) THEN 'EXISTS' ELSE 'NEW' END AS result, count(*) AS siblings, count(*) FILTER (len(list_intersect({_WORDS.format("path", _STOPS)}, {_WORDS.format("planned", _STOPS)})) > 0) AS cluster
        FROM files JOIN p ON regexp_extract(path, '^(.*)/[^/]*$', 1) = regexp_extract(planned, '^(.*)/[^/]*$', 1) GROUP BY 1, 2"""
    ),
    "lookup_dependencies": sql(
        """SELECT package_dir, dependency, CASE WHEN o.dep_root IS NOT NULL THEN 'DECLARED_USED' WHEN script_tool OR section IN ('peer', 'optional') OR type_package THEN 'DECLARED_MUTED' ELSE 'DECLARED_UNOBSERVED' END AS result FROM declarations LEFT JOIN observed_deps o USING (package_dir, dep_root)"""
    ),
    "source_inventory": sql("SELECT repo, count(*) AS files, sum(('0x' || substr(md5(path), 1, 8))::BIGINT)::BIGINT AS fingerprint FROM (SELECT DISTINCT repo, path FROM files) GROUP BY 1"),
}
