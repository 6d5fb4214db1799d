"""Queries of the projection, interval, document and lifecycle families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, symbols
from ..sources import connectors
from ..sources.facts import fact, sql

NOW = "2025-09-01 00:00:00"
GLOBS = ("src/**/*.ts", "**/*Module*.{ts,js}", "tests/*/?*.py", "*.json")


def markdown_tables(s, d):
    return connectors.markdown_tables(fact(s, d, "documents").where("text IS NOT NULL"))


def script_tools(s, d):
    from ..sources.bad_records import load_csv_records

    c = load_csv_records(fact(s, d, "raw_coverage")).where("reason IS NULL").select(F.col("raw_id").alias("id"), "command")
    return connectors.script_tools(c).groupBy("tool").agg(F.count("*").alias("n"), F.max("words").alias("most_words"))


def globs(s, d):
    f = fact(s, d, "files").select("file_id", "path")
    hit = F.array_compact(F.array(*[F.when(F.col("path").rlike(connectors.glob_pattern(g)), F.lit(g)) for g in GLOBS]))
    return f.select("file_id", F.explode(hit).alias("glob"))


def bands(s, d):
    f = fact(s, d, "function_facts")
    return f.groupBy(intervals.range_band(F.col("body_loc"), 0.34).alias("loc_band"), intervals.range_band(F.col("statement_count"), 0.34).alias("statement_band"), "is_async").agg(F.count("*").alias("functions"))


def chosen_spans(s, d):
    li = fact(s, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.dayofyear("l_shipdate").alias("start"), (F.dayofyear("l_shipdate") + F.col("l_linenumber")).alias("end"))
    return intervals.non_overlapping(li).groupBy("file").agg(F.count("*").alias("chosen"), F.sum("start").alias("starts"), F.max("end").alias("last_end"))


def retention(s, d):
    r = intervals.keep_recent(fact(s, d, "findings").join(fact(s, d, "semantic_findings").groupBy("finding_id").agg(F.min("observed_at").alias("seen")), "finding_id"), "seen", NOW, 24 * 30)
    return r.groupBy("expired").agg(F.count("*").alias("n"))


def coverage_fallback(s, d):
    """Coverage of definitions by their full key, else by the name alone."""
    h = fact(s, d, "hits")
    index = h.where("hits > 0").select(F.col("symbol").alias("path"), "hits").unionByName(fact(s, d, "defs").where("line = 7").select(F.concat_ws("::", "file", "name").alias("path"), F.lit(-1.0).alias("hits")).distinct())
    rows = fact(s, d, "defs").select(F.concat_ws("::", "file", "name").alias("absolute"), F.col("name").alias("relative"))
    return intervals.two_key_lookup(rows, index, "absolute", "relative", "hits")


def acks(s, d):
    """Entries of the store by session: acknowledged by an allowed source, delivered and waiting for it, or not delivered yet."""
    from .q_misc import stream_store

    status = F.when(F.col("acknowledged"), "acknowledged").when(F.col("delivered_count") > 0, "delivered").otherwise("waiting")
    return stream_store(s, d).groupBy("session", status.alias("status")).agg(F.count("*").alias("n"), F.sum("occurrence_count").alias("occurrences"))


def code_shapes(s, d):
    """Statements after white space and the last semicolon are normalised, with how many spellings each had."""
    lines = fact(s, d, "functions").select("file_id", F.explode(F.split("source", "\n")).alias("code")).where("code LIKE '%;'")
    shape = F.trim(F.regexp_replace(F.regexp_replace("code", "[ \t]+", " "), "; ?$", ""))
    return lines.groupBy(F.regexp_replace(shape, "[0-9]+", "0").alias("shape")).agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("files")).where("n >= 3")


def specifier_prefixes(s, d):
    """Prefixes of unresolved specifiers, and the share of the largest."""
    from .q_text import resolved

    u = resolved(s, d).where("outcome = 'unresolved'").select(F.regexp_extract("spec", "^([.]*/?[a-z]+)", 1).alias("prefix"))
    g = u.groupBy("prefix").agg(F.count("*").alias("n"))
    t = g.agg(F.sum("n").alias("total"))
    return g.join(F.broadcast(t), F.lit(True)).select("prefix", "n", F.round(F.col("n") / F.col("total"), 4).alias("share")).orderBy(F.col("n").desc(), "prefix").limit(20)


def module_of(s, d):
    """Calls between modules of callers and callees."""
    from .q_symbols import call_graph

    f = fact(s, d, "files").select("file_id", "submodule")
    g = call_graph(s, d).where("to_file IS NOT NULL")
    j = g.join(f.select(F.col("file_id").alias("from_file"), F.col("submodule").alias("from_module")), "from_file").join(f.select(F.col("file_id").alias("to_file"), F.col("submodule").alias("to_module")), "to_file")
    return j.groupBy("from_module", "to_module").agg(F.sum("calls").alias("calls"))


def excluded_candidates(s, d):
    """First policy that takes a dead candidate out of the list, by reason."""
    from .q_symbols import dead

    c = dead(s, d).join(fact(s, d, "own_uses"), ["file", "name"], "left")
    reason = F.when(F.col("file").endswith("/PROMO"), "public-api").when(F.col("kind").isin(*symbols.TYPE_ONLY), "declaration-only").when(F.col("namespace_shadowed"), "namespace-shadowed").when(F.col("uses") >= 2, "used-in-file").otherwise("kept")
    return c.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def generated_summary(s, d):
    f = fact(s, d, "files")
    gen = F.col("path").rlike("(^|/)_gen/|[.]generated[.]|_gen")
    return f.groupBy("ext").agg(F.count("*").alias("files"), F.count_if(gen).alias("generated"), F.count_if(gen & F.col("text").isNull()).alias("missing"))


def run_merge(s, d):
    """Runs with their recorded coverage: merged status, in the order failed, invalid, absent, complete."""
    r = fact(s, d, "runs").select("run_id", "repo", "exit_code", "stream_parse_status", F.length("stdout").alias("size")).distinct()
    status = F.when(F.col("exit_code").isNull(), "not-run").when(F.col("exit_code") < 0, "failed").when(F.col("stream_parse_status") == "invalid-json", "invalid").when(F.coalesce("size", F.lit(0)) == 0, "absent").otherwise("complete")
    return r.groupBy("repo", status.alias("status")).agg(F.count("*").alias("runs"))


def inline_lookup(s, d):
    """Whether a file has the looked-up inline pattern on one of the asked lines."""
    from ..sources.extract import _lines

    hits = _lines(fact(s, d, "files").where("ext IN ('ts', 'js', 'mjs') AND text IS NOT NULL")).where(F.col("body").rlike("catch [(]")).groupBy("file_id").agg(F.count("*").alias("all_lines"), F.count_if(F.col("line").between(10, 30)).alias("asked"))
    f = fact(s, d, "files").where("ext IN ('ts', 'js', 'mjs')")
    j = f.select("file_id", F.col("text").isNull().alias("unread")).join(hits, "file_id", "left").fillna({"all_lines": 0, "asked": 0})
    return j.select("file_id", F.when(F.col("unread"), "UNAVAILABLE").when(F.col("asked") > 0, "MATCH").when(F.col("all_lines") > 0, "OTHER_LINES").otherwise("NOT_OBSERVED").alias("result"))


QUERIES = {
    "markdown_tables": markdown_tables,
    "script_tools": script_tools,
    "glob_matches": globs,
    "range_bands": bands,
    "non_overlapping_spans": chosen_spans,
    "preimage_retention": retention,
    "coverage_two_keys": coverage_fallback,
    "acknowledgements": acks,
    "code_shapes": code_shapes,
    "unresolved_prefixes": specifier_prefixes,
    "module_calls": module_of,
    "excluded_candidates": excluded_candidates,
    "generated_summary": generated_summary,
    "run_status_merge": run_merge,
    "inline_lookup": inline_lookup,
}


def _sqls() -> dict[str, str]:
    from .q_misc import _ENT
    from .q_symbols import _CALLS, _DEAD
    from .q_text import _RES

    return {
        "acknowledgements": sql(f"WITH {_ENT} SELECT session, CASE WHEN acked THEN 'acknowledged' WHEN deliveries > 0 THEN 'delivered' ELSE 'waiting' END AS status, count(*) AS n, sum(n)::BIGINT AS occurrences FROM en GROUP BY 1, 2"),
        "unresolved_prefixes": sql(
            f"""WITH {_RES}, u AS (SELECT regexp_extract(spec, '^([.]*/?[a-z]+)', 1) AS prefix FROM rs WHERE outcome = 'unresolved') SELECT prefix, count(*) AS n, round(count(*) / (SELECT count(*) FROM u), 4) AS share FROM u GROUP BY 1 ORDER BY n DESC, prefix LIMIT 20"""
        ),
        "module_calls": sql(f"WITH {_CALLS} SELECT a.submodule AS from_module, b.submodule AS to_module, sum(calls)::BIGINT AS calls FROM graph JOIN files a ON a.file_id = from_file JOIN files b ON b.file_id = to_file GROUP BY 1, 2"),
        "excluded_candidates": sql(
            f"""WITH {_DEAD} SELECT CASE WHEN file LIKE '%/PROMO' THEN 'public-api' WHEN kind IN ('TSInterfaceDeclaration', 'TSTypeAliasDeclaration', 'TSModuleDeclaration') THEN 'declaration-only' WHEN namespace_shadowed THEN 'namespace-shadowed' WHEN uses >= 2 THEN 'used-in-file' ELSE 'kept' END AS reason, count(*) AS n FROM dead LEFT JOIN own_uses USING (file, name) GROUP BY 1"""
        ),
    }


SQL = {
    "markdown_tables": sql(
        """WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT *, regexp_full_match(line, '[|][-:| ]+[|]') AS ruler FROM l WHERE regexp_full_match(line, '[|].*[|]'))
        SELECT doc_id, pos::INT AS pos, trim(string_split(substr(line, 2, length(line) - 2), '|')[1]) AS first, trim(string_split(substr(line, 2, length(line) - 2), '|')[2]) AS second FROM t
        WHERE NOT ruler AND NOT EXISTS (SELECT 1 FROM t r WHERE r.ruler AND r.doc_id = t.doc_id AND r.pos = t.pos + 1)"""
    ),
    "glob_matches": sql(" UNION ALL ".join(f"SELECT file_id, '{g}' AS glob FROM files WHERE regexp_matches(path, '{connectors.glob_pattern(g)}')" for g in GLOBS)),
    "range_bands": sql(
        """SELECT CASE WHEN body_loc <= 0 THEN 0 ELSE floor(ln(body_loc) / ln(1.0 / 0.34)) + 1 END::BIGINT AS loc_band, CASE WHEN statement_count <= 0 THEN 0 ELSE floor(ln(statement_count) / ln(1.0 / 0.34)) + 1 END::BIGINT AS statement_band, is_async, count(*) AS functions FROM function_facts GROUP BY 1, 2, 3"""
    ),
    "preimage_retention": sql("SELECT epoch(TIMESTAMP '2025-09-01') - floor(epoch(seen)) > 2592000 AS expired, count(*) AS n FROM findings JOIN (SELECT finding_id, min(observed_at) AS seen FROM semantic_findings GROUP BY 1) USING (finding_id) GROUP BY 1"),
    "coverage_two_keys": sql(
        """WITH i AS (SELECT symbol AS path, hits FROM hits WHERE hits > 0 UNION ALL SELECT DISTINCT file || '::' || name, -1.0 FROM defs WHERE line = 7), r AS (SELECT file || '::' || name AS absolute, name AS relative FROM defs)
        SELECT absolute, relative, coalesce(a.hits, b.hits) AS hits FROM r LEFT JOIN i a ON a.path = absolute LEFT JOIN i b ON b.path = relative"""
    ),
    "code_shapes": sql(
        """SELECT regexp_replace(trim(regexp_replace(regexp_replace(code, '[ \t]+', ' ', 'g'), '; ?$', '')), '[0-9]+', '0', 'g') AS shape, count(*) AS n, count(DISTINCT file_id) AS files FROM (SELECT file_id, unnest(string_split(source, chr(10))) AS code FROM functions) WHERE code LIKE '%;' GROUP BY 1 HAVING count(*) >= 3"""
    ),
    "generated_summary": sql("SELECT ext, count(*) AS files, count(*) FILTER (g) AS generated, count(*) FILTER (g AND text IS NULL) AS missing FROM (SELECT *, regexp_matches(path, '(^|/)_gen/|[.]generated[.]|_gen') AS g FROM files) GROUP BY 1"),
    "run_status_merge": sql(
        """SELECT repo, CASE WHEN exit_code IS NULL THEN 'not-run' WHEN exit_code < 0 THEN 'failed' WHEN stream_parse_status = 'invalid-json' THEN 'invalid' WHEN coalesce(size, 0) = 0 THEN 'absent' ELSE 'complete' END AS status, count(*) AS runs
        FROM (SELECT DISTINCT run_id, repo, exit_code, stream_parse_status, length(stdout) AS size FROM runs) GROUP BY 1, 2"""
    ),
    "inline_lookup": sql(
        """WITH l AS (SELECT file_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS body FROM files WHERE ext IN ('ts', 'js', 'mjs')),
        h AS (SELECT file_id, count(*) AS a, count(*) FILTER (line BETWEEN 10 AND 30) AS q FROM l WHERE contains(body, 'catch (') GROUP BY 1)
        SELECT f.file_id, CASE WHEN text IS NULL THEN 'UNAVAILABLE' WHEN q > 0 THEN 'MATCH' WHEN a > 0 THEN 'OTHER_LINES' ELSE 'NOT_OBSERVED' END AS result FROM files f LEFT JOIN h ON h.file_id = f.file_id WHERE ext IN ('ts', 'js', 'mjs')"""
    ),
} | _sqls()
