"""Queries of lookups, export actions, owners, rankings and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import clones, lookups, resolver, symbols
from ..sources import extract
from ..sources.facts import fact, sql

INTENTS = (("loadWindowBuffer", "src/api"), ("storeQueueDigest", "services/mail"), ("listMetricPolicies", "tools/lint"), ("createOrderSignal", "lib/io"), ("fetchReport", "apps/portal"))
_DIR = "^(.*)/[^/]*$"


def _intents(s):
    return s.createDataFrame(list(INTENTS), "intent string, dir string")


def semantic_candidates(s, d):
    names = fact(s, d, "functions").select(F.regexp_replace("name", "[0-9]+$", "").alias("name"))
    return lookups.semantic_candidates(names, _intents(s))


def sibling_operations(s, d):
    """Suppressed candidates of every intent as sibling operations, by the first reason that mutes them."""
    f = fact(s, d, "functions").select(F.regexp_replace("name", "[0-9]+$", "").alias("name"), "owner_file").distinct()
    c = semantic_candidates(s, d).where("status <> 'hint'").join(_intents(s), "intent").join(f, "name")
    status = lookups.sibling_status(F.col("intent"), F.col("name"), F.col("owner_file"), F.col("owner_file").rlike("^tests/"), F.lit(True), F.col("status") == "suppressed:single-non-weak-token-only", F.regexp_extract("owner_file", _DIR, 1) == F.col("dir"))
    return c.groupBy("intent", status.alias("result")).agg(F.count("*").alias("candidates"), F.count_distinct("name").alias("names"))


def operation_families(s, d):
    f = fact(s, d, "functions")
    return f.groupBy(lookups.operation_family(F.col("name")).alias("family")).agg(F.count("*").alias("functions"), F.count_distinct("owner_file").alias("files"))


def _exports(s, d):
    f = fact(s, d, "files").where("ext IN ('ts', 'js', 'mjs') AND text IS NOT NULL")
    defs = extract.definitions(f, "js").where("exported").select("file_id", "name", "kind", "line")
    body = extract._lines(f).select("file_id", "line", "body")
    return symbols.internal_uses(defs.select("file_id", "name").distinct(), f).join(defs, ["file_id", "name"]).join(body, ["file_id", "line"])


def export_actions(s, d):
    e = _exports(s, d)
    return e.select("file_id", "name", "line", lookups.export_action(F.col("kind"), F.col("uses"), F.col("body")).alias("action"))


def capabilities(s, d):
    return s.createDataFrame(list(lookups.CAPABILITIES), "family string, status string")


def helper_drift(s, d):
    """Tiers of parts by how many deliver them, before and after a date."""
    from .q_deltas import CANON

    li = fact(s, d, "lineitem").groupBy(F.concat(F.lit("p"), "l_partkey").alias("identity"), (F.col("l_shipdate") < F.lit(CANON).cast("timestamp")).alias("early"))
    n = li.agg(F.count_distinct("l_suppkey").alias("n"), F.min("l_quantity").alias("q"))
    label = F.when(F.col("q") <= 1, "severely-any-contaminated-helper").when(F.col("n") >= 16, "central-helper").when(F.col("n") >= 12, "shared-helper").otherwise("zero-internal-fan-in-helper")
    t = n.select("identity", "early", label.alias("label"))
    evidence = fact(s, d, "defs").where("kind = 'ClassDeclaration'").select(F.col("name").alias("identity"))
    return lookups.helper_drift(t.where("early").drop("early"), t.where("NOT early").drop("early"), evidence)


def owners(s, d):
    """The package of every file: the deepest top directory with a JSON file, else the repo's last."""
    f = fact(s, d, "files").select("repo", "path")
    return symbols.nearest_owner(f, f.where("path LIKE '%.json'").select("repo", F.split("path", "/")[0].alias("package_dir")))


def modes(s, d):
    return symbols.repo_modes(fact(s, d, "files"))


def namespaces(s, d):
    return symbols.namespace_uses(fact(s, d, "files").where("ext IN ('ts', 'js', 'mjs') AND text IS NOT NULL"))


def worst_barrel(s, d):
    """The least compliance of all packages, and its gate; packages without imports do not count."""
    from .q_text import barrels

    w = barrels(s, d).agg(F.round(F.coalesce(F.min("compliance"), F.lit(100.0)) / 100, 3).alias("worst"))
    return w.select("worst", F.when(F.col("worst") < 0.5, "fix").when(F.col("worst") < 0.8, "watch").otherwise("ok").alias("gate"))


def specifier_matches(s, d):
    """Whether an unresolved specifier may mean a file that does not parse, by repo: pairs meet by repo and top directory."""
    from .q_text import resolved

    f = fact(s, d, "files").select("file_id", "repo", "path", "submodule", "parse_error")
    u = resolved(s, d).where("outcome = 'unresolved'").join(f.select("file_id", "repo", "path", "submodule"), "file_id")
    bad = f.where("parse_error").select("repo", "submodule", F.col("path").alias("bad"))
    j = u.join(bad, ["repo", "submodule"])
    r = lookups.specifier_could_match(F.col("spec"), F.regexp_extract("path", _DIR, 1), F.col("bad"), F.lit(True))
    return j.groupBy("repo", r.alias("result")).agg(F.count("*").alias("pairs"))


def type_texts(s, d):
    t = fact(s, d, "shapes").select(F.explode("types").alias("type"))
    return t.groupBy(text.type_text(F.col("type")).alias("type")).agg(F.count("*").alias("n"))


def artifact_hashes(s, d):
    """Artifacts of equal content, whatever the order of their keys."""
    a = text.stable_json_hash(fact(s, d, "artifact_files").select("artifact_id", "producer", "payload").distinct(), "payload")
    return a.groupBy("producer", "hash").agg(F.count("*").alias("artifacts"), F.min("artifact_id").alias("first_id"))


def oversize(s, d):
    return fact(s, d, "function_facts").orderBy(F.col("body_loc").desc(), "identity").limit(20).select("identity", "body_loc")


def ranked_groups(s, d):
    """Clone groups, generated ones last, then by size and largest body: a range-partitioned sort."""
    g = clones.hash_groups(fact(s, d, "function_facts"), "structure_hash", 3, 2)
    return g.orderBy("generated_only", F.col("size").desc(), F.col("max_loc").desc(), "first_identity").select("hash", "size", "max_loc", "generated_only")


def ranked_blocks(s, d):
    """The largest block clones, a hundred under review and a hundred muted."""
    from .q_clones import blocks

    p = fact(s, d, "files").select("file_id", "path")
    b = blocks(s, d).join(p.select(F.col("file_id").alias("file"), F.col("path").alias("p1")), "file").join(p.select(F.col("file_id").alias("file2"), F.col("path").alias("p2")), "file2")
    b = b.withColumn("muted", clones.block_policy(F.col("p1"), F.col("p2")).startswith("muted"))
    return lookups.first_of_each(b, ["muted"], [F.col("tokens").desc(), "file", "start", "file2", "start2"], 100).select("muted", "rank", "tokens", "file", "start", "file2", "start2")


def ranked_fixes(s, d):
    from .q_deltas import _findings, fix_plan

    f = fix_plan(s, d).join(_findings(s, d).select("id", "source_file_id"), "id")
    return f.orderBy("tier", F.col("source_file_id").asc_nulls_last(), "id").select("tier", "source_file_id", "id", "reason")


def missing_artifacts(s, d):
    """Producers whose artifacts a repo lacks."""
    a = fact(s, d, "artifact_files").where("repo IS NOT NULL").groupBy("repo").agg(F.collect_set("producer").alias("have"))
    known = F.array(*[F.lit(p) for p in ("discipline", "rank-fixes", "rust-health")])
    return a.select("repo", F.array_join(F.array_except(known, "have"), ",").alias("missing"))


def call_edges(s, d):
    """Calls resolved through the caller's own functions and its imports."""
    from .q_symbols import _callees, _calls
    from .q_text import resolved

    files = fact(s, d, "files").select("file_id", "repo", "path")
    to = resolved(s, d).join(files.select("file_id", "repo"), "file_id")
    ids = files.groupBy(F.col("repo").alias("r"), F.col("path").alias("t")).agg(F.min("file_id").alias("to_id"))
    to = to.join(ids, (F.col("repo") == F.col("r")) & (F.col("target") == F.col("t")), "left").select("file_id", "spec", "to_id")
    names = fact(s, d, "imports").select("file_id", "spec", F.explode(F.split("names", ",")).alias("n")).withColumn("n", F.trim("n")).where("n <> ''")
    parts = F.split("n", " as ")
    i = names.join(to, ["file_id", "spec"], "left").select(F.col("file_id").alias("file"), F.trim(F.element_at(parts, -1)).alias("local"), F.trim(parts[0]).alias("imported"), F.col("to_id").alias("target"))
    return resolver.resolve_calls(_calls(s, d), _callees(s, d), i)


def rust_functions(s, d):
    """Groups of Rust functions of equal structure: bodies with names and numbers put aside."""
    return clones.hash_groups(fact(s, d, "rust_function_facts"), "structure_hash", 3, 2)


def stamped(s, d):
    """Rust definitions with the time at which their file was observed."""
    at = fact(s, d, "source_files").groupBy(F.col("source_file_id").alias("file_id")).agg(F.min("observed_at").alias("observed_at"))
    return extract.definitions(fact(s, d, "files"), "rs").join(at, "file_id").select("file_id", "line", "name", F.unix_seconds("observed_at").alias("observed_at"), "kind")


def relative(s, d):
    return fact(s, d, "files").select("file_id", text.relative_path(F.col("path"), "packages/").alias("path"))


def performance(s, d):
    """Runs of every repo: wall time and bytes of their streams."""
    r = fact(s, d, "runs").select("run_id", "repo", "elapsed_ms", F.octet_length("stdout").alias("size")).distinct()
    return r.groupBy("repo").agg(F.count("*").alias("runs"), F.sum("elapsed_ms").alias("total_ms"), F.max("elapsed_ms").alias("longest_ms"), F.sum("size").alias("bytes"))


def lifecycle(s, d):
    """The worst status of the runs of every repo, and whether it has artifacts to go with them."""
    r = fact(s, d, "runs").select("run_id", "repo", "exit_code").distinct()
    rank = F.when(F.col("exit_code").isNull(), 1).when(F.col("exit_code") == 0, 0).otherwise(2)
    g = r.groupBy("repo").agg(F.max(rank).alias("worst"), F.count("*").alias("runs"))
    a = fact(s, d, "artifact_files").select("repo").distinct().withColumn("has", F.lit(True))
    status = F.element_at(F.array(F.lit("complete"), F.lit("not-run"), F.lit("failed")), F.col("worst") + 1)
    return g.join(a, "repo", "left").select("repo", status.alias("status"), "runs", F.coalesce("has", F.lit(False)).alias("has_artifacts"))


QUERIES = {
    "semantic_candidates": semantic_candidates,
    "sibling_operations": sibling_operations,
    "operation_families": operation_families,
    "export_actions": export_actions,
    "resolver_capabilities": capabilities,
    "helper_drift": helper_drift,
    "nearest_owner": owners,
    "repo_modes": modes,
    "namespace_uses": namespaces,
    "barrel_worst": worst_barrel,
    "specifier_matches": specifier_matches,
    "type_texts": type_texts,
    "artifact_hashes": artifact_hashes,
    "function_oversize_top": oversize,
    "clone_groups_ranked": ranked_groups,
    "block_clones_ranked": ranked_blocks,
    "fixes_ranked": ranked_fixes,
    "artifacts_missing": missing_artifacts,
    "rust_function_clones": rust_functions,
    "call_edges": call_edges,
    "definitions_observed": stamped,
    "relative_paths": relative,
    "producer_performance": performance,
    "lifecycle_status": lifecycle,
}


def _sqls() -> dict[str, str]:
    from .q_clones import _BLOCKS
    from .q_deltas import CANON, _RANK
    from .q_extract import _def_sql
    from .q_symbols import _CALLS
    from .q_text import _RES

    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    norm = "CASE WHEN w IN ('cfg', 'configuration') THEN 'config' WHEN length(w) > 3 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' AND w NOT LIKE '%us' THEN w[:-2] ELSE w END"

    def tokens(x: str) -> str:
        return f"(SELECT list(t ORDER BY o) FROM (SELECT t, min(o) AS o FROM (SELECT {norm} AS t, o FROM (SELECT unnest(ws) AS w, unnest(range(len(ws))) AS o FROM (SELECT string_split_regex(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+') AS ws))) WHERE length(t) >= 2 AND t NOT IN ({quoted(lookups.STOP_TOKENS)}) GROUP BY t))"

    family = lambda c: "CASE " + " ".join(f"WHEN {c} IN ({quoted(v)}) THEN '{k}'" for k, v in lookups.FAMILIES.items()) + " END"
    verbs = quoted(v for vs in lookups.FAMILIES.values() for v in vs)
    rows = ", ".join(f"('{a}', '{b}')" for a, b in INTENTS)
    sem = f"""it(intent, dir) AS (VALUES {rows}), nm AS (SELECT DISTINCT regexp_replace(name, '[0-9]+$', '') AS name FROM functions), nt AS (SELECT name, {tokens("name")} AS ts FROM nm), q AS (SELECT intent, dir, {tokens("intent")} AS ts FROM it),
        sc AS (SELECT intent, dir, name, nt.ts AS nts, q.ts AS its, list_sort(list_intersect(nt.ts, q.ts)) AS common FROM nt, q WHERE len(list_intersect(nt.ts, q.ts)) > 0),
        st AS (SELECT *, len(common) AS score, len(list_filter(common, lambda t: t NOT IN ({quoted(lookups.WEAK_TOKENS)}))) AS strong FROM sc),
        sm AS (SELECT *, CASE WHEN strong = 0 THEN 'suppressed:weak-tokens-only' WHEN score < 2 THEN 'suppressed:single-non-weak-token-only' ELSE 'hint' END AS status FROM st)"""
    tier = "CASE WHEN q <= 1 THEN 'severely-any-contaminated-helper' WHEN n >= 16 THEN 'central-helper' WHEN n >= 12 THEN 'shared-helper' ELSE 'zero-internal-fan-in-helper' END"
    return {
        "semantic_candidates": sql(f"WITH {sem} SELECT intent, name, score, strong, array_to_string(common, ',') AS tokens, status FROM sm"),
        "sibling_operations": sql(
            f"""WITH {sem}, f AS (SELECT DISTINCT regexp_replace(name, '[0-9]+$', '') AS name, owner_file FROM functions),
            c AS (SELECT sm.*, owner_file, {family("nts[1]")} AS fn, {family("its[1]")} AS fi, list_filter(list_intersect(list_slice(nts, 2, 1000), list_slice(its, 2, 1000)), lambda t: t NOT IN ({verbs})) AS sh FROM sm JOIN f USING (name) WHERE status <> 'hint'),
            r AS (SELECT intent, name, CASE WHEN name = '' OR coalesce(owner_file, '') = '' THEN 'insufficient-metadata' WHEN owner_file LIKE 'tests/%' THEN 'policy-excluded' WHEN status <> 'suppressed:single-non-weak-token-only' THEN 'insufficient-suppressed-support'
              WHEN regexp_extract(owner_file, '{_DIR}', 1) <> dir THEN 'locality-mismatch' WHEN fi IS NULL OR fn IS NULL THEN 'unknown-operation' WHEN len(sh) = 0 THEN 'domain-mismatch' WHEN fi <> fn THEN 'operation-family-mismatch' WHEN fi <> 'read-query' THEN 'family-not-promotable' ELSE 'promoted' END AS result FROM c)
            SELECT intent, result, count(*) AS candidates, count(DISTINCT name) AS names FROM r GROUP BY 1, 2"""
        ),
        "operation_families": sql(f"SELECT {family('t')} AS family, count(*) AS functions, count(DISTINCT owner_file) AS files FROM (SELECT owner_file, {tokens('name')}[1] AS t FROM functions) GROUP BY 1"),
        "export_actions": sql(
            f"""WITH {_def_sql("js")}, e AS (SELECT file_id, name, kind, line, body FROM df_js WHERE exported), w AS (SELECT file_id, unnest(regexp_extract_all(text, '{symbols.IDENTIFIER}')) AS name FROM files), n AS (SELECT file_id, name, count(*) AS n FROM w GROUP BY 1, 2)
            SELECT e.file_id, e.name, line, CASE WHEN n - 1 > 0 THEN 'demote_export_declaration' WHEN kind = 'class' AND regexp_matches(body, '\\bextends\\b|@[A-Za-z]|\\bstatic\\b|\\[[^\\]]*\\] *[(=]') THEN 'none'
              WHEN kind = 'variable' AND regexp_matches(body, '= *(?:await |new )?[A-Za-z_$][A-Za-z0-9_$.]*[(]') THEN 'none' WHEN kind IN ('interface', 'type-alias', 'enum') THEN 'delete_type_declaration' ELSE 'delete_value_declaration' END AS action
            FROM e JOIN n ON n.file_id = e.file_id AND n.name = e.name"""
        ),
        "resolver_capabilities": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in lookups.CAPABILITIES) + ") x(family, status)",
        "helper_drift": sql(
            f"""WITH g AS (SELECT 'p' || l_partkey AS identity, l_shipdate < TIMESTAMP '{CANON}' AS early, count(DISTINCT l_suppkey) AS n, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2), t AS (SELECT identity, early, {tier} AS label FROM g),
            j AS (SELECT identity, a.label AS old, b.label AS "new" FROM (SELECT * FROM t WHERE early) a FULL JOIN (SELECT * FROM t WHERE NOT early) b USING (identity)),
            k AS (SELECT *, coalesce(old LIKE 'severely%', false) OR coalesce("new" LIKE 'severely%', false) AS dirty, identity IN (SELECT name FROM defs WHERE kind = 'ClassDeclaration') AS seen FROM j WHERE old IS DISTINCT FROM "new")
            SELECT identity, old, "new", CASE WHEN "new" IS NULL THEN 'helper-removed' WHEN old IS NULL THEN 'helper-added' WHEN dirty AND seen THEN 'contamination-changed' WHEN NOT dirty THEN 'fan-in-tier-changed' ELSE 'label-changed' END AS category FROM k"""
        ),
        "nearest_owner": sql(
            """WITH p AS (SELECT DISTINCT repo, split_part(path, '/', 1) AS dir FROM files WHERE path LIKE '%.json'), l AS (SELECT repo, min(dir) AS last FROM p GROUP BY 1), f AS (SELECT DISTINCT repo, path FROM files)
            SELECT f.repo, path, coalesce(p.dir, last) AS package_dir, p.dir IS NOT NULL AS inside FROM f LEFT JOIN p ON p.repo = f.repo AND p.dir = split_part(path, '/', 1) LEFT JOIN l ON l.repo = f.repo"""
        ),
        "repo_modes": sql(
            """SELECT repo, CASE WHEN bool_or(path = 'package.json' AND json_valid(text)) THEN 'single-package' ELSE 'non-node' END AS mode, CASE WHEN bool_or(path = 'package.json' AND json_valid(text)) THEN 'javascript' WHEN bool_or(path IN ('pyproject.toml', 'setup.py')) THEN 'python' ELSE 'unknown' END AS language,
            count(*) FILTER (path LIKE '%/package.json') AS packages FROM files GROUP BY 1"""
        ),
        "specifier_matches": sql(
            rf"""WITH {_RES}, u AS (SELECT f.repo, f.path, f.submodule, rs.spec FROM rs JOIN files f USING (file_id) WHERE outcome = 'unresolved'), b AS (SELECT repo, submodule, path AS bad FROM files WHERE parse_error),
            j AS (SELECT u.repo, regexp_replace(regexp_extract(path, '{_DIR}', 1) || '/' || substr(spec, 3), '[.](?:d[.])?(?:[mc]?[tj]sx?)$', '') = regexp_replace(bad, '[.](?:d[.])?(?:[mc]?[tj]sx?)$', '') AS hit FROM u JOIN b ON b.repo = u.repo AND b.submodule = u.submodule)
            SELECT repo, CASE WHEN hit THEN 'match' ELSE 'no-match' END AS result, count(*) AS pairs FROM j GROUP BY 1, 2"""
        ),
        "type_texts": sql(
            r"""SELECT regexp_replace(trim(regexp_replace(regexp_replace(type, '\s+', ' ', 'g'), ' ?([<>()\[\]{}|&:,;=?]) ?', '\1', 'g')), '(?: ?; ?)+$', '') AS type, count(*) AS n FROM (SELECT unnest(types) AS type FROM shapes) GROUP BY 1"""
        ),
        "function_oversize_top": sql("SELECT identity, body_loc FROM function_facts ORDER BY body_loc DESC, identity LIMIT 20"),
        "clone_groups_ranked": sql("SELECT structure_hash AS hash, count(*) AS size, max(body_loc) AS max_loc, bool_and(generated) AS generated_only FROM function_facts WHERE structure_hash IS NOT NULL AND body_loc >= 3 AND statement_count >= 2 GROUP BY 1 HAVING count(*) >= 2"),
        "block_clones_ranked": sql(
            f"""WITH {_BLOCKS}, m AS (SELECT blk.*, p1 = p2 OR (regexp_matches(p1, '(^|/)tests?/|[.](test|spec)[.]') AND regexp_matches(p2, '(^|/)tests?/|[.](test|spec)[.]')) AS muted FROM blk JOIN (SELECT file_id, path AS p1 FROM files) x ON x.file_id = file JOIN (SELECT file_id, path AS p2 FROM files) y ON y.file_id = file2)
            SELECT muted, rank, tokens, file, start, file2, start2 FROM (SELECT *, row_number() OVER (PARTITION BY muted ORDER BY tokens DESC, file, start, file2, start2)::INT AS rank FROM m) WHERE rank <= 100"""
        ),
        "fixes_ranked": sql(f"WITH {_RANK} SELECT tier, source_file_id, id, reason FROM pl"),
        "artifacts_missing": sql("SELECT repo, array_to_string(list_filter(['discipline', 'rank-fixes', 'rust-health'], lambda p: NOT list_contains(h, p)), ',') AS missing FROM (SELECT repo, list(DISTINCT producer) AS h FROM artifact_files WHERE repo IS NOT NULL GROUP BY 1)"),
        "call_edges": sql(
            f"""WITH {_CALLS}, {_RES}, i AS (SELECT DISTINCT file_id, spec, trim(string_split(trim(unnest(string_split(names, ','))), ' as ')[-1]) AS local FROM imports), k AS (SELECT i.file_id, local, bool_or(target IS NOT NULL) AS known FROM i LEFT JOIN rs ON rs.file_id = i.file_id AND rs.spec = i.spec GROUP BY 1, 2),
            c AS (SELECT caller_file, callee, count(*) AS calls FROM calls GROUP BY 1, 2), o AS (SELECT DISTINCT file_id, name FROM functions)
            SELECT caller_file AS from_file, CASE WHEN o.name IS NOT NULL THEN caller_file END AS to_file, callee, calls, CASE WHEN o.name IS NOT NULL THEN 'internal-same-file' WHEN local IS NULL THEN 'unresolved' WHEN NOT known THEN 'imported-unresolved' ELSE 'imported-missing' END AS outcome
            FROM c LEFT JOIN o ON o.file_id = caller_file AND o.name = callee LEFT JOIN k ON k.file_id = caller_file AND k.local = callee"""
        ),
        "rust_function_clones": sql(
            """SELECT structure_hash AS hash, count(*) AS size, count(DISTINCT owner_file) AS files, min(body_loc) AS min_loc, max(body_loc) AS max_loc, bool_and(generated) AS generated_only, min(identity) AS first_identity FROM rust_function_facts WHERE body_loc >= 3 AND statement_count >= 2 GROUP BY 1 HAVING count(*) >= 2"""
        ),
        "definitions_observed": sql(f"WITH {_def_sql('rs')} SELECT file_id, line, name, kind, floor(epoch(o))::BIGINT AS observed_at FROM df_rs JOIN (SELECT source_file_id AS file_id, min(observed_at) AS o FROM source_files GROUP BY 1) USING (file_id)"),
        "relative_paths": sql("SELECT file_id, CASE WHEN starts_with(path, 'packages/') THEN substr(path, 10) ELSE path END AS path FROM files"),
        "producer_performance": sql("SELECT repo, count(*) AS runs, sum(elapsed_ms)::BIGINT AS total_ms, max(elapsed_ms) AS longest_ms, sum(strlen(stdout))::BIGINT AS bytes FROM (SELECT DISTINCT run_id, repo, elapsed_ms, stdout FROM runs) GROUP BY 1"),
        "lifecycle_status": sql(
            """SELECT r.repo, CASE WHEN max(CASE WHEN exit_code IS NULL THEN 1 WHEN exit_code = 0 THEN 0 ELSE 2 END) = 2 THEN 'failed' WHEN max(CASE WHEN exit_code IS NULL THEN 1 WHEN exit_code = 0 THEN 0 ELSE 2 END) = 1 THEN 'not-run' ELSE 'complete' END AS status, count(*) AS runs,
            r.repo IN (SELECT repo FROM artifact_files WHERE repo IS NOT NULL) AS has_artifacts FROM (SELECT DISTINCT run_id, repo, exit_code FROM runs) r GROUP BY r.repo"""
        ),
    }


SQL = _sqls()
