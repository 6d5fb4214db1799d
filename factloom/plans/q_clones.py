"""Queries of the clone and shape families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clones, shapes
from ..sources.facts import fact, sql

# fixed values
LOW_INFO_NAMES = ("Props", "Options", "Config", "State", "Result", "Meta", "Item", "Data", "Context", "Args", "Params", "Response", "Request", "Handler", "Input", "Output")


def _groups(key, loc, st):
    return lambda s, d: clones.hash_groups(fact(s, d, "function_facts"), key, loc, st)


def shared(s, d):
    return clones.shared_tokens(fact(s, d, "function_facts"), "structure_hash")


def near(s, d):
    return clones.near_functions(fact(s, d, "function_facts"))


def near_top(s, d):
    return near(s, d).orderBy("generated_only", F.col("score").desc(), "l_identity", "r_identity").limit(50)


def near_diag(s, d):
    return clones.near_diagnostics(fact(s, d, "function_facts"))


def blocks(s, d):
    files = fact(s, d, "files").where("ext IN ('ts', 'js', 'mjs')").select(F.col("file_id").alias("file"), "text")
    return clones.linked_windows(clones.text_windows(files), chunk=F.col("file") % 64)


def block_policy(s, d):
    paths = fact(s, d, "files").select("file_id", "path")
    b = blocks(s, d).join(paths.select(F.col("file_id").alias("file"), F.col("path").alias("p1")), "file").join(paths.select(F.col("file_id").alias("file2"), F.col("path").alias("p2")), "file2")
    return b.groupBy(clones.block_policy(F.col("p1"), F.col("p2")).alias("status")).agg(F.count("*").alias("pairs"), F.max("tokens").alias("longest"))


def shape_index(s, d):
    return shapes.index(fact(s, d, "shapes"))


def shape_near(s, d):
    return shapes.near(fact(s, d, "shapes"))


def shape_near_top(s, d):
    return shape_near(s, d).orderBy(F.col("score").desc(), F.col("field_jaccard").desc(), "left", "right").limit(20)


def inline(s, d):
    b = fact(s, d, "files").where("ext IN ('ts', 'js', 'mjs')").select("file_id", F.explode(F.regexp_extract_all("text", F.lit(r"catch [(][^)]*[)] [{][^}]*[}]"), F.lit(0))).alias("block"))
    return shapes.inline_groups(b.withColumn("block", F.regexp_replace("block", "[a-z]+[.][A-Za-z]+", "x.y")))


def collisions(s, d):
    f = fact(s, d, "shapes")
    imp = fact(s, d, "imports").select(F.explode(F.regexp_extract_all("names", F.lit("([A-Za-z_]+)[0-9]*"), F.lit(1))).alias("name")).groupBy("name").agg(F.count("*").alias("fan_in"))
    base = F.regexp_replace("exported_name", "[0-9]+$", "")
    defs = f.select(base.alias("name"), "identity", F.exists("types", lambda t: t.rlike(r"\bany\b")).alias("contaminated")).join(imp, "name", "left").fillna({"fan_in": 0})
    return shapes.name_collisions(defs, LOW_INFO_NAMES)


QUERIES = {
    "clones_exact": _groups("exact_hash", 1, 1),
    "clones_structure": _groups("structure_hash", 3, 2),
    "clones_signature": _groups("signature_hash", 0, 0),
    "clones_shared_tokens": shared,
    "near_functions": near,
    "near_functions_top": near_top,
    "near_diagnostics": near_diag,
    "block_clones": blocks,
    "block_clone_policy": block_policy,
    "shape_index": shape_index,
    "shape_near": shape_near,
    "shape_near_top": shape_near_top,
    "inline_pattern_groups": inline,
    "canon_type_labels": collisions,
}


def _group_sql(key: str, loc: int, st: int) -> str:
    return f"""SELECT {key} AS hash, count(*) AS size, count(DISTINCT owner_file) AS files, min(body_loc) AS min_loc, max(body_loc) AS max_loc, bool_and(generated) AS generated_only, min(identity) AS first_identity
    FROM function_facts WHERE {key} IS NOT NULL AND body_loc >= {loc} AND statement_count >= {st} GROUP BY 1 HAVING count(*) >= 2"""


_GENERIC = ", ".join(f"'{t}'" for t in clones.GENERIC_CALL_TOKENS)
_NEAR = f"""
sg AS (SELECT *, list_sort(list_filter(call_tokens, lambda t: strlen(t) >= 4 AND t NOT IN ({_GENERIC}))) AS sig, list_sort(list_distinct(list_filter(string_split_regex(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: length(w) >= 2))) AS words FROM function_facts),
idf AS (SELECT token, count(*) AS df, ln(((SELECT count(*) FROM sg) + 1.0) / (count(*) + 1.0)) AS idf FROM (SELECT unnest(sig) AS token FROM sg) GROUP BY 1),
ex AS (SELECT exact_hash FROM sg WHERE body_loc >= 1 AND statement_count >= 1 GROUP BY 1 HAVING count(*) >= 2),
st AS (SELECT structure_hash FROM sg WHERE body_loc >= 3 AND statement_count >= 2 GROUP BY 1 HAVING count(*) >= 2),
el AS (SELECT * FROM sg WHERE len(sig) > 0 AND NOT (body_loc >= 1 AND statement_count >= 1 AND exact_hash IN (FROM ex)) AND NOT (body_loc >= 3 AND statement_count >= 2 AND structure_hash IN (FROM st))),
post AS (SELECT identity, token FROM (SELECT identity, unnest(sig) AS token FROM el) JOIN idf USING (token) WHERE idf >= 3),
cand AS (SELECT DISTINCT a.identity AS l, b.identity AS r FROM post a JOIN post b ON a.token = b.token AND a.identity < b.identity),
pairs AS (SELECT l, r, x.sig AS ls, y.sig AS rs, x.words AS lw, y.words AS rw, x.generated AND y.generated AS generated_only, 1 - abs(x.body_loc - y.body_loc) / greatest(x.body_loc, y.body_loc) AS ls_sim,
  CASE WHEN greatest(x.statement_count, y.statement_count) <= 0 THEN 0 ELSE 1 - abs(x.statement_count - y.statement_count) / greatest(x.statement_count, y.statement_count) END AS st_sim
  FROM cand JOIN el x ON x.identity = l JOIN el y ON y.identity = r WHERE x.is_async = y.is_async AND abs(x.param_count - y.param_count) <= 1),
sc AS (SELECT p.*, list_sort(list_filter(ls, lambda t: list_contains(rs, t))) AS sh, (SELECT sum(idf ORDER BY token) FROM idf WHERE list_contains(p.ls, token) AND list_contains(p.rs, token)) AS s,
  CASE WHEN len(list_distinct(lw || rw)) = 0 THEN 0 ELSE len(list_intersect(lw, rw)) / len(list_distinct(lw || rw)) END AS nj FROM pairs p WHERE ls_sim >= 0.34 AND st_sim >= 0.34),
near AS (SELECT l AS l_identity, r AS r_identity, round(least(s / 6.0, 1.0) * 0.45 + nj * 0.25 + ls_sim * 0.15 + st_sim * 0.15, 3) AS score, array_to_string(sh, ',') AS shared_tokens, generated_only FROM sc WHERE least(s / 6.0, 1.0) >= 0.5 OR nj >= 0.34)"""
_RESERVED = ", ".join(f"'{w}'" for w in clones.RESERVED)
_BLOCKS = f"""
lines AS (SELECT file_id, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS body FROM files WHERE ext IN ('ts', 'js', 'mjs')),
sco AS (SELECT *, sum(regexp_matches(body, '{clones.SCOPE}')::INT) OVER (PARTITION BY file_id ORDER BY line) AS scope FROM lines),
tk AS (SELECT file_id, line, scope, unnest(range(len(a))) AS i, unnest(a) AS t FROM (SELECT file_id, line, scope, regexp_extract_all(body, '{clones.TOKEN}', 0) AS a FROM sco)),
tp AS (SELECT file_id AS file, row_number() OVER (PARTITION BY file_id ORDER BY line, i) - 1 AS pos, line, scope, t, regexp_matches(t, '^[A-Za-z_$]') AND t NOT IN ({_RESERVED}) AS ident FROM tk),
fu AS (SELECT *, min(pos) OVER (PARTITION BY file, scope, t) AS use1 FROM tp),
tok AS (SELECT file, pos, line, CASE WHEN ident THEN '$' || dense_rank() OVER (PARTITION BY file, scope, ident ORDER BY use1) WHEN regexp_matches(t, '^[0-9]') THEN '0' ELSE t END AS value FROM fu),
gr AS (SELECT file, pos, line, last(line) OVER w AS end_line, count(*) OVER w AS n, list(value) OVER w AS g FROM tok WINDOW w AS (PARTITION BY file ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
g2 AS (SELECT file, pos, line, end_line, md5(array_to_string(g, chr(1))) AS h FROM gr WHERE n = 50),
hd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h, file % 64 ORDER BY file, pos) AS r FROM g2) WHERE r = 1),
lk AS (SELECT file, pos, line, end_line, lead(file) OVER v AS file2, lead(pos) OVER v AS pos2, lead(line) OVER v AS line2, lead(end_line) OVER v AS end_line2 FROM g2 WINDOW v AS (PARTITION BY h, file % 64 ORDER BY file, pos)
  UNION ALL SELECT file, pos, line, end_line, lead(file) OVER v, lead(pos) OVER v, lead(line) OVER v, lead(end_line) OVER v FROM hd WINDOW v AS (PARTITION BY h ORDER BY file % 64)),
ok AS (SELECT *, pos2 - pos AS delta, pos - row_number() OVER (PARTITION BY file, file2, pos2 - pos ORDER BY pos) AS island FROM lk WHERE file2 IS NOT NULL AND (file <> file2 OR pos2 - pos >= 50)),
blk AS (SELECT file, file2, min(pos) AS start, min(pos) + delta AS start2, max(pos) - min(pos) + 50 AS tokens, min(line) AS line, max(end_line) AS end_line, min(line2) AS line2, max(end_line2) AS end_line2 FROM ok GROUP BY file, file2, delta, island
  HAVING max(end_line) - min(line) + 1 >= 5 AND max(end_line2) - min(line2) + 1 >= 5)"""
_STOP = ", ".join(f"'{t}'" for t in shapes.STOP_TOKENS)
_SHAPE = f"""
sh AS (SELECT identity, fields, list_distinct(list_filter(string_split_regex(lower(regexp_replace(exported_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))) AS words, regexp_extract(owner_file, '^(.*)/[^/]*$', 1) AS dir FROM shapes WHERE len(fields) > 0),
pr AS (SELECT a.identity AS l, b.identity AS r, len(list_intersect(a.fields, b.fields)) AS shared, len(a.fields) + len(b.fields) AS total, len(list_intersect(a.words, b.words)) AS nm, len(list_distinct(a.words || b.words)) AS un, a.dir = b.dir AS same FROM sh a JOIN sh b ON a.identity < b.identity),
nr AS (SELECT l AS left, r AS right, shared, round(shared / (total - shared), 3) AS field_jaccard, round(0.75 * (shared / (total - shared)) + 0.2 * (CASE WHEN un = 0 THEN 0 ELSE nm / un END) + 0.05 * same::INT, 3) AS score FROM pr
  WHERE shared >= 2 AND (nm > 0 OR same) AND (shared / (total - shared) >= 0.5 OR (nm > 0 AND shared / (total - shared) >= 0.4)))"""

SQL = {
    "clones_exact": sql(_group_sql("exact_hash", 1, 1)),
    "clones_structure": sql(_group_sql("structure_hash", 3, 2)),
    "clones_signature": sql(_group_sql("signature_hash", 0, 0)),
    "clones_shared_tokens": sql(
        """WITH n AS (SELECT structure_hash AS hash, count(*) AS n FROM function_facts GROUP BY 1 HAVING count(*) >= 2), t AS (SELECT structure_hash AS hash, identity, unnest(call_tokens) AS token FROM function_facts)
        SELECT hash, string_agg(token, ',' ORDER BY token) AS tokens FROM (SELECT hash, n, token FROM t JOIN n USING (hash) GROUP BY 1, 2, 3 HAVING count(DISTINCT identity) = n) GROUP BY 1"""
    ),
    "near_functions": sql(f"WITH {_NEAR} SELECT * FROM near WHERE score >= 0.62"),
    "near_functions_top": sql(f"WITH {_NEAR} SELECT * FROM near WHERE score >= 0.62 ORDER BY generated_only, score DESC, l_identity, r_identity LIMIT 50"),
    "near_diagnostics": sql(f"WITH {_NEAR} SELECT token, df AS functions, df * (df - 1) // 2 AS skipped_pairs FROM idf WHERE idf < 3"),
    "block_clones": sql(f"WITH {_BLOCKS} SELECT * FROM blk"),
    "block_clone_policy": sql(
        f"""WITH {_BLOCKS}, p AS (SELECT tokens, a.path AS p1, b.path AS p2 FROM blk JOIN files a ON a.file_id = file JOIN files b ON b.file_id = file2)
        SELECT CASE WHEN p1 = p2 THEN 'muted:same-file-repeat' WHEN regexp_matches(p1, '(^|/)tests?/|[.](test|spec)[.]') AND regexp_matches(p2, '(^|/)tests?/|[.](test|spec)[.]') THEN 'muted:test-scaffold' ELSE 'review' END AS status, count(*) AS pairs, max(tokens) AS longest FROM p GROUP BY 1"""
    ),
    "shape_index": sql("SELECT md5(array_to_string(fields, '|')) AS hash, count(*) AS size, string_agg(identity, ',' ORDER BY identity) AS identities, max(len(fields)) AS field_count FROM shapes GROUP BY 1"),
    "shape_near": sql(f"WITH {_SHAPE} SELECT * FROM nr"),
    "shape_near_top": sql(f"WITH {_SHAPE} SELECT * FROM nr ORDER BY score DESC, field_jaccard DESC, \"left\", \"right\" LIMIT 20"),
    "inline_pattern_groups": sql(
        """SELECT trim(regexp_replace(regexp_replace(b, '[a-z]+[.][A-Za-z]+', 'x.y', 'g'), '[ \n\t\r]+', ' ', 'g')) AS shape, count(*) AS occurrences, count(DISTINCT file_id) AS files
        FROM (SELECT file_id, unnest(regexp_extract_all(text, 'catch [(][^)]*[)] [{][^}]*[}]', 0)) AS b FROM files WHERE ext IN ('ts', 'js', 'mjs')) GROUP BY 1 HAVING count(*) >= 3"""
    ),
    "canon_type_labels": sql(
        f"""WITH imp AS (SELECT name, count(*) AS fan_in FROM (SELECT unnest(regexp_extract_all(names, '([A-Za-z_]+)[0-9]*', 1)) AS name FROM imports) GROUP BY 1),
        dd AS (SELECT regexp_replace(exported_name, '[0-9]+$', '') AS name, identity, len(list_filter(types, lambda t: regexp_matches(t, '\\bany\\b'))) > 0 AS bad FROM shapes),
        j AS (SELECT name, identity, bad, coalesce(fan_in, 0) AS fan_in FROM dd LEFT JOIN imp USING (name)),
        w AS (SELECT *, count(*) OVER (PARTITION BY name) AS n, max(fan_in) OVER (PARTITION BY name) AS top, sum(fan_in) OVER (PARTITION BY name) AS total, bool_and(bad) OVER (PARTITION BY name) AS all_bad FROM j)
        SELECT name, identity, fan_in, CASE WHEN n >= 2 AND all_bad THEN 'ANY_COLLISION' WHEN n >= 2 AND top >= 3 AND total >= 3 THEN 'DUPLICATE_STRONG' WHEN n >= 2 AND name IN ({", ".join(f"'{x}'" for x in LOW_INFO_NAMES)}) THEN 'LOCAL_COMMON_NAME'
          WHEN n >= 2 THEN 'DUPLICATE_REVIEW' WHEN bad THEN 'severely-any-contaminated' WHEN length(name) = 1 AND fan_in < 3 THEN 'low-signal-type-name' WHEN fan_in >= 3 THEN 'single-owner-strong' WHEN fan_in >= 1 THEN 'single-owner-weak' ELSE 'zero-internal-fan-in' END AS label FROM w"""
    ),
}
