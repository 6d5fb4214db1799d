"""Queries of the text family: discipline, escapes, naming, names, imports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import escapes as escaping
from ..operators import resolver
from ..sources import extract
from ..sources.facts import fact, sql

IDENT = "[A-Za-z_][A-Za-z0-9_]*"


def _counts(s, d):
    return text.marker_counts(fact(s, d, "files"))


def discipline_totals(s, d):
    return text.discipline_totals(_counts(s, d))


def discipline_offenders(s, d):
    return text.discipline_offenders(_counts(s, d))


def discipline_by_pattern(s, d):
    """Ten worst files of every pattern, over the files of this table."""
    c = _counts(s, d)
    long = c.select("file_id", F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"`{p}`").alias("count")) for p in text.DISCIPLINE])).alias("x")).select("file_id", "x.*").where("count > 0")
    w = Window.partitionBy("pattern").orderBy(F.col("count").desc(), "file_id")
    return long.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


def _escape_facts(s, d):
    f = fact(s, d, "files").where("ext IN ('ts', 'js', 'mjs')")
    return escaping.facts(f, extract.definitions(f, "js"))


def escapes(s, d):
    """Escapes of the type system by occurrence key: a key is a bucket, so equal occurrences of one owner are counted."""
    return _escape_facts(s, d).groupBy("file_id", "kind", "owner", "occurrence_key").agg(F.count("*").alias("occurrences"), F.min("line").alias("first_line"))


def contamination(s, d):
    return escaping.owner_labels(_escape_facts(s, d))


def _named(s, d):
    f = fact(s, d, "functions").select(F.concat(F.lit("function:"), F.split("owner_file", "/")[0]).alias("cohort"), F.regexp_replace("name", "[0-9]+$", "").alias("name"))
    b = fact(s, d, "files").select(F.concat(F.lit("file:"), "submodule", F.lit(":"), "ext").alias("cohort"), text.basename(F.col("path")).alias("name"))
    return f.unionByName(b)


def naming(s, d):
    return text.dominance(_named(s, d))


def naming_outliers(s, d):
    items, dom = _named(s, d).distinct(), naming(s, d).where("dominant IS NOT NULL")
    j = items.join(dom.select("cohort", "dominant"), "cohort")
    c = text.convention(F.col("name"))
    return j.where(c != F.col("dominant")).select("cohort", "name", c.alias("convention"), "dominant")


#: intended names, as a lookup before an edit would bring them
INTENTS = ("loadWindowBuffer", "storeQueueDigest", "parseMetricPolicy", "countOrder", "scoreMargin", "trimNodes", "rankTick", "applyPatches", "mergeLease", "emitTokn")


def near_names(s, d):
    f = fact(s, d, "functions").select(F.regexp_replace("name", "[0-9]+$", "").alias("name"))
    return text.near_names(f, s.createDataFrame([(i,) for i in INTENTS], "name string"))


def hints(s, d):
    """Functions whose names share two words and more with an intended operation."""
    from ..operators.clones import name_tokens

    f = fact(s, d, "functions").select(F.regexp_replace("name", "[0-9]+$", "").alias("name")).distinct().withColumn("words", name_tokens(F.col("name")))
    intents = s.createDataFrame([("loadWindowBuffer",), ("storeQueueDigest",), ("parseMetricPolicy",), ("countOrderSignal",)], "intent string").withColumn("iw", name_tokens(F.col("intent")))
    a = f.select("name", F.explode("words").alias("w")).join(F.broadcast(intents.select("intent", F.explode("iw").alias("w"))), "w")
    n = a.groupBy("intent", "name").agg(F.count("*").alias("shared"), F.array_join(F.array_sort(F.collect_list("w")), ",").alias("words")).where("shared >= 2")
    w = Window.partitionBy("intent").orderBy(F.col("shared").desc(), "name")
    return n.withColumn("rank", F.row_number().over(w)).where("rank <= 5")


def import_edges(s, d):
    i = fact(s, d, "imports")
    return i.groupBy("file_id", "spec").agg(F.count("*").alias("n")).select("file_id", "spec", "n", text.specifier_kind(F.col("spec")).alias("kind"), text.package_root(F.col("spec")).alias("root"))


def resolved(s, d):
    """Relative imports resolved to files of the same repo; the extension that comes first wins."""
    r = resolver.resolve(fact(s, d, "imports"), fact(s, d, "files").select("repo", "path"))
    return r.where("stage = 'relative'").select("file_id", "spec", "target", "outcome")


def unresolved_ratio(s, d):
    r = resolved(s, d).agg(F.count("*").alias("internal_specifiers"), F.count_if(F.col("outcome") == "unresolved").alias("unresolved"))
    ratio = F.coalesce(F.round(F.try_divide("unresolved", "internal_specifiers"), 4), F.lit(0.0))
    zone = F.when(ratio >= 0.15, "high-unresolved-ratio").when(F.col("unresolved") >= 1000, "many-unresolved").otherwise("none")
    return r.select("internal_specifiers", "unresolved", ratio.alias("ratio"), zone.alias("blind_zone"))


def barrels(s, d):
    """Imports of every package at its root against those of its subpaths, and their share in percent. The packages are the roots of all
    specifiers, relative ones by their first directory."""
    i = fact(s, d, "imports").select("spec")
    return text.barrel_discipline(i, i.select(text.package_root(F.col("spec")).alias("package")))


def language_counts(s, d):
    f = fact(s, d, "files")
    return f.groupBy("repo", "ext").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.count_if(F.col("text").isNull()).alias("unreadable"))


def line_counts(s, d):
    return fact(s, d, "files").select("file_id", text.lines(F.col("text")).alias("n_lines"), "loc")


#: fixed values: signals of Rust sources
RUST_SIGNALS = {"unwrap": "[.]unwrap[(]", "expect": "[.]expect[(]", "panic": "panic![(]", "unimplemented": "unimplemented![(]", "todo": "todo![(]", "unsafe": "unsafe [{]", "clone": "[.]clone[(][)]"}


def rust_signals(s, d):
    f = fact(s, d, "files").where("ext = 'rs' AND text IS NOT NULL")
    muted = F.col("path").rlike("(^|/)tests/|_gen") | F.col("text").contains("#[test]")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), F.regexp_count("text", F.lit(rx)).alias("n")) for k, rx in RUST_SIGNALS.items()]))
    g = f.select(muted.alias("muted"), pairs.alias("x")).groupBy("x.signal", "muted").agg(F.sum("x.n").alias("n"), F.count_if(F.col("x.n") > 0).alias("files"))
    return g.where("n > 0")


QUERIES = {
    "discipline_totals": discipline_totals,
    "discipline_offenders": discipline_offenders,
    "discipline_by_pattern": discipline_by_pattern,
    "type_escapes": escapes,
    "any_contamination": contamination,
    "naming_dominance": naming,
    "naming_outliers": naming_outliers,
    "near_names": near_names,
    "semantic_hints": hints,
    "import_edges": import_edges,
    "import_resolution": resolved,
    "unresolved_ratio": unresolved_ratio,
    "barrel_discipline": barrels,
    "language_counts": language_counts,
    "line_counts": line_counts,
    "rust_signals": rust_signals,
}


def _duck(rx: str) -> str:
    """The same marker for an engine without lookarounds: boundaries as optional neighbours."""
    b, e = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    return rx.replace(b, "\\b").replace(e, "\\b").replace("'", "''")


_FAM = "CASE WHEN ext IN ('ts', 'js', 'mjs') THEN 'ts' WHEN ext IN ('py', 'go') THEN ext END"
_CNT = (
    "cnt AS (SELECT file_id, fam, CASE WHEN text IS NOT NULL THEN length(text) - length(replace(text, chr(10), '')) + 1 END AS n_lines, "
    + ", ".join(f"""CASE WHEN fam IN ({", ".join(f"'{x}'" for x in langs)}) AND text IS NOT NULL THEN len(regexp_extract_all(text, '{_duck(rx)}')) ELSE 0 END AS "{p}" """ for p, (langs, rx) in text.DISCIPLINE.items())
    + f" FROM (SELECT *, {_FAM} AS fam FROM files) WHERE fam IS NOT NULL)"
)
_LONG = "long AS (" + " UNION ALL ".join(f"""SELECT file_id, n_lines, '{p}' AS pattern, "{p}" AS n FROM cnt""" for p in text.DISCIPLINE) + ")"
def _escape_sql(tail: str) -> str:
    """Facts of escapes with their owners, by scalar lookups of the nearest definition instead of windows."""
    from .q_extract import _def_sql

    kinds = " ".join(f"WHEN regexp_full_match(code, '{rx}') THEN '{k}'" for k, rx in escaping.KINDS)
    near = "(SELECT {agg}({{name: d.name, kind: d.kind}}, d.line) FROM df_js d WHERE d.file_id = o.file_id AND {cond})"
    above, below = near.format(agg="arg_max", cond="d.line <= o.line"), near.format(agg="arg_min", cond="d.line BETWEEN o.line AND o.line + 3")
    return sql(
        f"""WITH {_def_sql("js")}, occ AS (SELECT file_id, line, unnest(regexp_extract_all(body, '({escaping.PATTERN})', 1)) AS code FROM ln WHERE ext IN ('ts', 'js', 'mjs')),
        k AS (SELECT *, CASE {kinds} END AS kind FROM occ), w AS (SELECT *, CASE WHEN kind = 'jsdoc-any' THEN {below} ELSE {above} END AS own FROM k o),
        esc AS (SELECT file_id, line, kind, own.name AS owner, own.kind AS owner_kind, 'sha256:' || sha256(file_id || '|' || kind || '|' || trim(regexp_replace(code, '[ \t]+', ' ', 'g')) || '|' || coalesce(own.name, '<top-level>')) AS occurrence_key FROM w) {tail}"""
    )


_CONV = """CASE WHEN name IS NULL OR name = '' THEN 'mixed' WHEN regexp_matches(name, '^[a-z][a-z0-9]*(-[a-z0-9]+)+$') THEN 'kebab-case' WHEN regexp_matches(name, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$') THEN 'UPPER_SNAKE'
 WHEN regexp_matches(name, '^[a-z][a-z0-9]*(_[a-z0-9]+)+$') THEN 'snake_case' WHEN regexp_matches(name, '^[A-Z][A-Za-z0-9]*$') AND regexp_matches(name, '[A-Z].*[a-z]') THEN 'PascalCase'
 WHEN regexp_matches(name, '^[a-z][A-Za-z0-9]*$') AND regexp_matches(name, '[a-z].*[A-Z]') THEN 'camelCase' WHEN regexp_matches(name, '^[A-Z][A-Z0-9]*$') THEN 'UPPER_SNAKE' WHEN regexp_matches(name, '^[a-z][a-z0-9]*$') THEN 'camelCase' ELSE 'mixed' END"""
_BASE = "regexp_replace(regexp_replace(regexp_replace(path, '^.*/', ''), '[.](mjs|tsx|mts|cts|cjs|jsx|ts|js|py|go|rs|json)$', ''), '[.](test|spec|stories|d)$', '')"
_NAMING = f"""
it AS (SELECT 'function:' || split_part(owner_file, '/', 1) AS cohort, regexp_replace(name, '[0-9]+$', '') AS name FROM functions UNION ALL SELECT 'file:' || submodule || ':' || ext, {_BASE} FROM files),
cv AS (SELECT cohort, {_CONV} AS c, count(*) AS n FROM it GROUP BY 1, 2),
bs AS (SELECT cohort, sum(n)::BIGINT AS members, max(n) FILTER (c <> 'mixed') AS top FROM cv GROUP BY 1),
dm AS (SELECT bs.cohort, members, CASE WHEN members >= 3 AND top / members >= 0.6 THEN (SELECT min(c) FROM cv WHERE cv.cohort = bs.cohort AND c <> 'mixed' AND n = top) END AS dominant, coalesce(round(top / members, 3), 0) AS share,
  CASE WHEN members < 3 THEN 'too-few' WHEN top / members >= 0.6 THEN 'convention' ELSE 'mixed-convention' END AS label FROM bs)"""
_INTENTS = ", ".join(f"('{i}')" for i in INTENTS)
_TOK = "list_sort(list_distinct(list_filter(string_split_regex(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: length(w) >= 2)))"
_RES = """
im AS (SELECT DISTINCT file_id, repo, spec, regexp_replace(path, '[^/]*$', '') || substr(spec, 3) AS base FROM imports WHERE spec LIKE './%'),
ca AS (SELECT file_id, repo, spec, base || e AS target, k FROM im, (VALUES (0, '.ts'), (1, '.js'), (2, '.mjs'), (3, '/index.ts'), (4, '/index.js')) x(k, e)),
ht AS (SELECT file_id, spec, arg_min(target, k) AS target FROM ca WHERE EXISTS (SELECT 1 FROM files f WHERE f.repo = ca.repo AND f.path = ca.target) GROUP BY 1, 2),
rs AS (SELECT im.file_id, im.spec, target, CASE WHEN target IS NULL THEN 'unresolved' ELSE 'internal' END AS outcome FROM im LEFT JOIN ht ON ht.file_id = im.file_id AND ht.spec = im.spec)"""

SQL = {
    "discipline_totals": sql(f"WITH {_CNT}, {_LONG} SELECT pattern, sum(n)::BIGINT AS total, round(sum(n) / count(n_lines), 3) AS per_file, round(sum(n) * 1000 / sum(n_lines), 2) AS per_kloc FROM long GROUP BY 1"),
    "discipline_offenders": sql(f"WITH {_CNT}, {_LONG} SELECT file_id, sum(n)::BIGINT AS total, count(*) FILTER (n > 0)::INT AS patterns FROM long GROUP BY 1 HAVING sum(n) > 0 ORDER BY total DESC, file_id LIMIT 20"),
    "discipline_by_pattern": sql(f'WITH {_CNT}, {_LONG} SELECT file_id, pattern, n::INT AS "count", r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY n DESC, file_id) AS r FROM long WHERE n > 0) WHERE r <= 10'),
    "type_escapes": _escape_sql("SELECT file_id, kind, owner, occurrence_key, count(*) AS occurrences, min(line)::INT AS first_line FROM esc GROUP BY 1, 2, 3, 4"),
    "any_contamination": _escape_sql(
        """, c AS (SELECT file_id, owner, owner_kind, count(*) AS escapes, count(*) FILTER (kind NOT IN ('ts-ignore', 'ts-expect-error')) AS any_escapes, histogram(kind) AS h FROM esc WHERE owner IS NOT NULL GROUP BY 1, 2, 3),
        l AS (SELECT *, owner_kind IN ('interface', 'type-alias', 'enum') AS is_type FROM c WHERE any_escapes > 0)
        SELECT file_id, owner, owner_kind, escapes, any_escapes, CASE WHEN h['as-unknown-as-T'] > 0 OR h['rest-any-args'] > 0 OR coalesce(h['as-any'], 0) + coalesce(h['angle-any'], 0) >= 2 OR h['explicit-any'] >= 3 OR h['index-sig-any'] > 0 OR (is_type AND any_escapes >= 3)
          OR (owner_kind IN ('function', 'arrow', 'variable') AND h['jsdoc-any'] >= 2) THEN 'severely-any-contaminated' WHEN is_type OR h['as-any'] > 0 OR h['angle-any'] > 0 OR h['explicit-any'] > 0 OR h['jsdoc-any'] > 0 OR h['no-explicit-any-disable'] > 0 THEN 'any-contaminated' ELSE 'has-any' END AS label FROM l"""
    ),
    "naming_dominance": sql(f"WITH {_NAMING} SELECT * FROM dm"),
    "naming_outliers": sql(f"WITH {_NAMING} SELECT i.cohort, name, {_CONV} AS convention, dominant FROM (SELECT DISTINCT cohort, name FROM it) i JOIN dm ON dm.cohort = i.cohort AND dominant IS NOT NULL WHERE {_CONV} <> dominant"),
    "near_names": sql(
        f"""WITH n AS (SELECT DISTINCT regexp_replace(name, '[0-9]+$', '') AS name FROM functions), p AS (SELECT b.name AS intent, a.name, levenshtein(a.name, b.name) AS l,
          len(list_filter(range(1, least(length(a.name), length(b.name)) + 1), lambda i: left(a.name, i) = left(b.name, i))) AS prefix
          FROM n a JOIN (VALUES {_INTENTS}) b(name) ON a.name <> b.name)
        SELECT intent, name, least(l, 9)::INT AS distance, prefix::INT AS prefix FROM p WHERE (prefix >= 4 AND abs(length(name) - length(intent)) <= length(intent)) OR (abs(length(name) - length(intent)) <= 2 AND l <= 2)"""
    ),
    "semantic_hints": sql(
        f"""WITH f AS (SELECT DISTINCT regexp_replace(name, '[0-9]+$', '') AS name FROM functions), q(intent) AS (VALUES ('loadWindowBuffer'), ('storeQueueDigest'), ('parseMetricPolicy'), ('countOrderSignal')),
        j AS (SELECT intent, name, list_sort(list_intersect({_TOK.format("name")}, {_TOK.format("intent")})) AS w FROM f, q)
        SELECT intent, name, len(w) AS shared, array_to_string(w, ',') AS words, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY len(w) DESC, name) AS r FROM j WHERE len(w) >= 2) WHERE r <= 5"""
    ),
    "import_edges": sql(
        """SELECT file_id, spec, count(*) AS n, CASE WHEN starts_with(spec, '.') THEN 'relative' WHEN starts_with(spec, '/') THEN 'absolute' WHEN regexp_matches(spec, '^(node:|https?:)') THEN 'builtin'
        WHEN starts_with(spec, '@/') OR starts_with(spec, '~/') THEN 'alias' ELSE 'package' END AS kind, regexp_extract(spec, '^(@[^/]+/[^/]+|[^/]+)', 1) AS root FROM imports GROUP BY 1, 2"""
    ),
    "import_resolution": sql(f"WITH {_RES} SELECT * FROM rs"),
    "unresolved_ratio": sql(
        f"""WITH {_RES} SELECT i AS internal_specifiers, u AS unresolved, r AS ratio, CASE WHEN r >= 0.15 THEN 'high-unresolved-ratio' WHEN u >= 1000 THEN 'many-unresolved' ELSE 'none' END AS blind_zone
        FROM (SELECT count(*) AS i, count(*) FILTER (outcome = 'unresolved') AS u, coalesce(round(count(*) FILTER (outcome = 'unresolved') / count(*), 4), 0) AS r FROM rs)"""
    ),
    "barrel_discipline": sql(
        """WITH p AS (SELECT DISTINCT regexp_extract(spec, '^(@[^/]+/[^/]+|[^/]+)', 1) AS package FROM imports), j AS (SELECT package, spec = package AS root, spec FROM imports JOIN p ON spec = package OR starts_with(spec, package || '/'))
        SELECT package, count(*) FILTER (root) AS root_imports, count(*) FILTER (NOT root) AS subpath_imports, count(*) AS total, round(100.0 * count(*) FILTER (NOT root) / count(*), 1) AS compliance FROM j GROUP BY 1"""
    ),
    "language_counts": sql("SELECT repo, ext, count(*) AS files, sum(loc)::BIGINT AS loc, count(*) FILTER (text IS NULL) AS unreadable FROM files GROUP BY 1, 2"),
    "line_counts": sql("SELECT file_id, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS n_lines, loc FROM files"),
    "rust_signals": sql(
        "SELECT signal, muted, sum(n)::BIGINT AS n, count(*) FILTER (n > 0) AS files FROM ("
        + " UNION ALL ".join(f"SELECT '{k}' AS signal, regexp_matches(path, '(^|/)tests/|_gen') OR contains(text, '#[test]') AS muted, len(regexp_extract_all(text, '{rx}')) AS n FROM files WHERE ext = 'rs' AND text IS NOT NULL" for k, rx in RUST_SIGNALS.items())
        + ") GROUP BY 1, 2 HAVING sum(n) > 0"
    ),
}
