"""Lookups before an edit: search tokens, semantic candidates, sibling operations, and whether an export may be acted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: tokens that say nothing, tokens that say little, and the families of the verbs that names begin with
STOP_TOKENS = (
    "a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "of", "on", "or", "the", "this", "that", "to", "with", "add", "new", "helper", "function", "type", "file", "module",
    "service", "manager", "index", "main", "src", "lib", "utils", "util", "ts", "js", "mjs", "cjs", "tsx", "jsx",
)
WEAK_TOKENS = (
    "action", "adapter", "api", "app", "application", "client", "command", "config", "context", "data", "domain", "event", "factory", "handler", "item", "manager", "model", "module",
    "option", "provider", "request", "response", "result", "service", "state", "store", "type", "util", "value",
)
FAMILIES = {
    "read-query": ("fetch", "find", "get", "list", "load", "lookup", "query", "read", "resolve", "retrieve", "search"),
    "mutation-create": ("add", "create"),
    "mutation-delete": ("delete", "destroy", "remove"),
    "mutation-send": ("dispatch", "emit", "send"),
    "mutation-update": ("patch", "set", "update"),
    "mutation-save": ("save", "upsert", "write"),
}
MIN_SCORE, RESULTS = 2, 5


def _normal(w: Column) -> Column:
    ies = (F.length(w) > 3) & w.endswith("ies")
    plural = (F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss") & ~w.endswith("us")
    return F.when(w.isin("cfg", "configuration"), "config").when(ies, F.concat(F.regexp_replace(w, "ies$", ""), F.lit("y"))).when(plural, F.regexp_replace(w, "s$", "")).otherwise(w)


def search_tokens(name: Column) -> Column:
    """Words of a name in order, each once: singular, of two characters and more, without stop tokens."""
    words = F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    return F.array_distinct(F.filter(F.transform(words, _normal), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_TOKENS)))


def semantic_candidates(names: DataFrame, intents: DataFrame) -> DataFrame:
    """Names that share tokens with an intent, met by token: hint, or why they are suppressed. names(name), intents(intent).
    A token that is weak for itself does not support a hint: two tokens and a strong one among them are needed."""
    n = names.select("name").where("name IS NOT NULL").distinct().select("name", F.explode(search_tokens(F.col("name"))).alias("token"))
    i = intents.select("intent").distinct().select("intent", F.explode(search_tokens(F.col("intent"))).alias("token"))
    g = n.join(i, "token").groupBy("intent", "name").agg(F.count("*").alias("score"), F.count_if(~F.col("token").isin(*WEAK_TOKENS)).alias("strong"), F.array_join(F.array_sort(F.collect_list("token")), ",").alias("tokens"))
    status = F.when(F.col("strong") == 0, "suppressed:weak-tokens-only").when(F.col("score") < MIN_SCORE, "suppressed:single-non-weak-token-only").otherwise("hint")
    return g.withColumn("status", status)


def operation_family(name: Column) -> Column:
    """Family of the verb that a name begins with, by its search tokens; null where it is none."""
    first = F.get(search_tokens(name), F.lit(0))
    return F.coalesce(*[F.when(first.isin(*verbs), family) for family, verbs in FAMILIES.items()])


def domain_tokens(name: Column) -> Column:
    verbs = [v for vs in FAMILIES.values() for v in vs]
    tokens = search_tokens(name)
    return F.filter(F.slice(tokens, 2, 1000), lambda w: ~w.isin(*verbs))


def sibling_status(intent: Column, name: Column, owner: Column, excluded: Column, callable_: Column, supported: Column, near: Column) -> Column:
    """The first reason that mutes a suppressed candidate as a sibling operation of an intent, or promoted. near: same file or directory."""
    fi, fn, shared = operation_family(intent), operation_family(name), F.size(F.array_intersect(domain_tokens(intent), domain_tokens(name)))
    return (
        F.when(name.isNull() | (name == "") | owner.isNull() | (owner == ""), "insufficient-metadata")
        .when(excluded, "policy-excluded")
        .when(~callable_, "non-callable-definition")
        .when(~supported, "insufficient-suppressed-support")
        .when(~near, "locality-mismatch")
        .when(fi.isNull() | fn.isNull(), "unknown-operation")
        .when(shared == 0, "domain-mismatch")
        .when(fi != fn, "operation-family-mismatch")
        .when(fi != "read-query", "family-not-promotable")
        .otherwise("promoted")
    )


def first_of_each(df: DataFrame, keys: list[str], order: list, n: int = RESULTS) -> DataFrame:
    """The first n rows of every key; a filter on the rank, so every task keeps n rows of a key before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


#: kinds of declarations that are types
TYPE_KINDS = ("interface", "type-alias", "enum")


def export_action(kind: Column, uses: Column, body: Column) -> Column:
    """The safe edit of an unused export, or none where its declaration may have effects: a class that extends, is decorated, or holds
    static fields or computed members; an initialiser that calls. Without uses in its own file a declaration is deleted, else it stays
    without its export."""
    blocked = ((kind == "class") & body.rlike(r"\bextends\b|@[A-Za-z]|\bstatic\b|\[[^\]]*\] *[(=]")) | ((kind == "variable") & body.rlike(r"= *(?:await |new )?[A-Za-z_$][A-Za-z0-9_$.]*[(]"))
    delete = F.when(kind.isin(*TYPE_KINDS), "delete_type_declaration").otherwise("delete_value_declaration")
    return F.when(uses > 0, "demote_export_declaration").when(blocked, "none").otherwise(delete)


def specifier_could_match(spec: Column, from_dir: Column, file: Column, same_submodule: Column) -> Column:
    """match, no-match or unknown: whether an unresolved specifier may mean a file. Relative ones are compared by their path without
    extension, bare packages mean none, and aliases or deep paths may only mean files of the same submodule. Relative ones that climb
    are not followed further than one level a step."""
    stem = lambda c: F.regexp_replace(F.regexp_replace(c, r"[.](?:d[.])?(?:[mc]?[tj]sx?)$", ""), "/index$", "")
    up1 = F.regexp_replace(from_dir, "/?[^/]*$", "")
    base = F.when(spec.startswith("./"), F.concat(from_dir, F.lit("/"), F.substring(spec, 3, 10_000))).when(spec.rlike(r"^[.][.]/[^.]"), F.concat(up1, F.lit("/"), F.substring(spec, 4, 10_000)))
    bare = ~spec.rlike("^[./]") & ~spec.rlike("^[@~#]/") & F.when(spec.startswith("@"), F.size(F.split(spec, "/")) <= 2).otherwise(~spec.contains("/"))
    relative = F.when(F.coalesce(stem(base) == stem(file), F.lit(False)), "match").otherwise("no-match")
    return F.when(spec.isNull() | file.isNull(), "no-match").when(spec.startswith("."), relative).when(bare, "no-match").when(same_submodule, "unknown").otherwise("no-match")


#: fixed values: families of imports and whether the resolver answers for all of their cases
CAPABILITIES = (
    ("relative-paths", "supported"), ("absolute-project-paths", "partial"), ("node-packages", "partial"), ("tsconfig-paths", "partial"), ("workspace-packages", "partial"), ("package-json-exports", "partial"),
    ("output-to-source-mapping", "partial"), ("package-json-entry-fields", "partial"), ("node-imports", "partial"), ("json-imports", "partial"), ("generated-artifacts", "partial"), ("dynamic-modules", "partial"),
    ("conditional-exports", "partial"), ("re-export-aliases", "supported"),
)

#: fixed values: labels of helpers by their fan-in, and those of contamination
TIERS = ("zero-internal-fan-in-helper", "shared-helper", "central-helper")
CONTAMINATED = ("severely-any-contaminated-helper", "ANY_COLLISION_HELPER")


def helper_drift(canon: DataFrame, fresh: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """What changed between canon and fresh(identity, label): added, removed, contamination-changed (only with evidence(identity) for
    this very helper), fan-in-tier-changed (only without contamination on either side), else label-changed."""
    j = canon.select("identity", F.col("label").alias("old")).join(fresh.select("identity", F.col("label").alias("new")), "identity", "full_outer")
    if evidence is None:
        j = j.withColumn("seen", F.lit(False))
    else:
        j = j.join(evidence.select("identity", F.lit(True).alias("seen")).distinct(), "identity", "left")
    dirty = F.col("old").isin(*CONTAMINATED) | F.col("new").isin(*CONTAMINATED)
    category = (
        F.when(F.col("new").isNull(), "helper-removed")
        .when(F.col("old").isNull(), "helper-added")
        .when(dirty & F.coalesce("seen", F.lit(False)), "contamination-changed")
        .when(~dirty & F.col("old").isin(*TIERS) & F.col("new").isin(*TIERS), "fan-in-tier-changed")
        .otherwise("label-changed")
    )
    return j.where(~F.col("old").eqNullSafe(F.col("new"))).select("identity", "old", "new", category.alias("category"))
