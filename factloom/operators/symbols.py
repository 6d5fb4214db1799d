"""Symbols: fan-in of definitions, definitions without consumers, and what classifies them.

Absence is not clean: an optional input that is None gives 'unavailable', never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fan_in(defs: DataFrame, consumers: DataFrame, namespace_users: DataFrame) -> DataFrame:
    """Distinct consumer files of every identity (file, name): in all, by value, by type; and broad users of its whole file.
    Identities without consumers have zeros; consumed names without a definition are kept with kind 'unknown'.

    Consumers are made distinct per (identity, consumer) first, with the spaces as flags, so that the counts need no distinct."""
    each = consumers.groupBy(F.col("def_file").alias("file"), F.col("symbol").alias("name"), "consumer").agg(
        F.max(F.when(F.col("space") != "type", 1).otherwise(0)).alias("v"), F.max(F.when(F.col("space") == "type", 1).otherwise(0)).alias("t")
    )
    counts = each.groupBy("file", "name").agg(F.count("*").alias("fan_in"), F.sum("v").alias("value_fan_in"), F.sum("t").alias("type_fan_in"))
    broad = namespace_users.distinct().groupBy(F.col("def_file").alias("file")).agg(F.count("*").alias("broad_fan_in"))
    kinds = defs.groupBy("file", "name").agg(F.min("kind").alias("kind"))
    j = kinds.join(counts, ["file", "name"], "full_outer").join(broad, "file", "left")
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("fan_in", "value_fan_in", "type_fan_in", "broad_fan_in")]
    return j.select("file", "name", F.coalesce("kind", F.lit("unknown")).alias("kind"), *zero)


def dead_candidates(defs: DataFrame, consumers: DataFrame, namespace_users: DataFrame, barrels: DataFrame | None = None, public: DataFrame | None = None) -> DataFrame:
    """Definitions without a direct consumer. Files of barrels(file) are skipped; of files in public(file, name) only the listed names
    count as exported. namespace_shadowed: the file has a broad user; truly_dead: it has none."""
    d = defs.select("file", "name", "kind", "line")
    if barrels is not None:
        d = d.join(barrels.select("file").distinct(), "file", "left_anti")
    if public is not None:
        listed = public.select("file", "name").distinct()
        d = d.join(public.select("file", F.lit(True).alias("has_list")).distinct(), "file", "left").join(listed.withColumn("in_list", F.lit(True)), ["file", "name"], "left")
        d = d.where(F.col("has_list").isNull() | F.col("in_list")).drop("has_list", "in_list")
    used = consumers.select(F.col("def_file").alias("file"), F.col("symbol").alias("name")).distinct()
    broad = namespace_users.select(F.col("def_file").alias("file"), F.lit(True).alias("b")).distinct()
    d = d.join(used, ["file", "name"], "left_anti").join(broad, "file", "left")
    shadowed = F.coalesce("b", F.lit(False))
    return d.select("file", "name", "kind", "line", shadowed.alias("namespace_shadowed"), (~shadowed).alias("truly_dead"))


def dead_category(uses: Column) -> Column:
    """C without uses in its own file, A with one or two, B with three and more; a missing or negative count is an error."""
    bad = uses.isNull() | (uses < 0)
    return F.when(bad, F.raise_error(F.lit("file_internal_uses must be a count"))).when(uses == 0, "C").when(uses <= 2, "A").otherwise("B")


IDENTIFIER = "[A-Za-z_$][A-Za-z0-9_$]*"


def identifiers(files: DataFrame) -> DataFrame:
    """file_id, name, n: how often every identifier stands in the text of a file. Texts are cut into identifiers once, by the map side."""
    words = files.select("file_id", F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("name"))
    return words.groupBy("file_id", "name").agg(F.count("*").alias("n"))


def internal_uses(defs: DataFrame, files: DataFrame) -> DataFrame:
    """Occurrences of every name as an identifier of its own file, its definition not counted. defs(file_id, name), files(file_id, text)."""
    j = defs.join(identifiers(files), ["file_id", "name"], "left")
    return j.select("file_id", "name", F.greatest(F.lit(0).cast("bigint"), F.coalesce("n", F.lit(0)) - 1).alias("uses"))


def unused_dependencies(declared: DataFrame, observed: DataFrame | None) -> DataFrame:
    """Status of every declared dependency: used, else muted for the first reason that holds, else review. Observations count for
    their package where they name one (package_dir), else for all. Without any, nothing is known to be unused: 'unavailable'."""
    d = declared
    if observed is None:
        return d.select("package_dir", "dependency", F.lit("unavailable").alias("status"), F.lit("no-import-evidence").alias("reason"))
    keys = [k for k in ("package_dir", "dep_root") if k in observed.columns]
    d = d.join(observed.select(*keys, F.lit(True).alias("seen")).distinct(), keys, "left")
    reason = F.when(F.col("seen"), "import-consumer").when(F.col("script_tool"), "script-tool").when(F.col("section") == "peer", "peer-dependency").when(F.col("section") == "optional", "optional-dependency").when(F.col("type_package"), "type-package").otherwise("no-observed-consumer")
    status = F.when(F.col("seen"), "used").when(reason == "no-observed-consumer", "review-unused").otherwise("muted")
    return d.select("package_dir", "dependency", status.alias("status"), reason.alias("reason"))


def age_days(now: Column, ts: Column) -> Column:
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 86400)


def staleness(defs: DataFrame, touches: DataFrame, now: str, fossil: int = 365, stale: int = 90) -> DataFrame:
    """Tier by the age of the last touch, in whole days before an injected now; never touched is unknown."""
    last = touches.groupBy(F.col("symbol").alias("name")).agg(F.max("ts").alias("last_touch"))
    age = age_days(F.lit(now).cast("timestamp"), F.col("last_touch"))
    tier = F.when(age.isNull(), "unknown").when(age >= fossil, "fossil").when(age >= stale, "stale").otherwise("recent")
    return defs.join(last, "name", "left").select("file", "name", age.alias("age_days"), tier.alias("tier"))


#: fixed values: kinds of declarations that leave nothing to execute
TYPE_ONLY = ("TSInterfaceDeclaration", "TSTypeAliasDeclaration", "TSModuleDeclaration")
#: lines around a definition whose statements stand for it where no function encloses it
NEAR_LINES = 50


def runtime_evidence(defs: DataFrame, statements: DataFrame | None, functions: DataFrame | None = None) -> DataFrame:
    """Execution status of defs(file, name, kind, line). statements(file, line, hits) are those of the coverage report, a file without
    any has one row with a null line; functions(file, start, end, hits) are the covered functions.

    type-only kinds have no execution; a file that is not in the report is uncovered, one without statements is untested. The hits of
    the innermost function around the definition decide, or without one those of all statements within 50 lines: executed (of a
    definition that looks dead, so trust in it is low) or dead-confirmed."""
    if statements is None:
        return defs.select("file", "name", F.lit("unavailable").alias("status"), F.lit("low").alias("confidence"))
    files = statements.groupBy("file").agg(F.count("line").alias("statements"))
    d = defs.select("file", "name", "kind", "line").distinct()
    points = d.select("file", "line").where("line IS NOT NULL").distinct()
    # statements within the distance meet their definitions in blocks of lines
    block = F.explode(F.array(*[F.floor(F.col("line") / NEAR_LINES) + i for i in (-1, 0, 1)])).alias("block")
    per_line = statements.where("line IS NOT NULL").groupBy("file", "line").agg(F.sum("hits").alias("hits"))
    near = points.select("file", "line", block).join(per_line.select(F.col("file").alias("f"), F.col("line").alias("at"), "hits", F.floor(F.col("line") / NEAR_LINES).alias("b")), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")) & (F.abs(F.col("at") - F.col("line")) <= NEAR_LINES))
    near = near.groupBy("file", "line").agg(F.sum("hits").alias("near_hits"))
    j = d.join(files, "file", "left").join(near, ["file", "line"], "left")
    if functions is not None:
        from .deltas import innermost

        spans = functions.groupBy("file", "start", "end").agg(F.sum("hits").alias("name"))
        inner = innermost(points.withColumn("id", F.concat_ws(":", "file", "line")), spans).select("file", "line", F.col("name").alias("own_hits"))
        j = j.join(inner, ["file", "line"], "left")
    else:
        j = j.withColumn("own_hits", F.lit(None).cast("bigint"))
    hits = F.coalesce("own_hits", "near_hits", F.lit(0))
    status = F.when(F.col("kind").isin(*TYPE_ONLY), "type-only").when(F.col("statements").isNull(), "uncovered").when(F.col("statements") == 0, "file-untested").when(hits > 0, "executed").otherwise("dead-confirmed")
    conf = F.when(status == "dead-confirmed", "high").when(status == "executed", "low").otherwise("medium")
    return j.select("file", "name", status.alias("status"), conf.alias("confidence"))


def containing_package(files: DataFrame, packages: DataFrame) -> DataFrame:
    """The deepest package around every file, or null. files(repo, path), packages(repo, package_dir), '' for the root of a repo.
    A file meets packages by its leading directories, so this is an equality join; `a` does not contain `ab/c`."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = files.select("repo", "path").where("path IS NOT NULL").distinct().withColumn("package_dir", F.explode(above))
    hit = each.join(packages.select("repo", "package_dir").distinct(), ["repo", "package_dir"])
    best = hit.groupBy("repo", "path").agg(F.max_by("package_dir", F.length("package_dir")).alias("package_dir"))
    return files.select("repo", "path").distinct().join(best, ["repo", "path"], "left")


def call_graph(calls: DataFrame, callees: DataFrame) -> DataFrame:
    """Calls calls(caller_file, callee) resolved to callees(name, file), counted per edge; a name of several definitions stays
    unresolved rather than guessed."""
    unique = callees.groupBy("name").agg(F.count("*").alias("n"), F.min("file").alias("to_file")).where("n = 1").drop("n")
    counted = calls.groupBy("caller_file", "callee").agg(F.count("*").alias("calls"))
    j = counted.join(unique, counted["callee"] == unique["name"], "left")
    return j.select(F.col("caller_file").alias("from_file"), "to_file", "callee", "calls", F.when(F.col("to_file").isNull(), "unresolved").when(F.col("to_file") == F.col("caller_file"), "internal-same-file").otherwise("internal").alias("outcome"))


def callee_fan_in(callees: DataFrame, graph: DataFrame) -> DataFrame:
    """Callers and calls of every known definition, zero where none."""
    c = graph.where("to_file IS NOT NULL").groupBy(F.col("callee").alias("name")).agg(F.count_distinct("from_file").alias("callers"), F.sum("calls").alias("calls"))
    zero = [F.coalesce(x, F.lit(0).cast("bigint")).alias(x) for x in ("callers", "calls")]
    return callees.select("name").distinct().join(c, "name", "left").select("name", *zero)


def nearest_owner(files: DataFrame, packages: DataFrame) -> DataFrame:
    """The deepest package around every file, else the last of its repo's packages in order of depth (the shallowest, then by name)."""
    depth = F.when(F.col("package_dir") == "", 0).otherwise(F.size(F.split("package_dir", "/")))
    last = packages.groupBy("repo").agg(F.min_by("package_dir", F.struct(depth, "package_dir")).alias("last"))
    j = containing_package(files, packages).join(last, "repo", "left")
    return j.select("repo", "path", F.coalesce("package_dir", "last").alias("package_dir"), F.col("package_dir").isNotNull().alias("inside"))


def namespace_uses(files: DataFrame) -> DataFrame:
    """Members taken from namespace imports (import * as ns), and escape (null member) where a namespace is used as a value, so that any of
    its members may be. files(file_id, text) of TypeScript and JavaScript; strings and comments are not told apart."""
    ns = F.regexp_extract_all("text", F.lit(r"import [*] as ([A-Za-z_$][A-Za-z0-9_$]*) from"), F.lit(1))
    f = files.where(F.col("text").contains("import * as ")).select("file_id", "text", F.explode(F.array_distinct(ns)).alias("namespace"))
    uses = F.regexp_extract_all(F.regexp_replace("text", r"import [*] as [^;\n]*", ""), F.lit(r"((?:[.])?[A-Za-z_$][A-Za-z0-9_$]*(?:[.][A-Za-z_$][A-Za-z0-9_$]*)?)"), F.lit(1))
    u = f.select("file_id", "namespace", F.explode(uses).alias("use"))
    own = u.where((F.col("use") == F.col("namespace")) | F.col("use").startswith(F.concat("namespace", F.lit("."))))
    member = F.when(F.col("use") != F.col("namespace"), F.expr("substring(use, length(namespace) + 2)"))
    return own.groupBy("file_id", "namespace", member.alias("member")).agg(F.count("*").alias("n"))


def repo_modes(files: DataFrame) -> DataFrame:
    """Mode of every repo of files(repo, path, text) by its root package.json: workspaces, single-package, or non-node with its language;
    and the number of packages below."""
    root = F.col("path") == "package.json"
    spaces = F.get_json_object("text", "$.workspaces")
    g = files.groupBy("repo").agg(
        F.bool_or(root & F.get_json_object("text", "$").isNotNull()).alias("node"), F.bool_or(root & spaces.isNotNull()).alias("many"), F.bool_or(F.col("path").isin("pyproject.toml", "setup.py")).alias("python"),
        F.count_if(F.col("path").endswith("/package.json")).alias("packages"),
    )
    mode = F.when(F.col("node") & F.col("many"), "workspaces").when(F.col("node"), "single-package").otherwise("non-node")
    return g.select("repo", mode.alias("mode"), F.when(F.col("node"), "javascript").when(F.col("python"), "python").otherwise("unknown").alias("language"), "packages")


def semi_dead_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imported names that the importing text holds as an identifier nowhere else. imports(file_id, name), files(file_id, text)."""
    once = identifiers(files).where("n <= 1").drop("n")
    return imports.select("file_id", "name").distinct().join(once, ["file_id", "name"])
