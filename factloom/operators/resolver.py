"""Import specifiers to files, and calls through imports to definitions.

Every specifier is turned into candidate paths with a rank (the stage that made them, the nearness of its scope, the extension), all
candidates meet the files of their repo in one equality join, and the least rank wins. Nothing is probed file by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: what is tried behind a path, in order; a runtime extension also means its source
TAILS = ("", ".ts", ".tsx", ".d.ts", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.mjs")
SOURCES = {".js": (".ts", ".tsx"), ".mjs": (".mts",), ".cjs": (".cts",), ".jsx": (".tsx",)}
STAGES = ("relative", "exact-alias", "wildcard-alias", "base-url", "workspace-package", "root-prefix")


def normal_path(path: Column) -> Column:
    """A path without empty, `.` and `..` segments; what climbs above the root is null."""
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))

    def add(acc: Column, x: Column) -> Column:
        up = F.struct(F.slice(acc["p"], F.lit(1), F.greatest(F.size(acc["p"]) - 1, F.lit(0))).alias("p"), (acc["ok"] & (F.size(acc["p"]) > 0)).alias("ok"))
        return F.when(x.isin("", "."), acc).when(x == "..", up).otherwise(F.struct(F.concat(acc["p"], F.array(x)).alias("p"), acc["ok"].alias("ok")))

    return F.aggregate(F.split(path, "/"), start, add, lambda a: F.when(a["ok"], F.array_join(a["p"], "/")))


def _inside(path: Column, scope: Column) -> Column:
    return (scope == "") | path.startswith(F.concat(scope, F.lit("/")))


def resolve(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None, bases: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """file_id, spec, target, stage, outcome of every distinct import(file_id, repo, path, spec) among files(repo, path).

    aliases(repo, scope, pattern, target): a pattern may end in `*`, the nearest scope around the importing file goes first;
    bases(repo, scope, base): directories that plain specifiers start from; packages(repo, name, package_dir): workspaces.
    outcome: internal; unresolved where a stage applied but no file is there; external otherwise. Ties go to the first stage, the nearest
    scope, the longest pattern, the extension order, then the path."""
    i = imports.select("file_id", "repo", "path", "spec").where("spec IS NOT NULL").distinct()
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    plain = ~F.col("spec").rlike("^[./]")
    cols = ["file_id", "repo", "spec"]

    def made(df: DataFrame, stage: str, near: Column, base: Column) -> DataFrame:
        return df.select(*cols, F.lit(STAGES.index(stage)).alias("stage"), (-near).cast("int").alias("near"), normal_path(base).alias("base"))

    parts = [made(i.where(F.col("spec").startswith(".")), "relative", F.lit(0), F.concat_ws("/", folder, "spec"))]
    if aliases is not None:
        a = aliases.select(F.col("repo").alias("r"), "scope", "pattern", F.col("target").alias("to"))
        exact = i.join(a, (F.col("repo") == F.col("r")) & (F.col("spec") == F.col("pattern")) & _inside(F.col("path"), F.col("scope")))
        parts.append(made(exact, "exact-alias", F.length("scope") * 1000, F.concat_ws("/", "scope", "to")))
        # a wildcard meets the leading characters of a specifier up to each slash, or none
        w = a.where("pattern LIKE '%*'").withColumn("head", F.expr("substring(pattern, 1, length(pattern) - 1)"))
        segments = F.split("spec", "/")
        heads = F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda n: F.concat(F.array_join(F.slice(segments, 1, n), "/"), F.when(n > 0, "/").otherwise("")))
        wild = i.withColumn("lead", F.explode(heads)).join(w, (F.col("repo") == F.col("r")) & (F.col("lead") == F.col("head")) & _inside(F.col("path"), F.col("scope")))
        rest = F.expr("substring(spec, length(head) + 1)")
        parts.append(made(wild, "wildcard-alias", F.length("scope") * 1000 + F.length("head"), F.concat_ws("/", "scope", F.replace("to", F.lit("*"), rest))))
    if bases is not None:
        b = bases.select(F.col("repo").alias("r"), "scope", F.col("base").alias("root"))
        parts.append(made(i.where(plain).join(b, (F.col("repo") == F.col("r")) & _inside(F.col("path"), F.col("scope"))), "base-url", F.length("scope") * 1000, F.concat_ws("/", "scope", "root", "spec")))
    root = F.regexp_extract("spec", "^(@[^/]+/[^/]+|[^/]+)", 1)
    if packages is not None:
        p = packages.select(F.col("repo").alias("r"), "name", "package_dir")
        own = i.where(plain).withColumn("root", root).join(p, (F.col("repo") == F.col("r")) & (F.col("root") == F.col("name")))
        below = F.expr("substring(spec, length(root) + 2)")
        parts.append(made(own, "workspace-package", F.lit(0), F.concat_ws("/", "package_dir", below)))
        parts.append(made(own, "workspace-package", F.lit(-1), F.concat_ws("/", "package_dir", F.lit("src"), below)))
    tops = files.where("path LIKE '%/%'").select(F.col("repo").alias("r"), F.split("path", "/")[0].alias("top")).distinct()
    parts.append(made(i.where(plain & F.col("spec").contains("/")).join(tops, (F.col("repo") == F.col("r")) & (F.split("spec", "/")[0] == F.col("top"))), "root-prefix", F.lit(0), F.col("spec")))
    tried = parts[0]
    for x in parts[1:]:
        tried = tried.unionByName(x)
    tails = [F.struct(F.lit(n).alias("n"), F.concat("base", F.lit(t)).alias("path")) for n, t in enumerate(TAILS)]
    swaps = [F.struct(F.lit(len(TAILS) + n).alias("n"), F.when(F.col("base").endswith(a), F.concat(F.expr(f"substring(base, 1, length(base) - {len(a)})"), F.lit(t))).alias("path")) for n, (a, t) in enumerate((a, t) for a, ts in SOURCES.items() for t in ts)]
    each = tried.select(*cols, "stage", "near", F.explode(F.array(*tails, *swaps)).alias("x")).where("x.path IS NOT NULL")
    there = files.select(F.col("repo").alias("r"), F.col("path").alias("target")).distinct()
    hit = each.join(there, (F.col("repo") == F.col("r")) & (F.col("x.path") == F.col("target")))
    best = hit.groupBy(*cols).agg(F.min(F.struct("stage", "near", F.col("x.n").alias("n"), "target")).alias("b"))
    applied = tried.groupBy(*cols).agg(F.min("stage").alias("first"))
    j = i.join(applied, cols, "left").join(best, cols, "left")
    name = F.element_at(F.array(*[F.lit(s) for s in STAGES]), F.coalesce("b.stage", "first") + 1)
    # that a directory has the name of a package proves nothing
    outcome = F.when(F.col("b").isNotNull(), "internal").when(F.col("first").isNull() | (F.col("first") >= STAGES.index("base-url")), "external").otherwise("unresolved")
    return j.select("file_id", "spec", F.col("b.target").alias("target"), F.when(outcome != "external", name).alias("stage"), outcome.alias("outcome"))


def resolve_calls(calls: DataFrame, definitions: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls(caller_file, callee) counted per edge and resolved through the caller's own definitions, else its imports.

    definitions(file, name); imports(file, local, imported, target): the file that a local name comes from, null where that is not known
    or lies outside. `ns.member` calls resolve through a namespace import (imported `*`). outcome: internal-same-file, internal,
    imported-missing (the target does not define it), imported-unresolved, or unresolved; a name is never matched globally."""
    counted = calls.where("callee IS NOT NULL").groupBy(F.col("caller_file").alias("from_file"), "callee").agg(F.count("*").alias("calls"))
    d = definitions.select("file", "name").distinct()
    head = F.split("callee", "[.]")[0]
    c = counted.withColumn("head", head).withColumn("member", F.when(F.col("callee").contains("."), F.regexp_extract("callee", "[.](.*)$", 1)))
    own = d.select(F.col("file").alias("from_file"), F.col("name").alias("callee"), F.lit(True).alias("own"))
    i = imports.groupBy(F.col("file").alias("from_file"), F.col("local").alias("head")).agg(F.min_by(F.struct("imported", "target"), F.struct(F.col("target").isNull(), "target", "imported")).alias("i"))
    c = c.join(own, ["from_file", "callee"], "left").join(i, ["from_file", "head"], "left")
    wanted = F.when(F.col("i.imported") == "*", F.col("member")).when(F.col("member").isNull(), F.col("i.imported"))
    c = c.withColumn("to_name", wanted).withColumn("to_file", F.when(F.col("own"), F.col("from_file")).otherwise(F.col("i.target")))
    there = d.select(F.col("file").alias("to_file"), F.col("name").alias("to_name"), F.lit(True).alias("defined"))
    c = c.join(there, ["to_file", "to_name"], "left")
    outcome = (
        F.when(F.col("own"), "internal-same-file")
        .when(F.col("i").isNull(), "unresolved")
        .when(F.col("i.target").isNull(), "imported-unresolved")
        .when(F.col("defined"), "internal")
        .otherwise("imported-missing")
    )
    return c.select("from_file", F.when(outcome.isin("internal", "internal-same-file"), F.col("to_file")).alias("to_file"), "callee", "calls", outcome.alias("outcome"))
