"""Lexical extraction of definitions and uses: one pass over the lines of a file, all in the JVM.

This is the fast path of an extractor: patterns that stand at the start of a line. It reads no trees, so what hides in strings or spans
lines is not seen; the evidence column says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID = "[A-Za-z_$][A-Za-z0-9_$]*"

#: language -> (kind, pattern whose first group is the name), first match of a line wins
DEFINITIONS: dict[str, tuple[tuple[str, str], ...]] = {
    "js": (
        ("function", f"^(?:export )?(?:default )?(?:async )?function[*]? ({ID})"),
        ("class", f"^(?:export )?(?:default )?(?:abstract )?class ({ID})"),
        ("interface", f"^(?:export )?interface ({ID})"),
        ("type-alias", f"^(?:export )?type ({ID}) ?[=<]"),
        ("enum", f"^(?:export )?(?:const )?enum ({ID})"),
        ("arrow", f"^(?:export )?const ({ID})[^=]*= (?:async )?[(][^)]*[)] =>"),
        ("variable", f"^(?:export )?(?:const|let|var) ({ID})"),
    ),
    "rs": (
        ("fn", f"^ *(?:pub )?(?:async )?(?:unsafe )?fn ({ID})"),
        ("struct", f"^ *(?:pub )?struct ({ID})"),
        ("enum", f"^ *(?:pub )?enum ({ID})"),
        ("trait", f"^ *(?:pub )?trait ({ID})"),
        ("impl", f"^impl ({ID})"),
        ("mod", f"^ *(?:pub )?mod ({ID})"),
        ("const", f"^ *(?:pub )?const ({ID})"),
    ),
    "go": (
        ("method", f"^func [(][^)]*[)] ({ID})"),
        ("func", f"^func ({ID})"),
        ("struct", f"^type ({ID}) struct"),
        ("type", f"^type ({ID})"),
        ("const", f"^const ({ID})"),
        ("var", f"^var ({ID})"),
    ),
}
LANGUAGE = {"ts": "js", "js": "js", "mjs": "js", "rs": "rs", "go": "go"}


def _lines(files: DataFrame) -> DataFrame:
    return files.select("file_id", F.posexplode(F.split("text", "\n")).alias("pos", "body")).select("file_id", (F.col("pos") + 1).alias("line"), "body")


def definitions(files: DataFrame, language: str) -> DataFrame:
    """file_id, name, kind, line, exported of files(file_id, ext, text) of one language."""
    exts = [e for e, lang in LANGUAGE.items() if lang == language]
    rules = DEFINITIONS[language]
    lines = _lines(files.where(F.col("ext").isin(*exts)))
    kind = F.coalesce(*[F.when(F.col("body").rlike(rx), k) for k, rx in rules])
    name = F.coalesce(*[F.when(F.col("body").rlike(rx), F.regexp_extract("body", rx, 1)) for _, rx in rules])
    public = {"js": F.col("body").startswith("export "), "rs": F.ltrim("body").startswith("pub "), "go": name.rlike("^[A-Z]")}[language]
    return lines.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("file_id", name.alias("name"), "kind", "line", public.alias("exported"))


def use_kind(line: Column) -> Column:
    """Kind of the use that a line of TypeScript or JavaScript makes of another module; null where it makes none."""
    return (
        F.when(line.rlike("^export [*] from "), "reExportAll")
        .when(line.rlike("^export [{][^}]*[}] from "), "reExportNamed")
        .when(line.rlike("^import type "), "import-type")
        .when(line.rlike("^import [*] as "), "namespace")
        .when(line.rlike("^import [{]"), "import")
        .when(line.rlike("^import ['\"]"), "import-side-effect")
        .when(line.rlike(f"^import {ID}"), "default")
        .when(line.rlike("(^|[^A-Za-z0-9_.])import[(]['\"]"), "dynamic-literal")
        .when(line.rlike("(^|[^A-Za-z0-9_.])import[(]"), "dynamic-opaque")
        .when(line.rlike("(^|[^A-Za-z0-9_.])require[(]"), "require")
    )


def uses(files: DataFrame) -> DataFrame:
    exts = [e for e, lang in LANGUAGE.items() if lang == "js"]
    lines = _lines(files.where(F.col("ext").isin(*exts))).withColumn("kind", use_kind(F.col("body"))).where(F.col("kind").isNotNull())
    spec = F.regexp_extract("body", "(?:from |import |import[(]|require[(])['\"]([^'\"]*)['\"]", 1)
    return lines.select("file_id", "line", "kind", spec.alias("spec"), F.col("kind").isin("import-type").alias("type_only"))


def outcome(kind: Column, spec: Column, target: Column) -> Column:
    """Where a use leads; first rule that holds."""
    return (
        F.when(kind == "dynamic-opaque", "opaque")
        .when(spec.rlike("^(node:|https?:)"), "external")
        .when(~spec.startswith(".") & ~spec.rlike("^[@~]/"), "external")
        .when(spec.rlike("[.](css|svg|png|json)$"), "non-source-asset")
        .when(target.isNotNull(), "internal")
        .otherwise("unresolved")
    )


def resolve_aliases(specs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Stage and target of specs(spec): exact alias, then the longest wildcard prefix, else external. aliases(pattern, target) with at most
    one '*' at the end of both. Every prefix of a spec is looked up by equality."""
    exact = aliases.where(~F.col("pattern").endswith("*")).select(F.col("pattern").alias("spec"), F.col("target").alias("exact"))
    wild = aliases.where(F.col("pattern").endswith("*")).select(F.expr("left(pattern, length(pattern) - 1)").alias("prefix"), F.expr("left(target, length(target) - 1)").alias("to"))
    s = specs.select("spec").distinct()
    p = s.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("spec"), F.lit(1))), lambda i: F.left("spec", i)))).join(wild, "prefix")
    best = p.groupBy("spec").agg(F.max_by(F.struct("prefix", "to"), F.length("prefix")).alias("b"))
    j = s.join(exact, "spec", "left").join(best, "spec", "left")
    tail = F.concat("b.to", F.expr("substring(spec, length(b.prefix) + 1)"))
    stage = F.when(F.col("spec").startswith("."), "relative").when(F.col("exact").isNotNull(), "exact-alias").when(F.col("b").isNotNull(), "wildcard-alias").otherwise("external")
    return j.select("spec", stage.alias("stage"), F.when(stage == "exact-alias", F.col("exact")).when(stage == "wildcard-alias", tail).alias("target"))


def unused_by_name(defs: DataFrame, words: DataFrame) -> DataFrame:
    """References of every definition by name: words(file_id, word, n, is_test) counts identifiers of the same language. A definition's own
    mention is not counted; entry points and test paths are muted, public items are never removal candidates."""
    total = words.groupBy(F.col("word").alias("name")).agg(F.sum(F.when(~F.col("is_test"), F.col("n")).otherwise(0)).alias("production"), F.sum(F.when(F.col("is_test"), F.col("n")).otherwise(0)).alias("test"))
    own = defs.groupBy("name").agg(F.count("*").alias("own"))
    j = defs.join(own, "name").join(total, "name", "left").fillna({"production": 0, "test": 0})
    refs = F.greatest(F.lit(0).cast("bigint"), F.col("production") + F.col("test") - F.col("own"))
    status = F.when(F.col("name").isin("main", "default", "new"), "muted:entrypoint").when(refs > 0, "referenced").when(F.col("exported"), "review-public").otherwise("remove-candidate")
    return j.select("file_id", "name", "kind", refs.alias("references"), status.alias("status"))
