"""Text functions as column expressions: marker counters, tokenizers, naming conventions, name distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_W = "A-Za-z0-9_"
_B, _E = f"(?<![{_W}])", f"(?![{_W}])"
_S = "[ \t\n\f\r]"


def _word(w: str) -> str:
    return _B + w + _E


# fixed values: markers by language, as regular expressions with ASCII word boundaries
DISCIPLINE: dict[str, tuple[tuple[str, ...], str]] = {
    ":any": (("ts",), f":{_S}*any{_E}"),
    "as any": (("ts",), f"{_B}as{_S}+any{_E}"),
    "as unknown as": (("ts",), f"{_B}as{_S}+unknown{_S}+as{_E}"),
    "@ts-ignore": (("ts",), "@ts-ignore"),
    "@ts-expect-error": (("ts",), "@ts-expect-error"),
    "@ts-nocheck": (("ts",), "@ts-nocheck"),
    "eslint-disable": (("ts",), "eslint-disable"),
    "Function constructor": (("ts",), f"{_B}new{_S}+Function{_S}*[(]"),
    "# type: ignore": (("py",), f"#{_S}*type:{_S}*ignore{_E}"),
    "# pyright: ignore": (("py",), f"#{_S}*pyright:{_S}*ignore{_E}"),
    "# pylint: disable": (("py",), f"#{_S}*pylint:{_S}*disable{_E}"),
    "# noqa": (("py",), f"#{_S}*noqa{_E}"),
    "eval(": (("py",), f"{_B}eval{_S}*[(]"),
    "exec(": (("py",), f"{_B}exec{_S}*[(]"),
    "interface{}": (("go",), f"{_B}interface{_S}*[{{]{_S}*[}}]"),
    "panic(": (("go",), f"{_B}panic{_S}*[(]"),
    "unsafe.": (("go",), f"{_B}unsafe[.][{_W}]+"),
    "//nolint": (("go",), f"//{_S}*nolint"),
    "TODO": (("ts", "py", "go"), _word("TODO")),
    "FIXME": (("ts", "py", "go"), _word("FIXME")),
    "HACK": (("ts", "py", "go"), _word("HACK")),
    "XXX": (("ts", "py", "go"), _word("XXX")),
}
FAMILY = {"ts": "ts", "js": "ts", "mjs": "ts", "py": "py", "go": "go"}


def lines(text: Column) -> Column:
    """Line feeds plus one."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def marker_counts(files: DataFrame, patterns: dict = DISCIPLINE) -> DataFrame:
    """file_id, family and one count column per pattern, zero where the pattern is not of the file's language. One scan of the text
    per pattern inside one stage; no rows are multiplied. Files of other languages are left out."""
    fam = F.coalesce(*[F.when(F.col("ext") == e, F.lit(f)) for e, f in FAMILY.items()])
    df = files.withColumn("family", fam).where(F.col("family").isNotNull())
    cols = [F.when(F.col("family").isin(*langs) & F.col("text").isNotNull(), F.regexp_count("text", F.lit(rx))).otherwise(0).alias(name) for name, (langs, rx) in patterns.items()]
    return df.select("file_id", "family", F.when(F.col("text").isNotNull(), lines(F.col("text"))).alias("n_lines"), *cols)


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def discipline_totals(counts: DataFrame, patterns: dict = DISCIPLINE) -> DataFrame:
    """pattern, total, per file (3 places), per thousand lines (2 places); null rates where nothing was scanned. An unreadable
    file has no lines and is not scanned."""
    read = F.count("n_lines")
    agg = counts.agg(read.alias("files"), F.sum("n_lines").alias("total_lines"), *[F.sum(_col(p)).alias(p) for p in patterns])
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), _col(p).alias("total")) for p in patterns]))
    out = agg.select("files", "total_lines", pairs.alias("x")).select("files", "total_lines", "x.*")
    return out.select("pattern", "total", F.round(F.try_divide("total", "files"), 3).alias("per_file"), F.round(F.try_divide(F.col("total") * 1000, F.col("total_lines")), 2).alias("per_kloc"))


def discipline_offenders(counts: DataFrame, k: int = 20, patterns: dict = DISCIPLINE) -> DataFrame:
    total = sum((_col(p) for p in patterns), F.lit(0))
    kinds = sum((F.when(_col(p) > 0, 1).otherwise(0) for p in patterns), F.lit(0))
    t = counts.select("file_id", total.cast("bigint").alias("total"), kinds.alias("patterns")).where("total > 0")
    return t.orderBy(F.col("total").desc(), "file_id").limit(k)


def convention(name: Column) -> Column:
    """Casing of a name; first match wins, empty and null are mixed."""
    return (
        F.when(name.isNull() | (name == ""), "mixed")
        .when(name.rlike("^[a-z][a-z0-9]*(-[a-z0-9]+)+$"), "kebab-case")
        .when(name.rlike("^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$"), "UPPER_SNAKE")
        .when(name.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)+$"), "snake_case")
        .when(name.rlike("^[A-Z][A-Za-z0-9]*$") & name.rlike("[A-Z].*[a-z]"), "PascalCase")
        .when(name.rlike("^[a-z][A-Za-z0-9]*$") & name.rlike("[a-z].*[A-Z]"), "camelCase")
        .when(name.rlike("^[A-Z][A-Z0-9]*$"), "UPPER_SNAKE")
        .when(name.rlike("^[a-z][a-z0-9]*$"), "camelCase")
        .otherwise("mixed")
    )


def basename(path: Column) -> Column:
    """File name without directory, last language extension and .test, .spec, .stories, .d."""
    b = F.regexp_replace(path, "^.*/", "")
    return F.regexp_replace(F.regexp_replace(b, "[.](mjs|tsx|mts|cts|cjs|jsx|ts|js|py|go|rs|json)$", ""), "[.](test|spec|stories|d)$", "")


def dominance(items: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """Dominant convention of every cohort of items(cohort, name): at least `least` members and `share` of them; 'mixed' never
    dominates; of equal counts the first by name."""
    c = items.groupBy("cohort", convention(F.col("name")).alias("convention")).agg(F.count("*").alias("n"))
    g = c.groupBy("cohort").agg(F.sum("n").alias("members"), F.max_by(F.struct("n", "convention"), F.struct(F.when(F.col("convention") == "mixed", 0).otherwise(F.col("n")), F.col("n"))).alias("b"), F.max(F.when(F.col("convention") != "mixed", F.col("n"))).alias("top"))
    first = c.where("convention <> 'mixed'").groupBy("cohort", "n").agg(F.min("convention").alias("convention")).withColumnRenamed("n", "top")
    g = g.drop("b").join(first, ["cohort", "top"], "left")
    s = F.round(F.col("top") / F.col("members"), 3)
    ok = (F.col("members") >= least) & (F.col("top") / F.col("members") >= share)
    return g.select("cohort", "members", F.when(ok, F.col("convention")).alias("dominant"), F.coalesce(s, F.lit(0.0)).alias("share"), F.when(F.col("members") < least, "too-few").when(ok, "convention").otherwise("mixed-convention").alias("label"))


def shared_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    hits = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(F.left(a, i) == F.left(b, i), 1).otherwise(0))
    return F.when(n == 0, 0).otherwise(F.aggregate(hits, F.lit(0), lambda x, y: x + y))


def near_names(candidates: DataFrame, intents: DataFrame, cap: int = 2, prefix: int = 4) -> DataFrame:
    """Names close to each intended name: a shared prefix of four characters, or a length within two and an edit distance within two.
    Both conditions become equality keys (the prefix; every piece of a name with one piece of three unchanged), so that the search is
    a hash join. intents is the small side; equal names are no match."""
    c = candidates.select("name").distinct()
    q = intents.select(F.col("name").alias("intent")).distinct()
    by_prefix = c.withColumn("k", F.left("name", F.lit(prefix))).where(F.length("name") >= prefix).join(q.withColumn("k", F.left("intent", F.lit(prefix))).where(F.length("intent") >= prefix), "k").drop("k")
    # two edits leave one of three pieces of the intent unchanged, moved by at most two positions; a candidate has the pieces of every
    # intent length that is within two of its own
    w, third = "(ilen div 3)", "CASE WHEN i = 2 THEN ilen - 2 * (ilen div 3) ELSE ilen div 3 END"
    three = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i")
    pieces = q.withColumn("ilen", F.length("intent")).where("ilen >= 3").select("intent", "ilen", three)
    pieces = pieces.select("intent", "ilen", "i", F.expr(f"substring(intent, i * {w} + 1, {third})").alias("k"))
    grams = c.withColumn("ilen", F.explode(F.sequence(F.greatest(F.lit(3), F.length("name") - cap), F.greatest(F.lit(3), F.length("name") + cap)))).select("name", "ilen", three)
    grams = grams.withColumn("shift", F.explode(F.sequence(F.lit(-cap), F.lit(cap)))).where(f"i * {w} + shift >= 0 AND i * {w} + shift + {third} <= length(name)")
    grams = grams.select("name", "ilen", "i", F.expr(f"substring(name, i * {w} + shift + 1, {third})").alias("k")).distinct()
    by_piece = grams.join(pieces, ["ilen", "i", "k"]).select("name", "intent")
    # intents of one and two characters have no pieces: names of nearly their length
    tiny = q.where(F.length("intent") < 3).withColumn("n", F.explode(F.sequence(F.lit(1), F.length("intent") + cap)))
    short = c.withColumn("n", F.length("name")).join(tiny, "n")
    both = by_prefix.select("name", "intent").unionByName(by_piece).unionByName(short.select("name", "intent")).distinct().where("name <> intent")
    dist = F.levenshtein("name", "intent", cap * 4)
    p = both.withColumn("prefix", shared_prefix(F.col("name"), F.col("intent"))).withColumn("d", F.when(dist < 0, cap * 4 + 1).otherwise(dist))
    near = (F.col("prefix") >= prefix) & (F.abs(F.length("name") - F.length("intent")) <= F.length("intent"))
    close = (F.abs(F.length("name") - F.length("intent")) <= 2) & (F.col("d") <= cap)
    return p.where(near | close).select("intent", "name", F.col("d").alias("distance"), "prefix")


def package_root(spec: Column) -> Column:
    return F.regexp_extract(spec, "^(@[^/]+/[^/]+|[^/]+)", 1)


def specifier_kind(spec: Column) -> Column:
    return F.when(spec.startswith("."), "relative").when(spec.startswith("/"), "absolute").when(spec.rlike("^(node:|https?:)"), "builtin").when(spec.startswith("@/") | spec.startswith("~/"), "alias").otherwise("package")


def barrel_discipline(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """Imports(spec) of the root of every package against those of its subpaths; compliance is the share of subpaths in percent, null
    without imports. packages(package): a specifier belongs to the package that is its root, so this is an equality join."""
    own = imports.where("spec IS NOT NULL").select(package_root(F.col("spec")).alias("package"), "spec")
    g = own.groupBy("package").agg(F.count_if(F.col("spec") == F.col("package")).alias("root_imports"), F.count_if(F.col("spec") != F.col("package")).alias("subpath_imports"))
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("root_imports", "subpath_imports")]
    j = packages.select("package").where("package IS NOT NULL").distinct().join(g, "package", "left").select("package", *zero).withColumn("total", F.col("root_imports") + F.col("subpath_imports"))
    return j.withColumn("compliance", F.round(F.try_divide(F.lit(100.0) * F.col("subpath_imports"), F.col("total")), 1))


def relative_path(path: Column, root: str) -> Column:
    """A path below a root without it, with forward slashes; other paths as they are."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    top = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(p.startswith(top), F.substring(p, len(top) + 1, 1_000_000)).otherwise(p)


def type_text(text: Column) -> Column:
    """A type as text without what only lays it out: runs of blanks are one, none stands beside a sign, and no semicolon at the end.
    What lies in string literals is left alone."""
    literal = r"'(?:[^'\\\\]|\\\\.)*'|\"(?:[^\"\\\\]|\\\\.)*\"|`(?:[^`\\\\]|\\\\.)*`".replace("\\\\", "\\")
    parts = F.regexp_extract_all(text, F.lit(f"((?:{literal})|[^'\"`]+|.)"), F.lit(1))
    tidy = lambda p: F.when(p.rlike("^['\"`]"), p).otherwise(F.regexp_replace(F.regexp_replace(p, r"\s+", " "), r" ?([<>()\[\]{}|&:,;=?]) ?", "$1"))
    return F.regexp_replace(F.trim(F.array_join(F.transform(parts, tidy), "")), "(?: ?; ?)+$", "")


def stable_json_hash(df: DataFrame, column: str, name: str = "hash") -> DataFrame:
    """df with the SHA-256 of a JSON text after its keys are sorted at every level; null where it is no JSON. Equal values in any key order
    or layout have equal hashes."""
    import hashlib
    import json
    from collections.abc import Iterator

    import pyarrow as pa

    from .strict_json import loads

    def digest(x: str | None) -> str | None:
        try:
            return None if x is None else hashlib.sha256(json.dumps(loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-8", "surrogatepass")).hexdigest()
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([digest(x) for x in b.column(column).to_pylist()], pa.string())], names=[*b.schema.names, name])

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{name}` string")
