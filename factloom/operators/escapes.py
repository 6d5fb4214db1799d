"""Escapes from a type system: one fact per occurrence, its owner, and the labels of owners.

files(file_id, ext, text); definitions(file_id, name, kind, line, exported) of the same files. Every line of a text is tried against
the kinds in order of how specific they are, so an occurrence has one kind. A line lies in the last definition that begins at the
margin at or before it; a documentation comment belongs to the next definition within three lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: kinds of escapes, most specific first. A kind may have several patterns.
KINDS = (
    ("rest-any-args", r"[.][.][.][A-Za-z_$][A-Za-z0-9_$]*: any\b"),
    ("index-sig-any", r"\[[A-Za-z_$][A-Za-z0-9_$]*: [a-z]+\]: any\b"),
    ("generic-default-any", r"\b[A-Z][A-Za-z0-9]*(?: extends [A-Za-z]+)? = any\b"),
    ("as-unknown-as-T", r"as unknown as [A-Za-z_$][A-Za-z0-9_$]*"),
    ("as-any", r"\bas any\b"),
    ("explicit-any", r"[A-Za-z0-9_$]<any\b"),
    ("angle-any", r"<any>"),
    ("no-explicit-any-disable", r"eslint-disable(?:-next-line|-line)?\b[^\n]*\bno-explicit-any\b"),
    ("ts-ignore", r"@ts-ignore\b"),
    ("ts-expect-error", r"@ts-expect-error\b"),
    ("jsdoc-any", r"@(?:type|param|returns?|typedef|property) *[{] *any *[}]"),
    ("explicit-any", r"(?:: |, |\| |<)any\b"),
)
PATTERN = "|".join(rx for _, rx in KINDS)
#: fixed values: kinds that are no use of any, and kinds of owners
NOT_ANY = ("ts-ignore", "ts-expect-error")
TYPE_OWNERS = ("interface", "type-alias", "enum", "module")
HELPER_OWNERS = ("function", "arrow", "variable")


def facts(files: DataFrame, definitions: DataFrame) -> DataFrame:
    """file_id, line, kind, code, owner, owner_kind (null at the top level) and occurrence_key of every escape. Texts of files without any
    escape are left at the scan; only lines with one meet the definitions of their file."""
    lines = files.where(F.col("text").rlike(PATTERN)).select("file_id", F.posexplode(F.split("text", "\n")).alias("pos", "body"))
    found = lines.where(F.col("body").rlike(PATTERN)).select("file_id", (F.col("pos") + 1).alias("line"), F.posexplode(F.regexp_extract_all("body", F.lit(f"({PATTERN})"), F.lit(1))).alias("nth", "code"))
    found = found.withColumn("kind", F.coalesce(*[F.when(F.col("code").rlike(f"^(?:{rx})$"), k) for k, rx in KINDS]))
    d = definitions.select("file_id", "line", F.struct("name", "kind").alias("d")).withColumn("code", F.lit(None).cast("string"))
    both = found.select("file_id", "line", F.lit(None).cast(d.schema["d"].dataType).alias("d"), "code", "kind", "nth").unionByName(d, allowMissingColumns=True)
    # a definition counts for its own line; a file is the unit, whose lines are few and whose order is needed
    up = Window.partitionBy("file_id").orderBy("line", F.col("d").isNull())
    down = Window.partitionBy("file_id").orderBy(F.col("line").desc(), F.col("d").isNull())
    at = F.struct("d", "line")
    both = both.withColumn("above", F.last(F.when(F.col("d").isNotNull(), at), True).over(up)).withColumn("below", F.last(F.when(F.col("d").isNotNull(), at), True).over(down))
    doc = F.when(F.col("below.line") - F.col("line") <= 3, F.col("below.d"))
    both = both.where("code IS NOT NULL").withColumn("o", F.when(F.col("kind") == "jsdoc-any", doc).otherwise(F.col("above.d")))
    code = F.trim(F.regexp_replace("code", "[ \t]+", " "))
    key = F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", F.col("file_id").cast("string"), "kind", code, F.coalesce("o.name", F.lit("<top-level>"))), 256))
    return both.select("file_id", "line", "kind", "code", F.col("o.name").alias("owner"), F.col("o.kind").alias("owner_kind"), key.alias("occurrence_key"))


def owner_labels(escapes: DataFrame) -> DataFrame:
    """Label of every owner with an any: has-any, any-contaminated or severely-any-contaminated. Escapes at the top level have no owner."""
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    g = escapes.where("owner IS NOT NULL").groupBy("file_id", "owner", "owner_kind").agg(
        F.count("*").alias("escapes"), F.count_if(~F.col("kind").isin(*NOT_ANY)).alias("any_escapes"), n("explicit-any").alias("explicit"), n("as-any", "angle-any").alias("casts"),
        n("as-unknown-as-T").alias("laundering"), n("rest-any-args").alias("rest"), n("index-sig-any").alias("index"), n("jsdoc-any").alias("jsdoc"), n("no-explicit-any-disable").alias("disabled"),
    ).where("any_escapes > 0")
    is_type, is_helper = F.col("owner_kind").isin(*TYPE_OWNERS), F.col("owner_kind").isin(*HELPER_OWNERS)
    severe = (F.col("laundering") > 0) | (F.col("rest") > 0) | (F.col("casts") >= 2) | (F.col("explicit") >= 3) | (F.col("index") > 0) | (is_type & (F.col("any_escapes") >= 3)) | (is_helper & (F.col("jsdoc") >= 2))
    some = is_type | (F.col("casts") > 0) | (F.col("explicit") > 0) | (F.col("jsdoc") > 0) | (F.col("disabled") > 0)
    label = F.when(severe, "severely-any-contaminated").when(some, "any-contaminated").otherwise("has-any")
    return g.select("file_id", "owner", "owner_kind", "escapes", "any_escapes", label.alias("label"))
