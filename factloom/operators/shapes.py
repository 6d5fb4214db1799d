"""Type shapes: facts(identity, owner_file, exported_name, fields, types)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialize
from .pairs import BLOCK, meet

# fixed values: words that say nothing about a domain
STOP_TOKENS = ("type", "types", "interface", "interfaces", "model", "models", "state", "view", "data", "dto", "payload", "props", "options", "config", "request", "response", "result", "event", "item")


def index(shapes: DataFrame) -> DataFrame:
    """Every shape hash with its owners in order."""
    h = shapes.withColumn("hash", F.md5(F.array_join("fields", "|")))
    return h.groupBy("hash").agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list("identity")), ",").alias("identities"), F.first(F.size("fields")).alias("field_count"))


def name_words(name: Column) -> Column:
    words = F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    return F.array_except(F.filter(words, lambda w: F.length(w) >= 3), F.array(*[F.lit(t) for t in STOP_TOKENS]))


MIN_JACCARD, MIN_JACCARD_WITHOUT_NAME = 0.4, 0.5


def near(shapes: DataFrame, least_shared: int = 2, block: int = BLOCK) -> DataFrame:
    """Pairs of shapes that share two fields and more and a cue (directory or a word of the name), and are alike enough.

    Two shapes can be alike enough only if they share one of the rarest fields of each: of k fields all but the commonest that the least
    overlap may consist of. They meet there, at their first shared field and cue; a field that is in most shapes is the rarest shared
    one of hardly any pair, so it is no place to meet. Where a place is still crowded its shapes meet in blocks (`pairs.meet`)."""
    words = name_words(F.col("exported_name"))
    folder = F.regexp_extract("owner_file", "^(.*)/[^/]*$", 1)
    k = F.size("fields")
    s = shapes.where(k >= least_shared).select("identity", "fields", words.alias("words"), folder.alias("dir"))
    counts = s.select(F.explode("fields").alias("field")).groupBy("field").agg(F.count("*").alias("n"))
    rare = s.select("identity", F.explode("fields").alias("field")).join(counts, "field").groupBy("identity").agg(F.array_sort(F.collect_list(F.struct("n", "field"))).alias("o"))
    s = s.join(rare.select("identity", F.transform("o", lambda x: x["field"]).alias("ordered")), "identity")
    cues = F.array_union(F.transform("words", lambda w: F.concat(F.lit("w:"), w)), F.array(F.concat(F.lit("d:"), "dir")))
    s = materialize(s.withColumn("cues", cues), "shape-index")
    prefix = F.slice("ordered", F.lit(1), k - F.greatest(F.ceil(k * MIN_JACCARD).cast("int"), F.lit(least_shared)) + 1)
    at = s.withColumn("field", F.explode(prefix)).withColumn("cue", F.explode("cues"))
    crowd = at.groupBy("field", "cue").agg(F.count("*").alias("crowd")).where("crowd > 1")
    j = meet(at.join(crowd, ["field", "cue"]), ["field", "cue"], "identity", "crowd", block)
    shared = F.array_intersect("l.fields", "r.fields")
    first = F.element_at(F.filter("l.ordered", lambda x: F.array_contains(F.col("r.fields"), x)), 1)
    j = j.where((F.col("field") == first) & (F.col("cue") == F.array_min(F.array_intersect("l.cues", "r.cues")))).withColumn("shared", F.size(shared).cast("bigint")).where(F.col("shared") >= least_shared)
    jac = F.col("shared") / (F.size("l.fields") + F.size("r.fields") - F.col("shared"))
    names = F.size(F.array_intersect("l.words", "r.words"))
    union = F.size(F.array_union("l.words", "r.words"))
    name_jac = F.when(union == 0, 0.0).otherwise(names / union)
    same = F.col("l.dir") == F.col("r.dir")
    ok = ((names > 0) | same) & ((jac >= MIN_JACCARD_WITHOUT_NAME) | ((names > 0) & (jac >= MIN_JACCARD)))
    score = F.round(0.75 * jac + 0.2 * name_jac + 0.05 * same.cast("double"), 3)
    return j.where(ok).select(F.col("l.identity").alias("left"), F.col("r.identity").alias("right"), "shared", F.round(jac, 3).alias("field_jaccard"), score.alias("score"))


def inline_groups(blocks: DataFrame, least: int = 3) -> DataFrame:
    """Equal normalised blocks that occur `least` times and more. blocks(file_id, block)."""
    shape = F.trim(F.regexp_replace("block", "[ \n\t\r]+", " "))
    g = blocks.withColumn("shape", shape).groupBy("shape").agg(F.count("*").alias("occurrences"), F.count_distinct("file_id").alias("files"))
    return g.where(F.col("occurrences") >= least)


def name_collisions(defs: DataFrame, low_info: tuple[str, ...]) -> DataFrame:
    """Label of every exported name: facts(name, identity, fan_in, contaminated)."""
    g = defs.groupBy("name").agg(F.count("*").alias("n"), F.max("fan_in").alias("top"), F.sum("fan_in").alias("total"), F.min(F.col("contaminated").cast("int")).alias("all_bad"))
    d = defs.join(g, "name")
    many = F.col("n") >= 2
    label = (
        F.when(many & (F.col("all_bad") == 1), "ANY_COLLISION")
        .when(many & (F.col("top") >= 3) & (F.col("total") >= 3), "DUPLICATE_STRONG")
        .when(many & F.col("name").isin(*low_info), "LOCAL_COMMON_NAME")
        .when(many, "DUPLICATE_REVIEW")
        .when(F.col("contaminated"), "severely-any-contaminated")
        .when((F.length("name") == 1) & (F.col("fan_in") < 3), "low-signal-type-name")
        .when(F.col("fan_in") >= 3, "single-owner-strong")
        .when(F.col("fan_in") >= 1, "single-owner-weak")
        .otherwise("zero-internal-fan-in")
    )
    return d.select("name", "identity", "fan_in", label.alias("label"))
