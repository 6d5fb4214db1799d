"""Differences between two states: multisets of occurrences, sets of files, canon against fresh facts, snapshots, summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrence_delta(before: DataFrame, after: DataFrame, key: str = "occurrence_key", part: str = "file", order: str = "line") -> DataFrame:
    """Multiset difference by key: of the occurrences of a key, sorted by (part, order), those beyond the other side's count are silent-new
    or removed, the rest pre-existing. The ordinal is taken in two steps (counts per part, then within it), so that an occurrence key of
    many files is no unit of work."""

    def side(mine: DataFrame, other: DataFrame, label: str) -> DataFrame:
        n = other.groupBy(key).agg(F.count("*").alias("other"))
        parts = mine.groupBy(key, part).agg(F.count("*").alias("c"))
        w = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select(key, part, F.coalesce(F.sum("c").over(w), F.lit(0)).alias("before_part"))
        j = mine.withColumn("within", F.row_number().over(Window.partitionBy(key, part).orderBy(order)))
        j = j.join(parts, (j[key].eqNullSafe(parts[key])) & (j[part].eqNullSafe(parts[part]))).drop(parts[key]).drop(parts[part])
        j = j.withColumn("ordinal", F.col("before_part") + F.col("within")).drop("before_part", "within").join(n, key, "left")
        return j.withColumn("label", F.when(F.col("ordinal") > F.coalesce("other", F.lit(0)), label).otherwise("pre-existing")).drop("other")

    new = side(after, before, "silent-new")
    gone = side(before, after, "removed").where("label = 'removed'")
    return new.unionByName(gone)


def file_delta(planned: DataFrame, before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Per file: planned, unexpected, missing, removed. Without a side the status says so instead of a clean delta."""
    if after is None or before is None:
        return planned.select("file", F.lit("after-missing" if after is None else "baseline-missing").alias("status"))
    flags = [(planned, "planned"), (before, "before"), (after, "after")]
    rows = None
    for df, name in flags:
        part = df.select("file", *[F.lit(name == n).alias(n) for _, n in flags])
        rows = part if rows is None else rows.unionByName(part)
    g = rows.groupBy("file").agg(*[F.bool_or(n).alias(n) for _, n in flags])
    p, b, a = F.col("planned"), F.col("before"), F.col("after")
    status = F.when(p & a & ~b, "planned-new").when(p & a, "planned-existing").when(p, "planned-missing").when(a & ~b, "unexpected-new").when(b & ~a, "removed").otherwise("unchanged")
    return g.select("file", status.alias("status"))


def match_planned(planned: DataFrame, observed: DataFrame) -> DataFrame:
    """One-to-one greedy matching of planned(plan_id, kind, hint) to observed(occ_id, kind, file, line, fresh): plans in order take the
    first fitting occurrence that nobody took, fresh ones before others. A hint is a file, a directory around it, or unknown. Plans never
    match another kind, so each kind is one group; plans are few by nature, and of a plan's candidates only as many as there are plans of
    a kind can matter, so no more of them reach the group. Plans without a hint share the first occurrences of their kind, which are cut
    before they are joined."""
    most = planned.groupBy("kind").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    order = [(~F.col("fresh")).cast("int"), "file", "line", "occ_id"]
    occ = observed.select("occ_id", "kind", "file", "line", "fresh")
    first = occ.withColumn("r0", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).where(F.col("r0") <= most).drop("r0")
    anywhere = planned.where("hint = 'unknown'").select("plan_id", "kind").join(first, "kind")
    p = planned.where("hint <> 'unknown'").select("plan_id", F.col("kind").alias("k"), F.regexp_replace("hint", "/+$", "").alias("hint"))
    inside = (F.col("file") == F.col("hint")) | F.col("file").startswith(F.concat("hint", F.lit("/")))
    hinted = p.join(occ, (F.col("k") == F.col("kind")) & inside).select("plan_id", "kind", "occ_id", "file", "line", "fresh")
    w = Window.partitionBy("plan_id").orderBy(*order)
    ranked = anywhere.select(hinted.columns).unionByName(hinted).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for plan, g in pdf.sort_values(["plan_id", "r"]).groupby("plan_id", sort=True):
            for occ in g["occ_id"]:
                if occ not in taken:
                    taken.add(occ)
                    out.append((plan, occ))
                    break
        return pd.DataFrame(out, columns=["plan_id", "occ_id"])

    matched = ranked.groupBy("kind").applyInPandas(greedy, "plan_id bigint, occ_id bigint")
    return planned.select("plan_id", "kind").join(matched, "plan_id", "left").withColumn("label", F.when(F.col("occ_id").isNull(), "planned-not-observed").otherwise("planned"))


def canon_drift(canon: DataFrame, fresh: DataFrame) -> DataFrame:
    """canon and fresh(name, owner, label): added, removed, label-changed, owner-changed. One removal and one addition of a name are a
    change of owner; several are ambiguous and stay apart with low confidence."""
    c = canon.select("name", "owner", F.col("label").alias("old"), F.lit(True).alias("c"))
    f = fresh.select("name", "owner", F.col("label").alias("new"), F.lit(True).alias("f"))
    j = c.join(f, ["name", "owner"], "full_outer")
    moves = j.groupBy("name").agg(F.count(F.when(F.col("f").isNull(), 1)).alias("gone"), F.count(F.when(F.col("c").isNull(), 1)).alias("come"))
    j = j.join(moves, "name")
    pair = (F.col("gone") == 1) & (F.col("come") == 1)
    kind = F.when(F.col("c") & F.col("f"), F.when(F.col("old").eqNullSafe(F.col("new")), F.lit("same")).otherwise("label-changed")).when(pair, "owner-changed").when(F.col("c").isNull(), "added").otherwise("removed")
    conf = F.when(pair | (F.col("gone") == 0) | (F.col("come") == 0), "high").otherwise("low")
    out = j.select("name", "owner", "old", "new", kind.alias("drift"), conf.alias("confidence"))
    return out.where("drift <> 'same' AND NOT (drift = 'owner-changed' AND new IS NULL)")


def snapshot_changes(prior: DataFrame, now: DataFrame) -> DataFrame:
    """prior and now(file, content_hash, fingerprint): reuse of a cached fact needs equal content and context; else the reason."""
    p = prior.select("file", F.col("content_hash").alias("ph"), F.col("fingerprint").alias("pf"))
    j = p.join(now, "file", "full_outer")
    status = F.when(F.col("content_hash").isNull(), "dropped").when(F.col("ph").isNull(), "new").when(F.col("ph") != F.col("content_hash"), "changed").when(F.col("pf") != F.col("fingerprint"), "context-changed").otherwise("reused")
    return j.select("file", status.alias("status"))


def compare_summaries(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per metric of left and right(metric, value): right minus left, null unless both sides have a number."""
    j = left.select("metric", F.col("value").alias("left")).join(right.select("metric", F.col("value").alias("right")), "metric", "full_outer")
    return j.withColumn("delta", F.col("right") - F.col("left"))


def nearest_following(marks: DataFrame, defs: DataFrame, within: int = 3) -> DataFrame:
    """For each mark(file, line) the next definition(file, line, name) at most `within` lines below. The distance is an equality key
    of within+1 values, so the search is a hash join on (file, line)."""
    m = marks.withColumn("at", F.explode(F.sequence(F.col("line"), F.col("line") + within))).alias("m")
    d = defs.alias("d")
    j = m.join(d, (F.col("m.file") == F.col("d.file")) & (F.col("m.at") == F.col("d.line")))
    return j.groupBy(F.col("m.file").alias("file"), F.col("m.line").alias("line")).agg(F.min_by("d.name", F.struct("d.line", "d.name")).alias("name"))


def innermost(points: DataFrame, spans: DataFrame, bucket: int = 64) -> DataFrame:
    """For each point(file, line, id) the shortest span(file, start, end, name) around it. Spans are cut at multiples of `bucket`, so
    that containment is an equality on (file, bucket) with a filter, whatever the length of a file."""
    s = spans.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket)))).alias("s")
    p = points.withColumn("b", F.floor(F.col("line") / bucket)).alias("p")
    j = p.join(s, (F.col("p.file") == F.col("s.file")) & (F.col("p.b") == F.col("s.b")) & F.col("p.line").between(F.col("s.start"), F.col("s.end")))
    best = j.groupBy("p.id").agg(F.min_by("s.name", F.struct(F.col("s.end") - F.col("s.start"), F.col("s.start"), F.col("s.name"))).alias("name"))
    return points.select("id", "file", "line").join(best, "id", "left")


def overlapping(a: DataFrame, b: DataFrame, bucket: int = 1024) -> DataFrame:
    """Pairs of a(file, start, end, id) and b(file, start, end, id) that overlap; each pair is emitted in its first common bucket."""
    cut = lambda df: df.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.greatest("start", F.col("end")) / bucket))))
    x, y = cut(a).alias("x"), cut(b).alias("y")
    j = x.join(y, (F.col("x.file") == F.col("y.file")) & (F.col("x.b") == F.col("y.b")) & (F.col("x.start") <= F.col("y.end")) & (F.col("y.start") <= F.col("x.end")))
    first = F.floor(F.greatest("x.start", "y.start") / bucket)
    return j.where(F.col("x.b") == first).select(F.col("x.id").alias("a_id"), F.col("y.id").alias("b_id"))


def index_quantile(df: DataFrame, value: str, groups: list[str], percent: int = 95) -> DataFrame:
    """sorted[n * percent / 100] by integer division, not interpolated, per group. Values are counted first, so equal values of a hot
    group are one row; the running count then orders distinct values only."""
    c = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*groups)
    r = c.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    at = F.least(F.expr(f"n * {percent} div 100"), F.col("n") - 1)
    return r.where((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(*groups, F.col("n").alias("members"), F.col(value).alias(f"p{percent}"))


def size_bands(df: DataFrame, value: Column, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count_if(value > 150).alias("big"), F.count_if((value > 100) & (value <= 150)).alias("large"), F.count_if(value <= 100).alias("rest"))
