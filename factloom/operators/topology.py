"""Topology of a directed multigraph edges(src, dst, type_only) over nodes(file, submodule, loc, parse_error).

Duplicate edges are kept and count. Rankings have a total order (count descending, name ascending), so that top-k is
TakeOrderedAndProject with one answer; counts are combined before the shuffle, so a hub is no hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import lookup


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def fan(edges: DataFrame, side: str, k: int = 15) -> DataFrame:
    """The k files of most incoming (side 'dst') or outgoing ('src') edges, type-only ones included."""
    counted = edges.groupBy(F.col(side).alias("file")).agg(F.count("*").alias("n"))
    return top(counted, k, F.col("n").desc(), F.col("file").asc())


def largest_files(nodes: DataFrame, least: int = 400, flag: int = 1000, k: int = 20) -> DataFrame:
    sized = nodes.where(F.col("loc") >= least).select("file", "loc", (F.col("loc") >= flag).alias("oversize"))
    return top(sized, k, F.col("loc").desc(), F.col("file").asc())


def cross_submodule(edges: DataFrame, nodes: DataFrame, k: int | None = 30) -> DataFrame:
    """Edge counts between different submodules; edges with an unknown end are left out. Edges are counted per pair of ends
    before the submodules are looked up."""
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("c"))
    names = nodes.select("file", "submodule")
    both = pairs.join(names.select(F.col("file").alias("src"), F.col("submodule").alias("from_module")), "src")
    both = both.join(names.select(F.col("file").alias("dst"), F.col("submodule").alias("to_module")), "dst")
    counted = both.where("from_module <> to_module").groupBy("from_module", "to_module").agg(F.sum("c").alias("n"))
    return counted if k is None else top(counted, k, F.col("n").desc(), F.col("from_module"), F.col("to_module"))


def summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: files, lines, mean, parse errors (a missing size counts as one), edges by kind. A mean over no files is null."""
    bad = F.col("parse_error") | F.col("loc").isNull()
    a = nodes.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc"),
        F.round(F.try_divide(F.sum("loc"), F.count("*")), 2).alias("mean_loc"),
        F.count_if(bad).alias("parse_errors"),
    )
    b = edges.agg(F.count("*").alias("internal_edges"), F.count_if("type_only").alias("type_only_edges"), F.count_if(~F.col("type_only")).alias("runtime_edges"))
    return a.join(b, F.lit(True))  # one row each


def degree_classes(edges: DataFrame, nodes: DataFrame, cyclic: DataFrame, shared: int = 5) -> DataFrame:
    """Label of every submodule by its neighbours: cyclic, isolated, shared (at least `shared` in), leaf (no out), scoped."""
    pairs = cross_submodule(edges, nodes, None)
    ins = pairs.groupBy(F.col("to_module").alias("submodule")).agg(F.count("*").alias("fan_in"))
    outs = pairs.groupBy(F.col("from_module").alias("submodule")).agg(F.count("*").alias("fan_out"))
    mods = nodes.groupBy("submodule").agg(F.count("*").alias("files"), F.max("loc").alias("largest"))
    j = mods.join(ins, "submodule", "left").join(outs, "submodule", "left").join(cyclic.select("submodule", F.lit(True).alias("in_cycle")).distinct(), "submodule", "left").fillna({"fan_in": 0, "fan_out": 0, "in_cycle": False})
    label = (
        F.when(F.col("in_cycle"), "cyclic-submodule")
        .when((F.col("fan_in") == 0) & (F.col("fan_out") == 0), "isolated-submodule")
        .when(F.col("fan_in") >= shared, "shared-submodule")
        .when(F.col("fan_out") == 0, "leaf-submodule")
        .otherwise("scoped-submodule")
    )
    return j.select("submodule", "files", "fan_in", "fan_out", label.alias("label"), (F.col("largest") >= 1000).alias("oversize"))


def submodule_of(paths: DataFrame, workspaces: DataFrame, n_workspaces: int, path: str = "path") -> DataFrame:
    """Submodule of a path: the longest workspace that is a prefix; else src/x, apps/x, packages/x; else the first segment; a
    path without a directory is 'root'. Every prefix of a path is looked up by equality, so no join is a range join."""
    parts = F.split(path, "/")
    prefixes = paths.select(path).distinct().withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    hit = lookup(prefixes, workspaces.select(F.col("workspace").alias("prefix")).distinct().withColumn("w", F.lit(1)), ["prefix"], n_workspaces)
    longest = hit.groupBy(path).agg(F.max_by("prefix", F.length("prefix")).alias("workspace"))
    two = F.concat_ws("/", parts[0], parts[1])
    rule = F.when(F.size(parts) == 1, "root").when(parts[0].isin("src", "apps", "packages") & (F.size(parts) > 2), two).otherwise(parts[0])
    return paths.join(longest, path, "left").withColumn("submodule", F.coalesce("workspace", rule)).drop("workspace")


def entry_surface(*surfaces: DataFrame) -> DataFrame:
    """Distinct union of (file, source) entry lists; a file that several name keeps its first source by name."""
    return reduce(DataFrame.unionByName, surfaces).groupBy("file").agg(F.min("source").alias("source"), F.count_distinct("source").alias("sources"))
