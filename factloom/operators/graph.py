"""Graph closures on edges(src, dst): reachability and strongly connected components, by rounds of joins.

Each round ends in a written table, so that lineage stays short and a lost executor costs one round. A graph of up to `kernel_edges`
edges (counted, not assumed) is handed to one task instead, where an iterative algorithm needs no rounds.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialize

#: edges that one task may hold, by the kind of their ids: numbers take less than 100 bytes an edge, texts as long as they are
KERNEL_EDGES = 500_000
KERNEL_NUMBER_EDGES = 8_000_000


def _most(kind: str, kernel_edges: int | None) -> int:
    return kernel_edges if kernel_edges is not None else KERNEL_NUMBER_EDGES if kind in ("int", "bigint") else KERNEL_EDGES


def _graph(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, memoryview, memoryview]:
    """Nodes; the codes (places among the nodes) of sources without a target; and by code where its targets begin, and their codes."""
    lone, src, dst = [], [], []
    for b in batches:
        s, d = b.column(0), b.column(1)
        if d.null_count:
            lone.append(s.filter(d.is_null()))
            s, d = s.filter(d.is_valid()), d.drop_null()
        src.append(s)
        dst.append(d)
    parts = [*lone, *src, *dst]
    cuts = [sum(map(len, lone)), sum(map(len, lone + src))]
    if parts and pa.types.is_integer(parts[0].type):
        ids = np.concatenate([x.to_numpy() for x in parts])
        del parts, lone, src, dst
        order = np.argsort(ids)
        ids = ids[order]
        new = np.concatenate([[True] * len(ids[:1]), ids[1:] != ids[:-1]])
        nodes, codes = pa.array(ids[new]), np.empty(len(ids), np.int32)
        del ids
        codes[order] = np.cumsum(new, dtype=np.int32) - 1
        del order
    else:
        both = pa.chunked_array(parts, None if parts else pa.string()).dictionary_encode().combine_chunks()
        nodes, codes = both.dictionary, both.indices.to_numpy()
        del both, parts, lone, src, dst
    first, a, b = np.split(codes, cuts)
    begin = np.zeros(len(nodes) + 1, np.int32)
    np.cumsum(np.bincount(a, minlength=len(nodes)), out=begin[1:])
    return nodes, first, memoryview(begin), memoryview(b[np.argsort(a, kind="stable")])


def _batches(**columns: pa.Array) -> list[pa.RecordBatch]:
    return pa.table(columns).to_batches(max_chunksize=100_000)


def _depths(n: int, starts: np.ndarray, begin: memoryview, to: memoryview, max_depth: int | None) -> np.ndarray:
    """The depth of every node, -1 where it is not reached."""
    out = np.full(n, -1, np.int32)
    out[starts] = 0
    depth, level, k = memoryview(out), np.unique(starts).tolist(), 0
    while level and (max_depth is None or k < max_depth):
        k += 1
        found = []
        for v in level:
            for i in range(begin[v], begin[v + 1]):
                w = to[i]
                if depth[w] < 0:
                    depth[w] = k
                    found.append(w)
        level = found
    return out


def reachable(edges: DataFrame, entries: DataFrame, kernel_edges: int | None = None, max_depth: int | None = None) -> DataFrame:
    """file, depth of every node reachable from entries(file), entries included (also those without edges). Duplicate edges and
    self-loops change nothing. max_depth bounds the rounds; the caller learns by the depths that it was reached."""
    kind = edges.schema["src"].dataType.simpleString()
    links = edges.select("src", F.col("dst").cast(kind).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    starts = entries.select(F.col("file").cast(kind).alias("file")).where("file IS NOT NULL").distinct()
    links = materialize(links, "reach-edges")
    if links.count() + starts.count() <= _most(kind, kernel_edges):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nodes, first, begin, to = _graph(batches)
            depth = _depths(len(nodes), first, begin, to, max_depth)
            seen = np.flatnonzero(depth >= 0)
            yield from _batches(file=nodes.take(pa.array(seen)), depth=pa.array(depth[seen]))

        both = links.unionByName(starts.select(F.col("file").alias("src"), F.lit(None).cast(kind).alias("dst")))
        return both.repartition(1).mapInArrow(run, f"file {kind}, depth int")
    seen = materialize(starts.withColumn("depth", F.lit(0)), "reach")
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = links.join(frontier.select(F.col("file").alias("src")), "src").select(F.col("dst").alias("file")).distinct()
        frontier = materialize(found.join(seen, "file", "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if frontier.isEmpty():
            return seen
        seen = materialize(seen.unionByName(frontier), "reach") if depth % 8 == 0 else seen.unionByName(frontier)
    return seen


def _tarjan(n: int, begin: memoryview, to: memoryview) -> np.ndarray:
    """For every node a number of its strongly connected component (the code of one of its nodes); no recursion."""
    out = np.full(n, -1, np.int32)
    part = memoryview(out)  # open nodes have an index and no part
    index, low, at = memoryview(np.zeros(n, np.int32)), memoryview(np.zeros(n, np.int32)), memoryview(np.array(begin))
    stack, work, order = array("i"), array("i"), 0
    for root in range(n):
        if index[root]:
            continue
        order += 1
        index[root] = low[root] = order
        stack.append(root)
        work.append(root)
        while work:
            v = work[-1]
            for i in range(at[v], begin[v + 1]):
                w = to[i]
                if not index[w]:
                    order += 1
                    index[w] = low[w] = order
                    stack.append(w)
                    work.append(w)
                    at[v] = i + 1
                    break
                if part[w] < 0 and index[w] < low[v]:
                    low[v] = index[w]
            else:
                work.pop()
                if work and low[v] < low[work[-1]]:
                    low[work[-1]] = low[v]
                if low[v] == index[v]:
                    while True:
                        w = stack.pop()
                        part[w] = v
                        if w == v:
                            break
    return out


def _propagate(links: DataFrame, start: DataFrame, how: str) -> DataFrame:
    """Fixpoint of the greatest label that reaches each node. Each round sends the labels that changed in the one before."""
    labels = start.select("node", "label", F.lit(True).alias("fresh"))
    while True:
        sent = links.join(labels.where("fresh").select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("label").alias("label"))
        both = labels.select("node", F.col("label").alias("own"), F.lit(None).cast(start.schema["label"].dataType).alias("got")).unionByName(sent.select("node", F.lit(None).cast(start.schema["label"].dataType).alias("own"), F.col("label").alias("got")))
        new = both.groupBy("node").agg(F.max("own").alias("own"), F.max("got").alias("got"))
        grew = F.col("got").isNotNull() & (F.col("own").isNull() | (F.col("got") > F.col("own")))
        labels = materialize(new.select("node", F.greatest("own", "got").alias("label"), grew.alias("fresh")), f"scc-{how}")
        if labels.where("fresh").isEmpty():
            return labels.select("node", "label")


def components(edges: DataFrame, kernel_edges: int | None = None) -> DataFrame:
    """node, component (its smallest node) of every strongly connected component of at least two nodes; self-loops make none."""
    kind = edges.schema["src"].dataType.simpleString()
    most = _most(kind, kernel_edges)
    links = materialize(edges.select("src", F.col("dst").cast(kind).alias("dst")).where("src <> dst").distinct(), "scc-edges")
    found: list[DataFrame] = []
    while True:
        # nodes without incoming or outgoing edges are in no component
        n = links.count()
        while n > most:
            ends = links.select(F.col("src").alias("v")).intersect(links.select(F.col("dst").alias("v")))
            trimmed = links.join(ends.select(F.col("v").alias("src")), "src", "left_semi").join(ends.select(F.col("v").alias("dst")), "dst", "left_semi").select("src", "dst")
            links = materialize(trimmed, "scc-edges")
            before, n = n, links.count()
            if n > 0.95 * before:
                break
        if n <= most:

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                nodes, _, begin, to = _graph(batches)
                part = _tarjan(len(nodes), begin, to)
                kept = np.flatnonzero(np.bincount(part, minlength=len(nodes))[part] > 1) if len(part) else part
                names, part = nodes.take(pa.array(kept)), part[kept]
                ranks = pc.sort_indices(names).to_numpy()
                least = np.empty(len(nodes), np.int64)
                least[part[ranks[::-1]]] = ranks[::-1]  # the last one written is the smallest
                yield from _batches(node=names, component=names.take(pa.array(least[part])))

            found.append(links.repartition(1).mapInArrow(run, f"node {kind}, component {kind}"))
            break
        # colour every node by the greatest node that reaches it; within a colour, what reaches its root is a component
        nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct().withColumn("label", F.col("node"))
        colour = _propagate(links, nodes, "colour")
        inside = links.join(colour.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
        back = materialize(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "a"), "scc-back")
        seen = materialize(colour.where("node = label").select("node", "label"), "scc-back")
        frontier = seen
        while True:
            step = back.join(frontier.select(F.col("node").alias("src"), F.col("label").alias("a")), ["src", "a"]).select(F.col("dst").alias("node"), F.col("a").alias("label")).distinct()
            frontier = materialize(step.join(seen, ["node", "label"], "left_anti"), "scc-front")
            if frontier.isEmpty():
                break
            seen = materialize(seen.unionByName(frontier), "scc-seen")
        sizes = seen.groupBy("label").agg(F.count("*").alias("n"), F.min("node").alias("component")).where("n > 1")
        found.append(materialize(seen.join(sizes, "label").select("node", "component"), "scc-found"))
        gone = seen.select("node")
        links = materialize(links.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "scc-edges")
        if links.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def component_list(parts: DataFrame, k: int | None = 10) -> DataFrame:
    """The k largest components (all for None): size descending, smallest node ascending."""
    ranked = parts.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.col("size").desc(), F.col("component").asc())
    return ranked if k is None else ranked.limit(k)


def chain_ends(links: DataFrame) -> DataFrame:
    """src, end, steps: where the chain that begins with every link(src, dst) ends. A node hands on to one other (the least, where it
    is given several); a chain that runs into a cycle has no end (null, null).

    Links are doubled: each round joins every open chain with the one that begins at its end, so a chain of n links takes log2(n)
    rounds; a chain that is longer than there are links is in a cycle. Finished chains leave the rounds."""
    own = links.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src").agg(F.min("dst").alias("dst"))
    hops = materialize(own.select("src", "dst", F.lit(1).cast("bigint").alias("steps"), F.lit(False).alias("done")), "chain")
    total, reach = hops.count(), 1
    while not hops.where("NOT done").isEmpty():
        ends = hops.where("done")
        if reach > total:
            lost = hops.where("NOT done").select("src", F.lit(None).cast(hops.schema["dst"].dataType).alias("dst"), F.lit(None).cast("bigint").alias("steps"), F.lit(True).alias("done"))
            hops = ends.unionByName(lost)
            break
        nxt = hops.select(F.col("src").alias("dst"), F.col("dst").alias("far"), F.col("steps").alias("more"), F.col("done").alias("over"))
        j = hops.where("NOT done").join(nxt, "dst", "left")
        moved = j.select("src", F.coalesce("far", "dst").alias("dst"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("over", F.lit(True)).alias("done"))
        hops = materialize(ends.unionByName(moved), "chain")
        reach *= 2
    return hops.select("src", F.col("dst").alias("end"), "steps")
