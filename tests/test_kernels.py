"""Graph, clone and delta kernels against plain Python."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from factloom.operators import clones, deltas, graph, topology
from factloom.plans import q_topology
from factloom.streaming import events


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def closure(edges, starts):
    seen = set(starts)
    todo = list(seen)
    while todo:
        v = todo.pop()
        for a, b in edges:
            if a == v and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_components_by_rounds_equal_kernel(spark):
    edges = random_edges(40, 55, 1) + [(3, 3), (5, 6), (6, 5)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    want = {}
    for v in range(40):
        c = {w for w in closure(edges, [v]) if v in closure(edges, [w])}
        if len(c) > 1:
            want[v] = min(c)
    for limit in (10**6, 0):
        assert {r.node: r.component for r in graph.components(df, limit).collect()} == want


def test_reach_by_rounds_equals_kernel(spark):
    edges = random_edges(30, 35, 2)
    df, entries = spark.createDataFrame(edges, "src bigint, dst bigint"), spark.createDataFrame([(1,), (2,), (99,), (None,)], "file bigint")
    got = [{(r.file, r.depth) for r in graph.reachable(df, entries, k).collect()} for k in (10**6, 0)]
    assert got[0] == got[1] and {f for f, _ in got[0]} == closure(edges, [1, 2, 99])
    assert {d for _, d in {(r.file, r.depth) for r in graph.reachable(df, entries, max_depth=1).collect()}} <= {0, 1}


def test_unreachable_components_are_all_listed(spark, monkeypatch):
    n = 1005
    edges = [e for i in range(n) for e in ((2 * i, 2 * i + 1, False), (2 * i + 1, 2 * i, False))] + [(9999, 1, True), (5000, 5001, False), (5001, 5000, True)]
    facts = {"walk": spark.createDataFrame(edges, "src bigint, dst bigint, type_only boolean"), "walk_entries": spark.createDataFrame([(9999,)], "file bigint")}
    monkeypatch.setattr(q_topology, "fact", lambda s, d, name: facts[name])
    assert [tuple(r) for r in q_topology.unreachable_sccs(spark, "").collect()] == [(2 * i, 2) for i in range(1, n)]


def test_unreachable_components_of_a_long_ring_need_few_rounds(spark, monkeypatch):
    n, tables, kept = 600_000, [], graph.materialize
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), F.lit(False).alias("type_only"))
    facts = {"walk": ring, "walk_entries": spark.createDataFrame([(n,)], "file bigint")}
    monkeypatch.setattr(q_topology, "fact", lambda s, d, name: facts[name])

    def counted(df, label):
        tables.append(label)
        assert len(tables) < 6
        return kept(df, label)

    monkeypatch.setattr(graph, "materialize", counted)
    assert [tuple(r) for r in q_topology.unreachable_sccs(spark, "").collect()] == [(0, n)]


def test_unreachable_components_by_brute_force(spark, monkeypatch):
    some = 0
    for seed in range(3):
        rng = random.Random(seed)
        edges = [(rng.randrange(-20, 20), rng.randrange(-20, 20), rng.random() < 0.3) for _ in range(55)] + [(50, 51, False), (51, 50, False)]
        starts = [x for x, _, _ in edges[:2]]
        seen, run = closure([e[:2] for e in edges], starts), [e[:2] for e in edges if not e[2]]
        reach = {v: closure(run, [v]) for e in edges for v in e[:2]}
        parts = {frozenset(w for w in reach[v] if v in reach[w]) for v in reach}
        want = {(min(c), len(c)) for c in parts if len(c) > 1 and not c & seen}
        some += len(want)
        for text in (False, True):
            walk, entries = spark.createDataFrame(edges, "src bigint, dst bigint, type_only boolean"), spark.createDataFrame([(x,) for x in starts], "file bigint")
            if text:
                walk, entries = walk.selectExpr("lpad(src + 100, 3, '0') src", "lpad(dst + 100, 3, '0') dst", "type_only"), entries.selectExpr("lpad(file + 100, 3, '0') file")
            facts = {"walk": walk, "walk_entries": entries}
            monkeypatch.setattr(q_topology, "fact", lambda s, d, name: facts[name])
            for most in (10**6, 0) if seed == 0 and not text else (10**6,):
                monkeypatch.setattr(graph, "KERNEL_EDGES", most)
                monkeypatch.setattr(graph, "KERNEL_NUMBER_EDGES", most)
                got = {(int(r.component) - 100 if text else r.component, r["size"]) for r in q_topology.unreachable_sccs(spark, "").collect()}
                assert got == want
    assert some > 3


def test_empty_graph(spark):
    e, s = spark.createDataFrame([], "src bigint, dst bigint"), spark.createDataFrame([], "file bigint")
    assert graph.components(e).count() == 0 and graph.reachable(e, s).count() == 0
    assert topology.fan(e, "dst").count() == 0


def test_top_ties(spark):
    e = spark.createDataFrame([("a", x) for x in ("z", "y", "x", "y", "z")], "src string, dst string")
    assert [(r.file, r.n) for r in topology.fan(e, "dst", 2).collect()] == [("y", 2), ("z", 2)]


def test_block_clones(spark):
    base = [f"t{i}" for i in range(30)]
    files = {1: base + ["q"] * 5, 2: ["r"] * 3 + base, 3: [f"u{i}" for i in range(40)]}
    rows = [(f, i, v, i) for f, vs in files.items() for i, v in enumerate(vs)]
    got = clones.block_clones(spark.createDataFrame(rows, "file bigint, pos bigint, value string, line bigint"), k=10, chunk=F.lit(0)).collect()
    assert [(r.file, r.file2, r.start, r.start2, r.tokens) for r in got] == [(1, 2, 0, 3, 30)]
    rows += [(f + 10, p, v, n) for f, p, v, n in rows] + [(f + 20, p, v, n) for f, p, v, n in rows]
    df = spark.createDataFrame(rows, "file bigint, pos bigint, value string, line bigint")
    for chunk in (None, F.lit(0), F.col("file") % 3):
        # six files share the run: five links join them, whatever the chunks
        links = [(r.file, r.file2) for r in clones.block_clones(df, k=10, chunk=chunk).collect() if r.tokens >= 30 and {r.file % 10, r.file2 % 10} <= {1, 2}]
        joined = {1}
        for _ in range(6):
            joined |= {x for a, b in links for x in (a, b) if a in joined or b in joined}
        assert joined == {1, 2, 11, 12, 21, 22} and len(links) == 5


def test_block_clones_of_periodic_files(spark):
    k, files = 10, {1: [f"t{i % 4}" for i in range(60)], 2: [f"t{i % 4}" for i in range(40)]}
    rows = [(f, i, v, i) for f, vs in files.items() for i, v in enumerate(vs)]
    got = clones.block_clones(spark.createDataFrame(rows, "file bigint, pos bigint, value string, line bigint"), k=k, chunk=F.lit(0)).collect()
    links = {(r.file, p, r.file2, p + r.start2 - r.start) for r in got for p in range(r.start, r.start + r.tokens - k + 1)}
    want = set()  # every window to the first equal one of its file that does not overlap it
    for f, vs in files.items():
        for p in range(len(vs) - k + 1):
            later = [q for q in range(p + k, len(vs) - k + 1) if vs[q : q + k] == vs[p : p + k]]
            want |= {(f, p, f, q) for q in later[:1]}
    assert want and want == {x for x in links if x[0] == x[2]}
    # the four windows of the period join the files at their first places, in one run
    assert {(1, p, 2, p) for p in range(4)} <= links


def test_multiset_delta(spark):
    mk = lambda ks: spark.createDataFrame([(k, "f", i) for i, k in enumerate(ks)], "occurrence_key string, file string, line bigint")
    got = Counter((r.occurrence_key, r.label) for r in deltas.occurrence_delta(mk("aabc"), mk("aaabd")).collect())
    assert got == {("a", "pre-existing"): 2, ("a", "silent-new"): 1, ("b", "pre-existing"): 1, ("d", "silent-new"): 1, ("c", "removed"): 1}


def test_planned_matching(spark):
    plans = spark.createDataFrame([(1, "k", "d"), (2, "k", "d/"), (3, "k", "unknown"), (4, "z", "unknown"), (5, "k", "d/f")], "plan_id bigint, kind string, hint string")
    occ = spark.createDataFrame([(10, "k", "d/f1", 1, False), (11, "k", "d/f2", 2, True)], "occ_id bigint, kind string, file string, line bigint, fresh boolean")
    got = {r.plan_id: r.occ_id for r in deltas.match_planned(plans, occ).collect()}
    assert got == {1: 11, 2: 10, 3: None, 4: None, 5: None}


def test_file_delta_without_a_side(spark):
    p = spark.createDataFrame([("a",)], "file string")
    assert deltas.file_delta(p, None, p).first().status == "baseline-missing"
    assert deltas.file_delta(p, p, None).first().status == "after-missing"


def test_quantile(spark):
    rng = random.Random(5)
    vals = [rng.randrange(50) for _ in range(333)]
    df = spark.createDataFrame([("g", v) for v in vals] + [("h", 4), ("g", None)], "g string, v bigint")
    got = {r.g: r.p95 for r in deltas.index_quantile(df, "v", ["g"]).collect()}
    assert got == {"g": sorted(vals)[333 * 95 // 100], "h": 4}


def test_claims(spark):
    rows = [("s", i, i != 2, i == 3, None, 0) for i in range(1, 10)]
    e = spark.createDataFrame(rows, "session string, entry bigint, active boolean, acked boolean, next_redeliver_at timestamp, deliveries int")
    got = events.claim_due(e, "2025-01-01")
    assert [r.entry for r in got.orderBy("entry").collect()] == [1, 4, 5, 6, 7]
    after = events.mark_delivered(e, got, "2025-01-01")
    assert [r.entry for r in events.claim_due(after, "2025-01-01").orderBy("entry").collect()] == [8, 9]
