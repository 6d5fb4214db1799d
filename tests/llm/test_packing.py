from __future__ import annotations

import os
import random
from collections import defaultdict

import numpy as np
import pytest

from factloom.llm import mixing, packing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")

WORDS = "alpha beta gamma delta report commit parser window lease token shelf order".split()


def docs(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(rng.choice([0, 1, 5, 40, 200, 900])))) for i in range(n)]


def test_packing_is_whole(spark):
    rows = [*docs(300), (300, None), (301, "alpha"), (302, "alpha")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id bigint, text string, container string, tokens int")
    packs = spark.createDataFrame([("s", 64), ("m", 512), ("none", 0)], "pack_name string, capacity_tokens int")
    out = packing.pack_documents(df, packs, shard_docs=100).collect()
    enc = tokens.encoder(tokens.VOCABULARY)
    size = {i: len(enc.encode_ordinary(t or "")) for i, t in rows}
    for name, cap in (("s", 64), ("m", 512)):
        used, per = defaultdict(int), defaultdict(list)
        for r in out:
            if r.pack_name == name:
                used[r.container] += r.tokens
                per[r.doc_id].append((r.piece, r.tokens, r.container))
        assert max(used.values()) <= cap
        assert {i: sum(t for _, t, _ in v) for i, v in per.items()} == size
        for i, v in per.items():
            assert [p for p, _, _ in sorted(v)] == list(range(len(v)))
            if size[i] <= cap:
                assert len(v) == 1
            else:
                assert all(t == cap for _, t, _ in sorted(v)[:-1])
        # close to what the tokens need: a container or two per shard to spare
        assert len(used) <= -(-sum(size.values()) // cap) * 1.05 + 8
    assert {r.pack_name for r in out} == {"s", "m"}
    report = {r.pack_name: r for r in packing.unused_space(spark.createDataFrame(out), packs).collect()}
    assert report["s"].used_tokens == sum(size.values())


def test_order_does_not_matter(spark):
    packs = spark.createDataFrame([("m", 128)], "pack_name string, capacity_tokens int")
    a = spark.createDataFrame(docs(120), "doc_id bigint, text string")
    one = sorted(map(tuple, packing.pack_documents(a, packs).collect()))
    two = sorted(map(tuple, packing.pack_documents(a.orderBy("doc_id", ascending=False).repartition(7), packs).collect()))
    assert one == two


def test_neighbours_share_words():
    rng = np.random.default_rng(0)
    terms = [np.unique(rng.integers(0, 200, 30)).astype(np.int32) for _ in range(50)]
    terms[7] = terms[3].copy()
    index = packing.Index(terms, [np.ones(len(t), np.int32) for t in terms], np.array([len(t) for t in terms]))
    allowed = np.ones(50, bool)
    allowed[3] = False
    assert index.neighbours(3, allowed)[0] == 7
    allowed[7] = False
    assert 7 not in index.neighbours(3, allowed)


def test_all_terms_and_neighbours_count():
    # 0 shares twelve rare terms with 1 only, and sixty less rare ones with each of 2 to 61
    rare, rest = np.arange(12, dtype=np.int32), np.arange(100, 160, dtype=np.int32)
    terms = [np.concatenate([rare, rest]), rare, *[rest] * 60, np.array([999], np.int32)]
    index = packing.Index(terms, [np.ones(len(t), np.int32) for t in terms], np.array([len(t) for t in terms]))
    assert set(index.neighbours(0, np.ones(63, bool)).tolist()) - {0} == set(range(1, 62))
    # the container is filled with neighbours, though a larger document that shares nothing would fit
    sizes = np.array([10, *[1] * 61, 9])
    box = packing.fill(sizes, 71, index)
    assert len(set(box[:62])) == 1 and box[62] != box[0]


def test_shards_by_content(spark):
    rng = random.Random(4)
    topics = [WORDS[:6], WORDS[6:]]
    df = spark.createDataFrame([(i, "go " + " ".join(rng.choice(topics[i % 2]) for _ in range(60))) for i in range(200)], "doc_id bigint, text string")
    got = packing.sharded(tokens.token_counts(df, ["doc_id"], terms=True), 100).select("doc_id", "shard").collect()
    n = defaultdict(int)
    for r in got:
        n[r.shard, r.doc_id % 2] += 1
    assert len(got) == 200 and sum(max(n[s, 0], n[s, 1]) for s in {s for s, _ in n}) > 160
    same = spark.createDataFrame([(i, "alpha beta") for i in range(500)], "doc_id bigint, text string")
    sizes = [r["count"] for r in packing.sharded(tokens.token_counts(same, ["doc_id"], terms=True), 100).groupBy("shard").count().collect()]
    assert len(sizes) == 5 and max(sizes) < 200


def test_empty(spark):
    packs = spark.createDataFrame([("m", 128)], "pack_name string, capacity_tokens int")
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack_documents(none, packs).count() == 0
    assert packing.pack_documents(none, packs.limit(0)).count() == 0


# ---- mixing ----
def test_plan():
    t = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 4), "d": (0.0, 9)}
    r = mixing.plan(t, {"a": 1000, "b": 100, "c": 100})
    total = sum(r[s] * n for s, n in {"a": 1000, "b": 100, "c": 100}.items())
    assert r["b"] == pytest.approx(2) and r["a"] * 1000 / total == pytest.approx(0.5) and r["c"] * 100 / total == pytest.approx(0.2)
    big = mixing.plan(t, {"a": 1000, "b": 100, "c": 100}, 1e9)
    assert big == {"a": 1, "b": 2, "c": 4}
    assert mixing.plan(t, {}) == {} and set(mixing.plan(t, {"a": 5})) == {"a"}


def test_mix(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        s = rng.choice(["big"] * 8 + [" Small ", "SMALL", "other", None])
        rows.append((i, " ".join(["w"] * rng.choice([1, 3, 30, 200])), s))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, source string, chunk int, rank int")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 5)], "source string, target_share double, max_repeats int")
    used, report = mixing.mix(df, targets)
    rep = {r.source: r for r in report.collect()}
    assert rep["absent"].used_tokens == 0 and rep["absent"].actual_share == 0
    assert rep["big"].actual_share == pytest.approx(0.6 / 0.9, abs=0.01) and rep["small"].actual_share == pytest.approx(0.3 / 0.9, abs=0.01)
    got = used.collect()
    assert len({r.doc_id for r in got}) == len(got)
    assert all(1 <= r.uses <= (1 if r.source == "big" else 3) for r in got)
    # the expectation is met per source: copies are the floor or the ceiling of the rate
    for s, r in rep.items():
        assert {x.uses for x in got if x.source == s} <= {int(r.expected_uses), int(r.expected_uses) + 1}
    none, r0 = mixing.mix(df.limit(0), targets)
    assert none.count() == 0 and r0.count() == 3
