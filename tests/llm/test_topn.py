from __future__ import annotations

import random

from factloom.llm.topn import top_n_per_group

SCHEMA = "g bigint, p string, id bigint, file string, score bigint, code string, need int"


def brute(rows, n):
    groups = {}
    for g, p, i, f, s in set(rows):
        if s is not None:
            groups.setdefault((g, p), []).append((-s, (f is None, (f or "").encode()), i))
    return {k: [x[2] for x in sorted(v)[:n]] for k, v in groups.items()}


def run(spark, rows, n=10, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = {}
    for r in top_n_per_group(df, ["g", "p"], "score", "file", "id", n, **kw).collect():
        out.setdefault((r.g, r.p), {})[r.rank] = r.id
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


def test_against_brute_force(spark):
    rng = random.Random(7)
    names = ["a/b", "a/B", "é", "ÿ", "😀", "\uffee", "", None, "a" * 30 + "x", "a" * 30 + "y"] + [f"src/{i}" for i in range(40)]
    rows = []
    for i in range(3000):
        g = rng.choice([None, 1, 1, 1, 1, 2, 3, rng.randrange(100)])
        rows.append((g, rng.choice(["p", None]), i, rng.choice(names), rng.choice([None, -5, 0, 1, 1, 1, 2**62, -(2**62)])))
    rows += rng.sample(rows, 200)
    for kw in ({}, {"small": 10, "ways": 4}, {"small": 20, "ways": 64}):
        assert run(spark, rows, 10, **kw) == brute(rows, 10)


def test_all_tied(spark):
    rows = [(1, "p", i, "same/file/of/all", 3) for i in range(400)]
    assert run(spark, rows, 5, small=5, ways=3) == {(1, "p"): [0, 1, 2, 3, 4]}


def test_same_id_with_other_texts_ends(spark):
    rows = [(1, "p", 9, f"f{i % 3}", i % 2) for i in range(100)]
    assert len(run(spark, rows, 3, small=3, ways=2)[(1, "p")]) == 3


def test_empty(spark):
    assert run(spark, []) == {} and run(spark, [(1, "p", 1, "f", None)]) == {}
