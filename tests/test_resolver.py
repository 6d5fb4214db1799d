from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import resolver

FILES = ["src/a.ts", "src/b/index.ts", "src/b/c.js", "src/d.tsx", "lib/e.mts", "packages/p/src/index.ts", "packages/p/util.ts", "packages/q/deep/x.ts", "tools/t.ts", "src/app/y.ts", "src/inner/z.ts"]


def test_normal_path(spark):
    df = spark.createDataFrame([("a/./b/../c",), ("../a",), ("a//b/",), ("",), (None,), ("a/../../b",)], "p string")
    assert [r.x for r in df.select(resolver.normal_path(F.col("p")).alias("x")).collect()] == ["a/c", None, "a/b", "", None, None]


def test_stages(spark):
    want = {
        ("src/a.ts", "./b"): ("src/b/index.ts", "relative", "internal"), ("src/b/c.js", "../a"): ("src/a.ts", "relative", "internal"), ("src/b/c.js", "../d.js"): ("src/d.tsx", "relative", "internal"),
        ("src/a.ts", "../lib/e.mjs"): ("lib/e.mts", "relative", "internal"), ("src/a.ts", "./none"): (None, "relative", "unresolved"), ("src/a.ts", "../../out"): (None, "relative", "unresolved"),
        ("src/a.ts", "@/app/y"): ("src/app/y.ts", "wildcard-alias", "internal"), ("src/inner/z.ts", "@/z"): ("src/inner/z.ts", "wildcard-alias", "internal"), ("src/a.ts", "tool"): ("tools/t.ts", "exact-alias", "internal"),
        ("src/a.ts", "@/gone"): (None, "wildcard-alias", "unresolved"), ("src/a.ts", "app/y"): ("src/app/y.ts", "base-url", "internal"), ("tools/t.ts", "@org/p"): ("packages/p/src/index.ts", "workspace-package", "internal"),
        ("tools/t.ts", "@org/p/util"): ("packages/p/util.ts", "workspace-package", "internal"), ("tools/t.ts", "src/d"): ("src/d.tsx", "root-prefix", "internal"), ("tools/t.ts", "react"): (None, None, "external"),
        ("tools/t.ts", "lodash/fp"): (None, None, "external"), ("tools/t.ts", "@org/other"): (None, None, "external"),
    }
    rows = [(n, "r", path, spec) for n, (path, spec) in enumerate(want)]
    i = spark.createDataFrame([*rows, rows[0], (99, "r", "src/a.ts", None), (98, "s", "src/a.ts", "./b")], "file_id bigint, repo string, path string, spec string")
    f = spark.createDataFrame([("r", p) for p in FILES], "repo string, path string")
    a = spark.createDataFrame([("r", "", "@/*", "src/*"), ("r", "src/inner", "@/*", "./*"), ("r", "", "tool", "tools/t"), ("r", "", "@/app/*", "nowhere/*")], "repo string, scope string, pattern string, target string")
    b = spark.createDataFrame([("r", "", "src")], "repo string, scope string, base string")
    p = spark.createDataFrame([("r", "@org/p", "packages/p")], "repo string, name string, package_dir string")
    got = {r.file_id: (r.target, r.stage, r.outcome) for r in resolver.resolve(i, f, a, b, p).collect()}
    assert got.pop(98) == (None, "relative", "unresolved")
    assert got == {n: want[path, spec] for n, (path, spec) in enumerate(want)}
    assert resolver.resolve(i.limit(0), f).count() == 0


def test_calls_through_imports(spark):
    calls = [("a", "own"), ("a", "own"), ("a", "load"), ("a", "ns.read"), ("a", "gone"), ("a", "far"), ("a", "free"), ("a", "obj.m"), ("a", None)]
    c = spark.createDataFrame(calls, "caller_file string, callee string")
    d = spark.createDataFrame([("a", "own"), ("b", "fetch"), ("b", "read"), ("z", "free"), ("b", "fetch")], "file string, name string")
    i = spark.createDataFrame([("a", "load", "fetch", "b"), ("a", "ns", "*", "b"), ("a", "gone", "gone", "b"), ("a", "far", "far", None)], "file string, local string, imported string, target string")
    got = {r.callee: (r.to_file, r.calls, r.outcome) for r in resolver.resolve_calls(c, d, i).collect()}
    assert got == {
        "own": ("a", 2, "internal-same-file"), "load": ("b", 1, "internal"), "ns.read": ("b", 1, "internal"), "gone": (None, 1, "imported-missing"),
        "far": (None, 1, "imported-unresolved"), "free": (None, 1, "unresolved"), "obj.m": (None, 1, "unresolved"),
    }
