from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import deltas, intervals, shapes, symbols
from factloom.sources import connectors, extract, sinks


def test_non_overlapping(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(5), s := rng.randrange(200), s + rng.randrange(15)) for _ in range(400)]
    want = []
    for f in range(5):
        until, n = None, 0
        for _, s, e in sorted(r for r in rows if r[0] == f):
            if n < 7 and (until is None or s > until):
                want.append((f, s, e))
                until, n = e, n + 1
    df = spark.createDataFrame([(*r, 1) for r in rows], 'file bigint, start bigint, "end" bigint, n int'.replace('"end"', "`end`"))
    assert sorted(map(tuple, intervals.non_overlapping(df, 7).collect())) == sorted(want)
    assert intervals.non_overlapping(df.limit(0)).count() == 0


def test_globs():
    ok = [("src/**/*.ts", "src/a/b/c.ts"), ("src/**/*.ts", "src/c.ts"), ("*.{js,ts}", "a.js"), ("a?c", "abc"), ("**/x.y", "x.y")]
    no = [("src/**/*.ts", "lib/c.ts"), ("*.js", "a/b.js"), ("a?c", "a/c"), ("a.c", "abc")]
    for g, p in ok:
        assert re.match(connectors.glob_pattern(g), p), (g, p)
    for g, p in no:
        assert not re.match(connectors.glob_pattern(g), p), (g, p)


def test_script_tools(spark):
    rows = [(1, "tsc -p . && npm run lint"), (2, "A=1 jest 'x y'; npx vitest"), (3, "echo 'open"), (4, None), (5, ""), (6, "pnpm dlx tsx a && node_modules/.bin/esbuild; node server.js; npm test"), (7, "yarn lint || npm run-script x")]
    got = sorted((r.id, r.tool) for r in connectors.script_tools(spark.createDataFrame(rows, "id bigint, command string")).collect())
    assert got == [(1, "tsc"), (2, "jest"), (2, "vitest"), (3, "echo"), (6, "esbuild"), (6, "node"), (6, "tsx"), (7, "lint")]


def test_component_uses(spark):
    t = "<template><FooBar /></template>\n<script src='./a.js'></script>\n<script>import x from './b'</script>\n<style>@import './c.css'</style>"
    df = spark.createDataFrame([(1, "vue", t), (2, "ts", t), (3, "mdx", None)], "file_id bigint, ext string, text string")
    assert {(r.file_id, r.kind, r.target) for r in connectors.component_uses(df).collect()} == {(1, "component-tag", "FooBar"), (1, "script-src", "./a.js"), (1, "import", "./b"), (1, "style-asset", "./c.css")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("GA001", "note", "a|b", "x\ny")], "rule_id string, level string, location string, reason string")
    assert '"ruleId": "GA001"' in sinks.result_log(df)
    assert "a\\|b" in sinks.markdown_table(df) and "unavailable" in sinks.summary_report("t", {"s": None, "r": df})
    path = f"file://{tmp_path}/x"
    assert sinks.read_artifact(spark, path) is None
    sinks.write_artifact(df, path)
    assert sinks.read_artifact(spark, path).count() == 1
    assert [sinks.exit_code({"a": s}, strict) for s, strict in (("ok", True), ("failed", False), ("drift", False), ("drift", True))] == [0, 1, 0, 1]
    pairs = spark.createDataFrame([("a", "b", 3), ("c", "d-e", 3)], "from_module string, to_module string, n bigint")
    assert sinks.mermaid(pairs) == "graph LR\n  a -->|3| b\n  c -->|3| d_e"


def test_walk(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.ts").write_text("const a = 1;\n")
    (tmp_path / "y.txt").write_text("no")
    assert [r.text for r in connectors.walk(spark, str(tmp_path)).collect()] == ["const a = 1;\n"]


def test_markers(spark):
    t = "x: any; y:\n any; éany: anyé\nfoo as any, as  unknown as T; // TODO XTODO TODO_ @ts-ignore new Function ( evalx( eval ("
    df = spark.createDataFrame([(1, "ts", t), (2, "py", t), (3, "rs", t), (4, "ts", None)], "file_id bigint, ext string, text string")
    got = {r.file_id: r for r in text.marker_counts(df).collect()}
    assert set(got) == {1, 2, 4}
    one = got[1].asDict()
    assert (one[":any"], one["as any"], one["as unknown as"], one["TODO"], one["Function constructor"], one["eval("]) == (3, 1, 1, 1, 1, 0)
    assert got[2].asDict()["eval("] == 1 and got[4].n_lines is None
    totals = {r.pattern: r for r in text.discipline_totals(text.marker_counts(df.limit(0))).collect()}
    assert totals["TODO"].per_file is None


def test_conventions(spark):
    names = {"a-b": "kebab-case", "A_B": "UPPER_SNAKE", "a_b": "snake_case", "AbC": "PascalCase", "aB": "camelCase", "AB": "UPPER_SNAKE", "ab": "camelCase", "a_B": "mixed", "": "mixed", None: "mixed"}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r.name: r.c for r in df.select("name", text.convention(F.col("name")).alias("c")).collect()} == names


def test_near_names(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    intents = ["abcd", "ab", "a", "dcbadc", "aabbcc"]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, prev = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        return row[-1]

    def pre(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    want = {(q, w) for q in intents for w in set(words) if w != q and ((pre(q, w) >= 4 and abs(len(w) - len(q)) <= len(q)) or (abs(len(w) - len(q)) <= 2 and lev(q, w) <= 2))}
    got = text.near_names(spark.createDataFrame([(w,) for w in words], "name string"), spark.createDataFrame([(q,) for q in intents], "name string"))
    assert {(r.intent, r.name) for r in got.collect()} == want


def test_absence_is_not_clean(spark):
    d = spark.createDataFrame([("p", "d", "r", "prod", False, False)], "package_dir string, dependency string, dep_root string, section string, script_tool boolean, type_package boolean")
    assert symbols.unused_dependencies(d, None).first().status == "unavailable"
    f = spark.createDataFrame([("f", "n", "k", 1)], "file string, name string, kind string, line int")
    assert symbols.runtime_evidence(f, None).first().status == "unavailable"


def test_alias_stages(spark):
    a = spark.createDataFrame([("x", "one"), ("p/*", "q/*"), ("p/r/*", "s/*")], "pattern string, target string")
    s = spark.createDataFrame([("x",), ("p/a",), ("p/r/b",), ("./y",), ("z",)], "spec string")
    got = {r.spec: (r.stage, r.target) for r in extract.resolve_aliases(s, a).collect()}
    assert got == {"x": ("exact-alias", "one"), "p/a": ("wildcard-alias", "q/a"), "p/r/b": ("wildcard-alias", "s/b"), "./y": ("relative", None), "z": ("external", None)}


def test_interval_joins(spark):
    rng = random.Random(9)
    spans = [(rng.randrange(3), s := rng.randrange(300), s + rng.randrange(120), f"n{i}") for i in range(80)]
    points = [(rng.randrange(3), rng.randrange(400), i) for i in range(120)]
    sp = spark.createDataFrame(spans, "file bigint, start bigint, `end` bigint, name string")
    got = {r.id: r.name for r in deltas.innermost(spark.createDataFrame(points, "file bigint, line bigint, id bigint"), sp, bucket=16).collect()}
    for f, line, i in points:
        fit = [(e - s, s, n) for g, s, e, n in spans if g == f and s <= line <= e]
        assert got[i] == (min(fit)[2] if fit else None)
    x = [(f, s, e, f"a{i}") for i, (f, s, e, _) in enumerate(spans[:40])]
    y = [(f, s, e, f"b{i}") for i, (f, s, e, _) in enumerate(spans[40:])]
    mk = lambda r: spark.createDataFrame(r, "file bigint, start bigint, `end` bigint, id string")
    pairs = [tuple(r) for r in deltas.overlapping(mk(x), mk(y), bucket=16).collect()]
    want = {(i, j) for f, s, e, i in x for g, t, u, j in y if f == g and s <= u and t <= e}
    assert set(pairs) == want and len(pairs) == len(want)


def test_near_shapes_need_a_cue(spark):
    rows = [("a::X", "d/x.ts", "UserData", ["a", "b", "c"]), ("b::Y", "e/y.ts", "UserModel", ["a", "b", "d"]), ("c::Z", "f/z.ts", "Order", ["a", "b", "c"])]
    df = spark.createDataFrame(rows, "identity string, owner_file string, exported_name string, fields array<string>")
    assert [(r.left, r.right, r.field_jaccard) for r in shapes.near(df).collect()] == [("a::X", "b::Y", 0.5)]
