"""Operators against their rules on small fixtures, with cases that the test tables do not hold."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import clones, escapes, graph, lookups, pairs, shapes, symbols
from factloom.sources import extract, sinks
from factloom.streaming import events


def test_runtime_evidence(spark):
    defs = [("a", "type", "TSInterfaceDeclaration", 1), ("none", "gone", "FunctionDeclaration", 1), ("empty", "idle", "FunctionDeclaration", 1), ("a", "run", "FunctionDeclaration", 10), ("a", "dead", "FunctionDeclaration", 30), ("a", "near", "ClassDeclaration", 120), ("a", "far", "ClassDeclaration", 400)]
    statements = [("a", 11, 0), ("a", 31, 5), ("a", 171, 9), ("a", 170, 2), ("a", 500, 1), ("empty", None, None)]
    functions = [("a", 1, 100, 7), ("a", 9, 15, 3), ("a", 29, 35, 0)]
    got = symbols.runtime_evidence(
        spark.createDataFrame(defs + defs[:1], "file string, name string, kind string, line bigint"), spark.createDataFrame(statements, "file string, line bigint, hits bigint"), spark.createDataFrame(functions, "file string, start bigint, end bigint, hits bigint")
    ).collect()
    assert {(r.name, r.status, r.confidence) for r in got} == {
        ("type", "type-only", "medium"), ("gone", "uncovered", "medium"), ("idle", "file-untested", "medium"), ("run", "executed", "low"), ("dead", "dead-confirmed", "high"), ("near", "executed", "low"), ("far", "dead-confirmed", "high"),
    }
    assert len(got) == len(defs)
    d = spark.createDataFrame(defs, "file string, name string, kind string, line bigint")
    assert {r.status for r in symbols.runtime_evidence(d, None).collect()} == {"unavailable"}


def test_escapes_and_their_owners(spark):
    code = """// @ts-ignore
export function one(...rest: any[]) {
  return rest as unknown as Thing;
}
export const two = (a: any) => a;
export interface Three<T = any> {
  [key: string]: any;
  m: Map<string, any>;
}
/** @param {any} x */
/** @returns {any} */
function four(x) { return x as any; }
class Company { many = 1 }
"""
    df = spark.createDataFrame([(1, "ts", code), (2, "ts", None), (3, "ts", ""), (4, "ts", "export const b = <any>c;\nconst anyone = x as anything;\n")], "file_id bigint, ext string, text string")
    e = escapes.facts(df, extract.definitions(df, "js"))
    got = sorted((r.file_id, r.line, r.kind, r.owner) for r in e.collect())
    assert got == sorted([
        (1, 1, "ts-ignore", None), (1, 2, "rest-any-args", "one"), (1, 3, "as-unknown-as-T", "one"), (1, 5, "explicit-any", "two"), (1, 6, "generic-default-any", "Three"), (1, 7, "index-sig-any", "Three"),
        (1, 8, "explicit-any", "Three"), (1, 10, "jsdoc-any", "four"), (1, 11, "jsdoc-any", "four"), (1, 12, "as-any", "four"), (4, 1, "angle-any", "b"),
    ])
    labels = {(r.file_id, r.owner): r.label for r in escapes.owner_labels(e).collect()}
    severe = "severely-any-contaminated"
    assert labels == {(1, "one"): severe, (1, "two"): "any-contaminated", (1, "Three"): severe, (1, "four"): severe, (4, "b"): "any-contaminated"}
    assert e.where("file_id = 9").count() == 0


def test_barrels(spark):
    i = spark.createDataFrame([("@a/b",), ("@a/b/c",), ("@a/b/d/e",), ("@a/bc",), ("x",), (None,)], "spec string")
    p = spark.createDataFrame([("@a/b",), ("x",), ("none",), ("x",)], "package string")
    got = {r.package: (r.root_imports, r.subpath_imports, r.total, r.compliance) for r in text.barrel_discipline(i, p).collect()}
    assert got == {"@a/b": (1, 2, 3, 66.7), "x": (1, 0, 1, 0.0), "none": (0, 0, 0, None)}


def test_chain_ends(spark):
    rng = random.Random(4)
    links = {v: rng.randrange(60) for v in range(40)} | {100: 101, 101: 102, 102: 100, 200: 100}
    want = {}
    for v in links:
        seen, at, n = set(), v, 0
        while at in links and at not in seen:
            seen.add(at)
            at, n = links[at], n + 1
        want[v] = (None, None) if at in seen else (at, n)
    df = spark.createDataFrame([*links.items(), (7, None), (100, 101)], "src bigint, dst bigint")
    assert {r.src: (r.end, r.steps) for r in graph.chain_ends(df).collect()} == want
    assert graph.chain_ends(df.limit(0)).count() == 0


def test_identifier_uses(spark):
    f = spark.createDataFrame([(1, "get(); getUser(); get; forget"), (2, None)], "file_id bigint, text string")
    d = spark.createDataFrame([(1, "get"), (1, "getUser"), (1, "absent"), (2, "x")], "file_id bigint, name string")
    assert {(r.file_id, r.name): r.uses for r in symbols.internal_uses(d, f).collect()} == {(1, "get"): 1, (1, "getUser"): 0, (1, "absent"): 0, (2, "x"): 0}
    assert {(r.file_id, r.name) for r in symbols.semi_dead_imports(d, f).collect()} == {(1, "getUser")}


def test_containing_package(spark):
    f = spark.createDataFrame([("r", p) for p in ("a/b/c.ts", "a/bc/d.ts", "e.ts", "a/x.ts")] + [("s", "a/b/c.ts")], "repo string, path string")
    p = spark.createDataFrame([("r", ""), ("r", "a/b"), ("r", "a"), ("s", "a/b/c")], "repo string, package_dir string")
    got = {(r.repo, r.path): r.package_dir for r in symbols.containing_package(f, p).collect()}
    assert got == {("r", "a/b/c.ts"): "a/b", ("r", "a/bc/d.ts"): "a", ("r", "e.ts"): "", ("r", "a/x.ts"): "a", ("s", "a/b/c.ts"): None}


def test_every_pair_of_a_key_meets_once(spark):
    rows = [("hot", i, i * 10) for i in range(57)] + [("two", 1, 0), ("two", 2, 0), ("one", 1, 0)]
    df = spark.createDataFrame(rows, "key string, id bigint, v bigint")
    n = df.groupBy("key").agg(F.count("*").alias("n"))
    for block in (5, 2000):
        met = pairs.meet(df.join(n, "key"), ["key"], "id", "n", block)
        got = [(r.key, r.l.id, r.r.id) for r in met.collect()]
        assert sorted(got) == sorted([("hot", a, b) for a, b in itertools.combinations(range(57), 2)] + [("two", 1, 2)])
    # no place holds more than the pairs of two blocks
    blocks = -(-57 // 5)
    assert len(got) == 57 * 56 // 2 + 1 and blocks * (blocks + 1) // 2 > 50


def test_near_shapes_with_a_field_in_all_of_them(spark):
    rng = random.Random(9)
    fields = [f"f{i}" for i in range(14)]
    rows = []
    for i in range(90):
        own = sorted({"id", *rng.sample(fields, rng.randrange(0, 6))})
        rows.append((f"x{i:03d}", f"src/{rng.choice('ab')}/m.ts", rng.choice(["UserRecord", "OrderRecord", "TokenState", "X"]), own, ["string"]))
    df = spark.createDataFrame(rows, "identity string, owner_file string, exported_name string, fields array<string>, types array<string>")
    words = {r.identity: set(r.w) for r in df.select("identity", shapes.name_words(F.col("exported_name")).alias("w")).collect()}
    want = {}
    for a, b in itertools.combinations(rows, 2):
        shared, union = set(a[3]) & set(b[3]), set(a[3]) | set(b[3])
        names, same = len(words[a[0]] & words[b[0]]), a[1] == b[1]
        jac = len(shared) / len(union)
        if len(shared) >= 2 and (names or same) and (jac >= 0.5 or (names and jac >= 0.4)):
            want[a[0], b[0]] = len(shared)
    for block in (3, 2000):
        assert {(r.left, r.right): r.shared for r in shapes.near(df, block=block).collect()} == want
    assert len(want) > 50 and shapes.near(df.limit(0)).count() == 0


def test_near_functions_in_blocks(spark):
    rng = random.Random(2)
    vocabulary = [f"loadThing{i}" for i in range(60)]
    rows = []
    for i in range(120):
        calls = rng.sample(vocabulary[:12], 2) + ["sharedToken"] * (i < 5)
        rows.append((f"i{i:03d}", f"load{rng.choice(['Window', 'Queue'])}{rng.choice(['Buffer', 'Digest'])}", 10 + i % 3, 4, i % 3, i % 2 == 0, False, f"f{i}", f"e{i}", f"s{i}", calls))
    rows += [(f"z{i:03d}", "other", 10, 4, 0, True, False, f"g{i}", f"ze{i}", f"zs{i}", [vocabulary[20 + i % 40]]) for i in range(300)]
    df = spark.createDataFrame(rows, "identity string, name string, body_loc bigint, statement_count bigint, param_count bigint, is_async boolean, generated boolean, owner_file string, exact_hash string, structure_hash string, call_tokens array<string>")
    got = [sorted(map(tuple, clones.near_functions(df, block=b).collect())) for b in (4, 2000)]
    assert got[0] == got[1] and len(got[0]) == len({(a, b) for a, b, *_ in got[0]}) > 20


def test_windows_of_texts_keep_properties_and_number_slots(spark):
    body = "export function f(a) {\n  a.size = a.load(b);\n  b.size = c;\n}\n"
    other = body.replace("(a)", "(x)").replace("a.", "x.").replace("b", "y").replace("f(", "g(")
    prop = body.replace(".size", ".count")
    swap = body.replace("b.size = c", "c.size = b")
    df = spark.createDataFrame([(1, body), (2, "const lead = 1;\n" + other), (3, prop), (4, swap), (5, None), (6, "")], "file bigint, text string")
    w = clones.text_windows(df, 20).collect()
    by = {}
    for r in w:
        by.setdefault(r.hash, set()).add(r.file)
    assert {1, 2} in by.values() and not any({1, 3} <= s or {1, 4} <= s for s in by.values())
    assert {(r.line, r.end_line) for r in w if r.file == 1} >= {(0, 2)}


def test_block_clones_in_all_files(spark):
    """A window that is in every file gives one link less than it has occurrences, whatever the chunks."""
    rows = [(f, i, f"t{i}", i) for f in range(120) for i in range(12)]
    df = spark.createDataFrame(rows, "file bigint, pos bigint, value string, line bigint")
    w = clones.token_windows(df, 10)
    for per_chunk in (1, 10_000):
        assert clones.linked_windows(w, 10, per_chunk=per_chunk).count() == 119


def test_store_rules():
    run = lambda *actions: __import__("functools").reduce(lambda e, a: events.advance(e, *a), actions, None)
    add = lambda at, n=None, policy=None: ("append", at, n, policy, None)
    ack = lambda at, source="noted": ("acknowledge", at, None, None, source)
    clean = lambda at: ("cleanup", at, None, None, None)
    e = run(add(1), add(5, 3), ("deliver", 6, None, None, None))
    assert (e["occurrence_count"], e["first_seen"], e["last_seen"], e["delivered_count"], e["next_redeliver_at"]) == (4, 1, 5, 1, 6 + 300_000_000)
    assert run(ack(1)) is None and not run(add(1), ack(2, "tool"))["acknowledged"]
    e = run(add(1), ack(2), add(3, 9))
    assert e["acknowledged"] and e["occurrence_count"] == 1 and e["last_seen"] == 1
    e = run(add(1), clean(2))
    assert e["active"]
    e = run(add(1), ack(2), clean(3), add(4), ack(5))
    assert not e["active"] and e["archived_at"] == 3 and e["first_seen"] == 1
    e = run(add(1, None, "once"), ack(2), clean(3), add(4, 2, "once"))
    assert e["active"] and not e["acknowledged"] and (e["first_seen"], e["occurrence_count"]) == (4, 2)


def test_search_tokens_and_families(spark):
    df = spark.createDataFrame([("fetchCfgPolicies",), ("theUserStatus",), ("add_classes2x",), ("",), (None,), ("getFETCH",)], "name string")
    got = {r.name: (r.t, r.f, r.d) for r in df.select("name", lookups.search_tokens(F.col("name")).alias("t"), lookups.operation_family(F.col("name")).alias("f"), lookups.domain_tokens(F.col("name")).alias("d")).collect()}
    assert got["fetchCfgPolicies"] == (["fetch", "config", "policy"], "read-query", ["config", "policy"])
    assert got["theUserStatus"] == (["user", "status"], None, ["status"])
    assert got["add_classes2x"][0] == ["classes2x"] and got[""] == ([], None, []) and got[None][1] is None
    assert got["getFETCH"] == (["get", "fetch"], "read-query", [])


def test_sibling_cascade(spark):
    rows = [
        ("getUser", None, "a", False, True, True, True), ("getUser", "fetchUser", "a", True, True, True, True), ("getUser", "fetchUser", "a", False, False, True, True), ("getUser", "fetchUser", "a", False, True, False, True),
        ("getUser", "fetchUser", "a", False, True, True, False), ("getUser", "walkUser", "a", False, True, True, True), ("getUser", "fetchOrder", "a", False, True, True, True), ("getUser", "sendUser", "a", False, True, True, True),
        ("sendUser", "emitUser", "a", False, True, True, True), ("getUser", "fetchUsers", "a", False, True, True, True),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, intent string, name string, owner string, ex boolean, ca boolean, su boolean, ne boolean")
    got = [r.s for r in df.orderBy("i").select(lookups.sibling_status(*[F.col(c) for c in ("intent", "name", "owner", "ex", "ca", "su", "ne")]).alias("s")).collect()]
    assert got == ["insufficient-metadata", "policy-excluded", "non-callable-definition", "insufficient-suppressed-support", "locality-mismatch", "unknown-operation", "domain-mismatch", "operation-family-mismatch", "family-not-promotable", "promoted"]


def test_semantic_candidates_need_a_strong_token(spark):
    n = spark.createDataFrame([("userState",), ("loadUserState",), ("dataState",), ("loadOther",), (None,)], "name string")
    i = spark.createDataFrame([("loadUserState",), ("storeState",)], "intent string")
    got = {(r.intent, r.name): r.status for r in lookups.semantic_candidates(n, i).collect()}
    assert got[("loadUserState", "userState")] == "hint" and got[("loadUserState", "dataState")] == "suppressed:weak-tokens-only"
    assert got[("loadUserState", "loadOther")] == "suppressed:single-non-weak-token-only" and got[("storeState", "userState")] == "suppressed:weak-tokens-only"


def test_export_actions(spark):
    rows = [("function", 0, "export function a() {"), ("function", 2, "export function a() {"), ("interface", 0, "export interface A {"), ("class", 0, "export class A extends B {"), ("class", 0, "export class A {"), ("class", 1, "export class A extends B {"), ("variable", 0, "export const a = make();"), ("variable", 0, "export const a = 1;")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, uses bigint, body string")
    got = [r.a for r in df.orderBy("i").select(lookups.export_action(F.col("kind"), F.col("uses"), F.col("body")).alias("a")).collect()]
    value = "delete_value_declaration"
    assert got == [value, "demote_export_declaration", "delete_type_declaration", "none", value, "demote_export_declaration", "none", value]


def test_specifiers(spark):
    rows = [("./b", "src", "src/b.ts", True), ("./b", "src", "src/b/index.ts", True), ("../c", "src/a", "src/c.mts", True), ("./b", "src", "lib/b.ts", True), ("react", "src", "src/react.ts", True), ("@a/b", "src", "x.ts", True), ("@/x", "src", "src/x.ts", True), ("@/x", "src", "src/x.ts", False), ("a/b/c", "src", "x.ts", True), (None, "src", "x.ts", True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, spec string, dir string, file string, same boolean")
    got = [r.m for r in df.orderBy("i").select(lookups.specifier_could_match(*[F.col(c) for c in ("spec", "dir", "file", "same")]).alias("m")).collect()]
    assert got == ["match", "match", "match", "no-match", "no-match", "no-match", "unknown", "no-match", "unknown", "no-match"]


def test_helper_drift(spark):
    old = [("a", "shared-helper"), ("b", "shared-helper"), ("c", "ANY_COLLISION_HELPER"), ("d", "ANY_COLLISION_HELPER"), ("e", "local-name"), ("f", "x")]
    new = [("a", "central-helper"), ("c", "shared-helper"), ("d", "shared-helper"), ("e", "shared-helper"), ("f", "x"), ("g", "y")]
    mk = lambda rows: spark.createDataFrame(rows, "identity string, label string")
    ev = spark.createDataFrame([("c",), ("c",)], "identity string")
    got = {r.identity: r.category for r in lookups.helper_drift(mk(old), mk(new), ev).collect()}
    assert got == {"a": "fan-in-tier-changed", "b": "helper-removed", "c": "contamination-changed", "d": "label-changed", "e": "label-changed", "g": "helper-added"}
    assert {r.category for r in lookups.helper_drift(mk(old), mk(new)).where("identity = 'c'").collect()} == {"label-changed"}


def test_owners_modes_and_namespaces(spark):
    f = spark.createDataFrame([("r", "a/b.ts"), ("r", "x/y.ts"), ("s", "q.ts")], "repo string, path string")
    p = spark.createDataFrame([("r", "a"), ("r", "c/d")], "repo string, package_dir string")
    assert {(r.path, r.package_dir, r.inside) for r in symbols.nearest_owner(f, p).collect()} == {("a/b.ts", "a", True), ("x/y.ts", "a", False), ("q.ts", None, False)}
    m = spark.createDataFrame([("r", "package.json", '{"workspaces": ["p/*"]}'), ("r", "p/a/package.json", "{}"), ("s", "package.json", "{}"), ("t", "package.json", "{"), ("t", "setup.py", ""), ("u", "a.ts", None)], "repo string, path string, text string")
    assert {(r.repo, r.mode, r.language, r.packages) for r in symbols.repo_modes(m).collect()} == {("r", "workspaces", "javascript", 1), ("s", "single-package", "javascript", 0), ("t", "non-node", "python", 0), ("u", "non-node", "unknown", 0)}
    t = "import * as ns from './n';\nns.a(); ns.b.c; other.ns.d; const x = ns;\nnsx.q();"
    n = spark.createDataFrame([(1, t), (2, None), (3, "ns.a")], "file_id bigint, text string")
    assert {(r.member, r.n) for r in symbols.namespace_uses(n).collect()} == {("a", 1), ("b", 1), (None, 1)}


def test_type_texts_and_stable_hashes(spark):
    df = spark.createDataFrame([("Map< string ,\n  'a  b' | number >;",), ("A  extends B ? C : D",), ("",)], "t string")
    assert [r.x for r in df.select(text.type_text(F.col("t")).alias("x")).collect()] == ["Map<string,'a  b'|number>", "A extends B?C:D", ""]
    h = spark.createDataFrame([(1, '{"a": 1, "b": {"d": [1, 2], "c": null}}'), (2, '{"b":{"c":null,"d":[1,2]},"a":1}'), (3, '{"a": 1}'), (4, "{"), (5, None)], "i int, j string")
    got = {r.i: r.hash for r in text.stable_json_hash(h, "j").collect()}
    assert got[1] == got[2] != got[3] and got[4] is got[5] is None


def test_artifacts_are_cached_by_request(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3).toDF("x")

    folder = f"file://{tmp_path}"
    for n, request in enumerate(({"a": 1, "b": [2]}, {"b": [2], "a": 1}, {"a": 2})):
        df, hit = sinks.cached_artifact(spark, folder, request, build)
        assert df.count() == 3 and hit == (n == 1)
    assert len(calls) == 2


def test_review_pack(spark):
    c = spark.createDataFrame([("unused | export", "b.ts", "no use", "medium"), ("dead", "a.ts", None, "high")], "claim string, location string, evidence string, confidence string")
    t = sinks.review_pack("Pack", c, ["no coverage"])
    assert t.index("dead") < t.index("unused") and "unused \\| export" in t and t.endswith("- no coverage")
    assert "none" in sinks.review_pack("Pack", c.limit(0), [])
