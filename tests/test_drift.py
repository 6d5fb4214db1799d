from __future__ import annotations

import json
from datetime import datetime, timedelta

from factloom.sources import schema_drift as sd

FILES = "artifact_id bigint, feed_id bigint, repo string, producer string, file_name string, schema_version string, written_at timestamp, ingested_at timestamp, payload string, chunk string"
FIELDS = "producer string, field_path string, json_type string, is_optional boolean"
T0 = datetime(2025, 1, 1)


def tables(spark, feeds):
    rows, n = [], 0
    for feed, payloads in feeds.items():
        for k, p in enumerate(payloads):
            n += 1
            row = (n, feed, "r", "p", f"f{n}", "v", T0 + timedelta(minutes=k), T0, p if p is None or isinstance(p, str) else json.dumps(p), "clash")
            rows += [row, row]  # delivered twice
    contract = [("p", "m", "map", False), ("p", "o.note", "string", True), ("p", "a", "number", False)]
    return spark.createDataFrame(rows, FILES), spark.createDataFrame(contract, FIELDS)


def changes(spark, *payloads, chunk=sd.CHUNK):
    f, c = tables(spark, {1: payloads})
    return sorted((r.artifact_id, r.change_kind, r.old_field, r.new_field) for r in sd.schema_changes(f, c, chunk).collect())


def test_kinds(spark):
    got = changes(
        spark,
        {"totalLines": 1, "o": {"x": 1, "note": "n"}, "m": {"k": 1}, "gone": True, "list": [{"z": 1}]},
        {"lineTotal": 2, "o": {"x": "1"}, "m": {"q": "s"}, "new": {"in": {"deep": 1}}, "list": [5]},
    )
    assert got == [(2, "added", "", "new"), (2, "removed", "gone", ""), (2, "renamed", "totalLines", "lineTotal"), (2, "retyped", "o.x", "o.x")]


def test_nulls_keep_the_last_type(spark):
    assert changes(spark, {"a": 1}, {"a": None}, {"a": 2}) == []
    assert changes(spark, {"a": 1}, {"a": None}, {"a": "x"}) == [(3, "retyped", "a", "a")]
    assert changes(spark, {"a": None}, {"a": "x"}) == []
    assert changes(spark, {"o": {"x": 1}}, {"o": None}, {"o": {"x": 2}}) == []


def test_objects_count_once(spark):
    assert changes(spark, {"o": {"x": 1, "y": {"z": 1}}}, {}) == [(2, "removed", "o", "")]
    assert changes(spark, {"s": "t"}, {"s": {"total": 1, "unit": "u"}}) == [(2, "retyped", "s", "s")]


def test_rename_needs_type_parent_and_word(spark):
    assert [c[1] for c in changes(spark, {"maxFixes": 1}, {"max_fix": "1"})] == ["added", "removed"]
    assert [c[1] for c in changes(spark, {"files": 1}, {"o": {"files": 1}})] == ["added", "removed"]
    assert [c[1] for c in changes(spark, {"files": 1}, {"file-count": 1})] == ["renamed"]


def test_odd_files(spark):
    assert changes(spark, {"a": 1}, None, "[1]", "{", {"a": 1, "b": 2}) == [(5, "added", "", "b")]
    assert changes(spark) == []


def test_stretches_give_the_same(spark):
    import random

    rng, feeds = random.Random(3), {}
    for feed in range(6):
        state, out = {"a": 1, "b": "x", "o": {"c": True}}, []
        for k in range(40):
            if rng.random() < 0.3:
                state[f"k{rng.randrange(4)}"] = rng.choice([1, "s", None, [1], {"t": None}])
            if rng.random() < 0.2 and len(state) > 2:
                state.pop(rng.choice(sorted(state)))
            out.append(dict(state))
        feeds[feed] = out
    f, c = tables(spark, feeds)
    one = {tuple(r) for r in sd.schema_changes(f, c).collect()}
    many = {tuple(r) for r in sd.schema_changes(f, c, chunk=7).collect()}
    assert one == many and len(one) > 20


def test_null_objects_across_stretches(spark):
    x, null = {"a": {"x": 1}}, {"a": None}
    feed = [x, x, null, null, null, null, x, x]
    assert changes(spark, *feed) == changes(spark, *feed, chunk=2) == []
    early = [dict(x, n=k) for k in range(3)]
    f, c = tables(spark, {1: early})
    late = f.withColumn("written_at", f["written_at"] + __import__("pyspark").sql.functions.expr("INTERVAL 900 DAY")).withColumn("artifact_id", f["artifact_id"] + 100)
    assert sd.schema_changes(f.unionByName(late), c, chunk=2).count() == 0


def test_end_states_follow_the_state_before():
    """Folding stretches from their carried states gives what one fold over the feed gives, or the stretch says that it depends."""
    import random

    rng, checked, depends = random.Random(11), 0, 0
    names = ["a", "b", "total_a", "aTotal", "o"]

    def value(depth=0):
        return rng.choice([1, "s", None, None, [1], {k: value(depth + 1) for k in rng.sample(["x", "y", "x_y"], rng.randrange(3))} if depth < 2 else 2])

    for _ in range(1500):
        feed, state = [], {n: value() for n in rng.sample(names, 3)}
        for _ in range(9):
            for n in names:
                if rng.random() < 0.3:
                    state[n] = value()
                elif rng.random() < 0.15:
                    state.pop(n, None)
            feed.append(sd.header_of(json.dumps(state), frozenset()))
        opt, whole, st = frozenset(), [], None
        for h in feed:
            out, st = sd.step(st, h, opt)
            whole.append(out)
        for size in range(1, 8):
            before, got, ok = None, [], True
            for lo in range(0, len(feed), size):
                carry, end = before, None
                for h in feed[lo : lo + size]:
                    ok = ok and (end is None or not sd.is_open(end, h))
                    out, carry = sd.step(carry, h, opt)
                    got.append(out)
                    _, end = sd.step(end, h, opt)
                before = sd.follow(before, feed[lo], end, opt)
            depends += not ok
            if ok:
                checked += 1
                assert got == whole, (feed, size)
    assert checked > 3000 and depends > 100


def test_union_table(spark):
    f, c = tables(spark, {1: [{"a": 1, "s": 1, "o": {"x": True}}, {"a": 2.5, "s": "t", "n": None}]})
    t = sd.consistent_table(f, c, "p").orderBy("artifact_id")
    assert t.columns[6:] == ["a", "n", "o__x", "s"]
    assert [tuple(r[6:]) for r in t.collect()] == [(1.0, None, True, "1"), (2.5, None, None, "t")]
    assert sd.promote(frozenset({"null", "number"})) == "number" and sd.promote(frozenset({"object", "number"})) == "string"
