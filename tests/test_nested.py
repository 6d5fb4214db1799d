from __future__ import annotations

import json

from factloom.functions.strict_json import _deep, loads
from factloom.operators import flatten

SCHEMA = "message_id bigint, payload string, node_path string"


def nodes(spark, rows):
    df = spark.createDataFrame([(i, p, "clash") for i, p in rows], SCHEMA)
    return {(r.message_id, r.node_path, r.parent_path) for r in flatten.flatten_messages(df).collect()}


def test_paths(spark):
    span = {"byte_start": 1, "text": [{"text": "x"}, None, 3], "expansion": {"span": {"expansion": None}, "def_site_span": {}, "other": {}}}
    p = json.dumps({"reason": "m", "target": {"a": {}}, "message": {"code": {"code": "E"}, "spans": [None, span], "children": [{"children": [], "spans": ""}]}})
    got = nodes(spark, [(1, p), (1, p)])
    m = "message"
    want = [(m, ""), (f"{m}.spans[1]", m), (f"{m}.spans[1].text[0]", f"{m}.spans[1]"), (f"{m}.spans[1].text[2]", f"{m}.spans[1]"), (f"{m}.spans[1].expansion", f"{m}.spans[1]")]
    want += [(f"{m}.spans[1].expansion.span", f"{m}.spans[1].expansion"), (f"{m}.spans[1].expansion.def_site_span", f"{m}.spans[1].expansion"), (f"{m}.children[0]", m)]
    assert got == {(1, a, b) for a, b in want}


def test_odd_payloads(spark):
    assert nodes(spark, [(1, None), (2, ""), (3, "{"), (4, "[]"), (5, '{"message": "text"}'), (6, '{"message": null}')]) == set()
    assert nodes(spark, []) == set()


def test_deep_nesting(spark):
    depth = 3000
    p = '{"message": ' + '{"children": [' * depth + "{}" + "]}" * depth + "}"
    assert len(nodes(spark, [(7, p)])) == depth + 1


def test_round_trip(spark):
    """The tables hold all scalars: the records can be put together again."""
    msg = {"message": "m", "level": "error", "spans": [{"file_name": "a", "byte_start": 1, "byte_end": 2, "is_primary": True}], "children": [{"message": "c", "level": "note"}]}
    df = spark.createDataFrame([(1, json.dumps({"message": msg}))], "message_id bigint, payload string")
    t = flatten.flatten_messages(df)
    d = {r.node_path: r for r in flatten.typed_table(t, "diagnostic").collect()}
    s = flatten.typed_table(t, "span").collect()
    assert (d["message"].message, d["message.children[0]"].level) == ("m", "note")
    assert [(x.parent_path, x.byte_end, x.is_primary) for x in s] == [("message", 2, True)]


def test_tables_are_written_by_tag(spark, tmp_path):
    rows = [(i, json.dumps({"message": {"message": f"m{i}", "spans": [{"file_name": "a", "text": [{"text": "t"}]}], "children": [{"message": "c"}]}})) for i in range(20)]
    t = flatten.flatten_messages(spark.createDataFrame(rows, "message_id bigint, payload string"))
    path = f"file://{tmp_path}/tables"
    back = flatten.write_tables(t, path)
    assert {p.name for p in (tmp_path / "tables").iterdir() if p.is_dir()} == {f"tag={x}" for x in ("diagnostic", "span", "text")}
    for tag in flatten.SCHEMAS:
        assert sorted(map(str, flatten.typed_table(back, tag).collect())) == sorted(map(str, flatten.typed_table(t, tag).collect()))
    plan = flatten.typed_table(back, "span")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tag" in plan and "MapInArrow" not in plan


def test_strict_json():
    for text in ('{"a": [1, 2.5e3, -0, "x\\u00e9", null, true]}', "[]", '"s"', " 1 "):
        assert loads(text) == json.loads(text) == _deep(text)
    for text in ("", "{", "[1,]", "{'a': 1}", "NaN", '{"a": 1} x', '"\t"', "01", "+1", ".5", '{"a" 1}', "﻿{}", '"\\x"', "[1 2]", '{"a":}'):
        for f in (loads, _deep):
            try:
                f(text)
            except ValueError:
                continue
            raise AssertionError((f, text))
