from __future__ import annotations

import csv
import io

from factloom.sources import bad_records as br

GOOD = "1,event-stream,complete,,0,-1,5,check,2025-01-02T03:04:05Z,true"


def csv_rows(spark, lines):
    df = spark.createDataFrame([(i, "f", i, x, 1) for i, x in enumerate(lines)], "raw_id bigint, file_name string, line_no bigint, raw_line string, extra int")
    return {r.raw_id: r for r in br.load_csv_records(df).collect()}


def test_reasons(spark):
    cases = {
        GOOD: None,
        GOOD.replace("check", '"a ""b"", c\nd"'): None,
        GOOD.replace("complete,,", '"complete","",'): None,
        GOOD.replace("1,event", "00000000000000000000001,event", 1): None,
        GOOD.replace("check", "ch'eck"): None,
        GOOD.replace("check", '"check'): "quoting",
        GOOD.replace("check", '"check" x'): "quoting",
        GOOD.replace("check", 'che"ck'): "quoting",
        GOOD.replace("check", ' "check"'): "quoting",
        GOOD + ",": "columns",
        "": "columns",
        "1,event-stream": "columns",
        GOOD.replace("complete", "COMPLETE"): "value",
        GOOD.replace("complete", " complete"): "value",
        GOOD.replace("true", "yes"): "value",
        GOOD.replace("-1", "2147483648"): "value",
        GOOD.replace("-1", "-2147483648"): None,
        GOOD.replace("1,event", "-1,event", 1): "value",
        GOOD.replace("1,event", "-0,event", 1): None,
        GOOD.replace("1,event", "9223372036854775808,event", 1): "value",
        GOOD.replace("1,event", "9223372036854775807,event", 1): None,
        GOOD.replace("1,event", "+1,event", 1): "value",
        GOOD.replace("1,event", "0x1,event", 1): "value",
        GOOD.replace("2025-01-02", "2025-02-30"): "value",
        GOOD.replace("2025-01-02", "2024-02-29"): None,
        GOOD.replace("03:04:05", "24:00:00"): "value",
        GOOD.replace("Z", "+00:00"): "value",
        GOOD.replace("5,check", "٥,check"): "value",
    }
    got = csv_rows(spark, list(cases))
    assert {k: got[i].reason for i, k in enumerate(cases)} == cases
    assert got[1].command == 'a "b", c\nd' and got[1].run_id == 1 and got[1].exit_code == -1


def test_nulls_and_empty(spark):
    assert csv_rows(spark, [None])[0].reason == "columns"
    assert csv_rows(spark, []) == {}


def test_bulk_equals_strict(spark):
    lines = ([GOOD] * 40 + [GOOD + ","] + [GOOD.replace("01-02", "02-31")] + [GOOD.replace("check", '"x\ny"')]) * 30
    got = csv_rows(spark, lines)
    assert len(got) == len(lines)
    for i, x in enumerate(lines):
        reason, _, values = br.diagnose(x)
        assert got[i].reason == reason
        if values:
            assert (got[i].command, got[i].elapsed_ms, got[i].clean) == (values[7], values[6], values[9])


def test_split_matches_csv_module():
    for x in (GOOD, 'a,"b,c",', '"a""b",c', ",,", '"",""'):
        assert br.split_record(x) == next(csv.reader(io.StringIO(x), strict=True))


def test_lines(spark):
    text = '{"reason": "a"}\r\n \t\n\n{"x": 1}, {"y": 2}\n{"a": [1\n2]}\n[1]\n{"n": NaN}\n{"ok": 1}\r'
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "\r")]
    df = spark.createDataFrame([(i, t, "complete", 0) for i, t in rows], "run_id bigint, stdout string, stream_parse_status string, invalid_json_line_count bigint")
    rows = br.load_json_lines(df).distinct().collect()
    assert {(r.run_id, r.line_no): r.ok for r in rows} == {(1, 1): True, (1, 4): False, (1, 5): False, (1, 6): False, (1, 7): False, (1, 8): False, (1, 9): True, (4, 1): False}
    raw = spark.createDataFrame([], "raw_id bigint, file_name string, line_no bigint, raw_line string")
    assert br.failing_lines(df, raw).count() == 6
    assert br.run_status(df).where("run_id = 1").first().bad_lines == 5


def test_blocks_do_not_make_up_for_each_other():
    lines = ['{}, 0, {}', '{"a": [1', "2]}", "{}", "{}", "{}"]
    out = [None] * len(lines)
    br._parse_block(lines, 0, len(lines), out)
    assert [x[0] for x in out] == [False, False, False, True, True, True]
