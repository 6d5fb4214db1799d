"""Every core query runs; those with SQL agree with it."""

from __future__ import annotations

from collections import Counter

import pytest

from factloom.plans import registry

from .oracle import connect, same


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    if name in registry.SQL:
        same(df, connect(data).execute(registry.SQL[name]))
    else:
        rows = df.collect()
        assert len(df.columns) == len(set(df.columns)) and (rows or name in EMPTY)
        check = CHECKS.get(name)
        assert check is None or check(spark, data, rows)


def _planned(spark, data, rows):
    """Every plan once, and no more of them observed than there are occurrences of their kind."""
    n = {r[0]: r[1] for r in connect(data).execute("SELECT diagnostic_code, count(DISTINCT finding_id) FROM semantic_findings WHERE source_file_id IS NOT NULL GROUP BY 1").fetchall()}
    taken = Counter(r.kind for r in rows if r.label == "planned")
    return len({r.plan_id for r in rows}) == len(rows) and all(taken[k] == min(n.get(k, 0), taken[k]) for k in taken) and all(taken[k] >= min(1, n.get(k, 0)) for k in {r.kind for r in rows})


def _overlaps(spark, data, rows):
    spans = registry.QUERIES["p2_spans"](spark, data).where("byte_start IS NOT NULL AND byte_end IS NOT NULL AND file_name IS NOT NULL").collect()
    key = lambda s: f"{s.message_id}@{s.node_path}"
    want = {(key(a), key(b)) for a in spans if a.is_primary for b in spans if b.is_primary is False and a.file_name == b.file_name and a.byte_start <= b.byte_end and b.byte_start <= a.byte_end}
    return {(r.a_id, r.b_id) for r in rows} == want


def _unions(producer):
    """Every file of the producer that has a payload object, once, with the values of the fields that all its files have."""

    def check(spark, data, rows):
        want = connect(data).execute(f"SELECT count(DISTINCT artifact_id) FROM artifact_files WHERE producer = '{producer}' AND payload IS NOT NULL").fetchone()[0]
        return len(rows) == want and len({r.artifact_id for r in rows}) == want

    return check


def _diagnostics(spark, data, rows):
    n = connect(data).execute(f"SELECT count(*) FROM ({registry.SQL['p2_found']})").fetchone()[0]
    others = sum(connect(data).execute(f"SELECT count(*) FROM ({registry.SQL[f'p2_{t}s']})").fetchone()[0] for t in ("span", "text", "expansion"))
    return len(rows) == n - others and all((r.parent_path == "") == (r.node_path == "message") for r in rows)


#: no namespace import is in the tables (see test_rules), and no overlap in the smallest
EMPTY = ("namespace_uses", "span_overlap")
CHECKS = {
    "planned_matching": _planned,
    "span_overlap": _overlaps,
    "p2_diagnostics": _diagnostics,
    "p4_discipline": _unions("discipline"),
    "p4_rust_health": _unions("rust-health"),
    "p4_rank_fixes": _unions("rank-fixes"),
}


def test_entry(spark, data):
    import __spark_entry__ as e

    assert 0 < e.entry(spark).count() <= 15
    assert set(e.oracle_sql()) <= set(e.queries())
