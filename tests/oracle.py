"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import os
from collections import Counter


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return str(v.replace(tzinfo=None))
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


def connect(data: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{data}/{f}')")
    return con


def same(df, rel) -> None:
    cols, other = df.columns, [x[0] for x in rel.description]
    assert sorted(cols) == sorted(other)
    order = sorted(cols)
    mine = Counter(tuple(canon(r[c]) for c in order) for r in df.collect())
    theirs = Counter(tuple(canon(r[other.index(c)]) for c in order) for r in rel.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
