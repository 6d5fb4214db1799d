from __future__ import annotations

import pytest

from factloom.llm import queries as q

from ..oracle import connect, same


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, data, name):
    df = q.QUERIES[name](spark, data)
    if name in q.SQL:
        same(df, connect(data).execute(q.SQL[name]))
    else:
        assert df.count() > 0
