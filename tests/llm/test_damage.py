"""Kinds of damage do not hang on the bounds of the repair search."""

from __future__ import annotations

import random

import pytest

from factloom.llm import parse_errors
from factloom.llm.syntax.check import LEXERS, check
from factloom.llm.syntax.grammars import grammar

from .test_parse_errors import ALPHABETS, VALID

PY = "def f(a):\n    if a:\n        return [a, 1]\n    return g(a)\n"
#: brackets left open swallow the lines behind them: 11 and 12 edits, of which the bounded search finds 19 and 26
OPEN = (PY.replace("g(a)", "g(a") * 2 + PY * 2, PY.replace("1]", "1") * 2 + PY * 2)


def test_kinds_are_settled_where_the_search_ends_unproven():
    for text, cost in zip(OPEN, (11, 12)):
        assert check(text, "py", sure=False).cost > 12
        for bounds in ((12_000, 12, 300), (0, 12, 1), (500, 12, 20)):
            v = check(text, "py", *bounds)
            assert (v.cost, v.exact, v.kind) == (cost, True, "local"), (bounds, v)
        assert check(text, "py", max_cost=cost - 1).kind == "mismatch"


def test_rates_count_settled_kinds(spark):
    df = spark.createDataFrame([(i, "r", "a.py", t) for i, t in enumerate(OPEN)], "source_file_id bigint, repo string, file string, text string")
    (row,) = [r for r in parse_errors.invalid_rates(df).collect() if r.grouped_by == "repo"]
    assert (row.invalid, row.local, row.mismatch) == (2, 2, 0)


@pytest.mark.parametrize("language", sorted(ALPHABETS))
def test_kinds_are_the_same_under_all_bounds(language):
    rng = random.Random(11)
    texts = [t for t in VALID[language] if 5 < len(t) < 60]
    for _ in range(25):
        text = rng.choice(texts)
        for _ in range(rng.randrange(1, 4)):
            i = rng.randrange(len(text))
            text = text[:i] + rng.choice(["", "(", "}", " x ", ";", "=", '"']) + text[i + 1 :]
        assert len({check(text, language, *b).kind for b in ((12_000, 12, 300), (0, 12, 1))}) == 1, text


@pytest.mark.parametrize("language", sorted(ALPHABETS))
def test_levels_agree_with_the_search_without_bounds(language):
    g, rng = grammar(language), random.Random(7)
    texts = [t for t in VALID[language] if 5 < len(t) < 60]
    for _ in range(25):
        names, gaps, _ = LEXERS[language](rng.choice(texts))
        kinds = [g.kinds[k] for k in names]
        for _ in range(rng.randrange(1, 4)):
            i = rng.randrange(len(kinds))
            if rng.random() < 0.5 and len(kinds) > 1:
                del kinds[i], gaps[i]
            else:
                kinds.insert(i, rng.choice([k for k in g.kinds.values() if k > 2]))
                gaps.insert(i, False)
        kinds.append(0)
        cost, least, _ = g.repair(kinds, gaps, None)
        assert cost == least == g.within(kinds, gaps, cost + 1), kinds
        if cost:
            assert g.within(kinds, gaps, cost - 1) == cost, kinds
        far = g.chart(kinds, gaps)[1]
        costs = [g.within(kinds, gaps, cost + 2, f) for f in range(min(far, len(kinds) - 1) + 1)]
        assert costs == sorted(costs) and costs[0] == cost, kinds


def test_a_cheapest_repair_at_the_last_token_is_a_truncation():
    assert check('f(a, "b', "js").kind == check("f(a, b", "js").kind == "truncation"
    assert check("x y", "js").kind == "truncation"  # deleting the last token is as cheap as anything
    assert check("x y; z;", "js").kind == "local"
