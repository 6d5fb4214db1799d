"""One text in, one verdict out."""

from __future__ import annotations

from dataclasses import dataclass

from .engine import COLUMNS, EOF, ERR, MARK
from .grammars import grammar
from .lexers import lex_go, lex_js, lex_json, lex_python, lex_rust

LEXERS = {"ts": lex_js, "js": lex_js, "py": lex_python, "rs": lex_rust, "go": lex_go, "json": lex_json}
#: file extension -> language of the grammar
EXTENSIONS = {"ts": "ts", "js": "js", "mjs": "js", "rs": "rs", "py": "py", "go": "go", "json": "json"}


@dataclass(frozen=True)
class Verdict:
    """cost: edits of the cheapest repair found (0: valid); exact: proven least; kind: truncation, conflict, mismatch or
    local; offset: character offset of the first edit (-1 if valid)."""

    cost: int
    exact: bool
    kind: str
    offset: int


def check(text: str, language: str, pairs: int | None = 12_000, max_cost: int = 12, beam: int = 300, sure: bool = True) -> Verdict:
    """The bounds limit the search for the cheapest repair (see Grammar.repair), never whether a file is found invalid. Where it ends
    unproven and the kind depends on it, the question is settled without them (see Grammar.within), unless sure is false.

    A truncation goes on up to the last token, or some cheapest repair begins there; a mismatch takes more than max_cost edits, or more
    than one where the head breaks."""
    names, gaps, starts = LEXERS[language](text)
    g = grammar(language)
    if len(g.items) > COLUMNS:
        g.forget()
    kinds = [g.kinds.get(k, ERR) for k in names]
    kinds.append(EOF)
    # no grammar has conflict markers, so a text with markers is invalid; they cost one edit each
    if MARK not in kinds and g.chart(kinds, gaps)[0]:
        return Verdict(0, True, "", -1)
    marks = [i for i, k in enumerate(kinds) if k == MARK]
    for i in marks:
        gaps[i + 1] = True  # a marker is a line of its own
    cost, least, edits = g.repair(kinds, gaps, pairs, max_cost, beam)
    n = len(kinds) - 1
    far = g.chart(kinds, gaps)[1]
    first = min((p for _, p in edits), default=n)

    def fits(most: int) -> bool:
        """Whether at most so many edits repair the text."""
        nonlocal cost, least, first
        if sure and least <= most < cost:
            found = g.within(kinds, gaps, most)
            least = max(least, found)
            if found <= most:  # the latest place where a repair that cheap begins
                cost, lo, hi = found, 0, far
                while lo < hi:
                    mid = (lo + hi + 1) // 2
                    lo, hi = (mid, hi) if g.within(kinds, gaps, cost, mid) <= cost else (lo, mid - 1)
                first = lo
        return cost <= most

    def ends_here() -> bool:
        """Whether some cheapest repair begins at the last token."""
        nonlocal cost, least, first
        if not sure or far < n - 1:
            return first >= n - 1
        tail = g.within(kinds, gaps, cost, n - 1)
        if tail > cost or fits(tail - 1):
            return False
        cost, least, first = tail, max(least, tail), max(first, n - 1)
        return True

    if marks:
        kind = "conflict"
    elif far == n or ends_here():  # what is there could go on
        kind = "truncation"
    elif far <= 6 and n > 2 * far and not fits(1) or not fits(max_cost):
        kind = "mismatch"
    else:
        kind = "local"
    return Verdict(cost, cost == least, kind, starts[first] if first < n else len(text))
