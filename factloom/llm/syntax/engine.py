"""Error-correcting chart parsing over recursive transition networks.

A grammar is a set of rules in extended BNF. Every rule compiles to a least deterministic automaton whose arcs are terminals or
calls of other rules; no rule may be empty or begin with itself. The chart holds items (state, call node): the node is shared by
all callers of a rule at one position, so ambiguity and recursion cost polynomial work.

Nodes are kept once by what they are, a rule and where it returns to, and not by where they lie. So the set of items after a
prefix, a column of the chart, is a number too, and the step from a column by a token is made once and looked up afterwards, in
other places and other texts. Columns that are equal are one, which makes the search for a repair a search for the cheapest path
through pairs (position, column): a token that is there costs nothing, inserting, deleting or replacing one costs an edit. Level 0
of that search is the plain chart; level c+1 is reached from level c by one edit. A file of cost 0 is valid; any other is not,
and its edits say where and how it breaks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

#: columns a worker keeps; beyond that it forgets all of them between two texts
COLUMNS = 60_000
EOF, ERR, MARK = 0, 1, 2
FEW = 3

_PIECE = re.compile(r"\s+|'[^']+'|[A-Za-z_][A-Za-z_0-9]*|[|()*+?]")


@dataclass
class Grammar:
    """rules: name -> EBNF text; terminals are quoted or in capitals; macros are expanded as text before parsing.
    "ASI" is an empty match that the lexer allows before certain tokens."""

    rules: dict[str, str]
    macros: dict[str, str] = field(default_factory=dict)
    start: str = "file"

    def __post_init__(self) -> None:
        self.kinds: dict[str, int] = {"EOF": 0, "ERR": 1, "MARK": 2}
        self.ids = {name: i for i, name in enumerate(self.rules)}
        self.t_arcs: list[dict[int, int]] = []
        self.r_arcs: list[dict[int, int]] = []
        self.asi: list[int] = []
        self.final: list[bool] = []
        self.rule_of: list[int] = []
        self.first_state: list[int] = []
        for name, text in self.rules.items():
            self._compile(name, text)
        self._tables()
        self.forget()

    # -- EBNF to automata ----------------------------------------------------------------------------------------------
    def _compile(self, name: str, text: str) -> None:
        for _ in range(4):
            text = re.sub(r"'[^']+'|\b[A-Z][A-Z_0-9]*\b", lambda m: f"({self.macros[m[0]]})" if m[0] in self.macros else m[0], text)
        pieces = [p for p in _PIECE.findall(text) if p.strip()]
        if "".join(pieces) != re.sub(r"\s+", "", text):
            raise ValueError(f"bad rule {name}: {text}")
        arcs: list[list[tuple[object, int]]] = []

        def new() -> int:
            arcs.append([])
            return len(arcs) - 1

        pos = 0

        def alt() -> tuple[int, int]:
            nonlocal pos
            a, z = new(), new()
            while True:
                s, e = seq()
                arcs[a].append((None, s))
                arcs[e].append((None, z))
                if pos < len(pieces) and pieces[pos] == "|":
                    pos += 1
                    continue
                return a, z

        def seq() -> tuple[int, int]:
            nonlocal pos
            a = z = new()
            while pos < len(pieces) and pieces[pos] not in "|)":
                s, e = atom()
                arcs[z].append((None, s))
                z = e
            return a, z

        def atom() -> tuple[int, int]:
            nonlocal pos
            p = pieces[pos]
            pos += 1
            if p == "(":
                s, e = alt()
                if pieces[pos] != ")":
                    raise ValueError(f"unbalanced rule {name}")
                pos += 1
            else:
                s, e = new(), new()
                arcs[s].append((p, e))
            while pos < len(pieces) and pieces[pos] in "*+?":
                op = pieces[pos]
                pos += 1
                a, z = new(), new()
                arcs[a].append((None, s))
                arcs[e].append((None, z))
                if op in "*+":
                    arcs[e].append((None, s))
                if op in "*?":
                    arcs[a].append((None, z))
                s, e = a, z
            return s, e

        start, end = alt()
        if pos != len(pieces):
            raise ValueError(f"rule {name} ends early")

        def closure(states: set[int]) -> frozenset[int]:
            todo, out = list(states), set(states)
            while todo:
                for label, to in arcs[todo.pop()]:
                    if label is None and to not in out:
                        out.add(to)
                        todo.append(to)
            return frozenset(out)

        first = closure({start})
        known, todo, moves = {first: 0}, [first], {}
        while todo:
            here = todo.pop()
            to: dict[object, set[int]] = {}
            for s in here:
                for label, t in arcs[s]:
                    if label is not None:
                        to.setdefault(label, set()).add(t)
            for label, target in to.items():
                target = closure(target)
                if target not in known:
                    known[target] = len(known)
                    todo.append(target)
                moves.setdefault(known[here], {})[label] = known[target]
        # states that nothing tells apart are one
        block = [int(end in states) for states in known]
        while True:
            looks = [(block[i], frozenset((label, block[t]) for label, t in moves.get(i, {}).items())) for i in range(len(block))]
            number = {look: k for k, look in enumerate(dict.fromkeys(looks))}
            finer = [number[look] for look in looks]
            if len(number) == len(set(block)):
                break
            block = finer
        made: dict[int, int] = {}
        for i, states in enumerate(known):
            if block[i] not in made:
                made[block[i]] = self._state(name, end in states)
        self.first_state.append(made[block[0]])
        for i, own in moves.items():
            s = made[block[i]]
            for label, t in sorted(own.items()):
                t = made[block[t]]
                if label == "ASI":
                    self.asi[s] = t
                elif label[0] == "'" or label.isupper():
                    self.t_arcs[s][self.kinds.setdefault(label.strip("'"), len(self.kinds))] = t
                else:
                    self.r_arcs[s][self.ids[label]] = t

    def _state(self, name: str, final: bool) -> int:
        self.t_arcs.append({})
        self.r_arcs.append({})
        self.asi.append(-1)
        self.final.append(final)
        self.rule_of.append(self.ids[name])
        return len(self.final) - 1

    # -- FIRST, FOLLOW, least insertions ---------------------------------------------------------------------------------
    def _tables(self) -> None:
        n, states = len(self.rules), range(len(self.final))
        names = list(self.rules)
        for r in range(n):
            if self.final[self.first_state[r]] or self.asi[self.first_state[r]] >= 0:
                raise ValueError(f"rule {names[r]} may be empty")
            below, todo = set(), [r]
            while todo:
                new = set(self.r_arcs[self.first_state[todo.pop()]]) - below
                below |= new
                todo.extend(new)
            if r in below:
                raise ValueError(f"rule {names[r]} begins with itself")
        first: list[set[int]] = [set() for _ in range(n)]
        changed = True
        while changed:
            changed = False
            for r in range(n):
                s = self.first_state[r]
                new = set(self.t_arcs[s]).union(*(first[c] for c in self.r_arcs[s])) if self.r_arcs[s] else set(self.t_arcs[s])
                if new - first[r]:
                    first[r] |= new
                    changed = True
        follow: list[set[int]] = [set() for _ in range(n)]
        changed = True
        while changed:
            changed = False
            for s in states:
                for r, t in self.r_arcs[s].items():
                    new, todo = set(), [t]
                    while todo:
                        x = todo.pop()
                        new |= set(self.t_arcs[x])
                        for c in self.r_arcs[x]:
                            new |= first[c]
                        if self.asi[x] >= 0:
                            todo.append(self.asi[x])
                        if self.final[x]:
                            new |= follow[self.rule_of[x]]
                    if new - follow[r]:
                        follow[r] |= new
                        changed = True
        self.follow = [frozenset(f) for f in follow]
        # table[state][kind]: (shift target or -1, tuple of (rule, return state))
        self.table: list[dict[int, tuple[int, tuple]]] = []
        for s in states:
            kinds = set(self.t_arcs[s]).union(*(first[c] for c in self.r_arcs[s]))
            self.table.append({k: (self.t_arcs[s].get(k, -1), tuple((c, t) for c, t in self.r_arcs[s].items() if k in first[c])) for k in kinds})
        # least number of insertions from a state to the end of its rule
        big = 10**6
        least = [0 if self.final[s] else big for s in states]
        changed = True
        while changed:
            changed = False
            for s in states:
                c = least[s]
                for t in self.t_arcs[s].values():
                    c = min(c, 1 + least[t])
                for r, t in self.r_arcs[s].items():
                    c = min(c, least[self.first_state[r]] + least[t])
                if self.asi[s] >= 0:
                    c = min(c, 1 + least[self.asi[s]])
                if c < least[s]:
                    least[s] = c
                    changed = True
        self.least = least
        #: tails[gap][state]: the state, and where a gap lets statements end those after the end
        self.tails: list[list[tuple[int, ...]]] = [[(s,) for s in states], []]
        for s in states:
            chain = [s]
            while (t := self.asi[chain[-1]]) >= 0 and t not in chain:
                chain.append(t)
            self.tails[1].append(tuple(chain))

    # -- columns ---------------------------------------------------------------------------------------------------------
    def forget(self) -> None:
        """Drop all nodes and columns; numbers of columns do not outlive this."""
        #: links of every node, the least insertions that complete the input behind it, and its number by rule and links. Node 0 is
        #: the file; nodes 1 and up are the rules where nothing is known of their callers
        callers: list[list[tuple[int, int]]] = [[] for _ in self.rules]
        for s, calls in enumerate(self.r_arcs):
            for r, back in calls.items():
                callers[r].append((back, 1 + self.rule_of[s]))
        self.links: list[tuple[tuple[int, int], ...]] = [(), *map(tuple, callers)]
        self.behind: list[int] = [0] * len(self.links)
        self.node_ids: dict[tuple, int] = {}
        self.items: list[tuple[tuple[int, int], ...]] = []
        #: steps[column][2 * token + gap] -> column, or -1
        self.steps: list[dict[int, int]] = []
        self.after: list[tuple[int, ...] | None] = []
        self.column_ids: dict[frozenset, int] = {}
        self.completed: dict[tuple[int, int], dict] = {}
        self.shifts: dict[tuple[int, frozenset], int] = {}
        self.start_column = self._column([(self.first_state[self.ids[self.start]], 0)])
        self.anywhere = self._column([(s, 1 + r) for s, r in enumerate(self.rule_of)])

    def _column(self, items) -> int:
        key = frozenset(items)
        c = self.column_ids.get(key)
        if c is None:
            self.column_ids[key] = c = len(self.items)
            self.items.append(tuple(key))
            self.steps.append({})
            self.after.append(None)
        return c

    def _node(self, rule: int, calls: dict[int, set], made: dict[int, int]) -> int:
        """Number of the node of a rule called here; calls holds the nodes of this position by rule, as negative numbers."""
        nd = made.get(rule)
        if nd is None:
            links = frozenset((back, self._node(-1 - up, calls, made) if up < 0 else up) for back, up in calls[rule])
            nd = self.node_ids.get((rule, links))
            if nd is None:
                self.node_ids[rule, links] = nd = len(self.links)
                self.links.append(tuple(links))
                self.behind.append(min(self.least[back] + self.behind[up] for back, up in links))
            made[rule] = nd
        return nd

    def _completed(self, nd: int, key: int) -> dict[tuple[int, int], None]:
        """The items that go on with a token (2 * kind + gap) once a node is complete, and those after completions that follow from it."""
        got = self.completed.get((nd, key))
        if got is None:
            table, final, rule_of, follow, tails, tok, gap = self.table, self.final, self.rule_of, self.follow, self.tails[key & 1], key >> 1, key & 1
            got, todo, met = {}, [nd], {nd}
            while todo:
                for back, up in self.links[todo.pop()]:
                    for s in tails[back]:
                        if tok in table[s]:
                            got[s, up] = None
                        if final[s] and up not in met and (gap or tok in follow[rule_of[s]]):
                            met.add(up)
                            known = self.completed.get((up, key))
                            if known is not None:
                                got.update(known)
                            elif up:
                                todo.append(up)
            self.completed[nd, key] = got
        return got

    def step(self, column: int, key: int) -> int:
        """The column after a token (2 * kind + gap), or -1 if the token fits nowhere."""
        table, final, rule_of, follow, tails, tok, gap = self.table, self.final, self.rule_of, self.follow, self.tails[key & 1], key >> 1, key & 1
        alive: dict[tuple[int, int], None] = {}
        for start, nd in self.items[column]:
            for s in tails[start]:
                if tok in table[s]:
                    alive[s, nd] = None
                if final[s] and nd and (gap or tok in follow[rule_of[s]]):
                    alive.update(self._completed(nd, key))
        if not alive:
            self.steps[column][key] = -1
            return -1
        # what a token does depends on the items that go on with it only
        own_key = (tok, frozenset(alive))
        to = self.shifts.get(own_key)
        if to is None:
            stack, calls, out = list(alive), {}, []
            while stack:
                s, nd = stack.pop()
                shift, called = table[s][tok]
                if shift >= 0:
                    out.append((shift, nd))
                for rule, back in called:
                    own = calls.get(rule)
                    if own is None:
                        calls[rule] = own = set()
                        stack.append((self.first_state[rule], -1 - rule))
                    own.add((back, nd))
            made: dict[int, int] = {}
            self.shifts[own_key] = to = self._column([(s, self._node(-1 - nd, calls, made) if nd < 0 else nd) for s, nd in out])
        self.steps[column][key] = to
        return to

    def successors(self, column: int) -> tuple[int, ...]:
        """The columns that some token inserted here leads to, each once."""
        got = self.after[column]
        if got is not None:
            return got
        stack = list(self.items[column])
        here, calls, out = set(stack), {}, {}
        while stack:
            s, nd = stack.pop()
            for tok, t in self.t_arcs[s].items():
                out.setdefault(tok, []).append((t, nd))
            for rule, back in self.r_arcs[s].items():
                own = calls.get(rule)
                if own is None:
                    calls[rule] = own = set()
                    stack.append((self.first_state[rule], -1 - rule))
                own.add((back, nd))
            if self.final[s] and nd > 0:
                for link in self.links[nd]:
                    if link not in here:
                        here.add(link)
                        stack.append(link)
        # a rule has the same callers whether or not items that the token cannot follow are left out, so these are the columns of step()
        out.pop(EOF, None)
        alike: dict[tuple, list[int]] = {}
        for tok, items in out.items():
            alike.setdefault(tuple(items), []).append(tok)
        steps, made, columns = self.steps[column], {}, {}
        for items, toks in alike.items():
            to = self._column([(s, self._node(-1 - nd, calls, made) if nd < 0 else nd) for s, nd in items])
            columns[to] = None
            for tok in toks:
                steps[2 * tok] = to
        self.after[column] = got = tuple(columns)
        return got

    def finish(self, column: int) -> int:
        """Least insertions that complete the whole input from a column; the end token counts as present."""
        return max(0, min(self.least[s] + self.behind[nd] for s, nd in self.items[column]) - 1)

    # -- level 0: the plain chart ---------------------------------------------------------------------------------------
    def chart(self, kinds: list[int], gaps: list[bool]) -> tuple[bool, int]:
        """kinds ends with EOF. Whether the tokens parse, and the furthest position reached."""
        steps, column, step = self.steps, self.start_column, self.step
        for pos, key in enumerate([2 * k + g for k, g in zip(kinds, gaps)]):
            to = steps[column].get(key)
            if to is None:
                to = step(column, key)
            if to < 0:
                return False, pos
            column = to
        return True, len(kinds)

    # -- levels above 0 -------------------------------------------------------------------------------------------------
    def bounds(self, kinds: list[int], keys: list[int]) -> list[int]:
        """bounds[i]: a number of edits that the tokens from i on need at least, whatever lies before them.

        Tokens i to j that are part of no text of the language, whatever surrounds them, need an edit among them. Such stretches,
        one behind the other, need one each. A marker separates, for it may become anything."""
        n, steps, step = len(kinds) - 1, self.steps, self.step

        def dies(i: int, stop: int) -> int:
            column = self.anywhere
            for pos in range(i, stop + 1):
                to = steps[column].get(keys[pos])
                if to is None:
                    to = step(column, keys[pos])
                if to < 0:
                    return pos
                column = to
            return stop + 1

        ends: list[tuple[int, int, int]] = []  # (last start, end, edits) of the stretches, shortest first
        i = 0
        while i <= n:
            j = dies(i, n)
            if j > n:
                break
            lo, hi = i, j
            if kinds[j] == MARK:
                lo = j
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if dies(mid, j) == j:
                    lo = mid
                else:
                    hi = mid - 1
            ends.append((lo, j, int(kinds[j] != MARK)))
            i = lo + 1
        out = [0] * (n + 2)
        for k in range(len(ends) - 1, -1, -1):
            lo, j, edits = ends[k]
            for i in range(lo, ends[k - 1][0] if k else -1, -1):
                out[i] = edits + out[j + 1]
        return out

    def repair(self, kinds: list[int], gaps: list[bool], pairs: int | None = 12_000, max_cost: int = 12, beam: int = 300) -> tuple[int, int, tuple]:
        """Cheapest repair: (cost, proven least cost, edits (kind, position) in order). kinds ends with EOF.

        A marker (MARK) fits nowhere and costs one edit in any repair; it may be deleted or replaced, and is counted once.
        Pairs (position, column) are visited in order of the least cost a repair through them can have: the edits made and the bound
        of what is left. So the first repair is the cheapest. After about `pairs` of them (a quarter where at least FEW edits are needed
        for sure; None: no bound) the search goes on in a narrow way (see `_narrow`), and the cost may be more than the proven least.
        """
        n = len(kinds) - 1
        keys = [2 * k + g for k, g in zip(kinds, gaps)]
        marks = kinds.count(MARK)
        rest = self.bounds(kinds, keys)
        steps, step, successors = self.steps, self.step, self.successors
        seen: list[dict[int, int]] = [{} for _ in range(n + 2)]
        best, plan, made = 10**9, (), 0
        least = rest[0]
        if pairs is not None and least > FEW:  # far from anything valid: more edits than pairs can tell apart
            pairs = pairs // 4 if least <= max_cost else 0
        # open pairs by edits and position; pairs whose edits cost more than the present least; both with the trace of their edits
        open_: dict[int, dict[int, dict]] = defaultdict(lambda: defaultdict(dict))
        open_[0][0][self.start_column] = None
        late: list[tuple[int, int, dict, bool, bool]] = []
        while True:
            again, late = late, []
            todo: list[tuple[int, int, dict, bool, bool]] = again
            cost = 0
            while True:
                for c, pos, here, insert, change in todo:
                    # edits that fit under the present least; the others wait
                    now_insert, now_change = insert and c + 1 + rest[pos] <= least, change and c + 1 + rest[pos + 1] <= least
                    if insert > now_insert or change > now_change:
                        late.append((c, pos, here, insert and not now_insert, change and not now_change))
                    if now_insert or now_change:
                        a, b = open_[c + 1][pos], open_[c + 1][pos + 1]
                        known, above = seen[pos], seen[pos + 1]
                        for column, trace in here.items():
                            tos = successors(column)
                            made += len(tos)
                            if now_insert:
                                new = (trace, "insert", pos)
                                for to in tos:
                                    if to not in known and to not in a:
                                        a[to] = new
                            if now_change:
                                new = (trace, "replace", pos)
                                for to in tos:
                                    if to not in above and to not in b:
                                        b[to] = new
                                if column not in above and column not in b:
                                    b[column] = (trace, "delete", pos)
                            if pairs is not None and made > pairs:
                                break
                    if pairs is not None and made > pairs:
                        break
                if pairs is not None and made > pairs:
                    break
                while cost <= least and not open_.get(cost):
                    cost += 1
                if cost > least:
                    break
                # follow the tokens that are there
                fresh, todo = open_.pop(cost), []
                pos, last = min(fresh), max(fresh)
                while pos <= last:
                    here = {column: trace for column, trace in fresh.get(pos, {}).items() if seen[pos].get(column, cost + 1) > cost}
                    if here:
                        if pos > n:
                            if cost < best:
                                best, plan = cost, _edits(next(iter(here.values())))
                            break
                        seen[pos].update(dict.fromkeys(here, cost))
                        up = fresh[pos + 1]
                        if kinds[pos] == MARK:
                            for column, trace in here.items():
                                up.setdefault(column, (trace, "delete", pos))
                                for to in successors(column):
                                    up.setdefault(to, (trace, "replace", pos))
                                made += len(successors(column))
                        else:
                            key = keys[pos]
                            for column, trace in here.items():
                                to = steps[column].get(key)
                                if to is None:
                                    to = step(column, key)
                                if to >= 0:
                                    up.setdefault(to, trace)
                            # what is inserted at a marker can be inserted after it
                            todo.append((cost, pos, here, True, pos < n))
                        if pos == n:
                            for column, trace in here.items():
                                more = self.finish(column)
                                if cost + more < best:
                                    best, plan = cost + more, _edits(trace) + (("insert", n),) * more
                        if up:
                            last = max(last, pos + 1)
                    pos += 1
                if best <= least:
                    break
            if best <= least or (pairs is not None and made > pairs):
                break
            least += 1
            if best <= least:
                break
        if best > least:  # not proven
            cost, edits = self._narrow(kinds, keys, max_cost, beam)
            if cost < best:
                best, plan = cost, edits
        return best + marks, least + marks, plan

    def within(self, kinds: list[int], gaps: list[bool], most: int, first: int = 0) -> int:
        """Least cost of a repair whose edits all lie at `first` or later, or most + 1 if it costs more than `most`; always proven.

        No markers. Here a node is a rule and the position where it is called, with a link per caller that says how many edits later than
        the first caller it came, so nothing within a rule is done twice, and an item (state, node) counts at a position where it costs
        least: the work is polynomial and needs no bound on the search. Items behind a gap that ends statements (bound) only go on with the
        token after it."""
        n, table, final, rule_of, t_arcs, r_arcs, asi = len(kinds) - 1, self.table, self.final, self.rule_of, self.t_arcs, self.r_arcs, self.asi
        rest = self.bounds(kinds, [2 * k + g for k, g in zip(kinds, gaps)])
        targets = [tuple({t for k, t in arcs.items() if k != EOF}) for arcs in t_arcs]
        nodes: dict[tuple[int, int, bool], int] = {}
        links: list[dict[tuple[int, int], int]] = [{}]
        born, place, ends = [0], [-1], [{}]  # edits and position of the first call; edits by (position, bound) where the rule is complete
        seen: dict[tuple[int, bool], set[tuple[int, int]]] = defaultdict(set)
        levels: dict[int, dict[tuple[int, bool], list]] = defaultdict(lambda: defaultdict(list))
        levels[0][0, False].append((self.first_state[self.ids[self.start]], 0))

        def call(rule: int, back: int, up: int, bound: bool) -> None:
            nd = nodes.get((rule, pos, bound))
            if nd is None:
                nodes[rule, pos, bound] = nd = len(links)
                links.append({})
                born.append(cost)
                place.append(pos)
                ends.append({})
                level[pos, bound].append((self.first_state[rule], nd))
            if (back, up) not in links[nd]:
                links[nd][back, up] = late = cost - born[nd]
                for (q, b), c in ends[nd].items():
                    if c + late + rest[q] <= most:
                        levels[c + late][q, b].append((back, up))

        def complete(nd: int, bound: bool) -> None:
            if (pos, bound) not in ends[nd]:
                ends[nd][pos, bound] = cost
                for item, late in links[nd].items():
                    if cost + late + rest[pos] <= most:
                        levels[cost + late][pos, bound].append(item)

        for cost in range(most + 1):
            level = levels[cost]
            for pos in range(n + 1):
                if cost + rest[pos] > most or not (level.get((pos, False)) or level.get((pos, True))):
                    continue
                tok, gap = kinds[pos], gaps[pos]
                insert = pos >= first and cost + 1 + rest[pos] <= most
                change = first <= pos < n and cost + 1 + rest[pos + 1] <= most
                todo, known, up = level[pos, False], seen[pos, False], level[pos + 1, False]
                tight = level[pos, True]
                while todo:
                    item = todo.pop()
                    if item in known:
                        continue
                    known.add(item)
                    s, nd = item
                    if gap:
                        tight.append(item)
                    elif tok in table[s]:
                        shift, called = table[s][tok]
                        if shift >= 0:
                            up.append((shift, nd))
                        for rule, back in called:
                            call(rule, back, nd, False)
                    if insert or change:
                        for rule, back in r_arcs[s].items():
                            call(rule, back, nd, False)
                        if insert:
                            levels[cost + 1][pos, False].extend([(t, nd) for t in targets[s]])
                        if change:
                            after = levels[cost + 1][pos + 1, False]
                            after.extend([(t, nd) for t in targets[s]])
                            if place[nd] < pos or s != self.first_state[rule_of[s]]:  # else deleted before the call
                                after.append(item)
                    if final[s] and nd and (insert or change or not gap and tok in self.follow[rule_of[s]]):
                        complete(nd, False)
                known = seen[pos, True]
                while tight:
                    item = tight.pop()
                    if item in known:
                        continue
                    known.add(item)
                    s, nd = item
                    if tok in table[s]:
                        shift, called = table[s][tok]
                        if shift >= 0:
                            up.append((shift, nd))
                        for rule, back in called:
                            call(rule, back, nd, True)
                    if asi[s] >= 0:
                        tight.append((asi[s], nd))
                    if final[s] and nd:
                        complete(nd, True)
            if level.get((n + 1, False)):
                return cost
            del levels[cost]
        return most + 1

    def _narrow(self, kinds: list[int], keys: list[int], max_cost: int, beam: int) -> tuple[int, tuple]:
        """A repair that need not be the cheapest, without its markers: level by level, about `beam` pairs each, the furthest first.
        It stops at max_cost edits, or when that many would not reach the end at a few times the pace so far, and edits what is left."""
        n = len(kinds) - 1
        left = [0] * (n + 2)  # tokens from here on that are no markers
        for p in range(n - 1, -1, -1):
            left[p] = left[p + 1] + (kinds[p] != MARK)
        steps, step, successors = self.steps, self.step, self.successors
        seen: list[set[int]] = [set() for _ in range(n + 2)]

        def advance(level: dict[int, dict]) -> int:
            far, pos, last = 0, min(level), max(level)
            while pos <= last:
                here = level.get(pos)
                if here:
                    far = pos
                    seen[pos].update(here)
                    if pos > n:
                        break
                    known, up = seen[pos + 1], level.setdefault(pos + 1, {})
                    if kinds[pos] == MARK:
                        for column, trace in here.items():
                            up.setdefault(column, (trace, "delete", pos))
                            for to in successors(column):
                                up.setdefault(to, (trace, "replace", pos))
                    else:
                        for column, trace in here.items():
                            to = steps[column].get(keys[pos])
                            if to is None:
                                to = step(column, keys[pos])
                            if to >= 0 and to not in known:
                                up.setdefault(to, trace)
                    if up:
                        last = max(last, pos + 1)
                pos += 1
            return min(far, n)

        level: dict[int, dict] = {0: {self.start_column: None}}
        far = first_far = advance(level)
        cost, best, plan = 0, 10**9, ()
        while not level.get(n + 1):
            for pos in {far, n} & level.keys():
                for column, trace in level[pos].items():
                    more = left[pos] + self.finish(column)
                    if cost + more < best:
                        best = cost + more
                        plan = _edits(trace) + (("delete", pos), ("delete", n - 1))[: 2 * (pos < n)] + (("insert", n),) * (more - left[pos])
            if cost + 1 >= best or cost >= max_cost or (cost >= 3 and left[far] * cost > 4 * (far - first_far + 1) * (max_cost - cost)):
                return best, plan
            nxt: dict[int, dict] = defaultdict(dict)
            made = 0
            for pos in sorted(level, reverse=True):
                if pos > n or kinds[pos] == MARK:
                    continue
                here, up = nxt[pos], nxt[pos + 1]
                for column, trace in level[pos].items():
                    tos = successors(column)
                    made += len(tos)
                    here.update((to, (trace, "insert", pos)) for to in tos if to not in seen[pos] and to not in here)
                    if pos < n:
                        up.update((to, (trace, "replace", pos)) for to in tos if to not in seen[pos + 1] and to not in up)
                        if column not in seen[pos + 1]:
                            up.setdefault(column, (trace, "delete", pos))
                    if made > beam:
                        break
                if made > beam:
                    break
            level = {p: c for p, c in nxt.items() if c}
            if not level:
                return best, plan
            far = advance(level)
            cost += 1
        return cost, _edits(next(iter(level[n + 1].values())))


def _edits(trace) -> tuple:
    out = []
    while trace:
        out.append(trace[1:])
        trace = trace[0]
    return tuple(reversed(out))
