"""Least-cost syntax repair by an error-correcting chart parser.

A chart holds constituents bottom-up. Bracket groups are constituents: an innermost group is parsed, gets
the category under which it needs the fewest repairs, and stands as one symbol in the group around it.
Within a group, expressions are constituents that are found by folding operands and operators into one
symbol, and statements are the items: rows of a chart over positions and grammar states, in which a
symbol may be read (cost 0), replaced, dropped or supplied (cost 1 each). Finished constituents are kept
by their token kinds, so the many statements of one form are parsed once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Constituents kept per grammar and process.
KEPT = 200_000


class Grammar:
    """A right-linear grammar over one-character tokens, given as a regular expression: ( | ) * + ? [..]."""

    def __init__(self, pattern: str):
        self.fast = re.compile(pattern.replace("(", "(?:"))
        self.edges: list[list[tuple[str, int]]] = []
        self.free: list[list[int]] = []
        self._at, self._p = 0, pattern
        self._ends = self._alt()
        self._table = None
        self.cost = lru_cache(KEPT)(self._cost)

    def _states(self) -> tuple:
        """Deterministic states of the grammar and the least number of supplied tokens between them; made when
        the first repair is needed."""
        if self._table is not None:
            return self._table
        start, end = self._ends

        def closed(nodes) -> frozenset[int]:
            seen, todo = set(nodes), list(nodes)
            while todo:
                for b in self.free[todo.pop()]:
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            return frozenset(n for n in seen if self.edges[n] or n == end)

        first = closed([start])
        number, todo, moves = {first: 0}, [first], []
        while todo:
            state = todo.pop()
            to: dict[str, set[int]] = {}
            for n in state:
                for chars, b in self.edges[n]:
                    for c in chars:
                        to.setdefault(c, set()).add(b)
            for c, nodes in to.items():
                nxt = closed(nodes)
                if nxt not in number:
                    number[nxt] = len(number)
                    todo.append(nxt)
                moves.append((number[state], number[nxt], c))
        n = len(number)
        step = np.full((n, n), 9_999, dtype=np.int16)
        np.fill_diagonal(step, 0)
        for a, b, _ in moves:
            if a != b:
                step[a, b] = 1
        for k in range(n):
            np.minimum(step, step[:, k : k + 1] + step[k : k + 1, :], out=step)
        by: dict[str, list[tuple[int, int]]] = {}
        for a, b, c in moves:
            by.setdefault(c, []).append((a, b))
        by = {c: (np.array([x[0] for x in v]), np.array([x[1] for x in v])) for c, v in by.items()}
        pairs = {(a, b) for a, b, _ in moves}
        every = (np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
        ends = np.array([number[s] for s in number if end in s])
        self._table = step, by, every, ends
        return self._table

    def _node(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _alt(self) -> tuple[int, int]:
        a, b = self._node(), self._node()
        while True:
            s, t = self._seq()
            self.free[a].append(s)
            self.free[t].append(b)
            if self._at < len(self._p) and self._p[self._at] == "|":
                self._at += 1
                continue
            return a, b

    def _seq(self) -> tuple[int, int]:
        s = t = self._node()
        while self._at < len(self._p) and self._p[self._at] not in "|)":
            a, b = self._atom()
            self.free[t].append(a)
            t = b
        return s, t

    def _atom(self) -> tuple[int, int]:
        c = self._p[self._at]
        self._at += 1
        if c == "(":
            a, b = self._alt()
            self._at += 1
        else:
            if c == "[":
                close = self._p.index("]", self._at)
                c, self._at = self._p[self._at : close], close + 1
            a, b = self._node(), self._node()
            self.edges[a].append((c, b))
        while self._at < len(self._p) and self._p[self._at] in "*+?":
            m = self._p[self._at]
            self._at += 1
            s, t = self._node(), self._node()
            self.free[s].append(a)
            self.free[b].append(t)
            if m in "*?":
                self.free[s].append(t)
            if m in "*+":
                self.free[b].append(a)
            a, b = s, t
        return a, b

    def repairs(self, tokens: str) -> int:
        """The chart, row by row: for every position the least cost to reach each state."""
        step, by, (all_src, all_dst), ends = self._states()
        c = step[0].astype(np.int32)
        for t in tokens:
            nxt = c + 1  # dropped
            np.minimum.at(nxt, all_dst, c[all_src] + 1)  # replaced
            if t in by:
                src, dst = by[t]
                np.minimum.at(nxt, dst, c[src])  # read
            c = (nxt[:, None] + step).min(axis=0)  # supplied
        return int(c[ends].min())

    def _cost(self, tokens: str) -> int:
        return 0 if self.fast.fullmatch(tokens) else max(1, self.repairs(tokens))


GROUP = re.compile(r"[(\[{][^()\[\]{}]*[)\]}]")
PAIR = {"(": ")", "[": "]", "{": "}"}


class Folds:
    """Expressions as constituents: patterns that are folded into a symbol until nothing changes."""

    def __init__(self, steps: list[tuple[str, str]]):
        self.steps = [(re.compile(p), r) for p, r in steps]
        self.fold = lru_cache(KEPT)(self._fold)

    def _fold(self, tokens: str) -> str:
        while True:
            before = tokens
            for pattern, symbol in self.steps:
                tokens = pattern.sub(symbol, tokens)
            if tokens == before:
                return tokens


class Bracketed:
    """Parser of a language whose constituents are bracket groups.

    ``kinds`` lists for each opening bracket the categories ``(symbol, grammar, by_statement)`` that its
    contents may have; ``statement`` cuts contents into statements, ``order`` checks which statement may
    follow which, ``block`` tells braces that must be blocks by what stands before them.
    """

    def __init__(self, folds: Folds, kinds: dict[str, list[tuple[str, Grammar, bool]]], whole: Grammar, statement: str,
                 order: list[tuple[str, str]], block: str = "X(?!X)X"):
        self.block = re.compile(block)
        self.folds, self.kinds, self.whole = folds, kinds, whole
        self.order = [(a, re.compile(b)) for a, b in order]
        self.statement = re.compile(statement)
        self.group = lru_cache(KEPT)(self._group)
        self.one = lru_cache(KEPT)(lambda grammar, tokens: grammar.cost(folds.fold(tokens)))

    def statements(self, grammar: Grammar, tokens: str) -> int:
        """Cost of a sequence of statements."""
        cost = 0
        before = ""
        for p in self.statement.findall(tokens):
            if not p:
                continue
            c = self.one(grammar, p)
            for start, needed in self.order:
                if p[0] == start and not c and not needed.match(before):
                    c = 1
            cost += c
            before = p
        return cost

    def _group(self, tokens: str) -> tuple[str, int]:
        mismatch = int(PAIR[tokens[0]] != tokens[-1])
        inner = self.block.sub("K", tokens[1:-1])
        kinds = self.kinds[tokens[0]]
        folded = None
        for symbol, grammar, by_statement in kinds:  # without repairs, if any way
            if by_statement:
                if not self.statements(grammar, inner):
                    return symbol, mismatch
            else:
                if tokens[0] == "{" and ";" in inner:
                    continue  # statements
                folded = self.folds.fold(inner) if folded is None else folded
                if grammar.fast.fullmatch(folded):
                    return symbol, mismatch
        best = None
        for symbol, grammar, by_statement in kinds:
            if not by_statement and len(kinds) > 1 and tokens[0] == "{" and ";" in inner:
                continue  # statements
            cost = self.statements(grammar, inner) if by_statement else self.one(grammar, inner)
            if best is None or cost < best[1]:
                best = (symbol, cost)
        return best[0], best[1] + mismatch

    def reduce(self, tokens: str) -> tuple[str, int]:
        cost = 0

        def one(m: re.Match) -> str:
            nonlocal cost
            symbol, c = self.group(m.group())
            cost += c
            return symbol

        while True:
            tokens, n = GROUP.subn(one, tokens)
            if not n:
                return tokens, cost

    def parse(self, tokens: str) -> int:
        """Least number of repairs as the chart finds them."""
        rest, cost = self.reduce(tokens)
        rest = self.block.sub("K", rest)
        return cost + self.statements(self.whole, rest)
