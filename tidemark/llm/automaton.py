"""Deterministic automata over bytes from rule patterns.

Patterns know literals, escapes, classes, groups, ``(?i:...)``, ``|``, ``?``, ``*``,
``+`` and ``{m}``, ``{m,}``, ``{m,n}``. A pattern, or its mirror image, becomes a
graph with empty moves, several patterns share one graph, subsets of its nodes become
states, and states that no input tells apart are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ANY = frozenset(range(256))


def _both_cases(s: frozenset[int]) -> frozenset[int]:
    text = bytes(sorted(s))
    return frozenset(text.lower() + text.upper() + text)


class _Reader:
    """Turns a pattern into nested tuples: set, cat, alt and rep."""

    def __init__(self, pattern: str):
        self.rest, self.fold = list(pattern), False

    def peek(self) -> str:
        return self.rest[0] if self.rest else ""

    def take(self) -> str:
        return self.rest.pop(0)

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self):
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeated(self.atom()))
        return ("cat", items)

    def repeated(self, item):
        bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}
        while self.peek() in ("?", "*", "+", "{"):
            c = self.take()
            if c == "{":
                text = ""
                while (c := self.take()) != "}":
                    text += c
                low, comma, high = text.partition(",")
                bound = int(low), int(high) if high else None if comma else int(low)
            else:
                bound = bounds[c]
            item = ("rep", item, *bound)
        return item

    def byte(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            return int(self.take() + self.take(), 16)
        return {"n": 10, "r": 13, "t": 9}.get(c, ord(c))

    def atom(self):
        c = self.peek()
        if c == "(":
            self.take()
            outer = self.fold
            if "".join(self.rest[:3]) == "?i:":
                del self.rest[:3]
                self.fold = True
            inner = self.alternatives()
            self.take()
            self.fold = outer
            return inner
        if c == "[":
            return ("set", self.members())
        one = frozenset([self.byte()])
        return ("set", _both_cases(one) if self.fold else one)

    def members(self) -> frozenset[int]:
        self.take()
        negated = self.peek() == "^"
        if negated:
            self.take()
        found: set[int] = set()
        while self.peek() != "]":
            low = self.byte()
            if self.peek() == "-" and self.rest[1] != "]":
                self.take()
                found.update(range(low, self.byte() + 1))
            else:
                found.add(low)
        self.take()
        chosen = frozenset(ANY - found if negated else found)
        return _both_cases(chosen) if self.fold else chosen


class _Graph:
    """Nodes with empty moves and moves on a set of bytes."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def node(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int, mirror: bool) -> int:
        """Append a tree behind ``start`` and return its end."""
        kind = tree[0]
        if kind == "set":
            end = self.node()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in reversed(tree[1]) if mirror else tree[1]:
                start = self.add(part, start, mirror)
            return start
        if kind == "alt":
            end = self.node()
            for option in tree[1]:
                self.empty[self.add(option, start, mirror)].append(end)
            return end
        _, inner, low, high = tree
        for _ in range(low):
            start = self.add(inner, start, mirror)
        if high is None:
            loop = self.node()
            self.empty[start].append(loop)
            self.empty[self.add(inner, loop, mirror)].append(loop)
            return loop
        ends = [start]
        for _ in range(high - low):
            start = self.add(inner, start, mirror)
            ends.append(start)
        end = self.node()
        for e in ends:
            self.empty[e].append(end)
        return end

    def reach(self, nodes) -> frozenset[int]:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for n in self.empty[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """``step[state + byte]`` is the next state; states are multiples of 256 and those that
    accept something lie at ``first`` and above; ``accepts[state]`` has one bit per pattern.
    State ``dead`` (or -1) never accepts again."""

    step: list[int]
    start: int
    first: int
    dead: int
    accepts: dict[int, int]

    def __len__(self) -> int:
        return len(self.step) // 256


def compile_patterns(patterns: list[str], anywhere: bool, mirror: bool = False) -> Automaton:
    """One minimal automaton for all patterns; ``anywhere``: a match may begin at any byte."""
    graph = _Graph()
    begin, ends = graph.node(), {}
    for k, pattern in enumerate(patterns):
        entry = graph.node()
        graph.empty[begin].append(entry)
        ends[graph.add(_Reader(pattern).alternatives(), entry, mirror)] = 1 << k
    table, accepts = _subsets(graph, begin, ends, anywhere)
    return _numbered(*_merged(table, accepts))


def _subsets(graph: _Graph, begin: int, ends: dict[int, int], anywhere: bool) -> tuple[np.ndarray, np.ndarray]:
    sets = list({s for moves in graph.moves for s, _ in moves})
    alike: dict[tuple[bool, ...], list[int]] = {}
    for b in range(256):
        alike.setdefault(tuple(b in s for s in sets), []).append(b)
    first = graph.reach([begin])
    known, todo, rows = {first: 0}, [first], []
    while todo:
        nodes, row = todo.pop(0), np.zeros(256, np.int64)
        for members in alike.values():
            to = {n for x in nodes for s, n in graph.moves[x] if members[0] in s}
            after = graph.reach(to) | first if anywhere else graph.reach(to)
            if after not in known:
                known[after] = len(known)
                todo.append(after)
            row[members] = known[after]
        rows.append(row)
    marks = np.array([sum(ends.get(n, 0) for n in nodes) for nodes in known])
    return np.array(rows), marks


def _merged(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split blocks of states until members of a block always move to the same blocks."""
    block = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:
        _, one, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_index=True, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    rest = np.delete(np.arange(len(one)), finer[0])
    order = np.r_[finer[0], rest]  # the start stays state 0
    place = np.empty(len(one), np.int64)
    place[order] = np.arange(len(one))
    return place[finer[table[one[order]]]], accepts[one[order]]


def _numbered(table: np.ndarray, accepts: np.ndarray) -> Automaton:
    """Accepting states last; the start is wherever state 0 went."""
    order = np.argsort(accepts != 0, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    table, accepts = place[table[order]], accepts[order]
    dead = [s for s in range(len(table)) if not accepts[s] and (table[s] == s).all()]
    return Automaton(
        step=(table * 256).reshape(-1).tolist(), start=int(place[0]) * 256, first=int((accepts == 0).sum()) * 256,
        dead=dead[0] * 256 if dead else -1, accepts={s * 256: int(a) for s, a in enumerate(accepts) if a})

