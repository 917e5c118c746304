"""Regular expressions as minimal deterministic automata over bytes.

``compile_rules`` turns patterns into one automaton: parse, Thompson's
nondeterministic automaton, subset construction, minimisation by partition
refinement, transition array. Patterns may use literals, classes, groups,
alternation and bounded or unbounded repeats.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

DEAD = 0


class _Nfa:
    def __init__(self, backwards: bool = False) -> None:
        self.backwards = backwards
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Append what ``tree`` matches after ``start``; the state where it ends."""
        for op, arg in reversed(list(tree)) if self.backwards else tree:
            start = self._item(str(op), arg, start)
        return start

    def _item(self, op: str, arg, start: int) -> int:
        if op in ("LITERAL", "IN", "ANY", "NOT_LITERAL"):
            end = self.state()
            self.moves[start].append((_bytes(op, arg), end))
            return end
        if op == "SUBPATTERN":
            return self.add(arg[3], start)
        if op == "BRANCH":
            end = self.state()
            for tree in arg[1]:
                self.empty[self.add(tree, start)].append(end)
            return end
        if op in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, tree = arg
            for _ in range(least):
                start = self.add(tree, start)
            if str(most) == "MAXREPEAT":
                loop = self.state()
                self.empty[start].append(loop)
                self.empty[self.add(tree, loop)].append(loop)
                return loop
            end = self.state()
            for _ in range(most - least):
                self.empty[start].append(end)
                start = self.add(tree, start)
            self.empty[start].append(end)
            return end
        raise ValueError(f"unsupported in a rule: {op}")

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _bytes(op: str, arg) -> frozenset[int]:
    if op == "ANY":
        return frozenset(range(256)) - {10}
    if op == "LITERAL":
        return frozenset([arg])
    if op == "NOT_LITERAL":
        return frozenset(range(256)) - {arg}
    found: set[int] = set()
    negate = False
    for kind, value in arg:
        if str(kind) == "NEGATE":
            negate = True
        elif str(kind) == "LITERAL":
            found.add(value)
        elif str(kind) == "RANGE":
            found.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"unsupported in a class: {kind}")
    return frozenset(range(256)) - found if negate else frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """``table[state, byte]`` is the next state, 0 the dead state, ``accepts[state]`` a bit per rule."""

    table: np.ndarray
    accepts: np.ndarray
    start: int


def compile_rules(patterns: list[str], starts: bool = False) -> Automaton:
    """One minimal automaton for all patterns.

    With ``starts`` it reads a text from its end to its begin, and where it
    accepts a rule after a byte, a match of that rule starts at this byte. So one
    pass finds every position from which any rule matches.
    """
    nfa = _Nfa(backwards=starts)
    root = nfa.state()
    ends: dict[int, int] = {}
    for i, p in enumerate(patterns):
        begin = nfa.state()
        nfa.empty[root].append(begin)
        tree = re._parser.parse(p)
        ends[nfa.add(tree, begin)] = 1 << i
    # Bytes that no class tells apart share a column until the end.
    classes: dict[tuple, list[int]] = {}
    sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    for b in range(256):
        classes.setdefault(tuple(b in s for s in sets), []).append(b)
    letters = [bs[0] for bs in classes.values()]
    first = nfa.closure([root])
    numbers, todo, rows, accepts = {frozenset(): DEAD, first: 1}, [frozenset(), first], [], []
    for states in todo:  # grows while it is read
        bits = 0
        for s in states:
            bits |= ends.get(s, 0)
        accepts.append(bits)
        row = []
        for b in letters:
            step = nfa.closure({t for s in states for chars, t in nfa.moves[s] if b in chars})
            if starts:
                step |= first
            if step not in numbers:
                numbers[step] = len(todo)
                todo.append(step)
            row.append(numbers[step])
        rows.append(row)
    narrow, accepts = np.array(rows), np.array(accepts)
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block[:, None], block[narrow]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    order = {b: i for i, b in enumerate(dict.fromkeys(block.tolist()))}
    block = np.array([order[b] for b in block.tolist()])
    of_block = np.array([np.flatnonzero(block == i)[0] for i in range(len(order))])
    columns = np.empty(256, np.int64)
    for i, bs in enumerate(classes.values()):
        columns[bs] = i
    return Automaton(block[narrow[of_block]][:, columns], accepts[of_block], int(block[1]))
