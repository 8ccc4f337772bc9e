"""Patterns matched in time that grows with the text alone: a pattern becomes an automaton's table, walked once.

Only what needs no going back is taken: characters, sets, groups, choices, repetitions, and anchors at the ends. Python's
parser reads a pattern; sets of states then become states of the table, over ranges of code points that the pattern tells
apart. Matching is whole; \\d, \\w and \\s are ASCII, and a dot is anything but a line feed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from re import _constants as c
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of an automaton: parts of a pattern once repetitions are written out, states, and entries of the table.
PARTS, STATES, ENTRIES = 5_000, 1_000, 20_000
TOP = 0x110000
Ranges = list[tuple[int, int]]

DIGIT: Ranges = [(48, 57)]
SPACE: Ranges = [(9, 13), (32, 32)]
WORD: Ranges = [(48, 57), (65, 90), (95, 95), (97, 122)]


class Unsupported(ValueError):
    """The pattern needs what an automaton can't do, or too much of it."""


def outside(ranges: Ranges) -> Ranges:
    out, at = [], 0
    for lo, hi in sorted(ranges):
        if lo > at:
            out.append((at, lo - 1))
        at = max(at, hi + 1)
    return out + ([(at, TOP - 1)] if at < TOP else [])


CATEGORY = {
    c.CATEGORY_DIGIT: DIGIT, c.CATEGORY_NOT_DIGIT: outside(DIGIT),
    c.CATEGORY_SPACE: SPACE, c.CATEGORY_NOT_SPACE: outside(SPACE),
    c.CATEGORY_WORD: WORD, c.CATEGORY_NOT_WORD: outside(WORD),
}


class Parts:
    """States that a text can be in at once: where a state leads on its own, and on characters of some ranges."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.on: list[list[tuple[Ranges, int]]] = []

    def state(self) -> int:
        if len(self.free) >= PARTS:
            raise Unsupported("the pattern is too long once its repetitions are written out")
        self.free.append([])
        self.on.append([])
        return len(self.free) - 1

    def sequence(self, items, start: int, first: bool, last: bool) -> int:
        """Add items from a state on; returns where they end. first, last: whether they stand at an end of the pattern."""
        items = list(items)
        for i, (op, arg) in enumerate(items):
            start = self.item(op, arg, start, first and i == 0, last and i == len(items) - 1)
        return start

    def item(self, op, arg, start: int, first: bool, last: bool) -> int:
        if op in (c.LITERAL, c.NOT_LITERAL, c.ANY, c.IN):
            end = self.state()
            self.on[start].append((ranges_of(op, arg), end))
            return end
        if op is c.SUBPATTERN:
            if arg[1] or arg[2]:
                raise Unsupported("flags are not supported")
            return self.sequence(arg[3], start, first, last)
        if op is c.BRANCH:
            end = self.state()
            for choice in arg[1]:
                begin = self.state()
                self.free[start].append(begin)
                self.free[self.sequence(choice, begin, first, last)].append(end)
            return end
        if op in (c.MAX_REPEAT, c.MIN_REPEAT):
            least, most, body = arg
            for _ in range(least):
                start = self.sequence(body, start, False, False)
            if most is c.MAXREPEAT:
                loop = self.state()
                self.free[start].append(loop)
                self.free[self.sequence(body, loop, False, False)].append(loop)
                return loop
            end = self.state()
            self.free[start].append(end)
            for _ in range(most - least):
                start = self.sequence(body, start, False, False)
                self.free[start].append(end)
            return end
        if op is c.AT and ((first and arg in (c.AT_BEGINNING, c.AT_BEGINNING_STRING)) or (last and arg in (c.AT_END, c.AT_END_STRING))):
            return start
        raise Unsupported(f"{str(op).lower().replace('_', ' ')} is not supported")

    def closure(self, states: frozenset[int]) -> frozenset[int]:
        seen, open_ = set(states), list(states)
        while open_:
            for to in self.free[open_.pop()]:
                if to not in seen:
                    seen.add(to)
                    open_.append(to)
        return frozenset(seen)


def ranges_of(op, arg) -> Ranges:
    if op is c.ANY:
        return outside([(10, 10)])
    if op is c.LITERAL:
        return [(arg, arg)]
    if op is c.NOT_LITERAL:
        return outside([(arg, arg)])
    negated, found = False, []
    for kind, value in arg:
        if kind is c.NEGATE:
            negated = True
        elif kind is c.LITERAL:
            found.append((value, value))
        elif kind is c.RANGE:
            found.append(value)
        elif kind is c.CATEGORY and value in CATEGORY:
            found += CATEGORY[value]
        else:
            raise Unsupported(f"{str(kind).lower()} is not supported in a set")
    return outside(found) if negated else found


@dataclass(frozen=True)
class Automaton:
    """begins: first code points of the ranges that are told apart. table: the next state by state and range; state 0 is the
    first, -1 has no way to a match. accepting: states in which a text may end."""

    pattern: str
    begins: tuple[int, ...]
    table: tuple[tuple[int, ...], ...]
    accepting: frozenset[int]

    def fullmatch(self, text: str) -> bool:
        state = 0
        for ch in text:
            state = self.table[state][bisect_right(self.begins, ord(ch)) - 1]
            if state < 0:
                return False
        return state in self.accepting

    def matches(self, text: Column) -> Column:
        """The same over a column: a range for each character, by halving, and a step in the table for each."""

        def which(code: Column, lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi + 1) // 2
            return F.when(code < self.begins[mid], which(code, lo, mid - 1)).otherwise(which(code, mid, hi))

        width = len(self.begins)
        steps = F.array(*[F.lit(x) for row in self.table for x in row])
        codes = F.transform(F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "")), lambda ch: which(code_point(ch), 0, width - 1))
        end = F.aggregate(codes, F.lit(0), lambda s, x: F.when(s < 0, s).otherwise(F.element_at(steps, F.greatest(s, F.lit(0)) * width + x + 1)))
        return F.array_contains(F.array(*[F.lit(x) for x in sorted(self.accepting)]), end) if self.accepting else F.lit(False)


def code_point(ch: Column) -> Column:
    """Of a character: its four bytes in UTF-32."""
    return F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("int")


def automaton(pattern: str) -> Automaton:
    """Of a pattern that re.compile takes. Unsupported where an automaton can't do it within the bounds."""
    parsed = parser.parse(pattern)
    if parsed.state.flags & ~re.UNICODE:
        raise Unsupported("flags are not supported")
    parts = Parts()
    start = parts.state()
    end = parts.sequence(parsed, start, True, True)
    cuts = {0} | {x for on in parts.on for ranges, _ in on for lo, hi in ranges for x in (lo, hi + 1) if x < TOP}
    begins = tuple(sorted(cuts))
    spans = [[([(bisect_right(begins, lo) - 1, bisect_right(begins, hi) - 1) for lo, hi in ranges], to) for ranges, to in on] for on in parts.on]
    first = parts.closure(frozenset([start]))
    numbers, order, table = {first: 0}, [first], []
    for states in order:
        by_range: list[set[int]] = [set() for _ in begins]
        for s in states:
            for ranges, to in spans[s]:
                for lo, hi in ranges:
                    for k in range(lo, hi + 1):
                        by_range[k].add(to)
        row = []
        closed: dict[frozenset[int], int] = {}
        for reached in map(frozenset, by_range):
            if reached not in closed:
                if not reached:
                    closed[reached] = -1
                else:
                    to = parts.closure(reached)
                    if to not in numbers:
                        numbers[to] = len(order)
                        order.append(to)
                        if len(order) > STATES or len(order) * len(begins) > ENTRIES:
                            raise Unsupported("the pattern has too many states")
                    closed[reached] = numbers[to]
            row.append(closed[reached])
        table.append(tuple(row))
    return Automaton(pattern, begins, tuple(table), frozenset(i for i, states in enumerate(order) if end in states))
