"""An index of rules: a message meets only the rules that its direction, method, tool and text can satisfy.

Rules are looked up by (direction, method, tool), each once per worker and combination, and by a literal that one of
their patterns requires. One automaton finds all literals of a text in a single pass, however many rules there are.
What is left are a few candidates per message, whose patterns are then matched by Spark itself.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from signalbox.functions.regex import required_literals

try:
    import ahocorasick
except ImportError:  # without it, literals are looked for one by one
    ahocorasick = None

#: Combinations of direction, method and tool that a worker remembers.
_REMEMBERED = 10_000


class RuleIndex:
    """`rules` as (direction, methods, tools, patterns); candidates are their positions, in order."""

    def __init__(self, rules: list[tuple[str, tuple[str, ...], tuple[str, ...], tuple[str, ...]]]):
        self.size, self.free, self.by_literal = len(rules), set(), {}
        self.by: tuple[dict[str, set[int]], ...] = ({}, {}, {})
        self.any: tuple[set[int], ...] = (set(), set(), set())
        for i, (direction, methods, tools, patterns) in enumerate(rules):
            for field, values in enumerate(((direction,) if direction else (), methods, tools)):
                for value in values:
                    self.by[field].setdefault(value, set()).add(i)
                if not values:
                    self.any[field].add(i)
        # Of the literals a rule requires, the one that the fewest rules share tells most.
        literals = [{t for p in patterns for t in required_literals(p)} for *_, patterns in rules]
        shared = Counter(t for own in literals for t in own)
        for i, own in enumerate(literals):
            if own:
                self.by_literal.setdefault(min(own, key=lambda t: (shared[t], -len(t), t)), []).append(i)
            else:
                self.free.add(i)

    def matcher(self) -> Callable[[str, str, str, str], list[int]]:
        """A function of (direction, method, tool, text) that gives the candidates."""
        find = self._finder()
        known: dict[tuple, tuple[set[int], list[int]]] = {}

        def able(key: tuple) -> tuple[set[int], list[int]]:
            found = known.get(key)
            if found is None:
                if len(known) >= _REMEMBERED:
                    known.clear()
                # A rule's empty method also means no method; a missing tool is none that a rule can name.
                parts = [self.any[f] | self.by[f].get(v if v is not None else ("" if f == 1 else None), set()) for f, v in enumerate(key)]
                rules = set.intersection(*parts)
                found = known[key] = rules, sorted(rules & self.free)
            return found

        def candidates(direction, method, tool, text) -> list[int]:
            rules, free = able((direction, method, tool or None))
            if len(rules) == len(free) or not text:
                return free
            hits = {i for own in find(text) for i in own if i in rules}
            return sorted(hits.union(free)) if hits else free

        return candidates

    def _finder(self) -> Callable[[str], Iterator[list[int]]]:
        if not self.by_literal:
            return lambda text: iter(())
        if ahocorasick is None:
            return lambda text: (own for literal, own in self.by_literal.items() if literal in text)
        automaton = ahocorasick.Automaton()
        for literal, own in self.by_literal.items():
            automaton.add_word(literal, own)
        automaton.make_automaton()
        return lambda text: (own for _, own in automaton.iter(text))


def candidate_rules(index: RuleIndex, active: Column, payload: Column) -> Column:
    """The candidates of each message as array<int>; none where `active` is false. A null text meets no pattern."""

    @F.pandas_udf("array<int>")
    def found(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        match = index.matcher()
        for on, direction, method, tool, text in parts:
            # Nulls come as None or NaN, by the type of the column.
            columns = [c.astype(object).where(c.notna(), None) for c in (direction, method, tool, text)]
            yield pd.Series([match(*row) if flag else [] for flag, *row in zip(on, *columns, strict=True)], dtype=object)

    return found(active, F.col("direction"), F.col("method"), F.col("tool_name"), payload)


def literal_array(values: list, kind: str) -> Column:
    """A constant of type array<kind>, built from one text: a long list of literals takes long to build."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
