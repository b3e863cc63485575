"""Small weighted finite-state transducers: composition and tropical-semiring shortest paths."""

from __future__ import annotations

from collections import deque
from collections.abc import Hashable, Iterable
from typing import NamedTuple

#: Stands for any symbol that a state has no arc of its own for; as output, it copies the input.
ANY = "<any>"


class Arc(NamedTuple):
    out: Hashable
    weight: float
    to: Hashable


class Transducer:
    """States with arcs by input symbol; every state is final unless ``final`` names some.

    Weights are costs: they add along a path, and of two paths the cheaper one counts.
    """

    def __init__(self, start: Hashable, final: Iterable[Hashable] | None = None):
        self.start = start
        self.final = None if final is None else set(final)
        self.arcs: dict[Hashable, dict[Hashable, list[Arc]]] = {}

    def add(self, state: Hashable, symbol: Hashable, out: Hashable, weight: float, to: Hashable) -> None:
        self.arcs.setdefault(state, {}).setdefault(symbol, []).append(Arc(out, weight, to))

    def leaving(self, state: Hashable, symbol: Hashable) -> list[Arc]:
        """Arcs for a symbol; those of ANY apply where it has none of its own."""
        own = self.arcs.get(state, {})
        if symbol in own:
            return own[symbol]
        return [Arc(symbol if a.out == ANY else a.out, a.weight, a.to) for a in own.get(ANY, [])]

    def ends(self, state: Hashable) -> bool:
        return self.final is None or state in self.final

    def composed(self, other: Transducer, alphabet: Iterable[Hashable]) -> Transducer:
        """The transducer that feeds this one's output to ``other``, over the given input symbols."""
        both = Transducer((self.start, other.start))
        both.final = None if self.final is None and other.final is None else set()
        symbols = list(alphabet)
        seen, waiting = {both.start}, deque([both.start])
        while waiting:
            state = waiting.popleft()
            a, b = state
            if both.final is not None and self.ends(a) and other.ends(b):
                both.final.add(state)
            for s in symbols:
                for x in self.leaving(a, s):
                    for y in other.leaving(b, x.out):
                        to = (x.to, y.to)
                        both.add(state, s, y.out, x.weight + y.weight, to)
                        if to not in seen:
                            seen.add(to)
                            waiting.append(to)
        return both

    def shortest(self, symbols: Iterable[Hashable]) -> tuple[float, list[Hashable]] | None:
        """(cost, outputs) of the cheapest path for an input, or None; ties go to the first arc."""
        reach: dict[Hashable, tuple[float, tuple | None]] = {self.start: (0.0, None)}
        for s in symbols:
            ahead: dict[Hashable, tuple[float, tuple | None]] = {}
            for state, (cost, trail) in reach.items():
                for a in self.leaving(state, s):
                    total = cost + a.weight
                    if a.to not in ahead or total < ahead[a.to][0]:
                        ahead[a.to] = (total, (a.out, trail))
            reach = ahead
            if not reach:
                return None
        ends = [v for k, v in reach.items() if self.ends(k)]
        if not ends:
            return None
        cost, trail = min(ends, key=lambda v: v[0])
        out: list[Hashable] = []
        while trail is not None:
            out.append(trail[0])
            trail = trail[1]
        return cost, out[::-1]
