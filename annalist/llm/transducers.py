"""Weighted finite-state transducers over small alphabets.

A transducer reads a symbol, writes one, and multiplies what the word weighs by the factor of the arc it takes. Factors
multiply along a cascade of transducers; the weights of a path's words add up. Where several arcs read the same symbol
the transducer guesses, and only paths that end in a final state count; the heaviest one is the result.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Sequence
from dataclasses import dataclass

State = Hashable
Arcs = Callable[[State, int], Iterable[tuple[int, float, State]]]  # state, symbol read: (symbol written, factor, next state)


@dataclass(frozen=True)
class Transducer:
    start: State
    arcs: Arcs
    final: Callable[[State], bool] = lambda state: True

    def paths(self, symbols: Sequence[int]) -> list[tuple[list[int], list[float]]]:
        """All accepted paths, as symbols written and factors: exponential, for checks."""
        out = [(self.start, [], [])]
        for symbol in symbols:
            out = [(after, [*written, w], [*factors, f]) for at, written, factors in out for w, f, after in self.arcs(at, symbol)]
        return [(written, factors) for at, written, factors in out if self.final(at)]


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads like the first and writes what the second makes of that."""

    def arcs(state, symbol):
        a, b = state
        return [(w, f * g, (c, d)) for v, f, c in first.arcs(a, symbol) for w, g, d in second.arcs(b, v)]

    return Transducer((first.start, second.start), arcs, lambda s: first.final(s[0]) and second.final(s[1]))


class Automaton:
    """A transducer as tables of numbered states, without its output: for each state and symbol the (factor, next state)
    pairs. `rest` is the symbol that words without a symbol of their own have; it has one arc at most and the factor 0, and
    after `scope` of them nothing changes."""

    def __init__(self, source: Transducer, symbols: int, rest: int, scope: int):
        number, self.table, todo = {source.start: 0}, [], [source.start]
        for state in todo:  # grows as states are met
            row = []
            for symbol in range(symbols):
                arcs = list(source.arcs(state, symbol))
                for *_, after in arcs:
                    if after not in number:
                        number[after] = len(todo)
                        todo.append(after)
                row.append([(f, number[after]) for _, f, after in arcs])
            self.table.append(row)
        self.final = [source.final(state) for state in todo]
        self.scope = scope
        # the states after 0, 1, ... `scope` words of rest, which may end a path but never split it
        self.skips = [{k: k for k in range(len(todo))}]
        for _ in range(scope):
            self.skips.append({k: self.table[s][rest][0][1] for k, s in self.skips[-1].items() if self.table[s][rest]})

    def weight(self, words: Iterable[tuple[int, int, float]]) -> float:
        """The heaviest accepted path over words (number, symbol, weight) that stand in order; words in between are rest."""
        table, skips, scope = self.table, self.skips, self.scope
        live, last = {0: 0.0}, None
        for at, symbol, weight in words:
            skip = skips[0 if last is None else min(at - last - 1, scope)]
            last = at
            found: dict[int, float] = {}
            for state, total in live.items():
                if state in skip:
                    for factor, after in table[skip[state]][symbol]:
                        new = total + factor * weight
                        if found.get(after, -1.0) < new:
                            found[after] = new
            live = found
        return max((total for state, total in live.items() if self.final[state]), default=0.0)
