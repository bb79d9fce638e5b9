"""Weighted finite-state transducers over a small alphabet, composed and scored in max-plus.

A transducer rewrites a symbol string and adds weights. Composing two gives one that does
both in a single pass, with pairs of states. Where a transducer has several ways to go on,
the way of greatest weight counts, so it may guess what follows and fail if it guessed wrong.
"""

from __future__ import annotations

import math
import re


class Transducer:
    """arcs: (state, symbol read) -> [(next state, symbol written, weight)]; the start is state 0."""

    def __init__(self, arcs: dict[tuple[int, str], list[tuple[int, str, float]]], finals: set[int]) -> None:
        self.arcs, self.finals = arcs, finals

    def compose(self, other: Transducer) -> Transducer:
        """First this one, then the other on what this one writes."""
        number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        reads = sorted({c for _, c in self.arcs})
        while todo:
            here = todo.pop()
            for c in reads:
                out = []
                for p, written, w in self.arcs.get((here[0], c), ()):
                    for q, last, v in other.arcs.get((here[1], written), ()):
                        if (p, q) not in number:
                            number[p, q] = len(number)
                            todo.append((p, q))
                        out.append((number[p, q], last, w + v))
                if out:
                    arcs[number[here], c] = out
        return Transducer(arcs, {k for (p, q), k in number.items() if p in self.finals and q in other.finals})


class Scorer:
    """The greatest weight of a way through a transducer, by symbol string; idle symbols beyond ``reach`` change nothing."""

    def __init__(self, transducer: Transducer, idle: str, reach: int) -> None:
        self.moves: dict[str, dict[int, list[tuple[int, float]]]] = {}
        for (s, c), out in transducer.arcs.items():
            self.moves.setdefault(c, {})[s] = [(n, w) for n, _, w in out]
        self.finals = transducer.finals
        self.long, self.short, self.known = re.compile(f"{idle}{{{reach + 1},}}"), idle * reach, {}

    def __call__(self, symbols: str) -> float:
        symbols = self.long.sub(self.short, symbols)
        score = self.known.get(symbols)
        if score is None:
            score = self._best(symbols)
            if len(symbols) < 64 and len(self.known) < 1 << 16:  # memory only: longer ones are scored anew
                self.known[symbols] = score
        return score

    def _best(self, symbols: str) -> float:
        at = {0: 0.0}  # few states are open at a time
        for c in symbols:
            moves, now = self.moves[c], {}
            for s, have in at.items():
                for n, w in moves.get(s, ()):
                    if have + w > now.get(n, -math.inf):
                        now[n] = have + w
            at = now
        return max((w for s, w in at.items() if s in self.finals), default=-math.inf)
