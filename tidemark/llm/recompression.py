"""Recompression of token sequences: rounds that rename runs and pairs consistently.

A round first replaces every maximal run of one symbol, then every pair whose left symbol
falls in the round's left half of the alphabet and whose right symbol falls in the right
half.  New names are hashes of what they replace, and the halves are bits of hashes, so a
name means the same token string in every document of every task: the naming is global
without a dictionary to look up.  Equal substrings therefore get equal symbols, except near
their ends, where the outcome hangs on neighbours.  How far it hangs is tracked: each symbol
carries the interval of tokens that decide it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .textkit import U64, combine, splitmix


@dataclass
class Level:
    name: np.ndarray  #: symbol names
    lo: np.ndarray  #: first token that decides the symbol
    hi: np.ndarray  #: token after the last that decides it
    doc: np.ndarray  #: document of the symbol

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Flags of the first and of the last symbol of each document."""
        new = np.ones(len(self.doc) + 1, dtype=bool)
        new[1:-1] = self.doc[1:] != self.doc[:-1]
        return new[:-1], new[1:]


def _runs(x: Level, seed: int) -> Level:
    n = len(x.name)
    same = np.zeros(n, dtype=bool)
    same[1:] = (x.name[1:] == x.name[:-1]) & (x.doc[1:] == x.doc[:-1])
    first = np.flatnonzero(~same)
    length = np.diff(np.append(first, n))
    last = first + length - 1
    name = x.name[first]
    long = length > 1
    if long.any():
        name[long] = combine(name[long], length[long].astype(U64), 2 * seed + 1)
    doc = x.doc[first]
    # that a run ends where it does is known from the symbols beside it; beside the first
    # symbol of a document lies the token before the document, which no window in it reaches
    opens, closes = x.edges()
    lo = np.where(opens[first], x.lo[first] - 1, x.lo[first - 1])
    hi = np.where(closes[last], x.hi[last] + 1, x.hi[np.minimum(last + 1, n - 1)])
    return Level(name, lo, hi, doc)


def _pairs(x: Level, seed: int) -> Level:
    n = len(x.name)
    left = (splitmix(x.name, 1000 + seed) & U64(1)).astype(bool)
    joined = np.zeros(n, dtype=bool)  # with the next symbol
    joined[:-1] = left[:-1] & ~left[1:] & (x.doc[1:] == x.doc[:-1])
    second = np.zeros(n, dtype=bool)
    second[1:] = joined[:-1]
    opens, closes = x.edges()
    alone_left = left & ~joined
    alone_right = ~left & ~second
    after = np.where(closes, x.hi + 1, np.append(x.hi[1:], 0))
    before = np.where(opens, x.lo - 1, np.append(0, x.lo[:-1]))
    hi = np.where(alone_left, after, x.hi)
    lo = np.where(alone_right, before, x.lo)
    keep = ~second
    name = x.name.copy()
    at = np.flatnonzero(joined)
    name[at] = combine(x.name[at], x.name[at + 1], 2 * seed)
    hi[at] = x.hi[at + 1]
    return Level(name[keep], lo[keep], hi[keep], x.doc[keep])


def _clip(x: Level, ptr: np.ndarray) -> Level:
    return Level(x.name, np.maximum(x.lo, ptr[x.doc] - 1), np.minimum(x.hi, ptr[x.doc + 1] + 1), x.doc)


def levels(tokens: np.ndarray, ptr: np.ndarray, rounds: int, runs_every: int = 1) -> list[Level]:
    """The symbols after each round, at 0 the tokens; tokens ptr[d]..ptr[d+1] are document d."""
    at = np.arange(len(tokens), dtype=np.int64)
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    out = [Level(tokens, at, at + 1, doc)]
    for r in range(rounds):
        if len(out[-1].name) == 0:
            break
        x = out[-1]
        if r % runs_every == 0:
            x = _clip(_runs(x, r), ptr)
        out.append(_clip(_pairs(x, r), ptr))
    return out
