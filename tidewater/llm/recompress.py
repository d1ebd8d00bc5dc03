"""Locally consistent names for word sequences by recompression.

Round by round, maximal runs of a symbol, and then pairs of a left and a right
symbol, are replaced by new symbols. A name is a 64-bit mix of what it stands
for, and a symbol's side a bit of its name, so every task of every job names
equal runs and pairs alike without asking the others.

Which names come out at a place depends on the words around it only within a
known stretch: that of the symbol before and after for a run (is it maximal?),
that of the partner, or of the neighbour that is none, for a pair. ``Symbols``
carries that stretch along. A symbol whose stretch lies inside a window of words
therefore stands at the same place in every equal window, wherever it occurs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_KINDS = np.arange(8, dtype=np.uint64) * _A
_LEVELS = np.arange(64, dtype=np.uint64) * _B
#: Inverse of _A modulo 2**64.
_BACK = np.uint64(pow(int(_A), -1, 1 << 64))
NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def name(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    """Name of an ordered pair of values."""
    return mix(mix(a + _KINDS[kind]) + b * _A + np.uint64(1))


@dataclass
class Symbols:
    """Symbols of many sequences, one after the other."""

    name: np.ndarray
    start: np.ndarray  # words that the symbol stands for
    stop: np.ndarray
    low: np.ndarray  # words that it depends on
    high: np.ndarray
    seq: np.ndarray  # number of its sequence

    def take(self, i: np.ndarray) -> Symbols:
        return Symbols(self.name[i], self.start[i], self.stop[i], self.low[i], self.high[i], self.seq[i])


def first_symbols(words: np.ndarray, lengths: np.ndarray) -> Symbols:
    at = np.arange(len(words))
    return Symbols(words, at, at + 1, at, at + 1, np.repeat(np.arange(len(lengths)), lengths))


def _around(s: Symbols, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether a symbol of the same sequence stands before and after, and the
    stretches with those; past an end of the sequence nothing is known, so the
    stretch reaches out of it."""
    inner = s.seq[1:] == s.seq[:-1]
    before, after = np.concatenate(([False], inner)), np.concatenate((inner, [False]))
    low, high = begins[s.seq] - 1, ends[s.seq] + 1
    low[1:] = np.where(inner, np.minimum(s.low[:-1], s.low[1:]), low[1:])
    high[:-1] = np.where(inner, np.maximum(s.high[:-1], s.high[1:]), high[:-1])
    return before, after, low, high


def merge_runs(s: Symbols, begins: np.ndarray, ends: np.ndarray) -> Symbols:
    """Maximal runs of one symbol as one symbol."""
    _, _, low, high = _around(s, begins, ends)
    change = np.concatenate(([True], (s.name[1:] != s.name[:-1]) | (s.seq[1:] != s.seq[:-1])))
    first = np.flatnonzero(change)
    last = np.concatenate((first[1:], [len(change)])) - 1
    size = last - first + 1
    named = np.where(size > 1, name(s.name[first], size.astype(np.uint64), 2), s.name[first])
    return Symbols(named, s.start[first], s.stop[last], low[first], high[last], s.seq[first])


def merge_pairs(s: Symbols, begins: np.ndarray, ends: np.ndarray, level: int) -> Symbols:
    """A left symbol followed by a right one as one symbol."""
    _, after, low, high = _around(s, begins, ends)
    left = (mix(s.name ^ _LEVELS[level]) & np.uint64(1)).astype(bool)
    opens = np.zeros(len(left), bool)
    opens[:-1] = left[:-1] & ~left[1:] & after[:-1]
    closes = np.concatenate(([False], opens[:-1]))
    # alone: a left one looks at what follows, a right one at what goes before
    out = Symbols(s.name.copy(), s.start, s.stop.copy(), np.where(left, s.low, low), np.where(left, high, s.high), s.seq)
    i = np.flatnonzero(opens)
    out.name[i] = name(s.name[i], s.name[i + 1], 3)
    out.stop[i] = s.stop[i + 1]
    out.low[i] = np.minimum(s.low[i], s.low[i + 1])
    out.high[i] = np.maximum(s.high[i], s.high[i + 1])
    return out.take(np.flatnonzero(~closes))


def rounds_for(window: int) -> int:
    """Rounds after which symbols still fit into a window of so many words: the
    stretch of a symbol grows about threefold in each."""
    n = 1
    while 4 * 3 ** n <= window:
        n += 1
    return n


class Stretches:
    """Names of any stretches of words, from one running sum."""

    def __init__(self, words: np.ndarray):
        power = np.concatenate((np.ones(1, np.uint64), np.full(len(words), _A)))
        self.back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(words), _BACK))), dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(
            mix(words) * np.cumprod(power, dtype=np.uint64)[:-1], dtype=np.uint64)))

    def names(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Equal stretches have equal names; start >= 0, stop <= all words."""
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))


def anchors(words: np.ndarray, lengths: np.ndarray, window: int, stretches: Stretches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, sequence, anchor) of each window inside one sequence.

    Of the symbols that stand for two words or more and are determined by the
    window, the one that depends on a middling number of words is taken, of
    equals the least; the anchor is the name of the words it depends on. Where there is none, it
    is the name of the window. Equal windows have equal anchors."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    best = np.full(len(words) + 1, NOTHING)
    if len(words):
        s = first_symbols(words, lengths)
        for level in range(1, rounds_for(window) + 1):
            s = merge_pairs(merge_runs(s, begins, ends), begins, ends, level)
            span = s.stop - s.start
            lo = np.maximum(s.high - window, begins[s.seq])
            hi = np.minimum(s.low, ends[s.seq] - window)
            use = np.flatnonzero((span > 1) & (lo <= hi))
            low, high = s.low[use], s.high[use]
            # long enough to be telling, short enough to lie in many windows
            rank = np.minimum(np.abs(window * 5 // 8 - (high - low)), 14).astype(np.uint64)
            key = (rank << np.uint64(60)) | (stretches.names(low, high) >> np.uint64(4))
            lo, hi = lo[use], hi[use]
            while len(lo):
                np.minimum.at(best, lo, key)
                lo = lo + 1
                go = lo <= hi
                lo, hi, key = lo[go], hi[go], key[go]
    counts = np.maximum(lengths - window + 1, 0)
    seq = np.repeat(np.arange(len(lengths)), counts)
    start = np.arange(len(seq)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[seq]
    anchor = best[start]
    bare = np.flatnonzero(anchor == NOTHING)
    if len(bare):
        whole = stretches.names(start[bare], start[bare] + window)
        anchor[bare] = (np.uint64(15) << np.uint64(60)) | (whole >> np.uint64(4))
    return start, seq, anchor
