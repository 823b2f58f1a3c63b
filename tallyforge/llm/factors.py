"""Relative Lempel-Ziv factors of word segments against a block of reference text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import ragged_take, split_words

def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and dense ranks from 0."""
    order = np.argsort(key)
    fresh = np.zeros(len(key), dtype=np.int64)
    fresh[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.cumsum(fresh)
    return order, rank


class Reference:
    """A block of segments (arrays of word numbers), indexed by its suffixes.

    Every segment ends in a number of its own, so no match runs over its end.
    Matches are measured up to 2 ** levels - 1 words: ranks are kept for
    stretches of 1, 2, 4, ... 2 ** (levels - 1) words, and the index is sorted
    by twice the last.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, levels: int):
        spread = sizes + 1
        self.ends = np.cumsum(spread) - 1
        self.starts = self.ends - sizes
        text = np.empty(int(spread.sum()), dtype=np.int64)
        text[ragged_take(self.starts, sizes)] = words
        text[self.ends] = int(words.max(initial=0)) + 1 + np.arange(len(sizes))
        _, rank = _ranked(text)
        self.ranks = [rank]
        for level in range(levels):
            step = 1 << level
            follow = np.zeros(len(rank), dtype=np.int64)
            follow[:-step] = rank[step:] + 1
            order, rank = _ranked(rank * (len(rank) + 1) + follow)
            if level < levels - 1:
                self.ranks.append(rank)
        self.order = order
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = np.arange(len(order))

    def _common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that the suffixes at x and y have in common, by ever shorter stretches of equal rank."""
        common, last = np.zeros(len(x), dtype=np.int64), len(self.order) - 1
        for level in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[level]
            p, q = x + common, y + common
            same = (np.maximum(p, q) <= last) & (rank[np.minimum(p, last)] == rank[np.minimum(q, last)])
            common += same << level
        return common

    def match(self, at: np.ndarray) -> np.ndarray:
        """Length of the longest match of the text at each place with any other place of the block.

        Each place is searched in the index: in suffix order the longest match is with a neighbour.
        """
        place, last = self.place[at], len(self.order) - 1
        above = np.where(place > 0, self._common(self.order[np.maximum(place - 1, 0)], at), 0)
        below = np.where(place < last, self._common(at, self.order[np.minimum(place + 1, last)]), 0)
        return np.maximum(above, below)

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of the greedy factors of all segments, which are parsed side by side.

        A factor is the longest match at its start; a word without one is a factor of its own.
        """
        at, end = self.starts.copy(), self.ends.copy()
        starts, lengths = [], []
        while len(at):
            live = at < end
            at, end = at[live], end[live]
            length = np.maximum(self.match(at), 1)
            starts.append(at)
            lengths.append(length)
            at = at + length
        return np.concatenate(starts), np.concatenate(lengths)


def repeated_windows(bodies: pa.Array, length: int, rank: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each window of each segment's words starts at another place of the block as well.

    Windows inside a factor of length words or more repeat. A window over a
    factor's boundary may repeat with other words before or behind it, so those
    that begin less than length words before a boundary are looked up one by one.
    """
    dictionary, codes, offsets = split_words(bodies.cast(pa.large_string()))
    sizes = np.diff(offsets)
    block = Reference(codes.astype(np.int64), sizes, length.bit_length())
    start, size = block.factors()
    gone = np.zeros(int(block.ends[-1]) + 1, dtype=bool)
    long = size >= length
    gone[ragged_take(start[long], size[long] - length + 1)] = True
    tail = np.minimum(size, length - 1)
    edge = ragged_take(start + size - tail, tail)
    gone[edge[block.match(edge) >= length]] = True
    return gone[ragged_take(block.starts, np.maximum(sizes - length + 1, 0))]
