"""Suffix order of integer strings by the difference cover {1, 2} modulo 3, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import ragged_take, text_bytes

_BITS = 21


def _packed(*parts: np.ndarray) -> np.ndarray:
    """One sortable number of each tuple; parts that don't fit are ranked first."""
    if all(len(p) == 0 or int(p.max()) < 1 << _BITS for p in parts[1:]) and (len(parts) < 3 or not len(parts[0]) or int(parts[0].max()) < 1 << _BITS):
        key = parts[0].astype(np.int64)
        for p in parts[1:]:
            key = key << _BITS | p
        return key
    order = np.lexsort(parts[::-1])
    rows = np.stack([p[order] for p in parts])
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = np.concatenate([[0], np.cumsum((np.diff(rows, axis=1) != 0).any(axis=0))])
    return ranks


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of t (values from 1 up) in order of their first 3 ** (depth + 1) values at least.

    Sampled triples are sorted and named, the string of names is ordered by the
    same function, the suffixes outside the cover are sorted by one value and a
    rank, and both lists are merged. Suffixes that agree on so long a prefix may
    come in any order, which ends the recursion for repetitive strings.
    """
    n = len(t)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), dtype=np.int64)
    padded = np.concatenate([t, np.zeros(3, dtype=t.dtype)]).astype(np.int64)
    ones, twos, zeros = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([ones, twos])
    key = _packed(padded[sample], padded[sample + 1], padded[sample + 2])
    order = np.argsort(key)
    fresh = np.concatenate([[True], np.diff(key[order]) != 0])
    names = np.empty(len(sample), dtype=np.int64)
    names[order] = np.cumsum(fresh)
    if depth > 0 and not fresh.all():
        # a zero keeps the triples at 1 modulo 3 apart from those at 2 modulo 3
        joined = np.concatenate([names[: len(ones)], [0], names[len(ones) :]]) + 1
        deeper = suffix_order(joined, depth - 1)
        deeper = deeper[deeper != len(ones)]
        order = np.where(deeper > len(ones), deeper - 1, deeper)
    ranked = sample[order]
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[ranked] = np.arange(1, len(ranked) + 1)
    rest = zeros[np.argsort(_packed(padded[zeros], rank[zeros + 1]))]
    s1, s2 = ranked[ranked % 3 == 1], ranked[ranked % 3 == 2]
    both = np.concatenate([s1, rest])
    key = _packed(padded[both], rank[both + 1])
    # ties at the depth's end may be out of order among themselves; a running maximum keeps places apart
    place = np.arange(len(rest)) + np.maximum.accumulate(np.searchsorted(key[: len(s1)], key[len(s1) :]))
    both = np.concatenate([s2, rest])
    key = _packed(padded[both], padded[both + 1], rank[both + 2])
    place = place + np.maximum.accumulate(np.searchsorted(key[: len(s2)], key[len(s2) :]))
    out = np.full(n, -1, dtype=np.int64)
    out[place] = rest
    out[out < 0] = ranked
    return out


def equal_windows(t: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A class number for each window t[start:start + length]; equal windows, equal numbers.

    Windows are put in suffix order and neighbours' prefixes compared value by value.
    """
    depth = 0
    while 3 ** (depth + 1) < length:
        depth += 1
    chosen = np.full(len(t), -1, dtype=np.int64)
    chosen[starts] = np.arange(len(starts))
    order = suffix_order(t, depth)
    picked = chosen[order]
    picked = picked[picked >= 0]
    at = starts[picked]
    same = np.ones(max(len(at) - 1, 0), dtype=bool)
    for k in range(0, length, 20):
        live = np.flatnonzero(same)
        if not len(live):
            break
        for j in range(k, min(k + 20, length)):
            live = live[t[at[live] + j] == t[at[live + 1] + j]]
        same = np.zeros_like(same)
        same[live] = True
    out = np.empty(len(starts), dtype=np.int64)
    out[picked] = np.concatenate([[0], np.cumsum(~same)]) if len(at) else []
    return out


def later_windows(bodies: pa.Array, length: int, rank: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether an equal window starts earlier in the block, for each window of each body.

    Earlier means in a body of lower rank, or of equal rank at a lower place;
    place is where a body starts.
    """
    data, offsets = text_bytes(bodies.cast(pa.large_binary()).view(pa.large_string()))
    size = np.diff(offsets)
    # a 1 after each body; bytes start at 2
    at = offsets[:-1] + np.arange(len(size))
    t = np.ones(len(data) + len(size), dtype=np.int64)
    t[ragged_take(at, size)] = data.astype(np.int64) + 2
    count = np.maximum(size - length + 1, 0)
    group = equal_windows(t, ragged_take(at, count), length)
    own = np.repeat(rank, count) << 40 | ragged_take(place, count)
    least = np.full(int(group.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, own)
    return own > least[group]
