"""Suffix order by difference covers, vectorised: sampled triples are sorted and named, names are sorted by recursion,
the remaining suffixes are sorted by their first symbol and a sampled suffix, and both are merged by rank."""

from __future__ import annotations

import numpy as np


def _counts_below(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.searchsorted(sorted_keys, keys, "left")


def suffix_ranks(s: np.ndarray, need: int, unit: int = 1) -> np.ndarray:
    """For each suffix of ``s`` (positive integers) how many others are smaller.

    Suffixes count as equal if they share the symbols that stand for at least ``need`` places, of which each symbol of
    ``s`` stands for ``unit``; so recursion ends after log3(need) levels at most. Lengths up to 2**20 keep keys in 63 bits.
    """
    n = len(s)
    if n < 3:
        rest = [tuple(s[i:].tolist()) for i in range(n)]
        return np.array([sum(o < r for o in rest) for r in rest], np.int64)
    t = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.int64)
    width = int(t.max()) + 1
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    triples = (t[sample] * width + t[sample + 1]) * width + t[sample + 2]
    kinds, names = np.unique(triples, return_inverse=True)
    if len(kinds) < len(sample) and 3 * unit < need:
        below = suffix_ranks(np.concatenate([names[: len(one)] + 1, [0], names[len(one) :] + 1]), need, 3 * unit)
        names = np.concatenate([below[: len(one)], below[len(one) + 1 :]])
    # rank[i]: 1 + how many sampled suffixes are smaller; 0 behind the end
    rank = np.zeros(n + 3, np.int64)
    ordered = np.sort(names)
    below_own = _counts_below(ordered, names)
    rank[sample] = below_own + 1
    zero = np.arange(0, n, 3)
    size = n + 4
    short, long = t[zero] * size + rank[zero + 1], (t[zero] * width + t[zero + 1]) * size + rank[zero + 2]
    short_sorted = np.sort(short)
    one_keys, two_keys = t[one] * size + rank[one + 1], (t[two] * width + t[two + 1]) * size + rank[two + 2]
    out = np.empty(n, np.int64)
    out[one] = below_own[: len(one)] + _counts_below(short_sorted, one_keys)
    out[two] = below_own[len(one) :] + _counts_below(np.sort(long), two_keys)
    out[zero] = _counts_below(short_sorted, short) + _counts_below(np.sort(one_keys), short) + _counts_below(np.sort(two_keys), long)
    return out


def repeated_starts(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``starts`` (places of a byte array) begin a string of ``length`` bytes that another of them begins too.

    Strings run inside the array. Sorted suffixes that share a prefix are neighbours, so neighbours are compared.
    """
    out = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return out
    ranks = suffix_ranks(text.astype(np.int64) + 1, length)[starts]
    order = np.argsort(ranks, kind="stable")
    words = text.astype(np.uint64)
    for shift in (1, 2, 4):  # eight bytes from each place on
        words = words | (np.concatenate([words[shift:], np.zeros(shift, np.uint64)]) << np.uint64(8 * shift))
    a, b = starts[order[:-1]], starts[order[1:]]
    alive = np.arange(len(a))
    for at in [*range(0, length - 7, 8), length - 8]:
        alive = alive[words[a[alive] + at] == words[b[alive] + at]]
        if not len(alive):
            break
    out[order[alive]] = True
    out[order[alive + 1]] = True
    return out
