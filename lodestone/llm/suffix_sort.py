"""Difference-cover suffix sorting in numpy, to a bounded depth.

Sampled positions (those not divisible by three) are sorted by their triples
and named; the names are sorted the same way until they are unique or stand
for at least ``depth`` symbols; the remaining suffixes are sorted by one symbol
and the rank that follows, and merged in.
"""

from __future__ import annotations

import numpy as np


def _order(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order of rows of non-negative integers, and dense ranks from 1."""
    key, room = columns[0].astype(np.uint64), 64 - int(columns[0].max(initial=0)).bit_length()
    for c in columns[1:]:
        bits = int(c.max(initial=0)).bit_length()
        if bits > room:  # too wide for one word: rank what there is
            order, rank = _order(key)
            key, room = rank.astype(np.uint64), 64 - len(key).bit_length()
        key = (key << np.uint64(bits)) | c.astype(np.uint64)
        room -= bits
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]]) if len(key) else 0
    return order, rank


def suffix_order(text: np.ndarray, depth: int, each: int = 1) -> np.ndarray:
    """Positions of ``text`` (integers from 1) in the order of their suffixes;
    suffixes with the same first ``depth // each`` symbols stand together.

    ``each`` is how many original symbols one symbol here stands for.
    """
    n = len(text)
    if n < 4 or each >= depth:
        # Short, or each symbol already stands for enough.
        padded = np.concatenate([text, np.zeros(3, np.int64)])
        return _order(*(padded[k : n + k] for k in range(min(3, max(n, 1)))))[0] if n else np.zeros(0, np.int64)
    s = np.concatenate([text, np.zeros(3, np.int64)]).astype(np.int64)
    one, two, zero = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    order, name = _order(s[sample], s[sample + 1], s[sample + 2])
    if name.max() < len(sample) and 3 * each < depth:
        # The sampled suffixes of one residue after those of the other.
        order = suffix_order(name, depth, 3 * each)
        name = np.empty(len(sample), np.int64)
        name[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = name
    first = order < len(one)
    by_one, by_two = sample[order[first]], sample[order[~first]]
    by_one, by_two = by_one[by_one < n], by_two[by_two < n]
    zero_order = _order(s[zero], rank[zero + 1])[0]
    zero = zero[zero_order]
    wide = np.int64(int(rank.max()) + 1)
    high = np.int64(int(s.max()) + 1)
    below = np.searchsorted(s[by_one] * wide + rank[by_one + 1], s[zero] * wide + rank[zero + 1], side="left")
    below = below + np.searchsorted((s[by_two] * high + s[by_two + 1]) * wide + rank[by_two + 2], (s[zero] * high + s[zero + 1]) * wide + rank[zero + 2], side="left")
    out = np.empty(n, np.int64)
    # Suffixes alike to the full depth may come in any order among themselves.
    at = np.maximum.accumulate(below) + np.arange(len(zero))
    out[at] = zero
    rest = np.ones(n, bool)
    rest[at] = False
    merged = sample[order]
    out[rest] = merged[merged < n]
    return out


def equal_prefixes(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Number of the class of each start: two have the same number exactly if
    the ``depth`` bytes from them on are the same.

    ``text`` are bytes; at least ``depth`` follow each start. The suffixes are
    sorted and each is compared with the one before it, byte by byte.
    """
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = suffix_order(text.astype(np.int64) + 1, depth)
    order = order[wanted[order]]
    # Eight bytes at a time; the last word overlaps the one before it.
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    same = np.ones(max(0, len(order) - 1), bool)
    for k in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        word = np.ascontiguousarray(words[order + k]).view("<u8").ravel()
        same &= word[1:] == word[:-1]
    number = np.empty(len(text), np.int64)
    number[order] = np.cumsum(np.r_[True, ~same]) - 1 if len(order) else 0
    return number[starts]
