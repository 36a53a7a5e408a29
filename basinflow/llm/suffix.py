"""Suffix arrays over integer sequences by prefix doubling, with longest common prefixes of neighbours."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the suffixes' starts in lexical order; lcp[i] is the common prefix of suffixes order[i - 1] and order[i].

    Ranks of doubled lengths are kept until all differ; the prefixes are then measured from the longest length down.
    """
    n = len(symbols)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return np.arange(n), lcp
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    ranks, length = [rank], 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - length)] = rank[length:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        if new[order[-1]] == n - 1:
            break
        rank = new
        length *= 2
        ranks.append(rank)
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        step, table = 1 << level, np.append(ranks[level], -1)
        inside = (left + step <= n) & (right + step <= n)
        same = inside & (table[np.minimum(left, n)] == table[np.minimum(right, n)])
        common[same] += step
        left[same] += step
        right[same] += step
    lcp[1:] = common
    return order, lcp


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each position, the length of its longest substring found elsewhere too: the value of the deepest
    longest-common-prefix interval that holds the position's suffix."""
    order, lcp = suffix_array(symbols)
    longest = np.zeros(len(symbols), np.int64)
    if len(symbols):
        longest[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Positions inside a repeated substring of at least so many symbols: the union of the repeats' spans."""
    n = len(longest)
    marks = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(longest >= least)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + longest[starts], -1)
    return np.cumsum(marks)[:n] > 0
