"""Suffix arrays over word sequences by prefix doubling, in numpy.

``doubling`` sorts the suffixes of many sequences at once: a suffix ends with its own sequence, and only groups that are
still tied take part in the next round. ``neighbour_lcp`` reads common prefix lengths off the kept rounds.
"""

from __future__ import annotations

import numpy as np


def doubling(symbols: np.ndarray, ends: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks of each round) of ``symbols``; the suffix at p is symbols[p:ends[p]].

    ranks[k][p] is the place of the first suffix that agrees with p in its first 2**k symbols. Rounds stop when no two
    suffixes tie or 2**k reaches ``depth``; suffixes still tied then agree in at least ``depth`` symbols.
    """
    n = len(symbols)
    array = np.argsort(symbols, kind="stable")
    ranks = np.empty(n, np.int64)
    ordered = symbols[array]
    head = np.ones(n, bool)
    head[1:] = ordered[1:] != ordered[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    ranks[array] = first
    rounds, step = [ranks], 1
    tied = ~head
    tied[:-1] |= ~head[1:]
    active = np.flatnonzero(tied)                      # places in the array that are still in a group of several
    while len(active) and (depth is None or step < depth):
        suffix = array[active]
        further = suffix + step
        second = np.where(further < ends[suffix], ranks[np.minimum(further, n - 1)], -1)
        order = np.lexsort((second, ranks[suffix]))
        suffix, second = suffix[order], second[order]
        old = ranks[suffix]
        array[active] = suffix                          # a group's places are consecutive in ``active``
        new_head = np.ones(len(active), bool)
        new_head[1:] = (old[1:] != old[:-1]) | (second[1:] != second[:-1])
        place = np.maximum.accumulate(np.where(new_head, active, 0))
        ranks = ranks.copy()
        ranks[suffix] = place
        rounds.append(ranks)
        step *= 2
        tied = ~new_head
        tied[:-1] |= ~new_head[1:]
        active = active[tied]
    return array, rounds


def common_prefix(a: np.ndarray, b: np.ndarray, ends: np.ndarray, rounds: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, from the ranks of all rounds (run to the end)."""
    n = len(ends)
    length = np.zeros(len(a), np.int64)
    for level in range(len(rounds) - 1, -1, -1):
        x, y = a + length, b + length
        inside = (x < ends[a]) & (y < ends[b])
        same = inside & (rounds[level][np.minimum(x, n - 1)] == rounds[level][np.minimum(y, n - 1)])
        length += same.astype(np.int64) << level
    return length


def longest_repeats(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every position the longest common prefix of its suffix with any other suffix."""
    n = len(symbols)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    array, rounds = doubling(symbols, ends)
    pairs = np.flatnonzero(rounds[0][array[1:]] == rounds[0][array[:-1]])   # neighbours that share a first symbol
    left, right = array[pairs], array[pairs + 1]
    lcp = common_prefix(left, right, ends, rounds)
    np.maximum.at(best, left, lcp)
    np.maximum.at(best, right, lcp)
    return best
