"""Suffix arrays of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray, stop: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse, and the common prefix of each suffix with the one before it in the array.

    ``stop``: for each place the end of its text, which no suffix goes beyond. Texts have no symbol in common, or
    ``most`` says after how many symbols (a power of two) the order and the prefixes may end. Groups of suffixes that
    are told apart already are left alone by the later doublings.
    """
    n = len(symbols)
    array = np.argsort(symbols, kind="stable")
    ordered = symbols[array]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[array] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, step = [rank.astype(np.int32)], 1
    alone = head & np.concatenate([head[1:], [True]])
    slots = np.flatnonzero(~alone)
    while len(slots) and not (most and step >= most):
        at = array[slots]
        ahead = at + step
        inside = ahead < stop[at]
        second = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        key = rank[at] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        array[slots] = at
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank = rank.copy()
        rank[at] = slots[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        levels.append(rank.astype(np.int32))
        step *= 2
        slots = slots[~(head & np.concatenate([head[1:], [True]]))]
    common = np.zeros(n + 1, np.int64)
    pairs = np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]]) + 1
    left, right = array[pairs - 1], array[pairs]
    shared = np.zeros(len(pairs), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + shared, right + shared
        inside = (a < stop[left]) & (b < stop[right])
        same = inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)])
        shared += same.astype(np.int64) << k
    common[pairs] = shared
    inverse = np.empty(n, np.int64)
    inverse[array] = np.arange(n)
    return array, inverse, common
