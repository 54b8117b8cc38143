"""Double-array tries over phrases of words, built in bulk and walked for all positions of a text at once.

A word is a number, written as a fixed count of digits to base 256, so that a node has at most 256 children and rows of children interlock well. The
child of slot s by digit d is slot base[s] + d if check there names s. Level by level, all nodes of a level are told apart at once; rows with several
children are placed one by one, widest first, those with one child together into what is free.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BASE = 256


def digits_for(words: int) -> int:
    """Digits that numbers below ``words`` take."""
    n = 1
    while BASE**n < words:
        n += 1
    return n


@dataclass
class DoubleArray:
    base: np.ndarray  # int32; slot 0 is dead, slot 1 the root
    check: np.ndarray  # int32; -1 where no node is, so that nothing follows from slot 0
    leaf: np.ndarray  # int32: at the last slot of phrase i, i; else -1
    digits: int

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states one word further; dead (0) where no phrase goes on so. Words below 0 are unknown."""
        state = np.where(word < 0, 0, state)
        for k in range(self.digits - 1, -1, -1):
            slot = self.base[state] + ((word >> (8 * k)) & 255)
            state = np.where(self.check[slot] == state, slot, 0)
        return state


def build(phrases: np.ndarray, words: int, seed: int = 7) -> DoubleArray:
    """The trie of distinct phrases, given as a row of word numbers each."""
    digits = digits_for(max(words, 2))
    m, depth = phrases.shape
    spelt = np.stack([(phrases[:, j] >> (8 * k)) & 255 for j in range(depth) for k in range(digits - 1, -1, -1)], 1) if m else np.zeros((0, depth * digits), np.int64)
    order = np.lexsort(spelt.T[::-1])
    spelt = spelt[order]
    parent, parents, symbols = np.zeros(m, np.int64), [], []  # of each phrase its node of the last level; of each node its parent and digit
    begun = 1  # nodes so far; node 0 is the root
    for j in range(depth * digits):
        fresh = np.ones(m, bool)
        fresh[1:] = (spelt[1:, j] != spelt[:-1, j]) | (parent[1:] != parent[:-1])
        parents.append(parent[fresh])
        symbols.append(spelt[fresh, j])
        parent = begun + np.cumsum(fresh) - 1
        begun += int(fresh.sum())
    up = np.concatenate([[0], *parents]).astype(np.int64) if m else np.zeros(1, np.int64)
    by = np.concatenate([[0], *symbols]).astype(np.int64) if m else np.zeros(1, np.int64)
    kids = np.bincount(up[1:], minlength=begun)  # nodes of one parent are neighbours
    first = 1 + np.cumsum(kids) - kids
    place = np.zeros(begun, np.int64)
    room = 2
    while room < 2 * begun + 4 * BASE:
        room *= 2
    used, rng, end = np.zeros(room, bool), np.random.default_rng(seed), 2
    used[:2] = True
    several = np.flatnonzero(kids > 1)
    for node in several[np.argsort(-kids[several], kind="stable")].tolist():
        row = by[first[node] : first[node] + kids[node]]
        if end + BASE >= len(used):
            used = np.concatenate([used, np.zeros(len(used), bool)])
        tries = np.append(rng.integers(BASE, max(end, BASE + 1), 24 if len(row) < 24 else 0) - row[0], end)  # among what is there, else behind it
        tries = tries[tries >= 1]
        at = int(tries[np.argmax(~used[tries[:, None] + row].any(axis=1))])
        used[at + row] = True
        end = max(end, at + int(row[-1]) + 1)
        place[node] = at
    single = np.flatnonzero(kids == 1)
    symbol = by[first[single]]
    free = BASE + 1 + np.flatnonzero(~used[BASE + 1 :])  # high enough for any digit to leave a positive base
    if len(free) < len(single):
        free = np.concatenate([free, np.arange(len(used), len(used) + len(single) - len(free))])
    place[single] = free[: len(single)] - symbol
    slot = np.ones(begun, np.int64)
    slot[1:] = place[up[1:]] + by[1:]
    size = int(max(slot.max(initial=1), place.max(initial=0))) + BASE + 1
    base, check, leaf = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    base[slot], check[slot[1:]] = place, slot[up[1:]]
    if m:
        leaf[slot[parent]] = order
    return DoubleArray(base, check, leaf, digits)
