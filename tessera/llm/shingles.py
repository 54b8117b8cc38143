"""Sets of word shingles of whole texts, as 64-bit hashes, many texts at once."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240101)
_TABLE = _rng.integers(0, 1 << 64, 64 * 256, dtype=np.uint64)  # a random number for each byte at each place of a word
_ODD = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, text after text, each text's ascending; and where each text's begin (one more for the end).

    A-Z are lower-cased; words are runs without the six ASCII white-space characters; a text of fewer words than width is one shingle."""
    data = [(t or "").encode() for t in texts]
    raw = _LOWER[np.frombuffer(b"\n" + b"\n".join(data) + b"\n", np.uint8)]
    inside = ~_SPACE[raw]
    begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    bounds = 1 + np.cumsum([0] + [len(d) + 1 for d in data])
    place = np.arange(len(raw))
    if len(begins):
        place -= np.repeat(np.concatenate([[0], begins]), np.diff(np.concatenate([[0], begins, [len(raw)]])))
    value = _TABLE[((place & 63) << 8) + raw]
    far = place > 63
    if far.any():
        value[far] *= np.uint64(2) * (place[far] >> 6).astype(np.uint64) + np.uint64(1)
    value[~inside] = 0
    run = np.concatenate([[np.uint64(0)], np.cumsum(value)])
    word = mix(run[ends] - run[begins] + (ends - begins).astype(np.uint64))
    owner = np.searchsorted(bounds, begins, side="right") - 1
    words = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(words) - words
    n = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    starts = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(starts[-1]) - starts[doc] + first[doc]
    h = np.zeros(len(doc), np.uint64)
    used = np.minimum(words, width)[doc]
    for k in range(width):
        have = k < used
        part = word[np.minimum(at + k, max(len(word) - 1, 0))] * _ODD[k % 64] if len(word) else h
        h += np.where(have, part, np.uint64(0))
    h = mix(h + used.astype(np.uint64))
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(texts)))])
