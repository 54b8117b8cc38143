"""Vectorised character work on many whole texts at once: the texts of a slice are laid end to end as one array of code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x61C88647)


def slices(texts: list[str], chars: int = 400_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters together; a longer text is a range of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > chars:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str], pad: str = " ") -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each with the pad before and after it, and where each begins (one more for the end)."""
    joined = "".join(f"{pad}{t}{pad}" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    return codes, np.cumsum([0] + [len(t) + 2 * len(pad) for t in texts])


def ngrams(codes: np.ndarray, bounds: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order (ascending): bucket of each character n-gram that lies within a text, and the text it belongs to."""
    h, sizes = np.full(len(codes), 1, np.uint32), np.diff(bounds)
    inside = np.ones(len(codes), bool)
    for k in range(max(orders)):
        m = len(codes) - k
        if m <= 0:
            h = h[:0]
        else:
            h = (h[:m] ^ codes[k:]) * np.uint32(_MIX[k % len(_MIX)])
            h ^= h >> np.uint32(15)
            if k:
                cut = bounds[1:-1] - k
                inside[cut[cut >= 0]] = False
        if k + 1 in orders:
            at = inside[: len(h)]
            keep = (h * np.uint32(_MIX[0]) + np.uint32(k)) >> np.uint32(32 - bits)
            yield (keep if at.all() else keep[at]), np.repeat(np.arange(len(sizes)), np.maximum(sizes - k, 0))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
