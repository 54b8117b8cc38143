"""Words of many whole texts at once, straight from Arrow buffers: exact dictionary codes, without a Python object per text or word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(keep: str) -> np.ndarray:
    """Which of 256 bytes match the character class; bytes above 0x7F do as the class's characters above 0x7F."""
    import re

    out = np.ones(256, bool)
    out[:128] = [re.fullmatch(keep, chr(b)) is not None for b in range(128)]
    return out


@dataclass
class Words:
    codes: np.ndarray  # of each word its place in the dictionary
    dictionary: pa.StringArray
    counts: np.ndarray  # words of each text
    begins: np.ndarray  # first byte of each word
    data: np.ndarray  # the lower-cased bytes of all texts


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, text after text, null as empty; and where each text begins (one more for the end)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or bounds[0] == bounds[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.StringArray:
    """An Arrow array of strings that lie end to end in data."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    kind, width = (pa.string(), np.int32) if offsets[-1] < 2**31 else (pa.large_string(), np.int64)
    return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(np.ascontiguousarray(data))])


def words_of(column: pa.Array, inside: np.ndarray) -> Words:
    """Words (longest runs of bytes of the class ``inside``, A-Z lower-cased) of each text."""
    data, bounds = utf8(column)
    data = LOWER[data]
    at = inside[data]
    first, last = at.copy(), at.copy()
    first[1:] &= ~at[:-1]
    last[:-1] &= ~at[1:]
    edges = bounds[:-1][np.diff(bounds) > 0]  # a word ends where its text does
    first[edges] = at[edges]
    last[edges[1:] - 1] = at[edges[1:] - 1]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    found = strings(data[at], ends - begins).dictionary_encode()
    counts = np.diff(np.searchsorted(begins, bounds))
    return Words(found.indices.to_numpy(zero_copy_only=False), found.dictionary, counts, begins, data)


def row_slices(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``size`` bytes together; a longer text is a range of its own."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > size:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
