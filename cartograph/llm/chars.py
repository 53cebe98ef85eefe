"""Texts of an Arrow batch as one byte array, walked in chunks of bounded size."""

from __future__ import annotations

import numpy as np

CHUNK = 2_000_000


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets) of an Arrow string array; null counts as empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(column, size: int = CHUNK):
    """(first row, sub-array) of an Arrow string array: whole texts, about ``size`` bytes at a time."""
    _, offsets = bytes_of(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, column.slice(lo, hi - lo)
        lo = hi


def chunks(raw: np.ndarray, offsets: np.ndarray, overlap: int, size: int = CHUNK):
    """(bytes, document of each byte, bytes that start here) chunk by chunk, whatever the texts' lengths.

    A chunk repeats the next one's first ``overlap`` bytes, so that every run of
    ``overlap + 1`` bytes lies whole in the chunk in which it starts.
    """
    total = int(offsets[-1])
    for lo in range(0, total, size):
        own = min(size, total - lo)
        hi = min(lo + size + overlap, total)
        first = int(np.searchsorted(offsets, lo, side="right")) - 1
        last = int(np.searchsorted(offsets, hi, side="left"))
        inside = np.minimum(offsets[first + 1:last + 1], hi) - np.maximum(offsets[first:last], lo)
        doc = np.repeat(np.arange(first, last), inside)
        yield raw[lo:hi], doc, own
