"""Vectorised access to Arrow text columns inside a task.

All helpers work on one bounded slice of a record batch at a time; Spark partitions the
work.  ``slices`` cuts a batch so that a slice holds at most ``max_bytes`` of text (one row
at least, so a single very long text is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column as ``large_string`` with nulls turned into empty texts."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return col.fill_null("") if col.null_count else col


def slices(batch: pa.RecordBatch, name: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive zero-copy slices of ``batch`` of at most ``max_bytes`` of text, one row at least."""
    if batch.num_rows == 0:
        return
    col = text_column(batch, name)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64, count=col.offset + len(col) + 1)[col.offset :]
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offs, offs[start] + max_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield batch.slice(start, stop - start)
        start = stop


def given_back() -> None:
    """Memory that Arrow holds for later batches goes back, before the process serves another task."""
    pa.default_memory_pool().release_unused()


def buffer_of(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the ``n + 1`` offsets of the rows in them."""
    col = text_column(batch, name)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64, count=col.offset + len(col) + 1)[col.offset :]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``concatenate([arange(s, s + n) for s, n in zip(starts, lengths)])`` without a loop."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def distinct_pieces(raw: np.ndarray, cuts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Distinct byte strings between consecutive ``cuts``, and for each string its number."""
    if len(cuts) < 2:
        return [], np.zeros(0, np.int64)
    arr = pa.Array.from_buffers(
        pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts, dtype=np.int64)), pa.py_buffer(raw)]
    ).dictionary_encode()
    return arr.dictionary.to_pylist(), arr.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def space_cuts(raw: np.ndarray, offs: np.ndarray, only_space: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Cut every text before each run of white space that follows something else.

    Returns ``(cuts, first)``: byte positions of all cuts (starts of pieces, and the end), and
    for each text the number of its first piece (``n + 1`` values).  Pieces are
    ``[white space]*[other]*``.  A cut is made only before an ASCII space (or line feed unless
    ``only_space``), and never where the byte before may end a Unicode white space.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(len(offs), np.int64)
    here = raw == 0x20
    if not only_space:
        here |= raw == 0x0A
    prev = np.empty(n, np.uint8)
    prev[0], prev[1:] = 0x20, raw[:-1]
    if only_space:
        blank = prev == 0x20
    else:
        blank = (prev == 0x20) | ((prev >= 0x09) & (prev <= 0x0D)) | ((prev >= 0x1C) & (prev <= 0x1F))
        cand = np.flatnonzero(here & (prev >= 0x80))
        if len(cand):
            before = raw[np.maximum(cand - 2, 0)]
            blank[cand[np.isin(before, np.array([0xC2, 0x9A, 0x80, 0x81], np.uint8))]] = True
    mark = here & ~blank
    nonempty = offs[1:] > offs[:-1]
    mark[offs[:-1][nonempty]] = True
    starts = np.flatnonzero(mark)
    first = np.searchsorted(starts, offs)
    return np.append(starts, n), first
