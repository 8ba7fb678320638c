"""Flat byte views of Arrow string columns, for the operators that scan whole texts with numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts are scanned in runs of about so many bytes: temporary arrays stay in cache and memory stays bounded.
RUN_BYTES = 1 << 20


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z become a-z; all other bytes stay."""
    return buf + ((buf - np.uint8(65) < 26).view(np.uint8) << 5)


def runs(column: pa.Array, run_bytes: int = RUN_BYTES, run_texts: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first, last, bytes, offsets) of a string column, each of about ``run_bytes`` or a single longer text, and of at most ``run_texts`` texts.

    ``offsets`` has last - first + 1 entries into ``bytes``. A null counts as an empty text.
    """
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + run_bytes, side="right")) - 1
        last = min(max(last, first + 1), n, n if run_texts is None else first + run_texts)
        low, high = int(offsets[first]), int(offsets[last])
        yield first, last, data[low:high], offsets[first : last + 1] - low
        first = last


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, none across texts, and each text's first word index.

    ``is_word`` is a flag per byte; the third array has an entry more than there are texts.
    """
    n = len(is_word)
    if not n:
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    edges = offsets[1:-1]
    before[edges[edges < n]] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def release() -> None:
    """Gives freed memory back to the system: workers are used again, and what one stage held is not the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # another C library: it frees by itself, or not


def kept_rows(documents: DataFrame, keep: Callable[[np.ndarray, np.ndarray], np.ndarray], run_texts: int | None = None) -> DataFrame:
    """The rows of a table for whose text ``keep`` holds, all columns as they are; runs of texts are judged as they are read."""
    at = documents.columns.index("text")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = [keep(buf, offsets) for _, _, buf, offsets in runs(batch.column(at), run_texts=run_texts)]
            if flags:
                yield batch.filter(pa.array(np.concatenate(flags)))
        release()

    return documents.mapInArrow(judged, documents.schema)


class RollingHash:
    """64-bit polynomial hashes of any byte ranges of a buffer, from one prefix sum."""

    BASE = 0x9E3779B97F4A7C15 | 1
    INVERSE = pow(BASE, -1, 1 << 64)
    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._powers) < n:
            size = max(n, RUN_BYTES + 1)
            for name, base in (("_powers", cls.BASE), ("_inverse", cls.INVERSE)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(cls, name, np.multiply.accumulate(table))

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self._grow(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self._powers[:n], out=self.prefix[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self._inverse[starts])


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads all bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
