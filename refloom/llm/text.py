"""Whole-batch views of text columns: words, lines and their hashes as numpy arrays.

A batch of texts is one byte buffer with offsets.  Every function below works on that buffer at once, so the
cost of a text is its bytes, and the memory is bounded by ``PIECE`` bytes (or by one text, if that is longer).
A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

PIECE = 1 << 19
BATCH = "8m"  # of Arrow data that a task holds at a time
U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, as all batches use the same."""
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        size = max(PIECE + 1024, n)
        got = np.full(size, base, dtype=np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if size > 8 * PIECE:  # of one huge text: not kept
            return got
        _powers[int(base)] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same data; its session passes at most BATCH bytes to Python workers at a time, whatever the rows' length."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return df


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text (or one row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    if data is None or len(wide) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(wide) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch: ``start``/``end`` byte positions, ``at[d]:at[d+1]`` the words of text d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = data = LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        solid = ~SPACE[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        self.start = np.flatnonzero(solid & (first[:n] | np.concatenate([[True], ~solid[:-1]]))) if n else np.zeros(0, np.int64)
        self.end = np.flatnonzero(solid & (first[1:] | np.concatenate([~solid[1:], [True]]))) + 1 if n else np.zeros(0, np.int64)
        self.solid = solid
        self.at = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.at)
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def doc(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each word, or of any byte ranges."""
        if self._sums is None:
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(BYTE[self.data] * powers(BASE, len(self.data)), out=sums[1:])
            self._sums = sums
        start, end = (self.start, self.end) if start is None else (start, end)
        return mix((self._sums[end] - self._sums[start]) * powers(INVERSE, len(self.data) + 1)[start] + (end - start).astype(np.uint64))

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``size`` words inside one text."""
        n = len(hashes)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers(BASE, n), out=sums[1:])
        start = np.arange(n - size + 1)
        last = np.repeat(self.at[1:], self.count)[: len(start)]
        start = start[start + size <= last]
        return start, mix((sums[start + size] - sums[start]) * powers(INVERSE, n + 1)[start])

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[self.offsets])

    def per_doc_words(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per word over each text."""
        sums = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
        np.cumsum(values, out=sums[1:])
        return np.diff(sums[self.at])


def covered(start: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n positions lie in one of the runs [start, start + size)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + size, -1)
    return np.cumsum(step[:n]) > 0
