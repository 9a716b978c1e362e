"""A priority queue of number records that spills sorted runs to files and merges them back block by block."""

from __future__ import annotations

import heapq
import os
import tempfile

import numpy as np

MEMORY = 200_000  # records held before a run is written
BLOCK = 4_096  # records of each run that are read at a time


class SpillingQueue:
    """Records are tuples of ``width`` integers and come out in ascending order.

    At most ``memory`` pushed records, plus one block of each run, are held.  Runs are unnamed files in ``folder``;
    they belong to one task attempt and vanish with it, so a repeated task starts from nothing.
    """

    def __init__(self, width: int, folder: str | None, memory: int = MEMORY):
        self.width, self.folder, self.memory = width, folder or os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None, memory
        self.heap: list[tuple[int, ...]] = []
        self.heads: list[tuple[tuple[int, ...], int]] = []  # first record of each run
        self.runs: list = []

    def push(self, record: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, record)
        if len(self.heap) > self.memory:
            self._spill()

    def _spill(self) -> None:
        file = tempfile.TemporaryFile(dir=self.folder)
        np.array(sorted(self.heap), np.int64).tofile(file)
        file.seek(0)
        self.heap = []
        self.runs.append(self._read(file))
        self._head(len(self.runs) - 1)

    def _read(self, file):
        with file:
            while len(block := np.fromfile(file, np.int64, BLOCK * self.width)):
                yield from map(tuple, block.reshape(-1, self.width).tolist())

    def _head(self, run: int) -> None:
        record = next(self.runs[run], None)
        if record is not None:
            heapq.heappush(self.heads, (record, run))

    def first(self) -> tuple[int, ...] | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple[int, ...]:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            record, run = heapq.heappop(self.heads)
            self._head(run)
            return record
        return heapq.heappop(self.heap)
