"""Hashed character n-grams of whole batches of texts."""

from __future__ import annotations

import numpy as np

from refloom.llm.text import U, mix

STEP = U(0x9E3779B97F4A7C15)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each character, offsets in characters) of UTF-8 texts; the number is the code point's bytes."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    codes = data[lead].astype(np.uint64)
    more = np.append(data, np.zeros(3, np.uint8))
    for step in (1, 2, 3):
        nxt = more[lead + step]
        tail = ((nxt & 0xC0) == 0x80) & (codes >= U(0x80)) & (np.append(lead[1:], len(data)) > lead + step)
        codes = np.where(tail, codes << U(8) | nxt.astype(np.uint64), codes)
    return codes, np.searchsorted(lead, offsets)


def ngram_slots(codes: np.ndarray, offsets: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(first character, slot) of every run of ``size`` characters inside one text."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(n, U(size))
    for k in range(size):
        h = h * STEP + codes[k : k + n]
    start = np.arange(n)
    last = np.repeat(offsets[1:], np.diff(offsets))[:n]
    start = start[start + size <= last]
    return start, (mix(h[start]) >> U(64 - bits)).astype(np.int64)
