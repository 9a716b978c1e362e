"""Benchmark decontamination by templates.

Words are canonicalised: numbers, units after a number and names (capitalised words inside a sentence) become typed
placeholders, other words lose their case and outer punctuation.  Windows of ``window`` template words of documents
and benchmark items are joined by hash.  Matching windows on one diagonal (document place less item place) are put
together, and the values in their slots must be consistent: each value of the item stands for one and the same value
of the document wherever it occurs (two values may become equal).  So a question whose numbers and names were changed is found as well as a copy.

Windows of plain words (in lower case, without outer punctuation, values kept) are joined in the same way.  They count
whatever they consist of and whether or not the template windows on their diagonal are consistent.

An item is leaked by a document if consistent windows cover ``least`` of its words, or a ``share`` of them.

Before the join a bitmap of the benchmark's window hashes, of a fixed size, drops windows that cannot match; it may
keep too many, never too few.  The benchmark's windows are broadcast only if they were measured to be small.

Nulls and ties: a null text has no words; items with fewer than ``fewest`` words are not searched for, shorter windows
than ``window`` are whole items; template windows with less than half of literal words count for nothing; rows that repeat a
doc_id are told apart by a hash of the text; an item_id that occurs twice is leaked if either text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.text import BASE, LOWER, U, Words, buffer, in_small_batches, mix, pieces
from refloom.plans.runtime import cut

BITMAP = 22
#: units of measure, each after a number or written with it
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces ml l cl litre litres liter liters gallon gallons "
    "s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents percent degree degrees kmh mph watt watts volt volts byte bytes kb mb gb people items pieces"
).split()
OUTER = np.isin(np.arange(256), list(b".,;:!?\"'()[]{}$%+-"))
NUMERIC = np.isin(np.arange(256), list(b"0123456789.,/"))
DIGIT = np.isin(np.arange(256), list(b"0123456789"))
NUMBER, UNIT, NAME, MEASURE = mix(np.arange(1, 5, dtype=np.uint64))
_unit_words = Words(*buffer(pa.array([" ".join(UNITS)])))
_UNIT_HASHES = np.sort(_unit_words.hashes())


def _strip(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words without outer punctuation; words of punctuation only are taken as they are."""
    start, end = words.start.copy(), words.end.copy()
    while True:
        move = (end > start) & OUTER[data[np.minimum(start, len(data) - 1)]]
        if not move.any():
            break
        start += move
    while True:
        move = (end > start) & OUTER[data[end - 1]]
        if not move.any():
            break
        end -= move
    bare = end <= start
    return np.where(bare, words.start, start), np.where(bare, words.end, end)


def plain(column: pa.Array) -> np.ndarray:
    """Code of each word by its letters, whatever their case."""
    data, offsets = buffer(pc.replace_substring(pc.utf8_lower(column), "ß", "ss"))
    words = Words(data, offsets)
    return words.hashes(*_strip(data, words)) if len(words) else np.zeros(0, np.uint64)


def templates(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, template code of each word, value of each slot or 0)."""
    data, offsets = buffer(column)
    words = Words(data, offsets)
    n = len(words)
    if n == 0:
        return words, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    start, end = _strip(data, words)
    lowered = Words(LOWER[data], offsets)
    code = lowered.hashes(start, end)
    sums = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    within = lambda total: total[end] - total[start]
    digits, numeric = within(sums(DIGIT[data])), within(sums(NUMERIC[data]))
    number = (digits > 0) & (numeric == end - start)
    measure = np.zeros(n, bool)
    for i in np.flatnonzero((digits > 0) & ~number & DIGIT[data[start]]).tolist():
        text = data[start[i] : end[i]].tobytes().lower()
        measure[i] = text.lstrip(b"0123456789.,/").decode("utf-8", "ignore") in UNITS
    first = np.zeros(n, bool)
    first[words.at[:-1][words.count > 0]] = True
    at = np.minimum(np.searchsorted(_UNIT_HASHES, code), len(_UNIT_HASHES) - 1)
    unit = (_UNIT_HASHES[at] == code) & np.concatenate([[False], number[:-1]]) & ~first
    head = data[start]
    second = data[np.minimum(start + 1, len(data) - 1)]
    upper = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
    ended = np.concatenate([[True], np.isin(data[words.end[:-1] - 1], list(b".!?:"))])
    lines = sums(data == 10)
    broken = np.concatenate([[True], lines[words.start[1:]] > lines[words.end[:-1]]])
    name = upper & ~number & ~measure & ~unit & ~ended & ~broken & ~first
    value = np.where(number | measure | unit | name, code, U(0))
    for kind, mark in ((number, NUMBER), (measure, MEASURE), (unit, UNIT), (name, NAME)):
        code = np.where(kind, mark, code)
    return words, code, value


def _windows(column: pa.Array, sizes: list[int], whole_only: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, text, place, size, plain or not, hash of each window, slot values of all words); sizes below ``whole_only`` are whole texts' only.

    Windows without slots are plain only: as templates they would be the same.
    """
    words, code, value = templates(column)
    found = []
    literal = np.concatenate([[0], np.cumsum(value == 0)])
    for exact, codes in ((False, code), (True, plain(column))):
        for size in sizes:
            start, hashes = words.windows(codes, size)
            literals = literal[start + size] - literal[start]
            start_ok = np.ones(len(start), bool) if exact else (2 * literals >= size) & (literals < size)
            if whole_only > size:
                start_ok &= words.count[words.doc[start]] == size
            start, hashes = start[start_ok], hashes[start_ok]
            found.append((start, np.full(len(start), size), np.full(len(start), exact), mix(hashes + U((2 * size + exact) * int(BASE) % (1 << 64)))))
    start, size, exact, hashes = (np.concatenate(p) for p in zip(*found))
    text = words.doc[start]
    return words, text, start - words.at[text], size, exact, hashes, value


def _rows(column: pa.Array, own: list[pa.Array], names: list[str], sizes: list[int], whole_only: int, bitmap: np.ndarray | None) -> pa.RecordBatch:
    words, text, place, size, exact, hashes, value = _windows(column, sizes, whole_only)
    if bitmap is not None:
        slot = (hashes >> U(64 - BITMAP)).astype(np.int64)
        keep = (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64) & U(1)).astype(bool)
        text, place, size, exact, hashes = text[keep], place[keep], size[keep], exact[keep], hashes[keep]
    first = words.at[text] + place
    slots = np.where(exact, 0, size)  # values that are part of the hash need no comparison
    ends = np.concatenate([[0], np.cumsum(slots)])
    flat = value[np.repeat(first - ends[:-1], slots) + np.arange(ends[-1])] if len(first) else np.zeros(0, np.uint64)
    slots = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))
    take = pa.array(text)
    return pa.RecordBatch.from_arrays([*(c.take(take) for c in own), pa.array(hashes.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(exact), pa.array(words.count[text].astype(np.int32)), slots], [*names, "h", "place", "size", "exact", "n", "slots"])


_WINDOW = "h long, place int, size int, exact boolean, n int, slots array<long>"


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 8, least: int = 13, share: float = 0.5, fewest: int = 4) -> DataFrame:
    """(doc_id, _text_id, item_id) of every leaked item; _text_id is xxhash64 of the text."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield _rows(batch.column("text"), [batch.column("item_id")], ["item_id"], list(range(min(fewest, window), window + 1)), window, None)

    kind = benchmark.schema["item_id"].dataType.simpleString()
    known = cut(benchmark.select("item_id", "text").mapInArrow(items, f"item_id {kind}, {_WINDOW}").distinct())
    sizes = sorted(r[0] for r in known.df.select("size").distinct().collect())  # at most ``window`` rows
    slot = F.shiftrightunsigned("h", 64 - BITMAP)
    words = known.df.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITMAP}) & 63 as int))")).alias("bits")).collect()
    bitmap = np.zeros(1 << (BITMAP - 6), np.uint64)  # of a fixed size, whatever the benchmark's
    for r in words:
        bitmap[r.w] = U(r.bits % (1 << 64))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            if sizes:
                yield _rows(batch.column("text"), [batch.column("doc_id"), batch.column("_text_id")], ["doc_id", "_text_id"], sizes, 0, shared.value)

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = in_small_batches(docs).select("doc_id", F.xxhash64("text").alias("_text_id"), "text")
    found = source.mapInArrow(probes, f"doc_id {kind}, _text_id long, {_WINDOW}").select("doc_id", "_text_id", "h", "size", "exact", F.col("place").alias("_at"), F.col("slots").alias("_own"))
    pairs = found.join(known.hinted(), ["h", "size", "exact"])
    slots = F.filter(F.arrays_zip("slots", "_own"), lambda s: s["slots"] != 0)
    rows = pairs.select("doc_id", "_text_id", "item_id", "n", (F.col("_at") - F.col("place")).alias("_shift"), "place", "size", "exact", slots.alias("_slots"))
    places = lambda exact: F.collect_set(F.when(F.col("exact") == F.lit(exact), F.struct("place", "size")))
    groups = rows.groupBy("doc_id", "_text_id", "item_id", "n", "_shift").agg(places(True).alias("_plain"), places(False).alias("_changed"), F.flatten(F.collect_set("_slots")).alias("_slots"))  # bounded by the item
    consistent = F.size(F.array_distinct(F.transform("_slots", lambda s: s["slots"]))) == F.size(F.array_distinct("_slots"))
    counted = F.when(consistent, F.concat("_plain", "_changed")).otherwise(F.col("_plain"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(counted, lambda p: F.sequence(p["place"], p["place"] + p["size"] - 1)))))
    return groups.where((covered > 0) & ((covered >= least) | (covered >= F.lit(share) * F.col("n")))).select("doc_id", "_text_id", "item_id").distinct()


def _found(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    each = leaks(docs, benchmark, **options).groupBy("doc_id", "_text_id").agg(F.sort_array(F.collect_set("item_id")).alias("_items"))
    each = each.select(F.col("doc_id").alias("_doc"), F.col("_text_id").alias("_id"), "_items")
    return cut(each).hinted()


def _same(text_id: Column) -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_doc")) & (text_id == F.col("_id"))


def mark(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, contaminated, item_ids) of every document; item_ids in ascending order."""
    found = _found(docs, benchmark, **options)
    rows = docs.select("doc_id", F.xxhash64("text").alias("_row")).join(found, _same(F.col("_row")), "left")
    return rows.select("doc_id", F.col("_items").isNotNull().alias("contaminated"), F.coalesce("_items", F.array().cast(found.schema["_items"].dataType)).alias("item_ids"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that leak no item, with their own columns."""
    found = _found(docs, benchmark, **options)
    # each frame's own columns, as the documents may have any names
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_doc"]) & (F.xxhash64(docs["text"]) == found["_id"]), "left_anti")
