"""Hierarchical packing of documents into sequences of several context sizes.

A document of at least ``window`` tokens fills whole windows with its first tokens.  What is left of it is routed to the tier
of the smallest context size that holds it.  Tiers are packed from the longest to the shortest: windows of a tier start with
its own pieces, the gap behind them takes the longest piece of a shorter tier that fits, again and again, and only where none
fits a longer piece is cut.  Every window of a tier is full, so at most one sequence of the whole dataset, the last, has
padding.  Sequences are numbered from the longest context size to the shortest and dealt to step groups in turn, so groups
differ by at most one sequence of each size.

Pieces of one length are alike, so the driver packs the histogram of lengths (at most ``window`` counts, whatever the number
of documents) into slots, and each document finds its slots by its length and its number among the documents of that length.
Tokens never move but for one checkpoint of two or four bytes each.

Nulls and ties: a null text is empty and holds the end token alone; documents of equal length are numbered by the place of
their row; repeated rows and null ids are documents of their own; an empty table gives no pieces.  Only the key and the text
are read, so other columns may have any name.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.bpe import byte_symbols, share
from refloom.llm.text import LOWER, SPACE, buffer, in_small_batches, pieces
from refloom.plans.runtime import cut

WINDOW = 2_048
LEAST = 256  # the shortest tier
STEP = 1 << 19  # tokens of a step group
REMEMBER = 64 << 20  # bytes of words and of their ids that a worker process keeps
# kinds of bytes: 0 white space, 1 other, 2 one of the stops below, 3 ASCII letter or digit
KIND = np.ones(256, np.uint8)
KIND[SPACE] = 0
KIND[list(b",.;:!?")] = 2
KIND[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = 3
BREAK = np.zeros(16, bool)  # kinds of two bytes in a row (4 * first + second) between which a word starts or ends
BREAK[[0, 1, 2, 3, 4, 8, 12, 2 * 4 + 3, 3 * 4 + 2]] = True
LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
# each such letter beyond ASCII as the vocabulary writes its two bytes
SYMBOLS = {c: "".join(byte_symbols()[b] for b in chr(c).encode("utf-8")) for c in range(0xDF, 0x100)}


@dataclass
class Lot:
    """Pieces of one length: what is left from ``start`` on of the documents numbered ``low`` to ``high`` of a remainder."""

    remainder: int
    low: int
    high: int
    start: int


@dataclass
class Plan:
    """Slots as rows (remainder, low, high, start, length, sequence, offset, tier)."""

    window: int
    full: int = 0
    sequences: int = 0
    tokens: int = 0  # of all windows, for the number of step groups
    slots: list[tuple[int, ...]] = field(default_factory=list)

    def groups(self, step: int) -> int:
        return max(1, -(-self.tokens // step))


class _Stock:
    def __init__(self, counts: dict[int, int], window: int):
        self.count = np.zeros(window + 1, np.int64)
        self.lots: dict[int, list[Lot]] = {}
        for length, n in counts.items():
            self.put(length, Lot(length, 0, n, 0))

    def put(self, length: int, lot: Lot) -> None:
        self.lots.setdefault(length, []).append(lot)
        self.count[length] += lot.high - lot.low

    def take(self, length: int, most: int) -> list[Lot]:
        out = []
        while most:
            lot = self.lots[length][-1]
            n = min(most, lot.high - lot.low)
            out.append(Lot(lot.remainder, lot.low, lot.low + n, lot.start))
            lot.low += n
            if lot.low == lot.high:
                self.lots[length].pop()
            self.count[length] -= n
            most -= n
        return out

    def tokens(self) -> int:
        return int((self.count * np.arange(len(self.count))).sum())

    def longest(self, most: int) -> int:
        """The longest length of at most ``most`` in stock, 0 if none."""
        found = np.flatnonzero(self.count[1 : most + 1])
        return int(found[-1]) + 1 if len(found) else 0

    def shortest(self, least: int) -> int:
        found = np.flatnonzero(self.count[least:])
        return int(found[0]) + least if len(found) else 0


def plan(counts: dict[int, int], full: int, window: int = WINDOW, least: int = LEAST) -> Plan:
    """Slots for ``counts`` pieces of each length under ``window``, after ``full`` whole windows."""
    out = Plan(window, full, full, full * window)
    stock = _Stock(counts, window)

    def place(lots: list[Lot], length: int, sequence: int, offset: int, tier: int) -> None:
        for lot in lots:
            out.slots.append((lot.remainder, lot.low, lot.high, lot.start, length, sequence, offset, tier))
            sequence += lot.high - lot.low

    def part(length: int, size: int, n: int) -> tuple[list[Lot], int]:
        """n pieces of ``size`` tokens cut off pieces of ``length``; the rest goes back to the stock."""
        lots = stock.take(length, n)
        for lot in lots:
            stock.put(length - size, Lot(lot.remainder, lot.low, lot.high, lot.start + size))
        return lots, n

    def fill(sequence: int, n: int, offset: int, tier: int) -> None:
        todo = [(sequence, n, offset)]
        while todo:
            sequence, n, offset = todo.pop()
            gap = tier - offset
            if not gap:
                continue
            length = stock.longest(gap)
            if length:
                k = min(n, int(stock.count[length]))
                lots = stock.take(length, k)
            else:
                source = stock.shortest(gap + 1)
                length, k = gap, min(n, int(stock.count[source]))
                lots, _ = part(source, gap, k)
            place(lots, length, sequence, offset, tier)
            if k < n:
                todo.append((sequence + k, n - k, offset))
            todo.append((sequence, k, offset + length))

    tier = window
    while tier >= least:
        lowest = 1 if tier // 2 < least else tier // 2 + 1
        while (length := stock.longest(window)) >= lowest and stock.tokens() >= tier:
            # as many windows as all tokens that are left can fill
            n = min(int(stock.count[length]), stock.tokens() // tier)
            head = min(length, tier)
            lots = stock.take(length, n) if head == length else part(length, head, n)[0]
            place(lots, head, out.sequences, 0, tier)
            out.sequences += n
            out.tokens += n * tier
            fill(out.sequences - n, n, head, tier)
        tier //= 2
    offset = 0
    while length := stock.longest(window):  # less than the shortest tier
        lots = stock.take(length, 1)
        place(lots, length, out.sequences, offset, least)
        offset += length
    if offset:
        out.sequences += 1
        out.tokens += window
    return out


class Encoder:
    """The tokenizers library, asked once for each distinct word.

    A word is cut at ASCII white space, and where one of ``, . ; : ! ?`` meets an ASCII letter or digit: the vocabulary's normalizer and
    splitter never join what stands on both sides of such a place.  ASCII letters are looked up in lower case, as the normalizer makes
    them, unless a mark that could join them follows somewhere.  Words of lower-case Latin letters alone pass the normalizer and the splitter
    unchanged, so they go to the library's model at once.  Texts that may hold an added token go to the library whole.  Words are kept
    from task to task within REMEMBER bytes.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.type = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.binary())
        self.flat, self.starts = np.zeros(0, self.type), np.zeros(1, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: pa.Array) -> None:
        texts = words.cast(pa.string()).to_pylist()
        tokens = self.model.tokenize
        found: list = [[t.id for t in tokens(w.translate(SYMBOLS))] if LATIN.fullmatch(w) else None for w in texts]
        other = [i for i, f in enumerate(found) if f is None]
        for i, ids in zip(other, self._ids([texts[i] for i in other])):
            found[i] = ids
        ends = np.cumsum([len(f) for f in found]) + self.starts[-1]
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), self.type, int(ends[-1] - self.starts[-1]))])
        self.known = pa.concat_arrays([self.known, words])
        self.starts = np.concatenate([self.starts, ends])

    def _slots(self, distinct: pa.Array) -> np.ndarray:
        if self.known.nbytes + self.flat.nbytes + self.starts.nbytes > REMEMBER:
            self.forget()
        slot = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            slot[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn(distinct.take(pa.array(new)))
        return slot

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        whole = pc.fill_null(pc.match_substring(column, "<|"), False)
        data, offsets = buffer(pc.if_else(whole, "", column))
        start, end, solid = _words(data, offsets)
        sizes = end - start
        letters = LOWER[data]
        if (data - 0xCC <= 1).any():  # lead bytes of combining marks, with which letters of one case alone may join
            wide = np.zeros(len(data) + 1, np.int64)
            np.cumsum(data >= 128, out=wide[1:])
            letters = np.where(np.repeat(wide[end] > wide[start], sizes), data[solid], letters[solid])
        else:
            letters = letters[solid]
        places = np.zeros(len(start) + 1, np.int32)
        np.cumsum(sizes, out=places[1:])
        coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(letters)]).dictionary_encode()
        slot = self._slots(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        first = self.starts[slot]
        counts = self.starts[slot + 1] - first
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(first - ends + counts, counts) + np.arange(total)]
        at = np.concatenate([[0], ends])[np.searchsorted(start, offsets)]
        out = [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self._ids([column[i].as_py()])[0], self.type)
        return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte positions where words start and end, and which bytes lie in words."""
    n = len(data)
    kind = KIND[data]
    begins = np.zeros(n + 1, bool)
    begins[1:n] = BREAK[kind[:-1] * 4 + kind[1:]]
    begins[offsets] = True
    begins[0] = begins[n] = True
    solid = kind > 0
    return np.flatnonzero(solid & begins[:n]), np.flatnonzero(solid & begins[1:]) + 1, solid


_encoders: dict[str, Encoder] = {}


def load(file: str) -> Encoder:
    if file not in _encoders:
        _encoders[file] = Encoder(file if "/" in file else SparkFiles.get(file))
    return _encoders[file]


def tokenized(docs: DataFrame, path: str, key: str = "doc_id", end: int = 1, window: int = WINDOW) -> DataFrame:
    """key, ids (bytes) with ``end`` behind them, tokens, wide (ids of four bytes) and the row's numbers in its partition:
    ``before`` whole windows, and ``rank`` earlier documents that leave as many tokens over."""
    file = share(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(file)
        part, full, seen = TaskContext.get().partitionId(), 0, np.zeros(window, np.int64)
        for batch in pieces(batches, most=1 << 23):
            ids = [np.append(x, encoder.type(end)) for x in encoder.encode(batch.column("text").cast(pa.string()))]
            before, rank = [], []
            for x in ids:
                over = len(x) % window
                before.append(full)
                rank.append(int(seen[over]))
                full += len(x) // window
                seen[over] += 1
            n = len(ids)
            wide = pa.array(np.full(n, encoder.type is np.uint32))
            tokens = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array([x.tobytes() for x in ids], pa.binary()), tokens, wide, pa.array(np.full(n, part), pa.int64()), pa.array(before, pa.int64()), pa.array(rank, pa.int64())],
                names=["key", "ids", "tokens", "wide", "part", "before", "rank"],
            )

    return in_small_batches(docs).select(key, "text").mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, ids binary, tokens long, wide boolean, part long, before long, rank long")


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", end: int = 1, window: int = WINDOW, least: int = LEAST, step: int = STEP) -> DataFrame:
    """One row a piece: key, start, length, ids (little-endian, four bytes each), doc_tokens, sequence_id, offset, tier, step_group."""
    rows = cut(tokenized(docs, path, key, end, window)).df
    over = (F.col("tokens") % window).alias("over")
    counts = rows.groupBy("part", over).agg(F.count(F.lit(1)).alias("n")).where("over > 0")
    whole = rows.groupBy("part").agg(F.sum(F.floor(F.col("tokens") / window)).alias("n")).where("n > 0")
    counts = counts.unionByName(whole.select("part", F.lit(window).cast("long").alias("over"), "n"))
    # a group of this window has one row a task of the first step, not one a document
    earlier = Window.partitionBy("over").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = cut(counts.withColumn("base", F.sum("n").over(earlier) - F.col("n")))
    histogram = {int(r["over"]): int(r["n"]) for r in bases.df.groupBy("over").agg(F.sum("n").alias("n")).collect()}  # at most window rows
    found = plan({k: n for k, n in histogram.items() if k < window}, histogram.get(window, 0), window, least)
    groups = found.groups(step)
    slots: dict[int, np.ndarray] = {}
    table = np.array(found.slots, np.int64).reshape(-1, 8)
    for r in np.unique(table[:, 0]).tolist():
        own = table[table[:, 0] == r]
        slots[r] = own[np.argsort(own[:, 3], kind="stable")]
    # slots are bounded by the lengths under one window and the cuts among them
    shared = docs.sparkSession.sparkContext.broadcast(slots)
    one, two = bases.hinted().select(F.col("part").alias("_p"), F.col("over").alias("_o"), F.col("base").alias("_rank")), bases.hinted().where(F.col("over") == window).select(F.col("part").alias("_q"), F.col("base").alias("_before"))
    placed = rows.join(one, (F.col("part") == F.col("_p")) & (F.col("tokens") % window == F.col("_o")), "left").join(two, F.col("part") == F.col("_q"), "left")
    zero = F.lit(0).cast("long")
    placed = placed.select("key", "ids", "tokens", "wide", (F.coalesce("_before", zero) + F.col("before")).alias("first"), (F.coalesce("_rank", zero) + F.col("rank")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for batch in pieces(batches, "ids", 1 << 21):
            at, out, data = [], [], []
            for i, (raw, tokens, wide, first, number) in enumerate(zip(*[c.to_pylist() for c in batch.columns[1:]])):
                ids = np.frombuffer(raw, np.uint32 if wide else np.uint16).astype("<u4")
                spans = [(j * window, window, first + j, 0, window) for j in range(tokens // window)]
                left = tokens % window
                if left:
                    own = book[left]
                    own = own[(own[:, 1] <= number) & (number < own[:, 2])]
                    spans += [(tokens - left + s, n, q + number - low, o, t) for _, low, _, s, n, q, o, t in own.tolist()]
                for start, length, sequence, offset, tier in spans:
                    at.append(i)
                    out.append((start, length, tokens, sequence, offset, tier, sequence % groups))
                    data.append(ids[start : start + length].tobytes())
            start, length, tokens, sequence, offset, tier, group = (pa.array(c, pa.int64()) for c in zip(*out))
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), start, length, pa.array(data, pa.binary()), tokens, sequence, offset, tier, group]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"])

    kind = rows.schema["key"].dataType.simpleString()
    out = placed.mapInArrow(run, f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier long, step_group long")
    return out.withColumnRenamed("key", key)
