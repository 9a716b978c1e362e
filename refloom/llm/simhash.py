"""SimHash near-duplicates: candidates by blocks of equal bits, distances by bit-sliced counters, components by stars.

Fingerprints that differ in at most ``radius`` bits agree on all but ``radius`` of the blocks that the 64 bits are cut
into, so every choice of the other blocks is a join key and no link is lost.  Copies count once: only distinct
fingerprints are compared.  A key with more than ``HOT`` of them is cut into chunks, and every pair of chunks is a
group of its own, so that no group grows with the data.

Inside a group, plane b holds bit b of 64 fingerprints in one word.  A fingerprint is compared with 64 others at once:
its difference in plane b is added to two-bit counters by bitwise carry, the third bit stays set, and words in which
all 64 are beyond the radius are dropped.  A group returns one edge for each member of a component at most, never its
pairs.

Nulls and ties: a null text counts as empty; texts without words have fingerprint zero and are linked like any other;
equal fingerprints are one component; a null doc_id is kept and never names a component unless no other id is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.components import components
from refloom.llm.text import Words, buffer, in_small_batches, pieces
from refloom.plans.runtime import cut

SEED = 42
HOT = 512
SLAB = 1 << 20
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprints(column: pa.Array, shingle: int) -> np.ndarray:
    """The fingerprint of each text."""
    data, offsets = buffer(column)
    words = Words(data, offsets, lower=True)
    texts, n = len(words.count), len(words)
    if n == 0:
        return np.zeros(texts, np.uint64)
    # the words with one space after each
    length = words.end - words.start
    start = np.zeros(n, np.int64)
    np.cumsum(length[:-1] + 1, out=start[1:])
    body = np.full(start[-1] + length[-1] + 1, 32, np.uint8)
    solid = np.flatnonzero(words.solid)
    body[np.arange(len(solid)) + np.repeat(np.arange(n), length)] = words.data[solid]
    # one shingle at each word with enough followers, one for a shorter text
    first, last = words.at[:-1], words.at[1:]
    per_text = np.where(words.count >= shingle, words.count - shingle + 1, np.minimum(words.count, 1))
    begin = np.arange(per_text.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(per_text)[:-1]]), per_text)
    final = np.minimum(begin + shingle - 1, np.repeat(last - 1, per_text))
    raw, digest = body.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([digest(raw[a:z], SEED) for a, z in zip(start[begin].tolist(), (start[final] + length[final]).tolist())], np.uint64)
    some = np.flatnonzero(per_text)
    ends = np.cumsum(per_text)
    out = np.zeros(texts, np.uint64)
    for byte in range(8):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8)[:, byte, None], axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (ends - per_text)[some], axis=0, dtype=np.int64)
        for bit in range(8):
            out[some] |= (2 * ones[:, bit] > per_text[some]).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_id, print): xxhash64 of the text, and the fingerprint as a signed long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), pa.array(fingerprints(batch.column("text"), shingle).view(np.int64))], ["doc_id", "text_id", "print"])

    return in_small_batches(docs).select("doc_id", F.xxhash64("text").alias("text_id"), "text").mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_id long, print long")


def near_pairs(prints: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of fingerprints of one group within the radius; groups stand together."""
    if radius > 3:
        raise ValueError("the counters hold two bits: a radius of 3 at most")
    n = len(prints)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    slots = (sizes + 63) // 64  # words of each group
    base = np.concatenate([[0], np.cumsum(slots)])[:-1]
    of = np.repeat(np.arange(len(starts)), sizes)
    rank = np.arange(n) - starts[of]
    word, lane = base[of] + rank // 64, (rank % 64).astype(np.uint64)
    planes = np.zeros((64, int(slots.sum())), np.uint64)
    for b in range(64):
        np.bitwise_or.at(planes[b], word, (prints >> np.uint64(b) & np.uint64(1)) << lane)
    filled = np.zeros(planes.shape[1], np.uint64)
    np.bitwise_or.at(filled, word, np.uint64(1) << lane)
    # a row meets its own word and the later ones of its group
    meets = base[of] + slots[of] - word
    row = np.repeat(np.arange(n), meets)
    with_word = np.arange(len(row)) - np.repeat(np.cumsum(meets) - meets, meets) + np.repeat(word, meets)
    ones, twos, over = (np.zeros(len(row), np.uint64) for _ in range(3))
    # lanes that are empty, or not after the row in its own word, count as beyond the radius
    own = with_word == word[row]
    over |= ~filled[with_word]
    over[own] |= (np.uint64(2) << lane[row[own]]) - np.uint64(1)
    for b in range(64):
        differ = planes[b][with_word] ^ (np.uint64(0) - (prints[row] >> np.uint64(b) & np.uint64(1)))
        carry = ones & differ
        ones ^= differ
        fours = twos & carry
        twos ^= carry
        over |= fours
        if radius < 3:  # the counters are beyond a smaller radius earlier
            over |= (ones & twos, twos, ones | twos)[2 - radius]
        if b % 8 == 7:
            left = over != ALL
            row, with_word, ones, twos, over = row[left], with_word[left], ones[left], twos[left], over[left]
    hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(over) else np.zeros((0, 64), np.uint8)
    at, lanes = np.nonzero(hit)
    first_of_word = np.zeros(planes.shape[1], np.int64)
    first_of_word[word[::-1]] = np.arange(n)[::-1]
    return row[at], first_of_word[with_word[at]] + lanes


def local_edges(prints: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(print, smallest print of its component inside the group) of the members that have a link."""
    return spanning(prints, *near_pairs(prints, group, radius))


def spanning(prints: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(print, smallest print of its component) of the members of links (i, j); prints of a component ascend."""
    label = np.arange(len(prints))
    while len(i):
        least = np.minimum(label[i], label[j])
        changed = (label[i] != least) | (label[j] != least)
        if not changed.any():
            break
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
    moved = np.flatnonzero(label != np.arange(len(prints)))
    return prints[moved], prints[label[moved]]


def near_edges(distinct: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (column print) within the radius, directly or in steps."""
    sizes = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    shifts = [sum(sizes[:i]) for i in range(blocks)]
    keys = []
    for chosen in combinations(range(blocks), blocks - radius):
        parts = [F.shiftrightunsigned("print", shifts[i]).bitwiseAND(F.lit((1 << sizes[i]) - 1)) for i in chosen]
        keys.append(F.xxhash64(F.lit(str(chosen)), *parts))
    keyed = distinct.select("print", F.explode(F.array(*keys)).alias("key"))
    counts = keyed.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where(f"_n > {HOT}")
    hot = cut(counts.select("_key", F.ceil(F.col("_n") / HOT).cast("int").alias("_m"))).hinted()  # broadcast only if it was measured to be small
    chunk = F.pmod(F.xxhash64("print", F.lit(7)), F.col("_m")).cast("int")
    other = F.explode(F.when(F.col("_m").isNull(), F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("_m") - 1), F.col("_c"))))
    dealt = keyed.join(hot, F.col("key") == F.col("_key"), "left").withColumn("_c", F.coalesce(chunk, F.lit(0))).select("print", "key", "_c", other.alias("_o"))
    dealt = dealt.select("print", F.xxhash64("key", F.least("_c", "_o"), F.greatest("_c", "_o")).alias("group"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for last, batch in _and_last(batches):
            group, prints = (np.concatenate([h, batch.column(c).to_numpy()] if batch else [h]) for h, c in zip(held, ("group", "print")))
            whole = len(group) if last else int(np.searchsorted(group, group[-1], "left")) if len(group) else 0
            held = group[whole:], prints[whole:]
            same = group[:whole]
            again = np.zeros(whole, bool)
            again[1:] |= same[1:] == same[:-1]
            again[:-1] |= same[1:] == same[:-1]
            same, values = same[again], prints[:whole][again]
            for lo, hi in _slabs(same):
                a, b = local_edges(values[lo:hi].view(np.uint64), same[lo:hi], radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.repartition("group").sortWithinPartitions("group", "print").mapInArrow(compare, "a long, b long").distinct()


def _and_last(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield False, batch
    yield True, None


def _slabs(group: np.ndarray, most: int = SLAB) -> Iterator[tuple[int, int]]:
    """Cut whole groups into slabs of about ``most`` meetings of a row and a word."""
    if not len(group):
        return
    starts = np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group))
    sizes = np.diff(starts)
    cost = np.cumsum(sizes * ((sizes + 63) // 64))
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + most, "right")))
        yield int(starts[at]), int(starts[stop])
        at = stop


def near_components(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, text_id, print, component_id, n_copies): the smallest doc_id that links reach, and how many rows have the print."""
    prints = cut(with_fingerprints(docs, shingle)).df
    distinct = cut(prints.groupBy("print").agg(F.min("doc_id").alias("_doc"), F.count(F.lit(1)).alias("n_copies"))).df
    return place(prints, distinct, near_edges(distinct.select("print"), radius))


def place(prints: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of ``prints`` with the component_id and n_copies that edges between prints give them."""
    roots = components(edges)
    placed = distinct.join(roots, F.col("print") == F.col("node"), "left").select("print", "_doc", "n_copies", F.coalesce("component", "print").alias("_root"), F.col("node").isNotNull().alias("_linked"))
    placed = placed.where("_linked or n_copies > 1")
    least = placed.groupBy(F.col("_root").alias("_r")).agg(F.min("_doc").alias("component_id"))
    groups = cut(placed.join(least, F.col("_root") == F.col("_r")).select(F.col("print").alias("_print"), "component_id", "n_copies")).hinted()
    return prints.join(groups, F.col("print") == F.col("_print"), "left").select("doc_id", "text_id", "print", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """The document with the smallest doc_id of each component, with its own columns; of repeated rows one stays.

    Documents with a null doc_id stay only where no other id is in their component, and then one for each text.
    """
    return keep_first(docs, near_components(docs, shingle, radius))


def keep_first(docs: DataFrame, components: DataFrame) -> DataFrame:
    """What ``keep_one`` keeps, by components of any kind."""
    found = cut(components).df
    lost = found.where("component_id is not null and not (doc_id <=> component_id)").select("doc_id", "text_id").distinct()
    again = found.groupBy("doc_id", "text_id").count().where("count > 1").select("doc_id", "text_id")
    same = lambda side: docs["doc_id"].eqNullSafe(side["_doc"]) & (F.xxhash64(docs["text"]) == side["_id"])
    named = lambda df: cut(df.select(F.col("doc_id").alias("_doc"), F.col("text_id").alias("_id")))
    lost, again = named(lost), named(again)  # broadcast below only if they were measured to be small
    sides = (lost.hinted(), again.hinted())
    kept = docs.join(sides[0], same(sides[0]), "left_anti")
    if again.empty:
        return kept
    return kept.join(sides[1], same(sides[1]), "left_anti").unionByName(kept.join(sides[1], same(sides[1]), "left_semi").dropDuplicates(["doc_id", "text"]))


def hex_print(column: str = "print"):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
