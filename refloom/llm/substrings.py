"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping blocks of ``window // 2`` words; a repeat of ``window`` words holds at least
one whole block of the document it repeats.  The blocks are the index, and every rolling run of block length in every
document is a probe.  Both meet in buckets of their hash; a hit is a probe whose block starts a block of another
document, or a block that another document has.  Hits are then extended: the windows around them are hashed, and
windows of one hash meet at the smallest document that has them.  Adjoining windows make up the maximal repeats.

What is shuffled is packed: a task sends each bucket one row for some millions of probes (hash bits, document and
position, about seven bytes each).  Before that, a task settles what it can by itself: of probes that several of its
documents share it sends one, of windows only those of its smallest document, so no bucket grows with the copies of a
passage.  Texts are shuffled compressed, once, and joined by document twice.

Nulls and ties: a null text has no words; documents with a null doc_id are left whole and take nothing from others;
rows that repeat a doc_id are told apart by a hash of the text and never shorten each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.text import PIECE, Words, buffer, covered, in_small_batches, pieces

UNIT = 1 << 20  # probes that a task packs at a time
PACKED = "bucket int, settled boolean, docs binary, tags binary, counts binary, hashes binary, places binary"
HASH_BYTES = 5


def pack(bucket: int, settled: bool, docs: np.ndarray, tags: np.ndarray, hashes: np.ndarray | None, places: np.ndarray, width: int) -> dict:
    """One row of entries that stand in the order of (document, position); bytes of a rank stand together to compress well."""
    first = np.concatenate([[True], (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1]) | (places[1:] < places[:-1])])
    at = np.flatnonzero(first)
    step = np.diff(places, prepend=0)
    step[at] = places[at]
    return {
        "bucket": bucket, "settled": settled, "docs": docs[at].tobytes(), "tags": tags[at].tobytes(), "counts": _planes(np.diff(np.append(at, len(docs))), 4),
        "hashes": b"" if hashes is None else hashes.view(np.uint8).reshape(-1, 8)[:, 8 - width :].tobytes(), "places": _planes(step, 4),
    }


def _planes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def unpack(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(documents, tags, hashes, positions) of the entries of a row."""
    counts, step = _unplanes(row["counts"]), _unplanes(row["places"])
    sums = np.cumsum(step)
    at = np.cumsum(counts) - counts
    places = sums - np.repeat(sums[at] - step[at], counts)
    hashes = np.zeros((len(step), 8), np.uint8)
    if row["hashes"]:
        hashes[:, 8 - width :] = np.frombuffer(row["hashes"], np.uint8).reshape(-1, width)
    return np.repeat(np.frombuffer(row["docs"], np.int64), counts), np.repeat(np.frombuffer(row["tags"], np.uint32), counts), hashes.view(np.uint64).ravel(), places


def _runs(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash; for each entry in that order its run's first place, smallest and largest document."""
    order = np.argsort(hashes, kind="stable")
    ordered, of = hashes[order], docs[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.append(starts, len(order)))
    return order, starts, sizes, np.stack([np.minimum.reduceat(of, starts), np.maximum.reduceat(of, starts)])


def _shared(hashes: np.ndarray, docs: np.ndarray, places: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(hits, the first indexed block of each hit run): entries whose hash two documents have, one of them as a block."""
    order, starts, sizes, (low, high) = _runs(hashes, docs)
    aligned = places[order] % block == 0
    anchor = np.where(aligned, np.arange(len(order)), len(order))
    anchor = np.minimum.reduceat(anchor, starts)
    good = (low != high) & (anchor < len(order))
    hit = np.zeros(len(hashes), bool)
    hit[order] = np.repeat(good, sizes)
    return hit, order[anchor[good]]


def _later(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Entries whose hash a smaller document has."""
    order, _, sizes, (low, _) = _runs(hashes, docs)
    later = np.zeros(len(hashes), bool)
    later[order] = docs[order] > np.repeat(low, sizes)
    return later


class _Packer:
    """Collects entries of a task and turns them into packed rows."""

    def __init__(self, buckets: int, settle, width: int):
        self.buckets, self.settle, self.width, self.parts, self.n = buckets, settle, width, [], 0

    def add(self, *parts: np.ndarray) -> list[dict]:
        self.parts.append(parts)
        self.n += len(parts[0])
        return self.flush() if self.n >= UNIT else []

    def flush(self) -> list[dict]:
        if not self.n:
            return []
        docs, tags, hashes, places = (np.concatenate(p) for p in zip(*self.parts))
        self.parts, self.n = [], 0
        done, send = self.settle(hashes, docs, places)
        rows = []
        if done.any():
            rows.append(pack(int(docs[done][0] % self.buckets), True, docs[done], tags[done], None, places[done], self.width))
        own = np.flatnonzero(send)
        bucket = (hashes[own] % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        own, bucket = own[order], bucket[order]
        edges = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            at = own[edges[b] : edges[b + 1]]
            rows.append(pack(b, False, docs[at], tags[at], hashes[at], places[at], self.width))
        return rows


_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), *((n, pa.binary()) for n in ("docs", "tags", "counts", "hashes", "places"))])
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("places", pa.binary())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _PACKED_ARROW)


def _by_document(docs: np.ndarray, tags: np.ndarray, places: np.ndarray) -> pa.Table:
    order = np.lexsort((places, tags, docs))
    docs, tags, places = docs[order], tags[order], places[order].astype(np.uint32)
    at = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])])) if len(docs) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(docs))
    return pa.Table.from_arrays([pa.array(docs[at], pa.int64()), pa.array(tags[at].astype(np.int64)), pa.array([places[a:z].tobytes() for a, z in zip(at, ends)], pa.binary())], schema=_FOUND_ARROW)


def _meet(packed: DataFrame, pick, width: int) -> DataFrame:
    """(doc_id, tag, places) of the entries that ``pick`` chooses in each bucket, and of those already settled."""

    def bucket(table: pa.Table) -> pa.Table:
        settled, open_ = [], []
        for row in table.to_pylist():
            (settled if row["settled"] else open_).append(unpack(row, width))
        found = list(settled)
        if open_:
            docs, tags, hashes, places = (np.concatenate(p) for p in zip(*open_))
            hit = pick(hashes, docs, places)
            found.append((docs[hit], tags[hit], hashes[hit], places[hit]))
        docs, tags, _, places = (np.concatenate(p) for p in zip(*found))
        return _by_document(docs, tags, places)

    return packed.groupBy("bucket").applyInArrow(bucket, "doc_id long, tag long, places binary")


def _tag(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=4).digest(), "little")


def _unzipped(batches: Iterator[pa.RecordBatch], most: int = PIECE) -> Iterator[tuple[list[dict], list[bytes]]]:
    """Rows with their texts, a few megabytes at a time."""
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        rows, texts, size = [], [], 0
        for row in batch.to_pylist():
            text = unzip.decompress(row.pop("body")) if row["body"] else b""
            rows.append(row)
            texts.append(text)
            size += len(text)
            if size >= most:
                yield rows, texts
                rows, texts, size = [], [], 0
        if rows:
            yield rows, texts


def _joined(texts: list[bytes]) -> Words:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    return Words(np.frombuffer(b"".join(texts), np.uint8), offsets)


def _places(found: list) -> np.ndarray:
    return np.frombuffer(b"".join(found), np.uint32).astype(np.int64)


def repeats(docs: DataFrame, window: int = 50, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(bodies, repeats): (doc_id, body) with zipped texts, and (doc_id, found) with tags and first words of the windows
    that a smaller doc_id has too.  ``buckets`` follows the number of input partitions unless it is given."""
    block = window // 2
    buckets = buckets or 4 * max(16, docs.rdd.getNumPartitions())
    source = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(hashes, ids, places):
            hit, anchors = _shared(hashes, ids, places, block)
            send = ~hit
            send[anchors] = True
            return hit, send

        packer = _Packer(buckets, settle, HASH_BYTES)
        for batch in pieces(batches):
            words = Words(*buffer(batch.column("text")))
            start, hashes = words.windows(words.hashes(), block)
            of = words.doc[start]
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            if rows := packer.add(ids[of], np.zeros(len(of), np.uint32), hashes, start - words.at[of]):
                yield _batch(rows)
        if rows := packer.flush():
            yield _batch(rows)

    def hits(hashes, ids, places):
        return _shared(hashes, ids, places, block)[0]

    found = _meet(source.where("doc_id is not null").mapInArrow(probes, PACKED), hits, HASH_BYTES)
    found = found.groupBy("doc_id").agg(F.collect_list("places").alias("places"))  # a row for each bucket at most

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zipper = zstandard.ZstdCompressor(level=1)
        for batch in pieces(batches):
            texts = [zipper.compress(t) if t else None for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "body"])

    zipped = source.mapInArrow(bodies, "doc_id long, body binary").repartition("doc_id")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(hashes, ids, places):
            later = _later(hashes, ids)
            return later, ~later

        packer = _Packer(buckets, settle, 8)
        for rows, texts in _unzipped(batches):
            some = [d for d, row in enumerate(rows) if row["places"]]
            if not some:
                continue
            rows, texts = [rows[d] for d in some], [texts[d] for d in some]
            words = _joined(texts)
            start, hashes = words.windows(words.hashes(), window)
            near = np.zeros(len(words), bool)
            for d, row in enumerate(rows):
                at = _places(row["places"])
                at = np.unique((at[:, None] - np.arange(window - block + 1)).ravel()) if len(at) else at
                near[at[(at >= 0) & (at < words.count[d])] + words.at[d]] = True
            own = near[start]
            start, hashes = start[own], hashes[own]
            of = words.doc[start]
            ids, tags = np.array([r["doc_id"] for r in rows], np.int64), np.array([_tag(t) for t in texts], np.uint32)
            if out := packer.add(ids[of], tags[of], hashes, start - words.at[of]):
                yield _batch(out)
        if out := packer.flush():
            yield _batch(out)

    # a left join, as the second one is: so both read one exchange of the texts
    windows = zipped.join(found, "doc_id", "left").select("doc_id", "body", "places").mapInArrow(extend, PACKED)
    removed = _meet(windows, lambda hashes, ids, places: _later(hashes, ids), 8)
    return zipped, removed.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "places")).alias("found"))


def dedup_substrings(docs: DataFrame, window: int = 50, digest: bool = False, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by a space, or their SHA-256 as kept_sha256 with ``digest``."""
    zipped, removed = repeats(docs, window, buckets)
    name = "kept_sha256" if digest else "kept"

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _unzipped(batches):
            out = []
            for row, text in zip(rows, texts):
                words = text.split()
                n = len(words)
                if row["found"]:
                    tag = _tag(text)
                    at = _places([f["places"] for f in row["found"] if f["tag"] == tag])
                    gone = covered(np.unique(at), window, n)
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                kept = b" ".join(words)
                out.append((row["doc_id"], n, n - len(words), hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_words", "n_removed", name])

    return zipped.join(removed, "doc_id", "left").select("doc_id", "body", "found").mapInArrow(rewrite, f"doc_id long, n_words long, n_removed long, {name} string")
