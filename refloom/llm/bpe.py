"""BPE encoding and decoding with a public vocabulary.

The pair ranks of a word stand in the leaves of a segment tree whose nodes keep the minimum of rank and position, so
the root is the leftmost pair of lowest rank.  A merge changes three leaves and their paths to the root, and merging
goes on until no leaf holds a mergeable pair.  Trees of words of about the same length are rows of one numpy array,
and every round does one merge in each of them.

A text is cut at added tokens first, then at ASCII white space; a chunk's ids do not depend on what stands around it,
so each distinct chunk of a batch is encoded once and remembered from task to task (bounded by ``REMEMBER``, then forgotten).

Nulls and ties: a null text counts as empty and gives no ids; equal texts give equal ids; ids that are not in the
vocabulary are left out on decoding, as the vocabulary's library does.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from refloom.llm.text import in_small_batches, pieces

REMEMBER = 300_000
NONE = np.int64(1) << 62
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
_loaded: dict[str, Bpe] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next from code point 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _normal(text: str) -> str:
    """NFC, then the lower case of each character by itself (a final sigma has no form of its own)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join([c.lower() for c in text]) if "\u03a3" in text else text.lower()


class Bpe:
    """Encoder and decoder of one vocabulary file of words with an end-of-word suffix."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int64)
        pairs = np.array([(vocab[a] << 32 | vocab[b], vocab[a + b]) for a, b in model["merges"]], np.int64).reshape(-1, 2)
        order = np.argsort(pairs[:, 0], kind="stable")
        self.pairs, self.ranks, self.merged = pairs[order, 0], order.astype(np.int64), pairs[order, 1]
        bits = 20
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self._slot(self.pairs)] = True
        self.chunks: dict[bytes, tuple[str, str]] = {}

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of each pair; NONE where it cannot be merged."""
        pair = left << 32 | right
        rank, merged = np.full(len(pair), NONE), np.zeros(len(pair), np.int64)
        some = np.flatnonzero(self.maybe[self._slot(pair)])
        at = np.minimum(np.searchsorted(self.pairs, pair[some]), len(self.pairs) - 1)
        hit = self.pairs[at] == pair[some]
        some, at = some[hit], at[hit]
        rank[some], merged[some] = self.ranks[at], self.merged[at]
        return rank, merged

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words that are not cut any further."""
        out: list[list[int]] = [[] for _ in words]
        sizes = np.array([len(w) for w in words], np.int64)
        width = 2
        while width == 2 or width < 2 * sizes.max(initial=0):
            own = np.flatnonzero((sizes > width // 2 if width > 2 else sizes > 0) & (sizes <= width))
            step = max(1, (1 << 21) // width)
            for lo in range(0, len(own), step):
                part = own[lo : lo + step]
                ids, lengths = self._merge([words[i] for i in part], sizes[part], width)
                flat, ends = ids.tolist(), np.cumsum(lengths).tolist()
                at = 0
                for i, end in zip(part.tolist(), ends):
                    out[i] = flat[at:end]
                    at = end
            width *= 2
        return out

    def _merge(self, words: list[bytes], sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has; every word has at most ``width`` bytes."""
        n = len(words)
        data = np.zeros((n, width), np.uint8)
        place = np.arange(width)
        data[place < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        ids = np.where(place == sizes[:, None] - 1, self.final[data], self.inner[data])
        live = place < sizes[:, None]
        after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
        tree = np.full((n, 2 * width), NONE)
        result = np.zeros((n, width), np.int64)
        pair_row, pair_at = np.nonzero(place < sizes[:, None] - 1)
        rank, merged = self._find(ids[pair_row, pair_at], ids[pair_row, pair_at + 1])
        some = rank < NONE
        tree[pair_row[some], width + pair_at[some]] = rank[some] * width + pair_at[some]
        result[pair_row, pair_at] = merged
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            left = tree[row, 1] % width
            right = after[row, left]
            ids[row, left] = result[row, left]
            live[row, right] = False
            following = after[row, right]
            after[row, left] = following
            more = following < sizes[row]
            before[row[more], following[more]] = left[more]
            self._set(tree, row, right, np.full(len(row), NONE), width)
            for rows, at, nxt in ((row, left, following), (row[left > 0], before[row, left][left > 0], left[left > 0])):
                rank, merged = np.full(len(rows), NONE), np.zeros(len(rows), np.int64)
                some = np.flatnonzero(nxt < sizes[rows])
                rank[some], merged[some] = self._find(ids[rows[some], at[some]], ids[rows[some], nxt[some]])
                result[rows, at] = merged
                self._set(tree, rows, at, np.where(rank < NONE, rank * width + at, NONE), width)
            row = row[tree[row, 1] < NONE]
        return ids[live], live.sum(axis=1)

    @staticmethod
    def _set(tree: np.ndarray, row: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
        node = at + width
        tree[row, node] = value
        while width > 1:
            node >>= 1
            width >>= 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def _learn(self, chunks: list[bytes]) -> None:
        """Remember the ids and the decoded text of chunks."""
        words: list[bytes] = []
        counts = []
        for chunk in chunks:
            found = _WORD.findall(_normal(chunk.decode("utf-8")))
            words += [w.encode("utf-8") for w in found]
            counts.append(len(found))
        distinct = dict.fromkeys(words)
        shown = {w: (" ".join(map(str, ids)), self.decode(ids)) for w, ids in zip(distinct, self.encode_words(list(distinct)))}
        at = 0
        for chunk, n in zip(chunks, counts):
            own = [shown[w] for w in words[at : at + n]]
            self.chunks[chunk] = own[0] if n == 1 else (" ".join(o[0] for o in own), " ".join(o[1] for o in own))
            at += n

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """(ids joined by a space, decoded text) of each text."""
        parts: list[list[bytes | str]] = []
        for text in texts:
            if self.cut is None or "<|" not in text:
                parts.append(text.encode("utf-8").split())
            else:
                parts.append([x for p in self.cut.split(text) for x in ([p] if p in self.added else p.encode("utf-8").split())])
        if len(self.chunks) > REMEMBER:
            self.chunks = {}
        new = [c for c in set().union(*parts) - self.chunks.keys() if isinstance(c, bytes)]
        if new:
            self._learn(new)
        known = self.chunks
        for token, i in self.added.items():
            known[token] = (str(i), token)  # a str key, so that no chunk of bytes equals it
        out = []
        for part in parts:
            got = [known[c] for c in part]
            out.append((" ".join([g[0] for g in got if g[0]]), " ".join([g[1] for g in got if g[1]])))
        return out

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by a space: the vocabulary has no decoder of its own."""
        return " ".join(self.names[i] for i in ids if i in self.names)


def load(file: str) -> Bpe:
    """One encoder a worker process; ``file`` is a path, or a name that the driver shared with addFile."""
    if file not in _loaded:
        _loaded[file] = Bpe(file if "/" in file else SparkFiles.get(file))
    return _loaded[file]


def share(docs: DataFrame, path: str) -> str:
    """Ship the vocabulary to every executor and return the name under which ``load`` finds it."""
    docs.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of each document with its ids (array<int>) and the text decoded from them."""
    return _each(docs, path, keep, ("ids array<int>", "decoded string"), lambda ids, text: [pa.array([list(map(int, x.split())) for x in ids], pa.list_(pa.int32())), pa.array(text)])


def encode_digests(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of each document with n_tokens and SHA-256 digests of its ids and of the decoded text."""
    sha = lambda texts: pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in texts])
    columns = ("n_tokens long", "ids_sha256 string", "decoded_sha256 string")
    return _each(docs, path, keep, columns, lambda ids, text: [pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64()), sha(ids), sha(text)])


def _each(docs: DataFrame, path: str, keep: tuple[str, ...], columns: tuple[str, ...], arrays) -> DataFrame:
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *columns])
    names = [*keep, *(c.split(" ")[0] for c in columns)]
    file = share(docs, path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        for batch in pieces(batches, most=1 << 20):
            found = bpe.encode(batch.column("text").fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays([f[0] for f in found], [f[1] for f in found])], names)

    return in_small_batches(docs).select(*dict.fromkeys([*keep, "text"])).mapInArrow(rows, schema)
