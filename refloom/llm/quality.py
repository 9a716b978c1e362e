"""Quality rules: gradient-boosted trees over statistics of a document, above a fixed base rule.

Statistics come from whole texts, a batch at a time; the trees are fitted on a bounded sample of labelled documents
(``most`` rows in hash order) and sent to the tasks as flat arrays.

Nulls and ties: a null text counts as empty, so it has no words and fails the base rule; every row is judged by
itself, so repeated rows get equal verdicts.  Rows with a null label are not learned from.  Without labels of both
kinds the trees are left out and the verdict is the base rule's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.boosting import Forest, fit
from refloom.llm.sample import sample_ids, with_sample
from refloom.llm.text import BASE, Words, buffer, covered, in_small_batches, mix, pieces

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER, DIGIT, MARK = (np.isin(np.arange(256), list(x)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?"))
LETTER = np.isin(np.arange(256), np.arange(256)[[chr(i).isalpha() or i >= 128 for i in range(256)]])
WINDOW, LEAST_WORDS, REPEATED = 8, 20, 30
BASES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: name and the sign that the verdict's change with it may have
FEATURES = (
    ("symbols_a_word", -1), ("dup_line_share", -1), ("repeat_share", -1), ("upper_share", -1), ("digit_share", 0), ("mark_share", 0),
    ("word_length", 0), ("words", 0), ("words_a_line", 0), ("bare_share", -1), ("distinct_share", 0), ("loud_share", -1),
)
MONOTONE = np.array([sign for _, sign in FEATURES])


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    return np.isin(keys, twice) if len(twice) else np.zeros(len(keys), bool)


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts of each text, and its features."""
    data, offsets = buffer(column)
    words = Words(data, offsets)
    n, texts = words.count, len(words.count)
    solid, hashes = words.solid, words.hashes()
    chars = words.per_doc(solid & ((data & 0xC0) != 0x80))
    symbols = words.per_doc(SYMBOLS[data])

    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    start = start[start < len(data)]
    end = np.append(start[1:], len(data)) if len(start) else start
    doc = np.searchsorted(offsets, start, "right") - 1
    end = np.where((end > start) & (data[end - 1] == 10) if len(start) else False, end - 1, end)
    filled = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, doc = start[filled], end[filled], doc[filled]
    keys = mix(words.hashes(start, end) + doc.astype(np.uint64) * BASE)
    lines = np.bincount(doc, minlength=texts)
    _, kept = np.unique(keys, return_index=True)
    dup_lines = lines - np.bincount(doc[kept], minlength=texts)

    of = words.doc
    first, runs = words.windows(hashes, WINDOW)
    again = first[_repeats(mix(runs + of[first].astype(np.uint64) * BASE))]
    repeated = words.per_doc_words(covered(again, WINDOW, len(words)))
    _, kept = np.unique(mix(hashes + of.astype(np.uint64) * BASE), return_index=True)
    distinct = np.bincount(of[kept], minlength=texts)
    last = words.end - 1
    bare = words.per_doc_words(~LETTER[data[words.start]] & ~LETTER[data[last]])
    loud = words.per_doc_words(np.isin(data[last], list(b"!?*#$%&|<>")))

    base = dict(zip(BASES, (n, chars, symbols, dup_lines, repeated)))
    per = lambda a, b: a / np.maximum(b, 1)
    shares = [words.per_doc(kind[data]) for kind in (UPPER, DIGIT, MARK)]
    features = np.stack([
        per(symbols, n), per(dup_lines, lines), per(repeated, n), *(per(s, chars) for s in shares), per(chars, n), n, per(n, lines), per(bare, n), per(distinct, n), per(loud, n),
    ], axis=1).astype(float)
    return base, features


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > REPEATED * base["n_words"])


def train(docs: DataFrame, labels: DataFrame, most: int = 8000, label: str = "quality") -> Forest:
    """Trees fitted on at most ``most`` labelled documents."""
    ids = sample_ids(labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label")), most)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = statistics(batch.column("text"))[1]
            yield pa.RecordBatch.from_arrays([batch.column("_label"), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["y", "x"])

    sample = with_sample(in_small_batches(docs).select("doc_id", "text"), ids).select("text", "_label").mapInArrow(features, "y int, x array<double>").collect()  # at most `most` rows of 12 numbers
    sample.sort(key=lambda r: (r.x, r.y))
    x = np.array([r.x for r in sample]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.y for r in sample], float), MONOTONE)


def judge(docs: DataFrame, forest: Forest, threshold: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of each document with its counts, base_failed, score and kept."""
    used = list(dict.fromkeys([*keep, "text"]))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{b} long" for b in BASES), "base_failed boolean", "score double", "kept boolean"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            base, features = statistics(batch.column("text"))
            failed, score = base_failed(base), forest.score(features)
            own = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(base[b].astype(np.int64)) for b in BASES), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], [*keep, *BASES, "base_failed", "score", "kept"])

    return in_small_batches(docs).select(*used).mapInArrow(rows, schema)


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that are kept, with their own columns."""
    forest = train(docs, labels)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            base, features = statistics(batch.column("text"))
            yield batch.filter(pa.array(~base_failed(base) & (forest.score(features) >= threshold)))

    return in_small_batches(docs).mapInArrow(rows, docs.schema)
