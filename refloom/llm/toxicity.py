"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature is the presence of an n-gram (3 to 5 characters, lower-cased A-Z, hashed into slots) in a whole text.  The
log-count ratio of a slot compares the share of toxic texts that have it with the share of the others; the slots with
the largest ratios, weighed by how often they occur, are kept, and a logistic regression is fitted on the presence of
those, each scaled by its ratio.  The labels keep the weights that they have among all labelled rows.

The sample is bounded: at most ``most`` texts of each label, in hash order of their ids.  Counts of the sample are
added up by Spark; the driver gets one vector of slots and the kept slots of each sampled text.

Nulls and ties: a null or empty text has no features and gets the score of the intercept; rows with a null label or
id are not learned from; without texts of both labels every score is the mean label (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.minimise import lbfgs
from refloom.llm.ngrams import characters, ngram_slots
from refloom.llm.sample import sample_ids, with_sample
from refloom.llm.text import LOWER, buffer, in_small_batches, pieces

SIZES, BITS, KEPT = (3, 4, 5), 20, 2048


@dataclass(frozen=True)
class Linear:
    weight: np.ndarray  # of each slot, ratio included; 0 for slots that are not kept
    intercept: float

    def score(self, column: pa.Array) -> np.ndarray:
        doc, slot = present(column, self.weight != 0)
        total = np.bincount(doc, self.weight[slot], minlength=len(column)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def present(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) for every slot that a text has, once."""
    data, offsets = buffer(column)
    codes, at = characters(LOWER[data], offsets)
    keys = []
    for size in SIZES:
        start, slot = ngram_slots(codes, at, size, BITS)
        if wanted is not None:
            some = wanted[slot]
            start, slot = start[some], slot[some]
        keys.append((np.searchsorted(at, start, "right") - 1) << BITS | slot)
    keys = np.unique(np.concatenate(keys))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def _counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with each slot by label, and texts by label."""
    width = 1 << 12

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in pieces(batches):
            label = batch.column("_label").to_numpy()
            doc, slot = present(batch.column("text"))
            for y in (0, 1):
                total[y] += np.bincount(slot[label[doc] == y], minlength=1 << BITS)
                texts[y] += (label == y).sum()
        if texts.any():
            parts = total.reshape(2, -1, width)
            for i in range(parts.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([parts[:, i].astype(np.int32).tobytes()]), pa.array([texts.tobytes()])], ["part", "counts", "texts"])

    def merge(table: pa.Table) -> pa.Table:
        fold = lambda name, kind: sum(np.frombuffer(x, kind).astype(np.int64) for x in table.column(name).to_pylist())
        return pa.table({"part": table.column("part")[:1], "counts": [fold("counts", np.int32).tobytes()], "texts": [fold("texts", np.int64).tobytes()]})

    schema = "part long, counts binary, texts binary"
    rows = sample.select("text", "_label").mapInArrow(add, schema).groupBy("part").applyInArrow(merge, schema).collect()  # one row for each 4096 slots
    total, texts = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for r in rows:
        total[:, r.part * width : (r.part + 1) * width] = np.frombuffer(r.counts, np.int64).reshape(2, width)
        texts = np.frombuffer(r.texts, np.int64)
    return total[0], total[1], texts


def _fit(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, prior: float, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on scaled presence; label 1 weighs ``prior`` in all, whatever the sample's share."""
    at, slot = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows).astype(np.int64)
    value = scale[slot]
    share = np.where(y == 1, prior / max(y.sum(), 1), (1 - prior) / max((1 - y).sum(), 1))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        total = np.bincount(at, value * x[slot], len(rows)) + x[-1]
        error = share * (1 / (1 + np.exp(-np.clip(total, -500, 500))) - y)
        gradient = np.append(np.bincount(slot, value * error[at], len(scale)), error.sum())
        gradient[:-1] += ridge * x[:-1]
        return float(share @ (np.logaddexp(0, total) - y * total) + ridge / 2 * (x[:-1] @ x[:-1])), gradient

    x = lbfgs(loss, np.zeros(len(scale) + 1))
    return x[:-1] * scale, float(x[-1])


def train(docs: DataFrame, labels: DataFrame, most: int = 4000, label: str = "toxic") -> Linear:
    """A classifier fitted on at most ``most`` texts of each label."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    known = known.withColumn("_label", (F.col("_label") > 0).cast("int"))
    prior = known.agg(F.avg("_label")).first()[0]
    ids = sample_ids(known.where("_label = 0"), most).union(sample_ids(known.where("_label = 1"), most))
    sample = with_sample(in_small_batches(docs).select("doc_id", "text"), ids)
    clean, toxic, texts = _counts(sample)
    if not texts.all():
        mean = texts[1] / max(texts.sum(), 1)
        return Linear(np.zeros(1 << BITS), float(np.log(max(mean, 1e-9) / max(1 - mean, 1e-9))))
    p, q = (toxic + 1) / (texts[1] + 2), (clean + 1) / (texts[0] + 2)
    ratio = np.log(p / q)
    gain = np.abs(ratio) * np.maximum(toxic / texts[1], clean / texts[0])
    gain[toxic + clean < 3] = 0
    wanted = np.zeros(1 << BITS, bool)
    wanted[np.argsort(-gain, kind="stable")[:KEPT]] = True
    wanted &= gain > 0
    place = np.cumsum(wanted) - 1

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            doc, slot = present(batch.column("text"), wanted)
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            found = place[slot].astype(np.int16)
            yield pa.RecordBatch.from_arrays([batch.column("_label"), pa.array([found[a:z].tobytes() for a, z in zip(ends, ends[1:])], pa.binary())], ["y", "slots"])

    rows = sample.select("text", "_label").mapInArrow(slots, "y int, slots binary").collect()  # at most 2 * most rows of at most KEPT numbers
    rows.sort(key=lambda r: (bytes(r.slots), r.y))
    weight, intercept = _fit([np.frombuffer(r.slots, np.int16) for r in rows], np.array([r.y for r in rows], float), ratio[wanted], prior)
    full = np.zeros(1 << BITS)
    full[wanted] = weight
    return Linear(full, intercept)


def score_documents(docs: DataFrame, model: Linear, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of each document with its score (0 to 1) and predicted (1 from 0.5 on)."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double", "predicted int"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            score = shared.value.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return in_small_batches(docs).select(*dict.fromkeys([*keep, "text"])).mapInArrow(rows, schema)
