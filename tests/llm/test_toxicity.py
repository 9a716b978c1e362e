"""Toxicity: held-out accuracy, n-grams against brute force, edge cases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from refloom.llm import minimise, ngrams, toxicity
from refloom.llm.sample import remainder
from refloom.llm.text import buffer


def test_ngrams_are_those_of_characters():
    texts = ["", None, "abcab", "é\U0001f600日x", "ab", "日" * 5]
    codes, at = ngrams.characters(*buffer(pa.array(texts)))
    assert np.diff(at).tolist() == [len(t or "") for t in texts]
    start, slot = ngrams.ngram_slots(codes, at, 3, 20)
    seen = {}
    grams = [(t or "")[k : k + 3] for t in texts for k in range(len(t or "") - 2)]
    assert len(grams) == len(slot)
    for g, s in zip(grams, slot.tolist()):
        assert seen.setdefault(g, s) == s
    assert len(set(seen.values())) == len(seen)


def test_lbfgs_finds_a_minimum():
    a = np.diag([1.0, 10.0, 100.0])
    x = minimise.lbfgs(lambda v: (float(v @ a @ v / 2 - v.sum()), a @ v - 1), np.zeros(3))
    assert np.allclose(x, [1, 0.1, 0.01], atol=1e-4)


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where(remainder("doc_id", 2) != 0))
    rows = toxicity.score_documents(docs, model).join(labels, "doc_id").where(remainder("doc_id", 2) == 0).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    toxic, clean = (np.array([r.score for r in rows if r.toxic == y]) for y in (1, 0))
    assert (toxic[:, None] > clean[None, :]).mean() > 0.8
    assert (clean >= 0.5).mean() < 0.05


def test_edges(spark):
    docs = spark.createDataFrame([(1, "you idiot", 1.5), (2, "kind words", 2.5), (3, None, 3.5), (3, None, 3.5), (4, "", 4.5), (None, "x " * 50000, 5.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 6 and len({r.score for r in got if r.doc_id in (3, 4)}) == 1
    for none in (labels.limit(0), labels.where("toxic = 1")):
        scores = toxicity.score_documents(docs, toxicity.train(docs, none)).select(F.min("score"), F.max("score")).first()
        assert scores[0] == scores[1]
    assert toxicity.score_documents(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0
