"""Quality rules against brute force, with edge cases."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from refloom.llm import boosting, quality

TEXTS = [
    None, "", " \n ", "a", "a b c d e f g h a b c d e f g h", "x\nx\n\nx \n x\nx", "élève # & |   　 z", "one two three four five six seven eight " * 9,
    "\n".join(["same line here", "other line", "same line here"]) * 3, "<b>" * 40, "w " * 7, "q\r\nq\r\n" * 5, "big " * 5000, "\U0001f600 \U0001f600",
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in lines
            lines.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)} if len(words) < 1000 else set(range(len(words)))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_counts_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, score string")
    forest = boosting.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0), quality.MONOTONE)
    rows = quality.judge(docs.repartition(3), forest).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(TEXTS[r.doc_id]), r
        assert r.kept == (not r.base_failed)


def test_empty_table_and_columns_kept(spark):
    docs = spark.createDataFrame([(1, "good " + " ".join(f"w{i}" for i in range(60)), 7), (1, "bad", 8), (None, None, None)], "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([(None, None), (1, 1)], "doc_id long, quality int")
    assert [tuple(r) for r in quality.filter_documents(docs, labels).select("doc_id", "n_words").collect()] == [(1, 7)]
    assert quality.filter_documents(docs.limit(0), labels.limit(0)).count() == 0


def test_boosting_is_monotone_and_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=3000)) > 0).astype(float)
    forest = boosting.fit(x, y, np.array([1, -1, 0]))
    assert ((forest.score(x) > 0.5) == y).mean() > 0.9
    probe = np.repeat(rng.normal(size=(50, 3)), 40, axis=0)
    for f, sign in ((0, 1), (1, -1)):
        moved = probe.copy()
        moved[:, f] = np.tile(np.linspace(-3, 3, 40), 50)
        assert (np.diff(forest.score(moved).reshape(50, 40), axis=1) * sign >= -1e-12).all()


@pytest.mark.parametrize("y", [np.zeros(5), np.ones(5)])
def test_one_label_only(y):
    assert boosting.fit(np.zeros((5, 2)), y, np.zeros(2)).score(np.zeros((2, 2))).shape == (2,)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    rows = quality.judge(docs.join(labels.where(part), "doc_id"), quality.train(docs, labels.where(~part)), keep=("doc_id", "quality")).where("not base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.9
