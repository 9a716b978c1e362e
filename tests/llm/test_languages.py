"""Language ID: forward-backward against enumeration, its gradient, held-out accuracy, edge cases."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from refloom.llm import languages
from refloom.llm.sample import remainder


@pytest.mark.parametrize("segment", [2, 3, 64])
def test_forward_backward(monkeypatch, segment):
    monkeypatch.setattr(languages, "SEGMENT", segment)
    rng = np.random.default_rng(segment)
    lengths = [0, 1, 5, 7, 0, 2]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    e, t = rng.normal(size=(ends[-1], 3)), rng.normal(size=(3, 3))
    both, total, pairs = languages.marginals(e, t, starts, ends, pairs=True)
    want, log_all, want_pairs = np.zeros_like(e), 0.0, np.zeros((3, 3))
    for a, z in zip(starts, ends):
        if a == z:
            continue
        sums, z_all, p = np.zeros((z - a, 3)), 0.0, np.zeros((3, 3))
        for path in product(range(3), repeat=int(z - a) + 1):  # with a free label before the first word
            w = np.exp(sum(t[path[i], path[i + 1]] + e[a + i, path[i + 1]] for i in range(z - a)))
            z_all += w
            for i in range(z - a):
                sums[i, path[i + 1]] += w
                p[path[i], path[i + 1]] += w
        want[a:z], log_all, want_pairs = sums / z_all, log_all + np.log(z_all), want_pairs + p / z_all
    assert np.allclose(both, want) and np.isclose(total, log_all) and np.allclose(pairs, want_pairs)


def test_code_switched_words():
    de, en = "der die und nicht schön ung keit lich", "the and of that with ing tion was"
    field = languages.fit([de * 3 + " ", en * 3, de, en, f"{de} {de}", f"{en} {en}"], ["de", "en"] * 3)
    tokens = languages.Tokens(pa.array([f"{de} {en}"]))
    both, _, _ = languages.marginals(tokens.emissions(field)[tokens.of], field.transitions, np.array([0]), np.array([16]))
    assert (both[:8, 0] > 0.5).all() and (both[8:, 1] > 0.5).all()


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = languages.train(docs.where(remainder("doc_id", 4) != 2), most=30)
    rows = languages.identify(docs.where(remainder("doc_id", 4) == 2), field, keep=("doc_id", "lang")).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_edges(spark):
    rows = [(1, None, "en", 1.0), (2, "", "en", 1.0), (3, "12 34 !", None, 1.0), (4, "the and of", "en", 1.0), (4, "der die und", "de", 1.0), (None, "été là", "fr", 1.0), (5, "und der " * 20000, None, 1.0), (6, "日本", None, 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {(r.doc_id, r.lang_pred): r.score for r in languages.identify(docs, languages.train(docs)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "de"), (5, "de")} <= set(got)
    assert all(0 <= s <= 1 for s in got.values()) and got[1, "und"] == 0
    none = docs.where("lang is null")
    assert {r.lang_pred for r in languages.identify(docs, languages.train(none)).collect()} == {"und"}
    assert languages.identify(docs.limit(0), languages.train(docs)).count() == 0
    one = docs.where("doc_id = 4 and lang = 'en'")
    assert {r.lang_pred for r in languages.identify(one, languages.train(one)).collect()} == {"en"}
