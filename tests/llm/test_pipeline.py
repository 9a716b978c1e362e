"""The pipeline against the brute-force versions of its stages."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pyarrow as pa
from .test_bpe import expected
from .test_lines import brute as brute_lines
from .test_similar import brute as brute_near

from refloom.llm import decontaminate, quality
from refloom.llm.queries import table

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    forest = quality.train(docs, table(spark, SF, "labels"))
    ids = list(rows)
    base, features = quality.statistics(pa.array([rows[i].text for i in ids], pa.string()))
    good = ~quality.base_failed(base) & (forest.score(features) >= 0.5)
    kept = [(i, rows[i].text) for i, g in zip(ids, good) if g]
    assert np.mean(good) > 0.6

    lined = {i: t for i, t, _, _ in brute_lines(kept)}
    groups = brute_near(lined)  # five-word shingles at a similarity of 0.8
    single = {i: t for i, t in lined.items() if groups[i] == i}
    df = spark.createDataFrame(list(single.items()), "doc_id long, text string")
    leaks = {r.doc_id for r in decontaminate.leaks(df, table(spark, SF, "benchmark")).collect()}
    want = {i: expected(t) for i, t in single.items() if i not in leaks}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (" ".join(map(str, r.ids)), r.decoded) for r in got} == want and len(got) == len(want)


def test_odd_documents(spark):
    docs = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (1, "", "en", "s", 0, 2), (2, "w " * 30, None, None, None, 3)], "doc_id long, text string, lang string, source string, n_chars long, ids int")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            out.count()
            assert name == "encoding" or out.columns == frame.columns
