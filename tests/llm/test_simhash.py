"""SimHash components against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from refloom.llm import simhash
from refloom.llm.components import components


def brute_print(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=3):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_documents(spark):
    rng = np.random.default_rng(5)
    base = [f"Word{i}É" for i in rng.integers(0, 50, 400)]
    texts = [None, "", " \n", "One", "one", "one two", "A b c", "x " * 30000]
    for i in range(60):
        words = list(base)
        words[i * 5] = f"edit{i}"
        texts.append(" ".join(words))
    texts += texts[:9]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, print string")
    got = {r.doc_id: (r.print % (1 << 64), r.component_id) for r in simhash.near_components(docs.repartition(3)).collect()}
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    want = brute_components(prints)
    assert got == {i: (prints[i], want[i]) for i in prints}
    assert simhash.near_components(docs.limit(0)).count() == 0


def test_one_of_each_component_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, a), (2, a), (2, b), (3, b), (3, b), (None, a), (None, None), (5, ""), (4, "other"), (4, "other"), (4, "OTHER")]
    df = spark.createDataFrame([(i, t, k, 0) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int, text_id int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, (r.text or "").lower()[:5]) for r in kept.collect()) == [(1, "a0 a1"), (2, "b0 b1"), (4, "other"), (4, "other"), (5, "")]
    assert simhash.keep_one(df.where("k < 2")).count() == 1 and simhash.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_counters(radius):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = np.concatenate([centres] + [centres[rng.integers(0, 12, 300)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, k), dtype=np.uint64), axis=1) for k in (1, 2, 3, 4)])
    group = np.sort(rng.integers(0, 5, len(prints)))
    i, j = simhash.near_pairs(prints, group, radius)
    want = {(a, b) for a in range(len(prints)) for b in range(a + 1, len(prints)) if group[a] == group[b] and int(prints[a] ^ prints[b]).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_hot_key_is_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 16)
    rng = np.random.default_rng(9)
    prints = np.unique(np.concatenate([np.uint64(0xABCDEF0123456789) ^ (np.uint64(1) << rng.integers(0, 20, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 20, 300, dtype=np.uint64)), rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long")
    got = {r.node % (1 << 64): r.component % (1 << 64) for r in components(simhash.near_edges(df)).collect()}
    want = brute_components({int(p): int(p) for p in prints})
    parts = lambda d: {frozenset(k for k in d if d[k] == v) for v in set(d.values())}
    assert parts(got) == {p for p in parts(want) if len(p) > 1}


def test_components_of_a_long_chain(spark):
    rows = [(i, i + 1) for i in range(300)] + [(500, 501), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
