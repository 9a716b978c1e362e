"""Substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from refloom.llm import substrings


def brute(docs, window=50):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    least = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(400)}é"
    passage = [word() for _ in range(70)]
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (None, " ".join(passage)), (90, " ".join(passage)), (91, " ".join(passage[:49]))]
    for i in range(100, 140):
        body = [word() for _ in range(rng.randrange(0, 200))]
        cut = rng.randrange(0, len(body) + 1)
        a, z = sorted((rng.randrange(0, 71), rng.randrange(0, 71)))
        docs.append((i, "\n".join(body[:cut] + passage[a:z] + body[cut:])))
    docs += [(i + 200, t) for i, t in docs[10:20]] + [docs[12], docs[13], (112, " ".join(passage))]
    docs += [(500, "same " * 30000), (501, "same " * 120), (502, "same " * 49)]
    return docs


@pytest.mark.parametrize("buckets", [3, 40])
def test_documents(spark, buckets, monkeypatch):
    docs = cases()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, places string")
    got = substrings.dedup_substrings(df.repartition(5), digest=True, buckets=buckets).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs)


def test_texts_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b  c d"), (2, "x a b c d y")], "doc_id long, text string")
    assert sorted(map(tuple, substrings.dedup_substrings(df, window=4).collect())) == [(1, 4, 0, "a b c d"), (2, 6, 4, "x y")]
    assert substrings.dedup_substrings(df.limit(0)).count() == 0
