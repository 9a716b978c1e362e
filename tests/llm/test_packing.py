"""Packing against the tokenizers library and against the definition of a packing."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from refloom.llm import packing
from refloom.llm.queries import QUERIES, table, vocabulary

SF = "/root/testdata/sf0.001"


def tile(counts, full, window, least):
    """Every piece of every document lies in exactly one slot; returns the length of each sequence."""
    found = packing.plan(counts, full, window, least)
    parts, places = defaultdict(list), defaultdict(list)
    for r, low, high, start, length, sequence, offset, _ in found.slots:
        for k in range(low, high):
            parts[r, k].append((start, length))
            places[sequence + k - low].append((offset, length))
    for r, n in counts.items():
        for k in range(n):
            at = 0
            for start, length in sorted(parts.pop((r, k))):
                assert start == at and length > 0
                at += length
            assert at == r
    assert not parts and sorted(places) == list(range(full, found.sequences))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
    return [max(o + n for o, n in spans) for _, spans in sorted(places.items())]


@pytest.mark.parametrize("seed", range(12))
def test_plan_leaves_padding_in_one_sequence_at_most(seed):
    rng = random.Random(seed)
    window, least = rng.choice([(64, 8), (64, 64), (128, 16), (16, 1)])
    lengths = rng.sample(range(1, window), rng.randint(1, min(20, window - 1)))
    sizes = tile({n: rng.choice([1, 2, 7, 40]) for n in lengths}, seed, window, least)
    assert len([s for s in sizes if s != window and (s & (s - 1) or s < least)]) <= 1


@pytest.mark.parametrize("counts", [{}, {60: 50}, {33: 100}, {1: 1000}, {63: 1}, {40: 3, 24: 3}])
def test_plan_of_single_lengths(counts):
    sizes = tile(counts, 0, 64, 8)
    assert sum(sizes) == sum(k * n for k, n in counts.items())
    assert sum(-s % 64 for s in sizes if s & (s - 1)) < 64


def check(docs, rows, window):
    """rows: (doc_id, start, length, ids, doc_tokens, sequence_id, offset)"""
    library = Tokenizer.from_file(vocabulary())
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in docs}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc_id, start, length, data, tokens, sequence, offset in rows:
        by_doc[doc_id].append((start, length, data, tokens))
        by_sequence[sequence].append((offset, length))
    assert by_doc.keys() == ids.keys()
    for doc_id, parts in by_doc.items():
        at = 0
        for start, length, data, tokens in sorted(parts):
            want = np.array(ids[doc_id][start : start + length], "<u4").tobytes()
            assert start == at and tokens == len(ids[doc_id]) and data in (want, zlib.crc32(want))
            at += length
        assert at == len(ids[doc_id])
    sizes = []
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        sizes.append(at)
    assert max(sizes, default=0) <= window
    assert sum(window - s for s in sizes if s & (s - 1)) < window
    return by_sequence


def test_query(spark):
    rows = QUERIES["op13_packing"](spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    check(docs, [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in rows], 2048)


def test_odd_documents_and_step_groups(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "<|endoftext|> a<|startoftext|>B <|x", "Ä" * 9_000, "don't 12 x y  z", "ΣΑΣ ́é"]
    texts += [" ".join(rng.choice(["alpha", "b", "Zeta9", "...", "naïve"]) for _ in range(rng.randint(1, 400))) for _ in range(300)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("key", F.lit(1)).withColumn("part", F.lit("x"))
    out = packing.pack_documents(df, vocabulary(), window=256, least=32, step=4096)
    rows = out.collect()
    check(docs, [(r.doc_id, r.start, r.length, bytes(r.ids), r.doc_tokens, r.sequence_id, r.offset) for r in rows], 256)
    dealt = defaultdict(Counter)
    for group, tier, _ in {(r.step_group, r.tier, r.sequence_id) for r in rows}:
        dealt[tier][group] += 1
    groups = {r.step_group for r in rows}
    assert len(groups) > 2
    for counts in dealt.values():
        assert max(counts[g] for g in groups) - min(counts[g] for g in groups) <= 1


def test_repeated_and_missing_rows(spark):
    df = spark.createDataFrame([(None, None), (None, None), (1, "same"), (1, "same")], "doc_id int, text string")
    rows = packing.pack_documents(df, vocabulary()).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (0, 1), (1, 2), (1, 2)] and len({(r.sequence_id, r.offset) for r in rows}) == 4
    assert packing.pack_documents(df.limit(0), vocabulary()).count() == 0


def test_words_are_forgotten_within_bounds(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBER", 10)
    import pyarrow as pa

    encoder, library = packing.Encoder(vocabulary()), Tokenizer.from_file(vocabulary())
    for text in ("one two three four", "two five", "one six"):
        assert encoder.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(encoder.known) <= 4


def test_words_as_the_library_splits_them():
    import pyarrow as pa

    encoder, library = packing.Encoder(vocabulary()), Tokenizer.from_file(vocabulary())
    rng = random.Random(9)
    signs = ["a", "B", "7", ".", ",", "!", "'", "(", "\u20ac", "\u0301", "H\u0331", "\u00c9", "\u00e9", "\u00df", "\u00f7", "\u0149", " ", "\n", "\u00a0", "\u2003", "-", ":", "s", "<", "|", ">"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3_000)]
    got = encoder.encode(pa.array([*texts, None, ""], pa.string()))
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in [*texts, "", ""]]
