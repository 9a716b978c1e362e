"""BPE against the library that the vocabulary is made for."""

from __future__ import annotations

import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from refloom.llm import bpe

FILE = public_tokenizers.path("word_bpe_49k.json")
LIBRARY, OURS = Tokenizer.from_file(FILE), bpe.Bpe(FILE)
TEXTS = [
    None, "", "a", " \n", "<|endoftext|>x<|startoftext|> y", "<|endoftext", "<|ENDOFTEXT|>", "İstanbul ΣΑΣ ﬁ Å é", "don't I'LL we've 's",
    "\x1c\x1d a b　c", "\U0001f600\U0001f600 日本語", "٣٤ ½ ²", "a" * 5000, "ab" * 3000, "!!!???...", "́x", "x퟿​﻿ y\x00z\x85w", "word " * 20000, "b'x' str",
]


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return " ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False)


def test_odd_texts():
    for text, got in zip(TEXTS, OURS.encode([t or "" for t in TEXTS])):
        assert got == expected(text), text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), st.sampled_from("the ing'sAEé\n")), max_size=60), max_size=4))
def test_any_text(texts):
    assert OURS.encode(texts) == [expected(t) for t in texts]


def test_decode_leaves_unknown_ids_out():
    assert OURS.decode([320, 10**9, 320]) == LIBRARY.decode([320, 320], skip_special_tokens=False)


def test_documents(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, "a b", "y")], "doc_id long, text string, ids string")
    rows = bpe.encode_digests(docs.repartition(3), FILE).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text in [*enumerate(TEXTS), (0, "a b")]:
        ids, decoded = expected(text)
        want.append((i, len(ids.split()), sha(ids), sha(decoded)))
    assert sorted(map(tuple, rows)) == sorted(want)
    assert bpe.encode_digests(docs.limit(0), FILE).count() == 0
    assert bpe.encode_documents(docs.where("doc_id = 8"), FILE).collect()[0].ids == LIBRARY.encode(TEXTS[8], add_special_tokens=False).ids
