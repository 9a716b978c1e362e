"""Language ID: a linear-chain conditional random field labels the words of a text, also where languages switch.

Features of a word are its prefixes and suffixes (1 to 3 characters), its character bigrams and trigrams and the
languages in whose lexicon it is; all are hashed into slots with one weight for each language.  Transition weights
between the languages of neighbouring words are learned with them.  Forward-backward gives each word a probability for
each language; a text's score for a language is the mean over its words that hold a letter.

The field is fitted on at most ``most`` texts a language, in hash order of the ids, strung together so that switches
occur.  Scoring runs over whole texts: words are cut into segments, the segments' transfer matrices are multiplied
along each text, and all segments of a batch are swept together.

Nulls and ties: a text that is null or has no letter gets `und` and score 0; equal scores go to the language that is
first in the alphabet; rows with a null lang are not learned from; without any language every text gets `und`.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.minimise import lbfgs
from refloom.llm.ngrams import STEP, characters
from refloom.llm.sample import sample_ids, with_sample
from refloom.llm.text import U, Words, buffer, in_small_batches, mix, pieces

BITS, LEXICON, SEGMENT = 15, 200, 64


@dataclass(frozen=True)
class Field:
    languages: tuple[str, ...]
    weights: np.ndarray  # slots x languages
    transitions: np.ndarray  # from x to
    words: np.ndarray  # hashes of the lexicon, sorted
    lexicon: np.ndarray  # words x languages, 1 where the word is in the language's lexicon


class Tokens:
    """The distinct words of a batch of texts and their features."""

    def __init__(self, column: pa.Array):
        data, offsets = buffer(column)
        self.words = words = Words(data, offsets, lower=True)
        hashes, first, self.of = np.unique(words.hashes(), return_index=True, return_inverse=True)
        self.hashes = hashes
        codes, _ = characters(words.data, offsets)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        start, end = np.searchsorted(lead, words.start[first]), np.searchsorted(lead, words.end[first])
        self.slots = self._features(codes, start, end - start)
        letter = np.isin(codes, _letters(codes))
        sums = np.concatenate([[0], np.cumsum(letter)])
        self.letter = (sums[end] - sums[start] > 0)[self.of]

    @staticmethod
    def _features(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct word, slot) pairs."""
        word, slot = [], []

        def add(kind: int, own: np.ndarray, at: np.ndarray, n: int) -> None:
            h = np.full(len(at), U(kind))
            for k in range(n):
                h = h * STEP + codes[at + k]
            word.append(own)
            slot.append((mix(h) >> U(64 - BITS)).astype(np.int64))

        everyone = np.arange(len(size))
        for n in (1, 2, 3):
            own = everyone[size >= n]
            add(10 + n, own, start[own], n)
            add(20 + n, own, start[own] + size[own] - n, n)
        for n in (2, 3):
            count = np.maximum(size - n + 1, 0)
            own = np.repeat(everyone, count)
            add(30 + n, own, start[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count), n)
        return np.concatenate(word), np.concatenate(slot)

    def emissions(self, field: Field) -> np.ndarray:
        """Log potential of each language for each distinct word."""
        word, slot = self.slots
        n = len(self.hashes)
        out = np.stack([np.bincount(word, field.weights[slot, k], n) for k in range(len(field.languages))], axis=1)
        return out + self.in_lexicon(field.words, field.lexicon) @ field.weights[: len(field.languages)]

    def in_lexicon(self, words: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
        if not len(words):
            return np.zeros((len(self.hashes), lexicon.shape[1]))
        at = np.minimum(np.searchsorted(words, self.hashes), len(words) - 1)
        return lexicon[at] * (words[at] == self.hashes)[:, None]


def _letters(codes: np.ndarray) -> np.ndarray:
    """Those of the characters that are letters; a character is the number that its UTF-8 bytes make."""
    found = []
    for code in np.unique(codes).tolist():
        char = int(code).to_bytes(max(1, (int(code).bit_length() + 7) // 8), "big").decode("utf-8", "ignore")
        if char and unicodedata.category(char[0])[0] == "L":
            found.append(code)
    return np.array(found, np.uint64)


def marginals(emissions: np.ndarray, transitions: np.ndarray, starts: np.ndarray, ends: np.ndarray, pairs: bool = False):
    """(probabilities of each word's label, log of the sum over all paths, expected label pairs) of sequences of words.

    Sequence i is words starts[i]:ends[i].  Segments of all sequences are swept together; a segment's transfer matrix
    stands for it when the ends of long sequences are linked.
    """
    n, k = emissions.shape
    peak = emissions.max(axis=1) if n else np.zeros(0)
    e, t = np.exp(emissions - peak[:, None]), np.exp(transitions)
    counts = -(-(ends - starts) // SEGMENT)
    seq = np.repeat(np.arange(len(starts)), counts)
    rank = np.arange(len(seq)) - np.repeat(np.cumsum(counts) - counts, counts)
    low = starts[seq] + rank * SEGMENT
    size = np.minimum(ends[seq] - low, SEGMENT)
    order = np.argsort(-size, kind="stable")
    low, size, seq, rank = low[order], size[order], seq[order], rank[order]
    active = [int(np.searchsorted(-size, -s, "left")) for s in range(SEGMENT)]  # segments longer than s

    matrix, scale = np.tile(np.eye(k), (len(seq), 1, 1)), np.zeros(len(seq))
    for s in range(SEGMENT):
        a = active[s]
        if not a:
            break
        step = (matrix[:a].reshape(-1, k) @ t).reshape(a, k, k) * e[low[:a] + s][:, None, :]
        norm = step.max(axis=(1, 2))
        matrix[:a], scale[:a] = step / norm[:, None, None], scale[:a] + np.log(norm)

    place = np.zeros((len(starts), max(counts.max(initial=0), 1)), np.int64)
    place[seq, rank] = np.arange(len(seq))
    before, after = np.ones((len(seq), k)), np.ones((len(seq), k))
    total = np.zeros(len(starts))
    carried = np.ones((len(starts), k))
    for r in range(counts.max(initial=0)):
        own = np.flatnonzero(counts > r)
        at = place[own, r]
        before[at] = carried[own]
        new = np.einsum("ij,ijk->ik", carried[own], matrix[at])
        norm = new.sum(axis=1)
        total[own] += np.log(norm) + scale[at]
        carried[own] = new / norm[:, None]
    carried = np.ones((len(starts), k))
    for r in range(counts.max(initial=0) - 1, -1, -1):
        own = np.flatnonzero(counts > r)
        at = place[own, r]
        after[at] = carried[own]
        new = np.einsum("ijk,ik->ij", matrix[at], carried[own])
        carried[own] = new / new.sum(axis=1, keepdims=True)
    total += np.bincount(np.repeat(np.arange(len(starts)), ends - starts), np.concatenate([peak[a:z] for a, z in zip(starts, ends)]) if len(starts) else None, minlength=len(starts))

    forward, state = np.zeros((n, k)), before
    for s in range(SEGMENT):
        a = active[s]
        if not a:
            break
        step = (state[:a] @ t) * e[low[:a] + s]
        step /= step.sum(axis=1, keepdims=True)
        forward[low[:a] + s] = step
        state = np.concatenate([step, state[a:]])
    backward, state = np.zeros((n, k)), after
    for s in range(SEGMENT - 1, -1, -1):
        a = active[s]
        if not a:
            continue
        at = low[:a] + s
        backward[at] = state[:a]
        step = (e[at] * state[:a]) @ t.T
        state = np.concatenate([step / step.sum(axis=1, keepdims=True), state[a:]])
    both = forward * backward
    both /= np.maximum(both.sum(axis=1, keepdims=True), 1e-300)
    expected = np.zeros((k, k))
    if pairs:
        first = np.zeros(n, bool)
        first[starts[ends > starts]] = True
        prior = np.roll(forward, 1, axis=0)
        prior[first] = 1.0
        joint = prior[:, :, None] * t[None] * (e * backward)[:, None, :]
        expected = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return both, total.sum(), expected


def fit(texts: list[str], labels: list[str], ridge: float = 1.0, steps: int = 40) -> Field:
    """The field of the greatest penalised likelihood for whole texts of one language each, strung together."""
    languages = tuple(sorted(set(labels)))
    k = len(languages)
    empty = Field(languages, np.zeros((1 << BITS, k)), np.zeros((k, k)), np.zeros(0, np.uint64), np.zeros((0, k)))
    tokens = Tokens(pa.array(texts, pa.string()))
    n = len(tokens.words)
    if k < 2 or n == 0:
        return empty
    gold = np.array([languages.index(x) for x in labels])[tokens.words.doc]
    uses = np.zeros((len(tokens.hashes), k))
    np.add.at(uses, (tokens.of, gold), 1)
    lexicon = np.zeros_like(uses)
    for y in range(k):
        common = np.argsort(-uses[:, y], kind="stable")[:LEXICON]
        lexicon[common[uses[common, y] > 1], y] = 1
    known = lexicon.any(axis=1)
    words, lexicon = tokens.hashes[known], lexicon[known]
    inside = tokens.in_lexicon(words, lexicon)
    word, slot = tokens.slots
    step = 256
    starts = np.arange(0, n, step)
    ends = np.minimum(starts + step, n)
    head = np.zeros(n, bool)
    head[starts] = True
    observed = np.zeros((k, k))
    np.add.at(observed, (np.roll(gold, 1)[~head], gold[~head]), 1)
    size = (1 << BITS) * k

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        field = Field(languages, x[:size].reshape(-1, k), x[size:].reshape(k, k), words, lexicon)
        each = tokens.emissions(field)
        both, total, expected = marginals(each[tokens.of], field.transitions, starts, ends, pairs=True)
        # the pair at the head of a chain has a free label before it
        lead = np.exp(field.transitions)[:, :] / np.exp(field.transitions).sum(axis=0)
        observed_all = observed + lead * np.bincount(gold[head], minlength=k)
        value = total - each[tokens.of, gold].sum() - (observed * field.transitions).sum() - (np.bincount(gold[head], minlength=k) * np.log(np.exp(field.transitions).sum(axis=0))).sum()
        error = np.stack([np.bincount(tokens.of, both[:, y] - (gold == y), len(tokens.hashes)) for y in range(k)], axis=1)
        gradient = np.stack([np.bincount(slot, error[word, y], 1 << BITS) for y in range(k)], axis=1)
        gradient[:k] += inside.T @ error
        full = np.concatenate([gradient.ravel(), (expected - observed_all).ravel()]) + ridge * x
        return float(value + ridge / 2 * (x @ x)) / n, full / n

    x = lbfgs(loss, np.zeros(size + k * k), steps)
    return Field(languages, x[:size].reshape(-1, k), x[size:].reshape(k, k), words, lexicon)


def train(docs: DataFrame, most: int = 60) -> Field:
    """A field fitted on at most ``most`` texts of each language (column lang)."""
    known = docs.where("lang is not null and doc_id is not null and text is not null")
    names = [r[0] for r in known.select("lang").distinct().orderBy("lang").collect()]  # one row for each language
    if not names:
        return fit([], [])
    ids = None
    for name in names:
        part = sample_ids(known.where(F.col("lang") == name).select("doc_id"), most)
        ids = part if ids is None else ids.union(part)
    rows = with_sample(known.select("doc_id", "lang", "text"), ids.distinct()).select("doc_id", "lang", "text", F.xxhash64("doc_id", "text").alias("place")).collect()  # at most `most` texts a language
    rows.sort(key=lambda r: (r.place, r.text))
    return fit([r.text for r in rows], [r.lang for r in rows])


def predict(column: pa.Array, field: Field) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text."""
    tokens = Tokens(column)
    texts, k = len(column), len(field.languages)
    if not len(tokens.words) or not k:
        return ["und"] * texts, np.zeros(texts)
    at = tokens.words.at
    both, _, _ = marginals(tokens.emissions(field)[tokens.of], field.transitions, at[:-1], at[1:])
    doc = tokens.words.doc
    count = np.bincount(doc[tokens.letter], minlength=texts)
    mean = np.stack([np.bincount(doc, both[:, y] * tokens.letter, texts) for y in range(k)], axis=1) / np.maximum(count, 1)[:, None]
    best = np.argmax(mean, axis=1)
    return [field.languages[b] if c else "und" for b, c in zip(best.tolist(), count.tolist())], np.where(count > 0, np.clip(mean[np.arange(texts), best], 0, 1), 0.0)


def identify(docs: DataFrame, field: Field, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of each document with lang_pred and score."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double"])
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            names, score = predict(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return in_small_batches(docs).select(*dict.fromkeys([*keep, "text"])).mapInArrow(rows, schema)
