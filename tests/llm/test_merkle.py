"""Merkle manifest against a tree built level by level in plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from refloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n = row
    values = [doc_id, source, lang, None if n is None else n + more, text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """(root, [(left siblings first, proof hashes with side)] of each node)"""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(at):
            o = p ^ 1
            proofs[i].append((None, "") if o >= len(level) else ("L" if o < p else "R", level[o]))
            at[i] = p // 2
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], proofs


def brute(rows, tampered):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {n: sorted(groups[n], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for n in names}
    trees = {n: tree([leaf(r) for r in ordered[n]]) for n in names}
    root, above = tree([trees[n][0] for n in names])
    out = []
    for i, n in enumerate(names):
        for r, own in zip(ordered[n], trees[n][1]):
            node = leaf(r, 1 if tampered(r) else 0)
            for side, x in own + above[i]:
                node = h(x, node) if side == "L" else h(node, x)
            out.append((r[0], leaf(r), trees[n][0], root, [(s or "") + x for s, x in own + above[i]], node, node == root))
    return sorted(out, key=str)


def built(spark, rows, bits):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.lit("clash")).withColumn("tree", F.lit(1))
    out = merkle.manifest(df, {"n_chars": F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, bits=bits)
    return sorted([tuple(r) for r in out.collect()], key=str)


def docs(seed, n, langs):
    rng = random.Random(seed)
    return [(i, rng.choice(["", "ä b", "x" * 50]), rng.choice(langs), rng.choice(["s", None]), rng.choice([None, 5, 99])) for i in rng.sample(range(4 * n), n)]


@pytest.mark.parametrize("n,bits", [(1, 2), (2, 1), (37, 1), (150, 2), (150, 10)])
def test_superblocks_of_any_height(spark, n, bits):
    rows = docs(n, n, ["en", "de", "fr", None, "é"])
    assert built(spark, rows, bits) == brute(rows, lambda r: r[0] % 3 == 0)


def test_one_large_group_beside_lone_leaves(spark):
    rows = docs(5, 90, ["en"]) + [(1_000 + i, "t", f"l{i}", None, None) for i in range(7)]
    assert built(spark, rows, 2) == brute(rows, lambda r: r[0] % 3 == 0)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (3, "same", "en", "s", 1), (3, "same", "en", "s", 1), (3, "other", "en", "s", 1), (6, "y" * 200_000, "en", None, 4), (9, "null count stays", "en", None, None)]
    got = built(spark, rows, 1)
    assert got == brute(rows, lambda r: r[0] is not None and r[0] % 3 == 0)
    assert {r[0] for r in got if not r[6]} == {3, 6}
    assert built(spark, [], 4) == []
