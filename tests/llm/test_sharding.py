"""Sharding against an independent draw in plain Python."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

from refloom.llm import sharding
from refloom.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"


def draw(key, name, weight):
    word = int(hashlib.md5(f"{key}|{name}".encode()).hexdigest()[:12], 16)
    return -math.log((word + 0.5) / 2.0**48) / weight


def descend(leaves, key):
    """The shard of a key: at each level the child with the least draw, its weight the sum of its leaves."""
    for level in range(3):
        weights = {}
        for leaf in leaves:
            name = leaf[level] if level < 2 else f"shard{leaf[2]}"
            weights[name] = weights.get(name, 0.0) + leaf[3]
        best = min(weights, key=lambda n: draw(key, n, weights[n]))
        leaves = [x for x in leaves if (x[level] if level < 2 else f"shard{x[2]}") == best]
    return leaves[0][2]


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    leaves = [(f"region{i // 8}", f"region{i // 8}.rack{i // 4 % 2}", i, 1.0) for i in range(16)]
    more = [*leaves, ("region2", "region2.rack0", 16, 1.0)]
    rows = QUERIES["op8_sharding"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        body = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(body) + 1, zlib.crc32(body), "key")
        assert r.shard == descend(leaves, r.doc_id) and r.grown_shard == descend(more, r.doc_id)
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("weights", [(1.0, 1.0, 1.0, 1.0), (5.0, 1.0, 1.0, 1.0)])
def test_changed_weight_moves_keys_to_or_from_its_subtree_only(spark, weights):
    leaves = [(f"r{i // 2}", f"r{i // 2}.k", i, w) for i, w in enumerate(weights)]
    changed = [*leaves[:3], (*leaves[3][:3], 4.0)]
    df = spark.range(2_000).selectExpr("id AS doc_id", "'' AS text")
    one, two = ({r.doc_id: r.shard for r in sharding.shard_documents(df, sharding.Tree(tuple(t))).collect()} for t in (leaves, changed))
    assert one == {i: descend(leaves, i) for i in range(2_000)} and two == {i: descend(changed, i) for i in range(2_000)}
    assert all(two[i] in (2, 3) for i in one if one[i] != two[i])  # r1 alone gained weight
    share = Counter(one.values())[0] / 2_000
    assert abs(share - weights[0] / sum(weights)) < 0.05


def test_odd_rows(spark):
    rows = [(None, None, 1), (None, None, 1), (7, "same", 2), (7, "same", 2), (8, "", 3), (9, "y" * 100_000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    got = sharding.shard_documents(df, sharding.balanced(2, 2, 4)).collect()
    assert len(got) == 6 and len({(r.shard, r.slot) for r in got}) == 6
    assert [r.size for r in got if r.doc_id is None] == [1, 1] and {r.text_crc32 for r in got if r.doc_id is None} == {0}
    for shard, n in Counter(r.shard for r in got).items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    assert sharding.shard_documents(df.limit(0), sharding.balanced(2, 2, 4)).count() == 0
