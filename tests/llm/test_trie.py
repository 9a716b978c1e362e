"""Prefix trie against a brute-force version over dictionaries."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from refloom.llm import trie
from refloom.llm.spill import SpillingQueue

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            body = (role or "").encode(), (text or "").encode()
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(body[0])}:".encode() + body[0] + body[1]).hexdigest(), role or "", text or ""))
    whole = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (abs(conv) % 100 if conv >= 0 else -(abs(conv) % 100))
        whole[conv] = tuple(x[3:] for x in sorted(own.get(base, []))[:h] + sorted(own[conv])[h:])
    members = defaultdict(list)
    for conv, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = []
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[c] for c in children[path]) if path in children and children[path] else 1
        saved[path] = sum(saved[c] for c in children[path]) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
        ends = ",".join(str(c) for c in sorted(c for c in members[path] if len(whole[c]) == len(path)))
        out.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows, **kw):
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), **kw)
    return sorted([tuple(r) for r in got.select(*COLUMNS).collect()], key=str)


def sample(seed, convs, most, words):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for c in rng.sample(range(-150, 450), convs) for t in range(rng.randint(1, most))]
    return rows


@pytest.mark.parametrize("members", [2, 5, 128])
def test_shards_of_any_size_give_the_same_trie(spark, members):
    rows = sample(1, 60, 7, ["", "a", "äé", None])
    assert built(spark, rows, members=members) == brute(rows)


def test_odd_rows(spark):
    rows = sample(2, 20, 4, ["x", None])
    rows += [(None, 0, "user", "x"), (7, None, "user", "first"), (7, None, None, None), (7, 3, "b", "tie"), (7, 3, "a", "tie"), (7, 3, "a", "tie"), (800, 0, "user", "y" * 100_000), (801, 0, "user", "lost")]
    assert built(spark, rows) == brute(rows)
    assert built(spark, []) == []
    clash = spark.createDataFrame([(1, 0, "u", "t", 5, 6, "z")], SCHEMA + ", id1 long, members long, _block string")
    assert clash.transform(trie.prefix_trie).count() == len(brute([(1, 0, "u", "t")]))


def test_long_conversation_and_hot_turn(spark):
    rows = [(0, t, "user", f"t{t % 7}") for t in range(2_500)] + [(c, 0, "system", "same") for c in range(200, 500)] + [(c, t, "user", f"{c // 50}") for c in range(200, 500) for t in (1, 2)]
    assert built(spark, rows, members=16) == brute(rows)


def test_queue_spills_and_stays_in_order(tmp_path):
    rng = random.Random(3)
    queue, want, got = SpillingQueue(2, str(tmp_path), memory=50), [], []
    for _ in range(5_000):
        if rng.random() < 0.6 or not want:
            record = (rng.randrange(1_000), rng.randrange(10))
            queue.push(record)
            want.append(record)
        else:
            want.sort()
            got.append(queue.pop())
            assert got[-1] == want.pop(0)
    assert len(queue.runs) > 5 and sorted(want) == [queue.pop() for _ in want] and queue.first() is None


def test_totals_with_a_spilling_queue(spark):
    rows = sample(4, 80, 6, ["a", "b"])
    df = spark.createDataFrame(rows, SCHEMA)
    convs, turns = trie.rebuilt(df)
    found = trie.prefixes(turns, 10).cache()
    nodes = trie._nodes(convs, found).cache()
    segments = trie._segments(nodes)
    small, large = (sorted(map(tuple, trie.time_forward(segments, found, nodes, memory=m).collect())) for m in (3, 10_000))
    assert small == large
