"""Prefix trie of conversations by time-forward processing.

Every distinct sequence of first turns is a node.  A node's digest is the sum, over its turns, of hashes of (depth, role
and text), 128 bits with the depth; sums run along a conversation in blocks, so a conversation of any length is shared by
many tasks.  Nodes of the same members form an unbranched segment, known by (smallest member, number of members).

Subtree totals go up the segments.  Segments of at most ``MEMBERS`` members hang in whole subtrees below heavier ones;
each subtree is one shard.  A task reads the segments of its shards in reverse level order, takes the totals of their
children out of a spilling priority queue, and sends its own on to the parent through the same queue.  What the roots of
shards send goes to the next round, whose shards are subtrees of at most ``MEMBERS``**2 members without what is done, and so
on: the rounds grow with the logarithm of the conversations.

Nulls and ties: a null role or text is empty; a null turn comes first; turns of equal number follow the order of the digest
of role and text; rows that are repeated count as turns of their own; rows without a conv_id belong to no conversation;
an empty table has no nodes.  Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.spill import SpillingQueue
from refloom.plans.ordering import positions_within
from refloom.plans.runtime import cut, ensure_checkpoint_dir, union_all

MEMBERS = 128
RUN = 10  # bits of a block of a running sum
CHUNK = 1 << 20  # bytes of joined ids that one row holds
LIMBS = ["a", "b", "c", "d"]
NODE = ["id1", "id2", "depth"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def running(df: DataFrame, keys: list[str], at: str, columns: list[str], most: int) -> DataFrame:
    """Adds ``run_<column>``: the sum of each column over the rows of the same keys up to ``at`` (0 to ``most``, unique)."""
    block = F.shiftright(at, RUN)
    frame = Window.partitionBy(*keys, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.withColumn("_block", block).select("*", *[F.sum(c).over(frame).alias(f"run_{c}") for c in columns])
    if most < 1 << RUN:
        return local.drop("_block")
    blocks = df.groupBy(*keys, block.alias("_at")).agg(*[F.sum(c).alias(c) for c in columns])
    carried = running(blocks, keys, "_at", columns, most >> RUN).where("_at > 0")
    carried = carried.select(*[F.col(k).alias(f"_{k}") for k in keys], "_at", *[(F.col(f"run_{c}") - F.col(c)).alias(f"_{c}") for c in columns])
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_block") == F.col("_at")]
    kept = [F.col(c) for c in df.columns]
    return local.join(carried, on, "left").select(*kept, *[(F.col(f"run_{c}") + F.coalesce(f"_{c}", F.lit(0))).alias(f"run_{c}") for c in columns])


def rebuilt(conversations: DataFrame, block: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations with their length, turns with their depth from 1) after the first turns were taken from a block's first.

    The first h = crc32(conv_id) % ``heads`` turns of c come from conversation c - c % ``block``, the rest are its own.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    placed = cut(positions_within(turns, ["conv_id"], ["turn", "digest"])).df
    own = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    own = own.withColumn("head", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
    bases = own.select(F.col("conv_id").alias("_base"), F.col("own").alias("_own"))
    convs = own.join(bases, F.col("base") == F.col("_base"), "left")
    convs = convs.withColumn("kept", F.least("head", F.coalesce("_own", F.lit(0)))).select("conv_id", "base", "head", "kept", (F.col("kept") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("length"))
    convs = cut(convs).df
    ids = convs.withColumnRenamed("conv_id", "_conv")
    late = placed.join(ids, F.col("conv_id") == F.col("_conv")).where("pos >= head").select("conv_id", (F.col("pos") - F.col("head") + F.col("kept") + 1).alias("depth"), "digest", "chars", "length")
    # at most heads - 1 turns of a block's first conversation, each for at most 2 * block - 1 others
    first = placed.where((F.col("conv_id") % block == 0) & (F.col("pos") < heads - 1)).withColumnRenamed("conv_id", "_first")
    early = first.join(convs, F.col("_first") == F.col("base")).where("pos < kept").select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "chars", "length")
    return convs, late.unionByName(early)


def prefixes(turns: DataFrame, most: int) -> DataFrame:
    """Each turn with the digest of the prefix it ends (id1, id2) and of the one before it (up1, up2)."""
    low = F.lit(0xFFFFFFFF)
    x, y = F.xxhash64(F.lit(0), "depth", "digest"), F.xxhash64(F.lit(1), "depth", "digest")
    limbs = [F.shiftrightunsigned(x, 32), x.bitwiseAND(low), F.shiftrightunsigned(y, 32), y.bitwiseAND(low)]
    summed = running(turns.select("conv_id", "depth", "chars", "length", *[v.alias(n) for n, v in zip(LIMBS, limbs)]), ["conv_id"], "depth", LIMBS, most)

    def joined(high: Column, rest: Column) -> Column:
        return F.shiftleft(high.bitwiseAND(low), 32).bitwiseOR(rest.bitwiseAND(low))

    now = [F.col(f"run_{n}") for n in LIMBS]
    before = [F.col(f"run_{n}") - F.col(n) for n in LIMBS]
    return summed.select(
        "conv_id", "depth", "chars", (F.col("depth") == F.col("length")).cast("long").alias("last"),
        joined(*now[:2]).alias("id1"), joined(*now[2:]).alias("id2"), joined(*before[:2]).alias("up1"), joined(*before[2:]).alias("up2"),
    )


def _nodes(convs: DataFrame, rows: DataFrame) -> DataFrame:
    facts = [F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("owner"), F.min("chars").alias("chars"), F.sum("last").alias("ends"), F.min("up1").alias("up1"), F.min("up2").alias("up2")]
    zero = F.lit(0).cast("long")
    top = convs.select("conv_id", zero.alias("depth"), zero.alias("chars"), (F.col("length") == 0).cast("long").alias("last"), *[zero.alias(c) for c in ("id1", "id2", "up1", "up2")])
    return rows.unionByName(top).groupBy(*NODE).agg(*facts).withColumn("saved", (F.col("members") - 1) * F.col("chars"))


def _segments(nodes: DataFrame) -> DataFrame:
    """Unbranched runs of nodes, each with the run that its first node hangs from."""
    found = nodes.groupBy("owner", "members").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("saved").alias("saved"),
        F.max((F.col("ends") == F.col("members")).cast("long")).alias("leaf"),
        F.min_by("up1", "depth").alias("up1"), F.min_by("up2", "depth").alias("up2"), F.max_by("id1", "depth").alias("end1"), F.max_by("id2", "depth").alias("end2"),
    )
    found = cut(found).df
    above = found.select(F.col("owner").alias("up_owner"), F.col("members").alias("up_members"), F.col("bottom").alias("_b"), F.col("end1").alias("_1"), F.col("end2").alias("_2"))
    # a node that children hang from is the last one of its run; AQE splits a parent of very many children
    on = (F.col("up1") == F.col("_1")) & (F.col("up2") == F.col("_2")) & (F.col("top") - 1 == F.col("_b"))
    return cut(found.join(above, on, "left").drop("_b", "_1", "_2", "up1", "up2")).df


def time_forward(segments: DataFrame, rows: DataFrame, nodes: DataFrame, members: int = MEMBERS, memory: int | None = None) -> DataFrame:
    """(owner, bottom, leaves, below, children) of each segment: leaves of its subtree, saved tokens and children under it."""
    folder = ensure_checkpoint_dir(segments.sparkSession)
    folder = folder.removeprefix("file://") if folder.startswith(("file:/", "/")) else None
    folder = folder.removeprefix("file:") if folder else None
    schema = "up boolean, owner long, bottom long, members long, leaves long, below long, children long"
    extra = {} if memory is None else {"memory": memory}

    def shard(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queue = SpillingQueue(5, folder, **extra)
            for batch in batches:
                out = []
                for owner, count, top, bottom, saved, leaf, up_owner, up_members, leaves, below, children in zip(*[c.to_pylist() for c in batch.columns]):
                    key = (-bottom, owner)
                    while (first := queue.first()) is not None and first[:2] == key:
                        got = queue.pop()
                        leaves, below, children = leaves + got[2], below + got[3], children + got[4]
                    leaves += leaf
                    out.append((False, owner, bottom, count, leaves, below, children))
                    if up_owner is None:
                        continue
                    if up_members > most:
                        out.append((True, up_owner, top - 1, up_members, leaves, below + saved, 1))
                    else:
                        queue.push((1 - top, up_owner, leaves, below + saved, 1))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["up", "owner", "bottom", "members", "leaves", "below", "children"])
            if queue.first() is not None:
                raise ValueError("a parent is not in the shard of its child")

        return run

    heaviest = segments.agg(F.max("members").alias("n")).first()["n"] or 0
    sums = ["leaves", "below", "children"]
    done: list[DataFrame] = []
    sent: list[DataFrame] = []
    least, most = 0, members
    while least < heaviest:
        part = segments.where((F.col("members") > least) & (F.col("members") <= most))
        if sent:
            arrived = union_all(sent).where((F.col("members") > least) & (F.col("members") <= most))
            arrived = arrived.groupBy(F.col("owner").alias("_owner"), F.col("bottom").alias("_bottom")).agg(*[F.sum(c).alias(c) for c in sums])
            part = part.join(arrived, (F.col("owner") == F.col("_owner")) & (F.col("bottom") == F.col("_bottom")), "left").drop("_owner", "_bottom")
            part = part.fillna(0, sums)
        else:
            part = part.select("*", *[F.lit(0).cast("long").alias(c) for c in sums])
        if most < heaviest:
            heavy = cut(nodes.where(F.col("members") > most).select(*NODE))
            roots = rows.join(heavy.hinted(), NODE, "left_anti").groupBy(F.col("conv_id").alias("_conv")).agg(F.min_by("id1", "depth").alias("root"))
            part = part.join(roots, F.col("owner") == F.col("_conv"), "left")
        else:
            part = part.withColumn("root", F.lit(0).cast("long"))
        columns = ["owner", "members", "top", "bottom", "saved", "leaf", "up_owner", "up_members", *sums]
        ordered = part.repartition("root").sortWithinPartitions(F.desc("bottom"), "owner").select(*columns)
        out = cut(ordered.mapInArrow(shard(most), schema)).df
        done.append(out.where("NOT up"))
        sent.append(out.where("up"))
        least, most = most, most * members
    return union_all(done).select("owner", "bottom", *sums) if done else segments.select("owner", "bottom", *[F.lit(0).cast("long").alias(c) for c in sums])


def end_digests(ends: DataFrame) -> DataFrame:
    """(id1, id2, depth, ends_sha256): SHA-256 of the ascending conversation ids of each node, joined by commas.

    A sorted range of ids becomes a few long texts first, so that the one task that a digest needs reads few rows.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, 0, [], 0
        for batch in batches:
            out = []
            for id1, id2, depth, conv in zip(*[c.to_pylist() for c in batch.columns]):
                if (id1, id2, depth) != node or size > CHUNK:
                    if held:
                        out.append((*node, first, ",".join(held)))
                    node, first, held, size = (id1, id2, depth), conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            yield from packed(out)
        if held:
            yield from packed([(*node, first, ",".join(held))])

    def packed(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*NODE, "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for id1, id2, depth, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if (id1, id2, depth) == node:
                    sha.update(b",")
                else:
                    if sha:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (id1, id2, depth), hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*NODE, "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, sha.hexdigest())], names=[*NODE, "ends_sha256"])

    ordered = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").select(*NODE, "conv_id")
    texts = ordered.mapInArrow(chunks, "id1 long, id2 long, depth long, first long, ids string")
    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, "id1 long, id2 long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, members: int = MEMBERS) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, chars, n_ends."""
    convs, turns = rebuilt(conversations)
    most = convs.agg(F.max("length").alias("n")).first()["n"] or 0
    rows = cut(prefixes(turns, most)).df
    nodes = cut(_nodes(convs, rows)).df
    segments = _segments(nodes)
    totals = time_forward(segments, rows, nodes, members)
    zero = F.lit(0).cast("long")
    closed = rows.where("last = 1").select(*NODE, "conv_id").unionByName(convs.where("length = 0").select(zero.alias("id1"), zero.alias("id2"), zero.alias("depth"), "conv_id"))
    ends = end_digests(closed).select(F.col("id1").alias("_1"), F.col("id2").alias("_2"), F.col("depth").alias("_d"), "ends_sha256")
    whole = segments.join(totals.select(F.col("owner").alias("_owner"), F.col("bottom").alias("_bottom"), "leaves", "below", "children"), (F.col("owner") == F.col("_owner")) & (F.col("bottom") == F.col("_bottom")))
    whole = whole.join(ends, (F.col("end1") == F.col("_1")) & (F.col("end2") == F.col("_2")) & (F.col("bottom") == F.col("_d")), "left")
    whole = cut(whole.select(F.col("owner").alias("_owner"), F.col("members").alias("_members"), "top", "bottom", F.col("saved").alias("_saved"), "up_owner", "leaves", "below", "children", "ends_sha256")).df
    summed = running(nodes.select("owner", "members", "depth", "chars", "ends", "saved"), ["owner", "members"], "depth", ["saved"], most)
    joined = summed.join(whole, (F.col("owner") == F.col("_owner")) & (F.col("members") == F.col("_members")))
    bottom = F.col("depth") == F.col("bottom")
    return joined.select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("top"), F.col("up_owner")).otherwise(F.col("owner")).alias("parent_conv_id"),
        F.col("members").alias("n_convs"), F.when(bottom, F.col("children")).otherwise(F.lit(1)).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("below") + F.col("_saved") - F.col("run_saved") + F.col("saved")).alias("saved_tokens"),
        F.coalesce(F.when(bottom, F.col("ends_sha256")), F.lit(NO_ENDS)).alias("ends_sha256"), "chars", F.col("ends").alias("n_ends"),
    )
