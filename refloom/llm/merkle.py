"""Merkle manifest of a dataset by exchanging superblocks of subtrees.

A row's leaf is the digest of its fields; the leaves of a group, in order, are the lowest level of a binary hash tree, and
the groups' roots are the leaves of one tree above.  A superblock is an aligned subtree of ``BITS`` levels.  On the way up
the nodes of a superblock meet in one task and become its root, and superblock roots are the nodes of the next stage.  On the
way down the nodes of a superblock are cogrouped with the outer nodes that all of them need, namely the proof of the
superblock's root: one task finishes the local reduction again, joins local and outer proof, and folds what was found.
Stages grow with the logarithm of the rows; no task holds more than 2**``BITS`` nodes of a superblock.

Nulls and ties: a null field is ``-``; a null group comes first and is a tree of its own; a null order value comes first;
equal order values follow their leaves, and repeated rows are leaves of their own; a tree of one leaf has that leaf as root;
an empty table gives an empty manifest.  Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.plans.ordering import global_positions
from refloom.plans.runtime import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BITS = 10


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    """SHA-256 of each field's byte count and value, ``-`` where it is null."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def reduced(hashes: list[str], count: int, bits: int) -> list[list[str]]:
    """Levels of one superblock from its nodes to its root, where the whole tree has ``count`` nodes at this stage."""
    levels = [hashes]
    while (len(levels) <= bits) if count > 1 << bits else (len(levels[-1]) > 1):
        last = levels[-1]
        levels.append([digest(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def path(levels: list[list[str]], at: int) -> list[str]:
    """Siblings of a node from its level to the root, with the side they stand on; empty where a node is alone."""
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append("" if other >= len(level) else ("L" if other < at else "R") + level[other])
        at >>= 1
    return out


def fold(node: str, siblings: list[str]) -> str:
    for s in siblings:
        node = digest(s[1:], node) if s[:1] == "L" else digest(node, s[1:])
    return node


def _raise(nodes: DataFrame, bits: int) -> DataFrame:
    """(tree, pos, count, hash) of the superblock roots."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        count = int(pdf["count"].iloc[0])
        root = reduced(pdf["hash"].tolist(), count, bits)[-1][0]
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "pos": [int(pdf["pos"].iloc[0]) >> bits], "count": [-(-count // (1 << bits))], "hash": [root]})

    blocks = nodes.select("tree", F.shiftright("pos", bits).alias("block"), "pos", "count", "hash")
    return blocks.groupBy("tree", "block").applyInPandas(run, "tree string, pos long, count long, hash string")


def _exchange(nodes: DataFrame, outer: DataFrame, bits: int, columns: str, finish: Callable[[pd.DataFrame, list[list[str]], pd.Series], dict]) -> DataFrame:
    """Cogroups the nodes of each superblock with its root's row of ``outer`` and lets ``finish`` make the output columns."""

    def run(inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("pos")
        own = reduced(inner["hash"].tolist(), int(inner["count"].iloc[0]), bits)
        top = above.iloc[0]
        proofs = [[*path(own, i), *top["proof"]] for i in range(len(inner))]
        return pd.DataFrame(finish(inner, proofs, top))

    left = nodes.withColumn("block", F.shiftright("pos", bits)).groupBy("tree", "block")
    return left.cogroup(outer.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInPandas(run, columns)


def _climb(nodes: DataFrame, most: int, bits: int) -> list[DataFrame]:
    """Stages from ``nodes`` to one node a tree."""
    stages = [nodes]
    while most > 1:
        stages.append(cut(_raise(stages[-1], bits)).df)
        most = -(-most // (1 << bits))
    return stages


def _proofs(inner: pd.DataFrame, proofs: list[list[str]], top: pd.Series) -> dict:
    return {"tree": inner["tree"], "pos": inner["pos"], "proof": proofs, "subroot": top["subroot"]}


def _leaves(inner: pd.DataFrame, proofs: list[list[str]], top: pd.Series) -> dict:
    folded = [fold(node, proof) for node, proof in zip(inner["found"], proofs)]
    return {"key": inner["key"], "leaf": inner["hash"], "subroot": top["subroot"], "proof": proofs, "folded_root": folded}


def manifest(docs: DataFrame, found: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", bits: int = BITS) -> DataFrame:
    """order, leaf, subroot, root, proof (siblings with side L or R; empty: none), folded_root and verified of each row.

    ``found`` gives the values that some fields have when the manifest is checked; the fold starts from their leaf.
    """
    now = {f: F.col(f) for f in fields} | (found or {})
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"), F.col(order).alias("key"),
        leaf_of([F.col(f) for f in fields]).alias("hash"), leaf_of([now[f] for f in fields]).alias("found"),
    )
    placed = global_positions(rows, ["tree", "key", "hash"], "_place")
    trees = cut(placed.groupBy(F.col("tree").alias("_tree")).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("count")))
    leaves = placed.join(trees.hinted(), F.col("tree") == F.col("_tree")).select("tree", (F.col("_place") - F.col("_first")).alias("pos"), "count", "hash", "key", "found")
    stages = _climb(leaves, trees.df.agg(F.max("count").alias("n")).first()["n"] or 0, bits)

    names = cut(global_positions(stages[-1].select("tree", "hash"), ["tree"], "pos"))
    upper = names.df.select(F.lit("").alias("tree"), "pos", F.lit(names.rows).cast("long").alias("count"), "hash")
    tops = _climb(upper, names.rows, bits)
    root = tops[-1].select("hash").first()
    root = root["hash"] if root else None

    outer = tops[-1].select("tree", "pos", F.array().cast("array<string>").alias("proof"), F.lit(root).cast("string").alias("subroot"))
    inner = "tree string, pos long, proof array<string>, subroot string"
    for stage in reversed(tops[:-1]):
        outer = cut(_exchange(stage, outer, bits, inner, _proofs)).df
    outer = outer.select(F.col("pos").alias("_pos"), "proof").join(names.df, F.col("_pos") == F.col("pos")).select("tree", F.lit(0).cast("long").alias("pos"), "proof", F.col("hash").alias("subroot"))
    for stage in reversed(stages[1:-1]):
        outer = cut(_exchange(stage, outer, bits, inner, _proofs)).df
    columns = f"key {rows.schema['key'].dataType.simpleString()}, leaf string, subroot string, proof array<string>, folded_root string"
    # where every tree is a lone leaf there is no stage above the leaves, and a superblock holds that leaf
    out = _exchange(leaves, outer, bits, columns, _leaves)
    return out.select(F.col("key").alias(order), "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof", "folded_root", (F.col("folded_root") == F.lit(root).cast("string")).alias("verified"))
