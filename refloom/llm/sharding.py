"""Sharding by a hierarchical weighted hash tree.

Shards are the leaves of a tree of regions and racks; the weight of a node is the sum of its leaves.  A key starts
at the root and at every level goes to the child with the smallest draw -ln(u) / weight, where u in (0, 1) is a hash
of the key and the child's name.  The chance of a child is its share of the weight.  A draw depends on its own child
only, so a changed weight moves keys between that child and its siblings and nowhere else.

``grow`` adds one shard in a region of its own.  No other weight changes, so the added shard takes keys and no key
moves between old shards.

Nulls and ties: a null key hashes as the empty text; equal draws go to the child listed first; a null text has size
1 and the checksum of an empty text; repeated keys go to the same shard and get different slots.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.plans.ordering import global_positions


@dataclass(frozen=True)
class Tree:
    """(region, rack, shard number, weight) of every leaf."""

    leaves: tuple[tuple[str, str, int, float], ...]

    @property
    def shards(self) -> int:
        return len(self.leaves)

    def children(self, prefix: tuple[str, ...]) -> list[tuple[str, float]]:
        """Names and weights one level below a region or rack, in listed order."""
        found: dict[str, float] = {}
        for region, rack, shard, weight in self.leaves:
            path = (region, rack, str(shard))
            if path[: len(prefix)] == prefix:
                found[path[len(prefix)]] = found.get(path[len(prefix)], 0.0) + weight
        return list(found.items())


def balanced(regions: int, racks: int, shards: int) -> Tree:
    """Equal weights; shard numbers count up from 0."""
    spots = [(r, k) for r in range(regions) for k in range(racks) for _ in range(shards)]
    return Tree(tuple((f"region{r}", f"region{r}.rack{k}", i, 1.0) for i, (r, k) in enumerate(spots)))


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """One more shard, in a new region."""
    names = {leaf[0] for leaf in tree.leaves}
    region = next(f"region{i}" for i in range(len(names) + 1) if f"region{i}" not in names)
    return Tree((*tree.leaves, (region, f"{region}.rack0", tree.shards, weight)))


def _draw(key: Column, name: str, weight: float) -> Column:
    word = F.conv(F.substring(F.md5(F.concat_ws("|", key, F.lit(name)).cast("binary")), 1, 12), 16, 10).cast("double")
    return -F.log((word + 0.5) / F.lit(float(1 << 48))) / F.lit(weight)


def _descend(tree: Tree, key: Column, prefix: tuple[str, ...]) -> Column:
    options = tree.children(prefix)
    leaf = len(prefix) == 2
    below = [F.lit(int(n)) if leaf else _descend(tree, key, (*prefix, n)) for n, _ in options]
    if len(options) == 1:
        return below[0]
    draws = [_draw(key, n if not leaf else f"shard{n}", w) for n, w in options]
    least = F.least(*draws)
    picked = reduce(lambda rest, i: F.when(draws[i] == least, below[i]).otherwise(rest), reversed(range(len(options) - 1)), below[-1])
    return picked


def shard_of(tree: Tree, key: Column) -> Column:
    return _descend(tree, F.coalesce(key.cast("string"), F.lit("")), ()).cast("int")


def shard_documents(docs: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, grown_shard and slot, gapless from 0 in each shard in the order of key and checksum."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        shard_of(tree, F.col(key)).alias("shard"), shard_of(grow(tree), F.col(key)).alias("grown_shard"),
    )
    placed = global_positions(rows, ["shard", key, "text_crc32", "size"], "_place")
    firsts = placed.groupBy(F.col("shard").alias("_shard")).agg(F.min("_place").alias("_first"))
    # one row per shard, so its size is bounded by the tree
    joined = placed.join(F.broadcast(firsts), F.col("shard") == F.col("_shard"))
    return joined.select(*rows.columns, (F.col("_place") - F.col("_first")).alias("slot"))
