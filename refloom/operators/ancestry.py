"""Parent chains by pointer doubling: jobs grow with the logarithm of the depth, not with the depth.

``jumps`` gives, for k = 0, 1, ..., every node's ancestor 2**k steps up.  Depths add up while the pointers double, a subtree
doubles its reach with each table, and a node's ancestor any number of steps up takes one join for each bit of that number.
A chain longer than the table has rows runs into a cycle; such nodes are set apart and climbed step by step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.plans.runtime import Cut, Levels, cut


@dataclass(frozen=True)
class Chains:
    """``up[k]``: (node, at), the ancestor 2**k steps up; ``depth``: (node, depth) of all but roots; ``looped``: (node) or None."""

    up: list[DataFrame]
    depth: DataFrame
    looped: DataFrame | None


def jumps(parents: DataFrame) -> Chains:
    """Doubled pointers of (child, parent), where each child has one parent."""
    known = F.col("child").isNotNull() & F.col("parent").isNotNull()
    state = cut(parents.where(known).select(F.col("child").alias("node"), F.col("parent").alias("at"), F.lit(1).cast("long").alias("depth")).distinct())
    rows, up = state.rows, []
    while True:
        pointing = state.df.where("at IS NOT NULL")
        if pointing.isEmpty():
            return Chains(up, state.df.select("node", "depth"), None)
        up.append(pointing.select("node", "at"))
        if 1 << (len(up) - 1) > rows:
            return Chains(up, state.df.where("at IS NULL").select("node", "depth"), pointing.select("node"))
        above = state.df.select(F.col("node").alias("_node"), F.col("at").alias("_at"), F.col("depth").alias("_depth"))
        state = cut(state.df.join(above, F.col("at") == F.col("_node"), "left").select("node", F.col("_at").alias("at"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")))


def descendants(parents: DataFrame, seeds: DataFrame) -> DataFrame:
    """(root, node): each seed (root, node) with everything below it, itself included."""
    chains = jumps(parents)
    reach = cut(seeds.select("root", "node").distinct())
    for table in chains.up:
        below = table.select(F.col("node").alias("_node"), F.col("at").alias("_at"))
        more = below.join(reach.hinted(), F.col("_at") == F.col("node")).select("root", F.col("_node").alias("node"))
        both = reach.df.unionByName(more)
        # a seed below another gives pairs of its own; only a cycle brings a pair twice
        reach = cut(both.distinct() if chains.looped is not None else both)
    return reach.df


def below(pairs: DataFrame, parents: DataFrame) -> DataFrame:
    """The distinct (ancestor, candidate) of ``pairs`` whose candidate lies below the ancestor.

    The candidate is lifted by the difference of the two depths, one join for each of its bits, and compared once.
    """
    chains = jumps(parents)
    asked = pairs.select("ancestor", "candidate").distinct()
    depth = lambda side: chains.depth.select(F.col("node").alias(side), F.col("depth").alias(f"_{side}"))
    open_ = asked
    if chains.looped is not None:
        loose = chains.looped.withColumnRenamed("node", "candidate")
        open_ = asked.join(loose, "candidate", "left_anti")
    lifted = open_.join(depth("candidate"), "candidate").join(depth("ancestor"), "ancestor", "left")
    lifted = lifted.select("ancestor", "candidate", F.col("candidate").alias("at"), (F.col("_candidate") - F.coalesce("_ancestor", F.lit(0))).alias("rise")).where("rise > 0")
    for k, table in enumerate(chains.up):
        step = table.select(F.col("node").alias("_node"), F.col("at").alias("_up"))
        bit = F.shiftright("rise", k).bitwiseAND(F.lit(1)) == 1
        # rows without this bit find no partner and keep their place
        lifted = lifted.join(step, (F.col("at") == F.col("_node")) & bit, "left")
        lifted = lifted.select("ancestor", "candidate", F.coalesce("_up", "at").alias("at"), "rise")
    hit = lifted.where(F.col("at") == F.col("ancestor")).select("ancestor", "candidate")
    if chains.looped is None:
        return hit
    return hit.unionByName(_climbed(asked.join(loose, "candidate", "left_semi"), parents))


def _climbed(pairs: DataFrame, parents: DataFrame) -> DataFrame:
    """The pairs that hold, for candidates on or below a cycle: a step a job, decided pairs leave, no node is passed twice."""
    hop = parents.select(F.col("child").alias("_child"), F.col("parent").alias("_parent"))
    seen, found = Levels(), Levels()
    frontier = cut(pairs.withColumn("at", F.col("candidate")))
    seen.add(frontier)
    while not frontier.empty:
        risen = cut(frontier.df.join(hop, F.col("at") == F.col("_child")).select("ancestor", "candidate", F.col("_parent").alias("at")).distinct())
        found.add(cut(risen.df.where(F.col("at") == F.col("ancestor"))))
        frontier = cut(risen.df.where(F.col("at") != F.col("ancestor")).join(seen.frame(), ["ancestor", "candidate", "at"], "left_anti"))
        seen.add(frontier)
    return found.frame().select("ancestor", "candidate").where(F.col("ancestor") != F.col("candidate")).distinct()
