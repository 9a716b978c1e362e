"""Cycle groups: strongly connected components with at least two members.

Trim nodes that cannot lie on a cycle, then colour forwards with the ancestor of the largest rank and
walk backwards inside each colour; the walk from a colour's own node is exactly its component.
Whatever is left goes round again.  Ranks are hashes of the ids, so a chain of components falls into
pieces in every round and the number of rounds grows with the logarithm of its length, whatever the
order of the ids.  Every step is a join plus a partial aggregate over the remaining edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.plans.runtime import Cut, Levels, cut


def _rank(col: str):
    """A value for each id whose order has nothing to do with the order of the ids."""
    return F.concat(F.lpad(F.hex(F.xxhash64(col)), 16, "0"), F.lit("|"), F.col(col).cast("string"))


def _trim(edges: Cut) -> Cut:
    while not edges.empty:
        e = edges.df
        has_in = e.select(F.col("dst").alias("_n")).distinct()
        has_out = e.select(F.col("src").alias("_n")).distinct()
        core = cut(has_in.join(has_out, "_n", "left_semi"))
        kept = cut(
            e.join(core.hinted(), e["src"] == F.col("_n"), "left_semi").join(core.hinted(), e["dst"] == F.col("_n"), "left_semi")
        )
        if kept.rows == edges.rows:
            return kept
        edges = kept
    return edges


def _colour(edges: DataFrame) -> DataFrame:
    """(id, color): the largest rank that reaches each node, its own included."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    state = cut(ends.withColumn("color", _rank("id")).withColumn("moved", F.lit(True)))
    changed = state
    while not changed.empty:
        push = (
            edges.join(changed.hinted().select("id", "color"), F.col("src") == F.col("id"))
            .groupBy(F.col("dst").alias("id"))
            .agg(F.max("color").alias("got"))
        )
        state = cut(
            state.df.select("id", "color")
            .join(push, "id", "left")
            .select("id", F.greatest("color", "got").alias("color"), (F.col("got") > F.col("color")).alias("moved"))
        )
        moved = state.df.where(F.col("moved"))
        changed = cut(moved)
    return state.df.select("id", "color")


def cycle_members(edges: DataFrame) -> DataFrame:
    """(group, member) for every node on a cycle through at least one other node; group = max member."""
    live = _trim(cut(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct()))
    found = Levels()
    while not live.empty:
        colors = cut(_colour(live.df))
        c = colors.hinted()
        inside = cut(
            live.df.join(c.select(F.col("id").alias("src"), F.col("color").alias("cs")), "src")
            .join(c.select(F.col("id").alias("dst"), F.col("color").alias("cd")), "dst")
            .where(F.col("cs") == F.col("cd"))
            .select("src", "dst", F.col("cs").alias("color"))
        )
        got = Levels()
        frontier = cut(colors.df.where(_rank("id") == F.col("color")).select("color", F.col("id").alias("node")))
        got.add(frontier)
        while not frontier.empty:
            back = (
                inside.df.join(
                    frontier.hinted().select(F.col("color").alias("fc"), F.col("node").alias("fn")),
                    (F.col("dst") == F.col("fn")) & (F.col("color") == F.col("fc")),
                )
                .select("color", F.col("src").alias("node"))
                .distinct()
            )
            frontier = cut(back.join(got.hinted(), ["color", "node"], "left_anti"))
            if not frontier.empty:
                got.add(frontier)
        done = cut(got.frame().select(F.col("color").alias("group"), F.col("node").alias("member")))
        found.add(done)
        gone = done.hinted().select(F.col("member").alias("_n"))
        rest = inside.df.select("src", "dst")
        rest = rest.join(gone, rest["src"] == F.col("_n"), "left_anti").join(gone, rest["dst"] == F.col("_n"), "left_anti")
        live = _trim(cut(rest))
    if not found.rows:
        return edges.select(F.col("src").alias("group"), F.col("dst").alias("member")).where(F.lit(False))
    members = found.frame()
    named = members.groupBy("group").agg(F.count(F.lit(1)).alias("_n"), F.max("member").alias("_name")).where(F.col("_n") >= 2)
    return members.join(named, "group").select(F.col("_name").alias("group"), "member")


def cycle_groups(edges: DataFrame) -> DataFrame:
    """(group, size, first, last) per cycle group; the members themselves are ``cycle_members``."""
    return (
        cycle_members(edges)
        .groupBy("group")
        .agg(F.count(F.lit(1)).alias("size"), F.min("member").alias("first"), F.max("member").alias("last"))
    )
