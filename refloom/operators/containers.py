"""Containers: membership by deepest root, roll-ups, links, cycles and duplicated content.

Containment and container links live in their own DataFrames and never enter ``edges``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.scalar import path_prefixes
from refloom.model import DEFAULT_CONTAINER, Graph
from refloom.operators.scc import cycle_groups
from refloom.operators.traverse import mutual_pairs, walk
from refloom.plans.runtime import cut


def assign_container(nodes: DataFrame, containers: DataFrame, default: str = DEFAULT_CONTAINER) -> DataFrame:
    """Replace ``container`` by the container with the deepest root above the path.

    Each path is exploded to its prefixes and equi-joined to the roots; the deepest hit is taken with
    an aggregate, so no prefix comparison between all paths and all roots ever happens.
    """
    keyed = nodes.select("id", F.explode(path_prefixes("path")).alias("root"))
    hits = keyed.join(containers.select("root", F.col("name").alias("_name")), "root")
    best = hits.groupBy("id").agg(F.max_by("_name", F.length("root")).alias("_name"))
    rest = [c for c in nodes.columns if c != "container"]
    return nodes.join(best, "id", "left").select(
        *rest, F.when(F.col("virtual"), F.lit(None).cast("string")).otherwise(F.coalesce("_name", F.lit(default))).alias("container")
    )


def prefix_join(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, id, path): nodes strictly below each directory prefix."""
    keyed = nodes.select("id", "path", F.explode(path_prefixes("path")).alias("prefix")).where(F.col("prefix") != F.col("path"))
    return keyed.join(prefixes.select("prefix").distinct(), "prefix").select("prefix", "id", "path")


def edges_with_attrs(graph: Graph) -> DataFrame:
    """Edges with path, type and container of both ends; edges with an unknown end drop out."""
    n = graph.nodes.select("id", "path", "type", "container")
    s = n.withColumnsRenamed({"id": "src", "path": "src_path", "type": "src_type", "container": "src_container"})
    d = n.withColumnsRenamed({"id": "dst", "path": "dst_path", "type": "dst_type", "container": "dst_container"})
    return graph.edges.join(s, "src").join(d, "dst")


def cross_container_refs(graph: Graph) -> DataFrame:
    """The edges behind every container link, in long form."""
    e = edges_with_attrs(graph)
    return e.where(
        F.col("src_container").isNotNull() & F.col("dst_container").isNotNull() & (F.col("src_container") != F.col("dst_container"))
    )


def container_edges(graph: Graph) -> DataFrame:
    """(src, dst, kind, weight, refs) between containers; the refs themselves are ``cross_container_refs``."""
    return (
        cross_container_refs(graph)
        .groupBy(F.col("src_container").alias("src"), F.col("dst_container").alias("dst"))
        .agg(F.lit("container-dep").alias("kind"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("refs"))
    )


def _members(graph: Graph) -> DataFrame:
    return graph.nodes.where(~F.col("virtual") & F.col("container").isNotNull())


def contain_edges(graph: Graph) -> DataFrame:
    return _members(graph).select(
        F.col("container").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"), F.lit(1).cast("long").alias("weight")
    )


def container_rollup(graph: Graph, links: DataFrame | None = None, default: str = DEFAULT_CONTAINER) -> DataFrame:
    """(container, members, size, in_links, out_links); empty when only the default container exists."""
    links = container_edges(graph) if links is None else links
    per = _members(graph).groupBy("container").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("size"))
    ends = links.select(F.col("src").alias("container"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
        links.select(F.col("dst").alias("container"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    deg = ends.groupBy("container").agg(F.sum("i").alias("in_links"), F.sum("o").alias("out_links"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    # uncorrelated subquery: is there any container beside the default one?
    real = _members(graph).agg(F.bool_or(F.col("container") != default).alias("_any")).scalar()
    return per.join(deg, "container", "left").where(real).select(
        "container", "members", "size", zero("in_links"), zero("out_links")
    )


def container_links(graph: Graph, links: DataFrame | None = None) -> DataFrame:
    """Container links with ``mutual`` telling whether the opposite link exists too."""
    links = container_edges(graph) if links is None else links
    pairs = mutual_pairs(links)
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"))
    )
    return links.join(both.withColumn("_m", F.lit(True)), ["src", "dst"], "left").select(
        "src", "dst", "weight", "refs", F.coalesce("_m", F.lit(False)).alias("mutual")
    )


def capped_refs(graph: Graph, limit: int) -> DataFrame:
    """At most ``limit`` contributing references per link, in path order (a per-link top-k)."""
    w = Window.partitionBy("src_container", "dst_container").orderBy("src_path", "dst_path", "kind")
    return (
        cross_container_refs(graph)
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= limit)
        .select("src_container", "dst_container", "src", "dst", "src_path", "dst_path", "kind", "weight", "rank")
    )


def container_reach(graph: Graph) -> DataFrame:
    """(container, node): what each container's members are or transitively need."""
    start = _members(graph).select(F.col("container").alias("root"), F.col("id").alias("node"))
    return walk(graph.adjacency, start).select(F.col("root").alias("container"), "node")


def container_duplication(graph: Graph, containers: DataFrame) -> DataFrame:
    """(id, path, type, copies, size, wasted): nodes copied into every container tied at top priority.

    A node is needed by each container whose members are it or reach it, and is placed in the needing
    container of highest priority; a tie at the top puts a copy into each.  A container without a
    configured priority (the default one included) counts as priority 0.
    """
    named = containers.select(F.col("name").alias("container"), "priority")
    need = container_reach(graph).join(named, "container", "left").withColumn("priority", F.coalesce("priority", F.lit(0)))
    # count per (node, priority) first: a tie is a plain aggregate, no window over a hot node
    tied = need.groupBy("node", "priority").agg(F.count(F.lit(1)).alias("copies"))
    top = tied.groupBy(F.col("node").alias("id")).agg(F.max_by("copies", "priority").alias("copies")).where(F.col("copies") >= 2)
    return top.join(graph.nodes, "id").select(
        "id", "path", "type", "copies", "size", (F.col("size") * (F.col("copies") - 1)).alias("wasted")
    )


def container_report(graph: Graph, containers: DataFrame | None = None, limit: int = 20) -> dict[str, DataFrame]:
    """Every container section as its own DataFrame over one materialized link table."""
    links = cut(container_edges(graph)).df
    out = {
        "rollup": container_rollup(graph, links),
        "links": container_links(graph, links),
        "refs": capped_refs(graph, limit),
        "mutual": mutual_pairs(links),
        "cycles": cycle_groups(links),
    }
    if containers is not None:
        out["duplication"] = container_duplication(graph, containers)
    return out
