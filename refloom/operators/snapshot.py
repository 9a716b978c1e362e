"""Neighbourhood snapshots: an induced subgraph, its boundary, and a size budget.

Every row carries the centre (``root``) it belongs to, so the snapshots of several centres, overlapping ones included, are
built together and stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.model import Graph
from refloom.operators.traverse import _hop, both_ways
from refloom.plans.ordering import positions_within
from refloom.plans.runtime import BROADCAST_BYTES, Cut, Levels, cut, join_frontier

# Fixed default limits of a snapshot: depth, depth of site detail, size in characters.
MAX_DEPTH = 5
SITE_DEPTH = 2
BUDGET_CHARS = 256 * 1024


@dataclass(frozen=True)
class Snapshot:
    nodes: DataFrame  # root, idx, id, path, type, size, container, hops, boundary
    edges: DataFrame  # root, src_idx, dst_idx, kind, has_sites, sites_omitted
    sites: DataFrame | None
    depth: int
    dropped_sites: bool
    over: bool


def _known(graph: Graph, found: Cut) -> Cut:
    """The rows of ``found`` whose node exists; few rows are looked up without moving the nodes."""
    ids = graph.nodes.select(F.col("id").alias("node"))
    if found.nbytes <= BROADCAST_BYTES:
        ids = ids.join(found.hinted().select("node"), "node", "left_semi")
    return cut(found.df.join(ids, "node", "left_semi"))


def _levels(graph: Graph, center: DataFrame) -> Iterator[Cut]:
    """(root, node, hops) of the nodes at each distance from their centre, nearest first; a level is walked when it is asked for.

    Links are read again for each hop: a small frontier is broadcast into the scan, so no hop moves or keeps the link table.
    """
    pairs = both_ways(graph.adjacency)
    seen = Levels()
    start = center.select(F.col("id").alias("root"), F.col("id").alias("node")).distinct()
    level = _known(graph, cut(start.withColumn("hops", F.lit(0))))
    while not level.empty:
        seen.add(level)
        yield level
        level = _known(graph, _hop(level, pairs, seen.hinted()))


def snapshot_nodes(graph: Graph, center: DataFrame, depth: int) -> DataFrame:
    """(root, id, path, type, size, container, hops, boundary) within ``depth`` hops of each centre."""
    return _marked(graph, list(islice(_levels(graph, center), depth + 1)), depth)


def _marked(graph: Graph, levels: list[Cut], depth: int) -> DataFrame:
    seen = Levels()
    for level in levels:
        seen.add(level)
    nodes = graph.nodes.select("id", "path", "type", "size", "container")
    if not levels:
        return nodes.where(F.lit(False)).select(F.col("id").alias("root"), "*", F.lit(0).alias("hops"), F.lit(False).alias("boundary"))
    inner = nodes.join(seen.hinted().select("root", F.col("node").alias("id"), "hops"), "id")
    columns = ["root", "id", "path", "type", "size", "container", "hops"]
    if len(levels) <= depth:
        return inner.select(*columns, F.lit(False).alias("boundary"))
    rim = _rim(graph, levels[-1], seen).hinted().withColumn("_b", F.lit(True))
    return inner.join(rim, ["root", "id"], "left").select(*columns, F.coalesce("_b", F.lit(False)).alias("boundary"))


def _rim(graph: Graph, last: Cut, seen: Levels) -> Cut:
    """(root, id): nodes of the last level with a neighbour that was trimmed; no nearer node can have one."""
    near = join_frontier(last, both_ways(graph.adjacency), F.col("node") == F.col("src"))
    near = near.select("root", F.col("node").alias("id"), F.col("dst").alias("node"))
    beyond = near.join(seen.hinted().select("root", "node"), ["root", "node"], "left_anti").distinct()
    ids = graph.nodes.select(F.col("id").alias("node"))
    return cut(beyond.join(ids, "node", "left_semi").select("root", "id").distinct())


def _induced(graph: Graph, nodes: DataFrame, site_depth: int) -> DataFrame:
    """(root, src, dst, kind, hops, has_sites, sites_omitted): edges between nodes of one centre, hops of the farther end.

    Links to and from other nodes are left out first, below the count that makes edges of links where ``nodes`` is broadcast.
    """
    n = nodes.select("root", "id", "hops")
    e = graph.edges.select("src", "dst", "kind")
    for end in ("src", "dst"):
        e = e.join(n.select(F.col("id").alias(end)), end, "left_semi")
    inside = e.join(n.withColumnsRenamed({"id": "src", "hops": "hs"}), "src").join(
        n.withColumnsRenamed({"id": "dst", "hops": "hd"}), ["root", "dst"]
    ).withColumn("hops", F.greatest("hs", "hd"))
    if graph.sites is None:
        return inside.select("root", "src", "dst", "kind", "hops", F.lit(False).alias("has_sites"), F.lit(False).alias("sites_omitted"))
    has = graph.sites.select("src", "dst", "kind").distinct().withColumn("_s", F.lit(True))
    return inside.join(has, ["src", "dst", "kind"], "left").select(
        "root", "src", "dst", "kind", "hops",
        F.col("_s").isNotNull().alias("has_sites"),
        (F.col("_s").isNotNull() & (F.col("hops") > site_depth)).alias("sites_omitted"),
    )


def snapshot(graph: Graph, center: DataFrame, depth: int = MAX_DEPTH, site_depth: int = SITE_DEPTH) -> Snapshot:
    nodes = cut(snapshot_nodes(graph, center, depth))
    return _assemble(graph, nodes, depth, site_depth, False, False)


def _assemble(graph: Graph, nodes: Cut, depth: int, site_depth: int, dropped: bool, over: bool) -> Snapshot:
    numbered = cut(positions_within(nodes.df, ["root"], ["hops", "path", "id"], "idx"))
    edges = _induced(graph, nodes.hinted(), site_depth)
    ix = numbered.hinted().select("root", "id", "idx")
    coded = (
        edges.join(ix.withColumnsRenamed({"id": "src", "idx": "src_idx"}), ["root", "src"])
        .join(ix.withColumnsRenamed({"id": "dst", "idx": "dst_idx"}), ["root", "dst"])
        .select("root", "src", "dst", "src_idx", "dst_idx", "kind", "has_sites", "sites_omitted")
    )
    sites = None
    if graph.sites is not None and site_depth >= 0:
        near = coded.where(F.col("has_sites") & ~F.col("sites_omitted")).select("root", "src", "dst", "kind")
        sites = graph.sites.join(near, ["src", "dst", "kind"])
    return Snapshot(numbered.df, coded, sites, depth, dropped, over)


def snapshot_fit(
    graph: Graph, center: DataFrame, max_depth: int = MAX_DEPTH, site_depth: int = SITE_DEPTH, cap: int = BUDGET_CHARS
) -> Snapshot:
    """The deepest snapshot whose estimated text, of all centres together, fits ``cap``; at worst depth 1 without site detail.

    Sizes only grow with the depth, so the walk ends at the first depth that does not fit; nothing is walked twice.
    """
    names = graph.nodes.select(F.col("id").alias("node"), F.length("path").alias("chars"))
    seen, levels = Levels(), []
    used = sites_used = fits = 0
    ahead = _levels(graph, center)
    for at in range(max_depth + 1):
        level = next(ahead, None)
        if level is None:  # nothing is farther away
            fits = max_depth if used + sites_used <= cap else 0
            break
        levels.append(level)
        seen.add(level)
        used += names.join(level.hinted(), "node").agg(F.sum(F.col("chars") + 12).alias("n")).first()["n"] or 0
        if used <= cap:
            reach = seen.hinted().select("root", F.col("node").alias("id"), "hops")
            edges, detail = _level_chars(graph, reach, at, site_depth)
            used, sites_used = used + edges, sites_used + detail
        if at and used + sites_used > cap:
            break
        fits = at
    dropped = fits == 0
    over = dropped and used > cap
    depth = fits or 1
    nodes = cut(_marked(graph, levels[: depth + 1], depth))
    return _assemble(graph, nodes, depth, -1 if dropped else site_depth, dropped, over)


def _level_chars(graph: Graph, reach: DataFrame, hops: int, site_depth: int) -> tuple[int, int]:
    """Estimated text of the edges whose farther end is ``hops`` away, and of their sites."""
    induced = _induced(graph, reach, site_depth).where(F.col("hops") == hops)
    edges = induced.count() * 12
    if graph.sites is None:
        return edges, 0
    shown = induced.where(F.col("has_sites") & ~F.col("sites_omitted")).select("src", "dst", "kind")
    text = F.concat_ws(",", "node_path", "component", "property", "sub_name")
    return edges, graph.sites.join(shown, ["src", "dst", "kind"]).agg(F.sum(F.length(text) + 6).alias("n")).first()["n"] or 0
