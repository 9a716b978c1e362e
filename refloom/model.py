"""The data model: a directed, typed, weighted multigraph held as DataFrames.

``nodes``      id, path, type, size, container, virtual, has_source (extra columns allowed)
``edges``      src, dst, kind, weight, label - unique on (src, dst, kind)
``links``      src, dst, kind - the same references before deduplication; traversals use these, so
               no aggregation of the whole edge table is paid before a walk
``sites``      src, dst, kind, node_path, component, property, sub_name - kept apart from edges so
               that a hot edge never becomes one huge row
Ids are plain strings, so the same operators serve an asset tree, a star schema or a web crawl.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_FIELDS = {
    "id": "string",
    "path": "string",
    "type": "string",
    "size": "bigint",
    "container": "string",
    "virtual": "boolean",
    "has_source": "boolean",
}
_NODE_DEFAULT = {"size": 0, "container": None, "virtual": False, "has_source": True}

SITE_FIELDS = ["node_path", "component", "property", "sub_name"]
DEFAULT_CONTAINER = "main"


def conform_nodes(df: DataFrame) -> DataFrame:
    """Add the core node columns that are absent, cast those present, keep any extra ones."""
    out = df
    if "path" not in df.columns:
        out = out.withColumn("path", F.col("id"))
    if "type" not in df.columns:
        out = out.withColumn("type", F.lit("unknown"))
    for name, default in _NODE_DEFAULT.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(default))
    extra = [c for c in out.columns if c not in NODE_FIELDS]
    return out.select(*[F.col(c).cast(t).alias(c) for c, t in NODE_FIELDS.items()], *extra)


def conform_edges(df: DataFrame) -> DataFrame:
    out = df
    if "weight" not in out.columns:
        out = out.withColumn("weight", F.lit(1))
    if "label" not in out.columns:
        out = out.withColumn("label", F.lit(None).cast("string"))
    return out.select("src", "dst", "kind", F.col("weight").cast("long").alias("weight"), "label")


def edges_from_links(links: DataFrame) -> DataFrame:
    """One edge per (src, dst, kind) with weight = number of references."""
    return links.groupBy("src", "dst", "kind").agg(
        F.count(F.lit(1)).alias("weight"), F.lit(None).cast("string").alias("label")
    )


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    links: DataFrame | None = None
    sites: DataFrame | None = None
    sub_items: DataFrame | None = None
    sub_usage: DataFrame | None = None
    containers: DataFrame | None = None
    dangling: DataFrame | None = None
    missing: DataFrame | None = None
    parse_errors: DataFrame | None = None
    extras: dict = field(default_factory=dict)
    counted: tuple | None = None  # the edges and the links they are the counts of

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame, **kw) -> "Graph":
        e = conform_edges(edges)
        return Graph(conform_nodes(nodes), e, kw.pop("links", e.select("src", "dst", "kind")), **kw)

    @staticmethod
    def from_links(nodes: DataFrame, links: DataFrame, **kw) -> "Graph":
        pairs = links.select("src", "dst", "kind")
        edges = edges_from_links(pairs)
        return Graph(conform_nodes(nodes), edges, pairs, counted=(edges, pairs), **kw)

    @property
    def adjacency(self) -> DataFrame:
        return self.links if self.links is not None else self.edges.select("src", "dst", "kind")

    @property
    def references(self) -> DataFrame:
        """(src, dst, kind, weight): rows that add up to the edges; raw links where the edges are their counts."""
        if self.counted is not None and self.counted[0] is self.edges and self.counted[1] is self.links:
            return self.links.select("src", "dst", "kind", F.lit(1).cast("long").alias("weight"))
        return self.edges.select("src", "dst", "kind", "weight")

    def with_(self, **kw) -> "Graph":
        return replace(self, **kw)


def edges_from_fk(df: DataFrame, src, dst, kind: str) -> DataFrame:
    """References held by a relational table: one link per row, NULL endpoints dropped."""
    s = F.col(src) if isinstance(src, str) else src
    d = F.col(dst) if isinstance(dst, str) else dst
    return (
        df.select(s.cast("string").alias("src"), d.cast("string").alias("dst"), F.lit(kind).alias("kind"))
        .where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    )
