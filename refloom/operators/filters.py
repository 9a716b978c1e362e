"""Row filters, name search and sorted views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.matching import match_nodes
from refloom.functions.scalar import base, dir_of
from refloom.model import Graph
from refloom.operators.traverse import closure_sizes, degrees


def filter_types(df: DataFrame, types=None, column: str = "type") -> DataFrame:
    return df.where(F.col(column).isin(*types)) if types else df


def filter_path(nodes: DataFrame, text: str, column: str = "path") -> DataFrame:
    return nodes.where(F.lower(column).contains(text.lower())) if text else nodes


def where_matches(nodes: DataFrame, spec: dict | None) -> DataFrame:
    return nodes.where(match_nodes(spec))


def real_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that exist as sources: what every health report counts."""
    return nodes.where(F.col("has_source") & ~F.col("virtual"))


def unknown_values(df: DataFrame, column: str, values) -> DataFrame:
    """(value) for wanted values that never occur in the column."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], "value string")
    return wanted.join(df.select(F.col(column).alias("value")).distinct(), "value", "left_anti")


def find(nodes: DataFrame, query: str, types=None, limit: int | None = 50) -> DataFrame:
    """Name search ranked by the match position in the basename (99 when only the path matches)."""
    q = (query or "").lower()
    at = F.instr(F.lower(base("path")), q) if q else F.lit(1)
    hits = filter_types(filter_path(nodes, q), types).withColumn("rank", F.when(at == 0, F.lit(99)).otherwise(at - 1))
    out = hits.select("id", "path", "type", "rank")
    return out.orderBy("rank", "path").limit(limit) if limit is not None else out


def top_with_total(df: DataFrame, order: list[Column], limit: int) -> tuple[DataFrame, DataFrame]:
    """The first rows of a report and, separately, how many there are in all."""
    return df.orderBy(*order).limit(limit), df.agg(F.count(F.lit(1)).alias("total"))


SORTABLE = {"size", "in_degree", "out_degree", "upstream", "downstream"}


def sort_nodes(df: DataFrame, key: str = "path", desc: bool = False) -> DataFrame:
    """Sorted view: numeric keys as numbers, names case-insensitively, ties by basename and path."""
    col = F.col(key) if key in SORTABLE else F.lower(F.col(key))
    return df.orderBy(col.desc() if desc else col.asc(), F.lower(base("path")), F.col("path"))


def node_table(graph: Graph, mode: str = "exact") -> DataFrame:
    """One row per node: names, type, container, size, degrees and closure sizes."""
    deg = degrees(graph.edges)
    clo = closure_sizes(graph.adjacency, graph.nodes, mode)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return (
        graph.nodes.join(deg, "id", "left")
        .join(clo, "id", "left")
        .select(
            "id", base("path").alias("base"), dir_of("path").alias("dir"), "path", "type", "container", "size",
            zero("in_degree"), zero("upstream"), zero("out_degree"), zero("downstream"),
        )
    )


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key")
