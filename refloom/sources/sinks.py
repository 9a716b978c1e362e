"""Writing reports and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.model import Graph


def write_json(report: DataFrame | dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; a report of several sections becomes one folder per section."""
    if isinstance(report, dict):
        for name, df in report.items():
            df.write.mode(mode).json(f"{path}/{name}")
    else:
        report.write.mode(mode).json(path)


def as_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct("*")).alias("json"))


def write_graph(graph: Graph, path: str, mode: str = "overwrite") -> None:
    """Nodes by id, links and edges range-sorted by source so that lookups prune row groups."""
    graph.nodes.repartitionByRange("id").sortWithinPartitions("id").write.mode(mode).parquet(f"{path}/nodes")
    graph.edges.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").write.mode(mode).parquet(f"{path}/edges")
    graph.adjacency.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").write.mode(mode).parquet(f"{path}/links")
    if graph.sites is not None:
        graph.sites.repartitionByRange("src", "dst").write.mode(mode).parquet(f"{path}/sites")


def read_graph(spark: SparkSession, path: str, sites: bool = False) -> Graph:
    return Graph(
        spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/links"),
        spark.read.parquet(f"{path}/sites") if sites else None,
    )
