"""Adapters that read relational tables as reference graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.model import Graph, edges_from_fk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def _node(df: DataFrame, id_, path, type_: str, size, container) -> DataFrame:
    return df.select(
        id_.alias("id"),
        path.alias("path"),
        F.lit(type_).alias("type"),
        size.cast("long").alias("size"),
        container.cast("string").alias("container"),
        F.lit(False).alias("virtual"),
        F.lit(True).alias("has_source"),
    )


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero, none = F.lit(0), F.lit(None)
    t = lambda n: table(spark, sf_dir, n)
    parts = [
        _node(t("region"), key("R", "r_regionkey"), F.concat(F.lit("region/"), "r_name"), "region", zero, none),
        _node(t("nation"), key("N", "n_nationkey"), F.concat(F.lit("nation/"), "n_name"), "nation", zero,
              F.lit(None)),
        _node(t("customer"), key("C", "c_custkey"),
              F.concat_ws("/", F.lit("customer"), F.col("c_mktsegment"), F.col("c_name")), "customer", zero,
              key("N", "c_nationkey")),
        _node(t("supplier"), key("S", "s_suppkey"), F.concat_ws("/", F.lit("supplier"), F.col("s_name")),
              "supplier", zero, key("N", "s_nationkey")),
        _node(t("part"), key("P", "p_partkey"),
              F.concat_ws("/", F.lit("part"), F.col("p_brand"), F.col("p_type"),
                          F.concat_ws("-", F.col("p_name"), F.col("p_partkey").cast("string"))),
              "part", F.floor("p_retailprice"), F.col("p_brand")),
        _node(t("orders"), key("O", "o_orderkey"),
              F.concat_ws("/", F.lit("orders"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string")),
              "order", F.floor("o_totalprice"), none),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def star_links(spark: SparkSession, sf_dir: str, kinds: set[str] | None = None) -> DataFrame:
    """Foreign keys as links; only the tables behind the wanted kinds are read."""
    t = lambda n: table(spark, sf_dir, n)
    makers = {
        "in-region": lambda: [edges_from_fk(t("nation"), key("N", "n_nationkey"), key("R", "n_regionkey"), "in-region")],
        "in-nation": lambda: [
            edges_from_fk(t("customer"), key("C", "c_custkey"), key("N", "c_nationkey"), "in-nation"),
            edges_from_fk(t("supplier"), key("S", "s_suppkey"), key("N", "s_nationkey"), "in-nation"),
        ],
        "placed-by": lambda: [edges_from_fk(t("orders"), key("O", "o_orderkey"), key("C", "o_custkey"), "placed-by")],
        "part": lambda: [edges_from_fk(t("lineitem"), key("O", "l_orderkey"), key("P", "l_partkey"), "part")],
        "supplier": lambda: [edges_from_fk(t("lineitem"), key("O", "l_orderkey"), key("S", "l_suppkey"), "supplier")],
    }
    parts = [df for k, make in makers.items() if kinds is None or k in kinds for df in make()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def star_graph(spark: SparkSession, sf_dir: str, kinds: set[str] | None = None) -> Graph:
    """Orders, parts, suppliers, customers, nations and regions linked by their foreign keys."""
    return Graph.from_links(star_nodes(spark, sf_dir), star_links(spark, sf_dir, kinds))
