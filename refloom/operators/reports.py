"""Audit reports.  Each section is a lazy DataFrame; lists that can be long stay child tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refloom.model import DEFAULT_CONTAINER, Graph
from refloom.operators.containers import container_report
from refloom.operators.filters import filter_types, real_nodes
from refloom.operators.traverse import closure, closure_items, walk
from refloom.plans.runtime import union_all


def summary(graph: Graph) -> DataFrame:
    """Long-format project summary: (section, key, n)."""
    one = F.count(F.lit(1)).alias("n")
    parts = [
        graph.nodes.agg(one).select(F.lit("total").alias("section"), F.lit("nodes").alias("key"), "n"),
        graph.edges.agg(one).select(F.lit("total").alias("section"), F.lit("edges").alias("key"), "n"),
        graph.nodes.groupBy("type").agg(one).select(F.lit("type").alias("section"), F.col("type").alias("key"), "n"),
        graph.edges.groupBy("kind").agg(one).select(F.lit("kind").alias("section"), F.col("kind").alias("key"), "n"),
    ]
    for name, df in (("dangling", graph.dangling), ("parse_errors", graph.parse_errors)):
        if df is not None:
            parts.append(df.agg(one).select(F.lit("total").alias("section"), F.lit(name).alias("key"), "n"))
    return union_all(parts)


def size_report(graph: Graph, types=None) -> DataFrame:
    """(type, n, size) over nodes that exist as sources."""
    return (
        filter_types(real_nodes(graph.nodes), types)
        .groupBy("type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    )


def largest(graph: Graph, types=None, limit: int | None = None) -> DataFrame:
    out = filter_types(real_nodes(graph.nodes), types).select("id", "path", "type", "size").orderBy(F.desc("size"), "path")
    return out.limit(limit) if limit is not None else out


def unused_report(graph: Graph, root_types=(), types=None) -> DataFrame:
    """(id, path, type, size, container, candidate): real nodes nobody refers to.

    In the default container they are unused; in any other container they may be loaded by name at
    run time and are only candidates.  Types in ``root_types`` are entry points and never listed.
    """
    nodes = filter_types(real_nodes(graph.nodes), types)
    if root_types:
        nodes = nodes.where(~F.col("type").isin(*root_types))
    home = F.coalesce(F.col("container"), F.lit(DEFAULT_CONTAINER))
    used = graph.adjacency.select(F.col("dst").alias("id"))
    return nodes.join(used, "id", "left_anti").select(
        "id", "path", "type", "size", home.alias("container"), (home != DEFAULT_CONTAINER).alias("candidate")
    )


def dangling_refs(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """References whose target is not a node; ``raw`` is (src, ref, ...)."""
    known = nodes.select(F.col("id").alias("_id"))
    return raw.join(known, F.substring_index("ref", "@", 1) == F.col("_id"), "left_anti")


def dangling_report(dangling: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """(ref, refs, referrers, first_referrer, path, missing_source) per unresolved target.

    The referrers of one target can be any number, so only their count and the first one are kept on
    the row; ``dangling_referrers`` lists them all.
    """
    per = dangling.groupBy("ref").agg(
        F.count(F.lit(1)).alias("refs"),
        F.countDistinct("src").alias("referrers"),
        F.min("src").alias("first_referrer"),
    )
    if missing is None:
        return per.select("*", F.lit(None).cast("string").alias("path"), F.lit(False).alias("missing_source"))
    m = missing.select(F.col("id").alias("_mid"), F.col("path"))
    return per.join(m, F.substring_index("ref", "@", 1) == F.col("_mid"), "left").select(
        "ref", "refs", "referrers", "first_referrer", "path", F.col("_mid").isNotNull().alias("missing_source")
    )


def dangling_referrers(dangling: DataFrame) -> DataFrame:
    return dangling.select("ref", "src").distinct()


def missing_referenced(missing: DataFrame, refs: DataFrame) -> DataFrame:
    """Missing records something still points at."""
    return missing.join(refs.select(F.substring_index("ref", "@", 1).alias("id")), "id", "left_semi")


def references_to_missing(graph: Graph) -> DataFrame | None:
    """(src, ref) of all references that may name a record without a source: unresolved ones and what extractors ran into."""
    found = [df.select("src", "ref") for df in (graph.dangling, graph.extras.get("missing_hits")) if df is not None]
    return union_all(found) if found else None


def dropped_report(missing: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, path, refs, referenced) for every record whose source is gone."""
    per = refs.groupBy(F.substring_index("ref", "@", 1).alias("id")).agg(F.count(F.lit(1)).alias("refs"))
    return missing.join(per, "id", "left").select(
        "id", "path", F.coalesce("refs", F.lit(0)).cast("long").alias("refs"), F.col("refs").isNotNull().alias("referenced")
    )


def utilization(owners: DataFrame, sub_items: DataFrame, sub_usage: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Used and total sub-items per owner, by count and by area.

    ``owners`` (owner_id, path), ``sub_items`` (owner_id, sub_id, width, height), ``sub_usage``
    (owner_id, sub_id - NULL sub_id means the owner was referenced as a whole).  Area columns are
    NULL for an owner with any unknown size.
    """
    used = sub_usage.where(F.col("sub_id").isNotNull()).select("owner_id", "sub_id").distinct().withColumn("_u", F.lit(True))
    whole = sub_usage.where(F.col("sub_id").isNull()).select("owner_id").distinct().withColumn("whole_referenced", F.lit(True))
    touched = sub_usage.select("owner_id").distinct().withColumn("referenced", F.lit(True))
    area = (F.col("width") * F.col("height")).cast("double")
    known = F.col("width").isNotNull() & F.col("height").isNotNull()
    per = (
        sub_items.join(used, ["owner_id", "sub_id"], "left")
        .groupBy("owner_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("_u").isNotNull()).alias("used"),
            F.bool_and(known).alias("_known"),
            F.sum(area).alias("_total_area"),
            F.sum(F.when(F.col("_u").isNotNull(), area).otherwise(F.lit(0.0))).alias("_used_area"),
        )
    )
    when = lambda c: F.when(F.col("_known"), c)
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return (
        owners.join(per, "owner_id", "left").join(touched, "owner_id", "left").join(whole, "owner_id", "left").select(
            "owner_id", "path", count("used").alias("used"), count("total").alias("total"),
            F.when(count("total") > 0, count("used") / count("total")).otherwise(F.lit(0.0)).alias("ratio"),
            when(F.col("_total_area")).alias("total_area"),
            when(F.col("_used_area")).alias("used_area"),
            when(F.col("_total_area") - F.col("_used_area")).alias("wasted_area"),
            when(F.when(F.col("_total_area") > 0, F.col("_used_area") / F.col("_total_area"))).alias("area_ratio"),
            flag("referenced"), flag("whole_referenced"),
        )
    )


def type_facets(graph: Graph, scope: DataFrame | None = None, sized_only: bool = False) -> DataFrame:
    """(type, n) over a scope of node ids (all nodes when None)."""
    nodes = graph.nodes if scope is None else graph.nodes.join(scope.select("id").distinct(), "id", "left_semi")
    if sized_only:
        nodes = real_nodes(nodes).where(F.col("size") > 0)
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def linked_scope(graph: Graph, center: DataFrame) -> DataFrame:
    """(id): the centre with everything up- and downstream of it."""
    from refloom.operators.traverse import reverse

    start = center.select(F.col("id").alias("root"), F.col("id").alias("node"))
    down = walk(graph.adjacency, start)
    up = walk(reverse(graph.adjacency.select("src", "dst")), start)
    return down.unionByName(up).select(F.col("node").alias("id")).distinct()


def size_scope(graph: Graph, root: DataFrame | None = None, container: str | None = None) -> DataFrame:
    """Sized items of a scope: a root with its closure, a container's members, or everything."""
    cols = ["id", "path", "type", "size", "container"]
    if container is not None:
        return real_nodes(graph.nodes).where(F.col("container") == container).select(*cols)
    if root is not None:
        reach = closure(graph.adjacency, root).select(F.col("node").alias("id"))
        ids = reach.unionByName(root.select("id")).distinct()
        return graph.nodes.join(ids, "id", "left_semi").select(*cols)
    return real_nodes(graph.nodes).select(*cols)


OTHERS_CAP = 80  # fixed default: items shown per group before the rest is pooled


def size_map(items: DataFrame, by: str = "type", cap: int = OTHERS_CAP, text: str | None = None, types=None) -> DataFrame:
    """(grp, item, n, size, share): the largest ``cap`` items per group and one pooled row for the rest.

    The top of each group is a ranked filter (limited before the shuffle); the pooled row is the group
    total minus the shown items, so no group is ever sorted in one task.
    """
    rows = filter_types(items, types).where(F.coalesce("size", F.lit(0)) > 0)
    if text:
        rows = rows.where(F.lower("path").contains(text.lower()))
    key = F.coalesce(F.col(by), F.lit(DEFAULT_CONTAINER)) if by == "container" else F.col(by)
    rows = rows.withColumn("grp", key)
    w = Window.partitionBy("grp").orderBy(F.desc("size"), "path")
    shown = (
        rows.select("grp", "path", "size").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap)
        .select("grp", F.col("path").alias("item"), F.lit(1).cast("long").alias("n"), "size")
    )
    totals = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("tn"), F.sum("size").alias("ts"))
    top = shown.groupBy("grp").agg(F.count(F.lit(1)).alias("sn"), F.sum("size").alias("ss"))
    others = totals.join(top, "grp").where(F.col("tn") > F.col("sn")).select(
        "grp", F.lit("others").alias("item"), (F.col("tn") - F.col("sn")).alias("n"), (F.col("ts") - F.col("ss")).alias("size")
    )
    grand = totals.agg(F.sum("ts").alias("_all"))
    return shown.unionByName(others).select(
        "grp", "item", "n", "size", (F.col("size") / grand.scalar()).alias("share")
    )


def audit(graph: Graph, root_types=(), limit: int = 20) -> dict[str, DataFrame]:
    """All sections at once over one graph."""
    out = {
        "stats": summary(graph),
        "unused": unused_report(graph, root_types),
        "size": size_report(graph),
        "largest": largest(graph, limit=limit),
    }
    if graph.dangling is not None:
        out["dangling"] = dangling_report(graph.dangling, graph.missing)
    if graph.missing is not None and references_to_missing(graph) is not None:
        out["dropped"] = dropped_report(graph.missing, references_to_missing(graph))
    if graph.sub_items is not None and graph.sub_usage is not None:
        owners = graph.sub_items.select("owner_id").distinct().join(
            graph.nodes.select(F.col("id").alias("owner_id"), "path"), "owner_id"
        )
        out["utilization"] = utilization(owners, graph.sub_items, graph.sub_usage)
    out.update({f"containers.{k}": v for k, v in container_report(graph, graph.containers, limit).items()})
    return out


__all__ = [
    "audit", "closure_items", "dangling_referrers", "dangling_refs", "dangling_report", "dropped_report", "largest",
    "linked_scope", "missing_referenced", "size_map", "size_report", "size_scope", "summary", "type_facets",
    "unused_report", "utilization",
]
