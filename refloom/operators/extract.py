"""From documents to references, and from references to edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.functions.scalar import base, decode_token, encode_token, looks_compressed, main_id, sub_id
from refloom.model import edges_from_links
from refloom.operators.documents import entry_table, hosts, node_paths, walk_refs
from refloom.plans.runtime import cut

RAW = ["src", "ref", "node_path", "component", "property"]


def handler_refs(entries: DataFrame) -> DataFrame:
    """(doc_id, idx, ref, property): event-handler wiring to a script token."""
    token = F.try_variant_get("entry", "$._componentId", "string")
    handler = F.coalesce(F.try_variant_get("entry", "$.handler", "string"), F.lit(""))
    label = F.when(handler != "", F.concat(F.lit("click → "), handler, F.lit("()"))).otherwise(F.lit("click handler"))
    return entries.where(F.coalesce(token, F.lit("")) != "").select("doc_id", "idx", token.alias("ref"), label.alias("property"))


def document_refs(entries: DataFrame) -> DataFrame:
    """(src, what, ref, node_path, component, property) for every reference a document holds.

    Entries of a list document get the path of their owning node and their own type as the site.
    """
    rows = entry_table(entries)
    found = walk_refs(rows)
    wired = handler_refs(rows).select("doc_id", "idx", F.lit("handler").alias("what"), "ref", "property")
    paths = node_paths(rows, "skip", any_type=True).select("doc_id", F.col("idx").alias("host"), F.col("path").alias("node_path"))
    place = hosts(rows).join(paths, ["doc_id", "host"], "left").select("doc_id", "idx", "node_path")
    comp = rows.select("doc_id", "idx", F.col("type").alias("component")).where(F.col("idx").isNotNull())
    all_refs = found.unionByName(wired)
    located = all_refs.join(comp, ["doc_id", "idx"], "left").join(place, ["doc_id", "idx"], "left")
    return located.select(
        F.col("doc_id").alias("src"), "what", "ref", "node_path",
        F.when(F.col("what") != "handler", F.col("component")).alias("component"),
        F.when(F.col("property") != "", F.col("property")).alias("property"),
    )


def uuid_refs(entries: DataFrame) -> DataFrame:
    return document_refs(entries).where(F.col("what") == "ref").select(*RAW)


def type_refs(entries: DataFrame) -> DataFrame:
    return document_refs(entries).where(F.col("what") == "type").select(*RAW)


def resolve_tokens(refs: DataFrame, nodes: DataFrame, col: str = "ref") -> DataFrame:
    """References written as compressed tokens, decoded and kept only when the id is a node."""
    rest = [c for c in refs.columns if c != col]
    decoded = refs.where(looks_compressed(col)).select(*rest, decode_token(col).alias(col))
    return decoded.join(cut(nodes.select(F.col("id").alias(col))).hinted(), col, "left_semi")


def type_tokens(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, token): what a class name is serialized as; NULL when no script defines it."""
    scripts = nodes.where(F.col("type") == "script").select(
        F.regexp_replace(base("path"), r"(?i)\.[jt]s$", "").alias("name"), "id"
    )
    owner = scripts.groupBy("name").agg(F.min("id").alias("id"))
    direct = F.col("name").contains(".") | looks_compressed("name")
    return names.select("name").distinct().join(owner, "name", "left").select(
        "name", F.when(direct, F.col("name")).otherwise(encode_token("id")).alias("token")
    )


def component_names(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``component_name`` and ``component_script`` (path of the defining script, if any)."""
    scripts = nodes.select(F.col("id").alias("_cid"), F.col("path").alias("component_script"))
    key = F.when(looks_compressed("component"), decode_token("component"))
    return sites.join(cut(scripts).hinted(), key == F.col("_cid"), "left").drop("_cid").withColumn(
        "component_name",
        F.coalesce(F.regexp_replace(base("component_script"), r"(?i)\.[jt]s$", ""), F.col("component"), F.lit("")),
    )


def site_selector(named: DataFrame) -> DataFrame:
    """Adds ``selector`` (path:Component.property, NULL without a path) and ``site_text``."""
    comp = F.coalesce("component_name", F.lit(""))
    prop = F.coalesce("property", F.lit(""))
    sel = F.when(
        F.coalesce("node_path", F.lit("")) != "",
        F.when(comp == "", F.col("node_path")).otherwise(
            F.concat(F.col("node_path"), F.lit(":"), comp, F.when(prop != "", F.concat(F.lit("."), prop)).otherwise(F.lit("")))
        ),
    )
    frame = F.when(F.coalesce("sub_name", F.lit("")) != "", F.concat(F.lit('  "'), F.col("sub_name"), F.lit('"'))).otherwise(F.lit(""))
    bare = F.when((comp != "") & (prop != ""), F.concat(comp, F.lit("."), prop)).otherwise(
        F.coalesce(F.when(comp != "", comp), F.when(prop != "", prop), F.lit("?"))
    )
    return named.withColumn("selector", sel).withColumn(
        "site_text", F.concat(F.coalesce("selector", F.concat(F.lit("—  "), bare)), frame)
    )


def site_struct(named: DataFrame):
    """One struct per site, ready for ``to_json``."""
    return named.select(
        "*", F.struct("node_path", "component", "property", "sub_name", F.col("component_script").alias("component_script")).alias("site")
    )


@dataclass(frozen=True)
class Resolved:
    links: DataFrame
    edges: DataFrame
    sites: DataFrame
    sub_usage: DataFrame
    dangling: DataFrame
    missing_hits: DataFrame | None


def resolve_refs(raw: DataFrame, nodes: DataFrame, sub_items: DataFrame | None = None, missing: DataFrame | None = None) -> Resolved:
    """Split raw references into edges with sites, sub-item usage, and dangling references.

    The kind of an edge comes from its target: the kind of the referenced sub-item, else the type of
    the node.  A reference to a whole owner is usage with a NULL sub-item.
    """
    refs = raw.select(*RAW).withColumn("dst", main_id("ref")).withColumn("sub", sub_id("ref"))
    # few targets are referred to by very many rows: both tables are broadcast where their measured size allows it
    joined = refs.join(cut(nodes.select(F.col("id").alias("dst"), F.col("type").alias("_type"))).hinted(), "dst", "left")
    if sub_items is not None:
        subs = sub_items.select(
            F.col("owner_id").alias("dst"), F.col("sub_id").alias("sub"), F.col("kind").alias("_sub_kind"), F.col("name").alias("_sub_name")
        )
        joined = joined.join(cut(subs).hinted(), ["dst", "sub"], "left")
    else:
        joined = joined.withColumn("_sub_kind", F.lit(None).cast("string")).withColumn("_sub_name", F.lit(None).cast("string"))
    rows = cut(joined.withColumn("kind", F.coalesce("_sub_kind", "_type"))).df
    hit = rows.where(F.col("_type").isNotNull())
    links = hit.select("src", "dst", "kind")
    sites = hit.where(
        F.col("node_path").isNotNull() | F.col("component").isNotNull() | F.col("property").isNotNull()
    ).select("src", "dst", "kind", "node_path", "component", "property", F.col("_sub_name").alias("sub_name"))
    usage = hit.select(F.col("dst").alias("owner_id"), F.col("sub").alias("sub_id")).distinct()
    dangling = rows.where(F.col("_type").isNull()).select(*RAW)
    lost = None
    if missing is not None:
        lost = dangling.join(missing.select(F.col("id").alias("_m"), "path"), main_id("ref") == F.col("_m")).drop("_m")
    return Resolved(links, edges_from_links(links), sites, usage, dangling, lost)


def dedupe_edges(raw_edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, kind), weight = multiplicity, the smallest label kept."""
    label = F.min("label") if "label" in raw_edges.columns else F.lit(None).cast("string")
    return raw_edges.groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("weight"), label.alias("label"))


def document_sources(entries: DataFrame, nodes: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Raw references of documents with script tokens already decoded, ready for ``resolve_refs``.

    ``refs`` are the documents' references where they were extracted before.
    """
    refs = cut(document_refs(entries)).df if refs is None else refs
    plain = refs.where(F.col("what") == "ref").select(*RAW)
    tokens = resolve_tokens(refs.where(F.col("what") != "ref").select(*RAW), nodes)
    return plain.unionByName(tokens.select(*RAW))
