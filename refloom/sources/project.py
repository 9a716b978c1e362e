"""A project tree read into a Graph: one listing, and the bytes of sidecars and of text files, each read once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions.scalar import ext_of
from refloom.model import DEFAULT_CONTAINER, Graph, conform_nodes, edges_from_links
from refloom.operators.containers import assign_container
from refloom.operators.documents import doc_entries, parse_failures
from refloom.operators.extract import RAW, document_refs, document_sources, resolve_refs, resolve_tokens
from refloom.operators.extractors import (
    attr_edges, attr_refs, component_closure, extends_edges, line_edges, sibling_edges,
)
from refloom.plans.runtime import cut, union_all
from refloom.registry import Registry, merge_extractions
from refloom.sources.files import (
    META_SUFFIX, builtin_types, container_table, parse_meta, read_text, scan_files, split_missing, with_registrations,
)

# Extensions whose text is a reference-bearing JSON document (fixed default).
DOCUMENT_EXTS = (".prefab", ".scene", ".anim", ".mtl")
SCRIPT_TYPE = "script"
SCRIPT_EXTS = (".ts", ".js")
TEXT_EXTS = (".atlas", ".plist")


@dataclass
class Project:
    graph: Graph
    files: DataFrame
    texts: DataFrame  # path, text of documents, scripts and text atlases
    entries: DataFrame
    scripts: DataFrame
    extractor_errors: DataFrame
    nodes: DataFrame = field(init=False)

    def __post_init__(self) -> None:
        self.nodes = self.graph.nodes


def load_project(spark: SparkSession, root: str, registry: Registry | None = None) -> Project:
    registry = registry or Registry()
    listing = scan_files(spark, root)
    metas = read_text(scan_files(spark, root, content=True, exts=[META_SUFFIX]).where(F.col("path").endswith(META_SUFFIX)))
    table = builtin_types(spark)
    if registry.importer_types or registry.ext_types:
        table = with_registrations(table, registry.type_table(spark))
    records, subs, errors = parse_meta(metas, table)
    records, subs, errors = cut(records).df, cut(subs).df, cut(errors).df
    nodes, missing = split_missing(records, listing.where(~F.col("path").endswith(META_SUFFIX)), subs)
    missing = cut(missing).df

    wanted = [*DOCUMENT_EXTS, *registry.walked_exts]
    ext = ext_of("path")
    readable = sorted({*wanted, *SCRIPT_EXTS, *TEXT_EXTS})
    texts = cut(read_text(scan_files(spark, root, content=True, exts=readable).where(ext.isin(*readable)))).df
    by_path = nodes.select("id", "path", "type")
    docs = texts.where(ext.isin(*wanted)).join(by_path, "path").select(F.col("id").alias("doc_id"), "text")
    entries = cut(doc_entries(docs)).df
    scripts = texts.join(by_path.where(F.col("type") == SCRIPT_TYPE), "path").select("id", "path", "text")

    refs = cut(document_refs(entries)).df  # read twice: for the types in use, and for the edges
    tokens = resolve_tokens(refs.where(F.col("what") == "type").select(*RAW), nodes).select(F.col("ref").alias("id"))
    comps = cut(component_closure(scripts, tokens)).df
    dropped = nodes.where(F.col("type") == SCRIPT_TYPE).join(comps, "id", "left_anti").select("id")
    nodes = nodes.join(dropped, "id", "left_anti")
    containers = cut(container_table(records)).df
    nodes = assign_container(conform_nodes(nodes), containers, DEFAULT_CONTAINER)
    nodes = cut(nodes.withColumn("in_resources", F.col("path").startswith("resources/"))).df

    raw = document_sources(entries, nodes, refs)
    particles = attr_refs(nodes.where(F.col("type") == "particle"), ["$.spriteFrameUuid", "$.textureUuid"]).select(
        "src", "ref", F.lit(None).cast("string").alias("node_path"), F.lit("cc.ParticleSystem2D").alias("component"),
        F.lit("spriteFrame").alias("property"),
    )
    res = resolve_refs(raw.unionByName(particles), nodes, subs, missing)
    atlas_subs = subs.join(nodes.where(F.col("type") == "atlas").select(F.col("id").alias("owner_id")), "owner_id", "left_semi")
    atlas, no_atlas = attr_edges(atlas_subs, "$.imageUuidOrDatabaseUri", "texture", nodes, missing, id_col="owner_id")
    font, no_font = attr_edges(nodes.where(F.col("type") == "font"), "$.textureUuid", "texture", nodes, missing)
    spine, no_spine = sibling_edges(nodes, "spine", r"(?i)\.json$", [(".atlas", "spine-atlas"), (".png", "texture")], missing)
    pages = texts.join(nodes.where(F.col("type") == "spine-atlas").select("id", "path"), "path").select("id", "path", "text")
    page, no_page = line_edges(pages, nodes, "texture", missing)
    inherit = extends_edges(scripts.join(comps, "id", "left_semi"))
    links = cut(union_all([res.links, atlas, font, spine, page, inherit])).df
    # references of extractors to records whose source is gone (those of documents are dangling); found by path, they get the record's id
    by_id = union_all([no_atlas.select("src", F.col("dst").alias("ref")), no_font.select("src", F.col("dst").alias("ref"))])
    by_name = union_all([no_spine.select("src", "path"), no_page.select("src", "path")]).join(missing.select("path", F.col("id").alias("ref")), "path")
    hits = cut(by_id.unionByName(by_name.select("src", "ref"))).df
    bad_docs = parse_failures(docs).select(F.col("doc_id").alias("path"), "error")
    graph = Graph(
        nodes, edges_from_links(links), links, res.sites, subs, res.sub_usage, containers, res.dangling, missing,
        errors, {"document_errors": bad_docs, "missing_hits": hits},
    )
    project = Project(graph, listing, texts, entries, scripts, spark.createDataFrame([], "name string, error string"))
    if registry.extractors:
        parts, failed = registry.run_extractors(project)
        project.graph, project.extractor_errors = merge_extractions(graph, parts), failed
    return project


