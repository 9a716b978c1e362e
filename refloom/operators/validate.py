"""Structural validation of entry-list documents, and reports over instance overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.operators.documents import (
    CROSS_REF_TYPE, INFO_TYPE, INSTANCE_TYPE, OVERRIDE_TYPE, entry_table, id_refs, is_node_type, node_paths, ref_at,
)
from refloom.plans.runtime import cut, spread, union_all

ERRORS = ("empty", "no-root", "bad-ref", "null-entry", "untyped-entry", "bad-child", "bad-comp-ref", "unloadable")
LEAK_NAME = "should_hide_in_hierarchy"  # fixed value


def list_field(entries: DataFrame, path: str) -> DataFrame:
    """(doc_id, idx, pos, item): the items of an array field."""
    tvf = entries.sparkSession.tvf
    arr = F.try_variant_get("entry", path, "variant")
    return (
        entries.select("doc_id", "idx", arr.alias("_a")).where(F.schema_of_variant("_a").startswith("ARRAY"))
        .lateralJoin(tvf.variant_explode(F.col("_a").outer()))
        .select("doc_id", "idx", "pos", F.col("value").alias("item"))
    )


def child_refs(entries: DataFrame, path: str) -> DataFrame:
    """(doc_id, idx, pos, target): array-field items as entry indices, NULL for a non-reference."""
    return list_field(entries, path).select("doc_id", "idx", "pos", F.try_variant_get("item", "$.__id__", "int").alias("target"))


def _issue(df: DataFrame, code: str, idx: Column | None = None) -> DataFrame:
    return df.select(
        "doc_id", F.lit("error" if code in ERRORS else "warning").alias("severity"), F.lit(code).alias("code"),
        (F.lit(None) if idx is None else idx).cast("int").alias("idx"),
    )


def validate_docs(docs: DataFrame, entries: DataFrame, known_types: DataFrame | None = None) -> DataFrame:
    """(doc_id, severity, code, idx): one row per finding.

    ``docs`` is (doc_id, is_list, v) from ``parse_docs``; ``known_types`` (type) enables the check that
    a type outside the built-in namespace names a known class.
    """
    rows = entry_table(
        entries.where(F.col("idx").isNotNull()).select(
            "doc_id", "idx", "type", is_node_type().alias("is_node"), ref_at("entry", "$._parent").alias("parent"),
            ref_at("entry", "$.node").alias("node"), F.schema_of_variant("entry").alias("_s"), "entry",
        )
    )
    facts = rows.select("doc_id", "idx", "type", "is_node", "parent", "node", "_s")
    refs = cut(id_refs(rows.select("doc_id", "idx", "type", "entry"))).df
    nodes = rows.where("is_node").select("doc_id", "idx", "type", "entry")
    kids, comps = cut(child_refs(nodes, "$._children")).df, cut(child_refs(nodes, "$._components")).df

    listed = docs.where("is_list").select("doc_id")
    parts = [
        _issue(docs.where(~F.col("is_list")), "unloadable"),
        _issue(listed.join(rows.select("doc_id"), "doc_id", "left_anti"), "empty"),
        _issue(facts.where((F.col("idx") == 0) & F.col("type").isNull()), "no-root", F.col("idx")),
        _issue(facts.where(F.col("_s").isNull() | (F.col("_s") == "VOID")), "null-entry", F.col("idx")),
        _issue(facts.where((F.col("_s") != "VOID") & F.col("type").isNull()), "untyped-entry", F.col("idx")),
    ]
    typed = facts.where(F.col("type").isNotNull()).select("doc_id", F.col("idx").alias("target"))
    parts.append(_issue(refs.join(typed, ["doc_id", "target"], "left_anti"), "bad-ref", F.col("owner")))

    target = facts.select("doc_id", F.col("idx").alias("target"), F.col("is_node").alias("t_node"), F.col("parent").alias("t_parent"),
                          F.col("node").alias("t_owner"), (F.col("_s") != "VOID").alias("t_live"))
    k = kids.join(target, ["doc_id", "target"], "left")
    parts.append(_issue(k.where(~F.coalesce("t_node", F.lit(False))), "bad-child", F.col("idx")))
    parts.append(_issue(k.where(F.col("t_node") & ~F.col("t_parent").eqNullSafe(F.col("idx"))), "parent-mismatch", F.col("target")))
    c = comps.join(target, ["doc_id", "target"], "left")
    parts.append(_issue(c.where(~F.coalesce("t_live", F.lit(False))), "bad-comp-ref", F.col("idx")))
    parts.append(_issue(c.where(F.col("t_live") & (F.col("t_owner") != F.col("idx"))), "comp-node-mismatch", F.col("target")))

    held = refs.select("doc_id", F.col("target").alias("idx"))
    loose = facts.where((F.col("idx") > 0) & F.col("_s").startswith("OBJECT")).join(held, ["doc_id", "idx"], "left_anti")
    parts.append(_issue(loose, "orphan-entry", F.col("idx")))
    if known_types is not None:
        odd = facts.where(F.col("type").isNotNull() & ~F.col("type").startswith("cc.")).join(known_types.select("type").distinct(), "type", "left_anti")
        parts.append(_issue(odd, "unresolved-type", F.col("idx")))
    return union_all(parts)


def validation_summary(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """(total, passed, failures, warnings) over all documents."""
    per = issues.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    return docs.select("doc_id").join(per, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce("e", F.lit(0)) == 0).alias("passed"),
        F.count_if(F.coalesce("e", F.lit(0)) > 0).alias("failures"),
        # warnings of documents that could not be loaded do not exist, so every warning counts
        F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("warnings"),
    )


# ---- instance overrides ------------------------------------------------------------------------


def instance_roots(entries: DataFrame) -> DataFrame:
    """(doc_id, node, info, inst, name, file_id, source): nodes that host a nested instance."""
    nodes = entries.where(is_node_type()).select(
        "doc_id", F.col("idx").alias("node"), ref_at("entry", "$._prefab").alias("info"), F.try_variant_get("entry", "$._name", "string").alias("name")
    ).where(F.col("info").isNotNull())
    infos = entries.where(F.col("type") == INFO_TYPE).select(
        "doc_id", F.col("idx").alias("info"), ref_at("entry", "$.instance").alias("inst"),
        F.try_variant_get("entry", "$.fileId", "string").alias("file_id"), F.try_variant_get("entry", "$.asset.__uuid__", "string").alias("source"),
    )
    return spread(nodes.join(infos, ["doc_id", "info"]).where(F.col("inst").isNotNull()))


def instance_overrides(entries: DataFrame) -> DataFrame:
    """(doc_id, instance, instance_path, source, prop, local_id, on_root) per property override.

    An override is on the root when its target is exactly the host's own file id.
    """
    rows = entry_table(entries.where(F.col("idx").isNotNull()))
    inst = rows.where(F.col("type") == INSTANCE_TYPE)
    ov = child_refs(inst, "$.propertyOverrides").select("doc_id", F.col("idx").alias("inst"), F.col("target").alias("ov"))
    infos = rows.where(F.col("type") == OVERRIDE_TYPE).select(
        "doc_id", F.col("idx").alias("ov"), ref_at("entry", "$.targetInfo").alias("ti"),
        F.array_join(F.coalesce(F.try_variant_get("entry", "$.propertyPath", "array<string>"), F.array().cast("array<string>")), ".").alias("prop"),
    )
    targets = rows.select("doc_id", F.col("idx").alias("ti"), F.try_variant_get("entry", "$.localID", "array<string>").alias("local_id"))
    host = instance_roots(rows).groupBy("doc_id", "inst").agg(F.max(F.struct("node", "name", "file_id", "source")).alias("h"))
    paths = node_paths(rows, "index").select("doc_id", F.col("idx").alias("hnode"), F.col("path").alias("hpath"))
    found = ov.join(infos, ["doc_id", "ov"]).join(targets, ["doc_id", "ti"], "left").join(host, ["doc_id", "inst"], "left")
    found = found.withColumn("hnode", F.col("h.node")).join(paths, ["doc_id", "hnode"], "left")
    tag = lambda c: F.concat(F.lit("#"), c.cast("string"))
    local = F.coalesce("local_id", F.array().cast("array<string>"))
    return found.select(
        "doc_id", "inst",
        F.when(F.col("hnode").isNull(), tag(F.col("inst"))).otherwise(F.coalesce(F.nullif(F.col("h.name"), F.lit("")), tag(F.col("hnode")))).alias("instance"),
        F.when(F.col("hnode").isNull(), tag(F.col("inst"))).otherwise(F.col("hpath")).alias("instance_path"),
        F.col("h.source").alias("source"), "prop", local.alias("local_id"),
        F.coalesce((F.size(local) == 1) & (F.get(local, F.lit(0)) == F.col("h.file_id")), F.lit(False)).alias("on_root"),
    )


def override_rows(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Overrides with the file path and type of their document: what the rule engine reads."""
    n = nodes.select(F.col("id").alias("doc_id"), F.col("path").alias("file"), "type")
    return instance_overrides(entries).join(cut(n).hinted(), "doc_id")


def name_leaks(entries: DataFrame, pattern: str = LEAK_NAME) -> DataFrame:
    """(doc_id, idx, name): nodes whose name contains a forbidden text."""
    name = F.try_variant_get("entry", "$._name", "string")
    return entries.where(is_node_type() & F.coalesce(name.contains(pattern), F.lit(False))).select("doc_id", "idx", name.alias("name"))


def file_id_paths(entries: DataFrame) -> DataFrame:
    """(doc_id, file_id, path): the node each file id of a document stands for (first one wins)."""
    rows = entries.where(F.col("idx").isNotNull())
    nodes = rows.where(is_node_type()).select("doc_id", "idx", ref_at("entry", "$._prefab").alias("info")).where(F.col("info").isNotNull())
    infos = rows.where(F.col("type") == INFO_TYPE).select("doc_id", F.col("idx").alias("info"), F.try_variant_get("entry", "$.fileId", "string").alias("file_id"))
    owner = nodes.join(infos, ["doc_id", "info"]).where(F.col("file_id").isNotNull()).groupBy("doc_id", "file_id").agg(F.min("idx").alias("idx"))
    return owner.join(node_paths(rows, "index"), ["doc_id", "idx"]).select("doc_id", "file_id", "path")


def deep_override_paths(entries: DataFrame) -> DataFrame:
    """Overrides below an instance root, with the node named through its source document."""
    deep = instance_overrides(entries).where(~F.col("on_root"))
    names = file_id_paths(entries).select(F.col("doc_id").alias("source"), F.col("file_id").alias("_fid"), F.col("path").alias("deep_path"))
    parent = F.regexp_extract("instance_path", r"^(.*)/[^/]*$", 1)
    out = deep.withColumn("_fid", F.when(F.size("local_id") == 1, F.get("local_id", F.lit(0)))).join(names, ["source", "_fid"], "left")
    return out.drop("_fid").withColumn(
        "node_path", F.when(F.col("deep_path").isNotNull(), F.when(parent != "", F.concat(parent, F.lit("/"), "deep_path")).otherwise(F.col("deep_path")))
    )


def cross_references(entries: DataFrame) -> DataFrame:
    """(doc_id, info, source, prop, target, target_id): reference wiring across instance borders."""
    rows = entries.where(F.col("idx").isNotNull())
    held = child_refs(rows.where(F.col("type") == INFO_TYPE), "$.targetOverrides").select("doc_id", F.col("idx").alias("info"), F.col("target").alias("xref"))
    x = rows.where(F.col("type") == CROSS_REF_TYPE).select(
        "doc_id", F.col("idx").alias("xref"), ref_at("entry", "$.source").alias("source"), ref_at("entry", "$.target").alias("target"),
        ref_at("entry", "$.targetInfo").alias("ti"),
        F.array_join(F.coalesce(F.try_variant_get("entry", "$.propertyPath", "array<string>"), F.array().cast("array<string>")), ".").alias("prop"),
    )
    ti = rows.select("doc_id", F.col("idx").alias("ti"), F.try_variant_get("entry", "$.localID[0]", "string").alias("target_id"))
    return held.join(x, ["doc_id", "xref"]).join(ti, ["doc_id", "ti"], "left").select("doc_id", "info", "xref", "source", "prop", "target", "target_id")


def override_anatomy(entries: DataFrame) -> dict[str, DataFrame]:
    """Instances, value overrides and reference wiring of every document, with names resolved."""
    return {
        "instances": instance_roots(entries.where(F.col("idx").isNotNull())),
        "overrides": instance_overrides(entries),
        "deep": deep_override_paths(entries),
        "wiring": cross_references(entries),
        "file_ids": file_id_paths(entries),
    }
