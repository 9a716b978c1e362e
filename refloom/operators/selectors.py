"""Structure listing and selector lookup over entry-list documents, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.functions.scalar import base, decode_token, looks_compressed
from refloom.operators.documents import INFO_TYPE, entry_table, is_node_type, node_paths, ref_at
from refloom.operators.validate import child_refs
from refloom.plans.ordering import positions_within
from refloom.plans.runtime import Levels, cut, spread


def type_names(entries: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(doc_id, idx, name): readable type of every entry; script tokens become class names."""
    rows = entries.select("doc_id", "idx", "type").where(F.col("type").isNotNull())
    if nodes is None:
        return rows.select("doc_id", "idx", F.col("type").alias("name"))
    scripts = nodes.select(F.col("id").alias("_id"), F.regexp_replace(base("path"), r"(?i)\.[jt]s$", "").alias("_name"))
    return rows.join(cut(scripts).hinted(), F.when(looks_compressed("type"), decode_token("type")) == F.col("_id"), "left").select(
        "doc_id", "idx", F.coalesce("_name", "type").alias("name")
    )


def node_index(entries: DataFrame) -> DataFrame:
    """(doc_id, idx, path, ordinal, same): node paths with the rank among same-path nodes."""
    paths = node_paths(entries, "empty")
    ranked = cut(positions_within(paths.select("doc_id", "path", "idx"), ["doc_id", "path"], ["idx"], "ordinal")).df
    per = ranked.groupBy("doc_id", "path").agg(F.count(F.lit(1)).alias("same"))
    return ranked.join(per, ["doc_id", "path"]).select("doc_id", "idx", "path", "ordinal", "same")


def disambiguated(index: DataFrame) -> DataFrame:
    """Adds ``selector``: the path, with ``[i]`` only where several nodes share it."""
    mark = F.when(F.col("same") > 1, F.concat(F.lit("["), F.col("ordinal").cast("string"), F.lit("]"))).otherwise(F.lit(""))
    return index.withColumn("selector", F.concat("path", mark))


def component_index(entries: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, node, comp, name, ordinal, same): components of each node in list order."""
    nodes = entries.where(is_node_type()).select("doc_id", "idx", "type", "entry")
    refs = child_refs(nodes, "$._components").where(F.col("target").isNotNull())
    named = refs.select("doc_id", F.col("idx").alias("node"), "pos", F.col("target").alias("comp")).join(
        names.select("doc_id", F.col("idx").alias("comp"), "name"), ["doc_id", "comp"]
    )
    ranked = cut(positions_within(named.select("doc_id", "node", "name", "pos", "comp"), ["doc_id", "node", "name"], ["pos"], "ordinal")).df
    per = ranked.groupBy("doc_id", "node", "name").agg(F.count(F.lit(1)).alias("same"))
    return ranked.join(per, ["doc_id", "node", "name"])


def list_nodes(
    entries: DataFrame, nodes: DataFrame | None = None, under: DataFrame | None = None, depth: int | None = None,
    with_type: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, components): depth-first listing with paste-ready selectors.

    Nodes are (doc_id, idx, path, name, depth, active, instance, order_key); sorting by
    (doc_id, order_key) gives depth-first order.  Components are (doc_id, node, comp, name, selector).
    ``under`` (doc_id, idx) lists subtrees only.
    """
    rows = entry_table(entries.where(F.col("idx").isNotNull()))
    index = cut(disambiguated(node_index(rows))).df
    nodes_only = rows.where(is_node_type())
    kids = cut(child_refs(nodes_only.select("doc_id", "idx", "type", "entry"), "$._children").where(F.col("target").isNotNull())).df
    is_node = nodes_only.select("doc_id", F.col("idx").alias("target"))
    kids = cut(kids.join(is_node, ["doc_id", "target"], "left_semi")).df
    key = lambda c: F.lpad(c.cast("string"), 9, "0")
    if under is not None:
        start = under.select("doc_id", "idx").join(index.select("doc_id", "idx"), ["doc_id", "idx"], "left_semi")
    else:
        start = nodes_only.where(ref_at("entry", "$._parent").isNull()).select("doc_id", "idx")
    frontier = cut(start.select("doc_id", "idx", key(F.col("idx")).alias("order_key"), F.lit(0).alias("depth")))
    seen = Levels()
    seen.add(frontier)
    d = 0
    while not frontier.empty and (depth is None or d < depth):
        d += 1
        step = (
            kids.join(frontier.hinted(), ["doc_id", "idx"])
            .select("doc_id", F.col("target").alias("idx"), F.concat("order_key", F.lit("/"), key(F.col("pos"))).alias("order_key"), (F.col("depth") + 1).alias("depth"))
            .groupBy("doc_id", "idx").agg(F.min("order_key").alias("order_key"), F.min("depth").alias("depth"))
        )
        frontier = cut(step.join(seen.hinted().select("doc_id", "idx"), ["doc_id", "idx"], "left_anti"))
        if not frontier.empty:
            seen.add(frontier)
    placed = seen.frame().select("doc_id", "idx", "order_key", "depth")
    facts = nodes_only.select(
        "doc_id", "idx", F.coalesce(F.try_variant_get("entry", "$._name", "string"), F.lit("")).alias("name"),
        F.coalesce(F.try_variant_get("entry", "$._active", "boolean"), F.lit(True)).alias("active"), ref_at("entry", "$._prefab").alias("info"),
    )
    inst = rows.where((F.col("type") == INFO_TYPE) & F.try_variant_get("entry", "$.instance.__id__", "int").isNotNull()).select(
        "doc_id", F.col("idx").alias("info"), F.lit(True).alias("_inst")
    )
    listing = (
        placed.join(facts, ["doc_id", "idx"]).join(inst, ["doc_id", "info"], "left").join(index.select("doc_id", "idx", "selector"), ["doc_id", "idx"])
        .select("doc_id", "idx", F.col("selector").alias("path"), "name", "depth", "active", F.coalesce("_inst", F.lit(False)).alias("instance"), "order_key")
    )
    comps = component_index(rows, type_names(rows, nodes))
    part = F.when(F.col("same") > 1, F.concat("name", F.lit("["), F.col("ordinal").cast("string"), F.lit("]"))).otherwise(F.col("name"))
    sel = listing.select("doc_id", F.col("idx").alias("node"), F.col("path").alias("_p"))
    components = comps.join(sel, ["doc_id", "node"]).select("doc_id", "node", "comp", "name", F.concat("_p", F.lit(":"), part).alias("selector"))
    if with_type is not None:
        keep = components.where(F.col("name") == with_type).select("doc_id", F.col("node").alias("idx"))
        listing = listing.join(keep, ["doc_id", "idx"], "left_semi")
    return listing, components


def resolve_selectors(selectors: DataFrame, entries: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(doc_id, selector, kind, idx, node, prop, error) for a table of (doc_id, selector).

    Forms: ``path[i]``, ``path:Type[i]``, ``path:Type[i].prop`` and ``#n.prop``.  A literal path wins
    over reading ``[i]`` as a rank; anything ambiguous is an error, never a guess.
    """
    rows = entry_table(entries.where(F.col("idx").isNotNull()))
    wanted = cut(selectors.select("doc_id", "selector").distinct())
    in_docs = spread(rows.join(wanted.hinted().select("doc_id"), "doc_id", "left_semi"))
    index = cut(node_index(in_docs)).df
    names = type_names(in_docs, nodes)
    sel = wanted.df
    none_s = F.lit(None).cast("string")

    # '#n' escape
    hashed = sel.where(F.col("selector").startswith("#"))
    n = F.nullif(F.regexp_extract("selector", r"^#(\d+)", 1), F.lit("")).cast("int")
    rest = F.regexp_replace(F.regexp_replace("selector", r"^#\d+", ""), r"^\.", "")
    facts = rows.select("doc_id", F.col("idx").alias("_n"), is_node_type().alias("_isn"))
    by_hash = hashed.withColumn("_n", n).withColumn("prop", F.nullif(rest, F.lit(""))).join(facts, ["doc_id", "_n"], "left").select(
        "doc_id", "selector",
        F.when(F.col("prop").isNotNull(), F.lit("property")).when(F.col("_isn"), F.lit("node")).otherwise(F.lit("component")).alias("kind"),
        F.col("_n").alias("idx"), F.lit(None).cast("int").alias("node"), "prop",
        F.when(F.col("_n").isNull(), F.lit("bad #index selector")).when(F.col("_isn").isNull(), F.lit("index out of range")).alias("error"),
    )

    split = sel.where(~F.col("selector").startswith("#")).select(
        "doc_id", "selector", F.substring_index("selector", ":", 1).alias("node_sel"),
        F.when(F.instr("selector", ":") > 0, F.regexp_replace("selector", r"^[^:]*:", "")).otherwise(F.lit("")).alias("comp_sel"),
    )
    literal = index.groupBy("doc_id", F.col("path").alias("node_sel")).agg(F.count(F.lit(1)).alias("lit_n"), F.min("idx").alias("lit_idx"))
    s = split.join(literal, ["doc_id", "node_sel"], "left")
    s = s.withColumn("sib", F.nullif(F.regexp_extract("node_sel", r"\[(\d+)\]$", 1), F.lit("")).cast("int")).withColumn(
        "bare", F.regexp_replace("node_sel", r"\[\d+\]$", "")
    )
    plain = index.groupBy("doc_id", F.col("path").alias("bare")).agg(F.count(F.lit(1)).alias("bare_n"))
    at = index.select("doc_id", F.col("path").alias("bare"), F.col("ordinal").cast("int").alias("sib"), F.col("idx").alias("sib_idx"))
    s = s.join(plain, ["doc_id", "bare"], "left").join(at, ["doc_id", "bare", "sib"], "left")
    node_err = (
        F.when(F.col("lit_n") > 1, F.lit("ambiguous node"))
        .when(F.col("lit_n") == 1, none_s)
        .when(F.col("bare_n").isNull(), F.lit("no such node"))
        .when(F.col("sib").isNotNull() & F.col("sib_idx").isNull(), F.lit("sibling out of range"))
    )
    noded = cut(
        s.select("doc_id", "selector", "comp_sel", node_err.alias("error"), F.when(F.col("lit_n") == 1, F.col("lit_idx")).otherwise(F.col("sib_idx")).alias("node"))
    ).df
    bad = noded.where(F.col("error").isNotNull()).select("doc_id", "selector", none_s.alias("kind"), F.lit(None).cast("int").alias("idx"), "node", none_s.alias("prop"), "error")
    node_only = noded.where(F.col("error").isNull() & (F.col("comp_sel") == "")).select(
        "doc_id", "selector", F.lit("node").alias("kind"), F.col("node").alias("idx"), F.lit(None).cast("int").alias("node"), none_s.alias("prop"), "error"
    )

    comps = component_index(in_docs, names)
    want = noded.where(F.col("error").isNull() & (F.col("comp_sel") != "")).select("doc_id", "selector", "comp_sel", "node")
    fits = comps.join(want, ["doc_id", "node"]).where(
        (F.col("comp_sel") == F.col("name")) | F.col("comp_sel").startswith(F.concat("name", F.lit("."))) | F.col("comp_sel").startswith(F.concat("name", F.lit("[")))
    )
    longest = fits.groupBy("doc_id", "selector").agg(F.max_by("name", F.length("name")).alias("_best"))
    picked = want.join(longest, ["doc_id", "selector"], "left")
    tail = F.expr("substring(comp_sel, length(_best) + 1)")
    picked = picked.withColumn("_t", tail).withColumn("ti", F.nullif(F.regexp_extract("_t", r"^\[(\d+)\]", 1), F.lit("")).cast("int")).withColumn(
        "prop", F.nullif(F.regexp_replace(F.regexp_replace("_t", r"^\[\d+\]", ""), r"^\.", ""), F.lit(""))
    )
    per = comps.groupBy("doc_id", "node", F.col("name").alias("_best")).agg(F.count(F.lit(1)).alias("cn"))
    target = comps.select("doc_id", "node", F.col("name").alias("_best"), F.col("ordinal").cast("int").alias("_o"), "comp")
    picked = picked.join(per, ["doc_id", "node", "_best"], "left").withColumn("_o", F.coalesce("ti", F.lit(0)))
    picked = picked.join(target, ["doc_id", "node", "_best", "_o"], "left")
    comp_err = (
        F.when(F.col("_best").isNull(), F.lit("no matching component"))
        .when(F.col("ti").isNull() & (F.col("cn") > 1), F.lit("ambiguous component"))
        .when(F.col("comp").isNull(), F.lit("component out of range"))
    )
    by_comp = picked.select(
        "doc_id", "selector", F.when(F.col("prop").isNotNull(), F.lit("property")).otherwise(F.lit("component")).alias("kind"),
        F.col("comp").alias("idx"), "node", "prop", comp_err.alias("error"),
    )
    clean = lambda df: df.select(
        "doc_id", "selector", F.when(F.col("error").isNull(), F.col("kind")).alias("kind"), F.when(F.col("error").isNull(), F.col("idx")).alias("idx"), "node", "prop", "error"
    )
    return clean(by_hash).unionByName(clean(bad)).unionByName(clean(node_only)).unionByName(clean(by_comp))


def get_values(selectors: DataFrame, entries: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(doc_id, selector, kind, value, error): the entry, or the property value as JSON text."""
    from refloom.operators.edit import read_property

    found = resolve_selectors(selectors, entries, nodes)
    rows = entries.select("doc_id", "idx", F.to_json("entry").alias("json"))
    got = found.join(rows, ["doc_id", "idx"], "left")
    value = F.when(F.col("kind") == "property", read_property(F.col("json"), F.col("prop"))).otherwise(F.col("json"))
    return got.select("doc_id", "selector", "kind", F.when(F.col("error").isNull(), value).alias("value"), "error")
