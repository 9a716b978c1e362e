"""Entry-list documents as tables: entries, internal references, owning nodes and node paths.

A document is a JSON array in which ``{"__id__": n}`` stands for entry ``n``.  Entries are rows of
(doc_id, idx, type, entry); everything else is derived from them by joins on (doc_id, idx).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.plans.runtime import Levels, cut, spread, union_all

# Fixed values of the document format.
NODE_TYPES = ("cc.Node", "cc.Scene")
SCENE_TYPE = "cc.Scene"
DOC_TYPE = "cc.Prefab"
INFO_TYPE = "cc.PrefabInfo"
COMP_INFO_TYPE = "cc.CompPrefabInfo"
INSTANCE_TYPE = "cc.PrefabInstance"
OVERRIDE_TYPE = "CCPropertyOverrideInfo"
TARGET_TYPE = "cc.TargetInfo"
CROSS_REF_TYPE = "cc.TargetOverrideInfo"
HOST_HOPS = 6
ID_PATTERN = r'"__id__":(-?\d+)'


def is_node_type(col="type"):
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.isin(*NODE_TYPES), F.lit(False))


def ref_at(entry, path: str):
    """The entry index a reference field holds; NULL when it is not a reference."""
    e = F.col(entry) if isinstance(entry, str) else entry
    return F.try_variant_get(e, f"{path}.__id__", "int")


def _is_list_text(col: str = "text"):
    return F.col(col).rlike(r"^\s*\[")


def parse_docs(docs: DataFrame) -> DataFrame:
    """(doc_id, v, is_list): parsed text; ``v`` is NULL for text that is not JSON."""
    return docs.select("doc_id", F.try_parse_json("text").alias("v"), _is_list_text().alias("_l")).select(
        "doc_id", "v", (F.col("_l") & F.col("v").isNotNull()).alias("is_list")
    )


def parse_failures(docs: DataFrame) -> DataFrame:
    return parse_docs(docs).where(F.col("v").isNull()).select("doc_id", F.lit("invalid JSON").alias("error"))


def doc_entries(docs: DataFrame, lists_only: bool = False) -> DataFrame:
    """(doc_id, idx, type, entry).  A document that is one object is a single row with NULL idx.

    Each text is parsed once; text that is not JSON explodes to nothing.
    """
    tvf = docs.sparkSession.tvf
    rows = (
        docs.where(_is_list_text()).select("doc_id", "text")
        .lateralJoin(tvf.variant_explode(F.try_parse_json(F.col("text").outer())))
        .select("doc_id", F.col("pos").alias("idx"), F.col("value").alias("entry"))
    )
    if not lists_only:
        single = docs.where(F.col("text").rlike(r"^\s*\{")).select(
            "doc_id", F.lit(None).cast("int").alias("idx"), F.try_parse_json("text").alias("entry")
        )
        rows = rows.unionByName(single.where(F.col("entry").isNotNull()))
    return spread(with_type(rows))


def entry_table(entries: DataFrame) -> DataFrame:
    """Entries at rest, hashed by (doc_id, idx): a huge document spreads over all tasks, and the many
    joins on that key that follow find their larger side already in place."""
    return cut(entries.repartition("doc_id", "idx")).df


def with_type(rows: DataFrame) -> DataFrame:
    # only a JSON string is a type; numbers and objects under the key are not
    tag = F.try_variant_get("entry", "$.__type__", "variant")
    text = F.when(F.schema_of_variant(tag) == "STRING", F.try_variant_get("entry", "$.__type__", "string"))
    return rows.select("doc_id", "idx", text.alias("type"), "entry")


def id_refs(entries: DataFrame) -> DataFrame:
    """(doc_id, owner, target): every internal reference an entry holds, in any depth."""
    text = F.to_json("entry")
    held = entries.where(F.col("idx").isNotNull()).select(
        "doc_id", F.col("idx").alias("owner"), F.explode(F.regexp_extract_all(text, F.lit(ID_PATTERN), F.lit(1))).alias("target")
    )
    return held.withColumn("target", F.col("target").cast("int"))


def first_referrer(refs: DataFrame) -> DataFrame:
    """(doc_id, target, owner): the first entry that holds each reference."""
    return refs.groupBy("doc_id", "target").agg(F.min("owner").alias("owner"))


def hosts(entries: DataFrame) -> DataFrame:
    """(doc_id, idx, host): the node an entry belongs to.

    Its ``node`` field, itself when it is a node, otherwise the same question asked of whoever first
    refers to it, at most six times.  Only rows still undecided take part in each climb.
    """
    listed = entries.where(F.col("idx").isNotNull())
    own = F.coalesce(ref_at("entry", "$.node"), F.when(is_node_type(), F.col("idx")))
    up = first_referrer(id_refs(listed)).select("doc_id", F.col("target").alias("idx"), F.col("owner").alias("up"))
    info = cut(listed.select("doc_id", "idx", own.alias("host")).join(up, ["doc_id", "idx"], "left")).df
    done = [info.where(F.col("host").isNotNull()).select("doc_id", "idx", "host")]
    todo = cut(info.where(F.col("host").isNull() & F.col("up").isNotNull()).select("doc_id", "idx", "up"))
    nxt = info.select("doc_id", F.col("idx").alias("up"), F.col("host"), F.col("up").alias("up2"))
    for _ in range(HOST_HOPS):
        if todo.empty:
            break
        step = cut(todo.hinted().join(nxt, ["doc_id", "up"]).select("doc_id", "idx", "host", F.col("up2").alias("up")))
        done.append(step.df.where(F.col("host").isNotNull()).select("doc_id", "idx", "host"))
        todo = cut(step.df.where(F.col("host").isNull() & F.col("up").isNotNull()).select("doc_id", "idx", "up"))
    return spread(union_all(done))


def node_paths(entries: DataFrame, unnamed: str = "skip", any_type: bool = False) -> DataFrame:
    """(doc_id, idx, path): names joined from the root down the ``_parent`` chain.

    ``unnamed`` says how an entry without a name appears: ``skip`` (left out), ``index`` (``#idx``) or
    ``empty`` (an empty segment).  Only node-typed entries count unless ``any_type``.  Every round doubles the
    part of the chain that an entry knows, so jobs grow with the logarithm of the depth; entries whose chain is longer than
    their document are on or below a parent cycle and are climbed separately.
    """
    name = F.try_variant_get("entry", "$._name", "string")
    shown = {
        "skip": F.when(name != "", name),
        "index": F.when(name != "", name).otherwise(F.concat(F.lit("#"), F.col("idx").cast("string"))),
        "empty": F.coalesce(name, F.lit("")),
    }[unnamed]
    rows = entries.where(F.col("idx").isNotNull())
    if not any_type:
        rows = rows.where(is_node_type())
    seg = F.when(F.col("seg").isNotNull(), F.array("seg")).otherwise(F.array().cast("array<string>"))
    info = cut(rows.select("doc_id", "idx", ref_at("entry", "$._parent").alias("parent"), shown.alias("seg"))).df
    state = cut(info.select("doc_id", "idx", F.col("parent").alias("at"), seg.alias("segs")))
    sizes = info.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    known, loose, reach = state, None, 1
    while True:
        above = known.df.select("doc_id", F.col("idx").alias("at"), F.col("at").alias("_at"), F.col("segs").alias("_segs"))
        grown = known.df.join(above, ["doc_id", "at"], "left")
        known = cut(grown.select("doc_id", "idx", F.col("_at").alias("at"), F.concat(F.coalesce("_segs", F.array().cast("array<string>")), "segs").alias("segs")))
        reach *= 2
        going = known.df.where("at IS NOT NULL")
        if going.isEmpty():
            break
        # a chain with more steps than its document has entries
        out = cut(going.join(sizes, "doc_id").where(F.col("_n") < reach).select("doc_id", "idx"))
        if not out.empty:
            loose = out.df if loose is None else loose.unionByName(out.df)
            known = cut(known.df.join(out.hinted(), ["doc_id", "idx"], "left_anti"))
    found = known.df.select("doc_id", "idx", F.array_join("segs", "/").alias("path"))
    if loose is None:
        return found
    looped = cut(info.join(loose, ["doc_id", "idx"], "left_semi").select("doc_id", "idx", "parent", "seg"))
    return spread(found.unionByName(_cycle_paths(looped.df)))


def _cycle_paths(looped: DataFrame) -> DataFrame:
    hop = looped.select("doc_id", F.col("idx").alias("at"), F.col("parent").alias("next"), F.col("seg").alias("next_seg"))
    trail = cut(
        looped.select(
            "doc_id", "idx", F.col("parent").alias("at"), F.array("idx").alias("ids"),
            F.when(F.col("seg").isNotNull(), F.array("seg")).otherwise(F.array().cast("array<string>")).alias("segs"),
        )
    )
    done = []
    while not trail.empty:
        ended = trail.df.where(F.array_contains("ids", F.col("at")))
        done.append(ended.select("doc_id", "idx", F.array_join(F.reverse("segs"), "/").alias("path")))
        going = trail.df.where(~F.array_contains("ids", F.col("at")))
        trail = cut(
            going.join(hop, ["doc_id", "at"]).select(
                "doc_id", "idx", F.col("next").alias("at"), F.concat("ids", F.array("at")).alias("ids"),
                F.when(F.col("next_seg").isNotNull(), F.concat("segs", F.array("next_seg"))).otherwise(F.col("segs")).alias("segs"),
            )
        )
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def walk_refs(entries: DataFrame) -> DataFrame:
    """(doc_id, idx, what, ref, property): reference leaves and type tokens of each entry's own content.

    ``what`` is ``ref`` for ``__uuid__`` leaves and ``type`` for ``__type__`` tokens, at any depth.
    Internal references are not followed.  Each round opens one nesting level of all entries at once
    with ``variant_explode``; there is no shuffle.
    """
    tvf = entries.sparkSession.tvf
    level = cut(_containers(entries.select("doc_id", "idx", F.lit("").alias("property"), F.col("entry").alias("v"))))
    out = Levels()
    while not level.empty:
        marked = level.df.select("*", _leaf("__uuid__").alias("uuid"), _leaf("__type__").alias("tag"),
                                 F.try_variant_get("v", "$.__id__", "variant").isNotNull().alias("is_id"))
        refs = marked.where(F.coalesce("uuid", F.lit("")) != "").select(
            "doc_id", "idx", F.lit("ref").alias("what"), F.col("uuid").alias("ref"), "property")
        inner = marked.where((F.coalesce("uuid", F.lit("")) == "") & ~F.col("is_id"))
        tags = inner.where(F.col("tag").isNotNull()).select(
            "doc_id", "idx", F.lit("type").alias("what"), F.col("tag").alias("ref"), "property")
        out.add(cut(refs.unionByName(tags)))
        step = F.coalesce(F.col("key"), F.col("pos").cast("string"))
        opened = (
            inner.select("doc_id", "idx", "property", "v")
            .lateralJoin(tvf.variant_explode(F.col("v").outer()))
            .where(F.coalesce("key", F.lit("")) != "__type__")
            .select("doc_id", "idx", F.when(F.col("property") == "", step).otherwise(F.concat_ws(".", "property", step)).alias("property"),
                    F.col("value").alias("v"))
        )
        level = cut(_containers(opened))
    frame = out.frame() if out.rows else None
    if frame is None:
        return entries.select("doc_id", "idx", F.lit("ref").alias("what"), F.col("type").alias("ref"), F.lit("").alias("property")).where(F.lit(False))
    return frame


def _containers(df: DataFrame) -> DataFrame:
    s = F.schema_of_variant("v")
    return df.where(s.startswith("OBJECT") | s.startswith("ARRAY"))


def _leaf(key: str):
    v = F.try_variant_get("v", f"$.{key}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get("v", f"$.{key}", "string"))
