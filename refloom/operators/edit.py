"""Bulk edits of entry-list documents: every edit is a table of instructions joined to entries.

Structure (what is removed, renumbered, moved, appended) is decided by joins and fixpoints on Spark;
a small Arrow helper applies the finished instructions of one entry to that entry's JSON.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.operators.documents import (
    COMP_INFO_TYPE, CROSS_REF_TYPE, DOC_TYPE, INFO_TYPE, INSTANCE_TYPE, OVERRIDE_TYPE, SCENE_TYPE, TARGET_TYPE,
    entry_table, id_refs, is_node_type, ref_at, with_type,
)
from refloom.operators.traverse import cascade_orphans, is_descendant, walk
from refloom.operators.validate import child_refs, instance_roots
from refloom.plans.ordering import positions_within, running_sum
from refloom.plans.runtime import cut, spread, union_all

# ---- text-level reference rewrite --------------------------------------------------------------

# A quoted id, alone or followed by a sub-id (fixed pattern).
QUOTED_ID = r'"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})(?=["@])'


def splice(text: Column, pattern: str, render) -> Column:
    """Rebuild a text with every match of ``pattern`` (one group) replaced by ``render(group)``."""
    pieces = F.split(text, pattern)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), render)
    return F.array_join(F.zip_with(pieces, found, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")


def rewrite_refs(docs: DataFrame, mapping: DataFrame, pattern: str = QUOTED_ID) -> tuple[DataFrame, DataFrame]:
    """(docs', counts): ids replaced by a table of (old, new) in whole texts, and (doc_id, old, n).

    The distinct ids of each text are joined to the mapping, so only affected documents are rewritten
    and the mapping may be of any size.  A pair with old = new does nothing.
    """
    pairs = mapping.where(F.col("old") != F.col("new")).select("old", "new").distinct()
    held = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("old"))
    counts = held.groupBy("doc_id", "old").agg(F.count(F.lit(1)).alias("n")).join(pairs, "old")
    counts = cut(counts).df
    # one small map per affected document: only the ids that document holds
    per = counts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_m"))
    fixed = splice(F.col("text"), pattern, lambda t: F.concat(F.lit('"'), F.coalesce(F.element_at("_m", t), t)))
    out = docs.join(per, "doc_id", "left").withColumn("text", F.when(F.col("_m").isNull(), F.col("text")).otherwise(fixed))
    return out.drop("_m"), counts.select("doc_id", "old", "new", "n")


# ---- instructions on one entry -----------------------------------------------------------------

_NOTE = T.StructType([T.StructField("seq", T.IntegerType()), T.StructField("level", T.StringType()), T.StructField("note", T.StringType())])
_RESULT = T.StructType([T.StructField("json", T.StringType()), T.StructField("notes", T.ArrayType(_NOTE))])


def _steps(path: str) -> list[str]:
    return [p for p in re.sub(r"\[(\d+)\]", r".\1", path).split(".") if p]


def _kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "string"
    if isinstance(v, list):
        return "array"
    if isinstance(v.get("__uuid__"), str):
        return "asset"
    if isinstance(v.get("__id__"), int):
        return "ref"
    return v["__type__"] if isinstance(v.get("__type__"), str) else "object"


_MISSING = object()


def _peek(node, steps: list[str]):
    for s in steps:
        if isinstance(node, list):
            node = node[int(s)] if s.isdigit() and int(s) < len(node) else _MISSING
        elif isinstance(node, dict):
            node = node.get(s, _MISSING)
        else:
            return _MISSING
        if node is _MISSING:
            return _MISSING
    return node


def _put(node, steps: list[str], value) -> str | None:
    holder = _peek(node, steps[:-1])
    last = steps[-1]
    if isinstance(holder, list) and last.isdigit():
        at = int(last)
        if at > len(holder):
            return f"index {last} is out of range for an array of length {len(holder)}"
        holder[at:at + 1] = [value]
        return None
    if not isinstance(holder, dict):
        return "path stops early"
    holder[last] = value
    return None


def _one(entry, op: str, prop: str, value, force: bool) -> tuple[str, str] | None:
    """Apply one instruction in place; (level, note) when there is something to report."""
    steps = _steps(prop)
    if op == "set":
        old = _peek(entry, steps)
        if old is _MISSING and not force and not steps[-1].isdigit():
            return "error", f'no existing property "{prop}"'
        problem = _put(entry, steps, value)
        if problem:
            return "error", problem
        was, now = _kind(None if old is _MISSING else old), _kind(value)
        if "null" not in (was, now) and was != now:
            return "warning", f'value kind "{now}" differs from "{was}"'
        return None
    arr = _peek(entry, steps)
    if arr in (_MISSING, None) and op in ("add_ref", "drop_ref"):
        arr = []
        if _put(entry, steps, arr):
            return "error", "path stops early"
    if not isinstance(arr, list):
        return "error", f'"{prop}" is not an array'
    if op == "reorder":
        if sorted(value) != list(range(len(arr))):
            return "error", f"reorder needs a permutation of 0..{len(arr) - 1}"
        arr[:] = [arr[i] for i in value]
    elif op == "remove":
        if not 0 <= value < len(arr):
            return "error", f"index {value} out of range"
        del arr[value]
    elif op == "drop_ref":
        arr[:] = [x for x in arr if not (isinstance(x, dict) and x.get("__id__") == value)]
    elif op in ("insert", "add_ref"):
        at, item = value["at"], value["value"]
        if at is None or (op == "add_ref" and not 0 <= at < len(arr)):
            at = len(arr)
        if not 0 <= at <= len(arr):
            return "error", f"index {at} out of range"
        mixed = op == "insert" and arr and _kind(arr[0]) != _kind(item)
        arr.insert(at, item)
        if mixed:
            return "warning", f"inserted a {_kind(item)} element into an array of {_kind(arr[0 if at else 1])}"
    else:
        return "error", f'unknown edit op "{op}"'
    return None


@F.pandas_udf(_RESULT)
def _apply_entry(text: pd.Series, steps: pd.Series) -> pd.DataFrame:
    out, notes = [], []
    for body, todo in zip(text, steps):
        if todo is None or not len(todo):
            out.append(body)
            notes.append([])
            continue
        entry, said = json.loads(body), []
        for s in todo:
            note = _one(entry, s["op"], s["prop"], json.loads(s["value"]), bool(s["force"]))
            if note:
                said.append({"seq": int(s["seq"]), "level": note[0], "note": note[1]})
        out.append(json.dumps(entry, ensure_ascii=False, separators=(",", ":")))
        notes.append(said)
    return pd.DataFrame({"json": out, "notes": notes})


@F.pandas_udf(T.StringType())
def read_property(text: pd.Series, prop: pd.Series) -> pd.Series:
    """JSON text of a nested property; NULL when absent."""

    def one(body, path):
        if body is None or path is None:
            return None
        v = _peek(json.loads(body), _steps(path))
        return None if v is _MISSING else json.dumps(v, ensure_ascii=False, separators=(",", ":"))

    return pd.Series([one(b, p) for b, p in zip(text, prop)])


def _steps_df(df: DataFrame, op, prop, value, seq=None, force=None) -> DataFrame:
    """Instructions (doc_id, idx, seq, op, prop, value, force); ``value`` is JSON text."""
    lit = lambda x: F.lit(x) if isinstance(x, (str, bool, int)) else x
    return df.select(
        "doc_id", "idx", (F.lit(0) if seq is None else lit(seq)).cast("int").alias("seq"), lit(op).alias("op"), lit(prop).alias("prop"),
        value.alias("value"), (F.lit(False) if force is None else lit(force)).alias("force"),
    )


def ref_json(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit('{"__id__":'), c.cast("string"), F.lit("}"))


def apply_updates(entries: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries', notes) for instructions (doc_id, idx, seq, op, prop, value[, force]).

    ``op``: set, reorder, remove, insert, add_ref, drop_ref; ``value`` is JSON text.  Only fields that
    exist are set unless ``force``.  Instructions for an entry that does not exist are errors.
    """
    entries = spread(entries)
    ups = updates if "force" in updates.columns else updates.withColumn("force", F.lit(False))
    ups = cut(ups.select("doc_id", "idx", F.col("seq").cast("int").alias("seq"), "op", "prop", "value", "force")).df
    # instructions per entry: bounded by what one entry is told to change
    per = ups.groupBy("doc_id", "idx").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "prop", "value", "force"))).alias("_todo"))
    touched = entries.join(per, ["doc_id", "idx"])
    done = cut(touched.select("doc_id", "idx", _apply_entry(F.to_json("entry"), F.col("_todo")).alias("r"))).df
    changed = with_type(done.select("doc_id", "idx", F.parse_json("r.json").alias("entry")))
    rest = entries.join(per.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti")
    notes = done.select("doc_id", "idx", F.explode("r.notes").alias("n")).select("doc_id", "idx", "n.seq", "n.level", "n.note")
    lost = ups.join(entries.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti").select(
        "doc_id", "idx", "seq", F.lit("error").alias("level"), F.lit("no such entry").alias("note")
    )
    return rest.select("doc_id", "idx", "type", "entry").unionByName(changed), notes.unionByName(lost)


def set_refs(entries: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Point existing reference fields at other entries: (doc_id, idx, seq, prop, target[, force]).

    The target must exist (semi join) and the field must hold a reference or null.
    """
    entries = spread(entries)
    ups = updates if "force" in updates.columns else updates.withColumn("force", F.lit(False))
    live = entries.select("doc_id", F.col("idx").alias("target"))
    good = ups.join(live, ["doc_id", "target"], "left_semi")
    lost = ups.join(live, ["doc_id", "target"], "left_anti").select(
        "doc_id", "idx", F.col("seq").cast("int").alias("seq"), F.lit("error").alias("level"), F.lit("no such target entry").alias("note")
    )
    now = entries.select("doc_id", "idx", F.to_json("entry").alias("_j"))
    held = cut(good.join(now, ["doc_id", "idx"]).withColumn("_v", read_property(F.col("_j"), F.col("prop"))).drop("_j")).df
    free = F.col("force") | F.col("_v").isNull() | (F.col("_v") == "null") | F.col("_v").rlike(r'^\{"__id__":-?\d+\}$')
    wrong = held.where(~free).select(
        "doc_id", "idx", F.col("seq").cast("int").alias("seq"), F.lit("error").alias("level"), F.lit("field holds a value, not a reference").alias("note")
    )
    out, notes = apply_updates(entries, _steps_df(held.where(free), "set", F.col("prop"), ref_json("target"), F.col("seq"), F.col("force")))
    return out, union_all([notes, lost, wrong])


# ---- delete and renumber ------------------------------------------------------------------------

_GONE = "\u0001"
_REF = r'\{"__id__":(-?\d+)\}'


def _key(idx: str = "idx") -> Column:
    return F.concat_ws("#", F.col("doc_id").cast("string"), F.col(idx).cast("string"))


def _unkey(df: DataFrame, entries: DataFrame) -> DataFrame:
    kind = entries.schema["doc_id"].dataType
    return df.select(
        F.regexp_replace("id", r"#\d+$", "").cast(kind).alias("doc_id"), F.regexp_extract("id", r"#(\d+)$", 1).cast("int").alias("idx")
    )


def subtree_entries(entries: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, root, idx): each seed node with descendants, components and their bookkeeping entries."""
    entries = spread(entries)
    nodes = entries.where(is_node_type()).select("doc_id", "idx", "type", "entry")
    down = lambda df, path: child_refs(df, path).where(F.col("target").isNotNull()).select("doc_id", "idx", "target")
    single = lambda df, path: df.select("doc_id", "idx", ref_at("entry", path).alias("target")).where(F.col("target").isNotNull())
    comps = down(nodes, "$._components")
    comp_rows = entries.where(~is_node_type() & F.col("idx").isNotNull()).join(comps.select("doc_id", F.col("target").alias("idx")), ["doc_id", "idx"], "left_semi")
    links = union_all([down(nodes, "$._children"), comps, single(nodes, "$._prefab"), single(comp_rows, "$.__prefab")])
    keyed = links.select(_key().alias("src"), _key("target").alias("dst"))
    start = seeds.select(_key().alias("root")).withColumn("node", F.col("root"))
    got = walk(keyed, start).select("root", F.col("node").alias("id"))
    root_idx = F.regexp_extract("root", r"#(\d+)$", 1).cast("int")
    kind = entries.schema["doc_id"].dataType
    return got.select(
        F.regexp_replace("id", r"#\d+$", "").cast(kind).alias("doc_id"), root_idx.alias("root"), F.regexp_extract("id", r"#(\d+)$", 1).cast("int").alias("idx")
    )


def subtree_has_instance(entries: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, root, has_instance) per seed."""
    inst = instance_roots(entries).select("doc_id", F.col("node").alias("idx"), F.lit(True).alias("_i"))
    sub = subtree_entries(entries, seeds).join(inst, ["doc_id", "idx"], "left")
    return sub.groupBy("doc_id", "root").agg(F.bool_or(F.col("_i").isNotNull()).alias("has_instance"))


def owned_closure(entries: DataFrame, seed: DataFrame) -> DataFrame:
    """(doc_id, idx): the seed and every entry only it keeps alive."""
    refs = id_refs(entries).where(F.col("owner") != F.col("target")).select(_key("owner").alias("src"), _key("target").alias("dst"))
    gone = cascade_orphans(refs, seed.select(_key().alias("id")))
    return _unkey(gone.select("id").distinct(), entries)


def compact(entries: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries', cleared): drop entries, renumber the rest of each document densely.

    References into the removed set leave their lists and become null in properties; every other
    reference follows its target to the new position.  Untouched documents pass through.
    """
    entries = spread(entries)
    hit = cut(removed.select("doc_id", "idx").distinct())
    docs = hit.df.select("doc_id").distinct()
    rest = entries.join(docs, "doc_id", "left_anti")
    affected = cut(entries.where(F.col("idx").isNotNull()).join(docs, "doc_id", "left_semi")).df
    keep = spread(affected.join(hit.hinted(), ["doc_id", "idx"], "left_anti"))
    moved = cut(positions_within(keep.select("doc_id", "idx"), ["doc_id"], ["idx"], "new_idx")).df.withColumn("new_idx", F.col("new_idx").cast("int"))
    fate = moved.unionByName(hit.df.select("doc_id", "idx", F.lit(-1).alias("new_idx"))).select("doc_id", F.col("idx").alias("target"), "new_idx")
    refs = id_refs(keep).select("doc_id", F.col("owner").alias("idx"), "target").distinct().join(fate, ["doc_id", "target"])
    per = refs.groupBy("doc_id", "idx").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("target").cast("string"), "new_idx"))).alias("_m")
    )

    def render(t):
        to = F.element_at(F.col("_m"), t)
        return (
            F.when(to.isNull(), F.concat(F.lit('{"__id__":'), t, F.lit("}")))
            .when(to < 0, F.lit(_GONE))
            .otherwise(F.concat(F.lit('{"__id__":'), to.cast("string"), F.lit("}")))
        )

    text = splice(F.to_json("entry"), _REF, render)
    rows = keep.join(per, ["doc_id", "idx"], "left").join(moved, ["doc_id", "idx"])
    rows = rows.withColumn("_t", F.when(F.col("_m").isNull(), F.to_json("entry")).otherwise(text))
    rows = rows.withColumn("_cleared", F.regexp_count("_t", F.lit(":" + _GONE)))
    tidy = F.regexp_replace("_t", ":" + _GONE, ":null")
    tidy = F.regexp_replace(tidy, f"(?:,{_GONE})+", "")
    tidy = F.regexp_replace(tidy, r"\[" + _GONE + ",?", "[")
    done = cut(rows.select("doc_id", F.col("new_idx").alias("idx"), F.parse_json(tidy).alias("entry"), "_cleared")).df
    cleared = done.groupBy("doc_id").agg(F.sum("_cleared").alias("cleared"))
    out = with_type(done.select("doc_id", "idx", "entry"))
    return rest.select("doc_id", "idx", "type", "entry").unionByName(out), cleared


def delete_entries(entries: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries', report, errors) for a table of nodes and components to delete (doc_id, idx).

    Roots, scenes, bookkeeping entries and subtrees holding a nested instance are refused.
    """
    rows = entry_table(entries.where(F.col("idx").isNotNull()))
    facts = rows.select(
        "doc_id", "idx", "type", is_node_type().alias("is_node"), ref_at("entry", "$._parent").alias("parent"), ref_at("entry", "$.node").alias("owner"),
        ref_at("entry", "$.__prefab").alias("comp_info"),
    )
    want = cut(seeds.select("doc_id", "idx").distinct()).df.join(facts, ["doc_id", "idx"], "left")
    inst = subtree_has_instance(rows, want.where("is_node").select("doc_id", "idx")).where("has_instance").select("doc_id", F.col("root").alias("idx"), F.lit(True).alias("_inst"))
    want = want.join(inst, ["doc_id", "idx"], "left")
    err = (
        F.when(F.col("is_node").isNull(), F.lit("no such entry"))
        .when(F.col("type") == SCENE_TYPE, F.lit("cannot remove the scene root"))
        .when(F.col("is_node") & F.col("parent").isNull(), F.lit("cannot remove the root node"))
        .when(F.col("_inst"), F.lit("subtree contains a nested instance"))
        .when(~F.col("is_node") & (F.coalesce("type", F.lit("")) == DOC_TYPE), F.lit("not a component"))
        .when(~F.col("is_node") & F.col("owner").isNull(), F.lit("not a component"))
    )
    judged = cut(want.withColumn("error", err)).df
    good = judged.where(F.col("error").isNull())
    trees = subtree_entries(rows, good.where("is_node").select("doc_id", "idx")).select("doc_id", "idx")
    comps = good.where(~F.col("is_node"))
    own = comps.select("doc_id", "idx").unionByName(comps.where(F.col("comp_info").isNotNull()).select("doc_id", F.col("comp_info").alias("idx")))
    gone = cut(owned_closure(rows, trees.unionByName(own).distinct())).df
    out, cleared = compact(rows.unionByName(entries.where(F.col("idx").isNull()).select(*rows.columns)), gone)
    report = gone.groupBy("doc_id").agg(F.count(F.lit(1)).alias("removed")).join(cleared, "doc_id", "left").select(
        "doc_id", "removed", F.coalesce("cleared", F.lit(0)).cast("long").alias("cleared")
    )
    return out, report, judged.where(F.col("error").isNotNull()).select("doc_id", "idx", "error")


def collect_unreferenced(entries: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete those candidates (doc_id, idx) nothing refers to any more, with what they own."""
    held = id_refs(entries).select("doc_id", F.col("target").alias("idx"))
    seed = candidates.select("doc_id", "idx").distinct().join(held, ["doc_id", "idx"], "left_anti")
    return compact(entries, owned_closure(entries, seed))


def array_edit(entries: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries', notes) for array instructions reorder / remove / insert / insert_clone / insert_type.

    The structural lists are refused.  A removed reference whose target nothing else holds takes the
    target and what it owns with it.  ``insert_clone`` (value {"at"}) and ``insert_type`` (value {"at", "type"}) append an owned
    object and insert the reference to it, after the other instructions of the call (see ``insert_objects``).
    """
    last = F.substring_index("prop", ".", -1)
    bad = ops.where(last.isin("_children", "_components")).select(
        "doc_id", "idx", F.col("seq").cast("int").alias("seq"), F.lit("error").alias("level"), F.lit("structural list: use the node and component edits").alias("note")
    )
    fine = ops.where(~last.isin("_children", "_components"))
    objects = cut(fine.where(F.col("op").isin("insert_clone", "insert_type")))
    fine = fine.where(~F.col("op").isin("insert_clone", "insert_type"))
    if not objects.empty:
        v = F.parse_json("value")
        made = objects.df.select("doc_id", "idx", "seq", "prop", F.try_variant_get(v, "$.at", "int").alias("at"), F.when(F.col("op") == "insert_type", F.try_variant_get(v, "$.type", "string")).alias("type"))
        out, notes = array_edit(entries, fine)
        grown, more = insert_objects(out, made)
        return grown, union_all([notes, more, bad])
    before = id_refs(entries.join(fine.where(F.col("op") == "remove").select("doc_id", "idx").distinct(), ["doc_id", "idx"], "left_semi"))
    was = cut(before.select("doc_id", F.col("target").alias("idx")).distinct()).df
    out, notes = apply_updates(entries, fine)
    out = cut(out).df
    swept, _ = collect_unreferenced(out, was)
    return swept, notes.unionByName(bad)


def insert_objects(entries: DataFrame, adds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries', notes): append an owned object and insert the reference to it (doc_id, idx, seq, prop, at, type).

    With ``type`` the object is a bare one of that type; without, it is a copy of the entry that the array's first reference
    leads to, with its own ids reset and its other references as they are.  ``at`` counts in the array as it is when the
    instruction's turn comes (null: the end).  An instruction in error appends nothing.
    """
    ops = cut(adds.select("doc_id", "idx", F.col("seq").cast("int").alias("seq"), "prop", F.col("at").cast("int").alias("at"), "type")).df
    now = entries.select("doc_id", "idx", F.to_json("entry").alias("_j"))
    held = ops.join(now, ["doc_id", "idx"], "left").withColumn("_v", read_property(F.col("_j"), F.col("prop")))
    items = F.try_variant_get(F.parse_json("_v"), "$", "array<variant>")
    refs = F.filter(F.transform(items, lambda e: F.try_variant_get(e, "$.__id__", "int")), lambda e: e.isNotNull())
    # instructions on one array: bounded by what one entry is told to change
    turn = F.row_number().over(Window.partitionBy("doc_id", "idx", "prop").orderBy("seq")) - 1
    held = held.withColumn("_n", F.size(items)).withColumn("_first", F.get(refs, F.lit(0))).withColumn("_room", F.col("_n") + turn)
    live = entries.select("doc_id", F.col("idx").alias("_first"), F.to_json("entry").alias("_template"))
    held = held.drop("_j", "_v").join(live, ["doc_id", "_first"], "left")
    clone = F.col("type").isNull()
    err = (
        F.when(F.col("_n").isNull() | (F.col("_n") < 0), F.concat(F.lit('"'), "prop", F.lit('" is not an array')))
        .when((F.col("at") < 0) | (F.col("at") > F.col("_room")), F.concat(F.lit("index "), F.col("at").cast("string"), F.lit(" out of range")))
        .when(clone & F.col("_first").isNull(), F.lit("no element of the array to clone"))
        .when(clone & F.col("_template").isNull(), F.concat(F.lit("template entry "), F.col("_first").cast("string"), F.lit(" is missing")))
    )
    judged = cut(held.withColumn("error", err)).df
    ok = judged.where(F.col("error").isNull())
    body = F.when(clone, F.col("_template")).otherwise(F.to_json(F.struct(F.col("type").alias("__type__"))))
    new = positions_within(ok.withColumn("_body", body), ["doc_id"], ["seq", "idx", "prop"], "_rank").join(_doc_sizes(entries), "doc_id")
    new = cut(new.select("doc_id", F.col("idx").alias("_holder"), "seq", "prop", "at", (F.col("_len") + F.col("_rank")).cast("int").alias("idx"), clone.alias("_clone"), F.parse_json("_body").alias("entry"))).df
    has = lambda path, kind="variant": F.col("_clone") & F.try_variant_get("entry", path, kind).isNotNull()
    put = lambda prop, value, when: _steps_df(new.where(when), "set", prop, value, 0, True)
    steps = union_all([
        put("_id", F.concat(F.lit('"'), _pad22("a", F.col("idx")), F.lit('"')), has("$._id")),
        put("fileId", F.concat(F.lit('"'), _pad22("f", F.col("idx")), F.lit('"')), has("$.fileId")),
        put("__prefab", F.lit("null"), has("$.__prefab.__id__", "int")),
    ])
    made, _ = apply_updates(with_type(new.select("doc_id", "idx", "entry")), steps)
    at = F.coalesce(F.col("at").cast("string"), F.lit("null"))
    link = new.select("doc_id", F.col("_holder").alias("idx"), "seq", "prop", F.concat(F.lit('{"at":'), at, F.lit(',"value":'), ref_json("idx"), F.lit("}")).alias("_v"))
    old, notes = apply_updates(entries, _steps_df(link, "insert", F.col("prop"), F.col("_v"), F.col("seq")))
    cols = ["doc_id", "idx", "type", "entry"]
    bad = judged.where(F.col("error").isNotNull()).select("doc_id", "idx", "seq", F.lit("error").alias("level"), F.col("error").alias("note"))
    return old.select(*cols).unionByName(made.select(*cols)), notes.unionByName(bad)


# ---- moves and additions --------------------------------------------------------------------------


def set_parent(entries: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries', errors) for moves (doc_id, idx, new_parent, pos); root, self and cycle are refused."""
    facts = entries.where(F.col("idx").isNotNull()).select("doc_id", "idx", is_node_type().alias("_n"), ref_at("entry", "$._parent").alias("_p"))
    m = moves.join(facts, ["doc_id", "idx"], "left").join(
        facts.select("doc_id", F.col("idx").alias("new_parent"), F.col("_n").alias("_pn")), ["doc_id", "new_parent"], "left"
    )
    pairs = m.select(_key("idx").alias("ancestor"), _key("new_parent").alias("candidate")).distinct()
    ups = facts.where(F.col("_p").isNotNull()).select(_key().alias("child"), _key("_p").alias("parent"))
    loops = is_descendant(pairs, ups).where("descendant").select(F.col("ancestor").alias("_a"), F.col("candidate").alias("_c"), F.lit(True).alias("_loop"))
    m = m.withColumn("_a", _key("idx")).withColumn("_c", _key("new_parent")).join(loops, ["_a", "_c"], "left")
    err = (
        F.when(~F.coalesce("_n", F.lit(False)), F.lit("not a node"))
        .when(~F.coalesce("_pn", F.lit(False)), F.lit("parent is not a node"))
        .when(F.col("idx") == F.col("new_parent"), F.lit("cannot move a node into itself"))
        .when(F.col("_loop"), F.lit("cannot move a node into its own descendant"))
        .when(F.col("_p").isNull(), F.lit("cannot move the root node"))
    )
    judged = cut(m.withColumn("error", err).select("doc_id", "idx", "new_parent", "pos", F.col("_p").alias("old_parent"), "error")).df
    ok = judged.where(F.col("error").isNull())
    at = F.when(F.coalesce("pos", F.lit(-1)) >= 0, F.col("pos").cast("string")).otherwise(F.lit("null"))
    child = F.col("idx")
    steps = union_all([
        _steps_df(ok, "set", "_parent", ref_json("new_parent"), 0, True),
        _steps_df(ok.select("doc_id", F.col("old_parent").alias("idx"), child.alias("_c")), "drop_ref", "_children", F.col("_c").cast("string"), 1),
        _steps_df(
            ok.select("doc_id", F.col("new_parent").alias("idx"), F.concat(F.lit('{"at":'), at, F.lit(',"value":'), ref_json(child), F.lit("}")).alias("_v")),
            "add_ref", "_children", F.col("_v"), 2,
        ),
    ])
    out, _ = apply_updates(entries, steps)
    return out, judged.where(F.col("error").isNotNull()).select("doc_id", "idx", "error")


def _doc_sizes(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("idx").isNotNull()).groupBy("doc_id").agg((F.max("idx") + 1).alias("_len"))


def _templates(entries: DataFrame) -> DataFrame:
    """(doc_id, type, template): the first entry of each type in each document."""
    rows = entries.where(F.col("idx").isNotNull() & F.col("type").isNotNull())
    first = rows.groupBy("doc_id", "type").agg(F.min("idx").alias("idx"))
    return rows.join(first, ["doc_id", "type", "idx"]).select("doc_id", "type", F.to_json("entry").alias("template"))


def _pad22(prefix: str, n: Column) -> Column:
    return F.rpad(F.concat(F.lit(prefix), n.cast("string")), 22, "x")


def add_nodes(entries: DataFrame, adds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries', errors): append empty nodes (doc_id, seq, parent, name, pos) cloned from the first node.

    In a document of the prefab kind each new node gets its own bookkeeping entry.
    """
    facts = entries.where(is_node_type()).select("doc_id", F.col("idx").alias("parent"), F.lit(True).alias("_ok"))
    tmpl = _templates(entries)
    node_t = tmpl.where(F.col("type") == "cc.Node").select("doc_id", F.col("template").alias("_nt"))
    info_t = tmpl.where(F.col("type") == INFO_TYPE).select("doc_id", F.col("template").alias("_it"))
    kind = entries.where((F.col("idx") == 0) & (F.col("type") == DOC_TYPE)).select(
        "doc_id", F.coalesce(ref_at("entry", "$.data"), F.lit(1)).alias("_root")
    )
    a = adds.join(facts, ["doc_id", "parent"], "left").join(node_t, "doc_id", "left")
    err = F.when(F.col("_ok").isNull(), F.lit("not a node")).when(F.col("_nt").isNull(), F.lit("no existing node to use as a template"))
    judged = cut(a.withColumn("error", err)).df
    ok = judged.where(F.col("error").isNull()).drop("error", "_ok")
    ranked = positions_within(ok, ["doc_id"], ["seq"], "_rank").join(_doc_sizes(entries), "doc_id").join(kind, "doc_id", "left").join(info_t, "doc_id", "left")
    width = F.when(F.col("_root").isNotNull(), F.lit(2)).otherwise(F.lit(1))
    new = cut(ranked.withColumn("idx", (F.col("_len") + F.col("_rank") * width).cast("int"))).df
    q = lambda c: F.to_json(F.struct(c.alias("v")))
    quoted = F.regexp_extract(q(F.col("name")), r'^\{"v":(.*)\}$', 1)
    has = lambda k: F.col("_nt").contains(f'"{k}":')
    base_rows = new.select("doc_id", "idx", F.parse_json("_nt").alias("entry"))
    put = lambda prop, value, when=None: _steps_df(new if when is None else new.where(when), "set", prop, value, 0, True)
    zero = F.lit('{"__type__":"cc.Vec3","x":0,"y":0,"z":0}')
    steps = [
        put("_name", quoted), put("_parent", ref_json("parent")), put("_children", F.lit("[]")), put("_components", F.lit("[]")),
        put("_prefab", F.when(F.col("_root").isNotNull(), ref_json(F.col("idx") + 1)).otherwise(F.lit("null"))),
        put("_id", F.concat(F.lit('"'), _pad22("n", F.col("idx")), F.lit('"')), has("_id")),
        put("_lpos", zero, has("_lpos")), put("_euler", zero, has("_euler")),
        put("_lscale", F.lit('{"__type__":"cc.Vec3","x":1,"y":1,"z":1}'), has("_lscale")),
        put("_lrot", F.lit('{"__type__":"cc.Quat","x":0,"y":0,"z":0,"w":1}'), has("_lrot")),
        put("_active", F.lit("true"), has("_active")),
    ]
    made, _ = apply_updates(with_type(base_rows), union_all(steps))
    pre = new.where(F.col("_root").isNotNull())
    info_rows = pre.select("doc_id", (F.col("idx") + 1).alias("idx"), F.parse_json(F.coalesce("_it", F.lit(f'{{"__type__":"{INFO_TYPE}","fileId":""}}'))).alias("entry"), "_it", "_root")
    hasi = lambda k: F.coalesce(F.col("_it").contains(f'"{k}":'), F.lit(k == "fileId"))
    puti = lambda prop, value: _steps_df(info_rows.where(hasi(prop)), "set", prop, value, 0, True)
    info_steps = [
        puti("fileId", F.concat(F.lit('"'), _pad22("f", F.col("idx") - 1), F.lit('"'))), puti("root", ref_json("_root")), puti("asset", F.lit('{"__id__":0}')),
        puti("instance", F.lit("null")), puti("targetOverrides", F.lit("null")), puti("nestedPrefabInstanceRoots", F.lit("null")),
    ]
    infos, _ = apply_updates(with_type(info_rows.select("doc_id", "idx", "entry")), union_all(info_steps))
    at = F.when(F.coalesce("pos", F.lit(-1)) >= 0, F.col("pos").cast("string")).otherwise(F.lit("null"))
    link = _steps_df(
        new.select("doc_id", F.col("parent").alias("idx"), F.col("seq"), F.concat(F.lit('{"at":'), at, F.lit(',"value":'), ref_json("idx"), F.lit("}")).alias("_v")),
        "add_ref", "_children", F.col("_v"), F.col("seq"),
    )
    old, _ = apply_updates(entries, link)
    cols = ["doc_id", "idx", "type", "entry"]
    return old.select(*cols).unionByName(made.select(*cols)).unionByName(infos.select(*cols)), judged.where(F.col("error").isNotNull()).select("doc_id", "seq", "error")


def add_components(entries: DataFrame, adds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries', errors): append minimal components (doc_id, seq, node, type) to nodes."""
    facts = entries.where(is_node_type()).select("doc_id", F.col("idx").alias("node"), F.lit(True).alias("_ok"))
    kind = entries.where((F.col("idx") == 0) & (F.col("type") == DOC_TYPE)).select("doc_id", F.lit(True).alias("_pre"))
    judged = cut(adds.join(facts, ["doc_id", "node"], "left").withColumn("error", F.when(F.col("_ok").isNull(), F.lit("not a node")))).df
    ok = judged.where(F.col("error").isNull()).drop("error", "_ok")
    ranked = positions_within(ok, ["doc_id"], ["seq"], "_rank").join(_doc_sizes(entries), "doc_id").join(kind, "doc_id", "left")
    width = F.when(F.col("_pre"), F.lit(2)).otherwise(F.lit(1))
    new = cut(ranked.withColumn("idx", (F.col("_len") + F.col("_rank") * width).cast("int"))).df
    info = F.when(F.col("_pre"), ref_json(F.col("idx") + 1)).otherwise(F.lit("null"))
    body = F.concat(
        F.lit('{"__type__":"'), F.col("type"), F.lit('","_name":"","_objFlags":0,"node":'), ref_json("node"), F.lit(',"_enabled":true,"__prefab":'), info,
        F.lit(',"_id":"'), _pad22("c", F.col("idx")), F.lit('"}'),
    )
    comps = with_type(new.select("doc_id", "idx", F.parse_json(body).alias("entry")))
    info_body = F.concat(F.lit(f'{{"__type__":"{COMP_INFO_TYPE}","fileId":"'), _pad22("f", F.col("idx")), F.lit('"}'))
    infos = with_type(new.where("_pre").select("doc_id", (F.col("idx") + 1).alias("idx"), F.parse_json(info_body).alias("entry")))
    link = _steps_df(
        new.select("doc_id", F.col("node").alias("idx"), "seq", F.concat(F.lit('{"at":null,"value":'), ref_json("idx"), F.lit("}")).alias("_v")),
        "add_ref", "_components", F.col("_v"), F.col("seq"),
    )
    old, _ = apply_updates(entries, link)
    cols = ["doc_id", "idx", "type", "entry"]
    return old.select(*cols).unionByName(comps.select(*cols)).unionByName(infos.select(*cols)), judged.where(F.col("error").isNotNull()).select("doc_id", "seq", "error")


# ---- instance overrides ----------------------------------------------------------------------------


def upsert_overrides(entries: DataFrame, wants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries', errors): set root-level overrides (doc_id, seq, node, prop, value) of nested instances.

    An override of the same property is updated in place; otherwise a target and an override entry are
    appended and linked.  The baked value on the node follows.
    """
    rows = entry_table(entries.where(F.col("idx").isNotNull()))
    roots = instance_roots(rows).select("doc_id", "node", "inst", "file_id")
    judged = cut(wants.join(roots, ["doc_id", "node"], "left").withColumn("error", F.when(F.col("inst").isNull(), F.lit("not a nested-instance root")))).df
    ok = judged.where(F.col("error").isNull()).drop("error")
    inst = rows.where(F.col("type") == INSTANCE_TYPE)
    held = child_refs(inst, "$.propertyOverrides").select("doc_id", F.col("idx").alias("inst"), F.col("target").alias("ov"))
    ov = rows.where(F.col("type") == OVERRIDE_TYPE).select(
        "doc_id", F.col("idx").alias("ov"), ref_at("entry", "$.targetInfo").alias("ti"),
        F.array_join(F.coalesce(F.try_variant_get("entry", "$.propertyPath", "array<string>"), F.array().cast("array<string>")), ".").alias("prop"),
    )
    ti = rows.select("doc_id", F.col("idx").alias("ti"), F.try_variant_get("entry", "$.localID", "array<string>").alias("lid"))
    have = held.join(ov, ["doc_id", "ov"]).join(ti, ["doc_id", "ti"]).where(F.size("lid") == 1)
    have = have.select("doc_id", "inst", "prop", F.get("lid", F.lit(0)).alias("file_id"), "ov").groupBy("doc_id", "inst", "prop", "file_id").agg(F.min("ov").alias("ov"))
    plan = cut(ok.join(have, ["doc_id", "inst", "prop", "file_id"], "left")).df
    update = _steps_df(plan.where(F.col("ov").isNotNull()).select("doc_id", F.col("ov").alias("idx"), "seq", "value"), "set", "value", F.col("value"), F.col("seq"), True)
    fresh = cut(
        positions_within(plan.where(F.col("ov").isNull()).drop("ov"), ["doc_id"], ["seq"], "_rank").join(_doc_sizes(rows), "doc_id")
        .withColumn("idx", (F.col("_len") + F.col("_rank") * 2).cast("int"))
    ).df
    path_json = F.to_json(F.split("prop", r"\."))
    target = F.concat(F.lit(f'{{"__type__":"{TARGET_TYPE}","localID":["'), F.col("file_id"), F.lit('"]}'))
    over = F.concat(
        F.lit(f'{{"__type__":"{OVERRIDE_TYPE}","targetInfo":'), ref_json("idx"), F.lit(',"propertyPath":'), path_json, F.lit(',"value":'), F.col("value"), F.lit("}")
    )
    new = with_type(fresh.select("doc_id", "idx", F.parse_json(target).alias("entry"))).unionByName(
        with_type(fresh.select("doc_id", (F.col("idx") + 1).alias("idx"), F.parse_json(over).alias("entry")))
    )
    link = _steps_df(
        fresh.select("doc_id", F.col("inst").alias("idx"), "seq", F.concat(F.lit('{"at":null,"value":'), ref_json(F.col("idx") + 1), F.lit("}")).alias("_v")),
        "add_ref", "propertyOverrides", F.col("_v"), F.col("seq"),
    )
    baked = _steps_df(plan.select("doc_id", F.col("node").alias("idx"), "seq", "prop", "value"), "set", F.col("prop"), F.col("value"), F.col("seq"), True)
    out, _ = apply_updates(entries, union_all([update, link, baked]))
    return out.unionByName(new.select("doc_id", "idx", "type", "entry")), judged.where(F.col("error").isNotNull()).select("doc_id", "seq", "error")


def add_cross_refs(entries: DataFrame, wants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries', errors): wire (doc_id, seq, source, prop) to a node inside a nested instance.

    ``wants`` carries instance (index of the instance root), target_id (its file id in the source
    document) and inline (its index here, or NULL).  An existing record of the same source and
    property is redirected; otherwise target and record entries are appended on the outer root.
    """
    from refloom.operators.validate import cross_references

    rows = entry_table(entries.where(F.col("idx").isNotNull()))
    outer = rows.where(F.col("idx") == 0).select("doc_id", F.coalesce(ref_at("entry", "$.data"), F.lit(1)).alias("idx"))
    outer = rows.join(outer, ["doc_id", "idx"]).select("doc_id", ref_at("entry", "$._prefab").alias("outer_info"))
    infos = rows.where(F.col("type") == INFO_TYPE).select("doc_id", F.col("idx").alias("outer_info"))
    outer = outer.join(infos, ["doc_id", "outer_info"], "left_semi")
    judged = cut(wants.join(outer, "doc_id", "left").withColumn("error", F.when(F.col("outer_info").isNull(), F.lit("outer root has no bookkeeping entry")))).df
    ok = judged.where(F.col("error").isNull()).drop("error")
    have = cross_references(rows).select("doc_id", F.col("info").alias("outer_info"), "source", "prop", "xref")
    have = have.join(rows.select("doc_id", F.col("idx").alias("xref"), ref_at("entry", "$.targetInfo").alias("old_ti")), ["doc_id", "xref"])
    plan = cut(ok.join(have, ["doc_id", "outer_info", "source", "prop"], "left")).df
    fresh = cut(
        positions_within(plan.where(F.col("xref").isNull()), ["doc_id"], ["seq"], "_rank").join(_doc_sizes(rows), "doc_id")
        .withColumn("idx", (F.col("_len") + F.col("_rank") * 2).cast("int"))
    ).df
    old = plan.where(F.col("xref").isNotNull())
    target = F.concat(F.lit(f'{{"__type__":"{TARGET_TYPE}","localID":["'), F.col("target_id"), F.lit('"]}'))
    record = F.concat(
        F.lit(f'{{"__type__":"{CROSS_REF_TYPE}","source":'), ref_json("source"), F.lit(',"sourceInfo":null,"propertyPath":'), F.to_json(F.split("prop", r"\.")),
        F.lit(',"target":'), ref_json("instance"), F.lit(',"targetInfo":'), ref_json("idx"), F.lit("}"),
    )
    new = with_type(fresh.select("doc_id", "idx", F.parse_json(target).alias("entry"))).unionByName(
        with_type(fresh.select("doc_id", (F.col("idx") + 1).alias("idx"), F.parse_json(record).alias("entry")))
    )
    inline = F.when(F.col("inline").isNotNull(), ref_json("inline")).otherwise(F.lit("null"))
    steps = union_all([
        _steps_df(old.select("doc_id", F.col("xref").alias("idx"), "seq", "instance"), "set", "target", ref_json("instance"), F.col("seq"), True),
        _steps_df(
            old.where(F.col("old_ti").isNotNull()).select("doc_id", F.col("old_ti").alias("idx"), "seq", F.to_json(F.array("target_id")).alias("_v")),
            "set", "localID", F.col("_v"), F.col("seq"), True,
        ),
        _steps_df(
            fresh.select("doc_id", F.col("outer_info").alias("idx"), "seq", F.concat(F.lit('{"at":null,"value":'), ref_json(F.col("idx") + 1), F.lit("}")).alias("_v")),
            "add_ref", "targetOverrides", F.col("_v"), F.col("seq"),
        ),
        _steps_df(plan.select("doc_id", F.col("source").alias("idx"), "seq", "prop", inline.alias("_v")), "set", F.col("prop"), F.col("_v"), F.col("seq"), True),
    ])
    out, _ = apply_updates(entries, steps)
    return out.unionByName(new.select("doc_id", "idx", "type", "entry")), judged.where(F.col("error").isNotNull()).select("doc_id", "seq", "error")


# ---- versions and batches ---------------------------------------------------------------------------


def require_version(ops: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ops', refused): instructions whose (doc_id, expected_version) still is the document's version."""
    now = docs.select("doc_id", F.col("version").alias("expected_version"))
    return ops.join(now, ["doc_id", "expected_version"], "left_semi"), ops.join(now, ["doc_id", "expected_version"], "left_anti")


def diff_versions(old: DataFrame, new: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys..., change, old_value, new_value) for rows added, removed or changed."""
    o, n = old.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("_o")), new.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("_n"))
    change = F.when(F.col("_o").isNull(), F.lit("added")).when(F.col("_n").isNull(), F.lit("removed")).otherwise(F.lit("changed"))
    both = o.join(n, keys, "full_outer")
    return both.where(F.col("_o").isNull() | F.col("_n").isNull() | ~F.col("old_value").eqNullSafe(F.col("new_value"))).select(
        *keys, change.alias("change"), "old_value", "new_value"
    )


def entry_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    text = lambda df: df.select("doc_id", "idx", F.to_json("entry").alias("value"))
    return diff_versions(text(old), text(new), ["doc_id", "idx"])


# Kinds that change one entry and move no other: neighbouring steps of a document run in one round, in their order.
IN_PLACE = ("insert", "reorder", "set")


def schedule(ops: DataFrame) -> DataFrame:
    """``ops`` with ``level``: the round of its document in which a step runs, from 1.

    A document's steps are ranked by ``seq``.  A step opens a new round unless it and the one before it only change entries
    in place.  Rounds of different documents have nothing to do with each other, whatever their ``seq``.
    """
    steps = ops.groupBy("doc_id", "seq").agg(F.bool_and(F.col("kind").isin(*IN_PLACE)).alias("_easy"))
    ranked = cut(positions_within(steps, ["doc_id"], ["seq"], "_rank")).df
    before = ranked.select("doc_id", (F.col("_rank") + 1).alias("_rank"), F.col("_easy").alias("_before"))
    opens = ranked.join(before, ["doc_id", "_rank"], "left").withColumn("_opens", (~(F.col("_easy") & F.coalesce("_before", F.lit(False)))).cast("int"))
    opens = cut(opens).df
    most = opens.agg(F.max("_rank").alias("n")).first()["n"] or 0
    levels = running_sum(opens, ["doc_id"], "_rank", "_opens", most, "level").select("doc_id", "seq", F.col("level").cast("int").alias("level"))
    return ops.join(levels, ["doc_id", "seq"])


def _structural(rows: DataFrame) -> Column:
    return F.substring_index("prop", ".", -1).isin("_children", "_components") & (F.col("kind") != "set")


def _round(entries: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries', errors) of one round over the documents it touches."""
    said = lambda df: df.select("doc_id", F.col("seq").cast("int").alias("seq"), F.col("error").alias("error"))
    noted = lambda df: df.where("level = 'error'").select("doc_id", F.col("seq").cast("int").alias("seq"), F.col("note").alias("error"))
    # the round has one step of each document, or several that change entries in place
    of_step = lambda bad: bad.join(rows.groupBy("doc_id").agg(F.min("seq").alias("seq")), "doc_id").select("doc_id", "seq", "error")
    kinds = sorted(r["kind"] for r in rows.select("kind").distinct().collect())  # a handful of op names
    cur, errors = entries, []
    easy = [k for k in kinds if k in IN_PLACE]
    for kind in [*(["in place"] if easy else []), *(k for k in kinds if k not in IN_PLACE)]:
        part = rows.where(F.col("kind").isin(*easy)) if kind == "in place" else rows.where(F.col("kind") == kind)
        docs = part.select("doc_id").distinct()
        own, rest = cur.join(docs, "doc_id", "left_semi"), cur.join(docs, "doc_id", "left_anti")
        if kind == "in place":
            refused = part.where(_structural(part)).select("doc_id", "seq", F.lit("structural list: use the node and component edits").alias("error"))
            own, notes = apply_updates(own, part.where(~_structural(part)).select("doc_id", "idx", "seq", F.col("kind").alias("op"), "prop", "value"))
            errors += [said(refused), noted(notes)]
        elif kind in ("remove", "insert_clone", "insert_type"):
            own, notes = array_edit(own, part.select("doc_id", "idx", "seq", F.lit(kind).alias("op"), "prop", "value"))
            errors.append(noted(notes))
        elif kind == "set_ref":
            own, notes = set_refs(own, part.select("doc_id", "idx", "seq", "prop", "target"))
            errors.append(noted(notes))
        elif kind == "set_parent":
            own, bad = set_parent(own, part.select("doc_id", "idx", F.col("target").alias("new_parent"), "pos"))
            errors.append(of_step(bad))
        elif kind == "delete":
            own, _, bad = delete_entries(own, part.select("doc_id", "idx"))
            errors.append(of_step(bad))
        elif kind == "add_component":
            own, bad = add_components(own, part.select("doc_id", "seq", F.col("idx").alias("node"), F.col("value").alias("type")))
            errors.append(said(bad))
        elif kind == "add_node":
            own, bad = add_nodes(own, part.select("doc_id", "seq", F.col("idx").alias("parent"), F.col("value").alias("name"), "pos"))
            errors.append(said(bad))
        elif kind == "override":
            own, bad = upsert_overrides(own, part.select("doc_id", "seq", F.col("idx").alias("node"), "prop", "value"))
            errors.append(said(bad))
        elif kind == "cross_ref":
            wants = part.select("doc_id", "seq", F.col("idx").alias("source"), "prop", F.col("target").alias("instance"), F.col("value").alias("target_id"), F.col("pos").alias("inline"))
            own, bad = add_cross_refs(own, wants)
            errors.append(said(bad))
        else:
            errors.append(part.select("doc_id", "seq", F.lit(f'unknown edit op "{kind}"').alias("error")))
        cur = entry_table(own.select("doc_id", "idx", "type", "entry").unionByName(rest.select("doc_id", "idx", "type", "entry")))
    return cur, union_all(errors)


def apply_batch(entries: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries', errors): ordered instructions, all or nothing per document.

    ``ops`` is (doc_id, seq, kind, idx, prop, value, target, pos) with kind one of set, reorder, remove, insert, insert_clone,
    insert_type, set_ref, set_parent, delete, add_component (value: type), add_node (idx: parent, value: name), override (idx: instance root) and
    cross_ref (idx: source, target: instance root, value: file id, pos: index here or null).  There are as many rounds as the
    longest batch of one document has after fusing; a round reads only the documents that have a step in it.  A document leaves
    with its last step, or with its first error, and then keeps its original entries.
    """
    cols = ["doc_id", "idx", "type", "entry"]
    plan = cut(schedule(cut(ops.withColumn("seq", F.col("seq").cast("int"))).df)).df
    ends = cut(plan.groupBy("doc_id").agg(F.max("level").alias("_end"))).df
    rounds = ends.agg(F.max("_end").alias("n")).first()["n"] or 0
    cur = entry_table(entries.select(*cols).join(ends.select("doc_id"), "doc_id", "left_semi"))
    done, failed = [], []
    for level in range(1, rounds + 1):
        rows = cut(plan.where(F.col("level") == level).join(cur.select("doc_id").distinct(), "doc_id", "left_semi")).df if failed else cut(plan.where(F.col("level") == level)).df
        cur, errors = _round(cur, rows)
        errors = cut(errors)
        left = cur.join(ends, "doc_id")
        if not errors.empty:
            failed.append(errors.df)
            left = left.join(errors.df.select("doc_id").distinct(), "doc_id", "left_anti")
        left = cut(left).df
        done.append(left.where(F.col("_end") == level).select(*cols))
        cur = left.where(F.col("_end") > level).select(*cols)
    errors = union_all(failed) if failed else plan.select("doc_id", "seq", F.lit("").alias("error")).where(F.lit(False))
    kept = ends.join(errors.select("doc_id").distinct(), "doc_id", "left_anti")
    whole = entries.select(*cols).join(kept.select("doc_id"), "doc_id", "left_anti")
    return union_all([whole, *done]), errors


def documents_text(entries: DataFrame) -> DataFrame:
    """(doc_id, text): list documents written back as JSON, one text per document."""
    rows = entries.where(F.col("idx").isNotNull()).select("doc_id", "idx", F.to_json("entry").alias("j"))
    return rows.groupBy("doc_id").agg(
        F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "j"))), lambda s: s["j"]), ","), F.lit("]")).alias("text")
    )
