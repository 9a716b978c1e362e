from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from refloom.operators import documents as dc
from refloom.operators import edit as ed
from refloom.operators import selectors as sl
from refloom.operators import validate as va

R = lambda n: {"__id__": n}


def doc():
    return [
        {"__type__": "cc.Prefab", "data": R(1)},
        {"__type__": "cc.Node", "_name": "Root", "_parent": None, "_children": [R(2), R(4), R(7)], "_components": [R(6)], "_prefab": R(9), "_active": True},
        {"__type__": "cc.Node", "_name": "Item", "_parent": R(1), "_children": [], "_components": [R(3)], "_prefab": None},
        {"__type__": "cc.Button", "node": R(2), "events": [R(5)], "list": [3, 1, 2]},
        {"__type__": "cc.Node", "_name": "Item", "_parent": R(1), "_children": [], "_components": [], "_prefab": None},
        {"__type__": "cc.ClickEvent", "target": R(4), "handler": "go"},
        {"__type__": "cc.Layout", "node": R(1), "ref": R(2), "refs": [R(2), R(4)], "num": 1},
        {"__type__": "cc.Node", "_name": "Last", "_parent": R(1), "_children": [R(8)], "_components": [], "_prefab": None},
        {"__type__": "cc.Node", "_name": "Deep", "_parent": R(7), "_children": [], "_components": [], "_prefab": None},
        {"__type__": "cc.PrefabInfo", "fileId": "root", "root": R(1), "asset": R(0), "instance": None},
    ]


@pytest.fixture
def entries(spark):
    def build(**docs):
        rows = [(k, json.dumps(v)) for k, v in docs.items()]
        return dc.doc_entries(spark.createDataFrame(rows, "doc_id string, text string"))

    return build


def read(df, doc_id="d"):
    rows = df.where(F.col("doc_id") == doc_id).select("idx", F.to_json("entry").alias("j")).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(len(rows)))
    return [json.loads(r.j) for r in rows]


def codes(spark, df):
    ids = df.select("doc_id").distinct().withColumn("is_list", F.lit(True))
    return sorted((r.code, r.idx) for r in va.validate_docs(ids, df).collect())


def test_delete_node_takes_what_it_owns(spark, entries):
    e = entries(d=doc(), other=doc())
    seeds = spark.createDataFrame([("d", 2), ("d", 1), ("d", 6), ("d", 0)], "doc_id string, idx int")
    out, report, errors = ed.delete_entries(e, seeds.where("idx = 2"))
    got = read(out)
    # node, its button and the click event only the button held
    assert [x["__type__"] for x in got] == ["cc.Prefab", "cc.Node", "cc.Node", "cc.Layout", "cc.Node", "cc.Node", "cc.PrefabInfo"]
    assert got[1]["_children"] == [R(2), R(4)] and got[1]["_components"] == [R(3)] and got[1]["_prefab"] == R(6)
    assert got[3]["ref"] is None and got[3]["refs"] == [R(2)] and got[3]["node"] == R(1)
    assert got[4]["_children"] == [R(5)] and got[5]["_parent"] == R(4)
    assert [tuple(r) for r in report.collect()] == [("d", 3, 1)]
    assert read(out, "other") == doc() and codes(spark, out) == []
    _, _, errors = ed.delete_entries(e, seeds.where("idx IN (0, 1)"))
    assert {r.idx: r.error for r in errors.collect()} == {0: "not a component", 1: "cannot remove the root node"}
    out, report, _ = ed.delete_entries(e, seeds.where("idx = 6"))
    assert [tuple(r) for r in report.collect()] == [("d", 1, 0)] and read(out)[1]["_components"] == []


def test_updates_and_notes(spark, entries):
    ups = [
        ("d", 2, 0, "set", "_name", '"New"', False), ("d", 3, 0, "set", "list[1]", "9", False), ("d", 3, 1, "set", "typo", "1", False), ("d", 3, 2, "set", "fresh.x", "1", True),
        ("d", 6, 0, "set", "num", '"text"', False), ("d", 99, 0, "set", "a", "1", False), ("d", 3, 3, "set", "list[7]", "1", False),
    ]
    out, notes = ed.apply_updates(entries(d=doc()), spark.createDataFrame(ups, "doc_id string, idx int, seq int, op string, prop string, value string, force boolean"))
    got = read(out)
    assert got[2]["_name"] == "New" and got[3]["list"] == [3, 9, 2] and got[6]["num"] == "text"
    said = {(n.idx, n.seq, n.level) for n in notes.collect()}
    assert said == {(3, 1, "error"), (3, 2, "error"), (3, 3, "error"), (6, 0, "warning"), (99, 0, "error")}


def test_array_edits_collect_garbage(spark, entries):
    ops = [("d", 3, 0, "reorder", "list", "[2,0,1]"), ("d", 3, 1, "remove", "events", "0"), ("d", 6, 0, "insert", "refs", '{"at":0,"value":{"__id__":8}}'), ("d", 1, 0, "remove", "_children", "0")]
    out, notes = ed.array_edit(entries(d=doc()), spark.createDataFrame(ops, "doc_id string, idx int, seq int, op string, prop string, value string"))
    got = read(out)
    assert got[3]["list"] == [2, 3, 1] and got[3]["events"] == [] and len(got) == 9  # the click event is gone
    assert [x["__type__"] for x in got].count("cc.ClickEvent") == 0 and got[5]["refs"] == [R(7), R(2), R(4)]
    assert [(n.idx, n.level) for n in notes.collect()] == [(1, "error")]


def test_set_parent(spark, entries):
    moves = [("d", 4, 7, 0), ("d", 7, 8, -1), ("d", 1, 2, -1), ("d", 3, 1, -1)]
    out, errors = ed.set_parent(entries(d=doc()), spark.createDataFrame(moves, "doc_id string, idx int, new_parent int, pos int"))
    got = read(out)
    assert got[7]["_children"] == [R(4), R(8)] and got[4]["_parent"] == R(7) and got[1]["_children"] == [R(2), R(7)]
    assert {r.idx: r.error for r in errors.collect()} == {7: "cannot move a node into its own descendant", 1: "cannot move a node into its own descendant", 3: "not a node"}
    assert codes(spark, out) == []


def test_add_nodes_and_components(spark, entries):
    adds = spark.createDataFrame([("d", 0, 7, "A", 0), ("d", 1, 1, "B", -1), ("d", 2, 3, "C", -1)], "doc_id string, seq int, parent int, name string, pos int")
    out, errors = ed.add_nodes(entries(d=doc()), adds)
    got = read(out)
    assert [(x["__type__"], x.get("_name")) for x in got[10:]] == [("cc.Node", "A"), ("cc.PrefabInfo", None), ("cc.Node", "B"), ("cc.PrefabInfo", None)]
    assert got[7]["_children"] == [R(10), R(8)] and got[1]["_children"][-1] == R(12) and got[10]["_prefab"] == R(11) and got[11]["root"] == R(1)
    assert [(r.seq, r.error) for r in errors.collect()] == [(2, "not a node")] and codes(spark, out) == []
    comp, _ = ed.add_components(out, spark.createDataFrame([("d", 0, 10, "cc.Label")], "doc_id string, seq int, node int, type string"))
    got = read(comp)
    assert got[14]["__type__"] == "cc.Label" and got[14]["node"] == R(10) and got[14]["__prefab"] == R(15) and got[10]["_components"] == [R(14)]
    # adding and deleting again restores the document
    back, _, _ = ed.delete_entries(comp, spark.createDataFrame([("d", 10), ("d", 12)], "doc_id string, idx int"))
    assert read(back) == doc()


def test_refs_batches_versions_and_diff(spark, entries):
    e = entries(d=doc(), f=doc())
    ref = spark.createDataFrame([("d", 6, 0, "ref", 8), ("d", 6, 1, "num", 8), ("d", 6, 2, "ref", 77)], "doc_id string, idx int, seq int, prop string, target int")
    out, notes = ed.set_refs(e, ref)
    assert read(out)[6]["ref"] == R(8) and sorted(n.seq for n in notes.collect()) == [1, 2]
    cols = "doc_id string, seq int, kind string, idx int, prop string, value string, target int, pos int"
    ops = [("d", 0, "set", 2, "_name", '"X"', None, None), ("d", 1, "delete", 7, None, None, None, None), ("f", 0, "set", 2, "_name", '"X"', None, None), ("f", 1, "delete", 1, None, None, None, None)]
    done, errors = ed.apply_batch(e, spark.createDataFrame(ops, cols))
    assert len(read(done)) == 8 and read(done)[2]["_name"] == "X" and read(done, "f") == doc()
    assert [(r.doc_id, r.seq) for r in errors.collect()] == [("f", 1)]
    diff = {(r.doc_id, r.idx): r.change for r in ed.entry_diff(e, out).collect()}
    assert diff == {("d", 6): "changed"}
    ok, refused = ed.require_version(spark.createDataFrame([("d", 1), ("f", 2)], "doc_id string, expected_version int"), spark.createDataFrame([("d", 1), ("f", 3)], "doc_id string, version int"))
    assert (ok.count(), refused.count()) == (1, 1)
    text = {r.doc_id: json.loads(r.text) for r in ed.documents_text(e).collect()}
    assert text["d"] == doc()


def test_objects_inserted_by_clone_and_by_type(spark, entries):
    src = [
        {"__type__": "cc.Holder", "deep": {"list": [None, {"__id__": 2}, {"__id__": 1}]}, "plain": [1], "none": 5, "lost": [{"__id__": 9}]},
        {"__type__": "cc.A", "_id": "x"}, {"__type__": "cc.B", "_id": "old", "fileId": "f", "__prefab": {"__id__": 1}, "inner": {"__id__": 1}, "own": {"n": [{"__id__": 1}]}},
    ]
    ops = [("d", 0, 1, "insert_clone", "deep.list", '{"at":0}'), ("d", 0, 2, "insert_type", "deep.list", '{"at":4,"type":"my.C"}'), ("d", 0, 3, "insert_type", "plain", '{"type":"my.D"}')]
    bad = [("d", 0, 4, "insert_clone", "plain", "{}"), ("d", 0, 5, "insert_clone", "none", "{}"), ("d", 0, 6, "insert_type", "plain", '{"at":7,"type":"t"}'), ("d", 0, 7, "insert_clone", "lost", "{}"), ("d", 0, 8, "insert_clone", "x._children", "{}")]
    cols = "doc_id string, idx int, seq int, op string, prop string, value string"
    out, notes = ed.array_edit(entries(d=src), spark.createDataFrame(ops + bad, cols))
    got = read(out)
    assert got[:1] == [src[0] | {"deep": {"list": [{"__id__": 3}, None, {"__id__": 2}, {"__id__": 1}, {"__id__": 4}]}, "plain": [1, {"__id__": 5}]}] and got[1:3] == src[1:]
    assert got[3] == src[2] | {"_id": "a3".ljust(22, "x"), "fileId": "f3".ljust(22, "x"), "__prefab": None}
    assert got[4:] == [{"__type__": "my.C"}, {"__type__": "my.D"}]
    said = {r.seq: r.note for r in notes.where("level = 'error'").collect()}
    assert said[4] == "no element of the array to clone" and said[5] == '"none" is not an array' and said[6] == "index 7 out of range" and said[7] == "template entry 9 is missing" and sorted(said) == [4, 5, 6, 7, 8]


def test_batches_run_by_rounds_of_each_document(spark, entries):
    e = entries(d=doc(), f=doc(), g=doc(), h=doc())
    cols = "doc_id string, seq int, kind string, idx int, prop string, value string, target int, pos int"
    op = lambda d, seq, kind, idx, prop=None, value=None, target=None, pos=None: (d, seq, kind, idx, prop, value, target, pos)
    ops = [op("d", s, "set", 2, "_name", f'"N{s}"') for s in (100, 7, 3)]
    ops += [op("f", 1, "set", 2, "_name", '"A"'), op("f", 900, "delete", 7), op("f", 901, "set", 2, "_name", '"B"'), op("f", 902, "set", 1, "_name", '"C"')]
    ops += [op("g", 5, "add_node", 1, None, "Fresh", None, -1), op("g", 6, "no such kind", 1)]
    plan = ed.schedule(spark.createDataFrame(ops, cols))
    assert {(r.doc_id, r.seq): r.level for r in plan.collect()} == {("d", 3): 1, ("d", 7): 1, ("d", 100): 1, ("f", 1): 1, ("f", 900): 2, ("f", 901): 3, ("f", 902): 3, ("g", 5): 1, ("g", 6): 2}
    out, errors = ed.apply_batch(e, spark.createDataFrame(ops, cols))
    out = out.cache()
    assert read(out)[2]["_name"] == "N100" and read(out, "g") == doc() and read(out, "h") == doc()
    f = read(out, "f")
    assert (len(f), f[2]["_name"], f[1]["_name"]) == (8, "B", "C")
    assert [(r.doc_id, r.seq, r.error) for r in errors.collect()] == [("g", 6, 'unknown edit op "no such kind"')]
    grown, bad = ed.apply_batch(e, spark.createDataFrame([op("g", 5, "add_node", 1, None, "Fresh", None, -1), op("g", 9, "reorder", 1, "_children", "[0]")], cols))
    assert [(r.doc_id, r.seq) for r in bad.collect()] == [("g", 9)] and read(grown, "g") == doc()
    grown, bad = ed.apply_batch(e, spark.createDataFrame([op("g", 5, "add_node", 1, None, "Fresh", None, -1)], cols))
    assert bad.count() == 0 and any(v.get("_name") == "Fresh" for v in read(grown, "g"))
    i = entries(d=instance())
    done, bad = ed.apply_batch(i, spark.createDataFrame([op("d", 0, "override", 3, "_name", '"b"'), op("d", 1, "cross_ref", 10, "link", "deep", 3, None)], cols))
    assert bad.count() == 0 and read(done)[6]["value"] == "b" and any(v.get("__type__") == "cc.TargetOverrideInfo" for v in read(done))
    empty, bad = ed.apply_batch(e, spark.createDataFrame([], cols))
    assert bad.count() == 0 and read(empty) == doc()


def instance():
    return [
        {"__type__": "cc.Prefab", "data": R(1)}, {"__type__": "cc.Node", "_name": "Root", "_parent": None, "_children": [R(3)], "_components": [R(10)], "_prefab": R(2)},
        {"__type__": "cc.PrefabInfo", "fileId": "r", "instance": None, "targetOverrides": None},
        {"__type__": "cc.Node", "_name": "Inst", "_parent": R(1), "_children": [], "_components": [], "_prefab": R(4)},
        {"__type__": "cc.PrefabInfo", "fileId": "f", "asset": {"__uuid__": "src"}, "instance": R(5)}, {"__type__": "cc.PrefabInstance", "propertyOverrides": [R(6), R(8)]},
        {"__type__": "CCPropertyOverrideInfo", "targetInfo": R(7), "propertyPath": ["_name"], "value": "a"}, {"__type__": "cc.TargetInfo", "localID": ["f"]},
        {"__type__": "CCPropertyOverrideInfo", "targetInfo": R(9), "propertyPath": ["_lpos", "x"], "value": 1}, {"__type__": "cc.TargetInfo", "localID": ["deep"]},
        {"__type__": "cc.Ctl", "node": R(1), "link": None},
    ]


def test_instance_overrides_and_wiring(spark, entries):
    src = [{"__type__": "cc.Prefab", "data": R(1)}, {"__type__": "cc.Node", "_name": "Src", "_parent": None, "_prefab": R(2)}, {"__type__": "cc.PrefabInfo", "fileId": "deep"}]
    e = entries(d=instance(), src=src)
    got = {(r.prop, r.on_root, r.instance_path, tuple(r.local_id)) for r in va.instance_overrides(e).collect()}
    assert got == {("_name", True, "Root/Inst", ("f",)), ("_lpos.x", False, "Root/Inst", ("deep",))}
    assert [(r.prop, r.node_path) for r in va.deep_override_paths(e).collect()] == [("_lpos.x", "Root/Src")]
    want = spark.createDataFrame([("d", 0, 3, "_name", '"b"'), ("d", 1, 3, "_layer", "4"), ("d", 2, 1, "_layer", "4")], "doc_id string, seq int, node int, prop string, value string")
    out, errors = ed.upsert_overrides(e, want)
    doc_ = read(out)
    assert doc_[6]["value"] == "b" and doc_[3]["_name"] == "b" and doc_[12]["propertyPath"] == ["_layer"] and doc_[11]["localID"] == ["f"] and doc_[5]["propertyOverrides"][-1] == R(12)
    assert [r.seq for r in errors.collect()] == [2]
    wire = spark.createDataFrame([("d", 0, 10, "link", 3, "deep", None)], "doc_id string, seq int, source int, prop string, instance int, target_id string, inline int")
    out, _ = ed.add_cross_refs(e, wire)
    doc_ = read(out)
    assert doc_[12]["__type__"] == "cc.TargetOverrideInfo" and doc_[12]["target"] == R(3) and doc_[2]["targetOverrides"] == [R(12)] and doc_[10]["link"] is None
    again, _ = ed.add_cross_refs(out, wire.withColumn("target_id", F.lit("other")))
    assert len(read(again)) == 13 and read(again)[11]["localID"] == ["other"]
    seeds = spark.createDataFrame([("d", 1), ("d", 3)], "doc_id string, idx int")
    assert {r.root: r.has_instance for r in ed.subtree_has_instance(e, seeds).collect()} == {1: True, 3: True}
    assert set(va.override_anatomy(e)) == {"instances", "overrides", "deep", "wiring", "file_ids"}


def test_structure_and_selectors(spark, entries):
    e = entries(d=doc())
    nodes, comps = sl.list_nodes(e)
    listing = [(r.idx, r.path, r.depth) for r in nodes.orderBy("doc_id", "order_key").collect()]
    assert listing == [(1, "Root", 0), (2, "Root/Item[0]", 1), (4, "Root/Item[1]", 1), (7, "Root/Last", 1), (8, "Root/Last/Deep", 2)]
    assert {r.selector for r in comps.collect()} == {"Root:cc.Layout", "Root/Item[0]:cc.Button"}
    forms = ["Root/Item", "Root/Item[1]", "Root/Item[5]", "Root:cc.Layout.refs[1]", "Root:cc.Nope", "#5.handler", "#77", "Root/Last/Deep"]
    got = {r.selector: (r.kind, r.idx, r.prop, r.error) for r in sl.resolve_selectors(spark.createDataFrame([("d", s) for s in forms], "doc_id string, selector string"), e).collect()}
    assert got == {
        "Root/Item": (None, None, None, "ambiguous node"), "Root/Item[1]": ("node", 4, None, None), "Root/Item[5]": (None, None, None, "sibling out of range"),
        "Root:cc.Layout.refs[1]": ("property", 6, "refs[1]", None), "Root:cc.Nope": (None, None, None, "no matching component"), "#5.handler": ("property", 5, "handler", None),
        "#77": (None, None, None, "index out of range"), "Root/Last/Deep": ("node", 8, None, None),
    }
    vals = sl.get_values(spark.createDataFrame([("d", "Root:cc.Layout.refs[1]"), ("d", "#5.handler")], "doc_id string, selector string"), e)
    assert {r.selector: r.value for r in vals.collect()} == {"Root:cc.Layout.refs[1]": '{"__id__":4}', "#5.handler": '"go"'}
    only, _ = sl.list_nodes(e, under=spark.createDataFrame([("d", 7)], "doc_id string, idx int"), depth=0)
    assert [r.path for r in only.collect()] == ["Root/Last"]


def test_validation_codes(spark):
    bad = [{"__type__": "cc.Prefab", "data": R(1)}, {"__type__": "cc.Node", "_children": [R(2), 5, R(4)], "_components": [R(3), R(50)], "_parent": None}, {"__type__": "cc.Node", "_parent": R(0)},
           {"__type__": "zz.C", "node": R(2)}, {"x": 1}, None]
    docs = spark.createDataFrame([("b", json.dumps(bad)), ("e", "[]"), ("o", '{"a":1}'), ("x", "{")], "doc_id string, text string")
    parsed, e = dc.parse_docs(docs), dc.doc_entries(docs, lists_only=True)
    known = spark.createDataFrame([("a.B",)], "type string")
    got = sorted((r.doc_id, r.code, r.idx) for r in va.validate_docs(parsed, e, known).collect())
    assert got == sorted([
        ("b", "bad-ref", 1), ("b", "bad-ref", 1), ("b", "null-entry", 5), ("b", "untyped-entry", 4), ("b", "bad-child", 1), ("b", "bad-child", 1), ("b", "parent-mismatch", 2), ("b", "bad-comp-ref", 1),
        ("b", "comp-node-mismatch", 3), ("b", "unresolved-type", 3), ("e", "empty", None), ("o", "unloadable", None), ("x", "unloadable", None),
    ], key=lambda t: (t[0], t[1], -1 if t[2] is None else t[2]))
    s = va.validation_summary(va.validate_docs(parsed, e, known), parsed).first()
    assert (s.total, s.passed, s.failures, s.warnings) == (4, 0, 4, 3)


def test_parent_cycles_end(spark):
    docs = spark.createDataFrame([("d", json.dumps([{"__type__": "cc.Node", "_name": "A", "_parent": R(1)}, {"__type__": "cc.Node", "_name": "B", "_parent": R(0)}]))], "doc_id string, text string")
    assert {r.idx: r.path for r in dc.node_paths(dc.doc_entries(docs)).collect()} == {0: "B/A", 1: "A/B"}
