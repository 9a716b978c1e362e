from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from refloom.functions.scalar import encode_token
from refloom.operators import reports as rp
from refloom.operators import traverse as tv
from refloom.operators.extract import component_names, site_selector
from refloom.registry import Extraction, Registry, annotate, labelled
from refloom.sources.files import builtin_types, known_types, scan_files
from refloom.sources.project import load_project
from refloom.sources.sinks import as_json, read_graph, write_graph, write_json


def U(n: str) -> str:
    return "-".join([n * 8, n * 4, n * 4, n * 4, n * 12])


def token(spark, uid: str) -> str:
    return spark.createDataFrame([(uid,)], "u string").select(encode_token("u")).first()[0]


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    """A small project: atlas with a frame, component script, prefab, scene, ghosts and unused files."""
    root = tmp_path_factory.mktemp("project") / "assets"
    meta = lambda **k: json.dumps(k)
    files = {
        "coin.png": "PNG", "coin.png.meta": meta(importer="image", uuid=U("1"), subMetas={"6c48a": {"importer": "texture", "uuid": U("1") + "@6c48a"}, "f9941": {"importer": "sprite-frame", "uuid": U("1") + "@f9941", "name": "spriteFrame"}}),
        "ui.plist": "PLIST", "ui.plist.meta": meta(importer="sprite-atlas", uuid=U("2"), subMetas={"f1234": {"importer": "sprite-frame", "uuid": U("2") + "@f1234", "name": "coin_frame", "userData": {"imageUuidOrDatabaseUri": U("1") + "@6c48a", "width": 4, "height": 5}}}),
        "ShopCtrl.ts": "export class ShopCtrl extends Component { f<T extends Component>() {} }", "ShopCtrl.ts.meta": meta(importer="typescript", uuid=U("3")),
        "Utils.ts": "function get<T extends Component>() {}", "Utils.ts.meta": meta(importer="typescript", uuid=U("9")),
        "Shop.prefab": json.dumps([
            {"__type__": "cc.Prefab", "data": {"__id__": 1}},
            {"__type__": "cc.Node", "_name": "Shop", "_parent": None, "_children": [{"__id__": 3}], "_components": [{"__id__": 2}]},
            {"__type__": "cc.Sprite", "node": {"__id__": 1}, "_spriteFrame": {"__uuid__": U("2") + "@f1234"}, "_lost": {"__uuid__": U("c")}},
            {"__type__": "cc.Node", "_name": "Icon", "_parent": {"__id__": 1}, "_children": [], "_components": [{"__id__": 4}]},
            {"__type__": token(spark, U("3")), "node": {"__id__": 3}, "ghost": {"__uuid__": U("d")}},
        ]),
        "Shop.prefab.meta": meta(importer="prefab", uuid=U("4")),
        "Game.scene": json.dumps([{"__type__": "cc.Scene", "_name": "Game"}, {"__type__": "cc.X", "node": {"__id__": 0}, "p": {"__uuid__": U("4")}}]), "Game.scene.meta": meta(importer="scene", uuid=U("5")),
        "ghost.png.meta": meta(importer="image", uuid=U("d")), "bad.png.meta": "{nope", "noid.png.meta": "{}",
        "unused.png": "x", "unused.png.meta": meta(importer="image", uuid=U("6")),
        "resources.meta": meta(importer="directory", uuid=U("7"), userData={}), "resources/dyn.png": "yy", "resources/dyn.png.meta": meta(importer="image", uuid=U("8")),
        "pack.meta": meta(importer="directory", uuid=U("a"), userData={"isBundle": True, "priority": 3}), "pack/in.png": "z", "pack/in.png.meta": meta(importer="image", uuid=U("b")),
        ".DS_Store": "junk",
    }
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def project(spark, tree):
    return load_project(spark, tree)


def test_listing_skips_junk(spark, tree):
    names = {r.path for r in scan_files(spark, tree).collect()}
    assert "resources/dyn.png" in names and not any("DS_Store" in n for n in names)


def test_nodes_types_and_errors(spark, project):
    nodes = {r.path: (r.type, r.container) for r in project.graph.nodes.collect()}
    assert nodes == {
        "coin.png": ("image", "main"), "ui.plist": ("atlas", "main"), "ShopCtrl.ts": ("script", "main"), "Shop.prefab": ("prefab", "main"), "Game.scene": ("scene", "main"),
        "unused.png": ("image", "main"), "resources/dyn.png": ("image", "resources"), "pack/in.png": ("image", "pack"),
    }
    assert {(r.path, r.error) for r in project.graph.parse_errors.collect()} == {("bad.png.meta", "invalid JSON"), ("noid.png.meta", "no uuid")}
    assert {(r.name, r.root, r.priority) for r in project.graph.containers.collect()} == {("pack", "pack", 3), ("resources", "resources", 0)}
    assert "spine-atlas" in [r.type for r in known_types(builtin_types(spark)).collect()]


def test_edges_sites_and_usage(project):
    g = project.graph
    edges = {(r.src, r.dst, r.kind) for r in g.edges.collect()}
    assert edges == {(U("4"), U("2"), "sprite-frame"), (U("4"), U("3"), "script"), (U("5"), U("4"), "prefab"), (U("2"), U("1"), "texture")}
    named = site_selector(component_names(g.sites, g.nodes))
    sel = {(r.dst, r.selector, r.sub_name) for r in named.collect()}
    assert (U("2"), "Shop:cc.Sprite._spriteFrame", "coin_frame") in sel and (U("3"), "Shop/Icon:ShopCtrl", None) in sel
    assert {(r.owner_id, r.sub_id) for r in g.sub_usage.collect()} == {(U("2"), "f1234"), (U("3"), None), (U("4"), None)}


def test_closure_dangling_unused_and_audit(spark, project):
    g = project.graph
    root = spark.createDataFrame([(U("5"),)], "id string")
    assert {r.node for r in tv.closure(g.adjacency, root).collect()} == {U("4"), U("2"), U("3"), U("1")}
    d = {r.ref: (r.path, r.missing_source) for r in rp.dangling_report(g.dangling, g.missing).collect()}
    assert d == {U("c"): (None, False), U("d"): ("ghost.png", True)}
    assert {(r.path, r.referenced) for r in rp.dropped_report(g.missing, g.dangling).collect()} == {("ghost.png", True)}
    unused = {r.path: r.candidate for r in rp.unused_report(g, ("scene",)).collect()}
    assert unused == {"unused.png": False, "resources/dyn.png": True, "pack/in.png": True}
    sections = rp.audit(g, ("scene",))
    assert {"stats", "unused", "size", "dangling", "dropped", "utilization", "containers.rollup", "containers.duplication"} <= set(sections)
    u = [r for r in sections["utilization"].collect() if r.path == "ui.plist"][0]
    assert (u.used, u.total, u.total_area) == (1, 1, 20.0)


def test_content_is_read_of_wanted_files_only(spark, tree):
    read = {f.rsplit("/", 1)[-1] for f in scan_files(spark, tree, content=True, exts=[".prefab", ".ts"]).inputFiles()}
    assert read == {"Shop.prefab", "ShopCtrl.ts", "Utils.ts"}
    assert {f.rsplit(".", 1)[-1] for f in scan_files(spark, tree, content=True, exts=[".meta"]).inputFiles()} == {"meta"}


def test_extractors_keep_labels_sites_and_hits_on_missing_sources(spark, tmp_path):
    meta = lambda **k: json.dumps(k)
    files = {
        "gone.png.meta": meta(importer="image", uuid=U("1")), "page.PNG.meta": meta(importer="image", uuid=U("2")), "idle.png.meta": meta(importer="image", uuid=U("3")),
        "ui.plist": "PLIST", "ui.plist.meta": meta(importer="sprite-atlas", uuid=U("4"), subMetas={"f": {"importer": "sprite-frame", "uuid": U("4") + "@f", "name": "x", "userData": {"imageUuidOrDatabaseUri": U("1") + "@6c48a"}}}),
        "hero.ATLAS": "page.PNG\nsize: 1,1\n", "hero.ATLAS.meta": meta(importer="*", uuid=U("5")),
        "a.Prefab": json.dumps([{"__type__": "cc.Node", "p": {"__uuid__": U("4")}}]), "a.Prefab.meta": meta(importer="prefab", uuid=U("6")),
        "big.png": "x" * 1000, "big.png.meta": meta(importer="image", uuid=U("7")),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    reg = Registry()

    @reg.extractor("calls")
    def calls(project):
        edges = spark.createDataFrame([(U("6"), U("7"), "call", "load(b)"), (U("6"), U("7"), "call", "load(a)"), (U("6"), U("4"), "plain", None)], "src string, dst string, kind string, label string")
        return Extraction(edges=edges, dangling=spark.createDataFrame([(U("6"), "nowhere", "Root/N")], "src string, ref string, node_path string"))

    g = load_project(spark, str(tmp_path), reg).graph
    assert {(r.src, r.ref) for r in g.extras["missing_hits"].collect()} == {(U("4"), U("1")), (U("5"), U("2"))}
    dropped = rp.audit(g)["dropped"]
    assert {r.path: (r.refs, r.referenced) for r in dropped.collect()} == {"gone.png": (1, True), "page.PNG": (1, True), "idle.png": (0, False)}
    edges = {(r.dst, r.kind): (r.weight, r.label) for r in g.edges.collect()}
    assert edges[U("7"), "call"] == (2, "load(a)") and edges[U("4"), "plain"] == (1, None) and (U("4"), "atlas") in edges
    assert [(r.node_path) for r in g.dangling.where("ref = 'nowhere'").collect()] == ["Root/N"]


def test_extractors_types_reports_and_failures(spark, tree):
    reg = Registry()
    reg.register_types(importer={"image": "picture"}, ext={".zip": "pack"}, root_types=["scene"])

    @reg.extractor("events")
    def events(project):
        s = project.scripts.select("id")
        return Extraction(
            edges=s.select(F.col("id").alias("src"), F.lit("event:open").alias("dst"), F.lit("emits").alias("kind")),
            nodes=s.select(F.lit("event").alias("type"), F.lit("open").alias("path")),
        )

    @reg.extractor("broken")
    def broken(project):
        return project.scripts.select(F.raise_error(F.lit("boom")).cast("string").alias("src"), F.lit("x").alias("dst"), F.lit("k").alias("kind"))

    @reg.report("by-type")
    def by_type(graph, type_="event"):
        return graph.nodes.where(F.col("type") == type_).select("path")

    reg.checker("no-orphans")(lambda g, r, c: None)
    assert reg.checkers == {}
    p = load_project(spark, tree, reg)
    assert [r.name for r in p.extractor_errors.collect()] == ["broken"]
    virtual = p.graph.nodes.where("virtual").select("id", "type").collect()
    assert [tuple(r) for r in virtual] == [("event:open", "event")]
    assert p.graph.nodes.where("type = 'picture'").count() == 4
    assert [r.path for r in reg.run_report("by-type", p.graph).collect()] == ["open"]
    assert "event:open" not in {r.id for r in rp.unused_report(p.graph).collect()}
    with pytest.raises(KeyError):
        reg.run_report("nope", p.graph)
    rows = labelled(p.graph.nodes, F.col("type") == "atlas", F.concat(F.lit("frames of "), "path")).collect()
    assert [r.label for r in rows] == ["frames of ui.plist"]

    def count(batches):
        for pdf in batches:
            yield pdf[["id"]].assign(n=pdf["path"].str.len())

    got = annotate(p.graph.nodes.select("id", "path", "type"), F.col("type") == "atlas", count, "id string, n long").collect()
    assert [r.n for r in got] == [8]


def test_sinks_round_trip(spark, project, tmp_path):
    g = project.graph
    write_json({"size": rp.size_report(g), "stats": rp.summary(g)}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "size")).count() == rp.size_report(g).count()
    assert json.loads(as_json(rp.size_report(g).where("type = 'atlas'")).first()[0])["n"] == 1
    flat = g.with_(nodes=g.nodes.drop("user_data"))
    write_graph(flat, str(tmp_path / "graph"))
    back = read_graph(spark, str(tmp_path / "graph"), sites=True)
    assert back.edges.count() == g.edges.count() and back.sites.count() == g.sites.count()


def test_an_error_without_text_loses_only_its_own_extractor(spark, make):
    from refloom.registry import Registry

    class Silent(Exception):
        def __str__(self):
            return ""

    def fails(_):
        raise Silent

    registry = Registry()
    registry.extractor("silent")(fails)
    registry.extractor("fine")(lambda project: project.edges)
    done, errors = registry.run_extractors(make(["a", "b"], [("a", "b")]))
    assert len(done) == 1 and [(r.name, r.error) for r in errors.collect()] == [("silent", "Silent")]
