from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from refloom.operators import containers as ct
from refloom.operators import duplicates as dp
from refloom.operators import filters as fl
from refloom.operators import lookup as lk
from refloom.operators import reports as rp
from refloom.operators import search as se
from refloom.operators.rules import Context, evaluate_rules


def shared(make, pa, pb):
    g = make({"A1": ("p", 1, "A"), "B1": ("p", 1, "B"), "S": ("i", 10, "main")}, [("A1", "S"), ("B1", "S")])
    c = g.nodes.sparkSession.createDataFrame([("A", pa), ("B", pb)], "name string, priority int")
    return {r.id: (r.copies, r.wasted) for r in ct.container_duplication(g, c).collect()}


def test_duplication_only_on_a_priority_tie(make):
    assert shared(make, 5, 5) == {"S": (2, 10)}
    assert shared(make, 9, 3) == {}
    assert shared(make, 0, 0) == {"S": (3, 20)}  # the default container has priority 0 too


def test_nested_container_roots(spark, make):
    g = make({"1": ("t", 1, None, "ui/a.png"), "2": ("t", 1, None, "ui/inner/b.png"), "3": ("t", 1, None, "uix/c.png"), "4": ("t", 1, None, "resources/d.png")}, [])
    roots = spark.createDataFrame([("ui", "ui"), ("inner", "ui/inner"), ("resources", "resources")], "name string, root string")
    assert {r.id: r.container for r in ct.assign_container(g.nodes, roots).collect()} == {"1": "ui", "2": "inner", "3": "main", "4": "resources"}


def test_rollup_is_empty_without_real_containers(make):
    assert ct.container_rollup(make({"a": ("t", 1, "main")}, [])).count() == 0
    g = make({"a": ("t", 1, "X"), "b": ("t", 2, "main"), "c": ("t", 4, "X")}, [("a", "b"), ("c", "b"), ("a", "c")])
    assert {r.container: tuple(r)[1:] for r in ct.container_rollup(g).collect()} == {"X": (2, 5, 0, 1), "main": (1, 2, 1, 0)}
    report = ct.container_report(g)
    assert [(r.src, r.dst, r.weight, r.refs, r.mutual) for r in report["links"].collect()] == [("X", "main", 2, 2, False)]
    assert report["refs"].count() == 2 and report["cycles"].count() == 0


def test_unused_and_candidates(make):
    g = make({"a": ("scene", 1, "main"), "b": ("img", 2, "main"), "c": ("img", 4, "ui"), "d": ("img", 8, "main")}, [("a", "d")])
    got = {r.id: r.candidate for r in rp.unused_report(g, root_types=("scene",)).collect()}
    assert got == {"b": False, "c": True}


def test_utilization_by_area(spark):
    owners = spark.createDataFrame([("o", "o.plist"), ("u", "u.plist")], "owner_id string, path string")
    subs = spark.createDataFrame([("o", "f1", 100, 100), ("o", "f2", 10, 10), ("u", "f1", None, None), ("u", "f2", 1, 1)], "owner_id string, sub_id string, width int, height int")
    use = spark.createDataFrame([("o", "f2"), ("o", "f2"), ("u", None)], "owner_id string, sub_id string")
    r = {x.owner_id: x for x in rp.utilization(owners, subs, use).collect()}
    assert (r["o"].used, r["o"].total, r["o"].ratio, r["o"].total_area, r["o"].used_area, r["o"].wasted_area) == (1, 2, 0.5, 10100, 100, 10000)
    assert r["o"].area_ratio < 0.02 and not r["o"].whole_referenced
    assert (r["u"].ratio, r["u"].total_area, r["u"].area_ratio, r["u"].whole_referenced) == (0, None, None, True)


def test_dangling_and_dropped(spark, make):
    g = make(["a", "b"], [])
    raw = spark.createDataFrame([("a", "b"), ("a", "gone@1"), ("b", "gone@1"), ("a", "x")], "src string, ref string")
    missing = spark.createDataFrame([("gone", "ghost.png"), ("idle", "idle.png")], "id string, path string")
    d = rp.dangling_refs(raw, g.nodes)
    got = {r.ref: (r.refs, r.path, r.missing_source) for r in rp.dangling_report(d, missing).collect()}
    assert got == {"gone@1": (2, "ghost.png", True), "x": (1, None, False)}
    assert {r.id: (r.refs, r.referenced) for r in rp.dropped_report(missing, raw).collect()} == {"gone": (2, True), "idle": (0, False)}
    assert {r.id for r in rp.missing_referenced(missing, raw).collect()} == {"gone"}


def test_size_map_pools_the_rest(make):
    g = make({str(i): ("t", i, None) for i in range(1, 6)}, [])
    got = {r.item: (r.n, r.size) for r in rp.size_map(rp.size_scope(g), cap=2).collect()}
    assert got == {"5": (1, 5), "4": (1, 4), "others": (3, 6)}


def test_duplicate_groups(spark):
    files = spark.createDataFrame([("a", "image", 3, b"abc"), ("b", "image", 3, b"abc"), ("c", "image", 3, b"abd"), ("d", "image", 0, b""), ("e", "image", 0, b"")], "id string, type string, size long, content binary")
    m = dp.content_duplicates(files)
    nodes = spark.createDataFrame(
        [("a", "x/long/a.png", "image", 3, 1, False, "image", "{}"), ("b", "b.png", "image", 3, 1, True, "image", '{"t":1}')],
        "id string, path string, type string, size long, in_degree long, in_resources boolean, importer string, user_data string",
    )
    g = dp.annotate_groups(m, nodes).first()
    assert (g["count"], g.reclaimable, g.mergeable, g.canonical, g.warnings) == (2, 3, False, "b", "import-settings-differ,spans-resources")
    assert [(r.id, r.canonical) for r in dp.redundant_members(m, dp.annotate_groups(m, nodes)).collect()] == [("a", "b")]
    docs = spark.createDataFrame([("1", "prefab", '{"fileId":"x","k":1}'), ("2", "prefab", '{"k":1,"fileId":"y"}'), ("3", "anim", '{"k":1,"fileId":"z"}'), ("4", "prefab", "{")], "id string, type string, text string")
    assert {r.id for r in dp.canonical_duplicates(docs).collect()} == {"1", "2"}


def test_shared_names(spark):
    rec = spark.createDataFrame([("a1", "glow", 100, 100), ("a2", "glow", 100, 100), ("a1", "own", 5, 5), ("a1", "dim", 1, 1), ("a2", "dim", 2, 2), ("a1", "z", 0, 0), ("a2", "z", 0, 0)], "container string, name string, w int, h int")
    users = spark.createDataFrame([("a1", "u1"), ("a2", "u1"), ("a2", "u2")], "container string, user string")
    got = {r.name: (r.containers, r.confidence, r.users) for r in dp.shared_names(rec, users).collect()}
    assert got == {"glow": (2, "likely", 2), "dim": (2, "name-only", 2), "z": (2, "name-only", 2)}


@pytest.mark.parametrize("pivots", [0, 3])
def test_confirmation_matches_all_pairs(spark, monkeypatch, pivots):
    monkeypatch.setattr(dp, "_PIVOTS", pivots)
    monkeypatch.setattr(dp, "_BLOCK", 4)
    rnd = np.random.default_rng(5)
    turns = [np.rot90(np.arange(16).reshape(4, 4), k=-k).ravel() for k in range(4)]
    rows, want = [], {}
    for g in range(8):
        center = rnd.uniform(0, 255, 16)
        sigs = [(center + rnd.uniform(-1, 1, 16) * (10 + 4 * g))[turns[rnd.integers(4)]] for _ in range(11)]
        worst = max(min(np.abs(a - b[t]).sum() for t in turns) / (16 * 255) for a in sigs for b in sigs)
        want[g] = "confirmed" if worst <= 0.06 else "different"
        rows += [(g, i, [float(x) for x in s]) for i, s in enumerate(sigs)]
    df = spark.createDataFrame(rows, "gid int, member int, sig array<double>")
    got = {r.gid: r.verdict for r in dp.confirm_groups(df, 4, 0.06).collect()}
    assert got == want and set(want.values()) == {"confirmed", "different"}


def test_lookup_tiers(spark, make):
    g = make({"u1": ("t", 1, None, "a/icon.png"), "u2": ("t", 1, None, "b/icon.png"), "u3": ("t", 1, None, "b/Coin.PNG")}, [])
    q = spark.createDataFrame([(x,) for x in ["u1@sub", "a/icon.png", "icon.png", "b/icon", "coin", "nope", " ", "/assets/b/Coin.PNG.meta"]], "query string")
    got = {r.query: (r.status, r.tier, r.hits, r.id) for r in lk.resolve_names(q, g.nodes).collect()}
    assert got["u1@sub"] == ("unique", "id", 1, "u1") and got["a/icon.png"][1] == "path" and got["icon.png"][:3] == ("ambiguous", "suffix", 2)
    assert got["b/icon"] == ("unique", "no-extension", 1, "u2") and got["coin"] == ("unique", "ignore-case", 1, "u3")
    assert got["nope"][0] == "none" and got[" "][0] == "none" and got["/assets/b/Coin.PNG.meta"] == ("unique", "path", 1, "u3")


def test_suggestions_match_brute_force(spark, make):
    rnd = random.Random(2)
    names = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9))) + rnd.choice(["", ".png"]) for _ in range(60)})
    g = make({n: ("t", 1, None, f"d/{n}") for n in names}, [])
    queries = ["abca.png", "dd", "abcdabcdab", "b"]

    def dist(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]

    want = {}
    for q in queries:
        hits = []
        for n in names:
            d = min(dist(q, n), dist(q, n.rsplit(".", 1)[0]))
            if d <= max(2, int(max(len(q), len(n)) * 0.4)):
                hits.append((d, f"d/{n}"))
        want[q] = sorted(hits)[:5]
    got = {}
    for r in lk.suggest_names(spark.createDataFrame([(q,) for q in queries], "query string"), g.nodes).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.distance, r.path))
    assert got == want


def test_suggestions_by_segments(spark, make):
    rnd = random.Random(7)
    words = ["button", "background", "panel", "icon", "coin", "settings", "highlight", "particle", "texture"]
    names = sorted({"_".join(rnd.choice(words) for _ in range(rnd.randint(1, 5))) + rnd.choice(["", ".png", ".prefab"]) for _ in range(150)})
    queries = []
    for n in rnd.sample(names, 20):
        letters = list(n)
        for _ in range(rnd.randint(1, 9)):
            at = rnd.randrange(len(letters) + 1)
            letters[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "q"])
        queries.append("".join(letters))
    queries = [x for x in dict.fromkeys(queries) if x] + ["zzzzzzzzzzzzzzzzzzzzzzzzzzzz", "é", "x" * 90]

    def dist(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]

    want = {}
    for q in queries:
        hits = [(min(dist(q, n), dist(q, n.rsplit(".", 1)[0])), f"d/{n}") for n in names]
        top = sorted((d, p) for d, p in hits if d <= max(2, int(max(len(q), len(p) - 2) * 0.4)))[:5]
        if top:
            want[q] = top
    g = make({n: ("t", 1, None, f"d/{n}") for n in names}, [])
    got = {}
    for r in lk.suggest_names(spark.createDataFrame([(q,) for q in queries], "query string"), g.nodes).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.distance, r.path))
    assert got == want


def test_one_long_name_widens_no_other_band(spark, make):
    names = ["short.png", "shirt.png", "a" * 10_000 + ".png"]
    g = make({n: ("t", 1, None, n) for n in names}, [])
    forms = [("short.png", 9, 9), ("short", 9, 5), ("a" * 10_000, 10_004, 10_000)]
    got = lk.suggest_names(spark.createDataFrame([("shart.png",), ("a" * 9_990 + ".png",)], "query string"), g.nodes)
    assert sorted((len(r.query), r.distance, len(r.path)) for r in got.collect()) == [(9, 1, 9), (9, 1, 9), (9_994, 10, 10_004)]
    q = spark.createDataFrame([("shart.png", 9)], "qb string, ql int")
    bands = spark.createDataFrame([(9, f) for _, _, f in forms], "ql int, f int")
    assert {r.f for r in lk._probes(q, bands, 4).select("f").distinct().collect()} == {5, 9}


def test_search_index_and_scopes(make, spark):
    sites = [("b", "a", "use", "Canvas/Icon", "cc.Sprite", "_spriteFrame", "fr"), ("c", "a", "use", "Canvas/Icon", "cc.Sprite", "_spriteFrame", None)]
    subs = spark.createDataFrame([("a", "1", "sprite-frame", "hero"), ("a", "2", "sprite-frame", "spriteFrame")], "owner_id string, sub_id string, kind string, name string")
    g = make({"a": ("image", 1, None, "ui/coin.png"), "b": ("prefab", 1, None, "ui/Shop.prefab"), "c": ("scene", 1, None, "Game.scene")}, [("b", "a"), ("c", "a"), ("c", "b", "load")], sites, sub_items=subs)
    idx = se.search_index(g)
    kinds = {r.entry: r["count"] for r in idx.groupBy("entry").count().collect()}
    assert kinds == {"asset": 3, "frame": 1, "usage": 1, "edge": 1}
    top = lambda q: [(r.entry, r.target) for r in se.search(idx, q).collect()]
    assert top("coin") == [("asset", "a")] and top("@hero") == [("frame", "a")] and top(">icon") == [("usage", "a")]
    assert top("#prefab shop") == [("asset", "b")] and top("~load ") == [("edge", "b")] and len(top("")) == 3
    assert [(r.edge_kind, r.n) for r in se.kind_facets(idx, "~").orderBy("edge_kind").collect()] == [("load", 1), ("use", 1)]


def test_rules_gate_and_messages(spark, make):
    g = make({"A": ("t", 1, "x", "src/A"), "B": ("t", 1, "x", "src/B"), "C": ("t", 1, "y", "art/c")}, [("A", "B"), ("B", "C"), ("C", "A")],
             [("B", "C", "use", "Root/N", "cc.Sprite", "p", None)])
    bad = spark.createDataFrame([("m", "invalid JSON")], "path string, error string")
    g = g.with_(parse_errors=bad)
    rules = [
        {"name": "forbid-dep", "from": {"pathRegex": "^src/A"}, "to": {"pathStartsWith": "art/"}, "transitive": True},
        {"name": "forbid-dep", "from": {"not": {"pathStartsWith": "art/"}}, "to": {"pathStartsWith": "art/"}, "level": "warn"},
        {"name": "max-meta-errors"}, {"name": "no-bundle-cycle"}, {"name": "nope"}, {"name": "forbid-dep", "from": {"pathRegex": "("}}, {"name": "mine"}, {"name": "boom"},
    ]

    def mine(graph, rule, ctx):
        return graph.nodes.where("id = 'A'").select(F.lit("seen").alias("message"), F.col("path").alias("asset"), *[F.lit(None).cast("string").alias(c) for c in ("src", "dst", "kind")])

    def boom(graph, rule, ctx):
        raise RuntimeError("broken checker")

    r = evaluate_rules(g, rules, Context(), {"mine": mine, "boom": boom})
    msgs = {(v.rule, v.level, v.message) for v in r.violations.collect()}
    assert ("forbid-dep", "error", "src/A ⇒ art/c (transitively, 2 hop(s): src/A → src/B → art/c)") in msgs
    assert ("forbid-dep", "warn", "src/B → art/c (use)") in msgs
    assert ("max-meta-errors", "error", "1 meta parse error(s) (max 0)") in msgs
    assert ("no-bundle-cycle", "error", "bundle cycle x ⇄ y") in msgs and ("mine", "error", "seen") in msgs
    assert r.counts() == {"error": 4, "warn": 1, "config": 3} and r.gate() == 2
    assert [(s.src, s.dst, s.location) for s in r.sites.collect()] == [("B", "C", "Root/N:cc.Sprite.p")]
    assert evaluate_rules(make(["a"], [])).gate() == 0


def test_rule_that_breaks_in_a_task_leaves_the_others(spark, make):
    g = make({"A": ("t", 1, "x", "src/A"), "B": ("t", 1, "y", "src/B")}, [("A", "B")])
    none = [F.lit(None).cast("string").alias(c) for c in ("src", "dst", "kind")]

    def late(graph, rule, ctx):
        return graph.nodes.select(F.raise_error(F.concat(F.lit("bad row "), "id")).cast("string").alias("message"), F.col("path").alias("asset"), *none)

    def worker(graph, rule, ctx):
        def fail(batches):
            raise RuntimeError("lost in a task")
            yield from batches

        return graph.nodes.select("id").mapInArrow(fail, "id string").select(F.col("id").alias("message"), F.col("id").alias("asset"), *none)

    r = evaluate_rules(g, [{"name": "late"}, {"name": "no-cross-bundle"}, {"name": "worker"}], Context(), {"late": late, "worker": worker})
    got = {(v.rule, v.level): v.message for v in r.violations.collect()}
    assert got["no-cross-bundle", "error"] == "x → y (1 cross-bundle ref(s))" and r.gate() == 2 and r.checked == ["no-cross-bundle"]
    assert "bad row" in got["late", "config"] and got["worker", "config"] == 'rule "worker" failed: RuntimeError: lost in a task'


def test_override_and_leak_rules(spark, make):
    g = make(["a"], [])
    rows = [("f", "prefab", "_name", True, ["x"], "Root/I", "i"), ("f", "prefab", "_lpos", False, ["x", "y"], None, "i"), ("f", "prefab", "lightmapSettings", False, ["x"], "R", "i"), ("s", "scene", "_lpos", False, ["x"], "R", "i")]
    ov = spark.createDataFrame(rows, "file string, type string, prop string, on_root boolean, local_id array<string>, instance_path string, instance string")
    props = lambda **kw: sorted(v.message.split('"')[1] for v in evaluate_rules(g, [{"name": "no-deep-instance-override", **kw}], Context(overrides=ov)).violations.collect())
    assert props() == ["_lpos"] and props(ignoreProps=[]) == ["_lpos", "lightmapSettings"] and props(allowProps=[]) == ["_lpos", "_name"]
    assert props(ignoreProps="_lpos") == ["lightmapSettings"] and props(files="all") == ["_lpos", "_lpos"] and props(allowProps=["_name"]) == ["_lpos"]
    leaks = spark.createDataFrame([("f", "b"), ("f", "a"), ("h", "c")], "file string, name string")
    got = {v.asset: v.message for v in evaluate_rules(g, [{"name": "no-editor-preview-leak"}], Context(leaks=leaks)).violations.collect()}
    assert got["f"].startswith("editor preview Canvas leaked into the file: a, b — ") and set(got) == {"f", "h"}


def test_duplication_rule(spark, make):
    g = make({"a": ("t", 2048, "x"), "b": ("t", 1, "x")}, [])
    assert evaluate_rules(g, [{"name": "max-duplication"}]).violations.count() == 0


def test_distinguishing_dirs(spark):
    rows = [(1, "p", "a/b/x/icon.png"), (2, "p", "a/c/x/icon.png"), (3, "p", "a/c/x/other.png"), (4, None, "m/icon.png"), (5, None, "n/icon.png"), (6, "q", "icon.png"), (7, "q", "d/icon.png"), (8, "r", "s/t/i"), (9, "r", "s/t/i"), (10, "z", "a/a/i"), (11, "z", "a/a/a/i")]
    got = {r.id: r.dir for r in lk.distinguishing_dirs(spark.createDataFrame(rows, "id int, par string, path string"), ["par"]).collect()}

    def brute(paths):
        segs = [p.split("/") for p in paths]
        least, pre, suf = min(map(len, segs)), 0, 0
        while pre < least - 1 and len({tuple(s[: pre + 1]) for s in segs}) == 1:
            pre += 1
        while suf < least - 1 - pre and len({s[len(s) - 1 - suf] for s in segs}) == 1:
            suf += 1
        return ["/".join(s[pre : len(s) - suf]) for s in segs]

    want, groups = {}, {}
    for i, par, path in rows:
        groups.setdefault((par, path.rsplit("/", 1)[-1]), []).append((i, path))
    for members in groups.values():
        told = brute([p for _, p in members]) if len(members) > 1 else [None]
        want |= {i: d for (i, _), d in zip(members, told)}
    assert got == want


def test_min_util_rule(spark, make):
    subs = spark.createDataFrame([("o", "1", 1, 1), ("o", "2", 1, 1)], "owner_id string, sub_id string, width int, height int")
    use = spark.createDataFrame([("o", "1")], "owner_id string, sub_id string")
    g = make({"o": ("atlas", 1, None, "ui.plist")}, []).with_(sub_items=subs, sub_usage=use)
    msg = lambda low: [v.message for v in evaluate_rules(g, [{"name": "atlas-min-util", "min": low}]).violations.collect()]
    assert msg(0.6) == ["ui.plist 50% < 60% (1/2)"] and msg(0.4) == []


def test_find_ranks_basename_first(make):
    g = make({"1": ("t", 1, None, "coin/x.png"), "2": ("t", 1, None, "ui/a_coin.png"), "3": ("t", 1, None, "ui/coin.png")}, [])
    assert [r.id for r in fl.find(g.nodes, "COIN").collect()] == ["3", "2", "1"]


def test_duplicate_rule_writes_halves_as_printf(spark, make):
    groups = spark.createDataFrame([("a", 2, 2304), ("b", 10, 2359296)], "canonical_path string, count long, reclaimable long")
    found = evaluate_rules(make(["a", "b"], []), [{"name": "no-duplicate-files", "axis": "files"}], Context(duplicates={"files": groups})).violations
    assert {r.asset: r.message for r in found.collect()} == {
        "a": "duplicate files: 1 redundant copy(ies) of a (2.2 KB)", "b": "duplicate files: 9 redundant copy(ies) of b (2.2 MB)",
    }
