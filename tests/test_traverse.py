from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from refloom.operators import reach, trees
from refloom.operators import traverse as tv
from refloom.operators.ancestry import jumps
from refloom.operators.scc import cycle_members
from refloom.operators.snapshot import snapshot, snapshot_fit
from refloom.operators.trees import dep_tree, path_to_root, path_tree, prune_tree, pruned_tree


def bfs(adj, root):
    dist, todo = {root: 0}, deque([root])
    while todo:
        u = todo.popleft()
        for v in adj.get(u, ()):
            if v not in dist:
                dist[v] = dist[u] + 1
                todo.append(v)
    return dist


def digraph(seed, n=14, m=24):
    rnd = random.Random(seed)
    ids = [f"n{i}" for i in range(n)]
    edges = sorted({(rnd.choice(ids), rnd.choice(ids)) for _ in range(m)})
    adj = {}
    for a, b in edges:
        adj.setdefault(a, []).append(b)
    return ids, edges, adj


def ids_df(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


@pytest.mark.parametrize("seed", [1])
def test_closure_matches_bfs(spark, make, seed):
    ids, edges, adj = digraph(seed)
    g = make(ids, edges)
    got = {(r.root, r.node): r.hops for r in tv.closure(g.adjacency, ids_df(spark, ids)).collect()}
    want = {(r, v): d for r in ids for v, d in bfs(adj, r).items() if v != r}
    assert got == want
    sizes = {r.id: (r.downstream, r.upstream) for r in tv.closure_sizes(g.adjacency, g.nodes).collect()}
    assert sizes == {i: (sum(1 for k in want if k[0] == i), sum(1 for k in want if k[1] == i)) for i in ids}
    approx = {r.id: (r.downstream, r.upstream) for r in tv.closure_sizes(g.adjacency, g.nodes, "approx").collect()}
    assert approx == sizes  # small sets are exact in the sketch


def test_hub_path_gives_the_same_answer(spark, make, monkeypatch):
    ids, edges, adj = digraph(3)
    g = make(ids, edges)
    for factor in (0, 1000):
        monkeypatch.setattr(tv, "HUB_FACTOR", factor)
        for cap in (None, 2):
            got = {(r.root, r.node): r.hops for r in tv.closure(g.adjacency, ids_df(spark, ids), cap).collect()}
            want = {(r, v): d for r in ids for v, d in bfs(adj, r).items() if v != r and (cap is None or d <= cap)}
            assert got == want


@pytest.mark.parametrize("seed", [4])
def test_cycle_members_match_mutual_reach(spark, make, seed):
    ids, edges, adj = digraph(seed, 12, 20)
    reach = {i: set(bfs(adj, i)) for i in ids}
    want = {}
    for i in ids:
        comp = {j for j in ids if j in reach[i] and i in reach[j]}
        if len(comp) > 1:
            want[i] = max(comp)
    got = {r.member: r.group for r in cycle_members(make(ids, edges).edges).collect()}
    assert got == want


def test_three_cycle_is_one_group_without_mutual_pair(make):
    e = make("ABC", [("A", "B"), ("B", "C"), ("C", "A")]).edges
    assert {(r.group, r.member) for r in cycle_members(e).collect()} == {("C", "A"), ("C", "B"), ("C", "C")}
    assert tv.mutual_pairs(e).count() == 0
    assert [tuple(r) for r in tv.mutual_pairs(make("AB", [("A", "B"), ("B", "A")]).edges).collect()] == [("A", "B")]


def test_forbidden_path_takes_shortest_and_needs_an_edge(make):
    g = make({k: (t, 1, None) for k, t in [("A", "from"), ("B", "mid"), ("C", "to"), ("D", "from")]}, [("A", "B"), ("B", "C"), ("C", "A")])
    p = tv.forbidden_paths(g, F.col("type").isin("from", "to"), F.col("type") == "to").collect()
    assert [(r.id, r.hops, r.path_ids) for r in p] == [("A", 2, ["A", "B", "C"])]


def test_cascade_needs_every_referrer(spark, make):
    g = make("SABCD", [("S", "A"), ("A", "B"), ("B", "A"), ("S", "C"), ("D", "C"), ("A", "D")])
    got = {r.id: r.round for r in tv.cascade_orphans(g.adjacency, ids_df(spark, "SB")).collect()}
    # A needs S and B; D needs A; C needs S and D
    assert got == {"S": 0, "B": 0, "A": 1, "D": 2, "C": 3}
    assert {r.id for r in tv.cascade_orphans(g.adjacency, ids_df(spark, "S")).collect()} == {"S"}


def test_snapshot_line(spark, make):
    ids = ["d1"] + [f"n{i}" for i in range(7)]
    edges = [("d1", "n0")] + [(f"n{i}", f"n{i + 1}") for i in range(6)]
    sites = [("n0", "n1", "use", "a", "c", "p", None), ("n4", "n5", "use", "a", "c", "p", None)]
    g = make(ids, edges, sites)
    s = snapshot(g, ids_df(spark, ["n0"]), 5, 2)
    nodes = {r.id: (r.hops, r.boundary) for r in s.nodes.collect()}
    assert nodes == {"d1": (1, False), **{f"n{i}": (i, i == 5) for i in range(6)}}
    marks = {(r.src, r.dst): (r.has_sites, r.sites_omitted) for r in s.edges.collect()}
    assert marks[("n0", "n1")] == (True, False) and marks[("n4", "n5")] == (True, True) and marks[("n1", "n2")] == (False, False)
    assert s.sites.count() == 1
    small = snapshot_fit(g, ids_df(spark, ["n0"]), 5, 2, cap=80)
    assert small.depth == 1 and not small.dropped_sites
    tiny = snapshot_fit(g, ids_df(spark, ["n0"]), 5, 2, cap=1)
    assert tiny.depth == 1 and tiny.dropped_sites and tiny.over


def test_snapshot_fit_walks_no_farther_than_its_budget(spark, make, monkeypatch):
    from refloom.operators import snapshot as module
    from refloom.plans.runtime import cut

    written = []
    monkeypatch.setattr(module, "cut", lambda df: written.append(cut(df)) or written[-1])
    hub = [("c", f"m{i}") for i in range(3)] + [(f"m{i % 3}", f"far{i}") for i in range(300)] + [("far0", "gone")]
    g = make(["c", "x"] + sorted({b for _, b in hub} - {"gone"}), hub + [("far1", "x")])
    s = snapshot_fit(g, ids_df(spark, ["c"]), 5, cap=200)
    assert s.depth == 1 and {r.id: r.boundary for r in s.nodes.collect()} == {"c": False, "m0": True, "m1": True, "m2": True}
    assert s.edges.count() == 3 and max(c.rows for c in written) == 300  # the first level that does not fit, and nothing beyond it
    # links to what is no node make no boundary
    rim = {r.id: r.boundary for r in snapshot(g, ids_df(spark, ["c"]), 2).nodes.collect()}
    assert not rim["far0"] and rim["far1"] and not rim["m0"]


def test_dep_tree_marks_revisits_and_prunes(spark, make):
    types = {"R": "r", "A": "a", "B": "b", "C": "c", "X": "x"}
    g = make({k: (t, 1, None) for k, t in types.items()}, [("R", "A"), ("R", "B"), ("A", "C"), ("B", "C"), ("C", "R"), ("C", "X")])
    rows = {(r.depth, r.parent, r.node): r.revisit for r in dep_tree(g, ids_df(spark, "R"), "out", 4).collect()}
    assert rows == {
        (1, "R", "A"): False, (1, "R", "B"): False, (2, "A", "C"): False, (2, "B", "C"): True, (3, "C", "R"): True, (3, "C", "X"): False,
    }
    kept = {(r.parent, r.node) for r in prune_tree(dep_tree(g, ids_df(spark, "R"), "out", 4), ["x"]).collect()}
    assert kept == {("R", "A"), ("R", "B"), ("A", "C"), ("B", "C"), ("C", "X")}  # C -> R is an ancestor: no verdict to inherit
    capped = {(r.parent, r.node) for r in prune_tree(dep_tree(g, ids_df(spark, "R"), "out", 4), ["x"], limit=1).collect()}
    assert capped == {("R", "A"), ("A", "C"), ("C", "X")}
    broad = {(r.parent, r.node) for r in dep_tree(g, ids_df(spark, "R"), "out", 1, breadth=1).collect()}
    assert broad == {("R", "A")}


def test_snapshots_of_two_overlapping_centers(spark, make):
    ids, edges, _ = digraph(12, 22, 30)
    near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in ids}
    sites = [(a, b, "use", f"at {a}", "c", "p", None) for a, b in edges[::3]]
    g = make(ids, edges, sites)
    s = snapshot(g, ids_df(spark, ["n0", "n3"]), 2, 1)
    got = {}
    for r in s.nodes.collect():
        got.setdefault(r.root, {})[r.id] = (r.idx, r.hops, r.boundary)
    linked = {(r.root, r.src, r.dst): (r.src_idx, r.dst_idx, r.has_sites, r.sites_omitted) for r in s.edges.collect()}
    detail = {(r.root, r.src, r.dst) for r in s.sites.collect()}
    with_sites = {(a, b) for a, b, *_ in sites}
    for root in ("n0", "n3"):
        dist = bfs(near, root)
        inner = {i: d for i, d in dist.items() if d <= 2}
        order = sorted(inner, key=lambda i: (inner[i], i))
        assert got[root] == {i: (order.index(i), inner[i], any(dist[j] == 3 for j in near[i]) and inner[i] == 2) for i in inner}
        want = {(root, a, b): (order.index(a), order.index(b), (a, b) in with_sites, (a, b) in with_sites and max(inner[a], inner[b]) > 1) for a, b in edges if a in inner and b in inner}
        assert {k: v for k, v in linked.items() if k[0] == root} == want
        assert {k for k in detail if k[0] == root} == {k for k, v in want.items() if v[2] and not v[3]}
    assert set(got["n0"]) & set(got["n3"]) and got["n0"] != got["n3"]


def brute_tree(adj, types, root, depth):
    """Rows (depth, parent, node, revisit) with the shallowest place of each node expanded, and those that reach ``types``."""
    expanded, rows, frontier, up = {root}, [], [root], {}
    for d in range(1, depth + 1):
        level = [(p, n) for p in sorted(frontier, key=lambda i: (types[i], i)) for n in sorted(adj.get(p, ()))]
        old, fresh = set(expanded), []
        for p, n in level:
            seen = n in old or (d < depth and n in fresh)
            rows.append((d, p, n, seen))
            if not seen and d < depth:
                fresh.append(n)
                expanded.add(n)
                up[n] = p
        frontier = fresh

    def loops(p, n):
        while p != n and p != root:
            p = up[p]
        return p == n

    good = {p for _, p, n, _ in rows if types[n] == "x"}
    while True:
        more = {p for _, p, n, seen in rows if n in good and not (seen and loops(p, n))} - good
        if not more:
            break
        good |= more
    kept = {r for r in rows if types[r[2]] == "x" or (r[2] in good and not (r[3] and loops(r[1], r[2])))}
    return set(rows), kept


@pytest.mark.parametrize("seed", [3, 4])
def test_trees_with_paths_of_unequal_length(spark, make, seed):
    rnd = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(26)]
    edges = sorted({(rnd.choice(ids), rnd.choice(ids)) for _ in range(48)})
    types = {i: rnd.choice(["x", "a", "a", "a"]) for i in ids}
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
    g = make({i: (types[i], 1, None) for i in ids}, edges)
    roots = ids[:6]
    rows = lambda df: {(r.root, r.depth, r.parent, r.node, r.revisit) for r in df.collect()}
    for depth in (2, 5):
        tree = dep_tree(g, ids_df(spark, roots), "out", depth)
        want = [brute_tree(adj, types, r, depth) for r in roots]
        assert rows(tree) == {(r, *row) for r, w in zip(roots, want) for row in w[0]}
        kept = {(r, *row) for r, w in zip(roots, want) for row in w[1]}
        assert rows(prune_tree(tree, ["x"])) == kept and rows(pruned_tree(g, ids_df(spark, roots), ["x"], "out", depth)) == kept
    assert any(r[4] for r in kept)
    assert rows(pruned_tree(g, ids_df(spark, roots), ["x"], "out", 5, limit=2)) == rows(prune_tree(tree, ["x"], limit=2))
    assert pruned_tree(g, ids_df(spark, roots), ["no such type"], "out", 3).count() == 0


def test_path_tree_expands_every_path_until_a_cycle(spark, make):
    g = make({"R": ("r", 1, None), "A": ("a", 1, None), "B": ("b", 1, None), "C": ("c", 1, None)}, [("R", "A"), ("R", "B"), ("A", "C"), ("B", "C"), ("C", "A")])
    t = path_tree(g, ids_df(spark, "R"))
    got = {"".join(r.path_ids): (r.cycle, r.has_kids) for r in t.collect()}
    assert got == {"RA": (False, True), "RAC": (False, True), "RACA": (True, False), "RB": (False, True), "RBC": (False, True), "RBCA": (False, True), "RBCAC": (True, False)}
    only = {"".join(r.path_ids) for r in path_tree(g, ids_df(spark, "R"), types=["b"]).collect()}
    assert only == {"RB"}
    crumbs = {"".join(r.crumb) for r in path_to_root(t, g.nodes, "in").collect()}
    assert "CAR" in crumbs


def test_positions_survive_a_hot_group(spark):
    from refloom.plans.ordering import positions_within

    rows = [("hot", i) for i in range(500)] + [("cold", i) for i in range(3)] + [(None, 7)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(7)
    got = {(r.g, r.k): r.pos for r in positions_within(df, ["g"], ["k"]).collect()}
    assert got == {**{("hot", i): i for i in range(500)}, **{("cold", i): i for i in range(3)}, (None, 7): 0}


def test_checkpoint_folder_comes_from_the_session(spark):
    from refloom.plans.runtime import cut, ensure_checkpoint_dir

    assert spark.conf.get("spark.checkpoint.dir") in ensure_checkpoint_dir(spark)
    c = cut(spark.range(10))
    assert (c.rows, c.empty) == (10, False)


def test_long_chain_of_components_ends(spark, make):
    # 4 two-cycles in a chain whose ids fall along it
    names = [f"n{999 - i:03d}" for i in range(8)]
    edges = [(names[i], names[i + 1]) for i in range(7)] + [(names[i + 1], names[i]) for i in range(0, 8, 2)]
    got = {r.member: r.group for r in cycle_members(make(names, edges).edges).collect()}
    assert got == {names[i + k]: max(names[i], names[i + 1]) for i in range(0, 8, 2) for k in (0, 1)}


def test_parent_chains_by_doubling(spark):
    rnd = random.Random(8)
    up = {f"n{i}": f"n{rnd.randrange(max(0, i - 6), i)}" for i in range(1, 120)}
    up |= {f"c{i}": f"c{i - 1}" for i in range(1, 70)}
    up |= {"x": "y", "y": "z", "z": "x", "below": "x", "self": "self"}
    parents = spark.createDataFrame(list(up.items()), "child string, parent string")

    def above(n):
        out = []
        while n in up and up[n] not in out:
            n = up[n]
            out.append(n)
        return out

    ids = sorted(set(up) | set(up.values()))
    pairs = [(rnd.choice(ids), rnd.choice(ids)) for _ in range(150)] + [(a, c) for c in ("c69", "below", "x", "n119", "self") for a in above(c)[:9]] + [("n0", "n0"), ("nobody", "n5"), ("n0", "nobody")]
    pairs = sorted(set(pairs))
    got = {(r.ancestor, r.candidate): r.descendant for r in tv.is_descendant(spark.createDataFrame(pairs, "ancestor string, candidate string"), parents).collect()}
    assert got == {(a, c): a != c and a in above(c) for a, c in pairs}
    seeds = ["n0", "n60", "c0", "c40", "x", "below", "leaf"]
    got = {(r.root, r.node) for r in tv.subtree(parents, ids_df(spark, seeds)).collect()}
    assert got == {(s, s) for s in seeds} | {(s, n) for n in ids for s in seeds if s in above(n)}
    chain = spark.createDataFrame([(f"{i}", f"{i - 1}") for i in range(1, 1000)], "child string, parent string")
    found = jumps(chain)
    assert len(found.up) == 10 and found.looped is None and {r.node: r.depth for r in found.depth.collect()}["999"] == 999


def test_trees_count_only_the_links_they_need(spark, make):
    """no tree asks for the counts of all links; weights are those of the edges all the same."""
    g = make({"R": ("a", 1, None), "A": ("a", 1, None), "X": ("x", 1, None)}, [("R", "A"), ("R", "A"), ("A", "X"), ("X", "gone")])
    never = g.edges.withColumn("weight", F.raise_error(F.lit("all links were counted")).cast("long"))
    lazy = g.with_(edges=never, counted=(never, g.links))
    rows = {(r.depth, r.parent, r.node, r.weight, r.revisit) for r in dep_tree(lazy, ids_df(spark, "R"), "out", 3).collect()}
    assert rows == {(1, "R", "A", 2, False), (2, "A", "X", 1, False)}
    assert {(r.depth, r.node, r.weight) for r in pruned_tree(lazy, ids_df(spark, "R"), ["x"], "out", 2).collect()} == {(1, "A", 2), (2, "X", 1)}
    own = g.with_(edges=g.edges.withColumn("weight", F.lit(7).cast("long")))
    assert {r.weight for r in dep_tree(own, ids_df(spark, "R"), "out", 1).collect()} == {7}


def hub_graph(sources=150, leaves=12):
    """Many sources, each with links to most leaves and to two of six members of three hubs, which lead on to one end."""
    rnd = random.Random(5)
    edges = [(f"s{i}", f"p{k}") for i in range(sources) for k in range(leaves) if rnd.random() < 0.8]
    edges += [(f"s{i}", f"m{k}") for i in range(sources) for k in rnd.sample(range(6), 2)]
    return edges + [(f"m{k}", f"h{k % 3}") for k in range(6)] + [(f"h{k}", "end") for k in range(3)]


def written(monkeypatch, modules):
    from refloom.plans.runtime import cut

    rows = []
    for m in modules:
        monkeypatch.setattr(m, "cut", lambda df: rows.append(cut(df)) or rows[-1])
    return rows


def brute_counts(edges):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
    ids = {i for e in edges for i in e}
    return {i: set(bfs(adj, i)) - {i} for i in ids}


def test_exact_closure_sizes_store_no_pairs(spark, make, monkeypatch):
    """links were rewritten at each level and (node, word) sets of all sources were kept."""
    edges = hub_graph()
    want = brute_counts(edges)
    g = make(sorted(want), edges + edges[:50])
    rows = written(monkeypatch, [tv, reach])
    got = {r.id: (r.downstream, r.upstream) for r in tv.closure_sizes(g.adjacency, g.nodes).collect()}
    assert got == {i: (len(want[i]), sum(i in w for w in want.values())) for i in want}
    assert max(c.rows for c in rows) < len(edges) / 3


@pytest.mark.parametrize("one_mark", [False, True])
def test_closure_sizes_with_cycles_and_equal_hashes(spark, make, monkeypatch, one_mark):
    if one_mark:  # all targets have the same hash, so none is known to be an only child
        monkeypatch.setattr(reach, "_mark", lambda c: F.length(F.lit("same")).cast("long"))
    _, edges, _ = digraph(7, 40, 50)
    edges += [("a0", "a1"), ("a1", "a2"), ("a2", "a0"), ("a2", "tail"), ("top", "a1"), ("top", "top")]
    want = brute_counts(edges)
    g = make([*sorted(want), "alone"], edges)
    got = {r.id: (r.downstream, r.upstream) for r in tv.closure_sizes(g.adjacency, g.nodes).collect()}
    assert got == {"alone": (0, 0)} | {i: (len(want[i]), sum(i in w for w in want.values())) for i in want}
    assert tv.closure_sizes(g.adjacency.limit(0), g.nodes).agg(F.sum(F.col("downstream") + F.col("upstream"))).first()[0] == 0


def test_sketches_move_the_core_alone(spark, make, monkeypatch):
    """every round wrote a sketch of every node."""
    edges = hub_graph(400)
    want = brute_counts(edges)
    g = make(sorted(want), edges)
    rows = written(monkeypatch, [tv, reach])
    got = {r.id: (r.downstream, r.upstream) for r in tv.closure_sizes(g.adjacency, g.nodes, "approx", 14).collect()}
    exact = {i: (len(want[i]), sum(i in w for w in want.values())) for i in want}
    assert all(abs(a - b) <= 0.02 * b for i in want for a, b in zip(got[i], exact[i]))
    assert sum(c.rows for c in rows) < len(want)


def test_sketches_with_cycles(spark, make):
    _, edges, _ = digraph(11, 30, 36)
    edges += [("a0", "a1"), ("a1", "a0"), ("a1", "tail"), ("top", "a0"), ("top", "top")]
    want = brute_counts(edges)
    g = make([*sorted(want), "alone"], edges)
    got = {r.id: (r.downstream, r.upstream) for r in tv.closure_sizes(g.adjacency, g.nodes, "approx").collect()}
    assert got == {"alone": (0, 0)} | {i: (len(want[i]), sum(i in w for w in want.values())) for i in want}


def reported(spark, g, roots, want, facts, types=None):
    """(rows of the closure report, rows by brute force)."""
    got = {(r.root, r.type): (r.n, r.total_size) for r in tv.closure_report(g, ids_df(spark, roots), types).collect()}
    per = {}
    for i in roots:
        for j in want.get(i, ()):
            if j in facts and (types is None or facts[j][0] in types):
                n, size = per.get((i, facts[j][0]), (0, 0))
                per[i, facts[j][0]] = n + 1, size + facts[j][1]
    return got, per


def test_closure_report_stores_no_pairs(spark, make, monkeypatch):
    """the pairs of the first hop were written, and all pairs were shuffled after it."""
    edges = hub_graph()
    want = brute_counts(edges)
    facts = {i: (i[0], len(i)) for i in want}
    g = make({i: (*f, None) for i, f in facts.items()}, edges + edges[:50])
    monkeypatch.setattr(tv, "BROADCAST_BYTES", 0)
    rows = written(monkeypatch, [tv, reach])
    got, per = reported(spark, g, sorted(i for i in want if i[0] == "s"), want, facts)
    assert got == per and max(c.rows for c in rows) < len(edges) / 3


def test_closure_report_with_cycles_and_missing_nodes(spark, make, monkeypatch):
    """Both ways to the report; unknown nodes lead on but do not count, a missing type is a type, roots may reach each other."""
    _, edges, _ = digraph(8, 40, 50)
    edges += [("a0", "a1"), ("a1", "a2"), ("a2", "a0"), ("a2", "gone"), ("gone", "tail"), ("top", "a1"), ("top", "top")]
    want = brute_counts(edges)
    facts = {i: (None if k % 5 == 0 else "tu"[k % 2], k) for k, i in enumerate(sorted(want)) if i != "gone"}
    g = make({i: (*f, None) for i, f in facts.items()}, edges)
    for most in (0, 1 << 20):
        monkeypatch.setattr(tv, "BROADCAST_BYTES", most)
        got, per = reported(spark, g, [*sorted(want), "nowhere"], want, facts)
        assert got == per


def test_filtered_report_passes_through_other_types(spark, make, monkeypatch):
    """as F2, where the types in between are not asked for."""
    edges = hub_graph()
    want = brute_counts(edges)
    facts = {i: (i[0], len(i)) for i in want}
    g = make({i: (*f, None) for i, f in facts.items()}, edges)
    monkeypatch.setattr(tv, "BROADCAST_BYTES", 0)
    rows = written(monkeypatch, [tv, reach])
    got, per = reported(spark, g, sorted(i for i in want if i[0] == "s"), want, facts, ["p", "e"])
    assert got == per and {t for _, t in got} == {"p", "e"} and max(c.rows for c in rows) < len(edges) / 3


def test_pruned_tree_of_whole_depth(spark, make, monkeypatch):
    """the query stopped at two hops; places met twice in one level need no second pass over the tree."""
    from refloom.workload.traversal import dep_tree_pruned

    deep = {r.depth: r.node_type for r in dep_tree_pruned(spark, "/root/testdata/sf0.001").orderBy("depth").collect()}
    assert deep[2] == "nation" and deep[3] == "region"
    edges = hub_graph(20) + [("p0", "h0"), ("p1", "p2"), ("s0", "s1")]
    ids = sorted({i for e in edges for i in e})
    g = make({i: (i[0], 1, None) for i in ids}, edges)
    roots = ids_df(spark, [f"s{i}" for i in range(2, 20)])
    rows = lambda df: sorted((r.root, r.depth, r.parent, r.node, r.weight, r.revisit) for r in df.collect())
    want = rows(prune_tree(dep_tree(g, roots, "out", 3), ["e"]))
    assert len({r[0] for r in want}) == 18 and any(r[-1] for r in want) and {r[1] for r in want} == {1, 2, 3}
    monkeypatch.setattr(trees, "_prune", lambda *a: pytest.fail("walked the tree again"))
    assert rows(pruned_tree(g, roots, ["e"], "out", 3)) == want
