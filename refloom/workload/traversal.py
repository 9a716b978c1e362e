"""Traversal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.operators import traverse as tv
from refloom.operators.filters import node_table as _node_table
from refloom.operators.reach import heads_of
from refloom.operators.scc import cycle_groups as _cycle_groups
from refloom.operators.scc import cycle_members as _cycle_members
from refloom.operators.snapshot import snapshot, snapshot_fit as _fit, snapshot_nodes
from refloom.operators.trees import count_matches, dep_tree as _dep_tree, path_to_root, path_tree as _path_tree, pruned_tree
from refloom.workload.base import query, rows_as
from refloom.workload.inputs import STAR, TRADE, star_graph, table, trade_graph

REACH = f"""WITH RECURSIVE {STAR},
walk AS (SELECT id AS root, id AS node FROM nodes WHERE %s UNION SELECT root, links.%s FROM walk JOIN links ON links.%s = node),
reach AS (SELECT * FROM walk WHERE root <> node)"""


def _ids(g, type_):
    return g.nodes.where(F.col("type") == type_).select("id")


@query(REACH % ("type = 'order'", "dst", "src") + """
SELECT type, count(DISTINCT root) AS roots, count(*) AS n, sum(size)::BIGINT AS total_size FROM reach JOIN nodes ON id = node GROUP BY type""")
def closure_by_type(spark, sf):
    """What every order transitively pulls in, counted and sized by type."""
    g = star_graph(spark, sf)
    per = tv.closure_report(g, _ids(g, "order"))
    return per.groupBy("type").agg(rows_as("roots"), F.sum("n").alias("n"), F.sum("total_size").alias("total_size"))


@query(REACH % ("type = 'order'", "dst", "src") + """
SELECT type, max(n) AS max_n, min(n) AS min_n FROM (SELECT root, type, count(*) AS n FROM reach JOIN nodes ON id = node WHERE type IN ('part', 'region') GROUP BY ALL) GROUP BY type""")
def closure_filtered(spark, sf):
    g = star_graph(spark, sf)
    per = tv.closure_report(g, _ids(g, "order"), ["part", "region"])
    return per.groupBy("type").agg(F.max("n").alias("max_n"), F.min("n").alias("min_n"))


@query(REACH % ("type IN ('supplier', 'nation')", "src", "dst") + """
SELECT root, type, count(*) AS n FROM reach JOIN nodes ON id = node GROUP BY ALL""")
def blast_radius(spark, sf):
    """Everything that depends on each supplier and nation, by type."""
    g = star_graph(spark, sf)
    hit = tv.dependents(g.adjacency, g.nodes.where(F.col("type").isin("supplier", "nation")).select("id"))
    return hit.join(g.nodes.select(F.col("id").alias("node"), "type"), "node").groupBy("root", "type").agg(rows_as("n"))


@query(f"""WITH {STAR},
d AS (SELECT id, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o FROM (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY id)
SELECT type, count(*) AS n, sum(i)::BIGINT AS in_sum, max(i) AS in_max, sum(o)::BIGINT AS out_sum, max(o) AS out_max FROM d JOIN nodes USING (id) GROUP BY type""")
def degrees(spark, sf):
    g = star_graph(spark, sf)
    d = tv.degrees(g.edges).join(g.nodes.select("id", "type"), "id")
    return d.groupBy("type").agg(
        rows_as("n"), F.sum("in_degree").alias("in_sum"), F.max("in_degree").alias("in_max"), F.sum("out_degree").alias("out_sum"), F.max("out_degree").alias("out_max")
    )


@query(f"""WITH {STAR}
SELECT src AS id, 'out' AS dir, kind, count(*) AS n, sum(weight)::BIGINT AS weight FROM edges WHERE src IN (SELECT id FROM nodes WHERE type IN ('nation', 'supplier')) GROUP BY ALL
UNION ALL SELECT dst, 'in', kind, count(*), sum(weight)::BIGINT FROM edges WHERE dst IN (SELECT id FROM nodes WHERE type IN ('nation', 'supplier')) GROUP BY ALL""")
def neighbors(spark, sf):
    g = star_graph(spark, sf)
    hood = tv.neighbors(g.edges, g.nodes.where(F.col("type").isin("nation", "supplier")).select("id"))
    return hood.groupBy("id", "dir", "kind").agg(rows_as("n"), F.sum("weight").alias("weight"))


@query(f"""WITH {STAR},
h AS (SELECT e.src AS id, 'out' AS dir, dst AS other, kind, weight FROM edges e WHERE src IN (SELECT id FROM nodes WHERE type = 'customer')
  UNION ALL SELECT dst, 'in', src, kind, weight FROM edges WHERE dst IN (SELECT id FROM nodes WHERE type = 'customer'))
SELECT h.id, dir, n.path AS other_path, n.type AS other_type, kind, weight,
  row_number() OVER (PARTITION BY h.id, dir ORDER BY n.type, regexp_extract(n.path, '[^/]*$'), n.path, kind)::INTEGER AS rank
FROM h JOIN nodes n ON n.id = other QUALIFY rank <= 3""")
def deps_top(spark, sf):
    """The first three neighbours of every customer on each side, by (type, name)."""
    g = star_graph(spark, sf)
    out = tv.deps(g, _ids(g, "customer"), limit=3)
    return out.select("id", "dir", "other_path", "other_type", "kind", "weight", "rank")


@query(f"""WITH {STAR}
SELECT id, path, type, size, (SELECT count(*) FROM edges WHERE dst = id) AS in_degree, (SELECT count(*) FROM edges WHERE src = id) AS out_degree
FROM nodes WHERE type IN ('customer', 'nation')""")
def node_info(spark, sf):
    g = star_graph(spark, sf)
    info = tv.node_info(g, g.nodes.where(F.col("type").isin("customer", "nation")).select("id"))
    return info.select("id", "path", "type", "size", "in_degree", "out_degree")


@query(REACH % ("TRUE", "dst", "src") + """,
down AS (SELECT root AS id, count(*) AS downstream FROM reach GROUP BY 1), up AS (SELECT node AS id, count(*) AS upstream FROM reach GROUP BY 1)
SELECT id, regexp_extract(path, '[^/]*$') AS base, type, size, coalesce(i, 0) AS in_degree, coalesce(upstream, 0) AS upstream, coalesce(o, 0) AS out_degree, coalesce(downstream, 0) AS downstream
FROM nodes LEFT JOIN (SELECT src AS id, count(*) AS o FROM edges GROUP BY 1) USING (id) LEFT JOIN (SELECT dst AS id, count(*) AS i FROM edges GROUP BY 1) USING (id)
LEFT JOIN down USING (id) LEFT JOIN up USING (id)""")
def node_table(spark, sf):
    """Every node with its degrees and both closure sizes."""
    g = star_graph(spark, sf)
    return _node_table(g).select("id", "base", "type", "size", "in_degree", "upstream", "out_degree", "downstream")


@query(f"WITH {STAR} SELECT type, count(*) AS nodes, count(*) AS close FROM nodes GROUP BY type")
def closure_sizes_approx(spark, sf):
    """Sketched closure sizes of all nodes, and how many are within 10 % of the exact ones."""
    g = star_graph(spark, sf)
    heads = heads_of(g.adjacency)
    approx = tv.closure_sizes(g.adjacency, g.nodes, "approx", heads=heads).withColumnsRenamed({"downstream": "d", "upstream": "u"})
    both = tv.closure_sizes(g.adjacency, g.nodes, heads=heads).join(approx, "id").join(g.nodes.select("id", "type"), "id")
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.col(b) * 0.1 + 1
    return both.groupBy("type").agg(rows_as("nodes"), F.count_if(near("d", "downstream") & near("u", "upstream")).alias("close"))


HOOD = f"""WITH RECURSIVE {STAR},
pairs AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links),
hood AS (SELECT id AS root, id AS node, 0 AS hops FROM nodes WHERE type = '%s' UNION SELECT root, dst, hops + 1 FROM hood JOIN pairs ON src = node WHERE hops < %d),
near AS (SELECT root, node, min(hops) AS hops FROM hood GROUP BY ALL)"""


@query(HOOD % ("region", 2) + " SELECT root, type, hops, count(*) AS n FROM near JOIN nodes ON id = node GROUP BY ALL")
def neighborhood(spark, sf):
    """Nodes within two undirected hops of every region."""
    g = star_graph(spark, sf)
    hood = tv.neighborhood(g.adjacency, _ids(g, "region"), 2)
    return hood.join(g.nodes.select(F.col("id").alias("node"), "type"), "node").groupBy("root", "type", "hops").agg(rows_as("n"))


SNAP = f"""WITH RECURSIVE {STAR},
pairs AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links),
hood AS (SELECT id AS node, 0 AS hops FROM nodes WHERE path = 'region/ASIA' UNION SELECT dst, hops + 1 FROM hood JOIN pairs ON src = node WHERE hops < 2),
near AS (SELECT node, min(hops) AS hops FROM hood GROUP BY ALL),
marked AS (SELECT node, hops, EXISTS (SELECT 1 FROM pairs WHERE src = node AND dst NOT IN (SELECT node FROM near)) AS boundary FROM near)"""


@query(SNAP + " SELECT type, hops, boundary, count(*) AS n FROM marked JOIN nodes ON id = node GROUP BY ALL")
def snapshot_boundary(spark, sf):
    """The neighbourhood of one region with the nodes whose neighbours were trimmed."""
    g = star_graph(spark, sf)
    n = snapshot_nodes(g, g.nodes.where(F.col("path") == "region/ASIA").select("id"), 2)
    return n.groupBy("type", "hops", "boundary").agg(rows_as("n"))


@query(SNAP + """, numbered AS (SELECT node, row_number() OVER (ORDER BY hops, path, id) - 1 AS idx FROM near JOIN nodes ON id = node)
SELECT kind, count(*) AS n, sum(a.idx)::BIGINT AS src_sum, sum(b.idx)::BIGINT AS dst_sum FROM edges JOIN numbered a ON a.node = src JOIN numbered b ON b.node = dst GROUP BY kind""")
def snapshot_edges(spark, sf):
    """The induced edges of the same neighbourhood, with nodes interned as positions."""
    g = star_graph(spark, sf)
    s = snapshot(g, g.nodes.where(F.col("path") == "region/ASIA").select("id"), 2)
    return s.edges.groupBy("kind").agg(rows_as("n"), F.sum("src_idx").alias("src_sum"), F.sum("dst_idx").alias("dst_sum"))


@query(SNAP.replace("hops < 2", "hops < 4") + """,
sz AS (SELECT h, sum(c)::BIGINT AS c FROM (
  SELECT hops AS h, length(path) + 12 AS c FROM near JOIN nodes ON id = node
  UNION ALL SELECT greatest(a.hops, b.hops), 12 FROM edges JOIN near a ON a.node = src JOIN near b ON b.node = dst) GROUP BY h),
fit AS (SELECT max(d.d) AS depth FROM (SELECT unnest([1, 2, 3]) AS d) d WHERE (SELECT sum(c) FROM sz WHERE h <= d.d) <= 262144)
SELECT coalesce((SELECT depth FROM fit), 1)::INTEGER AS depth, count(*) AS nodes FROM near WHERE hops <= coalesce((SELECT depth FROM fit), 1)""")
def snapshot_fit(spark, sf):
    """The deepest neighbourhood of one region that fits the default budget."""
    g = star_graph(spark, sf)
    s = _fit(g, g.nodes.where(F.col("path") == "region/ASIA").select("id"), 3)
    return s.nodes.agg(F.lit(s.depth).alias("depth"), rows_as("nodes"))


@query(f"""WITH {STAR},
l1 AS (SELECT e.dst AS root, e.src AS node FROM edges e JOIN nodes n ON n.id = e.dst WHERE n.type = 'region'),
l2 AS (SELECT root, e.src AS node FROM l1 JOIN edges e ON e.dst = l1.node),
l3 AS (SELECT root, e.src AS node FROM l2 JOIN edges e ON e.dst = l2.node)
SELECT root, depth, type AS node_type, revisit, count(*) AS n FROM (
  SELECT root, 1 AS depth, node, false AS revisit FROM l1 UNION ALL SELECT root, 2, node, false FROM l2 UNION ALL SELECT root, 3, node, false FROM l3
) JOIN nodes ON id = node GROUP BY ALL""")
def dep_tree(spark, sf):
    """Who uses each region, three hops up, every node expanded once."""
    g = star_graph(spark, sf)
    t = _dep_tree(g, _ids(g, "region"), "in", 3)
    return t.groupBy("root", "depth", "node_type", "revisit").agg(rows_as("n"))


PRUNED = f"""WITH {STAR},
l1 AS (SELECT src AS root, dst AS node, kind FROM edges JOIN nodes ON id = src WHERE type = 'order'),
first1 AS (SELECT DISTINCT root, node FROM l1),
l2 AS (SELECT f.root, f.node AS parent, e.dst AS node FROM first1 f JOIN edges e ON e.src = f.node JOIN nodes n ON n.id = e.dst WHERE n.type = 'nation')"""


@query(f"""WITH {STAR},
l1 AS (SELECT src AS root, dst AS node FROM edges JOIN nodes ON id = src WHERE type = 'order'),
l2 AS (SELECT f.root, f.node AS parent, e.dst AS node FROM (SELECT DISTINCT root, node FROM l1) f JOIN edges e ON e.src = f.node),
l3 AS (SELECT f.root, f.node AS parent, e.dst AS node FROM (SELECT DISTINCT root, node FROM l2) f JOIN edges e ON e.src = f.node JOIN nodes n ON n.id = e.dst WHERE n.type = 'region'),
k2 AS (SELECT * FROM l2 WHERE (root, node) IN (SELECT root, parent FROM l3))
SELECT depth, type AS node_type, count(*) AS n FROM (
  SELECT 1 AS depth, node FROM l1 WHERE (root, node) IN (SELECT root, parent FROM k2)
  UNION ALL SELECT 2, node FROM k2 UNION ALL SELECT 3, node FROM l3) JOIN nodes ON id = node GROUP BY ALL""")
def dep_tree_pruned(spark, sf):
    """The whole tree of every order, three hops deep, cut to branches that reach a region."""
    g = star_graph(spark, sf)
    t = pruned_tree(g, _ids(g, "order"), ["region"], "out", 3)
    return t.groupBy("depth", "node_type").agg(rows_as("n"))


@query(PRUNED + " SELECT matches, count(*) AS orders FROM (SELECT root, count(*) AS matches FROM l2 GROUP BY root) GROUP BY matches")
def tree_matches(spark, sf):
    g = star_graph(spark, sf)
    t = pruned_tree(g, _ids(g, "order"), ["nation"], "out", 2)
    return count_matches(t, ["nation"]).groupBy("matches").agg(rows_as("orders"))


PATHS = f"""WITH {STAR},
l1 AS (SELECT DISTINCT e.dst AS root, e.src AS node FROM edges e JOIN nodes n ON n.id = e.dst WHERE n.type = 'region'),
l2 AS (SELECT DISTINCT root, l1.node AS up, e.src AS node FROM l1 JOIN edges e ON e.dst = l1.node),
k2 AS (SELECT l2.* FROM l2 JOIN nodes ON id = node WHERE type = 'customer' AND contains(lower(path), 'building'))"""


@query(PATHS + """
SELECT root, 2 AS depth, 'customer' AS node_type, false AS has_kids, count(*) AS n FROM k2 GROUP BY ALL
UNION ALL SELECT root, 1, 'nation', true, count(*) FROM l1 WHERE (root, node) IN (SELECT root, up FROM k2) GROUP BY ALL""")
def path_tree(spark, sf):
    """All two-hop paths into each region that end at a customer of one segment."""
    g = star_graph(spark, sf)
    t = _path_tree(g, _ids(g, "region"), "in", 2, ["customer"], "building")
    return t.groupBy("root", "depth", "node_type", "has_kids").agg(rows_as("n"))


@query(PATHS + " SELECT k2.node || ' > ' || up || ' > ' || root AS crumb FROM k2")
def breadcrumbs(spark, sf):
    """The chain from every matching customer to the region, dependents first."""
    g = star_graph(spark, sf)
    t = _path_tree(g, _ids(g, "region"), "in", 2, ["customer"], "building").where(F.col("depth") == 2)
    return path_to_root(t, g.nodes, "in").select(F.array_join("crumb", " > ").alias("crumb"))


@query(f"WITH {TRADE} SELECT a.src AS a, a.dst AS b FROM cedges a JOIN cedges b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def mutual_pairs(spark, sf):
    """Nations that trade with each other in both directions."""
    g = trade_graph(spark, sf)
    from refloom.operators.containers import container_edges

    return tv.mutual_pairs(container_edges(g))


CYCLES = f"""WITH RECURSIVE {TRADE},
r AS (SELECT src AS a, dst AS b FROM cedges UNION SELECT a, dst FROM r JOIN cedges ON src = b),
m AS (SELECT x.a AS member, max(greatest(x.a, x.b)) AS grp FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY 1)"""


@query(CYCLES + " SELECT grp AS \"group\", count(*) AS size, min(member) AS first, max(member) AS last FROM m GROUP BY grp")
def cycle_groups(spark, sf):
    """Cycles among all trade links of the nations."""
    from refloom.operators.containers import container_edges

    return _cycle_groups(container_edges(trade_graph(spark, sf)))


@query(CYCLES + " SELECT grp AS \"group\", member FROM m")
def cycle_members(spark, sf):
    from refloom.operators.containers import container_edges

    return _cycle_members(container_edges(trade_graph(spark, sf)))


FORBID = f"""WITH {STAR},
n AS (SELECT e.src AS id, path FROM edges e JOIN nodes ON id = e.src WHERE dst = (SELECT id FROM nodes WHERE path = 'region/AFRICA')),
c AS (SELECT DISTINCT e.src AS id FROM edges e JOIN n ON n.id = e.dst)"""


@query(FORBID + """
SELECT o.id, 3 AS hops, (SELECT id FROM nodes WHERE path = 'region/AFRICA') AS target
FROM nodes o WHERE o.type = 'order' AND o.path LIKE 'orders/1-URGENT/%' AND EXISTS (SELECT 1 FROM edges e JOIN c ON c.id = e.dst WHERE e.src = o.id)""")
def forbidden_paths(spark, sf):
    """Urgent orders that reach one region over any chain."""
    from refloom.functions.matching import match_nodes

    g = star_graph(spark, sf)
    p = tv.forbidden_paths(g, match_nodes({"type": "order", "pathStartsWith": "orders/1-URGENT/"}), match_nodes({"basename": "AFRICA"}))
    return p.select("id", "hops", "target")


@query("""WITH seeds AS (SELECT 'O' || o_orderkey AS id, 'C' || o_custkey AS c, o_orderpriority <> '1-URGENT' AS s FROM orders),
cust AS (SELECT c AS id FROM seeds GROUP BY c HAVING bool_and(s)),
refs AS (SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS dst FROM customer UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier),
nat AS (SELECT dst AS id FROM refs GROUP BY dst HAVING bool_and(src IN (SELECT id FROM cust)))
SELECT 0 AS round, count(*) AS n FROM seeds WHERE s UNION ALL SELECT 1, count(*) FROM cust HAVING count(*) > 0 UNION ALL SELECT 2, count(*) FROM nat HAVING count(*) > 0""")
def cascade_orphans(spark, sf):
    """What nothing else needs once every order that is not urgent goes."""
    g = star_graph(spark, sf, {"placed-by", "in-nation"})
    seed = g.nodes.where((F.col("type") == "order") & ~F.col("path").startswith("orders/1-URGENT/")).select("id")
    return tv.cascade_orphans(g.adjacency, seed).groupBy("round").agg(rows_as("n"))


def _turn(c):
    return F.concat_ws("#", F.col("conv_id").cast("string"), c.cast("string"))


@query("SELECT conv_id || '#0' AS root, count(*) AS n FROM conversations GROUP BY conv_id")
def subtree(spark, sf):
    """Each conversation's first turn with everything that follows it."""
    c = table(spark, sf, "conversations")
    parents = c.where(F.col("turn") > 0).select(_turn(F.col("turn")).alias("child"), _turn(F.col("turn") - 1).alias("parent"))
    return tv.subtree(parents, c.where(F.col("turn") == 0).select(_turn(F.col("turn")).alias("id"))).groupBy("root").agg(rows_as("n"))


@query("""SELECT conv_id || '#' || a AS ancestor, conv_id || '#' || b AS candidate, a < b AS descendant
FROM (SELECT conv_id, 1 AS a, max(turn) AS b FROM conversations GROUP BY 1)""")
def is_descendant(spark, sf):
    """Whether the last turn of each conversation comes below its second one."""
    c = table(spark, sf, "conversations")
    parents = c.where(F.col("turn") > 0).select(_turn(F.col("turn")).alias("child"), _turn(F.col("turn") - 1).alias("parent"))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return tv.is_descendant(last.select(_turn(F.lit(1)).alias("ancestor"), _turn(F.col("turn")).alias("candidate")), parents)


