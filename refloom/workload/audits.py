"""Reports, containers, filters and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.functions.scalar import human_size as _human_size
from refloom.functions.scalar import (
    base, dir_of, ext_of, insert_at, is_permutation, is_uuid, main_id, normalize_path, permute, remove_at, strip_ext, sub_id,
)
from refloom.functions.matching import match_nodes
from refloom.model import Graph
from refloom.operators import containers as ct
from refloom.operators import filters as fl
from refloom.operators import reports as rp
from refloom.operators.extractors import add_virtual_nodes, union_edges
from refloom.operators.rules import Context, evaluate_rules
from refloom.operators.traverse import degrees, filter_kinds
from refloom.operators.traverse import mutual_pairs as _mutual
from refloom.plans.ordering import global_positions, positions_within
from refloom.sources.tables import key
from refloom.workload.duplicates import GROUPS
from refloom.workload.base import query, rows_as
from refloom.workload.inputs import STAR, TRADE, WEB, star_graph, table, trade_graph, web_nodes, web_refs

# ---- summaries and sizes -------------------------------------------------------------------------


@query(f"""WITH {STAR}
SELECT 'total' AS section, 'nodes' AS key, count(*) AS n FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM edges
UNION ALL SELECT 'type', type, count(*) FROM nodes GROUP BY type UNION ALL SELECT 'kind', kind, count(*) FROM edges GROUP BY kind""")
def summary(spark, sf):
    return rp.summary(star_graph(spark, sf))


@query(f"WITH {STAR} SELECT type, count(*) AS n, sum(size)::BIGINT AS size FROM nodes GROUP BY type")
def size_by_type(spark, sf):
    return rp.size_report(star_graph(spark, sf))


@query(f"WITH {STAR} SELECT id, path, type, size FROM nodes WHERE type IN ('order', 'part') ORDER BY size DESC, path LIMIT 25")
def largest(spark, sf):
    return rp.largest(star_graph(spark, sf), ["order", "part"], 25)


@query(f"WITH {STAR} SELECT kind AS key, count(*) AS n FROM edges GROUP BY kind")
def edge_kind_histogram(spark, sf):
    return fl.histogram(star_graph(spark, sf).edges, "kind")


def _labelled_docs(spark, sf) -> Graph:
    """Documents in one container per language (English is the default one); labels refer to them."""
    d = table(spark, sf, "documents")
    nodes = d.select(
        key("D", "doc_id").alias("id"), F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string")).alias("path"), F.lit("document").alias("type"),
        F.col("n_chars").alias("size"), F.when(F.col("lang") == "en", F.lit("main")).otherwise(F.col("lang")).alias("container"),
    )
    lab = table(spark, sf, "labels")
    nodes = nodes.unionByName(
        lab.select(key("L", "doc_id").alias("id"), F.concat(F.lit("labels/"), F.col("doc_id").cast("string")).alias("path"), F.lit("label").alias("type"),
                   F.lit(0).cast("long").alias("size"), F.lit("main").alias("container"))
    )
    links = lab.select(key("L", "doc_id").alias("src"), key("D", "doc_id").alias("dst"), F.lit("labels").alias("kind"))
    return Graph.from_links(nodes, links)


@query("""SELECT 'D' || doc_id AS id, source || '/' || doc_id AS path, 'document' AS type, n_chars AS size, CASE lang WHEN 'en' THEN 'main' ELSE lang END AS container, lang <> 'en' AS candidate
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def unused_documents(spark, sf):
    """Documents no label refers to; outside the default container they are only candidates."""
    return rp.unused_report(_labelled_docs(spark, sf), root_types=("label",))


@query("""SELECT container, candidate, count(*) AS n, sum(n_chars)::BIGINT AS size FROM (
  SELECT CASE lang WHEN 'en' THEN 'main' ELSE lang END AS container, lang <> 'en' AS candidate, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY ALL""")
def unused_totals(spark, sf):
    r = rp.unused_report(_labelled_docs(spark, sf), root_types=("label",))
    return r.groupBy("container", "candidate").agg(rows_as("n"), F.sum("size").alias("size"))


@query(f"""WITH {WEB}
SELECT ref, count(*) AS refs, count(DISTINCT src) AS referrers, min(src) AS first_referrer, NULL::VARCHAR AS path, false AS missing_source
FROM refs WHERE ref NOT IN (SELECT url FROM pages) GROUP BY ref""")
def dangling_links(spark, sf):
    """Hyperlinks whose target is no page."""
    return rp.dangling_report(rp.dangling_refs(web_refs(spark, sf), web_nodes(spark, sf)))


@query(f"WITH {WEB} SELECT DISTINCT ref, src FROM refs WHERE ref NOT IN (SELECT url FROM pages)")
def dangling_referrers(spark, sf):
    return rp.dangling_referrers(rp.dangling_refs(web_refs(spark, sf), web_nodes(spark, sf)))


def _word_targets(spark, sf):
    """Records that are known by name but have no page: one per document source."""
    d = table(spark, sf, "pages")
    return d.select(F.explode(F.regexp_extract_all("html", F.lit(r">([^<>]*)</a>"), F.lit(1))).alias("w")).distinct().select(
        F.concat(F.lit("/"), "w").alias("id"), F.concat(F.lit("gone/"), "w").alias("path")
    )


GONE = WEB + """,
gone AS (SELECT DISTINCT '/' || w AS id, 'gone/' || w AS path FROM (SELECT unnest(regexp_extract_all(html, '>([^<>]*)</a>', 1)) AS w FROM pages))"""


@query(f"""WITH {GONE}
SELECT id, path, count(ref) AS refs, count(ref) > 0 AS referenced FROM gone LEFT JOIN refs ON ref = id GROUP BY id, path""")
def dropped_records(spark, sf):
    """Records whose source is gone, and whether anything still points at them."""
    return rp.dropped_report(_word_targets(spark, sf), web_refs(spark, sf))


@query(f"WITH {GONE} SELECT id, path FROM gone WHERE id IN (SELECT ref FROM refs)")
def missing_referenced(spark, sf):
    return rp.missing_referenced(_word_targets(spark, sf), web_refs(spark, sf))


@query("""WITH sub AS (SELECT 'N' || c_nationkey AS owner_id, c_custkey, length(c_mktsegment)::DOUBLE * length(c_name) AS area, c_custkey IN (SELECT user_id FROM events) AS u FROM customer)
SELECT owner_id, 'nation/' || n_name AS path, count(*) FILTER (WHERE u) AS used, count(*) AS total, count(*) FILTER (WHERE u)::DOUBLE / count(*) AS ratio,
  sum(area) AS total_area, coalesce(sum(area) FILTER (WHERE u), 0) AS used_area, sum(area) - coalesce(sum(area) FILTER (WHERE u), 0) AS wasted_area,
  coalesce(sum(area) FILTER (WHERE u), 0) / sum(area) AS area_ratio, bool_or(u) AS referenced, false AS whole_referenced
FROM sub JOIN nation ON owner_id = 'N' || n_nationkey GROUP BY ALL""")
def utilization(spark, sf):
    """How much of each nation's customer base is active."""
    n = table(spark, sf, "nation")
    owners = n.select(key("N", "n_nationkey").alias("owner_id"), F.concat(F.lit("nation/"), "n_name").alias("path"))
    c = table(spark, sf, "customer")
    subs = c.select(key("N", "c_nationkey").alias("owner_id"), key("C", "c_custkey").alias("sub_id"), F.length("c_mktsegment").alias("width"), F.length("c_name").alias("height"))
    active = table(spark, sf, "events").select(F.col("user_id").alias("c_custkey")).distinct()
    usage = c.join(active, "c_custkey").select(key("N", "c_nationkey").alias("owner_id"), key("C", "c_custkey").alias("sub_id"))
    return rp.utilization(owners, subs, usage)


@query(f"""WITH RECURSIVE {STAR},
down AS (SELECT id AS node FROM nodes WHERE path = 'nation/NATION_3' UNION SELECT dst FROM down JOIN links ON src = node),
up AS (SELECT id AS node FROM nodes WHERE path = 'nation/NATION_3' UNION SELECT src FROM up JOIN links ON dst = node)
SELECT type, count(*) AS n FROM nodes WHERE id IN (SELECT node FROM down UNION SELECT node FROM up) GROUP BY type""")
def type_facets(spark, sf):
    """Types in everything up- and downstream of one nation."""
    g = star_graph(spark, sf)
    return rp.type_facets(g, rp.linked_scope(g, g.nodes.where(F.col("path") == "nation/NATION_3").select("id")))


SIZES = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY size DESC, path) AS r FROM items),
mapped AS (SELECT grp, path AS item, 1::BIGINT AS n, size FROM ranked WHERE r <= {0}
  UNION ALL SELECT grp, 'others', count(*), sum(size)::BIGINT FROM ranked WHERE r > {0} GROUP BY grp)
SELECT grp, item, n, size, size / (SELECT sum(size) FROM items)::DOUBLE AS share FROM mapped"""


@query(f"WITH {STAR}, items AS (SELECT type AS grp, path, size FROM nodes WHERE size > 0),{SIZES.format(80)}")
def size_map(spark, sf):
    """The default size map: largest items per type, the rest pooled."""
    return rp.size_map(rp.size_scope(star_graph(spark, sf)))


@query(f"WITH {STAR}, items AS (SELECT container AS grp, path, size FROM nodes WHERE type = 'part' AND contains(lower(path), 'bolt')),{SIZES.format(5)}")
def size_map_by_container(spark, sf):
    g = star_graph(spark, sf)
    return rp.size_map(rp.size_scope(g), "container", 5, "bolt", ["part"])


@query(f"""WITH RECURSIVE {STAR},
down AS (SELECT id AS node FROM nodes WHERE path LIKE 'orders/1-URGENT/%' UNION SELECT dst FROM down JOIN links ON src = node)
SELECT type, count(*) AS n, sum(size)::BIGINT AS size FROM nodes WHERE id IN (SELECT node FROM down) GROUP BY type""")
def size_scope(spark, sf):
    """Sizes of all urgent orders together with everything they pull in."""
    g = star_graph(spark, sf)
    items = rp.size_scope(g, root=g.nodes.where(F.col("path").startswith("orders/1-URGENT/")).select("id"))
    return items.groupBy("type").agg(rows_as("n"), F.sum("size").alias("size"))


# ---- containers -----------------------------------------------------------------------------------


@query(f"WITH {TRADE} SELECT src, dst, 'container-dep' AS kind, weight, refs FROM cedges")
def container_edges(spark, sf):
    """Cross-nation trade, aggregated to nation links."""
    return ct.container_edges(trade_graph(spark, sf))


@query(f"""WITH {TRADE}
SELECT container, count(*) AS members, sum(size)::BIGINT AS size, (SELECT count(*) FROM cedges WHERE dst = container) AS in_links, (SELECT count(*) FROM cedges WHERE src = container) AS out_links
FROM tnodes GROUP BY container""")
def container_rollup(spark, sf):
    return ct.container_rollup(trade_graph(spark, sf))


@query(f"WITH {TRADE} SELECT a.src, a.dst, a.weight, a.refs, EXISTS (SELECT 1 FROM cedges b WHERE b.src = a.dst AND b.dst = a.src) AS mutual FROM cedges a")
def container_links(spark, sf):
    return ct.container_links(trade_graph(spark, sf))


@query(f"WITH {TRADE} SELECT container AS src, type AS member_type, count(*) AS n FROM tnodes GROUP BY ALL")
def contain_edges(spark, sf):
    g = trade_graph(spark, sf)
    e = ct.contain_edges(g).join(g.nodes.select(F.col("id").alias("dst"), F.col("type").alias("member_type")), "dst")
    return e.groupBy("src", "member_type").agg(rows_as("n"))


@query(f"""WITH {TRADE}
SELECT f.container AS src_container, t.container AS dst_container, f.path AS src_path, t.path AS dst_path, weight,
  row_number() OVER (PARTITION BY f.container, t.container ORDER BY f.path, t.path, kind)::INTEGER AS rank
FROM tedges JOIN tnodes f ON f.id = src JOIN tnodes t ON t.id = dst WHERE f.container <> t.container QUALIFY rank <= 3""")
def container_refs(spark, sf):
    """The first three references behind every nation link."""
    r = ct.capped_refs(trade_graph(spark, sf), 3)
    return r.select("src_container", "dst_container", "src_path", "dst_path", "weight", "rank")


@query(f"WITH {TRADE} SELECT a.src AS a, a.dst AS b FROM cedges a JOIN cedges b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def mutual_containers(spark, sf):
    return _mutual(ct.container_edges(trade_graph(spark, sf)))


@query("""WITH need AS (SELECT DISTINCT l_partkey, 'N' || c_nationkey AS c, n_regionkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey),
tied AS (SELECT l_partkey, p, count(*) AS copies FROM need GROUP BY ALL),
top AS (SELECT l_partkey, arg_max(copies, p) AS copies FROM tied GROUP BY 1)
SELECT 'P' || p_partkey AS id, copies, floor(p_retailprice)::BIGINT AS size, floor(p_retailprice)::BIGINT * (copies - 1) AS wasted FROM top JOIN part ON p_partkey = l_partkey WHERE copies >= 2""")
def duplication_by_priority(spark, sf):
    """Parts several nations of the highest region need at once, were nations to ship their orders' parts."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    orders = o.select(key("O", "o_orderkey").alias("id"), key("O", "o_orderkey").alias("path"), F.lit("order").alias("type"), F.lit(0).cast("long").alias("size"), key("N", "c_nationkey").alias("container"))
    p = table(spark, sf, "part").select(key("P", "p_partkey").alias("id"), F.col("p_name").alias("path"), F.lit("part").alias("type"), F.floor("p_retailprice").cast("long").alias("size"), F.lit(None).cast("string").alias("container"))
    li = table(spark, sf, "lineitem")
    links = li.select(key("O", "l_orderkey").alias("src"), key("P", "l_partkey").alias("dst"), F.lit("part").alias("kind"))
    n = table(spark, sf, "nation").select(key("N", "n_nationkey").alias("name"), F.col("n_regionkey").alias("priority"))
    g = Graph.from_links(orders.unionByName(p), links)
    return ct.container_duplication(g, n).select("id", "copies", "size", "wasted")


URL_ROOTS = """roots AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS root FROM pages
  UNION SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+/[a-z]+)', 1) FROM pages WHERE url LIKE 'https%')"""


def _page_paths(spark, sf):
    p = table(spark, sf, "pages")
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), r"[?#].*$", "")
    return p.select(key("W", "page_id").alias("id"), path.alias("path"), F.lit("page").alias("type"), F.lit(False).alias("virtual"))


@query(f"""WITH {URL_ROOTS},
p AS (SELECT 'W' || page_id AS id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages)
SELECT id, path, coalesce((SELECT arg_max(root, length(root)) FROM roots WHERE path = root OR starts_with(path, root || '/')), 'main') AS container FROM p""")
def longest_prefix_container(spark, sf):
    """Each page in the deepest of the hosts and, for secure links, language folders."""
    p = table(spark, sf, "pages")
    roots = p.select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("root")).union(
        p.where(F.col("url").startswith("https")).select(F.regexp_extract("url", r"^https?://([^/?#]+/[a-z]+)", 1))
    ).distinct()
    placed = ct.assign_container(_page_paths(spark, sf), roots.withColumn("name", F.col("root")))
    return placed.select("id", "path", "container")


@query("""WITH p AS (SELECT 'W' || page_id AS id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages),
d AS (SELECT DISTINCT regexp_extract(path, '^([^/]+/[^/]+)/', 1) AS prefix FROM p)
SELECT prefix, id, path FROM p JOIN d ON prefix <> '' AND starts_with(path, prefix || '/')""")
def prefix_join(spark, sf):
    """Pages below every two-level folder that occurs."""
    pages = _page_paths(spark, sf)
    d = pages.select(F.regexp_extract("path", r"^([^/]+/[^/]+)/", 1).alias("prefix")).where(F.col("prefix") != "").distinct()
    return ct.prefix_join(pages, d)


# ---- filters, sorts, scalar functions ---------------------------------------------------------------


@query(f"""WITH {STAR}
SELECT id, path FROM nodes WHERE type IN ('part', 'order') AND (starts_with(path, 'part/Brand#1') OR starts_with(path, 'orders/2')) AND NOT regexp_matches(regexp_extract(path, '[^/]*$'), '[0-4]$')""")
def matcher(spark, sf):
    """The matcher specification with lists, a prefix and a negated pattern."""
    g = star_graph(spark, sf)
    spec = {"type": ["part", "order"], "pathStartsWith": ["part/Brand#1", "orders/2"], "not": {"basenameRegex": "[0-4]$"}}
    return g.nodes.where(match_nodes(spec)).select("id", "path")


@query(f"""WITH {STAR},
hits AS (SELECT id, path, type, CASE WHEN instr(lower(regexp_extract(path, '[^/]*$')), 'ring') = 0 THEN 99 ELSE instr(lower(regexp_extract(path, '[^/]*$')), 'ring')::INTEGER - 1 END AS rank FROM nodes WHERE contains(lower(path), 'ring'))
SELECT * FROM hits ORDER BY rank, path LIMIT 50""")
def find_parts(spark, sf):
    """Name search with the default ranking and limit."""
    return fl.find(star_graph(spark, sf).nodes, "Ring")


@query("SELECT s AS value FROM (VALUES ('BUILDING'), ('PIRATES'), ('MACHINERY'), ('SPACE')) v(s) WHERE s NOT IN (SELECT c_mktsegment FROM customer)")
def unknown_values(spark, sf):
    return fl.unknown_values(table(spark, sf, "customer"), "c_mktsegment", ["BUILDING", "PIRATES", "MACHINERY", "SPACE"])


@query(r"""SELECT page_id, regexp_extract(url, '[^/]*$') AS base, regexp_replace(url, '/[^/]*$', '') AS dir, lower(regexp_extract(url, '(\.[^./]*)$', 1)) AS ext,
  regexp_replace(url, '\.[^./]+$', '') AS stem, printf('%.1f KB', length(html) / 1024.0) AS size_text,
  regexp_replace(regexp_replace(regexp_replace(replace(url, '/', '\'), '\\', '/', 'g'), '/{2,}', '/', 'g'), '/+$', '') AS clean FROM pages""")
def path_functions(spark, sf):
    """Path parts, size text and path cleaning of every page address."""
    p = table(spark, sf, "pages")
    pasted = F.concat(F.lit('"'), F.regexp_replace("url", "/", r"\\"), F.lit('" '))
    return p.select(
        "page_id", base("url").alias("base"), dir_of("url").alias("dir"), ext_of("url").alias("ext"), strip_ext("url").alias("stem"),
        _human_size(F.length("html")).alias("size_text"), normalize_path(pasted).alias("clean"),
    )


@query("""WITH t AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
SELECT event_type AS src, nxt AS dst, 'then' AS kind, count(*) AS weight FROM t WHERE nxt IS NOT NULL GROUP BY ALL""")
def transition_graph(spark, sf):
    """Edges between consecutive events of a user, paired by position so that no user sits in one task."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    at = positions_within(e, ["user_id"], ["ts", "event_id"])
    nxt = at.select("user_id", (F.col("pos") - 1).alias("pos"), F.col("event_type").alias("dst"))
    pairs = at.join(nxt, ["user_id", "pos"]).select(F.col("event_type").alias("src"), "dst", F.lit("then").alias("kind"))
    return pairs.groupBy("src", "dst", "kind").agg(rows_as("weight"))


@query("""SELECT 'event:' || event_type AS id, event_type AS path, 'event' AS type, count(DISTINCT user_id) AS in_degree FROM events GROUP BY event_type""")
def virtual_nodes(spark, sf):
    """Event types as synthetic nodes, counted in degrees."""
    from refloom.operators.traverse import degrees

    e = table(spark, sf, "events")
    users = table(spark, sf, "customer").select(key("C", "c_custkey").alias("id"), F.col("c_name").alias("path"), F.lit("customer").alias("type"))
    g = Graph.from_links(
        users, e.select(key("C", "user_id").alias("src"), F.concat(F.lit("event:"), "event_type").alias("dst"), F.lit("emits").alias("kind"))
    )
    nodes = add_virtual_nodes(g.nodes, e.select(F.lit("event").alias("type"), F.col("event_type").alias("path")))
    return nodes.where("virtual").join(degrees(g.edges), "id").select("id", "path", "type", "in_degree")


# ---- rules ------------------------------------------------------------------------------------------


@query(f"""WITH {STAR}
SELECT 'forbid-dep' AS rule, 'error' AS level, f.path || ' → ' || t.path || ' (' || kind || ')' AS message, f.path AS asset
FROM edges JOIN nodes f ON f.id = src JOIN nodes t ON t.id = dst WHERE f.type = 'customer' AND starts_with(f.path, 'customer/BUILDING/') AND regexp_matches(t.path, 'nation/NATION_1[0-9]?$')""")
def forbid_direct(spark, sf):
    """Direct references from one customer segment to some nations."""
    g = star_graph(spark, sf)
    rule = {"name": "forbid-dep", "from": {"type": "customer", "pathStartsWith": "customer/BUILDING/"}, "to": {"pathRegex": "nation/NATION_1[0-9]?$"}}
    return evaluate_rules(g, [rule]).violations.select("rule", "level", "message", "asset")


@query(f"""WITH {STAR},
hop AS (SELECT e.src AS id, min(e.dst) AS via FROM edges e JOIN edges r ON r.src = e.dst JOIN nodes t ON t.id = r.dst WHERE t.path = 'region/EUROPE' GROUP BY e.src)
SELECT 'forbid-dep' AS rule, 'warn' AS level, s.path || ' ⇒ region/EUROPE (transitively, 2 hop(s): ' || s.path || ' → ' || v.path || ' → region/EUROPE)' AS message, s.path AS asset
FROM hop JOIN nodes s ON s.id = hop.id JOIN nodes v ON v.id = via WHERE s.type = 'supplier'""")
def forbid_transitive(spark, sf):
    """Suppliers that reach one region, with the offending path."""
    g = star_graph(spark, sf)
    rule = {"name": "forbid-dep", "level": "warn", "transitive": True, "from": {"type": "supplier"}, "to": {"basename": "EUROPE"}}
    return evaluate_rules(g, [rule]).violations.select("rule", "level", "message", "asset")


@query(f"""WITH RECURSIVE {TRADE},
ways AS (SELECT src, dst FROM cedges UNION SELECT w.src, e.dst FROM ways w JOIN cedges e ON e.src = w.dst),
loops AS (SELECT a.src, min(a.dst) AS least FROM ways a JOIN ways b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)
SELECT 'no-cross-bundle' AS rule, 'warn' AS level, e.src || ' → ' || e.dst || ' (' || e.refs || ' cross-bundle ref(s))' || CASE WHEN b.src IS NULL THEN '' ELSE ' ⇄' END AS message
FROM cedges e LEFT JOIN cedges b ON b.src = e.dst AND b.dst = e.src WHERE e.src = 'N3'
UNION ALL SELECT 'no-bundle-cycle', 'error', 'bundle cycle ' || string_agg(src, ' ⇄ ' ORDER BY encode(src)) FROM loops GROUP BY least HAVING count(*) > 1
UNION ALL SELECT 'no-such-rule', 'config', 'unknown rule "no-such-rule"' UNION ALL SELECT '(invalid)', 'config', 'each rule needs a string "name"'
UNION ALL SELECT 'forbid-dep', 'config', 'rule "forbid-dep" failed: forbid-dep needs a "from" and/or "to" matcher'
UNION ALL SELECT 'breaks', 'config', 'rule "breaks" failed: ValueError: a checker that breaks in a task'""")
def violations(spark, sf):
    """A mixed rule set over the trade graph, with unknown, invalid and failing rules beside sound ones; all messages."""

    def breaks(g, rule, ctx):
        def fail(batches):
            raise ValueError("a checker that breaks in a task")
            yield from batches

        none = F.lit(None).cast("string")
        found = g.nodes.select(F.col("id").alias("message")).mapInArrow(fail, "message string")
        return found.select("message", *[none.alias(c) for c in ("asset", "src", "dst", "kind")])

    rules = [
        {"name": "breaks"}, {"name": "no-cross-bundle", "level": "warn", "from": "N3"}, {"name": "no-bundle-cycle"},
        {"name": "no-such-rule"}, {"level": "warn"}, {"name": "forbid-dep"},
    ]
    r = evaluate_rules(trade_graph(spark, sf), rules, extra={"breaks": breaks})
    return r.violations.select("rule", "level", F.when(F.col("rule") == "no-such-rule", F.substring_index("message", " (", 1)).otherwise(F.col("message")).alias("message"))


@query(f"""WITH {TRADE} SELECT 'no-orphans' AS rule, 'error' AS level, 'unused customer · ' || path AS message, path AS asset
FROM tnodes WHERE type = 'customer' AND id LIKE '%0' AND id NOT IN (SELECT dst FROM tedges)""")
def orphan_rule(spark, sf):
    """Customers outside of any nation that nobody refers to; those in a nation are candidates only."""
    g = trade_graph(spark, sf)
    g = g.with_(nodes=g.nodes.withColumn("container", F.when(F.col("id").endswith("0"), F.lit(None)).otherwise(F.col("container"))))
    return evaluate_rules(g, [{"name": "no-orphans", "type": "customer"}]).violations.select("rule", "level", "message", "asset")


@query("""SELECT 'no-dangling-refs' AS rule, 'warn' AS level, 'dangling ref ' || ref || ' (' || count(*) || ' referrer(s))' AS message, ref AS asset
FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS ref FROM pages) WHERE ref NOT IN (SELECT url FROM pages) GROUP BY ref""")
def default_rules(spark, sf):
    """The default rule set over the web graph."""
    refs, nodes = web_refs(spark, sf), web_nodes(spark, sf)
    g = Graph.from_links(nodes, refs.select("src", F.col("ref").alias("dst"), F.lit("href").alias("kind")), dangling=rp.dangling_refs(refs, nodes))
    return evaluate_rules(g).violations.select("rule", "level", "message", "asset")


@query(f"""WITH {GROUPS},
c AS (SELECT count(*) - 1 AS more, any_value(size) AS size, any_value(path) FILTER (WHERE r = 1) AS path FROM m GROUP BY h, size)
SELECT 'no-duplicate-files' AS rule, 'error' AS level, path AS asset, 'duplicate files: ' || more || ' redundant copy(ies) of ' || path || ' (' ||
  CASE WHEN size * more >= 1048576 THEN printf('%.1f MB', size * more / 1048576.0) ELSE printf('%.1f KB', size * more / 1024.0) END || ')' AS message FROM c""")
def duplicate_rule(spark, sf):
    """Duplicate documents as rule violations, fed from the lazy duplicate report."""
    from refloom.workload.duplicates import file_groups

    g = Graph.from_links(web_nodes(spark, sf), web_refs(spark, sf).select("src", F.col("ref").alias("dst"), F.lit("href").alias("kind")))
    ctx = Context(duplicates=lambda: {"files": file_groups(spark, sf)})
    return evaluate_rules(g, [{"name": "no-duplicate-files", "axis": "files"}], ctx).violations.select("rule", "level", "asset", "message")


# ---- siblings of one name ------------------------------------------------------------------------


@query("""WITH f AS (SELECT p_partkey AS id, p_size AS bin, 'art/' || p_brand || '/' || p_type || '/' || p_name || CASE WHEN p_partkey % 4 = 0 THEN '/alt' ELSE '' END || '/icon' || p_partkey % 3 || '.png' AS path FROM part),
s AS (SELECT *, string_split(path, '/') AS segs, split_part(path, '/', -1) AS base FROM f),
g AS (SELECT bin, base, count(*) AS n, min(len(segs)) AS least FROM s GROUP BY ALL),
front AS (SELECT bin, base, i FROM (SELECT bin, base, unnest(range(1, len(segs) + 1)) AS i, unnest(segs) AS seg FROM s) JOIN g USING (bin, base) WHERE i < least GROUP BY bin, base, i, n HAVING count(DISTINCT seg) = 1 AND count(*) = n),
back AS (SELECT bin, base, i FROM (SELECT bin, base, unnest(range(1, len(segs) + 1)) AS i, unnest(list_reverse(segs)) AS seg FROM s) JOIN g USING (bin, base) WHERE i < least GROUP BY bin, base, i, n HAVING count(DISTINCT seg) = 1 AND count(*) = n),
k AS (SELECT g.*,
  (SELECT count(*) FROM front a WHERE a.bin = g.bin AND a.base = g.base AND a.i <= (SELECT count(*) FROM front b WHERE b.bin = g.bin AND b.base = g.base AND b.i <= a.i)) AS pre,
  (SELECT count(*) FROM back a WHERE a.bin = g.bin AND a.base = g.base AND a.i <= (SELECT count(*) FROM back b WHERE b.bin = g.bin AND b.base = g.base AND b.i <= a.i)) AS suf FROM g)
SELECT id, CASE WHEN n > 1 THEN array_to_string(segs[pre + 1 : len(segs) - least(suf, least - 1 - pre)], '/') END AS dir FROM s JOIN k USING (bin, base)""")
def distinguishing_dirs(spark, sf):
    """What tells the icons of one size apart that have the same file name."""
    from refloom.operators.lookup import distinguishing_dirs as told

    alt = F.when(F.col("p_partkey") % 4 == 0, F.lit("/alt")).otherwise(F.lit(""))
    path = F.concat(F.lit("art/"), "p_brand", F.lit("/"), "p_type", F.lit("/"), "p_name", alt, F.lit("/icon"), (F.col("p_partkey") % 3).cast("string"), F.lit(".png"))
    files = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("bin"), path.alias("path"))
    return told(files, ["bin"]).select("id", "dir")


# ---- filters, orders and list functions ----------------------------------------------------------


@query(f"""WITH {STAR}, e AS (SELECT * FROM edges WHERE kind IN ('placed-by', 'in-nation'))
SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY id""")
def kind_degrees(spark, sf):
    """Degrees over two kinds of edges only."""
    return degrees(filter_kinds(star_graph(spark, sf).edges, ["placed-by", "in-nation"]))


@query(f"""WITH {STAR}
SELECT id, row_number() OVER (ORDER BY size DESC, lower(regexp_extract(path, '[^/]*$')), path) AS place FROM nodes WHERE type = 'part'
UNION ALL SELECT 'total', count(*) FROM nodes WHERE type = 'part'""")
def sorted_parts(spark, sf):
    """The place of every part when sorted by size, and the total of the report."""
    parts = star_graph(spark, sf).nodes.where("type = 'part'")
    placed = global_positions(parts.select("id", (-F.col("size")).alias("_s"), F.lower(base("path")).alias("_b"), "path"), ["_s", "_b", "path"], "place")
    _, total = fl.top_with_total(parts, [F.desc("size")], 10)
    return placed.select("id", (F.col("place") + 1).alias("place")).unionByName(total.select(F.lit("total").alias("id"), F.col("total").alias("place")))


@query(f"""WITH {STAR} SELECT id, path FROM nodes WHERE type = 'customer' ORDER BY lower(path) DESC, lower(regexp_extract(path, '[^/]*$')), path LIMIT 100""")
def sorted_view(spark, sf):
    """The first page of customers by name, falling."""
    return fl.sort_nodes(star_graph(spark, sf).nodes.where("type = 'customer'"), "path", True).select("id", "path").limit(100)


@query(f"""WITH {STAR}, {WEB.strip()} SELECT src, dst, kind, NULL::VARCHAR AS label FROM links WHERE kind = 'in-nation' UNION ALL SELECT src, ref, 'href', 'link' FROM refs""")
def union_of_edges(spark, sf):
    """Edges of two sources in one table; one of them has no labels."""
    web = web_refs(spark, sf).select("src", F.col("ref").alias("dst"), F.lit("href").alias("kind"), F.lit("link").alias("label"))
    return union_edges(web, star_graph(spark, sf).links.where("kind = 'in-nation'").select("src", "dst", "kind"))


@query("""WITH h AS (SELECT doc_id, md5(doc_id::VARCHAR) AS m FROM documents), u AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN m ELSE concat_ws('-', m[1:8], m[9:12], m[13:16], m[17:20], m[21:32]) END || CASE WHEN doc_id % 2 = 0 THEN '@f' || doc_id ELSE '' END AS id FROM h)
SELECT doc_id, regexp_full_match(split_part(id, '@', 1), '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') AS uuid, split_part(id, '@', 1) AS main, CASE WHEN contains(id, '@') THEN split_part(id, '@', 2) END AS sub FROM u""")
def id_parts(spark, sf):
    """Main and sub id of identifiers, and whether the main id is in the long form."""
    m = F.md5(F.col("doc_id").cast("string").cast("binary"))
    dashed = F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    tail = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("@f"), F.col("doc_id").cast("string"))).otherwise(F.lit(""))
    ids = table(spark, sf, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, m).otherwise(dashed), tail).alias("id"))
    return ids.select("doc_id", is_uuid(main_id("id")).alias("uuid"), main_id("id").alias("main"), sub_id("id").alias("sub"))


@query("""WITH a AS (SELECT p_partkey, range(p_size % 6) AS xs, p_size % 7 AS pos FROM part)
SELECT p_partkey, CASE WHEN pos <= len(xs) THEN array_to_string(xs[:pos] || [99] || xs[pos + 1:], ',') END AS added, CASE WHEN pos < len(xs) THEN array_to_string(xs[:pos] || xs[pos + 2:], ',') END AS removed,
  array_to_string(list_reverse(xs), ',') AS turned, true AS fits, false AS short FROM a""")
def list_edits(spark, sf):
    """Insertion, removal and reordering of lists, with places outside of them."""
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 6).alias("n"), (F.col("p_size") % 7).alias("at"))
    rows = rows.select("p_partkey", "n", "at", F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>")).alias("xs"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    turned = F.reverse("xs")
    return rows.select(
        "p_partkey", text(insert_at("xs", "at", F.lit(99))).alias("added"), text(remove_at("xs", "at")).alias("removed"),
        text(permute("xs", turned)).alias("turned"), is_permutation(turned, "n").alias("fits"), is_permutation(turned, F.col("n") + 1).alias("short"),
    )
