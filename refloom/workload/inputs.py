"""Graphs and documents derived from the benchmark tables, always from whole tables.

Each Spark derivation has a SQL twin (a ``WITH`` prefix) used by the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions.scalar import encode_token
from refloom.model import Graph, edges_from_fk
from refloom.operators.documents import doc_entries, entry_table, with_type
from refloom.plans.runtime import cut
from refloom.sources.tables import key, star_graph, table

__all__ = ["star_graph", "table"]

# ---- star graph -------------------------------------------------------------------------------

STAR = """
nodes AS (
  SELECT 'R' || r_regionkey AS id, 'region/' || r_name AS path, 'region' AS type, 0::BIGINT AS size, NULL::VARCHAR AS container FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'nation/' || n_name, 'nation', 0, NULL FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'customer/' || c_mktsegment || '/' || c_name, 'customer', 0, 'N' || c_nationkey FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'supplier/' || s_name, 'supplier', 0, 'N' || s_nationkey FROM supplier
  UNION ALL SELECT 'P' || p_partkey, 'part/' || p_brand || '/' || p_type || '/' || p_name || '-' || p_partkey, 'part', floor(p_retailprice)::BIGINT, p_brand FROM part
  UNION ALL SELECT 'O' || o_orderkey, 'orders/' || o_orderpriority || '/' || o_orderkey, 'order', floor(o_totalprice)::BIGINT, NULL FROM orders
),
links AS (
  SELECT 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst, 'in-region' AS kind FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'in-nation' FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'in-nation' FROM supplier
  UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey, 'placed-by' FROM orders
  UNION ALL SELECT 'O' || l_orderkey, 'P' || l_partkey, 'part' FROM lineitem
  UNION ALL SELECT 'O' || l_orderkey, 'S' || l_suppkey, 'supplier' FROM lineitem
),
edges AS (SELECT src, dst, kind, count(*) AS weight FROM links GROUP BY ALL)"""

# ---- trade graph: customers buy from suppliers; containers are nations --------------------------


def trade_graph(spark: SparkSession, sf: str) -> Graph:
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    none = F.lit(None).cast("string")
    nodes = c.select(
        key("C", "c_custkey").alias("id"), F.concat(F.lit("customer/"), "c_name").alias("path"), F.lit("customer").alias("type"),
        F.length("c_name").cast("long").alias("size"), key("N", "c_nationkey").alias("container"),
    ).unionByName(
        s.select(
            key("S", "s_suppkey").alias("id"), F.concat(F.lit("supplier/"), "s_name").alias("path"), F.lit("supplier").alias("type"),
            F.length("s_name").cast("long").alias("size"), key("N", "s_nationkey").alias("container"),
        )
    )
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    bought = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    links = edges_from_fk(bought, key("C", "o_custkey"), key("S", "l_suppkey"), "buys-from")
    n = table(spark, sf, "nation")
    containers = n.select(
        key("N", "n_nationkey").alias("name"), F.concat(F.lit("nation/"), "n_name").alias("root"), F.col("n_regionkey").alias("priority"),
        F.lit(False).alias("builtin"), none.alias("note"),
    ).drop("note")
    return Graph.from_links(nodes, links, containers=containers)


TRADE = """
tnodes AS (
  SELECT 'C' || c_custkey AS id, 'customer/' || c_name AS path, 'customer' AS type, length(c_name)::BIGINT AS size, 'N' || c_nationkey AS container FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'supplier/' || s_name, 'supplier', length(s_name), 'N' || s_nationkey FROM supplier
),
tedges AS (
  SELECT 'C' || o_custkey AS src, 'S' || l_suppkey AS dst, 'buys-from' AS kind, count(*) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
),
cedges AS (
  SELECT f.container AS src, t.container AS dst, sum(weight)::BIGINT AS weight, count(*) AS refs
  FROM tedges JOIN tnodes f ON f.id = tedges.src JOIN tnodes t ON t.id = tedges.dst
  WHERE f.container <> t.container GROUP BY ALL
)"""


# ---- web graph ----------------------------------------------------------------------------------

HREF = r'href="([^"]*)"'


def web_refs(spark: SparkSession, sf: str) -> DataFrame:
    """(src, ref): every href of every page."""
    p = table(spark, sf, "pages")
    return p.select(key("W", "page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("ref"))


def web_nodes(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select(F.col("url").alias("id"), F.col("url").alias("path"), F.lit("page").alias("type"), F.length("html").cast("long").alias("size"))


WEB = """
refs AS (SELECT 'W' || page_id AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS ref FROM pages)"""

# ---- asset documents: one entry-list document per part -------------------------------------------


def dealt(rows: DataFrame) -> DataFrame:
    """Rows that are to become documents, dealt over all tasks: a few MB of columns are one or two splits, but GB of documents.

    They are cut there, as conditions on the texts would be moved below a mere shuffle and build them in those splits.
    """
    return cut(rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))).df


def dashed(hex_col):
    s = lambda a, n: F.substring(hex_col, a, n)
    return F.concat_ws("-", s(1, 8), s(9, 4), s(13, 4), s(17, 4), s(21, 12))


def uid(c):
    return dashed(F.md5(F.col(c) if isinstance(c, str) else c))


def part_docs(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text): a root, two nodes, a sprite with two references, bookkeeping, a click handler."""
    p = dealt(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    body = F.concat(
        F.lit('[{"__type__":"cc.Prefab","_name":"'), F.col("p_name"), F.lit('","data":{"__id__":1}},'),
        F.lit('{"__type__":"cc.Node","_name":"'), F.col("p_brand"),
        F.lit('","_parent":null,"_children":[{"__id__":2}],"_components":[],"_prefab":{"__id__":4}},'),
        F.lit('{"__type__":"cc.Node","_name":"'), F.col("p_name"),
        F.lit('","_parent":{"__id__":1},"_children":[],"_components":[{"__id__":3}],"_prefab":null},'),
        F.lit('{"__type__":"cc.Sprite","node":{"__id__":2},"_spriteFrame":{"__uuid__":"'), uid("p_brand"), F.lit("@"), F.col("p_size").cast("string"),
        F.lit('"},"_clips":[null,{"__uuid__":"'), uid("p_type"), F.lit('"}],"_events":[{"__id__":5}]},'),
        F.lit('{"__type__":"cc.PrefabInfo","fileId":"f'), F.col("p_partkey").cast("string"), F.lit('","root":{"__id__":1},"asset":{"__uuid__":"'), uid("p_name"),
        F.lit('"}},'),
        F.lit('{"__type__":"cc.ClickEvent","_componentId":"'), encode_token(uid("p_type")), F.lit('","handler":"on'), F.col("p_size").cast("string"), F.lit('"}]'),
    )
    return p.select(key("P", "p_partkey").alias("doc_id"), body.alias("text"))


def part_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The entries of ``part_docs`` at rest, for what asks them several times: each text is parsed once."""
    return entry_table(doc_entries(part_docs(spark, sf)))


UID = "concat_ws('-', substr(md5({0}),1,8), substr(md5({0}),9,4), substr(md5({0}),13,4), substr(md5({0}),17,4), substr(md5({0}),21,12))"
TOKEN = "substr(md5({0}),1,5) || substr(base64(unhex(substr(md5({0}),6,27) || '000')),1,18)"
DOCS = f"""
pd AS (
  SELECT 'P' || p_partkey AS doc_id, p_name, p_brand, p_type, p_size, p_partkey, {UID.format('p_brand')} AS brand_id, {UID.format('p_type')} AS type_id,
    {UID.format('p_name')} AS name_id, {TOKEN.format('p_type')} AS type_token
  FROM part
),
docs AS (
  SELECT doc_id, '[{{"__type__":"cc.Prefab","_name":"' || p_name || '","data":{{"__id__":1}}}},'
    || '{{"__type__":"cc.Node","_name":"' || p_brand || '","_parent":null,"_children":[{{"__id__":2}}],"_components":[],"_prefab":{{"__id__":4}}}},'
    || '{{"__type__":"cc.Node","_name":"' || p_name || '","_parent":{{"__id__":1}},"_children":[],"_components":[{{"__id__":3}}],"_prefab":null}},'
    || '{{"__type__":"cc.Sprite","node":{{"__id__":2}},"_spriteFrame":{{"__uuid__":"' || brand_id || '@' || p_size || '"}},"_clips":[null,{{"__uuid__":"' || type_id || '"}}],"_events":[{{"__id__":5}}]}},'
    || '{{"__type__":"cc.PrefabInfo","fileId":"f' || p_partkey || '","root":{{"__id__":1}},"asset":{{"__uuid__":"' || name_id || '"}}}},'
    || '{{"__type__":"cc.ClickEvent","_componentId":"' || type_token || '","handler":"on' || p_size || '"}}]' AS text
  FROM pd
)"""


def asset_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Brands are atlases and types are scripts; part names are assets that do not exist."""
    p = table(spark, sf, "part")
    brands = p.groupBy("p_brand").agg(F.sum("p_size").cast("long").alias("size")).select(
        uid("p_brand").alias("id"), F.concat(F.lit("atlas/"), "p_brand", F.lit(".plist")).alias("path"), F.lit("atlas").alias("type"), "size"
    )
    types = p.groupBy("p_type").agg(F.sum("p_size").cast("long").alias("size")).select(
        uid("p_type").alias("id"), F.concat(F.lit("src/"), "p_type", F.lit(".ts")).alias("path"), F.lit("script").alias("type"), "size"
    )
    return brands.unionByName(types)


def asset_subs(spark: SparkSession, sf: str) -> DataFrame:
    """Sub-items of a brand: one frame per part size that occurs in it."""
    p = table(spark, sf, "part").select("p_brand", "p_size").distinct()
    size = F.col("p_size").cast("string")
    return p.select(
        uid("p_brand").alias("owner_id"), size.alias("sub_id"), F.concat(uid("p_brand"), F.lit("@"), size).alias("uuid"),
        F.lit("sprite-frame").alias("kind"), F.concat(F.lit("frame"), size).alias("name"), F.col("p_size").alias("width"), F.col("p_size").alias("height"),
    )


# ---- conversation documents: one entry per turn ---------------------------------------------------


def conv_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as a chain of nodes: each lists the next turn as its child, the last points past the end.

    System turns are not nodes.  Built row by row; no conversation is gathered.
    """
    c = table(spark, sf, "conversations")
    ref = lambda n: F.concat(F.lit('{"__id__":'), n.cast("string"), F.lit("}"))
    t = F.col("turn")
    kind = F.when(F.col("role") == "system", F.lit("sys.Note")).otherwise(F.lit("cc.Node"))
    body = F.concat(
        F.lit('{"__type__":"'), kind, F.lit('","_name":"'), F.col("role"), F.lit('","_parent":'), F.when(t == 0, F.lit("null")).otherwise(ref(t - 1)),
        F.lit(',"_children":['), ref(t + 1), F.lit('],"_len":'), F.length("text").cast("string"), F.lit("}"),
    )
    return with_type(c.select(F.col("conv_id").alias("doc_id"), t.cast("int").alias("idx"), F.parse_json(body).alias("entry")))


# ---- nested-instance documents: one per customer ---------------------------------------------------


def instance_docs(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text): a root holding one nested instance with a root-level and a deep override."""
    c = dealt(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
    nat = F.col("c_nationkey").cast("string")
    seg = F.col("c_mktsegment")
    body = F.concat(
        F.lit('[{"__type__":"cc.Prefab","data":{"__id__":1}},{"__type__":"cc.Node","_name":"Root","_parent":null,"_children":[{"__id__":3}],"_components":[],"_prefab":{"__id__":2}},'),
        F.lit('{"__type__":"cc.PrefabInfo","fileId":"root","root":{"__id__":1},"asset":{"__id__":0},"instance":null},'),
        F.lit('{"__type__":"cc.Node","_name":"'), seg, F.lit('","_parent":{"__id__":1},"_children":[],"_components":[],"_prefab":{"__id__":4}},'),
        F.lit('{"__type__":"cc.PrefabInfo","fileId":"f'), nat, F.lit('","asset":{"__uuid__":"'), key("N", "c_nationkey"), F.lit('"},"instance":{"__id__":5}},'),
        F.lit('{"__type__":"cc.PrefabInstance","fileId":"i","propertyOverrides":[{"__id__":6},{"__id__":8}]},'),
        F.lit('{"__type__":"CCPropertyOverrideInfo","targetInfo":{"__id__":7},"propertyPath":["_name"],"value":"'), F.col("c_name"), F.lit('"},'),
        F.lit('{"__type__":"cc.TargetInfo","localID":["f'), nat, F.lit('"]},'),
        F.lit('{"__type__":"CCPropertyOverrideInfo","targetInfo":{"__id__":9},"propertyPath":["_lpos","x"],"value":'), F.col("c_custkey").cast("string"), F.lit("},"),
        F.lit('{"__type__":"cc.TargetInfo","localID":["deep'), nat, F.lit('"]}]'),
    )
    return c.select(key("C", "c_custkey").alias("doc_id"), body.alias("text"))


# ---- text layouts ----------------------------------------------------------------------------------


def atlas_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(id, path, text): a sectioned text per part, one section in each field layout."""
    p = table(spark, sf, "part")
    size, k = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("\n"), F.col("p_brand"), F.lit(".png\nsize: 64,64\nformat: RGBA8888\nfilter: Linear\n"),
        F.col("p_name"), F.lit("\n  rotate: "), F.when(F.col("p_size") > 25, F.lit("true")).otherwise(F.lit("false")),
        F.lit("\n  xy: 2, "), size, F.lit("\n  size: "), size, F.lit(", 7\n  orig: "), size, F.lit(", 9\n  offset: 0, 0\n  index: -1\n"),
        F.col("p_type"), F.lit("\n  bounds: 1, 2, "), size, F.lit(", 4\n  offsets: 0, 0, 11, "), size, F.lit("\n"),
    )
    return p.select(key("P", "p_partkey").alias("id"), F.concat(F.lit("skel/"), k, F.lit(".atlas")).alias("path"), text.alias("text"))


def plist_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(id, path, text): a key/dict text per part, one frame in each dialect."""
    p = table(spark, sf, "part")
    size, k = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("<plist><dict><key>frames</key><dict><key>"), F.col("p_name"), F.lit("</key><dict><key>frame</key><string>{{3,"), size, F.lit("},{"), size,
        F.lit(",8}}</string><key>rotated</key>"), F.when(F.col("p_size") > 25, F.lit("<true/>")).otherwise(F.lit("<false/>")),
        F.lit("<key>sourceSize</key><string>{"), size, F.lit(",12}</string></dict><key>"), F.col("p_type"),
        F.lit("</key><dict><key>textureRect</key><string>{{1,2},{"), size, F.lit(",5}}</string><key>textureRotated</key><false/></dict></dict>"),
        F.lit("<key>metadata</key><dict><key>textureFileName</key><string>"), F.col("p_brand"), F.lit(".png</string></dict></dict></plist>"),
    )
    return p.select(key("P", "p_partkey").alias("id"), F.concat(F.lit("atlas/"), k, F.lit(".plist")).alias("path"), text.alias("text"))
