"""Document queries: extraction, resolution, validation, edits, refresh."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from refloom.functions.scalar import decode_token, encode_token, looks_compressed, value_kind
from refloom.model import Graph
from refloom.operators import documents as dc
from refloom.operators import edit as ed
from refloom.operators import extract as ex
from refloom.operators import extractors as xt
from refloom.operators import selectors as sl
from refloom.operators import validate as va
from refloom.operators.duplicates import shared_names as _shared
from refloom.plans.runtime import cut, ensure_checkpoint_dir
from refloom.sources.files import builtin_types, parse_meta, resolve_type
from refloom.sources.tables import key
from refloom.streaming.refresh import current_edges, refresh_stream
from refloom.workload.base import query, rows_as
from refloom.workload.inputs import (
    DOCS, HREF, UID, asset_nodes, asset_subs, atlas_texts, conv_entries, instance_docs, part_docs, part_entries, plist_texts, table, uid,
)

# ---- extraction --------------------------------------------------------------------------------


@query(f"""WITH {DOCS}
SELECT t.type, t.idx::INTEGER AS idx, count(*) AS n FROM docs, (VALUES ('cc.Prefab', 0), ('cc.Node', 1), ('cc.Node', 2), ('cc.Sprite', 3), ('cc.PrefabInfo', 4), ('cc.ClickEvent', 5)) t(type, idx) GROUP BY ALL""")
def doc_entries(spark, sf):
    """Documents exploded to typed entries."""
    return dc.doc_entries(part_docs(spark, sf)).groupBy("type", "idx").agg(rows_as("n"))


REFS = """
r AS (
  SELECT doc_id AS src, brand_id || '@' || p_size AS ref, p_brand || '/' || p_name AS node_path, 'cc.Sprite' AS component, '_spriteFrame' AS property FROM pd
  UNION ALL SELECT doc_id, type_id, p_brand || '/' || p_name, 'cc.Sprite', '_clips.1' FROM pd
  UNION ALL SELECT doc_id, name_id, p_brand, 'cc.PrefabInfo', 'asset' FROM pd)"""


@query(f"WITH {DOCS}, {REFS} SELECT * FROM r")
def uuid_refs(spark, sf):
    """Every asset reference with its owning node, component and property."""
    return ex.uuid_refs(dc.doc_entries(part_docs(spark, sf)))


@query(f"""WITH {DOCS}
SELECT component AS ref, count(*) AS n, count(DISTINCT node_path) AS places FROM (
  SELECT 'cc.Prefab' AS component, NULL AS node_path FROM pd UNION ALL SELECT 'cc.Node', p_brand FROM pd UNION ALL SELECT 'cc.Node', p_brand || '/' || p_name FROM pd
  UNION ALL SELECT 'cc.Sprite', p_brand || '/' || p_name FROM pd UNION ALL SELECT 'cc.PrefabInfo', p_brand FROM pd UNION ALL SELECT 'cc.ClickEvent', p_brand || '/' || p_name FROM pd) GROUP BY 1""")
def type_refs(spark, sf):
    return ex.type_refs(dc.doc_entries(part_docs(spark, sf))).groupBy("ref").agg(rows_as("n"), F.countDistinct("node_path").alias("places"))


@query(f"WITH {DOCS} SELECT doc_id, 5::INTEGER AS idx, type_token AS ref, 'click → on' || p_size || '()' AS property FROM pd")
def handler_refs(spark, sf):
    return ex.handler_refs(dc.doc_entries(part_docs(spark, sf)))


@query("""SELECT doc_id, owner::INTEGER AS owner, target::INTEGER AS target FROM (SELECT 'P' || p_partkey AS doc_id FROM part), (VALUES (0, 1), (1, 2), (1, 4), (2, 3), (3, 5)) t(owner, target)""")
def first_referrers(spark, sf):
    """Which entry first holds each internal reference."""
    return dc.first_referrer(dc.id_refs(dc.doc_entries(part_docs(spark, sf)))).select("doc_id", "owner", "target")


@query("""SELECT idx::INTEGER AS idx, host::INTEGER AS host, count(*) AS n FROM part, (VALUES (1, 1), (2, 2), (3, 2), (4, 1), (5, 2)) t(idx, host) GROUP BY ALL""")
def owning_nodes(spark, sf):
    return dc.hosts(part_entries(spark, sf)).groupBy("idx", "host").agg(rows_as("n"))


@query("""SELECT conv_id AS doc_id, turn::INTEGER AS idx, list_aggregate(list(role) FILTER (WHERE role <> 'system') OVER (PARTITION BY conv_id, grp ORDER BY turn), 'string_agg', '/') AS path
FROM (SELECT *, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM conversations) WHERE role <> 'system'""")
def node_paths(spark, sf):
    """The role path of every turn, restarting after system notes."""
    return dc.node_paths(conv_entries(spark, sf), "index").select("doc_id", "idx", "path")


RESOLVED = f"""
assets AS (SELECT {UID.format('p_brand')} AS id, 'atlas' AS type, p_brand AS name FROM part GROUP BY p_brand UNION ALL SELECT {UID.format('p_type')}, 'script', p_type FROM part GROUP BY p_type),
raw AS (
  SELECT doc_id AS src, brand_id AS dst, p_size::VARCHAR AS sub, 'sprite-frame' AS kind FROM pd UNION ALL SELECT doc_id, type_id, NULL, 'script' FROM pd
  UNION ALL SELECT doc_id, type_id, NULL, 'script' FROM pd)"""


def _resolved(spark, sf):
    nodes = asset_nodes(spark, sf)
    raw = ex.document_sources(dc.doc_entries(part_docs(spark, sf)), nodes)
    return nodes, ex.resolve_refs(raw, nodes, asset_subs(spark, sf))


@query(f"WITH {DOCS}, {RESOLVED} SELECT src, dst, kind, count(*) AS weight FROM raw GROUP BY ALL")
def resolved_edges(spark, sf):
    """References resolved to edges whose kind comes from the target."""
    return _resolved(spark, sf)[1].edges.select("src", "dst", "kind", "weight")


@query(f"WITH {DOCS}, {RESOLVED} SELECT DISTINCT dst AS owner_id, sub AS sub_id FROM raw")
def sub_usage(spark, sf):
    return _resolved(spark, sf)[1].sub_usage


@query(f"WITH {DOCS} SELECT name_id AS ref, count(*) AS n, count(DISTINCT doc_id) AS docs FROM pd GROUP BY 1")
def dangling_assets(spark, sf):
    return _resolved(spark, sf)[1].dangling.groupBy("ref").agg(rows_as("n"), F.countDistinct("src").alias("docs"))


@query(f"""WITH {DOCS}
SELECT doc_id AS src, brand_id AS dst, p_brand || '/' || p_name || ':cc.Sprite._spriteFrame' AS selector, p_brand || '/' || p_name || ':cc.Sprite._spriteFrame  "frame' || p_size || '"' AS site_text FROM pd
UNION ALL SELECT doc_id, type_id, p_brand || '/' || p_name || ':cc.Sprite._clips.1', p_brand || '/' || p_name || ':cc.Sprite._clips.1' FROM pd
UNION ALL SELECT doc_id, type_id, p_brand || '/' || p_name, p_brand || '/' || p_name FROM pd""")
def site_selectors(spark, sf):
    """Paste-ready selectors of every usage site."""
    nodes, res = _resolved(spark, sf)
    return ex.site_selector(ex.component_names(res.sites, nodes)).select("src", "dst", "selector", "site_text")


@query(f"""WITH {DOCS} SELECT DISTINCT doc_id AS src, type_id AS dst, p_brand || '/' || p_name AS node_path, component, property FROM pd, (VALUES ('cc.Sprite', 1), (NULL, 2)) t(component, k),
LATERAL (SELECT CASE k WHEN 1 THEN '_clips.1' ELSE 'click → on' || p_size || '()' END AS property)""")
def usage_sites(spark, sf):
    """Where each document uses its script asset, every place once."""
    from refloom.operators.traverse import usage_sites as sites

    nodes, res = _resolved(spark, sf)
    g = Graph(nodes, res.edges, res.links, res.sites)
    scripts = nodes.where(F.col("type") == "script").select(F.col("id").alias("dst"))
    pairs = res.edges.join(cut(scripts).hinted(), "dst", "left_semi").select("src", "dst")
    return sites(g, pairs).select("src", "dst", "node_path", "component", "property")


@query(f"WITH {DOCS} SELECT DISTINCT p_type, type_token AS token, type_id AS decoded, true AS compressed, length(type_token)::INTEGER AS n FROM pd")
def token_codec(spark, sf):
    """Ids to compressed tokens and back."""
    p = table(spark, sf, "part").select("p_type").distinct()
    t = encode_token(uid("p_type"))
    return p.select("p_type", t.alias("token"), decode_token(t).alias("decoded"), looks_compressed(t).alias("compressed"), F.length(t).alias("n"))


@query(f"WITH {DOCS} SELECT DISTINCT p_type AS name, type_token AS token FROM pd UNION SELECT 'cc.' || p_type, 'cc.' || p_type FROM pd UNION SELECT p_name, NULL FROM pd")
def type_tokens(spark, sf):
    p = table(spark, sf, "part")
    names = p.select(F.explode(F.array(F.col("p_type"), F.concat(F.lit("cc."), "p_type"), F.col("p_name"))).alias("name"))
    return ex.type_tokens(names, asset_nodes(spark, sf))


@query("""SELECT key, kind, count(*) AS n FROM part, (VALUES ('_spriteFrame', 'asset'), ('_clips', 'array'), ('_name', 'string'), ('node', 'ref'), ('_parent', 'null')) t(key, kind) GROUP BY ALL""")
def value_kinds(spark, sf):
    """The kind of value some fields of the documents hold."""
    e = dc.doc_entries(part_docs(spark, sf))
    v = lambda k: F.try_variant_get("entry", f"$.{k}", "variant")
    pick = lambda idx, k: e.where(F.col("idx") == idx).select(F.lit(k).alias("key"), value_kind(v(k)).alias("kind"))
    out = pick(3, "_spriteFrame").unionByName(pick(3, "_clips")).unionByName(pick(2, "_name")).unionByName(pick(3, "node")).unionByName(pick(1, "_parent"))
    return out.groupBy("key", "kind").agg(rows_as("n"))


# ---- sidecar records -------------------------------------------------------------------------------


def _metas(spark, sf):
    """(path, text): a sidecar per part; every size-13 one is broken, every size-17 one has no id."""
    p = table(spark, sf, "part")
    body = F.concat(
        F.lit('{"importer":"'), F.when(F.col("p_size") > 40, F.lit("sprite-atlas")).when(F.col("p_size") > 30, F.lit("*")).otherwise(F.lit("image")), F.lit('","uuid":"'),
        F.when(F.col("p_size") == 17, F.lit("")).otherwise(uid(key("P", "p_partkey"))),
        F.lit('","userData":{"imageUuidOrDatabaseUri":"'), uid("p_brand"), F.lit('@x"},"subMetas":{"a'), F.col("p_size").cast("string"),
        F.lit('":{"uuid":"u","importer":"texture","name":"","displayName":"shown","subMetas":{"b":{"importer":"sprite-frame","userData":{"width":3,"height":4}}}}}}'),
    )
    text = F.when(F.col("p_size") == 13, F.lit("{broken")).otherwise(body)
    return p.select(F.concat(F.lit("d/"), F.col("p_partkey").cast("string"), F.lit(".PNG.meta")).alias("path"), text.alias("text"), "p_brand")


@query(f"""SELECT {UID.format("'P' || p_partkey")} AS id, 'd/' || p_partkey || '.PNG' AS path, '.png' AS ext, CASE WHEN p_size > 40 THEN 'atlas' WHEN p_size > 30 THEN 'png' ELSE 'image' END AS type
FROM part WHERE p_size NOT IN (13, 17)""")
def parse_sidecars(spark, sf):
    """Sidecar texts to records with resolved types."""
    nodes, _, _ = parse_meta(_metas(spark, sf), builtin_types(spark))
    return nodes.select("id", "path", "ext", "type")


@query("""SELECT kind, name, count(*) AS n, sum(w)::BIGINT AS width FROM (SELECT 'texture' AS kind, 'shown' AS name, NULL AS w FROM part WHERE p_size NOT IN (13, 17) UNION ALL SELECT 'sprite-frame', 'b', 3 FROM part WHERE p_size NOT IN (13, 17)) GROUP BY ALL""")
def sub_items(spark, sf):
    """Nested sub-records, flattened."""
    _, subs, _ = parse_meta(_metas(spark, sf), builtin_types(spark))
    return subs.groupBy("kind", "name").agg(rows_as("n"), F.sum("width").alias("width"))


@query("""SELECT 'd/' || p_partkey || '.PNG.meta' AS path, CASE p_size WHEN 13 THEN 'invalid JSON' ELSE 'no uuid' END AS error FROM part WHERE p_size IN (13, 17)""")
def parse_errors(spark, sf):
    return parse_meta(_metas(spark, sf), builtin_types(spark))[2]


@query("""SELECT type, count(*) AS n FROM (SELECT CASE WHEN p_type = 'SMALL' THEN 'font' WHEN p_type = 'LARGE' THEN 'spine-atlas' WHEN p_type = 'ECONOMY' THEN 'economy' WHEN p_type = 'PROMO' THEN 'unknown' ELSE p_type END AS type FROM part) GROUP BY 1""")
def resolve_types(spark, sf):
    """Importer, extension and fallback rules over every part."""
    p = table(spark, sf, "part")
    imp = F.when(F.col("p_type") == "SMALL", F.lit("ttf-font")).when(F.col("p_type").isin("LARGE", "ECONOMY", "PROMO"), F.lit("*")).otherwise(F.col("p_type"))
    ext = F.when(F.col("p_type") == "LARGE", F.lit(".atlas")).when(F.col("p_type") == "ECONOMY", F.lit(".economy")).otherwise(F.lit(""))
    return resolve_type(p.select(imp.alias("importer"), ext.alias("ext")), builtin_types(spark)).groupBy("type").agg(rows_as("n"))


# ---- extractors ------------------------------------------------------------------------------------


@query("""SELECT DISTINCT 'E' || event_id AS src, json_extract_string(props, '$.k') AS dst, 'texture' AS kind FROM events WHERE json_extract_string(props, '$.k')::BIGINT IN (SELECT p_partkey FROM part)""")
def attr_edges(spark, sf):
    """Edges from a record attribute to the node it names."""
    e = table(spark, sf, "events").select(key("E", "event_id").alias("id"), F.try_parse_json("props").alias("user_data"))
    nodes = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"))
    return xt.attr_edges(e, ["$.missing", "$.k"], "texture", nodes)[0]


@query("""SELECT 'C' || c_custkey AS src, CASE WHEN c_custkey IN (SELECT user_id FROM events) THEN 'E' || c_custkey ELSE 'S' || c_custkey END AS dst,
  CASE WHEN c_custkey IN (SELECT user_id FROM events) THEN 'spine-atlas' ELSE 'texture' END AS kind FROM customer
WHERE c_custkey IN (SELECT user_id FROM events) OR c_custkey IN (SELECT s_suppkey FROM supplier)""")
def sibling_edges(spark, sf):
    """Same-named siblings by preference: an atlas, else an image."""
    def files(df, col, prefix, ext, type_):
        k = F.col(col).cast("string")
        return df.select(key(prefix, col).alias("id"), F.concat(F.lit("c/"), k, F.lit(ext)).alias("path"), F.lit(type_).alias("type"))

    users = table(spark, sf, "events").select("user_id").distinct()
    nodes = files(table(spark, sf, "customer"), "c_custkey", "C", ".json", "spine").unionByName(files(users, "user_id", "E", ".atlas", "spine-atlas"))
    nodes = nodes.unionByName(files(table(spark, sf, "supplier"), "s_suppkey", "S", ".png", "image"))
    return xt.sibling_edges(nodes, "spine", r"(?i)\.json$", [(".atlas", "spine-atlas"), (".png", "texture")])[0]


@query("SELECT 'P' || p_partkey AS src, p_brand AS dst, 'texture' AS kind FROM part")
def line_edges(spark, sf):
    """Page lines of sectioned texts to the images beside them."""
    pages = table(spark, sf, "part").select("p_brand").distinct().select(F.col("p_brand").alias("id"), F.concat(F.lit("skel/"), "p_brand", F.lit(".png")).alias("path"))
    return xt.line_edges(atlas_texts(spark, sf), pages)[0]


@query("""SELECT 'P' || p_partkey AS id, p_brand || '.png' AS page, name, x::INTEGER AS x, y::INTEGER AS y, w::INTEGER AS w, h::INTEGER AS h, rotate, mw::INTEGER AS mw, mh::INTEGER AS mh FROM part,
LATERAL (SELECT p_name AS name, 2 AS x, p_size AS y, CASE WHEN p_size > 25 THEN 7 ELSE p_size END AS w, CASE WHEN p_size > 25 THEN p_size ELSE 7 END AS h, p_size > 25 AS rotate, p_size AS mw, 9 AS mh
  UNION ALL SELECT p_type, 1, 2, p_size, 4, false, 11, p_size) t""")
def section_records(spark, sf):
    """Sections of every text in both field layouts."""
    return xt.section_records(atlas_texts(spark, sf)).drop("ord")


@query("""SELECT 'P' || p_partkey AS id, p_brand || '.png' AS page, name, x::INTEGER AS x, y::INTEGER AS y, w::INTEGER AS w, h::INTEGER AS h, rotate, mw::INTEGER AS mw, mh::INTEGER AS mh FROM part,
LATERAL (SELECT p_name AS name, 3 AS x, p_size AS y, CASE WHEN p_size > 25 THEN 8 ELSE p_size END AS w, CASE WHEN p_size > 25 THEN p_size ELSE 8 END AS h, p_size > 25 AS rotate, p_size AS mw, 12 AS mh
  UNION ALL SELECT p_type, 1, 2, p_size, 5, false, p_size, 5) t""")
def dict_records(spark, sf):
    """Frames of every key/dict text in both dialects."""
    return xt.dict_records(plist_texts(spark, sf)).drop("ord")


@query("""WITH f AS (SELECT 'P' || p_partkey AS c, p_name AS name, p_size || 'x9' AS d, p_size AS w FROM part UNION ALL SELECT 'P' || p_partkey, p_type, '11x' || p_size, p_size FROM part)
SELECT name, count(*) AS containers, count(DISTINCT d) AS dims, min(d) AS first_dims, CASE WHEN count(DISTINCT d) = 1 AND min(w) > 0 THEN 'likely' ELSE 'name-only' END AS confidence FROM f GROUP BY name HAVING count(*) >= 2""")
def shared_regions(spark, sf):
    """Regions packed into more than one sectioned text."""
    r = xt.section_records(atlas_texts(spark, sf))
    return _shared(r.select(F.col("id").alias("container"), "name", F.col("mw").alias("w"), F.col("mh").alias("h"), "ord"))


@query("""SELECT 'W' || page_id AS src, 'W' || arg AS dst, 'track' AS kind, 'track("' || arg || '")' AS label FROM (SELECT page_id, unnest(regexp_extract_all(html, '\\btrack\\((\\d+)\\)', 1)) AS arg FROM pages) WHERE arg::BIGINT IN (SELECT page_id FROM pages)""")
def stem_call_edges(spark, sf):
    """Literal calls in page sources to the pages they name."""
    p = table(spark, sf, "pages")
    calls = xt.literal_calls(p.select(key("W", "page_id").alias("id"), F.col("html").alias("text")), r"\b(track)\((\d+)\)")
    nodes = p.select(key("W", "page_id").alias("id"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("page").alias("type"))
    return xt.stem_call_edges(calls, nodes, "page", "track", "track")


@query("""WITH s AS (SELECT 'P' || p_partkey AS src, p_brand, p_type, p_size > 25 AS one FROM part)
SELECT src, p_brand || '/' || p_type AS dst, 'resource-load' AS kind, 'resources.load(''' || p_brand || '/' || p_type || ''')' AS label FROM s WHERE one
UNION ALL SELECT DISTINCT src, t.p_brand || '/' || t.p_type, 'resource-load', 'resources.loadDir(''' || s.p_brand || ''')' FROM s JOIN (SELECT DISTINCT p_brand, p_type FROM part) t USING (p_brand) WHERE NOT one""")
def call_edges(spark, sf):
    """Single and directory loads in script texts, resolved by path and by prefix."""
    p = table(spark, sf, "part")
    one = F.concat(F.lit("resources.load('"), "p_brand", F.lit("/"), "p_type", F.lit("', cb);"))
    many = F.concat(F.lit("resources.loadDir( \""), "p_brand", F.lit("\")"))
    src = p.select(key("P", "p_partkey").alias("id"), F.concat(F.lit("// js\n"), F.when(F.col("p_size") > 25, one).otherwise(many)).alias("text"))
    nodes = p.select("p_brand", "p_type").distinct().select(
        F.concat_ws("/", "p_brand", "p_type").alias("id"), F.concat(F.lit("resources/"), "p_brand", F.lit("/"), "p_type", F.lit(".png")).alias("path"), F.lit(True).alias("has_source")
    )
    return xt.call_edges(xt.literal_calls(src, xt.LOAD_CALLS), nodes)


def _scripts(spark, sf):
    """A class per customer extending its nation's, per nation extending its region's; one region is a component."""
    cls = lambda name, ext: F.concat(F.lit("import x;\nexport class "), name, F.lit(" extends "), ext, F.lit(" {\n  m<T extends Component>() {}\n}"))
    c, n, r = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "region")
    cust = c.select(key("C", "c_custkey").alias("id"), cls(key("Customer", "c_custkey"), key("Nation", "c_nationkey")).alias("text"))
    nat = n.select(key("N", "n_nationkey").alias("id"), cls(key("Nation", "n_nationkey"), key("Region", "n_regionkey")).alias("text"))
    reg = r.select(key("R", "r_regionkey").alias("id"), cls(key("Region", "r_regionkey"), F.when(F.col("r_name") == "ASIA", F.lit("Component")).otherwise(F.lit("Plain"))).alias("text"))
    return cust.unionByName(nat).unionByName(reg)


@query("""SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS dst, 'extends' AS kind FROM customer UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'extends' FROM nation""")
def extends_edges(spark, sf):
    """Class inheritance between script texts."""
    return xt.extends_edges(_scripts(spark, sf))


@query("""WITH n AS (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
SELECT 'R' || r_regionkey AS id FROM region WHERE r_name = 'ASIA' UNION SELECT 'N' || n_nationkey FROM n UNION SELECT 'C' || c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)
UNION SELECT 'C' || user_id FROM events""")
def component_closure(spark, sf):
    """Scripts kept in the index: descendants of the one component, and those events refer to."""
    return xt.component_closure(_scripts(spark, sf), table(spark, sf, "events").select(key("C", "user_id").alias("id")).distinct())


# ---- validation ---------------------------------------------------------------------------------------

CONV = """
c AS (SELECT conv_id, turn, role = 'system' AS sys, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
j AS (SELECT a.*, b.sys AS child_sys, p.sys AS parent_sys FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 LEFT JOIN c p ON p.conv_id = a.conv_id AND p.turn = a.turn - 1),
issues AS (
  SELECT conv_id, 'error' AS severity, 'bad-ref' AS code, turn FROM j WHERE turn = last
  UNION ALL SELECT conv_id, 'error', 'bad-child', turn FROM j WHERE NOT sys AND (turn = last OR child_sys)
  UNION ALL SELECT conv_id, 'warning', 'unresolved-type', turn FROM j WHERE sys)"""


@query(f"WITH {CONV} SELECT severity, code, count(*) AS n, sum(turn)::BIGINT AS idx_sum FROM issues GROUP BY ALL")
def doc_validation(spark, sf):
    """Structural findings over all conversation documents."""
    e = conv_entries(spark, sf)
    docs = e.select("doc_id").distinct().withColumn("is_list", F.lit(True))
    known = spark.createDataFrame([("cc.Node",)], "type string")
    return va.validate_docs(docs, e, known).groupBy("severity", "code").agg(rows_as("n"), F.sum("idx").alias("idx_sum"))


@query(f"""WITH {CONV}, per AS (SELECT conv_id, count(*) FILTER (WHERE severity = 'error') AS e, count(*) FILTER (WHERE severity = 'warning') AS w FROM issues GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(e, 0) = 0) AS passed, count(*) FILTER (WHERE e > 0) AS failures, coalesce(sum(w), 0)::BIGINT AS warnings FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN per USING (conv_id)""")
def validation_summary(spark, sf):
    e = conv_entries(spark, sf)
    docs = e.select("doc_id").distinct().withColumn("is_list", F.lit(True))
    known = spark.createDataFrame([("cc.Node",)], "type string")
    return va.validation_summary(va.validate_docs(docs, e, known), docs)


@query("""SELECT 'C' || c_custkey AS doc_id, c_mktsegment AS instance, 'Root/' || c_mktsegment AS instance_path, 'N' || c_nationkey AS source, prop, CASE prop WHEN '_name' THEN 'f' ELSE 'deep' END || c_nationkey AS local_id, prop = '_name' AS on_root
FROM customer, (VALUES ('_name'), ('_lpos.x')) t(prop)""")
def instance_overrides(spark, sf):
    """Overrides on nested instances, root level or deeper."""
    o = va.instance_overrides(dc.doc_entries(instance_docs(spark, sf)))
    return o.select("doc_id", "instance", "instance_path", "source", "prop", F.array_join("local_id", "/").alias("local_id"), "on_root")


@query("""SELECT 'C' || c_custkey AS doc_id, fid AS file_id, CASE fid WHEN 'root' THEN 'Root' ELSE 'Root/' || c_mktsegment END AS path FROM customer, LATERAL (SELECT unnest(['root', 'f' || c_nationkey]) AS fid)""")
def file_id_paths(spark, sf):
    return va.file_id_paths(dc.doc_entries(instance_docs(spark, sf)))


@query("""SELECT 'no-deep-instance-override' AS rule, 'deep instance override: "_lpos.x" on a node (localID deep' || c_nationkey || ') inside instance "Root/' || c_mktsegment || '"' AS message, 'p/' || c_custkey AS asset FROM customer""")
def deep_override_rule(spark, sf):
    """The nested-instance policy as a rule."""
    from refloom.operators.rules import Context, evaluate_rules

    nodes = table(spark, sf, "customer").select(key("C", "c_custkey").alias("id"), F.concat(F.lit("p/"), F.col("c_custkey").cast("string")).alias("path"), F.lit("prefab").alias("type"))
    links = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("type").alias("kind")).where(F.lit(False))
    g = Graph.from_links(nodes, links)
    ctx = Context(overrides=lambda: va.override_rows(dc.doc_entries(instance_docs(spark, sf)), g.nodes))
    return evaluate_rules(g, [{"name": "no-deep-instance-override"}], ctx).violations.select("rule", "message", "asset")


@query("SELECT conv_id AS doc_id, turn::INTEGER AS idx, role AS name FROM conversations WHERE contains(role, 'assist')")
def name_leaks(spark, sf):
    """Nodes whose name contains a forbidden text."""
    return va.name_leaks(conv_entries(spark, sf), "assist")


# ---- structure and edits -----------------------------------------------------------------------------


@query("""WITH p AS (SELECT 'P' || p_partkey AS doc_id, p_brand, p_name FROM part)
SELECT doc_id, 1::INTEGER AS idx, p_brand AS path, p_brand AS name, 0::INTEGER AS depth, true AS active, false AS instance FROM p
UNION ALL SELECT doc_id, 2, p_brand || '/' || p_name, p_name, 1, true, false FROM p""")
def list_nodes(spark, sf):
    """Depth-first structure of every document with paste-ready paths."""
    nodes, _ = sl.list_nodes(dc.doc_entries(part_docs(spark, sf)))
    return nodes.drop("order_key")


@query("""SELECT 'P' || p_partkey AS doc_id, kind, idx::INTEGER AS idx, prop, error FROM part, (VALUES ('node', 2, NULL, NULL), ('component', 3, NULL, NULL), ('property', 3, '_spriteFrame', NULL), ('property', 4, 'fileId', NULL), (NULL, NULL, NULL, 'no such node')) t(kind, idx, prop, error)""")
def resolve_selectors(spark, sf):
    """Five selector forms against every document."""
    p = table(spark, sf, "part")
    node = F.concat_ws("/", "p_brand", "p_name")
    s = p.select(
        key("P", "p_partkey").alias("doc_id"),
        F.explode(F.array(node, F.concat(node, F.lit(":cc.Sprite")), F.concat(node, F.lit(":cc.Sprite._spriteFrame")), F.lit("#4.fileId"), F.concat(F.lit("no/"), "p_name"))).alias("selector"),
    )
    return sl.resolve_selectors(s, dc.doc_entries(part_docs(spark, sf))).select("doc_id", "kind", "idx", "prop", "error")


@query(f"""WITH {DOCS} SELECT doc_id, '"' || p_name || '"' AS value FROM pd UNION ALL SELECT doc_id, '"' || brand_id || '@' || p_size || '"' FROM pd""")
def get_values(spark, sf):
    """Point reads at selectors in every document."""
    p = table(spark, sf, "part")
    s = p.select(key("P", "p_partkey").alias("doc_id"), F.explode(F.array(F.lit("#2._name"), F.lit("#3._spriteFrame.__uuid__"))).alias("selector"))
    return sl.get_values(s, dc.doc_entries(part_docs(spark, sf))).select("doc_id", "value")


@query(f"""WITH {DOCS}, m AS (SELECT p_brand, {UID.format('p_brand')} AS old, {UID.format("max(p_type)")} AS new FROM part GROUP BY p_brand)
SELECT doc_id, md5(replace(replace(text, '"' || old || '"', '"' || new || '"'), '"' || old || '@', '"' || new || '@')) AS digest FROM docs JOIN pd USING (doc_id) JOIN m USING (p_brand)""")
def rewrite_refs(spark, sf):
    """Every brand id replaced in every document text."""
    m = table(spark, sf, "part").groupBy("p_brand").agg(F.max("p_type").alias("t")).select(uid("p_brand").alias("old"), uid("t").alias("new"))
    out, _ = ed.rewrite_refs(part_docs(spark, sf), m)
    return out.select("doc_id", F.md5("text").alias("digest"))


@query(f"WITH {DOCS} SELECT doc_id, brand_id AS old, 1::BIGINT AS n FROM pd UNION ALL SELECT doc_id, type_id, 1 FROM pd")
def rewrite_counts(spark, sf):
    """How often each rewritten id occurred in each document."""
    p = table(spark, sf, "part")
    m = p.select(F.explode(F.array(uid("p_brand"), uid("p_type"))).alias("old")).distinct().withColumn("new", F.lit("00000000-0000-0000-0000-000000000000"))
    return ed.rewrite_refs(part_docs(spark, sf), m)[1].select("doc_id", "old", "n")


# the entries of a part document as they are written, keys in order
SHOWN = {
    0: """'{"__type__":"cc.Prefab","_name":"' || p_name || '","data":{"__id__":1}}'""",
    1: """'{"__type__":"cc.Node","_children":[{"__id__":2}],"_components":[],"_name":"' || p_brand || '","_parent":null,"_prefab":{"__id__":4}}'""",
    2: """'{"__type__":"cc.Node","_children":[],"_components":[{"__id__":3}],"_name":"' || p_name || '","_parent":{"__id__":1},"_prefab":null}'""",
    3: """'{"__type__":"cc.Sprite","_clips":[null,{"__uuid__":"' || type_id || '"}],"_events":[{"__id__":5}],"_spriteFrame":{"__uuid__":"' || brand_id || '@' || p_size || '"},"node":{"__id__":2}}'""",
    4: """'{"__type__":"cc.PrefabInfo","asset":{"__uuid__":"' || name_id || '"},"fileId":"f' || p_partkey || '","root":{"__id__":1}}'""",
    5: """'{"__type__":"cc.ClickEvent","_componentId":"' || type_token || '","handler":"on' || p_size || '"}'""",
}


def _shown(changed: dict[int, str], where: str = "true", drop: tuple[int, ...] = ()) -> str:
    """SQL rows (doc_id, idx, value) of every part document with some entries changed."""
    rows = {i: v for i, v in (SHOWN | changed).items() if i not in drop}
    return " UNION ALL ".join(f"SELECT doc_id, {i}::INTEGER AS idx, {v} AS value FROM pd WHERE {where}" for i, v in rows.items())


def _entries_as_text(entries):
    return entries.select("doc_id", "idx", F.to_json("entry").alias("value"))


@query(f"""WITH {DOCS}
SELECT doc_id, idx, 'entry' AS what, value FROM ({_shown({2: SHOWN[2].replace("p_name", "upper(p_name)"), 3: SHOWN[3].replace('{"__uuid__":"' + "' || brand_id || '@' || p_size || '" + '"}', "1")})})
UNION ALL SELECT doc_id, 2, 'error', 'no existing property "_nope"' FROM pd UNION ALL SELECT doc_id, 3, 'warning', 'value kind "number" differs from "asset"' FROM pd""")
def apply_updates(spark, sf):
    """A rename, a typo and a type drift in every document; all entries and notes."""
    p, e = table(spark, sf, "part"), part_entries(spark, sf)
    d = key("P", "p_partkey").alias("doc_id")
    up = lambda i, prop, v: p.select(d, F.lit(i).alias("idx"), F.lit(0).alias("seq"), F.lit("set").alias("op"), F.lit(prop).alias("prop"), v.alias("value"))
    ups = up(2, "_name", F.concat(F.lit('"'), F.upper("p_name"), F.lit('"'))).unionByName(up(2, "_nope", F.lit("1"))).unionByName(up(3, "_spriteFrame", F.lit("1")))
    out, notes = ed.apply_updates(e, ups)
    kept = _entries_as_text(out).select("doc_id", "idx", F.lit("entry").alias("what"), "value")
    return kept.unionByName(notes.select("doc_id", "idx", F.col("level").alias("what"), F.col("note").alias("value")))


DELETED = {1: SHOWN[1].replace('[{"__id__":2}]', "[]").replace('"__id__":4', '"__id__":2'), 2: SHOWN[4]}


@query(f"WITH {DOCS} {_shown(DELETED, drop=(3, 4, 5))}")
def delete_entries(spark, sf):
    """The inner node of every document deleted with all it owns; the rest renumbered, references included."""
    e = part_entries(spark, sf)
    out, _, _ = ed.delete_entries(e, e.where(F.col("idx") == 2).select("doc_id", "idx"))
    return _entries_as_text(out)


@query("""SELECT 'P' || p_partkey AS doc_id, 'removed 3' AS outcome FROM part UNION ALL SELECT 'P' || p_partkey, 'cannot remove the root node' FROM part""")
def delete_report(spark, sf):
    e = part_entries(spark, sf)
    _, report, errors = ed.delete_entries(e, e.where(F.col("idx").isin(1, 2)).select("doc_id", "idx"))
    return report.select("doc_id", F.concat(F.lit("removed "), F.col("removed").cast("string")).alias("outcome")).unionByName(errors.select("doc_id", F.col("error").alias("outcome")))


@query("""WITH c AS (SELECT conv_id, max(turn) AS last, arg_max(role, turn) = 'system' AS last_note, arg_min(role, turn) = 'system' AS first_note FROM conversations GROUP BY 1),
m AS (SELECT *, last > 1 AND NOT last_note AND NOT first_note AS moved FROM c),
id AS (SELECT '{"__id__":' AS a, '}' AS b)
SELECT conv_id AS doc_id, turn::INTEGER AS idx, CASE WHEN moved AND turn = last THEN 0 WHEN turn > 0 THEN turn - 1 END::INTEGER AS parent,
  CASE WHEN moved AND turn = last - 1 THEN '[]' WHEN moved AND turn = 0 THEN '[' || a || '1' || b || ',' || a || last || b || ']' ELSE '[' || a || (turn + 1) || b || ']' END AS children, '' AS error
FROM conversations JOIN m USING (conv_id), id
UNION ALL SELECT conv_id, last::INTEGER, NULL, NULL, CASE WHEN last_note THEN 'not a node' ELSE 'parent is not a node' END FROM m WHERE last > 1 AND NOT moved
UNION ALL SELECT conv_id, 0, NULL, NULL, CASE WHEN first_note THEN 'not a node' WHEN last_note THEN 'parent is not a node' ELSE 'cannot move a node into its own descendant' END FROM m WHERE last > 0""")
def set_parent(spark, sf):
    """The last turn moved below the first and the first below the last, in every conversation; all entries and refusals."""
    e = conv_entries(spark, sf)
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").cast("int").alias("last"))
    down = c.where("last > 1").select(F.col("conv_id").alias("doc_id"), F.col("last").alias("idx"), F.lit(0).alias("new_parent"), F.lit(-1).alias("pos"))
    loop = c.where("last > 0").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("idx"), F.col("last").alias("new_parent"), F.lit(-1).alias("pos"))
    out, bad = ed.set_parent(e, down.unionByName(loop))
    none = F.lit(None)
    shown = out.select("doc_id", "idx", dc.ref_at("entry", "$._parent").alias("parent"), F.to_json(F.try_variant_get("entry", "$._children", "variant")).alias("children"), F.lit("").alias("error"))
    return shown.unionByName(bad.select("doc_id", "idx", none.cast("int").alias("parent"), none.cast("string").alias("children"), "error"))


GROWN = {
    1: SHOWN[1].replace('[{"__id__":2}]', '[{"__id__":2},{"__id__":6}]'),
    6: """'{"__type__":"cc.Node","_children":[],"_components":[],"_name":"New ' || p_size || '","_parent":{"__id__":1},"_prefab":{"__id__":7}}'""",
    7: """'{"__type__":"cc.PrefabInfo","asset":{"__id__":0},"fileId":"' || rpad('f6', 22, 'x') || '","root":{"__id__":1}}'""",
}


@query(f"WITH {DOCS} {_shown(GROWN)}")
def add_nodes(spark, sf):
    """A node appended to every document from its own template, and linked; all entries."""
    p = table(spark, sf, "part")
    adds = p.select(key("P", "p_partkey").alias("doc_id"), F.lit(0).alias("seq"), F.lit(1).alias("parent"), F.concat(F.lit("New "), F.col("p_size").cast("string")).alias("name"), F.lit(-1).alias("pos"))
    out, _ = ed.add_nodes(part_entries(spark, sf), adds)
    return _entries_as_text(out)


@query("""SELECT 'C' || c_custkey AS doc_id, n::BIGINT AS entries, over::BIGINT AS overrides, v AS value FROM customer, LATERAL (SELECT 12 AS n, 3 AS over, '7' AS v) t""")
def upsert_overrides(spark, sf):
    """A new root override on every nested instance, next to the two that exist."""
    e = dc.doc_entries(instance_docs(spark, sf))
    want = table(spark, sf, "customer").select(key("C", "c_custkey").alias("doc_id"), F.lit(0).alias("seq"), F.lit(3).alias("node"), F.lit("_layer").alias("prop"), F.lit("7").alias("value"))
    out, _ = ed.upsert_overrides(e, want)
    out = cut(out).df
    per = out.groupBy("doc_id").agg(rows_as("entries"), F.count_if(F.col("type") == dc.OVERRIDE_TYPE).alias("overrides"))
    baked = out.where(F.col("idx") == 3).select("doc_id", F.try_variant_get("entry", "$._layer", "string").alias("value"))
    return per.join(baked, "doc_id")


@query("SELECT conv_id AS doc_id, turn::INTEGER AS idx, 'changed' AS change FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, max(turn)::INTEGER + 1, 'added' FROM conversations GROUP BY conv_id")
def diff_versions(spark, sf):
    """A keyed diff of documents before and after a bulk rename and an append."""
    e = conv_entries(spark, sf)
    ups = table(spark, sf, "conversations").where(F.col("role") == "user").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("idx"), F.lit(0).alias("seq"), F.lit("set").alias("op"), F.lit("_name").alias("prop"), F.lit('"person"').alias("value")
    )
    new, _ = ed.apply_updates(e, ups)
    tail = e.groupBy("doc_id").agg((F.max("idx") + 1).alias("idx")).select("doc_id", "idx", F.lit("cc.Node").alias("type"), F.parse_json(F.lit('{"__type__":"cc.Node"}')).alias("entry"))
    return ed.entry_diff(e, new.unionByName(tail)).select("doc_id", "idx", "change")


@query("SELECT doc_id, quality::INTEGER AS expected_version, quality = (lang = 'en')::INTEGER AS applied FROM labels JOIN documents USING (doc_id)")
def require_version(spark, sf):
    """Instructions refused when the document has moved on."""
    docs = table(spark, sf, "documents").select("doc_id", (F.col("lang") == "en").cast("int").alias("version"))
    ops = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("expected_version"))
    good, bad = ed.require_version(ops, docs)
    return good.withColumn("applied", F.lit(True)).unionByName(bad.withColumn("applied", F.lit(False)))


@query("""SELECT 'P' || p_partkey AS doc_id, CASE WHEN p_size > 25 THEN p_name ELSE upper(p_name) END AS name, (p_size <= 25)::INTEGER AS components FROM part""")
def apply_batch(spark, sf):
    """An ordered batch per document; documents whose second step fails keep their first state."""
    p, e = table(spark, sf, "part"), part_entries(spark, sf)
    none = F.lit(None)
    row = lambda seq, kind, idx, prop, value: p.select(
        key("P", "p_partkey").alias("doc_id"), F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), idx.cast("int").alias("idx"), none.cast("string").alias("prop") if prop is None else F.lit(prop).alias("prop"),
        value.alias("value"), none.cast("int").alias("target"), none.cast("int").alias("pos"),
    )
    ops = row(0, "set", F.lit(2), "_name", F.concat(F.lit('"'), F.upper("p_name"), F.lit('"'))).unionByName(
        row(1, "add_component", F.when(F.col("p_size") > 25, F.lit(3)).otherwise(F.lit(1)), None, F.lit("cc.Label"))
    )
    out, _ = ed.apply_batch(e, ops)
    out = cut(out).df
    named = out.where(F.col("idx") == 2).select("doc_id", F.try_variant_get("entry", "$._name", "string").alias("name"))
    comps = out.groupBy("doc_id").agg(F.count_if(F.col("type") == "cc.Label").cast("int").alias("components"))
    return named.join(comps, "doc_id")


CLONED = {
    3: SHOWN[3].replace("[null,", '[{"__id__":7},null,').replace('[{"__id__":5}]', '[{"__id__":5},{"__id__":6}]'), 6: SHOWN[5], 7: """'{"__type__":"my.Clip"}'""",
}


@query(f"""WITH {DOCS} SELECT doc_id, idx, value FROM ({_shown(CLONED)}) UNION ALL SELECT doc_id, 3, 'no element of the array to clone' FROM pd""")
def array_objects(spark, sf):
    """An event cloned behind its like, a new clip put first, and a clone without an example, in every document."""
    p = table(spark, sf, "part").select(key("P", "p_partkey").alias("doc_id"))
    row = lambda seq, op, prop, value: p.select("doc_id", F.lit(3).alias("idx"), F.lit(seq).alias("seq"), F.lit(op).alias("op"), F.lit(prop).alias("prop"), F.lit(value).alias("value"))
    ops = row(0, "insert_clone", "_events", "{}").unionByName(row(1, "insert_type", "_clips", '{"at":0,"type":"my.Clip"}')).unionByName(row(2, "insert_clone", "_clips", "{}"))
    out, notes = ed.array_edit(part_entries(spark, sf), ops)
    return _entries_as_text(out).unionByName(notes.where("level = 'error'").select("doc_id", "idx", F.col("note").alias("value")))


BATCHED = {1: SHOWN[1].replace("|| p_brand ||", "|| 'B' ||")}
LABELLED = BATCHED | {
    1: BATCHED[1].replace('"_components":[]', '"_components":[{"__id__":6}]'), 2: SHOWN[2].replace("p_name", "upper(p_name)"),
    6: """'{"__prefab":{"__id__":7},"__type__":"cc.Label","_enabled":true,"_id":"' || rpad('c6', 22, 'x') || '","_name":"","_objFlags":0,"node":{"__id__":1}}'""",
    7: """'{"__type__":"cc.CompPrefabInfo","fileId":"' || rpad('f6', 22, 'x') || '"}'""",
}
PRUNED = {k: v.replace("p_brand", "'B'") for k, v in DELETED.items()}


@query(f"""WITH {DOCS}
SELECT doc_id, idx, value FROM ({_shown(LABELLED, "p_size <= 20")} UNION ALL {_shown(PRUNED, "p_size > 20 AND p_size <= 40", (3, 4, 5))} UNION ALL {_shown({}, "p_size > 40")})
UNION ALL SELECT doc_id, NULL, 'no such entry' FROM pd WHERE p_size > 40""")
def batch_documents(spark, sf):
    """Batches whose step numbers differ from document to document: two renames, then a component, a delete or a failure."""
    p, e = table(spark, sf, "part"), part_entries(spark, sf)
    none = F.lit(None)

    def row(seq, kind, idx, prop, value, which="true"):
        return p.where(which).select(
            key("P", "p_partkey").alias("doc_id"), (F.col("p_size") * 10 + seq).alias("seq"), F.lit(kind).alias("kind"), F.lit(idx).alias("idx"), F.lit(prop).alias("prop"), value.alias("value"),
            none.cast("int").alias("target"), none.cast("int").alias("pos"),
        )

    ops = row(0, "set", 2, "_name", F.concat(F.lit('"'), F.upper("p_name"), F.lit('"'))).unionByName(row(1, "set", 1, "_name", F.lit('"B"')))
    ops = ops.unionByName(row(7, "add_component", 1, None, F.lit("cc.Label"), "p_size <= 20")).unionByName(row(9, "delete", 2, None, none.cast("string"), "p_size > 20 AND p_size <= 40"))
    ops = ops.unionByName(row(8, "delete", 77, None, none.cast("string"), "p_size > 40"))
    out, errors = ed.apply_batch(e, ops)
    return _entries_as_text(out).unionByName(errors.select("doc_id", none.cast("int").alias("idx"), F.col("error").alias("value")))


# ---- refresh -------------------------------------------------------------------------------------------


# page by page: version 4 brings emptied pages back, version 3 has new links, version 2 empties; of version 1 the later batch counts
REFRESHED = """CASE WHEN page_id % 7 = 2 AND page_id % 2 = 0 THEN html WHEN page_id % 3 = 0 THEN replace(html, 'href="', 'href="new-')
  WHEN page_id % 7 = 2 THEN '' WHEN page_id % 11 = 5 THEN replace(html, 'href="', 'href="late-') ELSE html END"""


@query(f"""SELECT 'W' || page_id AS src, ref AS dst, 'href' AS kind, count(*) AS weight
FROM (SELECT page_id, unnest(regexp_extract_all({REFRESHED}, '{HREF.replace("'", "''")}', 1)) AS ref FROM pages) GROUP BY ALL""")
def refresh_links(spark, sf):
    """Page links kept by the refresh stream over three batches of new, replaced, older and emptied pages, read back as edges."""
    home = f"{ensure_checkpoint_dir(spark)}/refresh-{uuid.uuid4().hex}"
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("n"), key("W", "page_id").alias("doc_id"), "html")
    text = lambda mark: F.replace("html", F.lit('href="'), F.lit(f'href="{mark}'))
    change = lambda which, version, body: pages.where(which).select("doc_id", F.lit(version).cast("long").alias("version"), body.alias("text"))
    batches = [
        change("true", 1, F.col("html")),
        change("n % 3 = 0", 3, text("new-")).unionByName(change("n % 5 = 1", 0, F.lit(""))).unionByName(change("n % 7 = 2", 2, F.lit(""))).unionByName(change("n % 7 = 2", 1, F.col("html"))),
        change("n % 3 = 0", 2, F.col("html")).unionByName(change("n % 7 = 2 AND n % 2 = 0", 4, F.col("html"))).unionByName(change("n % 11 = 5", 1, text("late-"))),
    ]

    def links(batch):
        return batch.select(F.col("doc_id").alias("src"), F.explode(F.regexp_extract_all("text", F.lit(HREF), F.lit(1))).alias("ref"), F.lit("href").alias("kind"))

    for batch in batches:
        batch.write.mode("append").parquet(f"{home}/feed")
        stream = spark.readStream.schema(batch.schema).parquet(f"{home}/feed")
        refresh_stream(stream, links, f"{home}/refs", f"{home}/offsets").awaitTermination()
    return current_edges(spark, f"{home}/refs").select("src", "dst", "kind", "weight")


@query("SELECT 'P' || p_partkey AS doc_id, 'u' || p_partkey AS ref, p_size::INTEGER AS depth FROM part")
def deep_refs(spark, sf):
    """A reference nested as deeply as the part's size (up to 50 levels) is found with its whole path."""
    text = F.concat(F.lit('[{"__type__":"cc.Node","v":'), F.repeat(F.lit('{"a":'), F.col("p_size")), F.lit('{"__uuid__":"u'), F.col("p_partkey").cast("string"), F.lit('"}'), F.repeat(F.lit("}"), F.col("p_size")), F.lit("}]"))
    docs = table(spark, sf, "part").select(key("P", "p_partkey").alias("doc_id"), text.alias("text"))
    refs = dc.walk_refs(dc.doc_entries(docs)).where("what = 'ref'")
    return refs.select("doc_id", "ref", (F.size(F.split("property", "\\.")) - 1).cast("int").alias("depth"))
