"""Duplicates, shared names, signatures, lookup and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.functions.scalar import match_positions
from refloom.operators import duplicates as dp
from refloom.operators import lookup as lk
from refloom.operators import search as se
from refloom.sources.tables import key
from refloom.workload.base import query, rows_as
from refloom.workload.inputs import STAR, star_graph, table


def _doc_files(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(key("D", "doc_id").alias("id"), F.lit("document").alias("type"), F.octet_length("text").cast("long").alias("size"), F.col("text").alias("content"))


def _doc_nodes(spark, sf):
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels").groupBy("doc_id").agg(rows_as("in_degree"))
    return d.join(lab, "doc_id", "left").select(
        key("D", "doc_id").alias("id"), F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string")).alias("path"), F.lit("document").alias("type"),
        F.octet_length("text").cast("long").alias("size"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"), (F.col("lang") == "en").alias("in_resources"),
        F.col("source").alias("importer"), F.col("lang").alias("user_data"),
    )


def file_groups(spark, sf):
    return dp.annotate_groups(dp.content_duplicates(_doc_files(spark, sf)), _doc_nodes(spark, sf))


GROUPS = """
d AS (SELECT 'D' || doc_id AS id, source || '/' || doc_id AS path, strlen(text)::BIGINT AS size, sha256(text) AS h, lang = 'en' AS res, source, lang,
  (SELECT count(*) FROM labels l WHERE l.doc_id = documents.doc_id) AS indeg FROM documents WHERE strlen(text) > 0),
g AS (SELECT h, size FROM d GROUP BY ALL HAVING count(*) > 1),
m AS (SELECT d.*, row_number() OVER (PARTITION BY d.h, d.size ORDER BY indeg DESC, res DESC, length(path), path) AS r FROM d JOIN g ON d.h = g.h AND d.size = g.size)"""


@query(f"""WITH {GROUPS}
SELECT size || ':' || h AS gid, count(*) AS count, any_value(size) AS size, any_value(size) * (count(*) - 1) AS reclaimable, count(DISTINCT source || '|' || lang) = 1 AS mergeable,
  concat_ws(',', CASE WHEN count(DISTINCT source || '|' || lang) > 1 THEN 'import-settings-differ' END, CASE WHEN bool_or(res) AND NOT bool_and(res) THEN 'spans-resources' END) AS warnings,
  max(CASE WHEN r = 1 THEN id END) AS canonical, max(CASE WHEN r = 1 THEN path END) AS canonical_path FROM m GROUP BY h, size""")
def exact_duplicates(spark, sf):
    """Groups of documents with the same text, annotated."""
    return file_groups(spark, sf)


@query(f"WITH {GROUPS} SELECT size || ':' || m.h AS gid, id, k.canonical FROM m JOIN (SELECT h, size AS s, id AS canonical FROM m WHERE r = 1) k ON k.h = m.h AND k.s = m.size WHERE r > 1")
def redundant_documents(spark, sf):
    """Every redundant copy with the member to keep: the input of a merge."""
    members = dp.content_duplicates(_doc_files(spark, sf))
    return dp.redundant_members(members, dp.annotate_groups(members, _doc_nodes(spark, sf)))


@query("""SELECT event_type AS type, replace(props, ' ', '') AS canonical, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1""")
def canonical_json_dups(spark, sf):
    """Event properties that are the same JSON, per event type."""
    e = table(spark, sf, "events")
    docs = e.select(F.col("event_id").cast("string").alias("id"), F.col("props").alias("text"), F.col("event_type").alias("type"))
    groups = dp.canonical_duplicates(docs)
    from refloom.functions.scalar import canonical_json

    named = docs.select("id", canonical_json("text").alias("canonical"))
    return groups.join(named, "id").groupBy("type", "canonical").agg(rows_as("n"))


@query("""SELECT event_type AS type, count(*) AS members, 1::BIGINT AS groups FROM events GROUP BY event_type HAVING count(*) > 1""")
def volatile_json_dups(spark, sf):
    """The same with the varying key blanked: one group per event type."""
    e = table(spark, sf, "events")
    docs = e.select(F.col("event_id").cast("string").alias("id"), F.col("props").alias("text"), F.col("event_type").alias("type"))
    g = dp.canonical_duplicates(docs, volatile=("k",))
    return g.groupBy("type").agg(rows_as("members"), F.countDistinct("gid").alias("groups"))


@query(f"""WITH {GROUPS},
f AS (SELECT any_value(size) * (count(*) - 1) AS r FROM m GROUP BY h, size),
c AS (SELECT 0 AS r FROM (SELECT 1 FROM events GROUP BY event_type, props HAVING count(*) > 1))
SELECT 'files' AS axis, count(*) AS groups, coalesce(sum(r), 0)::BIGINT AS reclaimable FROM f UNION ALL SELECT 'configs', count(*), coalesce(sum(r), 0)::BIGINT FROM c
UNION ALL SELECT 'total', (SELECT count(*) FROM f) + (SELECT count(*) FROM c), (SELECT coalesce(sum(r), 0) FROM f)::BIGINT""")
def duplicates_summary(spark, sf):
    e = table(spark, sf, "events")
    docs = e.select(F.col("event_id").cast("string").alias("id"), F.col("props").alias("text"), F.col("event_type").alias("type"))
    nodes = e.select(F.col("event_id").cast("string").alias("id"), F.col("event_id").cast("string").alias("path"), F.col("event_type").alias("type"), F.lit(0).cast("long").alias("size"),
                     F.lit(0).alias("in_degree"), F.lit(False).alias("in_resources"), F.lit("event").alias("importer"), F.lit(None).cast("string").alias("user_data"))
    configs = dp.annotate_groups(dp.canonical_duplicates(docs), nodes)
    return dp.duplicates_summary(file_groups(spark, sf), configs)


@query("""WITH f AS (SELECT p_brand, p_name || '/' || p_type AS name, arg_min(p_size, p_partkey) AS w FROM part GROUP BY ALL),
u AS (SELECT DISTINCT p_brand, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT name, count(*) AS containers, count(DISTINCT w) AS dims, min(w || 'x' || w) AS first_dims, CASE WHEN count(DISTINCT w) = 1 AND min(w) > 0 THEN 'likely' ELSE 'name-only' END AS confidence,
  (SELECT count(DISTINCT l_suppkey) FROM u WHERE u.p_brand IN (SELECT p_brand FROM f f2 WHERE f2.name = f.name)) AS users
FROM f GROUP BY name HAVING count(*) >= 2""")
def shared_names(spark, sf):
    """Part names packed into several brands, with the suppliers that use those brands."""
    p = table(spark, sf, "part")
    rec = p.select(F.col("p_brand").alias("container"), F.concat_ws("/", "p_name", "p_type").alias("name"), F.col("p_size").alias("w"), F.col("p_size").alias("h"), F.col("p_partkey").alias("ord"))
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    users = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("container"), F.col("l_suppkey").alias("user"))
    return dp.shared_names(rec, users)


ROT = "list_transform(range(64), lambda i: {0})"
TURNS = {0: "i", 1: "(7 - i % 8) * 8 + i // 8", 2: "63 - i", 3: "(i % 8) * 8 + 7 - i // 8"}


def _l1(turn: str) -> str:
    return f"list_sum(list_transform(range(64), lambda i: abs(a.embedding[i + 1]::DOUBLE - b.embedding[{turn} + 1]::DOUBLE))) / 64"


@query(f"""WITH w AS (SELECT a.label AS gid, max(least(1, {', '.join(_l1(t) for t in TURNS.values())})) AS worst FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1),
n AS (SELECT label AS gid, count(*) AS members FROM embeddings GROUP BY 1 HAVING count(*) >= 2)
SELECT gid, members, CASE WHEN worst <= 0.145 THEN 'confirmed' ELSE 'different' END AS verdict FROM n JOIN w USING (gid)""")
def signature_confirm(spark, sf):
    """Whether the vectors of each label, read as 8x8 grids, agree within a threshold up to quarter turns."""
    e = table(spark, sf, "embeddings").select(F.col("label").alias("gid"), F.col("vec_id").alias("member"), F.col("embedding").alias("sig"))
    return dp.confirm_groups(e, 8, threshold=0.145, scale=1.0)


# ---- lookup -----------------------------------------------------------------------------------------


def _brand_files(spark, sf):
    """Part names as files of their brand folder."""
    p = table(spark, sf, "part")
    return p.select("p_brand", "p_name").distinct().select(
        F.concat_ws(":", "p_brand", "p_name").alias("id"), F.concat(F.lower("p_brand"), F.lit("/"), F.initcap("p_name"), F.lit(".png")).alias("path")
    )


FILES = """
files AS (SELECT DISTINCT p_brand || ':' || p_name AS id, lower(p_brand) || '/' || upper(p_name[1]) || regexp_extract(p_name, '^.([^ ]*)', 1) || ' ' || upper(regexp_extract(p_name, ' (.)', 1)) || regexp_extract(p_name, ' .(.*)$', 1) || '.png' AS path FROM part),
qs AS (SELECT DISTINCT unnest([p_brand || ':' || p_name, 'db://assets/' || lower(p_brand) || '/' || p_name || '.png', p_name, '"' || p_name || '.png"', p_name || '?']) AS query FROM part),
qk AS (SELECT query, trim(query, '"') AS c, replace(trim(query, '"'), 'db://assets/', '') AS q FROM qs),
fk AS (SELECT id, path, regexp_replace(path, '\\.[^./]+$', '') AS bare FROM files),
hit AS (
  SELECT query, 0 AS t, id FROM qk JOIN fk ON c = id
  UNION SELECT query, 1, id FROM qk JOIN fk ON q = path OR c = path
  UNION SELECT query, 2, id FROM qk JOIN fk ON q = regexp_extract(path, '[^/]*$')
  UNION SELECT query, 3, id FROM qk JOIN fk ON q = bare OR q = regexp_extract(bare, '[^/]*$')
  UNION SELECT query, 4, id FROM qk JOIN fk ON lower(q) IN (lower(path), lower(regexp_extract(path, '[^/]*$')), lower(bare), lower(regexp_extract(bare, '[^/]*$')))),
best AS (SELECT query, min(t) AS t FROM hit GROUP BY 1),
res AS (SELECT query, t, count(DISTINCT id) AS hits, min(id) AS id FROM hit JOIN best USING (query, t) GROUP BY ALL)"""


@query(f"""WITH {FILES}
SELECT query, CASE WHEN hits IS NULL THEN 'none' WHEN hits = 1 THEN 'unique' ELSE 'ambiguous' END AS status, ['id', 'path', 'suffix', 'no-extension', 'ignore-case'][t + 1] AS tier,
  coalesce(hits, 0) AS hits, CASE WHEN hits = 1 THEN id END AS id FROM qs LEFT JOIN res USING (query)""")
def resolve_names(spark, sf):
    """Five ways of naming every part, resolved tier by tier."""
    p = table(spark, sf, "part").select("p_brand", "p_name").distinct()
    q = p.select(
        F.explode(
            F.array(
                F.concat_ws(":", "p_brand", "p_name"), F.concat(F.lit("db://assets/"), F.lower("p_brand"), F.lit("/"), "p_name", F.lit(".png")), F.col("p_name"),
                F.concat(F.lit('"'), "p_name", F.lit('.png"')), F.concat("p_name", F.lit("?")),
            )
        ).alias("query")
    )
    return lk.resolve_names(q, _brand_files(spark, sf))


@query(f"""WITH {FILES},
miss AS (SELECT DISTINCT replace(p_name, 'e', 'x') || '.png' AS query FROM part),
nb AS (SELECT path, lower(regexp_extract(path, '[^/]*$')) AS b FROM files),
cand AS (SELECT query, path, least(levenshtein(query, b), levenshtein(query, regexp_replace(b, '\\.[^./]+$', '')))::INTEGER AS distance, greatest(2, floor(greatest(length(query), length(b)) * 0.4)) AS tol FROM miss, nb)
SELECT query, path, distance, row_number() OVER (PARTITION BY query ORDER BY distance, path)::INTEGER AS rank FROM cand WHERE distance <= tol QUALIFY rank <= 5""")
def suggest_names(spark, sf):
    """Nearest files for every part name with one letter replaced."""
    p = table(spark, sf, "part")
    q = p.select(F.concat(F.regexp_replace("p_name", "e", "x"), F.lit(".png")).alias("query")).distinct()
    return lk.suggest_names(q, _brand_files(spark, sf))


# ---- search -----------------------------------------------------------------------------------------


def _indexed(spark, sf):
    return se.search_index(star_graph(spark, sf))


@query(f"""WITH {STAR},
e AS (SELECT dst, kind, coalesce(regexp_extract(f.path, '[^/]*$') || ' → ' || regexp_extract(t.path, '[^/]*$')) AS label FROM edges JOIN nodes f ON f.id = src JOIN nodes t ON t.id = dst)
SELECT 'asset' AS entry, type AS kind, count(*) AS n, count(DISTINCT regexp_extract(path, '[^/]*$')) AS labels FROM nodes GROUP BY ALL
UNION ALL SELECT 'edge', kind, count(*), count(DISTINCT label) FROM e GROUP BY ALL""")
def search_index(spark, sf):
    i = _indexed(spark, sf)
    return i.groupBy("entry", F.coalesce("edge_kind", "type").alias("kind")).agg(rows_as("n"), F.countDistinct("label").alias("labels"))


SCORE = """CASE WHEN instr(t, '{q}') = 1 THEN 1000.0 - length(t) WHEN instr(t, '{q}') > 1 THEN
  (CASE WHEN contains('/_-. ', t[(instr(t, '{q}') - 1)::INT]) THEN 700.0 ELSE 500.0 END) - (instr(t, '{q}') - 1) - length(t) * 0.1
  WHEN p{last} IS NOT NULL THEN {gains} ELSE -1 END"""


def _places(source: str, q: str) -> str:
    """``source`` with the 1-based places p0, p1, ... of the letters of ``q`` in column t, each after the one before."""
    for i, ch in enumerate(q):
        prev = f"p{i - 1}" if i else "0"
        source = f"(SELECT *, {prev} + nullif(instr(substr(t, {prev} + 1), '{ch}'), 0) AS p{i} FROM {source})"
    return source


def _scored(source: str, q: str) -> str:
    """(id, score) by prefix, substring or letters in order."""
    gains = " + ".join(f"1 + CASE WHEN p{i} = 1 OR contains('/_-. ', t[(p{i} - 1)::INT]) THEN 5 ELSE 0 END" + (f" + CASE WHEN p{i} = p{i - 1} + 1 THEN 3 ELSE 0 END" if i else "") for i in range(len(q)))
    return f"(SELECT id, {SCORE.format(q=q, last=len(q) - 1, gains=gains)} AS score FROM {_places(source, q)})"


def _best(where: str, q: str) -> str:
    """(id, score): the better of a node's name and its path, if one of them fits."""
    nodes = "(SELECT id, lower({}) AS t FROM nodes WHERE {})"
    name, path = nodes.format("regexp_extract(path, '[^/]*$')", where), nodes.format("path", where)
    return f"(SELECT id, round(max(score), 6)::DOUBLE AS score FROM (SELECT * FROM {_scored(name, q)} UNION ALL SELECT * FROM {_scored(path, q)}) GROUP BY id HAVING max(score) >= 0)"


@query(f"WITH {STAR} SELECT 'asset' AS entry, id AS target, score FROM {_best('true', 'bolt')}")
def fuzzy_search(spark, sf):
    """Prefix, substring and subsequence hits of an unscoped query."""
    return se.search(_indexed(spark, sf), "bolt").select("entry", "target", F.round("score", 6).alias("score"))


@query(f"WITH {STAR} SELECT id AS target, score FROM {_best("type = 'part'", 'brand#7')}")
def type_scope_search(spark, sf):
    """``#part brand#7``: filter by type, then search."""
    return se.search(_indexed(spark, sf), "#part Brand#7").select("target", F.round("score", 6).alias("score"))


@query(f"WITH {STAR} SELECT id AS target, score FROM {_best("type = 'part'", 'rdwgt')}")
def subsequence_search(spark, sf):
    """``#part rdwgt``: parts that hold letters in order; the text after the first word is searched."""
    return se.search(_indexed(spark, sf), "#part rdwgt").select("target", F.round("score", 6).alias("score"))


@query(f"WITH {STAR} SELECT kind AS edge_kind, count(*) AS n FROM edges WHERE contains(kind, 'in-') GROUP BY kind")
def kind_facets(spark, sf):
    """``~in-``: the edge kinds that match, with counts."""
    return se.kind_facets(_indexed(spark, sf), "~in-")


@query(f"""SELECT t AS p_name, CASE WHEN contains(t, 'bolt')
  THEN array_to_string(flatten(list_transform(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 4) = 'bolt'), lambda i: range(i - 1, i + 3))), ',')
  WHEN p3 IS NOT NULL THEN concat_ws(',', p0 - 1, p1 - 1, p2 - 1, p3 - 1) END AS positions
FROM {_places('(SELECT DISTINCT lower(p_name) AS t FROM part)', 'bolt')}""")
def highlight(spark, sf):
    """Matched character positions in every part name: substrings, else letters in order, else none."""
    p = table(spark, sf, "part").select(F.lower("p_name").alias("p_name")).distinct()
    return p.select("p_name", F.array_join(F.transform(match_positions("bolt", "p_name"), lambda i: i.cast("string")), ",").alias("positions"))
