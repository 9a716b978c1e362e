"""One query per operator with production parameters, over whole tables, and the SQL where it can be expressed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm import bpe, decontaminate, languages, lines, lm, merkle, packing, quality, sharding, simhash, substrings, toxicity, trie
from refloom.llm.sample import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, value: int):
    return F.coalesce(remainder("doc_id", modulus) == value, F.lit(False))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
    return toxicity.score_documents(docs, model).withColumn("held_out", held_out(5, 0))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


ORACLE["op2_line_dedup"] = """
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS raws FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(raws) AS raw, unnest(range(len(raws))) AS line FROM parts),
n AS (SELECT *, trim(translate(lower(raw), chr(9) || chr(13) || chr(11) || chr(12), '    '), ' ') AS t, doc_id * 1000000000 + line AS place FROM l),
d AS (SELECT t, length(t) AS size, min(place) AS place FROM n WHERE t <> '' GROUP BY t),
sizes AS (SELECT *, size AS short FROM d UNION ALL SELECT *, size - 1 AS short FROM d),
halves AS (SELECT *, left(t, short // 2) AS low, right(t, short - short // 2) AS high FROM sizes),
pairs AS (
  SELECT a.t, a.size, a.place, b.t AS ot, b.size AS osize, b.place AS oplace FROM halves a JOIN halves b ON a.short = b.short AND a.low = b.low AND a.size = a.short AND a.t <> b.t
  UNION
  SELECT a.t, a.size, a.place, b.t AS ot, b.size AS osize, b.place AS oplace FROM halves a JOIN halves b ON a.short = b.short AND a.high = b.high AND a.size = a.short AND a.t <> b.t),
close AS (SELECT * FROM pairs WHERE CASE WHEN size = osize
  THEN len(list_filter(range(1, size + 1), lambda i: substr(t, i, 1) <> substr(ot, i, 1))) = 1
  ELSE len(list_filter(range(0, size + 1), lambda i: left(t, i) = left(ot, i) AND substr(t, i + 1) = substr(ot, i + 2))) > 0 END),
near AS (SELECT t, min(oplace) AS place FROM (SELECT t, oplace FROM close UNION ALL SELECT ot AS t, place AS oplace FROM close) GROUP BY t),
firsts AS (SELECT d.t, least(d.place, coalesce(near.place, d.place)) AS place FROM d LEFT JOIN near ON d.t = near.t),
flags AS (SELECT n.*, coalesce(n.place > firsts.place, false) AS gone FROM n LEFT JOIN firsts ON n.t = firsts.t),
kept AS (SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM flags GROUP BY doc_id)
SELECT doc_id, text, n_lines, n_removed FROM kept UNION ALL SELECT doc_id, text, 0, 0 FROM documents WHERE text IS NULL
"""


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary())


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"), digest=True)


@query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(10, 0))
    return lm.score_documents(docs, "held_out", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.balanced(2, 2, 4)
    return sharding.shard_documents(table(spark, sf_dir, "documents"), tree).withColumn("law", F.lit("key"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = languages.train(docs.where(remainder("doc_id", 4) != 2))
    return languages.identify(docs, field).withColumn("held_out", held_out(4, 2))


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


def sql_crc32(number: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of a number's decimal text."""
    codes = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    step = "list_reduce(list_prepend(xor(v, b), range(8)), lambda w, i: CASE WHEN w & 1 = 1 THEN xor(w >> 1, 3988292384) ELSE w >> 1 END)"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda v, b: {step}))"


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("chars", "n_ends")


ORACLE["op11_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
d AS (SELECT conv_id, turn, sha256(concat(octet_length(encode(role)), ':', role, text)) AS digest, length(text) AS chars FROM t),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos FROM d),
c AS (SELECT conv_id, count(*) AS n, {sql_crc32("conv_id")} % 6 AS h FROM own GROUP BY conv_id),
turns AS (
  SELECT c.conv_id, own.pos + 1 AS depth, digest, chars FROM c JOIN own ON own.conv_id = c.conv_id - c.conv_id % 100 WHERE own.pos < c.h
  UNION ALL
  SELECT c.conv_id, own.pos - c.h + least(c.h, coalesce(b.n, 0)) + 1 AS depth, digest, chars
  FROM c JOIN own ON own.conv_id = c.conv_id LEFT JOIN c AS b ON b.conv_id = c.conv_id - c.conv_id % 100 WHERE own.pos >= c.h),
rows_ AS (
  SELECT conv_id, 0 AS depth, '' AS path, '' AS up, 0 AS chars FROM c
  UNION ALL
  SELECT conv_id, depth, string_agg(digest, '') OVER w AS path, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS up, chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
lengths AS (SELECT conv_id, max(depth) AS last FROM rows_ GROUP BY conv_id),
nodes AS (
  SELECT path, up, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = last) AS ends
  FROM rows_ JOIN lengths USING (conv_id) GROUP BY path, up, depth),
children AS (SELECT up AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up),
sums AS (
  SELECT r.path, sum((v.n - 1) * v.chars) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM nodes v JOIN rows_ r ON r.conv_id = v.conv_id AND r.depth <= v.depth LEFT JOIN children k ON k.path = v.path GROUP BY r.path)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM nodes v JOIN sums s ON s.path = v.path LEFT JOIN nodes p ON v.depth > 0 AND p.path = v.up LEFT JOIN children k ON k.path = v.path
"""


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # null where doc_id is null, which leaves n_chars as it is
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    found = {"n_chars": F.when(tampered, more).otherwise(F.col("n_chars").cast("string"))}
    out = merkle.manifest(table(spark, sf_dir, "documents"), found)
    siblings = F.array_join(F.transform("proof", lambda s: F.substring(s, 2, 64)), "")
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


ORACLE["op12_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("n_chars")} AS leaf,
    CASE WHEN {sql_crc32("doc_id")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS found
  FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
low(tree, step, pos, n, h) AS (
  SELECT tree, 0, pos, n, leaf FROM l
  UNION ALL
  SELECT tree, step + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY tree, step, pos // 2, n),
sub AS (SELECT tree, h, step, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high(step, pos, n, h) AS (
  SELECT 0, pos, n, h FROM sub
  UNION ALL
  SELECT step + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY step, pos // 2, n),
top AS (SELECT h AS root, step AS steps FROM high WHERE n = 1),
way AS (
  SELECT l.tree, l.pos, s.step, (l.pos >> s.step) & 1 AS odd, o.h
  FROM l JOIN (SELECT DISTINCT tree, step FROM low WHERE n > 1) s ON s.tree = l.tree
  LEFT JOIN low o ON o.tree = l.tree AND o.step = s.step AND o.pos = xor(l.pos >> s.step, 1)
  UNION ALL
  SELECT l.tree, l.pos, sub.step + s.step, (sub.pos >> s.step) & 1 AS odd, o.h
  FROM l JOIN sub ON sub.tree = l.tree CROSS JOIN (SELECT DISTINCT step FROM high WHERE n > 1) s
  LEFT JOIN high o ON o.step = s.step AND o.pos = xor(sub.pos >> s.step, 1)),
proof AS (SELECT tree, pos, coalesce(string_agg(h, '' ORDER BY step), '') AS hashes FROM way GROUP BY tree, pos),
folded(tree, pos, step, h) AS (
  SELECT tree, pos, CAST(0 AS BIGINT), found FROM l
  UNION ALL
  SELECT f.tree, f.pos, f.step + 1, sha256(CASE WHEN w.h IS NULL THEN f.h WHEN w.odd = 1 THEN w.h || f.h ELSE f.h || w.h END)
  FROM folded f JOIN way w ON w.tree = f.tree AND w.pos = f.pos AND w.step = f.step)
SELECT l.doc_id, l.leaf, sub.h AS subroot, top.root, sha256(coalesce(proof.hashes, '')) AS proof_sha256, f.h AS folded_root, f.h = top.root AS verified
FROM l JOIN sub USING (tree) CROSS JOIN top LEFT JOIN proof ON proof.tree = l.tree AND proof.pos = l.pos
JOIN folded f ON f.tree = l.tree AND f.pos = l.pos AND f.step = sub.step + top.steps
"""


@query
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
