"""Name lookup for a table of queries, and nearest-name suggestions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.scalar import base, main_id, normalize_path, path_suffixes, strip_ext
from refloom.plans.runtime import cut, union_all

SUGGESTIONS = 5  # fixed default

# Lookup tiers, best first.
TIERS = ("id", "path", "suffix", "no-extension", "ignore-case")


def _clean(c):
    return F.trim(F.regexp_replace(F.trim(c), r"""^(["'])(.*)\1$""", "$2"))


def _query_keys(queries: DataFrame) -> DataFrame:
    q = queries.select("query").distinct().withColumn("_c", _clean(F.col("query"))).where(F.length("_c") > 0)
    q = q.withColumn("_q", normalize_path("query"))
    k = lambda tier, col: F.struct(F.lit(tier).alias("tier"), col.alias("key"))
    return q.select(
        "query",
        F.inline(
            F.array(
                k(0, main_id("_c")), k(1, F.col("_q")), k(1, F.col("_c")), k(2, F.col("_q")), k(3, F.col("_q")),
                k(4, F.lower("_q")),
            )
        ),
    ).distinct()


def _node_keys(nodes: DataFrame) -> DataFrame:
    one = lambda tier, col: F.array(F.struct(F.lit(tier).alias("tier"), col.alias("key")))
    many = lambda tier, arr: F.transform(arr, lambda s: F.struct(F.lit(tier).alias("tier"), s.alias("key")))
    full, bare = path_suffixes("path"), path_suffixes(strip_ext("path"))
    lower = F.array_union(F.transform(full, F.lower), F.transform(bare, F.lower))
    return nodes.select(
        "id", "path",
        F.inline(F.concat(one(0, F.col("id")), one(1, F.col("path")), many(2, full), many(3, bare), many(4, lower))),
    )


def lookup_hits(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query, tier, id, path): the hits of each query at its best tier."""
    keys = cut(_query_keys(queries))
    hits = cut(_node_keys(nodes).join(keys.hinted(), ["tier", "key"]).select("query", "tier", "id", "path").distinct()).df
    best = hits.groupBy("query").agg(F.min("tier").alias("tier"))
    return hits.join(best, ["query", "tier"], "left_semi")


def resolve_names(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query, status, tier, hits, id): unique, ambiguous or none; ``id`` only when unique.

    All candidates of an ambiguous query are ``lookup_hits`` rows.
    """
    per = lookup_hits(queries, nodes).groupBy("query").agg(
        F.min("tier").alias("_t"), F.count(F.lit(1)).alias("hits"), F.min("id").alias("_id")
    )
    names = F.array(*[F.lit(t) for t in TIERS])
    return queries.select("query").distinct().join(per, "query", "left").select(
        "query",
        F.when(F.col("hits").isNull(), F.lit("none")).when(F.col("hits") == 1, F.lit("unique")).otherwise(F.lit("ambiguous")).alias("status"),
        F.get(names, F.col("_t")).alias("tier"),
        F.coalesce("hits", F.lit(0)).cast("long").alias("hits"),
        F.when(F.col("hits") == 1, F.col("_id")).alias("id"),
    )


# Radii of the segment rounds; a query that has enough names within one of them is done.
RADII = (2, 4, 8)
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _tolerance(a, b):
    """Greatest distance at which names of these lengths still count as near."""
    return F.greatest(F.lit(2), F.floor(F.greatest(a, b) * F.lit(0.4)).cast("int"))


def _letter_mask(text):
    """A bit for the first and one for the second of each letter, one for each digit: one edit adds at most one bit."""
    times = lambda ch: F.length(text) - F.length(F.replace(text, F.lit(ch)))
    bit = lambda cond, i: F.when(cond, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    bits = [bit(times(ch) > n, 2 * i + n) for i, ch in enumerate(_LETTERS) for n in (0, 1)]
    bits += [bit(F.instr(text, str(d)) > 0, 52 + d) for d in range(10)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _close(tol):
    """Condition that the query and the form are within ``tol``, cheap tests first; the distance itself is -1 beyond it."""
    missing = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b)))) <= tol
    return missing("qmask", "mask") & missing("mask", "qmask")


def _within(pairs: DataFrame, tol: Column) -> DataFrame:
    """(query, nb, d) of the pairs with an edit distance of at most ``tol``."""
    near = pairs.where(_close(tol)).withColumn("d", F.levenshtein("qb", "form")).where(F.col("d") <= tol)
    return near.groupBy("query", "nb").agg(F.min("d").alias("d"))


def _segments(forms: DataFrame, r: int) -> DataFrame:
    """Forms under each of their ``r`` + 1 segments; a form too short to be cut stands under its length alone."""
    n = F.col("f")
    size = F.floor(n / (r + 1)).cast("int")
    first_long = F.lit(r + 1) - F.pmod(n, F.lit(r + 1))  # from here on segments have one letter more
    cutting = F.when(n > r, F.sequence(F.lit(0), F.lit(r))).otherwise(F.array(F.lit(-1)))
    rows = forms.select("*", F.explode(cutting).alias("seg"))
    i = F.col("seg")
    start = i * size + F.greatest(i - first_long, F.lit(0))
    return rows.withColumn("piece", F.when(i < 0, F.lit("")).otherwise(F.substr("form", start + 1, size + (i >= first_long).cast("int"))))


def _probes(queries: DataFrame, bands: DataFrame, r: int) -> DataFrame:
    """Queries under every piece that a form of a near length could share with them.

    If at most ``r`` edits part two names, some segment i is left whole, with at most i edits before it and ``r`` - i behind.
    """
    lengths = bands.where(F.abs(F.col("ql") - F.col("f")) <= r).select("ql", "f").distinct()
    rows = queries.join(lengths, "ql")
    n = F.col("f")
    size, first_long = F.floor(n / (r + 1)).cast("int"), F.lit(r + 1) - F.pmod(n, F.lit(r + 1))
    rows = rows.select("*", F.explode(F.when(n > r, F.sequence(F.lit(0), F.lit(r))).otherwise(F.array(F.lit(-1)))).alias("seg"))
    i, delta = F.col("seg"), F.col("ql") - n
    start, length = i * size + F.greatest(i - first_long, F.lit(0)), size + (i >= first_long).cast("int")
    low = F.greatest(-i, delta - (r - i), -start)
    high = F.least(i, delta + (r - i), F.col("ql") - length - start)
    shifts = F.when(i < 0, F.array(F.lit(0))).when(low <= high, F.sequence(low, high))
    rows = rows.select("*", F.explode(shifts).alias("shift"))
    return rows.withColumn("piece", F.when(i < 0, F.lit("")).otherwise(F.substr("qb", start + F.col("shift") + 1, length))).drop("shift").distinct()


def suggest_names(queries: DataFrame, nodes: DataFrame, k: int = SUGGESTIONS) -> DataFrame:
    """(query, path, distance, rank): the ``k`` nearest paths by basename edit distance.

    Distinct names are compared, not nodes.  Rounds of growing radius r look names up in an index of segments: a name cut into
    r + 1 pieces shares a piece, at nearly the same place, with every query within r edits, so the join keys are the name's
    length, the segment and its letters.  A query that has ``k`` paths within r is done.  The few that are left, whose tolerance
    is wider than the last radius, meet the names of each length that their tolerance reaches, and each length is
    bounded by its own names.  Letter counts are compared before distances, and only pairs within the tolerance are emitted.
    """
    q = queries.select("query").distinct().withColumn("qb", F.lower(base(normalize_path("query")))).where(F.length("qb") > 0)
    q = q.withColumn("ql", F.length("qb")).withColumn("qmask", _letter_mask(F.col("qb")))
    pending = cut(q)
    names = nodes.select("path", F.lower(base("path")).alias("nb"))
    counts = names.groupBy("nb").agg(F.count(F.lit(1)).alias("paths"))
    forms = counts.select("nb", "paths", F.length("nb").alias("n"), F.explode(F.array_distinct(F.array("nb", strip_ext("nb")))).alias("form"))
    forms = cut(forms.withColumn("f", F.length("form")).withColumn("mask", _letter_mask(F.col("form")))).df
    # lengths of queries that a form can be near to, from its own length alone
    reach = F.sequence(F.greatest(F.col("f") - _tolerance(F.col("n"), F.lit(0)), F.lit(1)), F.greatest(F.col("f") + _tolerance(F.col("n"), F.lit(0)), F.ceil(F.col("f") / F.lit(0.6)).cast("int")))
    bands = forms.select("n", "f").distinct().select("n", "f", F.explode(reach).alias("ql")).withColumn("tol", _tolerance(F.col("ql"), F.col("n")))
    bands = bands.where(F.abs(F.col("ql") - F.col("f")) <= F.col("tol")).join(q.select("ql").distinct(), "ql", "left_semi")
    bands = cut(bands).df
    widest = bands.groupBy("ql").agg(F.max("tol").alias("widest"))

    found: list[DataFrame] = []
    for r in RADII:
        if pending.empty:
            break
        probes = cut(_probes(pending.df, bands, r))
        pairs = _segments(forms, r).join(probes.hinted(), ["f", "seg", "piece"])
        hits = cut(_within(pairs, F.least(F.lit(r), _tolerance(F.col("ql"), F.col("n"))))).df
        found.append(hits)
        full = hits.join(counts, "nb").groupBy("query").agg(F.sum("paths").alias("paths")).where(F.col("paths") >= k)
        pending = cut(pending.df.join(widest, "ql").where(F.col("widest") > r).drop("widest").join(full, "query", "left_anti"))
    if not pending.empty:
        near = cut(pending.df.join(bands, "ql"))
        found.append(_within(forms.join(near.hinted(), ["n", "f"]), F.col("tol")))
    if not found:
        return queries.select("query", F.lit("").alias("path"), F.lit(0).alias("distance"), F.lit(0).alias("rank")).where(F.lit(False))
    # a smaller radius is repeated by the larger ones
    best = union_all(found).groupBy("query", "nb").agg(F.min("d").alias("distance"))
    w = Window.partitionBy("query").orderBy("distance", "path")
    return names.join(best, "nb").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "path", "distance", "rank")


def _common(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def distinguishing_dirs(nodes: DataFrame, by: list[str]) -> DataFrame:
    """``nodes`` with ``dir``: the part of the path that tells siblings of one basename apart; NULL without such a sibling.

    Siblings have equal ``by``, nulls included.  What all paths of a group share at the front is what the least and the greatest of
    them share, and likewise at the back for the reversed paths, so a group is one row of partial aggregates however
    many paths it has.  The last segment and one segment at least are never cut away from the shortest path.
    """
    segs = F.split("path", "/")
    rows = nodes.withColumn("_segs", segs).withColumn("_base", F.element_at(segs, -1))
    back = F.reverse("_segs")
    groups = rows.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_base").alias("_by")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.size("_segs")).alias("_least"), F.min("_segs").alias("_lo"), F.max("_segs").alias("_hi"), F.min(back).alias("_rlo"), F.max(back).alias("_rhi")
    )
    front = F.least(_common(F.col("_lo"), F.col("_hi")), F.col("_least") - 1)
    groups = groups.where(F.col("_n") > 1).withColumn("_front", front)
    groups = groups.withColumn("_back", F.least(_common(F.col("_rlo"), F.col("_rhi")), F.col("_least") - 1 - F.col("_front")))
    on = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] + [F.col("_base") == F.col("_by")]
    told = F.array_join(F.slice("_segs", F.col("_front") + 1, F.size("_segs") - F.col("_front") - F.col("_back")), "/")
    found = rows.join(groups.select(*[f"_by_{c}" for c in by], "_by", "_front", "_back"), reduce(lambda a, b: a & b, on), "left")
    return found.select(*nodes.columns, F.when(F.col("_front").isNotNull(), told).alias("dir"))
