"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is a duplicate if an earlier line (smaller doc_id, then line number) is equal to it or within one edit, after
lower-casing and trimming.  Lines within one edit have a common variant: the line itself, or the line less one
character.  Variants are joined by hash, the edit distance is verified on the texts, and the earliest line stays.

A line of n characters has n variants, so two exact filters go first.  Cut into pieces, a line with one edit keeps
what stands before and after one of its pieces.  Only lines that share such a frame with another line go on, first
with 2 pieces, then with 16; and only characters of the piece between a shared frame are deleted.

Long texts are not shuffled for equality: lines are grouped by a 128-bit hash.  Groups hand on their earliest member,
never their pairs: all lines that lose the same character place to give the same variant are one edit from each other,
so the earliest stands for them.

Nulls and ties: a null text has no lines and stays null; blank lines are never duplicates; a null doc_id comes before
any other; rows that repeat a doc_id share its places, so an equal line at the same place stays in both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.plans.runtime import cut

COARSE, FINE = 2, 16
#: what counts as a space beside the space itself
BLANKS = "\t\r\x0b\x0c"
ID = ["_h", "_g"]


def _normal(line: Column) -> Column:
    """The line in lower case, other blanks as spaces, trimmed; translate goes character by character, so only lines with such blanks pay for it."""
    low = F.lower(line)
    odd = reduce(lambda a, b: a | b, [F.contains(line, F.lit(c)) for c in BLANKS])
    return F.trim(F.when(odd, F.translate(low, BLANKS, " " * len(BLANKS))).otherwise(low))


def _lines(docs: DataFrame, full: bool = False) -> DataFrame:
    """(doc_id, _text_id, _line, _t and its 128-bit hash) of every line, or of those that are not blank.

    Blank lines are told from the raw text: a condition on _t would be moved below it, and every line normalised twice.
    """
    cut_up = docs.select(F.col("doc_id"), F.xxhash64("text").alias("_text_id"), F.posexplode(F.split("text", "\n")).alias("_line", "_raw"))
    if full:
        cut_up = cut_up.where(F.ltrim("_raw", F.lit(" " + BLANKS)) != "")
    lines = cut_up.select("doc_id", "_text_id", "_line", _normal(F.col("_raw")).alias("_t"))
    return lines.select("*", F.xxhash64("_t").alias("_h"), F.xxhash64(F.lit(2), "_t").alias("_g"))


def _frame(t: Column, size: Column, piece: int | Column, pieces: int) -> tuple[Column, Column, Column]:
    """(hash of what stands around a piece, first place of the piece, place after it) for a shorter length ``size``."""
    piece = F.lit(piece) if isinstance(piece, int) else piece
    low = F.floor(size * piece / pieces).cast("int")
    high = F.floor(size * (piece + 1) / pieces).cast("int")
    return F.xxhash64(piece, size, F.left(t, low), F.right(t, size - high)), low, high


def _shared(keys: DataFrame) -> DataFrame:
    """The rows whose key another line has too."""
    several = keys.groupBy("_key").agg(F.min("_h").alias("_least"), F.max("_h").alias("_most")).where("_least <> _most").select("_key")
    return keys.join(several, "_key")


def _near(distinct: DataFrame, lines: DataFrame) -> DataFrame:
    """(_h, _g, _near): the earliest place of a line one edit away."""
    coarse = distinct.select(*ID, "_first", F.explode(F.array(*[f"_k{i}" for i in range(2 * COARSE)])).alias("_key"))
    some = cut(_shared(coarse).select(*ID, "_first").distinct()).hinted()  # broadcast only if it was measured to be small
    texts = cut(lines.select(*ID, "_t").join(some, ID).groupBy(*ID).agg(F.min("_t").alias("_t"), F.min("_first").alias("_first"))).df

    each = texts.select(*ID, "_t", F.explode(F.sequence(F.lit(0), F.lit(2 * FINE - 1))).alias("_i"))
    size = F.length("_t") - F.floor(F.col("_i") / FINE).cast("int")
    key, low, high = _frame(F.col("_t"), size, F.col("_i") % FINE, FINE)
    fine = each.where(size >= 0).select(*ID, key.alias("_key"), F.struct(low.alias("low"), high.alias("high")).alias("_piece"))
    matched = _shared(fine).groupBy(*ID).agg(F.collect_set("_piece").alias("_pieces"))  # 32 at most

    place = F.array_distinct(F.flatten(F.transform("_pieces", lambda p: F.sequence(p["low"], p["high"]))))
    places = texts.join(matched, ID).select(*ID, "_t", "_first", F.explode(F.array_append(place, F.lit(-1))).alias("_at"))
    without = F.when(F.col("_at") < 0, F.col("_t")).otherwise(F.concat(F.left("_t", F.col("_at")), F.substr("_t", F.col("_at") + 2)))
    variants = places.where(F.col("_at") < F.length("_t")).select(*ID, "_first", "_at", F.xxhash64(without).alias("_v"), F.length(without).alias("_n"))
    variants = cut(variants).df

    less, same = variants.where("_at >= 0"), variants.where("_at < 0").select(F.col("_h").alias("_oh"), F.col("_g").alias("_og"), F.col("_first").alias("_of"), "_v", "_n")
    head = F.min(F.struct("_first", "_h", "_g"))
    heads = less.groupBy("_v", "_n", "_at").agg(head.alias("_m"), F.min("_h").alias("_least"), F.max("_h").alias("_most")).where("_least <> _most")
    swapped = less.join(heads, ["_v", "_n", "_at"]).select(*ID, F.col("_m._h").alias("_oh"), F.col("_m._g").alias("_og"))
    grown = less.join(same, ["_v", "_n"])
    longer = grown.select(*ID, "_oh", "_og")
    shorter = grown.groupBy("_oh", "_og").agg(head.alias("_m")).select(F.col("_oh").alias("_h"), F.col("_og").alias("_g"), F.col("_m._h").alias("_oh"), F.col("_m._g").alias("_og"))
    pairs = swapped.union(longer).union(shorter).where("_h <> _oh or _g <> _og").distinct()
    other = texts.select(F.col("_h").alias("_oh"), F.col("_g").alias("_og"), F.col("_t").alias("_ot"), F.col("_first").alias("_of"))
    close = pairs.join(texts.select(*ID, "_t"), ID).join(other, ["_oh", "_og"]).where(F.levenshtein("_t", "_ot", 1) >= 0)
    return close.groupBy(*ID).agg(F.min("_of").alias("_near"))


def dedup_lines(docs: DataFrame, edits: int = 1) -> DataFrame:
    """The documents with ``text`` less its duplicate lines, and n_lines and n_removed beside the other columns.

    ``edits`` is 1, or 0 for equal lines only.  Columns named n_lines or n_removed before are replaced.
    """
    if edits not in (0, 1):
        raise ValueError("edits must be 0 or 1")
    full = _lines(docs, full=True)
    size = F.length("_t")
    keys = [_frame(F.col("_t"), size - less, piece, COARSE)[0] for less in (0, 1) for piece in range(COARSE)] if edits else []
    place = F.struct("doc_id", "_line")
    # keys before the grouping, so that it sorts no texts
    keyed = full.select(*ID, place.alias("_place"), *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    distinct = keyed.groupBy(*ID).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_times"), *[F.min(f"_k{i}").alias(f"_k{i}") for i in range(len(keys))])
    distinct = cut(distinct).df
    groups = distinct.where("_times > 1").select(*ID, "_first")
    if edits:
        near = _near(distinct, full)
        groups = distinct.join(near, ID, "left").where("_times > 1 or _near is not null").select(*ID, F.least("_first", F.coalesce("_near", "_first")).alias("_first"))
    firsts = cut(groups).hinted()
    gone = F.coalesce(place > F.col("_first"), F.lit(False))
    flagged = _lines(docs).drop("_t").join(firsts, ID, "left").select("doc_id", "_text_id", "_line", gone.alias("_gone"))
    marks = flagged.groupBy("doc_id", "_text_id").agg(F.sort_array(F.collect_set(F.struct("_line", "_gone"))).alias("_all"), F.max("_gone").alias("_any")).where("_any")
    marks = marks.select(F.col("doc_id").alias("_doc"), F.col("_text_id").alias("_id"), F.array_join(F.transform("_all", lambda x: F.when(x["_gone"], "1").otherwise("0")), "").alias("_marks"))
    marks = cut(marks).hinted()

    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    parts, mark = F.split(docs["text"], "\n"), marks["_marks"]
    kept = F.array_join(F.filter(parts, lambda line, i: F.substr(mark, i + 1, F.lit(1)) == "0"), "\n")
    # each frame's own columns, as the documents may have any names
    joined = docs.join(marks, docs["doc_id"].eqNullSafe(marks["_doc"]) & (F.xxhash64(docs["text"]) == marks["_id"]), "left")
    text = F.when(mark.isNull(), docs["text"]).otherwise(kept).alias("text")
    removed = F.coalesce(F.length(F.regexp_replace(mark, "0", "")), F.lit(0)).cast("long")
    counted = F.coalesce(F.size(parts), F.lit(0))
    n_lines = F.when(docs["text"].isNull(), F.lit(0)).otherwise(counted).cast("long")
    return joined.select(*[text if c == "text" else docs[f"`{c}`"] for c in names], n_lines.alias("n_lines"), removed.alias("n_removed"))
