"""Path, reference, score and JSON expressions.  Everything here is a Catalyst expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- paths -----------------------------------------------------------------------------------


def base(c) -> Column:
    return F.substring_index(_c(c), "/", -1)


def dir_of(c) -> Column:
    """Everything before the last slash; empty for a bare name."""
    c = _c(c)
    return F.when(F.instr(c, "/") > 0, F.regexp_replace(c, r"/[^/]*$", "")).otherwise(F.lit(""))


def ext_of(c) -> Column:
    """Lower-case extension of the basename with its dot, or the empty string."""
    return F.lower(F.regexp_extract(_c(c), r"(\.[^./]*)$", 1))


def strip_ext(c) -> Column:
    return F.regexp_replace(_c(c), r"\.[^./]+$", "")


def path_prefixes(c) -> Column:
    """All directory prefixes of a path, the path itself included."""
    seg = F.split(_c(c), "/")
    return F.transform(F.sequence(F.lit(1), F.size(seg)), lambda n: F.array_join(F.slice(seg, F.lit(1), n), "/"))


def path_suffixes(c) -> Column:
    """All trailing parts of a path, the path itself included."""
    seg = F.split(_c(c), "/")
    n = F.size(seg)
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(seg, k, n), "/"))


def normalize_path(c) -> Column:
    """Clean a pasted path: quotes, backslashes, URL scheme, root folder, trailing slash, sidecar suffix."""
    s = F.trim(_c(c))
    s = F.trim(F.regexp_replace(s, r"""^(["'])(.*)\1$""", "$2"))
    s = F.regexp_replace(s, r"\\", "/")
    s = F.regexp_replace(s, r"^db://", "")
    s = F.regexp_replace(s, r"/{2,}", "/")
    s = F.regexp_replace(s, r"^\.?/", "")
    s = F.regexp_replace(s, r"^assets/", "")
    s = F.regexp_replace(s, r"/+$", "")
    return F.regexp_replace(s, r"\.meta$", "")


def human_size(c) -> Column:
    """KB with one decimal, MB from 1 MiB upwards; halves go to the even digit, as C's printf has them."""
    c = _c(c)
    return F.when(c >= 1048576, F.format_string("%.1f MB", F.bround(c / 1048576.0, 1))).otherwise(
        F.format_string("%.1f KB", F.bround(c / 1024.0, 1))
    )


# ---- references ------------------------------------------------------------------------------

# Fixed values of the reference format.
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
TOKEN23_PATTERN = r"^[0-9a-fA-F]{5}[0-9a-zA-Z+/]{18}$"
TOKEN22_PATTERN = r"^[0-9a-fA-F]{2}[0-9a-zA-Z+/]{20}$"


def main_id(c) -> Column:
    return F.substring_index(_c(c), "@", 1)


def sub_id(c) -> Column:
    """The part after the first ``@``; NULL when there is none."""
    c = _c(c)
    return F.when(F.instr(c, "@") > 0, F.regexp_replace(c, r"^[^@]*@", ""))


def is_uuid(c) -> Column:
    return _c(c).rlike(UUID_PATTERN)


def looks_compressed(c) -> Column:
    c = _c(c)
    return c.rlike(TOKEN23_PATTERN) | c.rlike(TOKEN22_PATTERN)


def _dashed(h: Column) -> Column:
    s = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", s(1, 8), s(9, 4), s(13, 4), s(17, 4), s(21, 12))


def decode_token(c) -> Column:
    """Compressed token to id; anything else passes through."""
    c = _c(c)
    long_ = F.concat(
        F.substring(c, 1, 5),
        F.substring(F.lower(F.hex(F.unbase64(F.concat(F.substring(c, 6, 18), F.lit("AA"))))), 1, 27),
    )
    short = F.concat(F.substring(c, 1, 2), F.lower(F.hex(F.unbase64(F.substring(c, 3, 20)))))
    return (
        F.when(c.rlike(TOKEN23_PATTERN), _dashed(long_)).when(c.rlike(TOKEN22_PATTERN), _dashed(short)).otherwise(c)
    )


def encode_token(c, short: bool = False) -> Column:
    """Id to compressed token (23 characters, or 22 when ``short``); non-ids pass through."""
    c = _c(c)
    h = F.regexp_replace(c, "-", "")
    b64 = lambda x: F.regexp_replace(F.base64(F.unhex(x)), r"[\s=]", "")
    if short:
        token = F.concat(F.substring(h, 1, 2), b64(F.substring(h, 3, 30)))
    else:
        # 27 hex digits are 108 bits = 18 characters; pad to whole bytes, cut the padding off again
        token = F.concat(F.substring(h, 1, 5), F.substring(b64(F.concat(F.substring(h, 6, 27), F.lit("000"))), 1, 18))
    return F.when(c.rlike(UUID_PATTERN) | c.rlike("^[0-9a-fA-F]{32}$"), token).otherwise(c)


# ---- scores ----------------------------------------------------------------------------------

# Characters after which a match counts as starting a word (fixed value).
WORD_BREAKS = "/_-. "


def _is_break(ch: Column) -> Column:
    return F.instr(F.lit(WORD_BREAKS), ch) > 0


def match_score(q: str, c) -> Column:
    """Prefix, substring or subsequence score of lower-case query ``q`` in ``c``; -1 for no match."""
    text = F.lower(_c(c))
    query = F.lit(q)
    n = F.length(text)
    at = F.position(query, text)
    idx = at - 1
    before = F.substring(text, at - 1, F.lit(1))
    substring = F.when(_is_break(before), F.lit(700.0)).otherwise(F.lit(500.0)) - idx - n * F.lit(0.1)
    return (
        F.when(F.length(query) == 0, F.lit(0.0))
        .when(idx == 0, (F.lit(1000) - n).cast("double"))
        .when(idx > 0, substring)
        .otherwise(subsequence_score(q, text))
    )


def subsequence_score(q: str, c) -> Column:
    """1 per character, +5 at a word start, +3 when it follows the previous match; -1 if not contained."""
    text = _c(c)
    if not q:
        return F.lit(0.0)
    # A quick test keeps the character walk away from texts that cannot match.
    possible = text.rlike("(?s)" + ".*?".join(re.escape(ch) for ch in q))
    state = F.struct(F.lit(0).alias("next"), F.lit(-2).alias("prev"), F.lit(0).alias("score"))

    def step(acc, ch):
        rest = F.substr(text, acc["next"] + 1)
        hit = acc["next"] + F.position(ch, rest) - 1
        start = (hit == 0) | _is_break(F.substr(text, hit, F.lit(1)))
        gain = (
            F.lit(1)
            + F.when(start, F.lit(5)).otherwise(F.lit(0))
            + F.when(hit == acc["prev"] + 1, F.lit(3)).otherwise(F.lit(0))
        )
        return F.struct(
            (hit + 1).cast("int").alias("next"), hit.cast("int").alias("prev"), (acc["score"] + gain).cast("int").alias("score")
        )

    walked = F.aggregate(F.array(*[F.lit(ch) for ch in q]), state, step)
    return F.when(possible, walked["score"].cast("double")).otherwise(F.lit(-1.0))


def match_positions(q: str, c) -> Column:
    """0-based indices to highlight: every substring occurrence, else the subsequence; NULL if neither."""
    text = F.lower(_c(c))
    if not q:
        return F.array().cast("array<int>")
    n = len(q)
    pieces = F.split(text, re.escape(q))
    # start of occurrence k = lengths of the k pieces before it + k query lengths
    starts = F.transform(
        F.sequence(F.lit(1), F.size(pieces) - 1),
        lambda k: F.aggregate(F.slice(pieces, F.lit(1), k), F.lit(0), lambda a, p: (a + F.length(p)).cast("int"))
        + (k - 1) * n,
    )
    spans = F.flatten(F.transform(starts, lambda s: F.sequence(s, s + (n - 1))))
    state = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("pos"))

    def step(acc, ch):
        hit = (acc["next"] + F.position(ch, F.substr(text, acc["next"] + 1)) - 1).cast("int")
        return F.struct((hit + 1).cast("int").alias("next"), F.concat(acc["pos"], F.array(hit)).alias("pos"))

    walked = F.aggregate(F.array(*[F.lit(ch) for ch in q]), state, step)["pos"]
    possible = text.rlike("(?s)" + ".*?".join(re.escape(ch) for ch in q))
    return F.when(F.instr(text, q) > 0, spans).when(possible, walked)


def edit_distance(a, b, threshold: int | None = None) -> Column:
    return F.levenshtein(_c(a), _c(b), threshold) if threshold is not None else F.levenshtein(_c(a), _c(b))


# ---- JSON ------------------------------------------------------------------------------------


def canonical_json(c) -> Column:
    """Key-sorted compact text; NULL for unparseable input."""
    return F.to_json(F.try_parse_json(_c(c)))


def blank_keys(c, keys) -> Column:
    """Canonical text with the string values of volatile keys emptied."""
    out = _c(c)
    for k in keys:
        out = F.regexp_replace(out, f'"{re.escape(k)}":"(?:[^"\\\\]|\\\\.)*+"', f'"{k}":""')
        out = F.regexp_replace(out, f'"{re.escape(k)}":(?:-?[0-9][^,}}\\]]*|true|false|null)', f'"{k}":""')
    return out


def get_path(v, path: str, kind: str = "string") -> Column:
    """Value at a dotted path with ``[i]`` or ``.i`` array steps; NULL when the path stops early."""
    steps = [p for p in re.sub(r"\[(\d+)\]", r".\1", path).split(".") if p]
    expr = "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in steps)
    return F.try_variant_get(_c(v), expr, kind)


def value_kind(v) -> Column:
    """null, array, string, number, boolean, asset, ref, a type name, or object."""
    v = _c(v)
    s = F.schema_of_variant(v)
    tag = F.try_variant_get(v, "$.__type__", "string")
    return (
        F.when(v.isNull() | s.isin("VOID"), F.lit("null"))
        .when(s.startswith("ARRAY"), F.lit("array"))
        .when(s == "STRING", F.lit("string"))
        .when(s == "BOOLEAN", F.lit("boolean"))
        .when(
            s.startswith("OBJECT"),
            F.when(F.try_variant_get(v, "$.__uuid__", "string").isNotNull(), F.lit("asset"))
            .when(F.try_variant_get(v, "$.__id__", "double").isNotNull(), F.lit("ref"))
            .otherwise(F.coalesce(tag, F.lit("object"))),
        )
        .otherwise(F.lit("number"))
    )


# ---- arrays ----------------------------------------------------------------------------------


def is_permutation(perm, n) -> Column:
    perm, n = _c(perm), _c(n)
    return F.when(
        F.size(perm) == n,
        (n == 0) | (F.array_sort(perm) == F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))),
    ).otherwise(F.lit(False))


def permute(arr, perm) -> Column:
    arr = _c(arr)
    return F.transform(_c(perm), lambda i: F.get(arr, i.cast("int")))


def insert_at(arr, pos, value) -> Column:
    """Insert at 0-based ``pos``; position = length appends; NULL outside that range."""
    arr, pos = _c(arr), _c(pos)
    ok = (pos >= 0) & (pos <= F.size(arr))
    at = F.greatest(F.least(pos, F.size(arr)), F.lit(0)).cast("int")
    return F.when(
        ok, F.concat(F.slice(arr, F.lit(1), at), F.array(value), F.slice(arr, at + 1, F.size(arr)))
    )


def remove_at(arr, pos) -> Column:
    arr, pos = _c(arr), _c(pos)
    ok = (pos >= 0) & (pos < F.size(arr))
    at = F.greatest(F.least(pos, F.size(arr) - 1), F.lit(0)).cast("int")
    return F.when(ok, F.concat(F.slice(arr, F.lit(1), at), F.slice(arr, at + 2, F.size(arr))))
