"""Duplicate content, duplicate structure, shared names, and signature confirmation.

Groups are keyed by a hash computed where the row is read, so only (key, hash, id) is shuffled and
group facts come from partial aggregates.  Members always stay rows of a long table: a group with a
third of all rows never turns into one array, one window or one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.functions.scalar import blank_keys, canonical_json
from refloom.functions.signature import quarter_turns, signature_distance
from refloom.operators.filters import filter_types
from refloom.plans.runtime import cut, union_all

# Types whose JSON text is worth a structural comparison (fixed default).
CONFIG_TYPES = ("prefab", "material", "anim", "particle")
# Confirmation threshold of a shared region (fixed default).
CONFIRM_THRESHOLD = 0.10


def content_duplicates(files: DataFrame, content: str = "content", size: str = "size", types=None) -> DataFrame:
    """(gid, id, size) for every member of a group of byte-identical files.

    Sizes are counted first; only files sharing a size are hashed.  SHA-256 together with the size
    stands for the bytes.
    """
    rows = filter_types(files, types).where(F.col(size) > 0)
    shared = rows.groupBy(size).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(size)
    hashed = rows.join(shared, size, "left_semi").select(
        "id", F.col(size).alias("size"), F.sha2(F.col(content).cast("binary"), 256).alias("hash")
    )
    return _groups(hashed, ["size", "hash"])


def canonical_duplicates(
    docs: DataFrame, text: str = "text", type_: str = "type", volatile=("fileId",), types=None
) -> DataFrame:
    """(gid, id, type): documents of one type whose key-sorted JSON is equal once volatile keys are blank."""
    rows = filter_types(docs, types or None, type_)
    canon = blank_keys(canonical_json(text), volatile)
    hashed = rows.select("id", F.col(type_).alias("type"), canon.alias("_c")).where(F.col("_c").isNotNull()).select(
        "id", "type", F.sha2("_c", 256).alias("hash")
    )
    return _groups(hashed, ["type", "hash"])


def _groups(hashed: DataFrame, keys: list[str]) -> DataFrame:
    twice = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*keys)
    rest = [c for c in hashed.columns if c not in ("hash",)]
    return hashed.join(twice, keys, "left_semi").select(F.concat_ws(":", *keys).alias("gid"), *rest)


def annotate_groups(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per group: canonical member, count, reclaimable bytes, mergeable flag, warnings.

    Canonical: most referenced, then inside the run-time folder, then shortest path, then path.
    ``nodes`` needs id, path, type, size, in_degree, in_resources, importer, user_data (canonical text).
    """
    m = members.select("gid", "id").join(nodes, "id")
    order = F.struct(
        (-F.coalesce("in_degree", F.lit(0))).alias("a"), (~F.col("in_resources")).alias("b"),
        F.length("path").alias("c"), F.col("path").alias("d"), F.col("id").alias("e"),
    )
    settings = F.concat_ws("\u0001", F.coalesce("importer", F.lit("")), F.coalesce("user_data", F.lit("")))
    per = m.groupBy("gid").agg(
        F.count(F.lit(1)).alias("count"),
        F.min_by("size", "path").alias("size"),
        F.min_by("id", order).alias("canonical"),
        F.min_by("path", order).alias("canonical_path"),
        (F.min(settings) == F.max(settings)).alias("mergeable"),
        (F.bool_or("in_resources") & ~F.bool_and("in_resources")).alias("spans_resources"),
    )
    return per.select(
        "gid", "count", "size", (F.col("size") * (F.col("count") - 1)).alias("reclaimable"), "mergeable",
        F.concat_ws(
            ",",
            F.when(~F.col("mergeable"), F.lit("import-settings-differ")),
            F.when(F.col("spans_resources"), F.lit("spans-resources")),
        ).alias("warnings"),
        "canonical", "canonical_path",
    )


def redundant_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(gid, id, canonical): what to repoint onto the canonical member - feeds ``rewrite_refs``."""
    return members.select("gid", "id").join(groups.select("gid", "canonical"), "gid").where(F.col("id") != F.col("canonical"))


def duplicates_summary(file_groups: DataFrame | None, config_groups: DataFrame | None) -> DataFrame:
    """(axis, groups, reclaimable) per axis plus the total."""
    parts = [
        g.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("reclaimable"), F.lit(0)).cast("long").alias("reclaimable"))
        .select(F.lit(axis).alias("axis"), "groups", "reclaimable")
        for axis, g in (("files", file_groups), ("configs", config_groups))
        if g is not None
    ]
    both = union_all(parts)
    total = both.agg(F.sum("groups").alias("groups"), F.sum("reclaimable").alias("reclaimable"))
    return both.unionByName(total.select(F.lit("total").alias("axis"), "groups", "reclaimable"))


def shared_names(records: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """(name, containers, dims, first_dims, confidence, users) for names packed into several containers.

    ``records`` (container, name, w, h[, ord]); the first record of a name in a container counts.
    ``users`` (container, user) are whoever uses each container.
    """
    ordered = records if "ord" in records.columns else records.withColumn("ord", F.struct("w", "h"))
    first = ordered.groupBy("container", "name").agg(F.min_by(F.struct("w", "h"), "ord").alias("d"))
    first = first.select("container", "name", F.col("d.w").alias("w"), F.col("d.h").alias("h"))
    dims = F.concat_ws("x", F.coalesce("w", F.lit(0)).cast("string"), F.coalesce("h", F.lit(0)).cast("string"))
    unknown = (F.coalesce("w", F.lit(0)) == 0) | (F.coalesce("h", F.lit(0)) == 0)
    groups = (
        first.groupBy("name")
        .agg(
            F.count(F.lit(1)).alias("containers"), F.countDistinct(dims).alias("dims"), F.min(dims).alias("first_dims"),
            F.bool_or(unknown).alias("_unknown"),
        )
        .where(F.col("containers") >= 2)
        .withColumn("confidence", F.when((F.col("dims") == 1) & ~F.col("_unknown"), F.lit("likely")).otherwise(F.lit("name-only")))
        .drop("_unknown")
    )
    if users is None:
        return groups
    per = (
        first.select("container", "name").join(users.select("container", "user").distinct(), "container")
        .groupBy("name").agg(F.countDistinct("user").alias("users"))
    )
    return groups.join(per, "name", "left").withColumn("users", F.coalesce("users", F.lit(0)).cast("long"))


# ---- signature confirmation -------------------------------------------------------------------

_PIVOTS = 3
_BLOCK = 1024


def confirm_groups(
    members: DataFrame, side: int, threshold: float = CONFIRM_THRESHOLD, scale: float = 255.0
) -> DataFrame:
    """(gid, members, verdict) - ``confirmed`` when the worst pair of a group is within ``threshold``.

    ``members`` is (gid, member, sig).  The distance is a metric (a minimum over turns, which are
    isometries), so a few pivots decide most groups exactly: a member farther than the threshold from
    a pivot refutes the group, and a member x with d(pivot,x) + max d(pivot,.) within it can be left
    out.  Only members no pivot settles are compared block by block, each block pair one small task
    result, so no table of all pairs is ever produced.
    """
    rows = cut(members.where(F.col("sig").isNotNull()).select("gid", "member", "sig")).df
    counts = cut(rows.groupBy("gid").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= 2))
    live = rows.join(counts.hinted().select("gid"), "gid", "left_semi").withColumn("_far", F.lit(0.0)).withColumn("_open", F.lit(True))
    refuted = []
    for _ in range(_PIVOTS):
        pivots = cut(
            live.groupBy("gid").agg(F.max_by("sig", F.struct("_far", "member")).alias("_p"), F.bool_or("_open").alias("_any"))
        )
        if pivots.empty:
            break
        dist = live.join(pivots.hinted().select("gid", "_p"), "gid").withColumn(
            "_d", signature_distance(F.col("_p"), F.col("sig"), side, scale)
        )
        dist = cut(dist.select("gid", "member", "sig", "_d", "_open")).df
        reach = cut(dist.groupBy("gid").agg(F.max("_d").alias("_r")))
        bad = cut(reach.df.where(F.col("_r") > threshold).select("gid"))
        refuted.append(bad.df)
        settled = dist.join(reach.hinted(), "gid").join(bad.hinted(), "gid", "left_anti").select(
            "gid", "member", "sig", F.col("_d").alias("_far"),
            (F.col("_open") & (F.col("_d") + F.col("_r") > threshold)).alias("_open"),
        )
        # a group without open members is confirmed and leaves the loop
        alive = settled.groupBy("gid").agg(F.bool_or("_open").alias("_a")).where("_a").select("gid")
        live = cut(settled.join(alive, "gid", "left_semi")).df
    rest = live.where("_open").select("gid", "member", "sig")
    refuted.append(_block_refuted(rest, side, threshold, scale))
    bad_all = union_all(refuted).distinct().withColumn("_bad", F.lit(True))
    return counts.df.join(bad_all, "gid", "left").select(
        "gid", "members", F.when(F.col("_bad"), F.lit("different")).otherwise(F.lit("confirmed")).alias("verdict")
    )


def _block_refuted(rows: DataFrame, side: int, threshold: float, scale: float) -> DataFrame:
    n = rows.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / F.lit(_BLOCK)).cast("int").alias("_nb"))
    blocks = rows.join(n, "gid").withColumn("_b", F.pmod(F.xxhash64("member"), F.col("_nb")).cast("int"))
    # block b meets every block j once, as the pair (min, max)
    sent = blocks.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).select(
        "gid", F.least("_b", "_j").alias("lo"), F.greatest("_b", "_j").alias("hi"), (F.col("_b") == F.least("_b", "_j")).alias("left"),
        F.col("sig").cast("array<double>").alias("sig"),
    )
    turns = [np.array(t) for t in quarter_turns(side)]
    norm = float(side * side * scale)

    def worst(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        same = key[1] == key[2]
        a = np.stack(pdf["sig"][pdf["left"]].to_list()) if pdf["left"].any() else np.empty((0, side * side))
        b = a if same else (np.stack(pdf["sig"][~pdf["left"]].to_list()) if (~pdf["left"]).any() else np.empty((0, side * side)))
        bad = False
        for row in a:
            if not len(b):
                break
            best = np.min([np.abs(row[None, :] - b[:, t]).sum(axis=1) for t in turns], axis=0) / norm
            if (np.minimum(best, 1.0) > threshold).any():
                bad = True
                break
        return pd.DataFrame({"gid": [key[0]] if bad else []})

    gid = rows.schema["gid"].dataType.simpleString()
    return sent.groupBy("gid", "lo", "hi").applyInPandas(worst, f"gid {gid}").distinct()


