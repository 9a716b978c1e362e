"""Reading a project tree: files, sidecar metadata, types, missing sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions.scalar import base, ext_of
from refloom.plans.runtime import Levels, cut

# Names never listed (fixed value).
JUNK_NAMES = (".DS_Store",)
META_SUFFIX = ".meta"
# Importer to type (fixed values): built-in types and those of the optional extractors.
IMPORTER_TYPES = {
    "image": "image",
    "texture": "texture",
    "sprite-frame": "sprite-frame",
    "prefab": "prefab",
    "scene": "scene",
    "typescript": "script",
    "javascript": "script",
    "audio-clip": "audio",
    "material": "material",
    "effect": "effect",
    "animation-clip": "anim",
    "json": "json",
    "physics-material": "physics-material",
}
EXTRA_IMPORTER_TYPES = {
    "sprite-atlas": "atlas",
    "bitmap-font": "font",
    "ttf-font": "font",
    "particle": "particle",
    "spine-data": "spine",
}
EXTRA_EXT_TYPES = {".atlas": "spine-atlas"}


def _glob(exts) -> str:
    """A file-name pattern of some extensions in any case."""
    any_case = lambda ext: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)
    return "*{" + ",".join(any_case(e) for e in sorted(exts)) + "}"


def scan_files(spark: SparkSession, root: str, content: bool = False, exts=None) -> DataFrame:
    """(path, length, modified[, content]) below ``root``, paths relative to it; listing only unless asked.

    With ``exts`` the file source itself leaves out all other files, so their bytes are never read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    raw = (reader if exts is None else reader.option("pathGlobFilter", _glob(exts))).load(root)
    prefix = "/" + root.split("://", 1)[-1].strip("/").split("file:", 1)[-1].strip("/") + "/"
    rel = F.substring_index(F.col("path"), prefix, -1)
    cols = [rel.alias("path"), F.col("length"), F.col("modificationTime").alias("modified")]
    if content:
        cols.append(F.col("content"))
    return raw.select(*cols).where(~base("path").isin(*JUNK_NAMES))


def read_bytes(files: DataFrame) -> DataFrame:
    return files.select("path", "content")


def read_text(files: DataFrame) -> DataFrame:
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def builtin_types(spark: SparkSession, extras: bool = True) -> DataFrame:
    """(by, key, type, prio): the built-in type table; later registrations get a higher prio."""
    rows = [("importer", k, v, 0) for k, v in IMPORTER_TYPES.items()]
    if extras:
        rows += [("importer", k, v, 1) for k, v in EXTRA_IMPORTER_TYPES.items()]
        rows += [("ext", k, v, 1) for k, v in EXTRA_EXT_TYPES.items()]
    return spark.createDataFrame(rows, "by string, key string, type string, prio int")


def with_registrations(table: DataFrame, extra: DataFrame, prio: int = 2) -> DataFrame:
    return table.unionByName(extra.select("by", "key", "type", F.lit(prio).alias("prio")))


def resolve_type(df: DataFrame, table: DataFrame, importer: str = "importer", ext: str = "ext") -> DataFrame:
    """Adds ``type``: importer table, then extension table, then the extension, then the importer.

    The type table is configuration (tens of rows), hence broadcast.
    """
    best = table.groupBy("by", "key").agg(F.max_by("type", "prio").alias("type"))
    by_imp = F.broadcast(best.where(F.col("by") == "importer").select(F.col("key").alias("_ik"), F.col("type").alias("_it")))
    by_ext = F.broadcast(best.where(F.col("by") == "ext").select(F.col("key").alias("_ek"), F.col("type").alias("_et")))
    wild = F.col(importer).isNull() | (F.col(importer) == "*")
    fallback = F.when(wild, F.when(F.col(ext) != "", F.expr(f"substring({ext}, 2)")).otherwise(F.lit("unknown"))).otherwise(F.col(importer))
    return (
        df.join(by_imp, F.col(importer) == F.col("_ik"), "left").join(by_ext, F.col(ext) == F.col("_ek"), "left")
        .withColumn("type", F.coalesce("_it", "_et", fallback)).drop("_ik", "_it", "_ek", "_et")
    )


def known_types(table: DataFrame) -> DataFrame:
    return table.select("type").distinct().orderBy("type")


def _str(v: str, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def parse_meta(metas: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, sub_items, parse_errors) of sidecar texts ``metas`` (path, text).

    Bad JSON and records without an id are error rows; nothing aborts.
    """
    v = metas.select("path", F.try_parse_json("text").alias("v"))
    v = v.withColumn("id", F.nullif(_str("v", "$.uuid"), F.lit("")))
    errors = v.where(F.col("id").isNull()).select(
        "path", F.when(F.col("v").isNull(), F.lit("invalid JSON")).otherwise(F.lit("no uuid")).alias("error")
    )
    good = v.where(F.col("id").isNotNull())
    source = F.regexp_replace("path", r"\.meta$", "")
    recs = good.select(
        "id", source.alias("path"), F.col("path").alias("meta_path"), ext_of(source).alias("ext"),
        F.coalesce(F.nullif(_str("v", "$.importer"), F.lit("")), F.lit("*")).alias("importer"),
        F.try_variant_get("v", "$.userData", "variant").alias("user_data"),
        F.try_variant_get("v", "$.subMetas", "variant").alias("_subs"),
    )
    typed = resolve_type(recs, table)
    subs = explode_sub_items(typed.select(F.col("id").alias("owner_id"), F.col("_subs").alias("subs")))
    return typed.drop("_subs"), subs, errors


def explode_sub_items(meta: DataFrame) -> DataFrame:
    """(owner_id, sub_id, uuid, kind, name, user_data, width, height), nested levels flattened."""
    tvf = meta.sparkSession.tvf
    level = cut(meta.where(F.col("subs").isNotNull()).select("owner_id", "subs"))
    out = Levels()
    while not level.empty:
        opened = level.df.lateralJoin(tvf.variant_explode(F.col("subs").outer())).select(
            "owner_id", F.col("key").alias("sub_id"), F.col("value").alias("v")
        ).where(F.schema_of_variant("v").startswith("OBJECT"))
        rows = cut(
            opened.select(
                "owner_id", "sub_id", _str("v", "$.uuid").alias("uuid"),
                F.coalesce(_str("v", "$.importer"), F.lit("unknown")).alias("kind"),
                F.coalesce(F.nullif(_str("v", "$.name"), F.lit("")), F.nullif(_str("v", "$.displayName"), F.lit("")), F.col("sub_id")).alias("name"),
                F.try_variant_get("v", "$.userData", "variant").alias("user_data"),
                F.try_variant_get("v", "$.userData.width", "int").alias("width"),
                F.try_variant_get("v", "$.userData.height", "int").alias("height"),
                F.try_variant_get("v", "$.subMetas", "variant").alias("subs"),
            )
        )
        if rows.empty:
            break
        out.add(rows)
        level = cut(rows.df.where(F.col("subs").isNotNull()).select("owner_id", "subs"))
    if not out.rows:
        none = F.lit(None)
        return meta.where(F.lit(False)).select(
            "owner_id", none.cast("string").alias("sub_id"), none.cast("string").alias("uuid"), none.cast("string").alias("kind"),
            none.cast("string").alias("name"), F.col("subs").alias("user_data"), none.cast("int").alias("width"), none.cast("int").alias("height"),
        )
    return out.frame().drop("subs")


def split_missing(records: DataFrame, files: DataFrame, sub_items: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, missing): records whose source exists, and (id, path) of those whose source is gone.

    Folder records are neither.  Ids of the missing records' sub-items are missing too.
    """
    real = records.where(F.col("importer") != "directory")
    have = files.select("path")
    nodes = real.join(files.select("path", F.col("length").alias("size")), "path")
    gone = real.join(have, "path", "left_anti").select("id", "path")
    if sub_items is not None:
        subs = sub_items.where(F.col("uuid").isNotNull()).join(gone.withColumnRenamed("id", "owner_id"), "owner_id").select(F.col("uuid").alias("id"), "path")
        gone = gone.unionByName(subs)
    return nodes, gone


def container_table(records: DataFrame) -> DataFrame:
    """(name, root, priority, builtin) from folder records marked as containers, plus the built-in one."""
    v = F.col("user_data")
    own = records.where((F.col("importer") == "directory") & F.coalesce(F.try_variant_get(v, "$.isBundle", "boolean"), F.lit(False))).select(
        F.coalesce(F.nullif(_str("user_data", "$.bundleName"), F.lit("")), base("path")).alias("name"),
        F.col("path").alias("root"), F.coalesce(F.try_variant_get(v, "$.priority", "int"), F.lit(0)).alias("priority"), F.lit(False).alias("builtin"),
    )
    return own.unionByName(records.sparkSession.createDataFrame([("resources", "resources", 0, True)], own.schema))
