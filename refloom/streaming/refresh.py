"""Incremental refresh: changed documents replace their references, edges follow.

The state is a change log.  A micro-batch appends, for each document it changes, one head row and one row a reference, all with
the document's version and the batch's epoch; nothing older is read or rewritten.  A document without references leaves its
head row alone, which is its tombstone.  The current references of a document are the rows of its greatest (version, epoch), so an older
change that arrives late loses wherever it stands, and replaying a batch overwrites its own epoch with the same rows.

Compaction writes the current rows as the base of the next generation once the log has outgrown the base, so that the work is a
constant factor of what was appended.  A generation counts from the moment its row stands in the commit table; one that was
broken off is overwritten by the next attempt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from refloom.model import edges_from_links
from refloom.plans.runtime import Cut, cut

BUCKETS = 64  # files of a batch at most
BASE = -1  # epoch of the compacted rows
LOG_SCHEMA = "src string, ref string, kind string, version long, generation long, epoch long"


def latest_versions(changes: DataFrame, key: str = "doc_id", version: str = "version") -> DataFrame:
    """The newest row of each document; of equal versions the row with the largest hash, in any order of arrival."""
    rest = [c for c in changes.columns if c != key]
    order = F.struct(F.col(version), F.xxhash64(*rest))
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def newest_rows(batch: DataFrame, key: str = "doc_id", version: str = "version") -> tuple[DataFrame, Cut]:
    """(the batch's rows that ``latest_versions`` picks, their keys): texts stay where they are, only keys are shuffled and kept.

    Rows of one document that are equal throughout are reduced to one, which moves rows, where the batch holds any.
    """
    rest = [c for c in batch.columns if c != key]
    marked = batch.withColumn("_version", F.col(version)).withColumn("_hash", F.xxhash64(*rest))
    newest = cut(marked.groupBy(F.col(key)).agg(F.max(F.struct("_version", "_hash")).alias("_r"), F.count(F.lit(1)).alias("_n")).select(key, "_r.*", "_n"))
    kept = newest.hinted().select(F.col(key).alias("_key"), F.col("_version").alias("_v"), F.col("_hash").alias("_h"))
    found = marked.join(kept, F.col(key).eqNullSafe(F.col("_key")) & F.col("_version").eqNullSafe(F.col("_v")) & (F.col("_hash") == F.col("_h")))
    found = found.select(*batch.columns)
    if newest.df.where("_n > 1").isEmpty():
        return found, newest
    again = found.groupBy(key).count().where("count > 1").isEmpty()
    return (found if again else found.dropDuplicates([key])), newest


def create_table(spark: SparkSession, table: str) -> None:
    """An empty log of generation 0; does nothing where the table exists."""
    spark.createDataFrame([(0,)], "generation long").write.mode("ignore").parquet(f"{table}/commits")
    spark.createDataFrame([], LOG_SCHEMA).write.mode("ignore").partitionBy("generation", "epoch").parquet(f"{table}/log")


def generation(spark: SparkSession, table: str) -> int:
    """The committed generation; one row a compaction is read."""
    return spark.read.schema("generation long").parquet(f"{table}/commits").agg(F.max("generation").alias("g")).first()["g"] or 0


def change_log(spark: SparkSession, table: str) -> DataFrame:
    """(src, ref, kind, version, epoch) of the committed generation; rows without a reference are heads."""
    now = generation(spark, table)  # a literal, so other generations are not read
    return spark.read.schema(LOG_SCHEMA).parquet(f"{table}/log").where(F.col("generation") == now).drop("generation")


def current_rows(spark: SparkSession, table: str) -> DataFrame:
    """Heads and references of each document's greatest (version, epoch)."""
    log = change_log(spark, table)
    # one number that orders by version, then epoch: aggregated by hash, unlike a struct
    order = F.col("version").cast("decimal(19,0)") * F.lit(1 << 32) + F.col("epoch") + 1
    ranked = log.withColumn("_order", order)
    heads = ranked.where("ref IS NULL").groupBy("src").agg(F.max("_order").alias("_last")).withColumnRenamed("src", "_src")
    return ranked.join(heads, (F.col("src") == F.col("_src")) & (F.col("_order") == F.col("_last"))).select("src", "ref", "kind", "version")


def current_links(spark: SparkSession, table: str) -> DataFrame:
    return current_rows(spark, table).where(F.col("ref").isNotNull()).select("src", F.col("ref").alias("dst"), "kind")


def current_edges(spark: SparkSession, table: str) -> DataFrame:
    return edges_from_links(current_links(spark, table))


def _write(rows: DataFrame, table: str, now: int, epoch: int, buckets: int) -> None:
    placed = rows.select("src", "ref", "kind", "version", F.lit(now).cast("long").alias("generation"), F.lit(epoch).cast("long").alias("epoch"))
    writer = placed.repartition(buckets, "src", "ref").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("generation", "epoch").parquet(f"{table}/log")


def append_changes(spark: SparkSession, table: str, epoch: int, changed: DataFrame, refs: DataFrame, buckets: int = BUCKETS) -> None:
    """Log the references ``refs`` (src, ref, kind) of the documents ``changed`` (src, version), each with its latest version."""
    newest = cut(changed.groupBy("src").agg(F.max("version").alias("version"))).df
    none = F.lit(None).cast("string")
    found = refs.where(F.col("ref").isNotNull()).select("src", "ref", "kind").join(newest, "src").select("src", "ref", "kind", "version")
    _write(newest.select("src", none.alias("ref"), none.alias("kind"), "version").unionByName(found), table, generation(spark, table), epoch, buckets)


def compact(spark: SparkSession, table: str, keep: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Write the current rows, of the documents ``keep`` (src) if given, as the next generation and commit it."""
    now = generation(spark, table)
    rows = current_rows(spark, table)
    if keep is not None:
        rows = rows.join(keep.select("src").distinct(), "src", "left_semi")
    _write(cut(rows).df, table, now + 1, BASE, buckets)
    spark.createDataFrame([(now + 1,)], "generation long").write.mode("append").parquet(f"{table}/commits")


def compact_if_grown(spark: SparkSession, table: str, buckets: int = BUCKETS) -> bool:
    """Compact when the log holds more rows than the base it stands on; two numbers are read."""
    sizes = change_log(spark, table).agg(F.count_if(F.col("epoch") == BASE).alias("base"), F.count_if(F.col("epoch") != BASE).alias("log")).first()
    grown = sizes["log"] > sizes["base"]
    if grown:
        compact(spark, table, buckets=buckets)
    return grown


def refresh_stream(
    stream: DataFrame, extract: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, buckets: int = BUCKETS, available_now: bool = True
) -> StreamingQuery:
    """Run ``extract`` on each micro-batch of (doc_id, version, text) and log its references; batches are applied in order.

    ``extract`` maps (doc_id, text) to (src, ref, kind).
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        docs, newest = newest_rows(batch)
        if newest.empty:
            return
        changed = newest.df.select(F.col("doc_id").cast("string").alias("src"), F.col("_version").cast("long").alias("version"))
        append_changes(batch.sparkSession, table, epoch, changed, extract(docs), buckets)
        compact_if_grown(batch.sparkSession, table, buckets)

    create_table(stream.sparkSession, table)
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def drop_deleted(spark: SparkSession, table: str, present: DataFrame) -> None:
    """Periodic sweep between batches: forget documents that no longer appear in a full listing (doc_id)."""
    compact(spark, table, present.select(F.col("doc_id").cast("string").alias("src")))
