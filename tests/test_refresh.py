from __future__ import annotations

from pyspark.sql import functions as F

from refloom.streaming.refresh import append_changes, change_log, compact, compact_if_grown, create_table, current_edges, drop_deleted, generation, refresh_stream


def links(batch):
    return batch.select(F.col("doc_id").alias("src"), F.explode(F.split("text", ",")).alias("ref"), F.lit("use").alias("kind")).where("ref <> ''")


def test_changed_documents_replace_their_references(spark, tmp_path):
    src, table, ck = (str(tmp_path / n) for n in ("in", "refs", "ck"))
    schema = "doc_id string, version long, text string"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        refresh_stream(spark.readStream.schema(schema).parquet(src), links, table, ck, buckets=4).awaitTermination()
        return {(r.src, r.dst): r.weight for r in current_edges(spark, table).collect()}

    assert feed([("a", 1, "x,y,x"), ("b", 1, "x")]) == {("a", "x"): 2, ("a", "y"): 1, ("b", "x"): 1}
    assert feed([("a", 2, "z"), ("a", 3, "w"), ("c", 1, "")]) == {("a", "w"): 1, ("b", "x"): 1}
    assert feed([("e", 1, "x,x"), ("e", 1, "x,x"), ("e", 0, "y")]) == {("a", "w"): 1, ("b", "x"): 1, ("e", "x"): 2}  # equal rows count once
    assert feed([("e", 2, "")]) == {("a", "w"): 1, ("b", "x"): 1}
    assert feed([("a", 1, "old"), ("b", 2, "")]) == {("a", "w"): 1}  # stale change ignored, b lost its last reference
    drop_deleted(spark, table, spark.createDataFrame([("b",), ("c",)], "doc_id string"))
    assert current_edges(spark, table).count() == 0


def test_log_compacts_and_batches_replay(spark, tmp_path):
    table = str(tmp_path / "refs")

    def batch(epoch, rows):
        changed = spark.createDataFrame([(d, v) for d, v, _ in rows], "src string, version long")
        refs = spark.createDataFrame([(d, r, "use") for d, _, rs in rows for r in rs], "src string, ref string, kind string")
        append_changes(spark, table, epoch, changed, refs, 4)

    def edges():
        return {(r.src, r.dst): r.weight for r in current_edges(spark, table).collect()}

    create_table(spark, table)
    assert edges() == {} and generation(spark, table) == 0
    batch(0, [("a", 5, ["x", "x"]), ("b", 1, ["y"]), ("c", 2, [])])
    assert compact_if_grown(spark, table, 4) and generation(spark, table) == 1
    want = {("a", "x"): 2, ("b", "y"): 1}
    assert edges() == want and change_log(spark, table).count() == 6
    batch(1, [("b", 1, ["z"]), ("c", 1, ["late"]), ("a", 4, ["late"])])  # of equal versions the later batch counts
    want = {("a", "x"): 2, ("b", "z"): 1}
    assert edges() == want and not compact_if_grown(spark, table, 4)
    batch(1, [("b", 1, ["z"]), ("c", 1, ["late"]), ("a", 4, ["late"])])  # replayed
    assert edges() == want
    compact(spark, table, buckets=4)
    batch(1, [("b", 1, ["z"]), ("c", 1, ["late"]), ("a", 4, ["late"])])  # replayed after its rows were compacted
    assert edges() == want and generation(spark, table) == 2
    batch(2, [("a", 6, [])])
    assert edges() == {("b", "z"): 1}
