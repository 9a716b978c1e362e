"""No join broadcasts rows that are made from documents, however small Spark's estimate of them is."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from refloom.operators.documents import doc_entries
from refloom.plans import runtime

SF = os.environ.get("REFLOOM_SF_DIR", "/root/testdata/sf0.001")
NAMES = (
    "dangling_assets", "deep_override_rule", "delete_entries", "delete_report", "get_values", "instance_overrides", "resolved_edges", "site_selectors", "sub_usage",
    "type_refs", "upsert_overrides", "usage_sites", "uuid_refs",
)


def broadcasts(spark, since: int = -1) -> list[str]:
    """Broadcast joins in the plans of the jobs that ran after ``since``."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    plans = [(r.executionId(), r.physicalPlanDescription()) for r in (runs.apply(i) for i in range(runs.size()))]
    if since < 0:
        return [str(max([i for i, _ in plans], default=0))]
    found = [re.findall(r"\(\d+\) Broadcast(?:Hash|NestedLoop)Join.*\n(.*)\n(.*)", text) for i, text in plans if i > since]
    return sorted({re.sub(r"#\d+L?", "", " = ".join(keys)) for plan in found for keys in plan})


@pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_entries_are_never_broadcast(spark, monkeypatch, name):
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", -1)  # every measured table counts as large
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")  # sizes that a running job measured are no estimates
    last = int(broadcasts(spark)[0])
    try:
        E.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    # one row of an offset for each task is broadcast by design
    assert [line for line in broadcasts(spark, last) if "_pid" not in line] == []


def test_marked_rows_are_shuffled_by_later_joins(spark):
    docs = spark.createDataFrame([("a", '[{"__type__":"x","v":1},{"__type__":"y"}]')], "doc_id string, text string")
    e = doc_entries(docs)
    joined = e.select("doc_id", "idx").join(e.groupBy("doc_id").agg(F.max("idx").alias("top")), "doc_id")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["idx"] for r in joined.collect()) == [0, 1]


def test_documents_are_dealt_over_tasks_before_they_are_built(spark):
    from refloom.workload.inputs import instance_docs, part_docs, part_entries

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for docs in (part_docs(spark, "/root/testdata/sf0.001"), instance_docs(spark, "/root/testdata/sf0.001")):
        assert docs.where("text like '[%'").rdd.getNumPartitions() == tasks
    assert "parse_json" not in part_entries(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
