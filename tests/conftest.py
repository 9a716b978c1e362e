from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from refloom.plans.runtime import session_tuning  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[4]").appName("refloom-tests").config("spark.driver.memory", "6g")
    builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).config("spark.ui.showConsoleProgress", "false")
    s = session_tuning(builder, 4).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def make(spark):
    """Build a graph from a node dict {id: (type, size, container)} or id list, and edges."""
    from refloom.model import Graph

    def build(nodes, edges, sites=None, **kw):
        if not isinstance(nodes, dict):
            nodes = {n: ("t", 1, None) for n in nodes}
        rows = [(i, v[3] if len(v) > 3 else i, v[0], v[1], v[2]) for i, v in nodes.items()]
        n = spark.createDataFrame(rows, "id string, path string, type string, size long, container string")
        e = spark.createDataFrame([(*x, "use")[:3] for x in edges], "src string, dst string, kind string")
        if sites is not None:
            kw["sites"] = spark.createDataFrame(sites, "src string, dst string, kind string, node_path string, component string, property string, sub_name string")
        return Graph.from_links(n, e, **kw)

    return build
