"""The registered queries of the operators that SQL can express, on the small tables."""

from __future__ import annotations

import os

import pytest
from compare import connect, mismatch

from refloom.llm.queries import ORACLE, QUERIES

SF = os.environ.get("REFLOOM_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    assert mismatch(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
