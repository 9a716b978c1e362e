"""Registered queries against their SQL.  A quick subset by default; REFLOOM_ALL_QUERIES=1 runs all."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as E
from compare import connect, mismatch

SF = os.environ.get("REFLOOM_SF_DIR", "/root/testdata/sf0.001")
QUICK = (
    "closure_by_type", "blast_radius", "dep_tree_pruned", "cycle_groups", "forbid_transitive", "container_links", "duplication_by_priority", "size_map",
    "dropped_records", "exact_duplicates", "signature_confirm", "resolve_names", "fuzzy_search", "uuid_refs", "section_records", "doc_validation", "rewrite_refs",
    "transition_graph", "refresh_links",
)
NAMES = sorted(E.queries()) if os.environ.get("REFLOOM_ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = E.queries()[name](spark, SF)
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        assert mismatch(df, con, sql) is None


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
