"""Registered queries against their SQL twins; ``python check.py`` compares all of them."""
import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

SMALL = "/root/testdata/sf0.001"
SOME = ["log_search_negation", "log_facets", "error_kinds_documents", "access_parse", "lb_totals", "lb_paths_slow", "lb_requests_page",
        "stage_judge", "range_report", "orders_wow", "inbound_delta", "ab_series", "health_status", "alert_rate_muted", "cluster_readers"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_matches_its_sql(spark, con, name):
    ok, note = compare(spark, con, SMALL, name, entry.queries()[name], entry.oracle_sql()[name], allow_empty=True)
    assert ok, note


def test_names_and_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["t", "level", "n"]
