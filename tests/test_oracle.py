"""Every named query against its DuckDB twin at sf0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as E
from conftest import SF_ORACLE, SF_SMALL
from cartograph.plans.catalog import QUERIES as CATALOG
from oracle_check import compare

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, name):
    ok, msg, _, _ = compare(spark, name, QUERIES[name], ORACLE[name], SF_ORACLE)
    assert ok, msg


def test_every_query_has_an_oracle_or_is_listed():
    assert set(CATALOG) <= set(ORACLE)
    assert set(CATALOG) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["site", "base_url", "site_name", "n_pages", "n_sections", "doc"]
    assert df.count() > 0
    assert QUERIES["report_lines"](spark, SF_SMALL).count() > 0
