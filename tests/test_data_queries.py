"""Queries p1 to p3 and p5 to p7 against SQL, on the smallest test tables and on variants of them that strain the operators."""

from __future__ import annotations

import pytest

from marlgate.plans import data_queries
from tests.conftest import spark_rows, sql_rows, variant

TABLES = ["daily", "stock_daily", "feed_units", "index_weight", "update_runs", "income", "positions", "trade_cal", "stock_basic"]
NAMES = list(data_queries.queries())


@pytest.fixture(scope="module", params=["empty", "nulls", "doubled", "clash"])
def strained(request, tmp_path_factory):
    return request.param, variant(str(tmp_path_factory.mktemp(request.param)), request.param, TABLES)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, data, name):
    assert spark_rows(data_queries.queries()[name](spark, data)) == sql_rows(data, data_queries.oracle_sql()[name])


@pytest.mark.parametrize("name", NAMES)
def test_strained(spark, data, strained, name):
    kind, folder = strained
    got = spark_rows(data_queries.queries()[name](spark, folder))
    wanted = data if kind == "clash" else folder
    assert got == sql_rows(wanted, data_queries.oracle_sql()[name])
