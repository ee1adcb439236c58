"""The whole profile against SQL: every column of every large table, ranges included, on plain and strained tables."""

from __future__ import annotations

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA, spark_rows, sql_rows, variant

TABLES = ["stock_daily", "income", "daily", "documents", "index_weight", "positions"]


@pytest.mark.parametrize("kind", ["plain", "empty", "nulls", "doubled"])
def test_ranges_equal_sql(spark, tmp_path, kind):
    folder = variant(str(tmp_path), kind, TABLES)
    assert spark_rows(entry.queries()["p7_profile"](spark, folder)) == sql_rows(folder, entry.oracle_sql()["p7_profile"])


def test_every_column_has_its_range(spark, data):
    rows = entry.queries()["p7_profile"](spark, data).collect()
    assert {(r["src_table"], r["column_name"]) for r in rows} == {(t, c) for t in TABLES for c in pq.read_schema(f"{DATA}/{t}.parquet").names}
    for r in rows:
        if r["n_null"] < r["n_rows"]:
            low, high = (r["low"], r["high"]) if r["low"] is not None else (r["low_number"], r["high_number"])
            assert low <= high
