"""Survivorship against SQL, golden values and strained tables."""

from __future__ import annotations

import pytest

from marlgate.functions import normalize as norm
from marlgate.llm import queries, survivorship
from tests.conftest import spark_rows, sql_rows, variant

NAMES = ["p4_found", "p4_survivors"]


def test_survivor_takes_each_field_from_its_best_row(spark):
    rows = [(1, "k", 1, 5.0, None), (2, "k", 3, None, 1.0), (3, "k", 2, 7.0, 2.0), (4, "k", 2, 8.0, None), (5, None, 1, float("nan"), None)]
    frame = spark.createDataFrame(rows, "row_id long, key string, p int, a double, b double").withColumn("a", norm.as_number("a"))
    got = {r["key"]: r for r in survivorship.survivors(frame, ["key"], ["p"], ["a", "b"]).collect()}
    assert got["k"]["n_rows"] == 4 and got["k"]["a"]["row_id"] == 3 and got["k"]["b"]["value"] == 1.0
    assert got[None]["a"] is None and got[None]["b"] is None


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, data, name):
    assert spark_rows(queries.queries()[name](spark, data)) == sql_rows(data, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("kind", ["empty", "nulls", "doubled", "clash"])
def test_strained(spark, data, tmp_path, kind, name):
    folder = variant(str(tmp_path), kind, ["income"])
    got = spark_rows(queries.queries()[name](spark, folder))
    assert got == sql_rows(data if kind == "clash" else folder, queries.oracle_sql()[name])
