"""Generations of a lake, its catalogue and command line; staged CSV; the rules of resuming."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from marlgate.__main__ import run
from marlgate.operators import portal, research
from marlgate.sources import bundle, feeds, registry, writer


def test_generations_inherit_roll_back_and_recover(spark, data, tmp_path):
    folder = str(tmp_path / "lake")
    with pytest.raises(FileNotFoundError):
        bundle.Bundle(spark, folder)
    basic = spark.createDataFrame([("b", "20200101"), ("a", None)], "ts_code string, list_date string")
    first = bundle.build_bundle(spark, folder, {"stock_basic": basic})
    assert sorted((r["ts_code"], r["sid"]) for r in first.catalog().collect()) == [("a", 0), ("b", 1)]
    bars = spark.read.parquet(f"{data}/stock_daily.parquet")
    second = bundle.build_bundle(spark, folder, {"stock_daily": bars, "stock_basic": spark.createDataFrame([("0", None), ("b", "20200101")], basic.schema)})
    assert {r["ts_code"]: r["sid"] for r in second.catalog().collect()} == {"a": 0, "b": 1, "0": 2}  # ids stay, also of what is gone
    third = bundle.build_bundle(spark, folder, {"stock_basic": basic})
    assert third.holders["stock_daily"] == second.name and third.read("stock_daily").count() == bars.count()
    assert first.read("stock_basic").count() == 2 and third.problems().count() == 0
    with pytest.raises(FileNotFoundError):
        third.read("income")
    assert third.store.roll_back() == second.name and bundle.Bundle(spark, folder).name == second.name
    assert third.store.recover() == [third.name]  # what no generation in force names goes

    class Lost(Exception):
        pass

    def broken(*_args, **_more):
        raise Lost

    keep, bundle.manifest = bundle.manifest, broken
    try:
        with pytest.raises(Lost):
            bundle.build_bundle(spark, folder, {"stock_basic": basic.limit(0)})
    finally:
        bundle.manifest = keep
    assert bundle.Bundle(spark, folder).name == second.name
    victim = next(os.path.join(at, f) for at, _, fs in os.walk(f"{folder}/{second.name}/tables") for f in fs if f.endswith(".parquet"))
    os.remove(victim)
    assert {r["problem"] for r in bundle.Bundle(spark, folder).problems().collect()} == {"missing"}


def test_command_line(spark, data, tmp_path, capsys):
    folder = str(tmp_path / "lake")
    assert run(["build", folder, f"stock_daily={data}/stock_daily.parquet", f"stock_basic={data}/stock_basic.parquet"], spark) == 0
    assert run(["update", folder, f"stock_basic={data}/stock_basic.parquet"], spark) == 0 and run(["check", folder], spark) == 0
    assert run(["query", folder, "stock_daily", "--fields", "ts_code, close", "--start", "20220101", "--limit", "3"], spark) == 0
    assert run(["sql", folder, "SELECT count(*) AS many FROM stock_daily"], spark) == 0 and "many" in capsys.readouterr().out
    with pytest.raises(PermissionError):
        run(["sql", folder, "DROP VIEW stock_daily"], spark)
    assert run(["quality", folder, str(tmp_path / "report")], spark) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "report/findings.csv")).where("rule = 'duplicate_primary_key'").count() == 2
    with pytest.raises(SystemExit):
        run(["query", folder, "nothing"], spark)


def test_staged_csv_resumes(spark, tmp_path):
    folder, schema = str(tmp_path / "staged"), "d string, v int"
    rows = [("1", 1), ("1", 2), ("2", 3), (None, 4)]
    assert feeds.stage_csv(spark.createDataFrame(rows, schema), folder, "d") == 3
    assert feeds.stage_csv(spark.createDataFrame(rows[::-1], schema), folder, "d") == 0
    assert feeds.stage_csv(spark.createDataFrame([*rows[:3], ("3", 9), ("2", 8)], schema), folder, "d") == 2
    back = spark.read.option("header", True).csv(folder).select("d", F.col("v").cast("int"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted([*rows, ("3", 9), ("2", 8)], key=str)


def test_small_rules(spark):
    settings = {"a": 1}
    state = {"signature": writer.signature(settings), "started": 1000.0}
    assert writer.resumable(state, settings, 1000.0 + 3600) and not writer.resumable(state, {"a": 2}, 2000.0)
    assert not writer.resumable(state, settings, 1000.0 + 25 * 3600) and not writer.resumable(None, settings, 0.0)
    bars = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "ts_code string, trade_date string")
    halts = spark.createDataFrame([("a", "1", "s"), ("a", "2", "R"), ("b", "1", None), ("a", "1", "S")], "ts_code string, trade_date string, suspend_type string")
    got = {(r["ts_code"], r["trade_date"]): (r["suspended"], r["is_st"]) for r in portal.flagged(bars, halts, bars.limit(0)).collect()}
    assert got == {("a", "1"): (1, 0), ("a", "2"): (0, 0), ("b", "1"): (0, 0)}
    snaps = spark.createDataFrame([("i", "20220115", "x"), ("i", "20220301", "x"), ("j", "20220202", "x")], "series string, snapshot string, item string")
    assert sorted(map(tuple, research.missing_months(snaps, "202201", "202203").collect())) == [("i", "202202"), ("j", "202201"), ("j", "202203")]
    assert "close" in registry.available_fields() and "daily_basic.pe" in registry.available_fields()
