"""Sources, merges, point-in-time access, analysis, performance, quality and streams."""

from __future__ import annotations

import random
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlgate.operators import analysis, performance, portal, quality
from marlgate.plans import market_queries
from marlgate.sources import query, registry, writer
from marlgate.streaming import pipelines
from tests.conftest import spark_rows, sql_rows

FAST = ["source_projection", "sink_lake", "merge_upsert", "merge_ranges", "asof_close", "statements_known", "constituents_known", "universe_mask", "analysis_information", "analysis_neutral", "analysis_turnover", "performance_metrics", "quality_rules", "stream_windows", "event_sessions", "calendar_sessions"]


@pytest.mark.parametrize("name", FAST)
def test_equals_sql(spark, data, name):
    assert spark_rows(market_queries.queries()[name](spark, data)) == sql_rows(data, market_queries.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(market_queries.queries()) == set(market_queries.oracle_sql())


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lake"))
    bars = spark.createDataFrame([("20220103", " 000001.SZ ", "10.5", "x"), ("20220104", "000001.SZ", "nan", "3"), ("20230103", "600000.SH", "7", None), (None, "", "1", "1")], "trade_date string, ts_code string, close string, volume string")
    writer.write_table(bars, registry.TABLES["stock_daily"], folder)
    return query.LocalData(spark, folder)


def test_lake_round_trip(lake):
    rows = lake.query("stock_daily", "trade_date,ts_code,close,volume", start="20220101", end="20221231").collect()
    assert [tuple(r) for r in rows] == [("20220103", "000001.SZ", 10.5, None), ("20220104", "000001.SZ", None, 3.0)]
    assert "year" in lake.query("stock_daily", start="20220101", end="20221231")._jdf.queryExecution().executedPlan().toString().split("PartitionFilters", 1)[1][:200]
    assert lake.query("stock_daily", "ts_code", {"ts_code": []}).count() == 0 and lake.query("stock_daily", "ts_code", {"ts_code": None}).count() == 0
    for bad in (lambda: lake.query("nothing"), lambda: lake.query("stock_daily", "nothing"), lambda: lake.query("stock_daily", limit=-1), lambda: lake.query("stock_basic", start="2022")):
        with pytest.raises((KeyError, ValueError, Exception)):
            bad()


def test_only_reading_sql(lake):
    lake.register(["stock_daily"])
    assert lake.sql("SELECT count(*) AS n FROM stock_daily WHERE ts_code = :c", {"c": "600000.SH"}).first()["n"] == 1
    assert lake.sql("WITH x AS (SELECT * FROM stock_daily) SELECT ts_code FROM x UNION SELECT 'a'").count() >= 2
    for bad in ("DROP TABLE x", "INSERT INTO stock_daily SELECT * FROM stock_daily", "WITH x AS (SELECT 1) INSERT INTO y SELECT * FROM x", "CREATE TABLE a AS SELECT 1", "SET a=b"):
        with pytest.raises(PermissionError):
            lake.sql(bad)
    with pytest.raises(Exception, match="(?i)parse|syntax"):
        lake.sql("SELECT 1; DROP TABLE x")


def test_merges(spark):
    old = spark.createDataFrame([("a", "d1", 1), ("a", "d2", 2), ("b", "d1", 3), (None, "d1", 9)], "k string, d string, v int")
    new = spark.createDataFrame([("a", "d2", 5), ("c", "d1", 6), ("c", "d1", 7)], "k string, d string, v int")
    got = lambda f: sorted(map(tuple, f.collect()), key=str)
    assert got(writer.upsert(old, new, ["k", "d"], ["v"])) == got(spark.createDataFrame([("a", "d1", 1), ("a", "d2", 5), ("b", "d1", 3), ("c", "d1", 7), (None, "d1", 9)], old.schema))
    assert got(writer.replace_groups(old, new, ["d"])) == got(new)
    assert got(writer.replace_ranges(old, new, "k", "d")) == got(spark.createDataFrame([("a", "d1", 1), ("b", "d1", 3), (None, "d1", 9), ("a", "d2", 5), ("c", "d1", 6), ("c", "d1", 7)], old.schema))
    ids = writer.stable_ids(spark.createDataFrame([("a", 4)], "ts_code string, sid long"), spark.createDataFrame([("c",), ("b",), ("a",), (None,)], "ts_code string"))
    assert got(ids) == [("a", 4), ("b", 5), ("c", 6)]
    assert writer.signature({"b": 1, "a": 2}) == writer.signature({"a": 2, "b": 1})


def test_manifest_tells_changes(spark, lake, tmp_path):
    spec = [registry.TABLES["stock_daily"]]
    before = writer.manifest(spark, lake.folder, spec)
    assert before.count() > 0 and writer.changed_files(before, before).count() == 0
    other = before.withColumn("sha256", F.lit("0"))
    assert {r["problem"] for r in writer.changed_files(before, other).collect()} == {"different"}
    assert {r["problem"] for r in writer.changed_files(before, before.limit(0)).collect()} == {"missing"}


def test_adjustment_of_a_split(spark):
    rows = [("e", 1, 4.0, 1.0), ("e", 2, 4.0, None), ("e", 3, 2.0, 2.0), ("f", 1, 5.0, None)]
    bars = spark.createDataFrame(rows, "asset string, session int, close double, adj_factor double")
    take = lambda f: {(r["asset"], r["session"]): r["close"] for r in f.collect()}
    assert take(portal.adjusted(bars, "qfq")) == {("e", 1): 2.0, ("e", 2): 2.0, ("e", 3): 2.0, ("f", 1): 5.0}
    assert take(portal.adjusted(bars, "hfq"))["e", 3] == 4.0
    assert take(portal.adjusted(bars, "qfq", reference=2))["e", 1] == 4.0
    with pytest.raises(ValueError):
        portal.adjusted(bars, "other")


def test_statements_hide_the_announcement_day(spark):
    rows = [("a", "20231231", "1", "20240102", "0", 1, 100.0), ("a", "20231231", "1", "20240104", "1", 2, 110.0), ("a", "20240104", "1", "20240105", "0", 3, 120.0)]
    reports = spark.createDataFrame(rows, "ts_code string, end_date string, report_type string, effective_ann_date string, update_flag string, source_order long, revenue double")
    seen = {d: [r["revenue"] for r in portal.statements_known(reports, d, ["revenue"]).collect()] for d in ("20240102", "20240103", "20240104", "20240105", "20240108")}
    assert seen == {"20240102": [], "20240103": [100.0], "20240104": [100.0], "20240105": [110.0], "20240108": [120.0]}


def test_members_are_known_the_day_after(spark):
    rows = [("i", "20240102", "a"), ("i", "20240102", "b"), ("i", "20240104", "b")]
    snaps = spark.createDataFrame(rows, "series string, snapshot string, item string")
    assert {d: sorted(r["item"] for r in portal.members_on(snaps, d).collect()) for d in ("20240102", "20240103", "20240104", "20240105")} == {"20240102": [], "20240103": ["a", "b"], "20240104": ["a", "b"], "20240105": ["b"]}


def test_last_known_against_brute_force(spark):
    rng = random.Random(2)
    left = [(i, rng.choice("ab"), rng.randint(0, 20)) for i in range(60)]
    right = [(rng.choice("abc"), rng.randint(0, 20), rng.randint(0, 99)) for _ in range(30)]
    lf, rf = spark.createDataFrame(left, "id int, k string, at int"), spark.createDataFrame(right, "k string, known int, v int")
    for strict in (True, False):
        got = {r["id"]: r["v"] for r in portal.last_known(lf, rf, ["k"], "at", "known", ["v"], strict).collect()}
        for i, k, at in left:
            seen = [(known, v) for kk, known, v in right if kk == k and (known < at or (not strict and known == at))]
            assert got[i] == (max(seen)[1] if seen else None)


def test_calendar_problems(spark):
    rows = [("X", "20240101", 0, None), ("X", "20240102", 1, None), ("X", "20240102", 1, None), ("X", "20240104", 1, "20240101"), ("X", "2024", 1, None)]
    got = {(r["cal_date"], r["problem"]) for r in portal.calendar_problems(spark.createDataFrame(rows, "exchange string, cal_date string, is_open int, pretrade_date string")).collect()}
    assert got == {("20240102", "repeated"), ("20240103", "missing"), ("20240104", "broken chain"), ("2024", "unreadable")}


def test_neutral_factor_is_orthogonal(spark):
    rng = np.random.default_rng(1)
    rows = [(f"a{i}", 1, 0, float(rng.normal()), "I1" if i % 2 else "I2", float(rng.lognormal(3, 1))) for i in range(40)] + [("z", 1, 0, 1.0, None, 5.0), ("y", 1, 0, 1.0, "I1", -5.0)]
    out = analysis.neutralized(spark.createDataFrame(rows, "asset string, session int, session_idx int, f double, industry string, cap double")).toPandas()
    ok = out[out["f"].notna()]
    assert set(out["asset"]) - set(ok["asset"]) == {"z", "y"}
    assert abs(ok.groupby("industry")["f"].sum()).max() < 1e-9 and abs((ok["f"] * np.log(ok["cap"])).sum()) < 1e-9


def test_quantile_labels_and_constant_factors(spark):
    rows = [(f"a{i}", 1, 0, float(i // 2), 0.01 * i) for i in range(7)]
    frame = spark.createDataFrame(rows, "asset string, session int, session_idx int, f double, r double")
    want = np.ceil(pd.Series([r[3] for r in rows]).rank(method="first", pct=True) * 5).astype(int).tolist()
    assert [r["q"] for r in analysis.labelled(frame, 5).orderBy("asset").collect()] == want
    flat = frame.withColumn("f", F.lit(1.0))
    assert analysis.information(flat).first()["ic"] is None
    assert analysis.summary(analysis.information(frame))["sessions"] == 1


def test_performance_of_a_known_series(spark):
    r = [0.1, -0.2, 0.05, 0.0]
    value = np.cumprod([1 + x for x in r])
    daily = spark.createDataFrame([(date(2024, 1, 1 + i), x, float(v), 0.01 * i) for i, (x, v) in enumerate(zip(r, value, strict=True))], "day date, returns double, portfolio_value double, benchmark_return double")
    m = performance.metrics(daily).first()
    assert m["total_return"] == pytest.approx(value[-1] - 1) and m["max_drawdown"] == pytest.approx(0.2)
    assert m["sharpe"] == pytest.approx(np.mean(r) / np.std(r, ddof=1) * 252**0.5) and m["sortino"] == pytest.approx(np.mean(r) * 252**0.5 / np.sqrt(np.mean(np.minimum(r, 0) ** 2)))
    assert performance.monthly_table(daily).first()["1"] == pytest.approx(value[-1] - 1)
    trades = spark.createDataFrame([(3.0,), (-1.0,), (0.0,)], "pnl double")
    t = performance.closed_trade_ratios(trades).first()
    assert t["win_rate"] == pytest.approx(1 / 3) and t["profit_factor"] == 3.0
    assert performance.metrics(daily.limit(0)).first()["sharpe"] is None
    assert performance.histogram(daily.limit(0), "returns", 5).count() == 0


def test_quality_status(spark):
    rows = [("t", "r1", "warn", 2), ("t", "r2", "fail", 0), ("u", "r1", "fail", 1), ("v", "r1", "fail", 0)]
    assert {r["table_name"]: r["status"] for r in quality.status(spark.createDataFrame(rows, "table_name string, rule string, severity string, count long")).collect()} == {"t": "warn", "u": "fail", "v": "pass"}


def test_stream_upserts_are_repeatable(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, v int"
    state = {"n": 0}

    def read():
        return spark.read.parquet(f"{out}/{state['n']}") if state["n"] else None

    def publish(frame):
        frame.write.mode("overwrite").parquet(f"{out}/{state['n'] + 1}")
        state["n"] += 1

    spark.createDataFrame([("a", 1), ("b", 1)], schema).coalesce(1).write.mode("append").parquet(source)
    for more in ([("a", 2)], [("c", 3), ("a", 4)]):
        pipelines.upsert_stream(pipelines.file_stream(spark, source, schema), read, publish, ["k"], ["v"], str(tmp_path / "state")).awaitTermination()
        spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(source)
    pipelines.upsert_stream(pipelines.file_stream(spark, source, schema), read, publish, ["k"], ["v"], str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, read().collect())) == [("a", 4), ("b", 1), ("c", 3)]


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and {"p1_found", "p2_found", "p3_found", "p5_found", "p6_found", "p7_found"} <= names
