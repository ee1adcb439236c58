"""Writing, swapping and recovering tables, stream merges by partition, planning, and views as known at a session."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from marlgate.operators import bars, portal, quality, research
from marlgate.sources import registry, writer
from marlgate.streaming import pipelines


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_a_table_is_swapped_in_and_comes_back_after_a_crash(spark, data, tmp_path):
    spec, lake = registry.TABLES["stock_daily"], str(tmp_path)
    table = spark.read.parquet(f"{data}/stock_daily.parquet")
    path = writer.write_table(table, spec, lake, rows_a_file=200)
    first = spark.read.parquet(path).count()
    assert first == table.count() and len([f for _, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]) > 2  # a year isn't one file

    class Lost(Exception):
        pass

    def broken(*_):
        raise Lost

    keep = writer.swap
    writer.swap = broken
    try:
        with pytest.raises(Lost):
            writer.write_table(table.limit(1), spec, lake)
    finally:
        writer.swap = keep
    assert spark.read.parquet(path).count() == first  # half a write is never seen
    os.rename(path, os.path.join(os.path.dirname(path), f".{os.path.basename(path)}-old"))  # died between the two renames
    assert writer.recover_table(spark, path) and spark.read.parquet(path).count() == first
    assert not writer.recover_table(spark, path) and not [f for f in os.listdir(os.path.dirname(path)) if f.startswith(".") and "-" in f]
    writer.write_table(table.limit(3), spec, lake)
    assert spark.read.parquet(path).count() == 3


def test_manifest_counts_rows_and_sees_content(spark, data, tmp_path):
    spec = registry.TABLES["stock_daily"]
    table = spark.read.parquet(f"{data}/stock_daily.parquet")
    writer.write_table(table, spec, str(tmp_path))
    told = writer.manifest(spark, str(tmp_path), [spec])
    assert told.agg(F.sum("rows")).first()[0] == table.count() and told.where("sha256 is null").count() == 0
    assert told.join(writer.manifest(spark, str(tmp_path), [spec], most_bytes=0).where("sha256 is null"), ["path", "digest", "rows"]).count() == told.count()


def test_manifest_of_a_file_of_over_a_million_rows(spark, tmp_path):
    spec = registry.TABLES["stock_daily"]
    digit = F.shiftrightunsigned(F.xxhash64("id"), 20).cast("decimal(20,0)")
    for rows in (1000, 1_500_000):  # the larger one's digits sum to more than a long holds
        frame = spark.range(0, rows, 1, 1)
        frame.write.mode("overwrite").parquet(f"{tmp_path}/{spec.path}")
        told = writer.manifest(spark, str(tmp_path), [spec]).collect()
        total = int(frame.agg(F.sum(digit)).first()[0])
        assert [r["rows"] for r in told] == [rows] and (total >= 1 << 63) == (rows > 1000)
        assert told[0]["digest"] % (1 << 64) == total % (1 << 64)
        if total < 1 << 63:
            assert told[0]["digest"] == total  # what saved manifests hold


def test_calendars_and_codes(spark):
    schema = "exchange string, cal_date string, is_open int, pretrade_date string"
    old, new = [("S", "20240102", 1, None), ("S", "20240103", 1, "20240102")], [("S", "20240103", 0, "20240102"), ("S", "20240104", 1, "20240102"), ("S", "20240105", 1, "20240104")]
    merged = writer.merge_calendar(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), "20240104")
    assert rows_of(merged) == [("S", "20240102", 1, None), ("S", "20240103", 0, "20240102"), ("S", "20240104", 1, "20240102")]
    assert rows_of(writer.pruned(merged, "cal_date", ["20240102"])) == [("S", "20240102", 1, None)]
    assert portal.sessions_between(merged, "S", "20240102", "20240104") == ["20240102", "20240104"]
    with pytest.raises(ValueError):
        portal.sessions_between(merged, "S", "20240103", "20240104")
    assert portal.safe_end(merged, "S", "20240104 16:59") == "20240102" and portal.safe_end(merged, "S", "20240104 17:00") == "20240104"
    assert portal.safe_end(merged, "S", "20240101 18:00") is None
    assert {r["cal_date"]: (r["is_session"], r["shifted"]) for r in portal.day_offsets(merged, "S", 1).collect()} == {"20240102": (True, "20240104"), "20240103": (False, "20240104"), "20240104": (True, None)}
    assert {r["cal_date"]: r["shifted"] for r in portal.day_offsets(merged, "S", -1).collect()} == {"20240102": None, "20240103": "20240102", "20240104": "20240102"}


def test_keep_last_takes_one_row_a_key(spark):
    rows = [("a", 1, None, "x"), ("a", 2, None, "y"), ("a", None, 9, "z"), (None, 5, 1, "n"), (None, 6, 1, "m")]
    frame = spark.createDataFrame(rows, "k string, o int, p int, _last string")
    assert rows_of(writer.keep_last(frame, ["k"], ["o", "p"])) == [("a", 2, None, "y"), (None, 6, 1, "m")]
    assert writer.keep_last(frame, ["k"], ["o"]).columns == frame.columns and writer.keep_last(frame.limit(0), ["k"], ["o"]).count() == 0


def test_stream_rewrites_only_the_partitions_it_touches(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "k string, v int, y int"
    stream = lambda: pipelines.upsert_partitions(pipelines.file_stream(spark, source, schema), out, "y", ["k"], ["v"], state).awaitTermination()
    spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("b", 0, 2)], schema).coalesce(1).write.mode("append").parquet(source)
    stream()
    untouched = {f: os.stat(os.path.join(out, "y=2", f)).st_mtime_ns for f in os.listdir(f"{out}/y=2")}
    spark.createDataFrame([("a", 3, 1), ("c", 5, 1)], schema).coalesce(1).write.mode("append").parquet(source)
    stream()
    stream()
    assert rows_of(spark.read.schema(schema).parquet(out)) == [("a", 3, 1), ("b", 1, 2), ("c", 5, 1)]
    assert {f: os.stat(os.path.join(out, "y=2", f)).st_mtime_ns for f in os.listdir(f"{out}/y=2")} == untouched


def test_validity_and_statements(spark):
    events = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "b", 1), (4, None, 1), (5, "a", None)], "i int, k string, at int")
    spans = spark.createDataFrame([("a", 0, 10, "old"), ("a", 4, 8, "inner"), ("a", 10, None, "new"), ("b", None, 1, "gone")], "k string, s int, u int, name string")
    assert {r["i"]: r["name"] for r in portal.valid_at(events, spans, ["k"], "at", "s", "u", ["name"]).collect()} == {1: "inner", 2: "new", 3: None, 4: None, 5: None}
    a, b = spark.createDataFrame([("x", "d1", 1.0)], "ts_code string, end_date string, p double"), spark.createDataFrame([("x", "d2", 2.0)], "ts_code string, end_date string, q double")
    assert rows_of(portal.statements_joined([a, b])) == [("x", "d1", 1.0, None), ("x", "d2", None, 2.0)]


@pytest.fixture()
def panel(spark):
    rows = [("e", d, i, c, f, "20200101", st) for i, (d, c, f, st) in enumerate([("20240102", 4.0, 1.0, 0), ("20240103", 4.0, 1.0, 0), ("20240104", 2.0, 2.0, 1)])]
    rows += [("n", d, i, 1.0 + i, None, "20240103", 0) for i, d in enumerate(("20240102", "20240103", "20240104"))]
    frame = spark.createDataFrame(rows, "asset string, session string, session_idx int, close double, adj_factor double, listed string, is_st int")
    return frame.withColumn("volume", F.lit(1.0)).withColumn("list_date", F.to_date("listed", "yyyyMMdd")).withColumn("delist_date", F.lit(None).cast("date"))


def test_history_is_adjusted_as_of_its_end(spark, panel):
    take = lambda end: [r["close"] for r in portal.history(panel, ["close"], end, 2, ["e"], "qfq").orderBy("session").collect()]
    assert take("20240103") == [4.0, 4.0] and take("20240104") == [2.0, 2.0] and take("20231231") == []
    view = bars.BarView(panel, "20240104")
    assert {r["asset"]: r["close"] for r in view.current(["close"]).collect()} == {"e": 2.0, "n": 3.0}
    assert [r["close"] for r in bars.BarView(panel, "20240103").history(["close"], 5, ["e"]).orderBy("session").collect()] == [4.0, 4.0]
    assert {r["asset"]: r["can_trade"] for r in view.can_trade("is_st").collect()} == {"e": False, "n": True}
    assert view.raw_current(["close"], ["e"]).first()["close"] == 2.0
    with pytest.raises(ValueError):
        view.history(["close"], 0)
    with pytest.raises(ValueError):
        view.constituents("20240104")


def test_factor_data_masks_and_sees_the_past(spark, panel):
    dated = panel.withColumn("session", F.to_date("session", "yyyyMMdd"))
    data = research.FactorData(dated, F.to_date(F.lit("20240103"), "yyyyMMdd"), F.to_date(F.lit("20240104"), "yyyyMMdd"), None, "qfq", 1, ("is_st",))
    got = {(r["asset"], r["session"].strftime("%d")): r["v"] for r in data.history({"v": "MA($close, 2)"}).collect()}
    assert got == {("e", "03"): 2.0, ("e", "04"): None, ("n", "03"): None, ("n", "04"): 2.5}


def test_quality_report(spark, tmp_path):
    found = quality.unreadable_tables(spark, str(tmp_path), [registry.TABLES["stock_daily"]])
    assert [tuple(r) for r in found.collect()] == [("stock_daily", "readable_table", "fail", 1)]
    quality.write_report(found, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report/findings.csv")).count() == 1
    assert spark.read.json(str(tmp_path / "report/status.json")).first()["status"] == "fail"
