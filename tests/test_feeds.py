"""Feeds, masked research and small-series helpers."""

from __future__ import annotations

import numpy as np
import pytest

from marlgate.operators import research
from marlgate.sources import feeds, registry

PAGES = {"a": [(f"a{i}", i) for i in range(5)], "b": []}


def fetch(key, offset, limit):
    return PAGES[key][offset : offset + limit]


def stuck(key, offset, limit):
    return [("x", 1)] * limit


def test_paged_source(spark):
    spark.dataSource.register(feeds.PagedSource)
    read = spark.read.format("paged").option("schema", "k string, v int").option("keys", "a,b").option("limit", 2)
    assert sorted(r["v"] for r in read.option("fetch", "tests.test_feeds:fetch").load().collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="repeats"):
        read.option("fetch", "tests.test_feeds:stuck").load().collect()


def test_staged_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("trade_date,ts_code,close,extra\n20220103, 000001.SZ ,10.5,q\n20220104,,abc,\n")
    rows = feeds.staged_csv(spark, str(tmp_path), registry.TABLES["stock_daily"], 2).select("trade_date", "ts_code", "close", "year").orderBy("trade_date").collect()
    assert [tuple(r) for r in rows] == [("20220103", "000001.SZ", 10.5, 2022), ("20220104", None, None, 2022)]


def test_analysis_of_a_panel(spark):
    rng = np.random.default_rng(3)
    rows = [(f"a{i}", s, s, float(50 + rng.normal())) for i in range(12) for s in range(15)]
    panel = spark.createDataFrame(rows, "asset string, session int, session_idx int, close double")
    out = research.analyze(panel, "0 - RETURNS($close, 1)", (1, 2), 3)
    assert set(out) == {1, 2} and out[1]["information"].where("ic is not null").count() == 13
    assert out[2]["information"].where("rank_ic > 0").count() > 6
    half = research.masked(panel, {"v": "RANK($close)"}, panel["close"] > 50)
    assert 0 < half.where("v is not null").count() < 180


def test_small_series():
    assert research.quarter_ends("20220401", "20230331") == ["20220630", "20220930", "20221231", "20230331"]
    at, dense = research.density([0.1, 0.2, 0.15, None, 0.3])
    assert np.trapezoid(dense, at) == pytest.approx(1, abs=0.01) and len(research.density([1.0, 1.0])[0]) == 0
    assert research.normal_quantiles([3, 1, 2])[1] == (0.0, 2)
