"""Queries over the test tables for sources, merges, point-in-time access, factor analysis, performance, quality and streams."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlgate.functions.normalize import as_number, day_text, digits_of_number, effective_day, market_code, real_day, trimmed
from marlgate.operators import analysis, performance, portal, quality, research
from marlgate.operators.snapshots import index_snapshots
from marlgate.operators.trailing import latest_bars
from marlgate.plans.compiler import evaluate
from marlgate.plans.data_queries import _LATEST, _SNAPSHOTS, code_sql, day_sql, index_sql, reports_sql
from marlgate.plans.factor_queries import PANEL_SQL, monthly_panel
from marlgate.plans.sqltext import steps_of
from marlgate.session import passing, shared_dir
from marlgate.sources.query import LocalData, check_read_only, select_rows
from marlgate.sources.registry import TABLES, normalized
from marlgate.sources.testbed import table
from marlgate.sources.writer import keep_last, merge_calendar, pruned, replace_groups, replace_ranges, upsert, write_table
from marlgate.streaming.pipelines import event_windows, sessions_of

Query = Callable[[SparkSession, str], DataFrame]
SPLIT = 150  # load number that parts a log of deliveries into what is there and what comes


# --- sources and sinks --------------------------------------------------------------------------------------------------
def lake_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Write a table through the registry into a fresh lake, then read it back by a structured query."""
    lake = f"{shared_dir(spark).rstrip('/')}/lake-{uuid.uuid4().hex}"
    write_table(table(spark, folder, "stock_daily"), TABLES["stock_daily"], lake)
    passing(spark, lake)
    return LocalData(spark, lake).query("stock_daily")


def read_only_sql(spark: SparkSession, folder: str) -> DataFrame:
    for name in ("lineitem", "supplier", "nation"):
        table(spark, folder, name).createOrReplaceTempView(f"marlgate_{name}")
    text = """WITH sums AS (SELECT s_nationkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM marlgate_lineitem JOIN marlgate_supplier ON l_suppkey = s_suppkey
      WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY s_nationkey)
      SELECT n_name, n, total FROM sums JOIN marlgate_nation ON s_nationkey = n_nationkey"""
    check_read_only(spark, text)
    return spark.sql(text)


def log_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "stock_daily").select(market_code("ts_code").alias("ts_code"), day_text(real_day("trade_date")).alias("trade_date"), "close", "load_id", "row_id")
    rows = rows.where("ts_code is not null and trade_date is not null")
    return rows.where(F.col("load_id") <= SPLIT), rows.where(F.col("load_id") > SPLIT)


_LOG = f"log AS (SELECT * FROM (SELECT {code_sql('ts_code')} AS ts_code, {day_sql('trade_date')} AS trade_date, close, load_id, row_id FROM stock_daily) WHERE ts_code IS NOT NULL AND trade_date IS NOT NULL)"


# --- point in time ------------------------------------------------------------------------------------------------------
def reports(spark: SparkSession, folder: str, condition: str = "true") -> DataFrame:
    return table(spark, folder, "income").where(condition).select(
        market_code("ts_code").alias("ts_code"), day_text(real_day("end_date")).alias("end_date"), digits_of_number("report_type").alias("report_type"),
        day_text(real_day(effective_day("f_ann_date", "ann_date"))).alias("effective_ann_date"), trimmed("update_flag").alias("update_flag"), "source_order", as_number("revenue").alias("revenue"), as_number("n_income").alias("n_income"),
    ).where("ts_code is not null and end_date is not null")


def factored_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly bars with a split factor: every third asset doubles its factor each 24 sessions; gaps hold no factor."""
    factor = F.when(F.col("close").isNotNull(), F.when(F.col("asset") % 3 == 0, F.pow(F.lit(2.0), F.floor(F.col("session_idx") / 24))).otherwise(1.0))
    return monthly_panel(spark, folder).withColumn("adj_factor", factor.cast("double"))


def adjusted(mode: str) -> Query:
    return lambda spark, folder: portal.adjusted(factored_panel(spark, folder), mode).select("asset", "session", "close", "open")


def _adjusted_sql(mode: str) -> str:
    ref = "" if mode == "hfq" else " / last_value(f) OVER (PARTITION BY asset ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"""WITH {PANEL_SQL}, g AS (SELECT *, CASE WHEN close IS NOT NULL THEN CASE WHEN asset % 3 = 0 THEN pow(2.0, floor(session_idx / 24.0)) ELSE 1.0 END END AS raw FROM panel),
h AS (SELECT *, coalesce(last_value(raw IGNORE NULLS) OVER (PARTITION BY asset ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) AS f FROM g)
SELECT asset, session, close * (f{ref}) AS close, open * (f{ref}) AS open FROM h"""


def close_before_trade(spark: SparkSession, folder: str) -> DataFrame:
    """Each position's last close strictly before its trade date."""
    positions = table(spark, folder, "positions").where(F.upper(trimmed("record_type")) == "POSITION").select(
        "position_id", market_code("ts_code").alias("ts_code"), real_day("trade_date").alias("trade_day")
    ).where("ts_code is not null and trade_day is not null")
    bars = latest_bars(table(spark, folder, "stock_daily")).where("close is not null").select("ts_code", F.col("day").alias("known_day"), "close")
    return portal.last_known(positions, bars, ["ts_code"], "trade_day", "known_day", ["close"]).select("position_id", "ts_code", "close", day_text(F.col("known_day_used")).alias("known_day"))


def universe(spark: SparkSession, folder: str) -> DataFrame:
    basic = table(spark, folder, "stock_basic").select("ts_code", real_day("list_date").alias("list_date"), real_day("delist_date").alias("delist_date"))
    bars = latest_bars(table(spark, folder, "stock_daily")).select("ts_code", F.col("day").alias("session"), (F.coalesce(F.col("volume"), F.lit(0.0)) <= 0).alias("idle"))
    return portal.universe(bars.join(basic, "ts_code"), 90, ["idle"]).select("ts_code", day_text(F.col("session")).alias("session"), "in_universe")


def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    panel = monthly_panel(spark, folder)
    closes = panel.groupBy("session").agg(F.max("high").alias("close"))
    return portal.benchmark_returns(closes, panel).select("session", F.round("benchmark_return", 6).alias("benchmark_return"))


def asset_lives(spark: SparkSession, folder: str) -> DataFrame:
    basic = table(spark, folder, "stock_basic").select("ts_code", *[real_day(c).alias(c) for c in ("list_date", "delist_date")])
    bars = latest_bars(table(spark, folder, "stock_daily")).withColumnRenamed("day", "session")
    lives = portal.asset_life(basic, bars, dt.date(2022, 2, 1), dt.date(2022, 12, 31))
    return lives.select("ts_code", *[day_text(F.col(c)).alias(c) for c in ("first_seen", "last_seen", "life_start", "life_end")])


def stated_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Each figure of ``daily`` with the unit text its feed states for the day."""
    stated = table(spark, folder, "feed_units").where("field_name = 'vol'").select("feed", "asset_type", "unit_text", real_day("valid_from").alias("s"), real_day("valid_until").alias("u"))
    rows = table(spark, folder, "daily").select("row_id", "feed", "asset_type", real_day("trade_date").alias("day"))
    return portal.valid_at(rows, stated, ["feed", "asset_type"], "day", "s", "u", ["unit_text"]).select("row_id", "unit_text")


def best_statement(spark: SparkSession, folder: str, kind: str, figure: str) -> DataFrame:
    """The last version of a kind of statement: ts_code, end_date, figure."""
    rows = table(spark, folder, "income").select(
        market_code("ts_code").alias("ts_code"), day_text(real_day("end_date")).alias("end_date"), digits_of_number("report_type").alias("kind"), "source_order", "row_id", as_number(figure).alias(figure),
    ).where((F.col("kind") == kind) & F.col("ts_code").isNotNull() & F.col("end_date").isNotNull())
    return keep_last(rows, ["ts_code", "end_date"], ["source_order", "row_id", figure]).select("ts_code", "end_date", figure)


# --- factor analysis ----------------------------------------------------------------------------------------------------
FACTOR = {"f": "0 - RETURNS($close, 2)", "r": "FUTURE_RETURNS($close, 1)"}


def factor_frame(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("asset"), F.col("s_nationkey").cast("string").alias("industry"), F.col("s_acctbal").alias("cap"))
    return evaluate(monthly_panel(spark, folder), FACTOR).join(suppliers, "asset")


def _frame_sql() -> str:
    steps, last = steps_of(FACTOR, "panel")
    return ", ".join([PANEL_SQL, *steps, f"x AS (SELECT a.*, CAST(s_nationkey AS VARCHAR) AS industry, s_acctbal AS cap FROM ({last}) a JOIN supplier ON s_suppkey = asset)"])


_RANKS = """ranks AS (SELECT *, CASE WHEN f IS NOT NULL THEN (rank() OVER (PARTITION BY session ORDER BY f ASC NULLS LAST) + (count(*) OVER (PARTITION BY session, f) - 1) / 2.0) / count(f) OVER (PARTITION BY session) END AS rf,
  CASE WHEN r IS NOT NULL THEN (rank() OVER (PARTITION BY session ORDER BY r ASC NULLS LAST) + (count(*) OVER (PARTITION BY session, r) - 1) / 2.0) / count(r) OVER (PARTITION BY session) END AS rr FROM x)"""
_LABELS = "labels AS (SELECT *, CASE WHEN f IS NOT NULL THEN CAST(least(greatest(ceil((row_number() OVER (PARTITION BY session ORDER BY f ASC NULLS LAST, asset) / count(f) OVER (PARTITION BY session)) * 5), 1), 5) AS INT) END AS q FROM x)"


def _corr(a: str, b: str, least: int) -> str:
    both = f"FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"CASE WHEN count(*) {both} >= {least} THEN covar_pop({a}, {b}) {both} / nullif(stddev_pop({a}) {both} * stddev_pop({b}) {both}, 0) END"


def _rounded(make: Callable[[DataFrame], DataFrame], *columns: str, digits: int = 6) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = make(factor_frame(spark, folder))
        return out.withColumns({c: F.round(c, digits) for c in columns})

    return run


# --- performance --------------------------------------------------------------------------------------------------------
def asset_days(spark: SparkSession, folder: str) -> DataFrame:
    """Each asset as a portfolio: day, returns, portfolio_value, benchmark_return (the mean of all)."""
    rows = evaluate(monthly_panel(spark, folder), {"returns": "RETURNS($close, 1)", "portfolio_value": "$close"}).withColumnRenamed("session", "day")
    return rows.where("returns is not null").withColumn("benchmark_return", F.avg("returns").over(Window.partitionBy("day"))).select("asset", "day", "returns", "portfolio_value", "benchmark_return")


_DAYS = f"""WITH {PANEL_SQL}, rs AS (SELECT asset, session AS day, close AS portfolio_value, close / nullif(lag(close) OVER (PARTITION BY asset ORDER BY session), 0) - 1 AS returns FROM panel),
d AS (SELECT *, avg(returns) OVER (PARTITION BY day) AS benchmark_return FROM rs WHERE returns IS NOT NULL),
dd AS (SELECT *, portfolio_value / nullif(max(portfolio_value) OVER (PARTITION BY asset ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - 1 AS drawdown FROM d)"""


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = performance.metrics(asset_days(spark, folder), "asset")
    return out.select("asset", "n", *[shown(c) for c in out.columns if c not in ("asset", "n")])


def shown(c: str) -> Column:
    """Seven significant digits as text: raw returns compound to any size."""
    return F.when(F.col(c).isNotNull(), F.format_string("%.6e", c)).alias(c)


def _performance(make: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    return lambda spark, folder: make(asset_days(spark, folder)).withColumns({c: shown(c) for c in columns})


# --- quality ------------------------------------------------------------------------------------------------------------
def quality_counts(spark: SparkSession, folder: str) -> DataFrame:
    spec = TABLES["stock_daily"]
    daily = table(spark, folder, "stock_daily")
    weights = table(spark, folder, "index_weight").withColumnRenamed("snapshot_date", "trade_date")
    statements = normalized(table(spark, folder, "income").drop("row_id", "load_id"), TABLES["income"])
    return (
        quality.row_findings(daily, spec).unionByName(quality.duplicate_keys(daily, spec)).unionByName(quality.row_findings(weights, TABLES["index_weight"]))
        .unionByName(quality.duplicate_keys(weights, TABLES["index_weight"])).unionByName(quality.row_findings(statements, TABLES["income"]))
    )


def _quality_sql() -> str:
    blank = lambda c: f"coalesce(trim({c}), '') = ''"
    eight = lambda c: f"coalesce(regexp_matches({c}, '^[0-9]{{8}}$') AND try_strptime({c}, '%Y%m%d') IS NOT NULL, false)"
    clean = lambda c: f"nullif(trim({c}), '')"
    statements = f"""(SELECT {clean('ts_code')} AS ts_code, {clean('ann_date')} AS ann_date, {clean('end_date')} AS end_date,
      CASE WHEN coalesce({clean('f_ann_date')}, '0') <> '0' THEN {clean('f_ann_date')} ELSE {clean('ann_date')} END AS effective_ann_date FROM income)"""
    rows = [
        ("stock_daily", "null_primary_key", "fail", "stock_daily", f"{blank('ts_code')} OR {blank('trade_date')}"),
        ("stock_daily", "valid_date", "fail", "stock_daily", f"NOT ({blank('trade_date')}) AND NOT {eight('trade_date')}"),
        ("stock_daily", "ohlc_domain", "warn", "stock_daily", "open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR high < open OR high < close OR high < low OR low > open OR low > close"),
        ("stock_daily", "nonnegative_activity", "fail", "stock_daily", "volume < 0 OR turnover < 0"),
        ("index_weight", "null_primary_key", "fail", "index_weight", f"{blank('index_code')} OR {blank('snapshot_date')} OR {blank('con_code')}"),
        ("index_weight", "valid_date", "fail", "index_weight", f"NOT ({blank('snapshot_date')}) AND NOT {eight('snapshot_date')}"),
        ("index_weight", "weight_domain", "fail", "index_weight", "coalesce(weight < 0 OR weight > 100, true)"),
        ("income", "null_primary_key", "fail", statements, f"{blank('ts_code')} OR {blank('ann_date')} OR {blank('end_date')}"),
        ("income", "valid_date", "fail", statements, f"NOT ({blank('end_date')}) AND NOT {eight('end_date')}"),
        ("income", "finance_pit_dates", "warn", statements, "coalesce(effective_ann_date < end_date, true)"),
    ]
    parts = [f"SELECT '{t}' AS table_name, '{r}' AS rule, '{s}' AS severity, count(*) AS count FROM {src} WHERE {w}" for t, r, s, src, w in rows]
    for t, key in (("stock_daily", "ts_code, trade_date"), ("index_weight", "index_code, snapshot_date, con_code")):
        parts.append(f"SELECT '{t}', 'duplicate_primary_key', 'fail', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM {t} GROUP BY {key})")
    return " UNION ALL ".join(parts)


# --- streams ------------------------------------------------------------------------------------------------------------
def streamed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The events table read as a stream. Each batch gives the windows it changed, so state ends with the watermark; a batch
    that is repeated writes the same place, and of a window's versions the last batch's counts."""
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    passing(spark, base)
    path = f"{folder.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = event_windows(spark.readStream.schema(schema).parquet(path + "*"), "1 day")
    writer = stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")).start().awaitTermination()
    return _shown(keep_last(spark.read.parquet(f"{base}/out"), ["window_start", "event_type"], ["batch"]))


def _shown(windows: DataFrame) -> DataFrame:
    return windows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


_WINDOWS = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def top_by_sector(spark: SparkSession, folder: str) -> DataFrame:
    """The three best of each industry and session by factor, ties by size and asset."""
    rows = factor_frame(spark, folder).where("f is not null")
    place = F.row_number().over(Window.partitionBy("session", "industry").orderBy(F.col("f").desc(), F.col("cap").desc_nulls_last(), "asset"))
    return rows.withColumn("place", place).where("place <= 3").select("session", "industry", "asset", "place")


def tilted_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Within an industry weights follow the factor's rank; industries share alike."""
    ranked = analysis.percent_rank(factor_frame(spark, folder).where("f is not null"), "f", "_rank")
    inside = F.col("_rank") / F.sum("_rank").over(Window.partitionBy("session", "industry"))
    sectors = F.size(F.collect_set("industry").over(Window.partitionBy("session")))
    return ranked.select("session", "asset", F.round(inside / sectors, 6).alias("weight"))


def queries() -> dict[str, Query]:
    t = table
    return {
        "source_projection": lambda s, d: select_rows(t(s, d, "orders"), "o_orderkey, o_totalprice", {"o_orderstatus": ["F", "P"], "o_orderpriority": "1-URGENT"}),
        "source_top": lambda s, d: select_rows(t(s, d, "stock_daily"), ["row_id", "trade_date"], start="20220301", end="20220331", limit=50, date_column="trade_date", order=("trade_date", "row_id")),
        "source_empty_filter": lambda s, d: select_rows(t(s, d, "orders"), "o_orderkey", {"o_orderstatus": []}),
        "source_sql": read_only_sql, "sink_lake": lake_daily,
        "merge_upsert": lambda s, d: upsert(*log_parts(s, d), ["ts_code", "trade_date"], ["load_id", "row_id"]),
        "merge_dates": lambda s, d: replace_groups(*log_parts(s, d), ["trade_date"]),
        "merge_ranges": lambda s, d: replace_ranges(*log_parts(s, d), "ts_code", "trade_date"),
        "merge_reports": lambda s, d: upsert(*(reports(s, d, f"load_id {x} {SPLIT}") for x in ("<=", ">")), ["ts_code", "end_date", "report_type"], ["effective_ann_date", "update_flag", "source_order", "revenue", "n_income"]).select("ts_code", "end_date", "report_type", "effective_ann_date", "source_order"),
        "merge_snapshots": lambda s, d: replace_groups(*(t(s, d, "index_weight").where(f"delivery {x} 1") for x in ("<=", ">")), ["index_code", "snapshot_date"]).select("index_code", "snapshot_date", "con_code", "weight", "delivery"),
        "merge_calendar": lambda s, d: merge_calendar(t(s, d, "trade_cal").where("cal_date <= '20230601'"), t(s, d, "trade_cal").where("cal_date > '20230301'").withColumn("is_open", F.lit(1)), "20230901"),
        "merge_pruned": lambda s, d: pruned(t(s, d, "daily"), "asset_type", ["stock", "index"]).select("row_id", "ts_code", "asset_type"),
        "calendar_offsets": lambda s, d: portal.day_offsets(t(s, d, "trade_cal"), "SSE", 5), "calendar_backwards": lambda s, d: portal.day_offsets(t(s, d, "trade_cal"), "SZSE", -3),
        "asset_life": lambda s, d: asset_lives(s, d),
        "interval_units": lambda s, d: stated_texts(s, d),
        "statements_joined": lambda s, d: portal.statements_joined([best_statement(s, d, kind, f) for kind, f in (("1", "revenue"), ("2", "n_income"), ("3", "basic_eps"))]),
        "calendar_sessions": lambda s, d: portal.sessions(t(s, d, "trade_cal"), "SSE"),
        "calendar_problems": lambda s, d: portal.calendar_problems(t(s, d, "trade_cal")),
        "calendar_window": lambda s, d: portal.session_window(portal.sessions(t(s, d, "trade_cal"), "SZSE"), "20220701", 20).select("session", "session_idx"),
        "prices_hfq": adjusted("hfq"), "prices_qfq": adjusted("qfq"),
        "asof_close": close_before_trade,
        "statements_known": lambda s, d: portal.statements_known(reports(s, d), "20221001", ["revenue", "n_income"], "1", 2),
        "constituents_known": lambda s, d: portal.members_on(index_snapshots(t(s, d, "index_weight"))[0], "20220915").select(F.col("series").alias("index_code"), F.col("snapshot").alias("snapshot_date"), F.col("item").alias("con_code")),
        "snapshot_intervals": lambda s, d: portal.snapshot_intervals(index_snapshots(t(s, d, "index_weight"))[0]).withColumnsRenamed({"series": "index_code", "snapshot": "snapshot_date"}),
        "universe_mask": universe, "benchmark_returns": benchmark,
        "analysis_information": _rounded(analysis.information, "ic", "rank_ic"),
        "analysis_neutral": _rounded(lambda x: analysis.neutralized(x).select("asset", "session", "f"), "f"),
        "analysis_quantiles": _rounded(analysis.quantile_returns, "mean_return"),
        "analysis_long_short": _rounded(analysis.long_short, "spread"),
        "analysis_turnover": _rounded(analysis.quantile_turnover, "turnover"),
        "analysis_autocorrelation": _rounded(analysis.rank_autocorrelation, "rank_autocorrelation"),
        "analysis_factor_returns": _rounded(analysis.factor_returns, "factor_return", "universe_return"),
        "analysis_sector_information": _rounded(analysis.sector_information, "ic"),
        "analysis_sector_quantiles": _rounded(analysis.sector_quantiles, "mean_return"),
        "analysis_alpha_beta": _rounded(lambda x: analysis.alpha_beta(analysis.factor_returns(x)), "alpha", "beta", "t_alpha"),
        "performance_metrics": _metrics,
        "performance_drawdown": _performance(lambda x: performance.drawdown(x, "asset").select("asset", "day", "drawdown"), "drawdown"),
        "performance_monthly": _performance(lambda x: performance.calendar_returns(x, "asset"), "return"),
        "performance_yearly": _performance(lambda x: performance.calendar_returns(x, "asset", monthly=False), "return"),
        "performance_rolling": _performance(lambda x: performance.rolling_risk(x, 12, "asset"), "volatility", "sharpe"),
        "performance_cumulative": _performance(lambda x: performance.cumulative(x, "returns", "asset").select("asset", "day", "cumulative"), "cumulative"),
        "performance_moving": _performance(lambda x: performance.moving_mean(x, "returns", 21, 5, "asset").select("asset", "day", "moving_mean"), "moving_mean"),
        "performance_histogram": lambda s, d: performance.histogram(t(s, d, "orders"), "o_totalprice", 20).select("bin", "n"),
        "performance_attribution": lambda s, d: performance.attribution(t(s, d, "positions").where("position_id is not null")).select("ts_code", "days_held", F.round("contribution", 6).alias("contribution"), F.round("mean_weight", 6).alias("mean_weight"), "last_value"),
        "quality_rules": quality_counts,
        "quality_partial_nulls": lambda s, d: quality.partial_nulls(t(s, d, "stock_daily"), "stock_daily"),
        "quality_weight_sums": lambda s, d: quality.weight_sums(t(s, d, "index_weight"), "index_code", "snapshot_date").select("index_code", "snapshot_date", F.round("total", 4).alias("total")),
        "quality_orphans": lambda s, d: quality.orphans(t(s, d, "positions"), t(s, d, "stock_basic"), "ts_code", "ts_code"),
        "quality_coverage": lambda s, d: quality.uncovered(t(s, d, "daily").where("asset_type = 'stock'"), t(s, d, "stock_daily"), ["ts_code", "trade_date"]),
        "stream_windows": streamed_windows, "event_windows": lambda s, d: _shown(event_windows(t(s, d, "events"))),
        "event_sessions": lambda s, d: sessions_of(t(s, d, "events"), "6 hours").select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n"),
        "pipeline_top_by_sector": top_by_sector, "pipeline_tilt": tilted_weights,
        "research_masked": lambda s, d: research.masked(monthly_panel(s, d), {"value": "RANK($close)"}, F.col("close") > F.col("open")).select("asset", "session", "value"),
        "research_missing": lambda s, d: research.missing_sessions(portal.sessions(t(s, d, "trade_cal"), "SSE"), t(s, d, "index_weight"), "snapshot_date", "20220101", "20221231"),
        "pipeline_quotas": lambda s, d: research.quotas(t(s, d, "orders").groupBy(F.col("o_orderpriority").alias("group"), "o_orderstatus").agg(F.count(F.lit(1)).cast("double").alias("weight")), 17, ("o_orderstatus",)),
        "pipeline_breadth": lambda s, d: t(s, d, "stock_daily").groupBy("trade_date").agg(F.count(F.lit(1)).alias("n")),
    }


def oracle_sql() -> dict[str, str]:
    x = f"WITH {_frame_sql()}"
    means = f"{x}, {_LABELS}, m AS (SELECT session, q, avg(r) AS mean_return, count(r) AS n FROM labels WHERE q IS NOT NULL AND r IS NOT NULL GROUP BY 1, 2), every_q AS (SELECT session, unnest(range(1, 6)) AS q FROM (SELECT DISTINCT session FROM x))"
    returns = f"{x}, pr AS (SELECT *, f - avg(f) OVER (PARTITION BY session) AS w FROM x WHERE f IS NOT NULL AND r IS NOT NULL), fr AS (SELECT session, sum(w * r) / nullif(sum(abs(w)), 0) AS factor_return, avg(r) AS universe_return FROM pr GROUP BY 1)"
    usable = "f IS NOT NULL AND coalesce(trim(industry), '') <> '' AND cap > 0"
    year = 252
    return {
        "source_projection": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT'",
        "source_top": "SELECT row_id, trade_date FROM stock_daily WHERE trade_date BETWEEN '20220301' AND '20220331' ORDER BY trade_date, row_id LIMIT 50",
        "source_empty_filter": "SELECT o_orderkey FROM orders WHERE false",
        "source_sql": "SELECT n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1",
        "sink_lake": "SELECT nullif(trim(trade_date), '') AS trade_date, nullif(trim(ts_code), '') AS ts_code, open, high, low, close, pre_close, volume, turnover FROM stock_daily",
        "merge_upsert": f"WITH {_LOG} SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY ts_code, trade_date ORDER BY load_id > {SPLIT} DESC, load_id DESC, row_id DESC) = 1",
        "merge_dates": f"WITH {_LOG} SELECT * FROM log WHERE load_id > {SPLIT} OR trade_date NOT IN (SELECT trade_date FROM log WHERE load_id > {SPLIT})",
        "merge_ranges": f"WITH {_LOG}, span AS (SELECT ts_code, min(trade_date) AS a, max(trade_date) AS b FROM log WHERE load_id > {SPLIT} GROUP BY 1) SELECT log.* FROM log LEFT JOIN span USING (ts_code) WHERE load_id > {SPLIT} OR a IS NULL OR trade_date NOT BETWEEN a AND b",
        "merge_reports": f"WITH {reports_sql()}, v AS (SELECT r.*, nullif(trim(update_flag), '') AS flag, i.load_id FROM reports r JOIN (SELECT row_id, update_flag, load_id FROM income) i USING (row_id) WHERE load_id IS NOT NULL) "
        f"SELECT ts_code, end_date, report_type, known AS effective_ann_date, source_order FROM v QUALIFY row_number() OVER (PARTITION BY ts_code, end_date, report_type ORDER BY load_id > {SPLIT} DESC, known DESC NULLS LAST, flag DESC NULLS LAST, source_order DESC NULLS LAST, revenue DESC NULLS LAST, n_income DESC NULLS LAST) = 1",
        "merge_snapshots": "SELECT index_code, snapshot_date, con_code, weight, delivery FROM index_weight i WHERE delivery > 1 OR (delivery <= 1 AND NOT EXISTS (SELECT 1 FROM index_weight n WHERE n.delivery > 1 AND n.index_code IS NOT DISTINCT FROM i.index_code AND n.snapshot_date IS NOT DISTINCT FROM i.snapshot_date))",
        "merge_calendar": "SELECT exchange, cal_date, CASE WHEN cal_date > '20230301' THEN 1 ELSE is_open END AS is_open, pretrade_date FROM trade_cal WHERE cal_date <= '20230901'",
        "merge_pruned": "SELECT row_id, ts_code, asset_type FROM daily WHERE asset_type IN ('stock', 'index')",
        **{name: f"WITH d AS (SELECT cal_date, max(is_open) = 1 AS is_session FROM trade_cal WHERE exchange = '{ex}' GROUP BY 1), o AS (SELECT cal_date, row_number() OVER (ORDER BY cal_date) AS n FROM d WHERE is_session), "
           f"a AS (SELECT d.*, (SELECT count(*) FROM o WHERE o.cal_date {'<=' if by > 0 else '<'} d.cal_date) AS n FROM d) SELECT a.cal_date, is_session, o.cal_date AS shifted FROM a LEFT JOIN o ON o.n = a.n + {by if by > 0 else by + 1}"
           for name, ex, by in (("calendar_offsets", "SSE", 5), ("calendar_backwards", "SZSE", -3))},
        "asset_life": f"WITH {_LATEST}, s AS (SELECT ts_code, min(d) AS a, max(d) AS b FROM bars GROUP BY 1), x AS (SELECT ts_code, a, b, CAST(try_strptime(list_date, '%Y%m%d') AS DATE) AS l, CAST(try_strptime(delist_date, '%Y%m%d') AS DATE) AS x FROM stock_basic LEFT JOIN s USING (ts_code)) "
        "SELECT ts_code, strftime(a, '%Y%m%d') AS first_seen, strftime(b, '%Y%m%d') AS last_seen, CASE WHEN a IS NOT NULL THEN strftime(greatest(DATE '2022-02-01', l, a), '%Y%m%d') END AS life_start, CASE WHEN a IS NOT NULL THEN strftime(least(DATE '2022-12-31', x), '%Y%m%d') END AS life_end FROM x",
        "interval_units": f"SELECT row_id, (SELECT unit_text FROM feed_units f WHERE f.field_name = 'vol' AND f.feed = d.feed AND f.asset_type = d.asset_type AND coalesce(({day_sql('d.trade_date')}) >= coalesce(f.valid_from, ''), f.valid_from IS NULL) AND coalesce(({day_sql('d.trade_date')}) < f.valid_until, f.valid_until IS NULL) ORDER BY f.valid_from DESC NULLS LAST LIMIT 1) AS unit_text FROM daily d",
        "statements_joined": f"WITH {reports_sql()}, " + ", ".join(f"s{k} AS (SELECT ts_code, end_date, {f} FROM reports WHERE report_type = '{k}' QUALIFY row_number() OVER (PARTITION BY ts_code, end_date ORDER BY source_order DESC NULLS LAST, row_id DESC) = 1)" for k, f in (("1", "revenue"), ("2", "n_income"), ("3", "basic_eps")))
        + " SELECT ts_code, end_date, revenue, n_income, basic_eps FROM s1 FULL JOIN s2 USING (ts_code, end_date) FULL JOIN s3 USING (ts_code, end_date)",
        "calendar_sessions": "SELECT cal_date AS session, row_number() OVER (ORDER BY cal_date) - 1 AS session_idx, lag(cal_date) OVER (ORDER BY cal_date) AS previous, lead(cal_date) OVER (ORDER BY cal_date) AS next FROM (SELECT DISTINCT cal_date FROM trade_cal WHERE exchange = 'SSE' AND is_open = 1)",
        "calendar_problems": "SELECT exchange, cal_date, 'broken chain' AS problem FROM (SELECT *, max(CASE WHEN is_open = 1 THEN cal_date END) OVER (PARTITION BY exchange ORDER BY cal_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM trade_cal) WHERE is_open = 1 AND p <> pretrade_date",
        "calendar_window": "SELECT session, session_idx FROM (SELECT cal_date AS session, row_number() OVER (ORDER BY cal_date) - 1 AS session_idx FROM (SELECT DISTINCT cal_date FROM trade_cal WHERE exchange = 'SZSE' AND is_open = 1)) WHERE session <= '20220701' ORDER BY session DESC LIMIT 20",
        "prices_hfq": _adjusted_sql("hfq"), "prices_qfq": _adjusted_sql("qfq"),
        "asof_close": f"WITH {_LATEST}, p AS (SELECT * FROM (SELECT position_id, {code_sql('ts_code')} AS ts_code, CAST(try_strptime({day_sql('trade_date')}, '%Y%m%d') AS DATE) AS day FROM positions WHERE upper(trim(record_type)) = 'POSITION') WHERE ts_code IS NOT NULL AND day IS NOT NULL) "
        "SELECT position_id, p.ts_code, close, strftime(b.d, '%Y%m%d') AS known_day FROM p ASOF LEFT JOIN (SELECT * FROM bars WHERE close IS NOT NULL) b ON b.ts_code = p.ts_code AND b.d < p.day",
        "statements_known": f"WITH {reports_sql()}, v AS (SELECT * FROM reports WHERE report_type = '1' AND known < '20221001' AND end_date <= '20221001' QUALIFY row_number() OVER (PARTITION BY ts_code, end_date ORDER BY known DESC, updated DESC, source_order DESC) = 1) "
        "SELECT ts_code, end_date, known AS effective_ann_date, revenue, n_income FROM v QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY end_date DESC) <= 2",
        "constituents_known": _SNAPSHOTS + "SELECT index_code, snapshot_date, con_code FROM w JOIN (SELECT index_code, max(snapshot_date) AS snapshot_date FROM w WHERE snapshot_date < '20220915' GROUP BY 1) USING (index_code, snapshot_date)",
        "snapshot_intervals": _SNAPSHOTS + "SELECT index_code, snapshot_date, lead(snapshot_date) OVER (PARTITION BY index_code ORDER BY snapshot_date) AS valid_until FROM (SELECT DISTINCT index_code, snapshot_date FROM w)",
        "universe_mask": f"WITH {_LATEST} SELECT b.ts_code, strftime(d, '%Y%m%d') AS session, coalesce(CAST(try_strptime(list_date, '%Y%m%d') AS DATE) <= d AND (delist_date IS NULL OR d <= CAST(try_strptime(delist_date, '%Y%m%d') AS DATE)) AND date_diff('day', CAST(try_strptime(list_date, '%Y%m%d') AS DATE), d) >= 90, false) AND coalesce(volume, 0) > 0 AS in_universe FROM bars b JOIN stock_basic USING (ts_code)",
        "benchmark_returns": f"WITH {PANEL_SQL}, c AS (SELECT session, max(high) AS close FROM panel GROUP BY 1) SELECT session, round(coalesce(close / lag(close) OVER (ORDER BY session) - 1, 0), 6) AS benchmark_return FROM c",
        "analysis_information": f"{x}, {_RANKS} SELECT session, count(*) FILTER (f IS NOT NULL AND r IS NOT NULL) AS n, round({_corr('f', 'r', 3)}, 6) AS ic, round({_corr('rf', 'rr', 3)}, 6) AS rank_ic FROM ranks GROUP BY 1",
        "analysis_neutral": f"{x}, u AS (SELECT *, f - avg(f) OVER g AS yd, ln(cap) - avg(ln(cap)) OVER g AS sd, count(*) OVER (PARTITION BY session) AS k FROM x WHERE {usable} WINDOW g AS (PARTITION BY session, industry)), "
        "v AS (SELECT *, sum(sd * sd) OVER (PARTITION BY session) AS ss, sum(sd * yd) OVER (PARTITION BY session) AS sy FROM u) SELECT x.asset, x.session, round(CASE WHEN k >= 2 THEN CASE WHEN ss > 1e-12 THEN yd - sy / ss * sd ELSE yd END END, 6) AS f FROM x LEFT JOIN v USING (asset, session)",
        "analysis_quantiles": f"{means} SELECT e.session, CAST(e.q AS INT) AS q, round(mean_return, 6) AS mean_return, coalesce(n, 0) AS n FROM every_q e LEFT JOIN m ON m.session = e.session AND m.q = e.q",
        "analysis_long_short": f"{means} SELECT e.session, round(max(mean_return) FILTER (e.q = 5) - max(mean_return) FILTER (e.q = 1), 6) AS spread FROM every_q e LEFT JOIN m ON m.session = e.session AND m.q = e.q GROUP BY 1",
        "analysis_turnover": f"{x}, {_LABELS}, l AS (SELECT *, lag(q) OVER (PARTITION BY asset ORDER BY session_idx) AS p FROM labels) SELECT session, q, CASE WHEN any_value(session_idx) > 0 THEN round(1 - count(*) FILTER (p = q) / count(*), 6) END AS turnover FROM l WHERE q IS NOT NULL GROUP BY 1, 2",
        "analysis_autocorrelation": f"{x}, {_RANKS}, l AS (SELECT *, lag(rf) OVER (PARTITION BY asset ORDER BY session_idx) AS p FROM ranks) SELECT session, round({_corr('rf', 'p', 2)}, 6) AS rank_autocorrelation FROM l GROUP BY 1",
        "analysis_factor_returns": f"{returns} SELECT session, round(factor_return, 6) AS factor_return, round(universe_return, 6) AS universe_return FROM fr",
        "analysis_sector_information": f"{x}, d AS (SELECT industry, session, {_corr('f', 'r', 3)} AS ic FROM x GROUP BY 1, 2) SELECT industry, round(avg(ic), 6) AS ic, count(ic) AS sessions FROM d GROUP BY 1",
        "analysis_sector_quantiles": f"{x}, {_LABELS}, d AS (SELECT industry, q, session, avg(r) AS m FROM labels WHERE q IS NOT NULL AND r IS NOT NULL GROUP BY 1, 2, 3) SELECT industry, q, round(avg(m), 6) AS mean_return FROM d GROUP BY 1, 2",
        "analysis_alpha_beta": f"{returns}, a AS (SELECT count(*) AS n, regr_intercept(factor_return, universe_return) AS a, regr_slope(factor_return, universe_return) AS b, regr_sxx(factor_return, universe_return) AS sxx, regr_syy(factor_return, universe_return) AS syy, regr_sxy(factor_return, universe_return) AS sxy, avg(universe_return) AS mx FROM fr) "
        f"SELECT n, round(pow(1 + a, {year}) - 1, 6) AS alpha, round(b, 6) AS beta, round(a / (sqrt(greatest(syy - b * sxy, 0) / (n - 2)) * sqrt(1.0 / n + mx * mx / sxx)), 6) AS t_alpha FROM a",
        "performance_drawdown": f"{_DAYS} SELECT asset, day, printf('%.6e', CAST(drawdown AS DOUBLE)) AS drawdown FROM dd",
        "performance_monthly": f"{_DAYS} SELECT asset, year(day) AS year, month(day) AS month, printf('%.6e', CAST(product(1 + returns) - 1 AS DOUBLE)) AS return FROM d GROUP BY 1, 2, 3",
        "performance_yearly": f"{_DAYS} SELECT asset, year(day) AS year, printf('%.6e', CAST(product(1 + returns) - 1 AS DOUBLE)) AS return FROM d GROUP BY 1, 2",
        "performance_rolling": f"{_DAYS} SELECT asset, day, printf('%.6e', CAST(CASE WHEN count(*) OVER w = 12 THEN stddev_samp(returns) OVER w * sqrt({year}) END AS DOUBLE)) AS volatility, printf('%.6e', CAST(CASE WHEN count(*) OVER w = 12 THEN avg(returns) OVER w * sqrt({year}) / nullif(stddev_samp(returns) OVER w, 0) END AS DOUBLE)) AS sharpe FROM d WINDOW w AS (PARTITION BY asset ORDER BY day ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)",
        "performance_cumulative": f"{_DAYS} SELECT asset, day, printf('%.6e', CAST(exp(sum(ln(1 + returns)) OVER (PARTITION BY asset ORDER BY day)) - 1 AS DOUBLE)) AS cumulative FROM d",
        "performance_moving": f"{_DAYS} SELECT asset, day, printf('%.6e', CAST(CASE WHEN count(*) OVER w >= 5 THEN avg(returns) OVER w END AS DOUBLE)) AS moving_mean FROM d WINDOW w AS (PARTITION BY asset ORDER BY day ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)",
        "performance_histogram": "WITH s AS (SELECT min(o_totalprice) AS a, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders) SELECT CAST(least(floor((o_totalprice - a) / w), 19) + 1 AS INT) AS bin, count(*) AS n FROM orders, s GROUP BY 1",
        "performance_attribution": "WITH one AS (SELECT * FROM positions QUALIFY row_number() OVER (PARTITION BY trade_date, ts_code, index_code ORDER BY position_id DESC) = 1) SELECT ts_code, count(DISTINCT trade_date) AS days_held, round(sum(weight * asset_return), 6) AS contribution, round(avg(weight), 6) AS mean_weight, arg_max_null(market_value, row(coalesce(trade_date, ''), coalesce(index_code, ''))) AS last_value FROM one GROUP BY 1",
        "performance_metrics": f"{_DAYS}, s AS (SELECT asset, count(returns) AS n, product(1 + returns) - 1 AS total_return, avg(returns) AS m, stddev_samp(returns) AS s, avg(pow(least(returns, 0), 2)) AS down, abs(min(drawdown)) AS mdd, avg(benchmark_return) AS mb, covar_samp(returns, benchmark_return) AS cov, var_samp(benchmark_return) AS vb, avg(returns - benchmark_return) AS mx, stddev_samp(returns - benchmark_return) AS sx, product(1 + benchmark_return) - 1 AS bt FROM dd GROUP BY 1), "
        f"c AS (SELECT *, CASE WHEN total_return <= -1 THEN -1 ELSE pow(1 + total_return, {year}.0 / greatest(1, n - 1)) - 1 END AS cagr FROM s) SELECT asset, n, printf('%.6e', CAST(total_return AS DOUBLE)) AS total_return, printf('%.6e', CAST(cagr AS DOUBLE)) AS cagr, printf('%.6e', CAST(coalesce(s, 0) * sqrt({year}) AS DOUBLE)) AS volatility, printf('%.6e', CAST(m * sqrt({year}) / nullif(s, 0) AS DOUBLE)) AS sharpe, printf('%.6e', CAST(m * sqrt({year}) / nullif(sqrt(down), 0) AS DOUBLE)) AS sortino, printf('%.6e', CAST(mdd AS DOUBLE)) AS max_drawdown, printf('%.6e', CAST(cagr / nullif(mdd, 0) AS DOUBLE)) AS calmar, printf('%.6e', CAST(cov / nullif(vb, 0) AS DOUBLE)) AS beta, printf('%.6e', CAST((m - cov / nullif(vb, 0) * mb) * {year} AS DOUBLE)) AS alpha, printf('%.6e', CAST(sx * sqrt({year}) AS DOUBLE)) AS tracking_error, printf('%.6e', CAST(mx * {year} / nullif(sx * sqrt({year}), 0) AS DOUBLE)) AS information_ratio, printf('%.6e', CAST(bt AS DOUBLE)) AS benchmark_total_return, printf('%.6e', CAST(total_return - bt AS DOUBLE)) AS total_excess_return FROM c",
        "quality_rules": _quality_sql(),
        "quality_partial_nulls": " UNION ALL ".join(f"SELECT 'stock_daily' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS nulls FROM stock_daily HAVING count({c}) < count(*) AND count({c}) > 0" for c in ("row_id", "trade_date", "ts_code", "open", "high", "low", "close", "pre_close", "volume", "turnover", "load_id", "loaded_at")),
        "quality_weight_sums": "SELECT index_code, snapshot_date, round(sum(weight), 4) AS total FROM index_weight GROUP BY 1, 2 HAVING sum(weight) < 95 OR sum(weight) > 105",
        "quality_orphans": "SELECT ts_code AS value, count(*) AS rows FROM positions WHERE ts_code IS NOT NULL AND ts_code NOT IN (SELECT ts_code FROM stock_basic WHERE ts_code IS NOT NULL) GROUP BY 1",
        "quality_coverage": "SELECT DISTINCT ts_code, trade_date FROM daily d WHERE asset_type = 'stock' AND NOT EXISTS (SELECT 1 FROM stock_daily s WHERE s.ts_code = d.ts_code AND s.trade_date = d.trade_date)",
        "stream_windows": _WINDOWS, "event_windows": _WINDOWS,
        "event_sessions": "WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
        "k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM k GROUP BY user_id, no",
        "pipeline_top_by_sector": f"{x} SELECT session, industry, asset, CAST(row_number() OVER (PARTITION BY session, industry ORDER BY f DESC, cap DESC NULLS LAST, asset) AS INT) AS place FROM x WHERE f IS NOT NULL QUALIFY place <= 3",
        "pipeline_tilt": f"{x}, {_RANKS} SELECT session, asset, round(rf / sum(rf) OVER (PARTITION BY session, industry) / k, 6) AS weight FROM (SELECT *, count(DISTINCT industry) OVER (PARTITION BY session) AS k FROM ranks WHERE f IS NOT NULL)",
        "research_masked": f"WITH {', '.join([PANEL_SQL, *steps_of({'value': 'RANK($close)', 'c': '$close', 'o': '$open'}, 'panel')[0]])} SELECT asset, session, CASE WHEN c > o THEN value END AS value FROM ({steps_of({'value': 'RANK($close)', 'c': '$close', 'o': '$open'}, 'panel')[1]})",
        "research_missing": "SELECT DISTINCT cal_date AS session FROM trade_cal WHERE exchange = 'SSE' AND is_open = 1 AND cal_date BETWEEN '20220101' AND '20221231' AND cal_date NOT IN (SELECT snapshot_date FROM index_weight WHERE snapshot_date IS NOT NULL)",
        "pipeline_quotas": "WITH w AS (SELECT o_orderstatus, o_orderpriority AS g, count(*) AS n FROM orders GROUP BY 1, 2), x AS (SELECT *, CAST(n AS DOUBLE) * 17 / sum(n) OVER (PARTITION BY o_orderstatus) AS x FROM w), "
        'f AS (SELECT *, floor(x) AS f, 17 - sum(floor(x)) OVER (PARTITION BY o_orderstatus) AS l, row_number() OVER (PARTITION BY o_orderstatus ORDER BY x - floor(x) DESC, g) AS p FROM x) SELECT o_orderstatus, g AS "group", CAST(f + (p <= l)::INT AS INT) AS places FROM f',
        "pipeline_breadth": "SELECT trade_date, count(*) AS n FROM stock_daily GROUP BY 1",
    }
