"""Queries that write a lake and read it back by registry, role and SQL, and further point-in-time and report queries, with SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgate.functions.normalize import as_number, day_code, market_code, real_day, trimmed
from marlgate.operators import analysis, performance, portal, research
from marlgate.operators.snapshots import index_snapshots
from marlgate.operators.trailing import latest_bars
from marlgate.plans.compiler import evaluate
from marlgate.plans.data_queries import _LATEST, _SNAPSHOTS, code_sql, day_sql, reports_sql
from marlgate.plans.factor_queries import PANEL_SQL, monthly_panel
from marlgate.plans.factor_sql import ALONG, ratio
from marlgate.plans.market_queries import _DAYS, _RANKS, _corr, _frame_sql, asset_days, factor_frame, reports, shown, tilted_weights
from marlgate.session import passing, shared_dir
from marlgate.sources.bundle import build_bundle
from marlgate.sources.query import LocalData, inventory
from marlgate.sources.registry import TABLES
from marlgate.sources.testbed import table
from marlgate.sources.writer import stable_ids, write_table

Query = Callable[[SparkSession, str], DataFrame]


def lake(spark: SparkSession, tables: dict[str, DataFrame]) -> LocalData:
    folder = f"{shared_dir(spark).rstrip('/')}/lake-{uuid.uuid4().hex}"
    passing(spark, folder)
    for name, frame in tables.items():
        write_table(frame, TABLES[name], folder)
    return LocalData(spark, folder)


def lake_inventory(spark: SparkSession, folder: str) -> DataFrame:
    data = lake(spark, {"stock_daily": table(spark, folder, "stock_daily")})
    return inventory({"stock_daily": (data.read("stock_daily"), TABLES["stock_daily"])})[0]


def lake_role(spark: SparkSession, folder: str) -> DataFrame:
    """Stock and fund bars from two tables of the lake, as one."""
    daily = table(spark, folder, "daily")
    data = lake(spark, {name: daily.where(F.col("asset_type") == kind) for name, kind in (("stock_daily", "stock"), ("etf_daily", "etf"))})
    return data.role("daily").select("ts_code", "trade_date", "open", "close")


def lake_sql(spark: SparkSession, folder: str) -> DataFrame:
    data = lake(spark, {"stock_daily": table(spark, folder, "stock_daily"), "income": table(spark, folder, "income")})
    data.register(["stock_daily", "income"])
    return data.sql(
        "SELECT b.ts_code, count(*) AS bars, any_value(n) AS reports FROM stock_daily b JOIN (SELECT ts_code, count(*) AS n FROM income GROUP BY ts_code) i ON i.ts_code = b.ts_code WHERE close > ? GROUP BY b.ts_code", [20.0]
    )


def lake_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Two generations: the second inherits the first one's master table and brings bars."""
    where = f"{shared_dir(spark).rstrip('/')}/bundle-{uuid.uuid4().hex}"
    passing(spark, where)
    build_bundle(spark, where, {"stock_basic": table(spark, folder, "stock_basic")})
    return build_bundle(spark, where, {"stock_daily": table(spark, folder, "stock_daily")}).catalog()


def flags(spark: SparkSession, folder: str) -> DataFrame:
    """Bars with a flag where nothing was traded (as a list of suspensions), and one where the day's list names the asset."""
    rows = closes(spark, folder)
    bars = latest_bars(table(spark, folder, "stock_daily")).select("ts_code", F.date_format("day", "yyyyMMdd").alias("trade_date"), "volume")
    halts = bars.where("coalesce(volume, 0) <= 0").select("ts_code", "trade_date", F.when(F.col("volume") == 0, "s").otherwise("R").alias("suspend_type"))
    special = rows.where("close < 10").select("ts_code", F.col("day").alias("trade_date"))
    return portal.flagged(bars.select("ts_code", "trade_date"), halts, special)


def closes(spark: SparkSession, folder: str) -> DataFrame:
    return latest_bars(table(spark, folder, "stock_daily")).select("ts_code", F.date_format("day", "yyyyMMdd").alias("day"), "close")


def index_closes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "daily").where("asset_type = 'index'").select(F.upper(trimmed("ts_code")).alias("asset"), day_code("trade_date").alias("session"), F.struct("received_at", "row_id", as_number("close").alias("close")).alias("x"))
    return rows.where("asset is not null and session is not null").groupBy("asset", "session").agg(F.max("x").alias("x")).select("asset", "session", "x.close")


def rebalanced(spark: SparkSession, folder: str) -> DataFrame:
    weights = tilted_weights(spark, folder)
    days = [r[0] for r in weights.select("session").distinct().orderBy(F.col("session").desc()).limit(2).collect()]
    now, target = (weights.where(F.col("session") == F.lit(d)) for d in (days[1], days[0])) if len(days) == 2 else (weights.limit(0),) * 2
    return portal.rebalance(now, target).select("asset", *[F.round(c, 6).alias(c) for c in ("weight_now", "weight_target", "change")])


def position_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "positions").where(F.upper(trimmed("record_type")) == "POSITION").select(
        "position_id", day_code("trade_date").alias("trade_date"), market_code("ts_code").alias("ts_code"), "market_value", (F.col("weight") * F.col("asset_return")).alias("pnl")
    ).where("trade_date is not null and ts_code is not null")


def queries() -> dict[str, Query]:
    t = table
    return {
        "lake_inventory": lake_inventory, "lake_role": lake_role, "lake_sql": lake_sql, "lake_catalog": lake_catalog, "bars_flagged": flags,
        "research_months": lambda s, d: research.missing_months(index_snapshots(t(s, d, "index_weight"))[0], "202201", "202306"),
        "asof_carry_in": lambda s, d: portal.carried_in(closes(s, d), ["ts_code"], "day", "close", "20220901", "20220930"),
        "index_history": lambda s, d: portal.index_history(index_closes(s, d), portal.sessions(t(s, d, "trade_cal"), "SSE"), ["close"], "20220801", "20221031"),
        "statement_history": lambda s, d: portal.statement_history(reports(s, d), reports(s, d).agg(F.min("ts_code")).first()[0]).select("ts_code", "end_date", "effective_ann_date", "source_order", "revenue"),
        "research_combined": lambda s, d: research.combined({
            "momentum": evaluate(monthly_panel(s, d), {"value": "RETURNS($close, 3)"}).where("value > 0"), "reversal": evaluate(monthly_panel(s, d), {"value": "0 - RETURNS($close, 1)"}).where("value > 0"),
        }).select("asset", "session", shown("momentum"), shown("reversal")),
        "pipeline_rebalance": rebalanced,
        "positions_open": lambda s, d: performance.open_positions(position_rows(s, d)).select("last_day", "open_positions", F.round("value", 2).alias("value")),
        "positions_trades": lambda s, d: performance.closed_trade_ratios(position_rows(s, d).where("pnl is not null"), "ts_code").select("ts_code", shown("win_rate"), shown("profit_factor")),
        "performance_table": lambda s, d: performance.monthly_table(asset_days(s, d), "asset").select("asset", "year", *[shown(str(m)).alias(f"m{m}") for m in range(1, 13)]),
        "series_ic_histogram": lambda s, d: performance.histogram(analysis.information(factor_frame(s, d)), "ic", 45).select("bin", "n"),
        "asset_ids": lambda s, d: stable_ids(t(s, d, "stock_basic").where("ts_code < '300000.SZ'").select("ts_code", F.expr("cast(left(ts_code, 6) as bigint) % 1000").alias("sid")), t(s, d, "stock_basic")),
    }


def oracle_sql() -> dict[str, str]:
    x = f"WITH {_frame_sql()}"
    tilted = f"{x}, {_RANKS}, w AS (SELECT session, asset, round(rf / sum(rf) OVER (PARTITION BY session, industry) / k, 6) AS weight FROM (SELECT *, count(DISTINCT industry) OVER (PARTITION BY session) AS k FROM ranks WHERE f IS NOT NULL))"
    clean = lambda c: f"nullif(trim({c}), '')"
    place = f"(SELECT position_id, {day_sql('trade_date')} AS trade_date, {code_sql('ts_code')} AS ts_code, market_value, weight * asset_return AS pnl FROM positions WHERE upper(trim(record_type)) = 'POSITION')"
    text = lambda e, n: f"printf('%.6e', CAST({e} AS DOUBLE)) AS {n}"
    return {
        "lake_inventory": f"SELECT try_cast(left({clean('trade_date')}, 4) AS INT) AS year, count(*) AS rows, min({clean('trade_date')}) AS first_date, max({clean('trade_date')}) AS last_date, 'stock_daily' AS table_name FROM stock_daily GROUP BY 1",
        "lake_role": f"SELECT {clean('ts_code')} AS ts_code, {clean('trade_date')} AS trade_date, open, close FROM daily WHERE asset_type IN ('stock', 'etf')",
        "lake_sql": f"SELECT b.ts_code, count(*) AS bars, any_value(n) AS reports FROM (SELECT {clean('ts_code')} AS ts_code, close FROM stock_daily) b JOIN (SELECT {clean('ts_code')} AS ts_code, count(*) AS n FROM income GROUP BY 1) i ON i.ts_code = b.ts_code WHERE close > 20 GROUP BY 1",
        "lake_catalog": f"WITH m AS (SELECT {clean('ts_code')} AS ts_code, min({clean('list_date')}) AS list_date, max({clean('delist_date')}) AS delist_date FROM stock_basic WHERE {clean('ts_code')} IS NOT NULL GROUP BY 1), "
        f"s AS (SELECT {clean('ts_code')} AS ts_code, min({clean('trade_date')}) AS first_seen, max({clean('trade_date')}) AS last_seen FROM stock_daily GROUP BY 1) "
        "SELECT ts_code, row_number() OVER (ORDER BY ts_code) - 1 AS sid, 'stock' AS kind, list_date, delist_date, first_seen, last_seen FROM m LEFT JOIN s USING (ts_code)",
        "bars_flagged": f"WITH {_LATEST} SELECT ts_code, strftime(d, '%Y%m%d') AS trade_date, CAST(coalesce(volume = 0, false) AS INT) AS suspended, CAST(coalesce(close < 10, false) AS INT) AS is_st FROM bars",
        "research_months": _SNAPSHOTS + "SELECT index_code AS series, strftime(m, '%Y%m') AS month FROM (SELECT DISTINCT index_code FROM w) CROSS JOIN (SELECT unnest(generate_series(DATE '2022-01-01', DATE '2023-06-01', INTERVAL 1 MONTH)) AS m) WHERE (index_code, strftime(m, '%Y%m')) NOT IN (SELECT index_code, left(snapshot_date, 6) FROM w)",
        "asof_carry_in": f"WITH {_LATEST}, c AS (SELECT ts_code, strftime(d, '%Y%m%d') AS day, close FROM bars WHERE close > 0) SELECT ts_code, max(day) AS day, arg_max(close, day) AS close FROM c WHERE day < '20220901' GROUP BY 1 UNION ALL SELECT * FROM c WHERE day BETWEEN '20220901' AND '20220930'",
        "index_history": f"WITH b AS (SELECT upper(trim(ts_code)) AS asset, {day_sql('trade_date')} AS session, close, received_at, row_id FROM daily WHERE asset_type = 'index' AND ts_code IS NOT NULL), l AS (SELECT * FROM b WHERE session IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asset, session ORDER BY received_at DESC NULLS LAST, row_id DESC) = 1), "
        "c AS (SELECT DISTINCT cal_date AS session FROM trade_cal WHERE exchange = 'SSE' AND is_open = 1 AND cal_date BETWEEN '20220801' AND '20221031') SELECT a.asset, c.session, l.close FROM (SELECT DISTINCT asset FROM l) a CROSS JOIN c LEFT JOIN l ON l.asset = a.asset AND l.session = c.session",
        "statement_history": f"WITH {reports_sql()} SELECT ts_code, end_date, known AS effective_ann_date, source_order, revenue FROM reports WHERE report_type = '1' AND ts_code = (SELECT min(ts_code) FROM reports)",
        "research_combined": f"WITH {PANEL_SQL}, a AS (SELECT asset, session, {ratio('close', f'lag(close, 3) OVER ({ALONG})')} - 1 AS m, 1 - {ratio('close', f'lag(close) OVER ({ALONG})')} AS r FROM panel) SELECT asset, session, {text('CASE WHEN m > 0 THEN m END', 'momentum')}, {text('CASE WHEN r > 0 THEN r END', 'reversal')} FROM a WHERE m > 0 OR r > 0",
        "pipeline_rebalance": f"{tilted}, d AS (SELECT DISTINCT session FROM w ORDER BY 1 DESC LIMIT 2), a AS (SELECT * FROM w WHERE session = (SELECT min(session) FROM d)), b AS (SELECT * FROM w WHERE session = (SELECT max(session) FROM d)), "
        "m AS (SELECT coalesce(a.asset, b.asset) AS asset, coalesce(a.weight, 0) AS weight_now, coalesce(b.weight, 0) AS weight_target FROM a FULL JOIN b ON a.asset = b.asset) SELECT asset, weight_now, weight_target, round(weight_target - weight_now, 6) AS change FROM m WHERE abs(weight_target - weight_now) > 2e-4",
        "positions_open": f"WITH p AS (SELECT * FROM {place} WHERE trade_date IS NOT NULL AND ts_code IS NOT NULL) SELECT (SELECT max(trade_date) FROM p) AS last_day, count(DISTINCT ts_code) AS open_positions, round(sum(market_value), 2) AS value FROM p WHERE market_value > 0 AND trade_date = (SELECT max(trade_date) FROM p)",
        "positions_trades": f"SELECT ts_code, {text('avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END)', 'win_rate')}, {text('coalesce(sum(pnl) FILTER (pnl > 0), 0) / nullif(abs(sum(pnl) FILTER (pnl < 0)), 0)', 'profit_factor')} FROM {place} WHERE trade_date IS NOT NULL AND ts_code IS NOT NULL AND pnl IS NOT NULL GROUP BY 1",
        "performance_table": f"{_DAYS} SELECT asset, year(day) AS year, " + ", ".join(text(f"CASE WHEN count(returns) FILTER (month(day) = {m}) > 0 THEN product(1 + returns) FILTER (month(day) = {m}) - 1 END", f"m{m}") for m in range(1, 13)) + " FROM d GROUP BY 1, 2",
        "series_ic_histogram": f"{x}, i AS (SELECT session, {_corr('f', 'r', 3)} AS ic FROM x GROUP BY 1), s AS (SELECT min(ic) AS a, (max(ic) - min(ic)) / 45 AS w FROM i) SELECT CAST(least(floor((ic - a) / w), 44) + 1 AS INT) AS bin, count(*) AS n FROM i, s WHERE ic IS NOT NULL GROUP BY 1",
        "asset_ids": "WITH o AS (SELECT ts_code, CAST(left(ts_code, 6) AS BIGINT) % 1000 AS sid FROM stock_basic WHERE ts_code < '300000.SZ'), n AS (SELECT DISTINCT ts_code FROM stock_basic WHERE ts_code NOT IN (SELECT ts_code FROM o)) SELECT * FROM o UNION ALL SELECT ts_code, (SELECT coalesce(max(sid), -1) FROM o) + row_number() OVER (ORDER BY ts_code) FROM n",
    }
