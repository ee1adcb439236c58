"""Queries for histories, universes and whole analyses, with hand-written SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgate.functions.normalize import real_day
from marlgate.operators import analysis, performance, portal, research
from marlgate.operators.snapshots import index_snapshots
from marlgate.plans.data_queries import _SNAPSHOTS
from marlgate.plans.factor_queries import DAILY_SQL, PANEL_SQL, daily_panel, monthly_panel
from marlgate.plans.factor_sql import ALONG, mean, ratio
from marlgate.plans.market_queries import _LABELS, _RANKS, _corr, _frame_sql, factor_frame, shown
from marlgate.sources.testbed import table

Query = Callable[[SparkSession, str], DataFrame]
START, END = dt.date(2022, 9, 1), dt.date(2022, 12, 30)
DAY_START, DAY_END = (f"DATE '{d.isoformat()}'" for d in (START, END))


def split_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars with a split factor: assets whose code ends its digits in 0, 3, 6 or 9 double it every 100 sessions."""
    splits = F.substring("asset", 6, 1).cast("int") % 3 == 0
    factor = F.when(F.col("close").isNotNull(), F.when(splits, F.pow(F.lit(2.0), F.floor(F.col("session_idx") / 100))).otherwise(1.0))
    return daily_panel(spark, folder).withColumn("adj_factor", factor.cast("double"))


SPLIT_SQL = f"""{DAILY_SQL}, g AS (SELECT *, CASE WHEN close IS NOT NULL THEN CASE WHEN CAST(substr(asset, 6, 1) AS INT) % 3 = 0 THEN pow(2.0, floor(session_idx / 100)) ELSE 1.0 END END AS raw FROM panel WHERE session <= {DAY_END}),
h AS (SELECT *, coalesce(last_value(raw IGNORE NULLS) OVER ({ALONG} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) AS f FROM g),
q AS (SELECT asset, session, session_idx, volume, close * f / last_value(f) OVER ({ALONG} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS close FROM h)"""


def research_factor(spark: SparkSession, folder: str) -> DataFrame:
    basic = table(spark, folder, "stock_basic").select(F.col("ts_code").alias("asset"), *[real_day(c).alias(c) for c in ("list_date", "delist_date")])
    panel = split_panel(spark, folder).join(basic, "asset").withColumn("idle", F.coalesce(F.col("volume"), F.lit(0.0)) <= 0)
    members = research.member_union(index_snapshots(table(spark, folder, "index_weight"))[0], "20221230")
    data = research.FactorData(panel, START, END, members, "qfq", 60, ("idle",))
    return data.history({"value": "MA($close, 5) / $close"}).select("asset", "session", "in_universe", F.round("value", 6).alias("value"))


def rounded(make: Callable[[DataFrame], DataFrame], *keys: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = make(factor_frame(spark, folder))
        return out.select(*keys, *[shown(c) for c in out.columns if c not in keys])

    return run


def run_analysis(spark: SparkSession, folder: str) -> DataFrame:
    out = research.run_analysis(monthly_panel(spark, folder), "0 - RETURNS($close, 2)", (1, 3))
    return out.select("period", "sessions", "n", *[shown(c) for c in out.columns if c not in ("period", "sessions", "n")])


def queries() -> dict[str, Query]:
    return {
        "portal_history": lambda s, d: portal.history(split_panel(s, d), ["close"], END, 30, mode="qfq").select("asset", "session", F.round("close", 6).alias("close")),
        "portal_values": lambda s, d: portal.values_at(split_panel(s, d), ["close", "volume"], START, mode="qfq", reference=START).select("asset", F.round("close", 6).alias("close"), "volume"),
        "research_union": lambda s, d: research.member_union(index_snapshots(table(s, d, "index_weight"))[0], "20220801"),
        "research_factor": research_factor,
        "analysis_summary": rounded(lambda x: analysis.summary_table(analysis.information(x), analysis.quantile_turnover(x), analysis.rank_autocorrelation(x)), "sessions"),
        "analysis_returns": rounded(analysis.return_analysis, "n"),
        "analysis_run": run_analysis,
        "series_cumulative_ic": rounded(lambda x: analysis.cumulative_information(analysis.information(x)), "session"),
        "series_monthly_ic": rounded(lambda x: analysis.monthly_information(analysis.information(x)), "year", "month"),
        "series_quantile_distribution": rounded(analysis.quantile_distribution, "q", "sessions"),
        "series_quantile_cumulative": rounded(analysis.quantile_cumulative, "session", "q"),
        "series_factor_cumulative": rounded(lambda x: performance.cumulative(analysis.factor_returns(x).withColumnRenamed("session", "day"), "factor_return").select("day", "cumulative"), "day"),
    }


def text(**columns: str) -> str:
    return ", ".join(f"printf('%.6e', CAST({e} AS DOUBLE)) AS {n}" for n, e in columns.items())


def moments(n: str, skew: str, kurt: str) -> tuple[str, str]:
    return f"{skew} * sqrt({n} * ({n} - 1.0)) / ({n} - 2)", f"({n} - 1.0) / (({n} - 2.0) * ({n} - 3)) * (({n} + 1) * {kurt} + 6)"


def _analysis(frame: str, period: int) -> str:
    """Common table expressions from ``x`` (asset, session, session_idx, f, r) to one row of everything."""
    day = lambda e: f"CASE WHEN {e} > -1 THEN exp(ln(1 + {e}) / {period}) - 1 END"
    return f"""{frame}, {_RANKS}, {_LABELS},
info AS (SELECT session, {_corr('f', 'r', 3)} AS ic, {_corr('rf', 'rr', 3)} AS rank_ic FROM ranks GROUP BY 1),
m AS (SELECT count(ic) AS sessions, avg(ic) AS mu, stddev_samp(ic) AS sd, avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic <= 0 THEN 0.0 END) AS pos, avg(rank_ic) AS rmu, stddev_samp(rank_ic) AS rsd, count(rank_ic) AS rn,
  avg(CASE WHEN rank_ic > 0 THEN 1.0 WHEN rank_ic <= 0 THEN 0.0 END) AS rpos FROM info),
c AS (SELECT avg(pow(ic - mu, 2)) AS c2, avg(pow(ic - mu, 3)) AS c3, avg(pow(ic - mu, 4)) AS c4 FROM info, m),
lq AS (SELECT *, lag(q) OVER (PARTITION BY asset ORDER BY session_idx) AS p FROM labels),
turn AS (SELECT avg(t) AS turnover FROM (SELECT CASE WHEN any_value(session_idx) > 0 THEN 1 - count(*) FILTER (p = q) / count(*) END AS t FROM lq WHERE q IS NOT NULL GROUP BY session, q)),
lr AS (SELECT *, lag(rf) OVER (PARTITION BY asset ORDER BY session_idx) AS pf FROM ranks),
auto AS (SELECT avg(a) AS auto FROM (SELECT {_corr('rf', 'pf', 2)} AS a FROM lr GROUP BY session)),
qm AS (SELECT session, q, avg(r) AS mr FROM labels WHERE q IS NOT NULL AND r IS NOT NULL GROUP BY 1, 2),
ends AS (SELECT session, max({day('mr')}) FILTER (q = 5) AS t, max({day('mr')}) FILTER (q = 1) AS b FROM qm GROUP BY 1),
bps AS (SELECT avg(t) * 10000 AS top, avg(b) * 10000 AS bottom, avg(t - b) * 10000 AS spread FROM ends),
dr AS (SELECT session, f, {day('r')} AS r FROM x),
pr AS (SELECT *, f - avg(f) OVER (PARTITION BY session) AS w FROM dr WHERE f IS NOT NULL AND r IS NOT NULL),
fr AS (SELECT session, sum(w * r) / nullif(sum(abs(w)), 0) AS y, avg(r) AS u FROM pr GROUP BY 1),
ab AS (SELECT count(*) AS n, regr_intercept(y, u) AS a, regr_slope(y, u) AS b, regr_sxx(y, u) AS sxx, regr_syy(y, u) AS syy, regr_sxy(y, u) AS sxy, avg(u) AS mx FROM fr WHERE y IS NOT NULL AND u IS NOT NULL)"""


def _summary_columns() -> str:
    skew, kurt = moments("sessions", "(c3 / pow(c2, 1.5))", "(c4 / (c2 * c2) - 3)")
    return text(
        ic_mean="mu", ic_std="sd", icir=ratio("mu", "sd"), icir_annual=f"{ratio('mu', 'sd')} * sqrt(252)", ic_positive="pos", ic_t=f"{ratio('mu', 'sd')} * sqrt(sessions)", ic_skew=skew, ic_kurt=kurt,
        rank_ic_mean="rmu", rank_ic_std="rsd", rank_icir=ratio("rmu", "rsd"), rank_icir_annual=f"{ratio('rmu', 'rsd')} * sqrt(252)", rank_ic_positive="rpos", rank_ic_t=f"{ratio('rmu', 'rsd')} * sqrt(rn)",
        mean_turnover="turnover", mean_autocorrelation="auto",
    )


def _return_columns() -> str:
    return text(
        alpha="CASE WHEN n >= 3 THEN pow(1 + a, 252) - 1 END", beta="CASE WHEN n >= 3 THEN b END",
        t_alpha="CASE WHEN n >= 3 THEN a / (sqrt(greatest(syy - b * sxy, 0) / (n - 2)) * sqrt(1.0 / n + mx * mx / sxx)) END", top_bps="top", bottom_bps="bottom", spread_bps="spread",
    )


def oracle_sql() -> dict[str, str]:
    x = f"WITH {_frame_sql()}"
    info = f"{x}, {_RANKS}, info AS (SELECT session, {_corr('f', 'r', 3)} AS ic, {_corr('rf', 'rr', 3)} AS rank_ic FROM ranks GROUP BY 1)"
    means = f"{x}, {_LABELS}, m AS (SELECT session, q, avg(r) AS v FROM labels WHERE q IS NOT NULL AND r IS NOT NULL GROUP BY 1, 2), every_q AS (SELECT session, CAST(unnest(range(1, 6)) AS INT) AS q FROM (SELECT DISTINCT session FROM x)), e AS (SELECT every_q.session, every_q.q, v FROM every_q LEFT JOIN m ON m.session = every_q.session AND m.q = every_q.q)"
    returns = f"{x}, pr AS (SELECT *, f - avg(f) OVER (PARTITION BY session) AS w FROM x WHERE f IS NOT NULL AND r IS NOT NULL), fr AS (SELECT session, sum(w * r) / nullif(sum(abs(w)), 0) AS v FROM pr GROUP BY 1)"
    run = []
    for p in (1, 3):
        frame = f"WITH {PANEL_SQL}, x AS (SELECT asset, session, session_idx, -(close / nullif(lag(close, 2) OVER ({ALONG}), 0) - 1) AS f, lead(close, {p}) OVER ({ALONG}) / nullif(close, 0) - 1 AS r FROM panel)"
        run.append(f"SELECT * FROM ({_analysis(frame, p)} SELECT CAST({p} AS INT) AS period, sessions, n, {_summary_columns()}, {_return_columns()} FROM m, c, turn, auto, bps, ab)")
    listed = lambda c: f"CAST(try_strptime({c}, '%Y%m%d') AS DATE)"
    alive = f"coalesce({listed('list_date')} <= session AND (delist_date IS NULL OR session <= {listed('delist_date')}) AND date_diff('day', {listed('list_date')}, session) >= 60, false) AND coalesce(volume, 0) > 0"
    return {
        "portal_history": f"WITH {SPLIT_SQL} SELECT asset, session, round(close, 6) AS close FROM q WHERE session_idx > (SELECT max(session_idx) FROM q) - 30",
        "portal_values": f"WITH {SPLIT_SQL.replace(DAY_END, DAY_START)} SELECT asset, round(close, 6) AS close, volume FROM q WHERE session = {DAY_START}",
        "research_union": _SNAPSHOTS + "SELECT DISTINCT con_code AS asset FROM w WHERE snapshot_date < '20220801'",
        "research_factor": _SNAPSHOTS.rstrip() + f", {SPLIT_SQL}, v AS (SELECT *, {ratio(mean('close', 5), 'close')} AS value FROM q), "
        f"u AS (SELECT v.*, {alive} AS in_universe FROM v JOIN stock_basic ON ts_code = asset) SELECT asset, session, in_universe, CASE WHEN in_universe THEN round(value, 6) END AS value FROM u "
        f"WHERE session >= {DAY_START} AND asset IN (SELECT con_code FROM w WHERE snapshot_date < '20221230')",
        "analysis_summary": f"{_analysis(x, 1)} SELECT sessions, {_summary_columns()} FROM m, c, turn, auto",
        "analysis_returns": f"{_analysis(x, 1)} SELECT n, {_return_columns()} FROM bps, ab",
        "analysis_run": " UNION ALL ".join(run),
        "series_cumulative_ic": f"{info} SELECT session, {text(cumulative_ic='sum(coalesce(ic, 0)) OVER (ORDER BY session)', cumulative_rank_ic='sum(coalesce(rank_ic, 0)) OVER (ORDER BY session)')} FROM info",
        "series_monthly_ic": f"{info} SELECT year(session) AS year, month(session) AS month, {text(ic='avg(ic)', rank_ic='avg(rank_ic)')} FROM info GROUP BY 1, 2",
        "series_quantile_distribution": f"{means} SELECT q, count(v) AS sessions, {text(mean='avg(v)', std='stddev_samp(v)', lowest='min(v)', lower='quantile_cont(v, 0.25)', median='median(v)', upper='quantile_cont(v, 0.75)', highest='max(v)')} FROM e GROUP BY 1",
        "series_quantile_cumulative": f"{means} SELECT session, q, {text(cumulative='exp(sum(ln(1 + coalesce(CASE WHEN v > -1 THEN v END, 0))) OVER (PARTITION BY q ORDER BY session)) - 1')} FROM e",
        "series_factor_cumulative": f"{returns} SELECT session AS day, {text(cumulative='exp(sum(ln(1 + coalesce(v, 0))) OVER (ORDER BY session)) - 1')} FROM fr",
    }
