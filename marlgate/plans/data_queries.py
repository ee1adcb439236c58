"""Queries p1 to p3 and p5 to p7 over the test tables, each with SQL for an independent engine where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgate.operators import incremental, knowntime, profile, snapshots, trailing, units
from marlgate.sources.testbed import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(operator: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, folder: operator(*[table(spark, folder, n) for n in names])


def increments(stock_daily: DataFrame, income: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    bars, reports = incremental.all_new_or_changed([(stock_daily, incremental.stock_daily_set()), (income, incremental.income_set())], runs)
    return bars, reports


def found_increments(stock_daily: DataFrame, income: DataFrame, runs: DataFrame) -> DataFrame:
    bars, reports = increments(stock_daily, income, runs)
    return bars.select("dataset", "row_id").unionByName(reports.select("dataset", "row_id"))


def pending_records(stock_daily: DataFrame, income: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows the next run gets, with their key: dataset, row_id, load_id, ts_code, range_day."""
    bars, reports = increments(stock_daily, income, runs)
    return bars.select("dataset", "row_id", "load_id", "ts_code", F.col("trade_date").alias("range_day")).unionByName(
        reports.select("dataset", "row_id", "load_id", "ts_code", F.col("end_date").alias("range_day"))
    )


def queries() -> dict[str, Query]:
    return {
        "p1_found": _over(units.unit_cases, "daily", "stock_daily", "feed_units"),
        "p1_converted": _over(units.converted, "daily", "stock_daily", "feed_units"),
        "p1_stated": _over(units.stated_units, "feed_units"),
        "p2_found": lambda spark, folder: snapshots.constituent_changes(table(spark, folder, "index_weight")).select("index_code", "snapshot_date", "con_code", "change_kind"),
        "p2_weights": _over(snapshots.constituent_changes, "index_weight"),
        "p3_found": _over(found_increments, "stock_daily", "income", "update_runs"),
        "p3_pending": _over(pending_records, "stock_daily", "income", "update_runs"),
        "p5_found": _over(trailing.idle_days, "stock_daily"),
        "p5_trailing": _over(trailing.stock_trailing, "stock_daily"),
        "p6_found": _over(knowntime.known_at_trade, "positions", "income", "index_weight"),
        "p7_found": _over(profile.quality_findings, "stock_daily", "income"),
    }


# SQL ------------------------------------------------------------------------------------------------------------------
def code_sql(c: str) -> str:
    u = f"upper(trim({c}))"
    return (
        f"CASE WHEN regexp_matches({u}, '^[0-9]{{6}}[.](SZ|SH|BJ)$') THEN {u} "
        f"WHEN regexp_matches({u}, '^(SZ|SH|BJ)[.]?[0-9]{{6}}$') THEN right({u}, 6) || '.' || left({u}, 2) "
        f"WHEN regexp_matches({u}, '^[0-9]{{6}}(SZ|SH|BJ)$') THEN left({u}, 6) || '.' || right({u}, 2) END"
    )


def day_sql(c: str) -> str:
    t = f"trim({c})"
    return (
        f"CASE WHEN regexp_matches({t}, '^[0-9]{{8}}$') THEN strftime(try_strptime({t}, '%Y%m%d'), '%Y%m%d') "
        f"WHEN regexp_matches({t}, '^[0-9]{{4}}(-[0-9]{{2}}-|/[0-9]{{2}}/|[.][0-9]{{2}}[.])[0-9]{{2}}$') "
        f"THEN strftime(try_strptime(regexp_replace({t}, '[-/.]', '', 'g'), '%Y%m%d'), '%Y%m%d') END"
    )


def index_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches(upper(trim({c})), '^[0-9]{{6}}[.]CSI$') THEN upper(trim({c})) END"


EFFECTIVE = "CASE WHEN coalesce(trim(f_ann_date), '') IN ('', '0') THEN trim(ann_date) ELSE trim(f_ann_date) END"
TYPE_DIGITS = "CAST(CAST(try_cast(trim(report_type) AS DOUBLE) AS BIGINT) AS VARCHAR)"


def _aliases() -> str:
    return ", ".join(
        f"('{kind}', '{alias.replace(chr(39), chr(39) * 2)}', {power})"
        for kind, known in units.UNITS.items() for power, names in known.values() for alias in names
    )


def _figures() -> str:
    wide = "translate({}, '０１２３４５６７８９．，', '0123456789.,')"
    number = "[+-]?[0-9][0-9,]*([.][0-9]*)?(e[+-]?[0-9]+)?"

    def side(field: str, kind: str) -> str:
        text = f"trim(lower({wide.format(field)}))"
        return f"""
{field}_texts AS (SELECT DISTINCT {text} AS t FROM daily WHERE {field} IS NOT NULL),
{field}_units AS (SELECT DISTINCT trim(lower({field}_unit)) AS u FROM daily WHERE {field}_unit IS NOT NULL),
{field}_unit_pow AS (SELECT u, p AS unit_pow FROM {field}_units JOIN alias ON kind = '{kind}' AND a = u),
{field}_best AS (SELECT t, max_by(a, length(a)) AS a, max_by(p, length(a)) AS text_pow FROM {field}_texts JOIN alias ON kind = '{kind}' AND (starts_with(t, a || ' ') OR ends_with(t, a))
  AND NOT (regexp_matches(a, '^[0-9]') AND regexp_matches(left(t, length(t) - length(a)), '[0-9.,]$'))
  WHERE NOT regexp_full_match(t, '{number}') GROUP BY t),
{field}_read AS (SELECT x.t, text_pow, try_cast(replace(regexp_extract(CASE WHEN a IS NULL THEN x.t ELSE replace(x.t, a, ' ') END, '{number}'), ',', '') AS DOUBLE) AS number
  FROM {field}_texts x LEFT JOIN {field}_best b ON x.t = b.t)"""

    def says(field: str) -> str:
        return (
            f"(SELECT p FROM stated s WHERE s.feed = d.feed AND s.asset_type = d.asset_type AND s.field_name = '{field}' AND d.trade_date >= coalesce(s.valid_from, '00010101') "
            f"AND d.trade_date < coalesce(s.valid_until, '99991231') ORDER BY coalesce(s.valid_from, '00010101') DESC, coalesce(s.valid_until, '99991231') DESC, p DESC LIMIT 1)"
        )

    return f"""WITH alias(kind, a, p) AS (VALUES {_aliases()}),{side("vol", "volume")},{side("amount", "money")},
stated AS (SELECT f.*, p FROM feed_units f LEFT JOIN alias ON a = lower(trim(unit_text)) AND kind = CASE field_name WHEN 'vol' THEN 'volume' ELSE 'money' END),
fed AS (SELECT d.row_id, d.asset_type, vr.number AS v, ar.number AS m, coalesce(vr.text_pow, vu.unit_pow) AS v_own, coalesce(ar.text_pow, au.unit_pow) AS m_own,
  {says("vol")} AS v_says, {says("amount")} AS m_says,
  list_sort(list_filter([open, high, low, close], lambda x: x > 0)) AS prices
  FROM daily d
  LEFT JOIN vol_read vr ON vr.t = trim(lower({wide.format("vol")})) LEFT JOIN amount_read ar ON ar.t = trim(lower({wide.format("amount")}))
  LEFT JOIN vol_unit_pow vu ON vu.u = trim(lower(vol_unit)) LEFT JOIN amount_unit_pow au ON au.u = trim(lower(amount_unit))),
k AS (SELECT *, coalesce(v_own, v_says) AS v_pow, coalesce(m_own, m_says) AS m_pow,
  CASE WHEN asset_type <> 'index' AND v <> 0 AND m <> 0 AND len(prices) > 0
  THEN CAST(round(log10(abs(m)) - log10(abs(v)) - log10(prices[(len(prices) + 1) // 2])) AS INT) + coalesce(m_own, m_says) - coalesce(v_own, v_says) END AS off FROM fed),
solved AS (SELECT *, coalesce(off <> 0 AND v_own IS NULL AND v_pow + off IN (0, 2), false) AS v_off, coalesce(off <> 0 AND m_own IS NULL AND m_pow - off IN (0, 3, 4), false) AS m_off FROM k),
lots AS (SELECT *, CASE asset_type WHEN 'index' THEN 2 ELSE 0 END AS lot FROM solved),
bars AS (SELECT row_id, volume AS v, turnover AS m, CASE WHEN volume <> 0 AND turnover <> 0 AND len(prices) > 0
  THEN CAST(round(log10(abs(turnover)) - log10(abs(volume)) - log10(prices[(len(prices) + 1) // 2])) AS INT) END AS off
  FROM (SELECT *, list_sort(list_filter([open, high, low, close], lambda x: x > 0)) AS prices FROM stock_daily)),
figures AS (
  SELECT 'daily' AS src_table, row_id, 'vol' AS field_name, v AS number, CASE WHEN v_off THEN v_pow + off ELSE v_pow END - lot AS pow10, v_says - lot AS says FROM lots
  UNION ALL SELECT 'daily', row_id, 'amount', m, CASE WHEN m_off AND NOT v_off THEN m_pow - off ELSE m_pow END, m_says FROM lots
  UNION ALL SELECT 'stock_daily', row_id, 'volume', v, CASE off WHEN 2 THEN 2 WHEN 4 THEN 4 WHEN -1 THEN 2 ELSE 0 END, 0 FROM bars
  UNION ALL SELECT 'stock_daily', row_id, 'turnover', m, CASE off WHEN -3 THEN 3 WHEN -4 THEN 4 WHEN -8 THEN 8 WHEN -1 THEN 3 ELSE 0 END, 0 FROM bars)"""


_SNAPSHOTS = f"""WITH r AS (SELECT {index_sql("index_code")} AS index_code, {day_sql("snapshot_date")} AS snapshot_date, {code_sql("con_code")} AS con_code, weight, delivery, source_order FROM index_weight),
best AS (SELECT index_code, snapshot_date, max(delivery) AS delivery FROM r WHERE index_code IS NOT NULL AND snapshot_date IS NOT NULL GROUP BY ALL),
kept AS (SELECT r.* FROM r JOIN best USING (index_code, snapshot_date, delivery) WHERE con_code IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY index_code, snapshot_date, con_code ORDER BY source_order DESC, weight DESC NULLS LAST) = 1),
w AS (SELECT index_code, snapshot_date, con_code, CAST(round(weight * CASE WHEN sum(abs(weight)) OVER (PARTITION BY index_code, snapshot_date) <= 2 THEN 1e6 ELSE 1e4 END) AS BIGINT) AS weight FROM kept),
days AS (SELECT index_code, snapshot_date, lag(snapshot_date) OVER (PARTITION BY index_code ORDER BY snapshot_date) AS before FROM (SELECT DISTINCT index_code, snapshot_date FROM w)),
pairs AS (SELECT d.index_code, d.snapshot_date, con_code, weight, 1 AS now FROM days d JOIN w USING (index_code, snapshot_date) WHERE before IS NOT NULL
  UNION ALL SELECT d.index_code, d.snapshot_date, con_code, weight, 0 FROM days d JOIN w ON w.index_code = d.index_code AND w.snapshot_date = d.before),
c AS (SELECT index_code, snapshot_date, con_code, CASE WHEN min(now) = 1 THEN 'added' WHEN max(now) = 0 THEN 'removed'
  WHEN max(weight) FILTER (now = 0) IS DISTINCT FROM max(weight) FILTER (now = 1) THEN 'changed' END AS change_kind,
  max(weight) FILTER (now = 0) / 1e4 AS old_weight, max(weight) FILTER (now = 1) / 1e4 AS new_weight FROM pairs GROUP BY ALL HAVING change_kind IS NOT NULL)
"""


def _increment(name: str, keys: str, compared: list[str], outs: str) -> str:
    key_names = [k.rpartition(" AS ")[2] for k in keys.split(";")]
    readable = " AND ".join(f"{k} IS NOT NULL" for k in key_names[:2])
    partition, using = ", ".join(key_names), ", ".join(key_names)
    select = ", ".join(keys.split(";"))
    cols = ", ".join(f"{c} AS c_{c}" for c in compared)
    last = ", ".join(["load_id DESC", "row_id DESC", *[f"c_{c} DESC NULLS LAST" for c in compared]])
    same = " AND ".join(f"b.c_{c} IS NOT DISTINCT FROM n.c_{c}" for c in compared)
    return f"""(WITH last AS (SELECT * FROM update_runs WHERE dataset = '{name}' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY logged_at DESC) = 1),
done AS (SELECT DISTINCT unnest(range(from_load, to_load + 1)) AS load_id FROM last WHERE status = 'succeeded'),
r AS (SELECT row_id, load_id, {select}, {cols}, load_id IN (SELECT load_id FROM done) AS covered FROM {name}),
n AS (SELECT * FROM r WHERE {readable} QUALIFY row_number() OVER (PARTITION BY {partition} ORDER BY {last}) = 1),
b AS (SELECT * FROM r WHERE covered AND {readable} QUALIFY row_number() OVER (PARTITION BY {partition} ORDER BY {last}) = 1)
SELECT '{name}' AS dataset, n.row_id{outs} FROM n LEFT JOIN b USING ({using}) WHERE NOT n.covered AND (b.row_id IS NULL OR NOT ({same})))"""


_BAR_FIGURES = ["open", "high", "low", "close", "pre_close", "volume", "turnover"]
REPORT_FIGURES = ["basic_eps", "total_revenue", "revenue", "operate_profit", "n_income", "rd_exp"]
_LATEST = f"""latest AS (SELECT {code_sql("ts_code")} AS ts_code, CAST(try_strptime({day_sql("trade_date")}, '%Y%m%d') AS DATE) AS d, close, volume, load_id, row_id FROM stock_daily
  WHERE ({code_sql("ts_code")}) IS NOT NULL AND ({day_sql("trade_date")}) IS NOT NULL),
bars AS (SELECT * FROM latest QUALIFY row_number() OVER (PARTITION BY ts_code, d ORDER BY load_id DESC, row_id DESC, close DESC NULLS LAST, volume DESC NULLS LAST) = 1),
spans AS (SELECT ts_code, min(d) AS a, max(d) AS b FROM bars GROUP BY 1),
days AS (SELECT ts_code, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM spans),
dense AS (SELECT ts_code, d, CASE WHEN volume >= 0 THEN volume ELSE 0 END AS v, CASE WHEN volume >= 0 THEN 1 ELSE 0 END AS vn, CASE WHEN close > 0 THEN close ELSE 0 END AS c, CASE WHEN close > 0 THEN 1 ELSE 0 END AS cn
  FROM days LEFT JOIN bars USING (ts_code, d))"""


def reports_sql() -> str:
    return f"""versions AS (SELECT {code_sql("ts_code")} AS ts_code, {day_sql("end_date")} AS end_date, {TYPE_DIGITS} AS report_type, {day_sql(EFFECTIVE)} AS known,
  coalesce(trim(update_flag) = '1', false) AS updated, source_order, row_id, {", ".join(REPORT_FIGURES)} FROM income),
reports AS (SELECT * FROM versions WHERE ts_code IS NOT NULL AND end_date IS NOT NULL)"""


def _rules_sql() -> str:
    blank = lambda c: f"coalesce(trim({c}), '') = ''"
    eight = lambda c: f"coalesce(regexp_matches({c}, '^[0-9]{{8}}$') AND try_strptime({c}, '%Y%m%d') IS NOT NULL, false)"
    pattern = f"NOT ({blank('ts_code')}) AND NOT regexp_matches(ts_code, '^[0-9]{{6}}[.](SH|SZ|BJ)$')"
    bars = {
        "null_primary_key": f"{blank('ts_code')} OR {blank('trade_date')}", "code_pattern": pattern, "valid_date": f"NOT ({blank('trade_date')}) AND NOT {eight('trade_date')}",
        "ohlc_domain": "open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR high < open OR high < close OR high < low OR low > open OR low > close",
        "nonnegative_activity": "volume < 0 OR turnover < 0",
    }
    reports = {
        "null_primary_key": f"{blank('ts_code')} OR {blank('ann_date')} OR {blank('end_date')}", "code_pattern": pattern, "valid_date": f"NOT ({blank('end_date')}) AND NOT {eight('end_date')}",
        "finance_pit_dates": f"coalesce({EFFECTIVE}, '') IN ('', '0') OR ({day_sql('end_date')}) IS NULL OR ({day_sql(EFFECTIVE)}) < ({day_sql('end_date')})",
    }
    rows = [f"SELECT '{t}' AS src_table, '{n}' AS rule_name, row_id AS ref_id FROM {t} WHERE {w}" for t, rules in (("stock_daily", bars), ("income", reports)) for n, w in rules.items()]
    for c in _BAR_FIGURES:
        rows.append(f"""SELECT 'stock_daily', CASE WHEN 2 * nulls >= n THEN 'null_surge:{c}' ELSE 'median_shift:{c}' END, load_id FROM
(SELECT load_id, count(*) AS n, count(*) - count({c}) AS nulls, median({c}) AS m, (SELECT median({c}) FROM stock_daily) AS g FROM stock_daily WHERE load_id IS NOT NULL GROUP BY load_id)
WHERE n >= 10 AND (2 * nulls >= n OR m < 0.1 * g OR m > 10 * g)""")
    return " UNION ALL ".join(rows)


def oracle_sql() -> dict[str, str]:
    bar_keys = f"{code_sql('ts_code')} AS ts_code;{day_sql('trade_date')} AS trade_date"
    report_keys = f"{code_sql('ts_code')} AS ts_code;{day_sql('end_date')} AS end_date;{TYPE_DIGITS} AS report_type"
    report_compared = ["ann_date", "f_ann_date", "update_flag", *REPORT_FIGURES]
    more = lambda day: f", n.load_id, n.ts_code, n.{day} AS range_day"
    frame = lambda n: f"(PARTITION BY ts_code ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    trail = ", ".join(
        f"round(sum(v) OVER {frame(n)}, 2) AS volume_total_{n}, round(sum(v) OVER {frame(n)} / nullif(sum(vn) OVER {frame(n)}, 0), 6) AS volume_average_{n}, "
        f"round(sum(c) OVER {frame(n)}, 4) AS close_total_{n}, round(sum(c) OVER {frame(n)} / nullif(sum(cn) OVER {frame(n)}, 0), 6) AS close_average_{n}" for n in (7, 30)
    )
    return {
        "p1_found": _figures() + " SELECT src_table, row_id, field_name, CAST(pow10 AS INT) AS pow10 FROM figures WHERE number <> 0 AND pow10 <> says",
        "p1_converted": _figures() + " SELECT src_table, row_id, field_name, CASE WHEN pow10 >= 0 THEN number * pow(10.0, pow10) ELSE number / pow(10.0, -pow10) END AS common_value FROM figures",
        "p1_stated": f"WITH alias(kind, a, p) AS (VALUES {_aliases()}) SELECT feed, asset_type, field_name, coalesce({day_sql('valid_from')}, '00010101') AS valid_from, CAST(p AS INT) AS pow10, p IS NOT NULL AS readable "
        "FROM feed_units LEFT JOIN alias ON a = lower(trim(unit_text)) AND kind = CASE field_name WHEN 'vol' THEN 'volume' WHEN 'amount' THEN 'money' END",
        "p2_found": _SNAPSHOTS + "SELECT index_code, snapshot_date, con_code, change_kind FROM c",
        "p2_weights": _SNAPSHOTS + "SELECT * FROM c",
        "p3_found": _increment("stock_daily", bar_keys, _BAR_FIGURES, "") + " UNION ALL " + _increment("income", report_keys, report_compared, ""),
        "p3_pending": _increment("stock_daily", bar_keys, _BAR_FIGURES, more("trade_date")) + " UNION ALL " + _increment("income", report_keys, report_compared, more("end_date")),
        "p5_found": f"WITH {_LATEST}, w AS (SELECT ts_code, d, sum(v) OVER {frame(7)} AS s7, sum(v) OVER {frame(30)} AS s30 FROM dense) "
        "SELECT ts_code, strftime(d, '%Y%m%d') AS cal_day, CAST(7 AS INT) AS window_days FROM w WHERE s7 = 0 UNION ALL SELECT ts_code, strftime(d, '%Y%m%d'), CAST(30 AS INT) FROM w WHERE s30 = 0",
        "p5_trailing": f"WITH {_LATEST} SELECT ts_code, strftime(d, '%Y%m%d') AS cal_day, {trail} FROM dense",
        "p6_found": _SNAPSHOTS.rstrip() + f""", {reports_sql()},
p AS (SELECT position_id, {code_sql("ts_code")} AS ts_code, {index_sql("index_code")} AS index_code, {day_sql("trade_date")} AS day FROM positions WHERE upper(trim(record_type)) = 'POSITION' AND position_id IS NOT NULL),
inc AS (SELECT position_id, row_id FROM p JOIN reports r ON r.ts_code = p.ts_code AND r.report_type = '1' AND r.known < p.day AND r.end_date <= p.day
  QUALIFY row_number() OVER (PARTITION BY position_id ORDER BY r.end_date DESC, known DESC, updated DESC, source_order DESC, row_id) = 1),
snap AS (SELECT position_id, p.ts_code, p.index_code, max(snapshot_date) AS snapshot_date FROM p JOIN (SELECT DISTINCT index_code, snapshot_date FROM w) s ON s.index_code = p.index_code AND s.snapshot_date < p.day WHERE p.ts_code IS NOT NULL GROUP BY ALL)
SELECT position_id, 'income' AS kind, CAST(row_id AS VARCHAR) AS ref FROM inc
UNION ALL SELECT position_id, 'index_weight', snap.snapshot_date FROM snap JOIN w ON w.index_code = snap.index_code AND w.snapshot_date = snap.snapshot_date AND w.con_code = snap.ts_code""",
        "p7_found": _rules_sql(),
    }
