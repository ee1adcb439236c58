"""Queries of the factor language: one for each operator over daily bars, against hand-written SQL, and composite expressions over
a monthly panel of suppliers, against SQL made from their terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgate.functions.normalize import as_number, market_code, real_day
from marlgate.plans.compiler import dense_panel, evaluate
from marlgate.plans.data_queries import code_sql, day_sql
from marlgate.plans.factor_sql import operator_sql
from marlgate.plans.operators import OPERATORS
from marlgate.plans.sqltext import HALF, steps_of
from marlgate.sources.testbed import table

Query = Callable[[SparkSession, str], DataFrame]
VALUES = ["open", "high", "low", "close", "volume", "turnover"]

# what stands for a series of an operator's signature, and the windows that go round
SERIES_OF = {
    "x": "$close", "y": "$open", "o": "$open", "h": "$high", "l": "$low", "k": "$close", "v": "$volume", "c": "$close > $open", "d": "$close - $open",
    "r": "$close / $open", "p": "0.5", "u": "0.3",
}
WINDOWS = (7, 11, 15, 23)
LONGEST = 79  # sessions, as long as a window of research gets


def arguments_of(name: str) -> list[str]:
    """The arguments of an operator's example call, by rule: series by the signature's letters, windows in turn from the
    operator's place in the alphabet; every third operator of a single window gets the longest one."""
    signature, place = OPERATORS[name].signature.replace("?", ""), sorted(OPERATORS).index(name)
    out, turn = [], place
    for letter in signature:
        if letter in SERIES_OF:
            out.append(SERIES_OF[letter])
        elif letter == "f":
            out.append("2")
        else:
            single = sum(x in "wz" for x in signature) == 1 and set(signature) <= set("xydchlwv") and name not in CHAINED
            out.append(str(LONGEST if single and place % 3 == 0 else WINDOWS[turn % len(WINDOWS)]))
            turn += 1
    return out


CHAINED = ("EMA", "DEMA", "TEMA", "T3", "REF", "DELAY")  # averages of averages need many times their window
EXAMPLES = {name: f"{name}({', '.join(arguments_of(name))})" for name in sorted(OPERATORS)}
COMPOSITES = {
    "syntax_arithmetic": "-$close % 7 + 2 ** 3 - $open / ($high - $low)",
    "syntax_conditions": "not ($close > $open and $volume >= 100) or 1 < $low / $open <= 1.1 or ~($high == $close)",
    "composite_score": "0.4 * RANK(TS_ZSCORE($close, 6)) + 0.3 * RANK(-STD($close, 6)) + 0.3 * RANK(ATR($close, 5) / $close)",
    "composite_nested": "RANK(MA(RANK($close), 3) / RANK($volume)) - ZSCORE(CORR($close, $volume, 8))",
    "composite_momentum": "STD(LOG($close / REF($close, 1)), 6) * 252 ** 0.5 + RETURNS($close, 6)",
}


def monthly_bars(lineitem: DataFrame) -> DataFrame:
    """asset, session and bar fields; first and last price by ship date and the keys that break its ties."""
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = lineitem.select(F.col("l_suppkey").alias("asset"), F.trunc(F.to_date("l_shipdate"), "month").alias("session"), price.alias("price"), "l_quantity", "l_extendedprice", order.alias("k"))
    return rows.groupBy("asset", "session").agg(
        F.min_by("price", "k").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "k").alias("close"),
        F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("turnover"),
    )


def monthly_panel(spark: SparkSession, folder: str) -> DataFrame:
    return dense_panel(monthly_bars(table(spark, folder, "lineitem")), VALUES)


PANEL_SQL = """bars AS (
  SELECT l_suppkey AS asset, CAST(date_trunc('month', l_shipdate) AS DATE) AS session, min_by(price, k) AS open, max(price) AS high, min(price) AS low,
    max_by(price, k) AS close, sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS turnover
  FROM (SELECT *, l_extendedprice / l_quantity AS price, row(l_shipdate, l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem) GROUP BY 1, 2),
calendar AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS session_idx FROM (SELECT DISTINCT session FROM bars)),
panel AS (SELECT a.asset, c.session, c.session_idx, open, high, low, close, volume, turnover
  FROM (SELECT DISTINCT asset FROM bars) a CROSS JOIN calendar c LEFT JOIN bars b ON b.asset = a.asset AND b.session = c.session)"""


BAR_VALUES = {"open": "open", "high": "high", "low": "low", "close": "close", "volume": "floor(volume / 100)", "turnover": "floor(turnover / 1000)"}  # whole lots and thousands


def daily_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The latest bar of every stock and day, as recorded."""
    rows = table(spark, folder, "stock_daily").select(
        market_code("ts_code").alias("asset"), real_day("trade_date").alias("session"), F.struct("load_id", "row_id", *[as_number(c).alias(c) for c in BAR_VALUES]).alias("x"),
    ).where(F.col("asset").isNotNull() & F.col("session").isNotNull())
    bars = rows.groupBy("asset", "session").agg(F.max("x").alias("x")).select("asset", "session", "x.*")
    return dense_panel(bars.select("asset", "session", *[F.expr(e).cast("double").alias(c) for c, e in BAR_VALUES.items()]), list(BAR_VALUES))


DAILY_SQL = f"""bars AS (
  SELECT {code_sql("ts_code")} AS asset, CAST(try_strptime({day_sql("trade_date")}, '%Y%m%d') AS DATE) AS session, {", ".join(f"{e} AS {c}" for c, e in BAR_VALUES.items())}, load_id, row_id FROM stock_daily
  WHERE ({code_sql("ts_code")}) IS NOT NULL AND ({day_sql("trade_date")}) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asset, session ORDER BY load_id DESC, row_id DESC) = 1),
calendar AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS session_idx FROM (SELECT DISTINCT session FROM bars)),
panel AS (SELECT a.asset, c.session, c.session_idx, {", ".join(BAR_VALUES)}
  FROM (SELECT DISTINCT asset FROM bars) a CROSS JOIN calendar c LEFT JOIN bars b ON b.asset = a.asset AND b.session = c.session)"""


def _rounded(value: str, digits: int, half: float) -> Column:
    return (F.floor(F.col(value) * 10**digits + half) / 10.0**digits).alias("value")


def _run(expression: str, panel: Callable[[SparkSession, str], DataFrame], digits: int, half: float) -> Query:
    return lambda spark, folder: evaluate(panel(spark, folder), {"value": expression}).select("asset", "session", _rounded("value", digits, half))


def queries() -> dict[str, Query]:
    return {f"factor_{name.lower()}": _run(e, daily_panel, 5, 0.5) for name, e in EXAMPLES.items()} | {name: _run(e, monthly_panel, 4, HALF) for name, e in COMPOSITES.items()} | {
        "panel_bars": lambda spark, folder: monthly_panel(spark, folder).select("asset", "session", "session_idx", *VALUES),
        "panel_daily": lambda spark, folder: daily_panel(spark, folder).select("asset", "session", "session_idx", *BAR_VALUES),
    }


def sql_arguments(name: str) -> list:
    return [a.replace("$", "") if not a.replace(".", "").isdigit() else float(a) if "." in a else int(a) for a in arguments_of(name)]


def oracle_sql() -> dict[str, str]:
    out = {
        "panel_bars": f"WITH {PANEL_SQL} SELECT asset, session, session_idx, {', '.join(VALUES)} FROM panel",
        "panel_daily": f"WITH {DAILY_SQL} SELECT asset, session, session_idx, {', '.join(BAR_VALUES)} FROM panel",
    }
    for name in EXAMPLES:
        args = [f"({a})" if isinstance(a, str) and " " in a else a for a in sql_arguments(name)]
        out[f"factor_{name.lower()}"] = operator_sql(name, args, DAILY_SQL)
    for name, e in COMPOSITES.items():
        steps, last = steps_of({"value": e}, "panel", 4)
        out[name] = f"WITH {', '.join([PANEL_SQL, *steps])} SELECT asset, session, value FROM ({last})"
    return out
