"""Performance, risk and attribution of daily results, as aggregates and windows.

``daily``: day (DATE), returns, portfolio_value, benchmark_return and whatever else is summed. A portfolio's days are one
series: windows over it sort one row a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


def by_day(*keys: str):
    return Window.partitionBy(*(keys or (F.lit(1),))).orderBy("day")


def compounded(r: str) -> Column:
    """The product of one plus the returns, less one; null without any."""
    return F.when(F.count(r) > 0, F.product(1 + F.col(r)) - 1)


def drawdown(daily: DataFrame, *keys: str) -> DataFrame:
    """Add ``drawdown``: value over its highest so far, less one."""
    upto = by_day(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("drawdown", F.try_divide("portfolio_value", F.max("portfolio_value").over(upto)) - 1)


def metrics(daily: DataFrame, *keys: str) -> DataFrame:
    """One row a portfolio: total_return, cagr, volatility, sharpe, sortino, max_drawdown, calmar, beta, alpha,
    tracking_error, information_ratio, benchmark_total_return. A ratio over zero is null."""
    r, b = F.col("returns"), F.col("benchmark_return")
    rows = drawdown(daily, *keys).withColumn("_x", r - b)
    sums = rows.groupBy(*keys).agg(
        F.count("returns").alias("n"), compounded("returns").alias("total_return"), F.avg(r).alias("m"), F.stddev_samp(r).alias("s"),
        F.avg(F.pow(F.least(r, F.lit(0.0)), 2)).alias("down"), F.abs(F.min("drawdown")).alias("max_drawdown"),
        F.avg(b).alias("mb"), F.covar_samp(r, b).alias("cov"), F.var_samp(b).alias("vb"), F.avg("_x").alias("mx"), F.stddev_samp("_x").alias("sx"),
        compounded("benchmark_return").alias("benchmark_total_return"),
    )
    cagr = F.when(F.col("total_return") <= -1, -1.0).otherwise(F.pow(1 + F.col("total_return"), F.lit(float(YEAR)) / F.greatest(F.lit(1), F.col("n") - 1)) - 1)
    root = YEAR**0.5
    beta = F.try_divide("cov", "vb")
    return sums.select(
        *keys, "n", "total_return", cagr.alias("cagr"), (F.coalesce(F.col("s"), F.lit(0.0)) * root).alias("volatility"), F.try_divide(F.col("m") * root, "s").alias("sharpe"),
        F.try_divide(F.col("m") * root, F.sqrt("down")).alias("sortino"), "max_drawdown", F.try_divide(cagr, "max_drawdown").alias("calmar"),
        beta.alias("beta"), ((F.col("m") - beta * F.col("mb")) * YEAR).alias("alpha"), (F.col("sx") * root).alias("tracking_error"),
        F.try_divide(F.col("mx") * YEAR, F.col("sx") * root).alias("information_ratio"), "benchmark_total_return", (F.col("total_return") - F.col("benchmark_total_return")).alias("total_excess_return"),
    )


def calendar_returns(daily: DataFrame, *keys: str, monthly: bool = True) -> DataFrame:
    """Compounded returns by year, or by year and month."""
    parts = [F.year("day").alias("year"), *([F.month("day").alias("month")] if monthly else [])]
    return daily.groupBy(*keys, *parts).agg(compounded("returns").alias("return"))


def monthly_table(daily: DataFrame, *keys: str) -> DataFrame:
    """One row a year, one column a month."""
    return daily.withColumn("_month", F.month("day")).groupBy(*keys, F.year("day").alias("year")).pivot("_month", list(range(1, 13))).agg(compounded("returns"))


def rolling_risk(daily: DataFrame, window: int, *keys: str) -> DataFrame:
    """Annual volatility and Sharpe ratio over the last ``window`` days; null before there are that many."""
    frame = by_day(*keys).rowsBetween(-(window - 1), 0)
    m, s = F.avg("returns").over(frame), F.stddev_samp("returns").over(frame)
    full = F.count("returns").over(frame) == window
    return daily.select(*keys, "day", F.when(full, s * YEAR**0.5).alias("volatility"), F.when(full, F.try_divide(m * YEAR**0.5, s)).alias("sharpe"))


def cumulative(daily: DataFrame, column: str = "returns", *keys: str) -> DataFrame:
    """Add ``cumulative``: the running compounded return, missing days as zero; null from a total loss on."""
    upto = by_day(*keys).rowsBetween(Window.unboundedPreceding, 0)
    r = F.coalesce(F.col(column), F.lit(0.0))
    lost = F.max((r <= -1).cast("int")).over(upto) == 1
    return daily.withColumn("cumulative", F.when(~lost, F.exp(F.sum(F.log1p(F.when(r > -1, r))).over(upto)) - 1))


def moving_mean(daily: DataFrame, column: str, window: int = 21, least: int = 5, *keys: str) -> DataFrame:
    frame = by_day(*keys).rowsBetween(-(window - 1), 0)
    return daily.withColumn("moving_mean", F.when(F.count(column).over(frame) >= least, F.avg(column).over(frame)))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin (from 1), low, high, n over equal bins of the value range; one bin where all values are equal."""
    if bins < 1:
        raise ValueError("at least one bin")
    span = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    if span["a"] is None:
        return df.select(F.lit(1).alias("bin"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(0).cast("bigint").alias("n")).limit(0)
    a, width = float(span["a"]), (float(span["b"]) - float(span["a"])) / bins
    at = F.least(F.floor((F.col(column) - a) / width), F.lit(bins - 1)).cast("int") if width else F.lit(0)
    counted = df.where(F.col(column).isNotNull()).groupBy(at.alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select((F.col("_b") + 1).alias("bin"), (F.lit(a) + F.col("_b") * width).alias("low"), (F.lit(a) + (F.col("_b") + 1) * width).alias("high"), "n")


def closed_trade_ratios(trades: DataFrame, *keys: str) -> DataFrame:
    """win_rate and profit_factor from ``pnl``."""
    wins, losses = F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.sum(F.when(F.col("pnl") < 0, F.col("pnl")))
    return trades.groupBy(*keys).agg(F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.try_divide(F.coalesce(wins, F.lit(0.0)), F.abs(losses)).alias("profit_factor"))


def attribution(positions: DataFrame) -> DataFrame:
    """ts_code, days_held, contribution (sum of weight times return), mean_weight, last_value; CASH counts like an asset.

    Rows repeated under other ids on one day, code and index count once (the highest position_id).
    """
    key = ["trade_date", "ts_code", "index_code"]
    one = positions.groupBy(*key).agg(F.max_by(F.struct("weight", "asset_return", "market_value"), "position_id").alias("x")).select(*key, "x.*")
    return one.groupBy("ts_code").agg(
        F.countDistinct("trade_date").alias("days_held"), F.sum(F.col("weight") * F.col("asset_return")).alias("contribution"),
        F.avg("weight").alias("mean_weight"), F.max_by("market_value", F.struct("trade_date", "index_code")).alias("last_value"),
    )


def open_positions(positions: DataFrame, day: str = "trade_date") -> DataFrame:
    """One row: the last day with a position, how many assets are held on it with a value above zero, and that value."""
    held = positions.where(F.col("market_value") > 0)
    last = positions.agg(F.max(day).alias("last_day"))
    return held.join(last, F.col(day) == F.col("last_day"), "right").groupBy("last_day").agg(
        F.countDistinct("ts_code").alias("open_positions"), F.sum("market_value").alias("value")
    )
