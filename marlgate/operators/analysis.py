"""Cross-sectional factor analysis on long frames.

Frames have asset, session, session_idx, the factor ``f``, a forward return ``r`` and where needed ``industry`` and ``cap``.
Everything is aggregates and windows by session; only summaries of a few rows reach the driver. A correlation needs
``least`` pairs and variance on both sides, else it is null. Missing values are null and pair with nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlgate.functions.normalize import blank


def pearson(x: Column, y: Column, least: int = 2) -> Column:
    """Correlation over the pairs of a group, from sums that combine before the shuffle."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    made = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when((F.count(a) >= least) & made.isNotNull(), F.least(F.greatest(made, F.lit(-1.0)), F.lit(1.0)))


def percent_rank(df: DataFrame, value: str, out: str, by: str = "session") -> DataFrame:
    """Average rank of ties over the number of values, within each session."""
    first = F.rank().over(Window.partitionBy(by).orderBy(F.col(value).asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(by, value))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), (first + (ties - 1) / 2) / F.count(value).over(Window.partitionBy(by))))


def information(df: DataFrame, least: int = 3) -> DataFrame:
    """session, n, ic, rank_ic. Ranks are taken among all values of each side, before pairing."""
    ranked = percent_rank(percent_rank(df, "f", "_rf"), "r", "_rr")
    pairs = F.count(F.when(F.col("f").isNotNull() & F.col("r").isNotNull(), 1))
    return ranked.groupBy("session").agg(
        pairs.alias("n"), pearson(F.col("f"), F.col("r"), least).alias("ic"), pearson(F.col("_rf"), F.col("_rr"), least).alias("rank_ic")
    )


def neutralized(df: DataFrame, industry: str | None = "industry", cap: str | None = "cap", value: str = "f") -> DataFrame:
    """The factor less what industry means and log size explain together (both demeaned by industry, then one slope a session)."""
    usable = F.col(value).isNotNull()
    if industry:
        usable = usable & ~blank(industry)
    if cap:
        usable = usable & F.coalesce(F.col(cap) > 0, F.lit(False))
    group = Window.partitionBy("session", *([industry] if industry else []))
    day = Window.partitionBy("session")
    out = df.withColumn("_y", F.when(usable, F.col(value)))
    if cap:
        out = out.withColumn("_s", F.when(usable, F.log(F.when(F.col(cap) > 0, F.col(cap)))))
    # groups are taken among usable rows only: the others add nothing to the means
    out = out.withColumn("_yd", F.col("_y") - F.avg("_y").over(group))
    rest = F.col("_yd")
    if cap:
        out = out.withColumn("_sd", F.col("_s") - F.avg("_s").over(group))
        square, cross = F.sum(F.col("_sd") * F.col("_sd")).over(day), F.sum(F.col("_sd") * F.col("_yd")).over(day)
        rest = F.when(square > 1e-12, F.col("_yd") - cross / F.when(square > 1e-12, square) * F.col("_sd")).otherwise(F.col("_yd"))
    out = out.withColumn(value, F.when(F.count("_y").over(day) >= 2, rest))
    return out.drop("_y", "_s", "_yd", "_sd")


def labelled(df: DataFrame, quantiles: int = 5) -> DataFrame:
    """Add ``q``: 1 to ``quantiles`` by rank within the session, ties in asset order."""
    if quantiles < 2:
        raise ValueError("at least two quantiles")
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.col("f").asc_nulls_last(), "asset"))
    share = place / F.count("f").over(Window.partitionBy("session"))
    return df.withColumn("q", F.when(F.col("f").isNotNull(), F.least(F.greatest(F.ceil(share * quantiles), F.lit(1)), F.lit(quantiles)).cast("int")))


def quantile_returns(df: DataFrame, quantiles: int = 5) -> DataFrame:
    """session, q, mean_return, n: each session has all quantiles, empty ones with n = 0."""
    made = labelled(df, quantiles).where("q is not null and r is not null").groupBy("session", "q").agg(F.avg("r").alias("mean_return"), F.count("r").alias("n"))
    every = df.select("session").distinct().select("session", F.explode(F.sequence(F.lit(1), F.lit(quantiles))).alias("q"))
    return every.join(made, ["session", "q"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def long_short(df: DataFrame, quantiles: int = 5) -> DataFrame:
    """session, spread: top less bottom quantile."""
    pick = lambda q: F.max(F.when(F.col("q") == q, F.col("mean_return")))
    return quantile_returns(df, quantiles).groupBy("session").agg((pick(quantiles) - pick(1)).alias("spread"))


def quantile_turnover(df: DataFrame, quantiles: int = 5) -> DataFrame:
    """session, q, turnover: share of a quantile's assets that were not in it the session before. First session: null."""
    along = Window.partitionBy("asset").orderBy("session_idx")
    rows = labelled(df, quantiles).withColumn("_q", F.lag("q").over(along)).withColumn("_i", F.lag("session_idx").over(along))
    rows = rows.withColumn("_q", F.when(F.col("_i") == F.col("session_idx") - 1, F.col("_q")))
    stay = F.count_if(F.col("_q").eqNullSafe(F.col("q")))
    made = rows.where("q is not null").groupBy("session", "session_idx", "q").agg((1 - stay / F.count(F.lit(1))).alias("turnover"))
    return made.select("session", "q", F.when(F.col("session_idx") > 0, F.col("turnover")).alias("turnover"))


def rank_autocorrelation(df: DataFrame) -> DataFrame:
    """session, rank_autocorrelation with the session before (two common assets at least)."""
    along = Window.partitionBy("asset").orderBy("session_idx")
    ranked = percent_rank(df, "f", "_rf").withColumn("_before", F.lag("_rf").over(along))
    return ranked.groupBy("session").agg(pearson(F.col("_rf"), F.col("_before"), 2).alias("rank_autocorrelation"))


def factor_returns(df: DataFrame) -> DataFrame:
    """session, factor_return (weights: the centred factor over its absolute sum), universe_return."""
    pairs = df.where("f is not null and r is not null")
    centred = pairs.withColumn("_w", F.col("f") - F.avg("f").over(Window.partitionBy("session")))
    return centred.groupBy("session").agg(F.try_divide(F.sum(F.col("_w") * F.col("r")), F.sum(F.abs("_w"))).alias("factor_return"), F.avg("r").alias("universe_return"))


def sector_information(df: DataFrame, least: int = 3) -> DataFrame:
    """industry, ic, sessions: correlation by session and industry, then its mean over the sessions that have one."""
    daily = df.where(~blank("industry")).groupBy("industry", "session").agg(pearson(F.col("f"), F.col("r"), least).alias("ic"))
    return daily.groupBy("industry").agg(F.avg("ic").alias("ic"), F.count("ic").alias("sessions"))


def sector_quantiles(df: DataFrame, quantiles: int = 5) -> DataFrame:
    """industry, q, mean_return: mean over sessions of the daily means."""
    rows = labelled(df, quantiles).where("q is not null and r is not null").where(~blank("industry"))
    return rows.groupBy("industry", "q", "session").agg(F.avg("r").alias("_m")).groupBy("industry", "q").agg(F.avg("_m").alias("mean_return"))


def dailyized(r: Column, period: int) -> Column:
    """The one-session return that compounds to ``r`` over ``period``; null at a loss of everything."""
    return F.when(r > -1, F.expm1(F.log1p(F.when(r > -1, r)) / period))


def summary_table(info: DataFrame, turnover: DataFrame | None = None, autocorrelation: DataFrame | None = None, sessions_a_year: int = 252) -> DataFrame:
    """One row: moments of the information coefficients and of the rank coefficients, mean turnover and rank autocorrelation."""
    sums = info.agg(
        F.count("ic").alias("sessions"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg((F.col("ic") > 0).cast("double")).alias("ic_positive"),
        F.skewness("ic").alias("_skew"), F.kurtosis("ic").alias("_kurt"), F.avg("rank_ic").alias("rank_ic_mean"), F.stddev_samp("rank_ic").alias("rank_ic_std"),
        F.avg((F.col("rank_ic") > 0).cast("double")).alias("rank_ic_positive"), F.count("rank_ic").alias("_ranked"),
    )
    n, ratio, rank_ratio = F.col("sessions"), F.try_divide("ic_mean", "ic_std"), F.try_divide("rank_ic_mean", "rank_ic_std")
    out = sums.select(
        "sessions", "ic_mean", "ic_std", ratio.alias("icir"), (ratio * math.sqrt(sessions_a_year)).alias("icir_annual"), "ic_positive", (ratio * F.sqrt(n)).alias("ic_t"),
        F.when(n > 2, F.col("_skew") * F.sqrt(n * (n - 1)) / (n - 2)).alias("ic_skew"), F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_kurt") + 6)).alias("ic_kurt"),
        "rank_ic_mean", "rank_ic_std", rank_ratio.alias("rank_icir"), (rank_ratio * math.sqrt(sessions_a_year)).alias("rank_icir_annual"), "rank_ic_positive", (rank_ratio * F.sqrt("_ranked")).alias("rank_ic_t"),
    ).withColumn("one", F.lit(1))
    more = []
    if turnover is not None:
        more.append(turnover.agg(F.avg("turnover").alias("mean_turnover")))
    if autocorrelation is not None:
        more.append(autocorrelation.agg(F.avg("rank_autocorrelation").alias("mean_autocorrelation")))
    for frame in more:  # one row each
        out = out.join(frame.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


def summary(info: DataFrame, turnover: DataFrame | None = None, autocorrelation: DataFrame | None = None, sessions_a_year: int = 252) -> dict[str, float | None]:
    """The summary's row, with the two-sided normal probability of the t statistics."""
    row = summary_table(info, turnover, autocorrelation, sessions_a_year).first().asDict()
    for name in ("ic", "rank_ic"):
        t = row[f"{name}_t"]
        row[f"{name}_p"] = math.erfc(abs(t) / math.sqrt(2)) if t is not None else None
    return row


def return_analysis(df: DataFrame, quantiles: int = 5, period: int = 1) -> DataFrame:
    """One row: alpha, beta and t of the factor's returns on the universe's; mean one-session return of the top and bottom
    quantile and of their spread, in hundredths of a percent."""
    daily = quantile_returns(df, quantiles).withColumn("_d", dailyized(F.col("mean_return"), period))
    ends = daily.groupBy("session").agg(F.max(F.when(F.col("q") == quantiles, F.col("_d"))).alias("t"), F.max(F.when(F.col("q") == 1, F.col("_d"))).alias("b"))
    bps = ends.agg(*[(F.avg(x) * 10_000).alias(f"{name}_bps") for name, x in (("top", F.col("t")), ("bottom", F.col("b")), ("spread", F.col("t") - F.col("b")))])
    returns = factor_returns(df.withColumn("r", dailyized(F.col("r"), period)))
    return alpha_beta(returns).withColumn("one", F.lit(1)).join(bps.withColumn("one", F.lit(1)), "one").drop("one")


def cumulative_information(info: DataFrame) -> DataFrame:
    """session, cumulative_ic, cumulative_rank_ic: running sums, a missing coefficient as zero."""
    upto = Window.partitionBy(F.lit(1)).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)  # one series
    return info.select("session", *[F.sum(F.coalesce(c, F.lit(0.0))).over(upto).alias(f"cumulative_{c}") for c in ("ic", "rank_ic")])


def monthly_information(info: DataFrame) -> DataFrame:
    """year, month, ic, rank_ic: means over the sessions that have one."""
    return info.groupBy(F.year("session").alias("year"), F.month("session").alias("month")).agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"))


def quantile_distribution(df: DataFrame, quantiles: int = 5) -> DataFrame:
    """q, sessions, and of its mean returns by session: mean, std, lowest, quartiles, highest. Exact: a value a session."""
    x = F.col("mean_return")
    return quantile_returns(df, quantiles).groupBy("q").agg(
        F.count(x).alias("sessions"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("lowest"),
        *[F.percentile(x, F.lit(p)).alias(name) for name, p in (("lower", 0.25), ("median", 0.5), ("upper", 0.75))], F.max(x).alias("highest"),
    )


def quantile_cumulative(df: DataFrame, quantiles: int = 5, period: int = 1) -> DataFrame:
    """session, q, cumulative: running compounded one-session return of each quantile, missing days as zero."""
    upto = Window.partitionBy("q").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    daily = quantile_returns(df, quantiles).withColumn("_d", F.coalesce(dailyized(F.col("mean_return"), period), F.lit(0.0)))
    return daily.select("session", "q", F.expm1(F.sum(F.log1p("_d")).over(upto)).alias("cumulative"))


def alpha_beta(returns: DataFrame, sessions_a_year: int = 252) -> DataFrame:
    """alpha (compounded to a year), beta, t_alpha, n: the factor's returns on the universe's, least squares."""
    x, y = F.col("universe_return"), F.col("factor_return")
    pairs = returns.where(x.isNotNull() & y.isNotNull())
    made = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.regr_intercept(y, x).alias("a"), F.regr_slope(y, x).alias("beta"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"), F.avg(x).alias("mx"),
    )
    error = F.sqrt(F.greatest(F.col("syy") - F.col("beta") * F.col("sxy"), F.lit(0.0)) / F.when(F.col("n") > 2, F.col("n") - 2))
    deviation = error * F.sqrt(1 / F.col("n") + F.try_divide(F.col("mx") * F.col("mx"), F.col("sxx")))
    enough = F.col("n") >= 3
    return made.select(
        "n", F.when(enough, F.pow(1 + F.col("a"), sessions_a_year) - 1).alias("alpha"), F.when(enough, F.col("beta")).alias("beta"),
        F.when(enough, F.try_divide(F.col("a"), deviation)).alias("t_alpha"),
    )
