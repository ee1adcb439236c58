"""Research over a panel: masked histories, a whole factor analysis, coverage planning, group quotas, density of a series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlgate.operators import analysis, portal
from marlgate.plans.compiler import evaluate


def masked(panel: DataFrame, expressions: dict[str, str], mask: Column | str, keep: Sequence[str] = ()) -> DataFrame:
    """Expressions over all assets of the panel; results outside the mask are then null, so ranks see every asset."""
    name = mask if isinstance(mask, str) else "_mask"
    rows = panel if isinstance(mask, str) else panel.withColumn(name, mask)
    out = evaluate(rows, expressions, keep=(name, *keep))
    seen = F.coalesce(F.col(name).cast("boolean"), F.lit(False))
    return out.withColumns({e: F.when(seen, F.col(e)) for e in expressions}).drop(*([] if isinstance(mask, str) else [name]))


def analyze(panel: DataFrame, expression: str, periods: Sequence[int] = (1, 5, 10), quantiles: int = 5, neutral: tuple[str | None, str | None] = (None, None), attributes: DataFrame | None = None) -> dict[int, dict[str, DataFrame]]:
    """For each holding period: information, quantile returns, spread, turnover, autocorrelation, factor returns.

    Factor and all labels are compiled together, so the panel is read and sorted once. ``attributes``: asset, industry, cap.
    """
    labels = {f"r{p}": f"FUTURE_RETURNS($close, {p})" for p in periods}
    rows = evaluate(panel, {"f": expression, **labels})
    if attributes is not None:
        rows = rows.join(attributes, "asset", "left")
    if any(neutral):
        rows = analysis.neutralized(rows, *neutral)
    out = {}
    for p in periods:
        one = rows.withColumn("r", F.col(f"r{p}"))
        out[p] = {
            "information": analysis.information(one), "quantiles": analysis.quantile_returns(one, quantiles), "spread": analysis.long_short(one, quantiles),
            "turnover": analysis.quantile_turnover(one, quantiles), "autocorrelation": analysis.rank_autocorrelation(one), "returns": analysis.factor_returns(one),
        }
    return out


def run_analysis(panel: DataFrame, expression: str, periods: Sequence[int] = (1, 5, 10), quantiles: int = 5) -> DataFrame:
    """A whole analysis as one frame: a row for each holding period with its summary and return analysis."""
    rows = evaluate(panel, {"f": expression, **{f"r{p}": f"FUTURE_RETURNS($close, {p})" for p in periods}})
    out = []
    for p in periods:
        one = rows.withColumn("r", F.col(f"r{p}"))
        table = analysis.summary_table(analysis.information(one), analysis.quantile_turnover(one, quantiles), analysis.rank_autocorrelation(one))
        made = table.withColumn("period", F.lit(p)).join(analysis.return_analysis(one, quantiles, p).withColumn("period", F.lit(p)), "period")
        out.append(made)
    return reduce(DataFrame.unionByName, out)


def member_union(snapshots: DataFrame, end: object, indices: Sequence[str] | None = None) -> DataFrame:
    """asset: everything that was in an index (of those named) in a snapshot before the day."""
    rows = snapshots.where(F.col("snapshot") < F.lit(end))
    return (rows if indices is None else rows.where(F.col("series").isin(list(indices)))).select(F.col("item").alias("asset")).distinct()


@dataclass(frozen=True)
class FactorData:
    """Expressions over a universe and a span of sessions.

    ``panel``: asset, session, session_idx, fields, and as needed ``adj_factor``, list_date, delist_date and flags. Prices are
    adjusted as of the last session asked for; earlier sessions are read to warm up, later ones never. Outside the universe
    (not alive, listed too shortly, flagged) results are null, while expressions still see the asset's past.
    """

    panel: DataFrame
    start: object
    end: object
    assets: DataFrame | None = None
    adjustment: str = "qfq"
    min_listed_days: int = 0
    exclude_flags: tuple[str, ...] = ()

    def source(self) -> DataFrame:
        rows = self.panel.where(F.col("session") <= F.lit(self.end))
        if self.assets is not None:
            rows = rows.join(self.assets, "asset", "left_semi")
        rows = portal.adjusted(rows, self.adjustment, reference=self.end)
        return portal.universe(rows, self.min_listed_days, self.exclude_flags) if "list_date" in rows.columns else rows.withColumn("in_universe", F.lit(True))

    def prefetch(self) -> FactorData:
        """The same with its panel kept in memory and on disk, for several histories; ``release`` lets it go."""
        return replace(self, panel=self.panel.persist())

    def release(self) -> None:
        self.panel.unpersist()

    def history(self, expressions: dict[str, str]) -> DataFrame:
        """asset, session, in_universe and the expressions from start to end."""
        return masked(self.source(), expressions, "in_universe").where(F.col("session") >= F.lit(self.start)).drop("session_idx")


def combined(frames: dict[str, DataFrame], value: str = "value") -> DataFrame:
    """asset, session and one column for each named frame; a cell that a frame lacks is null there."""
    out = [f.select("asset", "session", F.col(value).alias(name)) for name, f in frames.items()]
    return reduce(lambda a, b: a.join(b, ["asset", "session"], "full_outer"), out)


def missing_sessions(calendar: DataFrame, rows: DataFrame, date: str, start: object, end: object) -> DataFrame:
    """Sessions of the calendar from start to end for which a table has no row."""
    wanted = calendar.where(F.col("session").between(F.lit(start), F.lit(end))).select("session")
    return wanted.join(rows.select(F.col(date).alias("session")).distinct(), "session", "left_anti")


def missing_months(snapshots: DataFrame, first: str, last: str) -> DataFrame:
    """series, month (``YYYYMM``): months of a span, both included, in which a series has no snapshot."""
    span = F.sequence(F.to_date(F.lit(first + "01"), "yyyyMMdd"), F.to_date(F.lit(last + "01"), "yyyyMMdd"), F.expr("interval 1 month"))
    wanted = snapshots.select("series").where(F.col("series").isNotNull()).distinct().select("series", F.explode(F.transform(span, lambda d: F.date_format(d, "yyyyMM"))).alias("month"))
    return wanted.join(snapshots.select("series", F.substring("snapshot", 1, 6).alias("month")).distinct(), ["series", "month"], "left_anti")


def quarter_ends(start: str, end: str) -> list[str]:
    """Report dates (``YYYYMMDD``) between two days, both included."""
    days = [f"{y}{d}" for y in range(int(start[:4]), int(end[:4]) + 1) for d in ("0331", "0630", "0930", "1231")]
    return [d for d in days if start <= d <= end]


def quotas(groups: DataFrame, total: int, by: Sequence[str] = ()) -> DataFrame:
    """Whole places for each group in proportion to its weight: floors first, what is left to the largest remainders
    (ties by group name). ``groups``: group, weight; ``by`` apportions separately."""
    side = Window.partitionBy(*(by or [F.lit(1)]))
    exact = F.try_divide(F.col("weight") * F.lit(total), F.sum("weight").over(side))
    rows = groups.where("weight > 0").withColumn("_x", exact).withColumn("_f", F.floor("_x"))
    left = F.lit(total) - F.sum("_f").over(side)
    place = F.row_number().over(side.orderBy((F.col("_x") - F.col("_f")).desc(), "group"))
    return rows.withColumn("_l", left).withColumn("_p", place).select(*by, "group", (F.col("_f") + (F.col("_p") <= F.col("_l")).cast("int")).cast("int").alias("places"))


def density(values: Sequence[float], points: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian kernel density of a short series (one value a session): where, and how dense."""
    x = np.asarray([v for v in values if v is not None], dtype=float)
    if len(x) < 2 or not np.std(x, ddof=1):
        return np.empty(0), np.empty(0)
    width = 1.06 * np.std(x, ddof=1) * len(x) ** -0.2
    at = np.linspace(x.min() - 3 * width, x.max() + 3 * width, points)
    return at, np.exp(-0.5 * ((at[:, None] - x) / width) ** 2).mean(axis=1) / (width * np.sqrt(2 * np.pi))


def normal_quantiles(values: Sequence[float]) -> list[tuple[float, float]]:
    """Pairs of normal and observed quantiles of a short series."""
    from statistics import NormalDist

    x = sorted(v for v in values if v is not None)
    return [(NormalDist().inv_cdf((i + 0.5) / len(x)), v) for i, v in enumerate(x)]
