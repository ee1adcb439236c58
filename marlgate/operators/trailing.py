"""Rolling totals over trailing periods, days without activity included.

Binary doubling: from the daily values come sums over 2, 4, 8 and 16 days, each from two shifted blocks of half the
length; any window is put together from the blocks of its binary digits. A window of n days costs about log2 n lags
instead of a frame of n rows, and all windows share the blocks.

Rows are reduced to one a record before they meet by stock, so a stock that holds a third of all rows has no more than one
row a calendar day when it is sorted.

Defined results. Rows whose code or day can't be read are left out. Of a record's rows the one with the highest load_id,
then row_id counts (of a row repeated with other values the greater ones). Null or negative volume is zero; a null or non-positive close is no observation. Days before the first
are empty. An average is over the days with an observation, null without any. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlgate.functions.normalize import as_number, day_text, market_code, real_day


def latest_bars(stock_daily: DataFrame) -> DataFrame:
    """ts_code, day (DATE), close, volume of each record's latest row."""
    rows = stock_daily.select(
        market_code("ts_code").alias("ts_code"), real_day("trade_date").alias("day"), as_number("close").alias("close"), as_number("volume").alias("volume"),
        "load_id", "row_id",
    ).where(F.col("ts_code").isNotNull() & F.col("day").isNotNull())
    best = rows.groupBy("ts_code", "day").agg(F.max(F.struct("load_id", "row_id", "close", "volume")).alias("x"))
    return best.select("ts_code", "day", "x.close", "x.volume")


def dense_days(rows: DataFrame, entity: str, day: str, values: list[str], fill: float = 0.0) -> DataFrame:
    """A row for every calendar day from an entity's first to its last; added days hold ``fill``. No join: each row is
    unfolded up to the day before the next one."""
    until = F.coalesce(F.date_sub(F.lead(day).over(Window.partitionBy(entity).orderBy(day)), 1), F.col(day))
    spans = rows.select(entity, day, *values, until.alias("until"))
    days = spans.select(entity, F.posexplode(F.sequence(day, "until")).alias("n", "cal_day"), *values)
    return days.select(entity, "cal_day", *[F.when(F.col("n") == 0, F.col(v)).otherwise(F.lit(fill)).alias(v) for v in values])


def trailing_sums(dense: DataFrame, entity: str, day: str, values: list[str], windows: list[int]) -> DataFrame:
    """Add ``<v>_<n>d`` for each value and window to a frame with one row per entity and day."""
    if min(windows) < 1:
        raise ValueError("a window has at least one day")
    along = Window.partitionBy(entity).orderBy(day)

    def back(name: str, by: int) -> Column:
        return F.col(name) if by == 0 else F.coalesce(F.lag(name, by).over(along), F.lit(0.0))

    block = {v: {1: v} for v in values}
    length = 1
    while length * 2 <= max(windows):
        dense = dense.withColumns({f"_{v}_{length * 2}": back(block[v][length], 0) + back(block[v][length], length) for v in values})
        for v in values:
            block[v][length * 2] = f"_{v}_{length * 2}"
        length *= 2
    sums = {}
    for v in values:
        for n in windows:
            total, done = None, 0
            for size in sorted((s for s in block[v] if n & s), reverse=True):
                piece = back(block[v][size], done)
                total, done = piece if total is None else total + piece, done + size
            sums[f"{v}_{n}d"] = total
    return dense.withColumns(sums).drop(*[name for b in block.values() for size, name in b.items() if size > 1])


def stock_trailing(stock_daily: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """ts_code, cal_day and for each window: volume total, close total, their daily averages over days observed."""
    bars = latest_bars(stock_daily)
    seen = lambda c, ok: F.when(ok, F.col(c)).otherwise(0.0)
    has_volume, has_close = F.coalesce(F.col("volume") >= 0, F.lit(False)), F.coalesce(F.col("close") > 0, F.lit(False))
    values = bars.select(
        "ts_code", "day", seen("volume", has_volume).alias("volume"), has_volume.cast("double").alias("volume_days"),
        seen("close", has_close).alias("close"), has_close.cast("double").alias("close_days"),
    )
    names = ["volume", "volume_days", "close", "close_days"]
    out = trailing_sums(dense_days(values, "ts_code", "day", names), "ts_code", "cal_day", names, list(windows))
    columns = []
    for n in windows:
        columns += [F.round(f"volume_{n}d", 2).alias(f"volume_total_{n}"), F.round(F.try_divide(f"volume_{n}d", f"volume_days_{n}d"), 6).alias(f"volume_average_{n}")]
        columns += [F.round(f"close_{n}d", 4).alias(f"close_total_{n}"), F.round(F.try_divide(f"close_{n}d", f"close_days_{n}d"), 6).alias(f"close_average_{n}")]
    return out.select("ts_code", day_text(F.col("cal_day")).alias("cal_day"), *columns)


def idle_days(stock_daily: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """ts_code, cal_day, window_days: days whose trailing total volume is zero."""
    bars = latest_bars(stock_daily).select("ts_code", "day", F.greatest(F.coalesce("volume", F.lit(0.0)), F.lit(0.0)).alias("volume"))
    sums = trailing_sums(dense_days(bars, "ts_code", "day", ["volume"]), "ts_code", "cal_day", ["volume"], list(windows))
    idle = F.array_compact(F.array(*[F.when(F.col(f"volume_{n}d") == 0, F.lit(n)) for n in windows]))
    return sums.select("ts_code", day_text(F.col("cal_day")).alias("cal_day"), F.explode(idle).alias("window_days"))
