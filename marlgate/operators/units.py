"""Quantities recorded in different units: find the unit, convert to the common one.

A multi-pattern automaton (Aho-Corasick) finds unit aliases in the text of a figure or in its unit column; the longest
match wins, the field decides between meanings ("万" is money in an amount field). The unit's factor comes from a
broadcast join with the factor table; figures without a unit take the one their feed states for the day, unless the row's
own prices contradict it.

The automaton only sees texts that hold more than a plain number: plain numbers are read by JVM expressions.

Defined results. Null, empty and numberless text ("N/A", "--") give a null number and no power. Zero has a power but is
no case. An unknown unit leaves the figure as unlabelled; where no unit is stated for
a feed and day, or none that can be read (``stated_units`` lists those), nothing differs from it. Repeated rows are judged row by row. Of periods
that overlap in feed_units the one that began last holds. Extra columns are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlgate.functions.normalize import as_number, day_text, real_day, trimmed
from marlgate.session import small

# Customary unit aliases by field kind, with the power of ten to shares or yuan.
VOLUME_UNITS = {
    "share": (0, ("share", "shares", "sh", "shs", "股")),
    "lot": (2, ("lot", "lots", "手")),
    "thousand shares": (3, ("thousand shares", "k shares", "k shs", "千股")),
    "ten thousand shares": (4, ("ten thousand shares", "10k shares", "x10^4 shares", "万股", "万")),
    "million shares": (6, ("million shares", "million shs", "mn shares", "m shares", "百万股")),
    "ten thousand lots": (6, ("ten thousand lots", "10k lots", "万手")),
    "hundred million shares": (8, ("hundred million shares", "100mn shares", "亿股", "亿")),
}
MONEY_UNITS = {
    "yuan": (0, ("yuan", "cny", "rmb", "元")),
    "thousand yuan": (3, ("thousand yuan", "k cny", "k yuan", "rmb '000", "cny '000", "千元")),
    "ten thousand yuan": (4, ("ten thousand yuan", "10k yuan", "10k cny", "cny x10^4", "rmb x10^4", "万元", "万")),
    "million yuan": (6, ("million yuan", "m yuan", "mn cny", "mn yuan", "rmb million", "cny million", "百万元")),
    "hundred million yuan": (8, ("hundred million yuan", "100mn yuan", "100mn cny", "亿元", "亿")),
}
UNITS = {"volume": VOLUME_UNITS, "money": MONEY_UNITS}
PLAIN_NUMBER = r"^[+-]?(\d+|\d{1,3}(,\d{3})+)?(\.\d*)?([eE][+-]?\d+)?$"
NUMBER = re.compile(r"[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)?(?:\.\d+)?(?:e[+-]?\d+)?")


def factor_table(spark) -> DataFrame:
    """(kind, unit_name, pow10): one row per unit, a fixed size."""
    rows = [(kind, name, power) for kind, units in UNITS.items() for name, (power, _) in units.items()]
    return spark.createDataFrame(rows, "kind string, unit_name string, pow10 int")


class UnitFinder:
    """The automaton of one field kind."""

    def __init__(self, kind: str):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for name, (_, aliases) in UNITS[kind].items():
            for alias in aliases:
                self.automaton.add_word(alias, (len(alias), name))
        self.automaton.make_automaton()
        self.known: dict[str, tuple[float | None, str | None]] = {}

    @staticmethod
    def flat(text: str) -> str:
        return " ".join(unicodedata.normalize("NFKC", text).replace("’", "'").lower().split())

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Alias matches that don't cut a word, longest first and without overlap."""
        found = []
        for end, (length, name) in self.automaton.iter(text):
            start, stop = end + 1 - length, end + 1
            cut = text[start].isascii() and text[start].isalpha() and start and text[start - 1].isascii() and text[start - 1].isalpha()
            cut |= text[end].isascii() and text[end].isalpha() and stop < len(text) and text[stop].isascii() and text[stop].isalpha()
            cut |= text[start].isdigit() and start and text[start - 1] in "0123456789.,"
            if not cut:
                found.append((start, stop, name))
        found.sort(key=lambda m: (m[0] - m[1], m[0]))
        kept: list[tuple[int, int, str]] = []
        for m in found:
            if all(m[1] <= k[0] or m[0] >= k[1] for k in kept):
                kept.append(m)
        return kept

    def read(self, text: str) -> tuple[float | None, str | None]:
        """The number and the unit that stand nearest to each other; either may be missing. Without a unit the first number counts."""
        flat = self.flat(text)
        spans = self.spans(flat)
        rest = list(flat)
        for a, b, _ in spans:
            rest[a:b] = " " * (b - a)
        numbers = [m for m in NUMBER.finditer("".join(rest)) if any(ch.isdigit() for ch in m.group())]
        if not numbers:
            return None, spans[0][2] if spans else None
        pairs = [(max(s[0] - m.end(), m.start() - s[1]), m.start(), s[0], m, s[2]) for m in numbers for s in spans]
        _, _, _, number, unit = min(pairs, key=lambda p: p[:3], default=(0, 0, 0, numbers[0], None))
        return float(number.group().replace(",", "")), unit

    def cached(self, text: str) -> tuple[float | None, str | None]:
        if len(self.known) > 200_000:
            self.known.clear()
        if text not in self.known:
            self.known[text] = self.read(text)
        return self.known[text]


def _reader(kinds: list[str]):
    """One function for all figures of a row: texts and unit texts in turn, out come numbers and unit names in turn."""
    schema = T.StructType([f for i in range(len(kinds)) for f in (T.StructField(f"number{i}", T.DoubleType()), T.StructField(f"unit{i}", T.StringType()))])

    @F.pandas_udf(schema)
    def read(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        finders = [UnitFinder(kind) for kind in kinds]
        for batch in batches:
            out = {}
            for i, finder in enumerate(finders):
                texts, units = batch[2 * i], batch[2 * i + 1]
                numbers, names = np.full(len(texts), np.nan), np.full(len(texts), None, dtype=object)
                for j in np.flatnonzero((texts.notna() | units.notna()).to_numpy()):
                    text, unit = texts.iat[j], units.iat[j]
                    if text is not None:
                        number, names[j] = finder.cached(text)
                        numbers[j] = np.nan if number is None else number
                    if names[j] is None and unit is not None:
                        names[j] = finder.cached(unit)[1]
                out |= {f"number{i}": numbers, f"unit{i}": names}
            yield pd.DataFrame(out)

    return read


def read_figures(df: DataFrame, figures: dict[str, tuple[str, str, str | None]]) -> DataFrame:
    """Add ``<out>_number`` and ``<out>_pow`` for each ``out: (kind, text column, unit column)``.

    ``_pow`` is the power of ten of the unit named in the row, null without one.
    """
    args, plains = [], {}
    for out, (_, text, unit) in figures.items():
        value = trimmed(text)
        unit_text = trimmed(unit) if unit else F.lit(None).cast("string")
        plains[out] = F.coalesce(value.rlike(PLAIN_NUMBER), F.lit(True))
        args += [F.when(~plains[out], value), F.when(unit_text != "", unit_text)]
    df = df.withColumn("figures_found", _reader([kind for kind, _, _ in figures.values()])(*args))
    factors = factor_table(df.sparkSession)
    for i, (out, (kind, text, _)) in enumerate(figures.items()):
        df = df.withColumn(
            f"{out}_number",
            F.when(plains[out], F.regexp_replace(trimmed(text), ",", "").try_cast("double")).otherwise(as_number(F.col(f"figures_found.number{i}"))),
        )
        own = factors.where(F.col("kind") == kind).select(F.col("unit_name").alias(f"{out}_unit_name"), F.col("pow10").alias(f"{out}_pow"))
        df = df.join(F.broadcast(own), F.col(f"figures_found.unit{i}") == F.col(f"{out}_unit_name"), "left").drop(f"{out}_unit_name")
    return df.drop("figures_found")


def stated_powers(feed_units: DataFrame) -> DataFrame:
    """feed_units with the power of each stated unit: (s_feed, s_asset, s_field, s_from, s_until, s_pow).

    The automaton reads the stated texts too, in any of their aliases. A text it can't read keeps its row, with a null power.
    """
    nothing, unit = F.lit(None).cast("string"), F.when(trimmed("unit_text") != "", trimmed("unit_text"))
    found = _reader(["volume", "money"])(nothing, unit, nothing, unit)
    kind = F.when(F.col("field_name") == "vol", "volume").when(F.col("field_name") == "amount", "money")
    read = feed_units.select(
        F.col("feed").alias("s_feed"), F.col("asset_type").alias("s_asset"), F.col("field_name").alias("s_field"),
        F.coalesce(real_day("valid_from"), F.lit("0001-01-01").cast("date")).alias("s_from"),
        F.coalesce(real_day("valid_until"), F.lit("9999-12-31").cast("date")).alias("s_until"), kind.alias("s_kind"), found.alias("found"),
    )
    unit_of = F.when(F.col("s_kind") == "volume", F.col("found.unit0")).when(F.col("s_kind") == "money", F.col("found.unit1"))
    both = factor_table(feed_units.sparkSession)
    return read.withColumn("s_unit", unit_of).join(F.broadcast(both), (F.col("s_kind") == F.col("kind")) & (F.col("s_unit") == F.col("unit_name")), "left").select(
        "s_feed", "s_asset", "s_field", "s_from", "s_until", F.col("pow10").alias("s_pow")
    )


def stated_units(feed_units: DataFrame) -> DataFrame:
    """feed, asset_type, field_name, valid_from (text), pow10, readable: what each period states; unreadable units are reported, not dropped."""
    return stated_powers(feed_units).select(
        F.col("s_feed").alias("feed"), F.col("s_asset").alias("asset_type"), F.col("s_field").alias("field_name"), day_text(F.col("s_from")).alias("valid_from"),
        F.col("s_pow").alias("pow10"), F.col("s_pow").isNotNull().alias("readable"),
    )


def own_price(*names: str) -> Column:
    """The median of the row's own positive prices (of four: the lower middle)."""
    prices = F.array_sort(F.filter(F.array(*[F.col(n).cast("double") for n in names]), lambda x: (x > 0) & ~F.isnan(x)))
    return F.when(F.size(prices) > 0, F.element_at(prices, F.floor((F.size(prices) + 1) / 2).cast("int")))


def off_by(money: Column, volume: Column, price: Column) -> Column:
    """The power of ten by which money per share departs from the price; null where it can't be told."""
    ok = (F.abs(money) > 0) & (F.abs(volume) > 0) & (price > 0)
    return F.when(ok, F.round(F.log10(F.abs(money)) - F.log10(F.abs(volume)) - F.log10(price)).cast("int"))


@dataclass(frozen=True)
class Customary:
    """Units an unlabelled figure may have instead of the stated one."""

    volume: tuple[int, ...] = (0, 2)
    money: tuple[int, ...] = (0, 3, 4)


def resolve_feed_units(daily: DataFrame, feed_units: DataFrame, customary: Customary = Customary()) -> DataFrame:
    """One row per row of ``daily``: row_id, vol and amount as numbers, stated and actual powers of ten.

    Columns: row_id, vol_number, amount_number, vol_stated, amount_stated, vol_pow10, amount_pow10. Index volume counts in
    lots, so its powers are two less. Where both readings of a departure are possible the volume is taken as off.
    """
    base = daily.select(
        "row_id", "feed", "asset_type", real_day("trade_date").alias("day"), own_price("open", "high", "low", "close").alias("price"),
        "vol", "vol_unit", "amount", "amount_unit",
    )
    read = read_figures(base, {"vol": ("volume", "vol", "vol_unit"), "amount": ("money", "amount", "amount_unit")})
    stated = stated_powers(feed_units)
    for field in ("vol", "amount"):
        # the periods of a feed's field as one array: a figure meets one stated unit, however often it is stated
        periods = stated.where(F.col("s_field") == field).groupBy("s_feed", "s_asset").agg(
            F.sort_array(F.collect_list(F.struct("s_from", "s_until", "s_pow")), asc=False).alias("periods")
        )
        valid = F.filter("periods", lambda p: (p["s_from"] <= F.col("day")) & (F.col("day") < p["s_until"]))
        read = read.join(small(periods), (F.col("feed") == F.col("s_feed")) & (F.col("asset_type") == F.col("s_asset")), "left").withColumn(
            f"{field}_says", F.get(valid, 0)["s_pow"]
        ).drop("s_feed", "s_asset", "periods")
    v, a = F.coalesce("vol_pow", "vol_says"), F.coalesce("amount_pow", "amount_says")
    # money over volume times price is ten to the off-th: either the volume's power rises by it, or the money's falls by it
    k = F.when(F.col("asset_type") != "index", off_by(F.col("amount_number"), F.col("vol_number"), F.col("price")) + a - v)
    vol_moves = F.col("vol_pow").isNull() & (v + k).isin(*customary.volume)
    amount_moves = F.col("amount_pow").isNull() & (a - k).isin(*customary.money)
    moved = read.withColumn("off", k).withColumn("vol_off", F.coalesce((F.col("off") != 0) & vol_moves, F.lit(False))).withColumn(
        "amount_off", F.coalesce((F.col("off") != 0) & amount_moves, F.lit(False)) & ~F.col("vol_off")
    )
    lots = F.when(F.col("asset_type") == "index", 2).otherwise(0)
    return moved.select(
        "row_id", "vol_number", "amount_number",
        (F.col("vol_says") - lots).alias("vol_stated"), F.col("amount_says").alias("amount_stated"),
        (F.when(F.col("vol_off"), v + F.col("off")).otherwise(v) - lots).alias("vol_pow10"),
        F.when(F.col("amount_off"), a - F.col("off")).otherwise(a).alias("amount_pow10"),
    )


# Departures of money per share from the price, and what is off then (power of volume, power of money).
BAR_DEPARTURES = {2: (2, 0), 4: (4, 0), -3: (0, 3), -4: (0, 4), -8: (0, 8), -1: (2, 3)}


def resolve_bar_units(bars: DataFrame, volume: str = "volume", money: str = "turnover") -> DataFrame:
    """row_id, both figures and their powers of ten to shares and yuan, judged by the bar's own prices; the departures of
    ``BAR_DEPARTURES`` are joined as a broadcast factor table. A figure without its counterpart counts as recorded."""
    base = bars.select("row_id", as_number(volume).alias("volume_number"), as_number(money).alias("turnover_number"), own_price("open", "high", "low", "close").alias("price"))
    departures = bars.sparkSession.createDataFrame([(k, *v) for k, v in BAR_DEPARTURES.items()], "departure int, volume_by int, turnover_by int")
    return (
        base.withColumn("off", off_by(F.col("turnover_number"), F.col("volume_number"), F.col("price")))
        .join(F.broadcast(departures), F.col("off") == F.col("departure"), "left")
        .select("row_id", "volume_number", "turnover_number", F.coalesce("volume_by", F.lit(0)).alias("volume_pow10"), F.coalesce("turnover_by", F.lit(0)).alias("turnover_pow10"))
    )


def _unfold(df: DataFrame, src: str, fields: dict[str, tuple[str, str, Column]]) -> DataFrame:
    cells = [
        F.struct(F.lit(name).alias("field_name"), F.col(number).alias("number"), F.col(power).cast("int").alias("pow10"), stated.cast("int").alias("stated"))
        for name, (number, power, stated) in fields.items()
    ]
    return df.select(F.lit(src).alias("src_table"), "row_id", F.explode(F.array(*cells)).alias("x")).select("src_table", "row_id", "x.*")


def figures_with_powers(daily: DataFrame, stock_daily: DataFrame, feed_units: DataFrame) -> DataFrame:
    """Every figure of both tables: src_table, row_id, field_name, number, pow10, stated."""
    fed = resolve_feed_units(daily, feed_units)
    bars = resolve_bar_units(stock_daily)
    return _unfold(fed, "daily", {
        "vol": ("vol_number", "vol_pow10", F.col("vol_stated")), "amount": ("amount_number", "amount_pow10", F.col("amount_stated")),
    }).unionByName(_unfold(bars, "stock_daily", {
        "volume": ("volume_number", "volume_pow10", F.lit(0)), "turnover": ("turnover_number", "turnover_pow10", F.lit(0)),
    }))


def unit_cases(daily: DataFrame, stock_daily: DataFrame, feed_units: DataFrame) -> DataFrame:
    """src_table, row_id, field_name, pow10: figures whose unit differs in scale from the stated one."""
    return figures_with_powers(daily, stock_daily, feed_units).where(
        (F.col("number") != 0) & (F.col("pow10") != F.col("stated"))
    ).select("src_table", "row_id", "field_name", "pow10")


def converted(daily: DataFrame, stock_daily: DataFrame, feed_units: DataFrame) -> DataFrame:
    """Every figure in common units: src_table, row_id, field_name, common_value (null where the figure is no number)."""
    # a division by an exact power of ten rounds once, a product with 0.01 twice
    ten = lambda p: F.pow(F.lit(10.0), p)
    value = F.when(F.col("pow10") >= 0, F.col("number") * ten(F.col("pow10"))).when(F.col("pow10") < 0, F.col("number") / ten(-F.col("pow10")))
    return figures_with_powers(daily, stock_daily, feed_units).select("src_table", "row_id", "field_name", value.alias("common_value"))
