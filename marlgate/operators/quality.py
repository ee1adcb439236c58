"""The declarative rule engine: every rule of a registered table is a filter, a group or an anti join, and all findings
have one form. Samples are five rows a rule, as a report shows them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgate.functions.normalize import blank, eight_digit_day
from marlgate.sources.registry import Table

FAIL, WARN, PASS = "fail", "warn", "pass"
FINDING = "table_name string, rule string, severity string, count bigint"


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    broken: Column


def row_rules(spec: Table, columns: Sequence[str]) -> list[Rule]:
    """Rules that look at one row, as far as the table has the columns."""
    have, out = set(columns), []
    key = ("ts_code", "ann_date", "end_date") if spec.open_measures else spec.key
    c = F.col
    if key and have >= set(key):
        out.append(Rule("null_primary_key", FAIL, _any([blank(k) for k in key])))
    if spec.date_column in have:
        out.append(Rule("valid_date", FAIL, ~blank(spec.date_column) & ~eight_digit_day(spec.date_column)))
        if "year" in have:
            out.append(Rule("partition_matches_date", FAIL, F.coalesce(c("year").cast("string") != F.substring(spec.date_column, 1, 4), F.lit(False))))
    if have >= {"open", "high", "low", "close"}:
        prices = [c(x) for x in ("open", "high", "low", "close")]
        out.append(Rule("ohlc_domain", WARN, _any([p <= 0 for p in prices] + [c("high") < p for p in (c("open"), c("close"), c("low"))] + [c("low") > p for p in (c("open"), c("close"))])))
    if have & {"volume", "turnover"}:
        out.append(Rule("nonnegative_activity", FAIL, _any([c(x) < 0 for x in ("volume", "turnover") if x in have])))
    if "adj_factor" in have:
        out.append(Rule("positive_adjustment_factor", FAIL, F.coalesce(c("adj_factor") <= 0, F.lit(True))))
    if have >= {"up_limit", "down_limit"}:
        out.append(Rule("limit_domain", WARN, _any([c("up_limit") <= 0, c("down_limit") <= 0, c("down_limit") > c("up_limit")])))
    if spec.name == "index_weight" and "weight" in have:
        out.append(Rule("weight_domain", FAIL, F.coalesce((c("weight") < 0) | (c("weight") > 100), F.lit(True))))
    if have >= {"effective_ann_date", "end_date"}:
        out.append(Rule("finance_pit_dates", WARN, F.coalesce(c("effective_ann_date") < c("end_date"), F.lit(True))))
    return out


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for x in conditions:
        out = out | F.coalesce(x, F.lit(False))
    return out


def row_findings(df: DataFrame, spec: Table) -> DataFrame:
    """All row rules in one scan."""
    rules = row_rules(spec, df.columns)
    counts = df.agg(*[F.count_if(r.broken).alias(f"r{i}") for i, r in enumerate(rules)])
    cells = F.array(*[F.struct(F.lit(spec.name).alias("table_name"), F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col(f"r{i}").alias("count")) for i, r in enumerate(rules)])
    return counts.select(F.explode(cells).alias("x")).select("x.*")


def duplicate_keys(df: DataFrame, spec: Table) -> DataFrame:
    """Rows beyond the first of each key."""
    extra = df.groupBy(*spec.key).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("count"))
    return extra.select(F.lit(spec.name).alias("table_name"), F.lit("duplicate_primary_key").alias("rule"), F.lit(FAIL).alias("severity"), "count")


def missing_columns(df: DataFrame, spec: Table) -> list[str]:
    return [c for c in spec.columns if c not in df.columns]


def partial_nulls(df: DataFrame, name: str) -> DataFrame:
    """table_name, column_name, nulls: columns that are null in some rows but not in all."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(df.columns)])
    return counts.select("_rows", F.explode(cells).alias("x")).where("x.nulls > 0 and x.nulls < _rows").select(F.lit(name).alias("table_name"), "x.*")


def weight_sums(df: DataFrame, series: str, day: str, low: float = 95.0, high: float = 105.0) -> DataFrame:
    """Snapshots whose weights add up to less than ``low`` or more than ``high``."""
    return df.groupBy(series, day).agg(F.sum("weight").alias("total")).where((F.col("total") < low) | (F.col("total") > high))


def orphans(df: DataFrame, master: DataFrame, column: str, master_column: str) -> DataFrame:
    """Values of a column that the master table doesn't have, with their rows."""
    rows = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return rows.join(master.select(F.col(master_column).alias("value")).distinct(), "value", "left_anti")


def uncovered(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys of one daily table that the other one lacks."""
    return df.select(*on).distinct().join(other.select(*on), list(on), "left_anti")


def sample(df: DataFrame, rule: Rule, rows: int = 5) -> DataFrame:
    """The first rows that break a rule, for a report."""
    return df.where(F.coalesce(rule.broken, F.lit(False))).limit(rows)


def status(findings: DataFrame) -> DataFrame:
    """table_name, status: fail before warn before pass."""
    broken = lambda s: F.max(((F.col("severity") == s) & (F.col("count") > 0)).cast("int")) == 1
    return findings.groupBy("table_name").agg(F.when(broken(FAIL), FAIL).when(broken(WARN), WARN).otherwise(PASS).alias("status"))


def unreadable_tables(spark: SparkSession, folder: str, specs: Sequence[Table]) -> DataFrame:
    """One finding a table: 1 where its files are missing or no Parquet, 0 where they can be read (checked by their footers)."""
    rows = []
    for spec in specs:
        try:
            spark.read.parquet(f"{folder.rstrip('/')}/{spec.path}").limit(1).count()
            rows.append((spec.name, "readable_table", FAIL, 0))
        except Exception:  # noqa: BLE001 whatever the reader raises, the table can't be read
            rows.append((spec.name, "readable_table", FAIL, 1))
    return spark.createDataFrame(rows, "table_name string, rule string, severity string, count bigint")


def write_report(findings: DataFrame, folder: str) -> None:
    """Findings and the tables' status as CSV and JSON folders; both are small."""
    for name, frame in (("findings", findings), ("status", status(findings))):
        one = frame.coalesce(1)
        one.write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/{name}.csv")
        one.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}.json")
