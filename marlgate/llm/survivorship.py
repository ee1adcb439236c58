"""The best representative of each duplicate group, built field by field.

One aggregation: for each attribute the maximum of the composite struct (has a value, known day, flag, source order, lowest
row id, value). Partial maxima are formed before the shuffle, so a group that holds a third of all rows shrinks to one row
a task. No group is collected.

Defined results. Rows whose code or end date can't be read are left out; an unreadable report type forms its own group.
A missing effective day comes last. NaN counts as no value. An attribute without any value is null and has no supplier.
Ties end at the lowest row id; a row repeated under one id supplies once. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlgate.functions.normalize import as_number, day_code, digits_of_number, effective_day, market_code, real_day, trimmed

FIGURES = ("basic_eps", "total_revenue", "revenue", "operate_profit", "n_income", "rd_exp")
RECORD = ("ts_code", "end_date", "report_type")


def readable_reports(income: DataFrame) -> DataFrame:
    """Record key in standard form, the order columns and the figures."""
    return income.select(
        market_code("ts_code").alias("ts_code"), day_code("end_date").alias("end_date"), digits_of_number("report_type").alias("report_type"),
        day_code(effective_day("f_ann_date", "ann_date")).alias("known_day"), F.coalesce(trimmed("update_flag") == "1", F.lit(False)).alias("updated"),
        "source_order", "row_id", *[as_number(f).alias(f) for f in FIGURES],
    ).where(F.col("ts_code").isNotNull() & F.col("end_date").isNotNull())


def survivors(rows: DataFrame, keys: list[str], priority: list[str], fields: list[str], row_id: str = "row_id") -> DataFrame:
    """One row per key: ``n_rows`` and for each field a struct (value, row_id) of the row that supplies it, or null.

    ``priority``: columns whose higher value wins, in order; null comes last.
    """
    lead = [F.struct(F.col(p).isNotNull().alias("has"), F.col(p).alias("v")).alias(f"p{i}") for i, p in enumerate(priority)]

    def best(field: str):
        whole = F.struct(F.col(field).isNotNull().alias("has"), *lead, (-F.col(row_id)).alias("row"), F.col(field).alias("value"))
        top = F.max(whole)
        return F.when(top["has"], F.struct(top["value"].alias("value"), (-top["row"]).alias("row_id"))).alias(field)

    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[best(f) for f in fields])


def surviving_reports(income: DataFrame) -> DataFrame:
    """ts_code, end_date, report_type, n_rows and the six figures as structs (value, row_id)."""
    return survivors(readable_reports(income), list(RECORD), ["known_day", "updated", "source_order"], list(FIGURES))


def supplying_rows(income: DataFrame) -> DataFrame:
    """ts_code, end_date, report_type, field_name, row_id for records of two or more rows."""
    several = surviving_reports(income).where("n_rows >= 2")
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}.row_id").alias("row_id")) for f in FIGURES])
    return several.select(*RECORD, F.explode(cells).alias("x")).select(*RECORD, "x.field_name", "x.row_id").where("row_id is not null")
