"""The profile of every column of the large tables, with ranges, and SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlgate.operators import profile
from marlgate.sources.testbed import table

Query = Callable[[SparkSession, str], DataFrame]

# column names, those of numbers after the bar
COLUMNS = {
    "stock_daily": "trade_date ts_code loaded_at | row_id open high low close pre_close volume turnover load_id",
    "income": "ts_code ann_date f_ann_date end_date report_type comp_type end_type update_flag | row_id basic_eps total_revenue revenue operate_profit n_income rd_exp source_order load_id",
    "daily": "feed asset_type ts_code trade_date vol vol_unit amount amount_unit received_at | row_id open high low close pre_close pct_chg",
    "documents": "text lang source mailbox message_id in_reply_to subject date_raw sent_at | doc_id n_chars",
    "index_weight": "index_code con_code snapshot_date | weight delivery source_order",
    "positions": "trade_date record_type ts_code index_code | position_id quantity market_value weight asset_return",
}


def ranges(source: DataFrame, name: str) -> DataFrame:
    """src_table, column_name, n_rows, n_null, n_distinct, low and high (null for numbers), low_number and high_number."""
    number = F.col("column_name").isin([f.name for f in source.schema.fields if isinstance(f.dataType, T.NumericType)])
    return profile.column_profile(source, name).select(
        "src_table", "column_name", "n_rows", "n_null", "n_distinct",
        *[F.when(~number, F.col(x)).alias(x) for x in ("low", "high")], *[F.when(number, F.col(x).cast("double")).alias(f"{x}_number") for x in ("low", "high")],
    )


def queries() -> dict[str, Query]:
    return {"p7_profile": lambda spark, folder: reduce(DataFrame.unionByName, [ranges(table(spark, folder, name), name) for name in COLUMNS])}


def oracle_sql() -> dict[str, str]:
    def side(name: str, c: str, is_number: bool) -> str:
        low, high = (f"CAST({f}({c}) AS {'DOUBLE' if is_number else 'VARCHAR'})" for f in ("min", "max"))
        text, number = (("CAST(NULL AS VARCHAR)",) * 2, (low, high)) if is_number else ((low, high), ("CAST(NULL AS DOUBLE)",) * 2)
        return (
            f"SELECT '{name}' AS src_table, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, "
            f"{text[0]} AS low, {text[1]} AS high, {number[0]} AS low_number, {number[1]} AS high_number FROM {name}"
        )

    return {"p7_profile": " UNION ALL ".join(side(name, c, i == 1) for name, both in COLUMNS.items() for i, part in enumerate(both.split("|")) for c in part.split())}
