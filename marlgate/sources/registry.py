"""The table registry: schemas, keys and partitions of the market lake, declared, never inferred."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlgate.functions.normalize import BLANKS


@dataclass(frozen=True)
class Table:
    """``open_measures``: columns beyond the declared ones are kept as doubles (wide statements)."""

    name: str
    path: str
    texts: tuple[str, ...]
    measures: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    date_column: str | None = None
    partition: tuple[str, ...] = ()
    sparse: bool = False
    whole: tuple[str, ...] = field(default=())
    open_measures: bool = False

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.texts, *self.measures, *self.whole)

    def schema(self) -> T.StructType:
        kinds = {**dict.fromkeys(self.texts, T.StringType()), **dict.fromkeys(self.measures, T.DoubleType()), **dict.fromkeys(self.whole, T.LongType())}
        return T.StructType([T.StructField(c, kinds[c]) for c in self.columns])


def _t(name: str, path: str, texts: str, measures: str = "", key: str = "", date: str | None = None, partition: str = "", **more) -> Table:
    return Table(name, path, tuple(texts.split()), tuple(measures.split()), tuple(key.split()), date, tuple(partition.split()), **more)


_BAR = "open high low close pre_close volume turnover"
_DAY = {"texts": "trade_date ts_code", "key": "ts_code trade_date", "date": "trade_date", "partition": "year"}
_SIZES = ("sm", "md", "lg", "elg")
_REPORT = "ts_code ann_date f_ann_date effective_ann_date end_date report_type comp_type end_type update_flag"
_REPORT_KEY = "ts_code ann_date f_ann_date end_date report_type comp_type end_type update_flag"
_STATEMENT = {"key": _REPORT_KEY, "date": "end_date", "partition": "report_year", "sparse": True, "whole": ("source_order",), "open_measures": True}

# Names of tables and columns, as users of such a lake write them in queries.
TABLES: dict[str, Table] = {t.name: t for t in (
    _t("trade_cal", "stock/trade_cal", "exchange cal_date pretrade_date", "", "exchange cal_date", "cal_date", "exchange", whole=("is_open",)),
    _t("stock_basic", "stock/basic", "ts_code symbol name area industry fullname enname cnspell market exchange curr_type list_status list_date delist_date is_hs act_name act_ent_type", key="ts_code"),
    _t("etf_basic", "etf/basic", "ts_code csname extname cname index_code index_name setup_date list_date list_status exchange mgr_name custod_name etf_type", "mgt_fee", "ts_code"),
    _t("index_basic", "index/basic", "ts_code name fullname market publisher index_type category base_date list_date weight_rule desc exp_date", "base_point", "ts_code"),
    _t("stock_daily", "stock/daily", measures=_BAR, **_DAY),
    _t("etf_daily", "etf/daily", measures=_BAR, **_DAY),
    _t("index_daily", "index/daily", measures=_BAR, **_DAY, sparse=True),
    _t("adj_factor", "stock/adj_factor", measures="adj_factor", **_DAY),
    _t("etf_adj_factor", "etf/adj_factor", measures="adj_factor", **_DAY),
    _t("daily_basic", "stock/daily_basic", measures="close turnover_rate turnover_rate_f volume_ratio pe pe_ttm pb ps ps_ttm dv_ratio dv_ttm total_share float_share free_share total_mv circ_mv limit_status", **_DAY, sparse=True),
    _t("moneyflow", "stock/moneyflow", measures=" ".join(f"{side}_{s}_{what}" for s in _SIZES for side in ("buy", "sell") for what in ("vol", "amount")) + " net_mf_vol net_mf_amount", **_DAY, sparse=True),
    _t("stk_limit", "stock/stk_limit", measures="pre_close up_limit down_limit", **_DAY, sparse=True),
    _t("suspend_d", "stock/suspend_d", "trade_date ts_code suspend_timing suspend_type", "", "ts_code trade_date suspend_type", "trade_date", "year", sparse=True),
    _t("stock_st", "stock/stock_st", "trade_date ts_code name type type_name", "", "ts_code trade_date type", "trade_date", "year", sparse=True),
    _t("industry", "stock/industry", "trade_date ts_code " + " ".join(f"l{n}_{what}" for n in (1, 2, 3) for what in ("code", "name")), "", "ts_code trade_date", "trade_date", "year", sparse=True),
    _t("index_weight", "index/weight", "index_code con_code trade_date", "weight", "index_code trade_date con_code", "trade_date", "index_code year", sparse=True),
    _t("balancesheet", "stock/finance/balancesheet", _REPORT, **_STATEMENT),
    _t("income", "stock/finance/income", _REPORT, **_STATEMENT),
    _t("cashflow", "stock/finance/cashflow", _REPORT, **_STATEMENT),
    _t("fina_indicator", "stock/finance/fina_indicator", "ts_code ann_date f_ann_date effective_ann_date end_date update_flag", **{**_STATEMENT, "key": "ts_code ann_date end_date update_flag"}),
)}
ROLES = {"daily": ("stock_daily", "etf_daily"), "adj_factor": ("adj_factor", "etf_adj_factor")}


def table_of(name: str) -> Table:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}; known: {', '.join(sorted(TABLES))}")
    return TABLES[name]


def normalized(df: DataFrame, spec: Table) -> DataFrame:
    """Declared columns in declared types: missing ones null, text trimmed with blank as null, unreadable numbers null,
    missing whole numbers zero. Partition columns are derived. Columns not declared are dropped unless the table is open."""
    have = {c.lower(): c for c in df.columns}
    empty = F.lit(None).cast("string")
    text = lambda c: F.nullif(F.btrim(F.col(f"`{have[c]}`").cast("string"), F.lit(BLANKS)), F.lit("")) if c in have else empty

    def measure(c: str):
        value = F.col(f"`{have[c]}`").try_cast("double") if c in have else empty.cast("double")
        return F.when(~F.isnan(value), value)

    out = {c: text(c) for c in spec.texts} | {c: measure(c) for c in spec.measures}
    out |= {c: F.coalesce(F.col(f"`{have[c]}`").try_cast("bigint") if c in have else empty.cast("bigint"), F.lit(0).cast("bigint")) for c in spec.whole}
    if spec.open_measures:
        out |= {c: measure(c) for c in sorted(set(have) - set(out) - set(spec.partition))}
    made = df.select(*[v.alias(k) for k, v in out.items()])
    if "effective_ann_date" in spec.texts and "effective_ann_date" not in have:
        known = F.when(F.coalesce(F.col("f_ann_date"), F.lit("0")) != "0", F.col("f_ann_date")).otherwise(F.col("ann_date"))
        made = made.withColumn("effective_ann_date", known)
    for p in spec.partition:
        if p in ("year", "report_year"):
            made = made.withColumn(p, F.substring(spec.date_column, 1, 4).try_cast("int"))
    return made


def available_fields(prefix: bool = True) -> list[str]:
    """Every measure of every table, as an expression names it: bare for bars, ``table.field`` for the others."""
    bare = set(ROLES["daily"])
    return sorted({c if t.name in bare or not prefix else f"{t.name}.{c}" for t in TABLES.values() for c in t.measures})
