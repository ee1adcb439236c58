"""A lake in generations: tables, catalogue of assets, manifest; built beside the one in force and published by one rename.

A build writes the tables it is given and refers to earlier generations for the others. Ids of assets never change. Readers
keep the generation they opened. What dies or fails its checks before the rename leaves the lake as it was; ``roll_back``
puts the generation before in force again, ``recover`` deletes what was never published.

Defined results. A table that was never built can't be read. An asset without a listing day or without bars has nulls there;
one that vanished from the master tables keeps its id. Empty tables are built like others.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgate.operators.incremental import Generations
from marlgate.sources.query import LocalData
from marlgate.sources.registry import TABLES, table_of
from marlgate.sources.writer import changed_files, manifest, stable_ids, write_table

MASTERS, BARS = ("stock_basic", "etf_basic", "index_basic"), ("stock_daily", "etf_daily", "index_daily")
CATALOG = "ts_code string, sid bigint, kind string, list_date string, delist_date string, first_seen string, last_seen string"


class Bundle:
    """One generation, the one in force unless named."""

    def __init__(self, spark: SparkSession, folder: str, name: str | None = None):
        self.spark, self.store = spark, Generations(spark, folder)
        self.name = name or self.store.current()
        if not self.name:
            raise FileNotFoundError(f"nothing is published in {folder}")
        self.holders = {r["table_name"]: r["holder"] for r in self.store.part("holders", self.name).collect()}  # the tables of the registry

    def read(self, table: str) -> DataFrame:
        return self._local(table).read(table)

    def query(self, table: str, **options) -> DataFrame:
        return self._local(table).query(table, **options)

    def register(self, tables: Sequence[str]) -> None:
        for table in tables:
            self.read(table).createOrReplaceTempView(table)

    def catalog(self) -> DataFrame:
        """ts_code, sid, kind, list_date, delist_date, first_seen, last_seen."""
        return self.store.part("catalog", self.name)

    def manifest(self) -> DataFrame:
        return self.store.part("manifest", self.name)

    def problems(self) -> DataFrame:
        """table_name, path, problem: files that differ from the manifest, and ids given twice. None in a sound bundle."""
        now = _manifest(self.spark, self.store.folder, self.holders)
        twice = self.catalog().groupBy("sid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return changed_files(self.manifest(), now).unionByName(twice.select(F.lit("catalog").alias("table_name"), F.col("sid").cast("string").alias("path"), F.lit("id given twice").alias("problem")))

    def _local(self, table: str) -> LocalData:
        if table_of(table).name not in self.holders:
            raise FileNotFoundError(f"{table} was never built")
        return LocalData(self.spark, f"{self.store.folder}/{self.holders[table]}/tables")


def _manifest(spark: SparkSession, folder: str, holders: dict[str, str]) -> DataFrame:
    parts = [manifest(spark, f"{folder}/{holder}/tables", [TABLES[t]]) for t, holder in sorted(holders.items())]
    return reduce(DataFrame.unionByName, parts)


def _catalog(spark: SparkSession, store: Generations, name: str, holders: dict[str, str]) -> DataFrame:
    read = lambda t: LocalData(spark, f"{store.folder}/{holders[t]}/tables").read(t)
    none = F.lit(None).cast("string")
    masters = [
        read(t).select("ts_code", F.lit(t.partition("_")[0]).alias("kind"), *[(F.col(c) if c in TABLES[t].columns else none).alias(c) for c in ("list_date", "delist_date")])
        for t in MASTERS if t in holders
    ]
    known = reduce(DataFrame.unionByName, masters) if masters else spark.createDataFrame([], "ts_code string, kind string, list_date string, delist_date string")
    one = known.where("ts_code is not null").groupBy("ts_code").agg(F.min("kind").alias("kind"), F.min("list_date").alias("list_date"), F.max("delist_date").alias("delist_date"))
    bars = [read(t).groupBy("ts_code").agg(F.min("trade_date").alias("first_seen"), F.max("trade_date").alias("last_seen")) for t in BARS if t in holders]
    seen = reduce(DataFrame.unionByName, bars).groupBy("ts_code").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")) if bars else spark.createDataFrame([], "ts_code string, first_seen string, last_seen string")
    old = store.part("catalog")
    ids = stable_ids(spark.createDataFrame([], "ts_code string, sid bigint") if old is None else old.select("ts_code", "sid"), one)
    return ids.join(one, "ts_code", "left").join(seen, "ts_code", "left").select("ts_code", "sid", "kind", "list_date", "delist_date", "first_seen", "last_seen")


def build_bundle(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> Bundle:
    """Build and publish a generation with the given tables; the others are inherited."""
    store = Generations(spark, folder)
    name, before = store.begin(), store.part("holders")
    for table, frame in tables.items():
        write_table(frame, table_of(table), f"{store.folder}/{name}/tables")
    holders = ({} if before is None else {r["table_name"]: r["holder"] for r in before.collect()}) | dict.fromkeys(tables, name)
    store.write(name, "holders", spark.createDataFrame(sorted(holders.items()), "table_name string, holder string").coalesce(1))
    store.write(name, "catalog", _catalog(spark, store, name, holders))
    fresh = _manifest(spark, store.folder, {t: h for t, h in holders.items() if h == name})
    kept = store.part("manifest")
    store.write(name, "manifest", fresh if kept is None else fresh.unionByName(kept.where(~F.col("table_name").isin(list(tables)))))
    bundle = Bundle(spark, folder, name)
    if bundle.problems().limit(1).count():
        raise ValueError(f"{name} is not sound and isn't published")
    store.publish(name)
    return bundle
