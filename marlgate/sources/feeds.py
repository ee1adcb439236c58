"""Deliveries from outside: staged CSV folders, and paged services through Spark's Python data source interface."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from marlgate.session import cut, exists, small
from marlgate.sources.registry import Table, normalized


def staged_csv(spark: SparkSession, folder: str, spec: Table, buckets: int | None = None) -> DataFrame:
    """CSV files with a header, read as text and brought to the registered types; bad numbers become null, never an error.

    ``buckets`` spreads the rows by the table's first key column, for merges that group by it.
    """
    names = spark.read.option("header", "true").csv(folder).columns
    rows = spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("header", "true").option("enforceSchema", "false").option("pathGlobFilter", "*.csv").csv(folder)
    made = normalized(rows, spec)
    return made.repartition(buckets, spec.key[0]) if buckets else made


def stage_csv(df: DataFrame, folder: str, by: str) -> int:
    """Write rows as CSV, a folder for each value of ``by``, with a ledger of rows and digests; how many values were written.

    A run that is repeated, or resumed after it died, writes only values whose rows aren't in the ledger as they are. Nulls
    form a value of their own. The ledger is written last, so a value is listed only when it is there whole.
    """
    spark = df.sparkSession
    rows = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    told = rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), 20)).alias("digest"))
    ledger = f"{folder.rstrip('/')}/.ledger"
    if exists(spark, ledger):
        told = told.join(spark.read.parquet(ledger).withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")), "left").select(by, told["rows"], told["digest"], (F.col("old_rows").eqNullSafe(told["rows"]) & F.col("old_digest").eqNullSafe(told["digest"])).alias("same"))
    else:
        told = told.withColumn("same", F.lit(False))
    told = cut(told)
    fresh = told.where(~F.col("same")).select(F.col(by).alias("_by"))
    some = fresh.count()
    if some:
        rows.join(small(fresh), F.col(by).eqNullSafe(F.col("_by")), "left_semi").withColumn("_value", F.col(by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("_value").csv(folder)
        listed = told.select(by, F.col("rows").alias("old_rows"), F.col("digest").alias("old_digest"))
        listed.coalesce(1).write.mode("overwrite").parquet(ledger)
    return some


class PagedSource(DataSource):
    """``format("paged")``: rows of a service that delivers pages.

    Options: ``fetch`` ("module:function", called with key, offset and limit, returning a list of tuples), ``keys`` (comma
    list, one partition each), ``schema``, ``limit`` (rows a page), ``attempts``. A page that repeats the one before is an
    error: the service ignores the offset.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return PagedReader(dict(self.options))


class Key(InputPartition):
    pass


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [Key(k) for k in self.options.get("keys", "").split(",") if k]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, function = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), function)
        limit, attempts = int(self.options.get("limit", 1000)), int(self.options.get("attempts", 3))
        offset, before = 0, None
        while True:
            for attempt in range(attempts):
                try:
                    page = list(fetch(partition.value, offset, limit))
                    break
                except OSError:
                    if attempt == attempts - 1:
                        raise
            if page and page == before:
                raise ValueError(f"page at {offset} of {partition.value} repeats the one before")
            yield from map(tuple, page)
            if len(page) < limit:
                return
            offset, before = offset + len(page), page
