"""Reading a folder of ``<table>.parquet`` files or folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlgate.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
