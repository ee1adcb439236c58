"""Merging deliveries into tables, and publishing whole generations.

All merges are expressed on DataFrames; a table is written beside the one in force and swapped in, a generation with its
output and tree is published by one rename (``operators.incremental.Generations``), so readers never see half a write.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlgate.functions.normalize import free_name
from marlgate.sources.registry import Table, normalized


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key, the last by ``order`` (nulls first). An aggregate that combines before the shuffle, so a key of many rows sends one a task."""
    name = free_name(df, "_last")
    whole, at = F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*[F.col(f"`{c}`") for c in order])
    return df.groupBy(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(key)]).agg(F.max_by(whole, at).alias(name)).select(f"{name}.*")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """New rows replace old ones of their key; repeats within a side end with the last by ``order``."""
    name = free_name(old, "_load")
    both = old.withColumn(name, F.lit(0)).unionByName(new.withColumn(name, F.lit(1)), allowMissingColumns=True)
    return keep_last(both, key, [name, *order]).drop(name)


def replace_groups(old: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every group that appears in ``new`` (dates, snapshots) is replaced whole; nulls form a group."""
    groups = new.select(*[F.col(c).alias(f"_g_{c}") for c in by]).distinct()
    on = [old[c].eqNullSafe(groups[f"_g_{c}"]) for c in by]
    return old.join(groups, on, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_ranges(old: DataFrame, new: DataFrame, by: str, date: str) -> DataFrame:
    """For each value of ``by``, old rows from the first to the last delivered date give way."""
    span = new.groupBy(F.col(by).alias("_by")).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    kept = old.join(span, (F.col(by) == F.col("_by")) & F.col(date).between(F.col("_a"), F.col("_b")), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def merge_calendar(old: DataFrame, new: DataFrame, end: str | None = None) -> DataFrame:
    """Calendar days of both, those delivered anew instead of the old ones, none after ``end``."""
    merged = upsert(old, new, ["exchange", "cal_date"])
    return merged if end is None else merged.where(F.col("cal_date") <= F.lit(end))


def pruned(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose code is among the allowed ones; a null code isn't."""
    return df.where(F.col(column).isin(list(allowed)))


def write_table(df: DataFrame, spec: Table, folder: str, codec: str = "zstd", rows_a_file: int = 2_000_000) -> str:
    """Normalise, spread by partition and hashed key, sort within, write compressed Parquet beside the table and swap it in.

    A partition is written by as many tasks as its table's rows ask for, not by one. Readers see the old table or the new
    one; what dies before the swap leaves the old one, and ``recover_table`` finishes a swap that died in the middle.
    """
    made = normalized(df, spec)
    parts = [p for p in spec.partition if p in made.columns]
    inside = [c for c in (*spec.key,) if c in made.columns and c not in parts]
    buckets = 1 + made.count() // rows_a_file
    if parts:
        made = made.repartition(*parts, *([F.pmod(F.xxhash64(*inside), F.lit(buckets))] if buckets > 1 and inside else []))
    path = f"{folder.rstrip('/')}/{spec.path}"
    staged = _beside(path, "staged")
    writer = (made.sortWithinPartitions(*parts, *inside) if parts or inside else made).write.mode("overwrite").option("compression", codec).option("maxRecordsPerFile", rows_a_file)
    (writer.partitionBy(*parts) if parts else writer).parquet(staged)
    swap(df.sparkSession, staged, path)
    return path


def _beside(path: str, what: str) -> str:
    folder, _, name = path.rpartition("/")
    return f"{folder}/.{name}-{what}"


def swap(spark: SparkSession, staged: str, path: str) -> None:
    """Put the staged folder in the place of the one in force, which is put back if that fails."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old = _beside(path, "old")
    fs = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(place(old), True)
    had = fs.exists(place(path))
    if had and not fs.rename(place(path), place(old)):
        raise OSError(f"{path} can't be put aside")
    if not fs.rename(place(staged), place(path)):
        if had:
            fs.rename(place(old), place(path))
        raise OSError(f"{staged} can't be published")
    fs.delete(place(old), True)


def recover_table(spark: SparkSession, path: str) -> bool:
    """After a crash: the old table comes back if it was put aside and nothing took its place. True if that was so."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    lost = fs.exists(place(_beside(path, "old"))) and not fs.exists(place(path))
    if lost:
        fs.rename(place(_beside(path, "old")), place(path))
    for what in ("old", "staged"):
        fs.delete(place(_beside(path, what)), True)
    return lost


def _wrapped_sum(value: Column) -> Column:
    """Sum of numbers of 44 bits modulo 2**64. Their halves are summed apart, which can't overflow below 2**41 rows."""
    low, high = F.sum(value.bitwiseAND(0x3FFFFF)), F.sum(F.shiftrightunsigned(value, 22))
    return F.shiftleft(high + F.shiftrightunsigned(low, 22), 22).bitwiseOR(low.bitwiseAND(0x3FFFFF))


def manifest(spark: SparkSession, folder: str, names: Sequence[Table], content: bool = True, most_bytes: int = 1 << 28) -> DataFrame:
    """table_name, path, bytes, rows, digest (of all rows, in any order) and sha256 of every file of a generation.

    Rows and digest come from a split scan, whatever the size of a file; sha256 needs a file whole, so it is null beyond ``most_bytes``.
    """
    frames = []
    for spec in names:
        path = f"{folder.rstrip('/')}/{spec.path}"
        rows = spark.read.parquet(path)
        h = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
        told = rows.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(
            F.count(F.lit(1)).alias("rows"), _wrapped_sum(F.shiftrightunsigned(h, 20)).alias("digest")
        )
        if content:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).where(F.col("length") <= most_bytes)
            told = told.join(files.select("path", F.sha2("content", 256).alias("sha256")), "path", "left")
        else:
            told = told.withColumn("sha256", F.lit(None).cast("string"))
        frames.append(told.select(F.lit(spec.name).alias("table_name"), "path", "bytes", "rows", "digest", "sha256"))
    return reduce(DataFrame.unionByName, frames)


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that are missing, new or different against a manifest: table_name, path, problem."""
    whole = F.struct("bytes", "rows", "digest", "sha256")
    a, b = before.select("path", F.col("table_name").alias("t0"), whole.alias("w0")), after.select("path", F.col("table_name").alias("t1"), whole.alias("w1"))
    problem = F.when(F.col("t1").isNull(), "missing").when(F.col("t0").isNull(), "new").when(~F.col("w0").eqNullSafe(F.col("w1")), "different")
    return a.join(b, "path", "full_outer").select(F.coalesce("t0", "t1").alias("table_name"), "path", problem.alias("problem")).where("problem is not null")


def signature(settings: dict) -> str:
    """A stable name for a run's settings, to resume only the same run."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def resumable(state: dict | None, settings: dict, now: float, hours: float = 24.0) -> bool:
    """Whether an interrupted run, noted as ``{"signature", "started"}``, may go on: the same settings, and not too old."""
    return bool(state) and state.get("signature") == signature(settings) and 0 <= now - state.get("started", float("-inf")) <= hours * 3600


def stable_ids(old: DataFrame, codes: DataFrame, code: str = "ts_code", sid: str = "sid") -> DataFrame:
    """Codes keep their number; new codes get the following ones in code order."""
    fresh = codes.select(code).where(F.col(code).isNotNull()).distinct().join(old.select(code), code, "left_anti")
    top = old.agg(F.coalesce(F.max(sid), F.lit(-1)).alias("top")).first()["top"]
    # only new codes are numbered: master data, not rows
    numbered = fresh.withColumn(sid, (F.row_number().over(Window.orderBy(code)) + F.lit(top)).cast("bigint"))
    return old.select(code, F.col(sid).cast("bigint").alias(sid)).unionByName(numbered)
