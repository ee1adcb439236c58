"""Structured Streaming: deliveries that arrive as files, and event windows with late data.

Batch and stream share their code: what a micro-batch does to a table is an operator on DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlgate.session import cut, exists, small
from marlgate.sources.writer import keep_last, upsert


def file_stream(spark: SparkSession, folder: str, schema, files_a_batch: int = 100) -> DataFrame:
    """Parquet files as they arrive; the schema is declared, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def event_windows(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "7 days", by: Sequence[str] = ("event_type",)) -> DataFrame:
    """window_start, keys, n, total over event time; works on streams and on tables.

    Events later than ``late`` behind the newest are dropped by a stream; a table has no late events.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions_of(events: DataFrame, gap: str = "30 minutes", late: str = "7 days") -> DataFrame:
    """user_id, session_start, session_end, n: events of a user with less than ``gap`` between them."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_of(events: DataFrame, key: Sequence[str], late: str = "7 days") -> DataFrame:
    """Each key once, as its first row arrives; state is kept for the watermark's length."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(list(key)) if events.isStreaming else events.dropDuplicates(list(key))


def upsert_stream(stream: DataFrame, read: Callable[[], DataFrame | None], publish: Callable[[DataFrame], object], key: Sequence[str], order: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Keep a table at the last row of each key. ``publish`` replaces the table whole (one rename), so a micro-batch that is
    repeated after a failure gives the same table."""

    def merge(batch: DataFrame, batch_id: int) -> None:  # noqa: ARG001
        old = read()
        publish(batch if old is None else upsert(old, batch, key, order))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_partitions(stream: DataFrame, path: str, part: str, key: Sequence[str], order: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Keep a table, partitioned by ``part``, at the last row of each key: a micro-batch reads and rewrites the partitions it
    touches and no others. ``part`` must follow from the key. A batch that is repeated after a failure gives the same table."""

    def merge(batch: DataFrame, batch_id: int) -> None:  # noqa: ARG001
        spark, merged = batch.sparkSession, batch
        if exists(spark, path):
            old = spark.read.schema(batch.schema).parquet(path)
            merged = upsert(old.join(small(batch.select(part).distinct()), part, "left_semi"), batch, key, order)
        # its input lies in the place it goes to, so the result is written aside first
        cut(keep_last(merged, key, order)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, appended to Parquet exactly once; returns when done."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
