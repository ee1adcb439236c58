"""Session helpers: defaults for tests, and the shared folder that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str = "marlgate", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the command line; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that setting is absent (tests, a single machine) a temporary folder is set.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="marlgate-")
        spark.conf.set(CHECKPOINT_KEY, path)
    return path


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A broadcast hint behind a count of the rows; a larger side is left to the planner."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def parts(spark: SparkSession, rows: int, rows_each: int = 100_000) -> int:
    """Into how many tasks Python work over so many rows is cut: at most ``rows_each`` a task, all cores busy beyond ten thousand rows each."""
    return max(1, -(-rows // rows_each), min(spark.sparkContext.defaultParallelism, -(-rows // 10_000)))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder, which survives the loss of executors. The table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    passing(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def passing(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver's file systems close: later frames may read it until then."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context: they need not have it, nor run in its folder."""
    context = spark.sparkContext
    if getattr(context, "_marlgate_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="marlgate-package-"), "marlgate-package.zip")  # read by the driver only
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(root):
            for file in files:
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._marlgate_shipped = True
