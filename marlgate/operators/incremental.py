"""Processing only new or changed records.

A Merkle tree over key ranges is saved with every run: leaves hold count and digest of the rows of a day and key bucket,
days, months and the root digest their children. A run digests today's rows (one scan, combined before the shuffle),
reads the saved tree back and descends from the root, level by level, only where digests differ. Rows are read again and
records compared only in the leaves that changed; leaves that came or vanished count as changed. Then output and tree are
published together, by one rename of a pointer.

A generation holds ``tree``, ``state`` (the records of the leaves it changed) and ``holders`` (which generation holds the records
of each leaf), so a run writes what changed and refers to older generations for the rest.

Defined results. Rows whose key can't be read are left out. A record counts as new or changed where its latest row (highest
load_id, then row_id) differs in the compared columns from what the last run saved; delivered again with equal values it
doesn't come out. Two nulls are equal. Of a row repeated under one id with other values the greater ones count. A record that
is gone comes out as removed. A run counts with the status it logged
last (of lines logged at one instant: 'succeeded' only if all say so). An empty table gives no rows and an empty tree.
A row without a load number belongs to no run. The number of leaves is bounded by days times ``buckets``, not by rows.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlgate.functions.normalize import as_number, day_code, digits_of_number, market_code, trimmed
from marlgate.session import passing, shared_dir, small

DIGESTS = ["rows", "digest_low", "digest_high"]
ROOT, MONTH, DAY, LEAF = range(4)


@dataclass(frozen=True)
class Dataset:
    """How a table's records are keyed, ordered and compared."""

    name: str
    keys: dict[str, Column]
    range_key: str
    compared: dict[str, Column]
    buckets: int = 64

    def prepared(self, table: DataFrame) -> DataFrame:
        """row_id, load_id, key columns, c_* compared columns, and range and leaf (its bucket) of each readable row."""
        rows = table.select("row_id", "load_id", *[c.alias(k) for k, c in self.keys.items()], *[c.alias(f"c_{k}") for k, c in self.compared.items()])
        readable = rows.where(F.col("ts_code").isNotNull() & F.col(self.range_key).isNotNull())
        return readable.withColumn("leaf", F.pmod(F.xxhash64("ts_code"), F.lit(self.buckets)).cast("int")).withColumn("range", F.col(self.range_key))


def stock_daily_set() -> Dataset:
    figures = ("open", "high", "low", "close", "pre_close", "volume", "turnover")
    return Dataset("stock_daily", {"ts_code": market_code("ts_code"), "trade_date": day_code("trade_date")}, "trade_date", {k: as_number(k) for k in figures})


def income_set() -> Dataset:
    figures = ("basic_eps", "total_revenue", "revenue", "operate_profit", "n_income", "rd_exp")
    keys = {"ts_code": market_code("ts_code"), "end_date": day_code("end_date"), "report_type": digits_of_number("report_type")}
    texts = {k: F.col(k) for k in ("ann_date", "f_ann_date", "update_flag")}
    return Dataset("income", keys, "end_date", texts | {k: as_number(k) for k in figures})


def processed_loads(runs: DataFrame, dataset: str) -> DataFrame:
    """load_id of every load that a run which succeeded covers: as many rows as there are loads."""
    own = runs.where((trimmed("dataset") == dataset) & F.col("run_id").isNotNull())
    last = own.groupBy("run_id").agg(F.max("logged_at").alias("last"))
    final = own.join(last, "run_id").where(F.col("logged_at").eqNullSafe(F.col("last"))).groupBy("run_id").agg(
        F.min(F.lower(trimmed("status")) == "succeeded").alias("ok"), F.min("from_load").alias("a"), F.max("to_load").alias("b")
    )
    return final.where(F.col("ok") & (F.col("a") <= F.col("b"))).select(F.explode(F.sequence("a", "b")).alias("load_id")).distinct()


def row_hash(rows: DataFrame) -> Column:
    """Of a whole row: key, id, load and compared columns."""
    return F.xxhash64("ts_code", "row_id", "load_id", content_hash(rows))


def content_hash(rows: DataFrame) -> Column:
    """Of what is compared."""
    return F.xxhash64(*[x for c in rows.columns if c.startswith("c_") for x in (F.col(c), F.col(c).isNull())])


def _sums(rows: Column, h: Column) -> list[Column]:
    """Sums of half hashes can't overflow below 2**31 rows, don't depend on the order, and repeated rows don't cancel each other."""
    parts = {"rows": rows, "digest_low": h.bitwiseAND(0xFFFFFFFF), "digest_high": F.shiftrightunsigned(h, 32)}
    return [F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(n) for n, x in parts.items()]


def leaf_digests(rows: DataFrame) -> DataFrame:
    """range, leaf, rows and digests."""
    return rows.groupBy("range", "leaf").agg(*_sums(F.lit(1).cast("bigint"), row_hash(rows)))


def merkle_tree(leaves: DataFrame) -> DataFrame:
    """level, parent, name, range, leaf, rows and digests of all nodes. A node's digest is that of its children with their names."""
    bottom = leaves.select(F.lit(LEAF).alias("level"), F.col("range").alias("parent"), F.concat_ws("-", "range", "leaf").alias("name"), "range", "leaf", *DIGESTS)
    nodes = [bottom]
    for level, parent in ((DAY, F.substring("name", 1, 6)), (MONTH, F.lit("all")), (ROOT, F.lit(None).cast("string"))):
        up = nodes[-1].groupBy(F.col("parent").alias("name")).agg(*_sums(F.col("rows"), F.xxhash64("name", *DIGESTS)))
        nodes.append(up.select(F.lit(level).alias("level"), parent.alias("parent"), "name", F.lit(None).cast("string").alias("range"), F.lit(None).cast("int").alias("leaf"), *DIGESTS))
    return reduce(DataFrame.unionByName, nodes)


def differing_nodes(now: DataFrame, saved: DataFrame, level: int, parents: list[str] | None) -> DataFrame:
    """Nodes of a level, under the given parents, that differ, came or vanished: name, range, leaf."""
    whole = F.struct(*DIGESTS)
    sides = []
    for tree, is_now in ((now, True), (saved, False)):
        nodes = tree.where(F.col("level") == level)
        sides.append((nodes if parents is None else nodes.where(F.col("parent").isin(parents))).select("name", "range", "leaf", whole.alias("whole"), F.lit(is_now).alias("is_now")))
    met = sides[0].unionByName(sides[1]).groupBy("name", "range", "leaf").agg(
        F.max(F.when(F.col("is_now"), F.col("whole"))).alias("a"), F.max(F.when(~F.col("is_now"), F.col("whole"))).alias("b")
    )
    return met.where(~F.col("a").eqNullSafe(F.col("b"))).select("name", "range", "leaf")


def changed_leaves(now: DataFrame, saved: DataFrame) -> DataFrame:
    """Descend from the root to the leaves (range, leaf) that differ. Names of months and days come to the driver, never leaves."""
    parents = None
    for level in (ROOT, MONTH, DAY):
        parents = [r["name"] for r in differing_nodes(now, saved, level, parents).select("name").collect()]
    return differing_nodes(now, saved, LEAF, parents).select("range", "leaf")


class Generations:
    """A folder of generations; the file CURRENT names the one that counts, PREVIOUS in a generation the one before.

    A run that dies before the rename leaves the old generation in force: its records come again, none is lost or doubled.
    A reader that keeps a generation's name goes on reading it after later publishes.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _text(self, file: str) -> str | None:
        at = self.path(f"{self.folder}/{file}")
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode().strip() or None
        finally:
            stream.close()

    def _put(self, file: str, text: str) -> None:
        stream = self.fs.create(self.path(f"{self.folder}/{file}"), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def current(self) -> str | None:
        return self._text("CURRENT")

    def part(self, part: str, name: str | None = None) -> DataFrame | None:
        """``tree``, ``state`` or ``holders`` of a generation, by default the one in force."""
        name = name or self.current()
        if not name:
            return None
        schema = T.StructType.fromJson(json.loads(self._text(f"{name}/.{part}.schema")))  # an empty part has no file to tell it
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{part}")

    def begin(self) -> str:
        name = f"generation-{uuid.uuid4().hex}"
        self._put(f"{name}/PREVIOUS", self.current() or "")
        return name

    def write(self, name: str, part: str, frame: DataFrame, *by: str) -> DataFrame:
        self._put(f"{name}/.{part}.schema", frame.schema.json())
        frame.write.partitionBy(*by).parquet(f"{self.folder}/{name}/{part}")
        return self.part(part, name)

    def publish(self, name: str) -> None:
        """Put the generation in force, by one rename."""
        self._put(f".{name}", name)
        temporary, final = self.path(f"{self.folder}/.{name}"), self.path(f"{self.folder}/CURRENT")
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(context.makeQualified(temporary), context.makeQualified(final), overwrite)

    def roll_back(self) -> str | None:
        """Put the generation before the current one in force again; its name, or None where there is none."""
        before = self._text(f"{self.current()}/PREVIOUS")
        if before:
            self.publish(before)
        return before

    def recover(self) -> list[str]:
        """Delete what died before its rename: generations that neither the current one nor its forerunners name."""
        kept, name = set(), self.current()
        while name:
            kept.add(name)
            name = self._text(f"{name}/PREVIOUS")
        names = [f.getPath().getName() for f in self.fs.listStatus(self.path(self.folder))] if self.fs.exists(self.path(self.folder)) else []
        lost = [n for n in names if n.lstrip(".").startswith("generation-") and n.lstrip(".") not in kept]
        for n in lost:
            self.fs.delete(self.path(f"{self.folder}/{n}"), True)
        return lost


def _held_records(store: Generations, stale: DataFrame) -> DataFrame | None:
    """The saved records of the given leaves, read from the generations that hold them."""
    held = small(store.part("holders").join(small(stale), ["range", "leaf"], "left_semi"))
    parts = []
    for (holder,) in held.select("holder").distinct().collect():  # as many as generations
        records = store.part("state", holder).where(F.col("digest").isNotNull())
        parts.append(records.join(held.where(F.col("holder") == holder), ["range", "leaf"], "left_semi"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def run_increment(table: DataFrame, dataset: Dataset, store: Generations) -> DataFrame:
    """One run against a store: key columns, row_id, load_id of the records that are new or differ from the published state,
    with ``removed`` true for those that are gone (row_id then that of the saved row). Published with the new tree."""
    rows, keys = dataset.prepared(table), list(dataset.keys)
    name = store.begin()
    now = store.write(name, "tree", merkle_tree(leaf_digests(rows)), "level")
    saved, stale = store.part("tree"), None
    if saved is None:
        holders = now.where(F.col("level") == LEAF).select("range", "leaf", F.lit(name).alias("holder"))
    else:
        stale = store.write(name, "stale", changed_leaves(now, saved))
        rows = rows.join(small(stale), ["range", "leaf"], "left_semi")
        holders = store.part("holders").join(small(stale), ["range", "leaf"], "left_anti").unionByName(stale.withColumn("holder", F.lit(name)))
    store.write(name, "holders", holders)
    compared = [c for c in rows.columns if c.startswith("c_")]
    none = F.lit(None).cast("bigint")
    order, row = F.struct("load_id", "row_id", *compared), F.struct("row_id", "load_id", content_hash(rows).alias("digest"))
    if stale is None or (before := _held_records(store, stale)) is None:
        records = rows.groupBy(*keys, "range", "leaf").agg(F.max_by(row, order).alias("now"), F.max(F.struct(none.alias("row_id"), none.alias("digest"))).alias("saved"))
    else:
        nothing = F.struct(none.alias("row_id"), none.alias("digest"))
        today = rows.select(*keys, "range", "leaf", row.alias("row"), order.alias("order"), F.when(F.lit(False), nothing).alias("old"))
        known = before.select(
            *keys, "range", "leaf", F.lit(None).cast(today.schema["row"].dataType).alias("row"), F.lit(None).cast(today.schema["order"].dataType).alias("order"),
            F.struct("row_id", "digest").alias("old"),
        )
        records = today.unionByName(known).groupBy(*keys, "range", "leaf").agg(F.max_by("row", "order").alias("now"), F.max("old").alias("saved"))
    store.write(name, "state", records.select(*keys, "range", "leaf", "now.row_id", "now.load_id", "now.digest", F.col("saved.row_id").alias("saved_row_id"), F.col("saved.digest").alias("saved_digest")))
    store.publish(name)
    gone = F.col("digest").isNull()
    changed = store.part("state", name).where(~F.col("digest").eqNullSafe(F.col("saved_digest")))
    return changed.select(*keys, F.when(gone, F.col("saved_row_id")).otherwise(F.col("row_id")).alias("row_id"), "load_id", gone.alias("removed"))


def new_or_changed(table: DataFrame, runs: DataFrame, dataset: Dataset) -> DataFrame:
    """Latest rows of records that no successful run has processed as they are: dataset, row_id, load_id and keys.

    What the runs covered is first saved as a generation with its tree, then the next run is done against it.
    """
    spark = table.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/increments-{uuid.uuid4().hex}"
    passing(spark, folder)
    store = Generations(spark, folder)
    covered = table.join(small(processed_loads(runs, dataset.name).withColumnRenamed("load_id", "covered_load")), F.col("load_id") == F.col("covered_load"), "left_semi")
    run_increment(covered, dataset, store)
    return run_increment(table, dataset, store).where(~F.col("removed")).select(F.lit(dataset.name).alias("dataset"), "row_id", "load_id", *dataset.keys)


def all_new_or_changed(sources: list[tuple[DataFrame, Dataset]], runs: DataFrame) -> list[DataFrame]:
    """``new_or_changed`` of several tables, whose runs are independent and go side by side."""
    with ThreadPoolExecutor(len(sources)) as pool:
        return list(pool.map(lambda x: new_or_changed(x[0], runs, x[1]), sources))
