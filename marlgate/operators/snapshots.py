"""What changed between consecutive full snapshots of a table.

Every row shrinks to a key hash and a row hash. The compact arrays are hash-bucketed by key, whatever series they belong
to, so a series that holds a third of all rows spreads over all buckets and a small one costs no task of its own. Within a
bucket they are sorted in numpy and consecutive snapshots are compared by ``searchsorted`` set differences. A row's full
values travel beside its arrays in the one shuffle and are taken out for the keys that differ only.

Defined results. A series' first snapshot gives nothing. Rows without a readable series, date or key are left out. Of rows
that repeat a key in a snapshot the one with the highest source_order counts, then the highest weight. Null against a
number is a change, null against null none. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlgate.functions.normalize import as_number, day_code, index_code, market_code, real_day
from marlgate.session import cut, parts, small

KINDS = np.array(["added", "removed", "changed"], dtype=object)


def difference(old_keys: np.ndarray, old_rows: np.ndarray, new_keys: np.ndarray, new_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that differ between two snapshots with sorted unique keys, and the index of their kind in ``KINDS``."""

    def found(keys: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(within, keys)
        at = np.minimum(at, max(len(within) - 1, 0))
        return (within[at] == keys if len(within) else np.zeros(len(keys), bool)), at

    in_old, at = found(new_keys, old_keys)
    in_new, _ = found(old_keys, new_keys)
    changed = new_keys[in_old][new_rows[in_old] != old_rows[at[in_old]]] if len(old_keys) else new_keys[:0]
    parts = [new_keys[~in_old], old_keys[~in_new], changed]
    return np.concatenate(parts), np.repeat(np.arange(3), [len(p) for p in parts])


def differing_rows(keys: np.ndarray, hashes: np.ndarray, numbers: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket: the number of the later snapshot, the kind, and the rows before and now (-1 for none) of each key that differs.

    ``numbers`` count a series' snapshots from 1, ``lasts`` is the number of its last one: behind it nothing is removed.
    """
    order = np.lexsort((keys, numbers))
    keys, hashes, numbers, lasts = keys[order], hashes[order], numbers[order], lasts[order]
    bounds = np.searchsorted(numbers, np.arange(1, int(numbers.max(initial=0)) + 3))
    found: list[tuple[np.ndarray, ...]] = []
    for n in range(2, len(bounds)):
        a, b, c = bounds[n - 2], bounds[n - 1], bounds[n]
        going = np.arange(a, b)[lasts[a:b] >= n]
        differing, kind = difference(keys[going], hashes[going], keys[b:c], hashes[b:c])
        old = np.searchsorted(keys[going], differing)
        new = np.searchsorted(keys[b:c], differing)
        before = np.where(kind == 0, -1, order[going[np.minimum(old, len(going) - 1)]] if len(going) else -1)
        now = np.where(kind == 1, -1, order[b + np.minimum(new, c - b - 1)] if c > b else -1)
        found.append((np.full(len(differing), n), kind, before, now))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.empty(0, "int64") for i in range(4))


def snapshot_changes(rows: DataFrame, values: list[str], buckets: int | None = None, numbers: DataFrame | None = None) -> DataFrame:
    """``rows``: series, snapshot (sortable), item, and value columns; one row per (series, snapshot, item).

    ``buckets`` splits the keys; left out, so many that each holds 100,000 rows. ``numbers``: ``snapshot_numbers``, if at hand.
    Out: series, snapshot (the later one), item, change_kind, and for each value ``old_<v>`` and ``new_<v>``.
    """
    numbers = snapshot_numbers(rows.select("series", "snapshot").distinct()) if numbers is None else numbers
    buckets = buckets or parts(rows.sparkSession, rows.count())
    compact = rows.join(small(numbers), ["series", "snapshot"]).select(
        F.xxhash64("series", "item").alias("row_key"), F.xxhash64(*[x for v in values for x in (F.col(v), F.col(v).isNull())]).alias("row_hash"),
        "snapshot_no", "last_no", "series", "item", *values,
    ).repartition(buckets, "row_key")
    names = [f"{side}_{v}" for v in values for side in ("old", "new")]
    sides = ", ".join(f"{side}_{v} {rows.schema[v].dataType.simpleString()}" for v in values for side in ("old", "new"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        bucket = pa.Table.from_batches(held).combine_chunks()
        n, kind, before, now = differing_rows(*[bucket[c].to_numpy() for c in ("row_key", "row_hash", "snapshot_no", "last_no")])
        some = pa.array(np.where(kind == 1, before, now))
        taken = [pa.array(n.astype("int32")), bucket["series"].take(some), bucket["item"].take(some), pa.array(KINDS[kind], pa.string())]
        old, new = (pa.array(x, mask=x < 0) for x in (before, now))
        taken += [bucket[v].take(side) for v in values for side in (old, new)]
        yield from pa.table(taken, ["snapshot_no", "series", "item", "change_kind", *names]).to_batches()

    changes = compact.mapInArrow(compare, f"snapshot_no int, series string, item string, change_kind string, {sides}")
    return changes.join(small(numbers), ["series", "snapshot_no"]).select("series", "snapshot", "item", "change_kind", *names)


def snapshot_numbers(snapshots: DataFrame) -> DataFrame:
    """Add snapshot_no (from 1, by series) and last_no to one row a snapshot."""
    by = Window.partitionBy("series")
    return snapshots.withColumns({"snapshot_no": F.row_number().over(by.orderBy("snapshot")), "last_no": F.count(F.lit(1)).over(by).cast("int")})


def index_snapshots(index_weight: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid constituents: series (index), snapshot (day text), item (constituent), weight_e4 (percent times 10,000);
    and one row a snapshot: series, snapshot, snapshot_no, last_no.

    A snapshot whose weights add up to 2 or less is recorded in fractions of one. Rows meet once, by constituent; what is
    known of a whole snapshot (its highest delivery, its total) is one row of the second table, joined back.
    """
    rows = index_weight.select(
        index_code("index_code").alias("series"), day_code("snapshot_date").alias("snapshot"), market_code("con_code").alias("item"),
        as_number("weight").alias("weight"), "delivery", "source_order",
    ).where(F.col("series").isNotNull() & F.col("snapshot").isNotNull())
    one = cut(rows.groupBy("series", "snapshot", "item").agg(F.max(F.struct("delivery", "source_order", "weight")).alias("x")).select("series", "snapshot", "item", "x.delivery", "x.weight"))
    item, order = F.col("item").isNotNull(), F.struct("delivery")
    deliveries = one.groupBy("series", "snapshot", "delivery").agg(F.sum(F.when(item, F.abs("weight"))).alias("total"), F.count(F.when(item, 1)).alias("n"))
    best = deliveries.groupBy("series", "snapshot").agg(F.max_by(F.struct("delivery", "total", "n"), order).alias("x")).where("x.n > 0")
    fractions = F.coalesce(F.col("x.total") <= 2, F.lit(False))
    numbers = cut(snapshot_numbers(best.select("series", "snapshot", F.col("x.delivery").alias("best"), fractions.alias("fractions"))))
    scale = F.when(F.col("fractions"), 1e6).otherwise(1e4)
    kept = one.where(F.col("item").isNotNull()).join(small(numbers), ["series", "snapshot"]).where(F.col("delivery").eqNullSafe(F.col("best")))
    members = kept.select("series", "snapshot", "item", F.round(F.col("weight") * scale).cast("bigint").alias("weight_e4"))
    return members, numbers.select("series", "snapshot", "snapshot_no", "last_no")


def constituent_changes(index_weight: DataFrame, buckets: int | None = None) -> DataFrame:
    """index_code, snapshot_date, con_code, change_kind, old_weight, new_weight (percent)."""
    members, numbers = index_snapshots(index_weight)
    changes = snapshot_changes(members, ["weight_e4"], buckets or parts(members.sparkSession, index_weight.count()), numbers)
    return changes.select(
        F.col("series").alias("index_code"), F.col("snapshot").alias("snapshot_date"), F.col("item").alias("con_code"), "change_kind",
        (F.col("old_weight_e4") / 1e4).alias("old_weight"), (F.col("new_weight_e4") / 1e4).alias("new_weight"),
    )
