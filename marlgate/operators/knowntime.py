"""Attributes as known at event time.

Shards of entities each get one path-copied persistent search tree over the valid-time key: every insertion copies only the
path to the root, so each known day keeps its own root at logarithmic cost. An event picks the last root known before its
day and searches the valid-time key there. Nodes stand in arrays: all insertions of a shard are laid out level by level,
all its events descend together, so neither costs a Python step a row.

Neither side of a shard is unbounded: facts are first reduced to one for each (entity, valid day, known day), events to one
for each (entity, day), and the number of shards follows from the number of rows. Memberships are sharded by index and member.

Defined results. Rows whose code or day can't be read, and events without an id, are left out. A fact without a known day is never known. A fact known
on the event's own day isn't used. Nothing found gives no row; a position
repeated under one id is answered once. Ties follow the stated order down to the lowest row id. Entities are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlgate.functions.normalize import day_code, digits_of_number, effective_day, index_code, market_code, trimmed
from marlgate.operators.snapshots import index_snapshots
from marlgate.session import cut, parts, small


class PersistentTree:
    """A binary search tree over ``keys`` (sorted, distinct), with one version for each insertion.

    Insertion i sets the value of the key at ``places[i]``; it copies the nodes from the root down to that key and shares the
    rest with the versions before. A node is (level, insertion): on level l insertion i copied the node of the keys whose
    place begins with the first l bits of ``places[i]``. ``sides[l]`` holds, for every insertion, the insertion whose node
    hangs on the other side of the copied one (-1: empty); on its own side hangs its own copy.
    """

    def __init__(self, keys: np.ndarray, places: np.ndarray):
        self.keys, self.places = keys, places
        self.depth = max(1, int(len(keys) - 1).bit_length()) if len(keys) else 0
        self.sides: list[np.ndarray] = []
        at = np.arange(len(places), dtype=np.int64)
        for level in range(self.depth):
            prefix = places >> (self.depth - level - 1)  # of the children
            order = np.lexsort((at, prefix))
            # the last insertion before i whose path went to the sibling
            ranked = prefix[order] * np.int64(len(places) + 1) + at[order]
            near = np.searchsorted(ranked, (prefix ^ 1) * np.int64(len(places) + 1) + at) - 1
            found = order[np.maximum(near, 0)]
            self.sides.append(np.where((near >= 0) & (prefix[found] == prefix ^ 1), found, -1))

    def _children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper child of nodes (-1 stays -1)."""
        safe = np.maximum(nodes, 0)
        up = (self.places[safe] >> (self.depth - level - 1)) & 1
        own, other = np.where(nodes < 0, -1, nodes), np.where(nodes < 0, -1, self.sides[level][safe])
        return np.where(up == 1, other, own), np.where(up == 1, own, other)

    def floor(self, roots: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """For each event the insertion that set the greatest key not above the wanted one, as of its root (-1: none)."""
        target = np.searchsorted(self.keys, wanted, side="right") - 1 if len(self.keys) else np.full(len(roots), -1)
        node = np.where(target < 0, -1, roots)
        spare, spare_level = np.full(len(roots), -1), np.zeros(len(roots), dtype=np.int64)
        for level in range(self.depth):
            low, high = self._children(level, node)
            right = (target >> (self.depth - level - 1)) & 1 == 1
            passed = right & (low >= 0)
            spare, spare_level = np.where(passed, low, spare), np.where(passed, level + 1, spare_level)
            node = np.where(right, high, low)
        # where the path ended in nothing: the greatest key of the last tree passed on the lower side
        for level in range(self.depth):
            now = spare_level <= level
            low, high = self._children(level, spare)
            spare = np.where(now & (spare >= 0), np.where(high >= 0, high, low), spare)
        return np.where(node >= 0, node, spare)

    def get(self, roots: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """For each event the insertion that set just this key (-1: none)."""
        found = self.floor(roots, wanted)
        safe = np.maximum(found, 0)
        return np.where((found >= 0) & (self.keys[self.places[safe]] == wanted), found, -1) if len(self.keys) else found


def known_facts(entity: np.ndarray, valid: np.ndarray, known: np.ndarray, event_entity: np.ndarray, event_day: np.ndarray, exact: bool) -> np.ndarray:
    """For each event the fact of its entity, known before its day, with the latest valid day not after it (``exact``: whose
    valid day is 0, as for keys without one); -1 without any. Days are numbers up to 2**32. Of facts that repeat entity, valid
    and known day the last one counts."""
    entities = np.unique(entity)
    order = np.lexsort((np.arange(len(known)), known))
    keys = (np.searchsorted(entities, entity) << 32) + valid
    distinct = np.unique(keys)
    tree = PersistentTree(distinct, np.searchsorted(distinct, keys[order]))
    place = np.minimum(np.searchsorted(entities, event_entity), max(len(entities) - 1, 0))
    there = entities[place] == event_entity if len(entities) else np.zeros(len(event_entity), bool)
    roots = np.where(there, np.searchsorted(known[order], event_day) - 1, -1)
    wanted = (place << 32) + (0 if exact else event_day)
    found = tree.floor(roots, wanted)
    safe = order[np.maximum(found, 0)] if len(order) else found
    return np.where((found >= 0) & (keys[safe] >> 32 == place), safe, -1) if len(order) else found


def position_events(positions: DataFrame) -> DataFrame:
    """position_id, ts_code, series (index), day (text) of readable POSITION rows."""
    return positions.where(F.upper(trimmed("record_type")) == "POSITION").select(
        "position_id", market_code("ts_code").alias("ts_code"), index_code("index_code").alias("series"), day_code("trade_date").alias("day")
    ).where(F.col("position_id").isNotNull() & F.col("ts_code").isNotNull() & F.col("day").isNotNull())


def searched(events: DataFrame, facts: DataFrame, keys: list[str], shards: int, exact: bool = False) -> DataFrame:
    """``events``: keys, day (text). ``facts``: keys, valid_day and known_day (texts), value (bigint). Out: keys, day, value.

    Both sides of a shard arrive in one task, told apart by ``is_fact``.
    """
    entity, number = F.xxhash64(*keys).alias("entity"), lambda c: F.col(c).cast("bigint")
    both = facts.select(entity, *keys, F.lit(True).alias("is_fact"), number("valid_day").alias("valid"), number("known_day").alias("known"), "value").unionByName(
        events.select(entity, *keys, F.lit(False).alias("is_fact"), F.lit(0).cast("bigint").alias("valid"), number("day").alias("known"), F.lit(0).cast("bigint").alias("value"))
    ).repartition(shards, "entity")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        shard = pa.Table.from_batches(held).combine_chunks()
        column = {c: shard[c].to_numpy() for c in ("entity", "valid", "known", "value")}
        is_fact = shard["is_fact"].to_numpy(zero_copy_only=False)
        fact, event = np.flatnonzero(is_fact), np.flatnonzero(~is_fact)
        found = known_facts(column["entity"][fact], column["valid"][fact], column["known"][fact], column["entity"][event], column["known"][event], exact)
        value = column["value"][fact[found[found >= 0]]] if len(fact) else np.empty(0, "int64")
        rows = event[found >= 0]
        taken = shard.select([*keys, "known"]).take(pa.array(rows))
        yield from taken.append_column("value", pa.array(value)).to_batches()

    schema = ", ".join([*[f"{k} string" for k in keys], "known bigint", "value bigint"])
    return both.mapInArrow(search, schema).select(*keys, F.lpad(F.col("known").cast("string"), 8, "0").alias("day"), "value")


def reports_known(positions: DataFrame, income: DataFrame, shards: int | None = None) -> DataFrame:
    """position_id, ref: the income row of report_type 1 that was known before the trade date."""
    facts = income.select(
        market_code("ts_code").alias("ts_code"), day_code("end_date").alias("valid_day"), digits_of_number("report_type").alias("kind"),
        day_code(effective_day("f_ann_date", "ann_date")).alias("known_day"),
        F.coalesce(trimmed("update_flag") == "1", F.lit(False)).alias("updated"), "source_order", "row_id",
    ).where("kind = '1' and ts_code is not null and valid_day is not null and known_day is not null")
    best = facts.groupBy("ts_code", "valid_day", "known_day").agg(F.max(F.struct("updated", "source_order", (-F.col("row_id")).alias("row"))).alias("x"))
    best = best.select("ts_code", "valid_day", "known_day", (-F.col("x.row")).alias("value"))
    events = cut(position_events(positions))
    shards = shards or parts(events.sparkSession, income.count() + events.count())
    found = searched(events.select("ts_code", "day").distinct(), best, ["ts_code"], shards)
    return events.join(found, ["ts_code", "day"]).select("position_id", F.col("value").cast("string").alias("ref")).distinct()


def memberships_known(positions: DataFrame, index_weight: DataFrame, shards: int | None = None) -> DataFrame:
    """position_id, ref: the index's latest snapshot before the trade date, where the stock is in it.

    A member is a fact where it comes (value 1) and where it goes (value 0), known from that snapshot on; which snapshot is
    the latest before a day is told by the index's list of snapshots, one row each.
    """
    events = cut(position_events(positions).where(F.col("series").isNotNull()))
    members, numbers = index_snapshots(index_weight)
    by = ["series", "item"]
    stays = members.join(small(numbers), ["series", "snapshot"]).select(*by, "snapshot", "snapshot_no", "last_no")
    # a stay's first snapshot begins it; the snapshot after its last one ends it
    comes = stays.select(*by, F.explode(F.array(F.struct(F.col("snapshot_no").alias("no"), F.lit(1).alias("v")), F.struct((F.col("snapshot_no") + 1).alias("no"), F.lit(0).alias("v")))).alias("x"), "last_no")
    turns = comes.where("x.no <= last_no").groupBy(*by, F.col("x.no").alias("snapshot_no")).agg(F.max("x.v").alias("value"))
    facts = turns.join(small(numbers), ["series", "snapshot_no"]).select(
        "series", F.col("item").alias("ts_code"), F.lit("0").alias("valid_day"), F.col("snapshot").alias("known_day"), F.col("value").cast("bigint").alias("value")
    )
    shards = shards or parts(events.sparkSession, index_weight.count() + events.count())
    found = searched(events.select("series", "ts_code", "day").distinct(), facts, ["series", "ts_code"], shards, exact=True).where("value = 1").drop("value")
    listed = numbers.groupBy("series").agg(F.sort_array(F.collect_list("snapshot")).alias("snapshots"))
    latest = F.element_at(F.filter("snapshots", lambda s: s < F.col("day")), -1)
    dated = found.join(small(listed), "series").select("series", "ts_code", "day", latest.alias("ref"))
    return events.join(dated, ["series", "ts_code", "day"]).select("position_id", "ref").distinct()


def known_at_trade(positions: DataFrame, income: DataFrame, index_weight: DataFrame) -> DataFrame:
    """position_id, kind ('income' or 'index_weight'), ref."""
    return reports_known(positions, income).select("position_id", F.lit("income").alias("kind"), "ref").unionByName(
        memberships_known(positions, index_weight).select("position_id", F.lit("index_weight").alias("kind"), "ref")
    )
