"""Filling fixed-capacity containers with items: sum-of-squares online packing.

A window's fill level is all that matters. For each item the level is chosen whose use makes the sum of squared counts of
partially filled windows smallest; the counts stand in one array of capacity + 1 levels. Items are hashed into shards of
bounded size and packed in parallel. Each item is placed for good before the next is seen; within a shard the largest come
first, or, with ``largest_first=False``, in the order of their hashes, as if they streamed in. ``p8_fill`` reports both losses.

Windows a shard leaves open by more than ``open_share`` are merged, as whole items, in a second round over few shards, so
the loss at the edges doesn't grow with the number of shards; windows fuller than that stay as they are.

Defined results. A text is split only above the capacity: into full windows and one rest. Texts without tokens take no
space and aren't placed. Every other text is placed once for each container size, a repeated row as often as it is there.
The result depends on the ids and sizes alone, not on how the table is laid out or how many tasks read it.
A capacity below one, or none, is an error. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlgate.session import cut

KINDS_AT_ONCE = 1000  # container kinds of one plan; more are packed in turns


class SumOfSquares:
    """Online packing into windows of one capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, dtype=np.int64)  # open windows by fill level
        self.open: dict[int, list[int]] = {}
        self.fills: list[int] = []

    def place(self, size: int) -> int:
        """The window an item of 1 to capacity goes to."""
        top = self.capacity - size
        levels = np.flatnonzero(self.counts[1 : top + 1]) + 1
        # what the sum of squares changes by: the level left loses one window, the level reached gains one; full ones don't count
        reached = self.counts[levels + size]
        change = 2 * (reached - self.counts[levels]) + 2
        change[levels + size == self.capacity] = 1 - 2 * self.counts[top] if len(levels) and levels[-1] == top else 0
        fresh = 2 * self.counts[size] + 1 if size < self.capacity else 0
        best = len(levels) - 1 - int(np.argmin(change[::-1])) if len(levels) else -1  # of equals the fullest
        if best >= 0 and change[best] <= fresh:
            level = int(levels[best])
            window = self.open[level].pop()
            self.counts[level] -= 1
        else:
            level, window = 0, len(self.fills)
            self.fills.append(0)
        level += size
        self.fills[window] = level
        if level < self.capacity:
            self.counts[level] += 1
            self.open.setdefault(level, []).append(window)
        return window


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each item, and the windows' fills."""
    packer = SumOfSquares(capacity)
    windows = np.fromiter((packer.place(int(s)) for s in sizes), dtype=np.int64, count=len(sizes))
    return windows, np.array(packer.fills, dtype=np.int64)


def pack(sizes: DataFrame, containers: list[tuple[str, int]], shard_items: int = 20_000, open_share: float = 0.02, largest_first: bool = True) -> DataFrame:
    """``sizes``: doc_id, n_tokens. Out: container, capacity, window, doc_id, piece, first_token, n_tokens.

    ``shard_items`` bounds what one task packs; windows with more than ``open_share`` unused go through the second round.
    """
    if not containers or any(c is None or c < 1 for _, c in containers):
        raise ValueError("container capacities must be at least one token")
    if len(containers) > KINDS_AT_ONCE:
        turns = [containers[a : a + KINDS_AT_ONCE] for a in range(0, len(containers), KINDS_AT_ONCE)]
        return reduce(DataFrame.unionByName, [pack(sizes, turn, shard_items, open_share, largest_first) for turn in turns])
    kinds = F.array(*[F.struct(F.lit(n).alias("container"), F.lit(int(c)).alias("capacity")) for n, c in containers])
    # repeated rows are told apart by counting them, so a copy's number doesn't depend on where its row lies
    counted = sizes.where("n_tokens > 0").groupBy("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens")).agg(F.count(F.lit(1)).alias("copies"))
    numbered = counted.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy")).select("*", F.explode(kinds).alias("kind")).select("*", "kind.*").drop("kind")
    whole = F.when(F.col("n_tokens") > F.col("capacity"), F.floor(F.col("n_tokens") / F.col("capacity"))).otherwise(0).cast("bigint")
    numbered = numbered.withColumn("whole", whole).withColumn("rest", F.col("n_tokens") - F.col("whole") * F.col("capacity"))
    full = numbered.where("whole > 0").select("container", "capacity", "doc_id", F.concat_ws("-", F.lit("full"), "doc_id", "n_tokens", "copy").alias("named"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("piece")).select(
        "container", "capacity", F.concat_ws("-", "named", "piece").alias("window"), "doc_id", "piece",
        (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").cast("bigint").alias("n_tokens"),
    )
    rests = numbered.where("rest > 0").select(
        "container", "capacity", F.struct("doc_id", "n_tokens", "copy", "whole").alias("item"), F.col("rest").alias("size"), F.xxhash64("doc_id", "n_tokens", "copy").alias("place")
    )
    spark = sizes.sparkSession
    shards = max(1, -(-sizes.count() // shard_items))  # of a table cut before: read from its footers
    schema = "container string, capacity int, item struct<doc_id: bigint, n_tokens: bigint, copy: bigint, whole: bigint>, size bigint, window string, fill bigint"

    def by_shard(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items["item"] = list(items["item"])
        items["order"] = [(i["doc_id"] is not None, i["doc_id"] or 0, i["n_tokens"], i["copy"]) for i in items["item"]]
        by = ["size", "place", "order"] if largest_first else ["place", "order"]
        items = items.sort_values(by, ascending=[n != "size" for n in by], kind="stable")
        windows, fills = pack_sizes(items["size"].to_numpy(), int(key[1]))
        return pd.DataFrame({
            "container": key[0], "capacity": key[1], "item": items["item"].to_numpy(), "size": items["size"].to_numpy(),
            "window": [f"{key[2]}-{w}" for w in windows], "fill": fills[windows],
        })

    first = cut(rests.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).groupBy("container", "capacity", "shard").applyInPandas(by_shard, schema))
    open_windows = first.where(F.col("fill") < F.col("capacity") * (1 - open_share)).groupBy("container", "capacity", "window").agg(F.max("fill").alias("size"))
    left = max((r["n"] for r in open_windows.groupBy("container").agg(F.count(F.lit(1)).alias("n")).collect()), default=0)
    again = max(1, -(-left // shard_items))

    def merge(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["size", "window"], ascending=False, kind="stable")
        windows, _ = pack_sizes(items["size"].to_numpy(), int(key[1]))
        return pd.DataFrame({"container": key[0], "window": items["window"].to_numpy(), "merged": [f"m{key[2]}-{w}" for w in windows]})

    merged = open_windows.withColumn("shard", F.pmod(F.xxhash64("window"), F.lit(again)).cast("int")).groupBy("container", "capacity", "shard").applyInPandas(
        merge, "container string, window string, merged string"
    )
    placed = first.join(merged, ["container", "window"], "left").select(
        "container", "capacity", F.coalesce("merged", "window").alias("window"), F.col("item.doc_id").alias("doc_id"), F.col("item.whole").alias("piece"),
        (F.col("item.whole") * F.col("capacity")).alias("first_token"), F.col("size").alias("n_tokens"),
    )
    return full.unionByName(placed)


def container_kinds(containers: DataFrame) -> list[tuple[str, int]]:
    """Name and capacity of every kind: a list of what there is to fill, not of data."""
    rows = containers.select("container", "capacity_tokens").where("container is not null and capacity_tokens is not null").toLocalIterator()
    return sorted((r[0], r[1]) for r in rows)


def fill_report(packed: DataFrame) -> DataFrame:
    """container, capacity, windows, tokens, unused_share."""
    return packed.groupBy("container", "capacity").agg(F.countDistinct("window").alias("windows"), F.sum("n_tokens").alias("tokens")).withColumn(
        "unused_share", 1 - F.col("tokens") / (F.col("windows") * F.col("capacity"))
    )


def audit(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """container, capacity, documents; and what must be none: overfull windows, documents split needlessly, documents whose
    pieces don't cover their tokens just as often as the document is there."""
    windows = packed.groupBy("container", "capacity", "window").agg(F.sum("n_tokens").alias("fill"))
    overfull = windows.groupBy("container", "capacity").agg(F.count_if(F.col("fill") > F.col("capacity")).alias("overfull"))
    wanted = sizes.where("n_tokens > 0").groupBy("doc_id").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"), F.count(F.lit(1)).alias("copies"))
    pieces = packed.groupBy("container", "capacity", "doc_id").agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("pieces"))
    met = pieces.join(wanted, "doc_id", "full")
    told = met.groupBy("container", "capacity").agg(
        F.count("doc_id").alias("documents"), F.count_if((F.col("longest") <= F.col("capacity")) & (F.col("pieces") > F.col("copies"))).alias("split_needlessly"),
        F.count_if(~F.col("placed").eqNullSafe(F.col("tokens"))).alias("wrongly_placed"),
    )
    return told.join(overfull, ["container", "capacity"]).select("container", "capacity", "documents", "overfull", "split_needlessly", "wrongly_placed")
