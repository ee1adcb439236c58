"""Mixing sources to target weights.

Efraimidis-Spirakis sampling without replacement: each text draws an exponential key, scaled by its quality weight; within
a source the smallest keys come first and are taken until the token budget is full. Complete epochs come before the
fractional selection. The prefix sums are distributed: token totals of key buckets, twice refined, find the bucket where
the budget ends; only that bucket's texts are sorted.

The total is the largest for which no source passes its ``max_repeat``. Keys come from a hash of doc_id and seed, so the
mixture is the same on every run and cluster.

Defined results. Texts of no source or of a source without a target are left out, as are texts without tokens. A target
source without texts gives nothing and doesn't limit the total. Null or non-positive targets or repeats are errors.
A source's budget is missed by less than its next text. Equal keys go by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_BROADCAST = 100_000  # sources
BITS = 12  # of each of the two bucket levels


def sampling_key(seed: int) -> Column:
    """-ln(u) / weight, with u in (0, 1) from the row's hash."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.col("weight")


def budgets(totals: dict[str, int], targets: list[tuple[str, float, int]]) -> dict[str, tuple[int, int, int]]:
    """source -> (complete epochs, tokens of the fractional selection, whole budget)."""
    present = [(s, share, repeat) for s, share, repeat in targets if totals.get(s, 0) > 0]
    if not present:
        return {}
    whole = sum(share for _, share, _ in present)
    total = min(repeat * totals[s] / (share / whole) for s, share, repeat in present)
    out = {}
    for s, share, repeat in present:
        budget = min(int(total * share / whole + 1e-6), repeat * totals[s])
        out[s] = (budget // totals[s], budget % totals[s], budget)
    return out


def mix(sizes: DataFrame, targets: list[tuple[str, float, int]], seed: int = 7) -> DataFrame:
    """``sizes``: doc_id, source, n_tokens, weight. Out: doc_id, source, n_tokens, uses (at least 1)."""
    if any(share is None or share <= 0 or repeat is None or repeat < 1 for _, share, repeat in targets):
        raise ValueError("targets need a positive share and at least one use")
    spark = sizes.sparkSession
    by_source = F.broadcast if len(targets) <= MOST_BROADCAST else (lambda frame: frame)  # frames of one row a source
    wanted = by_source(spark.createDataFrame([(s,) for s, _, _ in targets], "source string"))
    rows = sizes.where("n_tokens > 0").join(wanted, "source", "left_semi").withColumn("key", sampling_key(seed))
    # the key's exponential law turns it into a nearly even place, whatever the weights
    place = F.least(F.floor((1 - F.exp(-F.col("key") * F.lit(0.5))) * float(1 << 2 * BITS)), F.lit((1 << 2 * BITS) - 1)).cast("int")
    rows = rows.withColumn("high", F.shiftright(place, BITS)).withColumn("low", place.bitwiseAND((1 << BITS) - 1))
    totals = {r["source"]: r["t"] for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    plan = budgets(totals, targets)
    if not plan:
        return sizes.select("doc_id", "source", "n_tokens", F.lit(1).alias("uses")).limit(0)
    planned = spark.createDataFrame([(s, epochs, rest) for s, (epochs, rest, _) in plan.items()], "source string, epochs bigint, rest bigint")
    rows = rows.join(by_source(planned), "source")

    def boundary(part: DataFrame, level: str, room: str) -> DataFrame:
        """Of each source the bucket where the room ends, and the room left before it."""
        sums = part.groupBy("source", room, level).agg(F.sum("n_tokens").alias("t"))
        upto = F.sum("t").over(Window.partitionBy("source").orderBy(level))
        return sums.withColumn("upto", upto).where(F.col("upto") > F.col(room)).groupBy("source").agg(
            F.min(level).alias(f"end_{level}"), F.min_by(F.col(room) - F.col("upto") + F.col("t"), F.col(level)).alias(f"room_{level}")
        )

    first = boundary(rows, "high", "rest")
    rows = rows.join(by_source(first), "source", "left")
    at_end = rows.where(F.col("high") == F.col("end_high"))
    second = boundary(at_end, "low", "room_high")
    last = at_end.join(by_source(second), "source", "left").where(F.col("low") == F.col("end_low"))
    order = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    exact = last.withColumn("upto", F.sum("n_tokens").over(order)).where(F.col("upto") <= F.col("room_low")).select("doc_id", "source", F.lit(1).alias("last"))
    chosen = rows.join(by_source(second), "source", "left")
    before = F.col("end_high").isNull() | (F.col("high") < F.col("end_high")) | ((F.col("high") == F.col("end_high")) & (F.col("end_low").isNull() | (F.col("low") < F.col("end_low"))))
    uses = F.col("epochs") + F.when(before & (F.col("rest") > 0), 1).otherwise(F.coalesce("last", F.lit(0)))
    return chosen.join(exact.distinct(), ["doc_id", "source"], "left").select("doc_id", "source", "n_tokens", uses.cast("int").alias("uses")).where("uses > 0")


def target_rows(mix_targets: DataFrame) -> list[tuple[str, float, int]]:
    """The sampling plan, one row a source."""
    return sorted((r[0], r[1], r[2]) for r in mix_targets.select("source", "target_share", "max_repeat").where("source is not null").toLocalIterator())


def share_report(mixture: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeat, texts, tokens, most_uses, actual_share."""
    used = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"))
    joined = mix_targets.select("source", "target_share", "max_repeat").join(used, "source", "left").fillna(0, ["texts", "tokens", "most_uses"])
    everything = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return joined.withColumn("actual_share", F.try_divide("tokens", everything))


def audit(mixture: DataFrame, sizes: DataFrame, targets: list[tuple[str, float, int]]) -> DataFrame:
    """By source: target, cap, and what must be none: texts used beyond the cap, texts used neither as often as the complete
    epochs nor once more, and texts by which the budget is missed (a whole one or more)."""
    spark = sizes.sparkSession
    rows = sizes.where(F.col("source").isin([s for s, _, _ in targets]) & (F.col("n_tokens") > 0))
    known = rows.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.max("n_tokens").alias("longest"))
    plan = budgets({r["source"]: r["total"] for r in known.select("source", "total").collect()}, targets)
    wanted = [(s, share, repeat, plan[s][0], plan[s][2]) for s, share, repeat in targets if s in plan]
    planned = spark.createDataFrame(wanted, "source string, target_share double, max_repeat int, epochs bigint, budget bigint")
    used = rows.join(mixture.select("doc_id", "source", "uses"), ["doc_id", "source"], "left").withColumn("uses", F.coalesce("uses", F.lit(0))).join(F.broadcast(planned), "source")
    told = used.groupBy("source", "target_share", "max_repeat", "budget").agg(
        F.count_if(F.col("uses") > F.col("max_repeat")).alias("beyond_repeat"), F.count_if(~(F.col("uses") - F.col("epochs")).isin(0, 1)).alias("uneven_epochs"),
        F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.max("n_tokens").alias("longest"),
    )
    missed = F.floor(F.greatest(F.col("budget") - F.col("tokens"), F.col("tokens") - F.col("budget")) / (F.col("longest") + 1)).cast("bigint")
    return told.select("source", "target_share", "max_repeat", "beyond_repeat", "uneven_epochs", missed.alias("texts_missed"))
