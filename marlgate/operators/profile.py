"""Column-level data quality profile.

Three parts. Exact base aggregates: rows, nulls, distinct values, ranges, violations of rules, exact medians by radix
counting (no values are collected). A classifier two-sample test: for every load a logistic regression learns to tell its
rows from all others; folds are crossed, and the area under its curve, with each column left out and with each column
alone, says which loads and columns stand out. Then an exact check of the loads and columns found, and only of those.

Rows become patterns of binned values with their counts in one scan, so what follows costs patterns, not rows. Models are
fitted load by load on the executors, from bounded samples; scores are counted over all rows there too, in blocks of
loads. What reaches the driver are counts of levels and the models of one block, sizes that neither rows nor loads change.

Defined results. NaN counts as null. Rows without a load number belong to no load but count as rows of the table. Columns
without any number have no median and no shift. Empty tables give no findings and a profile of zero rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlgate.functions.normalize import as_number, blank, effective_day, eight_digit_day, real_day
from marlgate.session import cut, parts, small

BAR_COLUMNS = ("open", "high", "low", "close", "pre_close", "volume", "turnover")
CODE = r"^\d{6}\.(SH|SZ|BJ)\z"


def bar_rules() -> dict[str, Column]:
    o, h, l, c = (as_number(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    return {
        "null_primary_key": blank("ts_code") | blank("trade_date"),
        "code_pattern": ~blank("ts_code") & ~F.col("ts_code").rlike(CODE),
        "valid_date": ~blank("trade_date") & ~eight_digit_day("trade_date"),
        "ohlc_domain": (o <= 0) | (h <= 0) | (l <= 0) | (c <= 0) | (h < o) | (h < c) | (h < l) | (l > o) | (l > c),
        "nonnegative_activity": (as_number("volume") < 0) | (as_number("turnover") < 0),
    }


def report_rules() -> dict[str, Column]:
    known = effective_day("f_ann_date", "ann_date")
    end = real_day("end_date")
    return {
        "null_primary_key": blank("ts_code") | blank("ann_date") | blank("end_date"),
        "code_pattern": ~blank("ts_code") & ~F.col("ts_code").rlike(CODE),
        "valid_date": ~blank("end_date") & ~eight_digit_day("end_date"),
        "finance_pit_dates": F.coalesce(known, F.lit("")).isin("", "0") | end.isNull() | F.coalesce(real_day(known) < end, F.lit(False)),
    }


def broken_rules(table: DataFrame, name: str, rules: dict[str, Column], ref: str = "row_id") -> DataFrame:
    """src_table, rule_name, ref_id: one row per broken rule, from one scan. A rule that can't be told isn't broken."""
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(rule_name)) for rule_name, rule in rules.items()]))
    return table.select(F.lit(name).alias("src_table"), F.explode(broken).alias("rule_name"), F.col(ref).cast("bigint").alias("ref_id"))


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order; both zeros are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> 63 == 1, ~bits, bits | np.uint64(1 << 63))


def value_of(bits: int) -> float:
    bits = bits ^ (1 << 63) if bits >> 63 else ~bits & (1 << 64) - 1
    return float(np.array([bits], dtype=np.uint64).view(np.float64)[0])


RADIX_BITS = (20, 16, 16, 12)  # sign, exponent and eight digits of the fraction first


def exact_medians(table: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Medians of the non-null values (mean of the two middle ones for an even count), by radix counting.

    A pass counts, for each column, the values that share the digits known so far by their next digits, in numpy and
    combined before the shuffle; the counts alone reach the driver, at most 2**16 (first 2**20) for each middle rank. A column is
    done when a single value is left: two or three passes for prices and volumes, four at most for anything.
    """
    known: dict[str, list[tuple[int, int]]] = {c: [] for c in columns}  # (digits known, rank below them) of the middle ranks
    done: dict[str, list[float]] = {}
    for step, width in enumerate(RADIX_BITS):
        shift = 64 - sum(RADIX_BITS[: step + 1])
        wanted = [c for c in columns if c not in done and (step == 0 or known[c])]
        if not wanted:
            break
        prefixes = {c: np.array(sorted({d for d, _ in known[c]}), dtype=np.uint64) for c in wanted}
        rows = table.select(*[as_number(c).alias(f"v{i}") for i, c in enumerate(wanted)])

        def count(batches: Iterator[pa.RecordBatch], wanted=wanted, prefixes=prefixes, shift=shift, width=width, step=step) -> Iterator[pa.RecordBatch]:
            held: list[tuple[list, list, list]] = [([], [], []) for _ in wanted]
            for batch in batches:
                for i, c in enumerate(wanted):
                    bits = ordered_bits(batch.column(i).drop_null().to_numpy(zero_copy_only=False))
                    if step:
                        bits = bits[np.isin(bits >> np.uint64(shift + width), prefixes[c])]
                    digits, at, n = np.unique(bits >> np.uint64(shift), return_inverse=True, return_counts=True)
                    low, high = np.full(len(digits), ~np.uint64(0)), np.zeros(len(digits), np.uint64)
                    np.minimum.at(low, at, bits)
                    np.maximum.at(high, at, bits)
                    for parts_held, part in zip(held[i], (digits, n, np.stack([low, high])), strict=True):
                        parts_held.append(part)
            for i, (digits, n, ends) in enumerate(held):
                if digits:
                    values, at = np.unique(np.concatenate(digits), return_inverse=True)
                    both = np.concatenate(ends, axis=1)
                    low, high = np.full(len(values), ~np.uint64(0)), np.zeros(len(values), np.uint64)
                    np.minimum.at(low, at, both[0])
                    np.maximum.at(high, at, both[1])
                    signed = lambda x: pa.array((x ^ np.uint64(1 << 63)).view(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(values), i, np.int32)), signed(values), pa.array(np.bincount(at, np.concatenate(n), len(values)).astype(np.int64)), signed(low), signed(high)],
                        ["k", "digits", "n", "low", "high"],
                    )

        sums = rows.mapInArrow(count, "k int, digits bigint, n bigint, low bigint, high bigint").groupBy("k", "digits").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
        )
        found: dict[int, list] = {}
        for r in sums.collect():
            found.setdefault(r["k"], []).append((r["digits"] + (1 << 63), r["n"], r["low"] + (1 << 63), r["high"] + (1 << 63)))
        for i, c in enumerate(wanted):
            bins = sorted(found.get(i, []))
            if step == 0:
                total = sum(n for _, n, _, _ in bins)
                ranks = [(None, r) for r in ((total - 1) // 2, total // 2)] if total else []
            else:
                ranks = known[c]
            left, ends = [], []
            for prefix, rank in ranks:
                for digits, n, low, high in bins:
                    if prefix is not None and digits >> width != prefix:
                        continue
                    if rank < n:
                        left.append((digits, rank))
                        ends.append((low, high))
                        break
                    rank -= n
            known[c] = left
            if left and all(low == high for low, high in ends):
                done[c] = [value_of(low) for low, _ in ends]
    return {c: sum(done[c]) / 2 if c in done else None for c in columns}


def level_edges(median: float | None) -> list[float]:
    """Rising bounds of the levels of a column: zero, steps about the median, and just the limits a tenth and ten times it."""
    if median is None:
        return []
    steps = (0.01, 10**-0.5, 10**-0.25, 1.0, 10**0.25, 10**0.5, 100.0)
    return sorted({float(np.nextafter(0.0, 1.0)), 0.1 * median, float(np.nextafter(10 * median, np.inf)), *[s * median for s in steps]})


def level(value: Column, edges: list[float]) -> Column:
    """0 for null, else 1 and the number of bounds not above the value."""
    passed = [(value >= F.lit(e)).cast("int") for e in edges]
    return F.when(value.isNull(), 0).otherwise(reduce(lambda a, b: a + b, passed, F.lit(1)))


@dataclass(frozen=True)
class TwoSampleTest:
    """Logistic regressions that tell each load's rows from the whole table, cross-fitted over ``folds``.

    Rows enter as patterns of levels with counts. A load's model is fitted in the task that holds the load, on at most
    ``sample`` of its patterns and as many of the whole table (priority sampling by count, without bias); each fold is
    scored by the model that didn't see it, over all rows. Areas under the curve compare the load with all other rows.
    """

    columns: tuple[str, ...]
    medians: dict
    folds: int = 4
    sample: int = 4096
    iterations: int = 10
    rate: float = 0.35
    ridge: float = 1.0
    bins: int = 128
    block: int = 512  # loads whose models are sent to the tasks at once

    @property
    def edges(self) -> list[list[float]]:
        return [level_edges(self.medians[c]) for c in self.columns]

    @property
    def levels(self) -> int:
        return 2 + max(map(len, self.edges), default=0)

    @property
    def codes(self) -> list[str]:
        return [f"p{i}" for i in range(-(-len(self.columns) // 16))]

    def patterns(self, table: DataFrame, load: str) -> DataFrame:
        """load, fold, levels packed in numbers (16 columns each), n: one row a distinct pattern of a load and fold."""
        packed = []
        for i in range(len(self.codes)):
            code = F.lit(0).cast("bigint")
            for c, edges in list(zip(self.columns, self.edges, strict=True))[16 * i : 16 * i + 16]:
                code = code * self.levels + level(as_number(c), edges)
            packed.append(code.alias(f"p{i}"))
        rows = table.select(F.col(load).cast("bigint").alias("load"), F.pmod(F.xxhash64("row_id"), F.lit(self.folds)).cast("int").alias("fold"), *packed)
        return rows.groupBy("load", "fold", *self.codes).agg(F.count(F.lit(1)).alias("n"))

    def unpacked(self, rows: pd.DataFrame) -> np.ndarray:
        """Level of each pattern and column, as places in a row of all levels of all columns."""
        out = np.zeros((len(rows), len(self.columns)), dtype=np.int64)
        for i, name in enumerate(self.codes):
            code = rows[name].to_numpy("int64").copy()
            for k in range(min(len(self.columns), 16 * i + 16) - 1, 16 * i - 1, -1):
                out[:, k] = code % self.levels
                code //= self.levels
        return out + np.arange(len(self.columns)) * self.levels

    def sampled(self, places: np.ndarray, fold: np.ndarray, n: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a bounded sample and their weights."""
        if len(n) <= self.sample:
            return np.arange(len(n)), n.astype(float)
        mixed = (places @ (2654435761 ** np.arange(1, places.shape[1] + 1, dtype=object) % (1 << 31)).astype(np.int64) + fold * 40503 + salt) % 2147483647
        u = ((mixed * 48271) % 2147483647 + 1) / 2147483648
        priority = n / u
        order = np.argsort(-priority, kind="stable")
        return order[: self.sample], np.maximum(n[order[: self.sample]], priority[order[self.sample]])

    def one_hot(self, places: np.ndarray) -> np.ndarray:
        x = np.zeros((len(places), len(self.columns) * self.levels + 1), dtype=np.float32)
        np.put_along_axis(x, places, 1.0, axis=1)
        x[:, -1] = 1.0
        return x

    def fit(self, own: tuple, whole: tuple) -> np.ndarray:
        """Weights by fold left out. Sides: one-hot rows, fold, weight."""
        x = np.concatenate([own[0], whole[0]])
        fold, mine = np.concatenate([own[1], whole[1]]), np.arange(len(x)) < len(own[0])
        n = np.concatenate([own[2], whole[2]])[:, None] * (fold[:, None] != np.arange(self.folds))
        sums = np.where(mine[:, None], n, 0).sum(axis=0), np.where(mine[:, None], 0, n).sum(axis=0)
        weight = (n * np.where(mine[:, None], 0.5 / np.maximum(sums[0], 1), 0.5 / np.maximum(sums[1], 1))).astype(np.float32)
        goal, squares = mine[:, None].astype(np.float32), x.T
        w = np.zeros((x.shape[1], self.folds), dtype=np.float32)
        ridge = (self.ridge / np.maximum(sums[0], 1)).astype(np.float32)
        for _ in range(self.iterations):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope, curve = squares @ (weight * (p - goal)), squares @ (weight * p * (1 - p))
            w -= self.rate * (slope + ridge * w) / (curve + ridge)
        return w.T.astype(float)

    def variants(self, places: np.ndarray, w: np.ndarray) -> Iterator[np.ndarray]:
        """Scores with all columns, then without each one."""
        parts_of = [w[places[:, k]] for k in range(places.shape[1])]
        score = sum(parts_of) + w[-1]
        yield score
        for part in parts_of:
            yield score - part

    def step(self, score: np.ndarray) -> np.ndarray:
        return np.clip((score + 12) * (self.bins / 24), 0, self.bins - 1).astype(np.int64)

    def histogram(self, places: np.ndarray, fold: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Counts by variant and step of the score; ``w`` by fold left out."""
        out = np.zeros((len(self.columns) + 1, self.bins))
        for k in range(self.folds):
            at = fold == k
            for v, score in enumerate(self.variants(places[at], w[k])):
                out[v] += np.bincount(self.step(score), n[at], self.bins)
        return out

    def marginals(self, places: np.ndarray, fold: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Counts by fold, column and level."""
        width = len(self.columns) * self.levels
        flat = np.bincount((places + fold[:, None] * width).ravel(), np.repeat(n, places.shape[1]), self.folds * width)
        return flat.reshape(self.folds, len(self.columns), self.levels)

    def area_alone(self, own: np.ndarray, whole: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Area of each column alone, exactly from the counts of its levels, averaged over folds by the load's rows."""
        out = np.zeros(len(self.columns))
        for k in range(self.folds):
            for c in range(len(self.columns)):
                mine, rest = own[k, c], whole[k, c] - own[k, c]
                score = np.round(w[k][c * self.levels : (c + 1) * self.levels], 6)
                distinct, at = np.unique(score, return_inverse=True)
                a, b = np.bincount(at, mine, len(distinct)), np.bincount(at, rest, len(distinct))
                pairs = a.sum() * b.sum()
                out[c] += mine.sum() * ((a * (b.cumsum() - b / 2)).sum() / pairs if pairs else 0.5)
        return out / max(own[:, 0].sum(), 1)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Which levels of a column lie below a tenth of its median, and which above ten times it."""
        below, above = np.zeros((len(self.columns), self.levels), bool), np.zeros((len(self.columns), self.levels), bool)
        for c, (name, edges) in enumerate(zip(self.columns, self.edges, strict=True)):
            if edges:
                low, high = 0.1 * self.medians[name], np.nextafter(10 * self.medians[name], np.inf)
                for at in range(1, len(edges) + 2):
                    below[c, at] = at <= len(edges) and edges[at - 1] <= low
                    above[c, at] = at > 1 and edges[at - 2] >= high
        return below, above

    def scores(self, table: DataFrame, load: str) -> DataFrame:
        """load, rows, column, area, area_without, area_alone, n (values), below and above (values beyond the limits)."""
        spark, names = table.sparkSession, ["fold", *self.codes]
        patterns = cut(self.patterns(table, load))
        whole = cut(patterns.groupBy(*names).agg(F.sum("n").alias("n")))
        # a bounded sample of the whole table's patterns and its counts by level go to every task
        u = (F.shiftrightunsigned(F.xxhash64(*names), 11).cast("double") + 1.0) / float(1 << 53)
        head = whole.withColumn("priority", F.col("n") / u).orderBy(F.desc("priority")).limit(self.sample + 1).toPandas()
        least = head["priority"].iloc[-1] if len(head) > self.sample else 0.0
        head = head.iloc[: self.sample]
        reference = spark.sparkContext.broadcast((self.unpacked(head), head["fold"].to_numpy("int64"), np.maximum(head["n"].to_numpy(float), least)))
        level_sums = np.zeros((self.folds, len(self.columns), self.levels))
        counted_levels = whole.mapInPandas(self._marginal_rows, "place int, n double").groupBy("place").agg(F.sum("n").alias("n"))
        for r in counted_levels.collect():  # folds times columns times levels
            level_sums.flat[r["place"]] = r["n"]
        below, above = self.bounds()

        def fit_load(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            places, fold, n = self.unpacked(rows), rows["fold"].to_numpy("int64"), rows["n"].to_numpy(float)
            some, weight = self.sampled(places, fold, n, 11)
            ref = reference.value
            w = self.fit((self.one_hot(places[some]), fold[some], weight), (self.one_hot(ref[0]), ref[1], ref[2]))
            own = self.marginals(places, fold, n)
            flat = own.sum(axis=0)
            return pd.DataFrame({
                "load": [key[0]], "rows": [int(n.sum())], "weights": [w.tobytes()], "own": [self.histogram(places, fold, n, w).tobytes()],
                "alone": [self.area_alone(own, level_sums, w)], "n": [flat[:, 1:].sum(axis=1).astype(int)],
                "below": [np.where(below, flat, 0).sum(axis=1).astype(int)], "above": [np.where(above, flat, 0).sum(axis=1).astype(int)],
            })

        schema = "load bigint, rows bigint, weights binary, own binary, alone array<double>, n array<bigint>, below array<bigint>, above array<bigint>"
        loaded = patterns.where("load is not null")
        models = cut(loaded.repartition(parts(spark, loaded.count(), 50_000), "load").groupBy("load").applyInPandas(fit_load, schema))
        listed = sorted(r["load"] for r in models.select("load").collect())
        shape = (self.folds, len(self.columns) * self.levels + 1)
        spread = whole.repartition(parts(spark, whole.count(), 20_000))
        everyone = []
        for a in range(0, len(listed), self.block):
            own_block = models.where(F.col("load").between(listed[a], listed[min(a + self.block, len(listed)) - 1]))
            held = {r["load"]: np.frombuffer(r["weights"]).reshape(shape) for r in own_block.select("load", "weights").collect()}
            everyone.append(spread.mapInPandas(self._whole_histograms(spark.sparkContext.broadcast(held)), "load bigint, whole binary"))
        if not everyone:
            return spark.createDataFrame([], "load bigint, rows bigint, column string, area double, area_without double, area_alone double, n bigint, below bigint, above bigint")

        def areas(key: tuple, model: pd.DataFrame, partial: pd.DataFrame) -> pd.DataFrame:
            size = (len(self.columns) + 1, self.bins)
            whole_sum = sum((np.frombuffer(x).reshape(size) for x in partial["whole"]), np.zeros(size))
            own, mine = np.frombuffer(model["own"].iat[0]).reshape(size), float(model["rows"].iat[0])
            # pairs of the load with itself are half won: what is left are pairs with the rest
            pairs = mine * (whole_sum[0].sum() - mine)
            area = ((own * (whole_sum.cumsum(axis=1) - whole_sum / 2)).sum(axis=1) - mine * mine / 2) / pairs if pairs else np.full(size[0], 0.5)
            take = lambda c: list(model[c].iat[0])
            return pd.DataFrame({
                "load": key[0], "rows": int(mine), "column": list(self.columns), "area": area[0], "area_without": area[1:], "area_alone": take("alone"),
                "n": take("n"), "below": take("below"), "above": take("above"),
            })

        histograms = reduce(DataFrame.unionByName, everyone)
        return models.groupBy("load").cogroup(histograms.groupBy("load")).applyInPandas(
            areas, "load bigint, rows bigint, column string, area double, area_without double, area_alone double, n bigint, below bigint, above bigint"
        )

    def _marginal_rows(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(self.folds * len(self.columns) * self.levels)
        for rows in batches:
            total += self.marginals(self.unpacked(rows), rows["fold"].to_numpy("int64"), rows["n"].to_numpy(float)).ravel()
        at = np.flatnonzero(total)
        yield pd.DataFrame({"place": at.astype("int32"), "n": total[at]})

    def _whole_histograms(self, shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            models, total = shared.value, {}
            for rows in batches:
                places, fold, n = self.unpacked(rows), rows["fold"].to_numpy("int64"), rows["n"].to_numpy(float)
                for load, w in models.items():
                    made = self.histogram(places, fold, n, w)
                    total[load] = total[load] + made if load in total else made
            yield pd.DataFrame({"load": list(total), "whole": [x.tobytes() for x in total.values()]})

        return run


def two_sample_test(table: DataFrame, columns: list[str], load: str = "load_id", **options) -> tuple[dict[str, float | None], DataFrame]:
    """Exact medians of the table, and the scores of ``TwoSampleTest`` with ``named``: whether the load stands out in the column.

    It does where the column alone tells the load from the rest (area of 0.55 or more), or leaving it out costs 0.05.
    """
    medians = exact_medians(table, columns)
    tested = TwoSampleTest(tuple(columns), medians, **options).scores(table, load)
    return medians, cut(tested.withColumn("named", (F.col("area_alone") >= 0.55) | (F.col("area") - F.col("area_without") >= 0.05)))


def outstanding_loads(table: DataFrame, name: str, columns: list[str], load: str = "load_id", least_rows: int = 10) -> DataFrame:
    """src_table, rule_name, ref_id for loads that stand out: null_surge and median_shift by column.

    The two-sample test names loads and columns, whatever their size; no finding comes but through it. The exact check then
    looks at the counts of values beyond the limits: a median lies below a limit exactly if the values below it are the
    majority. Only where they are just half, the two middle values are read.
    """
    medians, tested = two_sample_test(table, columns, load)
    twice = lambda c: F.col(c) * 2
    suspects = tested.where(F.col("named") & (F.col("rows") >= least_rows))
    surge = (F.col("rows") - F.col("n")) * 2 >= F.col("rows")
    tied = ~surge & (F.col("n") > 0) & ((twice("below") == F.col("n")) | (twice("above") == F.col("n")))
    rule = F.when(surge, F.concat(F.lit("null_surge:"), "column")).when((F.col("n") > 0) & ((twice("below") > F.col("n")) | (twice("above") > F.col("n"))), F.concat(F.lit("median_shift:"), "column"))
    found = suspects.select(F.lit(name).alias("src_table"), rule.alias("rule_name"), F.col("load").alias("ref_id")).where("rule_name is not null")
    ties = suspects.where(tied & ~((twice("below") > F.col("n")) | (twice("above") > F.col("n"))))
    if not ties.limit(1).count():
        return found
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), as_number(c).alias("v"), F.lit(0.1 * medians[c]).alias("low"), F.lit(10 * medians[c]).alias("high")) for c in columns if medians[c] is not None
    ])
    asked = small(ties.groupBy(F.col("load").alias("suspect_load")).agg(F.collect_set("column").alias("suspects")))
    picked = table.join(asked, F.col(load).cast("bigint") == F.col("suspect_load")).select(
        F.col("suspect_load").alias("load"), F.explode(F.filter(cells, lambda x: F.array_contains("suspects", x["column"]))).alias("x")
    ).select("load", "x.*").where("v is not null")
    v = F.col("v")
    middle = picked.groupBy("load", "column", "low", "high").agg(
        F.count("v").alias("n"), F.count_if(v < F.col("low")).alias("below"), F.count_if(v > F.col("high")).alias("above"),
        ((F.max(F.when(v < F.col("low"), v)) + F.min(F.when(v >= F.col("low"), v))) / 2).alias("low_middle"),
        ((F.min(F.when(v > F.col("high"), v)) + F.max(F.when(v <= F.col("high"), v))) / 2).alias("high_middle"),
    )
    shifted = ((twice("below") == F.col("n")) & (F.col("low_middle") < F.col("low"))) | ((twice("above") == F.col("n")) & (F.col("high_middle") > F.col("high")))
    return found.unionByName(middle.where(shifted).select(F.lit(name).alias("src_table"), F.concat(F.lit("median_shift:"), "column").alias("rule_name"), F.col("load").alias("ref_id")))


def quality_findings(stock_daily: DataFrame, income: DataFrame) -> DataFrame:
    """src_table, rule_name, ref_id."""
    return (
        broken_rules(stock_daily, "stock_daily", bar_rules())
        .unionByName(broken_rules(income, "income", report_rules()))
        .unionByName(outstanding_loads(stock_daily, "stock_daily", list(BAR_COLUMNS)))
    )


def column_profile(table: DataFrame, name: str) -> DataFrame:
    """src_table, column_name, n_rows, n_null, n_distinct, low, high: exact, ranges as text (numbers: of the number).

    Distinct values are counted on their 64-bit hashes, deduplicated before the shuffle; NaN counts as null.
    """
    atomic = [f for f in table.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    value = {f.name: as_number(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in atomic}
    base = table.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[x for i, f in enumerate(atomic) for x in (F.count(value[f.name]).alias(f"c{i}"), F.min(value[f.name]).cast("string").alias(f"a{i}"), F.max(value[f.name]).cast("string").alias(f"b{i}"))],
    )
    cells = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col("n_rows"), (F.col("n_rows") - F.col(f"c{i}")).alias("n_null"), F.col(f"a{i}").alias("low"), F.col(f"b{i}").alias("high")) for i, f in enumerate(atomic)])
    base = base.select(F.explode(cells).alias("x")).select("x.*")
    hashes = F.array(*[F.when(value[f.name].isNotNull(), F.struct(F.lit(f.name).alias("column_name"), F.xxhash64(value[f.name]).alias("h"))) for f in atomic])
    distinct = table.select(F.explode(F.array_compact(hashes)).alias("x")).select("x.*").distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    return base.join(distinct, "column_name", "left").select(
        F.lit(name).alias("src_table"), "column_name", "n_rows", "n_null", F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct"), "low", "high"
    )
