"""Point-in-time access: adjusted prices, statements as known, constituents, universes, calendars.

Everything is strictly before the day where the day's own announcement isn't known yet. As-of joins are windows over the
union of both sides or joins on validity intervals, never a product of the two.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlgate.functions.normalize import require

PRICES = ("open", "high", "low", "close", "price")


def last_known(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, known: str, values: Sequence[str], strict: bool = True) -> DataFrame:
    """For every left row the values of the right side's last row known before ``at`` (or at it, unless ``strict``).

    Facts and the distinct times asked about are ordered together by (entity, time), once, and joined back to the events; of
    right rows known together the greatest values win.
    """
    require(left, *by, at)
    require(right, *by, known, *values)
    one = right.where(F.col(known).isNotNull()).groupBy(*by, known).agg(F.max(F.struct(*values)).alias("_v"))
    side = {"facts": 1 if strict else 0, "events": 0 if strict else 1}
    facts = one.select(*by, F.col(known).alias("_at"), F.lit(side["facts"]).alias("_side"), F.col(known).alias("_known"), "_v")
    # an entity's events shrink to the times they ask about before they are sorted with its facts
    asked = left.select(*by, F.col(at).alias("_at")).distinct().select(
        *by, "_at", F.lit(side["events"]).alias("_side"), F.lit(None).cast(right.schema[known].dataType).alias("_known"), F.lit(None).cast(one.schema["_v"].dataType).alias("_v")
    )
    order = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = facts.unionByName(asked).withColumn("_last", F.last("_v", ignorenulls=True).over(order)).withColumn("_used", F.last("_known", ignorenulls=True).over(order))
    found = both.where(F.col("_side") == side["events"]).select(*[F.col(k).alias(f"_by{i}") for i, k in enumerate(by)], "_at", "_used", "_last")
    on = [left[k] == found[f"_by{i}"] for i, k in enumerate(by)] + [left[at] == found["_at"]]
    taken = [F.col(f"_last.{v}").alias(v if v not in left.columns else f"{v}_known") for v in values]
    return left.join(found, on, "left").select(*[left[c] for c in left.columns], F.col("_used").alias(f"{known}_used"), *taken)


def adjusted(bars: DataFrame, mode: str = "raw", factor: str = "adj_factor", reference: object = None) -> DataFrame:
    """Prices times the factor (``hfq``), and over the factor at the reference session (``qfq``; default: each asset's last).

    The factor is carried forward from its last positive value, 1 before the first. Volume is never negative.
    """
    if mode not in ("raw", "qfq", "hfq"):
        raise ValueError(f"unknown adjustment {mode!r}")
    out = bars.withColumn("volume", F.when(F.col("volume").isNotNull(), F.greatest("volume", F.lit(0.0)))) if "volume" in bars.columns else bars
    if mode == "raw":
        return out
    along = Window.partitionBy("asset").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_f", F.coalesce(F.last(F.when(F.col(factor) > 0, F.col(factor)), ignorenulls=True).over(along), F.lit(1.0)))
    if mode == "qfq":
        seen = F.col("_f") if reference is None else F.when(F.col("session") <= F.lit(reference), F.col("_f"))
        at = F.max_by(seen, F.when(seen.isNotNull(), F.col("session"))).over(Window.partitionBy("asset"))
        out = out.withColumn("_f", F.col("_f") / F.coalesce(at, F.lit(1.0)))
    return out.withColumns({c: F.col(c) * F.col("_f") for c in PRICES if c in out.columns}).drop("_f")


def statements_known(reports: DataFrame, day: object, fields: Sequence[str], report_type: str | None = "1", periods: int = 1) -> DataFrame:
    """Each company's last ``periods`` report periods as known before ``day``, one version each.

    A version counts if it became effective before the day and its period isn't in the future; of a period's versions the
    latest effective, then the updated, then the highest source_order.
    """
    known = reports.where((F.col("effective_ann_date") < F.lit(day)) & (F.col("end_date") <= F.lit(day)))
    if report_type is not None and "report_type" in reports.columns:
        known = known.where(F.col("report_type") == report_type)
    order = F.struct("effective_ann_date", (F.coalesce(F.col("update_flag"), F.lit("")) == "1").alias("updated"), "source_order")
    best = known.groupBy("ts_code", "end_date").agg(F.max_by(F.struct("effective_ann_date", *fields), order).alias("v"))
    place = F.row_number().over(Window.partitionBy("ts_code").orderBy(F.col("end_date").desc()))
    return best.withColumn("_n", place).where(F.col("_n") <= periods).select("ts_code", "end_date", "v.*")


def snapshot_intervals(snapshots: DataFrame) -> DataFrame:
    """series, snapshot, valid_until: a snapshot counts on days after it, up to and on the day of the next."""
    days = snapshots.select("series", "snapshot").distinct()
    return days.withColumn("valid_until", F.lead("snapshot").over(Window.partitionBy("series").orderBy("snapshot")))


def members_on(snapshots: DataFrame, day: object) -> DataFrame:
    """series, snapshot, item and other columns of the latest snapshot strictly before the day; none before the first."""
    before = snapshots.where(F.col("snapshot") < F.lit(day))
    last = before.groupBy("series").agg(F.max("snapshot").alias("snapshot"))
    return before.join(last, ["series", "snapshot"], "left_semi")


def universe(panel: DataFrame, listed_days: int = 0, exclude_flags: Sequence[str] = ()) -> DataFrame:
    """Add ``in_universe``: alive, listed for so many calendar days, and none of the flags set."""
    alive = (F.col("list_date") <= F.col("session")) & (F.col("delist_date").isNull() | (F.col("session") <= F.col("delist_date")))
    old = F.datediff("session", "list_date") >= listed_days
    ok = F.coalesce(alive & old, F.lit(False))
    for flag in exclude_flags:
        ok = ok & (F.coalesce(F.col(flag).cast("double"), F.lit(0.0)) == 0)
    return panel.withColumn("in_universe", ok)


def benchmark_returns(closes: DataFrame, calendar: DataFrame) -> DataFrame:
    """session, benchmark_return: the last known close carried over sessions without one; the first is zero."""
    filled = calendar.select("session").distinct().join(closes.select("session", "close"), "session", "left")
    along = Window.partitionBy(F.lit(1)).orderBy("session")  # one series: a row a session
    filled = filled.withColumn("_c", F.last("close", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return filled.select("session", F.coalesce(F.try_divide("_c", F.lag("_c").over(along)) - 1, F.lit(0.0)).alias("benchmark_return"))


def sessions(trade_cal: DataFrame, exchange: str) -> DataFrame:
    """session (text), session_idx, previous and next session of an exchange's open days."""
    open_days = trade_cal.where((F.col("exchange") == exchange) & (F.col("is_open") == 1)).select(F.col("cal_date").alias("session")).distinct()
    order = Window.partitionBy(F.lit(1)).orderBy("session")  # a calendar
    return open_days.select("session", (F.row_number().over(order) - 1).alias("session_idx"), F.lag("session").over(order).alias("previous"), F.lead("session").over(order).alias("next"))


def session_window(calendar: DataFrame, end: object, count: int, include_end: bool = True) -> DataFrame:
    """The last ``count`` sessions up to a day."""
    upto = calendar.where(F.col("session") <= F.lit(end)) if include_end else calendar.where(F.col("session") < F.lit(end))
    return upto.orderBy(F.col("session").desc()).limit(count).orderBy("session")


def calendar_problems(trade_cal: DataFrame) -> DataFrame:
    """exchange, cal_date, problem: unreadable days, repeated days, gaps between natural days, broken chain of sessions."""
    day = F.try_to_timestamp("cal_date", F.lit("yyyyMMdd")).cast("date")
    rows = trade_cal.withColumn("_d", day)
    bad = rows.where(F.col("_d").isNull()).select("exchange", "cal_date", F.lit("unreadable").alias("problem"))
    one = rows.where(F.col("_d").isNotNull()).groupBy("exchange", "cal_date", "_d").agg(F.count(F.lit(1)).alias("n"), F.max("is_open").alias("is_open"), F.max("pretrade_date").alias("pretrade_date"))
    repeated = one.where("n > 1").select("exchange", "cal_date", F.lit("repeated").alias("problem"))
    order = Window.partitionBy("exchange").orderBy("_d")
    gaps = one.withColumn("_next", F.lead("_d").over(order)).where(F.datediff("_next", "_d") > 1).select("exchange", F.explode(F.sequence(F.date_add("_d", 1), F.date_sub("_next", 1))).alias("_g"))
    missing = gaps.select("exchange", F.date_format("_g", "yyyyMMdd").alias("cal_date"), F.lit("missing").alias("problem"))
    before = F.last(F.when(F.col("is_open") == 1, F.col("cal_date")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    chain = one.withColumn("_p", before).where((F.col("is_open") == 1) & F.col("_p").isNotNull() & F.col("pretrade_date").isNotNull() & (F.col("_p") != F.col("pretrade_date"))).select("exchange", "cal_date", F.lit("broken chain").alias("problem"))
    return bad.unionByName(repeated).unionByName(missing).unionByName(chain)


def tradable(bars: DataFrame, suspended: Column) -> Column:
    """A bar exists, the asset isn't suspended and something was traded."""
    return F.coalesce((F.col("close") > 0) & (F.col("volume") > 0) & ~suspended, F.lit(False))


def valid_at(events: DataFrame, intervals: DataFrame, by: Sequence[str], at: str, start: str, until: str, values: Sequence[str]) -> DataFrame:
    """Every event with the values of the interval it lies in (``start <= at < until``, an open end is null); of several the one that began last.

    ``intervals`` with a null or unreadable start count from the beginning.
    """
    spans = intervals.select(*[F.col(k).alias(f"_by{i}") for i, k in enumerate(by)], F.struct(F.col(start).alias("s"), F.col(until).alias("u"), *values).alias("_x"))
    listed = spans.groupBy(*[f"_by{i}" for i in range(len(by))]).agg(F.sort_array(F.collect_list("_x"), asc=False).alias("_spans"))  # an entity's memberships, not rows
    inside = F.filter("_spans", lambda x: (x["s"].isNull() | (x["s"] <= F.col(at))) & (x["u"].isNull() | (F.col(at) < x["u"])))
    found = events.join(listed, [events[k] == listed[f"_by{i}"] for i, k in enumerate(by)], "left").withColumn("_x", F.get(inside, 0))
    return found.select(*[events[c] for c in events.columns], *[F.col(f"_x.{v}").alias(v) for v in values])


def statements_joined(frames: Sequence[DataFrame], key: Sequence[str] = ("ts_code", "end_date")) -> DataFrame:
    """Statements of one company and period side by side; a period that one of them lacks keeps its row."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.join(frame, list(key), "full_outer")
    return out


def history(panel: DataFrame, fields: Sequence[str], end: object, bars: int, assets: Sequence[object] | None = None, mode: str = "raw", reference: object = None) -> DataFrame:
    """asset, session and fields of the last ``bars`` sessions up to ``end``; ``qfq`` is anchored at ``reference``, by default ``end``."""
    chosen = panel if assets is None else panel.where(F.col("asset").isin(list(assets)))
    upto = chosen.where(F.col("session") <= F.lit(end))
    last = panel.where(F.col("session") <= F.lit(end)).agg(F.max("session_idx")).first()[0]
    out = adjusted(upto, mode, reference=reference or end)
    return out.where(F.col("session_idx") > F.lit((-1 if last is None else last) - bars)).select("asset", "session", *fields)


def values_at(panel: DataFrame, fields: Sequence[str], session: object, assets: Sequence[object] | None = None, mode: str = "raw", reference: object = None) -> DataFrame:
    """asset and fields at one session."""
    return history(panel, fields, session, 1, assets, mode, reference).where(F.col("session") == F.lit(session)).drop("session")


def asset_life(basic: DataFrame, bars: DataFrame, start: object, end: object) -> DataFrame:
    """ts_code, first_seen, last_seen, life_start, life_end: from the latest of start, listing and first bar to the earlier of end and delisting.

    An asset without bars has no life; one without a listing day lives from its first bar.
    """
    seen = bars.groupBy("ts_code").agg(F.min("session").alias("first_seen"), F.max("session").alias("last_seen"))
    found = basic.select("ts_code", "list_date", "delist_date").join(seen, "ts_code", "left")
    begin = F.when(F.col("first_seen").isNotNull(), F.greatest(F.lit(start), "list_date", "first_seen"))
    return found.select("ts_code", "first_seen", "last_seen", begin.alias("life_start"), F.when(begin.isNotNull(), F.least(F.lit(end), "delist_date")).alias("life_end"))


def day_offsets(trade_cal: DataFrame, exchange: str, by: int) -> DataFrame:
    """cal_date, is_session, shifted: for every natural day whether it is a session, and the session ``by`` sessions on from it (back if negative).

    From a day without trading the count starts at the session before it (forwards) or after it (backwards).
    """
    days = trade_cal.where(F.col("exchange") == exchange).groupBy("cal_date").agg((F.max("is_open") == 1).alias("is_session"))
    order = Window.partitionBy(F.lit(1)).orderBy("cal_date")  # a calendar
    counted = days.withColumn("_n", F.sum(F.col("is_session").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    wanted = F.col("_n") + by + (0 if by >= 0 else F.when(F.col("is_session"), 0).otherwise(1))
    held = counted.where("is_session").select(F.col("_n").alias("_w"), F.col("cal_date").alias("shifted"))
    return counted.withColumn("_w", wanted).join(held, "_w", "left").select("cal_date", "is_session", "shifted")


def sessions_between(trade_cal: DataFrame, exchange: str, first: str, last: str) -> list[str]:
    """Open days from one to the other; both must be sessions."""
    open_days = [r[0] for r in sessions(trade_cal, exchange).where(F.col("session").between(first, last)).select("session").orderBy("session").collect()]  # a calendar
    if not open_days or open_days[0] != first or open_days[-1] != last:
        raise ValueError(f"{first} and {last} must both be sessions of {exchange}")
    return open_days


def safe_end(trade_cal: DataFrame, exchange: str, now: str, cutoff: str = "17:00") -> str | None:
    """The last session whose data is complete at ``now`` (``YYYYMMDD HH:MM``): today's only after the cutoff."""
    day, _, clock = now.partition(" ")
    upto = F.col("session") <= day if clock >= cutoff else F.col("session") < day
    return sessions(trade_cal, exchange).where(upto).agg(F.max("session")).first()[0]


def carried_in(facts: DataFrame, by: Sequence[str], known: str, value: str, start: object, end: object) -> DataFrame:
    """by, known, value: the facts of a window, and for each entity the last positive one before it, dated at its own time.

    So a carry-forward over the window needs no older history than one row an entity.
    """
    rows = facts.where(F.col(value) > 0).select(*by, known, value)
    before = rows.where(F.col(known) < F.lit(start)).groupBy(*by).agg(F.max(F.struct(known, value)).alias("_x")).select(*by, f"_x.{known}", f"_x.{value}")
    return before.unionByName(rows.where(F.col(known).between(F.lit(start), F.lit(end))))


def index_history(bars: DataFrame, calendar: DataFrame, fields: Sequence[str], start: object, end: object) -> DataFrame:
    """asset, session and fields of every index and every session of a span; a session without a bar has nulls."""
    days = calendar.where(F.col("session").between(F.lit(start), F.lit(end))).agg(F.sort_array(F.collect_set("session")).alias("_days"))  # a calendar
    named = bars.select("asset").where(F.col("asset").isNotNull()).distinct().withColumn("_one", F.lit(1))
    grid = named.join(days.withColumn("_one", F.lit(1)), "_one").select("asset", F.explode("_days").alias("session"))
    return grid.join(bars.select("asset", "session", *fields), ["asset", "session"], "left")


def statement_history(reports: DataFrame, code: str, report_type: str | None = "1") -> DataFrame:
    """All versions of one company's reports, in the order they became known."""
    rows = reports.where(F.col("ts_code") == code)
    return (rows if report_type is None else rows.where(F.col("report_type") == report_type)).orderBy("effective_ann_date", "end_date", "source_order")


def rebalance(now: DataFrame, target: DataFrame, tolerance: float = 2e-4) -> DataFrame:
    """asset, weight_now, weight_target, change, place: what to trade from one set of weights to the other, reductions first.

    Changes within the tolerance are left out; an asset that one side lacks weighs zero there.
    """
    met = now.select("asset", F.col("weight").alias("weight_now")).join(target.select("asset", F.col("weight").alias("weight_target")), "asset", "full_outer").fillna(0.0, ["weight_now", "weight_target"])
    moved = met.withColumn("change", F.col("weight_target") - F.col("weight_now")).where(F.abs("change") > tolerance)
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("change") >= 0, F.abs("change").desc(), "asset")  # a portfolio
    return moved.withColumn("place", F.row_number().over(order))


def flagged(bars: DataFrame, suspensions: DataFrame, specials: DataFrame, on: Sequence[str] = ("ts_code", "trade_date")) -> DataFrame:
    """Add ``suspended`` (1 where a suspension of type S is listed for the day, in any case) and ``is_st`` (1 where the day lists the asset at all)."""
    halted = suspensions.where(F.upper(F.coalesce("suspend_type", F.lit(""))) == "S").select(*on).distinct().withColumn("suspended", F.lit(1))
    listed = specials.select(*on).distinct().withColumn("is_st", F.lit(1))
    return bars.join(halted, list(on), "left").join(listed, list(on), "left").fillna(0, ["suspended", "is_st"])
