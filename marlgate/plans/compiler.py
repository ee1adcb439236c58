"""Terms to DataFrame columns over a long panel (asset, session, session_idx, fields).

Equal terms are computed once, for all expressions together. Work is staged: everything along sessions whose inputs are
ready is added first (one shuffle by asset serves all of it, whatever the depth), then everything across assets (one
shuffle by session); the two only alternate where an expression really nests them. Recursive terms of a stage share one
grouped Arrow function. All else stays in JVM expressions.

The panel has a row for every session of the calendar and every asset (``dense_panel``): a shift counts sessions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlgate.plans.algebra import RECURSIVE, SCALAR, SECTION, SERIES, Term, number, post_order, reach
from marlgate.plans.parser import parse

KEYS = ("asset", "session", "session_idx")


def along():
    """An asset's sessions in order."""
    return Window.partitionBy("asset").orderBy("session_idx")


def across():
    """A session's assets."""
    return Window.partitionBy("session")


def scalar_column(term: Term, args: list[Column], fields: Callable[[str], Column]) -> Column:
    op, p = term.op, term.params
    if op == "lit":
        return F.lit(p[0]).cast("double")
    if op == "field":
        return fields(p[0])
    simple: dict[str, Callable[..., Column]] = {
        "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": F.try_divide, "neg": lambda a: -a,
        "mod": lambda a, b: F.when(b != 0, a - b * F.floor(a / b)), "abs": F.abs, "sign": F.signum, "greatest": F.greatest, "least": F.least,
        "lt": lambda a, b: F.coalesce(a < b, F.lit(False)), "le": lambda a, b: F.coalesce(a <= b, F.lit(False)),
        "gt": lambda a, b: F.coalesce(a > b, F.lit(False)), "ge": lambda a, b: F.coalesce(a >= b, F.lit(False)),
        "eq": lambda a, b: F.coalesce(a == b, F.lit(False)), "ne": lambda a, b: F.coalesce(a != b, F.lit(True)),
        "and": lambda a, b: a & b, "or": lambda a, b: a | b, "not": lambda a: ~a, "truth": lambda a: F.coalesce(a != 0, F.lit(True)),
        "present": lambda a: a.isNotNull(), "num": lambda a: a.cast("double"), "if": lambda c, a, b: F.when(c, a).otherwise(b),
        "ln": lambda a: F.when(a > 0, F.log(a)), "angle": lambda a: F.degrees(F.atan(a)), "half_even": lambda a: F.rint(a * 10.0 ** p[0]) / 10.0 ** p[0],
        # a power without a real value, and one of zero to below zero, is missing
        "pow": lambda a, b: F.when(~((a < 0) & (b != F.floor(b))) & ~((a == 0) & (b < 0)), F.pow(a, b)),
    }
    return simple[op](*args)


def series_column(term: Term, args: list[Column]) -> Column:
    op, p = term.op, term.params
    x = args[0] if args else None
    if op == "shift":
        return (F.lag(x, p[0]) if p[0] > 0 else F.lead(x, -p[0])).over(along())
    if op == "session":
        return F.col("session_idx").cast("double")
    if op == "running_sum":
        return F.when(x.isNotNull(), F.sum(x).over(along().rowsBetween(Window.unboundedPreceding, 0)))
    if op == "last_true":
        return F.last(F.when(x > 0, F.col("session_idx").cast("double")), ignorenulls=True).over(along().rowsBetween(Window.unboundedPreceding, 0))
    if op == "final":
        return F.last(x).over(along().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    n, start = (p[1], p[2]) if op == "roll" else (p[-1], 0)
    frame = along().rowsBetween(-(n - 1) - start, -start)
    over = lambda c: c.over(frame)
    full = over(F.count(x)) == n
    if op == "roll":
        how = p[0]
        even = over(F.min(x)) == over(F.max(x))  # a window of equal values has no skew, and a tail of -3
        if how == "skew":
            made = over(F.skewness(x)) * ((n * (n - 1)) ** 0.5 / (n - 2)) if n > 2 else F.lit(None).cast("double")
            return F.when(full, F.when(even, 0.0 if n > 2 else None).otherwise(made))
        if how == "kurt":
            made = (over(F.kurtosis(x)) * (n + 1) + 6) * ((n - 1) / ((n - 2) * (n - 3))) if n > 3 else F.lit(None).cast("double")
            return F.when(full, F.when(even, -3.0 if n > 3 else None).otherwise(made))
        made = {
            "mean": F.avg, "sum": F.sum, "product": F.product, "std": F.stddev_samp, "var": F.var_samp, "pstd": F.stddev_pop, "max": F.max, "min": F.min,
            "median": lambda c: F.percentile(c, F.lit(0.5)),
        }[how](x)
        return F.when(full, over(made))
    if op == "trend":
        return F.when(full, over(F.regr_slope(x, F.col("session_idx").cast("double"))))
    if op == "roll2":
        y = args[1]
        both = full & (over(F.count(y)) == n)
        if p[0] == "cov":
            return F.when(both, over(F.covar_samp(x, y)))
        return F.when(both, F.try_divide(over(F.covar_pop(x, y)), over(F.stddev_pop(x)) * over(F.stddev_pop(y))))
    raise ValueError(f"unknown term {op}")


def section_column(term: Term, x: Column) -> Column:
    if term.op == "x_rank":
        # average rank of ties over the number of values; missing values sort last and have no rank
        first = F.rank().over(across().orderBy(x.asc_nulls_last()))
        ties = F.count(F.lit(1)).over(Window.partitionBy("session", x))
        return F.when(x.isNotNull(), (first + (ties - 1) / 2) / F.count(x).over(across()))
    return {"x_min": F.min, "x_max": F.max, "x_mean": F.avg, "x_std": F.stddev_pop}[term.op](x).over(across())


def window_shapes(how: str, x: np.ndarray, n: int) -> np.ndarray:
    """What needs a window's values themselves, for all windows of one asset at once; missing unless all n are there."""
    out = np.full(len(x), np.nan)
    if len(x) < n:
        return out
    windows = np.lib.stride_tricks.sliding_window_view(x, n)
    whole = np.isfinite(windows).all(axis=1)
    v = windows[whole]
    if how == "argmax":
        made = v.argmax(axis=1)
    elif how == "argmin":
        made = v.argmin(axis=1)
    elif how == "rank":
        last = v[:, -1:]
        made = ((v < last).sum(axis=1) + ((v == last).sum(axis=1) + 1) / 2) / n
    elif how == "mad":
        made = np.abs(v - v.mean(axis=1, keepdims=True)).mean(axis=1)
    else:
        made = v @ np.arange(1, n + 1) / (n * (n + 1) / 2)
    out[n - 1 :][whole] = made
    return out


def recursive_values(term: Term, x: np.ndarray, y: np.ndarray | None) -> np.ndarray:
    """One asset's values in session order; NaN is missing."""
    out = np.full(len(x), np.nan)
    if term.op == "shape":
        return window_shapes(term.params[0], x, term.params[1])
    if term.op == "ewm":
        alpha, least = term.params
        if alpha == 1.0 or len(x) == 0:
            filled = pd.Series(x).ffill().to_numpy(copy=True)
        else:
            filled = pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=0).mean().to_numpy(copy=True)
        filled[np.cumsum(np.isfinite(x)) < max(1, least)] = np.nan
        return filled
    if term.op == "dma":
        if np.any((y <= 0) | (y >= 1)):
            raise ValueError("DMA needs factors between 0 and 1")
        return _folded(x, y, lambda before, value, factor: factor * value + (1 - factor) * before)
    last = [np.nan]

    def adapted(before: float, value: float, factor: float) -> float:
        start = before if before == before else last[0]  # after a gap from the value before
        last[0] = value
        return start + factor * (value - start)

    last[0] = x[0] if len(x) else np.nan
    return _folded(x, y, adapted)


def _folded(x: np.ndarray, y: np.ndarray, step: Callable[[float, float, float], float]) -> np.ndarray:
    """The first value, then each from the one before; over plain numbers, which Python handles fastest."""
    values, factors = x.tolist(), y.tolist()
    out = values[:1]
    for value, factor in zip(values[1:], factors[1:], strict=True):
        out.append(step(out[-1], value, factor))
    return np.array(out, dtype=float)


def add_recursive(df: DataFrame, work: list[tuple[str, Term, list[str]]]) -> DataFrame:
    """All recursive terms of a stage, computed asset by asset in one pass. A group is one asset's sessions: days, not rows."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(name, T.DoubleType()) for name, _, _ in work]])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows["session_idx"].to_numpy(), kind="stable"))).combine_chunks()
        for name, term, inputs in work:  # only what a term needs leaves Arrow
            values = [rows[c].cast(pa.float64()).to_numpy() for c in inputs]
            made = recursive_values(term, values[0], values[1] if len(values) > 1 else None)
            rows = rows.append_column(name, pa.array(made, pa.float64(), mask=~np.isfinite(made)))
        return rows

    return df.groupBy("asset").applyInArrow(run, schema)


def evaluate(panel: DataFrame, expressions: dict[str, str | Term], keep: tuple[str, ...] = (), fields: Callable[[str], Column] | None = None) -> DataFrame:
    """Keys, kept columns and one double column for each named expression. Infinite results are missing."""
    roots = {name: number(parse(e) if isinstance(e, str) else e) for name, e in expressions.items()}
    order = post_order(list(roots.values()))
    own_fields = fields or (lambda name: _field(panel, name))
    used = sorted({t.params[0] for t in order if t.op == "field"})
    # positional names: a panel's own columns can't clash with what is added
    df = panel.select(*KEYS, *[panel[c].alias(f"_k{i}") for i, c in enumerate(keep)], *[own_fields(f).alias(f"_f{i}") for i, f in enumerate(used)])
    ready: dict[Term, Column] = {}

    def column(term: Term) -> Column:
        if term not in ready:
            args = [column(a) for a in term.args]
            ready[term] = scalar_column(term, args, lambda name: F.col(f"_f{used.index(name)}"))
        return ready[term]

    waiting = [t for t in order if t.kind != SCALAR]
    needs = {t: [u for u in post_order(list(t.args)) if u.kind != SCALAR] for t in waiting}
    serial = 0
    while waiting:
        done = {t for t in ready if t.kind != SCALAR}
        open_terms = [t for t in waiting if all(u in done for u in needs[t])]
        stage = [t for t in open_terms if t.kind == SERIES] or [t for t in open_terms if t.kind == RECURSIVE] or open_terms
        kind, names = stage[0].kind, {}
        for t in stage:
            names[t] = f"_t{serial}"
            serial += 1
        if kind == SECTION:
            inputs = {f"{names[t]}x": column(t.args[0]) for t in stage}
            df = df.withColumns(inputs)
            df = df.withColumns({names[t]: section_column(t, F.col(f"{names[t]}x")) for t in stage}).drop(*inputs)
        elif kind == SERIES:
            df = df.withColumns({names[t]: series_column(t, [column(a) for a in t.args]) for t in stage})
        else:
            inputs = {f"{names[t]}x{i}": column(a) for t in stage for i, a in enumerate(t.args)}
            df = add_recursive(df.withColumns(inputs), [(names[t], t, [f"{names[t]}x{i}" for i in range(len(t.args))]) for t in stage]).drop(*inputs)
        for t in stage:
            ready[t] = F.col(names[t])
        waiting = [t for t in waiting if t not in ready]
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    return df.select(*KEYS, *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *[finite(column(t)).alias(name) for name, t in roots.items()])


def _field(panel: DataFrame, name: str) -> Column:
    by_lower = {c.lower(): c for c in panel.columns}
    if name not in by_lower:
        raise KeyError(f"no field {name!r}")
    if isinstance(panel.schema[by_lower[name]].dataType, T.StringType):
        raise TypeError(f"{name!r} is text: it has no place in an expression")
    c = panel[by_lower[name]].cast("double")
    return F.when(~F.isnan(c), c)


def dense_panel(rows: DataFrame, values: list[str]) -> DataFrame:
    """A row for every session of every asset. ``rows``: asset, session, values; one row per asset and session.

    The calendar (its distinct sessions) comes to the driver: as many values as there are trading days.
    """
    kind = rows.schema["session"].dataType
    days = sorted(r[0] for r in rows.select("session").distinct().collect() if r[0] is not None)
    # one literal for the whole calendar
    calendar = (F.split(F.lit(",".join(map(str, days))), ",") if days else F.array()).cast(T.ArrayType(kind))
    grid = rows.select("asset").distinct().select("asset", F.posexplode(calendar).alias("session_idx", "session"))
    return grid.join(rows.select("asset", "session", *values), ["asset", "session"], "left").select("asset", "session", "session_idx", *values)


def evaluate_range(panel: DataFrame, expressions: dict[str, str], start=None, end=None, allow_future: bool = False, warmup: str = "full") -> DataFrame:
    """Results for sessions from ``start`` to ``end``.

    ``warmup``: "full" reads all earlier sessions, "window" only as many as the expressions reach back (all where they have
    memory), so old partitions aren't read. Sessions after ``end`` are read only with ``allow_future``.
    """
    reaches = [reach(number(parse(e))) for e in expressions.values()]
    calendar = panel.select("session", "session_idx").distinct()
    bounds = calendar.where(F.lit(True) if start is None else F.col("session") >= F.lit(start)).agg(F.min("session_idx")).first()[0]
    last = calendar.where(F.lit(True) if end is None else F.col("session") <= F.lit(end)).agg(F.max("session_idx")).first()[0]
    source = panel
    if warmup == "window" and bounds is not None and all(b is not None for b, _ in reaches):
        source = source.where(F.col("session_idx") >= bounds - max(b for b, _ in reaches))
    if last is not None:
        source = source.where(F.col("session_idx") <= last + (max(a for _, a in reaches) if allow_future else 0))
    out = evaluate(source, expressions)
    if start is not None:
        out = out.where(F.col("session") >= F.lit(start))
    return out if end is None else out.where(F.col("session") <= F.lit(end))
