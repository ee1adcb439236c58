"""The factor language: syntax, operators against pandas formulas, staging."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from marlgate.plans import factor_queries
from marlgate.plans.algebra import reach
from marlgate.plans.compiler import dense_panel, evaluate, evaluate_range
from marlgate.plans.operators import OPERATORS, available_operators
from marlgate.plans.parser import expression_fields, is_expression, parse
from tests.conftest import spark_rows, sql_rows

ROWS, NAMES = 60, list("abcd")


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(7)
    close = pd.DataFrame(100 * np.exp(rng.normal(0, 0.02, (ROWS, 4)).cumsum(axis=0)), columns=NAMES)
    close.iloc[20:23, 1] = np.nan
    close.iloc[35:46, 2] = 50.1  # windows of equal values
    return {"close": close, "open": close.shift(1).fillna(close.iloc[0]), "volume": pd.DataFrame(rng.integers(1, 99, (ROWS, 4)).astype(float), columns=NAMES)}


@pytest.fixture(scope="module")
def panel(spark, wide):
    rows = [(a, i, i, *[None if np.isnan(wide[f].loc[i, a]) else float(wide[f].loc[i, a]) for f in ("close", "open", "volume")]) for a in NAMES for i in range(ROWS)]
    return spark.createDataFrame(rows, "asset string, session int, session_idx int, close double, open double, volume double").cache()


def values(frame, name="v"):
    out = frame.toPandas().pivot(index="session", columns="asset", values=name)
    return out.astype(float)


CASES = {
    "MA($close, 5)": lambda c, o, v: c.rolling(5).mean(), "STD($close, 6)": lambda c, o, v: c.rolling(6).std(), "TS_SKEW($close, 7)": lambda c, o, v: c.rolling(7).skew(),
    "TS_KURT($close, 7)": lambda c, o, v: c.rolling(7).kurt(), "TS_MEDIAN($close, 5)": lambda c, o, v: c.rolling(5).median(), "CORR($close, $volume, 8)": lambda c, o, v: c.rolling(8).corr(v),
    "COV($close, $volume, 8)": lambda c, o, v: c.rolling(8).cov(v), "RANK($close)": lambda c, o, v: c.rank(axis=1, pct=True), "EMA($close, 5)": lambda c, o, v: c.ewm(span=5, adjust=False, min_periods=5).mean(),
    "SMA($close, 5, 2)": lambda c, o, v: c.ewm(alpha=0.4, adjust=False, min_periods=5).mean(), "DMA($close, 0.3)": lambda c, o, v: c.ewm(alpha=0.3, adjust=False).mean(),
    "TS_RANK($close, 6)": lambda c, o, v: c.rolling(6).apply(lambda x: pd.Series(x).rank(pct=True).iloc[-1], raw=True), "TS_ARGMAX($close, 6)": lambda c, o, v: c.rolling(6).apply(np.argmax, raw=True),
    "AVEDEV($close, 5)": lambda c, o, v: c.rolling(5).apply(lambda x: np.abs(x - x.mean()).mean(), raw=True), "WMA($close, 4)": lambda c, o, v: c.rolling(4).apply(lambda x: np.dot(x, [0.1, 0.2, 0.3, 0.4]), raw=True),
    "SLOPE($close, 5)": lambda c, o, v: c.rolling(5).apply(lambda x: np.polyfit(range(5), x, 1)[0], raw=True), "RETURNS($close, 3)": lambda c, o, v: c / c.shift(3) - 1,
    "FUTURE_RETURNS($close, 2)": lambda c, o, v: c.shift(-2) / c - 1, "RSI($close, 6)": lambda c, o, v: c.diff().clip(lower=0).rolling(6).mean() / c.diff().abs().rolling(6).mean() * 100,
    "PSY($close, 5)": lambda c, o, v: (c.diff() > 0).astype(float).rolling(5).mean() * 100, "OBV($close, $volume)": lambda c, o, v: (np.sign(c.diff()).fillna(0) * v).cumsum(),
    "COUNT($close > $open, 5)": lambda c, o, v: (c > o).astype(float).rolling(5).sum(), "TS_REGRESSION($close, $open, 8)": lambda c, o, v: c.rolling(8).cov(o) / o.rolling(8).var(),
    "ZSCORE($close)": lambda c, o, v: c.sub(c.mean(axis=1), axis=0).div(c.std(axis=1, ddof=0), axis=0), "MACD($close, 4, 8, 3)": lambda c, o, v: (lambda d: 2 * (d - d.ewm(span=3, adjust=False, min_periods=3).mean()))(c.ewm(span=4, adjust=False, min_periods=4).mean() - c.ewm(span=8, adjust=False, min_periods=8).mean()),
    "PRODUCT($close / $open, 3)": lambda c, o, v: (c / o).rolling(3).apply(np.prod, raw=True), "SUMIF($close > $open, $volume, 4)": lambda c, o, v: v.where(c > o, 0.0).rolling(4).sum(),
    "RD($close, 1)": lambda c, o, v: c.round(1), "-7 % 3 + $close * 0": lambda c, o, v: c * 0 + 2.0, "-2 ** 2 + $close * 0": lambda c, o, v: c * 0 - 4.0,
}


def test_operators_equal_pandas(panel, wide):
    names = {f"v{i}": e for i, e in enumerate(CASES)}
    got = evaluate(panel, names).toPandas()
    for name, e in names.items():
        want = CASES[e](wide["close"], wide["open"], wide["volume"]).replace([np.inf, -np.inf], np.nan)
        have = got.pivot(index="session", columns="asset", values=name).astype(float)
        pd.testing.assert_frame_equal(have.reset_index(drop=True), want[NAMES], check_names=False, check_column_type=False, rtol=1e-9, atol=1e-9, obj=e)


def shortened(expression: str) -> str:
    """The call with windows that fit a short panel."""
    for long, short in (("79", "8"), ("23", "6"), ("15", "5"), ("11", "4"), (" 7", " 5")):
        expression = expression.replace(long, short)
    return expression


def test_every_operator_has_a_query_and_a_result(panel):
    assert set(factor_queries.EXAMPLES) == set(available_operators()) and len(OPERATORS) == 129
    small = panel.withColumnsRenamed({}).selectExpr("*", "close * 1.01 as high", "close * 0.99 as low", "close * volume as turnover")
    out = evaluate(small, {k.lower(): shortened(e) for k, e in factor_queries.EXAMPLES.items() if k not in ("LOG",)}).toPandas()
    assert len(out) == ROWS * 4
    assert [c for c in out if c not in ("asset", "session", "session_idx") and out[c].isna().all()] == []


@pytest.mark.parametrize("text", ["", "MA($close)", "MA($close, 0)", "MA($close, 2.5)", "NOPE($close)", "__import__('os')", "$close.real()", "a if b else c", "$close +", "(1", "MA($close, n=3)", "close[0]", "lambda: 1", "'x'", "DMA($close, 2)", "SMA($close, 2, 3)", "MA($close, $open)"])
def test_refused(text):
    with pytest.raises(ValueError):
        parse(text)


def test_fields_and_reach():
    assert expression_fields("RANK(MA($daily_basic.pe, 5) / vol) + PRICE") == ("close", "daily_basic.pe", "volume")
    assert reach(parse("MA(REF($close, 3), 5) + FUTURE_RETURNS($close, 2)")) == (7, 2)
    assert reach(parse("EMA($close, 3)"))[0] is None
    assert is_expression("$close") and not is_expression("close")


def test_text_and_missing_fields(spark, panel):
    with pytest.raises(KeyError):
        evaluate(panel, {"v": "$nothing"})
    with pytest.raises(TypeError):
        evaluate(panel.selectExpr("*", "'x' as industry"), {"v": "$industry"})


def test_stages_share_shuffles(panel):
    plan = evaluate(panel, {"a": "MA($close, 5)", "b": "STD(MA($close, 5), 3)", "c": "RANK(MA($close, 5))", "d": "RANK(STD($close, 4))"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(asset") == 1 and plan.count("Exchange hashpartitioning(session") == 1


def test_range_with_and_without_future(panel):
    whole = {(r["asset"], r["session"]): r["v"] for r in evaluate(panel, {"v": "FUTURE_RETURNS($close, 2) + MA($close, 5) * 0"}).collect()}
    part = evaluate_range(panel, {"v": "FUTURE_RETURNS($close, 2) + MA($close, 5) * 0"}, 30, 40, allow_future=True, warmup="window").collect()
    assert len(part) == 44 and all(r["v"] == whole[r["asset"], r["session"]] for r in part)
    blind = {(r["asset"], r["session"]): r["v"] for r in evaluate_range(panel, {"v": "FUTURE_RETURNS($close, 2)"}, 30, 40).collect()}
    assert blind["a", 40] is None and blind["a", 38] is not None


def test_dense_panel_and_clashing_columns(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 3.0), ("b", 2, 5.0)], "asset string, session int, close double")
    dense = dense_panel(rows, ["close"])
    assert dense.count() == 6
    out = evaluate(dense.selectExpr("*", "1.0 as _f0", "2.0 as _t0"), {"v": "REF($close, 1)"}, keep=("_f0",))
    assert {(r["asset"], r["session"]): r["v"] for r in out.collect()}["a", 2] == 1.0
    assert evaluate(dense.limit(0), {"v": "RANK(MA($close, 2))"}).count() == 0


@pytest.mark.parametrize("name", ["factor_ma", "factor_rank", "factor_kama", "composite_nested", "syntax_conditions"])
def test_queries_equal_sql(spark, data, name):
    assert spark_rows(factor_queries.queries()[name](spark, data)) == sql_rows(data, factor_queries.oracle_sql()[name])
