"""Every operator against its hand-written SQL on a panel that strains it: gaps, constant stretches, zero spans and volumes, repeated values."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from marlgate.plans import factor_queries
from marlgate.plans.compiler import evaluate
from marlgate.plans.factor_sql import BY_NAME, operator_sql
from marlgate.plans.operators import OPERATORS

SHORT = {79: 8, 23: 6, 15: 5, 11: 4, 7: 5}


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(11)
    parts = []
    for asset in range(5):
        close = np.round(50 * np.exp(rng.normal(0, 0.03, 70).cumsum()), 2)
        close[20:32] = close[20]  # a constant stretch
        rows = pd.DataFrame({"asset": f"a{asset}", "session": range(70), "session_idx": range(70), "close": close, "open": np.round(close * (1 + rng.normal(0, 0.01, 70)), 2)})
        rows["high"], rows["low"] = rows[["open", "close"]].max(axis=1) + rng.choice([0.0, 0.25, 1.0], 70), rows[["open", "close"]].min(axis=1) - rng.choice([0.0, 0.25, 1.0], 70)
        rows["volume"] = rng.integers(0, 6, 70).astype(float)
        rows.loc[40:50, ["open", "high", "low", "close"]] = float(close[40])  # no span at all
        rows.loc[rng.choice(70, 4, replace=False), ["open", "high", "low", "close", "volume"]] = np.nan
        if asset == 4:
            rows["close"] = np.nan  # nothing known
        parts.append(rows)
    return pd.concat(parts, ignore_index=True)


def test_operators_equal_their_sql(spark, frame):
    assert set(BY_NAME) == set(OPERATORS) == set(factor_queries.EXAMPLES)
    panel = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "asset string, session int, session_idx int, close double, open double, high double, low double, volume double")
    calls = {}
    for name in OPERATORS:
        args = [SHORT.get(a, a) if isinstance(a, int) else a for a in factor_queries.sql_arguments(name)]
        shown = [f"({a})" if isinstance(a, str) and " " in a else a for a in args]
        text = [str(a) if not isinstance(a, str) else " ".join(f"${w}" if w in frame.columns else w for w in a.split()) for a in args]
        calls[name] = (f"{name}({', '.join(text)})", shown)
    got = evaluate(panel, {n.lower(): e for n, (e, _) in calls.items()}).toPandas().sort_values(["asset", "session"])
    connection = duckdb.connect()
    connection.register("strained", frame)
    wrong = []
    for name, (_, args) in calls.items():
        want = connection.execute(operator_sql(name, args, "panel AS (SELECT asset, session, session_idx, " + ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in ("open", "high", "low", "close", "volume")) + " FROM strained)")).df().sort_values(["asset", "session"])
        a, b = got[name.lower()].to_numpy(float), want["value"].to_numpy(float)
        if not ((np.isnan(a) == np.isnan(b)) & (np.isnan(a) | (np.abs(a - b) <= 1.1e-5 + 1e-7 * np.abs(b)))).all():
            at = ~((np.isnan(a) == np.isnan(b)) & (np.isnan(a) | (np.abs(a - b) <= 1.1e-5 + 1e-7 * np.abs(b))))
            wrong.append((name, calls[name][0], [(i, x, y) for i, x, y in zip(np.flatnonzero(at).tolist(), a[at].tolist(), b[at].tolist(), strict=True)][:5]))
    assert wrong == []
