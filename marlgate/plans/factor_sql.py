"""Hand-written SQL of every factor operator, for an independent engine.

Nothing here is made from the operators' own definitions: each formula is written down from its meaning, as stages of
columns over a relation ``panel`` (asset, session, session_idx, fields). Windows don't nest in SQL, so an inner one gets a
column in an earlier stage. Missing is null, a comparison with null is false, a division by zero is null, and a window
counts only if all its values are there.
"""

from __future__ import annotations

from collections.abc import Callable

ALONG = "PARTITION BY asset ORDER BY session_idx"
UPTO = f"({ALONG} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
Stages = list[dict[str, str]]


def frame(n: int, ago: int = 0) -> str:
    return f"({ALONG} ROWS BETWEEN {n - 1 + ago} PRECEDING AND {ago} PRECEDING)"


def roll(how: str, x: str, n: int, ago: int = 0) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n, ago)} = {n} THEN {how}({x}) OVER {frame(n, ago)} END"


def mean(x: str, n: int) -> str:
    return roll("avg", x, n)


def total(x: str, n: int) -> str:
    return roll("sum", x, n)


def listed(x: str, n: int) -> str:
    return roll("list", x, n)


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({ALONG})"


def ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def yes(condition: str) -> str:
    """A condition as a number; one that can't be told is false."""
    return f"CASE WHEN {condition} THEN 1.0 ELSE 0.0 END"


def ewm(x: str, alpha: float, least: int) -> str:
    """Of the values there are: each weighs (1 - alpha) to the number of sessions since, the newest alpha."""
    kept = f"pow({1 - alpha!r}, e.i - s.i)"
    step = f"struct_pack(i := e.i, y := ({kept} * s.y + {alpha!r} * e.y) / ({kept} + {alpha!r}))"
    seen = f"list(struct_pack(i := session_idx, y := CAST({x} AS DOUBLE))) FILTER (WHERE {x} IS NOT NULL) OVER {UPTO}"
    return f"CASE WHEN count({x}) OVER {UPTO} >= {max(1, least)} THEN (list_reduce({seen}, lambda s, e: {step})).y END"


def ema(x: str, n: int) -> str:
    return ewm(x, 2 / (n + 1), n)


def emas(x: str, n: int, depth: int) -> Stages:
    """e1, e2, ...: averages of averages."""
    return [{f"e{k}": ema(x if k == 1 else f"e{k - 1}", n)} for k in range(1, depth + 1)]


def done(value: str, *stages: dict[str, str]) -> Stages:
    return [*stages, {"value": value}]


def moments(x: str, n: int) -> dict[str, str]:
    held, middle = listed(x, n), mean(x, n)
    return {f"m{k}": f"list_sum(list_transform({held}, lambda e: pow(e - ({middle}), {k}))) / {n}" for k in (2, 3, 4)}


def ends(x: str, n: int) -> dict[str, str]:
    return {"lo": roll("min", x, n), "hi": roll("max", x, n)}


def weighted(x: str, n: int) -> Stages:
    whole = " + ".join(f"{k} * {lag(x, n - k)}" for k in range(1, n + 1))
    return done(f"({whole}) / {n * (n + 1) / 2}")


def deviation(x: str, n: int) -> str:
    return f"list_avg(list_transform({listed(x, n)}, lambda e: abs(e - ({mean(x, n)}))))"


def first_place(x: str, n: int, how: str) -> str:
    return f"(list_position({listed(x, n)}, {roll(how, x, n)}) - 1)"


def rank_in_window(x: str, n: int) -> str:
    held = listed(x, n)
    return f"(len(list_filter({held}, lambda e: e < {x})) + len(list_filter({held}, lambda e: e <= {x})) + 1) / 2.0 / {n}"


def slope(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n)} = {n} THEN regr_slope({x}, CAST(session_idx AS DOUBLE)) OVER {frame(n)} END"


def both(how: str, x: str, y: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n)} = {n} AND count({y}) OVER {frame(n)} = {n} THEN {how}({x}, {y}) OVER {frame(n)} END"


def ahead_of(x: str, y: str) -> str:
    return f"({x} > {y} AND {lag(x)} <= {lag(y)})"


def gains(x: str) -> list[dict[str, str]]:
    return [{"d": f"{x} - {lag(x)}"}, {"up": "CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0 END", "down": "CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0 END"}]


def kdj(c: str, h: str, l: str, n: int, m1: int, m2: int) -> list[dict[str, str]]:  # noqa: E741
    low, high = roll("min", l, n), roll("max", h, n)
    return [{"lo": low, "hi": high}, {"raw": f"{ratio(f'{c} - lo', '(hi - lo)')} * 100"}, {"kk": ewm("raw", 1 / m1, m1)}, {"dd": ewm("kk", 1 / m2, m2)}]


def directional(c: str, h: str, l: str, n: int) -> list[dict[str, str]]:  # noqa: E741
    return [
        {"up": f"{h} - {lag(h)}", "dn": f"{lag(l)} - {l}", "a1": f"{h} - {l}", "a2": f"abs({h} - {lag(c)})", "a3": f"abs({l} - {lag(c)})"},
        {"plus": "CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END", "minus": "CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END", "tr": "CASE WHEN a1 + a2 + a3 IS NOT NULL THEN greatest(a1, a2, a3) END"},
        {"st": total("tr", n), "sp": total("plus", n), "sm": total("minus", n)},
        {"pdi": f"{ratio('sp', 'st')} * 100", "mdi": f"{ratio('sm', 'st')} * 100"},
    ]


def adx(c: str, h: str, l: str, n: int, m: int) -> list[dict[str, str]]:  # noqa: E741
    return [*directional(c, h, l, n), {"dx": f"{ratio('abs(pdi - mdi)', '(pdi + mdi)')} * 100"}, {"adx": mean("dx", m)}]


def swing(o: str, c: str, h: str, l: str, n: int) -> list[dict[str, str]]:  # noqa: E741
    return [
        {"pc": lag(c), "po": lag(o)},
        {"a1": f"abs({h} - pc)", "a2": f"abs({l} - pc)", "a3": f"abs({h} - {l})", "moved": f"({c} - pc) + ({c} - {o}) / 2 + (pc - po) / 4"},
        {"far": "CASE WHEN a1 + a2 + a3 IS NOT NULL THEN greatest(a1, a2, a3) END"},
        {"si": ratio("moved", "far")}, {"asi": total("si", n)},
    ]


def kama(x: str, n: int) -> Stages:
    step = "struct_pack(o := coalesce(s.o, s.x) + e.w * (e.x - coalesce(s.o, s.x)), x := e.x, w := e.w)"
    return done(
        f"CASE WHEN er IS NOT NULL THEN (list_reduce(list(struct_pack(o := {x}, x := {x}, w := sc)) OVER {UPTO}, lambda s, e: {step})).o END",
        {"d1": f"abs({x} - {lag(x)})", "dn": f"abs({x} - {lag(x, n)})"}, {"er0": ratio("dn", total("d1", n))},
        {"er": "CASE WHEN er0 IS NOT NULL THEN least(greatest(er0, 0), 1) END"}, {"sc": "pow(er * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2)"},
    )


def mass(h: str, l: str, n1: int, n2: int) -> list[dict[str, str]]:  # noqa: E741
    return [{"range_": f"{h} - {l}"}, {"e1": ema("range_", n1)}, {"e2": ema("e1", n1)}, {"q": ratio("e1", "e2")}, {"mass": total("q", n2)}]


def trix(x: str, n: int) -> list[dict[str, str]]:
    return [*emas(x, n, 3), {"trix": f"({ratio('e3', lag('e3'))} - 1) * 100"}]


def ease(h: str, l: str, v: str, n: int) -> list[dict[str, str]]:  # noqa: E741
    return [{"mid": f"({h} + {l}) / 2"}, {"box": ratio(v, f"({h} - {l})")}, {"em": ratio(f"mid - {lag('mid')}", "box")}, {"emv": mean("em", n)}]


def flow(c: str, h: str, l: str, v: str, n: int) -> Stages:  # noqa: E741
    return done(
        f"100 - 100 / nullif(1 + {ratio('gained', 'lost')}, 0)", {"tp": f"({c} + {h} + {l}) / 3"}, {"d": f"tp - {lag('tp')}"},
        {"up": f"CASE WHEN d > 0 THEN tp * {v} ELSE 0 END", "dn": f"CASE WHEN d < 0 THEN tp * {v} ELSE 0 END"}, {"gained": total("up", n), "lost": total("dn", n)},
    )


def volume_ratio(x: str, v: str, n: int) -> Stages:
    return done(
        f"{ratio('su + sf / 2', '(sd + sf / 2)')} * 100", {"d": f"{x} - {lag(x)}"},
        {"up": f"CASE WHEN d > 0 THEN {v} ELSE 0 END", "dn": f"CASE WHEN d < 0 THEN {v} ELSE 0 END", "flat": f"CASE WHEN d = 0 THEN {v} ELSE 0 END"},
        {"su": total("up", n), "sd": total("dn", n), "sf": total("flat", n)},
    )


def three_averages(x: str, n: int, weights: dict[int, float]) -> Stages:
    return done(" + ".join(f"({w!r}) * e{k}" for k, w in weights.items()), *emas(x, n, max(weights)))


def lines(short: int, long: int, signal: int, x: str) -> list[dict[str, str]]:
    return [{"fast": ema(x, short), "slow": ema(x, long)}, {"dif": "fast - slow"}, {"dea": ema("dif", signal)}]


SESSION = "PARTITION BY session"
VOLUME_FACTOR = 0.7  # of T3
FORMULAS: dict[str, Callable[..., Stages]] = {
    # within a cell
    "ABS": lambda x: done(f"abs({x})"), "LOG": lambda x: done(f"CASE WHEN {x} > 0 THEN ln({x}) END"), "LOGABS": lambda x: done(f"CASE WHEN {x} <> 0 THEN ln(abs({x})) END"),
    "AS_FLOAT": lambda c: done(yes(c)), "RD": lambda x, d: done(f"round_even({x}, {d})"), "SIGN": lambda x: done(f"sign({x})"), "POWER": lambda x, p: done(f"pow({x}, {p})"),
    "SIGNEDPOWER": lambda x, p: done(f"sign({x}) * pow(abs({x}), {p})"), "MAX": lambda x, y: done(f"CASE WHEN {x} >= {y} THEN {x} WHEN {x} < {y} THEN {y} END"),
    "MIN": lambda x, y: done(f"CASE WHEN {x} <= {y} THEN {x} WHEN {x} > {y} THEN {y} END"), "MEAN": lambda x, y: done(f"({x} + {y}) / 2"), "EQUAL": lambda x, y: done(yes(f"{x} = {y}")),
    "VALUEWHEN": lambda c, y: done(f"CASE WHEN {c} THEN {y} END"), "IF": lambda c, a, b: done(f"CASE WHEN {c} THEN {a} ELSE {b} END"),
    "PPO": lambda x, y: done(f"{ratio(f'{x} - {y}', y)} * 100"), "BOLLINGERDIFF": lambda x, y: done(f"2 * ({x} - {y})"),
    # across a session
    "RANK": lambda x: done(f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({SESSION} ORDER BY {x} NULLS LAST) + count({x}) OVER ({SESSION} ORDER BY {x} NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0 / count({x}) OVER ({SESSION}) END"),
    "SCALE": lambda x: done(f"CASE WHEN {x} IS NOT NULL THEN coalesce({ratio(f'{x} - lo', '(hi - lo)')} * 2 - 1, 0) END", {"lo": f"min({x}) OVER ({SESSION})", "hi": f"max({x}) OVER ({SESSION})"}),
    "ZSCORE": lambda x: done(ratio(f"{x} - mu", "sd"), {"mu": f"avg({x}) OVER ({SESSION})", "sd": f"stddev_pop({x}) OVER ({SESSION})"}),
    "CONST": lambda x: done(f"(arg_max(struct_pack(v := {x}), session_idx) OVER (PARTITION BY asset)).v"),
    # windows
    "REF DELAY": lambda x, n: done(lag(x, n)), "DIFF DELTA MTM": lambda x, n, *_: done(f"{x} - {lag(x, n)}"), "ROC PCT_CHANGE RETURNS": lambda x, n: done(f"{ratio(x, lag(x, n))} - 1"),
    "FUTURE_RETURNS": lambda x, n: done(f"{ratio(f'lead({x}, {n}) OVER ({ALONG})', x)} - 1"), "MA TS_MEAN ADV": lambda x, n: done(mean(x, n)), "BOLL_MID": lambda x, n, k: done(mean(x, n)),
    "SUM": lambda x, n: done(total(x, n)), "PRODUCT": lambda x, n: done(roll("product", "_q", n), {"_q": x}), "STD STDDEV": lambda x, n: done(roll("stddev_samp", x, n)), "VAR": lambda x, n: done(roll("var_samp", x, n)),
    "TS_MAX": lambda x, n: done(roll("max", x, n)), "TS_MIN": lambda x, n: done(roll("min", x, n)), "TS_MIDDLE": lambda x, n: done(f"({roll('max', x, n)} + {roll('min', x, n)}) / 2"),
    "TS_MAD AVEDEV": lambda x, n: done(deviation(x, n)), "TS_RANK": lambda x, n: done(rank_in_window(x, n)), "TS_ARGMAX": lambda x, n: done(first_place(x, n, "max")), "TS_ARGMIN": lambda x, n: done(first_place(x, n, "min")),
    "HHVBARS": lambda x, n: done(f"{n - 1} - {first_place(x, n, 'max')}"), "LLVBARS": lambda x, n: done(f"{n - 1} - {first_place(x, n, 'min')}"), "COUNT": lambda c, n: done(total("f", n), {"f": yes(c)}),
    "EVERY": lambda c, n: done(yes(f"({roll('min', 'f', n)}) > 0"), {"f": yes(c)}), "EXIST": lambda c, n: done(yes(f"({roll('max', 'f', n)}) > 0"), {"f": yes(c)}),
    "BARSSINCEN": lambda c, n: done(f"CASE WHEN count(f) OVER {frame(n)} = {n} THEN session_idx - min(CASE WHEN f > 0 THEN session_idx END) OVER {frame(n)} END", {"f": yes(c)}),
    "BARSLAST": lambda c: done(f"session_idx - max(CASE WHEN f > 0 THEN session_idx END) OVER {UPTO}", {"f": yes(c)}),
    "BARSLASTCOUNT": lambda c: done(f"sum(f) OVER (PARTITION BY asset, run ORDER BY session_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", {"f": yes(c)}, {"run": f"sum(1 - f) OVER {UPTO}"}),  # noqa: F541
    "SLOPE": lambda x, n: done(slope(x, n)), "ANGLE": lambda x, n: done(f"degrees(atan({slope(x, n)}))"), "INTERCEPT": lambda x, n: done(f"{mean(x, n)} - k * {(n - 1) / 2}", {"k": slope(x, n)}),
    "FORCAST": lambda x, n: done(f"{mean(x, n)} - k * {(n - 1) / 2} + k * {n}", {"k": slope(x, n)}), "DECAYLINEAR WMA": weighted, "TS_ZSCORE": lambda x, n: done(ratio(f"{x} - {mean(x, n)}", f"({roll('stddev_pop', x, n)})")),
    "TS_SKEW": lambda x, n: done(f"CASE WHEN lo = hi THEN 0 ELSE {(n * (n - 1)) ** 0.5 / (n - 2)!r} * m3 / nullif(pow(m2, 1.5), 0) END", moments(x, n) | ends(x, n)),
    "TS_KURT": lambda x, n: done(f"CASE WHEN lo = hi THEN -3 ELSE {(n - 1) / ((n - 2) * (n - 3))!r} * ({n + 1} * (m4 / nullif(m2 * m2, 0) - 3) + 6) END", moments(x, n) | ends(x, n)), "TS_MEDIAN": lambda x, n: done(roll("median", x, n)),
    "SHARPE": lambda x, n: done(ratio(mean("r", n), f"({roll('stddev_samp', 'r', n)})"), {"r": f"{ratio(x, lag(x))} - 1"}), "SUM_ABS_PRICE_CHANGE": lambda x, n: done(total("d", n), {"d": f"abs({x} - {lag(x)})"}),
    "MEAN_ABS_PRICE_CHANGE ATR": lambda x, n: done(mean("d", n), {"d": f"abs({x} - {lag(x)})"}), "CROSS": lambda x, y: done(yes(ahead_of(x, y))),
    "LONGCROSS": lambda x, y, n: done(yes(f"{ahead_of(x, y)} AND coalesce({roll('min', 'below', n)}, 1) > 0"), {"below": yes(f"{lag(x)} < {lag(y)}")}),
    "LAST": lambda c, n, m: done(yes(f"({roll('min', 'f', abs(n - m) + 1, min(n, m))}) > 0"), {"f": yes(c)}),
    "CORR CORRELATION": lambda x, y, n: done(ratio(both("covar_pop", x, y, n), f"(stddev_pop({x}) OVER {frame(n)} * stddev_pop({y}) OVER {frame(n)})")), "COV COVARIANCE": lambda x, y, n: done(both("covar_samp", x, y, n)),
    "TS_REGRESSION": lambda x, y, n: done(both("regr_slope", x, y, n)), "SUMIF": lambda c, y, n: done(total("q", n), {"q": f"CASE WHEN {c} THEN {y} ELSE 0 END"}),
    # averages with memory
    "EMA": lambda x, n: done(ema(x, n)), "EXPMA": lambda x, n1, n2: done(ema(x, n1)), "EXPMA2": lambda x, n1, n2: done(ema(x, n2)), "SMA": lambda x, n, m: done(ewm(x, m / n, n)), "DMA": lambda x, a: done(ewm(x, a, 0)),
    "DEMA": lambda x, n: three_averages(x, n, {1: 2.0, 2: -1.0}), "TEMA": lambda x, n: three_averages(x, n, {1: 3.0, 2: -3.0, 3: 1.0}),
    "T3": lambda x, n: three_averages(x, n, {3: (1 + VOLUME_FACTOR) ** 3, 4: -3 * VOLUME_FACTOR * (1 + VOLUME_FACTOR) ** 2, 5: 3 * VOLUME_FACTOR**2 * (1 + VOLUME_FACTOR), 6: -(VOLUME_FACTOR**3)}), "KAMA": kama,
    "MACD_DIF": lambda x, s, l, g: done("dif", *lines(s, l, g, x)), "MACD_DEA": lambda x, s, l, g: done("dea", *lines(s, l, g, x)), "MACD": lambda x, s, l, g: done("2 * (dif - dea)", *lines(s, l, g, x)),
    "KDJ_K": lambda *a: done("kk", *kdj(*a)), "KDJ_D": lambda *a: done("dd", *kdj(*a)), "KDJ_J": lambda *a: done("3 * kk - 2 * dd", *kdj(*a)), "TRIX": lambda x, n, m: done("trix", *trix(x, n)), "TRIMA": lambda x, n, m: done(mean("trix", m), *trix(x, n)),
    "MASS": lambda h, l, n1, n2, m: done("mass", *mass(h, l, n1, n2)), "MASSMA": lambda h, l, n1, n2, m: done(mean("mass", m), *mass(h, l, n1, n2)),
    # indicators
    "RSI": lambda x, n: done(f"{ratio('mu', 'ma')} * 100", *gains(x), {"mu": mean('up', n), "ma": mean('abs(d)', n)}), "CMO": lambda x, n: done(f"{ratio('su - sd', '(su + sd)')} * 100", *gains(x), {"su": total("up", n), "sd": total("down", n)}),
    "WR": lambda x, n: done(f"{ratio(f'hi - {x}', '(hi - lo)')} * 100", {"hi": roll("max", x, n), "lo": roll("min", x, n)}), "STOCHASTIC": lambda x, n: done(f"{ratio(f'{x} - lo', '(hi - lo)')} * 100", {"hi": roll("max", x, n), "lo": roll("min", x, n)}),
    "BOLL_UPPER": lambda x, n, k: done(f"{mean(x, n)} + {k} * ({roll('stddev_samp', x, n)})"), "BOLL_LOWER": lambda x, n, k: done(f"{mean(x, n)} - {k} * ({roll('stddev_samp', x, n)})"), "BOLL_WIDTH": lambda x, n, *_: done(f"4 * ({roll('stddev_samp', x, n)})"),
    "BIAS": lambda x, n: done(f"{ratio(f'{x} - mu', 'mu')} * 100", {"mu": mean(x, n)}), "PSY": lambda x, n: done(f"100 * ({mean('f', n)})", {"d": f"{x} - {lag(x)}"}, {"f": yes("d > 0")}),
    "PSYMA": lambda x, n, m: done(mean("p", m), {"d": f"{x} - {lag(x)}"}, {"f": yes("d > 0")}, {"p": f"100 * ({mean('f', n)})"}), "CCI": lambda x, n: done(ratio(f"{x} - {mean(x, n)}", "(0.015 * md)"), {"md": deviation(x, n)}),
    "BBI": lambda x, *n: done(f"({' + '.join(f'({mean(x, k)})' for k in n)}) / 4"), "DMI_PDI": lambda c, h, l, n, m: done("pdi", *directional(c, h, l, n)), "DMI_MDI": lambda c, h, l, n, m: done("mdi", *directional(c, h, l, n)),
    "DMI_ADX": lambda *a: done("adx", *adx(*a)), "DMI_ADXR": lambda *a: done(f"(adx + {lag('adx', a[-1])}) / 2", *adx(*a)), "ADXR": lambda x, n: done(f"({x} + {lag(x, n)}) / 2"),
    "AROONOSC": lambda x, n: done(f"(young_high - young_low) / {n} * 100", {"young_high": first_place(x, n, "max"), "young_low": first_place(x, n, "min")}),
    "OBV": lambda x, v: done(f"CASE WHEN q IS NOT NULL THEN sum(q) OVER {UPTO} END", {"d": f"{x} - {lag(x)}"}, {"q": f"coalesce(sign(d), 0) * {v}"}), "VR": volume_ratio, "MFI": flow,
    "EMV": lambda h, l, v, n, m: done("emv", *ease(h, l, v, n)), "EMVMA": lambda h, l, v, n, m: done(mean("emv", m), *ease(h, l, v, n)), "DPO": lambda x, n, k, m: done(f"{lag(x, k)} - ({mean(x, n)})"),
    "DPOMA": lambda x, n, k, m: done(mean("q", m), {"q": f"{lag(x, k)} - ({mean(x, n)})"}),
    "BRAR": lambda o, c, h, l, n: done(f"{ratio('su', 'sd')} * 100", {"pc": lag(c)}, {"up": f"CASE WHEN {h} > pc THEN {h} - pc WHEN {h} <= pc THEN 0 END", "dn": f"CASE WHEN pc > {l} THEN pc - {l} WHEN pc <= {l} THEN 0 END"}, {"su": total('up', n), "sd": total('dn', n)}),
    "ARBR": lambda o, c, h, l, n: done(f"{ratio('su', 'sd')} * 100", {"up": f"{h} - {o}", "dn": f"{o} - {l}"}, {"su": total("up", n), "sd": total("dn", n)}), "MTMMA": lambda x, n, m: done(mean("d", m), {"d": f"{x} - {lag(x, n)}"}),
    "ROCMA": lambda x, n, m: done(mean("d", m), {"d": f"{ratio(x, lag(x, n))} - 1"}), "ASI": lambda o, c, h, l, n, m: done("asi", *swing(o, c, h, l, n)), "ASIT": lambda o, c, h, l, n, m: done(mean("asi", m), *swing(o, c, h, l, n)),
    "DIF": lambda x, n1, n2, m: done(f"({mean(x, n1)}) - ({mean(x, n2)})"), "DFMA": lambda x, n1, n2, m: done(mean("q", m), {"q": f"({mean(x, n1)}) - ({mean(x, n2)})"}),
}
BY_NAME = {name: formula for names, formula in FORMULAS.items() for name in names.split()}


def rounded(value: str, digits: int = 5) -> str:
    return f"floor({value} * {10**digits} + 0.5) / {10**digits}"


def operator_sql(name: str, args: list, panel: str) -> str:
    """asset, session, value of one operator call; ``panel``: common table expressions that end in ``panel``."""
    steps, at = [panel], "panel"
    stages = BY_NAME[name](*args)
    for i, stage in enumerate(stages):
        steps.append(f"g{i} AS (SELECT *, {', '.join(f'{text} AS {column}' for column, text in stage.items())} FROM {at})")
        at = f"g{i}"
    return f"WITH {', '.join(steps)} SELECT asset, session, CASE WHEN isfinite(CAST(value AS DOUBLE)) THEN {rounded('CAST(value AS DOUBLE)')} END AS value FROM {at}"
