"""The 129 operators of the factor language, defined over the terms of ``algebra``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import comb

from marlgate.plans.algebra import (
    Term, above, as_term, below, call, choose, condition, diff, ema, equal, ewm, lit, number, present, roll, shift,
)


@dataclass(frozen=True)
class Operator:
    name: str
    build: Callable[..., Term]
    signature: str  # one letter an argument: w window of 1 or more, z window of 0 or more, f number, any other a series; ? optional from here

    # what a series is meant to hold: x any, y a second one, o h l k the open, high, low and close, v a volume, c a condition,
    # d signed, r about one, p a power, u between 0 and 1


OPERATORS: dict[str, Operator] = {}


def operator(names: str, signature: str):
    def register(build: Callable[..., Term]) -> Callable[..., Term]:
        for name in names.split():
            OPERATORS[name] = Operator(name, build, signature)
        return build

    return register


def literal(term: object, what: str) -> float:
    term = as_term(term)
    sign = 1.0
    if term.op == "neg":
        sign, term = -1.0, term.args[0]
    if term.op != "lit" or term.params[0] is None:
        raise ValueError(f"{what} must be a plain number")
    return sign * term.params[0]


def apply(name: str, args: list[Term]) -> Term:
    """The term of an operator call, with its arguments checked."""
    op = OPERATORS.get(name.upper())
    if op is None:
        raise ValueError(f"unknown operator: {name}")
    need, _, optional = op.signature.partition("?")
    letters = need + optional
    if not len(need) <= len(args) <= len(letters):
        raise ValueError(f"{op.name} takes {len(need)}{f' to {len(letters)}' if optional else ''} arguments, got {len(args)}")
    ready: list[object] = []
    for letter, arg in zip(letters, args, strict=False):
        if letter == "f":
            ready.append(literal(arg, f"{op.name}'s parameter"))
        elif letter not in "wz":
            ready.append(arg)
        else:
            value, least = literal(arg, f"{op.name}'s window"), 1 if letter == "w" else 0
            if value != int(value) or value < least:
                raise ValueError(f"{op.name}'s window must be a whole number of at least {least}")
            ready.append(int(value))
    return op.build(*ready)


# --- within a cell ------------------------------------------------------------------------------------------------------
operator("ABS", "d")(lambda x: call("abs", x))
operator("LOG", "x")(lambda x: call("ln", x))
operator("LOGABS", "d")(lambda x: call("ln", call("abs", x)))
operator("AS_FLOAT", "c")(number)
operator("RD", "x?f")(lambda x, d=2.0: call("half_even", x, params=(int(d),)))
operator("SIGN", "d")(lambda x: call("sign", x))
operator("POWER", "xp")(lambda x, y: number(x) ** y)
operator("SIGNEDPOWER", "dp")(lambda x, y: call("sign", x) * call("abs", x) ** y)
operator("MAX", "xy")(lambda x, y: choose(present(x) & present(y), call("greatest", x, y)))
operator("MIN", "xy")(lambda x, y: choose(present(x) & present(y), call("least", x, y)))
operator("MEAN", "hl")(lambda x, y: (number(x) + y) / 2.0)
operator("EQUAL", "kh")(equal)
operator("VALUEWHEN", "cx")(lambda c, y: choose(c, y))
operator("IF", "cxy")(choose)
operator("PPO", "xy")(lambda x, y: (number(x) - y) / y * 100.0)
operator("BOLLINGERDIFF", "hl")(lambda x, y: 2.0 * (number(x) - y))


# --- across a session's assets ------------------------------------------------------------------------------------------
operator("RANK", "x")(lambda x: call("x_rank", x))


@operator("SCALE", "x")
def scale(x: Term) -> Term:
    low, high = call("x_min", x), call("x_max", x)
    placed = (number(x) - low) / (high - low) * 2.0 - 1.0
    return choose(present(x), choose(present(placed), placed, 0.0))


operator("ZSCORE", "x")(lambda x: (number(x) - call("x_mean", x)) / call("x_std", x))
operator("CONST", "x")(lambda x: call("final", x))


# --- along sessions -----------------------------------------------------------------------------------------------------
operator("REF DELAY", "xz")(shift)
operator("DIFF DELTA", "x?w")(lambda x, n=1: diff(x, n))
operator("ROC PCT_CHANGE RETURNS", "xw")(lambda x, n: number(x) / shift(x, n) - 1.0)
operator("FUTURE_RETURNS", "xw")(lambda x, n: shift(x, -n) / x - 1.0)
operator("MA TS_MEAN ADV", "xw")(lambda x, n: roll("mean", x, n))
operator("SUM", "xw")(lambda x, n: roll("sum", x, n))
operator("PRODUCT", "rw")(lambda x, n: roll("product", x, n))
operator("STD STDDEV", "xw")(lambda x, n: roll("std", x, n))
operator("VAR", "xw")(lambda x, n: roll("var", x, n))
operator("TS_MAX", "xw")(lambda x, n: roll("max", x, n))
operator("TS_MIN", "xw")(lambda x, n: roll("min", x, n))
operator("TS_MIDDLE", "xw")(lambda x, n: (roll("max", x, n) + roll("min", x, n)) / 2.0)
operator("TS_MAD AVEDEV", "xw")(lambda x, n: call("shape", x, params=("mad", n)))
operator("TS_RANK", "xw")(lambda x, n: call("shape", x, params=("rank", n)))
operator("TS_ARGMAX", "xw")(lambda x, n: call("shape", x, params=("argmax", n)))
operator("TS_ARGMIN", "xw")(lambda x, n: call("shape", x, params=("argmin", n)))
operator("HHVBARS", "xw")(lambda x, n: float(n - 1) - call("shape", x, params=("argmax", n)))
operator("LLVBARS", "xw")(lambda x, n: float(n - 1) - call("shape", x, params=("argmin", n)))
operator("COUNT", "cw")(lambda c, n: roll("sum", condition(c), n))
operator("EVERY", "cw")(lambda c, n: roll("min", c, n) > 0.0)
operator("EXIST", "cw")(lambda c, n: roll("max", c, n) > 0.0)


@operator("BARSSINCEN", "cw")
def bars_since_first(c: Term, n: int) -> Term:
    first = call("shape", choose(c, 1.0, 0.0), params=("argmax", n))
    return choose(roll("max", choose(c, 1.0, 0.0), n) > 0.0, float(n - 1) - first)


operator("BARSLAST", "c")(lambda c: Term("session") - call("last_true", choose(c, 1.0, 0.0)))


@operator("BARSLASTCOUNT", "c")
def run_length(c: Term) -> Term:
    broken = call("last_true", choose(c, 0.0, 1.0))
    return Term("session") - choose(present(broken), broken, -1.0)


def slope(x: Term, n: int) -> Term:
    return call("trend", x, params=(n,))


def intercept(x: Term, n: int) -> Term:
    return roll("mean", x, n) - slope(x, n) * ((n - 1) / 2.0)


operator("SLOPE", "xw")(slope)
operator("ANGLE", "xw")(lambda x, n: call("angle", slope(x, n)))
operator("INTERCEPT", "xw")(intercept)
operator("FORCAST", "xw")(lambda x, n: intercept(x, n) + slope(x, n) * float(n))
operator("DECAYLINEAR WMA", "xw")(lambda x, n: call("shape", x, params=("weighted", n)))
operator("TS_ZSCORE", "xw")(lambda x, n: (number(x) - roll("mean", x, n)) / roll("pstd", x, n))
operator("TS_SKEW", "xw")(lambda x, n: roll("skew", x, n))
operator("TS_KURT", "xw")(lambda x, n: roll("kurt", x, n))
operator("TS_MEDIAN", "xw")(lambda x, n: roll("median", x, n))


@operator("SHARPE", "xw")
def sharpe(x: Term, n: int) -> Term:
    steps = number(x) / shift(x, 1) - 1.0
    return roll("mean", steps, n) / roll("std", steps, n)


operator("SUM_ABS_PRICE_CHANGE", "xw")(lambda x, n: roll("sum", call("abs", diff(x)), n))
operator("MEAN_ABS_PRICE_CHANGE ATR", "xw")(lambda x, n: roll("mean", call("abs", diff(x)), n))
operator("CROSS", "xy")(lambda x, y: (number(x) > y) & (shift(x, 1) <= shift(y, 1)))


@operator("LONGCROSS", "xyw")
def long_cross(x: Term, y: Term, n: int) -> Term:
    held = roll("min", shift(x, 1) < shift(y, 1), n)
    return (number(x) > y) & (shift(x, 1) <= shift(y, 1)) & (~present(held) | (held > 0.0))


@operator("LAST", "czz")
def held_between(c: Term, n: int, m: int) -> Term:
    near, far = min(n, m), max(n, m)
    return roll("min", c, far - near + 1, near) > 0.0


operator("CORR CORRELATION", "xvw")(lambda x, y, n: call("roll2", x, y, params=("corr", n)))
operator("COV COVARIANCE", "xyw")(lambda x, y, n: call("roll2", x, y, params=("cov", n)))
operator("TS_REGRESSION", "xyw")(lambda x, y, n: call("roll2", x, y, params=("cov", n)) / roll("var", y, n))
operator("SUMIF", "cvw")(lambda c, y, n: roll("sum", choose(c, y, 0.0), n))


# --- averages with memory -----------------------------------------------------------------------------------------------
operator("EMA", "xw")(ema)
operator("EXPMA", "xww")(lambda x, n1, n2: ema(x, n1))
operator("EXPMA2", "xww")(lambda x, n1, n2: ema(x, n2))


@operator("SMA", "xwf")
def weighted_average(x: Term, n: int, m: float) -> Term:
    if not 0 < m / n <= 1:
        raise ValueError("SMA needs a weight above 0 and not above its window")
    return ewm(x, m / n, n)


@operator("DMA", "xu")
def dynamic_average(x: Term, a: Term) -> Term:
    if a.op == "lit":
        if not 0 < a.params[0] < 1:
            raise ValueError("DMA needs a factor between 0 and 1")
        return ewm(x, a.params[0], 0)
    return call("dma", x, a)


operator("DEMA", "xw")(lambda x, n: 2.0 * ema(x, n) - ema(ema(x, n), n))


@operator("TEMA", "xw")
def triple_average(x: Term, n: int) -> Term:
    one = ema(x, n)
    two = ema(one, n)
    return 3.0 * one - 3.0 * two + ema(two, n)


@operator("T3", "xw")
def six_fold_average(x: Term, n: int) -> Term:
    v, chain = 0.7, [number(x)]
    for _ in range(6):
        chain.append(ema(chain[-1], n))
    # (1 + v) times an average less v times the average of it, three times over: binomial weights
    weights = {3 + k: comb(3, k) * (-v) ** k * (1 + v) ** (3 - k) for k in range(4)}
    return sum((weights[k] * chain[k] for k in (4, 5, 6)), weights[3] * chain[3])


@operator("KAMA", "xw")
def adaptive_average(x: Term, n: int) -> Term:
    ratio = call("abs", diff(x, n)) / roll("sum", call("abs", diff(x)), n)
    efficiency = choose(present(ratio), call("least", call("greatest", ratio, lit(0.0)), lit(1.0)))
    fast, slow = 2 / 3, 2 / 31
    pace = (efficiency * (fast - slow) + slow) ** 2.0
    return choose(present(efficiency), call("kama", x, pace))


def macd_line(x: Term, short: int, long: int) -> Term:
    return ema(x, short) - ema(x, long)


operator("MACD_DIF", "xwww")(lambda x, s, l, sig: macd_line(x, s, l))
operator("MACD_DEA", "xwww")(lambda x, s, l, sig: ema(macd_line(x, s, l), sig))
operator("MACD", "xwww")(lambda x, s, l, sig: (macd_line(x, s, l) - ema(macd_line(x, s, l), sig)) * 2.0)


def stochastic_lines(c: Term, h: Term, l: Term, n: int, m1: int, m2: int) -> tuple[Term, Term]:  # noqa: E741
    low = roll("min", l, n)
    raw = (number(c) - low) / (roll("max", h, n) - low) * 100.0
    k = ewm(raw, 1 / m1, m1)
    return k, ewm(k, 1 / m2, m2)


operator("KDJ_K", "khlwww")(lambda *a: stochastic_lines(*a)[0])
operator("KDJ_D", "khlwww")(lambda *a: stochastic_lines(*a)[1])
operator("KDJ_J", "khlwww")(lambda *a: 3.0 * stochastic_lines(*a)[0] - 2.0 * stochastic_lines(*a)[1])


def trix(x: Term, n: int) -> Term:
    third = ema(ema(ema(x, n), n), n)
    return (third / shift(third, 1) - 1.0) * 100.0


operator("TRIX", "xww")(lambda x, n, m: trix(x, n))
operator("TRIMA", "xww")(lambda x, n, m: roll("mean", trix(x, n), m))


def mass(h: Term, l: Term, n1: int, n2: int) -> Term:  # noqa: E741
    first = ema(number(h) - l, n1)
    return roll("sum", first / ema(first, n1), n2)


operator("MASS", "hlwww")(lambda h, l, n1, n2, m: mass(h, l, n1, n2))
operator("MASSMA", "hlwww")(lambda h, l, n1, n2, m: roll("mean", mass(h, l, n1, n2), m))


# --- indicators from windows --------------------------------------------------------------------------------------------
def place(x: Term, n: int) -> Term:
    low, high = roll("min", x, n), roll("max", x, n)
    return (number(x) - low) / (high - low) * 100.0


operator("RSI", "xw")(lambda x, n: roll("mean", above(diff(x)), n) / roll("mean", call("abs", diff(x)), n) * 100.0)


@operator("CMO", "xw")
def momentum_balance(x: Term, n: int) -> Term:
    up, down = roll("sum", above(diff(x)), n), roll("sum", -below(diff(x)), n)
    return (up - down) / (up + down) * 100.0


operator("WR", "xw")(lambda x, n: (roll("max", x, n) - x) / (roll("max", x, n) - roll("min", x, n)) * 100.0)
operator("STOCHASTIC", "xw")(place)
operator("BOLL_UPPER", "xwf")(lambda x, n, k: roll("mean", x, n) + k * roll("std", x, n))
operator("BOLL_MID", "xwf")(lambda x, n, k: roll("mean", x, n))
operator("BOLL_LOWER", "xwf")(lambda x, n, k: roll("mean", x, n) - k * roll("std", x, n))
operator("BOLL_WIDTH", "xw?f")(lambda x, n, k=2.0: 4.0 * roll("std", x, n))
operator("BIAS", "xw")(lambda x, n: (number(x) - roll("mean", x, n)) / roll("mean", x, n) * 100.0)


def rising_share(x: Term, n: int) -> Term:
    return roll("mean", diff(x) > 0.0, n) * 100.0


operator("PSY", "xw")(rising_share)
operator("PSYMA", "xww")(lambda x, n, m: roll("mean", rising_share(x, n), m))
operator("CCI", "xw")(lambda x, n: (number(x) - roll("mean", x, n)) / (0.015 * call("shape", x, params=("mad", n))))
operator("BBI", "xwwww")(lambda x, a, b, c, d: (number(x) * 0.0 + roll("mean", x, a) + roll("mean", x, b) + roll("mean", x, c) + roll("mean", x, d)) / 4.0)


def directional(c: Term, h: Term, l: Term, n: int) -> tuple[Term, Term]:  # noqa: E741
    up, down, before = diff(h), -diff(l), shift(c, 1)
    ranges = [number(h) - l, call("abs", number(h) - before), call("abs", number(l) - before)]
    complete = present(ranges[0]) & present(ranges[1]) & present(ranges[2])
    total = roll("sum", choose(complete, call("greatest", *ranges)), n)
    plus = roll("sum", choose((up > down) & (up > 0.0), up, 0.0), n)
    minus = roll("sum", choose((down > up) & (down > 0.0), down, 0.0), n)
    return plus / total * 100.0, minus / total * 100.0


def adx(c: Term, h: Term, l: Term, n: int, m: int) -> Term:  # noqa: E741
    plus, minus = directional(c, h, l, n)
    return roll("mean", call("abs", plus - minus) / (plus + minus) * 100.0, m)


operator("DMI_PDI", "khlww")(lambda c, h, l, n, m: directional(c, h, l, n)[0])
operator("DMI_MDI", "khlww")(lambda c, h, l, n, m: directional(c, h, l, n)[1])
operator("DMI_ADX", "khlww")(adx)
operator("DMI_ADXR", "khlww")(lambda c, h, l, n, m: (adx(c, h, l, n, m) + shift(adx(c, h, l, n, m), m)) / 2.0)
operator("ADXR", "xw")(lambda x, n: (number(x) + shift(x, n)) / 2.0)
operator("AROONOSC", "xw")(lambda x, n: (call("shape", x, params=("argmax", n)) - call("shape", x, params=("argmin", n))) / float(n) * 100.0)


@operator("OBV", "xv")
def balance_volume(x: Term, v: Term) -> Term:
    step = call("sign", diff(x))
    return call("running_sum", choose(present(step), step, 0.0) * v)


@operator("VR", "xvw")
def volume_ratio(x: Term, v: Term, n: int) -> Term:
    step = diff(x)
    up, down, flat = (roll("sum", choose(c, v, 0.0), n) for c in (step > 0.0, step < 0.0, equal(step, 0.0)))
    return (up + flat / 2.0) / (down + flat / 2.0) * 100.0


@operator("MFI", "khlvw")
def money_flow(c: Term, h: Term, l: Term, v: Term, n: int) -> Term:  # noqa: E741
    typical = (number(c) + h + l) / 3.0
    gained = roll("sum", choose(diff(typical) > 0.0, typical * v, 0.0), n)
    lost = roll("sum", choose(diff(typical) < 0.0, typical * v, 0.0), n)
    return 100.0 - 100.0 / (1.0 + gained / lost)


def ease(h: Term, l: Term, v: Term, n: int) -> Term:  # noqa: E741
    middle = (number(h) + l) / 2.0
    return roll("mean", diff(middle) / (number(v) / (number(h) - l)), n)


operator("EMV", "hlvww")(lambda h, l, v, n, m: ease(h, l, v, n))
operator("EMVMA", "hlvww")(lambda h, l, v, n, m: roll("mean", ease(h, l, v, n), m))


def detrended(x: Term, n: int, k: int) -> Term:
    return shift(x, k) - roll("mean", x, n)


operator("DPO", "xwww")(lambda x, n, k, m: detrended(x, n, k))
operator("DPOMA", "xwww")(lambda x, n, k, m: roll("mean", detrended(x, n, k), m))
operator("BRAR", "okhlw")(lambda o, c, h, l, n: roll("sum", above(number(h) - shift(c, 1)), n) / roll("sum", above(shift(c, 1) - l), n) * 100.0)
operator("ARBR", "okhlw")(lambda o, c, h, l, n: roll("sum", number(h) - o, n) / roll("sum", number(o) - l, n) * 100.0)
operator("MTM", "xww")(lambda x, n, m: diff(x, n))
operator("MTMMA", "xww")(lambda x, n, m: roll("mean", diff(x, n), m))
operator("ROCMA", "xww")(lambda x, n, m: roll("mean", number(x) / shift(x, n) - 1.0, m))


def swing(o: Term, c: Term, h: Term, l: Term, n: int) -> Term:  # noqa: E741
    before = shift(c, 1)
    reaches = [call("abs", number(h) - before), call("abs", number(l) - before), call("abs", number(h) - l)]
    complete = present(reaches[0]) & present(reaches[1]) & present(reaches[2])
    moved = (number(c) - before) + 0.5 * (number(c) - o) + 0.25 * (before - shift(o, 1))
    return roll("sum", moved / choose(complete, call("greatest", *reaches)), n)


operator("ASI", "okhlww")(lambda o, c, h, l, n, m: swing(o, c, h, l, n))
operator("ASIT", "okhlww")(lambda o, c, h, l, n, m: roll("mean", swing(o, c, h, l, n), m))


def spread_of_means(x: Term, n1: int, n2: int) -> Term:
    return roll("mean", x, n1) - roll("mean", x, n2)


operator("DIF", "xwww")(lambda x, n1, n2, m: spread_of_means(x, n1, n2))
operator("DFMA", "xwww")(lambda x, n1, n2, m: roll("mean", spread_of_means(x, n1, n2), m))


def available_operators() -> tuple[str, ...]:
    return tuple(sorted(OPERATORS))
