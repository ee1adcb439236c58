"""Terms to SQL text for an independent engine, to check the compiled columns."""

from __future__ import annotations

from marlgate.plans.algebra import SCALAR, SECTION, Term, number, post_order
from marlgate.plans.parser import parse

HALF = 0.500031  # rounding by floor, off the exact half: prices in cents a piece often end there, and engines break ties apart
WINDOW = "PARTITION BY asset ORDER BY session_idx"


def _scalar(term: Term, a: list[str]) -> str:
    p = term.params
    return {
        "lit": lambda: "CAST(NULL AS DOUBLE)" if p[0] is None else f"CAST({p[0]!r} AS DOUBLE)", "field": lambda: p[0],
        "add": lambda: f"({a[0]} + {a[1]})", "sub": lambda: f"({a[0]} - {a[1]})", "mul": lambda: f"({a[0]} * {a[1]})", "div": lambda: f"({a[0]} / nullif({a[1]}, 0))",
        "neg": lambda: f"(-{a[0]})", "mod": lambda: f"({a[0]} - {a[1]} * floor({a[0]} / nullif({a[1]}, 0)))", "abs": lambda: f"abs({a[0]})", "sign": lambda: f"CAST(sign({a[0]}) AS DOUBLE)",
        "greatest": lambda: f"greatest({', '.join(a)})", "least": lambda: f"least({', '.join(a)})",
        **{op: (lambda s=s: f"coalesce({a[0]} {s} {a[1]}, false)") for op, s in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="), ("eq", "="))},
        "ne": lambda: f"coalesce({a[0]} <> {a[1]}, true)", "and": lambda: f"({a[0]} AND {a[1]})", "or": lambda: f"({a[0]} OR {a[1]})", "not": lambda: f"(NOT {a[0]})",
        "truth": lambda: f"coalesce({a[0]} <> 0, true)", "present": lambda: f"({a[0]} IS NOT NULL)", "num": lambda: f"CAST({a[0]} AS DOUBLE)",
        "if": lambda: f"CASE WHEN {a[0]} THEN {a[1]} ELSE {a[2]} END", "ln": lambda: f"CASE WHEN {a[0]} > 0 THEN ln({a[0]}) END",
        "angle": lambda: f"degrees(atan({a[0]}))", "half_even": lambda: f"round_even({a[0]}, {p[0]})",
        "pow": lambda: f"CASE WHEN NOT ({a[0]} < 0 AND {a[1]} <> floor({a[1]})) AND NOT ({a[0]} = 0 AND {a[1]} < 0) THEN pow({a[0]}, {a[1]}) END",
    }[term.op]()


def _fold(term: Term, a: list[str], upto: str) -> str:
    """Recursive terms as folds over the list of all values so far."""
    if term.op == "ewm":
        alpha, least = term.params
        kept = f"pow({1 - alpha!r}, s.g + 1)"
        step = f"CASE WHEN s.y IS NULL THEN e WHEN e.y IS NULL THEN struct_pack(y := s.y, g := s.g + 1) ELSE struct_pack(y := ({kept} * s.y + {alpha!r} * e.y) / ({kept} + {alpha!r}), g := CAST(0 AS DOUBLE)) END"
        return f"CASE WHEN count({a[0]}) OVER {upto} >= {max(1, least)} THEN (list_reduce(list(struct_pack(y := {a[0]}, g := CAST(0 AS DOUBLE))) OVER {upto}, lambda s, e: {step})).y END"
    if term.op == "dma":
        step = "struct_pack(o := e.w * e.x + (1 - e.w) * s.o, x := e.x, w := e.w)"
    else:
        step = "struct_pack(o := coalesce(s.o, s.x) + e.w * (e.x - coalesce(s.o, s.x)), x := e.x, w := e.w)"
    return f"(list_reduce(list(struct_pack(o := {a[0]}, x := {a[0]}, w := {a[1]})) OVER {upto}, lambda s, e: {step})).o"


def _window(term: Term, a: list[str]) -> str:
    op, p = term.op, term.params
    upto = f"({WINDOW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    if op == "shift":
        return f"{'lag' if p[0] > 0 else 'lead'}({a[0]}, {abs(p[0])}) OVER ({WINDOW})"
    if op == "session":
        return "CAST(session_idx AS DOUBLE)"
    if op == "running_sum":
        return f"CASE WHEN {a[0]} IS NOT NULL THEN sum({a[0]}) OVER {upto} END"
    if op == "last_true":
        return f"CAST(max(CASE WHEN {a[0]} > 0 THEN session_idx END) OVER {upto} AS DOUBLE)"
    if op in ("ewm", "dma", "kama"):
        return _fold(term, a, upto)
    if op == "final":
        return f"last_value({a[0]}) OVER ({WINDOW} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    if op == "x_rank":
        return f"CASE WHEN {a[0]} IS NOT NULL THEN (rank() OVER (PARTITION BY session ORDER BY {a[0]} ASC NULLS LAST) + (count(*) OVER (PARTITION BY session, {a[0]}) - 1) / 2.0) / count({a[0]}) OVER (PARTITION BY session) END"
    if term.kind == SECTION:
        return f"{ {'x_min': 'min', 'x_max': 'max', 'x_mean': 'avg', 'x_std': 'stddev_pop'}[op] }({a[0]}) OVER (PARTITION BY session)"
    n, start = (p[1], p[2]) if op == "roll" else (p[-1], 0)
    frame = f"({WINDOW} ROWS BETWEEN {n - 1 + start} PRECEDING AND {f'{start} PRECEDING' if start else 'CURRENT ROW'})"
    full = f"count({a[0]}) OVER {frame} = {n}"
    if op == "roll2":
        full += f" AND count({a[1]}) OVER {frame} = {n}"
        made = f"covar_samp({a[0]}, {a[1]}) OVER {frame}" if p[0] == "cov" else f"covar_pop({a[0]}, {a[1]}) OVER {frame} / nullif(stddev_pop({a[0]}) OVER {frame} * stddev_pop({a[1]}) OVER {frame}, 0)"
    elif op == "trend":
        made = f"regr_slope({a[0]}, CAST(session_idx AS DOUBLE)) OVER {frame}"
    elif op == "shape":
        values = f"list({a[0]}) OVER {frame}"
        made = {
            "argmax": f"CAST(list_position({values}, max({a[0]}) OVER {frame}) - 1 AS DOUBLE)", "argmin": f"CAST(list_position({values}, min({a[0]}) OVER {frame}) - 1 AS DOUBLE)",
            "rank": f"(len(list_filter({values}, lambda e: e < {a[0]})) + (len(list_filter({values}, lambda e: e = {a[0]})) + 1) / 2.0) / {n}",
            "mad": f"list_sum(list_transform({values}, lambda e: abs(e - (avg({a[0]}) OVER {frame})))) / {n}",
            "weighted": f"list_sum(list_transform({values}, lambda e, i: e * i)) / {n * (n + 1) / 2}",
        }[p[0]]
    elif p[0] in ("skew", "kurt"):
        moment = lambda k: f"list_sum(list_transform(list({a[0]}) OVER {frame}, lambda e: pow(e - (avg({a[0]}) OVER {frame}), {k}))) / {n}"
        even = f"(min({a[0]}) OVER {frame} = max({a[0]}) OVER {frame})"
        if p[0] == "skew":
            made = f"CASE WHEN {even} THEN 0 ELSE ({moment(3)}) / nullif(pow({moment(2)}, 1.5), 0) * {(n * (n - 1)) ** 0.5 / (n - 2)!r} END" if n > 2 else "NULL"
        else:
            made = f"CASE WHEN {even} THEN -3 ELSE ((({moment(4)}) / nullif(pow({moment(2)}, 2), 0) - 3) * {n + 1} + 6) * {(n - 1) / ((n - 2) * (n - 3))!r} END" if n > 3 else "NULL"
    else:
        made = {"mean": "avg", "sum": "sum", "product": "product", "std": "stddev_samp", "var": "var_samp", "pstd": "stddev_pop", "max": "max", "min": "min", "median": "median"}[p[0]] + f"({a[0]}) OVER {frame}"
    return f"CASE WHEN {full} THEN {made} END"


def steps_of(expressions: dict[str, str], panel: str, digits: int | None = None) -> tuple[list[str], str]:
    """Common table expressions and the last SELECT over a relation ``panel`` (asset, session, session_idx, fields)."""
    roots = {name: number(parse(e)) for name, e in expressions.items()}
    order = post_order(list(roots.values()))
    names: dict[Term, str] = {}

    def text(term: Term) -> str:
        return names[term] if term in names else _scalar(term, [text(a) for a in term.args])

    steps, at = [], panel
    waiting = [t for t in order if t.kind != SCALAR]
    while waiting:
        now = [t for t in waiting if all(u in names for u in post_order(list(t.args)) if u.kind != SCALAR)]
        # arguments first get a column of their own: windows don't nest
        inputs = {t: [f"i{len(steps)}_{k}_{j}" for j in range(len(t.args))] for k, t in enumerate(now)}
        given = ", ".join(f"{text(a)} AS {n}" for t in now for a, n in zip(t.args, inputs[t], strict=True))
        steps.append(f"s{len(steps)} AS (SELECT *{', ' + given if given else ''} FROM {at})")
        made = ", ".join(f"{_window(t, inputs[t])} AS w{len(steps)}_{k}" for k, t in enumerate(now))
        steps.append(f"s{len(steps)} AS (SELECT *, {made} FROM s{len(steps) - 1})")
        for k, t in enumerate(now):
            names[t] = f"w{len(steps) - 1}_{k}"
        at = f"s{len(steps) - 1}"
        waiting = [t for t in waiting if t not in names]
    shown = lambda t: f"CASE WHEN isfinite({text(t)}) THEN {text(t) if digits is None else f'floor({text(t)} * {10**digits} + {HALF!r}) / {10**digits}'} END"
    return steps, "SELECT asset, session, session_idx, " + ", ".join(f"{shown(t)} AS {n}" for n, t in roots.items()) + f" FROM {at}"
