"""Terms of the factor language: immutable, shared where equal, built by ordinary Python operators.

A term is an operation with child terms and fixed parameters. Kinds: ``scalar`` (within a cell), ``series`` (along an
asset's sessions), ``recursive`` (along sessions, each value from the one before, or from a whole window at once), ``section`` (across a session's assets).
Missing is null; comparisons with null are false, ``!=`` is true; a number counts as a condition unless it is zero.
"""

from __future__ import annotations

from dataclasses import dataclass, field

SCALAR, SERIES, RECURSIVE, SECTION = "scalar", "series", "recursive", "section"
CONDITIONS = frozenset({"lt", "le", "gt", "ge", "eq", "ne", "and", "or", "not", "truth", "present", "true"})
KIND_OF = {
    **dict.fromkeys(("shift", "roll", "roll2", "trend", "running_sum", "last_true", "session", "final"), SERIES),
    **dict.fromkeys(("ewm", "dma", "kama", "shape"), RECURSIVE),
    **dict.fromkeys(("x_rank", "x_min", "x_max", "x_mean", "x_std"), SECTION),
}


@dataclass(frozen=True, eq=False)
class Term:
    op: str
    args: tuple[Term, ...] = ()
    params: tuple = ()
    key: str = field(default="", compare=False)

    def __post_init__(self) -> None:
        inner = ",".join(a.key for a in self.args)
        object.__setattr__(self, "key", f"{self.op}[{','.join(map(repr, self.params))}]({inner})")

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Term) and self.key == other.key

    def __hash__(self) -> int:
        return hash(self.key)

    @property
    def kind(self) -> str:
        return KIND_OF.get(self.op, SCALAR)

    @property
    def is_condition(self) -> bool:
        return self.op in CONDITIONS

    def _two(self, op: str, other: object, swap: bool = False) -> Term:
        a, b = number(self), number(other)
        return Term(op, (b, a) if swap else (a, b))

    def __add__(self, o):
        return self._two("add", o)

    def __radd__(self, o):
        return self._two("add", o, True)

    def __sub__(self, o):
        return self._two("sub", o)

    def __rsub__(self, o):
        return self._two("sub", o, True)

    def __mul__(self, o):
        return self._two("mul", o)

    def __rmul__(self, o):
        return self._two("mul", o, True)

    def __truediv__(self, o):
        return self._two("div", o)

    def __rtruediv__(self, o):
        return self._two("div", o, True)

    def __mod__(self, o):
        return self._two("mod", o)

    def __pow__(self, o):
        return self._two("pow", o)

    def __neg__(self):
        return Term("neg", (number(self),))

    def __lt__(self, o):
        return self._two("lt", o)

    def __le__(self, o):
        return self._two("le", o)

    def __gt__(self, o):
        return self._two("gt", o)

    def __ge__(self, o):
        return self._two("ge", o)

    def __and__(self, o):
        return Term("and", (condition(self), condition(o)))

    def __or__(self, o):
        return Term("or", (condition(self), condition(o)))

    def __invert__(self):
        return Term("not", (condition(self),))


def lit(value: float | None) -> Term:
    return Term("lit", (), (None if value is None else float(value),))


def as_term(value: object) -> Term:
    return value if isinstance(value, Term) else lit(value)  # type: ignore[arg-type]


def number(value: object) -> Term:
    term = as_term(value)
    return Term("num", (term,)) if term.is_condition else term


def condition(value: object) -> Term:
    term = as_term(value)
    return term if term.is_condition else Term("truth", (term,))


def source(name: str) -> Term:
    return Term("field", (), (name,))


def equal(a, b) -> Term:
    return Term("eq", (number(a), number(b)))


def unequal(a, b) -> Term:
    return Term("ne", (number(a), number(b)))


def present(x) -> Term:
    return Term("present", (number(x),))


def choose(c, a, b=None) -> Term:
    return Term("if", (condition(c), number(a), number(lit(None) if b is None else b)))


def call(op: str, *args, params: tuple = ()) -> Term:
    return Term(op, tuple(number(a) for a in args), params)


def shift(x, n: int) -> Term:
    return call("shift", x, params=(int(n),)) if n else number(x)


def roll(how: str, x, n: int, start: int = 0) -> Term:
    """An aggregate over the n sessions that end ``start`` sessions ago; null unless all n have a value."""
    return call("roll", x, params=(how, int(n), int(start)))


def diff(x, n: int = 1) -> Term:
    return number(x) - shift(x, n)


def ewm(x, alpha: float, least: int) -> Term:
    return call("ewm", x, params=(float(alpha), int(least)))


def ema(x, n: int) -> Term:
    return ewm(x, 2.0 / (n + 1), n)


def below(x, bound: float = 0.0) -> Term:
    """x where it is under the bound, else the bound; null stays null."""
    return choose(present(x), call("least", x, lit(bound)))


def above(x, bound: float = 0.0) -> Term:
    return choose(present(x), call("greatest", x, lit(bound)))


def post_order(roots: list[Term]) -> list[Term]:
    """Every distinct term once, children first."""
    seen: dict[Term, None] = {}
    stack = [(r, False) for r in reversed(roots)]
    while stack:
        term, done = stack.pop()
        if done:
            seen.setdefault(term)
        elif term not in seen:
            stack.append((term, True))
            stack.extend((a, False) for a in reversed(term.args))
    return list(seen)


def reach(root: Term) -> tuple[int | None, int]:
    """Sessions a value needs before and after its own; None where all earlier ones count."""
    known: dict[Term, tuple[int | None, int]] = {}
    for term in post_order([root]):
        backs = [known[a][0] for a in term.args]
        back = None if any(b is None for b in backs) else max(backs, default=0)
        ahead = max((known[a][1] for a in term.args), default=0)
        if term.op == "shift":
            n = term.params[0]
            back, ahead = (back if n < 0 or back is None else back + n), ahead + max(0, -n)
        elif term.op == "roll":
            back = None if back is None else back + term.params[1] - 1 + term.params[2]
        elif term.op in ("roll2", "shape", "trend"):
            back = None if back is None else back + term.params[-1] - 1
        elif term.kind == RECURSIVE or term.op in ("running_sum", "last_true", "final"):
            back = None
        known[term] = (back, ahead)
    return known[root]
