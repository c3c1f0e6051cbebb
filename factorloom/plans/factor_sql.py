"""Factor expressions as SQL: the oracle of whole families, written from their formulas alone."""

from __future__ import annotations

from collections.abc import Mapping
from math import ceil, log10

from factorloom.expressions import Expr
from factorloom.kernels import DATE, LEVEL, TIME, TWELVE

#: Powers of ten that bars of this data are about.
SIZES = {"open": 3, "high": 3, "low": 3, "close": 3, "vwap": 3, "volume": 2, "turnover": 5, "amount": 5, "turnover_rate": 0}
ONE = ("rank", "ts_rank", "corr", "sign", ">", "<", ">=", "<=", "==", "or")


def size(e) -> float:
    """About which power of ten a formula's values have, by rule."""
    if not isinstance(e, Expr):
        return log10(abs(e)) if e and e == e else 0
    if e.op == "field":
        return SIZES[e.args[0]]
    s = [size(a) for a in e.args if isinstance(a, Expr)]
    if e.op in ONE:
        return 0
    if e.op in ("*", "cov"):
        return sum(size(a) for a in e.args[:2])
    if e.op in ("/", "sdiv"):
        return size(e.args[0]) - size(e.args[1])
    if e.op == "pow":
        return s[0] * (e.args[1] if not isinstance(e.args[1], Expr) else 1)
    if e.op == "ts_sum":
        return s[0] + log10(e.args[1])
    if e.op in ("argmax", "argmin", "log", "growth"):
        return 1
    if e.op == "scale":
        return -2
    return max(size(a) for a in e.args) if e.op in ("+", "-") else max(s)


def digits(e: Expr) -> int:
    """Decimals that leave about five figures, the same in both engines."""
    return 5 - ceil(size(e))


def finite(x: str) -> str:
    return f"CASE WHEN isfinite({x}) THEN {x} END"


def family_sql(formulas: Mapping[str, Expr], bars: str) -> str:
    """A query for ``date, ticker`` and each formula over the ``bars`` query; one step for each depth of windows."""
    depth: dict[Expr, int] = {}

    def visit(e) -> int:
        if not isinstance(e, Expr) or e.op == "field":
            return 0
        if e not in depth:
            depth[e] = max((visit(a) for a in e.args), default=0) + (e.op in TIME or e.op in DATE)
        return depth[e]

    for e in formulas.values():
        visit(e)
    windows = [e for e in depth if e.op in TIME or e.op in DATE]
    names = {e: f"w{i}" for i, e in enumerate(windows)}
    inner: dict[str, str] = {}  # arguments that windows take, by their SQL

    def row(e) -> str:
        if not isinstance(e, Expr):
            return "NULL::DOUBLE" if e != e else f"({float(e)!r})::DOUBLE"
        if e.op == "field":
            return f"{e.args[0]}"
        if e in names:
            return names[e]
        a = [row(x) for x in e.args]
        if e.op in ("+", "-", "*"):
            return f"({a[0]} {e.op} {a[1]})"
        if e.op == "/":
            return f"(CASE WHEN {a[1]} = 0 THEN CASE WHEN {a[0]} > 0 THEN 'inf'::DOUBLE WHEN {a[0]} < 0 THEN '-inf'::DOUBLE END ELSE {a[0]} / {a[1]} END)"
        if e.op == "sdiv":
            return f"({a[0]} / nullif({a[1]}, 0))"
        if e.op in (">", "<", ">=", "<=", "=="):
            return f"(coalesce({a[0]} {'=' if e.op == '==' else e.op} {a[1]}, false)::INT::DOUBLE)"
        known = {"pow": "pow({0}, {1})", "or": "greatest({0}, {1})", "least": "least({0}, {1})", "greatest": "greatest({0}, {1})", "abs": "abs({0})", "sign": "sign({0})::DOUBLE",
                 "log": "(CASE WHEN {0} > 0 THEN ln({0}) END)", "where": "(CASE WHEN {0} > 0 THEN {1} ELSE {2} END)"}
        return known[e.op].format(*a)

    def window(e: Expr, arg) -> str:
        n = next((x for x in e.args if isinstance(x, int)), 1)
        least = e.args[-1] if e.op not in ("delay", "delta", "decay", "argmax", "argmin", "fill", "growth", "rank", "scale") and sum(isinstance(x, int) for x in e.args) > 1 else n
        x = arg(e.args[0], False, e.op in ("rank", "ts_rank"))
        w = f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        o = "(PARTITION BY ticker ORDER BY date)"
        full = lambda value, x=x: f"CASE WHEN count({x}) OVER {w} >= {least} THEN {value} END"
        f = arg(e.args[0], True, e.op in ("argmax", "argmin"))
        simple = {"ts_sum": "sum", "mean": "avg", "std": "stddev_samp", "ts_min": "min", "ts_max": "max"}
        if e.op in simple:
            return full(f"{simple[e.op]}({f}) OVER {w}", f)
        if e.op in ("corr", "cov"):
            g = arg(e.args[1], True)
            both = f"CASE WHEN {f} IS NOT NULL AND {g} IS NOT NULL THEN 1 END"
            if e.op == "cov":
                return full(f"covar_samp({f}, {g}) OVER {w}", both)
            u, v = f"CASE WHEN {g} IS NOT NULL THEN {f} END", f"CASE WHEN {f} IS NOT NULL THEN {g} END"
            return full(f"covar_samp({f}, {g}) OVER {w} / nullif(stddev_samp({u}) OVER {w} * stddev_samp({v}) OVER {w}, 0) + {TWELVE!r}::DOUBLE - {TWELVE!r}::DOUBLE", both)
        if e.op == "quantile":
            return full(f"quantile_cont({f}, {e.args[2]}) OVER {w}", f)
        values = f"(list({{x}}) FILTER ({{x}} IS NOT NULL) OVER {w})"
        if e.op == "ts_rank":
            a = values.format(x=x)
            return f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER {w} >= {least} THEN (len(list_filter({a}, lambda v: v < {x})) + (len(list_filter({a}, lambda v: v = {x})) + 1) / 2.0::DOUBLE) / len({a}) END"
        if e.op in ("argmax", "argmin"):
            a = values.format(x=f)
            return full(f"list_position({a}, list_{e.op[3:]}({a}))::DOUBLE", f)
        if e.op == "decay":
            return full(f"list_dot_product({values.format(x=f)}, {[float(i) for i in range(1, n + 1)]}::DOUBLE[]) / {n * (n + 1) / 2}::DOUBLE", f)
        if e.op == "delay":
            return f"lag({x}, {n}) OVER {o}"
        if e.op == "delta":
            return f"{x} - lag({x}, {n}) OVER {o}"
        if e.op == "fill":
            return f"last_value({x} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"
        if e.op == "growth":
            return f"CASE WHEN {x} IS NOT NULL THEN product(1 + {x}) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) END"
        if e.op == "rank":
            return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0::DOUBLE) / count({x}) OVER (PARTITION BY date) END"
        return f"{x} * {float(e.args[1]) if len(e.args) > 1 else 1.0!r} / nullif(sum(abs({x})) OVER (PARTITION BY date), 0)"

    steps, last = [f"t0 AS ({bars})"], "t0"
    for d in range(1, max(depth.values(), default=0) + 1):
        now = [e for e in windows if depth[e] == d]
        inner.clear()

        def arg(e, only_finite: bool = False, ties: bool = False, inner=inner) -> str:
            """A column for an argument, NaN as NULL; of finite values alone where asked."""
            text = row(e)
            text = finite(text) if only_finite else f"CASE WHEN NOT isnan({text}) THEN {text} END"
            if ties:
                text = f"CASE WHEN isfinite({text}) THEN ({text}) * {LEVEL!r}::DOUBLE - (({text}) * {LEVEL!r}::DOUBLE - ({text})) ELSE {text} END"
            return inner.setdefault(text, f"a{len(inner)}")

        made = [(names[e], window(e, arg)) for e in now]
        steps.append(f"b{d} AS (SELECT *, {', '.join(f'{x} AS {n}' for x, n in inner.items())} FROM {last})")
        steps.append(f"c{d} AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in made)} FROM b{d})")
        steps.append(f"t{d} AS (SELECT * EXCLUDE ({', '.join(inner.values())}) FROM c{d})")
        last = f"t{d}"
    out = ", ".join(f"CASE WHEN abs({row(e)}) <= 3.4028235e38 THEN round({row(e)}, {digits(e)}) END AS {n}" for n, e in formulas.items())
    return f"WITH {', '.join(steps)} SELECT strftime(date, '%Y-%m-%d') AS date, ticker, {out} FROM {last}"
