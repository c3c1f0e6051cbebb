"""Factor expressions: small trees over panel fields.

Equal subtrees are one node.  Operators per ticker and per date alternate: all that a ticker's rows can give is computed in one pass over
rows dealt by ticker, nested windows and all, then what dates need in one over rows dealt by date, and so on; hundreds of factors take a handful
of shuffles.  A pass is a ``mapInArrow`` over whole groups with the vectorised operators of ``kernels``.  ``Expr`` also serves factor mining.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions import FLOAT_MAX
from factorloom.kernels import DATE, ROW, TIME, Groups

#: Rows that a task computes at once, more only where a group has more, and values of all their columns.
ROWS = 8192
VALUES = 1 << 21


@dataclass(frozen=True)
class Expr:
    op: str
    args: tuple = ()

    def __add__(self, o):
        return Expr("+", (self, o))

    def __radd__(self, o):
        return Expr("+", (o, self))

    def __sub__(self, o):
        return Expr("-", (self, o))

    def __rsub__(self, o):
        return Expr("-", (o, self))

    def __mul__(self, o):
        return Expr("*", (self, o))

    def __rmul__(self, o):
        return Expr("*", (o, self))

    def __truediv__(self, o):
        return Expr("/", (self, o))

    def __rtruediv__(self, o):
        return Expr("/", (o, self))

    def __pow__(self, o):
        return Expr("pow", (self, o))

    def __neg__(self):
        return Expr("*", (-1.0, self))

    def __gt__(self, o):
        return Expr(">", (self, o))

    def __lt__(self, o):
        return Expr("<", (self, o))

    def __ge__(self, o):
        return Expr(">=", (self, o))

    def __le__(self, o):
        return Expr("<=", (self, o))

    def __or__(self, o):
        return Expr("or", (self, o))

    def same(self, o):
        return Expr("==", (self, o))


def field(name: str) -> Expr:
    return Expr("field", (name,))


def operator(name: str) -> Callable[..., Expr]:
    return lambda *args: Expr(name, args)


def vocabulary() -> dict[str, Callable[..., Expr]]:
    """Constructors by name, for formulas."""
    return {n: operator(n) for n in [*TIME, *DATE, "abs", "sign", "log", "least", "greatest", "where", "sdiv"]}


def stages(formulas: Mapping[str, Expr]) -> dict[Expr, int]:
    """The pass of each operator over groups: even ones are by ticker, odd ones by date; a node comes after all that it reads."""
    out: dict[Expr, int] = {}
    seen: dict[Expr, int] = {}

    def visit(e) -> int:
        if not isinstance(e, Expr) or e.op == "field":
            return 0
        if e not in seen:
            below = max((visit(a) for a in e.args), default=0)
            if e.op in TIME or e.op in DATE:
                below += below % 2 != (e.op in DATE)
                out[e] = below
            seen[e] = below
        return seen[e]

    for e in formulas.values():
        visit(e)
    return out


#: Operators that read all rows before their own; of what is before a row they need one number, their value there.
UNBOUNDED = ("fill", "growth")


def unbounded(formulas: Mapping[str, Expr]) -> list[Expr]:
    """The nodes that read all earlier rows, inner ones first."""
    out: dict[Expr, None] = {}
    seen: set[Expr] = set()

    def visit(e) -> None:
        if isinstance(e, Expr) and e.op != "field" and e not in seen:
            seen.add(e)
            for a in e.args:
                visit(a)
            if e.op in UNBOUNDED:
                out[e] = None

    for e in formulas.values():
        visit(e)
    return list(out)


def seeded(formulas: Mapping[str, Expr], seeds: Mapping[Expr, str]) -> dict[str, Expr]:
    """The formulas with unbounded nodes that start from the columns named in ``seeds``."""
    made: dict[Expr, Expr] = {}

    def visit(e):
        if not isinstance(e, Expr) or e.op == "field":
            return e
        if e not in made:
            args = tuple(visit(a) for a in e.args)
            made[e] = Expr(e.op, (*args, field(seeds[e])) if e in seeds else args)
        return made[e]

    return {n: visit(e) for n, e in formulas.items()}


def renamed(formulas: Mapping[str, Expr], names: Mapping[str, str]) -> dict[str, Expr]:
    """The formulas over fields of other names."""

    def visit(e):
        if not isinstance(e, Expr):
            return e
        return field(names[e.args[0]]) if e.op == "field" else Expr(e.op, tuple(visit(a) for a in e.args))

    return {n: visit(e) for n, e in formulas.items()}


def reaches(formulas: Mapping[str, Expr]) -> dict[int, int]:
    """By pass over tickers how many earlier rows of a ticker it reads at most, nested windows added up; unbounded nodes are taken as seeded."""
    at = stages(formulas)
    known: dict[Expr, dict[int, int]] = {}

    def reach(e) -> dict[int, int]:
        if not isinstance(e, Expr) or e.op == "field":
            return {}
        if e not in known:
            out: dict[int, int] = {}
            for a in e.args:
                for p, n in reach(a).items():
                    out[p] = max(n, out.get(p, 0))
            if e.op in TIME:
                out[at[e]] = out.get(at[e], 0) + max((a for a in e.args if isinstance(a, int)), default=0)
            known[e] = out
        return known[e]

    out: dict[int, int] = {}
    for e in formulas.values():
        for p, n in reach(e).items():
            out[p] = max(n, out.get(p, 0))
    return out


def with_factors(panel: DataFrame, formulas: Mapping[str, Expr], keep: list[str], dtype: str = "double", keys: tuple[str, str] = ("ticker", "date"), exact: Mapping[str, Expr] | None = None) -> DataFrame:
    """``keep`` and a column of type ``dtype`` (float or double) for each formula, of type double for those in ``exact``.

    Each pass deals the rows once and holds some thousand rows, or one ticker's or date's, at a time.  The fewest values that later passes need go along.
    Missing values are NULL, never NaN; floats are NULL where a value is beyond their range.
    """
    kinds = dict.fromkeys(formulas, dtype) | dict.fromkeys(exact or {}, "double")
    formulas = {**formulas, **(exact or {})}
    return _passes(panel, formulas, kinds, keep, keys)


def _passes(panel: DataFrame, formulas: Mapping[str, Expr], kinds: Mapping[str, str], keep: list[str], keys: tuple[str, str]) -> DataFrame:
    """``keep`` and the formulas by one chain of passes."""
    at = stages(formulas)
    fields = {e: None for e in _inner(formulas.values()) if e.op == "field"}
    order = sorted(set(at.values())) or [0]
    between = carried(formulas, at, order)
    names = {e: f"_f{i}" for i, e in enumerate(fields)}
    names |= {e: f"_w{i}" for i, e in enumerate(dict.fromkeys(e for some in between for e in some if e not in fields))}
    types = dict(panel.dtypes)
    extra = list(dict.fromkeys([*keys, *keep]))
    rows = panel.select(*[F.col(f"`{c}`") for c in extra], *[F.col(f"`{e.args[0]}`").cast("double").alias(n) for e, n in names.items() if e in fields])
    parts = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for i, now in enumerate(order):
        have, wanted = between[i - 1] if i else fields, between[i] if i < len(between) else []
        done = {} if i < len(between) else formulas
        group, sort = (keys[0], [*keys]) if now % 2 == 0 else (keys[1], [keys[1]])
        dealt = rows.repartition(parts, group).sortWithinPartitions(*sort)
        schema = ", ".join([*[f"`{c}` {types[c]}" for c in extra], *[f"{names[e]} double" for e in wanted], *[f"`{n}` {kinds[n]}" for n in done]])
        plan = {"group": group, "extra": extra, "have": {e: names[e] for e in have}, "wanted": {e: names[e] for e in wanted}, "done": done, "kinds": {n: kinds[n] for n in done}}
        rows = dealt.mapInArrow(one_pass(plan), schema)
    return rows.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{n}`") for n in formulas])


def _inner(formulas) -> dict[Expr, None]:
    """All nodes, those that a node reads before it."""
    out: dict[Expr, None] = {}

    def visit(e) -> None:
        if isinstance(e, Expr) and e not in out:
            for a in e.args:
                visit(a)
            out[e] = None

    for e in formulas:
        visit(e)
    return out


def carried(formulas: Mapping[str, Expr], at: Mapping[Expr, int], order: list[int]) -> list[list[Expr]]:
    """What goes from each pass in ``order`` to the next: the fewest values from which the later ones can be computed.

    All is computed as late as it can be. Going back from the formulas, what a pass is given is a minimum cut of what it can compute, among such
    cuts the one nearest to the fields. So finished columns and inner values don't travel where what they are made of travels anyway.
    """
    nodes = list(_inner(formulas.values()))
    number = {e: i for i, e in enumerate(nodes)}
    below = [[number[a] for a in e.args if isinstance(a, Expr)] for e in nodes]
    since: list[int] = []  # the pass that can give a node first; fields are there before all
    for e, args in zip(nodes, below, strict=True):
        since.append(at.get(e, max((since[a] for a in args), default=-1)))
    needed, out = {number[e] for e in formulas.values() if isinstance(e, Expr)}, []
    for now, before in zip(order[:0:-1], order[-2::-1], strict=True):
        # only fields and operators over the other groups have to be given
        given = [e.op == "field" or e in at and (at[e] - now) % 2 == 1 for e in nodes]
        needed = _cut(needed, below, given, [s <= before for s in since])
        out.append([nodes[i] for i in sorted(needed)])
    return out[::-1]


def _cut(needed: set[int], below: list[list[int]], given: list[bool], possible: list[bool]) -> set[int]:
    """The fewest ``possible`` nodes that stand on all ways from given nodes up to needed ones, as near to the given ones as there are; by augmenting paths."""
    start, end, many = -1, -2, len(below) + 1
    left: dict[int, dict[int, int]] = {start: {}, end: {}}  # a node is an arc from 2i to 2i + 1

    def arc(u: int, v: int, n: int) -> None:
        left.setdefault(u, {})[v] = n
        left.setdefault(v, {}).setdefault(u, 0)

    seen, todo = set(needed), list(needed)
    while todo:
        v = todo.pop()
        arc(2 * v, 2 * v + 1, 1 if possible[v] else many)
        if given[v]:
            arc(start, 2 * v, many)
            continue
        for a in below[v]:
            arc(2 * a + 1, 2 * v, many)
            if a not in seen:
                seen.add(a)
                todo.append(a)
    for v in needed:
        arc(2 * v + 1, end, many)
    while True:
        came, todo = {start: start}, [start]
        for u in todo:
            for v, n in left[u].items():
                if n and v not in came:
                    came[v] = u
                    todo.append(v)
            if end in came:
                break
        if end not in came:
            return {v for v in seen if 2 * v in came and 2 * v + 1 not in came}
        v = end
        while v != start:
            u = came[v]
            left[u][v] -= 1
            left[v][u] += 1
            v = u


def one_pass(plan: dict):
    """Batches of rows sorted by group to batches with the pass's columns.

    Of a block, operators over groups are held whole, one array each; all else is made for some thousand rows at a time, so a large group needs
    no more than its inputs and these arrays.
    """
    names = plan["have"]
    made = {**{n: (e, "double") for e, n in plan["wanted"].items()}, **{n: (e, plan["kinds"][n]) for n, e in plan["done"].items()}}
    most = max(1024, min(ROWS, VALUES // (1 + len(names) + len(made))))

    def column(x, dtype: str, n: int) -> pa.Array:
        x = np.broadcast_to(np.asarray(x, float), n)
        if dtype == "float":
            x = np.where(np.abs(x) <= FLOAT_MAX, x, np.nan).astype(np.float32)
        return pa.array(x, mask=np.isnan(x))

    def evaluated(e, known: dict, read: Callable, operate: Callable, keep: bool):
        """``e`` over some rows, inner values in ``known`` where they are kept."""
        if not isinstance(e, Expr):
            return float(e)
        if e in known:
            return known[e]
        if e in names:
            out = read(e)
        elif e.op in TIME or e.op in DATE:
            return operate(e)
        else:
            out = ROW[e.op](*[evaluated(a, known, read, operate, keep) for a in e.args])
        if keep:
            known[e] = out
        return out

    def compute(table: pa.Table, groups: Groups):
        held: dict = {}
        whole: dict = {}
        small = groups.n <= 2 * ROWS

        def operate(e):
            if e not in held:
                columns = [np.broadcast_to(over(a), groups.n) if isinstance(a, Expr) else a for a in e.args]
                held[e] = (TIME.get(e.op) or DATE[e.op])(groups, *columns)
            return held[e]

        def over(e):
            return evaluated(e, whole, lambda f: table.column(names[f]).to_numpy(), operate, small)

        def prepare(e) -> None:
            if isinstance(e, Expr) and e not in names and e.op != "field":
                if e.op in TIME or e.op in DATE:
                    operate(e)
                else:
                    for a in e.args:
                        prepare(a)

        for e, _ in made.values():
            prepare(e)
        whole.clear()
        for at in range(0, groups.n, most):
            rows = table.slice(at, most)
            n, known = rows.num_rows, {}
            part = lambda e, k=known, t=rows, a=at, n=n: evaluated(e, k, lambda f: t.column(names[f]).to_numpy(), lambda o: held[o][a : a + n], True)
            out = {c: rows.column(c) for c in plan["extra"]}
            out |= {c: column(part(e), kind, n) for c, (e, kind) in made.items()}
            yield from pa.table(out).combine_chunks().to_batches()

    def blocks(table: pa.Table, starts: np.ndarray, end: int):
        """Whole groups, some thousand rows of them at once."""
        first = 0
        for i in range(1, len(starts) + 1):
            stop = int(starts[i]) if i < len(starts) else end
            if stop - starts[first] >= most or i == len(starts):
                at = int(starts[first])
                with np.errstate(all="ignore"):
                    yield from compute(table.slice(at, stop - at).combine_chunks(), Groups(starts[first:i] - at, stop - at))
                first = i

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < most:
                continue
            starts = group_starts(held.column(plan["group"]))
            if len(starts) > 1:  # the last group may go on
                cut = int(starts[-1])
                done, held = held.slice(0, cut), held.slice(cut)
                yield from blocks(done, starts[:-1], cut)
                del done
        if held is not None and held.num_rows:
            done, held, n = held, None, held.num_rows
            yield from blocks(done, group_starts(done.column(plan["group"])), n)

    return run


def group_starts(column: pa.ChunkedArray) -> np.ndarray:
    code = column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, np.int64)
