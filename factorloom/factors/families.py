"""Builders of the four families, and their catalogue."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.expressions import Expr, field, reaches, renamed, seeded, stages, unbounded, vocabulary, with_factors
from factorloom.factors.formulas import ALPHA101, ALPHA191
from factorloom.functions import no_nan

KEYS = ["date", "ticker"]
FAMILIES = {"alpha101": 101, "alpha191": 191, "alpha158": 158, "alpha360": 360}
PRICES = ("open", "high", "low", "close", "vwap")
FIELDS = ("open", "high", "low", "close", "vwap", "volume", "amount", "turnover_rate")


def expected_columns(family: str) -> list[str]:
    if family in ("alpha101", "alpha191"):
        return [f"{family}_{i:03d}" for i in range(1, FAMILIES[family] + 1)]
    if family == "alpha360":
        return list(alpha360_formulas())
    if family == "alpha158":
        return list(alpha158_formulas())
    raise ValueError(f"no factor family {family!r}; there are {sorted(FAMILIES)}")


def formulas(family: str) -> dict[str, Expr]:
    """The expressions of a family by column name."""
    if family in ("alpha158", "alpha360"):
        return {"alpha158": alpha158_formulas, "alpha360": alpha360_formulas}[family]()
    names = vocabulary() | {f: field(f) for f in ("open", "high", "low", "close", "vwap", "volume", "turnover", "turnover_rate")} | {"returns": change(field("close"))}
    text = {"alpha101": ALPHA101, "alpha191": ALPHA191}[family]
    out = {}
    for line in text.strip().splitlines():
        number, formula = line.split(" = ", 1)
        out[f"{family}_{int(number):03d}"] = eval(formula, {"__builtins__": {}}, names)  # noqa: S307  our own constants
    return out


def inputs(panel: DataFrame, fields: Iterable[str], adjusted: bool = True) -> DataFrame:
    """Keys and fields as doubles, gaps NULL: adjusted prices where the panel has them, unless ``adjusted`` is off; absent fields NULL throughout."""

    return panel.select(*KEYS, *[picked(panel, f, adjusted).alias(f) for f in fields])


def picked(panel: DataFrame, name: str, adjusted: bool = True) -> Column:
    for c in ([f"{name}_adj"] if adjusted and name in PRICES else []) + [name]:
        if c in panel.columns:
            return no_nan(F.col(c).cast("double"))
    return F.lit(None).cast("double")


def classic_factors(panel: DataFrame, families: Iterable[str] = ("alpha191", "alpha101"), *, only: Iterable[str] | None = None, adjusted: bool = True, dtype: str = "float") -> DataFrame:
    """Keys and the columns of the classic families, or those in ``only``; volume 0 counts as 1."""
    every: dict[str, Expr] = {}
    for f in dict.fromkeys(families):
        every |= formulas(f)
    chosen = {k: every[k] for k in (only if only is not None else every)}
    return with_factors(classic_inputs(panel, adjusted), chosen, KEYS, dtype)


def classic_inputs(panel: DataFrame, adjusted: bool = True, more: Iterable[str] = ()) -> DataFrame:
    rows = inputs(panel, [*FIELDS, *more], adjusted).withColumnRenamed("amount", "turnover")
    return rows.withColumn("volume", F.when(F.col("volume") == 0, 1.0).otherwise(F.col("volume")))


def bar_inputs(panel: DataFrame, family: str, adjusted: bool = True, more: Iterable[str] = ()) -> DataFrame:
    require(panel, BARS)
    if family == "alpha360":
        return inputs(panel, [*BARS, *more], adjusted)
    rows = inputs(panel, [*BARS, "amount", *more], adjusted)
    return rows if "amount" in panel.columns else rows.withColumn("amount", F.col("close") * F.col("volume"))


def continued(panel: DataFrame, family: str, dtype: str = "float") -> DataFrame:
    """Keys, a family's columns and ``_state_i`` of each unbounded node, which starts from the panel's column ``_seed_i``: its value before the ticker's first row."""
    every = formulas(family)
    nodes = unbounded(every)
    seeds = {e: f"_seed_{i}" for i, e in enumerate(nodes)}
    run = seeded({**every, **{f"_state_{i}": e for i, e in enumerate(nodes)}}, seeds)
    rows = classic_inputs(panel, more=seeds.values()) if family in ("alpha101", "alpha191") else bar_inputs(panel, family, more=seeds.values())
    return with_factors(rows, {k: run[k] for k in every}, KEYS, dtype, exact={k: e for k, e in run.items() if k not in every})


SPANS = (5, 10, 20, 30, 60)
BARS = ("open", "high", "low", "close", "vwap", "volume")


def change(x: Expr) -> Expr:
    """Relative change of the last known values."""
    filled = Expr("fill", (x,))
    return Expr("sdiv", (filled, Expr("delay", (filled, 1)))) - 1


def alpha158_formulas() -> dict[str, Expr]:
    w = vocabulary()
    div, delay, low_of, high_of = w["sdiv"], w["delay"], w["ts_min"], w["ts_max"]
    o, h, lo, c, v, vol, amt = (field(x) for x in ("open", "high", "low", "close", "vwap", "volume", "amount"))
    rng, top, bottom = h - lo, w["greatest"](o, c), w["least"](o, c)
    out = {
        "kmid": div(c - o, o), "klen": div(h - lo, o), "kmid2": div(c - o, rng), "kup": div(h - top, o), "kup2": div(h - top, rng),
        "klow": div(bottom - lo, o), "klow2": div(bottom - lo, rng), "ksft": div(2 * c - h - lo, o), "ksft2": div(2 * c - h - lo, rng),
    }
    for name, x in (("open", o), ("high", h), ("low", lo), ("vwap", v)):
        for k in range(20):
            out[f"{name}_lag{k:02d}_rel_close"] = div(delay(x, k) if k else x, c) - 1
    ret, vret = change(c), change(w["where"](vol.same(0), float("nan"), vol))
    for n in SPANS:
        hi, low = high_of(h, n, 1), low_of(lo, n, 1)
        out |= {
            f"roc_{n}": div(c, delay(c, n)) - 1,
            f"ma_{n}": div(w["mean"](c, n, 1), c) - 1,
            f"std_{n}": w["std"](ret, n, 2),
            f"max_{n}": div(hi, c) - 1,
            f"min_{n}": div(low, c) - 1,
            f"q80_{n}": div(w["quantile"](c, n, 0.8, 1), c) - 1,
            f"q20_{n}": div(w["quantile"](c, n, 0.2, 1), c) - 1,
            f"rank_{n}": w["ts_rank"](c, n, 1),
            f"rsv_{n}": div(c - low, hi - low),
            f"ret_mean_{n}": w["mean"](ret, n, 1),
            f"vma_{n}": div(vol, w["mean"](vol, n, 1)) - 1,
            f"vstd_{n}": w["std"](vret, n, 2),
            f"amount_ma_{n}": div(amt, w["mean"](amt, n, 1)) - 1,
        }
    out |= {"vwap_rel_close": div(v, c) - 1, "high_low_spread": div(h - lo, c), "close_to_high": div(c, h) - 1, "close_to_low": div(c, lo) - 1}
    return {f"alpha158_{k}": x for k, x in out.items()}


def alpha360_formulas() -> dict[str, Expr]:
    w = vocabulary()
    base = {f: field("volume" if f == "volume" else "close") for f in BARS}
    return {f"alpha360_{f}_lag{k:02d}": w["sdiv"](w["delay"](field(f), k) if k else field(f), base[f]) - 1 for f in BARS for k in range(60)}


def require(panel: DataFrame, names: Iterable[str]) -> None:
    if missing := [n for n in names if n not in panel.columns]:
        raise KeyError(f"the panel lacks {missing}")


def alpha158(panel: DataFrame, *, only: Iterable[str] | None = None, adjusted: bool = True, dtype: str = "float") -> DataFrame:
    """Keys and 158 candlestick, lag and rolling columns; windows need one value (deviations two). One shuffle."""
    rows, every = bar_inputs(panel, "alpha158", adjusted), alpha158_formulas()
    return with_factors(rows, {k: every[k] for k in (only if only is not None else every)}, KEYS, dtype)


def alpha360(panel: DataFrame, *, only: Iterable[str] | None = None, adjusted: bool = True, dtype: str = "float") -> DataFrame:
    """Keys and 60 lags of six fields over the current close (volume over the current volume), less 1. One shuffle."""
    every = alpha360_formulas()
    return with_factors(bar_inputs(panel, "alpha360", adjusted), {k: every[k] for k in (only if only is not None else every)}, KEYS, dtype)


def family_of(column: str) -> str | None:
    """The family whose prefix a column has."""
    return next((f for f in FAMILIES if column.startswith(f"{f}_")), None)


def normal_family(name: str) -> str:
    """Names as people write them: Alpha-158, alpha158_, ALPHA158."""
    clean = name.strip().lower().replace("-", "").replace("_", "").replace(" ", "")
    if clean not in FAMILIES:
        raise ValueError(f"no factor family {name!r}; there are {sorted(FAMILIES)}")
    return clean


def add_family(panel: DataFrame, family: str, dtype: str = "float") -> DataFrame:
    """The panel with a family's columns; rows stay as they are."""
    return add_families(panel, [family], dtype)


def add_families(panel: DataFrame, families: Iterable[str], dtype: str = "float") -> DataFrame:
    """The panel with the columns of families, each made from the panel alone; both classic families are one chain of passes.

    The panel's columns go along with the rows. Only where they are so many that taking them through all passes moves more, the classic families are joined to them.
    """
    names = list(dict.fromkeys(map(normal_family, families)))
    every = {f: formulas(f) for f in names}
    out = panel.drop(*[c for e in every.values() for c in e])
    if classic := [f for f in names if f in ("alpha101", "alpha191")]:
        chosen = {k: e for f in classic for k, e in every[f].items()}
        if (len(out.columns) - len(KEYS)) * len(set(stages(chosen).values())) <= len(out.columns) + len(chosen):
            volume = picked(out, "volume")
            read = {f: picked(out, "amount" if f == "turnover" else f) for f in ("open", "high", "low", "close", "vwap", "turnover", "turnover_rate")}
            out = _along(out, chosen, read | {"volume": F.when(volume == 0, 1.0).otherwise(volume)}, dtype)
        else:
            out = out.join(classic_factors(panel, classic, dtype=dtype), KEYS, "left")
    for f in names:
        if f in ("alpha158", "alpha360"):
            require(out, BARS)
            read = {b: picked(out, b) for b in BARS}
            if f == "alpha158":
                read["amount"] = picked(out, "amount") if "amount" in out.columns else read["close"] * read["volume"]
            out = _along(out, every[f], read, dtype)
    return out


def _along(panel: DataFrame, chosen: dict[str, Expr], read: dict[str, Column], dtype: str) -> DataFrame:
    """The panel's columns and the formulas over ``read``, which go with the rows through the passes."""
    own = [*KEYS, *[c for c in panel.columns if c not in KEYS]]
    rows = panel.select(*[F.col(f"`{c}`") for c in own], *[x.alias(f"_in_{n}") for n, x in read.items()])
    return with_factors(rows, renamed(chosen, {n: f"_in_{n}" for n in read}), own, dtype)


def catalogue() -> list[dict]:
    return [{"family": f, "columns": n, "prefix": f"{f}_"} for f, n in FAMILIES.items()]


def factor_catalogue(spark, families: Iterable[str] = tuple(FAMILIES)) -> DataFrame:
    """A row for each factor: family, formula, the fields that it reads, how many rows of a ticker it looks back, whether it carries a state, and the passes that it takes."""
    rows = []
    for f in families:
        for name, e in formulas(normal_family(f)).items():
            fields = sorted({n.args[0] for n in _nodes(e) if n.op == "field"})
            far = reaches({name: e})
            rows.append((name, normal_family(f), written(e), fields, sum(far.values()), bool(unbounded({name: e})), 1 + max(stages({name: e}).values(), default=0)))
    return spark.createDataFrame(rows, "factor string, family string, formula string, fields array<string>, look_back int, carries_state boolean, passes int")


def _nodes(e) -> list[Expr]:
    return [e, *[n for a in e.args for n in _nodes(a)]] if isinstance(e, Expr) else []


def written(e) -> str:
    """An expression as text."""
    if not isinstance(e, Expr):
        return f"{e:g}" if isinstance(e, float) else str(e)
    return e.args[0] if e.op == "field" else f"{e.op}({', '.join(written(a) for a in e.args)})"


def merge_external(panel: DataFrame, factors: DataFrame, *, prefix: str, expected: Iterable[str] | None = None, whole: bool = True) -> DataFrame:
    """The panel with the columns of ``factors`` that start with ``prefix``, in place of those it has.

    Keys of ``factors`` may stand once each; with ``whole`` they must be the panel's, else rows that only the panel has get NULL. ``expected`` columns must be there.
    """
    require(factors, [*KEYS, *(expected or ())])
    columns = [c for c in factors.columns if c.startswith(prefix)]
    if not columns:
        raise ValueError(f"no column starts with {prefix!r}")
    if twice := factors.groupBy(*KEYS).count().where("count > 1").limit(5).collect():
        raise ValueError(f"repeated keys, such as {[tuple(r) for r in twice]}")
    if whole:
        for a, b, what in ((panel, factors, "keys without factors"), (factors, panel, "keys that the panel lacks")):
            if lone := a.select(*KEYS).join(b.select(*KEYS), KEYS, "left_anti").limit(5).collect():
                raise ValueError(f"{what}, such as {[tuple(r) for r in lone]}")
    return panel.drop(*columns).join(factors.select(*KEYS, *columns), KEYS, "left")
