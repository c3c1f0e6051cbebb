"""From raw daily tables to the canonical panel, and from the panel to model inputs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions import flag, safe_div
from factorloom.operators.timeseries import TickerWindow

KEYS = ["date", "ticker"]
PRICES = ("open", "high", "low", "close", "vwap")
#: Columns that are never features; fixed values.
RESERVED = frozenset("date ticker open high low close pre_close change pct_chg vol amount volume vwap open_adj high_adj low_adj close_adj vwap_adj adj_factor return_1d next_period_return benchmark_open benchmark_close benchmark_high benchmark_low benchmark_return benchmark_next_period_return benchmark_cum_ret up_limit down_limit hit_up_limit hit_down_limit is_suspended is_st is_tradable tradeable name industry list_date rel_return pred_rel_return label".split())
TICK = 1e-6


def keyed(frame: DataFrame, date: str = "date", ticker: str = "ticker") -> DataFrame:
    """Key columns named date and ticker; also from ``tradetime``/``securityid``."""
    for new, names in (("date", (date, "tradetime", "trade_date")), ("ticker", (ticker, "securityid", "ts_code"))):
        old = next((n for n in names if n in frame.columns), None)
        if old is None:
            raise ValueError(f"no {new} column among {frame.columns}")
        frame = frame.withColumnRenamed(old, new)
    return frame


def daily_bars(raw: DataFrame) -> DataFrame:
    """Vendor bars: ``volume`` in shares, ``vwap`` from thousands of currency; dates from yyyyMMdd."""
    if missing := {"ts_code", "trade_date", "open", "high", "low", "close", "vol", "amount"} - set(raw.columns):
        raise ValueError(f"daily bars lack {sorted(missing)}")
    out = raw.withColumn("date", F.try_to_timestamp("trade_date", F.lit("yyyyMMdd"))).withColumnRenamed("ts_code", "ticker").drop("trade_date")
    out = out.withColumn("volume", F.col("vol") * 100)
    return out.withColumn("vwap", safe_div(F.col("amount") * 1000, F.col("volume")))


def adjusted_prices(panel: DataFrame) -> DataFrame:
    return panel.withColumns({f"{c}_adj": F.col(c) * F.col("adj_factor") for c in PRICES if c in panel.columns})


def returns(panel: DataFrame) -> DataFrame:
    """``return_1d`` over the last known close and ``next_period_return``."""
    w = TickerWindow()
    close = "close_adj" if "close_adj" in panel.columns else "close"
    out = panel.withColumn("_last", w.forward_fill(F.col(close)))
    out = out.withColumn("return_1d", w.pct_change(F.col("_last"))).drop("_last")
    return out.withColumn("next_period_return", w.lead(F.col("return_1d"), 1))


def limit_flags(panel: DataFrame) -> DataFrame:
    return panel.withColumns({"hit_up_limit": flag(F.col("close") >= F.col("up_limit") - TICK), "hit_down_limit": flag(F.col("close") <= F.col("down_limit") + TICK)})


def keep_last(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in an explicit order."""
    w = Window.partitionBy(*by).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def suspended(panel: DataFrame, halts: DataFrame) -> DataFrame:
    marks = halts.select(*KEYS).distinct().withColumn("_halt", F.lit(True))
    return panel.join(marks, KEYS, "left").withColumn("is_suspended", F.coalesce("_halt", F.lit(False))).drop("_halt")


def basics(panel: DataFrame, stocks: DataFrame) -> DataFrame:
    """Names, industries, ``is_st`` from the latest name, ``listed_days``."""
    out = panel.join(stocks, "ticker", "left")
    return out.withColumns({"is_st": flag(F.upper("name").contains("ST")), "listed_days": F.datediff("date", "list_date")})


def complete_calendar(panel: DataFrame) -> DataFrame:
    """Every date for every ticker; a bar without close is suspended. Both lists are distinct keys, not rows."""
    grid = panel.select("date").distinct().crossJoin(panel.select("ticker").distinct())
    out = grid.join(panel, KEYS, "left")
    known = F.col("is_suspended") if "is_suspended" in panel.columns else F.lit(False)
    return out.withColumn("is_suspended", F.coalesce(known, F.lit(False)) | F.col("close").isNull())


def benchmark_series(raw: DataFrame) -> DataFrame:
    """One row a date: return, next return and cumulative growth, the first return counted as 0."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    out = raw.withColumn("benchmark_return", safe_div(F.col("benchmark_close"), F.lag("benchmark_close").over(w)) - 1)
    return out.withColumns({
        "benchmark_next_period_return": F.lead("benchmark_return").over(w),
        "benchmark_cum_ret": F.product(1 + F.coalesce("benchmark_return", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })


def standard_panel(daily: DataFrame, *, factors: DataFrame | None = None, adjustment: DataFrame | None = None, limits: DataFrame | None = None, halts: DataFrame | None = None, stocks: DataFrame | None = None, benchmark: DataFrame | None = None, tickers: Sequence[str] | None = None, complete: bool = True) -> DataFrame:
    """The canonical panel from vendor tables: bars, adjusted prices, limit and suspend flags, stock names, every date for every ticker, returns, benchmark.

    Tables on ``(date, ticker)`` are joined to the bars; what isn't given is left out.  A panel without bars is an error.
    """
    panel = daily_bars(daily)
    if tickers is not None:
        panel = panel.where(F.col("ticker").isin(*tickers))
    if panel.isEmpty():
        raise ValueError("there are no daily bars")
    for table in (factors, adjustment, limits):
        if table is not None:
            panel = panel.join(table, KEYS, "left")
    if adjustment is not None:
        panel = adjusted_prices(panel)
    if limits is not None:
        panel = limit_flags(panel)
    if halts is not None:
        panel = suspended(panel, halts)
    if complete:
        panel = complete_calendar(panel)
    if stocks is not None:
        panel = basics(panel, stocks)
    panel = returns(panel)
    return panel if benchmark is None else panel.join(F.broadcast(benchmark_series(benchmark)), "date", "left")  # a row a date


#: Columns that a market's panel must have, by where labels come from.
LABELS = {"actual": ("benchmark_next_period_return",), "pred_rel_return": ("pred_rel_return",)}


def market_panel(panel: DataFrame, *, label_source: str = "actual", benchmark_return: str = "benchmark_next_period_return", benchmark_growth: str = "benchmark_cum_ret", filters: Sequence[str] = ()) -> DataFrame:
    """The panel with benchmark columns under their own names; an error names columns that labels, returns or tradability ``filters`` need and it lacks."""
    if label_source not in LABELS:
        raise ValueError(f"no label source {label_source!r}; there are {sorted(LABELS)}")
    for name, own in (("benchmark_next_period_return", benchmark_return), ("benchmark_cum_ret", benchmark_growth)):
        if name not in panel.columns and own in panel.columns:
            panel = panel.withColumn(name, F.col(own))
    if absent := sorted({"next_period_return", "benchmark_cum_ret", *LABELS[label_source], *filters} - set(panel.columns)):
        raise ValueError(f"the panel lacks {absent}")
    return panel


def tradable(panel: DataFrame, *, suspend: bool = True, st: bool = True, up_limit: bool = True, down_limit: bool = True) -> DataFrame:
    for c in ("is_tradable", "tradeable"):
        if c in panel.columns:
            panel = panel.where(F.coalesce(F.col(c), F.lit(False)))
            break
    for on, c in ((suspend, "is_suspended"), (st, "is_st"), (up_limit, "hit_up_limit"), (down_limit, "hit_down_limit")):
        if on and c in panel.columns:
            panel = panel.where(~F.coalesce(F.col(c), F.lit(False)))
    return panel


def feature_columns(panel: DataFrame) -> list[str]:
    """Numeric and boolean columns that aren't reserved."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    return [n for n, t in panel.dtypes if n not in RESERVED and (t in numeric or t.startswith("decimal"))]


def select_factors(columns: Iterable[str], include: Sequence[str] = (), exclude: Sequence[str] = (), drop: Sequence[str] = ()) -> list[str]:
    """Columns by prefix; a prefix that none has is an error."""
    clean = lambda p: p.strip().lower().replace("-", "_")
    columns = list(columns)
    for p in [*include, *exclude]:
        if not any(c.startswith(clean(p)) for c in columns):
            raise ValueError(f"no column starts with {p!r}")
    kept = [c for c in columns if not include or any(c.startswith(clean(p)) for p in include)]
    return [c for c in kept if not any(c.startswith(clean(p)) for p in exclude) and c not in set(drop)]


def without_infinities(panel: DataFrame, columns: Iterable[str]) -> DataFrame:
    return panel.withColumns({c: F.when(F.abs(F.col(c)) != float("inf"), F.col(c)) for c in columns})


def forward_filled(panel: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Features only: targets and state flags keep their gaps."""
    w = TickerWindow()
    return panel.withColumns({c: w.forward_fill(F.col(c)) for c in columns if c not in RESERVED})


def fill_values(reference: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Medians (numbers), false (flags) and "missing" (text), from the reference rows alone."""
    kinds = dict(reference.dtypes)
    numbers = [c for c in columns if kinds[c] not in ("boolean", "string")]
    from factorloom.operators.quantiles import quantiles

    from factorloom.sources.tables import settled

    medians = quantiles(settled(reference.select(*numbers)), numbers) if numbers else {}  # read several times
    return {c: (medians[c][0] if c in numbers else False if kinds[c] == "boolean" else "missing") for c in columns}


def filled(panel: DataFrame, values: Mapping[str, object], mark: Iterable[str] = ()) -> DataFrame:
    """Gaps filled; for columns in ``mark`` also ``<name>__is_missing``."""
    marks = {f"{c}__is_missing": F.col(c).isNull().cast("tinyint") for c in mark}
    return panel.withColumns(marks | {c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items() if v is not None})


def relative_return(panel: DataFrame) -> DataFrame:
    value = F.col("pred_rel_return") if "pred_rel_return" in panel.columns else F.col("next_period_return") - F.col("benchmark_next_period_return")
    return panel.withColumn("rel_return", value)


def labels(panel: DataFrame, threshold: float) -> DataFrame:
    """1, 0, -1; a missing relative return is 0."""
    r = F.col("rel_return")
    return panel.withColumn("label", F.when(r > threshold, 1).when(r < -threshold, -1).otherwise(0).cast("tinyint"))


def feature_lag(panel: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """Features of k bars ago; rows without any are dropped."""
    w = TickerWindow()
    out = panel.withColumns({c: w.delay(F.col(c), k) for c in columns}) if k else panel
    return out.where(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()) if columns else out


def preprocess(panel: DataFrame, threshold: float, *, reference: DataFrame | None = None, profile: Mapping[str, object] | None = None) -> DataFrame:
    """Market profile (options of ``market_panel``), infinities, forward fill, fill from reference rows, relative return and label."""
    if profile is not None:
        panel = market_panel(panel, **profile)
    names = feature_columns(panel)
    numbers = [c for c in names if dict(panel.dtypes)[c] in ("float", "double")]
    out = forward_filled(without_infinities(panel, numbers), names)
    if reference is not None:
        out = filled(out, fill_values(reference, names))
    return labels(relative_return(out), threshold)


def missing_features(panel: DataFrame, wanted: Sequence[str], policy: str = "error") -> DataFrame:
    """Absent features: an error, or zeros (with a warning for ``warn_fill_zero``)."""
    absent = [c for c in wanted if c not in panel.columns]
    if absent and policy == "error":
        raise ValueError(f"features are missing: {absent}")
    if policy not in ("error", "warn_fill_zero", "fill_zero"):
        raise ValueError(f"no policy {policy!r}")
    if absent and policy == "warn_fill_zero":
        import warnings

        warnings.warn(f"features filled with 0: {absent}", stacklevel=2)
    return panel.withColumns({c: F.lit(0.0) for c in absent}) if absent else panel


def between(panel: DataFrame, start=None, end=None) -> DataFrame:
    """Dates from start to end, both included; the predicate reaches the scan."""
    if start is not None:
        panel = panel.where(F.col("date") >= F.lit(start))
    if end is not None:
        panel = panel.where(F.col("date") <= F.lit(end))
    return panel


def as_of(left: DataFrame, right: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Each left row with the last right value at or before its date: union and one window, no range join.

    Without ``by`` both are in one task, so the left table may then have one row a date at most, as calendars and benchmarks do.
    """
    if not by and left.groupBy("date").count().where("count > 1").limit(1).count():
        raise ValueError("an as-of join of several rows a date needs a key")
    rows = left.withColumns({"_v": F.lit(None).cast(dict(right.dtypes)[value]), "_left": F.lit(1)})
    marks = right.select("date", *by, F.col(value).alias("_v"), F.lit(0).alias("_left"))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("date", "_left").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return both.where("_left = 1").drop("_v", "_left")
