"""Walk-forward backtests: windows on the driver, each step a Spark job over its slice of the panel."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.analytics import models
from factorloom.analytics.evidence import daily_ic, long_factors
from factorloom.analytics.portfolio import exposures, heuristic_weights, period_returns, volatility
from factorloom.analytics.riskqp import Risk, risk_weights
from factorloom.operators.standardise import between, fill_values, filled, labels, relative_return, tradable

STEP_MONTHS = 3


@dataclass(frozen=True)
class Span:
    train_start: date
    train_end: date
    test_start: date
    test_end: date


def add_months(d: date, n: int) -> date:
    """The same day n months on, at most the month's last."""
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    for day in range(d.day, 0, -1):
        try:
            return date(y, m + 1, day)
        except ValueError:
            continue
    raise AssertionError


def spans(start: date, windows: int, train_months: int, test_months: int, gap_months: int = 0) -> Iterator[Span]:
    """Training spans that roll on by three months, each with the test span after it and the gap."""
    for i in range(windows):
        a = add_months(start, STEP_MONTHS * i)
        b = add_months(a, train_months)
        c = add_months(b, gap_months)
        yield Span(a, b, c, add_months(c, test_months))


def segments(parts: Sequence[tuple[date, int, int, int]]) -> list[Span]:
    """Spans of several segments ``(start, windows, train_months, test_months)`` one after another; a later one goes on where the tests before it end."""
    out: list[Span] = []
    for part in parts:
        out += [s for s in spans(*part) if not out or s.test_start >= out[-1].test_end]
    return out


def walk_forward(panel: DataFrame, features: Sequence[str], steps: Sequence[Span], *, model: str = "ridge", threshold: float = 0.0, cost_bps: float = 0.0, cap: float = 0.25, vol_power: float = 0.0, risk: Risk | None = None, settle=None, **params) -> dict[str, DataFrame]:
    """Weights, period returns, exposures and period ICs of a walk-forward run.

    With ``risk`` the weights are those of ``risk_weights``, from the returns of all names before each test span; ``cap`` and ``vol_power`` are then its own.

    The panel is read once for the span of all steps. In each step gaps are filled with the training slice's statistics, the model is fitted
    on it, and the test slice's tradable rows are scored; the last score of a ticker counts.
    """
    first, last = min(s.train_start for s in steps), max(s.test_end for s in steps)
    panel = labels(relative_return(between(panel, first, last)), threshold)
    if settle:
        panel = settle(panel)
    weights, finals, realised, ics = [], [], [], []
    for s in steps:
        train = panel.where((F.col("date") >= F.lit(s.train_start)) & (F.col("date") < F.lit(s.train_end)))
        test = tradable(panel.where((F.col("date") >= F.lit(s.test_start)) & (F.col("date") < F.lit(s.test_end))))
        values = fill_values(train, features)
        fitted = models.fit(filled(train, values), features, model, **params)
        scored = models.scores(filled(test, values), fitted).select("date", "ticker", "score", "next_period_return")
        scored = settle(scored) if settle else scored
        period = F.lit(s.test_start)
        final = scored.groupBy("ticker").agg(F.max_by("score", "date").alias("score")).withColumn("period", period)
        if risk is not None:
            finals.append(final)
        else:
            if vol_power:
                final = final.join(volatility(train), "ticker", "left")
            weights.append(heuristic_weights(final, cap=cap, vol_power=vol_power))
        realised.append(scored.groupBy("ticker").agg((F.product(1 + F.coalesce("next_period_return", F.lit(0.0))) - 1).alias("ret")).withColumn("period", period))
        ics.append(daily_ic(long_factors(scored, ["score"], "next_period_return")).agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic")).withColumn("period", period))

    def union(parts):
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return settle(out) if settle else out

    w = union(weights) if risk is None else by_risk(union(finals), panel, risk, settle)
    r = union(realised)
    return {"weights": w, "returns": period_returns(w, r, cost_bps), "exposures": exposures(w), "ic": union(ics)}


def by_risk(scores: DataFrame, panel: DataFrame, risk: Risk, settle=None) -> DataFrame:
    """``(period, ticker, weight)`` of one strategy's scores by the quadratic programme, against the panel's ``return_1d`` before each period."""
    returns = panel.select(F.to_date("date").alias("date"), "ticker", F.col("return_1d").alias("ret")).where("ret is not null")
    out = risk_weights(scores.select(F.lit("run").alias("strategy"), "period", "ticker", "score"), returns, risk).select("period", "ticker", "weight")
    return settle(out) if settle else out


@dataclass(frozen=True)
class Segment:
    """A part of a chained run: its rolling windows, and the model, features and other settings of ``walk_forward`` that it has for itself."""

    start: date
    windows: int
    train_months: int = 60
    test_months: int = 3
    gap_months: int = 0
    features: Sequence[str] | None = None
    settings: Mapping[str, object] = field(default_factory=dict)

    def spans(self) -> list[Span]:
        return list(spans(self.start, self.windows, self.train_months, self.test_months, self.gap_months))


def nav(returns: DataFrame, initial: float = 1.0) -> DataFrame:
    """``(period, nav)`` after each period; one row a period."""
    order = Window.partitionBy(F.lit(0)).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return returns.select("period", (F.lit(float(initial)) * F.product(1 + F.coalesce("net_return", F.lit(0.0))).over(order)).alias("nav"))


def chained(panel: DataFrame, features: Sequence[str], parts: Sequence[Segment], *, initial: float = 1.0, settle=None, **shared) -> dict[str, DataFrame]:
    """The outputs of ``walk_forward`` of each segment, with its number as ``segment``, and ``nav``, which goes from one on to the next.

    A segment opens from flat and leaves out windows whose tests begin before those of the segment before it end.  ``shared`` settings hold where it has none.
    """
    found, last = [], None
    for i, part in enumerate(parts):
        steps = [s for s in part.spans() if last is None or s.test_start >= last]
        if not steps:
            continue
        last = steps[-1].test_end
        run = walk_forward(panel, part.features or features, steps, settle=settle, **{**shared, **part.settings})
        found.append({k: v.withColumn("segment", F.lit(i)) for k, v in run.items()})
    if not found:
        raise ValueError("no segment has a window of its own")
    out = found[0]
    for run in found[1:]:
        out = {k: v.unionByName(run[k]) for k, v in out.items()}
    return out | {"nav": nav(out["returns"], initial)}


def buckets(start: date, end: date, months: int) -> list[tuple[date, date]]:
    """The first and last days of the spans of ``months`` from ``start`` on, the last one cut at ``end``."""
    if start > end:
        raise ValueError("a holdout ends before it starts")
    out, a = [], start
    while a <= end:
        b = add_months(a, months)
        out.append((a, min(b - timedelta(days=1), end)))
        a = b
    return out


def holdout(panel: DataFrame, features: Sequence[str], start: date, end: date, *, months: int = 3, model: str = "ridge", threshold: float = 0.0, cost_bps: float = 0.0, cap: float = 0.25, risk: Risk | None = None, settle=None, **params) -> dict[str, DataFrame]:
    """One model of all tradable rows before ``start``, held against the spans from ``start`` to ``end``, both days included.

    Gaps are filled with the training rows' statistics; ``risk`` is as for ``walk_forward``.  Each span has the last score of a ticker; its IC compares these with the
    return of the same row.
    """
    panel = tradable(labels(relative_return(panel), threshold))
    panel = settle(panel) if settle else panel
    day = F.to_date("date")
    train = panel.where(day < F.lit(start))
    values = fill_values(train, features)
    fitted = models.fit(filled(train, values), features, model, **params)
    period = F.lit(None).cast("date")
    for a, b in buckets(start, end, months):
        period = F.when(day.between(F.lit(a), F.lit(b)), F.lit(a)).otherwise(period)
    test = filled(panel.where(day.between(F.lit(start), F.lit(end))), values)
    scored = models.scores(test, fitted).select(period.alias("period"), "date", "ticker", "score", "next_period_return")
    scored = settle(scored) if settle else scored
    final = scored.groupBy("period", "ticker").agg(F.max_by(F.struct("score", "next_period_return"), "date").alias("last"), (F.product(1 + F.coalesce("next_period_return", F.lit(0.0))) - 1).alias("ret"))
    final = final.select("period", "ticker", "last.score", "last.next_period_return", "ret")
    w = heuristic_weights(final.select("period", "ticker", "score"), cap=cap) if risk is None else by_risk(final, panel, risk)
    w = settle(w) if settle else w
    ic = daily_ic(long_factors(final.withColumnRenamed("period", "date"), ["score"], "next_period_return")).select(F.col("date").alias("period"), "ic", "rank_ic")
    return {"weights": w, "returns": period_returns(w, final.select("period", "ticker", "ret"), cost_bps), "exposures": exposures(w), "ic": ic}
