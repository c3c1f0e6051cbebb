"""Choosing features and parameters by the profit of a model's signals; trials on the driver, each a Spark job."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.analytics import models
from factorloom.analytics.portfolio import turnover
from factorloom.functions import safe_div
from factorloom.sources.tables import settled


def time_splits(panel: DataFrame, folds: int) -> list[tuple[object, object, object]]:
    """``(first day of validation, last day of it, first day of all)`` of expanding splits: ``folds + 1`` blocks of dates, all before a block train."""
    blocks = panel.select("date").distinct().withColumn("block", F.ntile(folds + 1).over(Window.partitionBy(F.lit(0)).orderBy("date")))
    ends = blocks.groupBy("block").agg(F.min("date").alias("a"), F.max("date").alias("b")).orderBy("block").collect()
    if folds < 1 or len(ends) < folds + 1:
        raise ValueError(f"{len(ends)} dates are too few for {folds} folds")
    return [(r["a"], r["b"], ends[0]["a"]) for r in ends[1:]]


def profit_by_date(signals: DataFrame, cost_bps: float = 0.0) -> DataFrame:
    """``(date, gross, turnover, profit)`` of equal weights on the signals -1, 0, 1 of each date; 0 where no name is active."""
    active = F.sum((F.col("signal") != 0).cast("int")).over(Window.partitionBy("date"))
    rows = signals.withColumn("weight", F.coalesce(safe_div(F.col("signal"), active), F.lit(0.0))).withColumnRenamed("date", "period")
    gross = rows.groupBy("period").agg(F.sum(F.col("weight") * F.coalesce("next_period_return", F.lit(0.0))).alias("gross"), F.max(F.abs("weight")).alias("_any"))
    out = gross.join(turnover(rows.select("period", "ticker", "weight")), "period")
    profit = F.when(F.col("_any") > 0, F.col("gross") - F.lit(cost_bps / 1e4) * F.col("turnover")).otherwise(0.0)
    return out.select(F.col("period").alias("date"), "gross", "turnover", profit.alias("profit"))


def pooled_profit(signals: DataFrame, by: Sequence[str] = (), cost_bps: float = 0.0) -> DataFrame:
    """``profit`` of all rows as one period that opens from flat: the mean of signal x return over active rows, less costs of half the book if a last signal is active."""
    by = list(by)
    per = signals.groupBy(*by, "ticker").agg(
        F.sum(F.col("signal") * F.coalesce("next_period_return", F.lit(0.0))).alias("s"), F.sum((F.col("signal") != 0).cast("int")).alias("n"), (F.max_by("signal", "date") != 0).alias("last")
    )
    cost = F.when(F.bool_or("last"), F.lit(cost_bps / 1e4 * 0.5)).otherwise(0.0)
    return per.groupBy(*by).agg(F.when(F.sum("n") > 0, F.sum("s") / F.sum("n") - cost).otherwise(0.0).alias("profit"))


def permuted(rows: DataFrame, column: str, seed: int) -> DataFrame:
    """The rows with one column shuffled among the tickers of each date, the same way in every run."""
    place = F.row_number().over(Window.partitionBy("date").orderBy("ticker"))
    other = F.row_number().over(Window.partitionBy("date").orderBy(F.xxhash64(F.lit(seed), F.lit(column), "ticker"), "ticker"))
    left = rows.drop(column).withColumn("_n", place)
    right = rows.select("date", column, other.alias("_n"))
    return left.join(right, ["date", "_n"]).select(*rows.columns)


def numbered(rows: DataFrame, order: Sequence, name: str) -> DataFrame:
    """``rows`` with their place from 0 in an order over all of them, as column ``name``: a range sort, then the sizes of its parts are added up; no part is ever a whole."""
    ordered = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id() % (1 << 33)))
    parts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    starts = parts.select("_part", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # one row a part
    return ordered.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_in")).drop("_part", "_in", "_start")


def shuffled(rows: DataFrame, column: str, seed: int, keys: Sequence[str] = ("date", "ticker")) -> DataFrame:
    """The rows with one column shuffled over all of them, the same way in every run: values in order of a seeded hash go to the rows in order of their keys."""
    left = numbered(rows.drop(column), list(keys), "_n")
    drawn = F.xxhash64(F.lit(seed), F.lit(column), *keys)
    right = numbered(rows.select(*keys, column).withColumn("_drawn", drawn), ["_drawn", *keys], "_n").select(column, "_n")
    return left.join(right, "_n").select(*rows.columns)


def permutation_profits(rows: DataFrame, fitted, features: Sequence[str], *, seed: int = 123, cost_bps: float = 0.0, scope: str = "all") -> list[tuple[str, float]]:
    """The pooled profit with each feature shuffled, over all rows or (``scope`` "date") within each date, from the feature that is missed most to the one missed least; one job for all."""
    if scope not in ("all", "date"):
        raise ValueError(f"no scope {scope!r}")
    shuffle = shuffled if scope == "all" else permuted
    parts = [shuffle(rows, f, seed).withColumn("cols", F.lit(f)) for f in features]
    together = parts[0]
    for p in parts[1:]:
        together = together.unionByName(p)
    found = pooled_profit(models.signals(together, fitted), ["cols"], cost_bps).collect()
    return sorted(((r["cols"], r["profit"]) for r in found), key=lambda x: (x[1], x[0]))


@dataclass(frozen=True)
class Selection:
    features: list[str]
    history: list[dict] = field(default_factory=list)


def eliminate(train: DataFrame, valid: DataFrame, features: Sequence[str], model: str = "random_forest", *, seed: int = 123, least: int = 2, steps: int | None = None, cost_bps: float = 0.0, scope: str = "all", **params) -> Selection:
    """Drops, step by step, the feature whose shuffling leaves most profit; the step of the highest profit gives the choice."""
    now, best, top, history = list(features), list(features), float("-inf"), []
    while len(now) > least and (steps is None or len(history) < steps):
        fitted = models.fit(train, now, model, **params)
        score = pooled_profit(models.signals(valid, fitted), cost_bps=cost_bps).first()["profit"]
        if score > top:
            top, best = score, list(now)
        gone = permutation_profits(valid, fitted, now, seed=seed + len(history), cost_bps=cost_bps, scope=scope)[-1][0]
        history.append({"step": len(history), "n_features": len(now), "score": score, "dropped_feature": gone})
        now.remove(gone)
    return Selection(best, history)


def drawn(space: Mapping[str, object], rng: random.Random) -> dict:
    """One point of a space: a list is a choice, a pair of ints or floats a range."""
    out = {}
    for name in sorted(space):
        s = space[name]
        if isinstance(s, tuple):
            out[name] = rng.randint(*s) if all(isinstance(v, int) for v in s) else rng.uniform(*s)
        else:
            out[name] = rng.choice(list(s))
    return out


def estimated(space: Mapping[str, object], tried: Sequence[tuple[float, dict]], rng: random.Random, *, share: float = 0.1, warm_up: int = 8, candidates: int = 24) -> dict:
    """One point of a space by a tree-structured Parzen estimator: parameter by parameter the candidate that good trials make likeliest against the others.

    The best ``share`` of the trials are the good ones. A range has a density of a bell at each trial, as wide as the distance to its neighbours, and a
    flat part for what no trial has seen; a choice has its counts, each with one more. The first ``warm_up`` points are drawn.
    """
    if len(tried) < warm_up:
        return drawn(space, rng)
    ranked = sorted(range(len(tried)), key=lambda i: (-tried[i][0], i))
    cut = max(1, round(share * len(tried)))
    good, rest = ([tried[i][1] for i in part] for part in (ranked[:cut], ranked[cut:]))
    out = {}
    for name in sorted(space):
        s = space[name]
        if not isinstance(s, tuple):
            options = list(s)
            weight = lambda points, x: (1 + sum(p[name] == x for p in points)) / (len(options) + len(points))  # noqa: E731, B023
            picks = rng.choices(options, [weight(good, x) for x in options], k=candidates)
            out[name] = max(picks, key=lambda x: weight(good, x) / weight(rest, x))
            continue
        low, high = s
        whole = all(isinstance(v, int) for v in s)
        bells_good, bells_rest = (_bells([p[name] for p in points], low, high) for points in (good, rest))
        picks = []
        for _ in range(candidates):
            at, wide = rng.choice(bells_good)
            x = rng.uniform(low, high) if wide is None else min(high, max(low, rng.gauss(at, wide)))
            picks.append(round(x) if whole else x)
        out[name] = max(picks, key=lambda x: _density(x, bells_good, low, high) / _density(x, bells_rest, low, high))
    return out


def _bells(values: Sequence[float], low: float, high: float) -> list[tuple[float, float | None]]:
    """Centres and widths; the one without a width is flat."""
    at, span = sorted(values), (high - low) or 1.0
    wide = [max(at[i] - (at[i - 1] if i else low), (at[i + 1] if i + 1 < len(at) else high) - at[i]) for i in range(len(at))]
    return [(x, min(span, max(w, span / min(100, 1 + len(at))))) for x, w in zip(at, wide, strict=True)] + [(low, None)]


def _density(x: float, bells: Sequence[tuple[float, float | None]], low: float, high: float) -> float:
    span = (high - low) or 1.0
    return sum(1 / span if w is None else math.exp(-(((x - at) / w) ** 2) / 2) / (w * math.sqrt(2 * math.pi)) for at, w in bells) / len(bells)


def tune(panel: DataFrame, features: Sequence[str], model: str, space: Mapping[str, object], *, trials: int = 20, folds: int = 3, seed: int = 42, cost_bps: float = 0.0, search: str = "tpe") -> tuple[dict, list[tuple[float, dict]]]:
    """The parameters of the highest mean profit over expanding splits, and every trial; ties go to the earlier one.

    ``search``: "tpe" learns from the trials before (``estimated``), "random" draws each by itself.
    """
    if search not in ("tpe", "random"):
        raise ValueError(f"no search {search!r}")
    rng, splits, tried = random.Random(seed), time_splits(panel, folds), []
    for _ in range(trials):
        params, profits = estimated(space, tried, rng) if search == "tpe" else drawn(space, rng), []
        for first, last, start in splits:
            fitted = models.fit(panel.where((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(first))), features, model, **params)
            rows = models.signals(panel.where(F.col("date").between(F.lit(first), F.lit(last))), fitted)
            profits.append(profit_by_date(rows, cost_bps).agg(F.coalesce(F.avg("profit"), F.lit(0.0)).alias("p")).first()["p"])
        tried.append((sum(profits) / len(profits), params))
    return max(tried, key=lambda x: x[0])[1], tried
