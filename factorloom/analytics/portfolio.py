"""Weights from scores, period by period; every step is a window or an aggregation over (period, ticker)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions import clip, safe_div
from factorloom.operators import crosssection as cs
from factorloom.operators.quantiles import quantiles
from factorloom.sources.tables import settled


def top_by_score(scores: DataFrame, k: int, by: str = "period") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(F.abs("score")), "ticker")
    return scores.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def last_by_ticker(rows: DataFrame, value: str, by: str = "period") -> DataFrame:
    return rows.groupBy(by, "ticker").agg(F.max_by(value, "date").alias(value))


def capped(rows: DataFrame, total: str, cap: float, by: list[str]) -> DataFrame:
    """``weight`` proportional to ``size``, adding up to the column ``total``, none above ``cap``.

    Sharing out what is above the cap until nothing is ends with the largest k at the cap and the rest in proportion; a suffix sum
    in order of size finds that k. If even all at the cap fall short, all are at the cap.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("size"), "ticker")
    back = Window.partitionBy(*by).orderBy("size", F.desc("ticker"))  # a frame to the last row would be summed anew for each row
    rows = rows.withColumns({"_k": F.row_number().over(order) - 1, "_left": F.sum("size").over(back.rowsBetween(Window.unboundedPreceding, 0))})
    share = safe_div((F.col(total) - F.col("_k") * cap) * F.col("size"), F.col("_left"))
    free = F.when(share <= cap + 1e-15, F.struct("_k", "_left"))
    first = F.min(free).over(Window.partitionBy(*by))
    scaled = safe_div((F.col(total) - first["_k"] * cap) * F.col("size"), first["_left"])
    weight = F.when(first.isNull() | (F.col("_k") < first["_k"]), F.lit(cap)).otherwise(scaled)
    return rows.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(0.0)).drop("_k", "_left")


def volatility(train: DataFrame, *, least: int = 8, last_resort: float = 0.20) -> DataFrame:
    """Population deviation of returns by ticker; tickers with fewer than ``least`` take the median."""
    per = settled(train.groupBy("ticker").agg(F.when(F.count("return_1d") >= least, F.stddev_pop("return_1d")).alias("vol")))
    median = quantiles(per, ["vol"])["vol"][0]
    return per.select("ticker", F.coalesce("vol", F.lit(last_resort if median is None else median)).alias("vol"))


def heuristic_weights(scores: DataFrame, *, gross: float = 1.0, net: float = 0.0, cap: float = 0.25, clip_at: float = 3.0, vol_power: float = 0.0, min_score: float = 0.0, min_names: int = 1, sector: str | None = None) -> DataFrame:
    """``(period, ticker, weight)`` from ``(period, ticker, score[, vol][, sector])``.

    Scores pass a gate, are standardised and clipped, scaled by ``vol ** -vol_power``, optionally freed of their sector's mean, and
    split into sides with budgets ``(gross +- net) / 2``, each capped by name.  A side of fewer than ``min_names`` has no weights, and its budget goes
    to the other.
    """
    rows = scores.where(F.col("score").isNotNull() & (F.abs("score") >= min_score))
    rows = rows.withColumn("z", cs.zscore_clip(F.col("score"), clip_at, "period"))
    if vol_power and "vol" in rows.columns:
        rows = rows.withColumn("z", safe_div(F.col("z"), F.pow("vol", F.lit(float(vol_power)))))
    if sector:
        rows = rows.withColumn("z", cs.demean(F.col("z"), "period", sector))
    rows = rows.withColumns({"side": F.signum("z").cast("int"), "size": F.abs("z")}).where("side <> 0")
    gross = max(0.0, gross)
    net = min(gross, max(-gross, net))
    names = F.count(F.lit(1)).over(Window.partitionBy("period", "side"))
    rows = rows.withColumn("_names", names).where(F.col("_names") >= min_names).drop("_names")
    every = Window.partitionBy("period")
    alone = F.min("side").over(every) == F.max("side").over(every)
    rows = rows.withColumn("budget", F.when(alone, F.lit(gross)).when(F.col("side") > 0, F.lit((gross + net) / 2)).otherwise(F.lit((gross - net) / 2)))
    rows = capped(rows, "budget", cap, ["period", "side"])
    return rows.select("period", "ticker", (F.col("side") * F.col("weight")).alias("weight"))


def turnover(weights: DataFrame) -> DataFrame:
    """One-way turnover of each period against the one before: half of all changes, absent names at 0."""
    periods = weights.select("period").distinct().withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("period")))
    now = weights.join(periods, "period").select("_i", "ticker", "weight")
    before = now.select((F.col("_i") + 1).alias("_i"), "ticker", F.col("weight").alias("was"))
    both = now.join(before, ["_i", "ticker"], "full_outer")
    change = both.groupBy("_i").agg((F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))) / 2).alias("turnover"))
    return periods.join(change, "_i", "left").select("period", F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def period_returns(weights: DataFrame, realised: DataFrame, cost_bps: float = 0.0) -> DataFrame:
    """Sum of weight x return, less costs of turnover."""
    gross = weights.join(realised, ["period", "ticker"], "left").groupBy("period").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("gross_return"))
    out = gross.join(turnover(weights), "period")
    return out.withColumn("net_return", F.col("gross_return") - F.lit(cost_bps / 1e4) * F.col("turnover"))


def exposures(weights: DataFrame) -> DataFrame:
    w = F.col("weight")
    return weights.groupBy("period").agg(F.sum(F.abs(w)).alias("gross"), F.sum(w).alias("net"), F.max(F.abs(w)).alias("largest"), F.sum((w > 0).cast("int")).cast("long").alias("longs"), F.sum((w < 0).cast("int")).cast("long").alias("shorts"))


def signal_score(up, down):
    return up - down


def rank_mu(x, limit: float):
    return clip(2 * (cs.rank(x, "period") - 0.5), -limit, limit)
