"""Weights that trade a signal off against risk and turnover: a small quadratic programme for each period.

Covariances are estimated period by period in parallel; periods of a strategy are solved in their order, as each starts from the weights before it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.analytics.portfolio import heuristic_weights
from factorloom.operators import crosssection as cs


@dataclass(frozen=True)
class Risk:
    gross: float = 1.0
    net: float = 0.0
    cap: float = 0.25
    clip_at: float = 3.0
    mu_clip: float = 1.0
    most_names: int = 200
    look_back: int = 252
    shrink: bool = True
    ridge: float = 1e-4
    aversion: float = 5.0
    turnover: float = 0.1


def shrunk_covariance(x: np.ndarray) -> np.ndarray:
    """Ledoit and Wolf's estimate: the sample covariance drawn to a multiple of the identity by the share that minimises expected squared error."""
    x = x - x.mean(0)
    n, p = x.shape
    s = x.T @ x / n
    level = np.trace(s) / p
    spread = ((s - level * np.eye(p)) ** 2).sum() / p
    noise = ((x**2).T @ (x**2) / n - s**2).sum() / (n * p)
    share = min(noise, spread) / spread if spread > 0 else 0.0
    return (1 - share) * s + share * level * np.eye(p)


def covariance(returns: np.ndarray, shrink: bool, ridge: float) -> np.ndarray:
    """Of dates x names: gaps at their name's median (0 without any), names without variance at the median variance, the ridge on the diagonal."""
    names = returns.shape[1]
    if not len(returns):
        return np.eye(names) * max(ridge, 1e-6)
    known = np.isfinite(returns)
    fill = np.array([np.median(returns[known[:, j], j]) if known[:, j].any() else 0.0 for j in range(names)])
    x = np.where(known, returns, fill)
    cov = shrunk_covariance(x) if shrink and len(x) > 1 else np.cov(x, rowvar=False, ddof=0).reshape(names, names) if len(x) > 1 else np.full((names, names), 0.0)
    own = np.diag(cov)
    usual = np.median(own[own > 0]) if (own > 0).any() else 1e-4
    cov = (cov + cov.T) / 2
    np.fill_diagonal(cov, np.where(own > 0, own, usual) + max(ridge, 0.0))
    return cov


def solve(mu: np.ndarray, cov: np.ndarray, before: np.ndarray, risk: Risk, steps: int = 20_000, tol: float = 1e-9) -> np.ndarray | None:
    """The w that minimises ``-mu w + aversion w' cov w + turnover |w - before|^2`` with ``sum w = net``, ``sum |w| <= gross`` and ``|w_i| <= cap``.

    Longs and shorts are variables of their own, between 0 and the cap. Splitting: a linear solve with one factor for all steps, then a projection on bounds.
    None if it does not settle.
    """
    n = len(mu)
    most = min(risk.gross, n * risk.cap)
    net = min(most, max(-most, risk.net))
    q = 2 * (risk.aversion * cov + risk.turnover * np.eye(n))
    p = np.block([[q, -q], [-q, q]]) + 1e-9 * np.eye(2 * n)
    linear = -(mu + 2 * risk.turnover * before)
    c = np.concatenate([linear, -linear])
    a = np.vstack([np.eye(2 * n), np.append(np.ones(n), -np.ones(n)), np.ones(2 * n)])
    low, high = np.concatenate([np.zeros(2 * n), [net, 0.0]]), np.concatenate([np.full(2 * n, risk.cap), [net, risk.gross]])
    rho = np.full(2 * n + 2, max(0.1, np.trace(q) / n))
    rho[-2] *= 100  # the equality
    inverse = np.linalg.inv(p + 1e-6 * np.eye(2 * n) + a.T @ (rho[:, None] * a))
    x, z, y = np.zeros(2 * n), np.zeros(2 * n + 2), np.zeros(2 * n + 2)
    for _ in range(steps):
        x = inverse @ (1e-6 * x - c + a.T @ (rho * z - y))
        ax = a @ x
        new = np.clip(ax + y / rho, low, high)
        y = y + rho * (ax - new)
        done = np.abs(ax - new).max() < tol and np.abs(rho * (new - z)).max() < tol * 10
        z = new
        if done:
            break
    w = z[:n] - z[n : 2 * n]
    if np.abs(w).sum() > risk.gross + 1e-4 or abs(w.sum() - net) > 1e-4:
        return None
    return np.where(np.abs(w) > 1e-9, w, 0.0)


def risk_weights(scores: DataFrame, returns: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """``(strategy, period, ticker, weight, fallback)`` from scores ``(strategy, period, ticker, score)`` and returns ``(date, ticker, ret)``.

    A period's covariance is that of its ``most_names`` strongest names over the ``look_back`` dates before it.  Where no solution is found the period has heuristic weights
    (``fallback``).  A task holds the names and dates of one period, then the matrices of one strategy's periods.
    """
    rows = scores.where("score is not null and score <> 0").withColumn("z", cs.zscore_clip(F.col("score"), risk.clip_at, "strategy", "period")).where(F.abs("z") > 1e-12)
    strongest = Window.partitionBy("strategy", "period").orderBy(F.desc(F.abs("z")), "ticker")
    rows = rows.withColumn("_n", F.row_number().over(strongest)).where(F.col("_n") <= risk.most_names).drop("_n")
    rows = rows.withColumn("mu", cs.rank_centred(F.col("z"), risk.mu_clip, "strategy", "period"))
    # the dates of each period, one row each, then only the returns of its names
    periods = rows.select("period").distinct()
    days = returns.select("date").distinct()
    near = periods.join(F.broadcast(days), F.col("date") < F.col("period"))  # dates and periods of a calendar, not rows
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("period").orderBy(F.desc("date")))).where(F.col("_n") <= risk.look_back).select("period", "date")
    history = rows.select("strategy", "period", "ticker").join(F.broadcast(near), "period").join(returns, ["date", "ticker"]).select("strategy", "period", "date", "ticker", "ret")
    history = history.toDF("strategy_", "period_", "date", "ticker", "ret")  # so that both sides of the cogroup have columns of their own

    def estimate(names: pd.DataFrame, past: pd.DataFrame) -> pd.DataFrame:
        names = names.sort_values("ticker")
        table = past.pivot_table(index="date", columns="ticker", values="ret", aggfunc="last").reindex(columns=names["ticker"]).sort_index() if len(past) else pd.DataFrame(np.empty((0, len(names))))
        cov = covariance(table.to_numpy(float), risk.shrink, risk.ridge)
        return pd.DataFrame({"strategy": [names["strategy"].iloc[0]], "period": [names["period"].iloc[0]], "tickers": [names["ticker"].tolist()], "mu": [names["mu"].tolist()], "cov": [cov.ravel().tolist()]}) if len(names) else pd.DataFrame(columns=["strategy", "period", "tickers", "mu", "cov"])

    kinds = dict(scores.dtypes)
    keys = ["strategy", "period"]
    ready = rows.select(*keys, "ticker", "mu").groupBy(*keys).cogroup(history.groupBy("strategy_", "period_")).applyInPandas(estimate, f"strategy {kinds['strategy']}, period {kinds['period']}, tickers array<{kinds['ticker']}>, mu array<double>, cov array<double>")

    def in_order(group: pd.DataFrame) -> pd.DataFrame:
        out, before = [], {}
        for r in group.sort_values("period").itertuples(index=False):
            mu, n = np.array(r.mu, float), len(r.mu)
            w = solve(mu, np.array(r.cov, float).reshape(n, n), np.array([before.get(t, 0.0) for t in r.tickers]), risk)
            if w is not None:
                before = dict(zip(r.tickers, w.tolist(), strict=True))
            out += [(r.strategy, r.period, t, x, w is None) for t, x in zip(r.tickers, w if w is not None else [None] * n, strict=True)]
        return pd.DataFrame(out, columns=["strategy", "period", "ticker", "weight", "fallback"])

    solved = ready.groupBy("strategy").applyInPandas(in_order, f"strategy {kinds['strategy']}, period {kinds['period']}, ticker {kinds['ticker']}, weight double, fallback boolean")
    plain = heuristic_weights(scores.withColumn("_key", F.struct("strategy", "period")).select(F.col("_key").alias("period"), "ticker", "score"), gross=risk.gross, net=risk.net, cap=risk.cap, clip_at=risk.clip_at)
    plain = plain.select("period.strategy", "period.period", "ticker", F.col("weight").alias("_plain"))
    both = solved.join(plain, ["strategy", "period", "ticker"], "left")
    return both.select("strategy", "period", "ticker", F.when(F.col("fallback"), F.coalesce("_plain", F.lit(0.0))).otherwise(F.col("weight")).alias("weight"), "fallback").where("weight <> 0")
