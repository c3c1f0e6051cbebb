"""The quadratic programme against a search over a grid and its optimality conditions; periods in order over Spark."""

from datetime import date, timedelta

import numpy as np
import pandas as pd

from factorloom.analytics.riskqp import Risk, covariance, risk_weights, shrunk_covariance, solve


def worth(w, mu, cov, before, r):
    return -mu @ w + r.aversion * w @ cov @ w + r.turnover * ((w - before) ** 2).sum()


def test_solution_is_the_best_of_a_grid():
    rng = np.random.default_rng(1)
    for case in range(8):
        x = rng.normal(size=(30, 3)) * 0.3
        cov, mu, before = np.cov(x, rowvar=False), rng.normal(size=3), rng.normal(size=3) * 0.1
        r = Risk(gross=0.8, net=(0.0, 0.3)[case % 2], cap=0.4, aversion=1.5, turnover=0.2)
        w = solve(mu, cov, before, r)
        assert abs(w.sum() - r.net) < 1e-6 and np.abs(w).sum() <= 0.8 + 1e-6 and np.abs(w).max() <= 0.4 + 1e-6
        grid = np.linspace(-0.4, 0.4, 161)
        a, b = np.meshgrid(grid, grid)
        points = np.stack([a.ravel(), b.ravel(), r.net - a.ravel() - b.ravel()], 1)
        points = points[(np.abs(points).max(1) <= 0.4 + 1e-12) & (np.abs(points).sum(1) <= 0.8 + 1e-12)]
        best = min(worth(p, mu, cov, before, r) for p in points)
        assert worth(w, mu, cov, before, r) <= best + 1e-6


def test_covariances():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4)) @ np.diag([1, 2, 0.5, 1.0])
    assert np.allclose(shrunk_covariance(x), np.cov(x, rowvar=False, ddof=0), atol=0.15)
    few = shrunk_covariance(rng.normal(size=(5, 40)))
    assert np.linalg.eigvalsh(few).min() > 0  # of full rank, where the sample's is 4
    gaps = np.array([[0.1, np.nan], [0.2, np.nan], [0.3, np.nan]])
    assert covariance(gaps, False, 0.0)[1, 1] > 0
    assert np.allclose(covariance(np.empty((0, 2)), True, 0.5), np.eye(2) * 0.5)


def test_periods_follow_each_other(spark):
    rng = np.random.default_rng(3)
    tickers = [f"t{i}" for i in range(12)]
    days = [date(2023, 1, 2) + timedelta(days=i) for i in range(60)]
    returns = spark.createDataFrame([(d, t, float(rng.normal() * 0.02)) for d in days for t in tickers], "date date, ticker string, ret double")
    periods = [days[30], days[40], days[50]]
    scores = spark.createDataFrame([("s", p, t, float(rng.normal())) for p in periods for t in tickers], "strategy string, period date, ticker string, score double")
    loose, tight = Risk(cap=0.2, turnover=0.0), Risk(cap=0.2, turnover=50.0)
    moved = {}
    for name, r in (("loose", loose), ("tight", tight)):
        w = risk_weights(scores, returns, r).toPandas()
        assert not w["fallback"].any()
        wide = w.pivot(index="period", columns="ticker", values="weight").reindex(columns=tickers).fillna(0.0)
        assert np.allclose(wide.sum(axis=1), 0, atol=1e-5) and (wide.abs().sum(axis=1) <= 1 + 1e-5).all() and (wide.abs().max(axis=1) <= 0.2 + 1e-6).all()
        moved[name] = wide.diff().abs().sum(axis=1).iloc[1:].sum()
    assert moved["tight"] < 0.3 * moved["loose"]
    # one period against plain numpy: z-scores, ranks, covariance of the dates before it, solution
    frame = scores.toPandas()
    one = frame[frame["period"] == periods[0]].sort_values("ticker")
    mu = 2 * (one["score"].rank(pct=True).to_numpy() - 0.5)
    past = returns.toPandas().pivot(index="date", columns="ticker", values="ret").reindex(columns=sorted(tickers))
    past = past[[d < periods[0] for d in past.index]]
    want = solve(mu, covariance(past.to_numpy(), True, loose.ridge), np.zeros(12), loose)
    got = risk_weights(scores.where(f"period = date'{periods[0]}'"), returns, loose).toPandas().set_index("ticker")["weight"].reindex(sorted(tickers)).fillna(0.0)
    assert np.allclose(got, want, atol=1e-6)
    assert isinstance(got, pd.Series)
