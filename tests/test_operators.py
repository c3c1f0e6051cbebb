"""Operators against independent formulations in plain Python and pandas, and closed-form cases."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions import ieee_div, safe_div, to_float
from factorloom.operators import crosssection as cs
from factorloom.operators.timeseries import TickerWindow


def panel(spark, columns, tickers=("A", "B", "C")):
    """Columns: name -> per-ticker lists."""
    rows = []
    for t in tickers:
        n = len(next(iter(columns.values()))[t])
        for i in range(n):
            rows.append((datetime(2024, 1, 1) + timedelta(days=i), t, *[None if columns[k][t][i] is None else float(columns[k][t][i]) for k in columns]))
    return spark.createDataFrame(rows, "date timestamp, ticker string, " + ", ".join(f"{k} double" for k in columns))


def by_ticker(df, name):
    out = {}
    for r in df.orderBy("ticker", "date").collect():
        out.setdefault(r["ticker"], []).append(r[name])
    return out


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        if y is None or (isinstance(y, float) and math.isnan(y)):
            assert x is None, (x, y)
        else:
            assert x is not None and abs(x - y) <= 1e-9 * max(1, abs(y)), (x, y)


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(7)
    cols = {k: {t: [None if rng.random() < 0.06 else float(rng.integers(1, 30)) for _ in range(40)] for t in "ABC"} for k in ("x", "y")}
    return panel(spark, cols), cols


@pytest.mark.parametrize("name", ["sum", "mean", "std", "min", "max", "cov", "corr", "rank", "argmax", "argmin", "delay", "delta", "decay", "quantile", "forward_fill", "growth", "pct"])
def test_rolling_against_pandas(spark, noisy, name):
    df, cols = noisy
    w, n = TickerWindow(), 6
    x, y = F.col("x"), F.col("y")
    if name == "pct":
        df = df.withColumn("f", w.forward_fill(x))
    expr = {
        "sum": lambda: w.sum(x, n), "mean": lambda: w.mean(x, n, 1), "std": lambda: w.std(x, n, 2), "min": lambda: w.min(x, n), "max": lambda: w.max(x, n), "cov": lambda: w.cov(x, y, n), "corr": lambda: w.corr(x, y, n),
        "rank": lambda: w.rank(x, n), "argmax": lambda: w.argmax(x, n), "argmin": lambda: w.argmin(x, n), "delay": lambda: w.delay(x, 2), "delta": lambda: w.delta(x, 2), "decay": lambda: w.decay(x, n),
        "quantile": lambda: w.quantile(x, n, 0.8, 1), "forward_fill": lambda: w.forward_fill(x), "growth": lambda: w.cumulative_growth(x), "pct": lambda: w.pct_change(F.col("f")),
    }[name]()
    got = by_ticker(df.select("date", "ticker", expr.alias("v")), "v")
    for t in "ABC":
        a, b = pd.Series(cols["x"][t], dtype=float), pd.Series(cols["y"][t], dtype=float)
        roll = a.rolling(n)
        weights = np.arange(1, n + 1) / (n * (n + 1) / 2)
        want = {
            "sum": lambda: roll.sum(), "mean": lambda: a.rolling(n, 1).mean(), "std": lambda: a.rolling(n, 2).std(), "min": lambda: roll.min(), "max": lambda: roll.max(), "cov": lambda: roll.cov(b), "corr": lambda: roll.corr(b),
            "rank": lambda: roll.apply(lambda v: pd.Series(v).rank(pct=True).iloc[-1], raw=True), "argmax": lambda: roll.apply(lambda v: v.argmax() + 1, raw=True), "argmin": lambda: roll.apply(lambda v: v.argmin() + 1, raw=True),
            "delay": lambda: a.shift(2), "delta": lambda: a.diff(2), "decay": lambda: roll.apply(lambda v: (v * weights).sum(), raw=True), "quantile": lambda: a.rolling(n, 1).quantile(0.8), "forward_fill": lambda: a.ffill(),
            "growth": lambda: (1 + a).cumprod(), "pct": lambda: a.ffill().pct_change(),
        }[name]()
        close(got[t], want.tolist())


def test_rank_across_a_date(spark):
    df = panel(spark, {"v": {"A": [300, 100], "B": [100, 200], "C": [200, 300]}})
    got = by_ticker(df.withColumn("r", cs.rank(F.col("v"))), "r")
    close(got["A"], [1.0, 1 / 3])
    close(got["C"], [2 / 3, 1.0])
    gap = panel(spark, {"v": {"A": [5000], "B": [1000], "C": [None]}})
    assert [r["r"] for r in gap.withColumn("r", cs.rank(F.col("v"))).orderBy("ticker").collect()] == [1.0, 0.5, None]


def test_cross_section(spark):
    df = panel(spark, {"v": {"A": [1, 0], "B": [-2, 0], "C": [5, 0]}, "u": {"A": [1, 1], "B": [2, 1], "C": [4, 1]}})
    rows = df.select("date", "ticker", cs.scale(F.col("v")).alias("s"), cs.zscore_clip(F.col("v"), 1.0).alias("z"), cs.residual(F.col("v"), F.col("u")).alias("e"))
    close(by_ticker(rows, "s")["B"], [-0.25, None])
    z = (np.array([1, -2, 5]) - 4 / 3) / np.std([1, -2, 5])
    close([by_ticker(rows, "z")[t][0] for t in "ABC"], np.clip(z, -1, 1).tolist())
    assert by_ticker(rows, "z")["A"][1] == 0
    slope, base = np.polyfit([1, 2, 4], [1, -2, 5], 1)
    close([by_ticker(rows, "e")[t][0] for t in "ABC"], [v - base - slope * u for u, v in ((1, 1), (2, -2), (4, 5))])


def test_division_rules(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 1.0), (6.0, 3.0)], "a double, b double")
    got = rows.select(safe_div(F.col("a"), F.col("b")).alias("s"), ieee_div(F.col("a"), F.col("b")).alias("i")).collect()
    assert [r["s"] for r in got] == [None, None, None, None, 2.0]
    assert [r["i"] for r in got] == [math.inf, -math.inf, None, None, 2.0]
    big = spark.createDataFrame([(1e40,), (float("inf"),), (float("nan"),), (1.5,)], "x double").select(to_float(F.col("x")).alias("f"))
    assert [r["f"] for r in big.collect()] == [None, None, None, 1.5]


def test_constant_window_has_no_correlation(spark):
    df = panel(spark, {"x": {"A": [0.1] * 8}, "y": {"A": list(range(8))}}, "A")
    assert set(by_ticker(df.withColumn("v", TickerWindow().corr(F.col("x"), F.col("y"), 4)), "v")["A"]) == {None}


def test_signal_as_of(spark):
    from factorloom.operators.standardise import as_of

    days = lambda *n: [(datetime(2024, 1, i),) for i in n]
    left = spark.createDataFrame(days(1, 5, 6, 9), "date timestamp")
    right = spark.createDataFrame([(datetime(2024, 1, 5), 1.0), (datetime(2024, 1, 8), 2.0)], "date timestamp, v double")
    assert [r["v"] for r in as_of(left, right, "v").orderBy("date").collect()] == [None, 1.0, 1.0, 2.0]


def test_standardise(spark):
    from factorloom.operators import standardise as st

    raw = spark.createDataFrame([("a", "20240102", 1.0, 2.0, 1.0, 2.0, 10.0, 1.5), ("b", "20240102", 1.0, 1.0, 1.0, 1.0, 0.0, 0.0)], "ts_code string, trade_date string, open double, high double, low double, close double, vol double, amount double")
    rows = {r["ticker"]: r for r in st.daily_bars(raw).collect()}
    assert rows["a"]["volume"] == 1000 and rows["a"]["vwap"] == 1.5 and rows["b"]["vwap"] is None
    with pytest.raises(ValueError):
        st.daily_bars(raw.drop("amount"))
    labelled = st.labels(spark.createDataFrame([(0.3,), (-0.3,), (0.05,), (None,)], "rel_return double"), 0.1)
    assert [r["label"] for r in labelled.collect()] == [1, -1, 0, 0]
    train = spark.createDataFrame([(1.0, True, "x"), (3.0, False, None), (None, None, "y")], "a double, b boolean, c string")
    assert st.fill_values(train, ["a", "b", "c"]) == {"a": 2.0, "b": False, "c": "missing"}
    with pytest.raises(ValueError):
        st.missing_features(train, ["z"])
    assert st.missing_features(train, ["z"], "fill_zero").first()["z"] == 0.0
    assert st.select_factors(["alpha101_001", "alpha158_kmid"], include=["alpha101"]) == ["alpha101_001"]
    with pytest.raises(ValueError):
        st.select_factors(["alpha101_001"], include=["alpha360"])
    p = panel(spark, {"close": {"A": [1, 2, 4], "B": [1, None, 3]}}, "AB")
    got = by_ticker(st.returns(p), "return_1d")
    close(got["A"], [None, 1.0, 1.0])
    close(got["B"], [None, 0.0, 2.0])
