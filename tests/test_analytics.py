"""Evidence, portfolios, performance: closed forms and brute force."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factorloom.analytics import evidence as ev
from factorloom.analytics import performance as perf
from factorloom.analytics import portfolio as pf
from factorloom.analytics import quality as qa

D = [datetime(2024, 1, 1) + timedelta(days=i) for i in range(400)]


def cross_section(spark, x, y):
    rows = [(D[0], f"t{i}", "f", b, a) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "date timestamp, ticker string, factor string, y double, x double")


@pytest.mark.parametrize(("y", "rank_ic"), [([1.0, 2.0, 3.0, 10.0], 1.0), ([1.0, 3.0, 4.0, 2.0], 1.0)])
def test_ic_of_complete_pairs(spark, y, rank_ic):
    r = ev.daily_ic(cross_section(spark, [1.0, 2.0, 3.0, None], y)).first()
    assert abs(r["rank_ic"] - rank_ic) < 1e-12 and r["n_obs"] == 3 and r["coverage"] == 0.75
    assert ev.daily_ic(cross_section(spark, [1.0, 1.0], [1.0, 2.0])).first()["ic"] is None


def hac(spark, values, horizon):
    return ev.hac_mean(spark.createDataFrame([("f", D[i], v) for i, v in enumerate(values)], "factor string, date timestamp, value double"), horizon).first()


def test_hac_closed_forms(spark):
    r = hac(spark, [-1.0, 1.0, -1.0, 1.0], 2)
    assert r["mean"] == 0 and abs(r["standard_error"] - 0.25) < 1e-12 and r["lags"] == 1 and abs(r["p_value"] - 1) < 1e-12
    assert abs(hac(spark, [-1.0, None, 1.0][::-1], 2)["standard_error"] - 2**-0.5) < 1e-12
    short = hac(spark, [0.1], 2)
    assert (short["status"], short["reason"]) == ("not_provided", "insufficient_valid_observations")
    with pytest.raises(ValueError):
        hac(spark, [0.1], 0)


def test_normal_tail(spark):
    zs = [0.0, 0.5, 1.0, 1.96, 2.9, 3.1, 5.0, 9.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(ev.normal_tail(F.col("z")).alias("p")).collect()
    for z, r in zip(zs, got):
        assert abs(r["p"] - math.erfc(z / 2**0.5)) <= 1e-12 * max(1e-3, r["p"]) + 1e-14


def test_q_values(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "factor string, p_value double")
    got = {r["factor"]: r for r in ev.q_values(rows).collect()}
    assert abs(got["a"]["q_bh"] - 0.04) < 1e-12 and abs(got["b"]["q_bh"] - 0.16 / 3) < 1e-12
    assert abs(got["a"]["q_by"] - 0.04 * 25 / 12) < 1e-12 and got["d"]["q_bh"] is None


def test_q_values_of_many_tests(spark):
    """Ties, gaps and several parts against the plain loop; it took the square of the tests before."""
    import time

    n = 120_000
    ps = [None if i % 17 == 0 else ((i * 7919) % 1000 + 1) / 1000.0 for i in range(n)]
    began = time.time()
    got = {r["factor"]: r for r in ev.q_values(spark.createDataFrame([(f"f{i}", p) for i, p in enumerate(ps)], "factor string, p_value double")).collect()}
    assert time.time() - began < 60 and len(got) == n
    h, low = math.fsum(1 / k for k in range(1, n + 1)), math.inf
    order = sorted((p, f"f{i}") for i, p in enumerate(ps) if p is not None)
    for i in range(len(order), 0, -1):
        p, f = order[i - 1]
        low = min(low, p * n / i)
        assert abs(got[f]["q_bh"] - min(1, low)) < 1e-12 and abs(got[f]["q_by"] - min(1, low * h)) < 1e-11
    assert all(got[f"f{i}"]["q_bh"] is None for i, p in enumerate(ps) if p is None)


def test_groups(spark):
    rows = cross_section(spark, list(map(float, range(10))), [i / 100 for i in range(10)])
    for rule in ("store", "panel"):
        got = {r["group"]: r["n"] for r in ev.grouped(rows, 5, rule).groupBy("group").agg(F.count("*").alias("n")).collect()}
        assert got == dict.fromkeys(range(1, 6), 2)
    with pytest.raises(ValueError):
        ev.grouped(rows, 5, "other")


def test_regimes(spark):
    rows = spark.createDataFrame([(D[i], -0.5 if i == 252 else 0.001) for i in range(255)], "date timestamp, benchmark_return double")
    got = [r["regime"] for r in ev.regimes(ev.checked_benchmark(rows)).orderBy("date").collect()]
    assert got == ["bull", "bear", "bear"]
    with pytest.raises(ValueError):
        ev.checked_benchmark(rows.union(rows.limit(1).withColumn("benchmark_return", F.lit(0.5))))


def test_capped_weights_against_the_loop(spark):
    import random

    rng = random.Random(1)
    rows, want = [], {}
    for p in range(40):
        sizes = [rng.random() ** 3 + 1e-3 for _ in range(rng.randrange(2, 9))]
        total, cap, fixed = 0.5, 0.25, set()
        while True:  # share out what is above the cap until nothing is
            free = [i for i in range(len(sizes)) if i not in fixed]
            rest = total - cap * len(fixed)
            share = {i: rest * sizes[i] / sum(sizes[j] for j in free) for i in free} if free else {}
            over = {i for i, v in share.items() if v > cap + 1e-15}
            if not over:
                break
            fixed |= over
        for i, s in enumerate(sizes):
            rows.append((p, f"t{i}", 1, s, total))
            want[p, f"t{i}"] = cap if i in fixed else share[i]
    df = spark.createDataFrame(rows, "period int, ticker string, side int, size double, total double")
    for r in pf.capped(df, "total", 0.25, ["period", "side"]).collect():
        assert abs(r["weight"] - want[r["period"], r["ticker"]]) < 1e-12


def test_capped_weights_of_many_names(spark):
    """40,000 names in one period: the sum of all smaller ones is running, not taken anew for each name."""
    import time

    rows = spark.range(40_000).select(F.lit(1).alias("period"), "id", F.col("id").alias("ticker"), (1 + F.col("id") % 1000 / 10).alias("size"), F.lit(0.5).alias("total"))
    began = time.time()
    r = pf.capped(rows, "total", 0.00002, ["period"]).agg(F.sum("weight"), F.max("weight"), F.min("weight")).first()
    assert time.time() - began < 20
    assert abs(r[0] - 0.5) < 1e-9 and r[1] == 0.00002 and 0 < r[2] < 0.00001


def test_weights_and_turnover(spark):
    scores = spark.createDataFrame([(1, f"t{i}", float(v)) for i, v in enumerate([3, 2, 1, -1, -2, -4])], "period int, ticker string, score double")
    w = pf.heuristic_weights(scores)
    e = pf.exposures(w).first()
    assert abs(e["gross"] - 1) < 1e-9 and abs(e["net"]) < 1e-9 and e["largest"] <= 0.25 + 1e-12
    two = spark.createDataFrame([(1, "a", 0.5), (1, "b", -0.5), (2, "b", 0.5), (2, "c", -0.5), (3, "b", 0.5), (3, "c", -0.5)], "period int, ticker string, weight double")
    assert [r["turnover"] for r in pf.turnover(two).orderBy("period").collect()] == [0.5, 1.0, 0.0]


def test_performance(spark):
    import statistics

    ret = [0.01, -0.02, 0.03, 0.00, -0.01, 0.04]
    m = perf.metrics(spark.createDataFrame([("s", D[i], r) for i, r in enumerate(ret)], "series string, date timestamp, ret double")).first()
    total = math.prod(1 + r for r in ret) - 1
    assert abs(m["total_return"] - total) < 1e-12 and abs(m["std"] - statistics.stdev(ret)) < 1e-12
    assert abs(m["sharpe"] - statistics.mean(ret) * 12**0.5 / statistics.stdev(ret)) < 1e-9
    import pandas as pd

    assert abs(m["skew"] - pd.Series(ret).skew()) < 1e-9 and abs(m["kurtosis"] - pd.Series(ret).kurt()) < 1e-9


def test_quality(spark):
    rows = spark.createDataFrame([(D[0], "a", 1.0, 2.0, 1.0, 1.0, 5.0), (D[0], "a", 1.0, 0.5, 1.0, -1.0, -5.0)], "date timestamp, ticker string, open double, high double, low double, close double, volume double")
    r = qa.sanity_report(rows).first()
    assert (r["duplicate_keys"], r["non_positive_prices"], r["negative_volume"], r["high_below_low"]) == (1, 1, 1, 1)
    q = qa.factor_quality(spark.createDataFrame([(float("nan"), 1.0), (float("inf"), 1.0), (None, 1.0), (2.0, 1.0)], "f double, g double"), ["f", "g"]).orderBy("factor").collect()
    assert (q[0]["nans"], q[0]["infinities"], q[0]["nulls"], q[0]["finite"], q[1]["constant"]) == (1, 1, 1, 1, True)
    with pytest.raises(ValueError):
        qa.enforce(False, "bad", "error")
