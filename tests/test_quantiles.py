"""Quantiles of many columns against NumPy: ties, gaps, signs, sizes around the buckets."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factorloom.operators.quantiles import from_bits, ordered_bits, quantiles

AT = [0.0, 0.1, 0.5, 0.77, 1.0]


def expected(values):
    known = np.array([x for x in values if x is not None and not np.isnan(x)], float)
    return [None] * len(AT) if not len(known) else np.quantile(known, AT).tolist()


def same(got, want):
    assert (got is None) == (want is None)
    assert got is None or got == want or abs(got - want) <= 1e-12 * max(1, abs(want))


def test_many_columns_at_once(spark):
    rng = np.random.default_rng(4)
    n = 3000
    columns = {
        "normal": rng.normal(size=n), "tiny": rng.normal(size=n) * 1e-300, "huge": rng.normal(size=n) * 1e300, "constant": np.full(n, 2.5), "ties": rng.integers(-3, 4, n).astype(float),
        "close_together": 1.0 + rng.integers(0, 50, n) * 2.0**-52, "zeros": np.where(rng.random(n) < 0.5, 0.0, -0.0), "skewed": np.exp(rng.normal(size=n) * 20),
    }
    rows = [[float(v[i]) for v in columns.values()] for i in range(n)]
    for r in rows[:1000]:
        r[0] = None
    for i, r in enumerate(rows[:500]):
        r[1] = float("nan") if i % 2 else None
    frame = spark.createDataFrame([(*r, i % 100, None) for i, r in enumerate(rows)], ", ".join(f"{c} double" for c in columns) + ", whole int, empty double").repartition(5)
    names = [*columns, "whole", "empty"]
    values = {c: [r[i] for r in rows] for i, c in enumerate(columns)} | {"whole": [i % 100 for i in range(n)], "empty": [None]}
    for options in ({}, {"step": 3, "few": 0}, {"few": 10_000}):
        got = quantiles(frame, names, AT, **options)
        for c in names:
            for a, b in zip(got[c], expected(values[c]), strict=True):
                same(a, b)


def test_small_and_wrong_input(spark):
    one = spark.createDataFrame([(7.0, None)], "x double, y double")
    assert quantiles(one, ["x", "y"], [0.3]) == {"x": [7.0], "y": [None]}
    assert quantiles(one.limit(0), ["x"]) == {"x": [None]}
    assert quantiles(one, []) == {}
    assert quantiles(spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),)], "x double"), ["x"], [0, 0.5, 1]) == {"x": [float("-inf"), 1.0, float("inf")]}
    with pytest.raises(ValueError):
        quantiles(one, ["x"], [1.5])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=30))
def test_bits_keep_the_order(values):
    x = np.array(values)
    key = ordered_bits(x)
    assert np.array_equal(from_bits(key), x)
    assert np.array_equal(np.sort(x), x[np.argsort(key, kind="stable")])
