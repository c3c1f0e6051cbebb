"""Families: column contracts, values against a separate evaluation in pandas, plans of few shuffles."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.factors.families import FAMILIES, add_family, alpha158, alpha360, catalogue, classic_factors, expected_columns, formulas, normal_family


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(7)
    rows = []
    for j, t in enumerate("ABCDEFG"):
        price = 10.0 + j
        for i in range(70):
            price *= 1 + rng.normal(0, 0.02)
            o = price * (1 + rng.normal(0, 0.01))
            hi, lo = max(o, price) * (1 + abs(rng.normal(0, 0.01))), min(o, price) * (1 - abs(rng.normal(0, 0.01)))
            v = float(rng.integers(0, 50)) * 100
            rows.append((datetime(2023, 1, 1) + timedelta(days=i), t, o, hi, lo, price, (hi + lo + price) / 3, v, v * price, rng.random()))
    frame = pd.DataFrame(rows, columns="date ticker open high low close vwap volume amount turnover_rate".split())
    return spark.createDataFrame(frame).repartition(2).cache(), frame


def evaluate(text: str, frame: pd.DataFrame) -> pd.Series:
    """A formula by pandas, operator by operator: nothing of the Spark side is used."""
    f = frame.sort_values(["date", "ticker"]).reset_index(drop=True)
    f["volume"] = f["volume"].replace(0, 1)
    f["returns"] = f.groupby("ticker")["close"].pct_change()
    f["turnover"] = f["amount"]
    t = lambda x, g: x.groupby(f["ticker"], group_keys=False).apply(g)
    fin = lambda x: x.where(np.isfinite(x))

    class S(pd.Series):
        @property
        def _constructor(self):
            return S

        def same(self, o):
            return self == o

    def ties(x):  # values that agree to ten figures are one
        return num(x).map(lambda v: float(f"{v:.9e}") if np.isfinite(v) else v)

    num = lambda x: S(x.astype(float)) if isinstance(x, pd.Series) else x
    roll = lambda how: lambda x, n: num(t(fin(num(x)), lambda s: getattr(s.rolling(n), how)()))

    def pair(how):
        def run(x, y, n):
            x, y = fin(num(x)), fin(num(y))
            # moments from the windows themselves: pandas' own running ones lose figures
            out = pd.Series(np.nan, index=f.index)
            for k in f["ticker"].unique():
                u, v = x[f["ticker"] == k], y[f["ticker"] == k]
                for i in range(n - 1, len(u)):
                    a, b = u.iloc[i - n + 1 : i + 1].to_numpy(), v.iloc[i - n + 1 : i + 1].to_numpy()
                    if np.isfinite(a).all() and np.isfinite(b).all():
                        a, b = a - a[0], b - b[0]
                        c = ((a - a.mean()) * (b - b.mean())).sum()
                        d = np.sqrt(((a - a.mean()) ** 2).sum()) * np.sqrt(((b - b.mean()) ** 2).sum())
                        out[u.index[i]] = c / (n - 1) if how == "cov" else round(c / d, 12) if d else np.nan
            return num(out)

        return run

    arr = lambda g: lambda x, n: num(t(num(x), lambda s: s.rolling(n).apply(g, raw=True)))
    names = {k: S(f[k]) for k in ("open", "high", "low", "close", "vwap", "volume", "returns", "turnover", "turnover_rate")} | {
        "ts_sum": lambda x, n: arr(lambda v: v.sum())(fin(num(x)), n), "mean": roll("mean"), "std": roll("std"), "ts_min": roll("min"), "ts_max": roll("max"), "corr": pair("corr"), "cov": pair("cov"),
        "ts_rank": lambda x, n: arr(lambda v: ((v < v[-1]).sum() + ((v == v[-1]).sum() + 1) / 2) / len(v))(ties(x), n), "argmax": lambda x, n: arr(lambda v: v.argmax() + 1)(ties(x), n), "decay": lambda x, n: arr(lambda v: (v * np.arange(1, n + 1)).sum() * 2 / n / (n + 1))(x, n),
        "delay": lambda x, k: num(t(num(x), lambda s: s.shift(k))), "delta": lambda x, k: num(t(num(x), lambda s: s - s.shift(k))), "growth": lambda x: num(t(num(x), lambda s: (1 + s).cumprod())),
        "rank": lambda x: num(ties(x).groupby(f["date"]).rank(pct=True)), "scale": lambda x: num(num(x) / num(x).abs().groupby(f["date"]).transform("sum").replace(0, np.nan)),
        "abs": lambda x: abs(num(x)), "sign": lambda x: num(np.sign(num(x))), "log": lambda x: num(np.log(num(x))), "where": lambda c, a, b: num(pd.Series(np.where(c, a, b), index=f.index)),
        "least": lambda a, b: num(pd.concat([a, b], axis=1).min(axis=1)), "greatest": lambda a, b: num(pd.concat([a, b], axis=1).max(axis=1)),
    }
    out = num(eval(text, {"__builtins__": {}}, names))  # noqa: S307
    return pd.Series(np.asarray(out, float), index=pd.MultiIndex.from_frame(f[["date", "ticker"]]))


def test_counts():
    assert {f: len(expected_columns(f)) for f in ("alpha101", "alpha191", "alpha360")} == {"alpha101": 101, "alpha191": 191, "alpha360": 360}
    assert sum(FAMILIES.values()) == 810
    assert all(list(formulas(f)) == expected_columns(f) for f in ("alpha101", "alpha191"))
    assert normal_family("Alpha-158") == "alpha158"
    assert [c["columns"] for c in catalogue()] == [101, 191, 158, 360]
    with pytest.raises(ValueError):
        normal_family("alpha7")


@pytest.mark.parametrize("family", ["alpha101", "alpha191"])
def test_every_formula(spark, bars, family):
    """All columns of a family against pandas."""
    from factorloom.factors import formulas as texts

    table, frame = bars
    got = classic_factors(table, [family], dtype="double").toPandas().set_index(["date", "ticker"]).sort_index()
    assert got.shape == (490, FAMILIES[family])
    wrong = {}
    for line in getattr(texts, family.upper()).strip().splitlines():
        number, text = line.split(" = ", 1)
        name = f"{family}_{int(number):03d}"
        want = evaluate(text, frame).sort_index()
        have = got[name].astype(float)
        a, b = want.replace([np.inf, -np.inf], np.nan), have.replace([np.inf, -np.inf], np.nan)
        both = a.notna() & b.notna()
        gaps, off = int((a.notna() != b.notna()).sum()), int((~np.isclose(a[both], b[both], rtol=1e-6, atol=1e-7)).sum())
        if gaps or off:
            wrong[name] = (gaps, off)
    assert not wrong


def test_alpha158_and_360(spark, bars):
    table, frame = bars
    a = alpha158(table, dtype="double").toPandas().set_index(["ticker", "date"]).sort_index()
    assert a.shape == (490, 158)
    f = frame.set_index(["ticker", "date"]).sort_index()
    c = f["close"].groupby("ticker")
    want = c.rolling(20, 1).mean().droplevel(0) / f["close"] - 1
    assert np.allclose(a["alpha158_ma_20"], want)
    ret = c.pct_change()
    assert np.allclose(a["alpha158_std_10"].astype(float), ret.groupby("ticker").rolling(10, 2).std().droplevel(0), equal_nan=True)
    assert np.allclose(a["alpha158_q80_5"], c.rolling(5, 1).quantile(0.8).droplevel(0) / f["close"] - 1)
    b = alpha360(table).toPandas().set_index(["ticker", "date"]).sort_index()
    assert b.shape == (490, 360) and list(b.columns) == expected_columns("alpha360")
    assert np.allclose(b["alpha360_open_lag03"].astype(float), f["open"].groupby("ticker").shift(3) / f["close"] - 1, equal_nan=True, atol=1e-6)
    assert set(b.dtypes.astype(str)) == {"float32"}


def test_missing_inputs(spark, bars):
    table, _ = bars
    with pytest.raises(KeyError):
        alpha158(table.drop("high"))
    got = classic_factors(table.drop("vwap"), only=["alpha191_013", "alpha191_014"]).toPandas()
    assert got["alpha191_013"].isna().all() and got["alpha191_014"].notna().any()
    assert "alpha101_012" in add_family(table, "alpha101").columns


def test_few_exchanges(spark, bars):
    """Families of lags and windows deal the rows once, the classic ones once for each turn between tickers and dates."""
    table, _ = bars
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(alpha360(table)) == exchanges(alpha158(table)) == 1
    assert exchanges(classic_factors(table, ["alpha101"])) <= 10
    assert exchanges(classic_factors(table, ["alpha191"])) <= 6


def test_adjusted_prices(spark, bars):
    """Families take adjusted prices where the panel has them, unless told not to."""
    table, _ = bars
    prices = ("open", "high", "low", "close", "vwap")
    factor = F.when(F.col("ticker") < "C", 2.0).otherwise(1.0 + F.dayofyear("date") / 100)
    both = table.withColumns({f"{p}_adj": F.col(p) * factor for p in prices}).cache()
    plain = both.select("date", "ticker", *[F.col(f"{p}_adj").alias(p) for p in prices], "volume", "amount", "turnover_rate")
    rows = lambda df: df.orderBy("ticker", "date").toPandas()
    for build in (alpha158, alpha360, lambda p, **o: classic_factors(p, only=["alpha191_023", "alpha101_053", "alpha191_003"], **o)):
        pd.testing.assert_frame_equal(rows(build(both)), rows(build(plain)))
        pd.testing.assert_frame_equal(rows(build(both, adjusted=False)), rows(build(table)))


def test_windows_stay_within_tickers_whatever_the_batches(spark, bars, monkeypatch):
    from factorloom import expressions

    table, _ = bars
    rows = lambda: alpha158(table, dtype="double").orderBy("ticker", "date").toPandas()
    want = rows()
    monkeypatch.setattr(expressions, "ROWS", 50)
    pd.testing.assert_frame_equal(rows(), want)
    gaps = table.withColumn("close", F.when(F.dayofyear("date") % 3 != 0, F.col("close")))
    got = alpha158(gaps, dtype="double", only=["alpha158_ma_5"]).join(gaps.select("date", "ticker", "close"), ["date", "ticker"])
    assert got.where("close is null and alpha158_ma_5 is not null").count() == 0
    assert alpha158(table.limit(0)).count() == 0


def test_rolling_kernels_against_plain_windows():
    """Every operator over windows of any length and groups of any size, with gaps, infinities, ties and constants, against NumPy on each window."""
    import warnings

    from factorloom import kernels as k

    def plain(g, f, n, least, *columns):
        out = np.full(g.n, np.nan)
        for i in range(g.n):
            rows = [c[max(g.start[i], i - n + 1) : i + 1] for c in columns]
            known = ~np.any([np.isnan(r) for r in rows], axis=0)
            if known.sum() >= (n if least is None else least) and known.any():
                out[i] = f(*[r[known] for r in rows], *([rows[0][-1]] if f is place_in else []))
        return out

    def place_in(w, last):
        return np.nan if np.isnan(last) else ((w < last).sum() + ((w == last).sum() + 1) / 2) / len(w)

    rng = np.random.default_rng(17)
    for trial in range(14):
        sizes = rng.integers(1, 90, rng.integers(1, 5)).tolist()
        g = k.Groups(np.cumsum([0, *sizes[:-1]]), sum(sizes))
        x = rng.normal(size=g.n) * 10 ** rng.uniform(-2, 4)
        y = rng.normal(size=g.n) + x
        if trial % 3 == 0:
            x = np.round(x / np.abs(x).max() * 3)
        if trial % 4 == 0:
            x[rng.random(g.n) < 0.2] = np.nan
        if trial % 5 == 0:
            x[rng.random(g.n) < 0.1] = np.inf
        if trial == 13:
            x[:] = 0.1
        scale = max(1.0, np.abs(x[np.isfinite(x)]).max(initial=0))
        same = lambda got, want, tol=1e-9: np.testing.assert_allclose(got, want, rtol=1e-9, atol=tol * scale, equal_nan=True)  # noqa: E731, B023
        fx = k.finite(x)
        with np.errstate(all="ignore"), warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for n in (1, 2, 5, 20, 25, 49, 70):
                for least in (None, 1, 2) if n > 2 else (None,):
                    for own, f in ((k.total, np.sum), (k.mean, np.mean), (k.lowest, np.min), (k.highest, np.max)):
                        same(own(g, x, n, least), plain(g, f, n, least, fx))
                    same(k.std(g, x, n, least), plain(g, lambda w: np.std(w, ddof=1) if len(w) > 1 else np.nan, n, least, fx), 1e-7)
                    same(k.cov(g, x, y, n, least), plain(g, lambda u, v: np.cov(u, v)[0, 1] if len(u) > 1 else np.nan, n, least, fx, y), 1e-6 * scale)
                    same(k.rolling_rank(g, x, n, least), plain(g, place_in, n, least, k.level(x)))
                    same(k.quantile(g, x, n, 0.3, least), plain(g, lambda w: np.quantile(w, 0.3), n, least, fx))
                for sign, f in ((1.0, np.argmax), (-1.0, np.argmin)):
                    same(k.place_of(sign)(g, x, n), plain(g, lambda w, f=f: f(w) + 1, n, None, k.level(fx)))
                same(k.decay(g, x, n), plain(g, lambda w: np.average(w, weights=np.arange(1, len(w) + 1)), n, None, fx))
                if trial != 13 and n > 2:
                    got, want = k.corr(g, x, y, n), plain(g, lambda u, v: np.corrcoef(u, v)[0, 1], n, None, fx, y)
                    np.testing.assert_allclose(got, want, atol=1e-6, equal_nan=True)
                elif n > 1:  # constant: no deviation at all, so no correlation
                    assert trial != 13 or np.isnan(k.corr(g, x, y, n)).all() and np.nanmax(k.std(g, x, n), initial=0) == 0


def test_continued_operators_go_on_from_their_seeds():
    from factorloom import kernels as k

    g = k.Groups(np.array([0, 3]), 6)
    x = np.array([np.nan, 0.5, np.nan, np.nan, 0.1, 0.2])
    seed = np.array([7.0, 7.0, 7.0, np.nan, np.nan, np.nan])
    np.testing.assert_array_equal(k.fill(g, x, seed), [7.0, 0.5, 0.5, np.nan, 0.1, 0.2])
    np.testing.assert_allclose(k.growth(g, x, seed), [np.nan, 10.5, np.nan, np.nan, 1.1, 1.32])


def test_exports_lead_to_what_they_name():
    import factorloom

    for name in factorloom.__all__:
        assert getattr(factorloom, name) is not None and name in dir(factorloom)
    from factorloom import Store, add_family

    assert Store.__name__ == "Store" and add_family.__module__ == "factorloom.factors.families"
    with pytest.raises(AttributeError):
        factorloom.nothing  # noqa: B018


def test_catalogue_of_single_factors(spark):
    from factorloom.factors.families import factor_catalogue

    rows = {r["factor"]: r for r in factor_catalogue(spark).collect()}
    assert len(rows) == 810 and {r["family"] for r in rows.values()} == set(FAMILIES)
    one = rows["alpha191_014"]
    assert (one["formula"], one["fields"], one["look_back"], one["carries_state"], one["passes"]) == ("-(close, delay(close, 5))", ["close"], 5, False, 1)
    assert rows["alpha101_019"]["carries_state"] and rows["alpha101_019"]["passes"] == 2
    assert rows["alpha360_open_lag59"]["look_back"] == 59 and rows["alpha360_open_lag59"]["fields"] == ["close", "open"]


def test_external_factors_merge_into_a_panel(spark):
    from factorloom.factors.families import merge_external

    panel = spark.createDataFrame([("2024-01-01", "A", 1.0, 9.0), ("2024-01-01", "B", 2.0, 9.0)], "date string, ticker string, close double, own_x double")
    made = spark.createDataFrame([("2024-01-01", "A", 5.0, 0.0), ("2024-01-01", "B", 6.0, 0.0)], "date string, ticker string, own_x double, other double")
    assert sorted(map(tuple, merge_external(panel, made, prefix="own_").collect())) == [("2024-01-01", "A", 1.0, 5.0), ("2024-01-01", "B", 2.0, 6.0)]
    assert {r["own_x"] for r in merge_external(panel, made.where("ticker = 'A'"), prefix="own_", whole=False).collect()} == {5.0, None}
    for factors, options, said in ((made.union(made), {}, "repeated"), (made.where("ticker = 'A'"), {}, "without factors"), (made, {"expected": ["own_y"]}, "own_y"), (made, {"prefix": "mine_"}, "mine_")):
        with pytest.raises((ValueError, KeyError), match=said):
            merge_external(panel, factors, **{"prefix": "own_", **options})
    with pytest.raises(ValueError, match="panel lacks"):
        merge_external(panel.where("ticker = 'A'"), made, prefix="own_")


def test_added_families_keep_repeated_rows(spark):
    """Families of one pass go along with the rows; joined to them, rows of equal keys were multiplied."""
    from datetime import datetime

    from factorloom.factors import families as fam

    rows = [(datetime(2024, 1, d), "a", 1.0 * d, 2.0, 0.5, 1.5 * d, 1.0, 10.0, f"x{d}") for d in (1, 2, 2)]
    p = spark.createDataFrame(rows, "date timestamp, ticker string, open double, high double, low double, close double, vwap double, volume double, note string")
    got = fam.add_families(p, ["alpha360", "Alpha-158"], dtype="double")
    assert got.count() == 3 and {r["note"] for r in got.collect()} == {"x1", "x2"}
    assert set(got.columns) == {*p.columns, *fam.expected_columns("alpha360"), *fam.expected_columns("alpha158")}


def test_large_groups_leave_in_slices():
    """A date of many rows is held as the arrays of its operators; before, all its columns were made at once."""
    import numpy as np
    import pyarrow as pa

    from factorloom.expressions import Expr, field, one_pass

    n = 50_000
    formulas = {f"f{i}": Expr("rank", (field("x") * float(1 - 2 * (i % 2)),)) * (i + 1.0) for i in range(20)}
    plan = {"group": "date", "extra": ["date"], "ready": [], "have": {field("x"): "_f0"}, "wanted": {}, "done": formulas, "kinds": dict.fromkeys(formulas, "double")}
    x = np.random.default_rng(1).permutation(n).astype(float)
    table = pa.table({"date": np.repeat([1, 2], [n - 10, 10]), "_f0": x})
    out = list(one_pass(plan)(iter(table.to_batches(max_chunksize=10_000))))
    assert max(b.num_rows for b in out) <= 8192 and sum(b.num_rows for b in out) == n
    got = pa.Table.from_batches(out)
    want = np.argsort(np.argsort(x[: n - 10])) + 1
    assert np.allclose(got.column("f0").to_numpy()[: n - 10], want / (n - 10)) and np.allclose(got.column("f2").to_numpy()[n - 10 :], 3 * (np.argsort(np.argsort(x[n - 10 :])) + 1) / 10)


def test_order_of_trades_does_not_matter(spark):
    """Two tickers with the same trades in other orders have the same amount and vwap to the last bit, as ranks would tell them apart; gaps and infinities stay."""
    from factorloom.panel import bars as made

    values = [1.1, 2.2, 3.3, 97_000.07, 1e9 + 0.01, 12.34, 5e-3, 7e10]
    odd = {9: [None, None], 10: [float("inf"), 1.0], 11: [float("nan"), 1.0], 12: [None, 2.5]}
    sets = {k: random.Random(k).sample(values[:-1], 7) for k in range(8)} | {8: [values[-1], 0.5]} | odd
    rows = spark.createDataFrame([(k, i, 2.0, v) for k, vs in sets.items() for i, v in enumerate(vs)], "k int, i int, q double, v double").coalesce(1)
    c = F.col
    got = {r["ticker"]: r for r in made(rows, F.lit(datetime(2024, 1, 1)), c("k"), c("i"), c("q"), c("q"), c("v")).collect()}
    assert len({(got[k]["amount"], got[k]["vwap"]) for k in range(8)}) == 1
    assert got[0]["amount"] == math.fsum(values[:-1]) and got[8]["amount"] == 7e10 + 0.5
    assert got[9]["amount"] is None and got[10]["amount"] == math.inf and math.isnan(got[11]["amount"]) and got[12]["amount"] == 2.5


def moved(df) -> int:
    """Columns that the repartitions of a plan move, all together."""
    count = lambda p: (p.output().size() if p.nodeName() == "RepartitionByExpression" else 0) + sum(count(p.children().apply(i)) for i in range(p.children().size()))
    return count(df._jdf.queryExecution().optimizedPlan())


def test_passes_move_what_later_ones_need(spark, bars):
    """Finished columns don't travel where their inputs travel anyway; before, alpha191 moved 784 columns in all and alpha101 442."""
    table, _ = bars
    assert moved(classic_factors(table, ["alpha191"])) <= 230
    assert moved(classic_factors(table, ["alpha101"])) <= 240


def test_a_minimum_cut_between_passes():
    from factorloom.expressions import carried, field, operator, stages

    rank, delay, mean = operator("rank"), operator("delay"), operator("mean")
    x, y = field("x"), field("y")
    inner = rank(delay(x, 1) * delay(y, 2))
    formulas = {"a": delay(x, 3), "b": delay(y, 4), "c": mean(inner, 5), "d": mean(inner, 6) + x, "e": delay(x, 9) * y}
    at = stages(formulas)
    # the rank's product goes to the dates, and its rank back; all that fields give is made by the last pass
    assert [set(s) for s in carried(formulas, at, sorted(set(at.values())))] == [{x, y, inner.args[0]}, {x, y, inner}]
    assert carried({"r": rank(x)}, stages({"r": rank(x)}), [1]) == []


def test_deep_formulas_by_themselves_and_together(spark, bars):
    """A column is the same whichever others it is computed with, as values are made in other passes then."""
    table, _ = bars
    names = ["alpha101_012", "alpha101_029", "alpha101_071", "alpha191_008", "alpha191_035", "alpha191_073"]
    rows = lambda only: classic_factors(table, only=only, dtype="double").orderBy("ticker", "date").toPandas()
    every = rows(None)
    for n in names:
        pd.testing.assert_series_equal(rows([n])[n], every[n])


def test_classic_families_go_along_with_a_panel(spark, bars):
    """No join, so that neither side is dealt again and repeated rows stay as many; a panel of many columns is joined, with the same values."""
    from pyspark.sql.functions import col

    from factorloom.factors.families import add_families

    table, _ = bars
    adjusted = table.withColumns({"close_adj": col("close") * 1.5, "note": F.concat("ticker", F.lit("x"))})
    both = add_families(adjusted, ["alpha101", "Alpha-191"], dtype="double")
    assert "Join" not in both._jdf.queryExecution().optimizedPlan().toString()
    names = ["alpha101_012", "alpha101_053", "alpha101_071", "alpha191_014", "alpha191_100"]
    assert both.columns == ["date", "ticker", *[c for c in adjusted.columns if c not in ("date", "ticker")], *expected_columns("alpha101"), *expected_columns("alpha191")]
    wide = add_families(adjusted.withColumns({f"more_{i}": F.lit(1.0) for i in range(90)}), ["alpha101", "alpha191"], dtype="double")
    assert "Join" in wide._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: df.orderBy("ticker", "date").select("date", "ticker", *names).toPandas()
    want = rows(classic_factors(adjusted, ["alpha101", "alpha191"], dtype="double"))
    pd.testing.assert_frame_equal(rows(both), want)
    pd.testing.assert_frame_equal(rows(wide), want)
    assert add_families(table.union(table.where("ticker = 'A'")), ["alpha101"]).count() == table.count() + 70
