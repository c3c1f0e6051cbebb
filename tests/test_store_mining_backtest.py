"""Stores, streams, mining and walk-forward runs over small panels."""

import os
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.sources.store import Store
from factorloom.sources.tables import business_days, rewrite, scan_panel, shared, write_panel


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(3)
    rows = []
    for t in "ABCDEFGH":
        p = 10.0
        for i in range(90):
            p *= 1 + rng.normal(0, 0.02)
            rows.append((datetime(2023, 1, 1) + timedelta(days=i), t, p, p * 1.01, p * 0.99, p, p, 100.0 + i, p * 100, i % 7 == 0))
    return spark.createDataFrame(pd.DataFrame(rows, columns="date ticker open high low close vwap volume amount is_suspended".split())).cache()


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_store_round_trip_and_reuse(spark, bars):
    from factorloom.factors.families import alpha360

    store = Store(spark, shared(spark, "store"))
    early = bars.where(F.col("date") < datetime(2023, 3, 1))
    assert store.write_base(early, 20) == [0, 1, 2]
    assert store.write_family("alpha360", look_back=59)["written"] == [0, 1, 2]
    assert store.write_family("alpha360", look_back=59) == {"written": [], "reused": [0, 1, 2]}
    assert store.write_base(bars, 20) == [2, 3, 4]
    assert store.stale() == ["alpha360"]
    assert store.write_family("alpha360", look_back=59)["written"] == [2, 3, 4]
    assert store.stale() == []
    got = store.load(["alpha360"]).select("date", "ticker", "alpha360_close_lag59", "alpha360_open_lag05")
    want = alpha360(bars).select("date", "ticker", "alpha360_close_lag59", "alpha360_open_lag05")
    assert rows_of(got) == rows_of(want)
    some = store.load(["alpha360"], start="2023-02-01", end="2023-02-05")
    assert some.select("date").distinct().count() == 5
    with pytest.raises(ValueError):
        store.write_family("alpha360", dtype="double", look_back=59)
    with pytest.raises(ValueError):
        store.load(["alpha158"])
    other = bars.select("date", "ticker", F.lit(1.0).alias("mine_one"))
    with pytest.raises(ValueError):
        store.write_external("mine", other.where("ticker <> 'A'"))
    store.write_external("mine", other)
    assert "mine_one" in store.load().columns


@pytest.mark.parametrize("family", ["alpha101", "alpha191", "alpha158", "alpha360"])
def test_incremental_families_equal_full_ones(spark, bars, family):
    """New dates and a changed bar leave the store as a full build would, running products and gaps at chunk ends too."""
    from factorloom.factors.families import add_family, expected_columns

    gaps = bars.where("ticker in ('A', 'B', 'C')").withColumn("close", F.when(~((F.col("ticker") == "B") & F.dayofyear("date").between(38, 44)), F.col("close")))
    store = Store(spark, shared(spark, "store"))
    store.write_base(gaps.where(F.col("date") < datetime(2023, 3, 1)), 20)
    store.write_family(family)
    store.write_base(gaps, 20, updating=[family])
    done = store.write_family(family)
    assert done["written"] == [2, 3, 4] and done["reused"] == [0, 1]
    names = expected_columns(family)
    assert rows_of(store.load([family]).select("date", "ticker", *names)) == rows_of(add_family(gaps, family).select("date", "ticker", *names))


def test_store_keeps_bases_and_families_together(spark, bars):
    from factorloom.factors.families import alpha360
    from factorloom.sources.store import looks_back

    assert looks_back("alpha360") == 59 and looks_back("alpha101") is None
    store = Store(spark, shared(spark, "store"))
    some = bars.where("ticker in ('A', 'B')")
    wide = some.join(alpha360(some), ["date", "ticker"])
    assert store.write_panel(wide, 30)["alpha360"]["written"] == [0, 1, 2]
    assert set(store.load().columns) == set(wide.columns)
    assert rows_of(store.load().select("date", "ticker", "alpha360_vwap_lag07", "close")) == rows_of(wide.select("date", "ticker", "alpha360_vwap_lag07", "close"))
    assert store.load(dates=[datetime(2023, 1, 5), datetime(2023, 3, 2)]).count() == 4
    # fewer dates under a family that isn't brought up to date
    with pytest.raises(ValueError, match="alpha360"):
        store.write_base(some.where(F.col("date") < datetime(2023, 2, 1)), 30, updating=["alpha158"])
    with pytest.raises(ValueError, match="repeated"):
        store.write_base(some.union(some.limit(1)), 30)
    store.write_base(some.where(F.col("date") < datetime(2023, 2, 15)), 30)
    assert store.base().count() == 2 * 45 and store.stale() == ["alpha360"]
    with pytest.raises(ValueError, match="older base"):
        store.load()
    store.write_family("alpha360", overwrite=True)
    assert store.load().count() == 2 * 45
    with pytest.raises(ValueError, match="dates back"):
        store.write_family("alpha101", look_back=60)
    # a version that a dying run never finished is not read
    number = store.manifest()["number"]
    store._write(some.withColumn("chunk", F.lit(0)), "base", [0])
    assert store.manifest()["number"] == number and store.base().count() == 2 * 45


@pytest.fixture(scope="module")
def long_bars(spark):
    """Two hundred dates; B has gaps in its prices, C has every seventh date only, D begins late, E ends early."""
    rng = np.random.default_rng(9)
    rows = []
    for t in "ABCDE":
        p = 10.0
        for i in range(200):
            p *= 1 + rng.normal(0, 0.02)
            if t == "C" and i % 7 or t == "D" and i < 150 or t == "E" and i > 120:
                continue
            close = None if t == "B" and 55 < i % 90 < 75 else p
            rows.append((datetime(2023, 1, 1) + timedelta(days=i), t, p, p * 1.01, p * 0.99, close, p, 100.0 + i % 11, p * 100))
    return spark.createDataFrame(rows, "date timestamp_ntz, ticker string, open double, high double, low double, close double, vwap double, volume double, amount double").cache()


def reads(store, monkeypatch):
    """The chunks of the base that are read from now on."""
    seen, plain = set(), type(store)._read
    monkeypatch.setattr(type(store), "_read", lambda self, where, at, chunks=None, *more: (seen.update(chunks if chunks is not None else map(int, at)) if where == "base" else None, plain(self, where, at, chunks, *more))[1])
    return seen


def test_a_new_chunk_reads_its_look_back_and_a_state(spark, long_bars, monkeypatch):
    """Adding chunks one by one gives what a full run gives, for tickers with gaps too, and reads only what windows reach."""
    from factorloom.factors.families import add_family, expected_columns

    store, day = Store(spark, shared(spark, "store")), lambda n: datetime(2023, 1, 1) + timedelta(days=n)
    some = long_bars.where("ticker <> 'C'")
    store.write_base(some.where(F.col("date") < day(180)), 10)
    assert store.write_family("alpha158")["written"] == list(range(18))
    store.write_base(some.where(F.col("date") < day(190)), 10, updating=["alpha158"])
    seen = reads(store, monkeypatch)
    assert store.write_family("alpha158") == {"written": [18], "reused": list(range(18))}
    assert seen == set(range(11, 19)) == set(store.manifest()["families"]["alpha158"]["read"])
    monkeypatch.undo()
    names = expected_columns("alpha158")
    full = add_family(some.where(F.col("date") < day(190)), "alpha158").select("date", "ticker", *names)
    assert rows_of(store.load(["alpha158"]).select("date", "ticker", *names)) == rows_of(full)
    # every seventh date: 60 rows of C are 420 dates
    store.write_base(long_bars, 10, updating=["alpha158"])
    store.write_family("alpha158")
    assert rows_of(store.load(["alpha158"]).select("date", "ticker", *names)) == rows_of(add_family(long_bars, "alpha158").select("date", "ticker", *names))


def test_a_revised_bar_reaches_as_far_as_windows_and_states(spark, long_bars):
    """A changed price in an old chunk rewrites the chunks that look back to it, and later ones only if the state has changed."""
    from factorloom.factors.families import add_family, expected_columns
    from factorloom.streaming.incremental import merge_batch

    some = long_bars.where("ticker in ('A', 'E')")
    store, names = Store(spark, shared(spark, "store")), expected_columns("alpha158")
    store.write_base(some, 10)
    store.write_family("alpha158")
    old = {k: v["hash"] for k, v in store.manifest()["families"]["alpha158"]["state"].items()}
    batch = some.where((F.col("date") == datetime(2023, 1, 25)) & (F.col("ticker") == "A")).withColumn("close", F.col("close") * 2)
    assert merge_batch(store, batch, ["alpha158"], 10)["alpha158"]["written"] == list(range(2, 10))
    now = store.manifest()["families"]["alpha158"]
    assert {k: v["hash"] for k, v in now["state"].items()} == old  # the last known price of each chunk is as before
    changed = some.join(batch.select("date", "ticker", F.lit(2.0).alias("times")), ["date", "ticker"], "left").withColumn("close", F.col("close") * F.coalesce("times", F.lit(1.0))).drop("times")
    assert rows_of(store.load(["alpha158"]).select("date", "ticker", *names)) == rows_of(add_family(changed, "alpha158").select("date", "ticker", *names))
    # E's last price is carried by every later state, but no later chunk has rows of E
    batch = some.where((F.col("date") == datetime(2023, 5, 1)) & (F.col("ticker") == "E")).withColumn("close", F.col("close") * 3)
    merge_batch(store, batch, ["alpha158"], 10)
    changed = changed.where(~((F.col("date") == datetime(2023, 5, 1)) & (F.col("ticker") == "E"))).unionByName(batch)
    assert rows_of(store.load(["alpha158"]).select("date", "ticker", *names)) == rows_of(add_family(changed, "alpha158").select("date", "ticker", *names))


def test_a_store_in_archives_is_read_where_it_lies(spark, long_bars):
    """Loads from one archive of a store's folder, and from several made by tasks, are the store's own; only what is asked for is read."""
    import tarfile

    from factorloom.sources.tar import MembersReader, TarStore, members, pack, scan_members

    some = long_bars.where("ticker in ('A', 'B')")
    root = shared(spark, "store")
    store, local = Store(spark, root), root.removeprefix("file://")
    store.write_base(some, 50)
    store.write_family("alpha158")
    store.write_family("alpha360")
    with tarfile.open(f"{local}.tar", "w") as tar:
        tar.add(local, "data/store")
    packed = pack(store, f"{root}-packed", archive_bytes=200 << 10)
    assert len(packed) > 2
    spans = ({}, {"start": "2023-02-01", "end": "2023-02-20"}, {"families": ["alpha360"], "prefixes": ["alpha360_close_"]}, {"families": [], "dates": [datetime(2023, 1, 5), datetime(2023, 6, 2)]})
    for inside in (TarStore(spark, f"file://{local}.tar"), TarStore(spark, packed)):
        for options in spans:
            assert rows_of(inside.load(**options)) == rows_of(store.load(**options))
        assert inside.stale() == []
        with pytest.raises(ValueError, match="can't be changed"):
            inside.write_family("alpha101")
        with pytest.raises(ValueError, match="has no"):
            inside.load(["alpha101"])
    # a task a member of the chunks that hold the dates; row groups without any of them are skipped
    parts = [m for m in members(f"{local}.tar") if "/base/" in m.name and m.name.endswith(".parquet")]
    assert scan_members(spark, parts, ["date", "close"]).columns == ["date", "close"]
    wanted = [m for m in parts if "chunk=2" in m.name]
    assert sum(b.num_rows for m in wanted for b in MembersReader(wanted, ["close"], "2023-04-11", "2023-05-30").read(m)) == 100
    assert sum(b.num_rows for m in wanted for b in MembersReader(wanted, ["close"], "2023-06-01", None).read(m)) == 0
    with tarfile.open(f"{local}.tar.gz", "w:gz") as tar:
        tar.add(local, "data/store")
    with pytest.raises(ValueError, match="without compression"):
        TarStore(spark, f"{local}.tar.gz")
    with tarfile.open(f"{local}-empty.tar", "w"):
        pass
    with pytest.raises(ValueError, match="no manifest"):
        TarStore(spark, f"{local}-empty.tar")


def test_merges_touch_only_their_chunks(spark, long_bars, monkeypatch):
    from factorloom.sources.store import Conflict
    from factorloom.streaming.incremental import merge_batch

    path, day = shared(spark, "store"), lambda n: datetime(2023, 1, 1) + timedelta(days=n)
    store, other = Store(spark, path), Store(spark, path)
    some = long_bars.where("ticker in ('A', 'B')")
    gap = F.col("date").isin(day(33), day(34))
    store.merge(some.where((F.col("date") < day(95)) & ~gap), 10)
    assert len(store.manifest()["base"]["chunks"]) == 10
    before = {k: v["at"] for k, v in store.manifest()["base"]["chunks"].items()}
    seen = reads(store, monkeypatch)
    assert store.merge(some.where(gap | F.col("date").between(day(95), day(116))), 10) == [3, 9, 10, 11]
    assert seen == {3, 9, 10, 11}
    monkeypatch.undo()
    after = store.manifest()
    assert all(after["base"]["chunks"][k]["at"] == at for k, at in before.items() if k not in ("3", "9"))
    assert rows_of(store.base().drop("chunk")) == rows_of(some.where(F.col("date") <= day(116)))
    # a replay changes nothing
    assert store.merge(some.where(gap), 10) == [] and store.manifest()["number"] == after["number"]
    # another run commits between reading and writing: its rows are not lost
    plain, once = Store._write_chunks, []

    def slow(self, rows, chunks):
        if self is store and not once:
            once.append(other.merge(some.where(F.col("date") == day(117)), 10))
        return plain(self, rows, chunks)

    monkeypatch.setattr(Store, "_write_chunks", slow)
    store.merge(some.where(F.col("date") == day(118)), 10)
    monkeypatch.undo()
    assert once and rows_of(store.base().drop("chunk")) == rows_of(some.where(F.col("date") <= day(118)))
    stale = store.manifest()
    other.merge(some.where(F.col("date") == day(119)), 10)
    with pytest.raises(Conflict):
        store._note(stale)
    # families that would be left behind are refused
    store.write_family("alpha360", look_back=59)
    with pytest.raises(ValueError, match="not brought up to date"):
        merge_batch(store, some.where(F.col("date") == day(120)), [], 10)
    with pytest.raises(ValueError, match="dates a chunk"):
        store.merge(some, 20)
    with pytest.raises(ValueError, match="columns"):
        store.merge(some.drop("vwap"), 10)


def test_a_cache_fetches_only_wanted_days(spark, long_bars, monkeypatch):
    """Days not there, the last ones again, empty days once; a run that is overtaken starts anew; strange days and other columns are refused."""
    from factorloom.sources.cache import DateCache

    asked, path = [], shared(spark, "cache")
    cache, other = DateCache(spark, path), DateCache(spark, path)
    dates = spark.createDataFrame([(date(2023, 1, d),) for d in range(1, 11)], "date date")

    def source(days, factor=1.0):
        asked.append(sorted(r[0].day for r in days.collect()))
        return long_bars.join(days, F.to_date("date") == F.col("day")).where("ticker = 'C'").select("date", "ticker", (F.col("low") * factor).alias("low"))

    with pytest.raises(ValueError, match="nothing"):
        cache.read("bars")
    assert cache.fill("bars", dates.limit(8), source) == {"fetched": 8, "rows": 2}  # C has the 1st and the 8th
    assert cache.fill("bars", dates, source) == {"fetched": 2, "rows": 0} and cache.fill("bars", dates, source) == {"fetched": 0, "rows": 0}
    assert asked == [list(range(1, 9)), [9, 10]]
    assert cache.fill("bars", dates.limit(8), lambda d: source(d, 2.0), refresh=2) == {"fetched": 2, "rows": 1} and asked[-1] == [7, 8]
    want = long_bars.where("ticker = 'C'").where("date < '2023-01-11'").select("date", "ticker", (F.col("low") * F.when(F.dayofmonth("date") == 8, 2.0).otherwise(1.0)).alias("low"))
    assert rows_of(cache.read("bars")) == rows_of(want)
    assert cache.read("bars", "2023-01-02", "2023-01-09").count() == 1 and cache.read("bars", "2023-01-02", "2023-01-03").count() == 0
    once = []

    def slow(days):
        if not once:
            once.append(other.fill("other", dates.limit(1), source))
        return source(days)

    more = spark.createDataFrame([(date(2023, 1, 15),)], "date date")
    assert cache.fill("bars", more, slow) == {"fetched": 1, "rows": 1} and len(cache.days("other")) == 1 and len(cache.days("bars")) == 11
    with pytest.raises(ValueError, match="not wanted"):
        cache.fill("bars", spark.createDataFrame([(date(2023, 2, 1),)], "date date"), lambda d: long_bars.select("date", "ticker", "low"))
    with pytest.raises(ValueError, match="other columns"):
        cache.fill("bars", spark.createDataFrame([(date(2023, 1, 22),)], "date date"), lambda d: source(d).drop("ticker"))


def test_ridge_is_the_closed_form(spark):
    from factorloom.analytics import models

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = x @ [0.02, -0.01, 0.0] + 0.003 + rng.normal(size=300) * 0.01
    rows = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "rel_return": y, "label": 0}))
    for alpha in (1.0, 50.0):
        fitted = models.fit(rows, ["a", "b", "c"], "ridge", alpha=alpha)
        centred, target = x - x.mean(0), y - y.mean()
        want = np.linalg.solve(centred.T @ centred + alpha * np.eye(3), centred.T @ target)
        assert np.allclose(fitted[1].stages[-1].coefficients.toArray(), want, atol=1e-8)
    assert any(v for _, v in models.importances(models.fit(rows, ["a", "b", "c"], "lasso"), ["a", "b", "c"]))


def test_stream_into_store(spark, bars):
    from factorloom.streaming.incremental import follow

    plain = bars.drop("is_suspended")
    landing, root, check = (shared(spark, n) for n in ("landing", "store", "check"))
    plain.where(F.col("date") < datetime(2023, 2, 10)).coalesce(1).write.parquet(landing)
    run = lambda: follow(spark, landing, plain.schema.simpleString()[7:-1].replace(":", " "), root, check, ["alpha360"], 30).awaitTermination(120)
    assert run()
    plain.where(F.col("date") >= datetime(2023, 2, 10)).coalesce(1).write.mode("append").parquet(landing)
    assert run()
    assert rows_of(Store(spark, root).base().drop("chunk")) == rows_of(plain)


def test_tables(spark, bars):
    path = shared(spark, "panel")
    write_panel(bars, path, level=3)
    assert rewrite(spark, path, path + "2") == 720
    assert scan_panel(spark, path, start="2023-01-05", end="2023-01-06").count() == 16
    for bad in ({"codec": "snappy", "level": 1}, {"level": 0}, {"codec": "odd"}):
        with pytest.raises(ValueError):
            write_panel(bars, path + "3", **bad)
    with pytest.raises(ValueError):
        rewrite(spark, path, path)
    with pytest.raises(ValueError):
        scan_panel(spark, "x.pkl")
    assert business_days(spark, "2024-01-05", "2024-01-09").count() == 3


def test_mining(spark, bars):
    from factorloom.factors.mining import Grower, depth, fitness, formula, inputs, mine, neutral_quintiles, nodes, out_of_sample
    from factorloom.expressions import Expr, field
    from factorloom.sources.tables import settled

    rows = inputs(bars, ["close", "volume"]).cache()
    trees = Grower(["close", "volume"], 5).population(8, 3)
    assert [formula(t) for t in trees] == [formula(t) for t in Grower(["close", "volume"], 5).population(8, 3)]
    assert all(depth(t) <= 3 and nodes(t) for t in trees)
    tree = Expr("-", (field("close"), Expr("delay", (field("close"), 3))))
    got = fitness(rows, [tree, Expr("safe_div", (field("close"), field("close")))], 0.0)
    p = rows.toPandas().sort_values(["ticker", "date"])
    x = p["close"] - p.groupby("ticker")["close"].shift(3)
    ok = x.notna() & p["_future"].notna()
    want = abs(np.corrcoef(x[ok].rank(), p["_future"][ok].rank())[0, 1])
    assert abs(got[0] - want) < 1e-9 and got[1] == 0
    found = mine(rows, ["close", "volume"], population=6, generations=2, most_depth=3, seed=1, settle=settled)
    assert found.score >= 0 and len(found.history) <= 3 and found.history == sorted(found.history)
    assert out_of_sample(rows, found.best).count() == 1
    # plain numbers stand in trees, and size takes no part in neutral quintiles
    trees = [t for seed in range(8) for t in Grower(["close", "volume"], seed).population(20, 4)]
    numbered = [t for t in trees if any(isinstance(a, float) for _, e in nodes(t) for a in e.args)]
    assert numbered and all(0 <= s <= 1 for s in fitness(rows, numbered[:4], 0.0, least=10))
    sized = inputs(bars.withColumn("total_mv", F.exp(F.ascii("ticker") / 10.0)), ["close", "volume"])
    assert "_size" in sized.columns
    assert neutral_quintiles(sized, found.best).columns == ["group", "mean_return", "periods"]


def test_walk_forward(spark, bars):
    from factorloom.analytics import models
    from factorloom.analytics.backtest import Span, add_months, spans, walk_forward
    from factorloom.operators.standardise import returns
    from factorloom.sources.tables import settled

    assert add_months(date(2024, 1, 31), 1) == date(2024, 2, 29)
    s = list(spans(date(2020, 1, 31), 2, 12, 6))
    assert [x.train_start for x in s] == [date(2020, 1, 31), date(2020, 4, 30)] and s[0].test_end == date(2021, 7, 31)
    p = returns(bars).withColumn("benchmark_next_period_return", F.lit(0.0)).withColumn("f1", F.sin(F.col("volume"))).withColumn("f2", F.col("close") / 10)
    steps = [Span(date(2023, 1, 1), date(2023, 2, 15), date(2023, 2, 15), date(2023, 3, 1)), Span(date(2023, 1, 15), date(2023, 3, 1), date(2023, 3, 1), date(2023, 3, 15))]
    out = walk_forward(p, ["f1", "f2"], steps, model="ridge", alpha=0.1, cost_bps=10, settle=settled)
    e = out["exposures"].collect()
    assert len(e) == 2 and all(r["gross"] <= 1 + 1e-9 and r["largest"] <= 0.25 + 1e-9 for r in e)
    assert out["returns"].count() == 2 and out["ic"].count() == 2
    train = p.withColumn("label", F.when(F.col("f1") > 0, 1).otherwise(-1)).withColumn("rel_return", F.col("f1"))
    fitted = models.fit(train, ["f1", "f2"], "random_forest", n_estimators=5, max_depth=3)
    assert models.selected(fitted, ["f1", "f2"])[0] == "f1"
    got = models.scores(train, fitted).select(F.corr("score", "f1")).first()[0]
    assert got > 0.7
    with pytest.raises(ValueError):
        models.fit(train, ["f1"], "xgboost")


def test_chained_segments_have_their_own_settings(spark, bars):
    """Each segment is a walk-forward run of its own, windows that overlap the one before are left out, and one NAV goes through all."""
    from factorloom.analytics.backtest import Segment, chained, spans, walk_forward
    from factorloom.operators.standardise import returns
    from factorloom.sources.tables import settled

    assert [(s.test_start, s.test_end) for s in spans(date(2022, 1, 1), 2, 12, 3, 1)] == [(date(2023, 2, 1), date(2023, 5, 1)), (date(2023, 5, 1), date(2023, 8, 1))]
    p = settled(returns(bars).withColumn("benchmark_next_period_return", F.lit(0.0)).withColumn("f1", F.sin(F.col("volume"))).withColumn("f2", F.col("close") / 10))
    one = Segment(date(2022, 12, 1), 1, 2, 1, settings={"model": "ridge", "cost_bps": 10.0, "alpha": 0.1})
    two = Segment(date(2022, 9, 1), 2, 3, 3, features=["f2"], settings={"model": "lasso", "alpha": 0.0})
    assert [s.test_start for s in two.spans()] == [date(2022, 12, 1), date(2023, 3, 1)]  # the first begins before segment one ends
    out = chained(p, ["f1", "f2"], [one, two], initial=2.0, cap=0.3, settle=settled)
    plain = [walk_forward(p, f, steps, cap=0.3, settle=settled, **part.settings) for f, part, steps in ((["f1", "f2"], one, one.spans()), (["f2"], two, two.spans()[1:]))]
    key = lambda df: sorted((str(r["period"]), str(r["ticker"]), round(r["weight"], 12)) for r in df.collect())
    for i, run in enumerate(plain):
        assert key(out["weights"].where(F.col("segment") == i)) == key(run["weights"]) != []
    net = [r["net_return"] for run in plain for r in run["returns"].orderBy("period").collect()]
    assert [r["nav"] for r in out["nav"].orderBy("period").collect()] == pytest.approx([2 * (1 + net[0]), 2 * (1 + net[0]) * (1 + net[1])])
    with pytest.raises(ValueError, match="window"):
        chained(p, ["f1"], [Segment(date(2022, 12, 1), 0)])


def test_risk_weights_in_walk_forward_and_holdout(spark, bars):
    """The programme's weights on the scores of the run, from returns before each period alone."""
    from factorloom.analytics.backtest import Span, holdout, walk_forward
    from factorloom.analytics.riskqp import Risk, risk_weights
    from factorloom.operators.standardise import returns
    from factorloom.sources.tables import settled

    p = settled(returns(bars).withColumn("benchmark_next_period_return", F.lit(0.0)).withColumn("f1", F.sin(F.col("volume") + F.ascii("ticker"))))
    steps = [Span(date(2023, 1, 1), date(2023, 2, 15), date(2023, 2, 15), date(2023, 3, 1)), Span(date(2023, 1, 15), date(2023, 3, 1), date(2023, 3, 1), date(2023, 3, 15))]
    risk = Risk(cap=0.2, look_back=30, turnover=0.5)
    out = walk_forward(p, ["f1"], steps, alpha=0.1, risk=risk, settle=settled)
    rows = out["weights"].groupBy("period").agg(F.sum("weight").alias("net"), F.max(F.abs("weight")).alias("top"), F.sum(F.abs("weight")).alias("gross")).collect()
    assert len(rows) == 2 and all(abs(r["net"]) < 1e-6 and r["top"] <= 0.2 + 1e-6 and 0.1 < r["gross"] <= 1 + 1e-6 for r in rows)
    # prices after the last period begins change nothing
    later = p.withColumn("return_1d", F.when(F.col("date") >= datetime(2023, 3, 1), 9.0).otherwise(F.col("return_1d")))
    key = lambda o: sorted((str(r["period"]), r["ticker"], round(r["weight"], 9)) for r in o["weights"].collect())
    assert key(walk_forward(later, ["f1"], steps, alpha=0.1, risk=risk, settle=settled)) == key(out)
    held = holdout(p, ["f1"], date(2023, 2, 15), date(2023, 3, 20), months=1, alpha=0.1, risk=risk, settle=settled)
    assert held["weights"].select("period").distinct().count() == 2 and held["exposures"].first()["largest"] <= 0.2 + 1e-6
    plain = walk_forward(p, ["f1"], steps, alpha=0.1, settle=settled)
    assert key(plain) != key(out)
    scores = spark.createDataFrame([("run", date(2023, 3, 1), t, float(i)) for i, t in enumerate("ABCD")], "strategy string, period date, ticker string, score double")
    assert risk_weights(scores, p.select(F.to_date("date").alias("date"), "ticker", F.col("return_1d").alias("ret")).where("ret is not null"), risk).count() > 0


def test_backtest_command_takes_segments_and_risk_weights(spark, bars, tmp_path, capsys):
    import json

    from factorloom.cli import main
    from factorloom.operators.standardise import returns
    from factorloom.sources.tables import write_panel

    path = f"{tmp_path}/panel"
    write_panel(returns(bars).withColumn("benchmark_next_period_return", F.lit(0.0)).withColumn("f1", F.sin(F.col("volume"))).withColumn("f2", F.col("close") / 10), path)
    config = tmp_path / "run.json"
    config.write_text(json.dumps({"features": ["f1", "f2"], "start": "2022-12-01", "windows": 1, "train_months": 2, "test_months": 1, "params": {"alpha": 0.1}, "then": [{"start": "2022-12-01", "train_months": 3, "weights": "risk", "risk": {"look_back": 20}, "model": "lasso", "params": {"alpha": 0.0}}]}))
    assert main(["backtest", "--panel", path, "--config", str(config), "--output", f"{tmp_path}/out"]) == 0
    figures = json.loads(capsys.readouterr().out)
    assert set(figures) == {"rolling"}
    assert [r["segment"] for r in spark.read.option("header", True).csv(f"{tmp_path}/out/rolling/returns").orderBy("period").collect()] == ["0", "1"]
    with pytest.raises(SystemExit, match="no weights"):
        main(["backtest", "--panel", path, "--config", str(config), "--set", "weights=equal"])


def test_segments_follow_each_other():
    from factorloom.analytics.backtest import segments

    steps = segments([(date(2020, 1, 1), 3, 12, 3), (date(2020, 1, 1), 8, 24, 3), (date(2019, 1, 1), 40, 36, 3)])
    assert len(steps) == 3 + 8 + 32
    assert all(a.test_end <= b.test_start for a, b in zip(steps, steps[1:]))


def test_what_a_run_leaves(spark, tmp_path):
    import json

    from factorloom.analytics.outputs import write_run

    rows = [(date(2023, i, 1), 0.01 * i, 0.01 * i - 0.002, 0.3 + 0.01 * i) for i in range(1, 7)]
    returns = spark.createDataFrame(rows, "period date, gross_return double, net_return double, turnover double")
    exposures = spark.createDataFrame([(r[0], 1.0, 0.0, 0.2, 5, 4 + i) for i, r in enumerate(rows)], "period date, gross double, net double, largest double, longs long, shorts long")
    ic = spark.createDataFrame([(r[0], 0.1 - 0.05 * i, 0.2) for i, r in enumerate(rows)], "period date, ic double, rank_ic double")
    benchmark = spark.createDataFrame([(r[0], 0.005 * (-1) ** i) for i, r in enumerate(rows)], "date date, ret double")
    where = str(tmp_path / "run")
    figures = write_run({"returns": returns, "exposures": exposures, "ic": ic}, where, benchmark=benchmark, settings={"model": "ridge", "api_token": "x"})
    net = np.array([r[2] for r in rows])
    assert abs(figures["strategy_total_return"] - (np.prod(1 + net) - 1)) < 1e-12
    assert abs(figures["avg_turnover"] - 0.335) < 1e-12 and abs(figures["annual_turnover"] - 12 * 0.335) < 1e-12
    assert figures["median_active_names"] == 11.5 and figures["rank_ic_ir"] is None
    assert abs(figures["beta"] - np.polyfit([0.005 * (-1) ** i for i in range(6)], net, 1)[0]) < 1e-9
    text = lambda n: "\n".join(r[0] for r in spark.read.text(f"{where}/{n}").collect())
    assert json.loads(text("settings_json")) == {"api_token": "***", "model": "ridge"}
    assert json.loads(text("metrics_json"))["beta"] == figures["beta"]
    assert spark.read.option("header", True).csv(f"{where}/hedged").count() == 6


def test_large_families_are_not_dealt_again(spark, tmp_path, monkeypatch):
    """Families above ``LARGE`` values are written by the tasks that made them, and load the same."""
    from datetime import datetime

    from factorloom.sources import store as st

    rows = [(datetime(2024, 1, 1 + d), f"t{t}", 1.0 + d, 3.0 + d + t, 0.5, 1.5 + d * t, 1.0 + t, 10.0 + d, 5.0) for d in range(9) for t in range(4)]
    p = spark.createDataFrame(rows, "date timestamp, ticker string, open double, high double, low double, close double, vwap double, volume double, amount double")
    found = []
    for large in (1 << 40, 0):
        monkeypatch.setattr(st, "LARGE", large)
        s = st.Store(spark, f"file://{tmp_path}/{large}")
        s.write_base(p, 4)
        s.write_family("alpha158", dtype="double")
        s.write_external("mine", p.select("date", "ticker", (p.close * 2).alias("mine_x")))
        found.append(sorted(map(str, s.load().drop("chunk").collect())))
    assert found[0] == found[1] and len(found[0]) == 36


def test_a_store_moves_into_archives(spark, long_bars, monkeypatch):
    """The archives take the store's place part by part, so there needn't be room for both; a copy leaves the store as it is."""
    from factorloom.sources import tar

    monkeypatch.setattr(tar, "PARTS", 4)
    root = shared(spark, "store")
    store, local = Store(spark, root), root.removeprefix("file://")
    store.write_base(long_bars.where("ticker in ('A', 'B')"), 50)
    store.write_family("alpha158")
    want = rows_of(store.load())
    sizes = lambda where: sum(os.path.getsize(f"{r}/{f}") for r, _, fs in os.walk(where) for f in fs if f.endswith((".parquet", ".tar")))
    whole = sizes(local)
    assert rows_of(tar.TarStore(spark, tar.pack(store, f"{root}-copy", archive_bytes=100 << 10)).load()) == want and sizes(local) == whole
    frame = type(long_bars)
    both, noted = [], frame.mapInArrow

    def watched(self, *args, **options):
        both.append(sizes(local) + sizes(f"{local}-moved"))
        return noted(self, *args, **options)

    monkeypatch.setattr(frame, "mapInArrow", watched)
    moved = tar.pack(store, f"{root}-moved", archive_bytes=100 << 10, move=True)
    monkeypatch.undo()
    assert len(both) == 8 and max(both) < 1.75 * whole and sizes(local) == 0
    assert rows_of(tar.TarStore(spark, moved).load()) == want and store.manifest()["number"] == 0


def test_a_wide_panel_is_not_written_beside_the_store(spark, long_bars, monkeypatch):
    """Base and families are written from the panel itself; before, all its columns were written once more."""
    from factorloom.factors.families import add_family
    from factorloom.sources import store as st

    written, real = [], st.settled
    monkeypatch.setattr(st, "settled", lambda df: (written.append(df.columns), real(df))[1])
    s = Store(spark, shared(spark, "wide"))
    wide = add_family(long_bars, "alpha360", dtype="double")
    s.write_panel(wide, 50, dtype="double")
    assert written and not [c for columns in written for c in columns if c.startswith("alpha360_")]
    assert rows_of(s.load()) == rows_of(wide.select(s.load().columns))
    with pytest.raises(ValueError, match="aren't the base's"):  # as many keys of each chunk, but one is another's
        s.write_family("mine", lambda b: b.select("date", F.when((F.col("ticker") == "A") & (F.dayofyear("date") == 9), F.lit("Z")).otherwise(F.col("ticker")).alias("ticker"), F.lit(1.0).alias("mine_x")))


def test_stores_leave_no_shuffle_files(spark, long_bars):
    """What a step of a store has shuffled goes when it is done, not when the session ends."""
    import time

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    there = lambda: {int(f.split("/shuffle_")[1].split("_")[0]) for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    first = spark.sparkContext._jsc.sc().newShuffleId()
    s = Store(spark, shared(spark, "swept"))
    s.write_base(long_bars, 50)
    s.write_family("alpha101")
    made = spark.sparkContext._jsc.sc().newShuffleId() - first
    for _ in range(100):
        if len(left := {i for i in there() if i > first}) <= made // 4:  # the JVM may hold on to the last query
            break
        time.sleep(0.1)
    assert made > 12 and len(left) <= made // 4, (made, left)
