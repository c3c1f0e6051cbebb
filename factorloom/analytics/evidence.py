"""Factor evidence: information coefficients, quantile groups, slices, inference and multiple-testing control."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions import finite, no_nan, safe_div
from factorloom.sources.tables import settled


def long_factors(panel: DataFrame, factors: Sequence[str], target: str, *, finite_only: bool = False) -> DataFrame:
    """``(date, ticker, factor, x, y)``, one row for each factor: one scan for all factors."""
    clean = finite if finite_only else no_nan
    rows = panel.select("date", "ticker", clean(F.col(target).cast("double")).alias("y"), *[clean(F.col(c).cast("double")).alias(c) for c in factors])
    return rows.unpivot(["date", "ticker", "y"], list(factors), "factor", "x")


def _pearson(x: str, y: str):
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when((F.count(x) >= 2) & varied, safe_div(F.covar_pop(x, y), spread))


def daily_ic(rows: DataFrame) -> DataFrame:
    """``(date, factor, ic, rank_ic, n_obs, coverage)`` of ``long_factors`` rows.

    Ranks are taken again over the pairs that are complete. Each (date, factor) is a cross-section of tickers.
    """
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    by = Window.partitionBy("date", "factor", both)

    def ranked(c: str):
        w = by.orderBy(c)
        return F.rank().over(w) + (F.count(F.lit(1)).over(w.rangeBetween(0, 0)) - 1) / 2

    ranks = rows.withColumns({"both": both, "rx": F.when(both, ranked("x")), "ry": F.when(both, ranked("y"))})
    u = ranks.withColumns({"x": F.when(F.col("both"), F.col("x")), "y": F.when(F.col("both"), F.col("y"))})
    return u.groupBy("date", "factor").agg(
        _pearson("x", "y").alias("ic"), _pearson("rx", "ry").alias("rank_ic"), F.count("x").alias("n_obs"), (F.count("x") / F.count(F.lit(1))).alias("coverage")
    )


def ic_summary(ic: DataFrame) -> DataFrame:
    """Means, information ratios (population deviation), shares of positive dates, mean coverage and periods."""
    one = lambda c: [
        F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), safe_div(F.avg(c), F.stddev_pop(c)).alias(f"{c}_ir"), F.avg(F.when(F.col(c).isNotNull(), (F.col(c) > 0).cast("double"))).alias(f"{c}_positive"),
    ]
    return ic.groupBy("factor").agg(*one("ic"), *one("rank_ic"), F.avg("coverage").alias("avg_coverage"), F.count("rank_ic").alias("periods"))


def grouped(rows: DataFrame, groups: int, rule: str = "store") -> DataFrame:
    """Complete pairs with their quantile ``group`` (1 = smallest factor).

    ``store``: ``floor((r - 1) g / n) + 1``. ``panel``: equal-frequency edges over ranks 1..n. Ranks are distinct, ties by ticker.
    """
    rows = rows.where("x is not null and y is not null")
    w = Window.partitionBy("date", "factor")
    rows = rows.withColumns({"r": F.row_number().over(w.orderBy("x", "ticker")), "n": F.count(F.lit(1)).over(w)})
    if rule == "store":
        bucket = F.least(F.lit(groups - 1), F.floor((F.col("r") - 1) * groups / F.col("n"))) + 1
        return rows.where("n >= 2").withColumn("group", bucket.cast("int"))
    if rule == "panel":
        q = F.least(F.lit(groups), F.col("n"))
        bucket = F.when(F.col("n") == 1, 1).otherwise(F.greatest(F.lit(1), F.ceil((F.col("r") - 1) * q / F.greatest(F.col("n") - 1, F.lit(1)))))
        return rows.withColumn("group", bucket.cast("int"))
    raise ValueError(f"no group rule {rule!r}")


def daily_group_returns(rows: DataFrame, groups: int = 5, rule: str = "store") -> DataFrame:
    return grouped(rows, groups, rule).groupBy("date", "factor", "group").agg(F.avg("y").alias("group_return"), F.count(F.lit(1)).alias("n"))


def group_returns(daily: DataFrame) -> DataFrame:
    return daily.groupBy("factor", "group").agg(F.avg("group_return").alias("mean_return"), F.count_distinct("date").alias("periods"))


def mining_groups(rows: DataFrame, groups: int = 5, least: int = 10) -> DataFrame:
    """Mean returns of quantile groups with interpolated edges, equal edges merged; dates of fewer than ``least`` names left out."""
    rows = rows.where("x is not null and y is not null")
    edges = rows.groupBy("date", "factor").agg(F.count(F.lit(1)).alias("n"), F.percentile("x", F.array(*[F.lit(i / groups) for i in range(groups + 1)])).alias("e")).where(F.col("n") >= least)
    edges = edges.select("date", "factor", F.array_distinct("e").alias("e"))
    out = rows.join(edges, ["date", "factor"])
    bucket = F.greatest(F.lit(1), F.size(F.filter("e", lambda v: v < F.col("x"))))
    daily = out.withColumn("group", bucket).groupBy("date", "factor", "group").agg(F.avg("y").alias("group_return"))
    return group_returns(daily)


def regimes(benchmark: DataFrame, span: int = 252) -> DataFrame:
    """``(date, regime)``: bull or bear by the compounded benchmark return of the ``span`` valid dates before."""
    valid = benchmark.where(F.col("benchmark_return").isNotNull())
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-span, -1)
    growth = F.when(F.count("benchmark_return").over(w) == span, F.product(1 + F.col("benchmark_return")).over(w) - 1)
    return valid.withColumn("past", growth).where("past is not null").select("date", F.when(F.col("past") > 0, "bull").otherwise("bear").alias("regime"))


def checked_benchmark(rows: DataFrame) -> DataFrame:
    """One return a date; two for a date, or a loss of everything, is an error."""
    per = rows.groupBy("date").agg(F.min("benchmark_return").alias("benchmark_return"), F.max("benchmark_return").alias("high"))
    bad = per.where("benchmark_return <> high or benchmark_return <= -1").limit(1).count()
    if bad:
        raise ValueError("conflicting benchmark returns on a date, or one of -1 or less")
    return per.drop("high")


def sliced(rows: DataFrame, regime: DataFrame | None) -> DataFrame:
    """Rows of dates with their calendar year as ``slice``, and again with their market regime."""
    out = rows.withColumn("slice", F.date_format("date", "yyyy"))
    return out if regime is None else out.unionByName(rows.join(F.broadcast(regime), "date").withColumnRenamed("regime", "slice"))  # one row a date


def slice_groups(daily: DataFrame, regime: DataFrame | None = None) -> DataFrame:
    """Mean return of each factor's groups, and dates, by slice, of ``daily_group_returns`` rows."""
    return sliced(daily, regime).groupBy("factor", "slice", "group").agg(F.avg("group_return").alias("mean_return"), F.count_distinct("date").alias("periods"))


def slices(ic: DataFrame, regime: DataFrame | None = None) -> DataFrame:
    """By factor and slice (calendar year, market regime): valid dates, mean RankIC, share of positive ones."""
    rows = sliced(ic.where("rank_ic is not null"), regime)
    return rows.groupBy("factor", "slice").agg(F.count("rank_ic").alias("valid_dates"), F.avg("rank_ic").alias("mean_rank_ic"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive_rate"))


def hac_moments(series: DataFrame, horizon: int) -> DataFrame:
    """``(factor, n, mean, lrv)`` of ``(factor, date, value)``: Bartlett-weighted long-run variance of the mean; gaps keep their place."""
    if horizon < 1:
        raise ValueError("horizon starts at 1")
    by = Window.partitionBy("factor")
    order = by.orderBy("date")
    rows = series.withColumns({"mean": F.avg("value").over(by), "len": F.count(F.lit(1)).over(by)})
    rows = rows.withColumn("c", F.coalesce(F.col("value") - F.col("mean"), F.lit(0.0)))
    lags = {f"g{k}": F.coalesce(F.col("c") * F.lag("c", k).over(order), F.lit(0.0)) for k in range(1, horizon)}
    rows = rows.withColumns(lags) if lags else rows
    used = F.least(F.lit(horizon - 1), F.max("len") - 1)
    total = F.sum(F.col("c") * F.col("c"))
    for k in range(1, horizon):
        total = total + F.when(used >= k, 2 * (1 - F.lit(float(k)) / (used + 1)) * F.sum(f"g{k}")).otherwise(0.0)
    return rows.groupBy("factor").agg(F.count("value").alias("n"), F.max("mean").alias("mean"), (safe_div(F.greatest(total, F.lit(0.0)), F.count("value") * F.count("value"))).alias("lrv"), used.alias("lags"))


def hac_mean(series: DataFrame, horizon: int, confidence: float = 0.95) -> DataFrame:
    """Standard error, z, two-sided p and interval of each factor's mean; ``not_provided`` below two values or without variance."""
    z_at = NormalDist().inv_cdf(0.5 + confidence / 2)
    rows = hac_moments(series, horizon).withColumn("standard_error", F.sqrt("lrv"))
    ok = (F.col("n") >= 2) & (F.col("standard_error") > 0)
    rows = rows.withColumn("z", F.when(ok, safe_div(F.col("mean"), F.col("standard_error"))))
    return rows.withColumns({
        "p_value": normal_tail(F.abs("z")),
        "low": F.when(ok, F.col("mean") - z_at * F.col("standard_error")),
        "high": F.when(ok, F.col("mean") + z_at * F.col("standard_error")),
        "status": F.when(ok, "complete").otherwise("not_provided"),
        "reason": F.when(ok, None).when(F.col("n") < 2, "insufficient_valid_observations").otherwise("no_variance"),
    }).drop("lrv")


def normal_tail(z):
    """Two-sided normal tail probability by a continued fraction (z > 3) or a power series: exact to about 1e-14."""
    x = z / F.lit(2.0**0.5)
    # erf by its series: 2/sqrt(pi) exp(-x^2) sum 2^n x^(2n+1) / (2n+1)!!
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("t"), x.alias("s")), lambda a, n: F.struct((a["t"] * 2 * x * x / (2 * n + 1)).alias("t"), (a["s"] + a["t"] * 2 * x * x / (2 * n + 1)).alias("s")))
    series = 1 - F.lit(2 / 3.141592653589793**0.5) * F.exp(-x * x) * terms["s"]
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda a, n: x + n / 2 / a)
    tail = F.exp(-x * x) / F.lit(3.141592653589793**0.5) / fraction
    return F.when(z > 3, tail).otherwise(series)


def harmonic(m):
    """1 + 1/2 + ... + 1/m to all its figures: summed up to 64 terms, beyond that by the Euler-Maclaurin series, whose next term is below 1e-16."""
    few = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(64), F.greatest(F.lit(1), m)).cast("int")), F.lit(0.0), lambda a, k: a + F.lit(1.0) / k)
    x = m.cast("double")
    return F.when(m <= 64, few).otherwise(F.ln(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4.0))))


def q_values(tests: DataFrame) -> DataFrame:
    """Benjamini-Hochberg and Benjamini-Yekutieli q-values of ``(factor, p_value)``; missing tests count in the family.

    Tests are range-sorted and numbered by the counts of each part; the smallest value of later parts is carried over as one row a part.
    """
    names = ["factor", "p_value"]
    parts = int(tests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["p_value", "factor"]
    rows = settled(tests.select(*names).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    before, after = (Window.partitionBy(F.lit(0)).orderBy(o) for o in ("part", F.desc("part")))  # one row a part
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("all"), F.count("p_value").alias("some"))
    starts = counts.select("part", F.coalesce(F.sum("some").over(earlier(before)), F.lit(0)).alias("start"), F.sum("all").over(Window.partitionBy(F.lit(0))).alias("m"))
    inner = Window.partitionBy("part")
    some = rows.where("p_value is not null").join(F.broadcast(starts), "part").withColumn("i", F.col("start") + F.row_number().over(inner.orderBy(*order)))
    some = some.withColumn("raw", F.col("p_value") * F.col("m") / F.col("i"))
    lows = some.groupBy("part").agg(F.min("raw").alias("low"))
    lows = lows.select("part", F.min("low").over(earlier(after)).alias("later"))
    back = inner.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    low = F.least(F.min("raw").over(back), F.col("later"))
    some = some.join(F.broadcast(lows), "part").withColumn("low", low)
    some = some.select(*names, F.least(F.lit(1.0), "low").alias("q_bh"), F.least(F.lit(1.0), F.col("low") * harmonic(F.col("m"))).alias("q_by"))
    return rows.where("p_value is null").select(*names, F.lit(None).cast("double").alias("q_bh"), F.lit(None).cast("double").alias("q_by")).unionByName(some)


def quality_gate(summary: DataFrame, least_coverage: float = 0.8) -> DataFrame:
    """pass, warn or fail, with what counts against: no factors, low coverage, missing RankIC."""
    low, lost = F.sum((F.col("avg_coverage") < least_coverage).cast("int")), F.sum(F.col("rank_ic_mean").isNull().cast("int"))
    out = summary.agg(F.count(F.lit(1)).alias("factor_count"), F.coalesce(low, F.lit(0)).alias("low_coverage"), F.coalesce(lost, F.lit(0)).alias("missing_rank_ic"))
    return out.withColumn("status", F.when(F.col("factor_count") < 1, "fail").when((F.col("low_coverage") > 0) | (F.col("missing_rank_ic") > 0), "warn").otherwise("pass"))
