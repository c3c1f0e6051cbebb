"""Performance of a return series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions import safe_div
from factorloom.operators.standardise import as_of


def nav(series: DataFrame) -> DataFrame:
    """``nav`` and ``drawdown`` of ``(series, date, ret)``."""
    w = Window.partitionBy("series").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = series.withColumn("nav", F.product(1 + F.col("ret")).over(w))
    peak = F.greatest(F.lit(1.0), F.max("nav").over(w))
    return out.withColumn("drawdown", F.col("nav") / peak - 1)


def metrics(series: DataFrame, per_year: float = 12.0, tail: float = 0.05) -> DataFrame:
    """One row for each series: growth, risk, ratios, shape (bias-corrected) and tails."""
    rows = nav(series)
    n = F.count("ret")
    at = Window.partitionBy("series")
    rows = rows.withColumn("_var", F.percentile("ret", F.lit(tail)).over(at))
    ret = F.col("ret")
    g1, g2 = F.skewness("ret"), F.kurtosis("ret")
    out = rows.groupBy("series").agg(
        n.alias("n"), (F.product(1 + ret) - 1).alias("total_return"), F.avg(ret).alias("mean"), F.stddev_samp(ret).alias("std"), F.min("drawdown").alias("max_drawdown"),
        F.sqrt(F.avg(F.pow(F.least(ret, F.lit(0.0)), F.lit(2.0)))).alias("downside"), F.avg((ret > 0).cast("double")).alias("win_rate"), g1.alias("_g1"), g2.alias("_g2"),
        F.max("_var").alias("value_at_risk"), F.avg(F.when(ret <= F.col("_var"), ret)).alias("expected_shortfall"),
    )
    m = F.col("n").cast("double")
    year = F.lit(per_year)
    out = out.withColumns({
        "annual_return": F.pow(1 + F.col("total_return"), safe_div(year, m)) - 1,
        "annual_volatility": F.col("std") * F.sqrt(year),
        "skew": F.when(m > 2, safe_div(F.col("_g1") * F.sqrt(m * (m - 1)), m - 2)),
        "kurtosis": F.when(m > 3, safe_div((m - 1) * ((m + 1) * F.col("_g2") + 6), (m - 2) * (m - 3))),
    })
    return out.withColumns({
        "sharpe": safe_div(F.col("mean") * F.sqrt(year), F.col("std")),
        "sortino": safe_div(F.col("mean") * F.sqrt(year), F.col("downside")),
        "calmar": safe_div(F.col("annual_return"), -F.col("max_drawdown")),
    }).drop("_g1", "_g2")


def against_benchmark(series: DataFrame, benchmark: DataFrame, per_year: float = 12.0) -> DataFrame:
    """Tracking error, information ratio, beta, alpha on dates that both have."""
    both = series.join(benchmark.select("date", F.col("ret").alias("b")), "date").where("ret is not null and b is not null")
    out = both.groupBy("series").agg(F.count("ret").alias("n"), F.avg(F.col("ret") - F.col("b")).alias("active"), F.stddev_samp(F.col("ret") - F.col("b")).alias("_te"), safe_div(F.covar_samp("ret", "b"), F.var_samp("b")).alias("beta"), F.avg("ret").alias("_r"), F.avg("b").alias("_b"))
    year = F.lit(per_year)
    return out.select("series", "n", (F.col("active") * year).alias("active_return"), (F.col("_te") * F.sqrt(year)).alias("tracking_error"), safe_div(F.col("active") * F.sqrt(year), F.col("_te")).alias("information_ratio"), "beta", ((F.col("_r") - F.col("beta") * F.col("_b")) * year).alias("alpha"))


def hedged(series: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(series, date, ret, b, hedged, residual, hedged_nav)``: each series less beta times the benchmark, and what a straight line leaves."""
    w = Window.partitionBy("series")
    rows = series.join(benchmark.select("date", F.col("ret").alias("b")), "date").where("ret is not null and b is not null")
    beta = safe_div(F.covar_samp("ret", "b").over(w), F.var_samp("b").over(w))
    alpha = F.avg("ret").over(w) - beta * F.avg("b").over(w)
    rows = rows.select("series", "date", "ret", "b", (F.col("ret") - beta * F.col("b")).alias("hedged"), (F.col("ret") - alpha - beta * F.col("b")).alias("residual"))
    return rows.withColumn("hedged_nav", F.product(1 + F.col("hedged")).over(w.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def comparison(series: DataFrame, benchmark: DataFrame, per_year: float = 12.0) -> DataFrame:
    """By series, against the benchmark on the dates that both have: excess return, win rate, tracking error, information ratio, alpha and beta of a period, hedged Sharpe of a period."""
    year, excess = F.lit(per_year), F.col("ret") - F.col("b")
    out = hedged(series, benchmark).groupBy("series").agg(
        F.avg((excess > 0).cast("double")).alias("win_rate_vs_benchmark"), F.avg(excess).alias("avg_excess_return"), (F.stddev_samp(excess) * F.sqrt(year)).alias("tracking_error"),
        safe_div(F.covar_samp("ret", "b"), F.var_samp("b")).alias("beta"), F.avg("ret").alias("_r"), F.avg("b").alias("_b"), safe_div(F.avg("hedged"), F.stddev_samp("hedged")).alias("hedged_sharpe"),
    )
    return out.withColumns({"alpha": F.col("_r") - F.col("beta") * F.col("_b"), "information_ratio": safe_div(F.col("avg_excess_return") * year, F.col("tracking_error"))}).drop("_r", "_b")


def spread_of(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Mean, median, smallest and largest value of a column, such as turnover or active names by period."""
    return rows.groupBy(*by).agg(F.avg(column).alias(f"avg_{column}"), F.percentile(column, F.lit(0.5)).alias(f"median_{column}"), F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}"))


def ratio_of(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Mean, sample deviation, their ratio and the share of positive values of a column, such as a period's IC."""
    return rows.groupBy(*by).agg(F.avg(column).alias(f"{column}_mean"), F.stddev_samp(column).alias(f"{column}_std"), safe_div(F.avg(column), F.stddev_samp(column)).alias(f"{column}_ir"), F.avg((F.col(column) > 0).cast("double")).alias(f"{column}_positive"))


def report(results: dict[str, DataFrame], benchmark: DataFrame | None = None, per_year: float = 12.0) -> DataFrame:
    """``(metric, value)`` of a backtest's tables (``returns``, ``exposures``, ``ic``): strategy, benchmark, comparison, turnover, active names and ICs."""
    returns = results["returns"].select(F.lit("strategy").alias("series"), F.col("period").alias("date"), F.col("net_return").alias("ret"))
    parts = [("strategy_", metrics(returns, per_year).drop("series", "n")), ("", spread_of(results["returns"].withColumn("one", F.lit(1)), "turnover", ["one"]).withColumn("annual_turnover", F.col("avg_turnover") * per_year).drop("one"))]
    if benchmark is not None:
        parts += [("benchmark_", metrics(benchmark.withColumn("series", F.lit("benchmark")).join(returns.select("date"), "date", "left_semi"), per_year).drop("series", "n")), ("", comparison(returns, benchmark, per_year).drop("series"))]
    if "exposures" in results:
        parts.append(("", spread_of(results["exposures"].select(F.lit(1).alias("one"), (F.col("longs") + F.col("shorts")).alias("active_names")), "active_names", ["one"]).drop("one")))
    if "ic" in results:
        parts += [("", ratio_of(results["ic"].withColumn("one", F.lit(1)), c, ["one"]).drop("one")) for c in ("ic", "rank_ic")]
    out = None
    for prefix, one in parts:
        long = one.select(*[F.col(c).cast("double").alias(prefix + c) for c in one.columns]).withColumn("_", F.lit(0))
        long = long.unpivot(["_"], [c for c in long.columns if c != "_"], "metric", "value").drop("_")
        out = long if out is None else out.unionByName(long)
    return out


def histogram(values: DataFrame, column: str, most: int = 10) -> DataFrame:
    """Equal-width bins, ``min(most, floor(sqrt n))`` of them, the last closed on the right."""
    span = values.agg(F.count(column).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
    rows = values.where(F.col(column).isNotNull()).crossJoin(F.broadcast(span))  # one row
    bins = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.sqrt("n")))).cast("int")
    width = (F.col("high") - F.col("low")) / F.col("bins")
    rows = rows.withColumn("bins", bins)
    at = F.when(width > 0, F.least(F.col("bins") - 1, F.floor((F.col(column) - F.col("low")) / width).cast("int"))).otherwise(0)
    rows = rows.withColumn("bin", at)
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("low") + F.col("bin") * width).alias("left"), F.max(safe_div(F.lit(1.0), F.col("n") * width)).alias("_d")).select("bin", "n", "left", (F.col("n") * F.col("_d")).alias("density"))


def benchmark_nav(periods: DataFrame, benchmark: DataFrame, mode: str = "nav") -> DataFrame:
    """Benchmark at period dates: quarter-end values carried forward, as of the date, rebased to the first."""
    if mode not in ("nav", "cumulative_return"):
        raise ValueError(f"no mode {mode!r}")
    level = F.col("value") if mode == "nav" else 1 + F.col("value")
    quarter = F.date_trunc("quarter", "date")
    ends = benchmark.where("value is not null").groupBy(quarter.alias("q")).agg(F.max_by(level, "date").alias("benchmark_nav"))
    ends = ends.select((F.col("q") + F.expr("INTERVAL 3 MONTHS") - F.expr("INTERVAL 1 DAY")).alias("date"), "benchmark_nav")
    out = as_of(periods, ends, "benchmark_nav")
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    first = F.first("benchmark_nav", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return out.withColumn("benchmark_nav", safe_div(F.col("benchmark_nav"), first))
