"""Data-quality reports over panels, factor families and raw caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions import flag, is_close, safe_div
from factorloom.operators.standardise import PRICES, returns


def sanity_report(panel: DataFrame) -> DataFrame:
    """One row: size, span, duplicate keys, impossible prices, volumes and ranges."""
    number = lambda c: F.coalesce(F.sum(flag(c).cast("int")), F.lit(0)).cast("long")
    prices = [c for c in PRICES if c in panel.columns]
    bad = F.lit(False)
    for c in prices:
        bad = bad | flag(F.col(c) <= 0)
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("date_min"), F.max("date").alias("date_max"), F.count_distinct("date").alias("n_dates"), F.count_distinct("ticker").alias("n_tickers"),
        (F.count(F.lit(1)) - F.count_distinct("date", "ticker")).alias("duplicate_keys"), number(bad).alias("non_positive_prices"), number(F.col("volume") < 0).alias("negative_volume"), number(F.col("high") < F.col("low")).alias("high_below_low"),
    )


def null_rates(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    rates = panel.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return rates.unpivot([], list(columns), "column", "null_rate")


def duplicate_keys(panel: DataFrame) -> DataFrame:
    return panel.groupBy("date", "ticker").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def return_consistency(panel: DataFrame, rtol: float = 1e-7, atol: float = 1e-10) -> DataFrame:
    """Recorded against recomputed ``return_1d`` and ``next_period_return``."""
    again = returns(panel.drop("return_1d", "next_period_return")).select("date", "ticker", F.col("return_1d").alias("_a"), F.col("next_period_return").alias("_b"))
    rows = panel.join(again, ["date", "ticker"], "left")
    parts = []
    for recorded, derived in (("return_1d", "_a"), ("next_period_return", "_b")):
        x, y = F.col(recorded), F.col(derived)
        count = lambda c: F.coalesce(F.sum(flag(c).cast("int")), F.lit(0)).cast("long")
        parts.append(rows.agg(F.lit(recorded).alias("column"), count(x.isNotNull() & y.isNotNull()).alias("compared"), count(~is_close(x, y, rtol, atol)).alias("mismatches"), count(x.isNull() & y.isNotNull()).alias("unexpected_null"), count(x.isNotNull() & y.isNull()).alias("unexpected_value")))
    return parts[0].unionByName(parts[1])


def adjusted_consistency(panel: DataFrame, rtol: float = 1e-7, atol: float = 1e-8) -> DataFrame:
    """How often ``x_adj`` differs from ``x * adj_factor``, by price."""
    names = [c for c in PRICES if f"{c}_adj" in panel.columns]
    return panel.agg(*[F.coalesce(F.sum(flag(~is_close(F.col(f"{c}_adj"), F.col(c) * F.col("adj_factor"), rtol, atol)).cast("int")), F.lit(0)).cast("long").alias(c) for c in names]).unpivot([], names, "column", "mismatches")


def factor_quality(factors: DataFrame, columns: Sequence[str], high_null: float = 0.95, allowed_constant: Sequence[str] = ()) -> DataFrame:
    """By factor: rows, nulls, NaN, infinities, finite values, range, and what is wrong; one scan for all factors."""
    rows = factors.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "factor", "x")
    inf = F.abs("x") == float("inf")
    good = F.when(~F.isnan("x") & ~inf, F.col("x"))
    n = lambda c: F.coalesce(F.sum(flag(c).cast("int")), F.lit(0)).cast("long")
    out = rows.groupBy("factor").agg(F.count(F.lit(1)).alias("n_rows"), n(F.col("x").isNull()).alias("nulls"), n(F.isnan("x")).alias("nans"), n(inf).alias("infinities"), F.count(good).alias("finite"), F.min(good).alias("low"), F.max(good).alias("high"))
    allowed = F.col("factor").isin(*allowed_constant) if allowed_constant else F.lit(False)
    return out.withColumns({
        "all_null": F.col("finite") == 0,
        "constant": flag(F.col("low") == F.col("high")) & ~allowed,
        "high_null": safe_div((F.col("nulls") + F.col("nans")).cast("double"), F.col("n_rows").cast("double")) > high_null,
    })


def raw_cache_rollup(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("source", "api_name").agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.count(F.lit(1)).alias("shards"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"), F.count_distinct("schema_hash").alias("schemas"))


def latest_by_key(catalog: DataFrame, keys: Sequence[str], stamp: str = "updated_at_utc") -> DataFrame:
    """Upsert: the last entry of each key stays."""
    w = Window.partitionBy(*keys).orderBy(F.desc(stamp))
    return catalog.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cache_anomalies(catalog: DataFrame, anchor: str = "daily") -> DataFrame:
    """Dates of the anchor API for which another API has no shard, or one without rows."""
    dates = catalog.where(F.col("api_name") == anchor).select("source", "trade_date").distinct()
    others = catalog.where(F.col("api_name") != anchor).select("source", "api_name").distinct()
    wanted = dates.join(others, "source")
    got = wanted.join(catalog.select("source", "api_name", "trade_date", "rows"), ["source", "api_name", "trade_date"], "left")
    return got.where("rows is null or rows = 0").withColumn("kind", F.when(F.col("rows").isNull(), "missing").otherwise("zero_rows")).drop("rows")


def key_mismatches(panel: DataFrame, factors: DataFrame) -> DataFrame:
    """Keys of either side that the other lacks: two anti joins."""
    keys = ["date", "ticker"]
    return panel.select(*keys).join(factors, keys, "left_anti").withColumn("side", F.lit("panel")).unionByName(factors.select(*keys).join(panel, keys, "left_anti").withColumn("side", F.lit("factors")))


def enforce(ok: bool, message: str, mode: str = "warn") -> None:
    """off, warn or error."""
    if mode not in ("off", "warn", "error"):
        raise ValueError(f"no mode {mode!r}")
    if not ok and mode == "error":
        raise ValueError(message)
    if not ok and mode == "warn":
        import warnings

        warnings.warn(message, stacklevel=2)


def wanted_dates(days: DataFrame, catalog: DataFrame, api: str, refresh: int = 0) -> DataFrame:
    """The ``trade_date`` of ``days`` that have to be fetched for an api: those without rows in the catalogue, and the last ``refresh`` ones anyway."""
    have = catalog.where(F.col("api_name") == F.lit(api)).select("trade_date").distinct()
    missing = days.select("trade_date").distinct().join(have, "trade_date", "left_anti")
    return missing.union(days.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(refresh)).distinct() if refresh else missing
