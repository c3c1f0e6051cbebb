"""Panels of bars by (date, ticker) from trade-like tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Doubles of this size stand 2^-20 apart.
STEPS = 1.5 * 2.0**32


def total(x: Column) -> Column:
    """A sum of doubles in which the order of rows doesn't matter, so that equal trades make equal bars.

    Multiples of 2^-20 and what values have beyond them are added up apart, each without rounding: for four million rows of 1 or
    more, up to 2^33 in all. Beyond that, and for very small values, it is as near as ``sum``.
    """
    small = F.abs(x) < 2.0**31
    whole = F.when(small, x + STEPS - STEPS).otherwise(x)
    return F.sum(whole) + F.sum(F.when(small, x - whole).otherwise(0.0))


def bars(trades: DataFrame, date: Column, ticker: Column, order: Column, price: Column, quantity: Column, value: Column) -> DataFrame:
    """Open, high, low, close, volume, amount and vwap: one aggregation, summed up before its only shuffle."""
    rows = trades.select(date.alias("date"), ticker.alias("ticker"), order.alias("o"), price.alias("p"), quantity.alias("q"), value.alias("v"))
    out = rows.groupBy("date", "ticker").agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("q").alias("volume"), total(F.col("v")).alias("amount")
    )
    return out.withColumn("vwap", F.try_divide("amount", "volume"))


def _lineitem_bars(items: DataFrame, date: Column, ticker: Column) -> DataFrame:
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    price = F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")
    return bars(items, date, ticker, order, price, F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars by month of shipping and supplier."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return _lineitem_bars(items, F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).cast("timestamp_ntz"), F.col("l_suppkey"))


def daily_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars by day of shipping and the supplier's region: thousands of dates, for long look-backs."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    home = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = items.join(home.select("s_suppkey", "n_regionkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return _lineitem_bars(rows, F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).cast("timestamp_ntz"), F.col("n_regionkey"))
