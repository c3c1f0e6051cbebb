"""Scans and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.operators.standardise import between, select_factors

CODECS = ("zstd", "snappy", "gzip", "lz4", "none", "uncompressed")
_base: dict[str, str] = {}


def shared(spark: SparkSession, name: str) -> str:
    """A fresh path in ``spark.checkpoint.dir``; below a temporary folder only where that is unset and all tasks run on this machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _base.setdefault(app, "") or _base.update({app: "file://" + tempfile.mkdtemp(prefix="factorloom-")}) or _base[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The rows written to shared storage and read again: a short plan that outlives executors."""
    path = shared(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of finished jobs, which it does as the driver's JVM collects its garbage; a large driver that has little to do keeps them for long."""
    spark.sparkContext._jvm.System.gc()


def scan_panel(spark: SparkSession, path: str, *, include: Sequence[str] = (), exclude: Sequence[str] = (), drop: Sequence[str] = (), start=None, end=None, base: Sequence[str] | None = None) -> DataFrame:
    """A Parquet or CSV panel: columns by factor prefix, dates by predicate; both reach the scan."""
    if path.rstrip("/").endswith(".csv"):
        frame = spark.read.option("header", True).option("inferSchema", True).csv(path)
    elif path.rstrip("/").endswith((".parquet", ".pq")) or "." not in path.rstrip("/").rsplit("/", 1)[-1]:
        frame = spark.read.parquet(path)
    else:
        raise ValueError(f"not a table that can be read: {path}")
    if include or exclude or drop:
        from factorloom.factors.families import family_of

        factors = [c for c in frame.columns if family_of(c)]
        kept = set(select_factors(factors, include, exclude, drop))
        frame = frame.select(*[c for c in frame.columns if c not in factors or c in kept])
    if base is not None:
        frame = frame.select(*base)
    return between(frame, start, end)


def write_panel(frame: DataFrame, path: str, *, codec: str = "zstd", level: int | None = None, row_group: int | None = None, mode: str = "errorifexists") -> None:
    if codec not in CODECS:
        raise ValueError(f"no codec {codec!r}")
    if level is not None and (level < 1 or codec in ("none", "uncompressed", "snappy")):
        raise ValueError(f"level {level} doesn't go with {codec}")
    if row_group is not None and row_group < 1:
        raise ValueError("row_group starts at 1")
    out = frame.write.mode(mode).option("compression", codec)
    if level is not None:
        out = out.option("parquet.compression.codec.zstd.level", level)
    if row_group is not None:
        out = out.option("parquet.block.size", row_group)
    out.parquet(path)


def rewrite(spark: SparkSession, source: str, target: str, **options) -> int:
    """Reads, writes and compares rows and columns; never in place."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("a table can't be rewritten in place")
    before = spark.read.parquet(source)
    write_panel(before, target, **options)
    after = spark.read.parquet(target)
    n = before.count()
    if after.columns != before.columns or after.count() != n:
        raise ValueError("the copy differs in rows or columns")
    return n


def trade_dates(frame: DataFrame) -> DataFrame:
    return frame.select("date").distinct()


def recent_dates(frame: DataFrame, n: int) -> DataFrame:
    return trade_dates(frame).orderBy(F.desc("date")).limit(n)


def business_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return days.where(F.dayofweek("date").between(2, 6))
