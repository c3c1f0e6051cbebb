"""Exact quantiles of very many columns: histograms of ever finer buckets around each wanted rank, then the few values left."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.sources.tables import settled


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """64-bit numbers in the order of the doubles; -0 is 0."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def from_bits(key: np.ndarray) -> np.ndarray:
    return np.where(key >> np.uint64(63) == 1, key & np.uint64((1 << 63) - 1), ~key).view(np.float64)


@dataclass
class Target:
    """A wanted value: the column, its rank inside the bucket ``prefix`` of ``depth`` leading bits, and how many values that holds."""

    column: int
    rank: int
    prefix: int = 0
    depth: int = 0
    size: int = 1 << 62


def within(key: np.ndarray, prefix: int, depth: int) -> np.ndarray:
    return key if depth == 0 else key[key >> np.uint64(64 - depth) == np.uint64(prefix)]


def _values(batch: pa.RecordBatch, i: int) -> np.ndarray:
    """The known values of a column; NaN is none."""
    x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
    return x[~np.isnan(x)]


def _histogram(rows: DataFrame, buckets: Sequence[tuple[int, int, int]], step: int) -> DataFrame:
    """``(c, prefix, bucket, n)`` of the (column, prefix, depth) buckets: how many values have each of the next ``step`` bits.

    A task holds 2**step counts for each, whatever its rows, and sends those that aren't 0.
    """
    columns = sorted({c for c, _, _ in buckets})
    place = {c: i for i, c in enumerate(columns)}
    buckets = list(buckets)

    def count(batches):
        counts = [np.zeros(1 << step, np.int64) for _ in buckets]
        for batch in batches:
            keys = {c: ordered_bits(_values(batch, place[c])) for c in columns}
            for (c, prefix, depth), have in zip(buckets, counts, strict=True):
                wide = min(step, 64 - depth)
                digit = within(keys[c], prefix, depth) >> np.uint64(64 - depth - wide) & np.uint64((1 << wide) - 1)
                have += np.bincount(digit.astype(np.int64), minlength=1 << step)
        for (c, prefix, _), have in zip(buckets, counts, strict=True):
            at = np.flatnonzero(have)
            signed = prefix - (1 << 64) if prefix >> 63 else prefix
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(np.full(len(at), signed, np.int64)), pa.array(at.astype(np.int32)), pa.array(have[at])], names=["c", "prefix", "bucket", "n"])

    found = rows.select(*[F.col(f"`{rows.columns[c]}`") for c in columns]).mapInArrow(count, "c int, prefix long, bucket int, n long")
    return found.groupBy("c", "prefix", "bucket").agg(F.sum("n").alias("n"))


def _left(rows: DataFrame, buckets: Sequence[tuple[int, int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """The values of small buckets, sorted."""
    columns = sorted({c for c, _, _ in buckets})
    place = {c: i for i, c in enumerate(columns)}
    buckets = list(buckets)

    def pick(batches):
        for batch in batches:
            keys = {c: ordered_bits(_values(batch, place[c])) for c in columns}
            for b, (c, prefix, depth) in enumerate(buckets):
                key = within(keys[c], prefix, depth)
                if len(key):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), b, np.int32)), pa.array(from_bits(key))], names=["b", "x"])

    found = rows.select(*[F.col(f"`{rows.columns[c]}`") for c in columns]).mapInArrow(pick, "b int, x double").toPandas()
    return {buckets[b][:2]: np.sort(part.to_numpy()) for b, part in found.groupby("b")["x"]}


def quantiles(frame: DataFrame, columns: Sequence[str], at: Sequence[float] = (0.5,), *, step: int = 11, few: int = 64) -> dict[str, list[float | None]]:
    """For each column its quantiles ``at``, interpolated between neighbours; None without a value. Nulls and NaN don't count.

    All columns are refined together: a pass counts, in each wanted bucket, the values by the next ``step`` bits of their order, and
    keeps the bucket that holds the rank; once a bucket has ``few`` values these are looked at themselves. Two or three passes do for most tables, six and
    no look at values for any, ties included. A task holds 2**step counts a bucket, the driver one number a quantile and ``few`` values at most, whatever the rows.
    Each pass reads the columns again, so ``frame`` should be a table or cheap.
    """
    if bad := [q for q in at if not 0 <= q <= 1]:
        raise ValueError(f"no quantiles at {bad}")
    rows = frame.select(*[F.col(f"`{c}`").cast("double") for c in columns])
    if not columns or not at:
        return {c: [] for c in columns}
    spark = frame.sparkSession
    first = settled(_histogram(rows, [(i, 0, 0) for i in range(len(columns))], step))
    total = {r["c"]: r["n"] for r in first.groupBy("c").agg(F.sum("n").alias("n")).collect()}
    targets: dict[tuple[int, int], Target] = {}
    for i, n in total.items():
        for q in at:
            for rank in (int(np.floor((n - 1) * q)), int(np.ceil((n - 1) * q))):
                targets[i, rank] = Target(i, rank, size=n)
    going, hist = list(targets.values()), first
    while going:
        names = {(t.column, t.prefix, t.depth) for t in going}
        if hist is None:
            hist = _histogram(rows, sorted(names), step)
        signed = lambda p: p - (1 << 64) if p >> 63 else p
        wanted = spark.createDataFrame([(k, t.column, signed(t.prefix), t.rank) for k, t in enumerate(going)], "k int, c int, prefix long, rank long")
        before = F.sum("n").over(Window.partitionBy("c", "prefix").orderBy("bucket")) - F.col("n")  # 2**step rows at most
        spots = hist.withColumn("before", before).join(F.broadcast(wanted), ["c", "prefix"]).where("before <= rank and rank < before + n")
        for r in spots.select("k", "bucket", "before", "n").collect():
            t = going[r["k"]]
            wide = min(step, 64 - t.depth)
            t.prefix, t.depth, t.rank, t.size = t.prefix << wide | r["bucket"], t.depth + wide, t.rank - r["before"], r["n"]
        going, hist = [t for t in going if t.depth < 64 and t.size > few], None
    rest = {(t.column, t.prefix, t.depth) for t in targets.values() if t.depth < 64}
    left = _left(rows, sorted(rest)) if rest else {}
    value = lambda t: float(left[t.column, t.prefix][t.rank]) if t.depth < 64 else float(from_bits(np.array([t.prefix], np.uint64))[0])
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        out[c] = []
        for q in at:
            if i not in total:
                out[c].append(None)
                continue
            spot = (total[i] - 1) * q
            ranks = int(np.floor(spot)), int(np.ceil(spot))
            low, high = (value(targets[i, k]) for k in ranks)
            out[c].append(low if ranks[0] == ranks[1] or low == high else low + (high - low) * (spot - ranks[0]))
    return out
