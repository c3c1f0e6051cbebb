"""Small helpers shared by the operators: words, hashes and tables in shared storage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space, in Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

_own_base: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and all tasks run on this machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_base:
            _own_base[app] = "file://" + tempfile.mkdtemp(prefix="factorloom-")
        base = _own_base[app]
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written as Parquet to the shared folder and read again: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*saved_ones: DataFrame) -> None:
    """Deletes tables that ``saved`` has written and that nothing reads any more."""
    for df in saved_ones:
        delete(df.sparkSession, df._saved_at)


def join_by_frequency(rows: DataFrame, keyed: DataFrame, on: list[str], count: str = "n", share: int = 2000) -> DataFrame:
    """The inner join of ``rows`` with ``keyed``, one saved row for each key that tells in ``count`` how many rows have it.

    Keys of more than one in ``share`` of all counted rows, so fewer than ``share`` keys whatever the input, are
    broadcast: their rows stay where they are.  All others are joined by a shuffle in which no key is large.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * share > F.lit(total)
    often, seldom = F.broadcast(keyed.where(hot)), keyed.where(~hot)
    rest = rows.join(F.broadcast(keyed.where(hot).select(*on)), on, "left_anti")
    return rows.join(often, on).unionByName(rest.join(seldom, on))


def with_only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that other columns, whatever their names, can't clash with those an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def words(text: str | None) -> list[bytes]:
    """bytes.split() parts at exactly the six ASCII white-space bytes that WORD excludes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """64-bit hashes by word; forgets all once it holds ``most`` words, so a task's memory is bounded."""

    def __init__(self, seed: int = 0, most: int = 300_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, parts: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, parts), np.uint64, len(parts))


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(h: np.ndarray, k: int, odd: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all runs of k items, from the items' hashes.  Doubling: a run of 2m combines two runs of m."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    m, out, done, have = np.uint64(odd), None, 0, h
    size = 1
    while True:
        if k & size:  # append this block to what is done
            out = have if out is None else mixed(out[: len(have) - done] * m + have[done:] + np.uint64(size)) if done else have
            done += size
        if done == k:
            return out[: len(h) - k + 1]
        n = len(have) - size
        have = mixed(have[:n] * m + have[size:] + np.uint64(size))
        size *= 2


def i64(a: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark's long."""
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def slices(batch: pa.RecordBatch, column: str, most: int = 16 << 20):
    """Parts of a batch of about ``most`` bytes of text, one row at least: long texts don't pile up in a worker."""
    size = np.diff(np.frombuffer(batch.column(column).buffers()[1], np.int64 if pa.types.is_large_string(batch.schema.field(column).type) else np.int32)[batch.column(column).offset :][: batch.num_rows + 1]) if batch.num_rows else []
    start, held = 0, 0
    for i, n in enumerate(size):
        held += int(n)
        if held >= most:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
