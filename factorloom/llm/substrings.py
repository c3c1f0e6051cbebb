"""Substring dedup over a log-structured index of window fingerprints."""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.llm.common import WordHashes, delete, i64, join_by_frequency, new_path, rolling, slices, words

GRAM = 16  # words of the grams whose smallest hash stands for a window
RUN = "fp long, ctx long, id {0}, row int, a int, b int"


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The place of the first smallest value in each window, by doubling."""
    n = len(x) - width + 1
    value, place, size = x, np.arange(len(x)), 1

    def both(v, p, w, q):
        less = w < v
        return np.where(less, w, v), np.where(less, q, p)

    while size * 2 <= width:
        value, place = both(value[:-size], place[:-size], value[size:], place[size:])
        size *= 2
    if rest := width - size:
        value, place = both(value[:n], place[:n], value[rest : rest + n], place[rest : rest + n])
    return place[:n]


def hashed(parts: list[list[bytes]], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of many texts, one after another, and each text's words."""
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.fromiter(map(hashes.__getitem__, chain.from_iterable(parts)), np.uint64, int(sizes.sum())), sizes


def content(parts: list[bytes], first: np.ndarray, last: np.ndarray) -> list[int]:
    """64-bit hashes of the words themselves, from each first to each last one."""
    data = memoryview(b" ".join(parts))
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    return [xxhash.xxh3_64_intdigest(data[i:j], 3) - (1 << 63) for i, j in zip((end - size)[first].tolist(), end[last].tolist(), strict=True)]


def stretches(h: np.ndarray, sizes: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """Windows with the same smallest gram, as ranges ``a`` to ``b`` of starts in text ``doc``; ``fp`` hashes the gram."""
    if len(h) < width:
        return {k: np.empty(0, np.int64) for k in ("doc", "a", "b", "fp")}
    grams = rolling(h, min(GRAM, width))
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(h) - width + 1]
    ends = np.cumsum(sizes)
    start = np.flatnonzero(np.arange(len(doc)) + width <= ends[doc])
    place, doc = smallest(grams, width - min(GRAM, width) + 1)[start], doc[start]
    new = np.append(True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])) if len(start) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start))[: len(first)] - 1
    a, b, doc = start[first], start[last], doc[first]
    base = (ends - sizes)[doc]
    return {"doc": doc, "a": a - base, "b": b - base, "fp": grams[place[first]] if len(first) else np.empty(0, np.uint64)}


def with_row(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` tells rows of one id but other texts apart."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.hash(F.col(f"`{text_col}`")).alias("row"), F.col(f"`{text_col}`").alias("text"))


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """``(fp, ctx, id, row, a, b)`` of each stretch of windows in ``(id, row, text)`` rows; ``ctx`` hashes all words that its windows cover."""

    def cut(batches):
        hashes = WordHashes()
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                parts = [words(t) for t in batch.column("text").to_pylist()]
                s = stretches(*hashed(parts, hashes), width)
                at, ctx = pa.array(s["doc"]), []
                cuts = np.searchsorted(s["doc"], np.arange(len(parts) + 1))
                for i in np.flatnonzero(np.diff(cuts)).tolist():
                    mine = slice(cuts[i], cuts[i + 1])
                    ctx += content(parts[i], s["a"][mine], s["b"][mine] + width - 1)
                yield pa.RecordBatch.from_arrays([i64(s["fp"]), pa.array(ctx, pa.int64()), batch.column("id").take(at), batch.column("row").take(at), pa.array(s["a"].astype(np.int32)), pa.array(s["b"].astype(np.int32))], names=["fp", "ctx", "id", "row", "a", "b"])

    return docs.where("id is not null and text is not null").mapInArrow(cut, RUN.format(dict(docs.dtypes)["id"]))


def exact_windows(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(key, check, id, row, start, new)`` of every window in the wanted ranges ``(id, row, a, b, new)``: a hash of its words' hashes and one of the words themselves."""
    kind = dict(docs.dtypes)["id"]
    ranges = wanted.groupBy("id", "row").agg(F.collect_list(F.struct("a", "b", "new")).alias("ranges"))
    rows = by_small_side(docs, ranges, "inner").select("id", "row", "text", "ranges")

    def cut(batches):
        hashes = WordHashes()
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                parts = [words(t) for t in batch.column("text").to_pylist()]
                h, sizes = hashed(parts, hashes)
                base = np.cumsum(sizes) - sizes
                doc, start, new, check = [], [], [], []
                for i, found in enumerate(batch.column("ranges").to_pylist()):
                    own = {s: r["new"] for r in found for s in range(r["a"], r["b"] + 1)}
                    doc += [i] * len(own)
                    start += own.keys()
                    new += own.values()
                    if own:
                        places = np.fromiter(own, np.int64, len(own))
                        check += content(parts[i], places, places + width - 1)
                doc, start = np.array(doc, np.int64), np.array(start, np.int64)
                at = start + base[doc]
                key = rolling(h, width)[at] if len(at) else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays([i64(key), pa.array(check, pa.int64()), batch.column("id").take(pa.array(doc)), batch.column("row").take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(new, pa.bool_())], names=["key", "check", "id", "row", "start", "new"])

    return rows.mapInArrow(cut, f"key long, check long, id {kind}, row int, start int, new boolean")


def by_small_side(docs: DataFrame, side: DataFrame, how: str, most_bytes: int = 32 << 20) -> DataFrame:
    """Documents joined to the ``ranges`` of some of them; texts are not shuffled while ``side``, which is saved, is of at most ``most_bytes``."""
    side = temporary(side, "by-document")
    size = side.agg(F.sum(F.lit(96) + F.size("ranges") * 32)).first()[0] or 0
    return docs.join(F.broadcast(side) if size <= most_bytes else side, ["id", "row"], how)


def merged(ranges: DataFrame) -> DataFrame:
    """Ranges of a document that touch or overlap as one."""
    order = Window.partitionBy("id", "row").orderBy("a", "b")
    ranges = ranges.withColumn("reach", F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    ranges = ranges.withColumn("part", F.sum(F.when(F.col("a") <= F.col("reach") + 1, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranges.groupBy("id", "row", "part").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("part")


_temporary: list[str] = []


def temporary(df: DataFrame, name: str) -> DataFrame:
    """``saved``, until ``forget``: an index is done with them when a batch's ranges are written."""
    path = new_path(df.sparkSession, name)
    _temporary.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    while _temporary:
        delete(spark, _temporary.pop())


def first_of(rows: DataFrame) -> DataFrame:
    """The first place of each stretch, its largest id and how often it stands."""
    found = rows.groupBy("fp", "ctx").agg(F.min(F.struct("id", "row", "a", "b")).alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    return found.select("fp", "ctx", "first.*", "last", "n")


class Index:
    """Sorted, immutable runs of the stretches of windows that documents have shown so far, each with the place where it was first seen.

    A run is one batch: a Parquet table bucketed by fingerprint into ``parts`` files, each sorted, so a batch, written in the same way, is merged with all
    runs file by file, and no run is ever shuffled again.  The few fingerprints that are in very many stretches are kept aside in a table of their own without
    buckets.  ``compact`` merges the runs file by file into one once there are more than ``most_runs``.

    Batches of one table come in order of their ids; what is in the index is earlier than any batch, whatever its ids.

    ``folder`` (a URI that driver and executors share) keeps an index: runs, the texts that matches are verified with, and a manifest, of which each
    version is a new file written when all it names is there.  An index opened on the folder, by another job too, goes on from the newest one.
    """

    def __init__(self, spark: SparkSession, width: int = 50, folder: str | None = None, most_runs: int = 4, parts: int | None = None):
        self.spark, self.most_runs = spark, most_runs
        self.folder = folder or new_path(spark, "substring-index")
        known = self._manifest() if folder else None
        if known and known["width"] != width:
            raise ValueError(f"the index in {folder} has windows of {known['width']} words, not {width}")
        self.width = width
        self.parts = known["parts"] if known else parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.kind = known["kind"] if known else None
        self.runs: list[str] = known["runs"] if known else []
        self.kept: list[str] = known["kept"] if known else []
        self.version = known["version"] if known else 0
        self.next = known["next"] if known else 0
        for run in self.runs:
            self._register(run)

    def _manifest(self) -> dict | None:
        try:
            rows = self.spark.read.text(f"{self.folder}/manifest/*").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return max((json.loads(r[0]) for r in rows), key=lambda m: m["version"], default=None)

    def commit(self) -> None:
        """Writes the manifest's next version."""
        self.version += 1
        state = {"version": self.version, "width": self.width, "parts": self.parts, "kind": self.kind, "runs": self.runs, "kept": self.kept, "next": self.next}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.folder}/manifest/{self.version:08d}")

    def _columns(self) -> str:
        return RUN.format(self.kind) + f", last {self.kind}, n long, seq int"

    def _table(self, run: str) -> str:
        return f"substring_{run.replace('-', '_')}"

    def _register(self, run: str) -> None:
        """Tells Spark of a run's buckets, where another session has written it."""
        columns = ", ".join(f"`{c.split()[0]}` {c.split(' ', 1)[1]}" for c in self._columns().split(", "))
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._table(run)} ({columns}) USING parquet CLUSTERED BY (fp) SORTED BY (fp, ctx) INTO {self.parts} BUCKETS LOCATION '{self.folder}/{run}/cold'")

    def cold(self, run: str) -> DataFrame:
        return self.spark.table(self._table(run))

    def hot(self, run: str) -> DataFrame:
        return self.spark.read.schema(self._columns()).parquet(f"{self.folder}/{run}/hot")

    def _write(self, cold: DataFrame, hot: DataFrame) -> str:
        """A new run; rows of ``cold`` are in ``parts`` partitions by fingerprint already."""
        run = f"run-{uuid.uuid4().hex}"
        columns = [c.split()[0] for c in self._columns().split(", ")]
        hot.select(*columns).write.parquet(f"{self.folder}/{run}/hot")
        cold.select(*columns).sortWithinPartitions("fp", "ctx").write.bucketBy(self.parts, "fp").sortBy("fp", "ctx").option("path", f"{self.folder}/{run}/cold").saveAsTable(self._table(run))
        return run

    def drop(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(run)}")
            delete(self.spark, f"{self.folder}/{run}")

    def close(self) -> None:
        """Forgets the tables' names; files stay."""
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(run)}")

    def keep(self, rows: DataFrame) -> None:
        """Keeps ``(id, row, text)`` rows, for matches with tables that are added later."""
        path = f"{self.folder}/texts-{uuid.uuid4().hex}"
        rows.where("id is not null and text is not null").write.parquet(path)
        self.kept.append(path)

    def with_kept(self, rows: DataFrame) -> DataFrame:
        return rows.union(self.spark.read.schema(rows.schema).parquet(*self.kept)) if self.kept else rows

    def compact(self) -> None:
        """One run in place of all: the earliest place of each stretch.  Buckets are merged where they lie."""
        old = self.runs
        merged = lambda rows: rows.groupBy("fp", "ctx").agg(F.min(F.struct("seq", "id", "row", "a", "b")).alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).select("fp", "ctx", "first.*", "last", "n")
        if len(old) > 1:
            self.runs = [self._write(merged(reduce(DataFrame.union, map(self.cold, old))), merged(reduce(DataFrame.union, map(self.hot, old))))]
            self.commit()
            self.drop(old)

    def add(self, batch: DataFrame, texts: DataFrame) -> DataFrame:
        """Adds ``(id, row, text)`` rows; the saved ranges ``(id, row, a, b)`` of window starts that an earlier document has.

        1. Each distinct stretch of the batch becomes a row of its new run, which is merged with the runs before it, bucket by bucket: fingerprints that two
           documents have are shared.
        2. A stretch that an earlier document has word for word is covered whole.
        3. Where a fingerprint has several surroundings, the windows of each one's first document are taken from the
           texts, and those whose words a smaller id has too are covered.
        """
        self.kind = dict(batch.dtypes)["id"]
        found = temporary(fingerprints(batch, self.width), "stretches")
        total = found.count()
        # a sample only says which fingerprints lie aside; any choice gives the same result, and it is bounded
        often = found.sample(0.02, seed=1).groupBy("fp").agg(F.count(F.lit(1)).alias("seen")).where((F.col("seen") >= 8) & (F.col("seen") * 1000 > F.lit(total * 0.02))).orderBy(F.desc("seen"), "fp").limit(1000)
        often = F.broadcast(temporary(often.select("fp"), "often"))
        seq = F.lit(self.next).alias("seq")
        cold = first_of(found.join(often, "fp", "left_anti").repartition(self.parts, "fp")).select("*", seq)
        run = self._write(cold, first_of(found.join(often, "fp", "left_semi")).select("*", seq))
        cold, hot = self.cold(run), self.hot(run)
        earlier = [part for old in self.runs for part in self._met(old, cold, hot)]
        columns = ["fp", "ctx", "seq", "id", "row", "a", "b"]
        history = temporary(reduce(DataFrame.union, [e.select(*columns) for e in earlier]), "history") if earlier else None
        by_print = lambda rows: rows.groupBy("fp").agg(F.min("id").alias("low"), F.max("last").alias("high")).where("low <> high").select("fp")
        shared = by_print(cold).union(by_print(hot))
        if history is not None:
            shared = shared.union(history.select("fp")).distinct()
        shared = temporary(shared, "shared")
        own = cold.join(shared, "fp", "left_semi").union(hot.join(F.broadcast(hot.select("fp").distinct().join(shared, "fp", "left_semi")), "fp", "left_semi"))
        own = own.select("fp", "ctx", F.struct("id", "row", "a", "b").alias("first"), "n")
        if history is None:
            firsts = own.withColumn("new", F.lit(True))
        else:
            known = history.groupBy("fp", "ctx").agg(F.min(F.struct("seq", "id", "row", "a", "b")).alias("f")).select("fp", "ctx", F.struct("f.id", "f.row", "f.a", "f.b").alias("known"))
            firsts = own.join(known, ["fp", "ctx"], "full").select("fp", "ctx", F.coalesce("known", "first").alias("first"), F.coalesce("n", F.lit(0)).alias("n"), F.col("known").isNull().alias("new"))
        firsts = temporary(firsts, "firsts")
        # stretches at several places, or known ones: their places in the batch; a stretch at one place is at its first
        several = temporary(firsts.where("n > 1 or not new and n > 0").select("fp", "ctx", "n", F.col("first.id").alias("first_id"), "new"), "several")
        placed = join_by_frequency(found, several, ["fp", "ctx"])
        covered = F.when(F.col("new"), F.col("id") > F.col("first_id")).otherwise(F.col("id") != F.col("first_id"))
        placed = temporary(placed.select("fp", "id", "row", "a", "b", covered.alias("covered"), "new"), "placed")
        ranges = placed.where("covered").select("id", "row", "a", "b")
        unclear = firsts.groupBy("fp").agg(F.min("ctx").alias("low"), F.max("ctx").alias("high"), F.max("new").alias("new")).where("low <> high and new").select("fp")
        wanted = placed.where("not covered and new").select("fp", "id", "row", "a", "b", F.lit(True).alias("new"))
        wanted = wanted.union(firsts.where("new and n = 1").select("fp", "first.*", F.lit(True)))
        if history is not None:
            wanted = wanted.union(firsts.where("not new").select("fp", "first.*", F.lit(False)))
        wanted = wanted.join(temporary(unclear, "unclear"), "fp", "left_semi").select("id", "row", "a", "b", "new")
        windows = temporary(exact_windows(texts, wanted, self.width), "windows")
        least = windows.groupBy("key", "check").agg(F.min(F.struct("new", "id")).alias("first"), F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")).where("least <> most")
        least = temporary(least.select("key", "check", (~F.col("first.new")).alias("old"), F.col("first.id").alias("least"), "n"), "least")
        verified = join_by_frequency(windows.where("new"), least, ["key", "check"]).where(F.when(F.col("old"), F.col("id") != F.col("least")).otherwise(F.col("id") > F.col("least")))
        ranges = ranges.union(verified.select("id", "row", F.col("start").alias("a"), F.col("start").alias("b")))
        path = new_path(self.spark, "ranges")
        ranges.write.parquet(path)
        forget(self.spark)
        self.runs.append(run)
        self.next += 1
        if len(self.runs) > self.most_runs:
            self.compact()
        return self.spark.read.schema(ranges.schema).parquet(path)

    def _met(self, run: str, cold: DataFrame, hot: DataFrame) -> list[DataFrame]:
        """The rows of an earlier run whose fingerprints the new one has: buckets against buckets, and the few that lie aside in either by broadcasts."""
        old, aside = self.cold(run), self.hot(run)
        few = lambda rows: F.broadcast(rows.select("fp").distinct())  # noqa: E731  at most 1000 a run
        in_new = cold.select("fp").union(hot.select("fp")).join(few(aside), "fp", "left_semi")
        return [old.join(cold.select("fp"), "fp", "left_semi"), old.join(few(hot), "fp", "left_semi"), aside.join(few(in_new), "fp", "left_semi")]


def kept_words(docs: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """``(id, n_words, n_removed, kept)`` of ``(id, row, text)`` rows: words that none of the windows covers, joined by a space."""
    kind = dict(docs.dtypes)["id"]
    lists = merged(ranges).groupBy("id", "row").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    rows = by_small_side(docs, lists, "left").select("id", "text", "ranges")

    def cut(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                n, gone, kept = [], [], []
                for text, found in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                    parts = words(text)
                    n.append(len(parts))
                    if found:
                        edge = np.zeros(len(parts) + 1, np.int64)
                        np.add.at(edge, [r["a"] for r in found], 1)
                        np.add.at(edge, [r["b"] + width for r in found], -1)
                        keep = np.cumsum(edge[:-1]) == 0
                        gone.append(int(len(parts) - keep.sum()))
                        parts = [parts[i] for i in np.flatnonzero(keep).tolist()]
                    else:
                        gone.append(0)
                    kept.append(b" ".join(parts))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())], names=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.mapInArrow(cut, f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame, *, width: int = 50, batches: int = 3, most_runs: int = 1, id_col: str = "doc_id", text_col: str = "text", index: Index | None = None) -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256, kept)``: every text less the words of windows that a document with a smaller id has too.

    Documents go through the index in ``batches`` ranges of ids, smallest first, so each meets the runs of
    those before it; more than ``most_runs`` runs are compacted.  Stretches, not windows, are shuffled: about one row for 18 words; windows only where a
    match has to be verified.  A passage in very many documents is counted by aggregation and never paired.

    An ``index`` that is handed in holds the tables before this one, which are earlier whatever their ids, and their texts;
    this table is added to it.

    Null texts have no words; fewer than ``width`` words make no window; documents with a null id are
    returned as they are; rows of one id neither remove from each other nor count as one; repeated rows are alike in result; other columns are ignored;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = with_row(docs, id_col, text_col)
    lasting = index is not None
    index = index or Index(spark, width, most_runs=most_runs)
    texts = index.with_kept(rows)
    at = [(i + 1) / batches for i in range(batches - 1)]
    cuts = rows.agg(F.percentile_approx("id", at, 1000).alias("cuts")).first()["cuts"] if at else []
    cuts = sorted(set(cuts or []))
    ranges = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = rows
        if low is not None:
            batch = batch.where(F.col("id") > F.lit(low))
        if high is not None:
            batch = batch.where(F.col("id") <= F.lit(high))
        found = index.add(batch, texts)
        ranges = found if ranges is None else ranges.union(found)
    if lasting:
        index.keep(rows)
        index.commit()
    else:
        index.drop(index.runs)
    return kept_words(rows, ranges, width).withColumnRenamed("id", id_col)
