"""Exact top-k inner products over integer vectors by MaxScore."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import saved


#: Products and sums of whole numbers stay exact in 64-bit floats below this.
EXACT = 2.0**53
LONG = 2**63 - 1


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component, as double; null if the vector or a component is null or not finite, before or after scaling."""
    x = F.transform(vector, lambda v: v.cast("double") * scale)
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    # doubles of 2^53 and more are whole, and floor() would force them into a long
    return F.when(fine, F.transform(x, lambda v: F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v)))


class Best:
    """The k best candidates so far of each query of a block, ties to the smaller id; rows come in batches."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.score = [np.empty(0) for _ in ids]
        self.found = [np.empty(0, np.int64) for _ in ids]
        self.most = np.abs(queries).max(1) if queries.size else np.zeros(len(ids))

    def least(self, q: int) -> float:
        """What a row must reach to be among the k best of query q."""
        return self.score[q][-1] if len(self.score[q]) == self.k else -np.inf

    def merge(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.append(self.score[q], score), np.append(self.found[q], ids)
        top = np.lexsort((i, -s))[: self.k]
        self.score[q], self.found[q] = s[top], i[top]

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """A batch of rows, by MaxScore.

        A term is a component.  Its impact ``q * (x - low)`` (or ``-q * (high - x)`` for a
        negative q) is never negative and at most ``abs(q) * (high - low)``; the offsets sum to a
        constant of the query.  Terms without which no row of the batch can reach the k-th score are essential: their
        postings, which for dense vectors are columns, are traversed, and the other terms are
        probed, the largest bound first, only for rows whose score so far plus all
        bounds left can still reach it.
        """
        low, high = rows.min(0), rows.max(0)
        span = high - low
        limit = rows.shape[1] * max(np.abs(low).max(), np.abs(high).max())
        for q, qf in enumerate(self.queries):
            others = ids != self.ids[q]
            least = self.least(q)
            if 4 * limit * self.most[q] >= EXACT or self.score[q].dtype == object:  # beyond exact floats: whole numbers of any size
                self.merge_large(q, ids[others], rows[others])
                continue
            if least == -np.inf:
                self.merge(q, (rows @ qf)[others], ids[others])
                continue
            bound = np.abs(qf) * span
            terms = np.argsort(-bound, kind="stable")
            left = np.append(np.cumsum(bound[terms][::-1])[::-1], 0.0)  # of the terms from here on
            base = np.where(qf >= 0, qf * low, qf * high)  # the least that each term adds
            base_left = np.append(np.cumsum(base[terms][::-1])[::-1], 0.0)
            cut = min(len(terms), int(np.searchsorted(-left, -(least - base_left[0]), side="right")))
            if not cut:  # all terms together can't reach it
                continue
            score = rows[:, terms[:cut]] @ qf[terms[:cut]]
            at = np.flatnonzero((score + base_left[cut] + left[cut] >= least) & others)
            score = score[at]
            while cut < len(terms) and len(at):
                more = terms[cut : cut + 8]
                score = score + rows[np.ix_(at, more)] @ qf[more]
                cut += len(more)
                fit = score + base_left[cut] + left[cut] >= least
                at, score = at[fit], score[fit]
            if len(at):
                self.merge(q, score, ids[at])

    def merge_large(self, q: int, ids: np.ndarray, rows: np.ndarray) -> None:
        whole = [int(v) for v in self.queries[q]]
        scores = [sum(a * int(b) for a, b in zip(whole, r, strict=True)) for r in rows.tolist()]
        s, i = np.append(self.score[q].astype(object), np.array(scores, object)), np.append(self.found[q], ids)
        top = sorted(range(len(s)), key=lambda j: (-int(s[j]), i[j]))[: self.k]
        s, self.found[q] = s[top], i[top]
        self.score[q] = s  # later batches are compared as whole numbers too

    def rows(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """``(query, id, score)`` of all, queries by their place; scores are held within a long."""
        place = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.found])
        score = [max(-LONG - 1, min(LONG, int(v))) for x in self.score for v in x]
        return place, np.concatenate([*self.found, np.empty(0, np.int64)]), score


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, batch_rows: int = 4096, block_bytes: int = 32 << 20) -> DataFrame:
    """``(query_id, rank, id, score)``: the k best rows of ``vectors`` for each row of ``queries``.

    Queries go in blocks of about ``block_bytes``, dealt by hash: one block at a time is broadcast, so what is sent has that bound whatever their number.
    For each block all vectors are scanned where they lie, without a shuffle; a task is a shard that streams its
    rows in batches and holds the k best of each query, and these alone are shuffled and merged.
    A row is not a candidate for a query with its own id.  Equal scores rank by the
    smaller id.  Vectors that are null, hold a null or non-finite component (or one that is beyond doubles when scaled), and
    rows with a null id, take no part; vectors of another length than the query
    never meet it.  Repeated ids are rows of their own as candidates; queries with one id and different vectors each have their ranks,
    while equal ones (same id and vector) count once.  Scores are exact, of components of any size; those beyond a long are given as
    its end.  Without queries or vectors there are no rows.
    """
    spark = vectors.sparkSession
    unit = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("id"), quantised(F.col(f"`{vector_col}`"), scale).alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows, asked = unit(vectors), saved(unit(queries).distinct().withColumn("key", F.xxhash64("id", "v")), "queries")
    lengths = asked.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("m")).orderBy("dim").collect()
    blocks = [(r["dim"], b, n) for r in lengths for n in [max(1, -(-r["m"] * r["dim"] * 8 // block_bytes))] for b in range(n)]
    parts = []
    for dim, b, n in blocks:
        same = F.size("v") == dim
        block = asked.where(same & (F.pmod("key", F.lit(n)) == b)).toPandas()
        if len(block):
            sent = spark.sparkContext.broadcast((block["id"].to_numpy(np.int64), block["key"].to_numpy(np.int64), np.stack(block["v"].to_numpy()).astype(np.float64)))
            part = ranked(rows.where(same).mapInArrow(search(sent, k, batch_rows), FOUND), k)
            parts.append(saved(part, "block") if len(blocks) > 1 else part)  # one block at a time
    found = reduce(DataFrame.union, parts) if parts else ranked(spark.createDataFrame([], FOUND), k)
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")


FOUND = "query_id long, query long, id long, score long"


def search(sent, k: int, batch_rows: int):
    """The k best rows of a shard for each query of the block sent."""

    def run(batches):
        ids, keys, queries = sent.value
        best = Best(ids, queries, k)
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                best.add(part.column("id").to_numpy(), part.column("v").flatten().to_numpy().reshape(part.num_rows, -1))
        place, found, score = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(ids[place]), pa.array(keys[place]), pa.array(found), pa.array(score, pa.int64())], names=["query_id", "query", "id", "score"])

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of all shards; ``query`` tells queries of one id apart."""
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
