"""Mixing sources to target weights over a time-varying curriculum, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import WORD, saved
from factorloom.llm.merkle import field


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float, source_col: str = "source") -> DataFrame:
    """``(source, source_size, weight, target)``: ``share`` of all sizes by weight, no target above ``most`` times its source's size.

    Resharing the excess until none is above ends at ``target = min(most * size,
    level * weight)``.  The capped sources are those with the smallest ``most *
    size / weight``, so one running sum in that order finds the level.  Only one
    row a source is ever in one place.
    """
    per = sizes.groupBy(source_col).agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.select(source_col, "source_size", F.element_at(cycle, (place % len(weights) + 1).cast("int")).alias("weight"))
    cap = F.col("source_size") * F.lit(float(most))
    every, order = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("ratio", F.col(source_col).asc_nulls_last())
    per = per.withColumns({"cap": cap, "ratio": cap / F.col("weight")})
    per = per.withColumns({
        "budget": F.sum("source_size").over(every) * F.lit(float(share)),
        "before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    # level if all sources before this one are capped and this one and those after it are not
    per = per.withColumn("level", (F.col("budget") - F.col("before")) / F.col("left"))
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col(source_col).isNull(), source_col, "level"))).over(every)
    target = F.least(F.col("cap"), F.coalesce(found["level"] * F.col("weight"), F.col("cap")))
    return per.select(source_col, "source_size", "weight", target.alias("target"))


def reached(tokens: Column, target: Column, slope: Column) -> Column:
    """When (0 to 1) a source with demand rate ``target * (1 + slope * (2t - 1))`` has used so many tokens: the inverse of ``demand``."""
    done = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(tokens, target)))
    back = (F.sqrt(F.pow(1 - slope, 2) + 4 * slope * done) - (1 - slope)) / (2 * slope)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.abs(slope) < 1e-9, done).otherwise(back)))


def demand(t: Column, target: Column, slope: Column) -> Column:
    """The tokens that a source has used at time t: the integral of its rate."""
    return target * ((1 - slope) * t + slope * t * t)


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    slopes: Sequence[float] = (0.5, 0.0, -0.5),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    hash_col: str | None = None,
    buckets: int = 4096,
) -> DataFrame:
    """``(id, source, size, source_size, target, taken, position, again_at)`` of every document.

    A source's documents follow each other in an order drawn by hash, twice over;
    the mix takes the first ``target`` words of that sequence.  The
    source's weight runs linearly through training from ``1 - slope`` to ``1 +
    slope`` of its mean.  A document is read from the time at which its source's cumulative demand reaches its
    first word to that at which it reaches its last; ``taken`` is the demand between the two (of a document at the end a part), for
    both readings.  ``position`` is the share of the whole mix, all sources' demand together, that has been read when the document's turn
    comes, ``again_at`` the same for its repetition; null where
    nothing is taken.  So at any position the sources' rates stand as their weights do then.  Sources by code point, null last, take ``weights`` and
    ``slopes`` in turn.

    No source is ever in one task: words are summed by hash bucket first, and the
    running sum inside a bucket starts from that of the buckets before it.  The
    result depends on ids and texts only, so reruns agree.  A null text or one
    without words has size 0 and is not taken; null ids and repeated rows are
    documents of their own (rows alike in id and size are interchangeable); an
    empty table gives no rows; other columns are ignored.  ``hash_col``: what of the id orders a source's documents.  One row a source
    is summed in one task, so there may be millions of sources, not billions.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(hash_col or "id").cast("string"), F.lit("null"))))
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), size_in_words(F.col(f"`{text_col}`")).alias("size"))
    sizes = saved(docs.withColumn("key", key).withColumn("bucket", (F.conv(F.substring("key", 1, 6), 16, 10).cast("long") % buckets).cast("int")), "mix-sizes")
    targets = source_targets(sizes, weights, share, most)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    targets = targets.withColumn("slope", F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), (place % len(slopes) + 1).cast("int")))
    # one row a source: the demand of the whole mix at time t is level * t + rise * t^2
    every = Window.partitionBy(F.lit(0))
    targets = targets.withColumns({"level": F.sum(F.col("target") * (1 - F.col("slope"))).over(every), "rise": F.sum(F.col("target") * F.col("slope")).over(every)})
    # a bucket's start: at most ``buckets`` rows a source, however many documents it has
    per_bucket = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("start")).alias("b")
    starts = starts.join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.*", "source_size", "target", "slope", "level", "rise").alias("b")
    inside = Window.partitionBy("source", "bucket").orderBy("key", hash_col or "id", "size", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d")
    rows = rows.join(starts, F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bucket") == F.col("b.bucket")))
    rows = rows.select("d.id", "d.source", "size", "source_size", "target", "slope", "level", "rise", (F.col("start") + F.col("inside")).alias("at"))
    target, slope = F.col("target"), F.col("slope")
    turns = {"from": F.col("at"), "until": F.col("at") + F.col("size"), "again_from": F.col("at") + F.col("source_size"), "again_until": F.col("at") + F.col("size") + F.col("source_size")}
    rows = rows.select("*", *[reached(x, target, slope).alias(f"t_{n}") for n, x in turns.items()])
    words = lambda t: F.round(demand(F.col(t), target, slope)).cast("long")
    first, second = words("t_until") - words("t_from"), words("t_again_until") - words("t_again_from")
    share = lambda t: F.try_divide(F.col("level") * F.col(t) + F.col("rise") * F.col(t) * F.col(t), F.col("level") + F.col("rise"))
    return rows.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        (first + second).alias("taken"),
        F.when(first > 0, share("t_from")).alias("position"),
        F.when(second > 0, share("t_again_from")).alias("again_at"),
    )


def in_training_order(mixed: DataFrame, *, id_col: str = "doc_id", untaken: bool = False, ordered: bool = True) -> DataFrame:
    """One row for each time that a document is read, range-sorted by position if ``ordered``.

    With ``untaken`` a document that is never read has one row too, of pass 0 and without position, at the end.
    """
    reads = F.filter(F.array(F.struct(F.lit(1).alias("pass"), F.col("position").alias("at")), F.struct(F.lit(2).alias("pass"), F.col("again_at").alias("at"))), lambda x: x["at"].isNotNull())
    if untaken:
        reads = F.when(F.size(reads) > 0, reads).otherwise(F.array(F.struct(F.lit(0).alias("pass"), F.lit(None).cast("double").alias("at"))))
    rows = mixed.withColumn("_read", F.explode(reads)).select(*[c for c in mixed.columns if c not in ("position", "again_at")], F.col("_read.pass").alias("pass"), F.col("_read.at").alias("position"))
    return rows.orderBy(F.col("position").asc_nulls_last(), id_col, "pass") if ordered else rows


#: What ``training_order`` adds to the columns of its documents.
ORDER = ("size", "source_size", "target", "taken", "pass", "position")


def training_order(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents with all their columns and ``ORDER``, a row for each time that one is read, range-sorted by position; those never read at the end.

    A column of ``docs`` named as one of ``ORDER`` gives way to it.  The order is made of ids and sizes alone.  A digest of all columns leads from it
    back to the documents, whose texts are shuffled twice, for the join and for the sort; rows alike in all columns are one there, so none is multiplied.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.md5(F.concat(*[field(F.col(f"`{c}`")) for c in docs.columns])).alias("uid"))
    narrow = rows.select(F.struct("uid", F.col("doc").getField(id_col).alias("id")).alias("id"), F.col("doc").getField(text_col).alias("text"), F.col("doc").getField(source_col).alias("source"))
    order = in_training_order(mix(narrow, id_col="id", hash_col="id.id", **options), id_col="id", untaken=True, ordered=False)
    joined = rows.groupBy("uid").agg(F.first("doc").alias("doc")).join(order.select(F.col("id.uid").alias("uid"), *ORDER), "uid")
    out = joined.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c not in ORDER], *ORDER)
    return out.orderBy(F.col("position").asc_nulls_last(), F.col(f"`{id_col}`"), "pass")
