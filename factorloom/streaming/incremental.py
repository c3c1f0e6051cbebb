"""Bars that land are merged into a store's base; families are brought up to date from their changed chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.sources.store import Store
from factorloom.sources.tables import settled


def merge_batch(store: Store, batch: DataFrame, families: Sequence[str], per_chunk: int = 60, **options) -> dict[str, dict]:
    """New bars replace those of their keys, in the chunks of their dates alone; families follow from the chunks that changed.

    A batch that comes twice changes nothing, so a restarted stream is safe. Refused if the store has families that aren't among ``families``;
    ``options`` are those of ``write_family``.
    """
    store.merge(settled(batch), per_chunk, updating=families)
    return {f: store.write_family(f, **options) for f in families}


def follow(spark: SparkSession, landing: str, schema: str, root: str, checkpoint: str, families: Sequence[str], per_chunk: int = 60):
    """A stream from a folder of Parquet bars; each micro-batch goes through ``merge_batch``."""
    store = Store(spark, root)
    stream = spark.readStream.schema(schema).parquet(landing)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: merge_batch(store, batch, families, per_chunk)).trigger(availableNow=True).start()


def windowed_bars(events: DataFrame, *, time: str, key: str, value: str, every: str, late: str) -> DataFrame:
    """Bars of a stream (or table) of prices by event time, with a watermark for late ones."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), F.col(key).alias("ticker"))
    out = rows.agg(F.min_by(value, time).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, time).alias("close"), F.count(F.lit(1)).alias("volume"))
    return out.select(F.col("w.start").alias("date"), "ticker", "open", "high", "low", "close", "volume")
