"""Rows of a source kept by date: only dates that are wanted and not there are fetched, the last ones again if asked for."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.sources.store import Store


class DateCache(Store):
    """A cache below ``root``: ``<api>/w=W/day=D`` and the versioned manifest of the store, which names the W of each day and its rows.

    A version is committed once, when its rows are there: a run that dies leaves the cache as it was, and of two that fill it at once the second starts anew.
    """

    def days(self, api: str) -> dict[str, dict]:
        """By day ``rows``, with 0 for days that were fetched and had none, and where they are."""
        return dict(self.manifest()["families"].get(api, {}).get("days", {}))

    def wanted(self, api: str, dates: DataFrame, refresh: int = 0) -> DataFrame:
        """The distinct ``day`` of ``dates`` that have to be fetched: those not there, and of all the last ``refresh`` anyway; one row a day."""
        if refresh < 0:
            raise ValueError("refresh starts at 0")
        every = dates.select(F.to_date("date").alias("day")).where("day is not null").distinct()
        known = sorted(self.days(api))
        there = F.to_date("day").cast("string").isin(*known) if known else F.lit(False)
        out = every.where(~there)
        if refresh:
            out = out.union(every.orderBy(F.desc("day")).limit(refresh)).distinct()
        return out

    def fill(self, api: str, dates: DataFrame, fetch: Callable[[DataFrame], DataFrame], *, refresh: int = 0, tries: int = 3) -> dict[str, int]:
        """Fetches what is wanted and commits it with the catalogue: ``{"fetched", "rows"}`` of this call.

        ``fetch`` gets the wanted days as a table and returns rows with a ``date``; what it does by day it does in tasks. Rows of a day replace all that the cache had of it;
        rows of days that were not wanted are an error. A day without rows is noted, and not fetched again.
        """
        for left in range(tries - 1, -1, -1):
            manifest = self.manifest()
            days = sorted(str(r[0]) for r in self.wanted(api, dates, refresh).collect())
            if not days:
                return {"fetched": 0, "rows": 0}
            table = self.spark.createDataFrame([(d,) for d in days], "day string").select(F.to_date("day").alias("day"))
            rows = fetch(table).withColumn("day", F.to_date("date"))
            at = uuid.uuid4().hex
            where = f"{self.root}/{api}/w={at}"
            rows.repartition("day").write.option("compression", "zstd").partitionBy("day").parquet(where)
            counts = {str(r["day"]): r["n"] for r in self.spark.read.schema(rows.schema).parquet(where).groupBy("day").agg(F.count(F.lit(1)).alias("n")).collect()}
            if strange := sorted(set(counts) - set(days)):
                raise ValueError(f"{api} gave rows of days that were not wanted: {strange[:5]}")
            entry = manifest["families"].setdefault(api, {"days": {}, "schema": rows.drop("day").schema.simpleString()})
            if entry["schema"] != rows.drop("day").schema.simpleString():
                raise ValueError(f"{api} has other columns now: {rows.drop('day').schema.simpleString()}, not {entry['schema']}")
            entry["days"] |= {d: {"rows": counts.get(d, 0), "at": at} for d in days}
            try:
                self._note(manifest)
                return {"fetched": len(days), "rows": sum(counts.values())}
            except ValueError:
                if not left:
                    raise

    def read(self, api: str, start=None, end=None) -> DataFrame:
        """The rows of an api; days outside the span are not read."""
        days = self.days(api)
        if not days:
            raise ValueError(f"nothing of {api} has been fetched")
        kept = {d: v for d, v in days.items() if v["rows"] and (start is None or d >= str(start)[:10]) and (end is None or d <= str(end)[:10])}
        paths = [f"{self.root}/{api}/w={v['at']}/day={d}" for d, v in kept.items()]
        whole = next((f"{self.root}/{api}/w={v['at']}/day={d}" for d, v in days.items() if v["rows"]), None)
        if whole is None:
            return self.spark.createDataFrame([], self.manifest()["families"][api]["schema"].removeprefix("struct<").removesuffix(">"))
        rows = self.spark.read.parquet(*paths or [whole])
        return rows if paths else rows.where(F.lit(False))
