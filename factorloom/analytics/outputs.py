"""What a backtest leaves behind: a folder of CSV files and a page of text."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.analytics.performance import hedged, histogram, nav, report
from factorloom.analytics.snapshot import json_safe
from factorloom.config import redacted


def write_csv(results: Mapping[str, DataFrame], path: str) -> list[str]:
    """Each result as CSV with a header below ``path``, in the order of its period; returns the names written."""
    for name, rows in results.items():
        keys = [c for c in ("period", "date", "ticker") if c in rows.columns]
        (rows.orderBy(*keys) if keys else rows).write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/{name}")
    return sorted(results)


def write_run(results: Mapping[str, DataFrame], path: str, *, benchmark: DataFrame | None = None, settings: Mapping[str, object] | None = None, title: str = "Backtest", per_year: float = 12.0) -> dict[str, object]:
    """All that a run leaves: its tables, NAV and drawdown, hedged returns with residuals and their histogram, metrics as CSV, JSON and text; returns the metrics."""
    returns = results["returns"].select(F.lit("strategy").alias("series"), F.col("period").alias("date"), F.col("net_return").alias("ret"))
    metrics = report(results, benchmark, per_year)
    tables = dict(results) | {"nav": nav(returns), "metrics": metrics, "return_histogram": histogram(returns, "ret")}
    if benchmark is not None:
        against = hedged(returns, benchmark)
        tables |= {"hedged": against, "benchmark_nav": nav(benchmark.withColumn("series", F.lit("benchmark"))), "residual_histogram": histogram(against, "residual")}
    write_csv(tables, path)
    figures = {r["metric"]: r["value"] for r in metrics.collect()}
    spark = metrics.sparkSession
    for name, text in (("metrics_json", json.dumps(json_safe(figures), sort_keys=True)), ("summary_txt", summary(title, figures, settings)), ("settings_json", json.dumps(json_safe(redacted(dict(settings or {}))), sort_keys=True))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/{name}")
    return figures


def summary(title: str, metrics: Mapping[str, object], settings: Mapping[str, object] | None = None) -> str:
    """A heading, the settings and the figures, one a line; numbers to six digits, absent ones as a dash."""

    def line(k, v):
        return f"{k}: {'-' if v is None else f'{v:.6g}' if isinstance(v, float) else v}"

    parts = [title, "=" * len(title)]
    if settings:
        parts += ["", "Settings", *(line(k, settings[k]) for k in sorted(settings))]
    return "\n".join([*parts, "", "Figures", *(line(k, v) for k, v in metrics.items())]) + "\n"
