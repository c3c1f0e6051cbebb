"""Evidence documents: aggregates only, checked before they leave."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.analytics import evidence as ev

#: Keys that would disclose holdings or places; fixed values.
FORBIDDEN = frozenset(["ticker", "tickers", "positions", "weights", "portfolio_weights", "raw_path", "input_path"])


def json_safe(value):
    """Non-finite numbers as null, dates as text."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if value is None or isinstance(value, (bool, int, str)):
        return value
    return str(value)


def audit(document, at: str = "$") -> None:
    """Raises on forbidden keys, non-finite numbers and absolute paths."""
    if isinstance(document, dict):
        for k, v in document.items():
            if k in FORBIDDEN:
                raise ValueError(f"{at}.{k} must not be published")
            audit(v, f"{at}.{k}")
    elif isinstance(document, (list, tuple)):
        for i, v in enumerate(document):
            audit(v, f"{at}[{i}]")
    elif isinstance(document, float) and not math.isfinite(document):
        raise ValueError(f"{at} is not finite")
    elif isinstance(document, str) and (document.startswith("/") or document[1:3] == ":\\"):
        raise ValueError(f"{at} is an absolute path")


def evidence(panel: DataFrame, factors: Sequence[str], target: str, *, groups: int = 5, rule: str = "store", horizon: int = 1, benchmark: DataFrame | None = None, settle=None) -> dict:
    """Header, IC summary, groups, slices and inference of each factor. Only one row a factor (or slice, or group) reaches the driver."""
    if benchmark is not None and target in benchmark.columns:
        raise ValueError("the benchmark's return can't be the forward return")
    rows = ev.long_factors(panel, factors, target, finite_only=rule == "store")
    ic, daily = ev.daily_ic(rows), ev.daily_group_returns(rows, groups, rule)
    if settle:
        ic, daily = settle(ic), settle(daily)
    regime = ev.regimes(ev.checked_benchmark(benchmark)) if benchmark is not None else None
    tests = ev.hac_mean(ic.select("factor", "date", F.col("rank_ic").alias("value")), horizon)
    tests = settle(tests) if settle else tests
    q = ev.q_values(tests.select("factor", "p_value")).drop("p_value")
    head = panel.agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("date").alias("dates"), F.count_distinct("ticker").alias("names")).first().asDict()
    of = lambda df: [r.asDict() for r in df.collect()]
    out = {f: {"groups": [], "slices": []} for f in factors}
    for r in of(ev.ic_summary(ic)):
        out[r.pop("factor")]["ic"] = r
    for r in of(tests.join(q, "factor")):
        out[r.pop("factor")]["inference"] = r
    for r in of(ev.group_returns(daily).orderBy("factor", "group")):
        out[r.pop("factor")]["groups"].append(r)
    for r in of(ev.slices(ic, regime).orderBy("factor", "slice")):
        out[r.pop("factor")]["slices"].append(r)
    statuses = {v["inference"]["status"] for v in out.values()}
    document = json_safe({"kind": "factor_evidence", "version": 1, "dataset": head, "inference": "complete" if statuses == {"complete"} else "partial" if "complete" in statuses else "not_provided", "factors": out})
    audit(document)
    return document
