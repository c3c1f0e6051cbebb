"""Commands: ``python -m factorloom.cli <command> --help``."""

from __future__ import annotations

import argparse
import json
import sys


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("factorloom").getOrCreate()


def factor_store(a) -> None:
    from factorloom.sources.store import Store
    from factorloom.sources.tables import scan_panel

    spark = _spark()
    store = Store(spark, a.store)
    if a.panel:
        print(json.dumps({"base": store.write_base(scan_panel(spark, a.panel), a.dates_per_part, updating=a.family)}))
    for f in a.family:
        print(json.dumps({f: store.write_family(f, dtype=a.dtype, overwrite=a.overwrite)}))


def factor_evidence(a) -> None:
    from factorloom.analytics.snapshot import evidence
    from factorloom.factors.families import family_of
    from factorloom.sources.store import Store
    from factorloom.sources.tables import scan_panel, settled

    spark = _spark()
    panel = Store(spark, a.store).load(a.family or None) if a.store else scan_panel(spark, a.panel)
    factors = a.factor or [c for c in panel.columns if family_of(c)]
    print(json.dumps(evidence(panel, factors, a.target, groups=a.groups, horizon=a.horizon, settle=settled), indent=2))


def data_status(a) -> None:
    from factorloom.analytics.quality import enforce, sanity_report
    from factorloom.sources.store import Store
    from factorloom.sources.tables import scan_panel

    spark = _spark()
    out: dict = {"panel": sanity_report(scan_panel(spark, a.panel)).first().asDict()}
    if a.store:
        store = Store(spark, a.store)
        out["store"] = {"families": {f: len(e["columns"]) for f, e in store.manifest()["families"].items()}, "stale": store.stale()}
    bad = [k for k in ("duplicate_keys", "non_positive_prices", "negative_volume", "high_below_low") if out["panel"][k]] + out.get("store", {}).get("stale", [])
    print(json.dumps(out | {"issues": bad}, default=str, indent=2))
    enforce(not bad, f"issues: {bad}", a.mode)


def data_snapshot(a) -> None:
    from factorloom.sources.store import snapshot
    from factorloom.sources.tables import scan_panel

    print(json.dumps(snapshot(scan_panel(_spark(), a.panel)), indent=2))


def parquet_rewrite(a) -> None:
    from factorloom.sources.tables import rewrite

    print(json.dumps({"rows": rewrite(_spark(), a.source, a.target, codec=a.codec, level=a.level)}))


def classic_factors(a) -> None:
    from factorloom.factors.families import classic_factors as build
    from factorloom.sources.tables import scan_panel, write_panel

    spark = _spark()
    write_panel(build(scan_panel(spark, a.panel), a.family or ["alpha101", "alpha191"], dtype=a.dtype), a.target)


def factor_mining(a) -> None:
    from factorloom.factors.mining import formula, inputs, mine, out_of_sample
    from factorloom.sources.tables import scan_panel, settled

    rows = settled(inputs(scan_panel(_spark(), a.panel), a.field, a.horizon))
    found = mine(rows, a.field, population=a.population, generations=a.generations, most_depth=a.depth, seed=a.seed, settle=settled)
    print(json.dumps({"formula": formula(found.best), "score": found.score, "history": found.history, "check": out_of_sample(rows, found.best).first().asDict()}, indent=2))


def backtest(a) -> None:
    from datetime import date

    from factorloom.analytics.backtest import Segment, chained, holdout
    from factorloom.analytics.outputs import summary, write_run
    from factorloom.analytics.performance import metrics
    from factorloom.analytics.riskqp import Risk
    from factorloom.config import resolve
    from factorloom.sources.tables import scan_panel, settled
    from pyspark.sql import functions as F

    s = resolve(a.config, a.set, {"model": "ridge", "train_months": 60, "test_months": 3, "gap_months": 0, "windows": 20, "cost_bps": 0.0, "cap": 0.25, "weights": "heuristic"})

    def options(x: dict) -> dict:
        if x["weights"] not in ("heuristic", "risk"):
            raise SystemExit(f"no weights {x['weights']!r}; there are heuristic and risk")
        risk = {"risk": Risk(**({"cap": x["cap"]} | x.get("risk", {})))} if x["weights"] == "risk" else {}
        return {"model": x["model"], "cost_bps": x["cost_bps"], "cap": x["cap"]} | risk | x.get("params", {})

    whole = [s, *[{k: v for k, v in s.items() if k != "then"} | more for more in s.get("then", [])]]  # a later segment has the first one's settings but for its own
    parts = [Segment(date.fromisoformat(x["start"]), x["windows"], x["train_months"], x["test_months"], x["gap_months"], x["features"], options(x)) for x in whole]
    steps = [t for p in parts for t in p.spans()]
    start, end = str(min(x.train_start for x in steps)), str(max(date.fromisoformat(s["holdout_end"]) if "holdout_end" in s else steps[0].test_end, *[x.test_end for x in steps]))
    if a.store:  # only the chunks, and of a panel the row groups, of the run's dates
        from factorloom.sources.store import Store

        panel = Store(_spark(), a.store).load(a.family or None, start=start, end=end)
    elif a.panel:
        panel = scan_panel(_spark(), a.panel, start=start, end=end)
    else:
        raise SystemExit("a backtest needs --panel or --store")
    runs = {"rolling": chained(panel, s["features"], parts, settle=settled)}
    if "holdout_start" in s:
        runs["holdout"] = holdout(panel, s["features"], date.fromisoformat(s["holdout_start"]), date.fromisoformat(s["holdout_end"]), months=s["test_months"], settle=settled, **options(s))
    figures = {}
    for name, out in runs.items():
        series = out["returns"].select(F.lit("strategy").alias("series"), F.col("period").alias("date"), F.col("net_return").alias("ret"))
        figures[name] = metrics(series, per_year=4.0 if name == "rolling" else 12 / s["test_months"]).first().asDict()
        if a.output:
            write_run(out, f"{a.output}/{name}", settings=s, title=name, per_year=4.0 if name == "rolling" else 12 / s["test_months"])
        if a.text:
            print(summary(name, figures[name], s))
    if not a.text:
        print(json.dumps(figures, indent=2, default=str))


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="factorloom", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(name, run, *options):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for flags, more in options:
            p.add_argument(*flags.split(), **more)

    panel, store = ("--panel", {"required": True}), ("--store", {})
    family, dtype = ("--family", {"action": "append", "default": []}), ("--dtype", {"default": "float", "choices": ["float", "double"]})
    command("factor-store", factor_store, ("--panel", {}), ("--store", {"required": True}), family, dtype, ("--dates-per-part", {"type": int, "default": 60}), ("--overwrite", {"action": "store_true"}))
    command("factor-evidence", factor_evidence, ("--panel", {}), store, family, ("--factor", {"action": "append", "default": []}), ("--target", {"default": "next_period_return"}), ("--groups", {"type": int, "default": 5}), ("--horizon", {"type": int, "default": 1}))
    command("data-status", data_status, panel, store, ("--mode", {"default": "warn", "choices": ["off", "warn", "error"]}))
    command("data-snapshot", data_snapshot, panel)
    command("parquet-rewrite", parquet_rewrite, ("source", {}), ("target", {}), ("--codec", {"default": "zstd"}), ("--level", {"type": int}))
    command("classic-factors", classic_factors, panel, ("--target", {"required": True}), family, dtype)
    command("factor-mining", factor_mining, panel, ("--field", {"action": "append", "required": True}), ("--horizon", {"type": int, "default": 1}), ("--population", {"type": int, "default": 100}), ("--generations", {"type": int, "default": 20}), ("--depth", {"type": int, "default": 4}), ("--seed", {"type": int, "default": 42}))
    command("backtest", backtest, ("--panel", {}), store, family, ("--output", {}), ("--text", {"action": "store_true"}), ("--config", {"action": "append", "default": []}), ("--set", {"action": "append", "default": []}))
    a = top.parse_args(argv)
    a.run(a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
