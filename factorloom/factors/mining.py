"""Mining factors by genetic programming: trees are ``Expr``; a whole generation is one Spark job."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.analytics.evidence import daily_ic, long_factors, mining_groups
from factorloom.expressions import Expr, field, with_factors
from factorloom.functions import finite, safe_div
from factorloom.operators.crosssection import residual
from factorloom.operators.timeseries import TickerWindow

#: Windows that trees may use; fixed values.
WINDOWS = (3, 5, 10, 20, 60)
#: Columns that may hold a market value, the first that a panel has.
SIZES = ("total_mv", "circ_mv", "market_cap")
SERIES1, SERIES2, TIMED = ("neg", "safe_log", "safe_sqrt", "rank"), ("+", "-", "*", "safe_div"), ("delay", "mean", "std", "ts_min", "ts_max", "delta", "corr")

W = TickerWindow()


def depth(e) -> int:
    return 1 + max((depth(a) for a in e.args if isinstance(a, Expr) and e.op != "field"), default=0) if isinstance(e, Expr) else 0


def formula(e) -> str:
    if not isinstance(e, Expr):
        return str(e)
    return e.args[0] if e.op == "field" else f"{e.op}({', '.join(formula(a) for a in e.args)})"


def nodes(e: Expr, path: tuple[int, ...] = ()) -> list[tuple[tuple[int, ...], Expr]]:
    out = [(path, e)]
    if e.op != "field":
        for i, a in enumerate(e.args):
            if isinstance(a, Expr):
                out += nodes(a, (*path, i))
    return out


def replaced(e: Expr, path: tuple[int, ...], new: Expr) -> Expr:
    if not path:
        return new
    args = list(e.args)
    args[path[0]] = replaced(args[path[0]], path[1:], new)
    return Expr(e.op, tuple(args))


class Grower:
    def __init__(self, fields: Sequence[str], seed: int):
        self.fields, self.rng = list(fields), random.Random(seed)

    def tree(self, most: int, whole: bool) -> Expr:
        if most <= 1 or (not whole and self.rng.random() < 0.3):
            return field(self.rng.choice(self.fields))
        op = self.rng.choice([*SERIES1, *SERIES2, *TIMED])
        sub = lambda: self.tree(most - 1, whole)
        if op in SERIES1:
            return Expr(op, (sub(),))
        if op in SERIES2:  # one in eight has a plain number on the right
            return Expr(op, (sub(), round(self.rng.uniform(-1, 1), 3) if self.rng.random() < 0.125 else sub()))
        return Expr(op, (*([sub(), sub()] if op == "corr" else [sub()]), self.rng.choice(WINDOWS)))

    def population(self, n: int, most: int) -> list[Expr]:
        """Half grown, half full, over all depths."""
        return [self.tree(2 + i % (most - 1) if most > 1 else 1, i % 2 == 0) for i in range(n)]

    def crossed(self, a: Expr, b: Expr, most: int) -> Expr:
        path, _ = self.rng.choice(nodes(a))
        new = replaced(a, path, self.rng.choice(nodes(b))[1])
        return new if depth(new) <= most else a

    def mutated(self, e: Expr) -> Expr:
        """Another operator of the same arity, field or window at one place."""
        path, old = self.rng.choice(nodes(e))
        if old.op == "field":
            return replaced(e, path, field(self.rng.choice(self.fields)))
        pool = next((g for g in (SERIES1, SERIES2, tuple(t for t in TIMED if t != "corr"), ("corr",)) if old.op in g), (old.op,))
        args = old.args
        if isinstance(args[-1], int) and self.rng.random() < 0.5:
            args = (*args[:-1], self.rng.choice(WINDOWS))
        return replaced(e, path, Expr(self.rng.choice(pool), args))


def inputs(panel: DataFrame, fields: Sequence[str], horizon: int = 1) -> DataFrame:
    """Fields, the forward return over ``horizon`` bars, and ``_size``, the logarithm of the market value, where the panel has one (of SIZES)."""
    close = "close_adj" if "close_adj" in panel.columns else "close"
    size = next((c for c in SIZES if c in panel.columns), None)
    more = [F.when(F.col(size) > 0, F.ln(F.col(size))).alias("_size")] if size else []
    return panel.select("date", "ticker", *fields, W.forward_return(F.col(close), horizon).alias("_future"), *more)


def fitness(rows: DataFrame, trees: Sequence[Expr], penalty: float, least: int = 100) -> list[float]:
    """abs(pooled Spearman) less ``penalty`` x depth; 0 for constant, rare or invalid factors. One job for all trees."""
    unique = list(dict.fromkeys(trees))
    names = {t: f"f{i}" for i, t in enumerate(unique)}
    made = with_factors(rows, {n: t for t, n in names.items()}, ["date", "ticker", "_future"])
    long = made.select("_future", *names.values()).unpivot(["_future"], list(names.values()), "factor", "x")
    long = long.select("factor", finite(F.col("x")).alias("x"), finite(F.col("_future")).alias("y")).where("x is not null and y is not null")
    # ranks by value counts: ties are averaged from cumulative counts of distinct values
    ranked = _ranked(_ranked(long, "x"), "y")
    got = ranked.groupBy("factor").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("x_rank", "y_rank").alias("c"), F.stddev_pop("x_rank").alias("a"), F.stddev_pop("y_rank").alias("b"))
    score = {r["factor"]: abs(r["c"]) / (r["a"] * r["b"]) for r in got.collect() if r["n"] >= least and r["a"] and r["b"]}
    return [max(0.0, score.get(names[t], 0.0) - penalty * depth(t)) if names[t] in score else 0.0 for t in trees]


def _ranked(rows: DataFrame, column: str) -> DataFrame:
    """Average ranks within a factor: a window over its distinct values' counts, not over its rows."""
    counts = rows.groupBy("factor", column).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("factor").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.withColumn(f"{column}_rank", F.sum("_n").over(w) - (F.col("_n") - 1) / 2).drop("_n")
    return rows.join(ranks, ["factor", column])


@dataclass
class Mined:
    best: Expr
    score: float
    history: list[float]
    generations: int


def mine(rows: DataFrame, fields: Sequence[str], *, population: int = 100, generations: int = 20, most_depth: int = 4, penalty: float = 0.001, elite: int = 2, tournament: int = 3, crossover: float = 0.7, mutation: float = 0.2, patience: int = 10, seed: int = 42, settle: Callable[[DataFrame], DataFrame] | None = None) -> Mined:
    """Tournament selection, subtree crossover, point mutation, elitism; ends early once the best stands still."""
    grower = Grower(fields, seed)
    pool = grower.population(population, most_depth)
    rows = settle(rows) if settle else rows
    history: list[float] = []
    best, top = pool[0], -1.0
    for g in range(generations + 1):
        scores = fitness(rows, pool, penalty)
        order = sorted(range(len(pool)), key=lambda i: -scores[i])
        if scores[order[0]] > top:
            best, top = pool[order[0]], scores[order[0]]
        history.append(top)
        if g == generations or (len(history) > patience and history[-1] - history[-1 - patience] < 0.001):
            return Mined(best, top, history, g)
        pick = lambda: pool[max(grower.rng.sample(range(len(pool)), min(tournament, len(pool))), key=lambda i: scores[i])]  # noqa: B023, E731
        new = [pool[i] for i in order[:elite]]
        while len(new) < population:
            child = pick()
            if grower.rng.random() < crossover:
                child = grower.crossed(child, pick(), most_depth)
            if grower.rng.random() < mutation:
                child = grower.mutated(child)
            new.append(child)
        pool = new
    return Mined(best, top, history, generations)


def out_of_sample(rows: DataFrame, tree: Expr) -> DataFrame:
    """Daily RankIC of a mined factor: mean, ICIR with sample deviation, dates."""
    made = with_factors(rows, {"mined": tree}, ["date", "ticker", "_future"])
    ic = daily_ic(long_factors(made, ["mined"], "_future", finite_only=True))
    return ic.agg(F.avg("rank_ic").alias("rank_ic_mean"), safe_div(F.avg("rank_ic"), F.stddev_samp("rank_ic")).alias("icir"), F.count("rank_ic").alias("dates"))


def neutral_quintiles(rows: DataFrame, tree: Expr) -> DataFrame:
    """``(group, mean_return, periods)`` of a mined factor's quintiles, freed of size by a line in each date's cross-section where ``inputs`` found one."""
    sized = "_size" in rows.columns
    made = with_factors(rows, {"mined": tree}, ["date", "ticker", "_future", *(["_size"] if sized else [])])
    if sized:
        made = made.withColumn("mined", residual(finite(F.col("mined")), F.col("_size")))
    return mining_groups(long_factors(made, ["mined"], "_future", finite_only=True)).select("group", "mean_return", "periods")
