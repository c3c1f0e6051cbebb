"""Trees over binned features, grown level by level from histograms: gradient boosting of three classes, and extra trees.

Features are cut at exact quantiles once and kept as one byte each.  A level of all trees that grow together is one job: tasks add up, for
each node, feature and bin, what splits need, Spark sums that, and a split is chosen for each node from its own bins; the driver gets one row a node.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.operators.quantiles import quantiles
from factorloom.sources.tables import settled

CLASSES = 3


@dataclass
class Tree:
    """Nodes by number: the children of i are 2i + 1 and 2i + 2. A row goes left if its bin is at most the node's."""

    split: dict[int, tuple[int, int]] = field(default_factory=dict)  # node: (feature, bin)
    value: dict[int, list[float]] = field(default_factory=dict)

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row comes to."""
        at = np.zeros(len(bins), np.int64)
        nodes = np.array(sorted(self.split), np.int64)
        feature, cut = np.array([self.split[n] for n in nodes.tolist()], np.int64).reshape(-1, 2).T
        going = np.arange(len(bins)) if len(nodes) else np.empty(0, np.int64)
        while len(going):
            spot = np.minimum(np.searchsorted(nodes, at[going]), len(nodes) - 1)
            inner = nodes[spot] == at[going]
            going, spot = going[inner], spot[inner]
            at[going] = 2 * at[going] + 2 - (bins[going, feature[spot]] <= cut[spot])
        return at

    def outputs(self, bins: np.ndarray, wide: int) -> np.ndarray:
        at = self.leaf(bins)
        known, place = np.unique(at, return_inverse=True)
        return np.array([self.value.get(int(n), [0.0] * wide) for n in known]).reshape(-1, wide)[place]


def edges_of(rows: DataFrame, features: Sequence[str], most: int) -> dict[str, list[float]]:
    """Cuts between bins: up to ``most - 1`` distinct quantiles of each feature."""
    found = quantiles(rows, features, [i / most for i in range(1, most)])
    return {f: sorted({x for x in v if x is not None}) for f, v in found.items()}


def binned(matrix: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bytes: how many cuts are below each value; a missing one is 0, left of all."""
    out = np.zeros(matrix.shape, np.uint8)
    for j, e in enumerate(edges):
        x = matrix[:, j]
        out[:, j] = np.where(np.isnan(x), 0, np.searchsorted(e, x, side="left") + 1)
    return out


def matrix_of(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features]) if features else np.empty((batch.num_rows, 0))


def binned_rows(rows: DataFrame, features: Sequence[str], edges: dict[str, list[float]]) -> DataFrame:
    """``(y, bins)``, written once: the class 0, 1 or 2 and a byte for each feature."""
    cuts, names = [np.array(edges[f]) for f in features], list(features)

    def cut(batches):
        for batch in batches:
            bins = binned(matrix_of(batch, names), cuts)
            yield pa.RecordBatch.from_arrays([batch.column("_y").cast(pa.int32()), pa.array([r.tobytes() for r in bins], pa.binary())], names=["y", "bins"])

    wanted = rows.select(F.col("_y").cast("int").alias("_y"), *[F.col(f"`{f}`").cast("double").alias(f) for f in features])
    return settled(wanted.mapInArrow(cut, "y int, bins binary"))


def histograms(table: DataFrame, width: int, bins: int, per_row: Callable, live: Sequence[tuple[int, int]], candidates: Callable[[int, int], np.ndarray], wide: int) -> DataFrame:
    """``(tree, node, feature, sums)``: for each live node and candidate feature ``wide`` sums for each bin, one after another.

    ``per_row(y, bins)`` gives, for each tree, the rows' nodes and the values to sum.  A task holds the sums of the live nodes, whatever its rows.
    """
    numbers = {k: i for i, k in enumerate(live)}
    chosen = [candidates(*k) for k in live]

    def count(batches):
        sums = [np.zeros((len(c), bins, wide)) for c in chosen]
        for batch in batches:
            y = batch.column("y").to_numpy()
            x = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(len(y), width)
            for tree, nodes, values in per_row(y, x):
                for node in np.unique(nodes).tolist():
                    i = numbers.get((tree, node))
                    if i is None:
                        continue
                    mine = np.flatnonzero(nodes == node)
                    for j, f in enumerate(chosen[i].tolist()):
                        for v in range(wide):
                            sums[i][j, :, v] += np.bincount(x[mine, f], values[mine, v], bins)
        for (tree, node), feats, have in zip(live, chosen, sums, strict=True):
            n = len(feats)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bins * wide), pa.array(have.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, tree, np.int32)), pa.array(np.full(n, node, np.int64)), pa.array(feats.astype(np.int32)), flat], names=["tree", "node", "feature", "sums"])

    parts = table.mapInArrow(count, "tree int, node long, feature int, sums array<double>")
    # added up pair by pair of bins: positions become rows, summed before the shuffle, and rows an array again
    spread = parts.select("tree", "node", "feature", F.posexplode("sums").alias("at", "v")).where("v <> 0")
    return spread.groupBy("tree", "node", "feature", "at").agg(F.sum("v").alias("v")).groupBy("tree", "node", "feature").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("sums"))


def best_splits(hist: DataFrame, bins: int, wide: int, choose: Callable) -> dict[tuple[int, int], tuple[float, int, int, list[float], list[float]]]:
    """For each node its best ``(gain, feature, bin, left sums, right sums)``, chosen where its bins are; ties go to the first feature, then bin."""

    def pick(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                sums = np.zeros(bins * wide)
                at = dict(r["sums"])
                sums[list(at)] = list(at.values())
                found = choose(r["tree"], r["node"], r["feature"], sums.reshape(bins, wide))
                if found:
                    gain, b, left, right = found
                    out.append((r["tree"], r["node"], r["feature"], float(gain), int(b), [float(v) for v in left], [float(v) for v in right]))
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["tree", "node", "feature", "gain", "bin", "l", "r"])

    rows = hist.mapInArrow(pick, "tree int, node long, feature int, gain double, bin int, l array<double>, r array<double>")
    order = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "l", "r")
    found = rows.groupBy("tree", "node").agg(F.max(order).alias("s")).collect()
    return {(r["tree"], r["node"]): (r["s"]["gain"], -r["s"]["f"], -r["s"]["b"], r["s"]["l"], r["s"]["r"]) for r in found}


@dataclass
class TreeModel:
    """Trees, the cuts of their features, and how their outputs become probabilities."""

    features: list[str]
    edges: dict[str, list[float]]
    trees: list[list[Tree]]  # boosting: a tree for each class and round; extra trees: one a round, with all classes
    prior: list[float]
    boosted: bool
    gains: list[float]

    @property
    def stages(self):
        return [self]

    @property
    def featureImportances(self):  # noqa: N802  the name that other models have
        total = sum(self.gains)
        return np.array([g / total if total else 0.0 for g in self.gains])

    def probabilities(self, bins: np.ndarray) -> np.ndarray:
        if self.boosted:
            raw = np.tile(np.array(self.prior), (len(bins), 1))
            for group in self.trees:
                for k, tree in enumerate(group):
                    raw[:, k] += tree.outputs(bins, 1)[:, 0]
            return softmax(raw)
        out = np.zeros((len(bins), CLASSES))
        for (tree,) in self.trees:
            out += tree.outputs(bins, CLASSES)
        return out / max(1, len(self.trees))

    def transform(self, rows: DataFrame) -> DataFrame:
        """``probability`` and ``prediction`` beside the rows; missing features count as the smallest values."""
        model, kinds = self, rows.schema
        names = {f: f"_f{i}" for i, f in enumerate(self.features)}
        cuts = [np.array(self.edges[f]) for f in self.features]

        def score(batches):
            for batch in batches:
                p = model.probabilities(binned(matrix_of(batch, list(names.values())), cuts))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * CLASSES), pa.array(p.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c.name) for c in kinds], lists, pa.array(p.argmax(1).astype(float))], names=[*[c.name for c in kinds], "_p", "prediction"])

        wide = rows.select("*", *[F.col(f"`{f}`").cast("double").alias(n) for f, n in names.items()])
        schema = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in kinds) + ", _p array<double>, prediction double"
        return wide.mapInArrow(score, schema).withColumn("probability", array_to_vector("_p")).drop("_p")

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "edges": self.edges, "prior": self.prior, "boosted": self.boosted, "gains": self.gains, "trees": [[{"split": {str(k): v for k, v in t.split.items()}, "value": {str(k): v for k, v in t.value.items()}} for t in g] for g in self.trees]})


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gain_of(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g * g / np.maximum(h + l2, 1e-12)


class Booster:
    """Gradient boosting of three classes by softmax: in each round a tree for each class, grown together from gradients and hessians."""

    def __init__(self, rounds: int = 100, depth: int = 3, rate: float = 0.1, l2: float = 0.0, least: int = 20, bins: int = 64):
        self.rounds, self.depth, self.rate, self.l2, self.least, self.bins = rounds, depth, rate, l2, least, min(255, bins)

    def fit(self, rows: DataFrame, features: Sequence[str]) -> TreeModel:
        features = list(features)
        edges = edges_of(rows, features, self.bins)
        table = binned_rows(rows, features, edges)
        counts = {r["y"]: r["n"] for r in table.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        total = sum(counts.values())
        prior = [float(np.log(max(counts.get(k, 0), 1e-9) / max(1, total))) for k in range(CLASSES)]
        model = TreeModel(features, edges, [], prior, True, [0.0] * len(features))
        wide, bins, every = 3, self.bins + 1, np.arange(len(features))
        for _ in range(self.rounds):
            group = [Tree() for _ in range(CLASSES)]
            live = [(k, 0) for k in range(CLASSES)]
            for level in range(self.depth):
                if not live:
                    break
                done, growing = model, group

                def per_row(y, x, done=done, growing=growing):
                    p = done.probabilities(x)
                    for k in range(CLASSES):
                        g, h = p[:, k] - (y == k), p[:, k] * (1 - p[:, k])
                        yield k, growing[k].leaf(x), np.column_stack([g, h, np.ones(len(y))])

                found = best_splits(histograms(table, len(features), bins, per_row, live, lambda t, n: every, wide), bins, wide, self._choose)
                nxt = []
                for (k, node), (gain, f, b, left, right) in sorted(found.items()):
                    group[k].split[node] = (f, b)
                    group[k].value.pop(node, None)
                    model.gains[f] += gain
                    for child, s in ((2 * node + 1, left), (2 * node + 2, right)):
                        group[k].value[child] = [-self.rate * s[0] / max(s[1] + self.l2, 1e-12)]
                        if level + 1 < self.depth and s[2] >= 2 * self.least:
                            nxt.append((k, child))
                live = nxt
            if not any(t.split for t in group):
                break
            model.trees.append(group)
        return model

    def _choose(self, tree, node, feature, sums):
        left = np.cumsum(sums, axis=0)[:-1]
        right = sums.sum(0) - left
        ok = (left[:, 2] >= self.least) & (right[:, 2] >= self.least)
        gain = gain_of(left[:, 0], left[:, 1], self.l2) + gain_of(right[:, 0], right[:, 1], self.l2) - gain_of(sums[:, 0].sum(), sums[:, 1].sum(), self.l2)
        gain = np.where(ok, gain, -np.inf)
        b = int(gain.argmax())
        return (gain[b], b, left[b], right[b]) if gain[b] > 1e-10 else None


class ExtraTrees:
    """Trees whose nodes look at a few features drawn at random, each at one cut drawn at random between the node's smallest and largest bin."""

    def __init__(self, trees: int = 100, depth: int = 10, least: int = 1, part: str | float = "sqrt", bins: int = 128, seed: int = 42, at_once: int = 8):
        self.trees, self.depth, self.least, self.part, self.bins, self.seed, self.at_once = trees, depth, least, part, min(255, bins), seed, at_once

    def drawn(self, tree: int, node: int, width: int) -> np.ndarray:
        size = max(1, int(np.sqrt(width))) if self.part == "sqrt" else max(1, int(self.part * width))
        return np.sort(np.random.default_rng([self.seed, tree, node]).permutation(width)[:size])

    def fit(self, rows: DataFrame, features: Sequence[str]) -> TreeModel:
        features = list(features)
        edges = edges_of(rows, features, self.bins)
        table = binned_rows(rows, features, edges)
        counts = {r["y"]: r["n"] for r in table.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        root = [float(counts.get(k, 0)) for k in range(CLASSES)]
        model = TreeModel(features, edges, [], [0.0] * CLASSES, False, [0.0] * len(features))
        bins = self.bins + 1
        for start in range(0, self.trees, self.at_once):
            group = {t: Tree(value={0: [v / max(1.0, sum(root)) for v in root]}) for t in range(start, min(self.trees, start + self.at_once))}
            live = [(t, 0) for t in group] if sum(v > 0 for v in root) > 1 else []
            for _ in range(self.depth):
                if not live:
                    break

                def per_row(y, x, group=group):
                    one = np.eye(CLASSES)[y]
                    for t, tree in group.items():
                        yield t, tree.leaf(x), one

                found = best_splits(histograms(table, len(features), bins, per_row, live, lambda t, n: self.drawn(t, n, len(features)), CLASSES), bins, CLASSES, self._choose)
                live = []
                for (t, node), (gain, f, b, left, right) in sorted(found.items()):
                    group[t].split[node] = (f, b)
                    group[t].value.pop(node)
                    model.gains[f] += gain
                    for child, s in ((2 * node + 1, left), (2 * node + 2, right)):
                        group[t].value[child] = [v / sum(s) for v in s]
                        if sum(v > 0 for v in s) > 1 and sum(s) >= 2 * self.least:
                            live.append((t, child))
            model.trees += [[t] for t in group.values()]
        return model

    def _choose(self, tree, node, feature, sums):
        full = np.flatnonzero(sums.sum(1))
        if len(full) < 2:
            return None
        low, high = int(full[0]), int(full[-1])
        b = int(np.random.default_rng([self.seed, tree, node, feature + 1]).integers(low, high))
        left = sums[: b + 1].sum(0)
        right = sums.sum(0) - left
        if min(left.sum(), right.sum()) < self.least:
            return None
        impurity = lambda s: s.sum() - (s * s).sum() / s.sum()  # noqa: E731  Gini, weighted by rows
        return impurity(sums.sum(0)) - impurity(left) - impurity(right), b, left, right
