"""Boosted and extra trees against the same rules in plain Python on small tables."""

import numpy as np
import pytest

from factorloom.analytics import models, trees

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(240, 3)), 2)
    x[rng.random(240) < 0.1, 0] = np.nan
    y = np.where(x[:, 1] > 0.6, 2, np.where(np.nan_to_num(x[:, 0]) + x[:, 2] < -0.5, 0, 1))
    return x, y


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y = data
    known = lambda v: None if np.isnan(v) else float(v)
    return spark.createDataFrame([(i, *map(known, r), int(k) - 1, float(k)) for i, (r, k) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, label int, _y double").repartition(3).cache()


def cuts_of(x, most):
    return [np.unique(np.nanquantile(x[:, j], [i / most for i in range(1, most)])) for j in range(x.shape[1])]


def bins_of(x, cuts):
    return np.array([[0 if np.isnan(v) else 1 + sum(c < v for c in cuts[j]) for j, v in enumerate(r)] for r in x])


def test_boosting_is_the_plain_algorithm(rows, data):
    """Every split and leaf of three rounds, found by trying every bin of every feature."""
    x, y = data
    most, rate, least = 12, 0.3, 15
    model = trees.Booster(rounds=3, depth=2, rate=rate, least=least, bins=most).fit(rows, NAMES)
    bins = bins_of(x, cuts_of(x, most))
    raw = np.log(np.bincount(y, minlength=3) / len(y))[None].repeat(len(y), 0)
    gains = np.zeros(3)
    for r in range(3):
        p = np.exp(raw) / np.exp(raw).sum(1, keepdims=True)
        step = np.zeros_like(raw)
        for k in range(3):
            g, h = p[:, k] - (y == k), p[:, k] * (1 - p[:, k])
            work, split, value = [(0, np.arange(len(y)), 0)], {}, np.zeros(len(y))
            while work:
                node, mine, level = work.pop(0)
                best = None
                for f in range(3):
                    for b in range(most):
                        left = mine[bins[mine, f] <= b]
                        right = mine[bins[mine, f] > b]
                        if min(len(left), len(right)) < least:
                            continue
                        gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - g[mine].sum() ** 2 / h[mine].sum()
                        if gain > 1e-10 and (best is None or gain > best[0] + 1e-12):
                            best = (gain, f, b, left, right)
                if best is None:
                    continue
                gain, f, b, left, right = best
                gains[f] += gain
                split[node] = (f, b)
                for child, part in ((2 * node + 1, left), (2 * node + 2, right)):
                    value[part] = -rate * g[part].sum() / h[part].sum()
                    if level + 1 < 2 and len(part) >= 2 * least:
                        work.append((child, part, level + 1))
            assert model.trees[r][k].split == split
            step[:, k] = value
        raw = raw + step
        assert np.allclose(np.column_stack([t.outputs(bins.astype(np.uint8), 1)[:, 0] for t in model.trees[r]]), step)
    assert np.allclose(model.featureImportances, gains / gains.sum())
    want = np.exp(raw) / np.exp(raw).sum(1, keepdims=True)
    got = {r["id"]: r["probability"].toArray() for r in model.transform(rows).collect()}
    assert np.allclose([got[i] for i in range(len(y))], want)


def test_extra_trees_split_at_their_drawn_cuts(rows, data):
    """Each node of each tree takes the best of the cuts drawn for it, and leaves hold the classes' shares."""
    x, y = data
    most = 16
    forest = trees.ExtraTrees(trees=3, depth=4, least=2, part=0.67, bins=most, seed=5, at_once=2)
    model = forest.fit(rows, NAMES)
    bins = bins_of(x, cuts_of(x, most))
    gini = lambda k: len(k) - (np.bincount(k, minlength=3) ** 2).sum() / len(k)
    assert len(model.trees) == 3
    for t, (tree,) in enumerate(model.trees):
        work, split = [(0, np.arange(len(y)), 0)], {}
        while work:
            node, mine, level = work.pop(0)
            if level == 4 or len(set(y[mine])) == 1 or len(mine) < 4:
                continue
            best = None
            for f in forest.drawn(t, node, 3).tolist():
                low, high = bins[mine, f].min(), bins[mine, f].max()
                if low == high:
                    continue
                b = int(np.random.default_rng([5, t, node, f + 1]).integers(low, high))
                left, right = mine[bins[mine, f] <= b], mine[bins[mine, f] > b]
                gain = gini(y[mine]) - gini(y[left]) - gini(y[right])
                if min(len(left), len(right)) >= 2 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, b, left, right)
            if best:
                split[node] = best[1:3]
                work += [(2 * node + 1, best[3], level + 1), (2 * node + 2, best[4], level + 1)]
        assert tree.split == split
        at = tree.leaf(bins.astype(np.uint8))
        for node in np.unique(at):
            assert np.allclose(tree.value[int(node)], np.bincount(y[at == node], minlength=3) / (at == node).sum())
    assert model.to_json() == forest.fit(rows, NAMES).to_json()


@pytest.mark.parametrize("name", ["hist_gradient_boosting", "extra_trees"])
def test_both_by_name(spark, rows, data, name):
    """They learn, score by P(up) - P(down), rank features, and take tables of one class and without rows."""
    x, y = data
    fitted = models.fit(rows, NAMES, name, n_estimators=12, max_depth=6, min_samples_leaf=3)
    got = {r["id"]: (r["score"], r["signal"]) for r in models.scores(rows, fitted).join(models.signals(rows, fitted).select("id", "signal"), "id").collect()}
    assert np.mean([got[i][1] == y[i] - 1 for i in range(len(y))]) > 0.85
    assert np.corrcoef([got[i][0] for i in range(len(y))], y)[0, 1] > 0.8
    assert {f for f, _ in models.importances(fitted, NAMES)} == set(NAMES) and abs(sum(v for _, v in models.importances(fitted, NAMES)) - 1) < 1e-9
    one = models.fit(rows.where("label = 1"), NAMES, name, n_estimators=2)
    assert {r["signal"] for r in models.signals(rows, one).collect()} == {1.0}
    none = models.fit(rows.limit(0), NAMES, name, n_estimators=2)
    assert models.scores(rows, none).count() == len(y)
