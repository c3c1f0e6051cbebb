"""Cross-sectional models over pyspark.ml, by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Class index of a label -1, 0, 1.
CLASSES = {-1: 0, 0: 1, 1: 2}


def _forest(p: dict):
    return RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=p.get("n_estimators", 100), maxDepth=min(30, p.get("max_depth", 10)), minInstancesPerNode=p.get("min_samples_leaf", 1), featureSubsetStrategy=p.get("max_features", "sqrt"), seed=p.get("seed", 42))


def _boosted(p: dict):
    return OneVsRest(featuresCol="_x", labelCol="_y", classifier=GBTClassifier(maxIter=p.get("n_estimators", 20), maxDepth=p.get("max_depth", 3), stepSize=p.get("learning_rate", 0.1), seed=p.get("seed", 42)))


def _hist_boosted(p: dict):
    from factorloom.analytics.trees import Booster

    return Booster(p.get("max_iter", p.get("n_estimators", 100)), p.get("max_depth", 3) or 6, p.get("learning_rate", 0.1), p.get("l2_regularization", 0.0), p.get("min_samples_leaf", 20), p.get("max_bins", 64))


def _extra_trees(p: dict):
    from factorloom.analytics.trees import ExtraTrees

    return ExtraTrees(p.get("n_estimators", 100), p.get("max_depth", 10) or 30, p.get("min_samples_leaf", 1), p.get("max_features", "sqrt"), seed=p.get("seed", 42))


def _linear(mix: float, alpha: float, summed: bool = False):
    """Least squares with penalty ``alpha * (mix * sum |w| + (1 - mix) / 2 * sum w^2)``; ``summed``: against the sum of squared errors, not their mean.

    Spark divides the squared part by the target's deviation, so both parameters are set against that; ``n`` and ``spread`` are those of the target.
    """

    def build(p: dict):
        weight = p.get("alpha", alpha) / (p["n"] if summed else 1)
        part = p.get("l1_ratio", mix)
        first, second = weight * part, weight * (1 - part) * p["spread"]
        return LinearRegression(featuresCol="_x", labelCol="_y", regParam=first + second, elasticNetParam=first / (first + second) if first + second else 0.0, standardization=False, maxIter=p.get("max_iter", 5000), tol=1e-9)

    build.moments = True
    return build


MODELS: dict[str, tuple[str, Callable[[dict], object]]] = {
    "random_forest": ("class", _forest),
    "gradient_boosting": ("class", _boosted),
    "hist_gradient_boosting": ("class", _hist_boosted),
    "extra_trees": ("class", _extra_trees),
    "ridge": ("value", _linear(0.0, 1.0, summed=True)),
    "lasso": ("value", _linear(1.0, 0.001)),
    "elasticnet": ("value", _linear(0.5, 0.001)),
}
#: Named by users of other engines, but without a counterpart here.
ABSENT = ("xgboost", "xgboost_regressor", "xgb_ranker")


def register(name: str, kind: str, build: Callable[[dict], object]) -> None:
    if kind not in ("class", "value"):
        raise ValueError(f"no kind {kind!r}")
    MODELS[name] = (kind, build)


def fit(rows: DataFrame, features: Sequence[str], name: str, **params):
    """A fitted pipeline on rows whose target is known; classes from ``label``, values from ``rel_return``."""
    if name not in MODELS:
        raise ValueError(f"{name} needs a library that isn't there" if name in ABSENT else f"no model {name!r}; there are {sorted(MODELS)}")
    kind, build = MODELS[name]
    target = (F.col("label") + 1).cast("double") if kind == "class" else F.col("rel_return").cast("double")
    rows = rows.withColumn("_y", target).where("_y is not null")
    if getattr(build, "moments", False):
        n, spread = rows.dropna(subset=list(features)).agg(F.count("_y"), F.coalesce(F.stddev_pop("_y"), F.lit(0.0))).first()
        params = params | {"n": max(1, n), "spread": spread}
    built = build(params)
    if not hasattr(built, "getFeaturesCol"):  # our own: over columns, gaps allowed
        return kind, built.fit(rows, features)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip"), built]).fit(rows)
    return kind, model


def scores(rows: DataFrame, fitted) -> DataFrame:
    """``score``: P(up) - P(down), or the prediction."""
    kind, model = fitted
    out = model.transform(rows)
    if kind == "value":
        return out.withColumn("score", F.col("prediction")).drop("_x", "prediction")
    if "probability" in out.columns:
        p = vector_to_array("probability")
        return out.withColumn("score", F.coalesce(F.get(p, F.lit(2)), F.lit(0.0)) - F.get(p, F.lit(0))).drop("_x", "rawPrediction", "probability", "prediction")
    return out.withColumn("score", F.col("prediction") - 1).drop("_x", "rawPrediction", "prediction")


def signals(rows: DataFrame, fitted) -> DataFrame:
    """``signal``: the predicted class -1, 0 or 1, or the sign of the prediction."""
    kind, model = fitted
    out = model.transform(rows)
    signal = F.signum("prediction") if kind == "value" else F.col("prediction") - 1
    return out.select(*rows.columns, signal.alias("signal"))


def importances(fitted, features: Sequence[str]) -> list[tuple[str, float]]:
    last = fitted[1].stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else [abs(v) for v in last.coefficients]
    return sorted(zip(features, map(float, values.toArray() if hasattr(values, "toArray") else values), strict=True), key=lambda x: (-x[1], x[0]))


def selected(fitted, features: Sequence[str]) -> list[str]:
    """Features that the model uses, or the best one if none."""
    ranked = importances(fitted, features)
    return [f for f, v in ranked if v > 0] or [ranked[0][0]]
