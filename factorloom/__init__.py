"""Cross-sectional factor analytics on Spark."""

import importlib
import sys

from pyspark import cloudpickle

# Tasks get the code itself, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What users import from here, and where it is; each module is loaded when it is first asked for.
EXPORTS = {
    "factors.families": ("FAMILIES", "add_family", "alpha158", "alpha360", "catalogue", "classic_factors", "expected_columns", "factor_catalogue", "formulas", "merge_external", "normal_family"),
    "factors.mining": ("mine", "out_of_sample"),
    "sources.cache": ("DateCache",),
    "sources.store": ("Conflict", "Store", "snapshot"),
    "sources.tables": ("rewrite", "scan_panel", "write_panel"),
    "sources.tar": ("TarStore", "pack"),
    "streaming.incremental": ("follow", "merge_batch", "windowed_bars"),
    "operators.quantiles": ("quantiles",),
    "operators.standardise": ("fill_values", "filled", "market_panel", "preprocess"),
    "analytics.backtest": ("Segment", "Span", "chained", "holdout", "spans", "walk_forward"),
    "analytics.evidence": ("daily_ic", "long_factors"),
    "analytics.models": ("MODELS", "fit", "register", "scores", "signals"),
    "analytics.portfolio": ("exposures", "heuristic_weights", "period_returns", "turnover"),
    "analytics.riskqp": ("Risk", "risk_weights"),
    "analytics.selection": ("eliminate", "tune"),
    "expressions": ("Expr", "with_factors"),
}
__all__ = sorted(n for names in EXPORTS.values() for n in names)  # noqa: PLE0605


def __getattr__(name: str):
    for module, names in EXPORTS.items():
        if name in names:
            return getattr(importlib.import_module(f"{__name__}.{module}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")


def __dir__():
    return [*globals(), *__all__]
