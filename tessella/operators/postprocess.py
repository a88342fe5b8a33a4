"""From a raw signal to weights: winsorize, normalise, smooth and cap, in that order, as formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessella.dsl.formula import evaluate

#: Templates (fixed values): each step is a formula of x.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "stable_low_turnover": ("mad_winsorize(x, 5)", "cs_demean(cs_rank(x))", "ts_ewm(x, 4)", "weight_cap(x, 0.01)"),
    "aggressive_high_ic": ("mad_winsorize(x, 5)", "cs_zscore(x)", "ts_ewm(x, 2)", "weight_cap(x, 0.05)"),
    "rank_clip": ("pct_rank(x)", "clip(x, -1, 1)"),
    "zscore_clip": ("zclip(x)", "clip(x, -1, 1)"),
}


def postprocess(signal: DataFrame, template: str | tuple[str, ...], alpha: str = "alpha") -> DataFrame:
    """signal with alpha replaced by the template's result."""
    out = signal.withColumnRenamed(alpha, "x")
    for step in TEMPLATES[template] if isinstance(template, str) else template:
        out = evaluate(out, {"_y": step}).drop("x").withColumnRenamed("_y", "x")
    return out.withColumnRenamed("x", alpha)
