"""Class and sample weights.

Class counts are a k-row aggregate (k = number of classes); the weights
derived from them enter row expressions as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORM_EPS = 1e-8   # added to the mean when normalising weights (fixed value)


def fixed_class_weight(label: Column, w0: float = 0.3, w1: float = 0.7) -> Column:
    """One weight per class."""
    return F.when(label == 1, F.lit(float(w1))).otherwise(F.lit(float(w0)))


def class_counts(df: DataFrame, label: str = "label") -> dict[int, int]:
    return {int(r[0]): int(r[1]) for r in df.groupBy(label).count().collect()}


def balanced_weights(counts: dict[int, int]) -> dict[int, float]:
    """N / (k * n_c) per class."""
    n, k = sum(counts.values()), len(counts)
    return {c: n / (k * nc) for c, nc in counts.items()}


def blended_weights(pair: DataFrame, alpha: float = 0.5, max_ratio: float = 3.0) -> DataFrame:
    """W3 on a one-row frame (orig0, orig1, post0, post1): the blend of both weights per class.

    Each class is clamped to ``max_ratio`` times the other. Returns (w0, w1).
    """
    blend = [F.lit(alpha) * F.col(f"orig{c}") + F.lit(1 - alpha) * F.col(f"post{c}") for c in (0, 1)]
    clamp = [F.least(blend[c], F.lit(max_ratio) * blend[1 - c]).alias(f"w{c}") for c in (0, 1)]
    return pair.select(*clamp)


def class_weight_column(label: Column, weights: dict[int, float]) -> Column:
    expr = None
    for c, w in sorted(weights.items()):
        expr = (F.when(label == c, F.lit(float(w))) if expr is None
                else expr.when(label == c, F.lit(float(w))))
    return expr.otherwise(F.lit(None).cast("double"))


def normalise_weights(df: DataFrame, weight: str = "weight", by: list[str] | None = None) -> DataFrame:
    """Weight / (mean weight + 1e-8); per group (e.g. per batch) when ``by`` is given.

    The mean is an aggregate joined back (one row per group), not a window
    over the whole table.
    """
    if not by:
        m = df.agg(F.avg(weight)).first()[0]
        return df.withColumn(weight, F.col(weight) / F.lit(m + NORM_EPS))
    means = df.groupBy(*by).agg(F.avg(weight).alias("_wm"))
    return df.join(means, by).withColumn(weight, F.col(weight) / (F.col("_wm") + F.lit(NORM_EPS))).drop("_wm")
