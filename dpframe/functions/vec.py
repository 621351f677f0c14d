"""Array-column math that stays JVM-side (higher-order SQL functions).

Used for scoring, per-row losses and gradients, L2 clipping (D1, D5–D7,
D13). Weight vectors are small driver-side lists and enter the plan as
literal arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROB_EPS = 1e-7   # probability clip for cross-entropy (fixed value)


def lit_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(x: Column, w) -> Column:
    """Σ x_i w_i (left to right); ``w`` is a list of floats or an array column."""
    wc = lit_array(w) if isinstance(w, (list, tuple)) else w
    return F.aggregate(F.zip_with(x, wc, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)


def sq_norm(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))


def l2_norm(x: Column) -> Column:
    return F.sqrt(sq_norm(x))


def clip_factor(norm: Column, clip: float) -> Column:
    """min(1, C / ||v||); a zero vector keeps factor 1."""
    return F.when(norm > F.lit(clip), F.lit(float(clip)) / norm).otherwise(F.lit(1.0))


def clip_l2(x: Column, clip: float) -> Column:
    """V * min(1, C / ||v||)."""
    f = clip_factor(l2_norm(x), clip)
    return F.transform(x, lambda v: v.cast("double") * f)


def scale(x: Column, a: Column | float) -> Column:
    ac = a if isinstance(a, Column) else F.lit(float(a))
    return F.transform(x, lambda v: v.cast("double") * ac)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def logistic_score(x: Column, w, b: float) -> Column:
    """D13 (logistic model): P(y=1) = sigmoid(x·w + b)."""
    return sigmoid(dot(x, w) + F.lit(float(b)))


def bce(y: Column, p: Column) -> Column:
    """Binary cross-entropy on probabilities clipped to [eps, 1-eps]."""
    pc = F.least(F.greatest(p, F.lit(PROB_EPS)), F.lit(1.0 - PROB_EPS))
    yd = y.cast("double")
    return -(yd * F.log(pc) + (F.lit(1.0) - yd) * F.log(F.lit(1.0) - pc))


def cce_from_logits(onehot: Column, logits: Column) -> Column:
    """Categorical cross-entropy from logits via a stable log-sum-exp."""
    mx = F.array_max(F.transform(logits, lambda v: v.cast("double")))
    lse = mx + F.log(F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(v.cast("double") - mx)))
    picked = F.aggregate(F.zip_with(onehot, logits, lambda t, v: t.cast("double") * v.cast("double")),
                         F.lit(0.0), lambda s, v: s + v)
    tsum = F.aggregate(onehot, F.lit(0.0), lambda s, v: s + v.cast("double"))
    return tsum * lse - picked


def logistic_grad(x: Column, y: Column, p: Column, weight: Column | None = None) -> Column:
    """Per-row gradient of BCE w.r.t. [w..., b]: (p - y) * [x, 1] (times row weight)."""
    r = p - y.cast("double")
    if weight is not None:
        r = r * weight
    return F.concat(F.transform(x, lambda v: v.cast("double") * r), F.array(r))
