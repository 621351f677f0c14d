"""Privacy accounting (A1–A7) and composition as column jobs.

Input is a table of runs or grid points with noise multiplier, training
size n, batch size, epochs and delta. Distinct (sigma, q) pairs (Rényi) or
(mu, delta) pairs (Gaussian DP) are evaluated once by an Arrow-batched
pandas UDF and joined back; the final minimum over orders is a SQL
higher-order expression.

Formulas (public: Mironov et al. 2019; Dong, Roth and Su 2019; Bu et al.
2019). Sampling rate q = b/n, steps T = epochs * n / b (real).
* GDP: mu = q sqrt(T) sqrt(exp(1/sigma^2) - 1); epsilon solves
  delta = Phi(-eps/mu + mu/2) - exp(eps) Phi(-eps/mu - mu/2).
* RDP of the subsampled Gaussian at order a:
  log E_{z~N(0, sigma^2)}[((1-q) + q exp((2z-1)/(2 sigma^2)))^a] / (a-1),
  integrated numerically in log space; epsilon = min_a T rdp(a) - log(delta)/(a-1).
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rényi orders (fixed values): 1.1, 1.2, ..., 10.9 and 12, 13, ..., 63.
RDP_ORDERS = [1 + x / 10.0 for x in range(1, 100)] + list(range(12, 64))
MAX_BROADCAST_PAIRS = 100_000


# ------------------------------------------------------------------ kernels

def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def rdp_subsampled_gaussian(q: float, sigma: float, orders=RDP_ORDERS) -> np.ndarray:
    """RDP of the Poisson-subsampled Gaussian mechanism at each order."""
    orders = np.asarray(orders, dtype=float)
    if sigma <= 0:
        return np.full(len(orders), np.inf)
    if q <= 0:
        return np.zeros(len(orders))
    if q >= 1:
        return orders / (2 * sigma ** 2)
    h = min(sigma, sigma * sigma) / 100.0
    lo = -12.0 * sigma - 1.0
    out = np.empty(len(orders))
    log_norm = -0.5 * math.log(2 * math.pi) - math.log(sigma)
    lq, l1q = math.log(q), math.log1p(-q)
    for i, a in enumerate(orders):
        hi = max(a, 1.0) + 12.0 * sigma + 1.0
        z = np.arange(lo, hi + h, h)
        u = (2 * z - 1) / (2 * sigma ** 2)
        lf = log_norm - z * z / (2 * sigma ** 2) + a * _log_add(np.full_like(u, l1q), lq + u)
        m = lf.max()
        log_a = m + math.log(np.exp(lf - m).sum() * h)
        out[i] = log_a / (a - 1)
    return out


def _phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def gdp_delta(eps: float, mu: float) -> float:
    return _phi(-eps / mu + mu / 2) - math.exp(eps) * _phi(-eps / mu - mu / 2)


def gdp_epsilon(mu: float, delta: float) -> float:
    """Smallest eps with delta(eps) <= delta (delta(eps) decreases in eps)."""
    if mu <= 0:
        return 0.0
    if gdp_delta(0.0, mu) <= delta:
        return 0.0
    lo, hi = 0.0, 1.0
    while gdp_delta(hi, mu) > delta:
        hi *= 2.0
        if hi > 1e6:
            return math.inf
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if gdp_delta(mid, mu) > delta:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-15 * max(1.0, hi):
            break
    return hi


def gdp_mu(n: float, batch: float, epochs: float, sigma: float) -> float:
    q = min(1.0, batch / n)
    steps = epochs * max(1.0, n / batch)          # at least one step an epoch is run
    return q * math.sqrt(steps) * math.sqrt(math.exp(1.0 / sigma ** 2) - 1.0)


@lru_cache(maxsize=1024)
def _curve(q: float, sigma: float) -> np.ndarray:
    """Curve of one step, kept: the epochs of a run and the trials of a grid share few (q, sigma)."""
    return rdp_subsampled_gaussian(q, sigma)


def rdp_epsilon(n: float, batch: float, epochs: float, sigma: float, delta: float) -> float:
    """A2 for one configuration (driver-side helper, used by tests)."""
    if sigma <= 0:
        return 0.0
    r = _curve(min(1.0, batch / n), sigma)
    steps = epochs * max(1.0, n / batch)
    o = np.asarray(RDP_ORDERS)
    return float(np.min(steps * r - math.log(delta) / (o - 1)))


# ------------------------------------------------------------------ UDFs

@F.pandas_udf(T.ArrayType(T.DoubleType()))
def rdp_curve_udf(q: pd.Series, sigma: pd.Series) -> pd.Series:
    return pd.Series([rdp_subsampled_gaussian(float(a), float(b)).tolist() for a, b in zip(q, sigma)])


@F.pandas_udf(T.DoubleType())
def gdp_epsilon_udf(mu: pd.Series, delta: pd.Series) -> pd.Series:
    return pd.Series([gdp_epsilon(float(m), float(d)) for m, d in zip(mu, delta)])


# ------------------------------------------------------------------ column jobs

def delta_policy(policy: str, n: Column) -> Column:
    """A4: delta = 1/n, 1e-6 or 1e-5."""
    if policy == "1/n":
        return F.lit(1.0) / n.cast("double")
    return F.lit(float(policy))


def _join_small(df: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    n = small.count()
    return df.join(F.broadcast(small) if n <= MAX_BROADCAST_PAIRS else small, on, "left")


def add_rdp_epsilon(df: DataFrame, noise: str = "noise_multiplier", n: str = "n", batch: str = "batch_size",
                    epochs: str = "epochs", delta: str = "delta", out: str = "epsilon") -> DataFrame:
    """A2/A3 (+A7): Rényi epsilon per row; 0 when the noise is 0."""
    q = F.least(F.lit(1.0), F.col(batch).cast("double") / F.col(n).cast("double"))  # a batch >= n is the whole set
    d = df.withColumn("_q", q).withColumn("_sigma", F.col(noise).cast("double"))
    pairs = d.where(F.col("_sigma") > 0).select("_q", "_sigma").distinct()
    curves = pairs.withColumn("_rdp", rdp_curve_udf(F.col("_q"), F.col("_sigma")))
    j = _join_small(d, curves, ["_q", "_sigma"])
    per = F.greatest(F.lit(1.0), F.col(n).cast("double") / F.col(batch).cast("double"))   # at least one step an epoch is run
    steps = F.col(epochs).cast("double") * per
    orders = F.array(*[F.lit(float(a)) for a in RDP_ORDERS])
    eps = F.array_min(F.zip_with("_rdp", orders,
                                 lambda r, a: steps * r - F.log(F.col(delta).cast("double")) / (a - F.lit(1.0))))
    return j.withColumn(out, F.when(F.col("_sigma") > 0, eps).otherwise(F.lit(0.0))).drop("_q", "_sigma", "_rdp")


def compose(df: DataFrame, by: list[str], delta: float, noise: str = "noise_multiplier", n: str = "n", batch: str = "batch_size",
            epochs: str = "epochs") -> DataFrame:
    """Budget spent by all mechanisms of each group together: (by..., mechanisms, unprotected, epsilon).

    Each row is a run with its own noise, rate and steps. Their Renyi curves
    add up order by order (one vector sum a group, combined before the
    shuffle); epsilon is the minimum over the orders of the summed curve, less
    than the sum of the single epsilons. Rows without noise are not private at
    all: they are counted in ``unprotected`` and leave epsilon as it is.
    """
    q = F.least(F.lit(1.0), F.col(batch).cast("double") / F.col(n).cast("double"))
    steps = F.col(epochs).cast("double") * F.greatest(F.lit(1.0), F.col(n).cast("double") / F.col(batch).cast("double"))
    d = df.select(*by, q.alias("_q"), F.col(noise).cast("double").alias("_sigma"), steps.alias("_steps"))
    # runs of one kind differ in steps only: add those up first
    kinds = d.where("_sigma > 0").groupBy(*by, "_q", "_sigma").agg(F.sum("_steps").alias("_steps"), F.count(F.lit(1)).alias("_m"))
    curves = kinds.select("_q", "_sigma").distinct().withColumn("_rdp", rdp_curve_udf(F.col("_q"), F.col("_sigma")))
    spent = _join_small(kinds, curves, ["_q", "_sigma"]).withColumn("_c", F.transform("_rdp", lambda r: r * F.col("_steps")))
    total = spent.groupBy(*by).agg(Summarizer.sum(array_to_vector("_c")).alias("_c"), F.sum("_m").alias("mechanisms"))
    orders = F.array(*[F.lit(float(a)) for a in RDP_ORDERS])
    eps = F.array_min(F.zip_with(vector_to_array("_c"), orders, lambda r, a: r - F.lit(math.log(delta)) / (a - F.lit(1.0))))
    every = d.groupBy(*by).agg(F.count(F.when(F.coalesce(F.col("_sigma"), F.lit(0.0)) <= 0, 1)).alias("unprotected"))
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    total = total.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "mechanisms", eps.alias("epsilon"))
    joined = every.join(total, on, "left") if by else every.crossJoin(total)       # without groups one row each
    return joined.select(*by, F.coalesce("mechanisms", F.lit(0)).alias("mechanisms"), "unprotected", F.coalesce("epsilon", F.lit(0.0)).alias("epsilon"))


def add_gdp_epsilon(df: DataFrame, noise: str = "noise_multiplier", n: str = "n", batch: str = "batch_size",
                    epochs: str = "epochs", delta: str = "delta", out: str = "epsilon") -> DataFrame:
    """A1 (+A7): Gaussian-DP (CLT) epsilon per row; 0 when the noise is 0."""
    nn, b, e, s = (F.col(c).cast("double") for c in (n, batch, epochs, noise))
    mu = F.least(F.lit(1.0), b / nn) * F.sqrt(e * F.greatest(F.lit(1.0), nn / b)) * F.sqrt(F.exp(F.lit(1.0) / (s * s)) - F.lit(1.0))
    d = df.withColumn("_mu", F.when(s > 0, mu)).withColumn("_delta", F.col(delta).cast("double"))
    pairs = d.where(F.col("_mu").isNotNull()).select("_mu", "_delta").distinct()
    sol = pairs.withColumn("_eps", gdp_epsilon_udf(F.col("_mu"), F.col("_delta")))
    j = _join_small(d, sol, ["_mu", "_delta"])
    return j.withColumn(out, F.when(s > 0, F.col("_eps")).otherwise(F.lit(0.0))).drop("_mu", "_delta", "_eps")


def per_epoch(df: DataFrame, epochs: str = "epochs", out: str = "epoch") -> DataFrame:
    """A5: one row per completed epoch (1..epochs), for epsilon after each."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(1), F.col(epochs).cast("int"))))


def budget_stop(df: DataFrame, run: list[str], epoch: str = "epoch", eps: str = "epsilon",
                budget: float = 5.0) -> DataFrame:
    """A run ends at the first epoch whose epsilon exceeds the budget.

    That epoch is kept (it was trained), later ones are dropped. The stop
    epoch is a per-run aggregate joined back, so it is known before training.
    """
    stop = df.groupBy(*run).agg(F.min(F.when(F.col(eps) > F.lit(budget), F.col(epoch))).alias("_stop"))
    j = df.join(stop, run)
    return j.where(F.col("_stop").isNull() | (F.col(epoch) <= F.col("_stop"))).drop("_stop")
