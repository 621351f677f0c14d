"""Clipped and noisy aggregation (D1–D4), private choice of keys.

Per-record vectors are clipped to L2 norm C inside the row projection,
summed per group with a partial (map-side) vector aggregate, and only
then receive Gaussian noise N(0, (C * noise_multiplier)^2) per coordinate.
Noise is attached to the aggregated (group, coordinate) cell and computed
from ``(secret seed, group, coordinate)`` with a Box–Muller transform of
md5 uniforms: it is added exactly once, does not depend on partitioning,
and a retried task reproduces it. The seed defaults to fresh entropy
(a known seed voids the guarantee); fixed seeds are for tests.
"""

from __future__ import annotations

import math
import secrets

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dpframe.functions.vec import clip_l2, l2_norm
from dpframe.keys import uniform01


def fresh_seed() -> str:
    return secrets.token_hex(16)


def gaussian(seed: str, *parts: Column) -> Column:
    """Standard normal draw determined by (seed, parts): Box–Muller on md5 uniforms."""
    # a null part is a value of its own, so that (null, a) and (a, null) get different draws
    txt = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts])
    u1 = uniform01(F.concat(txt, F.lit("|u1")))
    u2 = uniform01(F.concat(txt, F.lit("|u2")))
    u1 = F.greatest(u1, F.lit(2.0 ** -53))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def laplace(seed: str, *parts: Column) -> Column:
    """Standard Laplace draw determined by (seed, parts): inverse distribution function of one md5 uniform."""
    txt = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts])
    u = uniform01(F.concat(txt, F.lit("|lap"))) - F.lit(0.5)
    return -F.signum(u) * F.log(F.greatest(F.lit(1.0) - F.lit(2.0) * F.abs(u), F.lit(2.0 ** -53)))


def clip_rows(df: DataFrame, vec: str, clip: float, out: str = "clipped") -> DataFrame:
    """Each record's vector scaled to L2 norm at most ``clip``."""
    return df.withColumn(out, clip_l2(F.col(vec), clip))


def vector_sum(df: DataFrame, vec: str, by: list[str] | None = None) -> DataFrame:
    """Per group: element-wise sum of an array column and the row count.

    Uses the vector Summarizer (partial aggregation per partition, one
    d-vector per group shuffled), never an explode of n x d rows.
    """
    by = by or []
    g = df.groupBy(*by) if by else df
    agg = g.agg(Summarizer.sum(array_to_vector(F.col(vec))).alias("_s"), F.count(F.lit(1)).alias("n"))
    return agg.select(*by, vector_to_array("_s").alias("sum"), "n")


def noisy_sum(df: DataFrame, vec: str, clip: float, noise_multiplier: float, by: list[str] | None = None,
              seed: str | None = None, clip_first: bool = True) -> DataFrame:
    """Gaussian sum query, long output (by..., pos, noisy_sum).

    The exact sum and count are returned only when the noise is 0.
    sigma = clip * noise_multiplier on the sum; noise once per coordinate.
    """
    by = by or []
    seed = seed if seed is not None else fresh_seed()
    d = df.withColumn("_v", clip_l2(F.col(vec), clip)) if clip_first else df.withColumn("_v", F.col(vec))
    s = vector_sum(d, "_v", by)
    e = s.select(*by, "n", F.posexplode("sum").alias("pos", "sum"))
    sigma = float(clip) * float(noise_multiplier)
    noise = gaussian(seed, *[F.col(c) for c in by], F.col("pos")) * F.lit(sigma) if sigma > 0 else F.lit(0.0)
    exact = ["sum", "n"] if sigma == 0 else []
    return e.select(*by, F.col("pos").cast("int").alias("pos"), (F.col("sum") + noise).alias("noisy_sum"), *exact)


def per_user_noisy_sum(events: DataFrame, user: str, key: str, value: str, keys: list[str], clip: float,
                       noise_multiplier: float, seed: str | None = None) -> DataFrame:
    """D3: one record per user (their per-key totals as a vector), clipped, summed, noised.

    ``keys`` must be public (a fixed domain); keys found in the data go
    through :func:`private_key_sums`. Also a noisy user count (sensitivity 1) and the noisy mean per key.
    A user with a third of all events is still one bounded record.
    """
    seed = seed if seed is not None else fresh_seed()
    per_user = events.groupBy(user).pivot(key, keys).agg(F.sum(value))
    vec = F.array(*[F.coalesce(F.col(f"`{k}`"), F.lit(0.0)).cast("double") for k in keys])
    rec = per_user.select(vec.alias("v"))
    s = noisy_sum(rec, "v", clip, noise_multiplier, None, seed)
    n = rec.agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(k) for k in keys])
    sigma = float(clip) * float(noise_multiplier)
    cnt_noise = gaussian(seed, F.lit("count")) * F.lit(float(noise_multiplier)) if sigma > 0 else F.lit(0.0)
    exact = ["sum", F.col("n").alias("users")] if sigma == 0 else []
    s = s.drop("n").crossJoin(F.broadcast(n))                                # one row
    out = s.select(F.element_at(names, F.col("pos") + 1).alias(key), "noisy_sum",
                   (F.col("n") + cnt_noise).alias("noisy_users"), *exact)
    return out.withColumn("noisy_mean", F.col("noisy_sum") / F.greatest(F.col("noisy_users"), F.lit(1.0)))


def key_threshold(epsilon: float, delta: float, keys_per_user: int) -> float:
    """Least noisy number of users from which on a key may be shown: a key of one user passes with probability delta.

    Laplace noise of scale k / epsilon on the counts, each user in at most k
    keys (Wilson et al. 2020, "Differentially private SQL with bounded user
    contribution").
    """
    k = keys_per_user
    # 2 - 2 (1 - delta)^(1/k), without cancellation
    return 1.0 - k / epsilon * math.log(-2.0 * math.expm1(math.log1p(-delta) / k))


def bounded_keys(events: DataFrame, user: str, key: str, value: str | None, keys_per_user: int, seed) -> DataFrame:
    """(user, key[, total]) of at most ``keys_per_user`` keys of each user, drawn by hash.

    Each user's rows of a key are one record; nulls take no part. The draw is
    a per-user limit, which Spark applies in every partition before it
    shuffles, so a user with very many keys is no task's whole work.
    """
    total = F.sum(F.col(value).cast("double")) if value else F.count(F.lit(1))
    pairs = (events.where(F.col(user).isNotNull() & F.col(key).isNotNull()).groupBy(user, key).agg(total.alias("total"))
             .withColumn("_draw", F.md5(F.concat_ws("|", F.col(user).cast("string"), F.col(key).cast("string"), F.lit(str(seed))))))
    rank = F.row_number().over(Window.partitionBy(user).orderBy("_draw", key))
    out = pairs.withColumn("_rank", rank).where(F.col("_rank") <= keys_per_user).drop("_rank", "_draw")
    return out if value else out.drop("total")


def private_keys(events: DataFrame, user: str, key: str, epsilon: float, delta: float, keys_per_user: int,
                 seed: str | None = None, bounded: DataFrame | None = None) -> DataFrame:
    """D3 with unknown keys: (key, noisy_users) of the keys that may be shown under (epsilon, delta).

    A key is shown if its number of users, with noise, reaches
    :func:`key_threshold`; no exact count and no other key leaves.
    """
    seed = seed if seed is not None else fresh_seed()
    kept = bounded if bounded is not None else bounded_keys(events, user, key, None, keys_per_user, seed)
    noise = laplace(seed, F.col(key)) * F.lit(keys_per_user / epsilon)
    return (kept.groupBy(key).agg(F.count(F.lit(1)).alias("_users")).select(key, (F.col("_users") + noise).alias("noisy_users"))
            .where(F.col("noisy_users") >= key_threshold(epsilon, delta, keys_per_user)))


def private_key_sums(events: DataFrame, user: str, key: str, value: str, clip: float, noise_multiplier: float, epsilon: float,
                     delta: float, keys_per_user: int, seed: str | None = None) -> DataFrame:
    """D3 with unknown keys: noisy users, sum and mean of every key that :func:`private_keys` shows.

    A user's totals over the shown keys are clipped to L2 norm ``clip``; the
    sums get Gaussian noise of clip * noise_multiplier. Rows stay long (user,
    key), so there may be any number of keys. Spends (epsilon, delta) on the
    keys and users, and what noise_multiplier costs on the sums.
    """
    seed = seed if seed is not None else fresh_seed()
    kept = bounded_keys(events, user, key, value, keys_per_user, seed)
    shown = private_keys(events, user, key, epsilon, delta, keys_per_user, seed, kept.select(user, key))
    rows = kept.join(shown, key)
    norms = rows.groupBy(user).agg(F.sqrt(F.sum(F.col("total") * F.col("total"))).alias("_norm"))
    factor = F.when(F.col("_norm") > clip, F.lit(float(clip)) / F.col("_norm")).otherwise(F.lit(1.0))
    sums = rows.join(norms, user).groupBy(key, "noisy_users").agg(F.sum(F.col("total") * factor).alias("_sum"))
    noisy = F.col("_sum") + gaussian(seed, F.col(key)) * F.lit(float(clip) * float(noise_multiplier))
    return sums.select(key, "noisy_users", noisy.alias("noisy_sum")) \
        .withColumn("noisy_mean", F.col("noisy_sum") / F.greatest(F.col("noisy_users"), F.lit(1.0)))


def microbatch_noisy_mean(df: DataFrame, vec: str, clip: float, noise_multiplier: float, num_microbatches: int,
                          step: str = "step", micro: str = "microbatch", seed: str | None = None) -> DataFrame:
    """Mean per microbatch, clip each mean, sum, add noise, divide by microbatches.

    Output long (step, pos, value), with the exact clean_value only when the noise is 0.
    """
    seed = seed if seed is not None else fresh_seed()
    means = vector_sum(df, vec, [step, micro]).select(
        step, micro, F.transform("sum", lambda x: x / F.col("n")).alias("_m"))
    s = noisy_sum(means, "_m", clip, noise_multiplier, [step], seed)
    m = F.lit(float(num_microbatches))
    clean = [(F.col("sum") / m).alias("clean_value")] if "sum" in s.columns else []
    return s.select(step, "pos", (F.col("noisy_sum") / m).alias("value"), *clean)


def clipped_norms(df: DataFrame, vec: str, clip: float) -> DataFrame:
    """Norm before and after clipping per row (D1 check)."""
    return df.select("*", l2_norm(F.col(vec)).alias("norm"), l2_norm(clip_l2(F.col(vec), clip)).alias("clipped_norm"))
