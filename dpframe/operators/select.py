"""Feature selection and projection to components.

Variance and mutual information are single aggregation passes over an
unpivoted (feature, value) view; map-side partial aggregation keeps the
shuffle at (partitions x features x bins) rows. The principal axes come from
block Krylov iteration: each pass multiplies a block of vectors by the
covariance without forming it (X^T (X Q) per partition, broadcast Q, partial
d x block sums), so the driver holds the block basis and no d x d matrix,
unless as many axes are asked for.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PCA_DIM = 5000
COLLECT_PARTIALS_UP_TO = 64


def _long(df: DataFrame, cols: dict[str, Column], keep=()) -> DataFrame:
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), c.cast("double").alias("x"))
                                               for n, c in cols.items()])).alias("_f")).select(*keep, "_f.feature", "_f.x")


def variances(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Population variance of every feature (one pass)."""
    return _long(df, cols).groupBy("feature").agg(F.var_pop("x").alias("variance"))


def variance_threshold(df: DataFrame, cols: dict[str, Column], threshold: float = 0.0) -> DataFrame:
    """(feature, variance, kept) with kept = variance > threshold; error when nothing is kept."""
    v = variances(df, cols).withColumn("kept", (F.col("variance") > F.lit(threshold)).cast("int"))
    if v.where("kept = 1").limit(1).count() == 0:
        raise ValueError(f"no feature has variance above {threshold}")
    return v


def mutual_information(df: DataFrame, label: str, numeric: dict[str, Column], discrete: dict[str, Column],
                       bins: int = 10) -> DataFrame:
    """Y2 (+P11): mutual information of each feature with the label, in nats.

    Discrete (indicator) features use their values; numeric features use
    ``bins`` equal-width bins between their min and max (the reference's
    k-NN estimator is replaced by this binned estimate). A feature whose
    MI is undefined gets 0.
    """
    parts = []
    if numeric:
        mm = df.agg(*[x for n, c in numeric.items()
                      for x in (F.min(c.cast("double")).alias(f"lo_{n}"), F.max(c.cast("double")).alias(f"hi_{n}"))]).first()
        bcols = {}
        for n, c in numeric.items():
            lo, hi = mm[f"lo_{n}"], mm[f"hi_{n}"]
            if lo is None or hi is None or hi == lo:
                bcols[n] = F.lit(0).cast("double")
            else:
                b = F.floor((c.cast("double") - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins)))
                bcols[n] = F.least(b, F.lit(bins - 1)).cast("double")
        parts.append(bcols)
    if discrete:
        parts.append({n: c.cast("double") for n, c in discrete.items()})
    cols = {k: v for p in parts for k, v in p.items()}
    lng = _long(df, cols, keep=[label]).withColumnRenamed("x", "bin")
    c = lng.groupBy("feature", "bin", label).agg(F.count(F.lit(1)).alias("c"))
    wf = Window.partitionBy("feature")
    c = (c.withColumn("n", F.sum("c").over(wf))
         .withColumn("cb", F.sum("c").over(Window.partitionBy("feature", "bin")))
         .withColumn("cy", F.sum("c").over(Window.partitionBy("feature", label))))
    term = F.col("c") / F.col("n") * F.log((F.col("c").cast("double") / F.col("cb")) * (F.col("n").cast("double") / F.col("cy")))
    mi = c.groupBy("feature").agg(F.sum(term).alias("mi"))
    return mi.select("feature", F.coalesce(F.nanvl("mi", F.lit(None).cast("double")), F.lit(0.0)).alias("mi"))


def top_k_by_score(scores: DataFrame, score: str = "mi", name: str = "feature", min_k: int = 20,
                   max_k: int = 200) -> DataFrame:
    """Keep k = max(min_k, min(max_k, #positive)) best features (all candidates when none is positive)."""
    stats = scores.agg(F.sum((F.col(score) > 0).cast("int")).alias("pos"), F.count(F.lit(1)).alias("tot")).first()
    pos, tot = int(stats["pos"] or 0), int(stats["tot"])
    k = max(min_k, min(max_k, pos if pos > 0 else tot))
    w = Window.orderBy(F.col(score).desc(), F.col(name))  # one row per feature: bounded
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ------------------------------------------------------------------ covariance and PCA

def covariance(df: DataFrame, vec: str, max_dim: int = MAX_PCA_DIM) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, population covariance, n) of an array column, distributed.

    Pass 1: mean and count (vector Summarizer). Pass 2: per partition the
    centred X^T X, reduced to one d x d matrix.
    """
    first = df.select(array_to_vector(F.col(vec)).alias("_v")).agg(
        Summarizer.mean(F.col("_v")).alias("m"), F.count(F.lit(1)).alias("n")).select(
        vector_to_array("m").alias("m"), "n").first()
    mean, n = np.asarray(first["m"]), int(first["n"])
    d = len(mean)
    if d > max_dim:
        raise ValueError(f"covariance of width {d} exceeds max_dim = {max_dim}")
    bc = df.sparkSession.sparkContext.broadcast(mean)

    def part(it):
        m = bc.value
        acc = np.zeros((len(m), len(m)))
        for pdf in it:
            if len(pdf):
                X = np.stack(pdf[vec].to_numpy()).astype(np.float64) - m
                acc += X.T @ X
        yield pd.DataFrame({"g": [acc.ravel().tolist()]})

    partial = df.select(vec).mapInPandas(part, "g array<double>")
    if df.rdd.getNumPartitions() <= COLLECT_PARTIALS_UP_TO:
        G = np.sum([np.asarray(r["g"]) for r in partial.collect()], axis=0)
    else:
        G = np.asarray(partial.agg(vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g")).first()["g"])
    bc.destroy()
    return mean, G.reshape(d, d) / n, n


def _times_covariance(df: DataFrame, vec: str, mean: np.ndarray, q: np.ndarray, n: int, parts: int) -> np.ndarray:
    """Covariance times a block of vectors (d x b): one pass, a d x b partial sum per partition."""
    bc = df.sparkSession.sparkContext.broadcast((mean, q))

    def part(it):
        m, block = bc.value
        acc, seen = np.zeros(block.shape), False
        for pdf in it:
            if len(pdf):
                x = np.stack(pdf[vec].to_numpy()).astype(np.float64) - m
                acc += x.T @ (x @ block)
                seen = True
        if seen:
            yield pd.DataFrame({"g": [acc.ravel()]})

    partial = df.select(vec).mapInPandas(part, "g array<double>")
    if parts > COLLECT_PARTIALS_UP_TO:
        groups = F.pmod(F.spark_partition_id(), F.lit(COLLECT_PARTIALS_UP_TO))
        partial = partial.groupBy(groups).agg(vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g"))
    out = np.sum([np.asarray(r["g"]) for r in partial.select("g").collect()], axis=0)
    bc.destroy()
    return out.reshape(q.shape) / n


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The part of ``block`` outside ``basis`` as orthonormal columns; directions already there are left out."""
    for _ in range(2):                                  # twice is enough for full precision
        block = block - basis @ (basis.T @ block)
    q, r = np.linalg.qr(block)
    keep = np.abs(np.diag(r)) > 1e-10 * max(np.abs(r).max(), 1e-300)
    q = q[:, keep]
    q = q - basis @ (basis.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def principal_axes(df: DataFrame, vec: str, k: int, tol: float = 1e-11, extra: int = 8, max_basis: int | None = None,
                   seed: int = 0, max_passes: int = 300):
    """(mean, axes k x d, variances k, total variance, n) by block Krylov iteration with full reorthogonalisation.

    The basis grows by one block of residuals C v - lambda v a pass, until
    that of every wanted axis is below ``tol`` times the total variance. At
    ``max_basis`` columns (default 4 (k + extra) + 40) it is cut back to its
    best directions and goes on; axes that have not
    settled after ``max_passes`` raise. Sign: the largest loading is positive.
    """
    df = df.select(vec).where(F.col(vec).isNotNull())
    parts = max(1, df.rdd.getNumPartitions())
    v = df.select(array_to_vector(F.col(vec)).alias("_v")).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s"))
    first = v.select(vector_to_array("s.mean").alias("m"), vector_to_array("s.variance").alias("v"), F.col("s.count").alias("n")).first()
    mean, n = np.asarray(first["m"]), int(first["n"])
    d = len(mean)
    k = min(k, d)
    total = float(np.sum(first["v"])) * (n - 1) / n if n > 1 else 0.0
    if total <= 0:
        return mean, np.eye(d)[:k], np.zeros(k), 0.0, n
    block = min(d, k + extra)
    limit = min(d, max_basis or 4 * block + 40)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, block)))[0]
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    for _ in range(max_passes):
        cq = _times_covariance(df, vec, mean, q, n, parts)
        basis, image = np.hstack([basis, q]), np.hstack([image, cq])
        t = basis.T @ image
        vals, y = np.linalg.eigh((t + t.T) / 2)
        order = np.argsort(vals)[::-1]
        vals, y = vals[order], y[:, order]
        axes = basis @ y[:, :k]
        rest = image @ y[:, :block] - (basis @ y[:, :block]) * vals[:block]
        if basis.shape[1] >= d or np.linalg.norm(rest[:, :k], axis=0).max() <= tol * total:
            break
        if limit < d and basis.shape[1] + block > limit:     # thick restart: the best directions stay, with their images
            held = y[:, :min(2 * k, limit - block)]
            basis, image = basis @ held, image @ held
        q = _orthonormal(rest, basis)                   # what the covariance adds to the basis
        if not q.shape[1]:
            q = _orthonormal(np.random.default_rng(seed + basis.shape[1]).normal(size=(d, block)), basis)
            if not q.shape[1]:
                break
    else:
        raise RuntimeError(f"axes have not settled after {max_passes} passes: ask for fewer, or allow a larger basis")
    axes = axes * np.sign(axes[np.argmax(np.abs(axes), axis=0), np.arange(k)])
    return mean, axes.T, np.clip(vals[:k], 0.0, None), total, n


def pca_fit(df: DataFrame, vec: str, k: int | None = None):
    """Principal axes of the centred data: (mean, components k x d, explained variance ratio of each).

    ``k=None`` gives all d axes (the basis, d x d, then is the result).
    """
    if k is None:
        k = df.agg(F.max(F.size(vec))).first()[0]
    mean, axes, vals, total, _ = principal_axes(df, vec, k)
    return mean, axes, vals / total if total > 0 else vals


def choose_components(ratios: DataFrame, target: float = 0.95, min_k: int = 10, max_k: int = 300) -> DataFrame:
    """Y5 on (component, ratio) rows, one per axis: (k, retained, d).

    The first component whose running ratio reaches the target gives k, kept
    within [min_k, max_k] and the number d of components.
    """
    upto = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)     # d rows
    run = ratios.select("component", F.sum("ratio").over(upto).alias("reached"))
    stop = run.agg(F.count("*").alias("d"), F.min(F.when(F.col("reached") >= target, F.col("component") + 1)).alias("first"))
    k = F.least(F.greatest(F.coalesce("first", "d"), F.lit(min_k)), F.lit(max_k), F.col("d"))
    stop = stop.select(k.cast("int").alias("k"), F.col("d").cast("int").alias("d"))
    return run.join(F.broadcast(stop), F.col("component") == F.col("k") - 1).select("k", F.col("reached").alias("retained"), "d")


def pca_transform(x: Column, mean: np.ndarray, comps: np.ndarray) -> Column:
    """Project centred rows on the components: Arrow batches times the loadings, which travel once with the function."""
    shift, load = np.asarray(mean), np.ascontiguousarray(comps.T)

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        ok = v.notna().to_numpy()
        z = iter((np.stack(v[ok].to_numpy()).astype(np.float64) - shift) @ load) if ok.any() else iter(())
        return pd.Series([next(z) if x else None for x in ok], index=v.index, dtype=object)

    return project(x)
