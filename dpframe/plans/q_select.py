"""Queries for feature selection and components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from dpframe.operators import prepare, select
from dpframe.plans.datasets import labelled_lineitem, table
from dpframe.plans.registry import register, rounded
from dpframe.session import checkpoint_dir
from dpframe.sources import files

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATS = {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"]}
LABEL_SQL = "CAST(l_quantity >= 50 AND l_discount >= 0.05 AS INT)"


def _features(spark, sf_dir):
    li = labelled_lineitem(spark, sf_dir)
    cats = prepare.onehot_fit(li, list(CATS))
    num = {c: F.col(c) for c in NUM}
    disc = dict(prepare.onehot_columns(cats))
    return li, num, disc


def _long_sql() -> str:
    parts = [f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, {LABEL_SQL} AS label FROM lineitem" for c in NUM]
    parts += [f"SELECT '{c}_{v}', CAST(CAST({c} = '{v}' AS INT) AS DOUBLE), {LABEL_SQL} FROM lineitem"
              for c, vs in CATS.items() for v in vs]
    return " UNION ALL ".join(parts)


@register("y1_variance_threshold", f"""
SELECT feature, round(var_pop(x), 9) AS variance, CAST(var_pop(x) > 0.16 AS INTEGER) AS kept
FROM ({_long_sql()}) l GROUP BY feature""")
def y1_variance_threshold(spark, sf_dir):
    """Population variance per feature; keep those above 0.8 * 0.2 = 0.16."""
    li, num, disc = _features(spark, sf_dir)
    return rounded(select.variance_threshold(li, {**num, **disc}, 0.16))


def _mi_sql() -> str:
    binned = " UNION ALL ".join(
        [f"""SELECT '{c}' AS feature, CASE WHEN mx = mn THEN 0.0 ELSE
               CAST(least(floor((CAST({c} AS DOUBLE) - mn) / (mx - mn) * 10.0), 9) AS DOUBLE) END AS bin, label
             FROM (SELECT {c}, {LABEL_SQL} AS label FROM lineitem) a,
                  (SELECT min(CAST({c} AS DOUBLE)) AS mn, max(CAST({c} AS DOUBLE)) AS mx FROM lineitem) m""" for c in NUM]
        + [f"SELECT '{c}_{v}', CAST(CAST({c} = '{v}' AS INT) AS DOUBLE), {LABEL_SQL} FROM lineitem"
           for c, vs in CATS.items() for v in vs])
    return f"""WITH b AS ({binned}),
c AS (SELECT feature, bin, label, count(*) AS c FROM b GROUP BY feature, bin, label),
t AS (SELECT *, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, bin) AS cb,
             sum(c) OVER (PARTITION BY feature, label) AS cy FROM c)
SELECT feature, CAST(sum(c / n * ln(c * n / (cb * cy))) AS DOUBLE) AS mi FROM t GROUP BY feature"""


def _mi(spark, sf_dir):
    li, num, disc = _features(spark, sf_dir)
    return select.mutual_information(li, "label", num, disc, bins=10)


@register("y2_mutual_information", f"SELECT feature, round(mi, 9) AS mi FROM ({_mi_sql()}) m")
def y2_mutual_information(spark, sf_dir):
    """Y2: binned mutual information of each feature with the rare label (10 equal-width bins)."""
    return rounded(_mi(spark, sf_dir))


def _topk_sql(min_k: int, max_k: int, cap: int | None = None) -> str:
    lim = f" AND rank <= {cap}" if cap else ""
    return f"""WITH m AS ({_mi_sql()}),
k AS (SELECT greatest({min_k}, least({max_k}, CASE WHEN sum(CAST(mi > 0 AS INT)) > 0 THEN sum(CAST(mi > 0 AS INT)) ELSE count(*) END)) AS k FROM m),
r AS (SELECT feature, mi, row_number() OVER (ORDER BY mi DESC, feature) AS rank FROM m)
SELECT feature, round(mi, 9) AS mi, CAST(rank AS INTEGER) AS rank FROM r, k WHERE rank <= k.k{lim}"""


@register("y3_top_k_by_mi", _topk_sql(3, 5))
def y3_top_k_by_mi(spark, sf_dir):
    """k = max(3, min(5, #positive MI)) best features by MI (ties by name)."""
    out = select.top_k_by_score(_mi(spark, sf_dir), "mi", "feature", 3, 5)
    return rounded(out.withColumn("rank", F.col("rank").cast("int")))


@register("y8_feature_report", _topk_sql(20, 200, 10))
def y8_feature_report(spark, sf_dir):
    """Report of the selected features with their scores, top 10."""
    out = select.top_k_by_score(_mi(spark, sf_dir), "mi", "feature", 20, 200).where(F.col("rank") <= 10)
    return rounded(out.withColumn("rank", F.col("rank").cast("int")))


@register("y7_covariance", """
WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos
           FROM embeddings)
SELECT a.pos AS i, b.pos AS j, round(covar_pop(a.x, b.x), 9) AS cov
FROM e a JOIN e b ON a.vec_id = b.vec_id GROUP BY a.pos, b.pos""")
def y7_covariance(spark, sf_dir):
    """Population covariance matrix of the 64-dim embeddings (long form)."""
    e = table(spark, sf_dir, "embeddings")
    _, cov, _ = select.covariance(e, "embedding")
    d = cov.shape[0]
    rows = [(i, j, float(cov[i, j])) for i in range(d) for j in range(d)]
    return rounded(spark.createDataFrame(rows, "i int, j int, cov double"))


def _axes_sql(k: int) -> str:
    """CTEs of the first ``k`` principal axes: ``axes`` (component, ev) and ``loadings`` (component, pos, v), ``trace``; and ``e`` (vec_id, x, pos).

    The dominant axis of the covariance is any column of a high power of it
    (squared 16 times), and the next one that of the matrix less its part.
    """
    ctes = ["""e AS MATERIALIZED (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS pos FROM embeddings)""",
            """c0 AS MATERIALIZED (SELECT a.pos AS i, b.pos AS j, covar_pop(a.x, b.x) AS x FROM e a JOIN e b USING (vec_id) GROUP BY a.pos, b.pos)""",
            """trace AS MATERIALIZED (SELECT sum(x) AS total FROM c0 WHERE i = j)"""]
    for n in range(k):
        last = f"c{n}"
        for q in range(16):
            ctes.append(f"""s{n}_{q} AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS x FROM {last} a JOIN {last} b ON a.j = b.j GROUP BY a.i, b.i)""")
            ctes.append(f"""p{n}_{q} AS MATERIALIZED (SELECT i, j, x / (SELECT sum(x) FROM s{n}_{q} WHERE i = j) AS x FROM s{n}_{q})""")
            last = f"p{n}_{q}"
        ctes.append(f"""u{n} AS MATERIALIZED (SELECT i AS pos, x FROM {last} WHERE j = (SELECT i FROM {last} WHERE i = j ORDER BY x DESC LIMIT 1))""")
        ctes.append(f"""v{n} AS MATERIALIZED (SELECT pos, x / (SELECT sqrt(sum(x * x)) FROM u{n}) * (SELECT sign(x) FROM u{n} ORDER BY abs(x) DESC LIMIT 1) AS v FROM u{n})""")
        ctes.append(f"""l{n} AS MATERIALIZED (SELECT sum(c.x * a.v * b.v) AS ev FROM c{n} c JOIN v{n} a ON a.pos = c.i JOIN v{n} b ON b.pos = c.j)""")
        ctes.append(f"""c{n + 1} AS MATERIALIZED (SELECT c.i, c.j, c.x - l.ev * a.v * b.v AS x FROM c{n} c JOIN v{n} a ON a.pos = c.i JOIN v{n} b ON b.pos = c.j CROSS JOIN l{n} l)""")
    ctes.append("axes AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {n} AS component, ev FROM l{n}" for n in range(k)) + ")")
    ctes.append("loadings AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {n} AS component, pos, v FROM v{n}" for n in range(k)) + ")")
    return ",\n".join(ctes)


_PROJECTED = """means AS (SELECT pos, avg(x) AS mu FROM e GROUP BY pos),
z AS MATERIALIZED (SELECT vec_id, component, sum((e.x - mu) * v) AS z FROM e JOIN means USING (pos) JOIN loadings USING (pos) GROUP BY vec_id, component)"""


@register("y4_pca_components", f"""WITH {_axes_sql(10)}, {_PROJECTED}
SELECT CAST(component AS INTEGER) AS component, round(var_pop(z), 9) AS projected_variance, round(avg(z), 9) + 0.0 AS projected_mean,
       round(any_value(ev) / any_value(total), 9) AS explained_variance_ratio
FROM z JOIN axes USING (component) CROSS JOIN trace GROUP BY component""")
def y4_pca_components(spark, sf_dir):
    """PCA (centred) of the embeddings, 10 components; ratio and projected variance per component."""
    e = table(spark, sf_dir, "embeddings")
    mean, comps, ratio = select.pca_fit(e, "embedding", 10)
    proj = e.select(select.pca_transform(F.col("embedding"), mean, comps).alias("z"))
    v = proj.select(F.posexplode("z").alias("component", "z")).groupBy("component").agg(
        F.var_pop("z").alias("projected_variance"), F.avg("z").alias("projected_mean"))
    r = spark.createDataFrame([(j, float(ratio[j])) for j in range(10)], "component int, explained_variance_ratio double")
    out = rounded(v.join(r, "component"))
    return out.withColumn("projected_mean", F.col("projected_mean") + F.lit(0.0))


@register("y4_axes_residual", """
WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
t AS (SELECT sum(v) AS total FROM (SELECT var_pop(x) AS v FROM e GROUP BY pos) y)
SELECT CAST(c AS INTEGER) AS component, 0.0::DOUBLE AS residual, 0.0::DOUBLE AS orthonormality, round(total, 9) AS total_variance FROM range(10) r(c), t""")
def y4_axes_residual(spark, sf_dir):
    """|C v - lambda v| of each axis (one more pass over the rows), its distance from orthonormality, and the total variance."""
    e = table(spark, sf_dir, "embeddings")
    mean, axes, vals, total, n = select.principal_axes(e, "embedding", 10)
    cv = select._times_covariance(e, "embedding", mean, axes.T, n, 1)
    residual = np.abs(cv - axes.T * vals).max(axis=0)
    off = np.abs(axes @ axes.T - np.eye(len(axes))).max(axis=1)
    rows = [(j, round(float(residual[j]), 9), round(float(off[j]), 9), round(total, 9)) for j in range(10)]
    return spark.createDataFrame(rows, "component int, residual double, orthonormality double, total_variance double")


@register("y5_choose_components")
def y5_choose_components(spark, sf_dir):
    """K from cumulative explained variance 0.95, clipped to [10, 300] and the width."""
    e = table(spark, sf_dir, "embeddings")
    _, _, ratio = select.pca_fit(e, "embedding")
    ratios = spark.createDataFrame([(j, float(r)) for j, r in enumerate(ratio)], "component int, ratio double")
    n = e.agg(F.count(F.lit(1)).alias("n"))
    return rounded(select.choose_components(ratios, 0.95, 10, 300).crossJoin(n))      # one row each


@register("y6_append_components", f"""WITH {_axes_sql(10)}, {_PROJECTED},
f AS (SELECT pos - 1 AS pos, x AS v FROM e UNION ALL SELECT 64 + component, z FROM z)
SELECT CAST(pos AS INTEGER) AS pos, count(*) AS n, round(sum(v), 6) + 0.0 AS s, round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM f GROUP BY pos""")
def y6_append_components(spark, sf_dir):
    """Original features with the 10 principal components appended; stats per position."""
    from dpframe.plans.q_prepare import _long_stats
    e = table(spark, sf_dir, "embeddings")
    mean, comps, _ = select.pca_fit(e, "embedding", 10)
    both = e.select(F.concat(F.transform("embedding", lambda v: v.cast("double")),
                             select.pca_transform(F.col("embedding"), mean, comps)).alias("f"))
    return _long_stats(both, "f").withColumn("s", F.col("s") + F.lit(0.0))


@register("s9_feature_list_report", f"""
SELECT string_agg(feature || ': ' || printf('%.6f', round(mi, 6)), chr(10) ORDER BY rank) AS value FROM ({_topk_sql(3, 5)}) t""")
def s9_feature_list_report(spark, sf_dir):
    """The selected features with their scores as one text file, read back whole (k rows)."""
    top = select.top_k_by_score(_mi(spark, sf_dir), "mi", "feature", 3, 5)
    line = F.format_string("%s: %.6f", "feature", F.round("mi", 6))
    text = top.agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l")) \
        .select(F.array_join(F.col("l.line"), "\n").alias("value"))
    path = f"{checkpoint_dir(spark)}/feature-list-{uuid.uuid4().hex}"
    files.write_text_report(text, path)
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\n$", "").alias("value"))
