"""Queries for evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from dpframe.functions import vec
from dpframe.operators import evaluate
from dpframe.plans.q_flagship import report_sql, scored_sql, scored_splits
from dpframe.plans.registry import register, rounded


def _scored(spark, sf_dir):
    return scored_splits(spark, sf_dir)


@register("m1_threshold_strict_vs_inclusive", scored_sql() + """
SELECT split, CAST(sum(CAST(score > 0.2 AS INT)) AS BIGINT) AS pred_strict,
       CAST(sum(CAST(score >= 0.2 AS INT)) AS BIGINT) AS pred_inclusive FROM scored GROUP BY split""")
def m1_threshold(spark, sf_dir):
    """M1: predicted positives with ``>`` (DP scripts) and ``>=`` (the others) at 0.2."""
    s = _scored(spark, sf_dir)
    return s.groupBy("split").agg(
        F.sum(evaluate.predict(F.col("score"), 0.2, True)).cast("long").alias("pred_strict"),
        F.sum(evaluate.predict(F.col("score"), 0.2, False)).cast("long").alias("pred_inclusive"))


@register("m2_confusion_matrix", scored_sql() + """
SELECT sp.split, a.actual, p.predicted, CAST(count(s.label) AS BIGINT) AS n
FROM (SELECT DISTINCT split FROM scored) sp, (VALUES (0), (1)) a(actual), (VALUES (0), (1)) p(predicted)
LEFT JOIN scored s ON s.split = sp.split AND s.label = a.actual AND CAST(s.score > 0.2 AS INT) = p.predicted
GROUP BY sp.split, a.actual, p.predicted""")
def m2_confusion_matrix(spark, sf_dir):
    """Confusion matrix in long form (split, actual, predicted, n); all four cells."""
    s = _scored(spark, sf_dir).withColumn("pred", evaluate.predict(F.col("score"), 0.2, True))
    return evaluate.confusion_long(evaluate.confusion(s, "label", "pred", ["split"]), ["split"])


@register("m3_report_at_0_2", scored_sql() + "\n" + report_sql(
    "(SELECT split, label, CAST(score > 0.2 AS INT) AS pred FROM scored) s"))
def m3_report(spark, sf_dir):
    """M3–M6: per-class precision/recall/F1/support, macro, weighted, accuracy at 0.2."""
    return rounded(evaluate.classification_report(_scored(spark, sf_dir), "label", "score", 0.2, True, ["split"]))


@register("m10_fit_metrics_at_0_5", scored_sql() + "\n" + report_sql(
    "(SELECT split, label, CAST(score >= 0.5 AS INT) AS pred FROM scored) s"))
def m10_fit_metrics(spark, sf_dir):
    """Precision, recall and accuracy at 0.5 with ``>=`` (fit-time metrics)."""
    return rounded(evaluate.classification_report(_scored(spark, sf_dir), "label", "score", 0.5, False, ["split"]))


def _auc200_sql() -> str:
    return scored_sql() + """,
th AS (SELECT CAST(i AS INTEGER) AS i, CASE WHEN i = 0 THEN 0.0 - 1e-7 WHEN i = 199 THEN 1.0 + 1e-7
                                     ELSE CAST(i AS DOUBLE) / 199.0 END AS t FROM range(200) r(i)),
c AS (SELECT split, i, CAST(sum(CASE WHEN label = 1 AND score > t THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
             CAST(sum(CASE WHEN label <> 1 AND score > t THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
             CAST(sum(CASE WHEN label = 1 AND NOT (score > t) THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
             CAST(sum(CASE WHEN label <> 1 AND NOT (score > t) THEN 1 ELSE 0 END) AS DOUBLE) AS tn
      FROM scored, th GROUP BY split, i),
l AS (SELECT *, lead(tp) OVER w AS tp1, lead(fp) OVER w AS fp1, lead(fn) OVER w AS fn1, lead(tn) OVER w AS tn1
      FROM c WINDOW w AS (PARTITION BY split ORDER BY i)),
terms AS (
  SELECT split,
    (fp / (fp + tn + 1e-6) - fp1 / (fp1 + tn1 + 1e-6)) * ((tp + 1e-6) / (tp + fn + 1e-6) + (tp1 + 1e-6) / (tp1 + fn1 + 1e-6)) / 2.0 AS roc,
    tp - tp1 AS dtp, (tp + fp) AS p0, (tp1 + fp1) AS p1, tp1, fn1
  FROM l WHERE tp1 IS NOT NULL),
pr AS (SELECT *, CASE WHEN greatest(p0 - p1, 0.0) <> 0 THEN dtp / greatest(p0 - p1, 0.0) ELSE 0.0 END AS slope FROM terms),
pr2 AS (SELECT *, tp1 - slope * p1 AS icpt,
               CASE WHEN p0 > 0 AND p1 > 0 THEN (CASE WHEN greatest(p1, 0.0) <> 0 THEN p0 / greatest(p1, 0.0) ELSE 0.0 END) ELSE 1.0 END AS ratio
        FROM pr)
SELECT split, round(sum(roc), 9) AS auroc,
       round(sum(CASE WHEN greatest(tp1 + fn1, 0.0) <> 0 THEN slope * (dtp + icpt * ln(ratio)) / greatest(tp1 + fn1, 0.0) ELSE 0.0 END), 9) AS auprc
FROM pr2 GROUP BY split"""


@register("m7_m8_auc_200_thresholds", _auc200_sql())
def m7_m8_auc(spark, sf_dir):
    """M7/M8: AUROC (trapezoid) and AUPRC (careful interpolation) over 200 thresholds."""
    return rounded(evaluate.auc200(_scored(spark, sf_dir), "label", "score", ["split"]))


@register("m9_exact_auc_ap", scored_sql() + """,
d AS (SELECT split, score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg
      FROM scored GROUP BY split, score),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY split) AS P,
             sum(neg) OVER (PARTITION BY split) AS N
      FROM d WINDOW w AS (PARTITION BY split ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT split, round(sum(pos * ((N - cn) + neg / 2.0)) / (any_value(P) * any_value(N)), 9) AS roc_auc,
       round(sum(pos / P * (cp / (cp + cn))), 9) AS average_precision FROM c GROUP BY split""")
def m9_exact_auc(spark, sf_dir):
    """M9: exact AUROC (ties averaged) and average precision over distinct scores."""
    return rounded(evaluate.exact_auc(_scored(spark, sf_dir), "label", "score", ["split"]))


@register("m11_mean_loss", scored_sql() + """
SELECT split, round(avg(-(label * ln(least(greatest(score, 1e-7), 1 - 1e-7)) + (1 - label) * ln(1 - least(greatest(score, 1e-7), 1 - 1e-7)))), 9) AS mean_loss,
       count(*) AS n FROM scored GROUP BY split""")
def m11_mean_loss(spark, sf_dir):
    """Mean BCE over every evaluated row."""
    s = _scored(spark, sf_dir).withColumn("loss", vec.bce(F.col("label"), F.col("score")))
    return rounded(evaluate.mean_loss(s, "loss", ["split"]))


def _best_threshold_sql(metric: str) -> str:
    th = " UNION ALL ".join(
        f"SELECT {k} AS k, {t!r} AS thr" for k, t in enumerate(evaluate.search_thresholds(99)))
    return scored_sql() + f""",
th AS ({th}),
c AS (SELECT split, k, thr, CAST(sum(CASE WHEN label = 1 AND score >= thr THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
             CAST(sum(CASE WHEN label <> 1 AND score >= thr THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
             CAST(sum(CASE WHEN label = 1 AND NOT (score >= thr) THEN 1 ELSE 0 END) AS DOUBLE) AS fn
      FROM scored, th GROUP BY split, k, thr),
m AS (SELECT split, k, thr, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
             CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {metric} DESC, k) AS rn FROM m)
SELECT split, round(CASE WHEN {metric} > 0 THEN thr ELSE 0.5::DOUBLE END, 9) AS threshold,
       round(CASE WHEN {metric} > 0 THEN precision ELSE 0.0 END, 9) AS precision,
       round(CASE WHEN {metric} > 0 THEN recall ELSE 0.0 END, 9) AS recall,
       round(CASE WHEN {metric} > 0 THEN f1 ELSE 0.0 END, 9) AS f1 FROM b WHERE rn = 1"""


@register("m12_best_threshold_f1", _best_threshold_sql("f1"))
def m12_best_threshold_f1(spark, sf_dir):
    """Threshold in 0.01..0.99 maximising class-1 F1 (``>=``; first best wins)."""
    return rounded(evaluate.best_threshold(_scored(spark, sf_dir), "label", "score", "f1", 1, 99, ["split"]))


@register("m12_best_threshold_precision", _best_threshold_sql("precision"))
def m12_best_threshold_precision(spark, sf_dir):
    """M12 with precision as the objective."""
    return rounded(evaluate.best_threshold(_scored(spark, sf_dir), "label", "score", "precision", 1, 99, ["split"]))


def _report_cols(cols: list[str], threshold: float = 0.2) -> str:
    inner = report_sql(f"(SELECT split, label, CAST(score > {threshold} AS INT) AS pred FROM scored) s")
    return scored_sql() + f"\nSELECT split, {', '.join(cols)} FROM ({inner}) r"


M4 = ["precision_macro", "recall_macro", "f1_macro"]
M5 = ["precision_weighted", "recall_weighted", "f1_weighted"]
M6 = ["accuracy"]


@register("m4_macro_average", _report_cols(M4))
def m4_macro_average(spark, sf_dir):
    """M4: plain mean of the per-class precision, recall and F1 (threshold 0.2)."""
    return m3_report(spark, sf_dir).select("split", *M4)


@register("m5_weighted_average", _report_cols(M5))
def m5_weighted_average(spark, sf_dir):
    """M5: support-weighted mean of the per-class precision, recall and F1 (threshold 0.2)."""
    return m3_report(spark, sf_dir).select("split", *M5)


@register("m6_accuracy", _report_cols(M6))
def m6_accuracy(spark, sf_dir):
    """M6: accuracy at the report threshold."""
    return m3_report(spark, sf_dir).select("split", *M6)
