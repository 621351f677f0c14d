"""Evaluation aggregates.

Every metric is one pass over the scored rows into a bounded summary
(a confusion row, a <= 201-bucket score histogram, or per-distinct-score
counts) followed by expressions on that summary. ``by`` groups evaluate
many models/epochs/trials in the same pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AUC_EPS = 1.0e-6       # added to avoid 0/0 in the 200-threshold curve (fixed value)
AUC_KEPS = 1.0e-7      # end thresholds are -1e-7 and 1 + 1e-7 (fixed value)


def auc_thresholds(num: int = 200) -> list[float]:
    """Thresholds of the 200-point curve: -eps, i/(num-1) for i=1..num-2, 1+eps."""
    inner = [(i + 1) * 1.0 / (num - 1) for i in range(num - 2)]
    return [0.0 - AUC_KEPS] + inner + [1.0 + AUC_KEPS]


def search_thresholds(n_steps: int = 99, lo: float = 0.01, hi: float = 0.99) -> list[float]:
    """Evenly spaced thresholds lo..hi (both included), as numpy.linspace."""
    step = (hi - lo) / (n_steps - 1)
    return [lo + k * step for k in range(n_steps - 1)] + [hi]


def count_below(s: Column, thresholds: list[float], strict: bool = True) -> Column:
    """Number of thresholds t with t < s (strict) or t <= s, in O(1).

    Thresholds are (nearly) evenly spaced: a guess g from the spacing is
    within 2 of the answer, which is then (g - 2) plus the exact
    comparisons with the literal thresholds g-2 .. g+1. The expression
    stays linear in size (no nested corrections).
    """
    k = len(thresholds)
    t0, t1 = thresholds[1], thresholds[-2]
    step = (t1 - t0) / max(k - 3, 1)
    arr = F.array(*[F.lit(float(t)) for t in thresholds])
    g = F.floor((s - F.lit(t0)) / F.lit(step)).cast("int") + 2
    g = F.least(F.greatest(g, F.lit(0)), F.lit(k))

    def below(i: Column) -> Column:  # thresholds[i] compared with s; outside -> all below / none
        t = F.element_at(arr, i + 1)
        hit = (t < s) if strict else (t <= s)
        return F.when(i < 0, F.lit(1)).when(i >= k, F.lit(0)).otherwise(hit.cast("int"))

    total = (g - 2) + below(g - 2) + below(g - 1) + below(g) + below(g + 1)
    return F.when(s.isNull(), F.lit(None)).otherwise(total.cast("int"))


# ----------------------------------------------------------------- M1, M2

def predict(score: Column, threshold: float = 0.5, strict: bool = True) -> Column:
    """M1: class from score; strict ``>`` (DP scripts) or ``>=``."""
    return ((score > F.lit(threshold)) if strict else (score >= F.lit(threshold))).cast("int")


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """M2: one row per group with tn, fp, fn, tp (both classes always present)."""
    y, p = F.col(label), F.col(pred)
    aggs = [F.sum(((y == 0) & (p == 0)).cast("long")).alias("tn"),
            F.sum(((y == 0) & (p == 1)).cast("long")).alias("fp"),
            F.sum(((y == 1) & (p == 0)).cast("long")).alias("fn"),
            F.sum(((y == 1) & (p == 1)).cast("long")).alias("tp")]
    g = df.groupBy(*by) if by else df
    out = g.agg(*aggs)
    return out.select(*(by or []), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                                    for c in ("tn", "fp", "fn", "tp")])


def confusion_long(conf: DataFrame, by: list[str] | None = None) -> DataFrame:
    """S8 layout: (by..., actual, predicted, n)."""
    by = by or []
    return conf.select(*by, F.explode(F.array(
        F.struct(F.lit(0).alias("actual"), F.lit(0).alias("predicted"), F.col("tn").alias("n")),
        F.struct(F.lit(0).alias("actual"), F.lit(1).alias("predicted"), F.col("fp").alias("n")),
        F.struct(F.lit(1).alias("actual"), F.lit(0).alias("predicted"), F.col("fn").alias("n")),
        F.struct(F.lit(1).alias("actual"), F.lit(1).alias("predicted"), F.col("tp").alias("n")),
    )).alias("c")).select(*by, "c.actual", "c.predicted", "c.n")


# ----------------------------------------------------------------- M3–M6

def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def report_columns(tn="tn", fp="fp", fn="fn", tp="tp") -> list[Column]:
    """M3–M6 over a confusion row: per class, macro, support-weighted, accuracy.

    Zero division gives 0. F1 = 2 tp / (true + predicted), as the
    reference library computes it.
    """
    tn, fp, fn, tp = (F.col(c) for c in (tn, fp, fn, tp))
    sup0, sup1 = tn + fp, tp + fn
    pred0, pred1 = tn + fn, tp + fp
    p0, p1 = _div(tn, pred0), _div(tp, pred1)
    r0, r1 = _div(tn, sup0), _div(tp, sup1)
    f0, f1 = _div(2 * tn, sup0 + pred0), _div(2 * tp, sup1 + pred1)
    tot = sup0 + sup1
    w = lambda a, b: _div(a * sup0 + b * sup1, tot)
    return [
        p0.alias("precision_class_0"), r0.alias("recall_class_0"), f0.alias("f1_class_0"),
        sup0.cast("double").alias("support_class_0"),
        p1.alias("precision_class_1"), r1.alias("recall_class_1"), f1.alias("f1_class_1"),
        sup1.cast("double").alias("support_class_1"),
        _div(tn + tp, tot).alias("accuracy"),
        ((p0 + p1) / 2).alias("precision_macro"), ((r0 + r1) / 2).alias("recall_macro"),
        ((f0 + f1) / 2).alias("f1_macro"),
        w(p0, p1).alias("precision_weighted"), w(r0, r1).alias("recall_weighted"),
        w(f0, f1).alias("f1_weighted"),
    ]


def classification_report(df: DataFrame, label: str = "label", score: str = "score",
                          threshold: float = 0.5, strict: bool = True,
                          by: list[str] | None = None) -> DataFrame:
    """M1–M6 in one pass: threshold, confusion, per-class/macro/weighted metrics."""
    scored = df.withColumn("_pred", predict(F.col(score), threshold, strict))
    conf = confusion(scored, label, "_pred", by)
    return conf.select(*(by or []), "tn", "fp", "fn", "tp", *report_columns())


def report_text() -> Column:
    """The report of one :func:`classification_report` row as a text table with four digits."""
    def line(name, p, r, f, n):
        return F.format_string("%12s %10s%10s%10s%10d", F.lit(name), *[
            F.format_string("%.4f", F.round(F.col(c), 4)) if c else F.lit("") for c in (p, r, f)], n.cast("long"))

    head = F.format_string("%12s %10s%10s%10s%10s", *[F.lit(x) for x in ("", "precision", "recall", "f1-score", "support")])
    all_rows = F.col("support_class_0") + F.col("support_class_1")
    per_class = [line(str(c), f"precision_class_{c}", f"recall_class_{c}", f"f1_class_{c}", F.col(f"support_class_{c}")) for c in (0, 1)]
    means = [line(f"{k} avg", *[f"{m}_{k}" for m in ("precision", "recall", "f1")], all_rows) for k in ("macro", "weighted")]
    return F.concat_ws("\n", head, F.lit(""), *per_class, F.lit(""), line("accuracy", None, None, "accuracy", all_rows), *means)


# ----------------------------------------------------------------- M7, M8

def curve_counts(df: DataFrame, label: str = "label", score: str = "score",
                 by: list[str] | None = None, num: int = 200) -> DataFrame:
    """Per group and threshold i: tp, fp, fn, tn (score > t_i is positive).

    One pass buckets each score by the number of thresholds below it
    (<= num+1 buckets), then a bounded (buckets x thresholds) expansion.
    """
    by = by or []
    th = auc_thresholds(num)
    b = count_below(F.col(score).cast("double"), th, strict=True)
    hist = (df.groupBy(*by, b.alias("_b"))
            .agg(F.sum((F.col(label) == 1).cast("long")).alias("_pos"),
                 F.sum((F.col(label) != 1).cast("long")).alias("_neg")))
    idx = df.sparkSession.range(num).select(F.col("id").cast("int").alias("i"))
    j = hist.crossJoin(F.broadcast(idx))
    above = F.col("_b") > F.col("i")
    return (j.groupBy(*by, "i").agg(
        F.sum(F.when(above, F.col("_pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("_neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~above, F.col("_pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(~above, F.col("_neg")).otherwise(0)).alias("tn")))


def auc200(df: DataFrame, label: str = "label", score: str = "score",
           by: list[str] | None = None, num: int = 200) -> DataFrame:
    """M7/M8: AUROC (trapezoid) and AUPRC (careful interpolation) on 200 thresholds."""
    by = by or []
    cc = curve_counts(df, label, score, by, num)
    arr = (cc.groupBy(*by).agg(F.array_sort(F.collect_list(
        F.struct("i", *[F.col(c).cast("double").alias(c) for c in ("tp", "fp", "fn", "tn")]))).alias("a")))
    a = F.col("a")
    e = F.lit(AUC_EPS)

    def at(i, f):
        return F.element_at(a, i + 1)[f]

    def roc_term(i):
        x0 = at(i, "fp") / (at(i, "fp") + at(i, "tn") + e)
        x1 = at(i + 1, "fp") / (at(i + 1, "fp") + at(i + 1, "tn") + e)
        y0 = (at(i, "tp") + e) / (at(i, "tp") + at(i, "fn") + e)
        y1 = (at(i + 1, "tp") + e) / (at(i + 1, "tp") + at(i + 1, "fn") + e)
        return (x0 - x1) * (y0 + y1) / 2.0

    def pr_term(i):
        tp0, tp1 = at(i, "tp"), at(i + 1, "tp")
        p0, p1 = tp0 + at(i, "fp"), tp1 + at(i + 1, "fp")
        dtp = tp0 - tp1
        dp = F.greatest(p0 - p1, F.lit(0.0))
        slope = F.when(dp != 0, dtp / dp).otherwise(F.lit(0.0))
        icpt = tp1 - slope * p1
        ratio = F.when((p0 > 0) & (p1 > 0),
                       F.when(F.greatest(p1, F.lit(0.0)) != 0, p0 / F.greatest(p1, F.lit(0.0))).otherwise(0.0)
                       ).otherwise(F.lit(1.0))
        num_ = slope * (dtp + icpt * F.log(ratio))
        den = F.greatest(tp1 + at(i + 1, "fn"), F.lit(0.0))
        return F.when(den != 0, num_ / den).otherwise(F.lit(0.0))

    idx = F.sequence(F.lit(0), F.lit(num - 2))
    roc = F.aggregate(F.transform(idx, roc_term), F.lit(0.0), lambda s, x: s + x)
    pr = F.aggregate(F.transform(idx, pr_term), F.lit(0.0), lambda s, x: s + x)
    return arr.select(*by, roc.alias("auroc"), pr.alias("auprc"))


# ----------------------------------------------------------------- M9

def exact_auc(df: DataFrame, label: str = "label", score: str = "score",
              by: list[str] | None = None, buckets: int = 1024) -> DataFrame:
    """M9: exact AUROC (ties averaged) and average precision.

    Rows are first collapsed to distinct (group, score) counts, so a hot
    score value costs one row. Scores are then range-bucketed on
    approximate quantiles (a distributed sketch); cumulative counts come
    from per-bucket totals (bounded: groups x buckets rows) plus a window
    inside each bucket, so no window spans the whole score range.
    """
    from pyspark.ml.feature import Bucketizer

    by = by or []
    s = F.col(score).cast("double")
    d = (df.groupBy(*by, s.alias("_s"))
         .agg(F.sum((F.col(label) == 1).cast("long")).alias("_pos"),
              F.sum((F.col(label) != 1).cast("long")).alias("_neg")))
    qs = [i / buckets for i in range(1, buckets)]
    splits = sorted(set(x for x in d.approxQuantile("_s", qs, 1.0 / (4 * buckets)) if x is not None))
    splits = [float("-inf")] + splits + [float("inf")]
    d = Bucketizer(splits=splits, inputCol="_s", outputCol="_bk").transform(d)
    tot = d.groupBy(*by, "_bk").agg(F.sum("_pos").alias("_bp"), F.sum("_neg").alias("_bn"))
    gw = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    above = gw.orderBy(F.col("_bk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tot = (tot.withColumn("_op", F.coalesce(F.sum("_bp").over(above), F.lit(0)))
              .withColumn("_on", F.coalesce(F.sum("_bn").over(above), F.lit(0)))
              .withColumn("_P", F.sum("_bp").over(gw)).withColumn("_N", F.sum("_bn").over(gw)))
    inb = Window.partitionBy(*by, "_bk").orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    j = (d.join(F.broadcast(tot) if not by else tot, by + ["_bk"])
         .withColumn("_cp", F.col("_op") + F.sum("_pos").over(inb))
         .withColumn("_cn", F.col("_on") + F.sum("_neg").over(inb)))
    # negatives strictly below this score = N - cumulative negatives at >= score
    auc_term = F.col("_pos") * ((F.col("_N") - F.col("_cn")) + F.col("_neg") / 2.0)
    ap_term = F.try_divide(F.col("_pos"), F.col("_P")) * (F.col("_cp") / (F.col("_cp") + F.col("_cn")))
    g = j.groupBy(*by) if by else j
    return g.agg((F.try_divide(F.sum(auc_term), F.first("_P").cast("double") * F.first("_N").cast("double"))).alias("roc_auc"),
                 F.sum(ap_term).alias("average_precision"))


# ----------------------------------------------------------------- M11

def mean_loss(df: DataFrame, loss: str = "loss", by: list[str] | None = None) -> DataFrame:
    """Mean per-row loss over the evaluated rows."""
    g = df.groupBy(*by) if by else df
    return g.agg(F.avg(loss).alias("mean_loss"), F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------- M12

def best_threshold(df: DataFrame, label: str = "label", score: str = "score", metric: str = "f1",
                   cls: int = 1, n_steps: int = 99, by: list[str] | None = None) -> DataFrame:
    """Threshold in 0.01..0.99 maximising precision/recall/F1 of ``cls``.

    Prediction is ``score >= t``. The first (lowest) best threshold wins;
    when no threshold scores above 0 the answer is 0.5 with zero metrics.
    """
    by = by or []
    th = search_thresholds(n_steps)
    b = count_below(F.col(score).cast("double"), th, strict=False)   # thresholds <= s
    hist = (df.groupBy(*by, b.alias("_b"))
            .agg(F.sum((F.col(label) == 1).cast("long")).alias("_pos"),
                 F.sum((F.col(label) != 1).cast("long")).alias("_neg")))
    idx = df.sparkSession.createDataFrame([(k, float(t)) for k, t in enumerate(th)], "k int, thr double")
    j = hist.crossJoin(F.broadcast(idx))
    hit = F.col("_b") > F.col("k")          # t_k <= s  <=> predicted 1
    c = (j.groupBy(*by, "k", "thr").agg(
        F.sum(F.when(hit, F.col("_pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("_neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("_pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(~hit, F.col("_neg")).otherwise(0)).alias("tn")))
    if cls == 1:
        tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    else:
        tp, fp, fn = F.col("tn"), F.col("fn"), F.col("fp")
    prec, rec = _div(tp, tp + fp), _div(tp, tp + fn)
    f1 = _div(2 * tp, 2 * tp + fp + fn)
    m = {"precision": prec, "recall": rec, "f1": f1}[metric]
    c = c.select(*by, "k", "thr", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), m.alias("_m"))
    best = (c.groupBy(*by) if by else c).agg(
        F.min_by(F.struct("thr", "precision", "recall", "f1", "_m"),
                 F.struct((-F.col("_m")).alias("a"), F.col("k").alias("b"))).alias("best"))
    ok = F.col("best._m") > 0
    return best.select(*by,
                       F.when(ok, F.col("best.thr")).otherwise(0.5).alias("threshold"),
                       F.when(ok, F.col("best.precision")).otherwise(0.0).alias("precision"),
                       F.when(ok, F.col("best.recall")).otherwise(0.0).alias("recall"),
                       F.when(ok, F.col("best.f1")).otherwise(0.0).alias("f1"))


# ----------------------------------------------------------------- one pass per epoch

def epoch_metrics(df: DataFrame, threshold: float = 0.5, label: str = "label", score: str = "score",
                  num: int = 200) -> dict:
    """D14 evaluation in a single job: mean loss, confusion at ``threshold``
    (strict ``>``), AUROC/AUPRC on 200 thresholds.

    One aggregation yields a <= (num+1)-row histogram with the per-bucket
    counts, loss sums and threshold hits; the curve and report are then
    computed from that bounded summary.
    """
    from dpframe.functions.vec import bce

    s = F.col(score).cast("double")
    y = F.col(label)
    b = count_below(s, auc_thresholds(num), strict=True)
    rows = (df.groupBy(b.alias("b")).agg(
        F.sum((y == 1).cast("long")).alias("pos"), F.sum((y != 1).cast("long")).alias("neg"),
        F.sum(bce(y, s)).alias("loss"),
        F.sum(((y == 1) & (s > F.lit(threshold))).cast("long")).alias("tp"),
        F.sum(((y != 1) & (s > F.lit(threshold))).cast("long")).alias("fp")).collect())
    pos = {r["b"]: r["pos"] for r in rows}
    neg = {r["b"]: r["neg"] for r in rows}
    P, N = sum(pos.values()), sum(neg.values())
    tp_t, fp_t = sum(r["tp"] for r in rows), sum(r["fp"] for r in rows)
    tp = [float(sum(v for k, v in pos.items() if k > i)) for i in range(num)]
    fp = [float(sum(v for k, v in neg.items() if k > i)) for i in range(num)]
    fn = [P - t for t in tp]
    tn = [N - f for f in fp]
    e = AUC_EPS
    roc = 0.0
    pr = 0.0
    for i in range(num - 1):
        x0, x1 = fp[i] / (fp[i] + tn[i] + e), fp[i + 1] / (fp[i + 1] + tn[i + 1] + e)
        y0 = (tp[i] + e) / (tp[i] + fn[i] + e)
        y1 = (tp[i + 1] + e) / (tp[i + 1] + fn[i + 1] + e)
        roc += (x0 - x1) * (y0 + y1) / 2.0
        p0, p1 = tp[i] + fp[i], tp[i + 1] + fp[i + 1]
        dtp = tp[i] - tp[i + 1]
        dp = max(p0 - p1, 0.0)
        slope = dtp / dp if dp != 0 else 0.0
        icpt = tp[i + 1] - slope * p1
        ratio = (p0 / p1 if p1 > 0 else 0.0) if (p0 > 0 and p1 > 0) else 1.0
        den = max(tp[i + 1] + fn[i + 1], 0.0)
        pr += slope * (dtp + icpt * math.log(ratio)) / den if den != 0 else 0.0
    n = P + N
    tn_t, fn_t = N - fp_t, P - tp_t
    return {"eval_loss": sum(r["loss"] for r in rows) / max(n, 1), "auroc": roc, "auprc": pr,
            "accuracy": (tp_t + tn_t) / max(n, 1),
            "precision_class_1": tp_t / (tp_t + fp_t) if tp_t + fp_t else 0.0,
            "recall_class_1": tp_t / P if P else 0.0,
            "recall_class_0": tn_t / N if N else 0.0}
