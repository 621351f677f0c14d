"""Report numbers from a recorded confusion matrix; curve and threshold semantics."""

import pytest
from pyspark.sql import functions as F

from dpframe.operators import evaluate


def test_report_from_recorded_confusion(spark):
    conf = spark.createDataFrame([(103006, 94885, 130, 1979)], "tn long, fp long, fn long, tp long")
    r = conf.select(*evaluate.report_columns()).first()
    exp = {
        "precision_class_0": 0.998739528389699, "precision_class_1": 0.020430706970597953,
        "precision_macro": 0.5095851176801485, "precision_weighted": 0.9884232618678347,
        "recall_class_0": 0.5205188714999671, "recall_class_1": 0.9383594120436226,
        "recall_macro": 0.7294391417717949, "recall_weighted": 0.524925,
        "f1_class_0": 0.6843638610490088, "f1_class_1": 0.03999070453558041,
        "f1_macro": 0.3621772827922946, "f1_weighted": 0.6775689461135747,
    }
    for k, v in exp.items():
        assert r[k] == pytest.approx(v, abs=1e-12), k


def test_count_below_matches_brute_force(spark):
    import random
    th = evaluate.auc_thresholds(200)
    rnd = random.Random(3)
    xs = [rnd.random() for _ in range(500)] + list(th) + [0.0, 1.0, -0.5, 1.5]
    df = spark.createDataFrame([(x,) for x in xs], "s double")
    got = df.select("s", evaluate.count_below(F.col("s"), th, True).alias("b")).collect()
    for r in got:
        assert r["b"] == sum(1 for t in th if t < r["s"])
    st = evaluate.search_thresholds(99)
    got = df.select("s", evaluate.count_below(F.col("s"), st, False).alias("b")).collect()
    for r in got:
        assert r["b"] == sum(1 for t in st if t <= r["s"])


def test_epoch_metrics_equal_separate_aggregates(spark):
    import random
    rnd = random.Random(5)
    rows = [(int(rnd.random() < 0.2), rnd.random()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "label int, score double")
    one = evaluate.epoch_metrics(df, 0.5)
    auc = evaluate.auc200(df).first()
    rep = evaluate.classification_report(df, threshold=0.5).first()
    assert one["auroc"] == pytest.approx(auc["auroc"], abs=1e-12)
    assert one["auprc"] == pytest.approx(auc["auprc"], abs=1e-12)
    assert one["accuracy"] == pytest.approx(rep["accuracy"], abs=1e-12)


def test_exact_auc_brute_force(spark):
    import random
    rnd = random.Random(7)
    rows = [(int(rnd.random() < 0.3), round(rnd.random(), 2)) for _ in range(800)]
    df = spark.createDataFrame(rows, "label int, score double")
    r = evaluate.exact_auc(df, buckets=16).first()
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert r["roc_auc"] == pytest.approx(auc, abs=1e-12)
    ap = 0.0
    for s in sorted({s for _, s in rows}, reverse=True):
        tp = sum(1 for y, x in rows if x >= s and y == 1)
        k = sum(1 for y, x in rows if x >= s)
        ap += sum(1 for y, x in rows if x == s and y == 1) / len(pos) * tp / k
    assert r["average_precision"] == pytest.approx(ap, abs=1e-12)


def test_best_threshold_first_best_and_fallback(spark):
    df = spark.createDataFrame([(0, 0.3), (0, 0.4), (1, 0.9)], "label int, score double")
    r = evaluate.best_threshold(df, metric="f1").first()
    assert r["f1"] == 1.0 and r["threshold"] == pytest.approx(0.41, abs=1e-12)
    none = spark.createDataFrame([(0, 0.3), (0, 0.4)], "label int, score double")
    r = evaluate.best_threshold(none, metric="f1").first()
    assert (r["threshold"], r["f1"]) == (0.5, 0.0)


def test_report_text_golden(spark):
    # counts that the recorded four-digit ratios allow
    counts = spark.createDataFrame([(109657, 88234, 147, 1962)], "tn long, fp long, fn long, tp long")
    text = counts.select(*evaluate.report_columns()).select(evaluate.report_text()).first()[0]
    assert text == "\n".join([
        "              precision    recall  f1-score   support", "",
        "           0     0.9987    0.5541    0.7128    197891",
        "           1     0.0218    0.9303    0.0425      2109", "",
        "    accuracy                         0.5581    200000",
        "   macro avg     0.5102    0.7422    0.3776    200000",
        "weighted avg     0.9884    0.5581    0.7057    200000"])
