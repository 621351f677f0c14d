"""Flagship: prepare lineitem with the rare label, balance, score, report.

lineitem -> label -> one-hot + standard scale fitted on train (E1, E5, E6)
-> stratified exact split (T2) -> minority-size downsample of train (T4)
-> fixed-weight logistic score (D13) -> confusion + report (M1–M6) per split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dpframe.functions.vec import logistic_score
from dpframe.operators import evaluate, prepare, sample
from dpframe.plans.datasets import LINEITEM_KEY_SQL, SEED, labelled_lineitem, reuse
from dpframe.plans.registry import register, rounded

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORICAL = ["l_returnflag", "l_linestatus"]
CATS = {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"]}
# Fixed scoring model for plumbing checks (numeric block, then indicators).
WEIGHTS = [2.0, 0.1, 1.5, 0.0, 0.2, -0.1, 0.1, 0.05, -0.05]
BIAS = -4.0
BALANCE_SEED = 43


def prepared_lineitem(spark: SparkSession, sf_dir: str, fit_on: str = "train"):
    def build():
        li = labelled_lineitem(spark, sf_dir)
        return prepare.prepare_features(li, "label", F.col("key"), NUMERIC, CATEGORICAL,
                                        fit_on=fit_on, test_size=0.2, seed=SEED, stratify=True)
    return reuse(spark, ("prepared_lineitem", sf_dir, fit_on), build)


def scored_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse(spark, ("scored_splits", sf_dir), lambda: _scored_splits(spark, sf_dir))


def _scored_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep = prepared_lineitem(spark, sf_dir).df
    train = prep.where(F.col("is_test") == 0)
    test = prep.where(F.col("is_test") == 1)
    bal = sample.downsample(train, F.col("key"), "label", seed=BALANCE_SEED)
    both = (bal.withColumn("split", F.lit("train_balanced"))
            .unionByName(test.withColumn("split", F.lit("test"))))
    return both.withColumn("score", logistic_score(F.col("features"), WEIGHTS, BIAS))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_splits(spark, sf_dir)
    return rounded(evaluate.classification_report(scored, "label", "score", 0.5, True, by=["split"]))


# ------------------------------------------------------------------ SQL side

def token_sql(key: str, seed) -> str:
    return f"(md5({key} || '-{seed}') || '|' || {key})"


def _num_feat(c: str) -> str:
    return f"CAST(CAST(({c} - m_{c}) / s_{c} AS FLOAT) AS DOUBLE)"


def _cat_feats() -> list[str]:
    return [f"CAST(CAST(CAST({c} = '{v}' AS INT) AS FLOAT) AS DOUBLE)" for c, vs in CATS.items() for v in vs]


def prepared_sql(fit_on: str = "train") -> str:
    """CTEs ending in ``prep(key, label, is_test, tok, f0..f8)`` (DuckDB)."""
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC)
    feats = [_num_feat(c) for c in NUMERIC] + _cat_feats()
    fcols = ", ".join(f"{e} AS f{i}" for i, e in enumerate(feats))
    where = "WHERE is_test = 0" if fit_on == "train" else ""
    return f"""
base AS (SELECT {', '.join(NUMERIC + CATEGORICAL)},
                CAST(l_quantity >= 50 AND l_discount >= 0.05 AS INT) AS label,
                {LINEITEM_KEY_SQL} AS key FROM lineitem),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {token_sql('key', SEED)}) AS rn,
              count(*) OVER (PARTITION BY label) AS cnt FROM base),
sp AS (SELECT *, CAST(rn <= ceil(0.2::DOUBLE * cnt) AS INT) AS is_test FROM rk),
st AS (SELECT {stats} FROM sp {where}),
prep AS (SELECT key, label, is_test, {fcols} FROM sp, st)"""


def score_sql(alias: str = "score") -> str:
    z = " + ".join(f"({w!r}) * f{i}" for i, w in enumerate(WEIGHTS))
    return f"1.0 / (1.0 + exp(-(0.0 + {z} + ({BIAS!r})))) AS {alias}"


def balanced_sql(src: str, seed) -> str:
    return f"""(SELECT * EXCLUDE (brn, bmin) FROM (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY {token_sql('key', seed)}) AS brn,
               min(bcnt) OVER () AS bmin
        FROM (SELECT *, count(*) OVER (PARTITION BY label) AS bcnt FROM {src}) x) y
       WHERE brn <= bmin)"""


def report_sql(src: str, by: str = "split", pred: str = "pred", r: int = 9) -> str:
    def div(a, b):
        return f"(CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END)"
    p0, p1 = div("tn", "tn + fn"), div("tp", "tp + fp")
    r0, r1 = div("tn", "tn + fp"), div("tp", "tp + fn")
    f0, f1 = div("2 * tn", "(tn + fp) + (tn + fn)"), div("2 * tp", "(tp + fn) + (tp + fp)")
    tot = "(tn + fp + tp + fn)"
    w = lambda a, b: div(f"{a} * (tn + fp) + {b} * (tp + fn)", tot)
    cols = {
        "precision_class_0": p0, "recall_class_0": r0, "f1_class_0": f0, "support_class_0": "CAST(tn + fp AS DOUBLE)",
        "precision_class_1": p1, "recall_class_1": r1, "f1_class_1": f1, "support_class_1": "CAST(tp + fn AS DOUBLE)",
        "accuracy": div("tn + tp", tot),
        "precision_macro": f"({p0} + {p1}) / 2", "recall_macro": f"({r0} + {r1}) / 2", "f1_macro": f"({f0} + {f1}) / 2",
        "precision_weighted": w(p0, p1), "recall_weighted": w(r0, r1), "f1_weighted": w(f0, f1),
    }
    sel = ", ".join(f"round({e}, {r}) AS {n}" for n, e in cols.items())
    byc = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""SELECT {byc}tn, fp, fn, tp, {sel} FROM (
      SELECT {byc}CAST(sum(CASE WHEN label = 0 AND {pred} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
             CAST(sum(CASE WHEN label = 0 AND {pred} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(sum(CASE WHEN label = 1 AND {pred} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
             CAST(sum(CASE WHEN label = 1 AND {pred} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp
      FROM {src} {grp}) c"""


def scored_sql() -> str:
    """CTEs through ``scored(split, key, label, score)``."""
    return f"""WITH {prepared_sql()},
train AS (SELECT * FROM prep WHERE is_test = 0),
bal AS {balanced_sql('train', BALANCE_SEED)},
scored AS (SELECT 'train_balanced' AS split, key, label, {score_sql()} FROM bal
           UNION ALL SELECT 'test' AS split, key, label, {score_sql()} FROM prep WHERE is_test = 1)"""


FLAGSHIP_SQL = scored_sql() + "\n" + report_sql(
    "(SELECT split, label, CAST(score > 0.5 AS INT) AS pred FROM scored) s")

register("flagship_report", FLAGSHIP_SQL)(flagship)
