"""Queries for privacy accounting (A1–A7) and experiment tables."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dpframe.functions import accountant as acc
from dpframe.operators import evaluate, experiments as ex, sample, train
from dpframe.plans.datasets import METRIC_HISTORY_SQL, labelled_lineitem, metric_history, reuse, table
from dpframe.plans.registry import register, rounded

LABEL_SQL = "CAST(l_quantity >= 50 AND l_discount >= 0.05 AS INT)"
N_SQL = f"(SELECT CAST(2 * (sum({LABEL_SQL}) - ceil(0.2::DOUBLE * sum({LABEL_SQL}))) AS BIGINT) AS n FROM lineitem)"


def balanced_train_size(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the balanced training set: 2 x (positives - ceil(0.2 positives))."""
    p = labelled_lineitem(spark, sf_dir).agg(F.sum("label")).first()[0]
    return int(2 * (p - math.ceil(0.2 * p)))


def _values_sql(name: str, vals) -> str:
    return f"(SELECT * FROM (VALUES {', '.join(f'(CAST({float(v)!r} AS DOUBLE))' for v in vals)}) t({name}))"


def _grid_sql(values: dict, extra: str = "") -> str:
    names = list(values)
    frm = ", ".join(_values_sql(n, v) for n, v in values.items())
    return (f"SELECT {', '.join(names)}, CAST(row_number() OVER (ORDER BY {', '.join(names)}) AS INTEGER) AS trial"
            f"{extra} FROM {frm}")


# ------------------------------------------------------------------ H1, H2, H10

@register("h1_dp_grid", f"""
SELECT g.*, n.n, CAST(g.epochs * (n.n // 1024) AS BIGINT) AS steps FROM ({_grid_sql(ex.DP_GRID)}) g, {N_SQL} n""")
def h1_dp_grid(spark, sf_dir):
    """H1: 3x3x3x1x3 = 81 DP trials, with the training size and steps (batch 1024)."""
    n = balanced_train_size(spark, sf_dir)
    g = ex.grid(spark, ex.DP_GRID).withColumn("trial", F.col("trial").cast("int"))
    return g.withColumn("n", F.lit(n).cast("long")).withColumn(
        "steps", (F.col("epochs") * F.lit(n // 1024)).cast("long"))


@register("h1_nonprivate_grid", f"""
SELECT g.*, n.n FROM ({_grid_sql(ex.NONPRIVATE_GRID)}) g, {N_SQL} n""")
def h1_nonprivate_grid(spark, sf_dir):
    """H1: 6x6x6 = 216 non-private trials."""
    n = balanced_train_size(spark, sf_dir)
    return ex.grid(spark, ex.NONPRIVATE_GRID).withColumn("trial", F.col("trial").cast("int")) \
        .withColumn("n", F.lit(n).cast("long"))


def _space_sql() -> str:
    cols = []
    for name, kind, spec in ex.SEARCH_SPACE:
        txt = f"CAST(o_orderkey AS VARCHAR) || '|{name}|42'"
        u = f"(('0x' || substr(md5({txt}), 1, 15))::BIGINT % {{n}})"
        if kind == "int":
            lo, hi, st = spec
            n = (hi - lo) // st + 1
            cols.append(f"CAST({lo} + {u.format(n=n)} * {st} AS INTEGER) AS {name}")
        else:
            arr = "[" + ", ".join(f"CAST({float(v)!r} AS DOUBLE)" for v in spec) + "]"
            cols.append(f"{arr}[{u.format(n=len(spec))} + 1] AS {name}")
    return f"SELECT o_orderkey, {', '.join(cols)} FROM orders"


@register("h2_search_space", _space_sql())
def h2_search_space(spark, sf_dir):
    """H2: every order is a trial; units1 ~ Int(32, 512, 32), units2 ~ Int(32, 256, 32), lr ~ Choice."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return ex.sample_space(o, F.col("o_orderkey"))


def _sens_sql() -> str:
    rows = []
    for k, vs in ex.SENSITIVITY_VALUES.items():
        for v in vs:
            cfg = {kk: (float(v) if kk == k else float(bv)) for kk, bv in ex.SENSITIVITY_BASE.items()}
            rows.append(f"('{k}', CAST({float(v)!r} AS DOUBLE), "
                        + ", ".join(f"CAST({cfg[c]!r} AS DOUBLE)" for c in ex.SENSITIVITY_BASE) + ")")
    cols = ", ".join(ex.SENSITIVITY_BASE)
    return (f"SELECT s.*, n.n FROM (SELECT * FROM (VALUES {', '.join(rows)}) t(hyperparameter, value, {cols})) s, {N_SQL} n")


@register("h10_sensitivity_grid", _sens_sql())
def h10_sensitivity_grid(spark, sf_dir):
    """5 parameters x 3 values around the base point (15 configurations)."""
    n = balanced_train_size(spark, sf_dir)
    return ex.sensitivity_grid(spark).withColumn("n", F.lit(n).cast("long"))


# ------------------------------------------------------------------ A1–A7

def _account_grid(spark, sf_dir, delta_policy: str) -> DataFrame:
    n = balanced_train_size(spark, sf_dir)
    g = ex.grid(spark, {"noise_multiplier": [0.0] + ex.DP_GRID["noise_multiplier"] + [1.2],
                        "batch_size": [128, 256], "epochs": [5, 15]})
    g = g.withColumn("n", F.lit(n).cast("long"))
    return g.withColumn("delta", acc.delta_policy(delta_policy, F.col("n")))


@register("a1_gdp_epsilon_grid")
def a1_gdp_epsilon_grid(spark, sf_dir):
    """A1: Gaussian-DP epsilon per grid point (delta 1e-6)."""
    return rounded(acc.add_gdp_epsilon(_account_grid(spark, sf_dir, "1e-6")))


@register("a2_rdp_epsilon_grid")
def a2_rdp_epsilon_grid(spark, sf_dir):
    """A2: Rényi epsilon of the subsampled Gaussian per grid point (delta 1/n)."""
    return rounded(acc.add_rdp_epsilon(_account_grid(spark, sf_dir, "1/n")))


@register("a3_library_epsilon")
def a3_library_epsilon(spark, sf_dir):
    """A3: DP-SGD epsilon at delta 1e-5."""
    return rounded(acc.add_rdp_epsilon(_account_grid(spark, sf_dir, "1e-5")))


@register("a4_delta_policy", f"""
SELECT p.policy, n.n, CASE WHEN p.policy = '1/n' THEN 1.0 / n.n ELSE CAST(p.policy AS DOUBLE) END AS delta
FROM (VALUES ('1/n'), ('1e-6'), ('1e-5')) p(policy), {N_SQL} n""")
def a4_delta_policy(spark, sf_dir):
    """A4: delta = 1/n, 1e-6 or 1e-5 for the balanced training size."""
    n = balanced_train_size(spark, sf_dir)
    p = spark.createDataFrame([("1/n",), ("1e-6",), ("1e-5",)], "policy string").withColumn("n", F.lit(n).cast("long"))
    return p.withColumn("delta", F.when(F.col("policy") == "1/n", acc.delta_policy("1/n", F.col("n")))
                        .otherwise(F.col("policy").cast("double")))


@register("a5_epsilon_per_epoch")
def a5_epsilon_per_epoch(spark, sf_dir):
    """A5: epsilon after each epoch for every grid point (Rényi, delta 1/n)."""
    g = _account_grid(spark, sf_dir, "1/n").withColumnRenamed("epochs", "total_epochs")
    e = acc.per_epoch(g, "total_epochs", "epochs")
    return rounded(acc.add_rdp_epsilon(e))


@register("a6_budget_stop", f"""
WITH h AS (SELECT run_id, key, step, ts, event_id, value FROM ({METRIC_HISTORY_SQL}) x),
c AS (SELECT *, row_number() OVER w AS epoch, sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 100.0 AS epsilon
      FROM h WINDOW w AS (PARTITION BY run_id, key ORDER BY step, ts, event_id)),
s AS (SELECT run_id, key, min(CASE WHEN epsilon > 5.0 THEN epoch END) AS stop FROM c GROUP BY run_id, key)
SELECT c.run_id, c.key, CAST(c.epoch AS INTEGER) AS epoch, round(c.epsilon, 9) AS epsilon FROM c JOIN s USING (run_id, key)
WHERE s.stop IS NULL OR c.epoch <= s.stop""")
def a6_budget_stop(spark, sf_dir):
    """Cumulative cost per run and metric (values / 100 as epsilon); each ends at the first epoch over 5."""
    from dpframe.operators import runs
    d = runs.series_scan(metric_history(spark, sf_dir), ["run_id", "key"], ["step", "ts", "event_id"], "value")
    c = d.withColumn("epoch", F.col("_i").cast("int")).withColumn("epsilon", F.col("_sum_incl") / F.lit(100.0))
    return rounded(acc.budget_stop(c, ["run_id", "key"], "epoch", "epsilon", 5.0).select("run_id", "key", "epoch", "epsilon"))


@register("a7_zero_noise_zero_epsilon", f"""
SELECT noise_multiplier, batch_size, epochs, CAST(noise_multiplier = 0 AS INTEGER) AS eps_is_zero, n.n
FROM {_values_sql('noise_multiplier', [0.0] + ex.DP_GRID['noise_multiplier'] + [1.2])},
     {_values_sql('batch_size', [128, 256])}, {_values_sql('epochs', [5, 15])}, {N_SQL} n""")
def a7_zero_noise_zero_epsilon(spark, sf_dir):
    """Epsilon is exactly 0 when no noise is added (and positive otherwise)."""
    g = acc.add_rdp_epsilon(_account_grid(spark, sf_dir, "1/n"))
    return g.select("noise_multiplier", "batch_size", "epochs", (F.col("epsilon") == 0).cast("int").alias("eps_is_zero"), "n")


# ------------------------------------------------------------------ H3, H9, H11 (training)

def _dp_grid_configs():
    """The 81 points of the H1 grid, in its order."""
    names = list(ex.DP_GRID)
    points = [dict(zip(names, v)) for v in itertools.product(*[sorted(ex.DP_GRID[n]) for n in names])]
    return [train.FitConfig(model="logistic", optimizer="sgd", learning_rate=p["learning_rate"], l2_norm_clip=p["l2_norm_clip"],
                            noise_multiplier=p["noise_multiplier"], batch_size=256, epochs=int(p["epochs"]), seed=f"grid-{i}")
            for i, p in enumerate(points, 1)]


def _trial_scores(spark, te: DataFrame, params: list[np.ndarray], threshold: float = 0.2) -> DataFrame:
    """Score ``te`` under every trial in one pass and evaluate per trial."""
    from dpframe.functions import vec
    pdf = spark.createDataFrame([(i + 1, p[:-1].tolist(), float(p[-1])) for i, p in enumerate(params)],
                                "trial int, w array<double>, b double")
    sc = te.select("features", "label").crossJoin(F.broadcast(pdf)).withColumn(
        "score", vec.sigmoid(vec.dot(F.col("features"), F.col("w")) + F.col("b")))
    sc = sc.withColumn("loss", vec.bce(F.col("label"), F.col("score")))
    auc = evaluate.auc200(sc, "label", "score", ["trial"])
    loss = sc.groupBy("trial").agg(F.avg("loss").alias("eval_loss"))
    rep = evaluate.classification_report(sc, "label", "score", threshold, True, ["trial"]).select(
        "trial", "recall_class_1", "precision_class_1", "f1_class_1")
    return auc.join(loss, "trial").join(rep, "trial")


VALIDATION_SEED = 44


def _grid_results(spark, sf_dir):
    """See :func:`_run_grid`; trained once per session for the queries that share it."""
    return reuse(spark, ("dp_grid", sf_dir), lambda: _run_grid(spark, sf_dir))


def _run_grid(spark, sf_dir):
    """Trials fitted on four fifths of the balanced rows and scored on the rest (T3); test rows take no part."""
    from dpframe.plans.q_train import training_sets
    bal, te = training_sets(spark, sf_dir)
    cfgs = _dp_grid_configs()
    part = sample.validation_tail(bal, F.col("key"), 0.2, VALIDATION_SEED)
    res = train.fit_grid(part.where("is_val = 0").drop("is_val"), cfgs)
    val = part.where("is_val = 1").drop("is_val")
    meta = spark.createDataFrame([(i + 1, c.l2_norm_clip, c.noise_multiplier, c.learning_rate, c.epochs, r.steps,
                                   float(r.epsilon[-1]) if r.epsilon else 0.0)
                                  for i, (c, r) in enumerate(zip(cfgs, res))],
                                 "trial int, l2_norm_clip double, noise_multiplier double, learning_rate double, "
                                 "epochs int, steps int, epsilon double")
    return meta.join(_trial_scores(spark, val, [r.params for r in res]), "trial"), bal, te, cfgs


@register("h3_trials_together")
def h3_trials_together(spark, sf_dir):
    """H3: the 81 DP trials of the H1 grid trained together, one job per step; per-trial results on validation rows."""
    out, *_ = _grid_results(spark, sf_dir)
    return rounded(out)


@register("h9_refit_best")
def h9_refit_best(spark, sf_dir):
    """H9 (+H4): the trial with the lowest validation loss, refitted on all training rows; test rows only for its report."""
    out, bal, te, cfgs = _grid_results(spark, sf_dir)
    best = ex.best_trial(out, "eval_loss", "trial").first()
    cfg = cfgs[best["trial"] - 1]
    res = train.fit(bal, train.FitConfig(**{**cfg.__dict__, "seed": "refit"}), evaluate_on=te)
    h = train.history_frame(spark, res, f"refit-trial-{best['trial']}")
    return rounded(h.where(F.col("key") != "epoch_seconds"))


@register("h11_sensitivity_table")
def h11_sensitivity_table(spark, sf_dir):
    """(parameter, value, epsilon, AUPRC, AUROC) for the 15 one-at-a-time configurations."""
    from dpframe.plans.q_train import training_sets
    bal, te = training_sets(spark, sf_dir)
    rows = ex.sensitivity_grid(spark).orderBy("hyperparameter", "value").collect()
    cfgs = [train.FitConfig(model="logistic", optimizer="sgd", learning_rate=r["learning_rate"],
                            l2_norm_clip=r["l2_norm_clip"], noise_multiplier=r["noise_multiplier"], batch_size=256,
                            epochs=int(r["epochs"]), seed=f"sens-{i}") for i, r in enumerate(rows)]
    res = train.fit_grid(bal, cfgs)
    meta = spark.createDataFrame([(i + 1, r["hyperparameter"], float(r["value"]), float(r["pred_threshold"]),
                                   float(res[i].epsilon[-1]) if res[i].epsilon else 0.0) for i, r in enumerate(rows)],
                                 "trial int, hyperparameter string, value double, pred_threshold double, epsilon double")
    scores = _trial_scores(spark, te, [r.params for r in res])
    return rounded(meta.join(scores, "trial").select("hyperparameter", "value", "epsilon", "auprc", "auroc",
                                                      "recall_class_1"))


# ------------------------------------------------------------------ H4–H8, H12, H13 on tables

@register("h4_best_trial", """
SELECT o_orderstatus, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) x
WHERE rn = 1""")
def h4_best_trial(spark, sf_dir):
    """H4: per status, the order ("trial") with the lowest total ("loss"); earlier key wins ties."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    return ex.best_trial(o, "o_totalprice", "o_orderkey", ["o_orderstatus"])


@register("h5_best_epoch", f"""
SELECT run_id, key, step, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY value, step, event_id) AS rn FROM ({METRIC_HISTORY_SQL}) h) x
WHERE rn = 1""")
def h5_best_epoch(spark, sf_dir):
    """H5: per run and metric, the step with the lowest value."""
    h = metric_history(spark, sf_dir)
    return rounded(ex.best_epoch(h, ["run_id", "key"], "value", "step", ["event_id"])
                   .select("run_id", "key", "step", "value"), 6)


def _dedup_sql() -> str:
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key, step ORDER BY ts DESC, event_id DESC) AS rn1
              FROM ({METRIC_HISTORY_SQL}) h) d WHERE rn1 = 1)"""


@register("h6_early_stopping", f"""
WITH d AS (SELECT *, row_number() OVER w AS i,
                  min(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before
           FROM {_dedup_sql()} x WINDOW w AS (PARTITION BY run_id, key ORDER BY step)),
e AS (SELECT *, max(CASE WHEN best_before IS NULL OR value < best_before THEN i END)
                  OVER (PARTITION BY run_id, key ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp FROM d),
s AS (SELECT run_id, key, coalesce(min(CASE WHEN i - last_imp >= 5 THEN i END), max(i)) AS stop_epoch, max(i) AS epochs_seen
      FROM e GROUP BY run_id, key),
b AS (SELECT e.run_id, e.key, s.stop_epoch, s.epochs_seen, e.i, e.value,
             row_number() OVER (PARTITION BY e.run_id, e.key ORDER BY e.value, e.i) AS rb
      FROM e JOIN s ON e.run_id = s.run_id AND e.key = s.key WHERE e.i <= s.stop_epoch)
SELECT run_id, key, CAST(stop_epoch AS INTEGER) AS stop_epoch, CAST(epochs_seen AS INTEGER) AS epochs_seen,
       CAST(i AS INTEGER) AS best_epoch, round(value, 6) AS best_value FROM b WHERE rb = 1""")
def h6_early_stopping(spark, sf_dir):
    """H6: patience 5 (min mode) over each deduplicated run/metric history; restored best epoch."""
    from dpframe.operators import runs
    h = runs.dedupe(metric_history(spark, sf_dir))
    out = ex.early_stopping(h, ["run_id", "key"], "value", "step", patience=5)
    return rounded(out.select("run_id", "key", F.col("stop_epoch").cast("int"), F.col("epochs_seen").cast("int"),
                              F.col("best_epoch").cast("int"), "best_value"), 6)


@register("h7_reduce_lr_on_plateau")
def h7_reduce_lr_on_plateau(spark, sf_dir):
    """H7: learning rate per epoch of each run and metric, halved after 3 epochs without improvement (floor 1e-6)."""
    from dpframe.operators import runs
    h = runs.dedupe(metric_history(spark, sf_dir))
    return ex.reduce_lr_on_plateau(h, ["run_id", "key"], "value", "step", lr0=1e-3, patience=3, min_lr=1e-6)


@register("h8_top15_results", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 15""")
def h8_top15_results(spark, sf_dir):
    """H8: the 15 best "trials" by loss (lowest totals)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return ex.top_results(o, "o_totalprice", "o_orderkey", 15)


@register("h12_successive_halving", """
WITH b AS (SELECT *, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS bracket_idx,
                  count(*) OVER (PARTITION BY o_orderstatus) AS cnt,
                  row_number() OVER (PARTITION BY o_orderstatus
                      ORDER BY o_totalprice DESC, o_orderkey) AS rk
           FROM orders)
SELECT o_orderstatus, CAST(r.round AS INTEGER) AS round, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum,
       round(min(o_totalprice), 2) AS min_score
FROM b, (SELECT range AS round FROM range(0, 3)) r
WHERE r.round <= bracket_idx AND rk <= ceil(cnt / pow(3, r.round))
GROUP BY o_orderstatus, r.round""")
def h12_successive_halving(spark, sf_dir):
    """brackets = order status; round r keeps the top ceil(n / 3^r) by total price."""
    o = table(spark, sf_dir, "orders")
    sh = ex.successive_halving(o, "o_orderstatus", "o_totalprice", "o_orderkey", factor=3)
    return rounded(sh.groupBy("o_orderstatus", F.col("round").cast("int").alias("round")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"), F.min("o_totalprice").alias("min_score")), 2)


@register("h12_scores_per_round", """
WITH s AS (SELECT l_returnflag, l_orderkey, l_linenumber - 1 AS round, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL),
n AS (SELECT l_returnflag, count(*) AS n FROM s WHERE round = 0 GROUP BY l_returnflag),
r0 AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY score DESC, l_orderkey) AS rk FROM s WHERE round = 0),
r1 AS (SELECT s.*, row_number() OVER (PARTITION BY s.l_returnflag ORDER BY s.score DESC, s.l_orderkey) AS rk
       FROM s JOIN r0 USING (l_returnflag, l_orderkey) JOIN n USING (l_returnflag) WHERE s.round = 1 AND r0.rk <= ceil(n.n / 3.0)),
r2 AS (SELECT s.*, 0 AS rk FROM s JOIN r1 USING (l_returnflag, l_orderkey) JOIN n USING (l_returnflag)
       WHERE s.round = 2 AND r1.rk <= ceil(n.n / 9.0))
SELECT l_returnflag, CAST(round AS INTEGER) AS round, l_orderkey, round(score, 2) AS score
FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2) x""")
def h12_scores_per_round(spark, sf_dir):
    """H12 with a score per round: orders as trials, their line r + 1 as the score of round r, brackets by return flag."""
    li = table(spark, sf_dir, "lineitem")
    s = li.groupBy("l_returnflag", "l_orderkey", (F.col("l_linenumber") - 1).alias("r")).agg(F.max("l_extendedprice").alias("score"))
    return rounded(ex.halving_rounds(s, "l_returnflag", "l_orderkey", "r", "score", 3).select("l_returnflag", "round", "l_orderkey", "score"), 2)


@register("h13_best_overall", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1""")
def h13_best_overall(spark, sf_dir):
    """The single best "trial" (highest total; lowest key on ties)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return ex.best_overall(o, "o_totalprice", "o_orderkey")


@register("p8_filter_hyperparameter", f"""
SELECT run_id, key, count(*) AS n, round(max(value), 6) AS best FROM ({METRIC_HISTORY_SQL}) h
WHERE key = 'purchase' AND step >= 50 GROUP BY run_id, key""")
def p8_filter_hyperparameter(spark, sf_dir):
    """Rows of one parameter of a result table (one metric, later steps), with their best value per run."""
    h = metric_history(spark, sf_dir).where((F.col("key") == "purchase") & (F.col("step") >= 50))
    return rounded(h.groupBy("run_id", "key").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("best")), 6)


# ------------------------------------------------------------------ SQL oracles for A2/A3/A5 and H7

def _rdp_sql(delta_policy: str, per_epoch: bool = False) -> str:
    """Renyi epsilon in DuckDB: the same log-space quadrature, grid z = lo + k h."""
    noise = [0.0] + ex.DP_GRID["noise_multiplier"] + [1.2]
    delta = {"1/n": "1.0 / n.n", "1e-5": "CAST(1e-5 AS DOUBLE)", "1e-6": "CAST(1e-6 AS DOUBLE)"}[delta_policy]
    orders = ", ".join(f"(CAST({a!r} AS DOUBLE))" for a in acc.RDP_ORDERS)
    ep_col = "total_epochs" if per_epoch else "epochs"
    explode = (", unnest(range(1, CAST(total_epochs AS BIGINT) + 1)) AS ep" if per_epoch else "")
    ep_expr = "CAST(ep AS DOUBLE)" if per_epoch else "epochs"
    out_cols = ("noise_multiplier, batch_size, total_epochs, trial, n, delta, CAST(ep AS INTEGER) AS epochs"
                if per_epoch else "noise_multiplier, batch_size, epochs, trial, n, delta")
    return f"""
WITH n AS {N_SQL},
g AS (SELECT noise_multiplier, batch_size, epochs AS {ep_col},
             CAST(row_number() OVER (ORDER BY noise_multiplier, batch_size, epochs) AS INTEGER) AS trial
      FROM {_values_sql('noise_multiplier', noise)}, {_values_sql('batch_size', [128, 256])}, {_values_sql('epochs', [5, 15])}),
gd AS (SELECT g.*, n.n, {delta} AS delta FROM g, n),
pairs AS (SELECT DISTINCT least(1.0, batch_size / n) AS q, noise_multiplier AS sigma FROM gd WHERE noise_multiplier > 0),
{_curves_sql()},
rows AS (SELECT gd.*{explode} FROM gd),
e AS (SELECT rows.*, CASE WHEN noise_multiplier > 0 THEN (
          SELECT min({ep_expr} * greatest(1.0, rows.n / rows.batch_size) * rdp.r - ln(rows.delta) / (rdp.a - 1)) FROM rdp
          WHERE rdp.q = least(1.0, rows.batch_size / rows.n) AND rdp.sigma = rows.noise_multiplier) ELSE 0.0 END AS epsilon FROM rows)
SELECT {out_cols}, round(epsilon, 9) AS epsilon FROM e"""


def _curves_sql() -> str:
    """CTEs after ``pairs`` (q, sigma): ``rdp`` (q, sigma, a, r), the curve of one step at every order."""
    orders = ", ".join(f"(CAST({a!r} AS DOUBLE))" for a in acc.RDP_ORDERS)
    return f"""ords AS (SELECT * FROM (VALUES {orders}) o(a)),
grid AS (SELECT q, sigma, a, least(sigma, sigma * sigma) / 100.0 AS h, -12.0 * sigma - 1.0 AS lo,
                greatest(a, 1.0) + 12.0 * sigma + 1.0 AS hi FROM pairs, ords WHERE q < 1.0),
pts AS (SELECT q, sigma, a, h, lo + k * h AS z FROM (
          SELECT *, unnest(range(0, CAST(ceil((hi + h - lo) / h) AS BIGINT))) AS k FROM grid) x),
lfs AS (SELECT q, sigma, a, h,
          (-0.5 * ln(2 * pi()) - ln(sigma)) - z * z / (2 * sigma * sigma)
          + a * (greatest(ln(1 - q), ln(q) + (2 * z - 1) / (2 * sigma * sigma))
                 + ln(1 + exp(-abs(ln(1 - q) - (ln(q) + (2 * z - 1) / (2 * sigma * sigma)))))) AS lf FROM pts),
mx AS (SELECT q, sigma, a, max(lf) AS m FROM lfs GROUP BY q, sigma, a),
rdp AS (SELECT l.q, l.sigma, l.a, (any_value(mx.m) + ln(sum(exp(l.lf - mx.m)) * any_value(l.h))) / (l.a - 1) AS r
        FROM lfs l JOIN mx ON l.q = mx.q AND l.sigma = mx.sigma AND l.a = mx.a GROUP BY l.q, l.sigma, l.a
        UNION ALL SELECT q, sigma, a, a / (2 * sigma * sigma) FROM pairs, ords WHERE q >= 1.0)"""


def _compose_sql(mechanisms: str, by: str, delta: float) -> str:
    """Budget per group of ``mechanisms`` (by, q, sigma, steps): curves added up order by order, then the minimum."""
    return f"""
WITH m AS ({mechanisms}),
pairs AS (SELECT DISTINCT q, sigma FROM m WHERE sigma > 0),
{_curves_sql()},
kinds AS (SELECT {by}, q, sigma, sum(steps) AS steps FROM m WHERE sigma > 0 GROUP BY {by}, q, sigma),
spent AS (SELECT {by}, a, sum(k.steps * rdp.r) AS r FROM kinds k JOIN rdp ON rdp.q = k.q AND rdp.sigma = k.sigma GROUP BY {by}, a),
eps AS (SELECT {by}, min(r - ln({delta!r}::DOUBLE) / (a - 1)) AS epsilon FROM spent GROUP BY {by}),
c AS (SELECT {by}, count(*) FILTER (WHERE sigma > 0) AS mechanisms, count(*) FILTER (WHERE sigma <= 0) AS unprotected FROM m GROUP BY {by})
SELECT {by}, mechanisms, unprotected, round(coalesce(epsilon, 0.0), 9) AS epsilon FROM c LEFT JOIN eps USING ({by})"""


#: Noise of a run by its kind of event (fixed values); one kind runs without noise.
KIND_NOISE = {"click": 0.8, "view": 1.0, "purchase": 1.2, "signup": 1.5, "error": 0.0}
_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in KIND_NOISE.items()) + " END"


@register("a2_budget_per_user", _compose_sql(f"""
SELECT user_id, event_type, least(1.0, 256.0::DOUBLE / max(n.n)) AS q, CAST({_KIND_SQL} AS DOUBLE) AS sigma,
       count(*) * greatest(1.0::DOUBLE, max(n.n) / 256.0::DOUBLE) / 50.0 AS steps
FROM events, (SELECT count(*) AS n FROM events) n GROUP BY user_id, event_type""", "user_id", 1e-6))
def a2_budget_per_user(spark, sf_dir):
    """A2 composed: what each user's runs (one per kind of event, with noise and length of their own) spend together, delta 1e-6."""
    ev = table(spark, sf_dir, "events")
    n = ev.count()
    kinds = F.create_map(*[x for k, v in KIND_NOISE.items() for x in (F.lit(k), F.lit(v))])
    runs = (ev.groupBy("user_id", "event_type").agg((F.count(F.lit(1)) / 50.0).alias("epochs"))
            .select("user_id", F.element_at(kinds, F.col("event_type")).alias("noise_multiplier"), "epochs",
                    F.lit(n).alias("n"), F.lit(256).alias("batch_size")))
    return rounded(acc.compose(runs, ["user_id"], 1e-6))


@register("a5_epsilon_over_trials", _compose_sql(f"""
SELECT learning_rate, least(1.0, 256.0::DOUBLE / n.n) AS q, noise_multiplier AS sigma, epochs * greatest(1.0::DOUBLE, n.n / 256.0::DOUBLE) AS steps
FROM ({_grid_sql(ex.DP_GRID)}) g, {N_SQL} n""", "learning_rate", 1e-5))
def a5_epsilon_over_trials(spark, sf_dir):
    """A5 over a search: what all trials of the H1 grid spend on the same training rows, per learning rate, delta 1e-5."""
    n = balanced_train_size(spark, sf_dir)
    g = ex.grid(spark, ex.DP_GRID).withColumn("n", F.lit(n)).withColumn("batch_size", F.lit(256))
    return rounded(acc.compose(g, ["learning_rate"], 1e-5))


def _gdp_sql() -> str:
    """Gaussian-DP epsilon in DuckDB: normal tails by Simpson's rule, epsilon by bisection in a recursive CTE."""
    noise = [0.0] + ex.DP_GRID["noise_multiplier"] + [1.2]
    steps, width = 4000, 10.0

    def tail(t: str) -> str:
        """P(Z > t): the integral from t to t + 10; below 0 by symmetry."""
        h = width / steps
        x = f"(abs({t}) + {h!r} * i)"
        weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
        s = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * exp(-0.5 * {x} * {x}))) * {h / 3 / math.sqrt(2 * math.pi)!r}"
        return f"CASE WHEN {t} >= 0 THEN {s} ELSE 1.0 - {s} END"

    value = f"(({tail('(mid / mu - mu / 2)')}) - exp(mid) * ({tail('(mid / mu + mu / 2)')}))"
    return f"""
WITH RECURSIVE n AS {N_SQL},
g AS (SELECT noise_multiplier, batch_size, epochs, CAST(row_number() OVER (ORDER BY noise_multiplier, batch_size, epochs) AS INTEGER) AS trial
      FROM {_values_sql('noise_multiplier', noise)}, {_values_sql('batch_size', [128, 256])}, {_values_sql('epochs', [5, 15])}),
gd AS MATERIALIZED (SELECT g.*, n.n, CAST(1e-6 AS DOUBLE) AS delta, CASE WHEN noise_multiplier > 0 THEN
       least(1.0, batch_size / n.n) * sqrt(epochs * greatest(1.0, n.n / batch_size)) * sqrt(exp(1.0 / (noise_multiplier * noise_multiplier)) - 1.0) END AS mu FROM g, n),
b AS (SELECT trial, mu, delta, 0.0::DOUBLE AS lo, 64.0::DOUBLE AS hi, 32.0::DOUBLE AS mid, 0 AS k FROM gd WHERE mu IS NOT NULL
      UNION ALL SELECT trial, mu, delta, lo, hi, (lo + hi) / 2, k FROM (
        SELECT trial, mu, delta, k + 1 AS k, CASE WHEN {value} > delta THEN mid ELSE lo END AS lo, CASE WHEN {value} > delta THEN hi ELSE mid END AS hi
        FROM b WHERE k < 60) x)
SELECT gd.noise_multiplier, gd.batch_size, gd.epochs, gd.trial, gd.n, gd.delta, round(coalesce(b.mid, 0.0), 9) AS epsilon
FROM gd LEFT JOIN (SELECT * FROM b WHERE k = 60) b USING (trial)"""


ORACLES_EXTRA = {
    "a1_gdp_epsilon_grid": _gdp_sql(),
    "a2_rdp_epsilon_grid": _rdp_sql("1/n"),
    "a3_library_epsilon": _rdp_sql("1e-5"),
    "a5_epsilon_per_epoch": _rdp_sql("1/n", per_epoch=True),
    "h7_reduce_lr_on_plateau": f"""
WITH RECURSIVE h AS (
  SELECT run_id, key, step, value, row_number() OVER (PARTITION BY run_id, key ORDER BY step) AS i
  FROM {_dedup_sql()} d),
r AS (
  SELECT run_id, key, i, step, CAST(1e-3 AS DOUBLE) AS lr_used, value AS best, 0 AS wait, CAST(1e-3 AS DOUBLE) AS lr
  FROM h WHERE i = 1
  UNION ALL
  SELECT h.run_id, h.key, h.i, h.step, r.lr AS lr_used,
         CASE WHEN h.value < r.best - 1e-4 THEN h.value ELSE r.best END,
         CASE WHEN h.value < r.best - 1e-4 THEN 0 WHEN r.wait + 1 >= 3 THEN 0 ELSE r.wait + 1 END,
         CASE WHEN NOT (h.value < r.best - 1e-4) AND r.wait + 1 >= 3 AND r.lr > 1e-6
              THEN greatest(r.lr * 0.5, 1e-6) ELSE r.lr END
  FROM r JOIN h ON h.run_id = r.run_id AND h.key = r.key AND h.i = r.i + 1)
SELECT run_id, key, CAST(step AS INTEGER) AS step, lr_used AS learning_rate FROM r""",
}

from dpframe.plans.registry import ORACLES as _ORACLES  # noqa: E402

for _k, _v in ORACLES_EXTRA.items():
    _ORACLES[_k] = _v
