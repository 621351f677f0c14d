"""Queries for run-history analytics.

The events table stands in for the run store: run_id = user_id, key =
event_type, step = props.k, value, ts. Params come from customers
(run_id = c_custkey), run metadata from per-user event spans.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dpframe.operators import runs
from dpframe.plans.datasets import METRIC_HISTORY_SQL, metric_history, table
from dpframe.plans.registry import register, rounded

KEYS = ["click", "error", "purchase", "signup", "view"]
PARAM_TYPES = {"acctbal": "double", "mktsegment": "string", "nationkey": "int"}


def _params_long(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("run_id"), F.explode(F.array(
        F.struct(F.lit("acctbal").alias("key"), F.col("c_acctbal").cast("string").alias("value")),
        F.struct(F.lit("mktsegment").alias("key"), F.col("c_mktsegment").alias("value")),
        F.struct(F.lit("nationkey").alias("key"), F.col("c_nationkey").cast("string").alias("value")))).alias("p")) \
        .select("run_id", "p.key", "p.value")


DEDUP_SQL = f"""SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, key, step ORDER BY ts DESC, event_id DESC) AS rn
  FROM ({METRIC_HISTORY_SQL}) h) x WHERE rn = 1"""


@register("r1_dedupe_history", f"SELECT run_id, key, step, event_id, round(value, 6) AS value FROM ({DEDUP_SQL}) d")
def r1_dedupe_history(spark, sf_dir):
    """One row per (run, metric, step), the latest logged."""
    d = runs.dedupe(metric_history(spark, sf_dir))
    return rounded(d.select("run_id", "key", "step", "event_id", "value"), 6)


@register("r2_latest_metrics_wide", f"""
WITH l AS (SELECT run_id, key, arg_max(value, (step, ts, event_id)) AS v FROM ({METRIC_HISTORY_SQL}) h GROUP BY run_id, key)
SELECT run_id, {', '.join(f"round(max(CASE WHEN key = '{k}' THEN v END), 6) AS {k}" for k in KEYS)}
FROM l GROUP BY run_id""")
def r2_latest_metrics_wide(spark, sf_dir):
    """R2: latest value per run and metric, one column per metric."""
    return rounded(runs.latest_wide(metric_history(spark, sf_dir), KEYS), 6)


@register("r3_params_wide_typed", """
SELECT c_custkey AS run_id, TRY_CAST(CAST(c_acctbal AS VARCHAR) AS DOUBLE) AS acctbal, c_mktsegment AS mktsegment,
       TRY_CAST(CAST(c_nationkey AS VARCHAR) AS INTEGER) AS nationkey FROM customer""")
def r3_params_wide_typed(spark, sf_dir):
    """Long text params pivoted to one typed column each."""
    return runs.params_wide(_params_long(spark, sf_dir), PARAM_TYPES)


@register("r4_params_join_metrics", f"""
WITH l AS (SELECT run_id, key, arg_max(value, (step, ts, event_id)) AS v FROM ({METRIC_HISTORY_SQL}) h GROUP BY run_id, key),
w AS (SELECT run_id, {', '.join(f"max(CASE WHEN key = '{k}' THEN v END) AS {k}" for k in KEYS)} FROM l GROUP BY run_id)
SELECT c.c_custkey AS run_id, c.c_mktsegment AS mktsegment, c.c_acctbal AS acctbal,
       {', '.join(f"round(w.{k}, 6) AS {k}" for k in KEYS)}
FROM customer c JOIN w ON w.run_id = c.c_custkey""")
def r4_params_join_metrics(spark, sf_dir):
    """Typed params joined to the final metrics of the same run (equi-join on run_id)."""
    p = runs.params_wide(_params_long(spark, sf_dir), PARAM_TYPES).select("run_id", "mktsegment", "acctbal")
    m = runs.latest_wide(metric_history(spark, sf_dir), KEYS)
    return rounded(p.join(m, "run_id"), 6)


@register("r5_epoch_duration", f"""
SELECT run_id, key, step, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run_id, key ORDER BY step, ts))) / 1e6, 6) AS seconds
FROM ({DEDUP_SQL}) d QUALIFY seconds IS NOT NULL""")
def r5_epoch_duration(spark, sf_dir):
    """Seconds between consecutive steps of each run/metric (deduplicated)."""
    d = runs.epoch_durations(runs.dedupe(metric_history(spark, sf_dir)))
    return rounded(d.select("run_id", "key", "step", "seconds"), 6)


@register("r6_failed_and_silent_runs", """
SELECT c_custkey AS run_id, CASE WHEN c_acctbal < 0 THEN 4 ELSE 3 END AS status,
       CAST(c_custkey NOT IN (SELECT DISTINCT user_id FROM events) AS INTEGER) AS no_metrics
FROM customer WHERE c_acctbal < 0 OR c_custkey NOT IN (SELECT DISTINCT user_id FROM events)""")
def r6_failed_and_silent_runs(spark, sf_dir):
    """Runs with status 4 (failed: negative balance) or without any logged metric."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), "c_acctbal")
    c = c.withColumn("status", F.when(F.col("c_acctbal") < 0, F.lit(4)).otherwise(F.lit(3)))
    silent = runs.runs_without_metrics(c.select("run_id"), metric_history(spark, sf_dir)) \
        .withColumn("no_metrics", F.lit(1))
    out = c.join(silent, "run_id", "left").withColumn("no_metrics", F.coalesce("no_metrics", F.lit(0)))
    return out.where((F.col("status") == 4) | (F.col("no_metrics") == 1)).select("run_id", "status", "no_metrics")


@register("r7_privacy_utility_frontier", f"""
WITH r AS (SELECT run_id, max(CASE WHEN key = 'error' THEN value END) / 100.0 AS epsilon,
                  max(CASE WHEN key = 'purchase' THEN value END) / 500.0 AS auprc
           FROM ({METRIC_HISTORY_SQL}) h GROUP BY run_id HAVING epsilon IS NOT NULL AND auprc IS NOT NULL),
f AS (SELECT *, max(auprc) OVER (ORDER BY epsilon, auprc DESC, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb FROM r)
SELECT run_id, round(epsilon, 9) AS epsilon, round(auprc, 9) AS auprc FROM f WHERE bb IS NULL OR auprc > bb""")
def r7_privacy_utility_frontier(spark, sf_dir):
    """Runs not beaten on both cost (error/100 as epsilon) and utility (purchase/500)."""
    h = metric_history(spark, sf_dir)
    per = h.groupBy("run_id").agg((F.max(F.when(F.col("key") == "error", F.col("value"))) / 100.0).alias("epsilon"),
                                  (F.max(F.when(F.col("key") == "purchase", F.col("value"))) / 500.0).alias("auprc"))
    per = per.where(F.col("epsilon").isNotNull() & F.col("auprc").isNotNull())
    return rounded(runs.frontier(per, "epsilon", "auprc").select("run_id", "epsilon", "auprc"))


@register("r1_streaming_latest_step", f"SELECT run_id, key, step, event_id, round(value, 6) AS value FROM ({DEDUP_SQL}) d")
def r1_streaming_latest_step(spark, sf_dir):
    """R1 as a Structured Streaming job: events files -> last rows per batch -> log by batch number -> merged."""
    import uuid

    from dpframe.session import checkpoint_dir
    from dpframe.streaming import metrics as sm
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    sm.run_ingest(spark, f"{sf_dir}/events*.parquet", f"{base}/log", f"{base}/checkpoint")
    out = sm.read_latest(spark, f"{base}/log")
    return rounded(out.select("run_id", "key", "step", "event_id", "value"), 6)
