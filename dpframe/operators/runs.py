"""Run-history analytics (R1–R7) over long metric/param tables.

metrics(run_id, key, step, ts, value), params(run_id, key, value STRING),
runs(run_id, status, ...). Windows are partitioned by run and key; the
only cross-run ordering (R7) runs on the per-run aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dpframe.keys import epoch_micros


def dedupe(metrics: DataFrame, tiebreak: str = "event_id") -> DataFrame:
    """One row per (run, key, step): the latest logged (ts, then tiebreak)."""
    w = Window.partitionBy("run_id", "key", "step").orderBy(F.col("ts").desc(), F.col(tiebreak).desc())
    return metrics.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_wide(metrics: DataFrame, keys: list[str], tiebreak: str = "event_id") -> DataFrame:
    """R2: latest value per (run, key) by (step, ts), pivoted over a fixed key list."""
    latest = metrics.groupBy("run_id", "key").agg(
        F.max_by("value", F.struct("step", "ts", tiebreak)).alias("v"))
    return latest.groupBy("run_id").pivot("key", keys).agg(F.first("v"))


def params_wide(params: DataFrame, types: dict[str, str]) -> DataFrame:
    """Params pivoted (fixed key list) and cast with ``try_cast``."""
    wide = params.groupBy("run_id").pivot("key", list(types)).agg(F.first("value"))
    return wide.select("run_id", *[F.expr(f"try_cast(`{k}` AS {t})").alias(k) for k, t in types.items()])


def epoch_durations(metrics: DataFrame) -> DataFrame:
    """Seconds between consecutive logged steps of each (run, key) (series scan, no per-run window)."""
    from dpframe.keys import epoch_micros
    d = series_scan(metrics, ["run_id", "key"], ["step", "ts"], "value")
    secs = epoch_micros(F.col("ts")) - epoch_micros(F.col("_prev_ts"))
    return (d.withColumn("seconds", secs / F.lit(1e6)).where(F.col("seconds").isNotNull())
            .drop("_i", "_n", "_min_before", "_sum_incl", "_prev_ts"))


def runs_without_metrics(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Runs that logged no metric (left anti join)."""
    return runs.join(metrics.select("run_id").distinct(), "run_id", "left_anti")


def frontier(per_run: DataFrame, eps: str = "epsilon", utility: str = "auprc", buckets: int = 1024) -> DataFrame:
    """Runs not beaten on both privacy cost and utility.

    A run is on the frontier when it has higher utility than every run
    before it in (eps, -utility, run_id) order. The running maximum is a
    distributed prefix scan: runs are range-bucketed on approximate
    quantiles of eps (equal eps share a bucket), the per-bucket maxima
    (bounded: ``buckets`` rows) give the maximum of all earlier buckets,
    and a window inside each bucket gives the rest. No window spans all runs.
    """
    from pyspark.ml.feature import Bucketizer

    qs = [i / buckets for i in range(1, buckets)]
    cuts = sorted({x for x in per_run.approxQuantile(eps, qs, 1.0 / (4 * buckets)) if x is not None})
    splits = [float("-inf")] + cuts + [float("inf")]
    d = Bucketizer(splits=splits, inputCol=eps, outputCol="_bk").transform(
        per_run.withColumn(eps, F.col(eps).cast("double")))
    bmax = d.groupBy("_bk").agg(F.max(utility).alias("_bm"))
    prev = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)   # <= buckets rows
    bmax = bmax.withColumn("_before_bucket", F.max("_bm").over(prev)).drop("_bm")
    w = Window.partitionBy("_bk").orderBy(F.col(eps), F.col(utility).desc(), F.col("run_id")) \
        .rowsBetween(Window.unboundedPreceding, -1)
    j = d.join(F.broadcast(bmax), "_bk").withColumn("_in_bucket", F.max(utility).over(w))
    best_before = F.greatest(F.col("_before_bucket"), F.col("_in_bucket"))
    keep = best_before.isNull() | (F.col(utility) > best_before)
    return j.where(keep).drop("_bk", "_before_bucket", "_in_bucket")


def series_scan(history: DataFrame, series: list[str], order: list[str], value: str = "value",
                ts: str = "ts", running_max: str | None = None, chunks: int | None = None) -> DataFrame:
    """Running statistics along each ordered series, without a window over a whole series.

    Adds ``_i`` (1-based position), ``_n`` (series length), ``_min_before``
    (minimum of earlier values), ``_sum_incl`` (running sum),
    ``_prev_ts`` (timestamp of the previous row) and, with ``running_max``,
    ``_max_incl`` (running maximum of that column, nulls ignored).

    Rows are range-partitioned on (series, order) and checkpointed; a chunk is
    a series' rows in one range, so a series holding a third of all rows lies
    in a third of the ``chunks`` ranges (default: the shuffle partitions).
    Summaries of the chunks are combined over a table of at most ``chunks``
    rows a series, and windows run only inside a chunk.
    """
    d = _ranges(history, series, order, chunks)
    last_key = F.struct(*[F.col(c) for c in order])
    parts = d.groupBy(*series, "_chunk").agg(
        F.count(F.lit(1)).alias("_cc"), F.min(value).alias("_cmin"), F.sum(value).alias("_csum"),
        F.max_by(F.col(ts), last_key).alias("_clast_ts"),
        F.max(F.col(running_max) if running_max else F.lit(None)).alias("_cmax"))
    wc = Window.partitionBy(*series).orderBy("_chunk")
    before = wc.rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(c).alias(f"_s{i}") for i, c in enumerate(series)] + [F.col("_chunk").alias("_sc")]
    parts = (parts.withColumn("_off", F.coalesce(F.sum("_cc").over(before), F.lit(0)))
             .withColumn("_min_prev", F.min("_cmin").over(before))
             .withColumn("_sum_prev", F.coalesce(F.sum("_csum").over(before), F.lit(0.0)))
             .withColumn("_ts_prev", F.lag("_clast_ts").over(wc))
             .withColumn("_max_prev", F.max("_cmax").over(before))
             .withColumn("_n", F.sum("_cc").over(Window.partitionBy(*series)))
             .select(*named, "_off", "_min_prev", "_sum_prev", "_ts_prev", "_max_prev", "_n"))
    wi = Window.partitionBy(*series, "_chunk").orderBy(*order)
    on = F.col("_chunk") == F.col("_sc")
    for i, c in enumerate(series):
        on = on & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    j = (d.join(parts, on)
         .withColumn("_i", F.col("_off") + F.row_number().over(wi))
         .withColumn("_min_in", F.min(value).over(wi.rowsBetween(Window.unboundedPreceding, -1)))
         .withColumn("_sum_in", F.sum(value).over(wi.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("_prev_in", F.lag(ts).over(wi)))
    if running_max:
        j = j.withColumn("_max_incl", F.greatest(F.col("_max_prev"), F.max(running_max).over(
            wi.rowsBetween(Window.unboundedPreceding, 0))))
    return (j.withColumn("_min_before", F.least(F.col("_min_prev"), F.col("_min_in")))   # least ignores nulls
            .withColumn("_sum_incl", F.col("_sum_prev") + F.col("_sum_in"))
            .withColumn("_prev_ts", F.coalesce(F.col("_prev_in"), F.col("_ts_prev")))
            .drop("_chunk", "_sc", *[f"_s{i}" for i in range(len(series))], "_off", "_min_prev", "_sum_prev",
                  "_ts_prev", "_max_prev", "_min_in", "_sum_in", "_prev_in"))


def positions(df: DataFrame, series: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """``df`` with ``_i``, the 1-based place of a row in its ordered series, and ``_n``, the series' rows.

    Rows are dealt into ranges of (series, order); a window runs only inside a
    range, and its offset comes from one count per series and range.
    """
    d = _ranges(df, series, order, chunks)
    named = [F.col(c).alias(f"_s{i}") for i, c in enumerate(series)]
    whole = Window.partitionBy(*[f"_s{i}" for i in range(len(series))])
    parts = d.groupBy(*named, F.col("_chunk").alias("_sc")).agg(F.count(F.lit(1)).alias("_cc"))
    parts = (parts.withColumn("_n", F.sum("_cc").over(whole))
             .withColumn("_off", F.coalesce(F.sum("_cc").over(whole.orderBy("_sc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    on = F.col("_chunk") == F.col("_sc")
    for i, c in enumerate(series):
        on = on & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    inside = Window.partitionBy(*series, "_chunk").orderBy(*order)
    return (d.join(parts, on).withColumn("_i", F.col("_off") + F.row_number().over(inside))
            .drop("_chunk", "_sc", "_cc", "_off", *[f"_s{i}" for i in range(len(series))]))


def _ranges(history: DataFrame, series: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """``history`` with ``_chunk``, the number of its range on (series, order); equal keys share a range.

    Range borders come from sampling, so the numbered rows are checkpointed before anything reads them twice.
    """
    from dpframe.session import ensure_checkpoint_dir

    spark = history.sparkSession
    ensure_checkpoint_dir(spark)
    chunks = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (history.repartitionByRange(chunks, *series, *order)
            .withColumn("_chunk", F.spark_partition_id()).checkpoint())
