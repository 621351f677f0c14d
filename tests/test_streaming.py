"""The streaming log: any split into files, any lateness and any replay give the batch result."""

import pathlib

from pyspark.sql import functions as F

from dpframe.operators import runs
from dpframe.streaming import metrics as sm

from conftest import SF001


def _rows(df):
    return sorted(map(tuple, df.select("run_id", "key", "step", "event_id", F.round("value", 9)).collect()), key=repr)


def _source(spark, root, parts):
    """Events in files by a hash of their id, so that every file holds late rows of the others' steps."""
    events = spark.read.schema(sm.EVENTS_SCHEMA).parquet(f"{SF001}/events.parquet")
    odd = spark.createDataFrame([(-1, None, 1, "click", 5.0, '{"k": 1}'), (-2, None, None, None, None, None)], sm.EVENTS_SCHEMA)
    for i in range(parts):
        (events.where(F.pmod(F.xxhash64("event_id"), parts) == i).unionByName(odd.limit(2 if i == 0 else 0))
         .coalesce(1).write.mode("append").parquet(root))
    return spark.read.schema(sm.EVENTS_SCHEMA).parquet(root)


def test_log_equals_the_batch_result_whatever_order_files_come_in(spark, tmp_path):
    src, log, ck = (str(tmp_path / d) for d in ("src", "log", "ck"))
    events = _source(spark, src, 4)
    whole = _rows(sm.latest_per_step(sm.history_view(events)))
    assert whole == _rows(runs.dedupe(sm.history_view(events)))
    sm.run_ingest(spark, src, log, ck)
    batches = sm._finished(spark, log, "batches")
    assert len(batches) >= 4 and _rows(sm.read_latest(spark, log)) == whole
    # nothing is kept between batches
    assert not list(pathlib.Path(ck).glob("state/**/*.*"))
    # a batch that runs again replaces itself
    last = max(batches)
    again = spark.read.schema(sm.LOG_SCHEMA).parquet(batches[last]).persist()
    n = again.count()
    sm.write_batch(again, last, log)
    assert spark.read.parquet(batches[last]).count() == n and _rows(sm.read_latest(spark, log)) == whole
    again.unpersist()
    # a restarted job with nothing new changes nothing
    sm.run_ingest(spark, src, log, ck)
    assert _rows(sm.read_latest(spark, log)) == whole


def test_compaction_bounds_the_log_and_late_rows_still_count(spark, tmp_path):
    src, log, ck = (str(tmp_path / d) for d in ("src", "log", "ck"))
    events = _source(spark, src, 3)
    whole = _rows(sm.latest_per_step(sm.history_view(events)))
    sm.run_ingest(spark, src, log, ck)
    upto = sm.compact(spark, log)
    assert upto == max(sm._finished(spark, log, "batches")) and sm.compact(spark, log) == upto
    merged = spark.read.parquet(sm._finished(spark, log, "merged")[upto])
    assert merged.count() == len(whole) and _rows(sm.read_latest(spark, log)) == whole
    assert sm.drop_merged(spark, log) >= 3 and _rows(sm.read_latest(spark, log)) == whole
    # a row ten years late for a new step counts, an old one for a known step does not
    known = merged.where("ts IS NOT NULL").orderBy("run_id", "key", "step").first()
    late = spark.createDataFrame([(10 ** 9, None, 7, "late", 1.5, '{"k": 3}')], sm.EVENTS_SCHEMA).withColumn(
        "ts", F.lit("2001-01-01 00:00:00").cast("timestamp_ntz"))
    older = late.withColumn("user_id", F.lit(known["run_id"])).withColumn("event_type", F.lit(known["key"])).withColumn(
        "props", F.format_string('{"k": %d}', F.lit(known["step"])))
    late.unionByName(older).coalesce(1).write.mode("append").parquet(src)
    sm.run_ingest(spark, src, log, ck)
    assert _rows(sm.read_latest(spark, log)) == sorted(whole + [(7, "late", 3, 10 ** 9, 1.5)], key=repr)


def test_empty_log(spark, tmp_path):
    log = str(tmp_path / "none")
    assert sm.read_latest(spark, log).count() == 0 and sm.compact(spark, log) == -1 and sm.drop_merged(spark, log) == 0
