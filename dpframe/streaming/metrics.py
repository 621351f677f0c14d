"""Streaming ingestion of metric history (S6 + R1 as a Structured Streaming job).

Metric rows arrive as files; the log keeps, per (run, key, step), the row
logged last (by ts, then event id). "Last" merges: the last row of a batch's
last rows is that of all rows. So the job needs no streaming state. Each
micro-batch is reduced to its own last rows and written in the folder of its
batch number, and a reader merges the folders. Nothing is kept between
batches however long the job runs, a row of any lateness still counts (a
watermark would have to drop it), and a batch that runs again after a lost
driver replaces its own folder. ``compact`` merges the batches so far, which
bounds the log by the number of (run, key, step) and the batches since.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


#: Columns of the log.
LOG_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()), T.StructField("key", T.StringType()), T.StructField("step", T.IntegerType()),
    T.StructField("ts", T.TimestampType()), T.StructField("value", T.DoubleType()), T.StructField("event_id", T.LongType()),
])


def history_view(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("key"),
                         F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("step"),
                         F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")


def latest_per_step(history: DataFrame) -> DataFrame:
    """Last logged row (greatest ts, then event id) per (run, key, step); partial results merge to the same rows."""
    order = F.struct("ts", "event_id")
    return (history.groupBy("run_id", "key", "step")
            .agg(F.max_by("value", order).alias("value"), F.max(order).alias("_last"))
            .select("run_id", "key", "step", "_last.ts", "value", "_last.event_id"))


def run_ingest(spark: SparkSession, source: str, log_path: str, checkpoint: str,
               schema: T.StructType = EVENTS_SCHEMA, max_files: int = 1) -> None:
    """Process everything available in ``source`` (availableNow) into the log."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    q = (history_view(stream).writeStream
         .foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, log_path))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def write_batch(history: DataFrame, batch_id: int, log_path: str) -> None:
    """The batch's last rows in the folder of its number; a batch that runs again replaces its own folder."""
    latest_per_step(history).write.mode("overwrite").parquet(f"{log_path}/batches/batch_id={batch_id}")


def _finished(spark: SparkSession, log_path: str, kind: str) -> dict[int, str]:
    """Folders below ``log_path/kind`` by number, those whose writing ended."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{log_path}/{kind}/*=*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    paths = [f.getPath().getParent() for f in found or []]
    return {int(p.getName().split("=")[1]): p.toString() for p in paths}


def _parts(spark: SparkSession, log_path: str) -> tuple[list[str], int]:
    """Folders that together hold the log: the newest merged one and the batches after it; the number they reach."""
    merged, batches = _finished(spark, log_path, "merged"), _finished(spark, log_path, "batches")
    upto = max(merged, default=-1)
    after = sorted(b for b in batches if b > upto)
    return ([merged[upto]] if merged else []) + [batches[b] for b in after], max([upto] + after)


def compact(spark: SparkSession, log_path: str) -> int:
    """Merge the log into one row per (run, key, step), beside the batches; returns the last batch merged.

    Readers go on with the old folders until the merged one is complete. Run
    it from one place. Folders that a merge has made needless stay until
    ``drop_merged``, so that readers that already listed them can end.
    """
    parts, upto = _parts(spark, log_path)
    if upto in _finished(spark, log_path, "merged") or not parts:
        return upto
    latest_per_step(spark.read.schema(LOG_SCHEMA).parquet(*parts)).write.mode("overwrite").parquet(f"{log_path}/merged/upto={upto}")
    return upto


def drop_merged(spark: SparkSession, log_path: str) -> int:
    """Remove the folders that the newest merged one covers; returns how many."""
    merged = _finished(spark, log_path, "merged")
    upto = max(merged, default=-1)
    old = [p for n, p in merged.items() if n < upto] + [p for n, p in _finished(spark, log_path, "batches").items() if n <= upto]
    for folder in old:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(old)


def read_latest(spark: SparkSession, log_path: str) -> DataFrame:
    """The log's last row per (run, key, step), late rows included; an empty log has no rows."""
    parts, _ = _parts(spark, log_path)
    log = spark.read.schema(LOG_SCHEMA).parquet(*parts) if parts else spark.createDataFrame([], LOG_SCHEMA)
    return latest_per_step(log)
