"""Helpers shared by the corpus operators: tables, written intermediates, text rules.

Intermediate tables are written below ``spark.checkpoint.dir`` (shared by
driver and executors), one new folder per table, so a lost executor costs
only its unfinished tasks.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dpframe.session import checkpoint_dir

#: White space that separates words: space and the six ASCII control spaces.
SPACE_CLASS = "\\x20\\x09-\\x0D"
#: Everything that separates normalised words (ASCII without letters and digits).
NON_WORD_CLASS = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    checkpoint_dir(spark)          # also ships the package to the Python workers
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


#: Spark removes the shuffle files of a query when it ends: those of a written table are of no more use.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` in the shared folder and read it back (cuts the lineage, frees its shuffle files)."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with setting(spark, DROP_SHUFFLES, "true"):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove the folder of a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm-" not in folder:
            raise ValueError(f"not a written intermediate: {folder}")
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A key that holds more than this share of all rows (and more than HOT_ROWS) is spread over several tasks.
HOT_SHARE, HOT_ROWS = 4096, 256


def hot_limit(rows: int) -> int:
    """Rows of one key that one task takes. Fewer than HOT_SHARE keys can have more, whatever the number of rows."""
    return max(HOT_ROWS, rows // HOT_SHARE)


def salted(df: DataFrame, key: str, by: str, hot: DataFrame, limit: int) -> DataFrame:
    """``df`` with a ``salt`` from a hash of ``by``: 0 for all but the keys in ``hot`` (key, n; fewer than HOT_SHARE rows)."""
    small = hot.select(F.col(key), F.col("n").alias("_n"))
    parts = F.ceil(F.col("_n") / limit)
    return df.join(F.broadcast(small), key, "left").withColumn(
        "salt", F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), parts)).cast("int")).drop("_n")


def replicated(df: DataFrame, n: Column, limit: int) -> DataFrame:
    """``df``, one row a key, once for every salt that ``salted`` gives to a key of ``n`` rows."""
    parts = F.greatest(F.ceil(n / limit), F.lit(1)).cast("int")
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session while the block runs its own jobs."""
    old = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def batch_rows(spark: SparkSession, rows: int):
    """Rows per Arrow batch while the block runs its own jobs (wide rows need few)."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normal_words(text: Column) -> Column:
    """Array of words: ASCII lower case, runs of characters outside the ASCII non-word set."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), f"[{NON_WORD_CLASS}]+")
    return F.filter(parts, lambda w: w != "")


def normal_text(text: Column) -> Column:
    """The words of ``normal_words`` joined by one space."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), f"[{NON_WORD_CLASS}]+", " "))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
