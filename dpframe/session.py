"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, partitions: int | None = None,
              app: str = "dpframe") -> SparkSession:
    """Return the active session or build a local one for tests and bench.

    On a cluster the session already exists (spark-submit); this only adds
    the settings the operators depend on: UTC session time zone (oracle
    comparisons), AQE with partition coalescing and skew-join splitting,
    Arrow for pandas UDFs, and no web UI.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    master = master or os.environ.get("DPFRAME_MASTER", "local[8]")
    partitions = partitions or int(os.environ.get("DPFRAME_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.default.parallelism", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("DPFRAME_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``dpframe`` importable in Python workers (pandas UDFs, mapInPandas).

    The package is zipped once per SparkContext and added with
    ``addPyFile``, so executors get it wherever the driver runs from.
    """
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_dpframe_shipped", False):
        return
    pkg = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="dpframe-pkg-")) / "dpframe.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in pkg.rglob("*.py"):
            z.write(f, f.relative_to(pkg.parent))
    sc.addPyFile(str(out))
    sc._dpframe_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; set one only if unset.

    On a cluster the shared folder is configured by the deployment; a local
    folder is created only for local-mode runs (tests, bench).
    """
    ship_package(spark)
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="dpframe-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables (lineage cuts)."""
    return ensure_checkpoint_dir(spark)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
