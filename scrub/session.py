"""Session helpers: table loading and a local session for tests and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "scrub") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Call-site capture for error messages costs several JVM calls per Column
        # call; building a pipeline makes thousands of them.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SCRUB_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder; create a scratch one only in a local session without one."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: no SparkContext; the server owns the setting
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        return current
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="scrub-ckpt-")
    sc.setCheckpointDir(path)
    return path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _is_local(spark: SparkSession) -> bool:
    """One process only, as in tests and the bench."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def spread(df: DataFrame, keys=(), min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy row-local work over a few small files enough tasks, in a local session only.

    The test tables are single files of one row group, which a scan can't
    split.  They are hashed on their unique row ``keys`` (deterministic on
    retry), else dealt round-robin.  On a cluster the scan is left as it is:
    no shuffle of texts.  Only the file index is looked at, nothing is run.
    """
    try:
        if not _is_local(df.sparkSession):
            return df
        want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - Spark Connect: leave the scan as it is
        return df
    if len(df.inputFiles()) >= want:
        return df
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.repartition(want, *keys) if keys else df.repartition(want)
