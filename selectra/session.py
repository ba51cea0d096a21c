"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback_dirs: dict[str, str] = {}


def local_session(cpus: int | str = "*", app: str = "selectra") -> SparkSession:
    """A session for tests and the benchmark; a cluster job brings its own."""
    cores = 8 if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))  # one machine: its disk is shared
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A session on this machine alone gets a temporary folder without that
    setting; a cluster must name one, because its executors share no local disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback_dirs:
        _fallback_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _fallback_dirs[app]


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name below the shared root."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


#: whether the shuffles of a query are deleted at its end
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives lost executors.

    What was shuffled on the way is deleted at the end: it is not read again,
    and would stay on the disks until the driver's next garbage collection.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    if not spark.conf.isModifiable(_CLEANUP):  # an older Spark
        return df.checkpoint(eager=True)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEANUP, before)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Repartition to the full shuffle width before work that is heavy per row.

    A count given by hand is left alone by adaptive coalescing, which would
    otherwise pack small rows that mean much work into one task.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *columns)
