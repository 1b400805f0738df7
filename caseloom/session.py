"""Session settings and lineage cutting."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, name: str = "caseloom", shuffle: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("caseloom.local.tasks", str(cores) if str(cores).isdigit() else "8")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in
    ``spark.checkpoint.dir``. A private one, removed at exit, is made only where
    that is unset on a local master; elsewhere a missing setting is an error,
    because a folder of the driver alone would lose data."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _private_folder()


@functools.cache
def _private_folder() -> str:
    folder = tempfile.mkdtemp(prefix="caseloom-ckpt-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path of this name below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:16]}"


#: Whether the shuffle files of a query go when it ends; else they stay until the driver collects its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives the
    loss of an executor, and later reads prune columns. The shuffle files of the write
    are removed at its end, so that iterations hold those of one round."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def removed(*tables: DataFrame | None) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_written_to", None):
            sc = df.sparkSession.sparkContext
            folder = sc._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def stable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so later stages survive the
    loss of an executor and iterated plans stay short."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
