"""Session factory and the one place that knows where intermediate tables may live."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ownergraph", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings that the operators are designed for (UTC, AQE, skew joins, zstd)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session, as in tests, may go without the setting: then a folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ownergraph-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def materialise(df: DataFrame, tag: str, shrink: int = 1) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a cut of the lineage that outlives any executor.

    ``shrink`` joins so many shuffle partitions in one file, for tables that are small beside their inputs.  The
    files go when the application ends.
    """
    spark = df.sparkSession
    if shrink > 1:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // shrink))
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    held = spark.read.schema(df.schema).parquet(path)
    held._written = path
    return held


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    for df in tables:
        path = getattr(df, "_written", None) if isinstance(df, DataFrame) and "_written" in df.__dict__ else None
        if path:
            jvm_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm_path, True)


def keep(df: DataFrame) -> DataFrame:
    """Hold a table that is small beside its inputs, in memory or else on disk; what a lost executor held is made again.

    Call ``unpersist`` once nothing reads it any more.  Not for loops: plans of plans grow; there ``materialise`` cuts them.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
