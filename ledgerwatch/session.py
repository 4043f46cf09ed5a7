"""Session defaults for stand-alone runs; on a cluster the submitted configuration wins."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "ledgerwatch") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LEDGERWATCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is configured and all tasks run in this process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    fallback = tempfile.mkdtemp(prefix="ledgerwatch-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table, in one folder per application, which goes when the application ends."""
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _to_go:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _to_go.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


_to_go: set[str] = set()


def cut_lineage(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: a lost executor costs no recomputation,
    and later readers take only the columns they need. ``instead_of``: a table written by this that nothing reads any more; it goes."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    if instead_of is not None and "_scratch" in vars(instead_of):
        old = df.sparkSession._jvm.org.apache.hadoop.fs.Path(instead_of._scratch)
        old.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(old, True)
    return out
