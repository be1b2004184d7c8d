"""Sessions, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: What every query here relies on: UTC, adaptive plans, skewed joins dealt anew.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def connect(app: str = "fieldlark", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; ``settings`` (dots as double underscores) come on top."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset a temporary one, for a session of one process alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if master.split("[")[0] != "local":
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="fieldlark-shared-")
        named = _own_dirs[app]
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts lineage: later jobs neither compute it twice nor depend on an executor
    that made it. The files go when the driver ends. ``codec`` is Parquet's,
    the session's if not given.
    """
    spark = df.sparkSession
    path = scratch(spark, "kept")
    df.write.parquet(path, compression=codec)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def dimension(df: DataFrame, most: int = 20_000) -> DataFrame:
    """``df`` for the small side of a join: broadcast if it has at most ``most`` rows, else shuffled as Spark sees fit.

    Counts no more than ``most`` + 1 rows.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
