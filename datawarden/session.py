"""Session helpers: UTC time zone and the shared folder for written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def use_utc(spark: SparkSession) -> SparkSession:
    """All day buckets and windows are UTC; zone-less input timestamps are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediates: the one that spark.checkpoint.dir names, else one below
    the session's warehouse. Both are shared by the driver and all executors."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"


def new_run_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh, never reused folder below the shared one."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def remove_run_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder that `new_run_dir` named, once nothing reads it any more."""
    if not path.startswith(f"{shared_dir(spark)}/"):
        raise ValueError("not a folder of this session")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
