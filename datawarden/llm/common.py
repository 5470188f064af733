"""What the operators share: narrow inputs, written intermediates and the hash halves of a query."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import time
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datawarden.session import new_run_dir, remove_run_dir

#: A word of every contract but the license scan's: anything but ASCII white space. Fixed value.
WORD = r"[^\x20\x09-\x0D]+"


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the needed columns, cast; other columns, whatever their names, go no further.

    A needed column that is missing altogether counts as null in every row.
    """
    have = set(df.columns)
    return df.select(
        *(
            (F.col(f"`{name}`") if name in have else F.lit(None)).cast(kind).alias(name)
            for name, kind in columns.items()
        )
    )


def written(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """`df` written once to the shared folder and read back, and its folder: later reads do not
    repeat the work above, and a lost executor costs no more than the tasks it ran."""
    path = new_run_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    return written(df, purpose)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes written folders that nothing reads any more, and shuffle files of finished steps."""
    for path in paths:
        remove_run_dir(spark, path)
    release(spark)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1024):
    """Inside, Spark hands Python no more rows at once than these. By default it gathers 10,000, and
    that many whole texts or sets are held by the executor's JVM and by the worker beside each other."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, own = spark.conf.get(key), spark.conf.getAll.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, own) if own else spark.conf.unset(key)


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, as `--py-files` would."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(package)
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in os.walk(package):
            for file in files:
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    archive.write(full, os.path.join(name, os.path.relpath(full, package)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps: it does so when their plans are
    garbage-collected, which between the written steps of a long job would happen too late.

    A plan held from Python goes in the first round, its shuffles in the next, and the cleaner runs
    beside them.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
