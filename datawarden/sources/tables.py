"""Parquet tables and the export of catalogue summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table; zone-less timestamps become UTC instants."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def export_catalog(summaries: DataFrame, path: str) -> None:
    """The whole catalogue as JSON lines, written by the executors."""
    summaries.withColumn("exported_at", F.current_timestamp()).write.json(path)
