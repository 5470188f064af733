"""From input tables to published catalogue tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from datawarden.config import MAX_FILE_BYTES, Settings
from datawarden.functions.scalars import instant
from datawarden.operators import profile as pf
from datawarden.operators.classify import apply_refinements, classify
from datawarden.operators.quality import quality_checks
from datawarden.operators.score import dataset_scores, narrative, profile_scores
from datawarden.operators.usage import value_scores
from datawarden.session import new_run_dir
from datawarden.sources.catalog_store import CatalogStore, new_run_id
from datawarden.sources.csv_files import read_csv_folder, safe_message


@dataclass
class Analysis:
    """Everything derived from a set of tables, each part a lazy plan built when asked for.

    `freq` feeds both the counts and the samples. Where it is large, write it once and pass the
    written table.
    """

    freq: DataFrame
    rows: DataFrame
    headers: DataFrame
    events: DataFrame
    now: datetime | str
    settings: Settings = Settings()
    refinements: DataFrame | None = None

    @cached_property
    def counts(self) -> DataFrame:
        """Column profiles without samples."""
        return pf.column_profile(self.freq, self.headers)

    def take_counts(self, written: DataFrame) -> None:
        """The column profiles as they were written: all that follows from them reads those, and tests
        no value again."""
        self.counts = written.drop("sample_values")

    @cached_property
    def samples(self) -> DataFrame:
        """Headers with their sample values."""
        return pf.with_samples(self.headers, pf.sample_values(self.freq))

    @cached_property
    def columns(self) -> DataFrame:
        return pf.with_samples(self.counts, pf.sample_values(self.freq))

    @cached_property
    def profile(self) -> DataFrame:
        return pf.dataset_profile(self.rows, self.headers)

    @cached_property
    def tags(self) -> DataFrame:
        tags = classify(self.freq, self.headers, self.settings)
        if self.refinements is None:
            return tags
        return apply_refinements(tags, self.refinements, self.settings)

    @cached_property
    def checks(self) -> DataFrame:
        return quality_checks(self.counts, self.profile)

    @cached_property
    def scores(self) -> DataFrame:
        # After an ingest every column carries a tag, explicit NONE included: coverage is 1.
        parts = profile_scores(self.counts, self.profile, None, self.settings)
        ids = self.headers.select("dataset_id").distinct()
        return dataset_scores(parts, value_scores(ids, self.events, self.now, self.settings))


def ingest_csv(
    spark: SparkSession,
    folder: str,
    store: CatalogStore,
    now: datetime | str,
    settings: Settings = Settings(),
    refinements: DataFrame | None = None,
    delimiter: str = ",",
    max_bytes: int | None = MAX_FILE_BYTES,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Ingest a folder of CSV files and publish the result; returns the rejects.

    Files beyond `max_bytes` are rejected; None takes files of any size. `names` gives datasets another
    name than their file's, by file id or file name; one that is blank or longer
    than 255 characters is rejected.

    A file that is not rectangular is catalogued as FAILED, without scores, columns or tags. The
    input is read once; values, row counts and headers of the good files are written once and read
    by everything that follows.
    """
    intake = read_csv_folder(spark, folder, delimiter, max_bytes, names=names)
    rejects = intake.manifest.filter("code IS NOT NULL").select(
        "file_id", "file_name", "size_bytes", "code", "message"
    )
    work = new_run_dir(spark, "ingest")

    def written(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    shape = written("shape", intake.shape())
    good = shape.filter("ragged_rows = 0").select("dataset_id")

    def only_good(df: DataFrame) -> DataFrame:
        return df.join(good, "dataset_id", "left_semi")

    found = Analysis(
        written("freq", pf.value_freq(only_good(intake.cells()))),
        written("rows", only_good(intake.row_counts())),
        written("headers", only_good(intake.headers())),
        store.usage(now),
        now,
        settings,
        refinements,
    )
    run_id = new_run_id()
    store.write("columns", found.columns, run_id)
    found.take_counts(store.of_run("columns", run_id))
    store.write("tags", found.tags, run_id)
    store.write("quality_checks", found.checks, run_id)
    store.write("dataset_scores", found.scores, run_id)
    store.write("preview_rows", only_good(intake.preview()), run_id)

    accepted = intake.manifest.filter("code IS NULL").withColumnRenamed("file_id", "dataset_id")
    datasets = accepted.drop("code").join(shape, "dataset_id").selectExpr(
        "*", "CASE WHEN ragged_rows > 0 THEN 'ragged' END AS failure"
    ).selectExpr(
        "dataset_id",
        "name",
        "file_name AS original_filename",
        "file_type",
        "size_bytes",
        "row_count",
        "CAST(size(headers) AS BIGINT) AS column_count",
        "CASE WHEN failure IS NULL THEN 'READY' ELSE 'FAILED' END AS status",
        f"{safe_message('failure')} AS error_message",
        f"{instant(now)} AS uploaded_at",
        f"{instant(now)} AS updated_at",
    )
    text = narrative(
        datasets,
        found.profile,
        spark.read.parquet(f"{store.root}/tags/run_id={run_id}"),
        spark.read.parquet(f"{store.root}/dataset_scores/run_id={run_id}"),
    )
    store.write("datasets", datasets.join(text, "dataset_id", "left"), run_id)
    store.publish(run_id, datasets, now)
    return rejects
