"""Catalogue queries over the dataset, column, tag, check, score and access-log tables.

Catalogue tables have one row per dataset or column; the access log is the large one. It is
always aggregated to one row per dataset before it meets anything else.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from datawarden.config import RECOMMENDATIONS, SENSITIVITIES, STATUSES
from datawarden.functions import scalars as s
from datawarden.operators.usage import access_rollup, daily_usage, usage_summary

SORT_KEYS = (
    "uploaded_at", "name", "quality_score", "trust_score", "value_score", "row_count",
)


# --------------------------------------------------------------------------- joins
def dataset_columns(datasets: DataFrame, columns: DataFrame, tags: DataFrame) -> DataFrame:
    """Datasets with their columns and each column's tag; both sides optional."""
    tag = tags.select(
        "dataset_id", "position", "category", "sensitivity", "confidence", "source", "overridden"
    )
    described = columns.join(tag, ["dataset_id", "position"], "left")
    return datasets.select("dataset_id").join(described, "dataset_id", "left")


def pii_rollup(tags: DataFrame) -> DataFrame:
    """Per dataset the columns above NONE and the highest level among them (else null)."""
    rank = f"nullif({s.sensitivity_rank('sensitivity')}, 0)"
    return tags.groupBy("dataset_id").agg(
        F.expr("count_if(sensitivity <> 'NONE') AS pii_column_count"),
        F.expr(f"max_by(sensitivity, {rank}) AS highest_sensitivity"),
    )


def with_scores(datasets: DataFrame, scores: DataFrame) -> DataFrame:
    """Datasets with their three scores; null where none were computed (not the same as 0)."""
    flat = scores.selectExpr(
        "dataset_id",
        "quality.score AS quality_score",
        "trust.score AS trust_score",
        "value.score AS value_score",
        "recommendation",
    )
    return datasets.join(flat, "dataset_id", "left")


def summaries(
    datasets: DataFrame, tags: DataFrame, events: DataFrame, now: datetime | str
) -> DataFrame:
    """The list projection: scored datasets with PII and usage roll-ups."""
    return (
        datasets.join(pii_rollup(tags), "dataset_id", "left")
        .join(access_rollup(events, now), "dataset_id", "left")
        .selectExpr(
            "dataset_id", "name", "original_filename", "file_type", "size_bytes", "row_count",
            "column_count", "status", "quality_score", "trust_score", "value_score",
            "recommendation",
            "coalesce(pii_column_count, 0L) AS pii_column_count",
            "highest_sensitivity",
            "last_accessed_at",
            "coalesce(access_count, 0L) AS access_count",
            "coalesce(access_count_90d, 0L) AS access_count_90d",
            "error_message", "uploaded_at", "updated_at",
        )
    )


# --------------------------------------------------------------------------- filters
def by_recommendation(datasets: DataFrame, recommendation: str) -> DataFrame:
    if recommendation not in RECOMMENDATIONS:
        raise ValueError(f"recommendation must be one of {RECOMMENDATIONS}")
    return datasets.filter(f"recommendation = '{recommendation}'")


def by_sensitivity(datasets: DataFrame, tags: DataFrame, level: str) -> DataFrame:
    """Datasets with at least one column tagged exactly at the level."""
    if level not in SENSITIVITIES:
        raise ValueError(f"sensitivity must be one of {SENSITIVITIES}")
    hits = tags.filter(f"sensitivity = '{level}'").select("dataset_id")
    return datasets.join(hits, "dataset_id", "left_semi")


def trackable(events: DataFrame, datasets: DataFrame) -> DataFrame:
    """Only READY datasets record views."""
    ready = datasets.filter("status = 'READY'").select("dataset_id")
    return events.join(ready, "dataset_id", "left_semi")


def checks_of_column(checks: DataFrame, dataset_id: str, position: int) -> DataFrame:
    return checks.filter((F.col("dataset_id") == dataset_id) & (F.col("position") == position))


# --------------------------------------------------------------------------- list
def _order(sort: str) -> list[Column]:
    descending = sort.startswith("-")
    key = sort.removeprefix("-")
    if key not in SORT_KEYS:
        raise ValueError(f"sort must be one of {SORT_KEYS}, with - for descending")
    c = F.col(key)
    # Unscored datasets come last in either direction; dataset_id makes pages stable.
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col("dataset_id").asc()]


def sorted_catalog(datasets: DataFrame, sort: str = "-uploaded_at") -> DataFrame:
    return datasets.orderBy(*_order(sort))


def matching(
    datasets: DataFrame,
    tags: DataFrame,
    sensitivity: str | None = None,
    recommendation: str | None = None,
) -> DataFrame:
    """The filtered catalogue; its count() is the total beside a page."""
    chosen = datasets
    if recommendation is not None:
        chosen = by_recommendation(chosen, recommendation)
    if sensitivity is not None:
        chosen = by_sensitivity(chosen, tags, sensitivity)
    return chosen


def catalog_page(
    datasets: DataFrame,
    tags: DataFrame,
    events: DataFrame,
    now: datetime | str,
    sort: str = "-uploaded_at",
    sensitivity: str | None = None,
    recommendation: str | None = None,
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    """One page of summaries, at most 100 rows.

    Filter, sort and page run on the dataset rows. Tags and events are first cut to the page's ids,
    then aggregated and joined to it.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must lie in 1..100")
    if offset < 0:
        raise ValueError("offset must not be negative")
    chosen = matching(datasets, tags, sensitivity, recommendation)
    page = chosen.orderBy(*_order(sort)).offset(offset).limit(limit)
    ids = page.select("dataset_id")
    mine = [df.join(ids, "dataset_id", "left_semi") for df in (tags, events)]
    return sorted_catalog(summaries(page, *mine, now), sort)


Cursor = tuple[object, str]


def cursor_of(row: Row, sort: str = "-uploaded_at") -> Cursor:
    """The place of a page's last row in the order of `sort`, for `catalog_page_after`."""
    return row[sort.removeprefix("-")], row["dataset_id"]


def beyond(datasets: DataFrame, sort: str, after: Cursor | None) -> DataFrame:
    """Rows that come later than a cursor in the order of `sort`; all of them without one."""
    if after is None:
        return datasets
    value, dataset_id = after
    key, later_id = F.col(sort.removeprefix("-")), F.col("dataset_id") > F.lit(dataset_id)
    if value is None:
        return datasets.filter(key.isNull() & later_id)
    past = key < F.lit(value) if sort.startswith("-") else key > F.lit(value)
    return datasets.filter(past | ((key == F.lit(value)) & later_id) | key.isNull())


def catalog_page_after(
    datasets: DataFrame,
    tags: DataFrame,
    events: DataFrame,
    now: datetime | str,
    sort: str = "-uploaded_at",
    after: Cursor | None = None,
    sensitivity: str | None = None,
    recommendation: str | None = None,
    limit: int = 20,
) -> DataFrame:
    """The page of summaries behind a cursor (the first one without), at most 100 rows.

    However far into the list, each task keeps `limit` rows: what lies before the cursor is
    filtered out, where an offset would keep and sort it. Rows that are added or removed before
    the cursor do not shift the page.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must lie in 1..100")
    order = _order(sort)
    chosen = beyond(matching(datasets, tags, sensitivity, recommendation), sort, after)
    page = chosen.orderBy(*order).limit(limit)
    ids = page.select("dataset_id")
    mine = [df.join(ids, "dataset_id", "left_semi") for df in (tags, events)]
    return sorted_catalog(summaries(page, *mine, now), sort)


def detail(
    dataset_id: str,
    datasets: DataFrame,
    columns: DataFrame,
    tags: DataFrame,
    checks: DataFrame,
    events: DataFrame,
    now: datetime | str,
) -> dict[str, DataFrame]:
    """Everything about one dataset. The id filter is pushed into every table's scan."""

    def mine(df: DataFrame) -> DataFrame:
        return df.filter(F.col("dataset_id") == dataset_id)

    one, my_tags, my_events = mine(datasets), mine(tags), mine(events)
    return {
        "summary": summaries(one, my_tags, my_events, now),
        "columns": dataset_columns(one, mine(columns), my_tags).orderBy("position"),
        "checks": mine(checks).orderBy(F.col("position").asc_nulls_last(), "check_type"),
        "usage": daily_usage(one, my_events, now).orderBy("date"),
        "usage_summary": usage_summary(one, my_events, now),
    }


# --------------------------------------------------------------------------- overview
def overview_totals(datasets: DataFrame) -> DataFrame:
    """Counts, sums and score averages (over scored datasets, one decimal, 0 if there are none)."""
    averages = [
        f"coalesce({s.half_up(f'avg({x}_score)', 1)}, 0D) AS avg_{x}"
        for x in ("quality", "trust", "value")
    ]
    return datasets.selectExpr(
        "count(1) AS total_datasets",
        *averages,
        "coalesce(sum(row_count), 0L) AS total_rows",
        "coalesce(sum(column_count), 0L) AS total_columns",
    )


def _filled_counts(df: DataFrame, column: str, keys: tuple[str, ...]) -> DataFrame:
    """Count per enum key, zero where none. One aggregate row turned into len(keys) rows."""
    counted = df.selectExpr(*[f"count_if({column} = '{k}') AS `{k}`" for k in keys])
    rows = ", ".join(f"struct('{k}' AS {column}, `{k}` AS n)" for k in keys)
    return counted.selectExpr(f"inline(array({rows}))")


def status_counts(datasets: DataFrame) -> DataFrame:
    return _filled_counts(datasets, "status", STATUSES)


def recommendation_counts(datasets: DataFrame) -> DataFrame:
    return _filled_counts(datasets, "recommendation", RECOMMENDATIONS)


def sensitivity_counts(tags: DataFrame) -> DataFrame:
    return _filled_counts(tags, "sensitivity", SENSITIVITIES)


def _newest(datasets: DataFrame, n: int) -> DataFrame:
    return datasets.orderBy(F.col("uploaded_at").desc(), "dataset_id").limit(n)


def recent_datasets(datasets: DataFrame, n: int = 5) -> DataFrame:
    return _newest(datasets, n).select("dataset_id", "name", "uploaded_at", "quality_score")


def needs_attention(datasets: DataFrame, n: int = 10) -> DataFrame:
    """Newest FAILED or RETIRE datasets."""
    flagged = datasets.filter("status = 'FAILED' OR recommendation = 'RETIRE'")
    return _newest(flagged, n).select("dataset_id", "name", "recommendation", "status")


def top_quality_vs_value(datasets: DataFrame, n: int = 6) -> DataFrame:
    """The best READY datasets by quality, among those with both scores."""
    comparable = datasets.filter(
        "status = 'READY' AND quality_score IS NOT NULL AND value_score IS NOT NULL"
    )
    return (
        comparable.orderBy(F.col("quality_score").desc(), "dataset_id")
        .limit(n)
        .select("dataset_id", "name", "quality_score", "value_score")
    )
