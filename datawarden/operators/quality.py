"""Data-quality findings: one row per finding, from profiles alone."""

from __future__ import annotations

from pyspark.sql import DataFrame

from datawarden.functions.scalars import fixed_1, half_up

# Severity cut-offs on a share.
MISSING_ERROR = 0.5
MISSING_WARNING = 0.2
TYPE_MISMATCH_WARNING = 0.8


def _finding(condition: str, check: str, severity: str, count: str, pct: str, detail: str) -> str:
    return (
        f"CASE WHEN {condition} THEN struct('{check}' AS check_type, {severity} AS severity, "
        f"CAST({count} AS BIGINT) AS affected_count, CAST({pct} AS DOUBLE) AS affected_pct, "
        f"{detail} AS detail) END"
    )


def missing_severity(pct: str) -> str:
    return (
        f"CASE WHEN {pct} >= {MISSING_ERROR}D THEN 'ERROR' "
        f"WHEN {pct} >= {MISSING_WARNING}D THEN 'WARNING' ELSE 'INFO' END"
    )


def column_findings(profile: DataFrame) -> DataFrame:
    """Every finding of every column in one pass over the profile rows."""
    invalid = "(non_null_count - type_match_count)"
    share = "dominant_type_share"
    findings = [
        _finding(
            "completeness = 0", "EMPTY_COLUMN", "'WARNING'", "missing_count", "missing_pct",
            "concat('Column \"', name, '\" is entirely empty.')",
        ),
        _finding(
            "completeness <> 0 AND missing_pct > 0", "MISSING_VALUES",
            missing_severity("missing_pct"), "missing_count", "missing_pct",
            f"concat(missing_count, ' missing value(s) (', {fixed_1('(missing_pct * 100)')}, "
            "'%) in \"', name, '\".')",
        ),
        _finding(
            "validity < 1", "INVALID_VALUES", "'WARNING'", invalid,
            f"coalesce(try_divide({invalid}, non_null_count), 0D)",
            f"concat({invalid}, ' value(s) in \"', name, '\" do not match inferred type ', "
            "data_type, '.')",
        ),
        _finding(
            f"{share} < 1", "TYPE_MISMATCH",
            f"CASE WHEN {share} < {TYPE_MISMATCH_WARNING}D THEN 'WARNING' ELSE 'INFO' END",
            half_up(f"(1 - {share}) * non_null_count"), f"1 - {share}",
            f"concat('Mixed types in \"', name, '\"; dominant type covers ', "
            f"{half_up(f'{share} * 100')}, '%.')",
        ),
    ]
    return profile.selectExpr(
        "dataset_id", "position", "name AS column_name",
        f"inline(array_compact(array({', '.join(findings)})))",
    )


def dataset_findings(datasets: DataFrame) -> DataFrame:
    findings = [
        _finding(
            "duplicate_row_count > 0", "DUPLICATE_ROWS", "'WARNING'", "duplicate_row_count",
            "coalesce(try_divide(duplicate_row_count, row_count), 0D)",
            "concat(duplicate_row_count, ' duplicate row(s) detected.')",
        ),
        _finding(
            "array_contains(structural_issues, 'DUPLICATE_HEADER')", "DUPLICATE_HEADER", "'ERROR'",
            "repeated_headers", "coalesce(try_divide(repeated_headers, column_count), 0D)",
            "'Duplicate column header(s) detected.'",
        ),
    ]
    return datasets.selectExpr(
        "dataset_id", "CAST(NULL AS INT) AS position", "CAST(NULL AS STRING) AS column_name",
        f"inline(array_compact(array({', '.join(findings)})))",
    )


def quality_checks(profile: DataFrame, datasets: DataFrame) -> DataFrame:
    """All findings; a clean dataset has none. Dataset-level findings have a null position."""
    return column_findings(profile).unionByName(dataset_findings(datasets))
