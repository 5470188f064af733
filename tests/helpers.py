"""Small tables for the unit tests: one dataset per case, profiled in one job."""

from __future__ import annotations

from datawarden.operators import profile as pf


def column_cases(spark, cases: dict[str, list[str | None]]):
    """Single-column datasets; returns (value_freq, headers, row counts)."""
    rows = [(name, i, v) for name, values in cases.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "dataset_id string, ord int, c string")
    names = spark.createDataFrame([(n,) for n in cases], "dataset_id string")
    headers = pf.headers_of(names, ["c"])
    freq = pf.value_freq(pf.text_cells(df, ["c"], ordinal="ord"))
    return freq, headers, pf.row_counts(df, ["c"])


def profiles(spark, cases):
    freq, headers, _ = column_cases(spark, cases)
    columns = pf.with_samples(pf.column_profile(freq, headers), pf.sample_values(freq))
    return {r["dataset_id"]: r for r in columns.collect()}


def table_case(spark, names: list[str], rows: list[list[str | None]], dataset_id: str = "t"):
    """A table of text rows; returns an Analysis-ready (freq, rows, headers)."""
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    df = spark.createDataFrame(
        [(dataset_id, i, *r) for i, r in enumerate(rows)], f"dataset_id string, ord int, {fields}"
    )
    columns = [f"c{i}" for i in range(len(names))]
    ids = spark.createDataFrame([(dataset_id,)], "dataset_id string")
    return (
        pf.value_freq(pf.text_cells(df, columns, ordinal="ord")),
        pf.row_counts(df, columns),
        pf.headers_of(ids, names),
    )
