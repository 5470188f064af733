"""Column profiles from mergeable parts.

Row, null and type-match counts add up; distinct counts do not, so each part keeps a HyperLogLog
sketch of its values. A part is one row a column (4 KB at most), so an appended file is profiled
alone and its part merged with those before: no value is grouped or shuffled, and old files are not
read again. The distinct count is an estimate, all other figures are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datawarden.functions import scalars as s
from datawarden.functions.cell_types import type_tests
from datawarden.operators.profile import KEY, type_columns, with_headers

#: 2**LG_K buckets: a standard error of 1.04 / sqrt(2**LG_K), 1.6 percent.
LG_K = 12
#: Stated bound of the relative error: three standard errors.
ERROR_BOUND = 3 * 1.04 / 2 ** (LG_K / 2)

_COUNTS = ("row_count", "non_null_count", *(f"m_{k}" for k in type_tests("t")), "m_STRING")
SCHEMA = f"dataset_id string, position int, {', '.join(f'{c} bigint' for c in _COUNTS)}, sketch binary"


def column_sketches(cells: DataFrame) -> DataFrame:
    """The part of one set of cells: counts and a sketch of the values per column."""
    tests = type_tests("t")
    tested = cells.selectExpr(*KEY, "value", f"{s.trimmed('value')} AS t")
    flagged = tested.selectExpr(*KEY, "value", *[f"{t} AS is_{k}" for k, t in tests.items()])
    other = "NOT (" + " OR ".join(f"is_{k}" for k in tests) + ")"
    return flagged.groupBy(*KEY).agg(
        F.expr("count(1) AS row_count"),
        F.expr("count(value) AS non_null_count"),
        *[F.expr(f"count_if(value IS NOT NULL AND is_{k}) AS m_{k}") for k in tests],
        F.expr(f"count_if(value IS NOT NULL AND {other}) AS m_STRING"),
        F.hll_sketch_agg("value", F.lit(LG_K)).alias("sketch"),
    )


def merge_sketches(parts: DataFrame) -> DataFrame:
    """One part out of many; merging is associative, and repeated merging changes nothing else."""
    return parts.groupBy(*KEY).agg(
        *[F.sum(c).alias(c) for c in _COUNTS], F.hll_union_agg("sketch").alias("sketch")
    )


def sketched_counts(merged: DataFrame) -> DataFrame:
    """The columns of `column_counts`, with an estimated distinct count.

    A sketch that was built in one piece has an estimator that depends on the order of its values; united
    with itself it is estimated from its buckets alone, as merged ones are.
    """
    estimate = F.hll_sketch_estimate(F.hll_union("sketch", "sketch"))
    return merged.select(*KEY, *_COUNTS, estimate.alias("distinct_count"))


def sketched_profile(parts: DataFrame, headers: DataFrame) -> DataFrame:
    """The column profile of all parts together; its distinct counts lie within ERROR_BOUND."""
    return with_headers(headers, type_columns(sketched_counts(merge_sketches(parts))))
