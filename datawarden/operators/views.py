"""Derived views for presentation: bands, explain rows, distributions, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datawarden.functions.cell_types import number
from datawarden.functions.scalars import trimmed

KEY = ["dataset_id", "position"]
SALTS = 64
SCORE_PARTS = {
    "quality": ("completeness", "validity", "uniqueness"),
    "trust": ("quality", "consistency", "classification_coverage"),
    "value": ("frequency", "recency", "trend"),
}


def score_band(score: str) -> str:
    """0 to 4, cut at 25, 50, 75 and 90."""
    return (
        f"CASE WHEN {score} < 25 THEN 0 WHEN {score} < 50 THEN 1 WHEN {score} < 75 THEN 2 "
        f"WHEN {score} < 90 THEN 3 WHEN {score} IS NOT NULL THEN 4 END"
    )


def score_tier(score: str) -> str:
    return (
        f"CASE WHEN {score} >= 80 THEN 'Good' WHEN {score} >= 60 THEN 'Fair' "
        f"WHEN {score} IS NOT NULL THEN 'Poor' END"
    )


def score_bands(scores: DataFrame) -> DataFrame:
    """Band and tier of each of the three scores, one row per dataset and score."""
    rows = ", ".join(f"struct('{x}' AS score_name, {x}.score AS score)" for x in SCORE_PARTS)
    return scores.selectExpr("dataset_id", f"inline(array({rows}))").selectExpr(
        "*", f"{score_band('score')} AS band", f"{score_tier('score')} AS tier"
    )


def explain_rows(
    scores: DataFrame, blocks: tuple[str, ...] = ("quality", "trust", "value")
) -> DataFrame:
    """One row per score input with its weight and contribution; they add up to the score.

    Where Trust is explained together with Quality, completeness and validity are listed once
    more as sub-inputs of Trust's quality term, without weight or contribution.
    """

    def row(block: str, part: str, under: str, x: str, weight: str, contribution: str) -> str:
        return (
            f"struct('{block}' AS score_name, '{part}' AS input_name, {under} AS under, "
            f"{x} AS input, {weight} AS weight, {contribution} AS contribution)"
        )

    nothing, rows = "CAST(NULL AS DOUBLE)", []
    for block in blocks:
        for part in SCORE_PARTS[block]:
            x, w = f"{block}.inputs.{part}", f"{block}.weights.{part}"
            rows.append(row(block, part, "CAST(NULL AS STRING)", x, w, f"100D * {w} * {x}"))
    if "trust" in blocks and "quality" in blocks:
        for part in ("completeness", "validity"):
            x = f"quality.inputs.{part}"
            rows.append(row("trust", part, "'quality'", x, nothing, nothing))
    return scores.selectExpr("dataset_id", f"inline(array({', '.join(rows)}))")


def type_distribution(profile: DataFrame) -> DataFrame:
    """Columns per data type, most frequent first."""
    counted = profile.groupBy("data_type").agg(F.expr("count(1) AS n"))
    return counted.orderBy(F.col("n").desc(), "data_type")


def numeric_histogram(freq: DataFrame, bins: int = 6) -> DataFrame:
    """Equal-width bins over all numeric values of each column.

    Finite numbers only, as text or of a numeric type; other types have no histogram. Columns with
    fewer than two numbers have none; equal values make a single bin. The largest value belongs to
    the last bin. Empty bins are listed with 0.
    """
    kind = dict(freq.dtypes)["value"]
    if kind == "string":
        x = number(trimmed("value"))
    elif kind.startswith("decimal") or kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        x = "value"
    else:
        x = "NULL"
    numbers = freq.selectExpr(*KEY, "n", f"CAST({x} AS DOUBLE) AS x").filter(
        "abs(x) < double('Infinity')"
    )
    stats = numbers.groupBy(*KEY).agg(
        F.expr("min(x) AS lo"), F.expr("max(x) AS hi"), F.expr("sum(n) AS total")
    ).filter("total >= 2")
    width = f"((hi - lo) / {float(bins)}D)"
    # A column of unique numbers has as many rows as its table: they are dealt over salted keys, and the
    # one row of bounds goes to each of them.
    salted = numbers.withColumn("salt", F.expr(f"pmod(xxhash64(x), {SALTS}L)"))
    bounds = stats.withColumn("salt", F.expr(f"explode(sequence(0L, {SALTS - 1}L))"))
    placed = salted.join(bounds, [*KEY, "salt"]).selectExpr(
        *KEY,
        "n",
        f"CASE WHEN lo = hi THEN 0 ELSE least({bins - 1}, CAST(floor((x - lo) / {width}) AS INT)) "
        "END AS bin",
    )
    counted = placed.groupBy(*KEY, "bin").agg(F.expr("sum(n) AS n"))
    frame = stats.selectExpr(
        *KEY, "lo", "hi",
        f"explode(sequence(0, CASE WHEN lo = hi THEN 0 ELSE {bins - 1} END)) AS bin",
    )
    return frame.join(counted, [*KEY, "bin"], "left").selectExpr(
        *KEY,
        "bin",
        f"CASE WHEN lo = hi THEN lo ELSE lo + bin * {width} END AS bin_from",
        f"CASE WHEN lo = hi THEN hi ELSE lo + (bin + 1) * {width} END AS bin_to",
        "coalesce(n, 0L) AS n",
    )


def shares(distribution: DataFrame) -> DataFrame:
    """Each key's share of the total n (0 where the total is 0).

    For distributions over an enum: a handful of rows, whatever was counted.
    """
    return distribution.selectExpr("*", "coalesce(try_divide(n, sum(n) OVER ()), 0D) AS share")


def usage_normalised(page: DataFrame) -> DataFrame:
    """Access counts relative to the busiest dataset of a page (at most 100 rows)."""
    return page.selectExpr(
        "dataset_id",
        "access_count",
        "access_count / greatest(max(access_count) OVER (), 1L) AS usage_share",
    )


def missing_severity(profile: DataFrame, checks: DataFrame) -> DataFrame:
    """Each column's missing share with the severity of its MISSING_VALUES finding, if any."""
    found = checks.filter("check_type = 'MISSING_VALUES'").select(*KEY, "severity")
    return profile.select(*KEY, "name", "missing_pct").join(found, KEY, "left")
