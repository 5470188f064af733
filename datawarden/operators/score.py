"""Quality, Trust and Value scores with the inputs that explain them.

Quality needs a profile, Trust needs Quality, Value needs nothing but access events. Each score
block is a struct {score, inputs, weights[, raw]}; it can be re-weighted from its stored inputs.
A score is the sum of its contributions 100 * weight * input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datawarden.config import (
    RECENCY_MIN_ACCESSES,
    STRUCTURAL_PENALTY_CAP,
    STRUCTURAL_PENALTY_PER_ISSUE,
    TREND_BASELINE_MIN,
    Settings,
)
from datawarden.functions import scalars as s


def _block(inputs: dict[str, str], weights: dict[str, float], raw: str | None = None) -> str:
    score = " + ".join(f"100D * {s.double(weights[n])} * {x}" for n, x in inputs.items())
    fields = ", ".join(f"{x} AS {n}" for n, x in inputs.items())
    listed = ", ".join(f"{s.double(weights[n])} AS {n}" for n in inputs)
    tail = "" if raw is None else f", {raw} AS raw"
    return f"struct({score} AS score, struct({fields}) AS inputs, struct({listed}) AS weights{tail})"


def quality_block(completeness: str, validity: str, uniqueness: str, settings: Settings) -> str:
    inputs = {"completeness": completeness, "validity": validity, "uniqueness": uniqueness}
    return _block({n: s.unit(x) for n, x in inputs.items()}, settings.quality)


def trust_block(quality_score: str, consistency: str, coverage: str, settings: Settings) -> str:
    inputs = {
        "quality": f"{quality_score} / 100D",
        "consistency": consistency,
        "classification_coverage": coverage,
    }
    return _block({n: s.unit(x) for n, x in inputs.items()}, settings.trust)


# --------------------------------------------------------------------------- quality and trust
def profile_means(profile: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Per dataset the column means the scores are made of, in one grouped pass.

    Without `tags` every column counts as classified, which is how an ingest ends.
    """
    columns, tagged = profile, "count(1)"
    if tags is not None:
        keys = tags.selectExpr("dataset_id", "position", "1 AS tagged")
        columns, tagged = profile.join(keys, ["dataset_id", "position"], "left"), "count(tagged)"
    aggregates = [
        "avg(CASE WHEN row_count > 0 THEN non_null_count / row_count ELSE 0D END) AS completeness",
        "avg(CASE WHEN non_null_count = 0 THEN 1D ELSE type_match_count / non_null_count END) "
        "AS validity",
        "avg(CASE WHEN non_null_count = 0 THEN 1D ELSE dominant_type_share END) AS type_share",
        f"{tagged} AS classified",
        "count(1) AS columns",
    ]
    return columns.groupBy("dataset_id").agg(*[F.expr(a) for a in aggregates])


def profile_scores(
    profile: DataFrame,
    datasets: DataFrame,
    tags: DataFrame | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """Quality and Trust per dataset; an empty dataset scores 0, never NaN."""

    def of(x: str) -> str:
        return f"CASE WHEN row_count > 0 AND columns > 0 THEN {x} ELSE 0D END"

    penalty = (
        f"least({s.double(STRUCTURAL_PENALTY_CAP)}, "
        f"{s.double(STRUCTURAL_PENALTY_PER_ISSUE)} * size(array_distinct(structural_issues)))"
    )
    quality = quality_block(
        of("completeness"), of("validity"), of("1 - duplicate_row_count / row_count"), settings
    )
    scored = datasets.join(profile_means(profile, tags), "dataset_id", "left").selectExpr(
        "dataset_id",
        f"{quality} AS quality",
        f"struct({s.unit('type_share')} AS mean_dominant_type_share, "
        f"{s.unit(penalty)} AS structural_penalty, structural_issues) AS consistency_detail",
        "coalesce(try_divide(classified, columns), 0D) AS coverage",
    )
    trust = trust_block(
        "quality.score",
        "consistency_detail.mean_dominant_type_share * (1 - consistency_detail.structural_penalty)",
        "coverage",
        settings,
    )
    return scored.selectExpr("dataset_id", "quality", f"{trust} AS trust", "consistency_detail")


# --------------------------------------------------------------------------- value
def recommend(score: str, accesses_90d: str, trend: str, settings: Settings) -> str:
    cut = {k: s.double(v) for k, v in settings.recommend.items()}
    return (
        f"CASE WHEN {accesses_90d} = 0 OR {score} < {cut['retire_below']} THEN 'RETIRE' "
        f"WHEN {score} < {cut['archive_below']} AND {trend} < 0.5D THEN 'ARCHIVE' "
        f"WHEN {score} < {cut['optimize_below']} THEN 'OPTIMIZE' ELSE 'KEEP' END"
    )


def value_block(settings: Settings) -> str:
    """The Value block of a row with the access-window columns."""
    frequency = f"log1p(accesses_90d) / log1p({s.double(settings.freq_cap)})"
    decay = f"coalesce(exp(-days_since_last_access / {s.double(settings.half_life_days)}), 0D)"
    recency = f"{decay} * {s.unit(f'accesses_90d / {s.double(RECENCY_MIN_ACCESSES)}')}"
    trend = (
        "0.5D + (accesses_last30 - accesses_prev30) "
        f"/ (2D * greatest({TREND_BASELINE_MIN}L, accesses_prev30))"
    )
    raw = (
        "struct(accesses_90d, accesses_last30, accesses_prev30, "
        "coalesce(days_since_last_access, 0D) AS days_since_last_access, "
        f"{int(settings.freq_cap)} AS freq_cap, {s.double(settings.half_life_days)} AS half_life)"
    )
    inputs = {"frequency": s.unit(frequency), "recency": s.unit(recency), "trend": s.unit(trend)}
    return _block(inputs, settings.value, raw)


def value_from_windows(windows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds value, recommendation and is_declining to rows with access windows."""
    rule = recommend("value.score", "accesses_90d", "value.inputs.trend", settings)
    return windows.selectExpr("*", f"{value_block(settings)} AS value").selectExpr(
        "*", f"{rule} AS recommendation", "value.inputs.trend < 0.5D AS is_declining"
    )


# --------------------------------------------------------------------------- together
def dataset_scores(profile_part: DataFrame, value_part: DataFrame) -> DataFrame:
    """Quality, Trust and Value side by side. `value_part` covers every dataset."""
    return profile_part.join(
        value_part.select("dataset_id", "value", "recommendation"), "dataset_id"
    ).select("dataset_id", "quality", "trust", "value", "recommendation", "consistency_detail")


def reweight(scores: DataFrame, settings: Settings) -> DataFrame:
    """Quality and Trust again from their stored inputs, under other weights."""
    quality = quality_block(
        *[f"quality.inputs.{p}" for p in ("completeness", "validity", "uniqueness")], settings
    )
    trust = trust_block(
        "quality.score",
        "trust.inputs.consistency",
        "trust.inputs.classification_coverage",
        settings,
    )
    step = scores.withColumn("quality", F.expr(quality))
    return step.withColumn("trust", F.expr(trust))


def narrative(
    datasets: DataFrame, profile: DataFrame, tags: DataFrame, scores: DataFrame
) -> DataFrame:
    """One summary line per dataset; sensitive categories in order of their first column."""
    sensitive = tags.filter("sensitivity <> 'NONE'")
    first_seen = sensitive.groupBy("dataset_id", "category").agg(
        F.expr("min(position) AS position"), F.expr("count(1) AS n")
    )
    # At most one entry per category, so the collected list has a fixed bound.
    sensitive_part = first_seen.groupBy("dataset_id").agg(
        F.expr("sum(n) AS n"), F.expr("sort_array(collect_list(struct(position, category))) AS cats")
    )
    text = (
        "concat(name, ' — ', row_count, ' rows × ', column_count, ' cols. Quality ', "
        f"{s.half_up('quality.score')}, ', Trust ', {s.half_up('trust.score')}, ', Value ', "
        f"{s.half_up('value.score')}, ' (', recommendation, '). Duplicate rows: ', "
        "duplicate_row_count, '. Sensitive columns: ', coalesce(n, 0L), "
        "CASE WHEN n > 0 THEN concat(' (', array_join(cats.category, ', '), ')') ELSE '' END, '.')"
    )
    return (
        datasets.select("dataset_id", "name")
        .join(
            profile.select("dataset_id", "row_count", "column_count", "duplicate_row_count"),
            "dataset_id",
        )
        .join(
            scores.select("dataset_id", "quality", "trust", "value", "recommendation"),
            "dataset_id",
        )
        .join(sensitive_part, "dataset_id", "left")
        .selectExpr("dataset_id", f"{text} AS narrative")
    )
