"""PII classification: a header signal and a value signal, resolved into one tag per column.

Every distinct non-blank value of a column has one vote. The value tests run on the grouped values
(value_freq), where each is tested once, and are counted per column in the map tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datawarden.config import (
    AMBIGUOUS_MIN,
    HEADER_CONFIDENCE,
    PII_CATEGORIES,
    SAMPLE_VALUES,
    SENSITIVITIES,
    Settings,
)
from datawarden.functions import scalars as s
from datawarden.functions.pii import (
    HINTED,
    STRONG_CATEGORIES,
    VALUE_CATEGORIES,
    header_category,
    value_tests,
)

KEY = ["dataset_id", "position"]


def header_categories(headers: DataFrame) -> DataFrame:
    return headers.selectExpr(*KEY, "name", f"{header_category('name')} AS header_category")


def value_shares(values: DataFrame, headers: DataFrame) -> DataFrame:
    """Per column the share of its distinct non-blank values that match each value category.

    `values` has dataset_id, position and value, one row for each vote. The result has
    header_category, sample_size (the votes) and a `shares` struct with one field per category.
    Categories that need a hint count only under a header that gives it.
    """
    votes = values.selectExpr(*KEY, f"{s.trimmed('value')} AS v")
    # Tested under their own hint here; whether the header gives it is known behind the join.
    counts = [
        f"count_if(v <> '' AND {value_tests('v', s.text(c))[c]}) AS m_{c}" for c in VALUE_CATEGORIES
    ]
    counted = votes.groupBy(*KEY).agg(
        F.expr("count_if(v <> '') AS votes"), *[F.expr(c) for c in counts]
    )

    def share(c: str) -> str:
        x = f"coalesce(try_divide(m_{c}, votes), 0D)"
        return f"CASE WHEN header_category <=> '{c}' THEN {x} ELSE 0D END" if c in HINTED else x

    shares = ", ".join(f"'{c}', {share(c)}" for c in VALUE_CATEGORIES)
    return header_categories(headers).join(counted, KEY, "left").selectExpr(
        *KEY,
        "name",
        "header_category",
        "coalesce(votes, 0L) AS sample_size",
        f"named_struct({shares}) AS shares",
    )


def best_value_category(shares: DataFrame) -> DataFrame:
    """The largest share as value_category and value_share: ties go to the header's category,
    then to the earlier category. No match at all gives null and 0."""
    candidates = ", ".join(
        f"struct(shares.{c} AS share, header_category <=> '{c}' AS hinted, {-i} AS place, "
        f"'{c}' AS category)"
        for i, c in enumerate(VALUE_CATEGORIES)
    )
    return shares.selectExpr(
        *KEY, "name", "header_category", f"array_max(array({candidates})) AS best"
    ).selectExpr(
        *KEY,
        "name",
        "header_category",
        "CASE WHEN best.share > 0 THEN best.category END AS value_category",
        "best.share AS value_share",
    )


def resolve_tags(best: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One tag per column. Ambiguous columns carry the best guess and needs_review.

    Decisive values (a share from the threshold on) win over the header, unless both name
    strong categories and disagree. A header stands when the values say nothing; a partial share
    leaves the column ambiguous if there is no header or the header is strong.
    """
    judged = best.selectExpr(
        "*",
        f"value_category IS NOT NULL AND value_share >= {s.double(settings.classify_threshold)} "
        "AS decisive",
        f"value_share >= {s.double(AMBIGUOUS_MIN)} AS partial",
        f"{s.one_of('header_category', STRONG_CATEGORIES)} AS strong_header",
        f"{s.one_of('value_category', STRONG_CATEGORIES)} AS strong_value",
    ).selectExpr(
        "*",
        "CASE WHEN decisive THEN coalesce(header_category <> value_category, false) "
        "AND strong_header AND strong_value "
        "WHEN header_category IS NOT NULL THEN strong_header AND partial ELSE partial END "
        "AS needs_review",
    ).selectExpr(
        "*",
        "value_category IS NOT NULL AND CASE WHEN needs_review THEN partial ELSE decisive END "
        "AS by_value",
    ).selectExpr(
        *KEY,
        "name",
        "CASE WHEN by_value THEN value_category ELSE coalesce(header_category, 'NONE') END "
        "AS category",
        "CASE WHEN by_value THEN value_share "
        f"WHEN header_category IS NOT NULL THEN {s.double(HEADER_CONFIDENCE)} END AS confidence",
        "needs_review",
    )
    tag = (
        "name, category, "
        f"{s.looked_up('category', settings.sensitivity)} AS sensitivity, "
        "confidence, 'AUTO_REGEX' AS source, false AS overridden, needs_review"
    )
    # A one-element inline: later filters on the tag stay above it. Pushed further down, they
    # would be rewritten over the nested expressions above, once per reference.
    return judged.selectExpr(*KEY, f"inline(array(struct({tag})))")


def classify(
    values: DataFrame, headers: DataFrame, settings: Settings = Settings()
) -> DataFrame:
    """Tags of all headers by their names and by all their distinct values."""
    return resolve_tags(best_value_category(value_shares(values, headers)), settings)


def classify_samples(columns: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Tags for columns(dataset_id, position, name, sample_values): each sample has a vote."""
    values = columns.selectExpr(*KEY, "explode(sample_values) AS value")
    return classify(values, columns.select(*KEY, "name"), settings)


def review_queue(tags: DataFrame, columns: DataFrame, k: int = SAMPLE_VALUES) -> DataFrame:
    """Ambiguous columns with the few samples a reviewer gets to see."""
    samples = columns.selectExpr(*KEY, f"slice(sample_values, 1, {int(k)}) AS sample_values")
    return (
        tags.filter("needs_review")
        .join(samples, KEY)
        .select(*KEY, "name", "category", "confidence", "sample_values")
    )


def apply_refinements(
    tags: DataFrame, refinements: DataFrame, settings: Settings = Settings()
) -> DataFrame:
    """Labels from outside, taken over for ambiguous columns only.

    `refinements` has dataset_id, position, category, sensitivity, confidence (text) and
    labelled_at; the latest label of a column counts, and it counts only with a known category.
    An unknown level falls back to the category's, a non-numeric confidence to null.
    """
    label = "struct(category, sensitivity, confidence)"
    latest = refinements.groupBy(*KEY).agg(
        F.expr(
            f"max_by({label}, struct(labelled_at, category, sensitivity, confidence)) AS label"
        )
    )
    known = latest.filter(s.one_of("label.category", PII_CATEGORIES)).selectExpr(
        *KEY,
        "label.category AS new_category",
        f"CASE WHEN {s.one_of('label.sensitivity', SENSITIVITIES)} THEN label.sensitivity "
        f"ELSE {s.looked_up('label.category', settings.sensitivity)} END AS new_sensitivity",
        "CASE WHEN NOT isnan(try_cast(label.confidence AS DOUBLE)) "
        "THEN try_cast(label.confidence AS DOUBLE) END AS new_confidence",
        "'AUTO_AI' AS new_source",
    )
    taken = "needs_review AND new_category IS NOT NULL"
    return tags.join(known, KEY, "left").selectExpr(
        *KEY,
        "name",
        *[
            f"CASE WHEN {taken} THEN new_{c} ELSE {c} END AS {c}"
            for c in ("category", "sensitivity", "confidence", "source")
        ],
        "overridden",
        "needs_review",
    )
