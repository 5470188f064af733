"""Changes to a catalogue, all as functions from log tables to new states.

Logs are append-only; the effective state is the latest entry per key, found by a grouped
max_by with map-side combine.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datawarden import config as cfg
from datawarden.config import PII_CATEGORIES, SENSITIVITIES, Settings
from datawarden.functions import scalars as s
from datawarden.operators.score import reweight, trust_block, value_from_windows
from datawarden.operators.usage import value_scores, windows_at

KEY = ["dataset_id", "position"]


# --------------------------------------------------------------------------- settings
def _between(x: str, bounds: tuple[float, float]) -> str:
    return f"{x} BETWEEN {bounds[0]} AND {bounds[1]}"


def _weights_ok(keys: tuple[str, ...]) -> str:
    names = ", ".join(s.text(k) for k in sorted(keys))
    return (
        f"coalesce(array_sort(map_keys(m)) = array({names}) "
        f"AND forall(map_values(m), x -> {_between('x', cfg.WEIGHT_RANGE)}) "
        f"AND abs(aggregate(map_values(m), 0D, (a, x) -> a + x) - 1) <= {cfg.WEIGHT_TOLERANCE}, false)"
    )


def acceptable_settings(log: DataFrame) -> DataFrame:
    """The entries that the settings' own checks would take; others never count.

    A null value is a tombstone and always taken.
    """
    number = "try_cast(json_value AS DOUBLE)"
    cuts = tuple(Settings().recommend)
    checks = {
        "classify_threshold": _between(number, cfg.THRESHOLD_RANGE),
        "freq_cap": f"{_between(number, cfg.FREQ_CAP_RANGE)} AND {number} = floor({number})",
        "half_life_days": _between(number, cfg.HALF_LIFE_RANGE),
        "recommend": f"array_sort(map_keys(m)) = array({', '.join(s.text(k) for k in sorted(cuts))}) "
        f"AND forall(map_values(m), x -> {_between('x', cfg.CUTOFF_RANGE)}) "
        f"AND m['{cuts[0]}'] <= m['{cuts[1]}'] AND m['{cuts[1]}'] <= m['{cuts[2]}']",
        "sensitivity": "array_sort(map_keys(t)) = array("
        + ", ".join(s.text(c) for c in sorted(PII_CATEGORIES))
        + f") AND forall(map_values(t), x -> {s.one_of('x', SENSITIVITIES)})",
    }
    for block in ("quality", "trust", "value"):
        checks[block] = _weights_ok(tuple(getattr(Settings(), block)))
    cases = " ".join(f"WHEN '{k}' THEN coalesce({c}, false)" for k, c in checks.items())
    parsed = log.selectExpr(
        "*",
        "from_json(json_value, 'map<string,double>') AS m",
        "from_json(json_value, 'map<string,string>') AS t",
    )
    kept = parsed.filter(f"json_value IS NULL OR CASE key {cases} ELSE false END")
    return kept.select(*log.columns)


def effective_settings(log: DataFrame, defaults: Settings = Settings()) -> DataFrame:
    """Eight rows (key, value, overridden, updated_at) from settings_log(key, json_value,
    updated_at).

    A null json_value is a tombstone: it takes the key back to its default, as does a later
    tombstone under the key '*' for all keys. Later entries win; within one instant the larger
    text does. Values that the settings would refuse are passed over.
    """
    known = acceptable_settings(log).filter(s.one_of("key", [*defaults.keys(), "*"]))
    latest = known.groupBy("key").agg(F.expr("max(struct(updated_at, json_value)) AS entry"))
    # At most nine rows are left: one per key and the reset marker.
    folded = latest.agg(F.expr("map_from_entries(collect_list(struct(key, entry))) AS entries"))
    rows = ", ".join(
        f"struct({s.text(k)} AS key, {s.text(v)} AS fallback)" for k, v in defaults.as_json().items()
    )
    found = folded.selectExpr("entries", f"inline(array({rows}))").selectExpr(
        "key",
        "fallback",
        "try_element_at(entries, key) AS entry",
        "try_element_at(entries, '*').updated_at AS reset_at",
    )
    live = (
        "entry.json_value IS NOT NULL AND (reset_at IS NULL OR entry.updated_at > reset_at)"
    )
    return found.selectExpr(
        "key",
        f"CASE WHEN {live} THEN entry.json_value ELSE fallback END AS value",
        f"coalesce({live}, false) AS overridden",
        f"CASE WHEN {live} THEN entry.updated_at END AS updated_at",
    )


def load_settings(log: DataFrame, defaults: Settings = Settings()) -> Settings:
    """The settings an operator runs with. Reads at most eight short rows to the driver."""
    rows = effective_settings(log, defaults).filter("overridden").collect()
    return defaults.with_overrides({r["key"]: json.loads(r["value"]) for r in rows})


# --------------------------------------------------------------------------- overrides
_OVERRIDE_OK = (
    f"{s.one_of('category', PII_CATEGORIES)} "
    f"AND (sensitivity IS NULL OR {s.one_of('sensitivity', SENSITIVITIES)})"
)


def valid_overrides(
    requests: DataFrame, columns: DataFrame, settings: Settings = Settings()
) -> DataFrame:
    """The latest acceptable override per column.

    Requests(dataset_id, position, category, sensitivity, requested_at) need a known category
    and, if they give one, a known level; the level defaults by category.
    """
    # The last time of each decision first: a timestamp is kept in a hash map, where structs of texts
    # would have every request sorted in its task.
    decisions = requests.filter(_OVERRIDE_OK).groupBy(*KEY, "category", "sensitivity").agg(
        F.max("requested_at").alias("requested_at")
    )
    latest = decisions.groupBy(*KEY).agg(
        F.expr(
            "max_by(struct(category, sensitivity), struct(requested_at, category, sensitivity)) AS o"
        )
    )
    return latest.join(columns.select(*KEY), KEY, "left_semi").selectExpr(
        *KEY,
        "o.category AS category",
        f"coalesce(o.sensitivity, {s.looked_up('o.category', settings.sensitivity)}) "
        "AS sensitivity",
    )


def rejected_overrides(requests: DataFrame, datasets: DataFrame, columns: DataFrame) -> DataFrame:
    """Requests that cannot be applied, with the reason: unknown category or level, unknown
    dataset, unknown column."""
    known_dataset = datasets.selectExpr("dataset_id", "true AS has_dataset")
    known_column = columns.selectExpr(*KEY, "true AS has_column")
    return (
        requests.join(known_dataset, "dataset_id", "left")
        .join(known_column, KEY, "left")
        .selectExpr(
            *requests.columns,
            f"CASE WHEN NOT ({_OVERRIDE_OK}) THEN 'validation_error' "
            "WHEN has_dataset IS NULL THEN 'dataset_not_found' "
            "WHEN has_column IS NULL THEN 'column_not_found' END AS code",
        )
        .filter("code IS NOT NULL")
    )


def apply_overrides(tags: DataFrame, overrides: DataFrame) -> DataFrame:
    """Tags after the overrides: MANUAL, without a confidence. A column without a tag gets one."""
    manual = overrides.selectExpr(
        *KEY, "category AS manual_category", "sensitivity AS manual_sensitivity"
    )
    made = "manual_category IS NOT NULL"
    return tags.join(manual, KEY, "full").selectExpr(
        *KEY,
        "coalesce(manual_category, category) AS category",
        f"CASE WHEN {made} THEN manual_sensitivity ELSE sensitivity END AS sensitivity",
        f"CASE WHEN NOT ({made}) THEN confidence END AS confidence",
        f"CASE WHEN {made} THEN 'MANUAL' ELSE source END AS source",
        f"{made} OR coalesce(overridden, false) AS overridden",
    )


def retrust(
    scores: DataFrame, datasets: DataFrame, tags: DataFrame, settings: Settings = Settings()
) -> DataFrame:
    """Trust again from the stored quality and consistency and the present tag coverage.

    Quality and Value keep their blocks.
    """
    tagged = tags.groupBy("dataset_id").agg(F.expr("count(category) AS tagged"))
    coverage = "coalesce(try_divide(coalesce(tagged, 0L), column_count), 0D)"
    trust = trust_block("quality.score", "trust.inputs.consistency", coverage, settings)
    return (
        scores.join(datasets.select("dataset_id", "column_count"), "dataset_id")
        .join(tagged, "dataset_id", "left")
        .withColumn("trust", F.expr(trust))
        .select(*scores.columns)
    )


# --------------------------------------------------------------------------- recompute
def recompute_scores(
    scores: DataFrame, events: DataFrame, now: datetime | str, settings: Settings
) -> DataFrame:
    """All three scores under new settings: Quality and Trust re-weighted from their stored
    inputs, Value derived from the events. Takes scored datasets only."""
    return recompute_value(reweight(scores, settings), events, now, settings)


def recompute_value(
    scores: DataFrame, events: DataFrame, now: datetime | str, settings: Settings = Settings()
) -> DataFrame:
    """Only the Value block replaced; Quality and Trust stay as stored."""
    fresh = value_scores(scores.select("dataset_id"), events, now, settings)
    return (
        scores.drop("value", "recommendation")
        .join(fresh.select("dataset_id", "value", "recommendation"), "dataset_id")
        .select(*scores.columns)
    )


def value_history(
    scores: DataFrame, events: DataFrame, instants: list[datetime | str], settings: Settings = Settings()
) -> DataFrame:
    """Snapshots of all scored datasets at several instants, Value as it was then.

    The windows of all instants are counted in one pass over the events.
    """
    windows = windows_at(scores.select("dataset_id"), events, instants)
    fresh = value_from_windows(windows, settings).selectExpr(
        "dataset_id", "captured_at", "value.score AS value_score"
    )
    known = scores.filter("quality.score IS NOT NULL AND trust.score IS NOT NULL")
    return known.join(fresh, "dataset_id").selectExpr(
        "dataset_id", "quality.score AS quality_score", "trust.score AS trust_score", "value_score",
        "captured_at",
    )


def score_snapshots(scores: DataFrame, captured_at: datetime | str) -> DataFrame:
    """Rows to append to the score history; a dataset needs all three scores."""
    return scores.filter("quality.score IS NOT NULL AND trust.score IS NOT NULL").selectExpr(
        "dataset_id",
        "quality.score AS quality_score",
        "trust.score AS trust_score",
        "value.score AS value_score",
        f"{s.instant(captured_at)} AS captured_at",
    )


def remap_tags(tags: DataFrame, settings: Settings) -> DataFrame:
    """Automatic tags moved to the level their category has now; overridden tags stay.

    Adds `changed`; its true count is the number of updated tags.
    """
    level = s.looked_up("category", settings.sensitivity)
    changed = f"coalesce(NOT overridden AND sensitivity <> {level}, false)"
    return tags.withColumns(
        {
            "changed": F.expr(changed),
            "sensitivity": F.expr(f"CASE WHEN {changed} THEN {level} ELSE sensitivity END"),
        }
    )


def recompute_counts(datasets: DataFrame, scores: DataFrame, remapped: DataFrame) -> DataFrame:
    """One row: datasets updated, datasets skipped for lack of scores, tags updated."""
    known = scores.selectExpr("dataset_id", "1 AS scored")
    done = datasets.select("dataset_id").join(known, "dataset_id", "left").selectExpr(
        "CAST(scored IS NOT NULL AS BIGINT) AS updated",
        "CAST(scored IS NULL AS BIGINT) AS skipped",
        "0L AS tags_updated",
    )
    moved = remapped.selectExpr(
        "0L AS updated", "0L AS skipped", "CAST(changed AS BIGINT) AS tags_updated"
    )
    return done.unionByName(moved).selectExpr(
        *[f"coalesce(sum({c}), 0L) AS {c}" for c in ("updated", "skipped", "tags_updated")]
    )


# --------------------------------------------------------------------------- deletes
def tombstones_by_name(datasets: DataFrame, names: list[str], at: datetime | str) -> DataFrame:
    return datasets.filter(s.one_of("name", names)).selectExpr(
        "dataset_id", f"{s.instant(at)} AS deleted_at"
    )


def without_deleted(table: DataFrame, tombstones: DataFrame, at: str | None = None) -> DataFrame:
    """Cascade: every table is read through this.

    With `at`, a timestamp column of the table, a tombstone hides only what is not newer than
    itself, so that a dataset can come back after a delete.
    """
    if at is None:
        return table.join(tombstones.select("dataset_id"), "dataset_id", "left_anti")
    last = tombstones.groupBy("dataset_id").agg(F.expr("max(deleted_at) AS deleted_at"))
    kept = table.join(last, "dataset_id", "left").filter(f"deleted_at IS NULL OR deleted_at < {at}")
    return kept.select(*table.columns)
