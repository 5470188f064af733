from datetime import datetime, timedelta, timezone

import pytest
from helpers import table_case

from datawarden.config import Settings, SettingsError
from datawarden.functions import scalars as s
from datawarden.operators import score as sc
from datawarden.operators.views import explain_rows, score_bands
from datawarden.operators.usage import value_scores
from datawarden.plans.ingest import Analysis

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)
COLUMNS = "dataset_id string, position int, row_count bigint, non_null_count bigint, " \
    "type_match_count bigint, dominant_type_share double"
DATASETS = "dataset_id string, row_count bigint, column_count bigint, " \
    "duplicate_row_count bigint, structural_issues array<string>"


def worked_profile(spark, issues=()):
    columns = spark.createDataFrame(
        [("c", 0, 100, 100, 100, 1.0), ("c", 1, 100, 90, 88, 0.98), ("c", 2, 100, 100, 100, 1.0),
         ("c", 3, 100, 96, 90, 0.95)], COLUMNS,
    )
    datasets = spark.createDataFrame([("c", 100, 4, 3, list(issues))], DATASETS)
    tags = spark.createDataFrame([("c", i) for i in range(3)], "dataset_id string, position int")
    return sc.profile_scores(columns, datasets, tags).first()


def events(spark, offsets, hours=0):
    rows = [("d", NOW - timedelta(days=d, hours=hours)) for d in offsets]
    return spark.createDataFrame(rows, "dataset_id string, occurred_at timestamp")


def value_of(spark, offsets, hours=0, settings=Settings()):
    ids = spark.createDataFrame([("d",)], "dataset_id string")
    return value_scores(ids, events(spark, offsets, hours), NOW, settings).first()


def test_worked_quality_and_trust(spark):
    r = worked_profile(spark)
    q, t = r["quality"], r["trust"]
    assert q["inputs"]["completeness"] == pytest.approx(0.965, abs=1e-4)
    assert q["inputs"]["validity"] == pytest.approx(0.97882, abs=1e-4)
    assert q["inputs"]["uniqueness"] == pytest.approx(0.97)
    assert q["score"] == pytest.approx(97.06, abs=0.005)
    assert t["inputs"]["consistency"] == pytest.approx(0.9825, abs=1e-4)
    assert t["inputs"]["classification_coverage"] == pytest.approx(0.75)
    assert t["score"] == pytest.approx(91.90, abs=0.005) and t["score"] < q["score"]


def test_structural_penalty(spark):
    r = worked_profile(spark, ["DUPLICATE_HEADER", "RAGGED_ROWS", "RAGGED_ROWS"])
    assert r["consistency_detail"]["structural_penalty"] == pytest.approx(0.1)
    assert r["trust"]["inputs"]["consistency"] == pytest.approx(0.9825 * 0.9, abs=1e-4)


def test_empty_dataset_scores_zero(spark):
    columns = spark.createDataFrame([], COLUMNS)
    datasets = spark.createDataFrame([("e", 0, 0, 0, [])], DATASETS)
    r = sc.profile_scores(columns, datasets).first()
    assert r["quality"]["score"] == 0 and r["trust"]["score"] == 0


def test_value_anchors(spark):
    v = value_of(spark, [24, 35, 40, 45, 50, 55, 65, 70])
    raw, parts = v["value"]["raw"], v["value"]["inputs"]
    assert [raw[k] for k in ("accesses_90d", "accesses_last30", "accesses_prev30")] == [8, 1, 5]
    assert raw["days_since_last_access"] == 24
    assert parts["frequency"] == pytest.approx(0.558829, abs=1e-5)
    assert parts["recency"] == pytest.approx(0.449329, abs=1e-5)
    assert parts["trend"] == pytest.approx(0.1)
    assert v["value"]["score"] == pytest.approx(42.87, abs=0.005)
    assert (v["recommendation"], v["is_declining"]) == ("OPTIMIZE", True)

    v = value_of(spark, [])
    assert (v["value"]["score"], v["recommendation"]) == (pytest.approx(10.0), "RETIRE")
    assert v["last_accessed_at"] is None
    assert value_of(spark, [0])["value"]["score"] == pytest.approx(31.6, abs=0.05)

    spans = {
        "KEEP": ([*range(1, 21), *range(31, 43), *range(61, 74)], 94),
        "OPTIMIZE": ([24, 31, 36, 41, 46, 51, 61, 71], 43),
        # 45*log1p(4)/log1p(50) + 35*exp(-40.125/30) + 20*(0.5 - 3/10) = 31.6
        "ARCHIVE": ([40, 45, 50, 61], 32),
    }
    for expected, (offsets, score) in spans.items():
        v = value_of(spark, offsets, hours=3)
        assert (v["recommendation"], round(v["value"]["score"])) == (expected, score)


def test_window_edges(spark):
    v = value_of(spark, [0, 30, 60, 90, -1])["value"]["raw"]
    # now - 90d is outside, now - 30d belongs to the previous window, the future to none.
    assert (v["accesses_90d"], v["accesses_last30"], v["accesses_prev30"]) == (3, 1, 1)
    assert v["days_since_last_access"] == 0  # a later event never makes the age negative


def test_recommendation_table(spark):
    rows = [(91.91, 40, 0.83), (42.87, 8, 0.1), (27.65, 4, 0.0), (10.0, 0, 0.5), (27.65, 4, 0.5),
            (14.9, 3, 0.9), (99.0, 0, 1.0)]
    df = spark.createDataFrame(rows, "score double, n bigint, trend double")
    rule = sc.recommend("score", "n", "trend", Settings())
    assert [r[0] for r in df.selectExpr(rule).collect()] == [
        "KEEP", "OPTIMIZE", "ARCHIVE", "RETIRE", "OPTIMIZE", "RETIRE", "RETIRE",
    ]


def test_contributions_add_up(spark):
    freq, rows, headers = table_case(spark, ["email", "age"], [["a@x.io", "1"], ["b@x.io", None]])
    a = Analysis(freq, rows, headers, events(spark, [1, 2]), NOW)
    scores = a.scores.first()
    parts = explain_rows(a.scores).collect()
    for block in ("quality", "trust", "value"):
        total = sum(r["contribution"] for r in parts if r["score_name"] == block and r["under"] is None)
        assert total == pytest.approx(scores[block]["score"])
    assert {r["input_name"] for r in parts if r["under"] == "quality"} == {"completeness", "validity"}
    assert {r["score_name"] for r in score_bands(a.scores).collect()} == {"quality", "trust", "value"}


def test_unit_and_rounding(spark):
    df = spark.sql("SELECT * FROM VALUES (double('NaN')), (-1D), (0.5D), (7D), (NULL) AS v(x)")
    assert [r[0] for r in df.selectExpr(s.unit("x")).collect()] == [0.0, 0.0, 0.5, 1.0, 0.0]
    df = spark.sql("SELECT * FROM VALUES (2.5D), (-2.5D), (0.49D) AS v(x)")
    assert [r[0] for r in df.selectExpr(s.half_up("x")).collect()] == [3, -2, 0]


def test_settings_are_checked():
    ok = Settings().with_overrides({"value": {"frequency": 0.3335, "recency": 0.3335, "trend": 0.3335}})
    assert ok.value["trend"] == 0.3335
    for bad in (
        {"quality": {"completeness": 0.5, "validity": 0.3, "uniqueness": 0.3}},
        {"recommend": {"retire_below": 70, "archive_below": 35, "optimize_below": 60}},
        {"nope": 1},
        {"freq_cap": 0},
        {"half_life_days": 0.1},
        {"classify_threshold": 1.5},
        {"sensitivity": {"EMAIL": "HIGH"}},
    ):
        with pytest.raises(SettingsError):
            Settings().with_overrides(bad)
    for weights in (Settings().quality, Settings().trust, Settings().value):
        assert sum(weights.values()) == pytest.approx(1)
