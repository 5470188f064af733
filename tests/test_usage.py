from datetime import datetime, timedelta, timezone

import pytest

from datawarden.operators.usage import access_rollup, daily_usage, usage_summary
from datawarden.operators.views import usage_normalised

NOW = datetime(2026, 1, 1, 15, tzinfo=timezone.utc)


def log(spark):
    rows = [
        ("a", "DETAIL_VIEW", NOW),
        ("a", "VIEW", NOW - timedelta(hours=16)),  # the day before, in UTC
        ("a", "VIEW", NOW - timedelta(days=89)),
        ("a", "DOWNLOAD", NOW - timedelta(days=90)),
        ("a", "VIEW", NOW + timedelta(days=1)),
    ]
    return spark.createDataFrame(rows, "dataset_id string, access_type string, occurred_at timestamp")


def ids(spark):
    return spark.createDataFrame([("a",), ("b",)], "dataset_id string")


def test_series_is_dense_and_typed(spark):
    got = daily_usage(ids(spark), log(spark), NOW).orderBy("dataset_id", "date").collect()
    a = [r for r in got if r["dataset_id"] == "a"]
    assert len(a) == 90 and len(got) == 180
    assert str(a[0]["date"]) == "2025-10-04" and str(a[-1]["date"]) == "2026-01-01"
    assert (a[-1]["detail_view"], a[-1]["total"]) == (1, 1)
    assert a[-2]["view"] == 1 and a[0]["view"] == 1
    assert sum(r["total"] for r in a) == 3
    assert all(r["total"] == 0 for r in got if r["dataset_id"] == "b")


def test_type_filter_narrows_series_and_summary(spark):
    series = daily_usage(ids(spark), log(spark), NOW, 30, "DOWNLOAD").collect()
    assert len(series) == 60 and sum(r["total"] for r in series) == 0
    s = {r["dataset_id"]: r for r in usage_summary(ids(spark), log(spark), NOW, 30, "DETAIL_VIEW").collect()}
    assert (s["a"]["accesses_90d"], s["a"]["accesses_last30"]) == (1, 1)
    assert str(s["a"]["from_date"]) == "2025-12-02"
    assert s["b"]["accesses_90d"] == 0 and s["b"]["last_accessed_at"] is None


def test_summary_windows_do_not_depend_on_days(spark):
    a, b = (usage_summary(ids(spark), log(spark), NOW, d).filter("dataset_id = 'a'").first() for d in (1, 365))
    assert a["accesses_90d"] == b["accesses_90d"] == 3


def test_rollup_keeps_its_own_window(spark):
    r = access_rollup(log(spark), NOW).first()
    # Closed at the lower edge and open to the future, unlike the scoring window.
    assert (r["access_count"], r["access_count_90d"]) == (5, 5)


def test_arguments(spark):
    for days in (0, 366):
        with pytest.raises(ValueError):
            daily_usage(ids(spark), log(spark), NOW, days)
    with pytest.raises(ValueError):
        daily_usage(ids(spark), log(spark), NOW, 30, "BOGUS")


def test_session_zone_does_not_move_days(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        a = daily_usage(ids(spark), log(spark), NOW).filter("dataset_id = 'a' AND total > 0")
        assert {str(r["date"]) for r in a.collect()} == {"2026-01-01", "2025-12-31", "2025-10-04"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_usage_normalised(spark):
    page = spark.createDataFrame([("a", 8), ("b", 2), ("c", 0)], "dataset_id string, access_count bigint")
    got = {r["dataset_id"]: r["usage_share"] for r in usage_normalised(page).collect()}
    assert got == {"a": 1.0, "b": 0.25, "c": 0.0}
    none = page.withColumn("access_count", page["access_count"] * 0)
    assert all(r["usage_share"] == 0 for r in usage_normalised(none).collect())
