"""Usage from the daily roll-up equals usage from the whole log."""

import random
import re
from datetime import datetime, timedelta, timezone

import pytest

from datawarden.operators.usage import access_rollup, access_windows, daily_usage, usage_summary, windows_at
from datawarden.sources.catalog_store import CatalogStore

BASE = datetime(2026, 1, 1, 7, 30, tzinfo=timezone.utc)
SCHEMA = "event_id bigint, dataset_id string, access_type string, source string, occurred_at timestamp"


def batch_of(spark, seed, n, back, ahead=5):
    """Events of six datasets, a third of them of one; some at midnight, some on the window's edge."""
    draw, rows = random.Random(seed), []
    for i in range(n):
        at = BASE + timedelta(days=draw.uniform(-back, ahead))
        if i % 7 == 0:
            at = at.replace(hour=0, minute=0, second=0, microsecond=0)
        if i % 11 == 0:
            at = BASE - timedelta(days=draw.choice([0, 30, 60, 90]), seconds=draw.choice([0, 0, 1, -1]))
        rows.append((seed * 10000 + i, draw.choice("aabcde"), draw.choice(["VIEW", "DOWNLOAD"]), "LIVE", at))
    return spark.createDataFrame(rows, SCHEMA)


def facts(ids, events, now):
    out = [access_windows(events, now), access_rollup(events, now), usage_summary(ids, events, now, 30, "VIEW")]
    out.append(daily_usage(ids, events, now, 60).filter("total > 0"))
    return [sorted(map(str, df.collect())) for df in out]


@pytest.mark.parametrize("unit", ["day", "month"])
def test_usage_equals_the_log(spark, tmp_path, unit):
    store = CatalogStore(spark, f"{tmp_path}/store", log_unit=unit)
    ids = spark.createDataFrame([(x,) for x in "abcdef"], "dataset_id string")

    def same(*instants):
        for now in instants:
            assert facts(ids, store.usage(now), now) == facts(ids, store.access_events(), now)

    assert store.usage(BASE).count() == 0
    store.append("access_events", batch_of(spark, 1, 60, 200), "one")
    store.roll_up(BASE - timedelta(days=95))
    same(BASE, BASE - timedelta(days=40))
    store.append("access_events", batch_of(spark, 2, 40, 400), "late")  # reaches behind the totals
    same(BASE)
    if unit == "day":
        return
    store.append("access_events", batch_of(spark, 3, 30, 300), "late")  # the batch again, with other rows
    same(BASE)
    store.roll_up(BASE - timedelta(days=91))
    store.append("access_events", batch_of(spark, 4, 40, 300), "one")  # the totals hold its first rows
    assert store._folders("usage_totals") == []
    same(BASE + timedelta(days=3))
    store.roll_up(BASE - timedelta(days=150))
    store.roll_up(BASE - timedelta(days=92))
    deleted = [("a", BASE - timedelta(days=120)), ("b", BASE), ("c", BASE - timedelta(days=20, hours=3))]
    store.append("tombstones", spark.createDataFrame(deleted, "dataset_id string, deleted_at timestamp"))
    same(BASE - timedelta(days=10))
    store.roll_up(BASE - timedelta(days=91))  # after the deletes
    same(BASE)
    assert len(store._folders("usage_totals")) == 2


def test_folders_are_pruned(spark, tmp_path):
    store = CatalogStore(spark, f"{tmp_path}/store")
    store.append("access_events", batch_of(spark, 1, 40, 200), "one")
    store.roll_up(BASE - timedelta(days=95))
    usage = access_windows(store.usage(BASE), BASE)
    plan = usage._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters: [" in line and "event_date" in line]
    assert len(filters) == 2 and all("PartitionFilters: []" not in line for line in filters)
    days = {"2026-01-01", "2025-12-02", "2025-11-02", "2025-10-03"}
    read = [set(re.findall(r"20\d\d-\d\d-\d\d", x.split("PartitionFilters: [")[1].split("]")[0])) for x in filters]
    assert days in read


def test_history_does_not_know_what_came_later(spark):
    rows = [(1, "a", "VIEW", "LIVE", BASE - timedelta(days=50)), (2, "a", "VIEW", "LIVE", BASE)]
    ids = spark.createDataFrame([("a",)], "dataset_id string")
    at = [BASE - timedelta(days=60), BASE - timedelta(days=40), BASE]
    got = windows_at(ids, spark.createDataFrame(rows, SCHEMA), at).orderBy("captured_at").collect()
    assert [r.days_since_last_access for r in got] == [None, 10.0, 0.0]
    assert [r.accesses_90d for r in got] == [0, 1, 2]
