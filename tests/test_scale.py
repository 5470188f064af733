"""What one task holds: bounded by rows, however the input's files are cut."""

from datetime import datetime

import pytest

from datawarden.operators import maintenance as mt
from datawarden.operators import profile as pf
from datawarden.plans import workload as wl
from datawarden.plans.ingest import Analysis
from datawarden.sources import catalog_store
from datawarden.sources.catalog_store import CatalogStore
from datawarden.sources.csv_files import read_csv_folder


def test_rows_are_dealt_to_tasks_by_number(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(pf, "ROWS_A_TASK", 100)
    for rows in (wl.dirty_orders(spark, sf_dir), wl.dirty_customers(spark, sf_dir)):
        sizes = [n for n in rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
        assert len(sizes) > 1 and max(sizes) <= 250


def test_findings_come_from_the_written_profiles(spark, tmp_path):
    freq = spark.createDataFrame([("d", 0, "1", 2), ("d", 0, None, 1)], "dataset_id string, position int, value string, n bigint")
    freq.write.parquet(f"{tmp_path}/freq")
    freq = spark.read.parquet(f"{tmp_path}/freq")
    rows = spark.createDataFrame([("d", 3, 1)], "dataset_id string, row_count bigint, duplicate_row_count bigint")
    headers = spark.createDataFrame([("d", 0, "a")], "dataset_id string, position int, name string")
    events = spark.createDataFrame([], "dataset_id string, access_type string, occurred_at timestamp")
    plain = Analysis(freq, rows, headers, events, wl.NOW)
    store, found = CatalogStore(spark, f"{tmp_path}/store"), Analysis(freq, rows, headers, events, wl.NOW)
    store.write("columns", found.columns, "run-1")
    found.take_counts(store.of_run("columns", "run-1"))
    for part in ("counts", "checks", "scores"):
        mine = getattr(found, part)
        assert not any("/freq/" in f for f in mine.inputFiles())
        assert sorted(map(repr, mine.collect())) == sorted(map(repr, getattr(plain, part).collect()))


def test_the_latest_override_is_found_without_sorting_requests(spark):
    at = [datetime(2024, 1, d) for d in (1, 2, 3)]
    requests = [
        ("d", 0, "EMAIL", None, at[0]), ("d", 0, "NAME", "LOW", at[2]), ("d", 0, "EMAIL", None, at[1]),
        ("d", 0, "BOGUS", None, at[2]),
        ("d", 1, "NAME", "LOW", at[1]), ("d", 1, "NAME", "HIGH", at[1]), ("d", 1, "NAME", None, at[1]),  # ties
        ("d", 2, "EMAIL", "LOW", None), ("d", 2, "NAME", "LOW", None), ("d", 3, "NAME", None, None),
        ("d", 3, "EMAIL", "HIGH", at[0]), ("d", 9, "EMAIL", None, at[0]),
    ]
    requests = spark.createDataFrame(
        requests, "dataset_id string, position int, category string, sensitivity string, requested_at timestamp"
    )
    columns = spark.createDataFrame([("d", i) for i in range(4)], "dataset_id string, position int")
    chosen = mt.valid_overrides(requests, columns)
    got = {r["position"]: (r["category"], r["sensitivity"]) for r in chosen.collect()}
    assert got == {0: ("NAME", "LOW"), 1: ("NAME", "LOW"), 2: ("NAME", "LOW"), 3: ("EMAIL", "HIGH")}
    plan = chosen._jdf.queryExecution().sparkPlan().toString()
    first = plan[plan.rindex("Aggregate("):]  # nearest to the requests
    assert "max(requested_at" in first and "HashAggregate" in plan and "max_by" not in first


@pytest.mark.parametrize("adaptive", ["true", "false"])  # streams run without it
def test_a_batch_has_few_files_a_folder(spark, tmp_path, monkeypatch, adaptive):
    monkeypatch.setattr(catalog_store, "EVENTS_A_TASK", 100)
    store = CatalogStore(spark, f"{tmp_path}/store")
    log = spark.range(400).repartition(8).selectExpr(
        "id AS event_id", "concat('d', id % 3) AS dataset_id", "'VIEW' AS access_type", "'LIVE' AS source",
        # half of all events on one day
        "timestamp_seconds(CASE WHEN id % 2 = 0 THEN 0 ELSE 86400 * (id % 10) END + id) AS occurred_at",
    )
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        store.append("access_events", log, batch="first")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    files = list((tmp_path / "store" / "access_events").rglob("*.parquet"))
    days = {f.parent for f in files}
    assert len(files) <= len(days) + 4  # one for each folder and each further task
    assert len([f for f in files if f.parent.name == "event_date=1970-01-01"]) >= 2  # the hot day is dealt
    assert sorted(r["event_id"] for r in store.access_events().collect()) == list(range(400))
    assert store.usage("1970-01-20T00:00:00Z").selectExpr("sum(n)").first()[0] == 400
    assert not list((tmp_path / "store" / "arriving").rglob("*.parquet"))


def test_csv_cells_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pf, "ROWS_A_TASK", 100)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x,y\n" + "".join(f"{i},{i % 7}\n" for i in range(1000)))
    intake = read_csv_folder(spark, str(tmp_path / "in"))
    sizes = [n for n in intake.cells().rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert sum(sizes) == 2000 and max(sizes) <= 500
