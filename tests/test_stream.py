from datetime import datetime, timedelta, timezone

from datawarden.operators.usage import value_scores
from datawarden.operators.score import dataset_scores
from datawarden.sources.catalog_store import CatalogStore
from datawarden.streaming import access_stream as st

BASE = datetime(2026, 1, 1, tzinfo=timezone.utc)
SCHEMA = "event_id bigint, dataset_id string, access_type string, source string, occurred_at timestamp"


def write_files(spark, folder, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/part={i}")


def events(start, n, offset=0):
    return [
        (start + i, "ab"[i % 2], ("VIEW", "DOWNLOAD")[i % 3 == 0], "LIVE",
         BASE + timedelta(hours=offset + i)) for i in range(n)
    ]


def batch_counts(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = df.selectExpr("dataset_id", "to_date(occurred_at) AS date", "access_type").groupBy(
        "dataset_id", "date", "access_type").count().collect()
    return {(r[0], r[1], r[2]): r[3] for r in got}


def stream_counts(spark, target):
    return {(r["dataset_id"], r["date"], r["access_type"]): r["n"]
            for r in st.read_daily_usage(spark, target).collect()}


def test_daily_usage_equals_batch_over_several_triggers(spark, tmp_path):
    parts = [events(0, 30), events(30, 30, 20), events(60, 30, 40)]
    write_files(spark, f"{tmp_path}/in", parts)
    for mode in ("update", "complete"):
        out = f"{tmp_path}/{mode}"
        stream = st.access_stream(spark, f"{tmp_path}/in", SCHEMA, files_per_batch=1)
        st.start_daily_usage(stream, f"{out}/n", f"{out}/cp", mode, available_now=True).awaitTermination()
        assert stream_counts(spark, f"{out}/n") == batch_counts(spark, sum(parts, []))
    # A second run picks up new files only, and running counts go on.
    more = events(90, 10, 45)
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part=3")
    stream = st.access_stream(spark, f"{tmp_path}/in", SCHEMA, files_per_batch=1)
    out = f"{tmp_path}/update"
    st.start_daily_usage(stream, f"{out}/n", f"{out}/cp", "update", available_now=True).awaitTermination()
    assert stream_counts(spark, f"{out}/n") == batch_counts(spark, sum(parts, []) + more)


def test_intake_drops_repeated_events(spark, tmp_path):
    first = events(0, 20)
    write_files(spark, f"{tmp_path}/in", [first, first[10:] + events(20, 5, 20)])
    store = CatalogStore(spark, f"{tmp_path}/store")
    stream = st.deduplicated(st.access_stream(spark, f"{tmp_path}/in", SCHEMA, 1), "2 days")
    st.start_intake(stream, store, f"{tmp_path}/cp", available_now=True).awaitTermination()
    assert sorted(r["event_id"] for r in store.access_events().collect()) == list(range(25))


def test_value_follows_touched_datasets(spark, tmp_path):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "dataset_id string")
    none = spark.createDataFrame([], SCHEMA)
    parts = ids.selectExpr(
        "dataset_id", "struct(90D AS score) AS quality", "struct(80D AS score) AS trust",
        "CAST(NULL AS STRING) AS consistency_detail",
    )
    dataset_scores(parts, value_scores(ids, none, BASE)).write.parquet(f"{tmp_path}/scores")
    files = [events(0, 12), [(50, "b", "VIEW", "LIVE", BASE + timedelta(hours=12))]]
    write_files(spark, f"{tmp_path}/in", files)
    store = CatalogStore(spark, f"{tmp_path}/store")
    now = BASE + timedelta(days=1)
    st.start_value(
        st.access_stream(spark, f"{tmp_path}/in", SCHEMA, 1), store,
        lambda: spark.read.parquet(f"{tmp_path}/scores"), lambda: now, f"{tmp_path}/cp",
        available_now=True,
    ).awaitTermination()
    got = store.score_snapshots().collect()
    assert {r["dataset_id"] for r in got} == {"a", "b"}
    log = spark.createDataFrame(sum(files, []), SCHEMA)
    expected = {r["dataset_id"]: r["value"]["score"] for r in value_scores(ids, log, now).collect()}
    assert max(r["value_score"] for r in got if r["dataset_id"] == "b") == expected["b"]
    assert {r["value_score"] for r in got if r["dataset_id"] == "a"} == {expected["a"]}
    assert all(r["quality_score"] == 90 for r in got)


def test_a_day_is_one_folder_after_many_batches(spark, tmp_path):
    parts = [events(30 * k, 30, 20 * k) for k in range(6)]
    write_files(spark, f"{tmp_path}/in", parts)
    stream = st.access_stream(spark, f"{tmp_path}/in", SCHEMA, files_per_batch=1)
    out = f"{tmp_path}/n"
    st.start_daily_usage(stream, out, f"{tmp_path}/cp", available_now=True).awaitTermination()
    assert stream_counts(spark, out) == batch_counts(spark, sum(parts, []))
    kept = {d.name: [e.name for e in d.iterdir() if e.is_dir()] for d in (tmp_path / "n").iterdir() if d.is_dir()}
    assert len(kept) == 6 and all(len(epochs) <= 2 for epochs in kept.values())
    read = {f.split("/n/")[1].rsplit("/", 1)[0] for f in st.read_daily_usage(spark, out).inputFiles()}
    assert len(read) == len({f.split("/")[0] for f in read}) == 6


def by_hand(rows, every, last):
    """Windows of each dataset at every midnight, from the definition."""
    day, out = timedelta(days=1), {}
    grid = [BASE.replace(year=1970) + k * day for k in range(0, 22000, every)]
    for ds in {r[1] for r in rows if r[1]}:
        at = [r[4] for r in rows if r[1] == ds]
        count = lambda t, a, b: sum(t - b * day < x <= t - a * day for x in at)
        for t in grid:
            if t <= last and (count(t, 0, 90) or count(t - every * day, 0, 90)):
                out[ds, t] = (count(t, 0, 90), count(t, 0, 30), count(t, 30, 60), max(x for x in at if x <= t))
    return out


def ages(spark, tmp_path, parts, every):
    write_files(spark, f"{tmp_path}/in", parts)
    stream = st.access_stream(spark, f"{tmp_path}/in", SCHEMA, files_per_batch=1).withWatermark("occurred_at", "0 days")
    store = CatalogStore(spark, f"{tmp_path}/store")
    st.start_ageing_value(stream, store, f"{tmp_path}/cp", every_days=every, available_now=True).awaitTermination()
    return store.log("value_log")


def test_value_ages_without_events(spark, tmp_path):
    """a and d fall silent while others go on: KEEP at first, then ARCHIVE for d, RETIRE in the end."""
    busy = [(k, "a", "VIEW", "LIVE", BASE + timedelta(hours=10 * k)) for k in range(60)]
    other = [(1000 + k, "b", "VIEW", "LIVE", BASE + timedelta(days=k, hours=3)) for k in range(160)]
    midnight = [(2000 + k, "c", "VIEW", "LIVE", BASE + timedelta(days=k)) for k in (0, 30, 60, 90)]
    clock = [(None, None, None, "LIVE", BASE + timedelta(days=200, hours=12))]
    burst = [(3000 + k, "d", "VIEW", "LIVE", BASE + timedelta(hours=2 * k)) for k in range(8)]
    rows = sorted(busy + other + midnight + burst, key=lambda r: r[4])
    log = ages(spark, tmp_path, [rows[:40], rows[40:100], rows[100:150], rows[150:], clock], 1)
    got = log.selectExpr("dataset_id", "captured_at", "value.raw.*", "recommendation").collect()
    want = by_hand(rows, 1, clock[0][4])
    found = {(r.dataset_id, r.captured_at.replace(tzinfo=timezone.utc)): r for r in got}
    assert len(found) == len(got) and set(found) == set(want)
    for key, (n90, last30, prev30, last) in want.items():
        r = found[key]
        assert (r.accesses_90d, r.accesses_last30, r.accesses_prev30) == (n90, last30, prev30)
        assert abs(r.days_since_last_access - (key[1] - last).total_seconds() / 86400) < 1e-9
    path = lambda x: list(dict.fromkeys(r.recommendation for _, r in sorted(found.items(), key=lambda f: f[0][1]) if r.dataset_id == x))
    assert path("d").index("KEEP") < path("d").index("ARCHIVE") < path("d").index("RETIRE")
    assert path("a")[-1] == "RETIRE"


def test_a_dataset_wakes_again(spark, tmp_path):
    rows = [(1, "a", "VIEW", "LIVE", BASE), (2, "a", "VIEW", "LIVE", BASE + timedelta(days=250))]
    clock = [(None, None, None, "LIVE", BASE + timedelta(days=130, hours=1))]
    end = [(None, None, None, "LIVE", BASE + timedelta(days=400))]
    log = ages(spark, tmp_path, [rows[:1], clock, rows[1:], end], 7)
    got = {(r.dataset_id, r.captured_at.replace(tzinfo=timezone.utc)) for r in log.collect()}
    assert got == set(by_hand(rows, 7, end[0][4]))


def test_ageing_is_published(spark, tmp_path):
    ids = spark.createDataFrame([("a",), ("b",)], "dataset_id string")
    none = spark.createDataFrame([], SCHEMA)
    parts = ids.selectExpr(
        "dataset_id", "struct(90D AS score) AS quality", "struct(80D AS score) AS trust", "CAST(NULL AS STRING) AS consistency_detail"
    )
    store = CatalogStore(spark, f"{tmp_path}/store")
    store.write("dataset_scores", dataset_scores(parts, value_scores(ids, none, BASE)), "run-first")
    store.publish("run-first", ids, BASE - timedelta(days=1), ("dataset_scores",))
    rows = [(k, "a", "VIEW", "LIVE", BASE + timedelta(hours=k)) for k in range(40)]
    write_files(spark, f"{tmp_path}/in", [rows, [(None, None, None, "LIVE", BASE + timedelta(days=3, hours=5))]])
    stream = st.access_stream(spark, f"{tmp_path}/in", SCHEMA, files_per_batch=1).withWatermark("occurred_at", "0 days")
    st.start_ageing_value(
        stream, store, f"{tmp_path}/cp", scores=lambda: store.read("dataset_scores"), available_now=True
    ).awaitTermination()
    log = spark.createDataFrame(rows, SCHEMA)
    want = {r.dataset_id: r.value.score for r in value_scores(ids, log, BASE + timedelta(days=3)).collect()}
    got = {r.dataset_id: r.value.score for r in store.read("dataset_scores").collect()}
    assert got == want
