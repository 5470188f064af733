"""CSV folders to a published catalogue, then reads and changes of that catalogue."""

from datetime import datetime, timezone

import pytest

from pyspark.sql import functions as F

from datawarden.config import Settings
from datawarden.operators import catalog as cat
from datawarden.operators import maintenance as mt
from datawarden.operators import profile as pf
from datawarden.plans.ingest import ingest_csv
from datawarden.sources.catalog_store import CatalogStore, new_run_id
from datawarden.sources.csv_files import mapped_lines, placed_lines, read_csv_folder, split_maps, split_states
from datawarden.sources.tables import export_catalog

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)
CUSTOMERS = """email,phone,full_name,country
ada@example.com,+1-415-555-0132,Ada Lovelace,US
linus@example.com,+358-40-5551234,Linus Torvalds,FI
alan@example.com,+44-20-7946-0958,Alan Turing,GB
radia@example.com,+1-425-555-0193,Radia Perlman,
"""
FOUR = """email,full_name,age,signup_date
ada@example.com,Ada Lovelace,36,2023-01-15
grace@example.com,Grace Hopper,45,2023-02-20
alan@example.com,Alan Turing,41,2023-03-10
ada@example.com,Ada Lovelace,36,2023-01-15
"""
FILES = {
    "customers.csv": CUSTOMERS,
    "four.CSV": FOUR,
    "broken.csv": "id,name,name\n1,Alice,Smith,extra\n2,Bob\n3,Carol,Jones\n",
    "short.csv": "a,b,c\n1,2,3\n5,6\n",
    "nul.csv": "id,name\n1,a\0b\n2,c\0d",
    "collide.csv": "a,a_2,a\n1,2,3\n4,5,6\n",
    "stray.csv": "a,b\n1,\"oops\n" + "".join(f"{i},{i}\n" for i in range(200)),
    "multi.csv": 'id,note\n1,"two\nlines, ""quoted"""\n2,plain\n',
    "inch.csv": 'id,size\n1,5" pipe\n2,"""a"""\n3,""\n',
    "quoted_head.csv": '"a, b",,"say ""hi"""\n1,2,3\n',
    "empty.csv": "",
    "header_only.csv": "a,b\n",
    "bom.csv": "﻿x,y\r\n1,2\r\n3,4\r\n",
    "notes.pdf": "%PDF",
    "book.xlsx": "PK",
    "with [brackets].csv": "q\n7\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("csv files")
    for name, content in FILES.items():
        (base / name).write_bytes(content.encode())
    return str(base)


@pytest.fixture(scope="module")
def intake(spark, folder):
    return read_csv_folder(spark, folder)


def by_file(df, intake, *columns):
    names = intake.manifest.selectExpr("file_id AS dataset_id", "file_name")
    out = {}
    for r in df.join(names, "dataset_id").collect():
        out.setdefault(r["file_name"], []).append(tuple(r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


def test_manifest(intake):
    m = {r["file_name"]: r for r in intake.manifest.collect()}
    assert set(m) == set(FILES)
    assert {k: r["code"] for k, r in m.items() if r["code"]} == {
        "stray.csv": "invalid_file", "empty.csv": "empty_file", "header_only.csv": "empty_file",
        "notes.pdf": "unsupported_file_type", "book.xlsx": "unsupported_file_type",
    }
    assert "unterminated quote" in m["stray.csv"]["message"]
    assert m["quoted_head.csv"]["headers"] == ["a, b", "", 'say "hi"']
    assert m["bom.csv"]["headers"] == ["x", "y"]
    assert m["collide.csv"]["headers"] == ["a", "a_2", "a"]


def test_names(spark, folder):
    names = {"nul.csv": "  Clean bytes ", "bom.csv": " ", "inch.csv": "n" * 256, "four.CSV": "n" * 255}
    m = {r["file_name"]: r for r in read_csv_folder(spark, folder, names=names).manifest.collect()}
    assert {k for k, r in m.items() if r["code"] == "invalid_name"} == {"bom.csv", "inch.csv"}
    assert (m["nul.csv"]["name"], m["four.CSV"]["name"]) == ("Clean bytes", "n" * 255)


QUOTES = [
    '1,5" pipe\n2,"oops\n' + "".join(f"{i},x\n" for i in range(47)),  # never closes
    '1,"two\nlines"\n2,5" pipe\n',
    '1,""\n2,""""\n3,"""a"""\n4,"a""b"\n5,"a,""b"",c"\n',
    '1,"a\n\nb"\n\n2,"x""\n""y"\n"3\n",z\n',
    '1,"a"b\n2,a"b"\n3,"c"\n',
    '1,"' + '""' * 20000 + '"\n',
    '1,"' + "line\n" * 3000 + '"\n2,"x"\n',
    '1,"""\n2,b\n',
]


def _parsed(text):
    """Records of a text with a header line, or None for an open quote; character by character."""
    out, row, cell, inside, quoted = [], [], "", False, False
    for i, c in enumerate(text + ("" if text.endswith("\n") else "\n")):
        if inside:
            if c == '"':
                inside = False
            cell += c
        elif c == '"' and (cell == "" or quoted and cell.endswith('"') and text[i - 1] == '"'):
            inside, quoted = True, True
            cell += c
        elif c in ",\n":
            if quoted and len(cell) > 1 and cell.endswith('"'):
                cell = cell[1:-1].replace('""', '"')
            row.append(cell or None)
            cell, quoted = "", False
            if c == "\n":
                if row != [None]:
                    out.append(row)
                row = []
        else:
            cell += c
    return None if inside else out


@pytest.mark.parametrize("split", [None, "40"])
def test_quotes_in_splits(spark, tmp_path, split):
    for i, text in enumerate(QUOTES):
        (tmp_path / f"q{i}.csv").write_text("a,b\n" + text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split or "128m")
    spark.conf.set("spark.sql.files.openCostInBytes", "1" if split else "4m")
    few = tmp_path if split is None else tmp_path / "q[0-4].csv"
    try:
        intake = read_csv_folder(spark, str(few))
        codes = {r["file_name"]: r["code"] for r in intake.manifest.collect()}
        rows = by_file(intake.rows.withColumn("at", F.struct("ord.block", "ord.row")), intake, "at", "cells")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, code in codes.items():
        want = _parsed("a,b\n" + QUOTES[int(name[1])])
        assert (code == "invalid_file") == (want is None), name
        assert code in (None, "invalid_file")
        if want is not None:
            assert [r[1] for r in rows[name]] == want[1:], name


def test_long_records_reject_their_file(spark, tmp_path):
    (tmp_path / "long.csv").write_text('a,b\n1,"x' + "\n" * 50 + '"\n2,3\n')
    (tmp_path / "good.csv").write_text('a,b\n1,"x' + "\n" * 20 + '"\n2,3\n')
    intake = read_csv_folder(spark, str(tmp_path), max_record_lines=30)
    codes = {r.file_name: r.code for r in intake.manifest.collect()}
    assert codes == {"long.csv": "record_too_long", "good.csv": None}
    assert sorted(r.cells[1] for r in intake.rows.collect()) == ["3", "x" + "\n" * 20]


def test_lines_are_placed_without_moving(spark, folder):
    lines = mapped_lines(spark, folder)
    states = split_states(split_maps(lines))
    plan = placed_lines(lines, states)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "line#" in x]
    assert moved == [] and "ArrowEvalPython" in plan


def test_size_cap(spark, folder):
    m = {r["file_name"]: r["code"] for r in read_csv_folder(spark, folder, max_bytes=500).manifest.collect()}
    assert m["stray.csv"] == "file_too_large" and m["nul.csv"] is None


def test_shape(intake):
    got = by_file(intake.shape(), intake, "row_count", "ragged_rows")
    assert got["broken.csv"] == [(3, 2)] and got["short.csv"] == [(2, 1)]
    assert got["multi.csv"] == [(2, 0)] and got["inch.csv"] == [(3, 0)]
    assert got["customers.csv"] == [(4, 0)] and got["with [brackets].csv"] == [(1, 0)]


def test_cells(intake):
    freq = pf.value_freq(intake.cells())
    got = by_file(pf.sample_values(freq), intake, "position", "sample_values")
    assert got["nul.csv"][1] == (1, ["ab", "cd"])
    assert got["multi.csv"][1] == (1, ['two\nlines, "quoted"', "plain"])
    assert got["inch.csv"] == [(0, ["1", "2", "3"]), (1, ['5" pipe', '"a"'])]
    assert got["bom.csv"] == [(0, ["1", "3"]), (1, ["2", "4"])]


@pytest.fixture(scope="module")
def store(spark, folder, tmp_path_factory):
    made = CatalogStore(spark, str(tmp_path_factory.mktemp("catalog")))
    names = {"nul.csv": "  Clean bytes "}
    rejects = ingest_csv(spark, folder, made, NOW, names=names)
    assert rejects.count() == 5
    return made


def datasets_of(store):
    return cat.with_scores(store.read("datasets"), store.read("dataset_scores"))


def ids_of(store):
    return {r["name"]: r["dataset_id"] for r in store.read("datasets").collect()}


def test_ingested_datasets(store):
    d = {r["name"]: r for r in datasets_of(store).collect()}
    assert len(d) == 11
    assert d["Clean bytes"]["original_filename"] == "nul.csv"  # a given name counts trimmed
    assert d["broken.csv"]["status"] == "FAILED" and d["broken.csv"]["quality_score"] is None
    assert d["broken.csv"]["error_message"].startswith("File is not rectangular")
    four = d["four.CSV"]
    assert (four["status"], four["row_count"], four["column_count"]) == ("READY", 4, 4)
    assert four["quality_score"] == pytest.approx(92.5)
    assert (four["value_score"], four["recommendation"]) == (pytest.approx(10), "RETIRE")
    assert four["narrative"] == (
        "four.CSV — 4 rows × 4 cols. Quality 93, Trust 97, Value 10 (RETIRE). "
        "Duplicate rows: 1. Sensitive columns: 2 (EMAIL, NAME)."
    )


def test_ingested_tags_and_checks(store):
    ids = ids_of(store)
    tags = store.read("tags").filter(f"dataset_id = '{ids['four.CSV']}'").orderBy("position").collect()
    assert [t["category"] for t in tags] == ["EMAIL", "NAME", "NONE", "NONE"]
    columns = store.read("columns").filter(f"dataset_id = '{ids['four.CSV']}'").orderBy("position")
    assert [c["data_type"] for c in columns.collect()] == ["STRING", "STRING", "INTEGER", "DATE"]
    checks = store.read("quality_checks").filter(f"dataset_id = '{ids['four.CSV']}'").collect()
    assert [c["check_type"] for c in checks] == ["DUPLICATE_ROWS"]
    assert store.read("tags").filter(f"dataset_id = '{ids['broken.csv']}'").count() == 0
    one = cat.checks_of_column(store.read("quality_checks"), ids["customers.csv"], 3).collect()
    assert [c["check_type"] for c in one] == ["MISSING_VALUES"]
    preview = store.read("preview_rows").filter(f"dataset_id = '{ids['collide.csv']}'")
    rows = preview.orderBy("row_number").collect()
    assert [[c["value"] for c in r["cells"]] for r in rows] == [["1", "2", "3"], ["4", "5", "6"]]


def test_overview_and_lists(spark, store):
    d, tags = datasets_of(store), store.read("tags")
    status = {r["status"]: r["n"] for r in cat.status_counts(d).collect()}
    assert status == {"PROCESSING": 0, "READY": 9, "FAILED": 2}
    assert cat.overview_totals(d).first()["total_datasets"] == 11
    recs = {r["recommendation"]: r["n"] for r in cat.recommendation_counts(d).collect()}
    assert recs == {"KEEP": 0, "OPTIMIZE": 0, "ARCHIVE": 0, "RETIRE": 9}
    assert {r["name"] for r in cat.needs_attention(d).collect()} >= {"broken.csv", "short.csv"}
    high = cat.by_sensitivity(d, tags, "HIGH").collect()
    assert {r["name"] for r in high} == {"customers.csv", "four.CSV"}
    pages = []
    for offset in (0, 4, 8):
        page = cat.catalog_page(d, tags, store.access_events(), NOW, "-quality_score", limit=4, offset=offset)
        pages += [(r["name"], r["quality_score"]) for r in page.collect()]
    assert len({n for n, _ in pages}) == 11
    assert {n for n, q in pages[-2:]} == {"broken.csv", "short.csv"}  # unscored last
    assert cat.sorted_catalog(d, "quality_score").collect()[-1]["quality_score"] is None
    assert cat.matching(d, tags, "HIGH", "RETIRE").count() == 2
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}, {"sort": "size"}, {"sensitivity": "TOP"}):
        with pytest.raises(ValueError):
            cat.catalog_page(d, tags, store.access_events(), NOW, **bad)
    empty = cat.overview_totals(d.limit(0)).first()
    assert (empty["total_datasets"], empty["avg_quality"], empty["total_rows"]) == (0, 0.0, 0)


def test_detail_and_tracking(spark, store):
    ids = ids_of(store)
    views = spark.createDataFrame(
        [(1, ids["four.CSV"], "DETAIL_VIEW", "LIVE", NOW), (2, ids["broken.csv"], "VIEW", "LIVE", NOW)],
        "event_id bigint, dataset_id string, access_type string, source string, occurred_at timestamp",
    )
    allowed = cat.trackable(views, store.read("datasets"))
    assert [r["event_id"] for r in allowed.collect()] == [1]
    store.append("access_events", allowed, batch="views")
    store.append("access_events", allowed, batch="views")  # repeated batch: nothing twice
    assert store.access_events().count() == 1
    assert store.access_events(since=NOW).count() == 1
    fresh = mt.recompute_value(store.read("dataset_scores"), store.access_events(), NOW)
    run = new_run_id()
    store.write("dataset_scores", fresh, run)
    store.publish(run, fresh, datetime(2026, 1, 2), tables=("dataset_scores",))
    store.append("score_snapshots", mt.score_snapshots(fresh, NOW), batch="views")
    assert store.score_snapshots().count() == 9
    d = cat.detail(
        ids["four.CSV"], datasets_of(store), store.read("columns"), store.read("tags"),
        store.read("quality_checks"), store.access_events(), NOW,
    )
    summary = d["summary"].first()
    assert summary["value_score"] == pytest.approx(31.6, abs=0.05)
    assert (summary["recommendation"], summary["access_count"]) == ("OPTIMIZE", 1)
    assert (summary["pii_column_count"], summary["highest_sensitivity"]) == (2, "HIGH")
    assert [r["position"] for r in d["columns"].collect()] == [0, 1, 2, 3]
    assert d["usage"].count() == 90 and d["usage_summary"].first()["accesses_90d"] == 1
    untouched = datasets_of(store).filter("name = 'collide.csv'").first()
    assert untouched["value_score"] == pytest.approx(10)


def test_export(spark, store, tmp_path):
    rows = cat.summaries(datasets_of(store), store.read("tags"), store.access_events(), NOW)
    export_catalog(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 11


def test_unpublished_runs_are_invisible(store):
    before = store.read("tags").count()
    store.write("tags", store.read("tags").limit(1), new_run_id())
    assert store.read("tags").count() == before


def test_overrides(spark, store):
    ids = ids_of(store)
    four = ids["four.CSV"]
    scores = store.read("dataset_scores").filter(f"dataset_id = '{four}'")
    tags = store.read("tags").filter(f"dataset_id = '{four}' AND position <> 2")
    columns, listed = store.read("columns"), store.read("datasets")
    schema = "dataset_id string, position int, category string, sensitivity string, requested_at int"
    requests = spark.createDataFrame(
        [(four, 0, "EMAIL", "LOW", 1), (four, 0, "EMAIL", None, 2), (four, 9, "NAME", None, 1),
         ("nowhere", 0, "NAME", None, 1), (four, 1, "NOT_A_CATEGORY", None, 5)], schema,
    )
    codes = {(r["dataset_id"], r["position"]): r["code"]
             for r in mt.rejected_overrides(requests, listed, columns).collect()}
    assert codes == {(four, 9): "column_not_found", ("nowhere", 0): "dataset_not_found",
                     (four, 1): "validation_error"}
    changed = mt.apply_overrides(tags, mt.valid_overrides(requests, columns))
    t = {r["position"]: r for r in changed.collect()}
    assert [t[0][c] for c in ("category", "sensitivity", "source", "overridden", "confidence")] == [
        "EMAIL", "HIGH", "MANUAL", True, None,
    ]
    assert t[1]["source"] == "AUTO_REGEX" and 2 not in t
    lowered = mt.retrust(scores, listed, changed).first()
    before = scores.first()
    assert lowered["trust"]["inputs"]["classification_coverage"] == pytest.approx(0.75)
    assert lowered["trust"]["score"] < before["trust"]["score"]
    assert lowered["quality"] == before["quality"] and lowered["value"] == before["value"]
    again = spark.createDataFrame([(four, 2, "NONE", None, 3)], schema)
    restored = mt.apply_overrides(changed, mt.valid_overrides(again, columns))
    full = mt.retrust(scores, listed, restored).first()
    assert full["trust"]["score"] == pytest.approx(before["trust"]["score"])
    # A later re-map moves automatic tags only.
    s = Settings().with_overrides({"sensitivity": {**Settings().sensitivity, "EMAIL": "LOW", "NAME": "LOW"}})
    moved = {r["position"]: r for r in mt.remap_tags(restored, s).collect()}
    assert (moved[0]["sensitivity"], moved[0]["changed"]) == ("HIGH", False)
    assert (moved[1]["sensitivity"], moved[1]["changed"]) == ("LOW", True)


def test_recompute(store):
    scores, events = store.read("dataset_scores"), store.access_events()
    s = Settings().with_overrides(
        {"trust": {"quality": 1.0, "consistency": 0.0, "classification_coverage": 0.0}}
    )
    for r in mt.recompute_scores(scores, events, NOW, s).collect():
        assert r["trust"]["score"] == pytest.approx(r["quality"]["score"])
        assert r["trust"]["weights"]["quality"] == 1
    same = mt.recompute_scores(scores, events, NOW, Settings())
    assert sorted(same.collect(), key=str) == sorted(scores.collect(), key=str)
    counts = mt.recompute_counts(store.read("datasets"), scores, mt.remap_tags(store.read("tags"), s))
    assert tuple(counts.first()) == (9, 2, 0)


def test_compaction_keeps_the_present_state(spark, store):
    tables = ("datasets", "columns", "tags", "quality_checks", "dataset_scores", "preview_rows")
    before = {t: sorted(map(str, store.read(t).collect())) for t in tables}
    reader = store.read("columns")  # opened before, read after
    run = store.compact(datetime(2026, 1, 3, tzinfo=timezone.utc))
    assert {t: sorted(map(str, store.read(t).collect())) for t in tables} == before
    assert sorted(map(str, reader.collect())) == before["columns"]
    store.vacuum(keep=1)
    assert {t: sorted(map(str, store.read(t).collect())) for t in tables} == before
    assert all(store._folders(t) == [run] for t in tables) and len(store._versions()) == 1


def test_readers_open_one_version_and_its_runs(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path))
    ids = lambda *x: spark.createDataFrame([(i, f"v{len(x)}") for i in x], "dataset_id string, name string")
    for k in range(8):
        run = f"run-{k}"
        rows = ids("a", "b") if k % 2 else ids("a")
        store.write("datasets", rows, run)
        store.publish(run, rows, NOW.replace(day=1 + k), ("datasets",))
    store.write("datasets", ids("z"), "run-unpublished")
    store.publish("run-3", ids("a", "b"), NOW.replace(day=2), ("datasets",))  # older than what is there
    read = store.read("datasets")
    assert sorted(map(tuple, read.collect())) == [("a", "v2"), ("b", "v2")]
    assert {f.split("run_id=")[1].split("/")[0] for f in read.inputFiles() if "run_id=" in f} == {"run-7"}
    versions = [f for f in read.inputFiles() if "/state/" in f]
    assert len({f.split("version=")[1].split("/")[0] for f in versions}) == 1
    # a version that was not finished is not seen
    (tmp_path / "state" / f"version={99:012d}").mkdir()
    assert store.read("datasets").count() == 2
    with pytest.raises(ValueError):
        store.publish("007", ids("a"), NOW)


def test_pages_by_cursor_equal_pages_by_offset(spark):
    rows = [(f"d{i:02d}", None if i % 4 == 0 else float(i % 5), NOW.replace(day=1 + i % 9), f"n{i % 7}", i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "dataset_id string, quality_score double, uploaded_at timestamp, name string, row_count int")
    for sort in ("quality_score", "-quality_score", "uploaded_at", "-uploaded_at", "-name", "row_count"):
        whole = [r.dataset_id for r in cat.sorted_catalog(df, sort).collect()]
        got, after = [], None
        while True:
            page = cat.sorted_catalog(cat.beyond(df, sort, after), sort).limit(7).collect()
            if not page:
                break
            got += [r.dataset_id for r in page]
            after = cat.cursor_of(page[-1], sort)
        assert got == whole
    page = cat.sorted_catalog(cat.beyond(df, "-name", ("n3", "d10")), "-name").limit(7)
    assert "TakeOrderedAndProject(limit=7" in page._jdf.queryExecution().executedPlan().toString()


def test_logged_changes_are_published(spark, store):
    four = ids_of(store)["four.CSV"]
    at = datetime(2026, 1, 4, tzinfo=timezone.utc)
    schema = "dataset_id string, position int, category string, sensitivity string, requested_at timestamp"
    store.append("tag_overrides", spark.createDataFrame([(four, 2, "ID_NUMBER", None, at), (four, 0, "BAD", None, at)], schema))
    others = sorted(map(str, store.read("tags").filter(f"dataset_id <> '{four}'").collect()))
    store.apply_logged_overrides(at)
    tags = {r["position"]: r for r in store.read("tags").filter(f"dataset_id = '{four}'").collect()}
    assert (tags[2]["category"], tags[2]["sensitivity"], tags[2]["overridden"]) == ("ID_NUMBER", "HIGH", True)
    assert (tags[0]["category"], tags[0]["overridden"]) == ("EMAIL", False)
    assert sorted(map(str, store.read("tags").filter(f"dataset_id <> '{four}'").collect())) == others
    entries = [("sensitivity", Settings().with_overrides({"sensitivity": {**Settings().sensitivity, "EMAIL": "LOW"}}).as_json()["sensitivity"], at),
               ("freq_cap", "0", at), ("trust", "not json", at)]
    store.append("settings_log", spark.createDataFrame(entries, "key string, json_value string, updated_at timestamp"))
    assert store.settings().freq_cap == Settings().freq_cap and store.settings().sensitivity["EMAIL"] == "LOW"
    store.rescore(datetime(2026, 1, 5, tzinfo=timezone.utc))
    tags = {r["position"]: r["sensitivity"] for r in store.read("tags").filter(f"dataset_id = '{four}'").collect()}
    assert (tags[0], tags[2]) == ("LOW", "HIGH")


def test_deletes(spark, store, folder):
    later = datetime(2026, 1, 10, tzinfo=timezone.utc)
    store.delete_named(["collide.csv", "unknown"], later)
    assert store.read("datasets").count() == 10
    assert store.read("columns").select("dataset_id").distinct().count() == 8
    store.delete_one(ids_of(store)["four.CSV"], later)
    assert store.access_events().count() == 0 and store.score_snapshots().count() == 7
    store.delete_all(later)
    assert store.read("datasets").count() == 0 and store.read("tags").count() == 0
    # A later ingest of the same files brings them back, without their old events.
    ingest_csv(spark, folder, store, datetime(2026, 2, 1, tzinfo=timezone.utc))
    assert store.read("datasets").count() == 11 and store.access_events().count() == 0


def test_shared_folder_of_the_session(spark):
    from datawarden.session import new_run_dir, shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_run_dir(spark, "x") != new_run_dir(spark, "x")
