import pytest
from helpers import column_cases, profiles, table_case
from pyspark.sql import functions as F

from datawarden.operators import profile as pf
from datawarden.operators import sketch as sk
from datawarden.operators import views


def test_type_table(spark):
    cases = {
        "INTEGER": ["1", "2", "3"],
        "FLOAT": ["1.5", "2.0"],
        "BOOLEAN": ["true", "false"],
        "DATE": ["2024-01-01"],
        "DATETIME": ["2024-01-01T10:00:00Z"],
        "STRING": ["ada@x.io", "bob"],
        "UNKNOWN": [None, None],
        "mixed": ["1", "x", "2"],
        "hex": ["0x10", "0xFF", "0x20"],
        "suffix": ["1d", "2f", "NaN"],
        "bad_date": ["2024-02-30", "2024-13-01"],
        "yes_no": ["Yes", "no", "YES"],
        "zero_one": ["0", "1", "1"],
        "huge": ["1e400", "2e400"],
    }
    got = {k: r["data_type"] for k, r in profiles(spark, cases).items()}
    expected = {k: k for k in cases if k.isupper()}
    assert got == expected | {
        "mixed": "STRING", "hex": "STRING", "suffix": "STRING", "bad_date": "STRING",
        "yes_no": "BOOLEAN", "zero_one": "INTEGER", "huge": "STRING",
    }


def test_shares_validity_and_samples(spark):
    cases = {
        "mixed": ["1", "x", "2"],
        "messy": ["1", "2", "3", "x", "y"],
        "cleaner": ["1", "2", "3", "4", "x"],
        "words": ["alice", "bob", "carol"],
        "nine": ["1", "2", "3", "4", "5", "6", "7", "8", "9", "x"],
        "missing": ["a", "b", None, "", "a"],
        "empty": [None, "", None],
        "blank": ["  ", "\t", "a"],
        "many": [str(i) for i in range(30)],
        "long": ["z" * 5000],
        "order": ["m", "b", "m", "a"],
    }
    p = profiles(spark, cases)
    assert p["mixed"]["dominant_type_share"] == pytest.approx(2 / 3)
    assert p["mixed"]["validity"] == pytest.approx(2 / 3)
    assert (p["messy"]["data_type"], p["cleaner"]["data_type"]) == ("STRING", "INTEGER")
    assert p["messy"]["validity"] < p["cleaner"]["validity"]
    assert (p["words"]["data_type"], p["words"]["validity"]) == ("STRING", 1.0)
    assert (p["nine"]["data_type"], p["nine"]["validity"]) == ("INTEGER", pytest.approx(0.9))
    m = p["missing"]
    assert (m["missing_count"], m["distinct_count"], m["sample_values"]) == (2, 2, ["a", "b"])
    assert (m["completeness"], m["missing_pct"]) == (pytest.approx(0.6), pytest.approx(0.4))
    e = p["empty"]
    assert (e["data_type"], e["completeness"], e["validity"]) == ("UNKNOWN", 0.0, 1.0)
    assert (e["distinct_count"], e["sample_values"], e["missing_pct"]) == (0, [], 1.0)
    assert p["blank"]["missing_count"] == 2
    assert len(p["many"]["sample_values"]) == 10
    assert p["many"]["sample_values"] == [str(i) for i in range(10)]
    long = p["long"]["sample_values"][0]
    assert len(long) == 256 and long.endswith("…")
    assert p["order"]["sample_values"] == ["m", "b", "a"]


def test_dataset_profile(spark):
    rows = [["ada@x.io", "Ada", "L"], ["grace@x.io", "Grace", "H"], ["ada@x.io", "Ada", "L"]]
    _, counts, headers = table_case(spark, ["email", "name", " NAME "], rows)
    p = pf.dataset_profile(counts, headers).first()
    assert (p["row_count"], p["duplicate_row_count"], p["column_count"]) == (3, 1, 3)
    assert p["structural_issues"] == ["DUPLICATE_HEADER"] and p["repeated_headers"] == 2
    _, counts, headers = table_case(spark, ["a", "", "c"], [["1", "2", "3"]])
    assert pf.dataset_profile(counts, headers).first()["structural_issues"] == ["BLANK_HEADER"]


def test_row_digest_tells_rows_apart(spark):
    rows = [("t", "a", None), ("t", None, "a"), ("t", "a", ""), ("t", "1:a", None), ("t", "a", None),
            ("t", "a1:", "b"), ("t", "a", "1:b")]
    df = spark.createDataFrame(rows, "dataset_id string, x string, y string")
    r = pf.row_counts(df, ["x", "y"]).first()
    assert (r["row_count"], r["duplicate_row_count"]) == (7, 1)
    exact = df.groupBy("x", "y").count().selectExpr("sum(count - 1)").first()[0]
    assert exact == 1


def test_empty_dataset_keeps_its_columns(spark):
    freq, headers, rows = column_cases(spark, {"full": ["1"], "none": []})
    p = {r["dataset_id"]: r for r in pf.column_profile(freq, headers).collect()}
    assert p["none"]["data_type"] == "UNKNOWN" and p["none"]["row_count"] == 0


def test_partitioning_does_not_matter(spark):
    rows = [("d", i, str(i % 7), "x" if i % 3 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "dataset_id string, ord int, a string, b string")
    out = []
    for parts in (1, 16):
        freq = pf.value_freq(pf.text_cells(df.repartition(parts), ["a", "b"], ordinal="ord"))
        ids = spark.createDataFrame([("d",)], "dataset_id string")
        full = pf.with_samples(
            pf.column_profile(freq, pf.headers_of(ids, ["a", "b"])), pf.sample_values(freq)
        )
        out.append(sorted(map(tuple, full.collect()), key=repr))
    assert out[0] == out[1]


def test_wide_tables_are_unpivoted_in_groups(spark):
    names = [f"c{i}" for i in range(450)]
    df = spark.range(20).selectExpr("'w' AS dataset_id", *[f"CAST(id % 5 AS STRING) AS {n}" for n in names])
    counts = pf.column_counts(pf.value_freq(pf.text_cells(df, names)))
    assert counts.count() == 450
    assert counts.selectExpr("min(distinct_count)", "max(distinct_count)").first() == (5, 5)


def test_typed_profile(spark):
    df = spark.sql(
        """SELECT 't' AS dataset_id, * FROM VALUES
        (1, 1.5D, true, DATE'2024-01-01', 'a', array(1, 2)),
        (2, double('NaN'), true, NULL, ' ', array(1, 2)),
        (2, -0.0D, false, DATE'2024-01-01', 'b', NULL),
        (3, 0.0D, NULL, NULL, 'b', array(2)) AS v(i, f, b, d, s, l)"""
    )
    p = {r["name"]: r for r in pf.typed_column_profile(df, list("ifbdsl")).collect()}
    assert [p[c]["data_type"] for c in "ifbdsl"] == [
        "INTEGER", "FLOAT", "BOOLEAN", "DATE", "STRING", "STRING",
    ]
    assert [p[c]["distinct_count"] for c in "ifbdsl"] == [3, 3, 2, 1, 2, 2]
    assert p["f"]["validity"] == 0.75 and p["s"]["missing_count"] == 1


def test_typed_profile_reads_once(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("dataset_id", F.lit("o"))
    profile = pf.typed_column_profile(df, [c for c in df.columns if c != "dataset_id"])
    plan = profile._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2


def test_duplicates_in_two_levels(spark, monkeypatch):
    rows = [("ab"[i % 2], str(i % 50), None if i % 3 else "x") for i in range(400)] + [("c", "1", "2"), ("d", "1,", ""), ("d", "1", ",")]
    df = spark.createDataFrame(rows, "dataset_id string, a string, b string")
    want = sorted(map(tuple, pf.row_counts(df, ["a", "b"]).collect()))
    assert sorted(map(tuple, pf.two_level_row_counts(df, ["a", "b"]).collect())) == want
    monkeypatch.setattr(pf, "BROADCAST_HASHES", 3)
    assert sorted(map(tuple, pf.two_level_row_counts(df, ["a", "b"]).collect())) == want
    assert pf.two_level_row_counts(df.limit(0), ["a", "b"]).collect() == []


def test_sketches_merge_to_the_whole(spark):
    rows = [("ab"[i % 5 == 0], i, str(i % 700), None if i % 3 else "7.5", "x") for i in range(5000)]
    df = spark.createDataFrame(rows, "dataset_id string, i int, a string, b string, c string")
    cells = lambda where: pf.text_cells(df.filter(where), ["a", "b", "c"])
    parts = pf.union_all([sk.column_sketches(cells(f"i % 4 = {k}")) for k in range(4)])
    nested = sk.merge_sketches(sk.merge_sketches(parts.filter("position < 2")).unionByName(parts.filter("position = 2")))
    whole = sorted(map(str, sk.sketched_counts(sk.column_sketches(cells("true"))).collect()))
    assert sorted(map(str, sk.sketched_counts(sk.merge_sketches(parts)).collect())) == whole
    assert sorted(map(str, sk.sketched_counts(nested).collect())) == whole
    exact = {(r.dataset_id, r.position): r for r in pf.column_counts(pf.value_freq(cells("true"))).collect()}
    for r in sk.sketched_counts(sk.merge_sketches(parts)).collect():
        want = exact[r.dataset_id, r.position]
        assert abs(r.distinct_count - want.distinct_count) <= sk.ERROR_BOUND * want.distinct_count
        assert (r.row_count, r.non_null_count, r.m_INTEGER, r.m_STRING) == (
            want.row_count, want.non_null_count, want.m_INTEGER, want.m_STRING)
    # nothing but one row a column and task is shuffled
    plan = sk.column_sketches(cells("true"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_hll_sketch_agg" in plan
    headers = pf.headers_of(spark.createDataFrame([("a",), ("b",)], "dataset_id string"), ["a", "b", "c", "d"])
    profile = {(r.dataset_id, r.name): r.data_type for r in sk.sketched_profile(parts, headers).collect()}
    assert profile["a", "a"] == "INTEGER" and profile["b", "b"] == "FLOAT" and profile["a", "d"] == "UNKNOWN"


def test_histogram_does_not_meet_values_by_column(spark):
    rows = [("d", str(i)) for i in range(6000)] + [("e", "5"), ("e", "5"), ("f", "1"), ("g", "x")]
    freq = pf.value_freq(pf.text_cells(spark.createDataFrame(rows, "dataset_id string, a string"), ["a"]))
    got = views.numeric_histogram(freq)
    assert sorted((r.dataset_id, r.bin, r.n) for r in got.collect()) == [("d", b, 1000) for b in range(6)] + [("e", 0, 2)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "bin_from" not in line]
    assert any("salt" in line for line in joins)


def test_counts_and_samples_share_one_shuffle(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_orderstatus AS dataset_id", "o_orderpriority AS a", "CAST(o_custkey AS STRING) AS b"
    )
    freq = pf.value_freq(pf.text_cells(df, ["a", "b"]))
    both = pf.with_samples(pf.type_columns(pf.column_counts(freq)), pf.sample_values(freq))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # One scan, the value shuffle reused, the ranking cut before its shuffle.
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan
    assert plan.count("WindowGroupLimit") == 2


def test_preview_rows(spark):
    rows = [("d", i, "v" * 300, str(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "dataset_id string, ord int, a string, b string")
    got = pf.preview_rows(df, ["a", "b"], "ord", names=["x", "x"]).orderBy("row_number").collect()
    assert [r["row_number"] for r in got] == list(range(1, 51))
    assert [c["value"] for c in got[7]["cells"]] == ["v" * 255 + "…", "7"]
    assert [c["position"] for c in got[0]["cells"]] == [0, 1]


def test_long_cells_are_told_apart_whole(spark):
    base = "word " * 400
    cases = {
        "tails": [base + "a", base + "b", base + "a", "short"],
        "digits": ["7" * 1500, "-" + "8" * 1500],
        "blank": [" " * 2000, "x"],
    }
    p = profiles(spark, cases)
    assert p["tails"]["distinct_count"] == 3 and p["tails"]["data_type"] == "STRING"
    assert p["tails"]["sample_values"][0] == base[:255] + "…"
    assert p["digits"]["data_type"] == "INTEGER" and p["blank"]["missing_count"] == 1
