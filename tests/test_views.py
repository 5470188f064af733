from helpers import column_cases

from datawarden.operators.views import (
    missing_severity, numeric_histogram, score_band, score_tier, shares, type_distribution,
)


def test_histogram(spark):
    freq, _, _ = column_cases(
        spark, {"a": ["1", "2", "2", "7", "x", "1e400"], "same": ["5", "5.0"], "one": ["3"], "none": ["a"]}
    )
    got = {}
    for r in numeric_histogram(freq).orderBy("bin").collect():
        got.setdefault(r["dataset_id"], []).append((r["bin"], r["bin_from"], r["n"]))
    assert got["a"] == [(0, 1.0, 1), (1, 2.0, 2), (2, 3.0, 0), (3, 4.0, 0), (4, 5.0, 0), (5, 6.0, 1)]
    assert got["same"] == [(0, 5.0, 2)]
    assert set(got) == {"a", "same"}


def test_bands_and_tiers(spark):
    df = spark.sql("SELECT * FROM VALUES (0D),(25D),(50D),(60D),(75D),(80D),(90D),(NULL) AS v(x)")
    got = [tuple(r) for r in df.selectExpr(score_band("x"), score_tier("x")).collect()]
    assert got == [(0, "Poor"), (1, "Poor"), (2, "Poor"), (2, "Fair"), (3, "Fair"), (3, "Good"),
                   (4, "Good"), (None, None)]


def test_shares(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1)], "k string, n bigint")
    assert [r["share"] for r in shares(df).orderBy("k").collect()] == [0.75, 0.25]
    zero = spark.createDataFrame([("a", 0)], "k string, n bigint")
    assert shares(zero).first()["share"] == 0


def test_type_distribution_and_missing_severity(spark):
    p = spark.createDataFrame(
        [("d", 0, "a", "STRING", 0.6), ("d", 1, "b", "STRING", 0.0), ("d", 2, "c", "DATE", 0.1)],
        "dataset_id string, position int, name string, data_type string, missing_pct double",
    )
    assert [tuple(r) for r in type_distribution(p).collect()] == [("STRING", 2), ("DATE", 1)]
    checks = spark.createDataFrame(
        [("d", 0, "MISSING_VALUES", "ERROR"), ("d", 2, "TYPE_MISMATCH", "INFO")],
        "dataset_id string, position int, check_type string, severity string",
    )
    got = {r["name"]: r["severity"] for r in missing_severity(p, checks).collect()}
    assert got == {"a": "ERROR", "b": None, "c": None}
