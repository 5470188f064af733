import pytest
from helpers import column_cases, table_case

from datawarden.functions import scalars as s
from datawarden.operators import profile as pf
from datawarden.operators.quality import column_findings, quality_checks


def column_checks(spark, cases):
    freq, headers, _ = column_cases(spark, cases)
    out = {}
    for r in column_findings(pf.column_profile(freq, headers)).collect():
        out.setdefault(r["dataset_id"], {})[r["check_type"]] = r
    return out


def missing(present, total):
    return [str(i) if i < present else None for i in range(total)]


def test_column_checks(spark):
    got = column_checks(
        spark,
        {
            "60": missing(4, 10), "30": missing(7, 10), "10": missing(9, 10), "empty": [None, None],
            "nine": ["1", "2", "3", "4", "5", "6", "7", "8", "9", "x"], "mixed": ["1", "x", "2"],
            "clean": ["1", "2", "3"],
        },
    )
    assert [got[k]["MISSING_VALUES"]["severity"] for k in ("60", "30", "10")] == [
        "ERROR", "WARNING", "INFO",
    ]
    m = got["30"]["MISSING_VALUES"]
    assert (m["affected_count"], m["affected_pct"], m["column_name"]) == (3, pytest.approx(0.3), "c")
    assert m["detail"] == '3 missing value(s) (30.0%) in "c".'
    assert set(got["empty"]) == {"EMPTY_COLUMN"}
    assert got["empty"]["EMPTY_COLUMN"]["detail"] == 'Column "c" is entirely empty.'
    inv = got["nine"]["INVALID_VALUES"]
    assert (inv["severity"], inv["affected_count"]) == ("WARNING", 1)
    assert got["nine"]["TYPE_MISMATCH"]["severity"] == "INFO"
    assert set(got["mixed"]) == {"TYPE_MISMATCH", "INVALID_VALUES"}
    assert got["mixed"]["INVALID_VALUES"]["affected_count"] == 1
    assert got["mixed"]["TYPE_MISMATCH"]["detail"] == 'Mixed types in "c"; dominant type covers 67%.'
    assert "clean" not in got


def checks_of(spark, names, rows):
    freq, counts, headers = table_case(spark, names, rows)
    profile = pf.column_profile(freq, headers)
    found = quality_checks(profile, pf.dataset_profile(counts, headers)).collect()
    return {r["check_type"]: r for r in found}


def test_dataset_checks(spark):
    got = checks_of(spark, ["id", "name", "name"], [["1", "a", "b"], ["1", "a", "b"]])
    dup = got["DUPLICATE_ROWS"]
    assert (dup["severity"], dup["position"], dup["affected_count"]) == ("WARNING", None, 1)
    assert dup["affected_pct"] == 0.5
    head = got["DUPLICATE_HEADER"]
    assert (head["severity"], head["affected_count"]) == ("ERROR", 2)
    assert checks_of(spark, ["a", "b"], [["1", "x"], ["2", "y"], ["3", "z"]]) == {}


def test_one_decimal_is_rounded_exactly(spark):
    # 12.35 is stored slightly below, 0.25 and 6.75 are exact ties.
    values = [0.0, 0.04, 0.05, 0.25, 6.75, 12.35, 12.45, 33.333, 99.95, 100.0, 2.675, 0.15, 1.005]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.selectExpr(s.fixed_1("x")).collect()]
    from decimal import ROUND_HALF_UP, Decimal

    assert got == [str(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_UP)) for v in values]
