import json
from datetime import datetime

from datawarden.config import Settings
from datawarden.operators.maintenance import effective_settings, load_settings

SCHEMA = "key string, json_value string, updated_at timestamp"
T = lambda n: datetime(2026, 1, n)


def log(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_defaults(spark):
    rows = effective_settings(log(spark)).collect()
    assert {r["key"]: r["value"] for r in rows} == Settings().as_json()
    assert not any(r["overridden"] for r in rows) and len(rows) == 8
    assert load_settings(log(spark)) == Settings()


def test_keys_are_replaced_whole_and_the_last_wins(spark):
    weights = {"completeness": 0.5, "validity": 0.25, "uniqueness": 0.25}
    changes = log(
        spark, ("quality", json.dumps(Settings().quality), T(1)), ("quality", json.dumps(weights), T(2)),
        ("freq_cap", "5", T(1)), ("freq_cap", None, T(3)), ("bogus", "1", T(1)),
    )
    s = load_settings(changes)
    assert s.quality == weights and s.freq_cap == 50 and s.trust == Settings().trust
    assert [r["key"] for r in effective_settings(changes).filter("overridden").collect()] == ["quality"]


def test_reset_drops_earlier_overrides(spark):
    changes = log(spark, ("freq_cap", "5", T(1)), ("*", None, T(2)), ("half_life_days", "7", T(3)))
    s = load_settings(changes)
    assert (s.freq_cap, s.half_life_days) == (50, 7)
    assert load_settings(log(spark, ("freq_cap", "5", T(1)), ("*", None, T(2)), ("*", None, T(3)))) == Settings()
