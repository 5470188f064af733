"""Access-log operators: scoring windows, daily series, roll-ups.

Each is one grouped pass with conditional counts. A dataset with a third of all events costs
nothing special: its rows collapse in the partial aggregate before the shuffle.

Events may carry a weight `n`: a row then stands for n events of one day, the last of them at its
`occurred_at`. A log that is rolled up by day answers the same questions as the log itself, as
long as the days in which a window begins or ends come event by event (`edge_days`).
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datawarden.config import ACCESS_TYPES, Settings
from datawarden.functions import scalars as s
from datawarden.operators.score import value_from_windows

_AT = "CAST(occurred_at AS TIMESTAMP)"


def _grouped(df: DataFrame, keys: list[str], aggregates: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(a) for a in aggregates])


def of_type(events: DataFrame, access_type: str | None) -> DataFrame:
    if access_type is None:
        return events
    if access_type not in ACCESS_TYPES:
        raise ValueError(f"access type must be one of {ACCESS_TYPES}")
    return events.filter(f"access_type = '{access_type}'")


def _total(events: DataFrame, condition: str = "true") -> str:
    """The number of events that meet a condition."""
    if "n" not in events.columns:
        return f"count_if({condition})"
    return f"coalesce(sum(CASE WHEN {condition} THEN n END), 0L)"


def _within(events: DataFrame, now: datetime | str, newer: int, older: int) -> str:
    return _total(events, f"{_AT} <= {s.days_before(now, newer)} AND {_AT} > {s.days_before(now, older)}")


def edge_days(now: datetime | str) -> list[date]:
    """The UTC days in which a scoring window begins or ends, in order."""
    at = s.micros(now) // s.DAY_MICROS
    return sorted({date(1970, 1, 1) + timedelta(days=at - back) for back in (0, 30, 60, 90)})


def daily_rollup(events: DataFrame, *keys: str) -> DataFrame:
    """Events per dataset, type and UTC day (and other `keys`): their number, first and last."""
    dated = events.withColumn("date", F.expr(s.utc_day("occurred_at")))
    return _grouped(
        dated,
        ["dataset_id", "access_type", "date", *keys],
        [f"{_total(events)} AS n", f"min({_AT}) AS first_at", f"max({_AT}) AS last_at"],
    )


def access_windows(events: DataFrame, now: datetime | str) -> DataFrame:
    """Per dataset the three scoring windows and the days since the last access.

    Windows are half open: (now - 90d, now], (now - 30d, now], (now - 60d, now - 30d]. The last
    access is taken over all events, later ones than `now` included; its age is never negative.
    """
    grouped = _grouped(
        events,
        ["dataset_id"],
        [
            f"{_within(events, now, 0, 90)} AS accesses_90d",
            f"{_within(events, now, 0, 30)} AS accesses_last30",
            f"{_within(events, now, 30, 60)} AS accesses_prev30",
            f"max({_AT}) AS last_accessed_at",
        ],
    )
    return grouped.selectExpr("*", f"{_age(now)} AS days_since_last_access")


def windows_for(datasets: DataFrame, events: DataFrame, now: datetime | str) -> DataFrame:
    """Access windows of every dataset; one without events has zero counts and no last access."""
    counts = ("accesses_90d", "accesses_last30", "accesses_prev30")
    found = datasets.select("dataset_id").join(access_windows(events, now), "dataset_id", "left")
    return found.selectExpr(
        "dataset_id", *[f"coalesce({c}, 0L) AS {c}" for c in counts], "last_accessed_at"
    ).selectExpr("*", f"{_age(now)} AS days_since_last_access")


def _age(now: datetime | str, last: str = "last_accessed_at") -> str:
    age = f"({s.micros(now)}L - unix_micros({last})) / {s.double(s.DAY_MICROS)}"
    return f"CASE WHEN {last} IS NOT NULL THEN greatest(0D, {age}) END"


def windows_at(datasets: DataFrame, events: DataFrame, instants: list[datetime | str]) -> DataFrame:
    """The access windows of every dataset as they were at each instant (captured_at), in one pass.

    The last access is the last one up to the instant: what came later could not be known.
    """
    facts = []
    for i, at in enumerate(instants):
        for c, newer, older in (("accesses_90d", 0, 90), ("accesses_last30", 0, 30), ("accesses_prev30", 30, 60)):
            facts.append(f"{_within(events, at, newer, older)} AS {c}_{i}")
        facts.append(f"max(CASE WHEN {_AT} <= {s.instant(at)} THEN {_AT} END) AS last_accessed_at_{i}")
    grouped = _grouped(events, ["dataset_id"], facts)
    rows = ", ".join(
        f"struct({s.instant(at)} AS captured_at, coalesce(accesses_90d_{i}, 0L) AS accesses_90d, "
        f"coalesce(accesses_last30_{i}, 0L) AS accesses_last30, "
        f"coalesce(accesses_prev30_{i}, 0L) AS accesses_prev30, last_accessed_at_{i} AS last_accessed_at, "
        f"{_age(at, f'last_accessed_at_{i}')} AS days_since_last_access)"
        for i, at in enumerate(instants)
    )
    return datasets.select("dataset_id").join(grouped, "dataset_id", "left").selectExpr(
        "dataset_id", f"inline(array({rows}))"
    )


def value_scores(
    datasets: DataFrame,
    events: DataFrame,
    now: datetime | str,
    settings: Settings = Settings(),
) -> DataFrame:
    return value_from_windows(windows_for(datasets, events, now), settings)


def _check_days(days: int) -> None:
    if not 1 <= days <= 365:
        raise ValueError("days must lie in 1..365")


def daily_usage(
    datasets: DataFrame,
    events: DataFrame,
    now: datetime | str,
    days: int = 90,
    access_type: str | None = None,
) -> DataFrame:
    """Exactly `days` zero-filled UTC-day buckets per dataset, the last one being today.

    The calendar is generated per dataset row (1 to 365 entries), not joined in. The log is cut to
    the days by two literal instants, and by its day or month folders where it has them.
    """
    _check_days(days)
    today = s.utc_day(s.instant(now))
    first = f"date_sub({today}, {days - 1})"
    start = s.micros(now) // s.DAY_MICROS - (days - 1)
    events = events.filter(
        f"{_AT} >= timestamp_micros({start * s.DAY_MICROS}L) "
        f"AND {_AT} < timestamp_micros({(start + days) * s.DAY_MICROS}L)"
    )
    if "event_date" in events.columns:
        low, high = (date(1970, 1, 1) + timedelta(days=start + d) for d in (0, days - 1))
        events = events.filter(f"event_date >= DATE'{low.replace(day=1)}' AND event_date <= DATE'{high}'")
    counts = [f"{_total(events, f"access_type = '{t}'")} AS {t.lower()}" for t in ACCESS_TYPES]
    weight = ["n"] if "n" in events.columns else []
    dated = of_type(events, access_type).selectExpr(
        "dataset_id", "access_type", *weight, f"{s.utc_day('occurred_at')} AS date"
    )
    counted = _grouped(
        dated.filter(f"date BETWEEN {first} AND {today}"), ["dataset_id", "date"], counts
    )
    calendar = datasets.selectExpr("dataset_id", f"explode(sequence({first}, {today})) AS date")
    filled = [f"coalesce({t.lower()}, 0L)" for t in ACCESS_TYPES]
    return calendar.join(counted, ["dataset_id", "date"], "left").selectExpr(
        "dataset_id",
        "date",
        f"{' + '.join(filled)} AS total",
        *[f"{x} AS {t.lower()}" for x, t in zip(filled, ACCESS_TYPES, strict=True)],
    )


def usage_summary(
    datasets: DataFrame,
    events: DataFrame,
    now: datetime | str,
    days: int = 90,
    access_type: str | None = None,
) -> DataFrame:
    """The fixed 90/30/previous-30 windows, whatever `days`; `from_date` is the day before the
    first bucket of the series."""
    _check_days(days)
    today = s.utc_day(s.instant(now))
    return windows_for(datasets, of_type(events, access_type), now).selectExpr(
        "dataset_id",
        f"date_sub({today}, {days}) AS from_date",
        f"{today} AS to_date",
        "accesses_90d",
        "accesses_last30",
        "accesses_prev30",
        "last_accessed_at",
    )


def access_rollup(events: DataFrame, now: datetime | str) -> DataFrame:
    """All-time count, last access and the list's 90-day count, which has no upper bound."""
    return _grouped(
        events,
        ["dataset_id"],
        [
            f"{_total(events)} AS access_count",
            f"{_total(events, f'{_AT} >= {s.days_before(now, 90)}')} AS access_count_90d",
            f"max({_AT}) AS last_accessed_at",
        ],
    )
