"""Scalar expressions shared by the operators, as Spark SQL text.

Operators pass them to ``selectExpr`` and ``expr``: one call to the JVM per expression, however
deep it is. Arguments are SQL text too; every function brackets its own result.
"""

from __future__ import annotations

from datetime import datetime, timezone

from datawarden.config import SAMPLE_CHARS

# Fixed value: the characters a browser-side trim removes and its \s class matches.
WHITESPACE = (
    "\t\n\u000b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

DAY_MICROS = 86_400_000_000


def text(value: str | None) -> str:
    """A string literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def double(value: float) -> str:
    return f"{float(value)!r}D"


def name(column: str) -> str:
    """A column name of the data, quoted."""
    return "`" + column.replace("`", "``") + "`"


def one_of(x: str, values: tuple[str, ...] | list[str]) -> str:
    """True or false, never null."""
    return f"coalesce({x} IN ({', '.join(text(v) for v in values)}), false)"


def matches(x: str, pattern: str) -> str:
    return f"rlike({x}, r'{pattern}')"


def _printable(x: str) -> str:
    """The first character is a visible ASCII one, which settles most cells without a scan."""
    return f"ascii({x}) BETWEEN 33 AND 126"


def trimmed(x: str) -> str:
    return (
        f"CASE WHEN {_printable(x)} AND {_printable(f'right({x}, 1)')} THEN {x} "
        f"ELSE btrim({x}, {text(WHITESPACE)}) END"
    )


def cell(x: str) -> str:
    """A cell as the profiler groups it: null if blank, else its whole text."""
    return (
        f"CASE WHEN NOT ({_printable(x)}) AND btrim({x}, {text(WHITESPACE)}) = '' THEN NULL "
        f"ELSE {x} END"
    )


def unit(x: str) -> str:
    """Clamp to [0, 1]; NaN and null become 0."""
    return f"greatest(0D, least(1D, nanvl(coalesce(CAST({x} AS DOUBLE), 0D), 0D)))"


def half_up(x: str, digits: int = 0) -> str:
    """Round half up on the binary value, so 2.5 -> 3 and -2.5 -> -2."""
    if digits == 0:
        return f"floor(({x}) + 0.5D)"
    scale = double(10**digits)
    return f"(floor(({x}) * {scale} + 0.5D) / {scale})"


def fixed_1(x: str) -> str:
    """Text with one decimal for a non-negative double, correctly rounded from its exact value.

    10*x is rounded when computed. Where that lands on a tie, the rounding error of the
    product (an exact split multiplication) tells on which side the true value lies.
    """
    high = f"({x} * 134217729D - ({x} * 134217729D - {x}))"  # 2^27 + 1
    product = f"({x} * 10D)"
    error = f"(({high} * 10D - {product}) + ({x} - {high}) * 10D)"
    part = f"({product} - floor({product}))"
    up = f"(CASE WHEN {part} > 0.5D OR ({part} = 0.5D AND {error} >= 0D) THEN 1 ELSE 0 END)"
    tenths = f"CAST(floor({product}) + {up} AS BIGINT)"
    return f"concat({tenths} DIV 10, '.', {tenths} % 10)"


def shorten(x: str, limit: int = SAMPLE_CHARS) -> str:
    """At most `limit` characters; the last one is an ellipsis where text was cut."""
    return (
        f"CASE WHEN length({x}) > {limit} THEN concat(substring({x}, 1, {limit - 1}), '…') "
        f"ELSE {x} END"
    )


def instant(at: datetime | str) -> str:
    """A literal point in time. Text and naive datetimes are read as UTC."""
    return f"timestamp_micros({micros(at)}L)"


def micros(at: datetime | str) -> int:
    if isinstance(at, str):
        at = datetime.fromisoformat(at.replace("Z", "+00:00"))
    if at.tzinfo is None:
        at = at.replace(tzinfo=timezone.utc)
    delta = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def days_before(at: datetime | str, days: int) -> str:
    return f"timestamp_micros({micros(at) - days * DAY_MICROS}L)"


def utc_day(x: str) -> str:
    """The UTC calendar day, whatever the session time zone is."""
    return (
        f"date_add(DATE'1970-01-01', "
        f"CAST(floor(unix_micros(CAST({x} AS TIMESTAMP)) / {DAY_MICROS}L) AS INT))"
    )


def looked_up(x: str, table: dict[str, str]) -> str:
    """The value of a small fixed table, null for an unknown key."""
    entries = ", ".join(f"{text(k)}, {text(v)}" for k, v in table.items())
    return f"try_element_at(map({entries}), {x})"


def sensitivity_rank(x: str) -> str:
    return f"CASE {x} WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
