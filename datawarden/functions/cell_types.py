"""Atomic type tests on the text of one cell, as Spark SQL text."""

from __future__ import annotations

from datawarden.functions.scalars import matches, one_of

# The accepted spellings per type, in tie-break order.
INTEGER_PATTERN = r"^-?[0-9]+$"
FLOAT_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
BOOLEAN_WORDS = ("true", "false", "0", "1", "yes", "no")
DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DATETIME_PATTERN = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?"
    r"(Z|[+-][0-9]{2}:[0-9]{2})?$"
)
TYPE_ORDER = ("INTEGER", "FLOAT", "BOOLEAN", "DATE", "DATETIME", "STRING")


def number(x: str) -> str:
    """The finite number a cell spells, else null. Hex literals and type suffixes are no numbers."""
    return (
        f"CASE WHEN {matches(x, FLOAT_PATTERN)} "
        f"AND abs(try_cast({x} AS DOUBLE)) < double('Infinity') THEN try_cast({x} AS DOUBLE) END"
    )


def type_tests(x: str) -> dict[str, str]:
    """One boolean per type but STRING, which is what no other test takes.

    Tests overlap: 1 is INTEGER, FLOAT and BOOLEAN.
    """
    return {
        "INTEGER": matches(x, INTEGER_PATTERN),
        "FLOAT": f"({number(x)}) IS NOT NULL",
        "BOOLEAN": one_of(f"lower({x})", BOOLEAN_WORDS),
        "DATE": f"{matches(x, DATE_PATTERN)} AND try_cast({x} AS DATE) IS NOT NULL",
        "DATETIME": f"{matches(x, DATETIME_PATTERN)} AND try_cast({x} AS TIMESTAMP) IS NOT NULL",
    }
