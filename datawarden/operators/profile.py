"""Column and dataset profiles.

Everything is keyed by ``dataset_id``, so many datasets of one shape are profiled in one job.

    table --inline--> cells(dataset_id, position, value[, ord])
          --groupBy(dataset_id, position, value)--> value_freq(n[, first_ord])
          --groupBy(dataset_id, position)--> counts
          --row_number <= k--> samples

A row becomes an array of (position, value) and is inlined below a partial aggregate, in one scan at
any width: the shuffle carries distinct values with their counts, a hot value (or an all-null column)
collapses before it leaves its task. Type tests run once per distinct value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datawarden.config import PREVIEW_ROWS, SAMPLE_VALUES
from datawarden.functions import scalars as s
from datawarden.functions.cell_types import TYPE_ORDER, type_tests
from datawarden.session import new_run_dir

KEY = ["dataset_id", "position"]
#: Rows whose cells one task groups; their distinct values stay in its memory.
ROWS_A_TASK = 100_000
#: Repeated row hashes up to this number (some 40 MB) are broadcast.
BROADCAST_HASHES = 1 << 20


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def spread(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The rows, about `n`, in tasks of some ROWS_A_TASK each, however their files are cut: ordered ranges
    of `keys`, so that equal values of a dataset tend to meet before they are shuffled."""
    return rows.repartitionByRange(1 + n // ROWS_A_TASK, *keys)


# --------------------------------------------------------------------------- cells
def _id(column: str) -> str:
    """Rows without an id form the dataset ''."""
    return f"coalesce({s.name(column)}, '')"


def _unpivot(df: DataFrame, ids: dict[str, str], cells: dict[int, str]) -> DataFrame:
    """Long form of the given expressions, keyed by their column position."""
    rows = ", ".join(f"struct({i} AS position, {e} AS value)" for i, e in cells.items())
    long = df.selectExpr(*[f"{e} AS {n}" for n, e in ids.items()], f"inline(array({rows}))")
    # Keys that cannot be null need no null filter before a join, which would be pushed into one
    # reader of the long form and keep it from sharing the shuffle of the others.
    return long.selectExpr(*ids, "coalesce(position, -1) AS position", "value")


def text_cells(
    df: DataFrame, columns: Sequence[str], dataset_id: str = "dataset_id", ordinal: str | None = None
) -> DataFrame:
    """Long form of an all-text table; a blank cell becomes null.

    `ordinal` names a column that orders the rows; it gives the samples first-seen order.
    """
    ids = {"dataset_id": _id(dataset_id)}
    if ordinal:
        ids["ord"] = s.name(ordinal)
    return _unpivot(df, ids, {i: s.cell(s.name(c)) for i, c in enumerate(columns)})


def value_freq(cells: DataFrame) -> DataFrame:
    """Each distinct value of each column with its count (and first position, if rows have one)."""
    first = ["min(ord) AS first_ord"] if "ord" in cells.columns else []
    return _grouped(cells, ["dataset_id", "position", "value"], ["count(1) AS n", *first])


def _grouped(df: DataFrame, keys: Sequence[str], aggregates: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(a) for a in aggregates])


# --------------------------------------------------------------------------- headers
def headers_of(datasets: DataFrame, names: Sequence[str]) -> DataFrame:
    """The header table of datasets that share their column names."""
    listing = ", ".join(s.text(n) for n in names)
    return datasets.selectExpr("dataset_id", f"posexplode(array({listing})) AS (position, name)")


def structural_issues(headers: DataFrame) -> DataFrame:
    """Per dataset its column count, the distinct header defects and how many headers repeat.

    Names are grouped before they are counted, so no dataset is ever held in one task.
    """
    plain = headers.selectExpr(
        "dataset_id", f"lower({s.trimmed("`name`")}) AS name"
    )
    names = _grouped(plain, ["dataset_id", "name"], ["count(1) AS n"])
    per = _grouped(
        names,
        ["dataset_id"],
        [
            "sum(n) AS column_count",
            "coalesce(sum(CASE WHEN n > 1 THEN n END), 0L) AS repeated_headers",
            "count_if(coalesce(name, '') = '') AS blank_headers",
        ],
    )
    return per.selectExpr(
        "dataset_id",
        "column_count",
        "repeated_headers",
        "array_compact(array(CASE WHEN repeated_headers > 0 THEN 'DUPLICATE_HEADER' END, "
        "CASE WHEN blank_headers > 0 THEN 'BLANK_HEADER' END)) AS structural_issues",
    )


# --------------------------------------------------------------------------- column profile
def column_counts(freq: DataFrame) -> DataFrame:
    """Counts per column: rows, present, distinct and values matching each type."""
    tests = type_tests("t")
    cells = freq.selectExpr(*KEY, "n", "value", f"{s.trimmed('value')} AS t")
    flagged = cells.selectExpr(*KEY, "n", "value", *[f"{t} AS is_{k}" for k, t in tests.items()])
    other = "NOT (" + " OR ".join(f"is_{k}" for k in tests) + ")"

    def total(condition: str) -> str:
        return f"coalesce(sum(CASE WHEN value IS NOT NULL AND {condition} THEN n END), 0L)"

    return _grouped(
        flagged,
        KEY,
        [
            "sum(n) AS row_count",
            f"{total('true')} AS non_null_count",
            "count(value) AS distinct_count",
            *[f"{total(f'is_{k}')} AS m_{k}" for k in tests],
            f"{total(other)} AS m_STRING",
        ],
    )


# Shared ratios; they need row_count, non_null_count and distinct_count in scope.
_MEASURES = (
    "row_count",
    "non_null_count",
    "row_count - non_null_count AS missing_count",
    "CASE WHEN row_count > 0 THEN (row_count - non_null_count) / row_count ELSE 0D END "
    "AS missing_pct",
    "CASE WHEN row_count > 0 THEN non_null_count / row_count ELSE 0D END AS completeness",
    "distinct_count",
)


def type_columns(counts: DataFrame) -> DataFrame:
    """Commit each column to a type.

    The dominant type matches the most values; ties go to the earlier one in TYPE_ORDER. It is
    committed from a share of 0.8 (compared in whole numbers), else the column stays STRING and
    its validity reports the dominant share.
    """
    most = f"greatest({', '.join(f'm_{k}' for k in TYPE_ORDER)})"
    cases = " ".join(f"WHEN m_{k} = {most} THEN '{k}'" for k in TYPE_ORDER)
    ranked = counts.selectExpr(
        *KEY, "row_count", "non_null_count", "distinct_count",
        f"{most} AS most", f"CASE {cases} END AS dominant",
    )
    judged = ranked.selectExpr(
        "*",
        "most * 5 >= non_null_count * 4 AS committed",
        "CASE WHEN most * 5 >= non_null_count * 4 AND dominant = 'STRING' THEN non_null_count "
        "ELSE most END AS type_match_count",
    )
    return judged.selectExpr(
        *KEY,
        "CASE WHEN non_null_count = 0 THEN 'UNKNOWN' WHEN committed THEN dominant ELSE 'STRING' END "
        "AS data_type",
        *_MEASURES,
        "type_match_count",
        "CASE WHEN non_null_count = 0 THEN 1D ELSE most / non_null_count END AS dominant_type_share",
        "CASE WHEN non_null_count = 0 THEN 1D ELSE type_match_count / non_null_count END "
        "AS validity",
    )


def with_headers(headers: DataFrame, typed: DataFrame) -> DataFrame:
    """Every header gets a profile row; a column of a dataset without rows is UNKNOWN and empty."""
    defaults = {
        "data_type": "'UNKNOWN'", "row_count": "0L", "non_null_count": "0L",
        "missing_count": "0L", "missing_pct": "0D", "completeness": "0D", "distinct_count": "0L",
        "type_match_count": "0L", "dominant_type_share": "1D", "validity": "1D",
    }
    return headers.join(typed, KEY, "left").selectExpr(
        *KEY, "name", *[f"coalesce({c}, {d}) AS {c}" for c, d in defaults.items()]
    )


def column_profile(freq: DataFrame, headers: DataFrame) -> DataFrame:
    return with_headers(headers, type_columns(column_counts(freq)))


# --------------------------------------------------------------------------- samples
def sample_values(freq: DataFrame, k: int = SAMPLE_VALUES) -> DataFrame:
    """Up to k distinct values per column, in first-seen order, cut to 256 characters.

    Without a row ordinal the order is md5(value): arbitrary but reproducible. The ranking is
    limited inside each task before the shuffle, so a column's values never meet in one task.
    """
    order = "first_ord" if "first_ord" in freq.columns else "md5(value)"
    # Presence is tested behind the count: a plain null test would be pushed below the
    # aggregate, and its shuffle could no longer be shared with the column counts.
    present = freq.filter("CASE WHEN n > 0 THEN value END IS NOT NULL")
    ranked = present.selectExpr(
        *KEY,
        "value",
        f"row_number() OVER (PARTITION BY dataset_id, position ORDER BY {order}, value) AS rank",
    )
    packed = _grouped(
        ranked.filter(f"rank <= {int(k)}"),
        KEY,
        [f"sort_array(collect_list(struct(rank, {s.shorten('value')} AS value))) AS packed"],
    )
    return packed.selectExpr(*KEY, "packed.value AS sample_values")


def with_samples(profile: DataFrame, samples: DataFrame) -> DataFrame:
    kept = [s.name(c) for c in profile.columns if c not in KEY]
    return profile.join(samples, KEY, "left").selectExpr(
        *KEY, *kept, "coalesce(sample_values, CAST(array() AS ARRAY<STRING>)) AS sample_values"
    )


# --------------------------------------------------------------------------- dataset profile
def _plain_text(kind: T.DataType, x: str) -> str:
    """A spelling that is equal exactly where the values are."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return f"CAST({x} + CAST(0 AS {kind.simpleString()}) AS STRING)"  # -0.0 equals 0.0
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        spelled = f"to_json(struct({x}), map('ignoreNullFields', 'false'))"
        return f"CASE WHEN {x} IS NOT NULL THEN {spelled} END"
    if isinstance(kind, T.BinaryType):
        return f"hex({x})"
    return f"CAST({x} AS STRING)"


def spelled_row(df: DataFrame, columns: Sequence[str]) -> str:
    """The row in a spelling that is equal exactly where the rows are."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for column in columns:
        x = _plain_text(fields[column], s.name(column))
        parts.append(f"coalesce(concat(length({x}), ':', {x}), '~')")
    return f"concat({', '.join(parts)})"


def row_digest(df: DataFrame, columns: Sequence[str]) -> str:
    """SHA-256 of the row's spelling: equal digests mean equal rows.

    The duplicate count shuffles 32 bytes a row instead of the row.
    """
    return f"unhex(sha2({spelled_row(df, columns)}, 256))"


def row_counts(
    df: DataFrame, columns: Sequence[str], dataset_id: str = "dataset_id"
) -> DataFrame:
    """Rows per dataset and rows beyond the first of each group of equal rows."""
    digests = df.selectExpr(
        f"{_id(dataset_id)} AS dataset_id", f"{row_digest(df, columns)} AS digest"
    )
    return digest_counts(digests)


def digest_counts(digests: DataFrame) -> DataFrame:
    """The same from (dataset_id, digest)."""
    groups = _grouped(digests, ["dataset_id", "digest"], ["count(1) AS n"])
    return _grouped(
        groups, ["dataset_id"], ["sum(n) AS row_count", "sum(n - 1) AS duplicate_row_count"]
    )


def two_level_counts(rows: DataFrame) -> DataFrame:
    """The same from (dataset_id, spelled), shuffling 8 bytes a row.

    Rows are grouped by a 64-bit hash first. Only rows whose hash occurs again within their dataset can be
    duplicates; they alone are digested and grouped, so that hash collisions count for nothing. The
    repeated hashes are written, counted, and broadcast up to BROADCAST_HASHES; where there are
    more, most rows would be digested anyway, and all are.
    """
    spark = rows.sparkSession
    hashed = rows.selectExpr("dataset_id", "xxhash64(spelled) AS h", "spelled")
    groups = _grouped(hashed.drop("spelled"), ["dataset_id", "h"], ["count(1) AS n"])
    path = new_run_dir(spark, "repeated-hashes")
    again = groups.filter("n > 1").select("dataset_id", "h")
    again.write.parquet(path)
    again = spark.read.schema(again.schema).parquet(path)
    digest = "unhex(sha2(spelled, 256)) AS digest"
    if again.count() > BROADCAST_HASHES:
        return digest_counts(rows.selectExpr("dataset_id", digest))
    company = hashed.join(F.broadcast(again), ["dataset_id", "h"], "left_semi")
    repeats = digest_counts(company.selectExpr("dataset_id", digest)).drop("row_count")
    totals = _grouped(rows, ["dataset_id"], ["count(1) AS row_count"])
    return totals.join(repeats, "dataset_id", "left").selectExpr(
        "dataset_id", "row_count", "coalesce(duplicate_row_count, 0L) AS duplicate_row_count"
    )


def two_level_row_counts(
    df: DataFrame, columns: Sequence[str], dataset_id: str = "dataset_id"
) -> DataFrame:
    """`row_counts` in two levels. It runs the first one when it is called."""
    return two_level_counts(
        df.selectExpr(f"{_id(dataset_id)} AS dataset_id", f"{spelled_row(df, columns)} AS spelled")
    )


def dataset_profile(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows, columns, duplicates and header defects per dataset."""
    return structural_issues(headers).join(rows, "dataset_id", "left").selectExpr(
        "dataset_id",
        "coalesce(row_count, 0L) AS row_count",
        "column_count",
        "coalesce(duplicate_row_count, 0L) AS duplicate_row_count",
        "repeated_headers",
        "structural_issues",
    )


def preview_rows(
    df: DataFrame,
    columns: Sequence[str],
    ordinal: str,
    dataset_id: str = "dataset_id",
    names: Sequence[str] | None = None,
    limit: int = PREVIEW_ROWS,
) -> DataFrame:
    """The first rows of each dataset. Cells stay positional, so repeated names cannot collide.

    Without `names` (files of one width, each with its own header) cells carry positions only.
    """
    cells = []
    for i, c in enumerate(columns):
        label = "" if names is None else f"{s.text(names[i])} AS name, "
        cells.append(f"struct({i} AS position, {label}{s.shorten(s.name(c))} AS value)")
    ranked = df.selectExpr(
        f"{s.name(dataset_id)} AS dataset_id",
        f"row_number() OVER (PARTITION BY {s.name(dataset_id)} ORDER BY {s.name(ordinal)}) "
        "AS row_number",
        f"array({', '.join(cells)}) AS cells",
    )
    return ranked.filter(f"row_number <= {int(limit)}")


# --------------------------------------------------------------------------- typed tables
def _family(kind: T.DataType) -> tuple[str, str]:
    """(common storage type, data type) of a native column."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint", "INTEGER"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "double", "FLOAT"
    if isinstance(kind, T.DecimalType):
        return kind.simpleString(), "FLOAT"
    if isinstance(kind, T.BooleanType):
        return "boolean", "BOOLEAN"
    if isinstance(kind, T.DateType):
        return "date", "DATE"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return kind.simpleString(), "DATETIME"
    return "string", "STRING"


def typed_value_freq(
    df: DataFrame, columns: Sequence[str], dataset_id: str
) -> list[tuple[str, DataFrame]]:
    """One (data type, value_freq) pair per storage type; values keep their native type."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    groups: dict[tuple[str, str], dict[int, str]] = {}
    for i, column in enumerate(columns):
        storage, data_type = _family(fields[column])
        x = s.name(column)
        if storage == "string":
            x = s.cell(_plain_text(fields[column], x))
        groups.setdefault((storage, data_type), {})[i] = f"CAST({x} AS {storage})"
    ids = {"dataset_id": _id(dataset_id)}
    return [
        (data_type, value_freq(_unpivot(df, ids, cells)))
        for (_, data_type), cells in groups.items()
    ]


def typed_column_profile(
    df: DataFrame, columns: Sequence[str], dataset_id: str = "dataset_id"
) -> DataFrame:
    """Profile of a table with native types: the schema is the type, only NaN is invalid.

    All columns are inlined in one scan, each into the slot of its storage type, and grouped by
    column and slot at once, whatever types the table has.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    families = [_family(fields[c]) for c in columns]
    slots = {storage: f"v{i}" for i, storage in enumerate(dict.fromkeys(f[0] for f in families))}
    rows = []
    for i, (column, (storage, _)) in enumerate(zip(columns, families, strict=True)):
        x = s.name(column)
        if storage == "string":
            x = s.cell(_plain_text(fields[column], x))
        cells = [f"CAST({x if k == storage else 'NULL'} AS {k}) AS {v}" for k, v in slots.items()]
        rows.append(f"struct({i} AS position, {', '.join(cells)})")
    long = df.selectExpr(f"{_id(dataset_id)} AS dataset_id", f"inline(array({', '.join(rows)}))")
    freq = _grouped(long, [*KEY, *slots.values()], ["count(1) AS n"])
    present = f"({' OR '.join(f'{v} IS NOT NULL' for v in slots.values())})"
    valid = present + "".join(f" AND NOT coalesce(isnan({v}), false)" for k, v in slots.items() if k == "double")
    counts = _grouped(
        freq,
        KEY,
        [
            "sum(n) AS row_count",
            f"coalesce(sum(CASE WHEN {present} THEN n END), 0L) AS non_null_count",
            f"count_if({present}) AS distinct_count",
            f"coalesce(sum(CASE WHEN {valid} THEN n END), 0L) AS type_match_count",
        ],
    )
    share = "CASE WHEN non_null_count = 0 THEN 1D ELSE type_match_count / non_null_count END"
    names, kinds = (f"array({', '.join(s.text(x) for x in xs)})" for xs in (columns, [f[1] for f in families]))
    return counts.selectExpr(
        *KEY,
        f"get({names}, position) AS name",
        f"CASE WHEN non_null_count = 0 THEN 'UNKNOWN' ELSE get({kinds}, position) END AS data_type",
        *_MEASURES,
        "type_match_count",
        f"{share} AS dominant_type_share",
        f"{share} AS validity",
    )
