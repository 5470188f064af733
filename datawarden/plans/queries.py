"""The registered queries: one entry per operator, each over its whole tables.

Every callable takes (spark, sf_dir) and returns a lazy DataFrame with flat columns. Doubles are
rounded to six digits, dates and instants are given as text or epoch seconds, so that results
can be compared between engines.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datawarden.config import ACCESS_TYPES, Settings
from datawarden.functions.cell_types import TYPE_ORDER
from datawarden.functions.pii import VALUE_CATEGORIES
from datawarden.operators import catalog as cat
from datawarden.operators import maintenance as mt
from datawarden.operators import sketch as sk
from datawarden.operators import views
from datawarden.operators.classify import (
    apply_refinements,
    header_categories,
    review_queue,
    value_shares,
)
from datawarden.operators.profile import (
    ROWS_A_TASK,
    column_counts,
    column_profile,
    dataset_profile,
    preview_rows,
    sample_values,
    text_cells,
    two_level_row_counts,
    typed_column_profile,
    typed_value_freq,
    union_all,
    value_freq,
    with_samples,
)
from datawarden.operators.score import narrative, profile_scores
from datawarden.operators.usage import (
    access_rollup,
    access_windows,
    daily_usage,
    usage_summary,
    value_scores,
)
from datawarden.plans import oracle as sql
from datawarden.plans import workload as wl
from datawarden.plans.workload import read_table
from datawarden.session import new_run_dir, use_utc
from datawarden.sources.catalog_store import CatalogStore
from datawarden.sources.csv_files import list_files, read_csv_folder
from datawarden.sources.tables import export_catalog
from datawarden.streaming import access_stream as stream

Query = Callable[[SparkSession, str], DataFrame]
_COLUMN = ["dataset_id", "position"]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Settings used by the re-weighting queries.
OTHER = Settings(
    quality={"completeness": 0.5, "validity": 0.25, "uniqueness": 0.25},
    trust={"quality": 0.6, "consistency": 0.3, "classification_coverage": 0.1},
    value={"frequency": 0.3, "recency": 0.5, "trend": 0.2},
    freq_cap=20,
    half_life_days=14.0,
    recommend={"retire_below": 20.0, "archive_below": 45.0, "optimize_below": 70.0},
    sensitivity={**Settings().sensitivity, "EMAIL": "LOW", "NONE": "LOW", "NAME": "HIGH"},
)


def query(oracle: str | None = None, extra: dict[str, str] | None = None):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(use_utc(spark), sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if oracle is not None:
            ORACLE[fn.__name__] = sql.sql(oracle, extra)
        return fn

    return register


def r6(c: str) -> Column:
    return F.expr(f"round({c}, 6)")


def seconds(c: str) -> Column:
    return F.expr(f"unix_seconds({c})")


def day_text(c: str) -> Column:
    return F.expr(f"date_format({c}, 'yyyy-MM-dd')")


# --------------------------------------------------------------------------- access log
_SEC = "CAST(floor(epoch({})) AS BIGINT)"


@query(
    f"""SELECT dataset_id, accesses_90d, accesses_last30, accesses_prev30,
    {_SEC.format("last_accessed_at")} AS last_accessed_s,
    round(days_since_last_access, 6) AS days_since_last_access
    FROM windows WHERE last_accessed_at IS NOT NULL"""
)
def access_windows_query(spark, sf_dir):
    return access_windows(wl.access_log(spark, sf_dir), wl.NOW).select(
        "dataset_id", "accesses_90d", "accesses_last30", "accesses_prev30",
        seconds("last_accessed_at").alias("last_accessed_s"),
        r6("days_since_last_access").alias("days_since_last_access"),
    )


_VALUE = """SELECT dataset_id, round(frequency, 6) AS frequency, round(recency, 6) AS recency,
round(trend, 6) AS trend, round(value_score, 6) AS value_score, recommendation FROM {}"""


def flat_value(df: DataFrame) -> DataFrame:
    return df.select(
        "dataset_id",
        *[r6(f"value.inputs.{p}").alias(p) for p in ("frequency", "recency", "trend")],
        r6("value.score").alias("value_score"),
        "recommendation",
    )


@query(_VALUE.format("asset_value"))
def value_scores_query(spark, sf_dir):
    return flat_value(
        value_scores(wl.assets(spark, sf_dir), wl.access_log(spark, sf_dir), wl.NOW)
    )


@query(
    """SELECT recommendation, count(*) AS datasets,
    count(*) FILTER (WHERE trend < 0.5::DOUBLE) AS declining FROM asset_value
    GROUP BY recommendation"""
)
def value_recommendation(spark, sf_dir):
    scored = value_scores(wl.assets(spark, sf_dir), wl.access_log(spark, sf_dir), wl.NOW)
    return scored.groupBy("recommendation").agg(
        F.count(F.lit(1)).alias("datasets"), F.count_if("is_declining").alias("declining")
    )


_EXPLAIN = " UNION ALL ".join(
    f"SELECT dataset_id, '{p}' AS input_name, round({p}, 6) AS input, {w}::DOUBLE AS weight, "
    f"round(100 * {w}::DOUBLE * {p}, 6) AS contribution FROM asset_value"
    for p, w in Settings().value.items()
)


@query(_EXPLAIN)
def value_explain(spark, sf_dir):
    scored = value_scores(wl.assets(spark, sf_dir), wl.access_log(spark, sf_dir), wl.NOW)
    return views.explain_rows(scored, ("value",)).select(
        "dataset_id", "input_name", r6("input").alias("input"), "weight",
        r6("contribution").alias("contribution"),
    )


def _daily(where: str, days: int) -> str:
    counts = ", ".join(
        f"count(*) FILTER (WHERE access_type = '{t}') AS {t.lower()}" for t in ACCESS_TYPES
    )
    parts = ", ".join(f"coalesce({c}, 0) AS {c}" for c in sql.ACCESS_COLUMNS)
    total = " + ".join(f"coalesce({c}, 0)" for c in sql.ACCESS_COLUMNS)
    return f"""
    SELECT dataset_id, strftime(day, '%Y-%m-%d') AS date, {total} AS total, {parts}
    FROM (SELECT dataset_id, CAST({sql.NOW} AS DATE) - CAST(i AS INTEGER) AS day
          FROM assets, range({days}) r(i))
    LEFT JOIN (SELECT dataset_id, CAST(occurred_at AS DATE) AS day, {counts}
               FROM access_log WHERE {where} GROUP BY ALL) USING (dataset_id, day)"""


@query(_daily("true", 90))
def usage_daily(spark, sf_dir):
    out = daily_usage(wl.assets(spark, sf_dir), wl.access_log(spark, sf_dir), wl.NOW)
    return out.withColumn("date", day_text("date"))


@query(_daily("access_type = 'DOWNLOAD'", 30))
def usage_daily_typed(spark, sf_dir):
    out = daily_usage(
        wl.assets(spark, sf_dir), wl.access_log(spark, sf_dir), wl.NOW, 30, "DOWNLOAD"
    )
    return out.withColumn("date", day_text("date"))


@query(
    f"""SELECT dataset_id, '1998-05-02' AS from_date, '1998-07-01' AS to_date, accesses_90d,
    accesses_last30, accesses_prev30, {_SEC.format("last_accessed_at")} AS last_accessed_s
    FROM views_windows""",
    {
        "view_log": "SELECT * FROM access_log WHERE access_type = 'VIEW'",
        "views_windows": sql.windows("assets", "view_log", sql.NOW),
    },
)
def usage_summary_query(spark, sf_dir):
    usage = wl.Catalog(spark, sf_dir).usage
    return usage_summary(wl.assets(spark, sf_dir), usage, wl.NOW, 60, "VIEW").select(
        "dataset_id", day_text("from_date").alias("from_date"), day_text("to_date").alias("to_date"),
        "accesses_90d", "accesses_last30", "accesses_prev30",
        seconds("last_accessed_at").alias("last_accessed_s"),
    )


@query(
    f"""SELECT dataset_id, access_count, access_count_90d,
    {_SEC.format("last_accessed_at")} AS last_accessed_s FROM full_rollup""",
    {"full_rollup": sql.rollup("all_access")},
)
def access_rollup_query(spark, sf_dir):
    """All-time counts of all events, from the store's roll-up; the 90-day count has no upper bound."""
    return access_rollup(wl.Catalog(spark, sf_dir).usage, wl.NOW).select(
        "dataset_id", "access_count", "access_count_90d",
        seconds("last_accessed_at").alias("last_accessed_s"),
    )


_ROLLED_TIMES = ("1996-03-15T12:00:00Z", wl.NOW)


def _rolled_sql() -> str:
    parts = []
    for at in _ROLLED_TIMES:
        now = f"TIMESTAMP '{at[:10]} {at[11:19]}'"
        counts = sql.rollup("live_log").replace(sql.NOW, now)
        parts.append(
            f"SELECT '{at}' AS at, dataset_id, accesses_90d, accesses_last30, accesses_prev30, "
            f"{_SEC.format('r.last_accessed_at')} AS last_accessed_s, access_count, access_count_90d "
            f"FROM ({sql.windows('assets', 'live_log', now)}) JOIN ({counts}) r USING (dataset_id)"
        )
    return " UNION ALL ".join(parts)


@query(
    _rolled_sql(),
    {
        "live_log": "SELECT * FROM access_log WHERE NOT (dataset_id LIKE 'BUILDING-%' AND occurred_at "
        "<= TIMESTAMP '1995-06-15 00:00:00')"
    },
)
def usage_rolled(spark, sf_dir):
    """The log in three batches, one of them late, summed up in between, with a backdated delete."""
    store = CatalogStore(spark, new_run_dir(spark, "usage"), log_unit="month")
    log = wl.access_log(spark, sf_dir).withColumn("source", F.lit("LIVE"))
    late = "(event_id % 10 = 0 AND occurred_at < TIMESTAMP'1997-01-01 00:00:00Z')"
    store.append("access_events", log.filter(f"NOT {late} AND occurred_at < TIMESTAMP'1997-01-01 00:00:00Z'"), "old")
    store.roll_up("1995-01-01T00:00:00Z")
    store.append("access_events", log.filter("occurred_at >= TIMESTAMP'1997-01-01 00:00:00Z'"), "new")
    store.append("access_events", log.filter(late), "late")
    store.roll_up("1996-06-01T00:00:00Z")
    gone = wl.assets(spark, sf_dir).filter("dataset_id LIKE 'BUILDING-%'")
    store.append("tombstones", gone.selectExpr("dataset_id", "TIMESTAMP'1995-06-15 00:00:00Z' AS deleted_at"))
    parts = []
    for at in _ROLLED_TIMES:
        usage = store.usage(at)
        parts.append(
            access_windows(usage, at).join(access_rollup(usage, at).drop("last_accessed_at"), "dataset_id").select(
                F.lit(at).alias("at"), "dataset_id", "accesses_90d", "accesses_last30", "accesses_prev30",
                seconds("last_accessed_at").alias("last_accessed_s"), "access_count", "access_count_90d",
            )
        )
    return union_all(parts)


@query(
    """SELECT access_type, count(*) AS events FROM access_log
    WHERE dataset_id IN (SELECT dataset_id FROM ready) GROUP BY access_type"""
)
def trackable_events(spark, sf_dir):
    ready = cat.trackable(wl.access_log(spark, sf_dir), wl.manifest(spark, sf_dir))
    return ready.groupBy("access_type").agg(F.count(F.lit(1)).alias("events"))


@query(
    """SELECT dataset_id, access_count, round(access_count / greatest(max(access_count) OVER (),
    1)::DOUBLE, 6) AS usage_share
    FROM (SELECT * FROM summaries ORDER BY uploaded_at DESC, dataset_id LIMIT 100)"""
)
def usage_normalised(spark, sf_dir):
    c = wl.Catalog(spark, sf_dir)
    page = cat.catalog_page(c.datasets, c.tags, c.usage, wl.NOW, limit=100)
    return views.usage_normalised(page).withColumn("usage_share", r6("usage_share"))


# --------------------------------------------------------------------------- profile
_PROFILE = """SELECT dataset_id, position, name, data_type, row_count, non_null_count, missing_count,
round(missing_pct, 6) AS missing_pct, round(completeness, 6) AS completeness, distinct_count,
type_match_count, round(dominant_type_share, 6) AS dominant_type_share,
round(validity, 6) AS validity FROM {}"""


def flat_profile(df: DataFrame) -> DataFrame:
    ratios = ("missing_pct", "completeness", "dominant_type_share", "validity")
    return df.select(
        "dataset_id", "position", "name", "data_type", "row_count", "non_null_count",
        "missing_count", "distinct_count", "type_match_count", *[r6(c).alias(c) for c in ratios],
    )


@query(_PROFILE.format("column_profile"))
def column_profile_query(spark, sf_dir):
    t = wl.text_tables(spark, sf_dir)
    return flat_profile(column_profile(t.freq, t.headers))


TYPED_TABLES = {
    "orders": "o_orderkey INTEGER, o_custkey INTEGER, o_orderstatus STRING, o_totalprice FLOAT, "
    "o_orderdate DATETIME, o_orderpriority STRING",
    "customer": "c_custkey INTEGER, c_name STRING, c_nationkey INTEGER, c_acctbal FLOAT, "
    "c_mktsegment STRING",
    "part": "p_partkey INTEGER, p_name STRING, p_brand STRING, p_type STRING, p_size INTEGER, "
    "p_retailprice FLOAT",
    "lineitem": "l_orderkey INTEGER, l_partkey INTEGER, l_suppkey INTEGER, l_linenumber INTEGER, "
    "l_quantity FLOAT, l_extendedprice FLOAT, l_discount FLOAT, l_tax FLOAT, l_returnflag STRING, "
    "l_linestatus STRING, l_shipdate DATETIME",
    "supplier": "s_suppkey INTEGER, s_name STRING, s_nationkey INTEGER, s_acctbal FLOAT",
    "nation": "n_nationkey INTEGER, n_name STRING, n_regionkey INTEGER",
    "region": "r_regionkey INTEGER, r_name STRING",
    "events": "event_id INTEGER, ts DATETIME, user_id INTEGER, event_type STRING, value FLOAT, "
    "props STRING",
    "documents": "doc_id INTEGER, text STRING, lang STRING, source STRING, n_chars INTEGER",
    "labels": "doc_id INTEGER, quality INTEGER, toxic INTEGER",
    "pages": "page_id INTEGER, url STRING, html STRING",
    "embeddings": "vec_id INTEGER, embedding ARRAY, label INTEGER",
    "benchmark": "item_id INTEGER, text STRING",
    "conversations": "conv_id INTEGER, turn INTEGER, role STRING, text STRING",
}


def _typed_oracle() -> str:
    parts = []
    for table, listing in TYPED_TABLES.items():
        for i, entry in enumerate(listing.split(", ")):
            name, kind = entry.split()
            kind, array = ("STRING", True) if kind == "ARRAY" else (kind, False)
            cell = f"CASE WHEN trim({name}) <> '' THEN {name} END" if kind == "STRING" and not array else name
            parts.append(
                f"SELECT '{table}' AS dataset_id, {i} AS position, '{name}' AS name, "
                f"CASE WHEN count({cell}) = 0 THEN 'UNKNOWN' ELSE '{kind}' END AS data_type, "
                f"count(*) AS row_count, count({cell}) AS non_null_count, "
                f"count(*) - count({cell}) AS missing_count, "
                f"round((count(*) - count({cell})) / count(*)::DOUBLE, 6) AS missing_pct, "
                f"round(count({cell}) / count(*)::DOUBLE, 6) AS completeness, "
                f"count(DISTINCT {cell}) AS distinct_count, count({cell}) AS type_match_count, "
                f"1e0 AS dominant_type_share, 1e0 AS validity FROM {table}"
            )
    return " UNION ALL ".join(parts)


@query(_typed_oracle())
def column_profile_typed(spark, sf_dir):
    parts = []
    for table in TYPED_TABLES:
        df = read_table(spark, sf_dir, table).withColumn("dataset_id", F.lit(table))
        columns = [c for c in df.columns if c != "dataset_id"]
        parts.append(typed_column_profile(df, columns))
    return flat_profile(union_all(parts))


@query("SELECT data_type, count(*) AS n FROM column_profile GROUP BY data_type")
def type_distribution(spark, sf_dir):
    t = wl.text_tables(spark, sf_dir)
    return views.type_distribution(column_profile(t.freq, t.headers))


@query("SELECT dataset_id, position, sample_values FROM samples")
def sample_values_query(spark, sf_dir):
    return sample_values(wl.text_tables(spark, sf_dir).freq).withColumn(
        "sample_values", F.array_join("sample_values", "|")
    )


@query(
    """SELECT dataset_id, position, string_agg(value, '|' ORDER BY rank) AS sample_values FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset_id, position ORDER BY first_ord, value) AS rank
    FROM value_freq WHERE value IS NOT NULL) WHERE rank <= 10 GROUP BY dataset_id, position"""
)
def sample_values_first_seen(spark, sf_dir):
    return sample_values(wl.text_tables(spark, sf_dir, ordered=True).freq).withColumn(
        "sample_values", F.array_join("sample_values", "|")
    )


@query(
    "SELECT dataset_id, position, "
    + ", ".join(f"m_{t} AS m_{t.lower()}" for t in TYPE_ORDER)
    + " FROM counts"
)
def type_match_counts(spark, sf_dir):
    return column_counts(wl.text_tables(spark, sf_dir).freq).select(
        "dataset_id", "position", *[F.col(f"m_{t}").alias(f"m_{t.lower()}") for t in TYPE_ORDER]
    )


@query(
    """SELECT dataset_id, row_count, column_count, duplicate_row_count, repeated_headers,
    concat_ws('|', CASE WHEN repeated_headers > 0 THEN 'DUPLICATE_HEADER' END,
              CASE WHEN blank_headers > 0 THEN 'BLANK_HEADER' END) AS structural_issues
    FROM dataset_profile"""
)
def duplicate_rows(spark, sf_dir):
    """Rows and duplicates of both text tables, in two levels: 8-byte hashes, then digests."""
    headers = wl.text_tables(spark, sf_dir).headers
    tables = ((wl.dirty_orders(spark, sf_dir), wl.ORDER_COLUMNS), (wl.dirty_customers(spark, sf_dir), wl.CUSTOMER_COLUMNS))
    rows = union_all([two_level_row_counts(df, columns) for df, columns in tables])
    return dataset_profile(rows, headers).withColumn("structural_issues", F.array_join("structural_issues", "|"))


def _histogram(freq: str) -> str:
    return f"""
    SELECT dataset_id, position, bin, round(CASE WHEN lo = hi THEN lo ELSE lo + bin * w END, 6)
             AS bin_from, round(CASE WHEN lo = hi THEN hi ELSE lo + (bin + 1) * w END, 6) AS bin_to,
           CAST(coalesce(n, 0) AS BIGINT) AS n
    FROM (SELECT *, CAST(unnest(range(CASE WHEN lo = hi THEN 1 ELSE 6 END)) AS INTEGER) AS bin
          FROM num_stats)
    LEFT JOIN (SELECT dataset_id, position, CAST(CASE WHEN lo = hi THEN 0
                        ELSE least(5, floor((x - lo) / w)) END AS INTEGER) AS bin, sum(n) AS n
               FROM {freq} JOIN num_stats USING (dataset_id, position) GROUP BY ALL)
    USING (dataset_id, position, bin)"""


_STATS = """SELECT dataset_id, position, min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 6e0 AS w
FROM {} GROUP BY dataset_id, position HAVING sum(n) >= 2"""


def flat_histogram(df: DataFrame) -> DataFrame:
    return df.select(
        "dataset_id", "position", "bin", r6("bin_from").alias("bin_from"),
        r6("bin_to").alias("bin_to"), "n",
    )


@query(
    _histogram("numbers"),
    {
        "numbers": "SELECT dataset_id, position, n, TRY_CAST(t AS DOUBLE) AS x FROM flags "
        "WHERE is_FLOAT",
        "num_stats": _STATS.format("numbers"),
    },
)
def numeric_histogram(spark, sf_dir):
    return flat_histogram(views.numeric_histogram(wl.text_tables(spark, sf_dir).freq))


_LINEITEM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    _histogram("lineitem_numbers"),
    {
        "lineitem_numbers": " UNION ALL ".join(
            f"SELECT 'lineitem' AS dataset_id, {i} AS position, {c} AS x, count(*) AS n "
            f"FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}"
            for i, c in enumerate(_LINEITEM)
        ),
        "num_stats": _STATS.format("lineitem_numbers"),
    },
)
def numeric_histogram_typed(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem").withColumn("dataset_id", F.lit("lineitem"))
    freqs = [f for _, f in typed_value_freq(df, _LINEITEM, "dataset_id")]
    return flat_histogram(union_all([views.numeric_histogram(f) for f in freqs]))


_CELLS = " || '~' || ".join(f'coalesce("{c}", \'\')' for c in wl.ORDER_COLUMNS)


@query(
    f"""SELECT dataset_id, row_number, cells FROM (
    SELECT dataset_id, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY ord) AS INTEGER)
             AS row_number, {_CELLS} AS cells FROM dirty_orders) WHERE row_number <= 50"""
)
def preview_rows_query(spark, sf_dir):
    rows = preview_rows(wl.dirty_orders(spark, sf_dir), wl.ORDER_COLUMNS, "ord")
    text = "array_join(transform(cells, c -> coalesce(c.value, '')), '~')"
    return rows.selectExpr("dataset_id", "row_number", f"{text} AS cells")


@query(
    """SELECT dataset_id, position, row_count, non_null_count, m_INTEGER AS m_integer, m_STRING AS m_string,
    true AS merged_is_whole, true AS within_bound FROM counts"""
)
def column_sketches(spark, sf_dir):
    """Both text tables profiled in three parts, each appended on its own, and merged: the estimated
    distinct counts equal those of one sketch of everything and lie within the stated bound."""
    store = CatalogStore(spark, new_run_dir(spark, "sketches"))
    orders, customers = wl.dirty_orders(spark, sf_dir), wl.dirty_customers(spark, sf_dir)

    def cells(condition: str) -> DataFrame:
        parts = ((orders, wl.ORDER_COLUMNS), (customers, wl.CUSTOMER_COLUMNS))
        return union_all([text_cells(df.filter(condition), columns) for df, columns in parts])

    for k in range(3):
        part = sk.column_sketches(cells(f"ord % 3 = {k}")).withColumn("profiled_at", F.expr(f"TIMESTAMP'{wl.NOW}'"))
        store.append("column_sketches", part, batch=f"part-{k}")
    merged = sk.sketched_counts(store.column_sketches())
    whole = sk.sketched_counts(sk.column_sketches(cells("true"))).selectExpr(*_COLUMN, "distinct_count AS whole")
    exact = column_counts(value_freq(cells("true"))).selectExpr(*_COLUMN, "distinct_count AS exact")
    return merged.join(whole, _COLUMN).join(exact, _COLUMN).selectExpr(
        *_COLUMN, "row_count", "non_null_count", "m_INTEGER AS m_integer", "m_STRING AS m_string",
        "distinct_count = whole AS merged_is_whole",
        f"abs(distinct_count - exact) <= {sk.ERROR_BOUND} * exact AS within_bound",
    )


# --------------------------------------------------------------------------- classification
@query("SELECT dataset_id, position, name, header_category FROM header_hints")
def header_categories_query(spark, sf_dir):
    return header_categories(wl.text_tables(spark, sf_dir).headers)


_SHARES = (
    "SELECT dataset_id, position, name, header_category, sample_size, "
    + ", ".join(f"round(s_{c}, 6) AS {c.lower()}" for c in VALUE_CATEGORIES)
    + " FROM {}"
)


def flat_shares(df: DataFrame) -> DataFrame:
    return df.select(
        "dataset_id", "position", "name", "header_category",
        F.col("sample_size").cast("bigint").alias("sample_size"),
        *[r6(f"shares.{c}").alias(c.lower()) for c in VALUE_CATEGORIES],
    )


@query(_SHARES.format("shares"))
def value_pattern_shares(spark, sf_dir):
    t = wl.text_tables(spark, sf_dir)
    return flat_shares(value_shares(t.freq, t.headers))


@query(_SHARES.format("token_shares"))
def token_pattern_shares(spark, sf_dir):
    """Every distinct word of all documents has a vote for its source."""
    tokens = wl.text_tokens(spark, sf_dir)
    names = tokens.groupBy("dataset_id", "position", "name").agg(F.count(F.lit(1)).alias("words"))
    return flat_shares(value_shares(value_freq(tokens), names.drop("words")))


_TAGS = """SELECT dataset_id, position, name, category, sensitivity, round(confidence, 6)
AS confidence, source, needs_review FROM tags"""


@query(_TAGS)
def classify_columns(spark, sf_dir):
    return wl.findings(spark, sf_dir).tags.drop("overridden").withColumn(
        "confidence", r6("confidence")
    )


@query(
    """SELECT dataset_id, position, name, category, round(confidence, 6) AS confidence, sample_values
    FROM tags JOIN samples USING (dataset_id, position) WHERE needs_review"""
)
def review_queue_query(spark, sf_dir):
    found = wl.findings(spark, sf_dir)
    return (
        review_queue(found.tags, found.samples)
        .withColumn("confidence", r6("confidence"))
        .withColumn("sample_values", F.array_join("sample_values", "|"))
    )


@query(
    """SELECT dataset_id, position, name, category, sensitivity, round(confidence, 6) AS confidence,
    source FROM refined_tags"""
)
def apply_refinements_query(spark, sf_dir):
    found = wl.findings(spark, sf_dir)
    return apply_refinements(found.tags, wl.refinements(spark, sf_dir)).select(
        "dataset_id", "position", "name", "category", "sensitivity",
        r6("confidence").alias("confidence"), "source",
    )


# --------------------------------------------------------------------------- findings, scores
@query(
    """SELECT dataset_id, coalesce(position, -1) AS position, column_name, check_type, severity,
    affected_count, round(affected_pct, 6) AS affected_pct, detail FROM checks"""
)
def quality_checks_query(spark, sf_dir):
    return wl.findings(spark, sf_dir).checks.withColumns(
        {"affected_pct": r6("affected_pct"), "position": F.coalesce("position", F.lit(-1))}
    )


@query(
    """SELECT dataset_id, position, name, round(missing_pct, 6) AS missing_pct, severity
    FROM column_profile LEFT JOIN (SELECT dataset_id, position, severity FROM checks
                                   WHERE check_type = 'MISSING_VALUES')
    USING (dataset_id, position)"""
)
def missing_severity(spark, sf_dir):
    found = wl.findings(spark, sf_dir)
    return views.missing_severity(found.counts, found.checks).withColumn(
        "missing_pct", r6("missing_pct")
    )


@query(
    """SELECT dataset_id, round(completeness, 6) AS completeness, round(validity, 6) AS validity,
    round(uniqueness, 6) AS uniqueness, round(quality_score, 6) AS quality_score
    FROM quality_trust"""
)
def quality_score(spark, sf_dir):
    scores = wl.findings(spark, sf_dir).scores
    return scores.select(
        "dataset_id",
        *[r6(f"quality.inputs.{p}").alias(p) for p in ("completeness", "validity", "uniqueness")],
        r6("quality.score").alias("quality_score"),
    )


@query(
    """SELECT dataset_id, round(type_share, 6) AS type_share,
    round(structural_penalty, 6) AS structural_penalty, round(consistency, 6) AS consistency,
    1e0 AS coverage, round(trust_score, 6) AS trust_score FROM quality_trust"""
)
def trust_score(spark, sf_dir):
    scores = wl.findings(spark, sf_dir).scores
    return scores.select(
        "dataset_id",
        r6("consistency_detail.mean_dominant_type_share").alias("type_share"),
        r6("consistency_detail.structural_penalty").alias("structural_penalty"),
        r6("trust.inputs.consistency").alias("consistency"),
        r6("trust.inputs.classification_coverage").alias("coverage"),
        r6("trust.score").alias("trust_score"),
    )


def flat_scores(df: DataFrame) -> DataFrame:
    return df.select(
        "dataset_id",
        *[r6(f"{s}.score").alias(f"{s}_score") for s in ("quality", "trust", "value")],
        "recommendation",
    )


_SCORES = """SELECT dataset_id, round(quality_score, 6) AS quality_score,
round(trust_score, 6) AS trust_score, round(value_score, 6) AS value_score, recommendation FROM {}"""


@query(_SCORES.format("scores"))
def dataset_scores(spark, sf_dir):
    return flat_scores(wl.findings(spark, sf_dir).scores)


@query(
    """SELECT dataset_id, accesses_90d, accesses_last30, accesses_prev30,
    round(coalesce(days_since_last_access, 0), 6) AS days_since_last_access, 50 AS freq_cap,
    30e0 AS half_life FROM scores"""
)
def value_breakdown_raw(spark, sf_dir):
    scores = wl.findings(spark, sf_dir).scores
    return scores.select("dataset_id", "value.raw.*").withColumn(
        "days_since_last_access", r6("days_since_last_access")
    )


@query(
    """SELECT dataset_id, lower(dataset_id) || ' — ' || row_count || ' rows × ' || column_count
    || ' cols. Quality ' || CAST(floor(quality_score + 0.5::DOUBLE) AS BIGINT) || ', Trust '
    || CAST(floor(trust_score + 0.5::DOUBLE) AS BIGINT) || ', Value '
    || CAST(floor(value_score + 0.5::DOUBLE) AS BIGINT) || ' (' || recommendation
    || '). Duplicate rows: ' || duplicate_row_count || '. Sensitive columns: ' || coalesce(n, 0)
    || coalesce(' (' || cats || ')', '') || '.' AS narrative
    FROM scores LEFT JOIN (
      SELECT dataset_id, CAST(sum(n) AS BIGINT) AS n,
             string_agg(category, ', ' ORDER BY position) AS cats
      FROM (SELECT dataset_id, category, min(position) AS position, count(*) AS n FROM tags
            WHERE sensitivity <> 'NONE' GROUP BY dataset_id, category) GROUP BY dataset_id)
    USING (dataset_id)"""
)
def narrative_summary(spark, sf_dir):
    found = wl.findings(spark, sf_dir)
    named = wl.manifest(spark, sf_dir).select("dataset_id", "name")
    return narrative(named, found.profile, found.tags, found.scores)


# --------------------------------------------------------------------------- catalogue
@query("SELECT dataset_id, pii_column_count, highest_sensitivity FROM pii")
def pii_rollup(spark, sf_dir):
    return cat.pii_rollup(wl.Catalog(spark, sf_dir).tags)


@query(
    """SELECT m.dataset_id, position, name, data_type, category, sensitivity FROM manifest m
    LEFT JOIN (SELECT c.*, category, sensitivity FROM ready_columns c
               LEFT JOIN ready_tags USING (dataset_id, position)) USING (dataset_id)"""
)
def dataset_columns(spark, sf_dir):
    c = wl.Catalog(spark, sf_dir)
    return cat.dataset_columns(c.listed, c.columns, c.tags).select(
        "dataset_id", "position", "name", "data_type", "category", "sensitivity"
    )


_SUMMARY = f"""SELECT dataset_id, name, original_filename, file_type, size_bytes, row_count,
column_count, status, round(quality_score, 6) AS quality_score, round(trust_score, 6) AS trust_score,
round(value_score, 6) AS value_score, recommendation, pii_column_count, highest_sensitivity,
{_SEC.format("last_accessed_at")} AS last_accessed_s, access_count, access_count_90d, error_message,
{_SEC.format("uploaded_at")} AS uploaded_s FROM summaries"""


def flat_summary(df: DataFrame) -> DataFrame:
    scores = ("quality_score", "trust_score", "value_score")
    return df.select(
        "dataset_id", "name", "original_filename", "file_type", "size_bytes", "row_count",
        "column_count", "status", *[r6(s).alias(s) for s in scores], "recommendation",
        "pii_column_count", "highest_sensitivity",
        seconds("last_accessed_at").alias("last_accessed_s"), "access_count", "access_count_90d",
        "error_message", seconds("uploaded_at").alias("uploaded_s"),
    )


@query(_SUMMARY + " ORDER BY quality_score DESC NULLS LAST, dataset_id LIMIT 20 OFFSET 20")
def catalog_list(spark, sf_dir):
    """The second page of the list, best quality first."""
    c = wl.Catalog(spark, sf_dir)
    return flat_summary(
        cat.catalog_page(
            c.datasets, c.tags, c.usage, wl.NOW, sort="-quality_score", limit=20, offset=20
        )
    )


@query(_SUMMARY)
def catalog_summaries(spark, sf_dir):
    c = wl.Catalog(spark, sf_dir)
    return flat_summary(cat.summaries(c.datasets, c.tags, c.usage, wl.NOW))


@query(
    """SELECT dataset_id, name, status, recommendation FROM datasets WHERE dataset_id IN
    (SELECT dataset_id FROM ready_tags WHERE sensitivity = 'MEDIUM')"""
)
def catalog_filter_sensitivity(spark, sf_dir):
    c = wl.Catalog(spark, sf_dir)
    return cat.by_sensitivity(c.datasets, c.tags, "MEDIUM").select(
        "dataset_id", "name", "status", "recommendation"
    )


@query(
    """SELECT dataset_id, name, status, recommendation FROM datasets
    WHERE recommendation = 'ARCHIVE'"""
)
def catalog_filter_recommendation(spark, sf_dir):
    c = wl.Catalog(spark, sf_dir)
    return cat.by_recommendation(c.datasets, "ARCHIVE").select(
        "dataset_id", "name", "status", "recommendation"
    )


_AVG = "coalesce(floor(avg({0}) * 10 + 0.5::DOUBLE) / 10, 0) AS avg_{1}"


@query(
    "SELECT count(*) AS total_datasets, "
    + ", ".join(_AVG.format(f"{s}_score", s) for s in ("quality", "trust", "value"))
    + ", CAST(sum(row_count) AS BIGINT) AS total_rows, CAST(sum(column_count) AS BIGINT) "
    "AS total_columns FROM datasets"
)
def overview_totals(spark, sf_dir):
    return cat.overview_totals(wl.Catalog(spark, sf_dir).datasets)


@query(sql.STATUS_COUNTS)
def overview_status(spark, sf_dir):
    return cat.status_counts(wl.Catalog(spark, sf_dir).listed)


@query(f"SELECT *, round(n / sum(n) OVER (), 6) AS share FROM ({sql.RECOMMENDATION_COUNTS})")
def overview_recommendations(spark, sf_dir):
    counts = cat.recommendation_counts(wl.Catalog(spark, sf_dir).datasets)
    return views.shares(counts).withColumn("share", r6("share"))


@query(f"SELECT *, round(n / sum(n) OVER (), 6) AS share FROM ({sql.SENSITIVITY_COUNTS})")
def overview_sensitivity(spark, sf_dir):
    counts = cat.sensitivity_counts(wl.Catalog(spark, sf_dir).tags)
    return views.shares(counts).withColumn("share", r6("share"))


@query(
    """SELECT dataset_id, name, recommendation, status FROM datasets
    WHERE status = 'FAILED' OR recommendation = 'RETIRE'
    ORDER BY uploaded_at DESC, dataset_id LIMIT 10"""
)
def needs_attention(spark, sf_dir):
    return cat.needs_attention(wl.Catalog(spark, sf_dir).datasets)


@query(
    f"""SELECT dataset_id, name, {_SEC.format("uploaded_at")} AS uploaded_s,
    round(quality_score, 6) AS quality_score
    FROM datasets ORDER BY uploaded_at DESC, dataset_id LIMIT 5"""
)
def recent_datasets(spark, sf_dir):
    return cat.recent_datasets(wl.Catalog(spark, sf_dir).datasets).select(
        "dataset_id", "name", seconds("uploaded_at").alias("uploaded_s"),
        r6("quality_score").alias("quality_score"),
    )


@query(
    """SELECT dataset_id, name, round(quality_score, 6) AS quality_score,
    round(value_score, 6) AS value_score FROM datasets
    WHERE status = 'READY' AND quality_score IS NOT NULL AND value_score IS NOT NULL
    ORDER BY datasets.quality_score DESC, dataset_id LIMIT 6"""
)
def top_quality_vs_value(spark, sf_dir):
    top = cat.top_quality_vs_value(wl.Catalog(spark, sf_dir).datasets)
    return top.withColumns({c: r6(c) for c in ("quality_score", "value_score")})


_BANDS = " UNION ALL ".join(
    f"""SELECT dataset_id, '{s}' AS score_name, round({s}_score, 6) AS score,
    CASE WHEN {s}_score < 25 THEN 0 WHEN {s}_score < 50 THEN 1 WHEN {s}_score < 75 THEN 2
         WHEN {s}_score < 90 THEN 3 ELSE 4 END AS band,
    CASE WHEN {s}_score >= 80 THEN 'Good' WHEN {s}_score >= 60 THEN 'Fair' ELSE 'Poor' END AS tier
    FROM scores"""
    for s in ("quality", "trust", "value")
)


@query(_BANDS)
def score_bands(spark, sf_dir):
    return views.score_bands(wl.findings(spark, sf_dir).scores).withColumn("score", r6("score"))


def _explain_all() -> str:
    s, rows = Settings(), []
    expressions = {"quality": "quality_score / 100", "classification_coverage": "1e0"}
    for block, weights in (("quality", s.quality), ("trust", s.trust), ("value", s.value)):
        for part, w in weights.items():
            x = expressions.get(part, part) if block == "trust" else part
            rows.append(
                f"SELECT dataset_id, '{block}' AS score_name, '{part}' AS input_name, "
                f"CAST(NULL AS VARCHAR) AS under, round({x}, 6) AS input, {w}::DOUBLE AS weight, "
                f"round(100 * {w}::DOUBLE * ({x}), 6) AS contribution FROM scores"
            )
    for part in ("completeness", "validity"):
        rows.append(
            f"SELECT dataset_id, 'trust', '{part}', 'quality', round({part}, 6), NULL, NULL "
            "FROM scores"
        )
    return " UNION ALL ".join(rows)


@query(_explain_all())
def score_explain(spark, sf_dir):
    return views.explain_rows(wl.findings(spark, sf_dir).scores).withColumns(
        {c: r6(c) for c in ("input", "contribution")}
    )


# --------------------------------------------------------------------------- maintenance
@query(
    """SELECT dataset_id, position, category, sensitivity, round(confidence, 6) AS confidence,
    source, overridden FROM overridden_tags"""
)
def override_tags(spark, sf_dir):
    c = wl.Catalog(spark, sf_dir)
    chosen = mt.valid_overrides(wl.override_requests(spark, sf_dir), c.columns)
    return mt.apply_overrides(c.tags, chosen).withColumn(
        "confidence", r6("confidence")
    )


@query(
    """SELECT dataset_id, round(quality_score, 6) AS quality_score, round(value_score, 6)
    AS value_score, round(coverage, 6) AS coverage,
    round(100 * 0.45::DOUBLE * quality_score / 100 + 100 * 0.3::DOUBLE * consistency
          + 100 * 0.25::DOUBLE * coverage, 6) AS trust_score
    FROM (SELECT s.*, coalesce(tagged, 0) / column_count::DOUBLE AS coverage FROM ready_scores s
          LEFT JOIN (SELECT dataset_id, count(category) AS tagged FROM overridden_given_tags
                     GROUP BY dataset_id) USING (dataset_id))"""
)
def override_trust(spark, sf_dir):
    """Some columns have no tag row yet; decisions about them raise the coverage."""
    c = wl.Catalog(spark, sf_dir)
    chosen = mt.valid_overrides(wl.override_requests(spark, sf_dir), c.columns)
    tags = mt.apply_overrides(c.tags.filter("position % 4 <> 3"), chosen)
    out = mt.retrust(c.scores, c.listed, tags)
    return out.select(
        "dataset_id", r6("quality.score").alias("quality_score"),
        r6("value.score").alias("value_score"),
        r6("trust.inputs.classification_coverage").alias("coverage"),
        r6("trust.score").alias("trust_score"),
    )


@query(
    """SELECT code, count(*) AS requests FROM (
    SELECT CASE WHEN category = 'NOT_A_CATEGORY' OR sensitivity = 'TOP' THEN 'validation_error'
                WHEN m.dataset_id IS NULL THEN 'dataset_not_found'
                WHEN c.dataset_id IS NULL THEN 'column_not_found' END AS code
    FROM override_requests r LEFT JOIN manifest m USING (dataset_id)
    LEFT JOIN ready_columns c ON c.dataset_id = r.dataset_id AND c.position = r.position)
    WHERE code IS NOT NULL GROUP BY code"""
)
def override_rejects(spark, sf_dir):
    c = wl.Catalog(spark, sf_dir)
    bad = mt.rejected_overrides(wl.override_requests(spark, sf_dir), c.listed, c.columns)
    return bad.groupBy("code").agg(F.count(F.lit(1)).alias("requests"))


@query(
    """SELECT dataset_id, round(quality_score, 6) AS quality_score,
    round(trust_score, 6) AS trust_score, round(value_score, 6) AS value_score, recommendation
    FROM other_quality JOIN other_value USING (dataset_id)
    WHERE dataset_id IN (SELECT dataset_id FROM ready)""",
    {
        "other_quality": sql.quality_trust(OTHER),
        "other_value": sql.value("SELECT * FROM profiled_windows", OTHER),
    },
)
def recompute_scores(spark, sf_dir):
    c = wl.Catalog(spark, sf_dir)
    return flat_scores(mt.recompute_scores(c.scores, c.usage, wl.NOW, OTHER))


_REMAP = (
    "CASE WHEN category IN ('EMAIL', 'NONE') THEN 'LOW' WHEN category = 'NAME' THEN 'HIGH' "
    "ELSE sensitivity END"
)


@query(
    f"""SELECT dataset_id, position, category, overridden,
    CASE WHEN overridden THEN sensitivity ELSE {_REMAP} END AS sensitivity,
    NOT overridden AND sensitivity <> {_REMAP} AS changed FROM overridden_tags"""
)
def remap_tags(spark, sf_dir):
    c = wl.Catalog(spark, sf_dir)
    chosen = mt.valid_overrides(wl.override_requests(spark, sf_dir), c.columns)
    tags = mt.apply_overrides(c.tags, chosen)
    return mt.remap_tags(tags, OTHER).select(
        "dataset_id", "position", "category", "overridden", "sensitivity", "changed"
    )


@query(
    f"""SELECT count(*) FILTER (WHERE quality_score IS NOT NULL) AS updated,
    count(*) FILTER (WHERE quality_score IS NULL) AS skipped,
    (SELECT count(*) FROM ready_tags WHERE sensitivity <> {_REMAP}) AS tags_updated FROM datasets"""
)
def recompute_counts(spark, sf_dir):
    c = wl.Catalog(spark, sf_dir)
    return mt.recompute_counts(c.datasets, c.scores, mt.remap_tags(c.tags, OTHER))


def _settings_oracle() -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in Settings().as_json().items())
    return f"""
    SELECT key, CASE WHEN live THEN json_value ELSE fallback END AS value, live AS overridden,
           CASE WHEN live THEN {_SEC.format("updated_at")} END AS updated_s
    FROM (SELECT d.key, fallback, json_value, updated_at,
                 coalesce(json_value IS NOT NULL AND (reset_at IS NULL OR updated_at > reset_at),
                          false) AS live
          FROM (VALUES {rows}) d(key, fallback)
          LEFT JOIN (SELECT key, json_value, updated_at FROM (
                SELECT *, row_number() OVER (PARTITION BY key ORDER BY updated_at DESC,
                          json_value DESC NULLS LAST) AS rn FROM settings_log) WHERE rn = 1) l
          USING (key), (SELECT max(updated_at) AS reset_at FROM settings_log WHERE key = '*'))"""


@query(_settings_oracle())
def settings_effective(spark, sf_dir):
    return mt.effective_settings(wl.settings_log(spark, sf_dir)).select(
        "key", "value", "overridden", seconds("updated_at").alias("updated_s")
    )


SNAPSHOT_TIMES = ("1998-01-01", "1998-04-01", "1998-07-01")
_SNAPSHOTS = " UNION ALL ".join(
    f"SELECT dataset_id, '{t}' AS captured, round(quality_score, 6) AS quality_score, "
    f"round(trust_score, 6) AS trust_score, round(v{i}.value_score, 6) AS value_score "
    f"FROM ready_quality JOIN v{i} USING (dataset_id)"
    for i, t in enumerate(SNAPSHOT_TIMES)
)


@query(
    _SNAPSHOTS,
    {
        "ready_quality": "SELECT dataset_id, quality_score, trust_score FROM quality_trust "
        "WHERE dataset_id IN (SELECT dataset_id FROM ready)",
        **{
            f"w{i}": sql.windows("profiled", f"l{i}", f"TIMESTAMP '{t} 00:00:00'")
            for i, t in enumerate(SNAPSHOT_TIMES)
        },
        **{
            f"l{i}": f"SELECT * FROM access_log WHERE occurred_at <= TIMESTAMP '{t} 00:00:00'"
            for i, t in enumerate(SNAPSHOT_TIMES)
        },
        **{f"v{i}": sql.value(f"SELECT * FROM w{i}") for i, _ in enumerate(SNAPSHOT_TIMES)},
    },
)
def score_snapshots(spark, sf_dir):
    """The score history at three instants, with Value as it was then."""
    c = wl.Catalog(spark, sf_dir)
    return mt.value_history(c.scores, c.events, list(SNAPSHOT_TIMES)).select(
        "dataset_id",
        F.date_format("captured_at", "yyyy-MM-dd").alias("captured"),
        *[r6(s).alias(s) for s in ("quality_score", "trust_score", "value_score")],
    )


_DELETED = ["building-3", "furniture-12", "customers-machinery", "no-such-name"]


@query(
    f"""SELECT 'datasets' AS table_name, count(*) AS n FROM datasets
    WHERE name NOT IN {tuple(_DELETED)}
    UNION ALL SELECT 'columns', count(*) FROM ready_columns
    WHERE lower(dataset_id) NOT IN {tuple(_DELETED)}
    UNION ALL SELECT 'tags', count(*) FROM ready_tags
    WHERE lower(dataset_id) NOT IN {tuple(_DELETED)}
    UNION ALL SELECT 'access_events', count(*) FROM access_log
    WHERE lower(dataset_id) NOT IN {tuple(_DELETED)}"""
)
def delete_cascade(spark, sf_dir):
    c = wl.Catalog(spark, sf_dir)
    gone = mt.tombstones_by_name(c.listed, _DELETED, wl.NOW)
    tables = {
        "datasets": c.datasets, "columns": c.columns, "tags": c.tags, "access_events": c.events,
    }
    return union_all(
        [
            mt.without_deleted(df, gone).agg(F.count(F.lit(1)).alias("n")).select(
                F.lit(name).alias("table_name"), "n"
            )
            for name, df in tables.items()
        ]
    )


@query(
    _PROFILE.format("column_profile")
    + """ WHERE dataset_id = (SELECT dataset_id FROM access_log GROUP BY dataset_id
    ORDER BY count(*) DESC, dataset_id LIMIT 1)"""
)
def reprofile_one(spark, sf_dir):
    """A fresh profile of the most used dataset, found from the whole log."""
    usage = access_rollup(wl.access_log(spark, sf_dir), wl.NOW)
    busiest = usage.orderBy(F.col("access_count").desc(), "dataset_id").limit(1)
    t = wl.text_tables(spark, sf_dir)
    one = busiest.select("dataset_id")
    return flat_profile(
        column_profile(
            t.freq.join(one, "dataset_id", "left_semi"),
            t.headers.join(one, "dataset_id", "left_semi"),
        )
    )


# --------------------------------------------------------------------------- csv
CSV_KEYS = 20_000  # order keys of a file


def _write_csv(spark: SparkSession, sf_dir: str) -> str:
    """The dirty orders as CSV files of a range of keys each, so more rows make more files.

    MACHINERY has rows with a field too many, HOUSEHOLD quoted line breaks, and each FURNITURE
    file one quote that never closes.
    """
    folder = new_run_dir(spark, "csv")
    rows = wl.dirty_orders(spark, sf_dir).selectExpr(
        "split(dataset_id, '-')[0] AS segment", f"ord DIV {CSV_KEYS} AS file_no", "*"
    )
    stray = (
        rows.filter("segment = 'FURNITURE' AND ord % 50 <> 0")
        .groupBy("segment", "file_no")
        .agg(F.expr("min(ord) AS ord"))
        .selectExpr("segment", "file_no", "ord", "true AS stray")
    )
    cells = {c: f"coalesce({c}, '')" for c in wl.ORDER_COLUMNS}
    cells["status"] = (
        "CASE WHEN stray THEN concat('\"', status) "
        "WHEN segment = 'MACHINERY' AND ord % 10 < 2 THEN concat(status, ',extra') "
        "ELSE status END"
    )
    cells["notes"] = (
        "CASE WHEN segment = 'HOUSEHOLD' AND ord % 10 < 2 "
        "THEN concat('\"first line', char(10), 'second, line\"') ELSE '' END"
    )
    lines = rows.join(stray, ["segment", "file_no", "ord"], "left").selectExpr(
        "segment", "file_no", "1 AS rank", f"concat_ws(',', {', '.join(cells.values())}) AS line"
    )
    heads = rows.select("segment", "file_no").distinct().selectExpr(
        "segment", "file_no", "0 AS rank", f"'{','.join(wl.ORDER_COLUMNS)}' AS line"
    )
    tasks = 1 + read_table(spark, sf_dir, "orders").count() // ROWS_A_TASK
    (
        lines.unionByName(heads)
        .repartition(tasks, "segment", "file_no")
        .sortWithinPartitions("segment", "file_no", "rank")
        .select("segment", "file_no", "line")
        .write.partitionBy("segment", "file_no")
        .option("compression", "none")
        .text(f"{folder}/lines")
    )
    return f"{folder}/lines"


@query(
    """SELECT segment, CASE segment WHEN 'FURNITURE' THEN 'invalid_file' WHEN 'MACHINERY'
    THEN 'ragged' END AS code, CASE WHEN segment = 'FURNITURE' THEN 0 ELSE count(*) END AS row_count,
    CASE WHEN segment = 'FURNITURE' THEN 0 ELSE 9 END AS columns,
    CASE WHEN segment IN ('FURNITURE', 'MACHINERY') THEN 0
         ELSE count(*) FILTER (WHERE customer_email IS NULL OR customer_email = '') END
      AS missing_emails,
    CASE WHEN segment = 'HOUSEHOLD' THEN count(*) FILTER (WHERE ord % 10 < 2) ELSE 0 END AS notes,
    CASE WHEN segment IN ('FURNITURE', 'MACHINERY') THEN 0 ELSE count(DISTINCT phone) END AS phones
    FROM (SELECT *, split_part(dataset_id, '-', 1) AS segment FROM dirty_orders) GROUP BY segment"""
)
def csv_intake(spark, sf_dir):
    """CSV files written and read back: rejects, ragged files, and profiles per folder."""
    folder = _write_csv(spark, sf_dir)
    intake = read_csv_folder(spark, folder, suffixes=(".csv", ".txt"))
    found = intake.manifest.selectExpr(
        "file_id AS dataset_id",
        "regexp_extract(file_id, 'segment=([A-Z]+)', 1) AS segment",
        "code",
        "coalesce(size(headers), 0) AS columns",
    ).join(intake.shape(), "dataset_id", "left").selectExpr(
        "dataset_id",
        "segment",
        "coalesce(code, CASE WHEN ragged_rows > 0 THEN 'ragged' END) AS code",
        "coalesce(row_count, 0L) AS row_count",
        "columns",
    )
    # A row a file, written: its size is known then, and the cells need not be sorted to meet it.
    path = new_run_dir(spark, "csv-files")
    found.write.parquet(path)
    files = spark.read.schema(found.schema).parquet(path)
    per_segment = files.groupBy("segment").agg(
        F.expr("max(code) AS code"),
        F.expr("sum(row_count) AS row_count"),
        F.expr("max(columns) AS columns"),
    )
    good = files.filter("code IS NULL").select("dataset_id", "segment")
    cells = intake.cells().join(good, "dataset_id").selectExpr(
        "segment AS dataset_id", "position", "value"
    )
    profile = column_counts(value_freq(cells)).groupBy("dataset_id").agg(
        F.expr("max(CASE WHEN position = 1 THEN row_count - non_null_count END) AS missing_emails"),
        F.expr("max(CASE WHEN position = 8 THEN non_null_count END) AS notes"),
        F.expr("max(CASE WHEN position = 6 THEN distinct_count END) AS phones"),
    )
    return per_segment.join(
        profile.withColumnRenamed("dataset_id", "segment"), "segment", "left"
    ).selectExpr(
        "segment", "code", "row_count", "columns",
        *[f"coalesce({c}, 0L) AS {c}" for c in ("missing_emails", "notes", "phones")],
    )


# --------------------------------------------------------------------------- streams
STREAM_DELAY = "30 days"


EVENTS_A_FILE = 1_000_000


def _stream_files(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """All orders as event files, equally many a year, written year by year.

    Every 40th event comes twice. Every 500th comes three years late, if the log lasts that long: by
    then the watermark has passed it.
    """
    folder = new_run_dir(spark, "events")
    log = wl.access_log(spark, sf_dir).withColumn("year", F.year("occurred_at"))
    years = sorted(r["year"] for r in log.select("year").distinct().collect())  # a handful
    files = 1 + log.count() // (EVENTS_A_FILE * max(1, len(years)))
    late = f"event_id % 500 = 0 AND year + 3 <= {years[-1]}" if years else "false"
    rows = log.selectExpr(
        "event_id", "dataset_id", "access_type", "'LIVE' AS source", "occurred_at",
        f"CASE WHEN {late} THEN year + 3 ELSE year END AS file",
        "explode(CASE WHEN event_id % 40 = 0 THEN array(0, 1) ELSE array(0) END) AS copy",
    ).drop("copy")
    for year in years:
        rows.filter(f"file = {year}").drop("file").repartition(files).write.parquet(f"{folder}/year={year}")
    return folder, files


def _event_stream(spark: SparkSession, folder: str, files: int) -> DataFrame:
    """A batch for each year of files."""
    return stream.access_stream(spark, folder, STREAM_SCHEMA, files_per_batch=files)


STREAM_SCHEMA = (
    "event_id bigint, dataset_id string, access_type string, source string, occurred_at timestamp"
)
_IN_TIME = (
    "SELECT * FROM access_log WHERE NOT (event_id % 500 = 0 AND year(occurred_at) + 3 <= "
    "(SELECT max(year(occurred_at)) FROM access_log))"
)


@query(
    """SELECT dataset_id, strftime(occurred_at, '%Y-%m-%d') AS date, access_type,
    CAST(sum(CASE WHEN event_id % 40 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n
    FROM in_time GROUP BY ALL""",
    {"in_time": _IN_TIME},
)
def stream_daily_usage(spark, sf_dir):
    """Running counts over a file a year; late events are dropped, repeats counted as they come."""
    work = new_run_dir(spark, "daily")
    stream.start_daily_usage(
        _event_stream(spark, *_stream_files(spark, sf_dir)), f"{work}/counts", f"{work}/checkpoint",
        available_now=True, delay=STREAM_DELAY, unit="month",
    ).awaitTermination()
    return stream.read_daily_usage(spark, f"{work}/counts").withColumn("date", day_text("date"))


@query(
    """SELECT dataset_id, access_type, count(*) AS n, min(strftime(occurred_at, '%Y-%m-%d'))
    AS first_day FROM in_time WHERE dataset_id IN (SELECT dataset_id FROM ready)
    GROUP BY dataset_id, access_type""",
    {"in_time": _IN_TIME},
)
def stream_intake(spark, sf_dir):
    """Events of READY datasets, deduplicated by id within a watermark, appended to the log."""
    work = new_run_dir(spark, "intake")
    store = CatalogStore(spark, f"{work}/store", log_unit="month")
    events = stream.deduplicated(_event_stream(spark, *_stream_files(spark, sf_dir)), STREAM_DELAY)
    listed = wl.Catalog(spark, sf_dir).listed
    stream.start_intake(
        events, store, f"{work}/checkpoint", available_now=True, datasets=lambda: listed
    ).awaitTermination()
    return store.access_events().groupBy("dataset_id", "access_type").agg(
        F.expr("count(1) AS n"), F.expr("date_format(min(occurred_at), 'yyyy-MM-dd') AS first_day")
    )


@query(
    """SELECT dataset_id, round(quality_score, 6) AS quality_score,
    round(trust_score, 6) AS trust_score, round(sv.value_score, 6) AS value_score,
    sv.recommendation FROM ready_scores JOIN stream_value_scores sv USING (dataset_id)""",
    {
        "in_time": _IN_TIME,
        "stream_windows": sql.windows("profiled", "in_time", sql.NOW),
        "stream_value_scores": sql.value("SELECT * FROM stream_windows"),
    },
)
def stream_value(spark, sf_dir):
    """Scores and recommendations of the store after the stream: Value of every touched dataset is
    written back, the others keep theirs."""
    store = wl.Catalog(spark, sf_dir).copy(events=False)
    now = datetime(1998, 7, 1, tzinfo=timezone.utc)
    events = stream.deduplicated(_event_stream(spark, *_stream_files(spark, sf_dir)), STREAM_DELAY)
    work = new_run_dir(spark, "value")
    stream.start_value(
        events, store, lambda: store.read("dataset_scores"), lambda: now, f"{work}/checkpoint",
        available_now=True,
    ).awaitTermination()
    return flat_scores(store.read("dataset_scores"))


AGEING_DAYS = 30


@query(
    f"""SELECT dataset_id, strftime(captured_at, '%Y-%m-%d') AS date, accesses_90d, accesses_last30,
    accesses_prev30, round(value_score, 6) AS value_score, recommendation FROM aged_values""",
    {
        "in_time": _IN_TIME,
        "instants": f"SELECT TIMESTAMP '1970-01-01' + to_days(CAST(k * {AGEING_DAYS} AS INTEGER)) AS captured_at "
        f"FROM range(20000 // {AGEING_DAYS}) r(k)",
        "bounds": "SELECT dataset_id, captured_at FROM (SELECT DISTINCT dataset_id FROM in_time), instants "
        f"WHERE captured_at <= {sql.NOW}",
        "aged_all": """SELECT dataset_id, captured_at,
          count(*) FILTER (occurred_at > captured_at - INTERVAL 90 DAY) AS accesses_90d,
          count(*) FILTER (occurred_at > captured_at - INTERVAL 30 DAY) AS accesses_last30,
          count(*) FILTER (occurred_at > captured_at - INTERVAL 60 DAY AND occurred_at <= captured_at - INTERVAL 30 DAY)
            AS accesses_prev30,
          max(occurred_at) AS last_accessed_at,
          (epoch_us(captured_at) - epoch_us(max(occurred_at))) / 86400e6 AS days_since_last_access
          FROM bounds JOIN in_time USING (dataset_id) WHERE occurred_at <= captured_at GROUP BY dataset_id, captured_at""",
        "aged": "SELECT * FROM (SELECT *, lag(accesses_90d) OVER (PARTITION BY dataset_id ORDER BY captured_at) "
        "AS earlier FROM aged_all) WHERE accesses_90d > 0 OR earlier > 0",
        "aged_values": sql.value("SELECT * FROM aged"),
    },
)
def stream_value_ageing(spark, sf_dir):
    """Value of every dataset at every 30th midnight, as the watermark passes it; datasets age and
    retire without events of their own."""
    work = new_run_dir(spark, "ageing")
    folder, files = _stream_files(spark, sf_dir)
    # Heartbeats as the last file: the clock goes on to noon of the day before the last instant's
    # watermark, so that all instants up to NOW have passed.
    spark.range(1, numPartitions=1).selectExpr(
        "CAST(NULL AS BIGINT) AS event_id", "CAST(NULL AS STRING) AS dataset_id", "CAST(NULL AS STRING) AS access_type",
        "'LIVE' AS source", "TIMESTAMP'1998-07-01 12:00:00Z' + INTERVAL 30 DAYS AS occurred_at",
    ).write.parquet(f"{folder}/year=heartbeat")
    events = stream.deduplicated(_event_stream(spark, folder, files), STREAM_DELAY)
    store = CatalogStore(spark, f"{work}/store")
    stream.start_ageing_value(events, store, f"{work}/checkpoint", every_days=AGEING_DAYS, available_now=True).awaitTermination()
    return store.log("value_log").select(
        "dataset_id", F.date_format("captured_at", "yyyy-MM-dd").alias("date"),
        *[F.col(f"value.raw.{c}").alias(c) for c in ("accesses_90d", "accesses_last30", "accesses_prev30")],
        r6("value.score").alias("value_score"), "recommendation",
    ).filter(f"date <= '{wl.NOW[:10]}'")


# --------------------------------------------------------------------------- more of the catalogue
@query(
    """SELECT 'datasets' AS table_name, count(*) AS n FROM manifest
    UNION ALL SELECT 'columns', count(*) FROM ready_columns
    UNION ALL SELECT 'tags', count(*) FROM ready_tags
    UNION ALL SELECT 'dataset_scores', count(*) FROM ready_scores
    UNION ALL SELECT 'access_events', count(*) FROM access_log"""
)
def catalog_publish(spark, sf_dir):
    """A catalogue analysed, published and read back."""
    store = wl.publish_catalog(spark, sf_dir)
    tables = {t: store.read(t) for t in ("datasets", "columns", "tags", "dataset_scores")}
    return _sizes(tables | {"access_events": store.access_events()})


def _sizes(tables: dict[str, DataFrame]) -> DataFrame:
    return union_all(
        [
            df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
            for name, df in tables.items()
        ]
    )


@query(
    """SELECT 'before' AS step, count(*) AS datasets,
    (SELECT count(*) FROM ready_tags) AS tags FROM manifest
    UNION ALL SELECT 'republished', count(*), (SELECT count(*) FROM ready_tags) FROM manifest
    UNION ALL SELECT 'deleted', 0, 0
    UNION ALL SELECT 'again', count(*), (SELECT count(*) FROM ready_tags WHERE dataset_id IN
      (SELECT dataset_id FROM manifest WHERE name_starts)) FROM manifest WHERE name_starts""",
    {"manifest": sql.CTES["manifest"].replace("SELECT dataset_id, count(*) +", "SELECT dataset_id, "
     "dataset_id LIKE 'B%' AS name_starts, count(*) +").replace("SELECT 'customers-' || c_mktsegment,",
     "SELECT 'customers-' || c_mktsegment, false,")},
)
def store_round_trip(spark, sf_dir):
    """Published, published again, deleted altogether, and some datasets published once more."""
    c = wl.Catalog(spark, sf_dir)
    store = c.copy()
    states = []

    def note(step: str) -> None:
        counts = store.read("datasets").agg(F.count(F.lit(1)).alias("datasets")).crossJoin(
            store.read("tags").agg(F.count(F.lit(1)).alias("tags"))
        )  # two single rows
        path = new_run_dir(spark, "round-trip")
        counts.select(F.lit(step).alias("step"), "datasets", "tags").write.parquet(path)
        states.append(spark.read.parquet(path))

    def again(condition: str, at: str) -> None:
        run = f"run-{at[:10]}"
        some = c.listed.filter(condition)
        store.write("datasets", some, run)
        store.write("tags", c.tags.join(some.select("dataset_id"), "dataset_id", "left_semi"), run)
        store.publish(run, some, at, ("datasets", "tags"))

    note("before")
    again("true", "1998-07-02T00:00:00Z")
    note("republished")
    store.delete_all("1998-07-03T00:00:00Z")
    note("deleted")
    again("dataset_id LIKE 'B%'", "1998-07-04T00:00:00Z")
    note("again")
    return union_all(states)


@query(
    """SELECT dataset_id, round(quality_score, 6) AS quality_score, round(coverage, 6) AS coverage,
    round(100 * 0.45::DOUBLE * quality_score / 100 + 100 * 0.3::DOUBLE * consistency
          + 100 * 0.25::DOUBLE * coverage, 6) AS trust_score, manual
    FROM (SELECT s.*, tagged / column_count::DOUBLE AS coverage, manual FROM ready_scores s
          JOIN (SELECT dataset_id, count(category) AS tagged,
                       count(*) FILTER (WHERE overridden) AS manual FROM overridden_tags
                GROUP BY dataset_id) USING (dataset_id))"""
)
def override_publish(spark, sf_dir):
    """Logged overrides applied and published by the store, read back from it."""
    store = wl.Catalog(spark, sf_dir).copy()
    store.append("tag_overrides", wl.override_requests(spark, sf_dir), batch="first")
    store.apply_logged_overrides("1998-07-02T00:00:00Z")
    manual = store.read("tags").groupBy("dataset_id").agg(F.count_if("overridden").alias("manual"))
    return store.read("dataset_scores").join(manual, "dataset_id").select(
        "dataset_id", r6("quality.score").alias("quality_score"),
        r6("trust.inputs.classification_coverage").alias("coverage"),
        r6("trust.score").alias("trust_score"), "manual",
    )


@query(
    f"""SELECT dataset_id, round(quality_score, 6) AS quality_score,
    round(trust_score, 6) AS trust_score, round(value_score, 6) AS value_score, recommendation,
    moved FROM other_quality JOIN other_value USING (dataset_id) JOIN (
      SELECT dataset_id, count(*) FILTER (WHERE category IN ('EMAIL', 'NONE', 'NAME')) AS moved
      FROM ready_tags GROUP BY dataset_id) USING (dataset_id)""",
    {
        "other_quality": sql.quality_trust(OTHER),
        "other_value": sql.value("SELECT * FROM profiled_windows", OTHER),
    },
)
def rescore_publish(spark, sf_dir):
    """Settings logged, one bad entry among them, then all scores and tags published again."""
    c = wl.Catalog(spark, sf_dir)
    store = c.copy()
    given = {k: v for k, v in OTHER.as_json().items() if v != Settings().as_json()[k]}
    rows = [(k, v, datetime(1998, 7, 1)) for k, v in given.items()]
    rows.append(("trust", '{"quality": 7}', datetime(1998, 7, 2)))
    rows.append(("freq_cap", "many", datetime(1998, 7, 2)))
    store.append("settings_log", spark.createDataFrame(rows, "key string, json_value string, updated_at timestamp"))
    store.rescore(wl.NOW, "run-rescored")
    before = c.tags.select("dataset_id", "position", F.col("sensitivity").alias("old"))
    moved = store.read("tags").join(before, ["dataset_id", "position"]).groupBy("dataset_id").agg(
        F.count_if(F.col("sensitivity") != F.col("old")).alias("moved")
    )
    return flat_scores(store.read("dataset_scores")).join(moved, "dataset_id")


@query(
    f"""SELECT recommendation, sensitivity, count(*) AS total FROM datasets
    JOIN (SELECT DISTINCT dataset_id, sensitivity FROM ready_tags) USING (dataset_id)
    WHERE recommendation IN ('ARCHIVE', 'RETIRE') AND sensitivity IN ('HIGH', 'MEDIUM')
    GROUP BY recommendation, sensitivity"""
)
def catalog_total(spark, sf_dir):
    """The total beside a page, for filters on recommendation and sensitivity together."""
    c = wl.Catalog(spark, sf_dir)
    parts = []
    for recommendation in ("ARCHIVE", "RETIRE"):
        for level in ("HIGH", "MEDIUM"):
            found = cat.matching(c.datasets, c.tags, level, recommendation)
            parts.append(
                found.agg(F.count(F.lit(1)).alias("total")).select(
                    F.lit(recommendation).alias("recommendation"), F.lit(level).alias("sensitivity"), "total"
                )
            )
    return union_all(parts).where("total > 0")


_SORTS = " UNION ALL ".join(
    f"SELECT '{sign}{key}' AS sort, CAST(row_number() OVER (ORDER BY {key} "
    f"{'DESC' if sign else 'ASC'} NULLS LAST, dataset_id) AS INTEGER) AS place, dataset_id FROM datasets"
    for key in cat.SORT_KEYS
    for sign in ("", "-")
)


@query(f"SELECT * FROM ({_SORTS}) WHERE place <= 10")
def catalog_sorts(spark, sf_dir):
    """The first ten datasets in each of the twelve orders."""
    c = wl.Catalog(spark, sf_dir)
    parts = []
    for key in cat.SORT_KEYS:
        for sign in ("", "-"):
            top = cat.sorted_catalog(c.datasets, sign + key).limit(10)
            ranked = top.select(key, "dataset_id").selectExpr(
                "dataset_id",
                f"row_number() OVER (ORDER BY {key} {'DESC' if sign else 'ASC'} NULLS LAST, dataset_id) AS place",
            )
            parts.append(ranked.select(F.lit(sign + key).alias("sort"), "place", "dataset_id"))
    return union_all(parts)


_PAGE, _PAGES = 7, 3


@query(f"SELECT * FROM ({_SORTS}) WHERE place > {_PAGE * (_PAGES - 1)} AND place <= {_PAGE * _PAGES}")
def catalog_keyset(spark, sf_dir):
    """The third page of each of the twelve orders, reached by the last row of the one before."""
    c = wl.Catalog(spark, sf_dir)
    parts = []
    for key in cat.SORT_KEYS:
        for sign in ("", "-"):
            after, sort = None, sign + key
            for _ in range(_PAGES - 1):
                page = cat.sorted_catalog(cat.beyond(c.datasets, sort, after), sort).limit(_PAGE)
                after = cat.cursor_of(page.select(key, "dataset_id").collect()[-1], sort)
            page = cat.catalog_page_after(c.datasets, c.tags, c.usage, wl.NOW, sort, after, limit=_PAGE)
            ranked = page.select(key, "dataset_id").selectExpr(
                "dataset_id",
                f"{_PAGE * (_PAGES - 1)} + row_number() OVER (ORDER BY {key} {'DESC' if sign else 'ASC'} NULLS LAST, "
                "dataset_id) AS place",
            )
            parts.append(ranked.select(F.lit(sort).alias("sort"), "place", "dataset_id"))
    return union_all(parts)


@query(
    """SELECT 'column' AS part, dataset_id, CAST(row_number() OVER (ORDER BY position) AS INTEGER)
    AS place, name AS what FROM ready_columns WHERE dataset_id = 'customers-BUILDING'
    UNION ALL SELECT 'check', dataset_id, CAST(row_number() OVER (ORDER BY position NULLS LAST,
    check_type) AS INTEGER), check_type FROM checks WHERE dataset_id = 'customers-BUILDING'
    UNION ALL SELECT 'check of a column', dataset_id, CAST(row_number() OVER (ORDER BY check_type)
    AS INTEGER), check_type FROM checks WHERE dataset_id = 'customers-BUILDING' AND position = 3"""
)
def dataset_detail(spark, sf_dir):
    """Columns and findings of one dataset in their order, and the findings of one column."""
    c = wl.Catalog(spark, sf_dir)
    one = "customers-BUILDING"
    found = cat.detail(one, c.datasets, c.columns, c.tags, c.checks, c.usage, wl.NOW)

    def placed(part: str, rows: DataFrame, what: str, order: str) -> DataFrame:
        return rows.selectExpr(
            f"'{part}' AS part", "dataset_id", f"row_number() OVER (ORDER BY {order}) AS place", f"{what} AS what"
        )

    return union_all(
        [
            placed("column", found["columns"], "name", "position"),
            placed("check", found["checks"], "check_type", "position NULLS LAST, check_type"),
            placed("check of a column", cat.checks_of_column(c.checks, one, 3), "check_type", "check_type"),
        ]
    )


@query(
    """SELECT dataset_id, round(tagged / column_count::DOUBLE, 6) AS coverage,
    round(100 * 0.45::DOUBLE * quality_score / 100 + 100 * 0.3::DOUBLE * consistency
          + 100 * 0.25::DOUBLE * (tagged / column_count::DOUBLE), 6) AS trust_score
    FROM quality_trust JOIN (SELECT dataset_id, count(*) AS tagged FROM tags WHERE position % 4 <> 3
                             GROUP BY dataset_id) USING (dataset_id)"""
)
def trust_coverage(spark, sf_dir):
    """Trust where some columns carry no tag."""
    found = wl.findings(spark, sf_dir)
    parts = profile_scores(found.counts, found.profile, found.tags.filter("position % 4 <> 3"))
    return parts.select(
        "dataset_id", r6("trust.inputs.classification_coverage").alias("coverage"),
        r6("trust.score").alias("trust_score"),
    )


@query(_SUMMARY)
def catalog_export(spark, sf_dir):
    """The catalogue exported as JSON lines and read back, whole rows."""
    c = wl.Catalog(spark, sf_dir)
    path = new_run_dir(spark, "export")
    rows = cat.summaries(c.datasets, c.tags, c.usage, wl.NOW)
    export_catalog(rows, path)
    return flat_summary(spark.read.schema(rows.schema).json(path))


@query(
    _histogram("special"),
    {
        "special": "SELECT 'lineitem' AS dataset_id, 0 AS position, l_quantity AS x, count(*) AS n "
        "FROM lineitem WHERE l_linenumber <> 7 AND l_quantity IS NOT NULL GROUP BY l_quantity",
        "num_stats": _STATS.format("special"),
    },
)
def numeric_histogram_special(spark, sf_dir):
    """Infinite and undefined numbers are left out; dates and texts of no number have no histogram."""
    df = read_table(spark, sf_dir, "lineitem").selectExpr(
        "'lineitem' AS dataset_id",
        "CASE WHEN l_linenumber = 7 THEN CASE WHEN l_orderkey % 2 = 0 THEN double('Infinity') "
        "ELSE double('NaN') END ELSE l_quantity END AS quantity",
        "CAST(l_shipdate AS DATE) AS shipped", "l_returnflag = 'R' AS returned", "l_shipdate AS at",
    )
    freqs = [f for _, f in typed_value_freq(df, df.columns[1:], "dataset_id")]
    return flat_histogram(union_all([views.numeric_histogram(f) for f in freqs]))


@query(
    f"""SELECT c_nationkey AS nation, c_custkey // {CSV_KEYS} AS file_no,
    CASE c_nationkey % 5 WHEN 0 THEN 'unsupported_file_type'
    WHEN 1 THEN 'empty_file' WHEN 2 THEN 'invalid_file' END AS code,
    CASE c_nationkey % 5 WHEN 0 THEN 'Only .csv files can be read; save other formats as CSV.'
    WHEN 1 THEN 'File is empty or has no data rows.' WHEN 2 THEN 'File has an unterminated quote.'
    END AS message,
    CASE WHEN c_nationkey % 5 > 2 THEN 3 ELSE 0 END AS columns,
    CASE WHEN c_nationkey % 5 > 2 THEN count(*) ELSE 0 END AS row_count,
    CASE WHEN c_nationkey % 5 > 2 THEN count(DISTINCT c_name) ELSE 0 END AS names
    FROM customer GROUP BY c_nationkey, c_custkey // {CSV_KEYS}"""
)
def csv_rejects(spark, sf_dir):
    """The customers of a nation and a range of keys as a file each: another type, only a header, an
    open quote, NUL characters in the cells, or quoted line breaks and inch marks."""
    folder = new_run_dir(spark, "nations")
    key = ["nation", "file_no"]
    rows = read_table(spark, sf_dir, "customer").selectExpr(
        "c_nationkey AS nation", f"c_custkey DIV {CSV_KEYS} AS file_no", "c_custkey AS ord", "c_name"
    )
    first = rows.groupBy(*key).agg(F.min("ord").alias("first"))
    lines = rows.join(first, key).selectExpr(
        *key, "ord",
        "CASE nation % 5 WHEN 2 THEN concat(ord, ',', c_name, CASE WHEN ord = first THEN ',\"open' ELSE ',x' END) "
        "WHEN 3 THEN concat(ord, ',', char(0), c_name, char(0), ',') "
        "ELSE concat(ord, ',\"', c_name, '\",\"a ', char(10), ' \"\"b\"\"\"') END AS line",
    )
    heads = first.selectExpr(*key, "CAST(-1 AS BIGINT) AS ord", "'key,name,note' AS line")
    plain = lines.filter("nation % 5 <> 1").unionByName(heads).repartition(*key).sortWithinPartitions(*key, "ord")
    texts = plain.filter("nation % 5 <> 0").select(*key, "line").write.partitionBy(*key)
    texts.option("compression", "none").text(folder)
    plain.filter("nation % 5 = 0").select(*key, "line").write.mode("append").partitionBy(*key).json(folder)
    intake = read_csv_folder(spark, folder, suffixes=(".csv", ".txt"))
    listed = intake.manifest.filter("file_name LIKE 'part-%'").selectExpr(
        "file_id AS dataset_id", *_FILE_KEY, "code", "message", "coalesce(size(headers), 0) AS columns",
    )
    found = intake.rows.groupBy("dataset_id").agg(
        F.expr("count(1) AS row_count"), F.expr("count(DISTINCT cells[1]) AS names")
    )
    return listed.join(found, "dataset_id", "left").selectExpr(
        *key, "code", "message", "columns", "coalesce(row_count, 0L) AS row_count", "coalesce(names, 0L) AS names"
    )


_FILE_KEY = (
    "CAST(regexp_extract(file_id, 'nation=([0-9]+)', 1) AS INT) AS nation",
    "CAST(regexp_extract(file_id, 'file_no=([0-9]+)', 1) AS BIGINT) AS file_no",
)
#: Of `csv_names`; every 20th supplier goes to another file, so that some files are small.
_SIZE_CAP = 60
_SUPPLIER_FILES = f"CASE WHEN s_suppkey {{mod}} 20 = 0 THEN 0 ELSE 1 + s_suppkey {{div}} {CSV_KEYS} END"


@query(
    f"""SELECT nation, file_no, code, CASE WHEN code IS NULL THEN CASE nation % 3 WHEN 0 THEN 'Nation ' || nation
    ELSE 'file' END END AS name, size_bytes, CASE WHEN code IS NULL THEN row_count ELSE 0 END AS row_count
    FROM (SELECT *, CASE WHEN size_bytes > {_SIZE_CAP} THEN 'file_too_large' WHEN nation % 3 = 1 THEN 'invalid_name' END
          AS code FROM (
      SELECT s_nationkey AS nation, {_SUPPLIER_FILES.format(mod='%', div='//')} AS file_no, count(*) AS row_count,
             CAST(length('key,name') + 1 + sum(length(s_suppkey || ',' || s_name) + 1) AS BIGINT) AS size_bytes
      FROM supplier GROUP BY ALL))"""
)
def csv_names(spark, sf_dir):
    """The suppliers of a nation as files, some beyond the size cap, some named by the caller: with
    blanks around the name, or with more characters than a name may have."""
    folder, key = new_run_dir(spark, "suppliers"), ["nation", "file_no"]
    rows = read_table(spark, sf_dir, "supplier").selectExpr(
        "s_nationkey AS nation", f"CAST({_SUPPLIER_FILES.format(mod='%', div='DIV')} AS BIGINT) AS file_no",
        "s_suppkey AS ord", "concat(s_suppkey, ',', s_name) AS line",
    )
    heads = rows.select(*key).distinct().selectExpr(*key, "CAST(-1 AS BIGINT) AS ord", "'key,name' AS line")
    files = rows.unionByName(heads).repartition(*key).sortWithinPartitions(*key, "ord").select(*key, "line")
    files.write.partitionBy(*key).option("compression", "none").text(folder)
    given = {}
    for r in list_files(spark, folder, (".txt",)).filter("file_name LIKE 'part-%'").selectExpr("file_id", *_FILE_KEY).collect():
        if r["nation"] % 3 < 2:  # names as a caller gives them, one for a file
            given[r["file_id"]] = f" Nation {r['nation']} " if r["nation"] % 3 == 0 else "x" * 256
    intake = read_csv_folder(spark, folder, max_bytes=_SIZE_CAP, suffixes=(".txt",), names=given)
    listed = intake.manifest.filter("file_name LIKE 'part-%'").selectExpr(
        "file_id AS dataset_id", *_FILE_KEY, "code", "size_bytes",
        "CASE WHEN code IS NULL THEN CASE WHEN name = file_name THEN 'file' ELSE name END END AS name",
    )
    return listed.join(intake.shape(), "dataset_id", "left").selectExpr(
        *key, "code", "name", "size_bytes", "coalesce(row_count, 0L) AS row_count"
    )


@query(
    """SELECT dataset_id, name, status, row_count, column_count, coalesce(access_count, 0) AS access_count, tags
    FROM datasets LEFT JOIN (SELECT dataset_id, count(*) AS access_count FROM access_log GROUP BY dataset_id) USING (dataset_id)
    LEFT JOIN (SELECT dataset_id, count(*) AS tags FROM ready_tags GROUP BY dataset_id) USING (dataset_id)
    WHERE dataset_id <> 'BUILDING-3'"""
)
def delete_one(spark, sf_dir):
    """One dataset deleted from the store: the catalogue without it, its tags and its events."""
    store = wl.Catalog(spark, sf_dir).copy()
    store.delete_one("BUILDING-3", "2100-01-01T00:00:00Z")
    counts = access_rollup(store.usage(wl.NOW), wl.NOW).select("dataset_id", "access_count")
    tags = store.read("tags").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("tags"))
    listed = store.read("datasets").select("dataset_id", "name", "status", "row_count", "column_count")
    # what is left of the deleted dataset anywhere would show as a row of its own
    ids = listed.select("dataset_id").unionByName(counts.select("dataset_id")).unionByName(tags.select("dataset_id")).distinct()
    out = ids.join(listed, "dataset_id", "left").join(counts, "dataset_id", "left").join(tags, "dataset_id", "left")
    return out.withColumn("access_count", F.coalesce("access_count", F.lit(0)))


# Query names are the operator names.
for _registry in (QUERIES, ORACLE):
    for _name in [n for n in _registry if n.endswith("_query")]:
        _registry[_name.removesuffix("_query")] = _registry.pop(_name)

__all__ = ["ORACLE", "QUERIES"]
