"""Inputs for the registered queries, derived by Spark from the given tables.

The given tables are clean, so dirt is derived by rule: every view reads its whole tables and
grows with them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datawarden.config import SENSITIVITY_BY_CATEGORY, Settings
from datawarden.operators.catalog import with_scores
from datawarden.operators.profile import headers_of, row_counts, spread, text_cells, value_freq
from datawarden.plans.ingest import Analysis
from datawarden.session import new_run_dir, remove_run_dir
from datawarden.sources import tables
from datawarden.sources.catalog_store import CatalogStore, new_run_id

NOW = "1998-07-01T00:00:00Z"
#: Usage before this day is summed up; no window or series reaches back so far.
LONG_AGO = "1997-01-01T00:00:00Z"
ALL_LEVELS = json.dumps({**SENSITIVITY_BY_CATEGORY, "NONE": "LOW"}, sort_keys=True)

ORDER_COLUMNS = (
    "order_id", "customer_email", "amount", "status", "order_date", "client_ip", "phone", "card",
    "notes",
)
CUSTOMER_COLUMNS = (
    "customer_id", "full_name", "ssn", "date_of_birth", "zip_code", "mobile", "remote_addr",
    "contact", "signup_date", "active", "balance", "Billing_Address", "last_seen", "CC-Number",
)


_HANDLES: dict[tuple[str, str, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. The lazy handle is kept per application, so a plan that uses a table in
    several places lists its files once."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _HANDLES:
        _HANDLES[key] = tables.read_table(spark, sf_dir, name)
    return _HANDLES[key]


ASSET = "concat(c_mktsegment, '-', c_nationkey)"
SEGMENT_DATASET = "concat('customers-', c_mktsegment)"
ACCESS_TYPE = (
    "CASE o_orderstatus WHEN 'O' THEN 'VIEW' WHEN 'F' THEN 'DETAIL_VIEW' ELSE 'DOWNLOAD' END"
)


def orders_with_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS o_custkey", f"{ASSET} AS dataset_id"
    )
    return read_table(spark, sf_dir, "orders").join(customer, "o_custkey")


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as access events of their customer's segment and nation; some are later than NOW."""
    return orders_with_asset(spark, sf_dir).selectExpr(
        "dataset_id",
        f"{ACCESS_TYPE} AS access_type",
        "o_orderdate AS occurred_at",
        "o_orderkey AS event_id",
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").selectExpr(f"{ASSET} AS dataset_id").distinct()


# --------------------------------------------------------------------------- text tables
def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text with missing, mixed and malformed cells; every 50th row twice."""
    n = read_table(spark, sf_dir, "orders").count()  # from the files' footers
    return spread(orders_with_asset(spark, sf_dir), n, "dataset_id", "o_custkey", "o_orderkey").selectExpr(
        "dataset_id",
        "o_orderkey AS ord",
        "CAST(o_orderkey AS STRING) AS order_id",
        "CASE WHEN o_custkey % 10 = 0 THEN NULL WHEN o_custkey % 7 = 0 THEN 'n/a' "
        "ELSE concat('user', o_custkey, '@example.com') END AS customer_email",
        "CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 4 = 0 THEN 'free' "
        "ELSE CAST(floor(o_totalprice) AS STRING) END AS amount",
        "o_orderstatus AS status",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS order_date",
        "concat(o_orderkey % 256, '.', o_custkey % 256, '.0.1') AS client_ip",
        "concat('+1-415-555-', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')) AS phone",
        "CASE WHEN o_orderkey % 5 = 0 THEN '4111111111111112' ELSE '4111 1111 1111 1111' END "
        "AS card",
        "CAST(NULL AS STRING) AS notes",
        "explode(CASE WHEN o_orderkey % 50 = 0 THEN array(0, 1) ELSE array(0) END) AS copy",
    ).drop("copy")


def dirty_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as text, one dataset per segment, with personal data of many kinds."""

    def day(start: str, span: int) -> str:
        added = f"date_add(DATE'{start}', CAST(c_custkey % {span} AS INT))"
        return f"date_format({added}, 'yyyy-MM-dd')"

    customer = read_table(spark, sf_dir, "customer")
    return spread(customer, customer.count(), "c_mktsegment", "c_custkey").selectExpr(
        f"{SEGMENT_DATASET} AS dataset_id",
        "c_custkey AS ord",
        "CAST(c_custkey AS STRING) AS customer_id",
        "c_name AS full_name",
        "CASE WHEN c_custkey % 6 = 0 THEN concat('unknown ', c_custkey) ELSE "
        "concat(c_custkey % 900 + 100, '-', c_custkey % 90 + 10, '-', c_custkey % 9000 + 1000) END "
        "AS ssn",
        f"CASE WHEN c_custkey % 9 = 0 THEN 'n/a' ELSE {day('1950-01-01', 15000)} END "
        "AS date_of_birth",
        "concat(lpad(CAST(c_custkey % 100000 AS STRING), 5, '0'), "
        "CASE WHEN c_custkey % 3 = 0 THEN '-0001' ELSE '' END) AS zip_code",
        "CASE WHEN c_custkey % 5 < 2 "
        "THEN concat('+1-415-555-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) "
        "ELSE concat('ext ', c_custkey) END AS mobile",
        "CASE WHEN c_custkey % 4 < 2 THEN concat('10.0.', c_custkey % 250, '.', c_custkey % 199) "
        "ELSE concat('2001:0db8:0:0:0:0:0:', c_custkey % 10000) END AS remote_addr",
        "CASE WHEN c_custkey % 2 = 0 THEN concat('user', c_custkey, '@example.com') "
        "ELSE concat('Contact ', c_custkey) END AS contact",
        f"{day('1996-01-01', 700)} AS signup_date",
        "CASE c_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'TRUE' END AS active",
        "CASE WHEN c_custkey % 50 = 0 THEN '0x10' WHEN c_custkey % 11 = 0 THEN '  ' "
        "ELSE concat(floor(c_acctbal), '.5') END AS balance",
        "concat('Street ', c_nationkey, ' no ', c_custkey) AS Billing_Address",
        f"concat({day('1997-01-01', 400)}, 'T10:00:00Z') AS last_seen",
        "CASE WHEN c_custkey % 2 = 0 THEN '4111 1111 1111 1111' ELSE '5500 0000 0000 0004' END "
        "AS `CC-Number`",
    )


def customer_headers(datasets: DataFrame) -> DataFrame:
    """Header names of the customer datasets; some repeat a name or leave one blank."""
    return headers_of(datasets, CUSTOMER_COLUMNS).selectExpr(
        "dataset_id",
        "position",
        "CASE WHEN position = 8 AND dataset_id IN ('customers-FURNITURE', 'customers-MACHINERY') "
        "THEN ' ZIP_CODE ' WHEN position = 9 AND dataset_id = 'customers-BUILDING' THEN '' "
        "ELSE name END AS name",
    )


@dataclass
class TextTables:
    """The two text tables in the shape the profiler takes."""

    freq: DataFrame
    rows: DataFrame
    headers: DataFrame


def text_tables(spark: SparkSession, sf_dir: str, ordered: bool = False) -> TextTables:
    orders, customers = dirty_orders(spark, sf_dir), dirty_customers(spark, sf_dir)
    ordinal = "ord" if ordered else None
    cells = text_cells(orders, ORDER_COLUMNS, ordinal=ordinal).unionByName(
        text_cells(customers, CUSTOMER_COLUMNS, ordinal=ordinal)
    )
    rows = row_counts(orders, ORDER_COLUMNS).unionByName(row_counts(customers, CUSTOMER_COLUMNS))
    headers = headers_of(assets(spark, sf_dir), ORDER_COLUMNS).unionByName(
        customer_headers(
            read_table(spark, sf_dir, "customer")
            .selectExpr(f"{SEGMENT_DATASET} AS dataset_id")
            .distinct()
        )
    )
    return TextTables(value_freq(cells), rows, headers)


def findings(
    spark: SparkSession, sf_dir: str, now: str = NOW, settings: Settings = Settings()
) -> Analysis:
    t = text_tables(spark, sf_dir)
    return Analysis(t.freq, t.rows, t.headers, access_log(spark, sf_dir), now, settings)


# --------------------------------------------------------------------------- catalogue
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per dataset. Nations 10 and 21 failed, nations 7 and 19 are still processing."""
    customer = read_table(spark, sf_dir, "customer")
    orders = (
        customer.selectExpr("c_custkey AS o_custkey", f"{ASSET} AS dataset_id", "c_nationkey")
        .join(read_table(spark, sf_dir, "orders"), "o_custkey")
        .groupBy("dataset_id", "c_nationkey")
        .agg(
            F.expr("sum(CASE WHEN o_orderkey % 50 = 0 THEN 2 ELSE 1 END) AS row_count"),
            F.expr("sum(CAST(length(o_orderkey) AS BIGINT)) AS size_bytes"),
            F.expr("max(o_orderdate) AS uploaded_at"),
        )
        .selectExpr(
            "dataset_id", "row_count", "size_bytes", "uploaded_at",
            f"{len(ORDER_COLUMNS)}L AS column_count",
            "CASE WHEN c_nationkey IN (10, 21) THEN 'FAILED' "
            "WHEN c_nationkey IN (7, 19) THEN 'PROCESSING' ELSE 'READY' END AS status",
        )
    )
    customers = (
        customer.selectExpr(f"{SEGMENT_DATASET} AS dataset_id", "c_custkey")
        .groupBy("dataset_id")
        .agg(
            F.expr("count(1) AS row_count"),
            F.expr("sum(CAST(length(c_custkey) AS BIGINT)) AS size_bytes"),
            F.expr(
                "CAST(date_add(DATE'1998-01-01', CAST(min(c_custkey) AS INT)) AS TIMESTAMP) "
                "AS uploaded_at"
            ),
        )
        .selectExpr("*", f"{len(CUSTOMER_COLUMNS)}L AS column_count", "'READY' AS status")
    )
    return orders.unionByName(customers).selectExpr(
        "dataset_id",
        "lower(dataset_id) AS name",
        "concat(lower(dataset_id), '.csv') AS original_filename",
        "'CSV' AS file_type",
        "size_bytes",
        "row_count",
        "column_count",
        "status",
        "CASE WHEN status = 'FAILED' THEN 'File is not rectangular.' END AS error_message",
        "uploaded_at",
        "uploaded_at AS updated_at",
    )


_STORES: dict[tuple[str, str, tuple[int, ...]], str] = {}


def _changed_at(spark: SparkSession, sf_dir: str) -> tuple[int, ...]:
    """When the tables that the catalogue is made of were last changed."""
    out = []
    for name in ("customer", "orders"):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out.append(system.getFileStatus(path).getModificationTime())
    return tuple(out)


def publish_catalog(spark: SparkSession, sf_dir: str) -> CatalogStore:
    """Both text tables analysed and published, as an ingest leaves them: grouped values, row counts
    and headers are written once and read by everything that follows."""
    store = CatalogStore(spark, new_run_dir(spark, "catalog"), log_unit="month")
    work = new_run_dir(spark, "catalog-input")

    def written(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    t = text_tables(spark, sf_dir)
    listed = written("manifest", manifest(spark, sf_dir))
    ready = listed.filter("status = 'READY'").select("dataset_id")

    def of_ready(df: DataFrame) -> DataFrame:
        return df.join(ready, "dataset_id", "left_semi")

    live = access_log(spark, sf_dir).withColumn("source", F.lit("LIVE"))
    store.append("access_events", live, batch="first")
    store.roll_up(LONG_AGO)
    found = Analysis(
        written("freq", of_ready(t.freq)), written("rows", of_ready(t.rows)),
        written("headers", of_ready(t.headers)), store.usage(NOW), NOW,
    )
    run = new_run_id()
    store.write("columns", found.counts, run)
    found.take_counts(store.of_run("columns", run))
    store.write("tags", found.tags, run)
    store.write("quality_checks", found.checks, run)
    store.write("dataset_scores", found.scores, run)
    store.write("datasets", listed, run)
    store.publish(run, listed, NOW, ("datasets", "columns", "tags", "quality_checks", "dataset_scores"))
    remove_run_dir(spark, work)
    return store


class Catalog:
    """The published catalogue of both text tables; only READY datasets have findings.

    It is published once for each application and state of the folder's tables, and read from the
    store.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, sf_dir, _changed_at(spark, sf_dir))
        if key not in _STORES:
            _STORES[key] = publish_catalog(spark, sf_dir).root
        self.store = CatalogStore(spark, _STORES[key], log_unit="month")

    @cached_property
    def listed(self) -> DataFrame:
        return self.store.read("datasets")

    @cached_property
    def datasets(self) -> DataFrame:
        return with_scores(self.listed, self.scores)

    @cached_property
    def columns(self) -> DataFrame:
        return self.store.read("columns")

    @cached_property
    def tags(self) -> DataFrame:
        return self.store.read("tags")

    @cached_property
    def checks(self) -> DataFrame:
        return self.store.read("quality_checks")

    @cached_property
    def scores(self) -> DataFrame:
        return self.store.read("dataset_scores")

    @cached_property
    def events(self) -> DataFrame:
        return self.store.access_events()

    @cached_property
    def usage(self) -> DataFrame:
        """The log as weighted events, rolled up by day."""
        return self.store.usage(NOW)

    def copy(self, events: bool = True) -> CatalogStore:
        """A store of its own with the same content, for changes; without `events`, an empty log."""
        spark = self.store.spark
        other = CatalogStore(spark, new_run_dir(spark, "catalog-copy"), log_unit="month")
        run = new_run_id()
        tables = {
            "datasets": self.listed, "columns": self.columns, "tags": self.tags,
            "dataset_scores": self.scores,
        }
        for name, rows in tables.items():
            other.write(name, rows, run)
        other.publish(run, self.listed, NOW, tuple(tables))
        if events:
            other.append("access_events", self.events, batch="first")
        return other


# --------------------------------------------------------------------------- logs
def settings_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as setting changes; some are tombstones, every 2500th is a reset of all keys."""
    return read_table(spark, sf_dir, "events").selectExpr(
        "CASE WHEN event_id % 2500 = 0 THEN '*' WHEN event_type = 'purchase' THEN 'freq_cap' "
        "WHEN event_type = 'signup' THEN 'half_life_days' WHEN event_type = 'click' THEN 'trust' "
        "WHEN event_type = 'view' THEN 'sensitivity' ELSE 'recommend' END AS key",
        # of the sensitivity maps, those of even users lack categories and must not count
        "CASE WHEN event_id % 2500 = 0 OR user_id % 3 = 0 THEN NULL "
        "WHEN event_type = 'purchase' THEN CAST(user_id % 50 + 20 AS STRING) "
        "WHEN event_type = 'signup' THEN CAST(user_id % 30 + 10 AS STRING) "
        "WHEN event_type = 'click' "
        """THEN '{"classification_coverage": 0.25, "consistency": 0.25, "quality": 0.5}' """
        f"""WHEN event_type = 'view' THEN CASE WHEN user_id % 2 = 0 THEN '{{"NONE": "LOW"}}' ELSE '{ALL_LEVELS}' END """
        """ELSE '{"archive_below": 40, "optimize_below": 70, "retire_below": 20}' END """
        "AS json_value",
        "ts AS updated_at",
    )


def override_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as manual tag decisions; some name unknown datasets, columns, categories, levels."""
    return orders_with_asset(spark, sf_dir).selectExpr(
        "CASE WHEN o_orderkey % 97 = 0 THEN concat('unknown-', dataset_id) ELSE dataset_id END "
        "AS dataset_id",
        "CAST(o_orderkey % 11 AS INT) AS position",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'EMAIL' WHEN '2-HIGH' THEN 'NAME' "
        "WHEN '3-MEDIUM' THEN 'NONE' WHEN '5-LOW' THEN 'OTHER' ELSE 'NOT_A_CATEGORY' END "
        "AS category",
        "CASE o_orderkey % 4 WHEN 1 THEN 'LOW' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'TOP' END "
        "AS sensitivity",
        "o_orderdate AS requested_at",
    )


def refinements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as outside labels for the columns of their dataset."""
    return orders_with_asset(spark, sf_dir).selectExpr(
        "dataset_id",
        "CAST(o_orderkey % 9 AS INT) AS position",
        "CASE o_orderstatus WHEN 'O' THEN 'CREDIT_CARD' WHEN 'F' THEN 'OTHER' ELSE 'BOGUS' END "
        "AS category",
        "CASE o_orderkey % 3 WHEN 0 THEN 'MEDIUM' WHEN 1 THEN 'whatever' END AS sensitivity",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'high' "
        "ELSE concat('0.', lpad(CAST(o_orderkey % 100 AS STRING), 2, '0')) END AS confidence",
        "o_orderdate AS labelled_at",
    )


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, as one column per source."""
    return (
        read_table(spark, sf_dir, "documents")
        .selectExpr("source", r"explode(split(text, r'[ \t\n\r\f]+')) AS value")
        .filter("value <> ''")
        .selectExpr(
            "'documents' AS dataset_id",
            "CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS position",
            "source AS name",
            "value",
        )
    )
