"""The registered queries once more as plain SQL for DuckDB, built from named CTEs."""

from __future__ import annotations

import re

from datawarden.config import (
    ACCESS_TYPES,
    RECOMMENDATIONS,
    SENSITIVITIES,
    SENSITIVITY_BY_CATEGORY,
    STATUSES,
    Settings,
)
from datawarden.functions.cell_types import (
    BOOLEAN_WORDS,
    DATE_PATTERN as CELL_DATE,
    DATETIME_PATTERN,
    FLOAT_PATTERN,
    INTEGER_PATTERN,
    TYPE_ORDER,
)
from datawarden.functions.pii import (
    CARD_PATTERN,
    DATE_PATTERN,
    HEADER_PATTERNS,
    IPV4_PATTERN,
    IPV6_PATTERN,
    POSTAL_PATTERN,
    SSN_PATTERN,
    STRONG_CATEGORIES,
    VALUE_CATEGORIES,
)
from datawarden.plans.workload import ALL_LEVELS, CUSTOMER_COLUMNS, ORDER_COLUMNS

NOW = "TIMESTAMP '1998-07-01 00:00:00'"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"
PHONE = r"^\+?[0-9][0-9\s().\-]{5,20}[0-9]$"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _unit(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


def _lit(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


# --------------------------------------------------------------------------- derived inputs
CTES: dict[str, str] = {}

CTES["orders_with_asset"] = """
SELECT o.*, c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) AS dataset_id, c_nationkey
FROM orders o JOIN customer ON o_custkey = c_custkey"""

CTES["all_access"] = """
SELECT dataset_id,
       CASE o_orderstatus WHEN 'O' THEN 'VIEW' WHEN 'F' THEN 'DETAIL_VIEW' ELSE 'DOWNLOAD' END
         AS access_type,
       o_orderdate AS occurred_at, o_orderkey AS event_id
FROM orders_with_asset"""

CTES["access_log"] = "SELECT * FROM all_access"

CTES["assets"] = """
SELECT DISTINCT c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) AS dataset_id FROM customer"""

CTES["dirty_orders_once"] = """
SELECT dataset_id, o_orderkey AS ord, CAST(o_orderkey AS VARCHAR) AS order_id,
       CASE WHEN o_custkey % 10 = 0 THEN NULL WHEN o_custkey % 7 = 0 THEN 'n/a'
            ELSE 'user' || o_custkey || '@example.com' END AS customer_email,
       CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 4 = 0 THEN 'free'
            ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS amount,
       o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS order_date,
       (o_orderkey % 256) || '.' || (o_custkey % 256) || '.0.1' AS client_ip,
       '+1-415-555-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS phone,
       CASE WHEN o_orderkey % 5 = 0 THEN '4111111111111112' ELSE '4111 1111 1111 1111' END AS card,
       CAST(NULL AS VARCHAR) AS notes
FROM orders_with_asset"""

CTES["dirty_orders"] = """
SELECT * FROM dirty_orders_once
UNION ALL SELECT * FROM dirty_orders_once WHERE ord % 50 = 0"""

CTES["dirty_customers"] = """
SELECT 'customers-' || c_mktsegment AS dataset_id, c_custkey AS ord,
       CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS full_name,
       CASE WHEN c_custkey % 6 = 0 THEN 'unknown ' || c_custkey
            ELSE (c_custkey % 900 + 100) || '-' || (c_custkey % 90 + 10) || '-'
                 || (c_custkey % 9000 + 1000) END AS ssn,
       CASE WHEN c_custkey % 9 = 0 THEN 'n/a'
            ELSE strftime(DATE '1950-01-01' + CAST(c_custkey % 15000 AS INTEGER), '%Y-%m-%d') END
         AS date_of_birth,
       lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0')
         || CASE WHEN c_custkey % 3 = 0 THEN '-0001' ELSE '' END AS zip_code,
       CASE WHEN c_custkey % 5 < 2
            THEN '+1-415-555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')
            ELSE 'ext ' || c_custkey END AS mobile,
       CASE WHEN c_custkey % 4 < 2 THEN '10.0.' || (c_custkey % 250) || '.' || (c_custkey % 199)
            ELSE '2001:0db8:0:0:0:0:0:' || (c_custkey % 10000) END AS remote_addr,
       CASE WHEN c_custkey % 2 = 0 THEN 'user' || c_custkey || '@example.com'
            ELSE 'Contact ' || c_custkey END AS contact,
       strftime(DATE '1996-01-01' + CAST(c_custkey % 700 AS INTEGER), '%Y-%m-%d') AS signup_date,
       CASE c_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'TRUE' END AS active,
       CASE WHEN c_custkey % 50 = 0 THEN '0x10' WHEN c_custkey % 11 = 0 THEN '  '
            ELSE CAST(floor(c_acctbal) AS BIGINT) || '.5' END AS balance,
       'Street ' || c_nationkey || ' no ' || c_custkey AS "Billing_Address",
       strftime(DATE '1997-01-01' + CAST(c_custkey % 400 AS INTEGER), '%Y-%m-%d') || 'T10:00:00Z'
         AS last_seen,
       CASE WHEN c_custkey % 2 = 0 THEN '4111 1111 1111 1111' ELSE '5500 0000 0000 0004' END
         AS "CC-Number"
FROM customer"""


def _cells() -> str:
    parts = []
    for table, names in (("dirty_orders", ORDER_COLUMNS), ("dirty_customers", CUSTOMER_COLUMNS)):
        for i, name in enumerate(names):
            parts.append(
                f"SELECT dataset_id, {i} AS position, ord, "
                f"CASE WHEN trim(\"{name}\") = '' THEN NULL ELSE \"{name}\" END AS value FROM {table}"
            )
    return "\nUNION ALL ".join(parts)


CTES["cells"] = _cells()
CTES["value_freq"] = """
SELECT dataset_id, position, value, count(*) AS n, min(ord) AS first_ord
FROM cells GROUP BY dataset_id, position, value"""


def _headers() -> str:
    orders = ", ".join(f"({i}, {_q(n)})" for i, n in enumerate(ORDER_COLUMNS))
    customers = ", ".join(f"({i}, {_q(n)})" for i, n in enumerate(CUSTOMER_COLUMNS))
    return f"""
SELECT dataset_id, position, name FROM assets, (VALUES {orders}) h(position, name)
UNION ALL
SELECT dataset_id, position,
       CASE WHEN position = 8 AND dataset_id IN ('customers-FURNITURE', 'customers-MACHINERY')
            THEN ' ZIP_CODE '
            WHEN position = 9 AND dataset_id = 'customers-BUILDING' THEN '' ELSE name END AS name
FROM (SELECT DISTINCT dataset_id FROM dirty_customers), (VALUES {customers}) h(position, name)"""


CTES["headers"] = _headers()

# --------------------------------------------------------------------------- profile
CTES["flags"] = f"""
SELECT *, NOT (is_INTEGER OR is_FLOAT OR is_BOOLEAN OR is_DATE OR is_DATETIME) AS is_STRING FROM (
  SELECT *, regexp_matches(t, {_q(INTEGER_PATTERN)}) AS is_INTEGER,
         regexp_matches(t, {_q(FLOAT_PATTERN)})
           AND coalesce(isfinite(TRY_CAST(t AS DOUBLE)), false) AS is_FLOAT,
         lower(t) IN {_in(BOOLEAN_WORDS)} AS is_BOOLEAN,
         regexp_matches(t, {_q(CELL_DATE)}) AND TRY_CAST(t AS DATE) IS NOT NULL AS is_DATE,
         regexp_matches(t, {_q(DATETIME_PATTERN)}) AND TRY_CAST(t AS TIMESTAMP) IS NOT NULL
           AS is_DATETIME
  FROM (SELECT *, trim(value) AS t FROM value_freq))"""

CTES["counts"] = (
    "SELECT dataset_id, position, CAST(sum(n) AS BIGINT) AS row_count, "
    "CAST(coalesce(sum(n) FILTER (WHERE value IS NOT NULL), 0) AS BIGINT) AS non_null_count, "
    "count(value) AS distinct_count, "
    + ", ".join(
        f"CAST(coalesce(sum(n) FILTER (WHERE value IS NOT NULL AND is_{t}), 0) AS BIGINT) AS m_{t}"
        for t in TYPE_ORDER
    )
    + " FROM flags GROUP BY dataset_id, position"
)

CTES["typed_counts"] = f"""
SELECT *, greatest({", ".join("m_" + t for t in TYPE_ORDER)}) AS most,
       CASE {" ".join(f"WHEN m_{t} = greatest({', '.join('m_' + x for x in TYPE_ORDER)}) THEN '{t}'"
                      for t in TYPE_ORDER)} END AS dominant
FROM counts"""

CTES["column_profile"] = """
SELECT dataset_id, position, name,
       CASE WHEN non_null_count = 0 THEN 'UNKNOWN' WHEN most * 5 >= non_null_count * 4 THEN dominant
            ELSE 'STRING' END AS data_type,
       row_count, non_null_count, row_count - non_null_count AS missing_count,
       (row_count - non_null_count) / row_count::DOUBLE AS missing_pct,
       non_null_count / row_count::DOUBLE AS completeness, distinct_count,
       CASE WHEN most * 5 >= non_null_count * 4 AND dominant = 'STRING' THEN non_null_count
            ELSE most END AS type_match_count,
       CASE WHEN non_null_count = 0 THEN 1e0 ELSE most / non_null_count::DOUBLE END
         AS dominant_type_share,
       CASE WHEN non_null_count = 0 THEN 1e0
            WHEN most * 5 >= non_null_count * 4 AND dominant = 'STRING' THEN 1e0
            ELSE most / non_null_count::DOUBLE END AS validity
FROM headers JOIN typed_counts USING (dataset_id, position)"""

CTES["sample_rows"] = """
SELECT dataset_id, position, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_id, position ORDER BY md5(value), value) AS rank
  FROM value_freq WHERE value IS NOT NULL) WHERE rank <= 10"""

CTES["samples"] = """
SELECT dataset_id, position, string_agg(value, '|' ORDER BY rank) AS sample_values
FROM sample_rows GROUP BY dataset_id, position"""

_group = lambda names: ", ".join(f'"{n}"' for n in names)
CTES["duplicates"] = f"""
SELECT dataset_id, CAST(sum(n) AS BIGINT) AS row_count,
       CAST(sum(n - 1) AS BIGINT) AS duplicate_row_count
FROM (SELECT dataset_id, count(*) AS n FROM dirty_orders
      GROUP BY dataset_id, {_group(ORDER_COLUMNS)}
      UNION ALL
      SELECT dataset_id, count(*) AS n FROM dirty_customers
      GROUP BY dataset_id, {_group(CUSTOMER_COLUMNS)})
GROUP BY dataset_id"""

CTES["header_names"] = """
SELECT dataset_id, lower(trim(name)) AS name, count(*) AS n
FROM headers GROUP BY dataset_id, lower(trim(name))"""

CTES["dataset_profile"] = """
SELECT dataset_id, row_count, column_count, duplicate_row_count, repeated_headers, blank_headers
FROM (SELECT dataset_id, CAST(sum(n) AS BIGINT) AS column_count,
             CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS repeated_headers,
             count(*) FILTER (WHERE name = '') AS blank_headers
      FROM header_names GROUP BY dataset_id) JOIN duplicates USING (dataset_id)"""

# --------------------------------------------------------------------------- classification
CTES["header_hints"] = f"""
SELECT dataset_id, position, name,
       CASE {" ".join(f"WHEN regexp_matches(h, {_q(p)}) THEN '{c}'" for c, p in HEADER_PATTERNS)}
       END AS header_category
FROM (SELECT *, trim(regexp_replace(lower(name), '[\\s_\\-]+', ' ', 'g')) AS h FROM headers)"""


def _luhn(digits: str) -> str:
    terms = []
    for i in range(19):
        d = f"CAST(substr(reverse({digits}), {i + 1}, 1) AS INTEGER)"
        if i % 2:
            d = f"CASE WHEN 2 * {d} > 9 THEN 2 * {d} - 9 ELSE 2 * {d} END"
        terms.append(f"CASE WHEN length({digits}) > {i} THEN {d} ELSE 0 END")
    return "(" + " + ".join(terms) + ") % 10 = 0"


def _shares(samples: str, hints: str) -> str:
    tests = {
        "EMAIL": f"regexp_matches(v, {_q(EMAIL)})",
        "IP_ADDRESS": f"regexp_matches(v, {_q(IPV4_PATTERN)}) OR regexp_matches(v, {_q(IPV6_PATTERN)})",
        "CREDIT_CARD": f"CASE WHEN regexp_matches(v, {_q(CARD_PATTERN)}) "
        f"AND length(d) BETWEEN 13 AND 19 THEN {_luhn('d')} ELSE false END",
        "PHONE": f"regexp_matches(v, {_q(PHONE)}) AND length(d) BETWEEN 7 AND 15 "
        f"AND NOT regexp_matches(v, {_q(DATE_PATTERN)})",
        "ID_NUMBER": f"regexp_matches(v, {_q(SSN_PATTERN)})",
        "DATE_OF_BIRTH": "coalesce(header_category = 'DATE_OF_BIRTH', false) "
        f"AND regexp_matches(v, {_q(DATE_PATTERN)})",
        "POSTAL_CODE": "coalesce(header_category = 'POSTAL_CODE', false) "
        f"AND regexp_matches(v, {_q(POSTAL_PATTERN)})",
    }
    shares = ", ".join(
        f"coalesce(count(v) FILTER (WHERE {tests[c]}) / nullif(count(v), 0)::DOUBLE, 0e0) AS s_{c}"
        for c in VALUE_CATEGORIES
    )
    return f"""
SELECT dataset_id, position, name, header_category, count(v) AS sample_size, {shares}
FROM (SELECT h.*, trim(value) AS v, regexp_replace(value, '[^0-9]', '', 'g') AS d
      FROM {hints} h LEFT JOIN {samples} s USING (dataset_id, position))
GROUP BY dataset_id, position, name, header_category"""


CTES["distinct_values"] = "SELECT dataset_id, position, value FROM value_freq WHERE value IS NOT NULL"
CTES["shares"] = _shares("distinct_values", "header_hints")

CTES["best"] = f"""
SELECT dataset_id, position, name, header_category AS h,
       CASE WHEN share > 0 THEN category END AS v, share
FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, position
                ORDER BY share DESC, coalesce(header_category = category, false) DESC, ordinal) AS rn
      FROM ({" UNION ALL ".join(
          f"SELECT dataset_id, position, name, header_category, '{c}' AS category, "
          f"{i} AS ordinal, s_{c} AS share FROM shares" for i, c in enumerate(VALUE_CATEGORIES))}))
WHERE rn = 1"""

_STRONG = _in(STRONG_CATEGORIES)
_LEVEL = "CASE {} " + " ".join(
    f"WHEN '{c}' THEN '{s}'" for c, s in SENSITIVITY_BY_CATEGORY.items()
) + " END"

CTES["tags"] = f"""
SELECT dataset_id, position, name, category, {_LEVEL.format("category")} AS sensitivity,
       confidence, 'AUTO_REGEX' AS source, false AS overridden, needs_review
FROM (SELECT *,
        CASE WHEN use_value THEN v WHEN h IS NOT NULL THEN h ELSE 'NONE' END AS category,
        CASE WHEN use_value THEN share WHEN h IS NOT NULL THEN 0.6::DOUBLE END AS confidence
      FROM (SELECT *, v IS NOT NULL AND CASE WHEN needs_review THEN share >= 0.3::DOUBLE
                                             ELSE share >= 0.7::DOUBLE END AS use_value
            FROM (SELECT *,
                    CASE WHEN v IS NOT NULL AND share >= 0.7::DOUBLE
                         THEN h IS NOT NULL AND h <> v AND h IN {_STRONG} AND v IN {_STRONG}
                         WHEN h IS NOT NULL THEN h IN {_STRONG} AND share >= 0.3::DOUBLE
                         ELSE share >= 0.3::DOUBLE END AS needs_review
                  FROM best)))"""

CTES["refinement_log"] = """
SELECT dataset_id, CAST(o_orderkey % 9 AS INTEGER) AS position,
       CASE o_orderstatus WHEN 'O' THEN 'CREDIT_CARD' WHEN 'F' THEN 'OTHER' ELSE 'BOGUS' END
         AS category,
       CASE o_orderkey % 3 WHEN 0 THEN 'MEDIUM' WHEN 1 THEN 'whatever' END AS sensitivity,
       CASE WHEN o_orderkey % 4 = 0 THEN 'high'
            ELSE '0.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') END AS confidence,
       o_orderdate AS labelled_at
FROM orders_with_asset"""

CTES["refined_tags"] = f"""
SELECT t.dataset_id, t.position, name,
       CASE WHEN needs_review AND c IS NOT NULL THEN c ELSE t.category END AS category,
       CASE WHEN needs_review AND c IS NOT NULL
            THEN CASE WHEN s IN {_in(SENSITIVITIES)} THEN s ELSE {_LEVEL.format("c")} END
            ELSE t.sensitivity END AS sensitivity,
       CASE WHEN needs_review AND c IS NOT NULL THEN TRY_CAST(f AS DOUBLE) ELSE t.confidence END
         AS confidence,
       CASE WHEN needs_review AND c IS NOT NULL THEN 'AUTO_AI' ELSE source END AS source
FROM tags t LEFT JOIN (
  SELECT dataset_id, position, category AS c, sensitivity AS s, confidence AS f FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset_id, position ORDER BY labelled_at DESC,
              category DESC, sensitivity DESC NULLS LAST, confidence DESC) AS rn
    FROM refinement_log) WHERE rn = 1 AND category <> 'BOGUS') r USING (dataset_id, position)"""

# --------------------------------------------------------------------------- findings
_P1 = (
    "CASE WHEN {x} * 4 = floor({x} * 4) AND CAST(floor({x} * 4) AS BIGINT) % 2 = 1 "
    "THEN printf('%.1f', {x} + 0.01e0) ELSE printf('%.1f', {x}) END"
)
CTES["checks"] = f"""
SELECT dataset_id, position, name AS column_name, 'EMPTY_COLUMN' AS check_type,
       'WARNING' AS severity, missing_count AS affected_count, missing_pct AS affected_pct,
       'Column "' || name || '" is entirely empty.' AS detail
FROM column_profile WHERE completeness = 0
UNION ALL
SELECT dataset_id, position, name, 'MISSING_VALUES',
       CASE WHEN missing_pct >= 0.5::DOUBLE THEN 'ERROR' WHEN missing_pct >= 0.2::DOUBLE
            THEN 'WARNING' ELSE 'INFO' END, missing_count, missing_pct,
       missing_count || ' missing value(s) (' || {_P1.format(x="(missing_pct * 100)")}
         || '%) in "' || name || '".'
FROM column_profile WHERE completeness <> 0 AND missing_pct > 0
UNION ALL
SELECT dataset_id, position, name, 'INVALID_VALUES', 'WARNING', non_null_count - type_match_count,
       (non_null_count - type_match_count) / non_null_count::DOUBLE,
       (non_null_count - type_match_count) || ' value(s) in "' || name
         || '" do not match inferred type ' || data_type || '.'
FROM column_profile WHERE validity < 1
UNION ALL
SELECT dataset_id, position, name, 'TYPE_MISMATCH',
       CASE WHEN dominant_type_share < 0.8::DOUBLE THEN 'WARNING' ELSE 'INFO' END,
       CAST(floor((1 - dominant_type_share) * non_null_count + 0.5e0) AS BIGINT),
       1 - dominant_type_share,
       'Mixed types in "' || name || '"; dominant type covers '
         || CAST(floor(dominant_type_share * 100 + 0.5e0) AS BIGINT) || '%.'
FROM column_profile WHERE dominant_type_share < 1
UNION ALL
SELECT dataset_id, NULL, NULL, 'DUPLICATE_ROWS', 'WARNING', duplicate_row_count,
       duplicate_row_count / row_count::DOUBLE, duplicate_row_count || ' duplicate row(s) detected.'
FROM dataset_profile WHERE duplicate_row_count > 0
UNION ALL
SELECT dataset_id, NULL, NULL, 'DUPLICATE_HEADER', 'ERROR', repeated_headers,
       repeated_headers / column_count::DOUBLE, 'Duplicate column header(s) detected.'
FROM dataset_profile WHERE repeated_headers > 0"""

# --------------------------------------------------------------------------- scores
CTES["means"] = """
SELECT dataset_id, avg(non_null_count / row_count::DOUBLE) AS completeness,
       avg(CASE WHEN non_null_count = 0 THEN 1e0 ELSE type_match_count / non_null_count::DOUBLE END)
         AS validity,
       avg(CASE WHEN non_null_count = 0 THEN 1e0 ELSE dominant_type_share END) AS type_share
FROM column_profile GROUP BY dataset_id"""


def _quality(s: Settings) -> str:
    w = s.quality
    return (
        f"100 * {_lit(w['completeness'])} * completeness + 100 * {_lit(w['validity'])} * validity "
        f"+ 100 * {_lit(w['uniqueness'])} * uniqueness"
    )


def _trust(s: Settings, coverage: str) -> str:
    w = s.trust
    return (
        f"100 * {_lit(w['quality'])} * {_unit('quality_score / 100')} "
        f"+ 100 * {_lit(w['consistency'])} * consistency "
        f"+ 100 * {_lit(w['classification_coverage'])} * {coverage}"
    )


def quality_trust(s: Settings = Settings(), coverage: str = "1e0") -> str:
    return f"""
SELECT *, {_trust(s, coverage)} AS trust_score FROM (
  SELECT *, {_quality(s)} AS quality_score FROM (
    SELECT dataset_id, row_count, column_count, duplicate_row_count, completeness, validity,
           1 - duplicate_row_count / row_count::DOUBLE AS uniqueness,
           least(0.2::DOUBLE, 0.05::DOUBLE * (CASE WHEN repeated_headers > 0 THEN 1 ELSE 0 END
             + CASE WHEN blank_headers > 0 THEN 1 ELSE 0 END)) AS structural_penalty,
           type_share, type_share * (1 - structural_penalty) AS consistency
    FROM means JOIN dataset_profile USING (dataset_id)))"""


CTES["quality_trust"] = quality_trust()


def windows(datasets: str, events: str, now: str) -> str:
    def count(newer: int, older: int) -> str:
        return (
            f"count(*) FILTER (WHERE occurred_at <= {now} - INTERVAL {newer} DAY "
            f"AND occurred_at > {now} - INTERVAL {older} DAY)"
        )

    return f"""
SELECT dataset_id, coalesce(accesses_90d, 0) AS accesses_90d,
       coalesce(accesses_last30, 0) AS accesses_last30,
       coalesce(accesses_prev30, 0) AS accesses_prev30, last_accessed_at,
       greatest(0e0, (epoch_us({now}) - epoch_us(last_accessed_at)) / 86400e6)
         AS days_since_last_access
FROM {datasets} LEFT JOIN (
  SELECT dataset_id, {count(0, 90)} AS accesses_90d, {count(0, 30)} AS accesses_last30,
         {count(30, 60)} AS accesses_prev30, max(occurred_at) AS last_accessed_at
  FROM {events} GROUP BY dataset_id) USING (dataset_id)"""


def value(source: str, s: Settings = Settings()) -> str:
    w, r = s.value, s.recommend
    return f"""
SELECT *, CASE WHEN accesses_90d = 0 OR value_score < {_lit(r['retire_below'])} THEN 'RETIRE'
               WHEN value_score < {_lit(r['archive_below'])} AND trend < 0.5::DOUBLE THEN 'ARCHIVE'
               WHEN value_score < {_lit(r['optimize_below'])} THEN 'OPTIMIZE'
               ELSE 'KEEP' END AS recommendation
FROM (SELECT *, 100 * {_lit(w['frequency'])} * frequency + 100 * {_lit(w['recency'])} * recency
                + 100 * {_lit(w['trend'])} * trend AS value_score
      FROM (SELECT *, {_unit(f"ln(1 + accesses_90d::DOUBLE) / ln(1 + {_lit(s.freq_cap)})")}
                        AS frequency,
                   {_unit(f"coalesce(exp(-days_since_last_access / {_lit(s.half_life_days)}), 0e0)"
                          " * least(1e0, accesses_90d / 3e0)")} AS recency,
                   {_unit("0.5::DOUBLE + (accesses_last30 - accesses_prev30) "
                          "/ (2e0 * greatest(5, accesses_prev30))")} AS trend
            FROM ({source})))"""


CTES["profiled"] = "SELECT dataset_id FROM dataset_profile"
CTES["windows"] = windows("assets", "access_log", NOW)
CTES["profiled_windows"] = windows("profiled", "access_log", NOW)
CTES["asset_value"] = value("SELECT * FROM windows")
CTES["value_scores"] = value("SELECT * FROM profiled_windows")
CTES["scores"] = """
SELECT q.*, frequency, recency, trend, value_score, recommendation, accesses_90d, accesses_last30,
       accesses_prev30, days_since_last_access
FROM quality_trust q JOIN value_scores USING (dataset_id)"""

# --------------------------------------------------------------------------- catalogue
CTES["manifest"] = """
SELECT dataset_id, count(*) + count(*) FILTER (WHERE o_orderkey % 50 = 0) AS row_count,
       CAST(sum(length(CAST(o_orderkey AS VARCHAR))) AS BIGINT) AS size_bytes,
       max(o_orderdate) AS uploaded_at, 9 AS column_count,
       CASE WHEN c_nationkey IN (10, 21) THEN 'FAILED' WHEN c_nationkey IN (7, 19)
            THEN 'PROCESSING' ELSE 'READY' END AS status
FROM orders_with_asset GROUP BY dataset_id, c_nationkey
UNION ALL
SELECT 'customers-' || c_mktsegment, count(*),
       CAST(sum(length(CAST(c_custkey AS VARCHAR))) AS BIGINT),
       CAST(DATE '1998-01-01' + CAST(min(c_custkey) AS INTEGER) AS TIMESTAMP), 14, 'READY'
FROM customer GROUP BY c_mktsegment"""

CTES["datasets"] = """
SELECT m.dataset_id, lower(m.dataset_id) AS name, lower(m.dataset_id) || '.csv' AS original_filename,
       'CSV' AS file_type, size_bytes, m.row_count, CAST(m.column_count AS BIGINT) AS column_count,
       status, CASE WHEN status = 'READY' THEN quality_score END AS quality_score,
       CASE WHEN status = 'READY' THEN trust_score END AS trust_score,
       CASE WHEN status = 'READY' THEN value_score END AS value_score,
       CASE WHEN status = 'READY' THEN recommendation END AS recommendation,
       CASE WHEN status = 'FAILED' THEN 'File is not rectangular.' END AS error_message, uploaded_at
FROM manifest m LEFT JOIN scores s USING (dataset_id)"""

CTES["ready"] = "SELECT dataset_id FROM manifest WHERE status = 'READY'"
CTES["ready_tags"] = "SELECT * FROM tags WHERE dataset_id IN (SELECT dataset_id FROM ready)"
CTES["ready_columns"] = (
    "SELECT * FROM column_profile WHERE dataset_id IN (SELECT dataset_id FROM ready)"
)
CTES["ready_scores"] = "SELECT * FROM scores WHERE dataset_id IN (SELECT dataset_id FROM ready)"

CTES["pii"] = """
SELECT dataset_id, count(*) FILTER (WHERE sensitivity <> 'NONE') AS pii_column_count,
       CASE max(CASE sensitivity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0
                END) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' END
         AS highest_sensitivity
FROM ready_tags GROUP BY dataset_id"""


def rollup(events: str) -> str:
    return f"""
SELECT dataset_id, count(*) AS access_count,
       count(*) FILTER (WHERE occurred_at >= {NOW} - INTERVAL 90 DAY) AS access_count_90d,
       max(occurred_at) AS last_accessed_at
FROM {events} GROUP BY dataset_id"""


CTES["access_rollup"] = rollup("access_log")
CTES["summaries"] = """
SELECT d.*, coalesce(pii_column_count, 0) AS pii_column_count, highest_sensitivity,
       last_accessed_at, coalesce(access_count, 0) AS access_count,
       coalesce(access_count_90d, 0) AS access_count_90d
FROM datasets d LEFT JOIN pii USING (dataset_id) LEFT JOIN access_rollup USING (dataset_id)"""

# --------------------------------------------------------------------------- logs
CTES["override_requests"] = """
SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'unknown-' || dataset_id ELSE dataset_id END AS dataset_id,
       CAST(o_orderkey % 11 AS INTEGER) AS position,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'EMAIL' WHEN '2-HIGH' THEN 'NAME'
            WHEN '3-MEDIUM' THEN 'NONE' WHEN '5-LOW' THEN 'OTHER' ELSE 'NOT_A_CATEGORY' END
         AS category,
       CASE o_orderkey % 4 WHEN 1 THEN 'LOW' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'TOP' END AS sensitivity,
       o_orderdate AS requested_at
FROM orders_with_asset"""

CTES["overrides"] = f"""
SELECT dataset_id, position, category,
       coalesce(sensitivity, {_LEVEL.format("category")}) AS sensitivity
FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, position ORDER BY requested_at DESC,
                category DESC, sensitivity DESC NULLS LAST) AS rn
      FROM override_requests
      WHERE category <> 'NOT_A_CATEGORY' AND (sensitivity IS NULL OR sensitivity <> 'TOP'))
JOIN (SELECT DISTINCT dataset_id, position FROM ready_columns) USING (dataset_id, position)
WHERE rn = 1"""

CTES["given_tags"] = "SELECT * FROM ready_tags WHERE position % 4 <> 3"


def overridden(tags: str) -> str:
    return f"""
SELECT dataset_id, position, coalesce(o.category, t.category) AS category,
       coalesce(o.sensitivity, t.sensitivity) AS sensitivity,
       CASE WHEN o.category IS NULL THEN t.confidence END AS confidence,
       CASE WHEN o.category IS NULL THEN t.source ELSE 'MANUAL' END AS source,
       o.category IS NOT NULL AS overridden
FROM {tags} t FULL JOIN overrides o USING (dataset_id, position)"""


CTES["overridden_tags"] = overridden("ready_tags")
CTES["overridden_given_tags"] = overridden("given_tags")

CTES["settings_log"] = """
SELECT CASE WHEN event_id % 2500 = 0 THEN '*' WHEN event_type = 'purchase' THEN 'freq_cap'
            WHEN event_type = 'signup' THEN 'half_life_days' WHEN event_type = 'click' THEN 'trust'
            WHEN event_type = 'view' THEN 'sensitivity' ELSE 'recommend' END AS key,
       CASE WHEN event_id % 2500 = 0 OR user_id % 3 = 0 THEN NULL
            WHEN event_type = 'purchase' THEN CAST(user_id % 50 + 20 AS VARCHAR)
            WHEN event_type = 'signup' THEN CAST(user_id % 30 + 10 AS VARCHAR)
            WHEN event_type = 'click'
            THEN '{"classification_coverage": 0.25, "consistency": 0.25, "quality": 0.5}'
            WHEN event_type = 'view' THEN '@levels'
            ELSE '{"archive_below": 40, "optimize_below": 70, "retire_below": 20}' END AS json_value,
       ts AS updated_at
FROM events
WHERE event_id % 2500 = 0 OR user_id % 3 = 0 OR event_type <> 'view' OR user_id % 2 <> 0""".replace("@levels", ALL_LEVELS)

CTES["text_tokens"] = """
SELECT 'documents' AS dataset_id, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS position,
       source AS name, value
FROM (SELECT source, unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+')) AS value FROM documents)
WHERE value <> ''"""

CTES["token_samples"] = "SELECT DISTINCT dataset_id, position, value FROM text_tokens"
CTES["token_hints"] = """
SELECT DISTINCT dataset_id, position, name, CAST(NULL AS VARCHAR) AS header_category
FROM text_tokens"""
CTES["token_shares"] = _shares("token_samples", "token_hints")


def _uses(sql: str, name: str) -> bool:
    return re.search(rf"(?<![\w.\"']){name}(?![\w'\"])", sql) is not None


def sql(final: str, extra: dict[str, str] | None = None) -> str:
    """The final select preceded by the CTEs it needs, in dependency order."""
    ctes = {**CTES, **(extra or {})}
    needed: set[str] = set()
    todo = [final]
    while todo:
        text = todo.pop()
        for name in ctes:
            if name not in needed and _uses(text, name):
                needed.add(name)
                todo.append(ctes[name])
    ordered = _sorted(needed, ctes)
    if not ordered:
        return final.strip()
    return "WITH " + ",\n".join(f"{n} AS ({ctes[n].strip()})" for n in ordered) + "\n" + final.strip()


def _sorted(needed: set[str], ctes: dict[str, str]) -> list[str]:
    done: list[str] = []

    def visit(name: str) -> None:
        for other in ctes:
            if other != name and other in needed and other not in done and _uses(ctes[name], other):
                visit(other)
        if name not in done:
            done.append(name)

    for name in ctes:
        if name in needed:
            visit(name)
    return done


def counts_over(column: str, table: str, keys: tuple[str, ...]) -> str:
    """Zero-filled counts per enum key."""
    return " UNION ALL ".join(
        f"SELECT '{k}' AS {column}, count(*) FILTER (WHERE {column} = '{k}') AS n FROM {table}"
        for k in keys
    )


STATUS_COUNTS = counts_over("status", "datasets", STATUSES)
RECOMMENDATION_COUNTS = counts_over("recommendation", "datasets", RECOMMENDATIONS)
SENSITIVITY_COUNTS = counts_over("sensitivity", "ready_tags", SENSITIVITIES)
ACCESS_COLUMNS = tuple(t.lower() for t in ACCESS_TYPES)
