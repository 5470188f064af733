"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

Filters A to D look at one text; E asks whether a smaller doc_id has the same text, which is an
existential self-join: rows are left-semi joined on hash, exact text and a smaller id. Only rows
whose hash occurs twice bring their text (a bitmap passes all of them and few others), and of
equal texts the right side has the smallest id alone, taken before the shuffle. Hashes with more
than a fixed share of all rows are dealt over several tasks: rows by turn, and the one row on the
right to each of them.

The rows the join finds are united with the failures of the other filters, as one row that takes a
document out of its combination without E and one that puts it into the one with E, so no join by
id is needed and repeated ids do no harm. What is left are counts of at most 32 combinations of
failures for each part, and all orders follow from these.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datawarden.llm.common import discard, narrow, written
from datawarden.llm.sieve import sieve_of

#: Hashes with more than a SHARES-th of all rows, and at least HOT_ROWS, are dealt over several
#: tasks. There are fewer than SHARES of them, so their list is broadcast.
SHARES = 1 << 15
HOT_ROWS = 64


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """The failure conditions of filters A to D; fixed values of the query."""
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * upper > 2 * F.length(text),
        "D": F.rlike(text, F.lit("[#$%&*|]")),
    }


def words_of(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def failures(rows: DataFrame, filters: Mapping[str, Column]) -> DataFrame:
    """`rows` (text and others) with `bits`: bit k is set where the k-th filter fails."""
    bits = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    return rows.withColumn("words", words_of(F.col("text"))).select(*rows.columns, bits.alias("bits"))


def repeated(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """The rows of `rows` (doc_id, text, hash and others, non-null texts) whose text a smaller doc_id
    has too. `hashes` (hash, n) has the hashes that occur more than once and their counts, and it is
    read several times. A null doc_id is not smaller than any other, nor any smaller than it.
    """
    spark = rows.sparkSession
    total = hashes.agg(F.sum("n")).first()[0] or 0
    most = max(HOT_ROWS, total // SHARES)
    hot = F.broadcast(hashes.filter(F.col("n") > most).select("hash", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    sieve = spark.sparkContext.broadcast(sieve_of(hashes, "hash"))

    @F.pandas_udf("boolean")
    def passes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for hashed in batches:
            yield pd.Series(sieve.value.passes(hashed.to_numpy()))

    company = rows.filter(passes("hash")).join(hot, "hash", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    left = company.withColumn("part_no", (F.monotonically_increasing_id() % F.col("parts")).cast("int")).drop("parts")
    first = company.groupBy("hash", "text", "parts").agg(F.min("doc_id").alias("first_id"))
    right = first.select(
        F.col("hash").alias("_hash"), F.col("text").alias("_text"), "first_id",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_part_no"),
    )
    same = (
        (F.col("hash") == F.col("_hash")) & (F.col("part_no") == F.col("_part_no")) & (F.col("text") == F.col("_text"))
        & (F.col("first_id") < F.col("doc_id"))
    )
    return left.join(right, same, "left_semi").drop("part_no")


def combinations(docs: DataFrame, labels: DataFrame, repeats: str = "E") -> tuple[DataFrame, tuple[str, ...], list[str]]:
    """(part, bits, n, good, toxic) with the counts of documents by part and failed filters, the
    filters' letters in the order of their bits, and the folders it reads."""
    spark = docs.sparkSession
    rows = narrow(docs, doc_id="long", text="string", source="string").select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumn("hash", F.xxhash64("text"))
    filters = text_filters(F.col("text"), F.col("words"))
    flagged, flagged_at = written(failures(rows, filters).drop("text"), "audit-rows")
    counts = flagged.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    hashes, hashes_at = written(counts, "audit-hashes")
    again = repeated(failures(rows, filters), hashes).select("doc_id", "part", "bits")
    again, again_at = written(again, "audit-repeats")
    discard(spark, hashes_at)

    last = 1 << len(filters)
    united = (
        flagged.select("doc_id", "part", "bits", F.lit(1).alias("n"))
        .unionByName(again.withColumn("n", F.lit(-1)))
        .unionByName(again.withColumns({"bits": F.col("bits") + last, "n": F.lit(1)}))
    )
    marks = narrow(labels, doc_id="long", quality="int", toxic="int").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.expr("coalesce(quality = 1, false)")).alias("good"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic")
    )
    # rows without an id have no label; in the join they would all meet in one task
    known = united.filter("doc_id IS NOT NULL").join(marks, "doc_id", "left").drop("doc_id")
    marked = known.unionByName(united.filter("doc_id IS NULL").select("part", "bits", "n", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("toxic")))
    counted = marked.groupBy("part", "bits").agg(
        F.sum("n").alias("n"),
        *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")),
    )
    return counted, (*filters, repeats), [flagged_at, again_at]


def in_all_orders(counted: DataFrame, letters: tuple[str, ...]) -> DataFrame:
    """One row for each part, order of the filters and step, from (part, bits, n, good, toxic).

    A part's combinations are at most 2 ** len(letters), and meet as one array.
    """
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("cells"))
    orders = ",".join("".join(p) for p in permutations(letters))
    steps = parts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")
    )

    def bit(place: Column) -> Column:
        return F.expr(f"1 << (instr('{''.join(letters)}', substring(filter_order, {place}, 1)) - 1)")

    earlier = F.expr(
        f"aggregate(filter(sequence(1, {len(letters)}), k -> k < step), 0, "
        f"(mask, k) -> mask + (1 << (instr('{''.join(letters)}', substring(filter_order, k, 1)) - 1)))"
    )
    placed = steps.withColumns({"own": bit("step"), "earlier": earlier})
    own, before = F.col("own"), F.col("earlier")

    def fails(c: Column) -> Column:
        return c["bits"].bitwiseAND(own) != 0

    def gone(c: Column) -> Column:
        return c["bits"].bitwiseAND(before) != 0

    def total(of: str, condition) -> Column:
        return F.aggregate(
            F.filter("cells", condition), F.lit(0).cast("long"), lambda acc, c: acc + c[of].cast("long")
        )

    # of all orders, a filter is the first of the ones a document fails in an equal share
    share = factorial(len(letters))
    shapley = F.aggregate(
        F.filter("cells", fails),
        F.lit(0).cast("long"),
        lambda acc, c: acc + F.floor(c["n"] * share / F.bit_count(c["bits"])).cast("long"),
    )
    return placed.select(
        "part", "filter_order", "step",
        total("n", lambda c: ~fails(c) & ~gone(c)).alias("kept"),
        total("n", lambda c: fails(c) & ~gone(c)).alias("removed"),
        total("n", lambda c: fails(c) & gone(c)).alias("redundant"),
        total("n", lambda c: c["bits"] == own).alias("unique_fails"),
        total("good", lambda c: fails(c) & ~gone(c)).alias("good_lost"),
        total("toxic", lambda c: fails(c) & ~gone(c)).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of `docs` (doc_id, text, source) with `labels` (doc_id, quality, toxic).

    A null text is empty, a null source the part ''. Of rows that share id and text none is smaller
    than another; rows without id are repeats of nothing and have no label. A document is good or
    toxic if any of its labels says so. No documents: no rows. Other columns are ignored.
    """
    counted, letters, folders = combinations(docs, labels)
    cells, _ = written(counted, "audit-cells")
    discard(docs.sparkSession, *folders)
    return in_all_orders(cells, letters)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = f"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    [w FOR w IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF w <> ''] AS words,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), bits AS (
  SELECT part, good, toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN first_id < doc_id THEN 16 ELSE 0 END AS bits
  FROM texts LEFT JOIN marks USING (doc_id)
), cells AS (
  SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM bits GROUP BY part, bits
), orders AS (
  SELECT unnest(string_split('{",".join("".join(p) for p in permutations("ABCDE"))}', ',')) AS filter_order
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, 1 << (ascii(filter_order[step]) - 65) AS own,
    list_sum([0] || [1 << (ascii(filter_order[k]) - 65) FOR k IN range(1, step)])::BIGINT AS earlier
  FROM orders, range(1, 6) r(step)
), counted AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (bits & (own | earlier) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (bits & own <> 0 AND bits & earlier = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (bits & own <> 0 AND bits & earlier <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (bits = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (bits & own <> 0 AND bits & earlier = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (bits & own <> 0 AND bits & earlier = 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""
