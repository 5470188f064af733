"""Mixing sources to target weights.

Tokens are aggregated per source, targets follow the weights, a repetition rate follows from
target and size, and each document is emitted floor(rate) times plus one hash-seeded Bernoulli
copy with probability equal to the fraction.

The draw of a document is a 32-bit number from its id's md5, turned by a per-source offset. One of
`OFFSETS` evenly spaced offsets is taken, the one under which the source's words come nearest to
its target, so that a small source with a few long documents meets its target too. Every offset is
tried in one grouped pass that is summed in the map tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datawarden.llm.common import WORD, materialize, narrow

OFFSETS = 32
_TURN = 1 << 32


def word_count(text: Column) -> Column:
    """Words of the whole text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sources: DataFrame, weights: Sequence[float], share: float, most: float
) -> DataFrame:
    """(source, source_size) with `target`: `share` of all sizes dealt by weight, no target above
    `most` times its source's size, what is cut off reshared by weight.

    Water filling in closed form: in ascending order of cap per weight, the level that a source and
    those after it can share rises while sources are capped and falls from the first one that is
    not, so the water stands at its maximum. One row per source, so the windows without a
    partition see no more rows than there are sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("cap_per_weight", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.array(*(F.lit(float(w)) for w in weights))
    ranked = (
        sources.withColumn("weight", F.get(weight, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")))
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("cap_per_weight", F.col("cap") / F.col("weight"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(whole))
        .withColumn(
            "level",
            (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
        )
    )
    return ranked.withColumn("water", F.max("level").over(whole)).select(
        "source", "source_size", F.least("cap", F.col("water") * F.col("weight")).alias("target")
    )


def _draw(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _copies(draw: Column, offset: Column) -> Column:
    """floor(rate) copies, and one more when the turned draw falls below the fraction."""
    return F.col("whole") + F.when((draw + offset) % F.lit(_TURN) < F.col("threshold"), F.lit(1)).otherwise(F.lit(0)).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    rows = narrow(docs, doc_id="long", text="string", source="string")
    sized = rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), _draw(F.col("doc_id")).alias("draw"))
    return materialize(sized, "mix-sizes")


def _rates(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row for each source: source_size, target, whole, threshold and offset."""
    if not 0 <= share <= most:
        raise ValueError("share must lie between 0 and most")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = targets.withColumn("rate", rate).select(
        F.col("source").alias("_source"),
        "source_size",
        "target",
        F.floor("rate").cast("long").alias("whole"),
        F.floor((F.col("rate") - F.floor("rate")) * F.lit(float(_TURN))).cast("long").alias("threshold"),
    )
    rates = materialize(rates, "mix-rates")
    steps = [k * (_TURN // OFFSETS) for k in range(OFFSETS)]
    misses = [F.abs(F.sum(F.col("size") * _copies(F.col("draw"), F.lit(s))) - F.first("target")) for s in steps]
    tried = sized.join(rates, F.col("source").eqNullSafe(F.col("_source"))).groupBy("_source").agg(F.array(*misses).alias("misses"))
    offset = (F.array_position("misses", F.array_min("misses")) - 1) * F.lit(_TURN // OFFSETS)
    chosen = tried.select(F.col("_source").alias("_chosen"), offset.alias("offset"))
    return materialize(rates.join(chosen, F.col("_source").eqNullSafe(F.col("_chosen"))).drop("_chosen"), "mix-offsets")


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """Per row of `docs` (doc_id, text, source): doc_id, source, size, source_size, target, copies,
    taken (size times copies).

    Sources in code point order, null last, take the weights in turn. Empty and null texts have
    size 0 and take nothing. Rows with one id are taken alike; a null id draws as the empty text.
    A source without words has target 0. No rows: no rows. `share` must not exceed `most`.
    """
    sized = _sized(docs)
    rates = _rates(sized, weights, share, most)
    dealt = sized.join(rates, F.col("source").eqNullSafe(F.col("_source")))
    copies = _copies(F.col("draw"), F.col("offset"))
    return dealt.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies")).withColumn(
        "taken", F.col("size") * F.col("copies")
    )


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """The documents themselves, each as often as `mix_plan` says, with their own columns."""
    rates = _rates(_sized(docs), weights, share, most)
    rates = rates.select("_source", F.struct("whole", "threshold", "offset").alias("_rate"))
    rate = {c: F.col(f"_rate.{c}") for c in ("whole", "threshold", "offset")}
    more = (_draw(F.col("doc_id").cast("long")) + rate["offset"]) % F.lit(_TURN) < rate["threshold"]
    copies = rate["whole"] + F.when(more, F.lit(1)).otherwise(F.lit(0))
    joined = docs.join(rates, F.col("source").cast("string").eqNullSafe(F.col("_source"))).withColumn("_copies", copies.cast("int"))
    emitted = joined.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return emitted.select(*(f"`{c}`" for c in docs.columns))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS draw
  FROM documents
), sources AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         (CAST([3, 1, 2] AS DOUBLE[]))[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / weight AS cap_per_weight,
         (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER before, 0))
           / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM sources
  WINDOW before AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
         least(cap, max(level) OVER () * weight) AS target
  FROM levels
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
), joined AS (
  SELECT d.doc_id, d.source, d.size, d.draw, r.source_size, r.target, floor(r.rate)::BIGINT AS whole,
         floor((r.rate - floor(r.rate)) * 4294967296.0)::BIGINT AS threshold
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
), tried AS (
  SELECT source, o.k * 134217728 AS off,
         abs(sum(size * (whole + CASE WHEN (draw + o.k * 134217728) % 4294967296 < threshold THEN 1 ELSE 0 END)) - first(target)) AS miss
  FROM joined, (SELECT unnest(range(32)) AS k) o GROUP BY source, o.k
), chosen AS (
  SELECT source, off FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, off) = 1
)
SELECT j.doc_id, j.size, j.source_size::BIGINT AS source_size, j.target,
       (j.size * (j.whole + CASE WHEN (j.draw + c.off) % 4294967296 < j.threshold THEN 1 ELSE 0 END))::BIGINT AS taken
FROM joined j JOIN chosen c ON j.source IS NOT DISTINCT FROM c.source
"""


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")
