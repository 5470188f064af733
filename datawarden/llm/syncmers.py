"""Document fingerprints from closed syncmers, with DataFrame functions only.

The symbols are the lower-cased words of a text. A k-word window is an anchor when the smallest
hash among its s-word windows stands at its first or last place. Whether a window is chosen depends
on its own words alone, so an edit changes only the anchors that touch it, and the anchors of two
texts can be matched by their place in the sequence. Of random text about 2/(k-s+1) of the windows
are anchors, and two anchors are never more than k-s words apart.

A fingerprint is the sequence of the distinct anchor hashes, in order of first place. Only k-s
consecutive windows are sure to hold an anchor: a text of fewer windows, of which none is chosen, has
one anchor, its whole word sequence. A text without words has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datawarden.llm.common import narrow

K, S = 6, 2
#: Ids in one range of the neighbour search. Ranges are sorted apart; only their heads meet.
RANGE = 64


def words_of(text: Column) -> Column:
    """Lower-cased words; an empty array for null and empty texts."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_anchors(df: DataFrame, text: str, into: str, k: int = K, s: int = S) -> DataFrame:
    """`df` with the distinct anchor hashes of a text column, in order of first place."""
    span = k - s + 1
    words, smers, n = f"{into}_words", f"{into}_smers", F.size(f"{into}_words")
    empty = F.array().cast("array<bigint>")
    hashed = F.when(
        n >= k,
        F.transform(F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(s)))),
    ).otherwise(empty)
    edge = lambda i: F.array_min(F.slice(smers, i + 1, span)) == F.least(F.get(smers, i), F.get(smers, i + span - 1))
    chosen = F.transform(
        F.filter(F.sequence(F.lit(0), n - k), edge), lambda i: F.hash(F.slice(words, i + 1, k))
    )
    none = F.array().cast("array<int>")
    whole = F.when(n > 0, F.array(F.hash(words))).otherwise(none)
    return (
        df.withColumn(words, words_of(F.col(text)))
        .withColumn(smers, hashed)
        .withColumn(into, F.when(n >= k, F.array_distinct(chosen)).otherwise(none))
        .withColumn(into, F.when(F.size(into) > 0, F.col(into)).otherwise(whole))
        .drop(words, smers)
    )


def as_text(anchors: Column) -> Column:
    return F.array_join(F.transform(anchors, lambda h: F.lower(F.right(F.lpad(F.hex(h), 8, "0"), F.lit(8)))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of anchors in common among those of either; 1 for two texts without anchors."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def with_next(rows: DataFrame, derive, span: int = RANGE) -> DataFrame:
    """`derive(rows)` of (doc_id, text) with every other column also of the next row, as `next_*`,
    in descending order of doc_id; the first row follows the last. Ties go by text; null ids come last.

    Rows are dealt by ranges of `span` ids, each sorted on its own. The last row of a range is
    followed by the head of the next one, which a join of the heads brings; only the range numbers,
    one for each range, pass a window without a partition.
    """
    dealt = rows.withColumn("_part", F.coalesce(F.floor(F.col("doc_id") / span), F.lit(-(1 << 62))))
    derived = derive(dealt)
    carried = [c for c in derived.columns if c not in ("doc_id", "_part")]
    within = Window.partitionBy("_part").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    order = F.struct(F.bitwise_not("doc_id").alias("o"), "text")  # rises as the id falls
    heads = derive(dealt.groupBy("_part").agg(F.min_by("text", order).alias("text")))
    ranges = Window.orderBy(F.col("_part").desc())
    ends = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("_part").over(ranges), F.first("_part").over(ends))
    follows = dealt.select("_part").distinct().withColumn("_after", after)
    heads = heads.select(F.col("_part").alias("_after"), F.struct(*carried).alias("_head"))
    heads = follows.join(heads, "_after").drop("_after")
    joined = derived.withColumn("_next", F.lead(F.struct(*carried)).over(within)).join(heads, "_part")
    value = F.coalesce("_next", "_head")
    return joined.withColumns({f"next_{c}": value[c] for c in carried}).drop("_part", "_next", "_head")


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """`docs` with its anchors and `fingerprint`. Null texts count as empty."""
    out = with_anchors(docs, text, "anchors", k, s)
    return out.withColumn("fingerprint", as_text(F.col("anchors")))


def edited_neighbours(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Every document beside its edited text and its next document (descending doc_id).

    Repeated ids are neighbours in order of their texts; one row alone is its own next.
    """
    rows = narrow(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    rows = with_next(rows, lambda df: with_anchors(df, "text", "anchors", k, s))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "anchors", "next_anchors", edited.alias("edited"))
    return with_anchors(rows, "edited", "edited_anchors", k, s)


def op7_syncmers(spark, sf_dir: str) -> DataFrame:
    rows = edited_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("anchors")).alias("fingerprint"),
        as_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
