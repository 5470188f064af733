"""From raw documents to packed training sequences, in five written stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datawarden.llm import jaccard, language, mixing, packing, substrings
from datawarden.llm.common import materialize, release, ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Of the near-duplicate stage; the defaults of `jaccard` are those of the query op4 alone. Fixed values.
SHINGLE, PERCENT = 5, 80
#: Of the language stage.
MIN_SHARE, MIN_SCORE = 0.01, 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a target language, with the predicted one as their `lang`.

    Targets are the languages of at least MIN_SHARE of the labelled documents. A document goes if it has
    no letter, if its language is no target, if the others together are likelier (MIN_SCORE), or if
    its text makes its language no likelier than the share of that language alone does: then no
    part of it is known to the model.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    model = language.fit(docs)
    share = F.lit(None).cast("double")
    for name, part in model.shares.items():
        if part >= MIN_SHARE:
            share = F.when(F.col("lang_pred") == name, part).otherwise(share)
    kept = language.predict(docs, model).where((F.col("score") >= MIN_SCORE) & ((F.col("score") > share * (1 + 1e-9)) | (share == 1)))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by an overlap of 0.8 in shingles
    of five words."""
    ship(spark)
    return jaccard.one_of_each(docs.select(*COLUMNS), size=SHINGLE, percent=PERCENT)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in a document with a smaller id. An untouched text stays
    as it is; a document of which no word is left goes."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    found = substrings.dedup_substrings(docs, carry=("text", "lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    found = found.where("n_removed = 0 OR n_removed < n_words")
    return found.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources meet their target weights."""
    ship(spark)
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in a sequence of at most 1024 tokens."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: Language scores, 64-bit hashes and token ids have no SQL form; tests check the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
