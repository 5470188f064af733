"""Language identification with word-first backoff.

A word that the model knows is scored by its log frequency in each language. A word it does not
know falls back to its character n-grams, from the longest down: the first length at which any
n-gram of the word is known scores it, by the mean of their log frequencies. A text's scores are
the sums over its words and the log share of each language, and the best one wins.

The model is fitted on a bounded sample of the labelled rows: in expectation PER_LANGUAGE of each
language, chosen by the hash of the id, or all where there are fewer. It keeps every word and n-gram
that occurs MIN_COUNT times in a language's sample, so the sample bounds its size. Predictions cover
every row and whole texts. Texts are lower-cased, and typographic signs end a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datawarden.llm.common import crc_remainder, narrow
from datawarden.llm.words import LETTERS, blocks, mix

PER_LANGUAGE = 3000
MIN_COUNT = 2
#: Signs outside ASCII that are no letters: quotes, dashes, dots, marks, special blanks.
SIGNS = "\u2018\u2019\u201a\u201c\u201d\u201e\u00ab\u00bb\u2039\u203a\u2010\u2011\u2012\u2013\u2014\u2015\u2026\u2022\u00b7\u00bf\u00a1\u00a0\u202f\u2009\u3000\u3001\u3002"
LENGTHS = (5, 4, 3, 2, 1)
SMOOTHING = 0.5
COUNTS = "lang string, size int, feature long, n long"


def plain(text: Column) -> Column:
    """The text as words are taken from it."""
    return F.lower(F.translate(text, SIGNS, " " * len(SIGNS)))


def _grams(data: np.ndarray, start: np.ndarray, length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, key) of all n-grams of `size` characters of the given words. The key of an ASCII one is
    its bytes; others are hashed to 62 bits and have a bit that no ASCII one has."""
    word = np.repeat(np.arange(len(start)), length)
    at = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length) + start[word]
    first = (data[at] & 0xC0) != 0x80
    word, at = word[first], at[first]
    code, inside = data[at].astype(np.uint64), np.ones(len(at), dtype=bool)
    for j in (1, 2, 3):  # the bytes of a character that follow its first
        byte = data[np.minimum(at + j, len(data) - 1)]
        inside &= (at + j < len(data)) & ((byte & 0xC0) == 0x80)
        code |= np.where(inside, byte, 0).astype(np.uint64) << np.uint64(8 * j)
    n = max(len(word) - size + 1, 0)
    begin = np.flatnonzero(word[:n] == word[size - 1 :])
    packed = np.zeros(len(begin), dtype=np.uint64)
    hashed, ascii_only = packed.copy(), np.ones(len(begin), dtype=bool)
    for j in range(size):
        c = code[begin + j]
        packed |= (c & np.uint64(0x7F)) << np.uint64(8 * j)
        hashed = mix(hashed + c + np.uint64(1))
        ascii_only &= c < 0x80
    return word[begin], np.where(ascii_only, packed, hashed >> np.uint64(2) | np.uint64(1 << 62))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (size 0) and n-grams of each language in a batch."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for block in blocks(batch.column("text"), LETTERS, block_bytes=1 << 19):
            own = langs[block.row : block.row + block.n]
            doc = block.doc_of()
            for lang in sorted(set(own)):
                mine = np.flatnonzero((own == lang)[doc]) if len(doc) else np.zeros(0, np.int64)
                sets = [(0, block.hash[mine])]
                sets += [(k, _grams(block.data, block.start[mine], block.length[mine], k)[1]) for k in LENGTHS]
                for size, values in sets:
                    feature, n = np.unique(values, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(feature), pa.string()),
                            pa.array(np.full(len(feature), size, np.int32)),
                            pa.array(feature.view(np.int64)),
                            pa.array(n.astype(np.int64)),
                        ],
                        names=["lang", "size", "feature", "n"],
                    )


class Model:
    """Log frequencies of words and n-grams by language, and the share of each language."""

    def __init__(self, rows: list[tuple], shares: dict[str, int]):
        self.langs = sorted(shares)
        total = sum(shares.values())
        self.shares = {x: shares[x] / total for x in self.langs}
        self.prior = np.log(np.array([shares[x] / total for x in self.langs])) if self.langs else np.zeros(0)
        place = {x: i for i, x in enumerate(self.langs)}
        self.keys, self.logs = {}, {}
        for size in (0, *LENGTHS):
            mine = [(f, place[lang], n) for lang, s, f, n in rows if s == size]
            feature = np.array([x[0] for x in mine], dtype=np.int64).view(np.uint64)
            keys, which = np.unique(feature, return_inverse=True)
            counts = np.zeros((len(keys), len(self.langs)))
            np.add.at(counts, (which, [x[1] for x in mine]), [x[2] for x in mine])
            smooth = counts + SMOOTHING
            self.keys[size] = keys
            self.logs[size] = np.log(smooth / smooth.sum(axis=0, keepdims=True)) if len(keys) else counts

    def look_up(self, size: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which values are known, and their rows."""
        keys = self.keys[size]
        at = np.minimum(np.searchsorted(keys, values), max(len(keys) - 1, 0))
        return (keys[at] == values) if len(keys) else np.zeros(len(values), dtype=bool), at

    def word_scores(self, data, start, length, hashes) -> np.ndarray:
        out = np.zeros((len(hashes), len(self.langs)))
        known, at = self.look_up(0, hashes)
        out[known] = self.logs[0][at[known]]
        todo = np.flatnonzero(~known)
        for size in LENGTHS:
            if not len(todo):
                break
            word, packed = _grams(data, start[todo], length[todo], size)
            hit, at = self.look_up(size, packed)
            n = np.bincount(word[hit], minlength=len(todo))
            done = n > 0
            for k in range(len(self.langs)):
                total = np.bincount(word[hit], weights=self.logs[size][at[hit], k], minlength=len(todo))
                out[todo[done], k] = total[done] / n[done]
            todo = todo[~done]
        return out


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """The model of the labelled rows (doc_id, text, lang) of `docs`."""
    rows = narrow(docs, doc_id="long", text="string", lang="string").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n_rows"))
    shares = {r["lang"]: r["n_rows"] for r in counts.collect()}  # one row for each language
    part = F.element_at(
        F.create_map(*(F.lit(x) for k, n in shares.items() for x in (k, min(1.0, per_language / n)))), F.col("lang")
    ) if shares else F.lit(0.0)
    draw = F.crc32(F.concat(F.lit("fit "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sample = rows.where(draw < part * float(1 << 32)).select("lang", plain(F.col("text")).alias("text"))
    features = sample.mapInArrow(_counted, COUNTS).groupBy("lang", "size", "feature").agg(F.sum("n").alias("n"))
    kept = features.where(F.col("n") >= MIN_COUNT).toArrow()
    return Model(list(zip(*(kept.column(i).to_pylist() for i in range(4)))), shares)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` (its doc_id, text and other columns) with lang_pred and score, which replace columns of
    these names.

    `und` with score 0 where the text is null or has no letter, or where the model has no language.
    The score is the winner's share of the likelihood; ties go to the first language by code point.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "_letters", "_plain")]
    lettered = docs.select(
        *(F.col(f"`{c}`") for c in kept),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"),
        plain(F.col("text")).alias("_plain"),
    )
    schema = docs.select(*(f"`{c}`" for c in kept)).withColumns(
        {"lang_pred": F.lit(""), "score": F.lit(0.0)}
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            letters = batch.column("_letters").to_numpy(zero_copy_only=False)
            pred, score = [], []
            for block in blocks(batch.column("_plain"), LETTERS):
                total = np.tile(m.prior, (block.n, 1))
                if len(block.hash) and m.langs:
                    hashes, sample, which = np.unique(block.hash, return_index=True, return_inverse=True)
                    words = m.word_scores(block.data, block.start[sample], block.length[sample], hashes)
                    doc = block.doc_of()
                    for k in range(len(m.langs)):
                        total[:, k] += np.bincount(doc, weights=words[which, k], minlength=block.n)
                for i in range(block.n):
                    if not m.langs or not letters[block.row + i]:
                        pred.append("und")
                        score.append(0.0)
                    else:
                        best = int(np.argmax(total[i]))
                        pred.append(m.langs[best])
                        score.append(float(1 / np.exp(total[i] - total[i][best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=[*kept, "lang_pred", "score"],
            )

    return lettered.mapInArrow(run, schema)


def held_out(doc_id) -> object:
    return crc_remainder(doc_id, 4) == 2


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    rows = narrow(docs, doc_id="long", text="string")
    return predict(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
