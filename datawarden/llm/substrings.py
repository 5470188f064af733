"""Substring dedup with suffix automata.

A window is LENGTH consecutive words of a document. A word is removed when a window that covers it
also starts in a document with a smaller id.

Broadcasting automata of the whole corpus, shard by shard, to all documents would grow with the
square of the corpus. What is searched first is therefore which shards a document has to meet:

1. Anchors: the smallest hash among a window's GRAM-word pieces. Equal windows have equal anchors, so
   only windows whose anchor stands in two documents are candidates. Anchors are about a fifth of
   the windows, and are summed in the map tasks before they move.
2. Candidate windows that stand in two documents are found by their hash, with their owner, the
   smallest id. The owners' maximal runs of them are the reference passages: each repeated passage
   once. They are dealt into shards of bounded size, by owner.
3. Every document's runs go to the shards of their owners. A shard met by many documents is dealt
   over several tasks, each with the shard's passages.
4. A task builds the suffix automaton of its shard, each state with the smallest id it occurs in, and
   streams the runs through it. Matching statistics, cut at LENGTH, say which windows occur in a
   smaller document: their words are removed.
5. The spans are joined to the documents.

Hashes only route; what is compared are sequences of 64-bit word hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datawarden.llm.common import discard, materialize, narrow, release, written
from datawarden.llm.sieve import sieve_of
from datawarden.llm.words import Block, blocks, mix

LENGTH = 13
GRAM = 6
#: Reference windows of a shard, and windows that one task streams against it, about.
SHARD, STREAM = 40_000, 200_000
_LAST = (1 << 63) - 1


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all sequences of `size` consecutive words, across documents too."""
    total = len(words) - size + 1
    if total <= 0:
        return np.zeros(0, dtype=np.uint64)
    power = lambda n: np.uint64(pow(0xD6E8FEB86659FD93, n, 1 << 64))
    out, done, part, width = np.zeros(total, dtype=np.uint64), 0, words, 1
    while width <= size:  # `part` has the sequences of `width` words, a power of two
        if size & width:
            out = out * power(width) + part[done : done + total]
            done += width
        if 2 * width <= size:
            part = part[:-width] * power(width) + part[width:]
        width *= 2
    return mix(out)


def anchors(words: np.ndarray, length: int, gram: int = GRAM) -> np.ndarray:
    """The anchor of every window: the least hash of the pieces it holds."""
    gram = min(gram, length)
    least, have, span = sequence_hashes(words, gram), 1, length - gram + 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least


def document_windows(block: Block, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows that lie in one document, and the documents."""
    total = len(block.hash) - length + 1
    if total <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    doc = block.doc_of()
    at = np.flatnonzero(doc[:total] == doc[length - 1 :])
    return at, doc[at]


class SuffixAutomaton:
    """Of word sequences added in ascending order of their documents' ids. `first` is the smallest id
    among the occurrences of a state's sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [_LAST]

    def _state(self, size: int, first: int, following: dict, link: int = 0) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A state for the shorter sequences of q, those that also end in p's with `word`."""
        following, link = self.next, self.link
        clone = self._state(self.size[p] + 1, self.first[q], dict(following[q]), link[q])
        while p >= 0 and following[p].get(word) == q:
            following[p][word] = clone
            p = link[p]
        link[q] = clone
        return clone

    def add(self, words: list[int], doc: int) -> None:
        following, link, size = self.next, self.link, self.size
        last = 0
        for word in words:
            q = following[last].get(word)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._split(last, word, q)
                continue
            state, p = self._state(size[last] + 1, doc, {}), last
            while p >= 0 and word not in following[p]:
                following[p][word] = state
                p = link[p]
            if p >= 0:
                q = following[p][word]
                link[state] = q if size[q] == size[p] + 1 else self._split(p, word, q)
            last = state

    def repeated(self, words: list[int], doc: int, length: int) -> list[tuple[int, int]]:
        """Maximal spans of `words` covered by windows that occur in a smaller document."""
        following, link, size, first = self.next, self.link, self.size, self.first
        spans, state, matched = [], 0, 0
        for i, word in enumerate(words):
            q = following[state].get(word)
            while q is None and state:
                state = link[state]
                matched = size[state]
                q = following[state].get(word)
            if q is None:
                continue
            state, matched = q, matched + 1
            if matched >= length:
                while size[link[state]] >= length:  # the state of the last `length` words
                    state = link[state]
                matched = length
                if first[state] < doc:
                    if spans and spans[-1][1] >= i - length + 1:
                        spans[-1] = (spans[-1][0], i + 1)
                    else:
                        spans.append((i - length + 1, i + 1))
        return spans


def _keyed(docs: DataFrame) -> DataFrame:
    """row: one key for each id and text; doc: the id that is compared, last for null."""
    rows = narrow(docs, doc_id="long", text="string")
    return rows.withColumns({"row": F.xxhash64("doc_id", "text"), "doc": F.coalesce("doc_id", F.lit(_LAST))})


def _longs(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).view(np.int64)) for c in columns], names=names)


def _column(batch: pa.RecordBatch, name: str, block: Block) -> np.ndarray:
    return batch.column(name).to_numpy()[block.row : block.row + block.n]


def _repeated(found: DataFrame, key: str) -> DataFrame:
    """Keys that stand in two documents, with the smaller id."""
    both = found.groupBy(key).agg(F.min("doc").alias("owner"), F.max("doc").alias("last"))
    return both.where("owner < last").drop("last")


def shared_windows(rows: DataFrame, length: int) -> tuple[DataFrame, str]:
    """(h, owner): hashes of windows in two documents, with the smallest id; and their folder."""
    spark = rows.sparkSession

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                at, owner = document_windows(block, length)
                if len(at):
                    anchor = anchors(block.hash, length)[at]
                    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
                    yield _longs(["a", "doc"], anchor[new], _column(batch, "doc", block)[owner[new]])

    shared = _repeated(rows.select("text", "doc").mapInArrow(pieces, "a long, doc long"), "a").select("a")
    shared, shared_path = written(shared, "substring-anchors")
    sieve = spark.sparkContext.broadcast(sieve_of(shared, "a"))
    discard(spark, shared_path)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                at, owner = document_windows(block, length)
                if len(at):
                    on = sieve.value.passes(anchors(block.hash, length)[at])
                    yield _longs(["h", "doc"], sequence_hashes(block.hash, length)[at[on]], _column(batch, "doc", block)[owner[on]])

    found = _repeated(rows.select("text", "doc").mapInArrow(candidates, "h long, doc long"), "h")
    found, path = written(found, "substring-windows")
    release(spark)
    return found, path


_RUNS = "row long, doc long, owner long, start long, n long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal runs of adjacent windows with one owner, from rows sorted by (row, at)."""
    held = None
    for batch in batches:
        row, doc, owner, at = (batch.column(c).to_numpy() for c in ("row", "doc", "owner", "at"))
        if held is not None:
            row, doc, owner, at = (np.concatenate([h, x]) for h, x in zip(held, (row, doc, owner, at)))
        again = np.concatenate([[False], (row[1:] == row[:-1]) & (at[1:] == at[:-1])])  # repeated rows
        row, doc, owner, at = (x[~again] for x in (row, doc, owner, at))
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)])
        begin = np.flatnonzero(new)
        last = begin[-1] if len(begin) else 0
        held = tuple(x[last:] for x in (row, doc, owner, at))  # the last run may go on
        begin, n = begin[:-1], np.diff(begin)
        yield _longs(["row", "doc", "owner", "start", "n"], row[begin], doc[begin], owner[begin], at[begin], n)
    if held is not None and len(held[0]):
        row, doc, owner, at = held
        yield _longs(["row", "doc", "owner", "start", "n"], row[:1], doc[:1], owner[:1], at[:1], np.array([len(row)]))


def window_runs(rows: DataFrame, windows: DataFrame, length: int) -> tuple[DataFrame, str]:
    """(row, doc, owner, start, n): every document's runs of shared windows, by owner; and their
    folder."""
    spark = rows.sparkSession
    sieve = spark.sparkContext.broadcast(sieve_of(windows, "h"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                at, owner = document_windows(block, length)
                if len(at):
                    h = sequence_hashes(block.hash, length)[at]
                    on = sieve.value.passes(h)
                    at, owner = at[on], owner[on]
                    yield _longs(
                        ["h", "row", "doc", "at"], h[on], _column(batch, "row", block)[owner], _column(batch, "doc", block)[owner], at - block.first[owner]
                    )

    placed = rows.select("text", "row", "doc").mapInArrow(places, "h long, row long, doc long, at long").join(windows, "h").drop("h")
    runs = placed.repartition("row").sortWithinPartitions("row", "at").mapInArrow(_runs, _RUNS)
    runs, path = written(runs, "substring-runs")
    release(spark)
    return runs, path


_TEXTS = "shard int, part int, reference boolean, row long, doc long, start long, words binary"


def _with_words(length: int):
    """The runs of each document with their words, as 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs").to_pylist()
            for block in blocks(batch.column("text")):
                out = []
                for i in range(block.n):
                    own = block.hash[block.first[i] : block.first[i + 1]]
                    for r in runs[block.row + i]:
                        words = own[r["start"] : r["start"] + r["n"] + length - 1].tobytes()
                        out.append((r["shard"], r["part"], r["reference"], r["row"], r["doc"], r["start"], words))
                if out:
                    kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    names = [f.split()[0] for f in _TEXTS.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def _matched(length: int):
    """Streams the runs of each (shard, part) through its automaton: rows come with the reference
    passages first, by ascending id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, automaton = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["shard"], r["part"]) != key:
                    key, automaton = (r["shard"], r["part"]), SuffixAutomaton()
                words = np.frombuffer(r["words"], dtype=np.int64).tolist()
                if r["reference"]:
                    automaton.add(words, r["doc"])
                else:
                    out += [(r["row"], r["start"] + a, r["start"] + b) for a, b in automaton.repeated(words, r["doc"], length)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["row", "start", "stop"])

    return run


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, start, stop): word spans that also stand in a document with a smaller id. Spans of one
    row may overlap."""
    spark = rows.sparkSession
    windows, windows_path = shared_windows(rows, length)
    runs, runs_path = window_runs(rows, windows, length)
    discard(spark, windows_path)
    total = runs.where("doc = owner").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-total // SHARD))
    runs = runs.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(shards)).cast("int")).withColumn("reference", F.col("doc") == F.col("owner"))
    loads = runs.where("NOT reference").groupBy("shard").agg(F.ceil(F.sum("n") / STREAM).cast("int").alias("parts"))
    dealt = runs.join(loads, "shard")  # a shard that nothing is streamed against is not needed
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    own = F.array(F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("reference"), every).otherwise(own)))
    # long ones of a document first meet here: bounded by its length
    listed = dealt.groupBy("row").agg(F.collect_list(F.struct("shard", "part", "reference", "row", "doc", "start", "n")).alias("runs"))
    listed, listed_path = written(listed, "substring-lists")
    discard(spark, runs_path)
    sieve = spark.sparkContext.broadcast(sieve_of(listed, "row"))

    def concerned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sieve.value.passes(batch.column("row").to_numpy())))

    texts = rows.select("row", "text").mapInArrow(concerned, "row long, text string").join(listed, "row").select("text", "runs")
    words = texts.mapInArrow(_with_words(length), _TEXTS)
    order = [F.col("shard"), F.col("part"), F.col("reference").desc(), F.col("doc")]
    spans = words.repartition("shard", "part").sortWithinPartitions(*order).mapInArrow(_matched(length), "row long, start long, stop long")
    spans = materialize(spans, "substring-spans")
    discard(spark, listed_path)
    return spans


_KEPT = "n_words long, n_removed long, kept string, kept_sha256 string"


def dedup_substrings(docs: DataFrame, length: int = LENGTH, texts: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_words, n_removed, kept (the words left, joined by
    one blank; null unless `texts`), kept_sha256, then the `carry` columns of the row.

    Null, empty and wordless texts have no words. Texts shorter than a window keep all of theirs.
    Repeats within a document, or between rows of one id, remove nothing. Null ids count as larger
    than all others and as equal to one another. No rows: no rows.
    """
    rows = _keyed(docs)
    spans = repeated_spans(rows, length)
    covered = spans.distinct().groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            for block in blocks(batch.column("text"), hashed=False):
                removed, kept, digest = np.zeros(block.n, np.int64), [], []
                for i in range(block.n):
                    a, b = int(block.first[i]), int(block.first[i + 1])
                    left, at = [], a
                    for start, stop in sorted((s["start"], s["stop"]) for s in spans[block.row + i] or ()):
                        start, stop = a + start, min(a + stop, b)
                        if start > at:
                            left.append(block.joined(at, start))
                        removed[i] += max(stop - max(start, at), 0)
                        at = max(at, stop)
                    if at < b:
                        left.append(block.joined(at, b))
                    left = b" ".join(left)
                    kept.append(left.decode() if texts else None)
                    digest.append(hashlib.sha256(left).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.row, block.n),
                        pa.array(np.diff(block.first).astype(np.int64)),
                        pa.array(removed),
                        pa.array(kept, pa.string()),
                        pa.array(digest, pa.string()),
                        *(batch.column(f"_{c}").slice(block.row, block.n) for c in carry),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256", *carry],
                )

    texts_of = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row"),
        *(F.col(f"`{c}`").alias(f"_{c}") for c in carry),
    )
    joined = texts_of.join(covered, "row", "left").drop("row")
    kinds = dict(docs.dtypes)
    return joined.mapInArrow(run, ", ".join([f"doc_id long, {_KEPT}", *(f"`{c}` {kinds[c]}" for c in carry)]))


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False).drop("kept")


SQL = r"""
WITH words AS (
  SELECT doc_id, w, i FROM (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
  )
), windows AS (
  SELECT doc_id, i, md5(string_agg(w, ' ') OVER f) AS h, count(*) OVER f AS n
  FROM words WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), marked AS (
  SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY h) AS again FROM windows WHERE n = 13
), covered AS (
  SELECT w.doc_id, w.w, w.i, coalesce(max(m.again::INT) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM words w LEFT JOIN marked m ON w.doc_id = m.doc_id AND w.i = m.i
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM covered GROUP BY doc_id
) USING (doc_id)
"""
