"""Best-fit packing by patterns.

Texts become token ids and pieces of at most one sequence's length. Packing needs only the
histogram of piece lengths, which has as many bins as a sequence has tokens, at any input size:

1. Patterns of two or three lengths that fill a sequence are enumerated over the lengths present.
2. Non-negative least squares fits their repeat counts to the histogram, and the fits are rounded
   down to what the histogram still holds.
3. What is left is packed by repeated best fit, again on counts: the longest length left opens a
   sequence, the longest that fits joins it until nothing does, and the pattern is repeated as
   often as the counts allow.

The plan is a table of (length, ranks from-to) to (sequence, offset). A piece finds its place by its
rank among the pieces of its length. Ranks are counted per (length, bucket) and offset by bucket,
so a length shared by a third of all pieces is spread over many tasks.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datawarden.llm.common import materialize, narrow
from datawarden.llm.words import bytes_of

SEQUENCE = 1024
END = 2
BUCKETS = 256
TOKENIZER = "byte_bpe_50k.json"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- tokens ---------------------------------------------------------------------------------------


class Encoder:
    """Ids of the byte-level BPE of a tokenizer file, remembered per word.

    Texts of common Latin characters are cut into the tokenizer's pre-tokens by arrays of character
    classes; each distinct pre-token is encoded once and remembered. Any other text, and any that
    holds an added token of the file, goes through the tokenizer itself. Both give the same ids.
    """

    #: Characters up to here are cut by arrays; their classes are those of the tokenizer's pattern.
    LATIN = 0x250
    FORGET = 1_500_000

    def __init__(self, path: str):
        import tiktoken
        import unicodedata
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.added = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.piece = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        kinds = np.zeros(self.LATIN, dtype=np.uint8)  # 0 other, 1 letter, 2 number, 3 space
        for c in range(self.LATIN):
            category = unicodedata.category(chr(c))
            kinds[c] = 3 if chr(c).isspace() and c not in (0x1C, 0x1D, 0x1E, 0x1F) else {"L": 1, "N": 2}.get(category[0], 0)
        self.kinds = kinds
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.keys = np.zeros(0, dtype=np.uint64)
        self.slots = np.zeros(0, dtype=np.int64)
        self.pool: list[np.ndarray] = []
        self.ids = np.zeros(0, dtype=np.uint32)
        self.at = np.zeros(1, dtype=np.int64)

    def pretokens(self, chars: np.ndarray) -> np.ndarray:
        """First characters of the pre-tokens of one text of Latin characters."""
        kind = self.kinds[chars]
        n = len(chars)
        begins = np.ones(n, dtype=bool)
        begins[1:] = kind[1:] != kind[:-1]
        space = kind == 3
        # of a run of white space before anything else, the last character stands apart from the rest
        last = space.copy()
        last[:-1] &= ~space[1:]
        last[-1] = False  # at the end of the text the run stays whole
        begins |= last
        # a blank there joins what follows
        blank = last & (chars == 32)
        joined = np.flatnonzero(blank) + 1
        begins[joined] = False
        # contractions: an apostrophe that begins a token, with the letters after it
        quotes = np.flatnonzero((chars == 39) & begins)
        if len(quotes):
            one, two = chars[np.minimum(quotes + 1, n - 1)], chars[np.minimum(quotes + 2, n - 1)]
            inside, inside2 = quotes + 1 < n, quotes + 2 < n
            single = inside & np.isin(one, [ord(c) for c in "stmd"])
            double = inside2 & (
                ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            )
            for hit, size in ((single, 2), (double & ~single, 3)):
                q = quotes[hit]
                begins[q + 1] = False
                after = q + size
                after = after[after < n]
                begins[after] |= kind[after] == 1
        return np.flatnonzero(begins)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin."""
        if len(self.at) > self.FORGET:
            self.forget()
        out: list[np.ndarray | None] = [None] * len(texts)
        plain: list[tuple[int, np.ndarray]] = []
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, dtype=np.uint32)
                continue
            chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            if int(chars.max()) < self.LATIN and not any(a in text for a in self.added):
                plain.append((i, chars))
            else:
                out[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        if plain:
            self._encode_plain(plain, texts, out)
        ids = np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)
        return ids, np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)

    def _encode_plain(self, plain, texts, out) -> None:
        from datawarden.llm.words import hash_spans16

        chars = np.concatenate([c for _, c in plain]).astype(np.uint16)
        ends = np.cumsum([len(c) for _, c in plain])
        starts = np.concatenate([self.pretokens(c) + e - len(c) for (_, c), e in zip(plain, ends)])
        lengths = np.diff(np.concatenate([starts, [len(chars)]]))
        hashes = hash_spans16(chars, starts, lengths)
        distinct, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        found = place < len(self.keys)
        found[found] = self.keys[place[found]] == distinct[found]
        slot = np.empty(len(distinct), dtype=np.int64)
        slot[found] = self.slots[place[found]]
        new = np.flatnonzero(~found)
        if len(new):
            fresh, sizes, piece = [], np.empty(len(new), dtype=np.int64), self.piece
            for k, j in enumerate(sample[new]):
                got = piece(chars[starts[j] : starts[j] + lengths[j]].tobytes().decode("utf-16-le").encode())
                sizes[k] = len(got)
                fresh.extend(got)
            slot[new] = len(self.at) - 1 + np.arange(len(new))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, np.array(fresh, dtype=np.uint32)])
            order = np.searchsorted(self.keys, distinct[new])
            self.keys = np.insert(self.keys, order, distinct[new])
            self.slots = np.insert(self.slots, order, slot[new])
        slots = slot[which]
        size = self.at[slots + 1] - self.at[slots]
        stop = np.cumsum(size)
        flat = self.ids[np.arange(stop[-1]) - np.repeat(stop - size - self.at[slots], size)]
        # where each text's tokens end: at its last pre-token
        last = np.concatenate([[0], stop[np.searchsorted(starts, ends) - 1]])
        for (i, _), a, b in zip(plain, last[:-1], last[1:]):
            out[i] = flat[a:b]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(total: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of a document's pieces: only the first may be shorter than `size`."""
    n = max(1, -(-total // size))
    first = total - (n - 1) * size
    lengths = np.full(n, size, dtype=np.int64)
    lengths[0] = first
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths


def pieces(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of `docs`: its ids, then `end`.

    Null and empty texts have the end id alone. A repeated row has its pieces again. The tokenizer's
    file must be at the same path on every executor.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = bytes_of(batch.column("text"))
            ids_of = batch.column("doc_id")
            row = 0
            while row < batch.num_rows:
                n = max(1, int(np.searchsorted(offsets, offsets[row] + (1 << 20), side="right")) - 1 - row)
                n = min(n, batch.num_rows - row)
                texts = [raw[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(row, row + n)]
                ids, at = encoder(path).encode(texts)
                doc, piece, begin, length, crc = [], [], [], [], []
                for i in range(n):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end)).astype("<u4")
                    starts, lengths = cut(len(own), size)
                    for k, (s, l) in enumerate(zip(starts, lengths)):
                        doc.append(row + i)
                        piece.append(k)
                        begin.append(int(s))
                        length.append(int(l))
                        crc.append(zlib.crc32(own[s : s + l].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [ids_of.take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32())]
                    + [pa.array(x, pa.int64()) for x in (begin, length, crc)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
                row += n

    return narrow(docs, doc_id="long", text="string").mapInArrow(run, PIECES)


# --- plan -----------------------------------------------------------------------------------------


def patterns(counts: np.ndarray, size: int, triples: int = 4096) -> list[tuple[int, ...]]:
    """Multisets of two or three lengths in the histogram that fill a sequence exactly; of the
    triples, those whose scarcest length is most frequent."""
    have = np.flatnonzero(counts[:size])
    have = have[have > 0]
    present = counts > 0
    pairs = [(int(a), size - int(a)) for a in have if a <= size - a and present[size - a]]
    found = []
    for a in have:
        b = have[(have >= a) & (size - a - have >= have)]
        c = size - a - b
        ok = present[c] & (c > 0)
        weight = np.minimum(counts[a], np.minimum(counts[b[ok]], counts[c[ok]]))
        found += [(int(w), int(a), int(x), int(y)) for w, x, y in zip(weight, b[ok], c[ok])]
        if len(found) > 8 * triples:
            found = sorted(found, reverse=True)[:triples]
    return pairs + [t[1:] for t in sorted(found, reverse=True)[:triples]]


def fit_counts(wanted: np.ndarray, columns: list[tuple[int, ...]], sweeps: int = 60) -> np.ndarray:
    """Non-negative least squares: repeats x of the patterns (columns of lengths) with A x nearest
    to the histogram, by cyclic coordinate descent, which for x >= 0 converges to the optimum."""
    if not columns:
        return np.zeros(0)
    rows = np.full((len(columns), 3), len(wanted), dtype=np.int64)
    for j, lengths in enumerate(columns):
        rows[j, : len(lengths)] = lengths
    x = [0.0] * len(columns)
    rest = [*wanted.astype(float), 0.0]
    multiplicity = [tuple((l, c.count(l)) for l in sorted(set(c))) for c in columns]
    square = [sum(m * m for _, m in c) for c in multiplicity]
    for _ in range(sweeps):
        moved = 0.0
        for j, c in enumerate(multiplicity):
            step = sum(m * rest[l] for l, m in c) / square[j]
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for l, m in c:
                    rest[l] -= m * step
        if moved < 0.25:
            break
    return np.array(x)


def plan_sequences(histogram: dict[int, int], size: int = SEQUENCE) -> pd.DataFrame:
    """(length, from_rank, to_rank, sequence, offset): the pieces of a length with ranks from
    from_rank to to_rank - 1 go to the sequences from `sequence` on, one each, at `offset`."""
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    used = np.zeros(size + 1, dtype=np.int64)
    table, sequence = [], 0

    def lay(pattern: tuple[int, ...], repeats: int) -> None:
        nonlocal sequence
        offset = 0
        for length in pattern:
            table.append((length, used[length], used[length] + repeats, sequence, offset))
            used[length] += repeats
            left[length] -= repeats
            offset += length
        sequence += repeats

    if left[size]:
        lay((size,), int(left[size]))
    found = patterns(left, size)
    fit = fit_counts(left, found)
    for j in np.argsort(-fit, kind="stable"):
        pattern = found[j]
        room = min(int(left[l]) // pattern.count(l) for l in set(pattern))
        repeats = min(int(fit[j]), room)
        if repeats > 0:
            lay(pattern, repeats)
    while left.any():
        pattern, room = [], size
        taken = np.zeros(size + 1, dtype=np.int64)
        while room:
            fits = np.flatnonzero(left[1 : room + 1] - taken[1 : room + 1] > 0)
            if not len(fits):
                break
            length = int(fits[-1]) + 1
            pattern.append(length)
            taken[length] += 1
            room -= length
        lay(tuple(pattern), min(int(left[l]) // int(taken[l]) for l in set(pattern)))
    return pd.DataFrame(table, columns=["length", "from_rank", "to_rank", "sequence", "offset"])


def place(found: DataFrame, size: int = SEQUENCE, buckets: int = BUCKETS) -> DataFrame:
    """`found` (pieces) with sequence_id and offset. The driver sees one count for each length."""
    spark = found.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    found = materialize(found.withColumn("bucket", bucket), "pack-pieces")
    cells = found.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = materialize(cells.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))), "pack-cells")
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table = plan_sequences(histogram, size)
    # at most a few rows for each length and pattern, whatever the input's size
    lengths = table["length"].to_numpy(np.int64)
    key = lengths * (1 << 48) + table["from_rank"].to_numpy(np.int64)
    order = np.argsort(key, kind="stable")
    spans = {
        "key": key[order],
        "from_rank": table["from_rank"].to_numpy(np.int64)[order],
        "sequence": table["sequence"].to_numpy(np.int64)[order],
        "offset": table["offset"].to_numpy(np.int64)[order],
    }
    shared = spark.sparkContext.broadcast(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            key = batch.column("length").to_numpy(zero_copy_only=False) * (1 << 48) + rank
            at = np.searchsorted(t["key"], key, side="right") - 1
            sequence = t["sequence"][at] + rank - t["from_rank"][at]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(t["offset"][at])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        found.withColumn("row", F.row_number().over(within))
        .join(cells.select("length", "bucket", "base"), ["length", "bucket"])
        .withColumn("rank", F.col("base") + F.col("row") - 1)
    )
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        run, f"{PIECES}, sequence_id long, offset long"
    )


def pack(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """Pieces of `docs` (doc_id, text) with their sequence and offset; see `pieces` and `place`.

    Offsets in a sequence leave no gap from 0. Repeated rows and null ids have pieces of their own.
    No rows: no pieces.
    """
    return place(pieces(docs, path, size, end), size)


def op10_pack(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
