"""Exact top-k search by block-max pruning.

Vectors are integers. Documents are ordered so that like ones come together, and stored in segments
of bounded size; a segment is cut into blocks of consecutive documents, and each block keeps, for
every dimension, its largest and smallest component. A query's sum over dimensions of weight times
that extreme bounds every score in the block. Blocks are visited in descending order of the bound,
scored through the block's own forward index (its rows), until the bounds fall below the k-th score.

1. Segments and query chunks are written as rows of packed arrays.
2. Each query is scored in its most promising segment, which gives a first k-th score.
3. The query goes on only to segments whose own bound reaches that score, block by block.

Segments are dealt in buckets. A bucket's segments come to a task once, before the chunks of queries
that any of them can still hold a hit for, and a chunk comes to a bucket once: nothing is repeated
for each pair of the two. Where most blocks of a segment stay open, they are scored at once.

The driver sees the segments' extremes only: at most `MAX_SEGMENTS` rows and one for each partition,
since segments grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datawarden.llm.common import materialize, small_batches

BLOCK = 64
SEGMENT = 4096
MAX_SEGMENTS = 8192
CHUNK = 512
#: Packed rows, of segments or chunks, that Python is handed at once.
BATCH = 4
#: Components of the vectors of a bucket, and buckets at least, where there are segments enough.
BUCKET, BUCKETS = 1 << 22, 64
#: Up to here sums of products are exact in doubles, and in single floats.
EXACT, EXACT_SINGLE = 2.0**53, 2.0**24

_SEGMENTS = "segment long, n int, dim int, ids binary, rows binary, low binary, high binary"
#: A segment, or queries for a bucket with their floors and the segments they are first scored in.
_WORK = "bucket int, segment long, dim int, ids binary, rows binary, low binary, high binary, floor binary, first binary"
_HITS = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(256 * x) of every component as long.

    Rows with a null id, a null vector, or a null, NaN or infinite component take no part. Rows that
    share an id count once, with the least of their vectors. Vectors may differ in length: missing
    components are 0. Components beyond the range of a long are its limits.
    """
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    v = F.col(f"`{column}`").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(F.forall("v", finite), F.lit(False)))
    rows = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * 256)).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows dealt and sorted so that vectors with the same two strongest components, and equal
    vectors, stand together. Equal ones are told apart by id, so a frequent vector is split too."""
    keyed = rows.mapInArrow(_leading, "vec_id long, v array<long>, lead int, second int")
    order = ["lead", "second", F.hash("v"), "vec_id"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "v")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of long arrays as a matrix, short rows filled with 0."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    dim = int(lengths.max()) if len(lengths) else 0
    out = np.zeros((len(lengths), dim), dtype=np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places, from 1 on, of the strongest component, negative if that is, and of the next one."""
    for batch in batches:
        m = _matrix(batch.column("v"))
        lead = second = np.zeros(len(m), dtype=np.int64)
        if m.size:
            each, size = np.arange(len(m)), np.abs(m)
            first = size.argmax(axis=1)
            lead = np.where(m[each, first] < 0, -1 - first, 1 + first)
            size[each, first] = -1
            second = 1 + size.argmax(axis=1)
        keys = [pa.array(x.astype(np.int32)) for x in (lead, second)]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), *keys], names=["vec_id", "v", "lead", "second"])


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    dim = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, dim - p.shape[1]))) for p in parts])


def _packs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of `size` consecutive rows of a partition."""
    ids, rows, held = [], [], 0
    for batch in batches:
        own, matrix, at = batch.column("vec_id").to_numpy(zero_copy_only=False), _matrix(batch.column("v")), 0
        while at < len(own):
            n = min(size - held, len(own) - at)
            ids.append(own[at : at + n])
            rows.append(matrix[at : at + n])
            held, at = held + n, at + n
            if held == size:
                yield np.concatenate(ids), _stacked(rows)
                ids, rows, held = [], [], 0
    if held:
        yield np.concatenate(ids), _stacked(rows)


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [(n, kinds[k]) for n, k in map(str.split, schema.split(", "))]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def build_index(rows: DataFrame, segment: int, block: int = BLOCK) -> DataFrame:
    """Segments of at most `segment` vectors with the extremes of their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, (ids, m) in enumerate(_packs(batches, segment)):
            starts = np.arange(0, len(ids), block)
            low, high = np.minimum.reduceat(m, starts), np.maximum.reduceat(m, starts)
            packed = [_pack(x) for x in (m, low, high)]
            yield _batch(_SEGMENTS, [((part << 32) | k, len(ids), m.shape[1], ids.astype("<i8").tobytes(), *packed)])

    return _ordered(rows).mapInArrow(run, _SEGMENTS)


def _pack(m: np.ndarray) -> bytes:
    """A matrix in the smallest integers that hold it."""
    least, most = (int(m.min()), int(m.max())) if m.size else (0, 0)
    kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= least and most <= np.iinfo(k).max)
    return m.astype(kind).tobytes()


def _unpack(data: bytes, n: int, dim: int) -> np.ndarray:
    """The `n` rows of a packed matrix."""
    return np.frombuffer(data, dtype=f"<i{len(data) // (n * dim)}").reshape(n, dim) if n * dim else np.zeros((n, dim), dtype=np.int64)


def _fit(m: np.ndarray, dim: int) -> np.ndarray:
    return m[:, :dim] if m.shape[1] >= dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))


def _numbers(*arrays: np.ndarray) -> list[np.ndarray]:
    """As floats where every sum of products is exact in them, else as Python integers."""
    most = [max(1.0, -float(a.min(initial=0)), float(a.max(initial=0))) for a in arrays]
    dim = max(a.shape[1] for a in arrays)
    bound = most[0] * max(most[1:]) * max(dim, 1)
    kind = np.float32 if bound < EXACT_SINGLE else np.float64 if bound < EXACT else object
    return [a.astype(np.int64).astype(object) if kind is object else a.astype(kind) for a in arrays]


def search_segment(
    query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray,
    ids: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray,
    k: int, block: int = BLOCK, step: int = 8,
) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's hits in one segment: its k best there that reach
    its floor. `floors` are scores that k other vectors already reach (or -inf)."""
    dim = max(queries.shape[1], rows.shape[1])
    q, m, lo, hi = _numbers(*(_fit(x, dim) for x in (queries, rows, low, high)))
    bounds = np.where(q > 0, q, 0) @ hi.T + np.where(q < 0, q, 0) @ lo.T
    out = []
    opened = (bounds >= floors[:, None]).astype(bool)
    if m.dtype != object and np.isfinite(floors).all() and 8 * opened.sum() > opened.size:
        return _dense(query_ids, q, floors, opened, ids, m, k, block)
    for i, own in enumerate(query_ids):
        order = np.argsort(-bounds[i], kind="stable")
        best_ids, best, floor, at = np.zeros(0, np.int64), np.zeros(0, m.dtype), floors[i], 0
        while at < len(order) and bounds[i, order[at]] >= floor:
            chosen = order[at : at + step]
            chosen = chosen[(bounds[i, chosen] >= floor).astype(bool)]
            at += step
            place = (chosen[:, None] * block + np.arange(block)).ravel()
            place = place[place < len(ids)]
            score = m[place] @ q[i]
            keep = (score >= floor).astype(bool) & (ids[place] != own)
            best_ids, best = np.concatenate([best_ids, ids[place][keep]]), np.concatenate([best, score[keep]])
            if len(best) > k:
                top = np.lexsort((best_ids, -best))[:k] if best.dtype != object else np.array(
                    sorted(range(len(best)), key=lambda j: (-best[j], best_ids[j]))[:k])
                best_ids, best = best_ids[top], best[top]
            if len(best) == k:
                floor = max(floor, min(best))
        limit = (1 << 63) - 1
        out += [(int(own), int(v), max(-limit - 1, min(limit, int(s)))) for v, s in zip(best_ids, best)]
    return out


def _dense(query_ids, q, floors, opened, ids, m, k, block) -> list[tuple[int, int, int]]:
    """The same for floats and finite floors, with the blocks that any of some queries has open
    scored by one product."""
    out = []
    for at in range(0, len(q), 64):
        part = slice(at, at + 64)
        rows = np.flatnonzero(np.repeat(opened[part].any(axis=0), block)[: len(ids)])
        score = q[part] @ m[rows].T
        i, j = np.nonzero(score >= floors[part, None])
        keep = ids[rows[j]] != query_ids[part][i]
        i, j = i[keep], j[keep]
        found, scores = ids[rows[j]], score[i, j].astype(np.int64)
        top = _best(i, found, scores, k)
        out += zip(query_ids[part][i[top]].tolist(), found[top].tolist(), scores[top].tolist())
    return out


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best hits, by query."""
    order = np.lexsort((ids, -scores.astype(np.float64) if len(scores) and np.abs(scores).max() < EXACT else ~scores, query))
    own = query[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def search_bucket(
    query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray | None, first: np.ndarray,
    segments: list[tuple], k: int,
) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best hits in a bucket. Without floors, in the
    segment that is its first one; with floors, in the others, and what is found raises the floors."""
    empty = np.zeros(0, np.int64)
    place, found, scores = empty, empty, empty
    at = {int(q): i for i, q in enumerate(query_ids)}
    limits = np.full(len(query_ids), -np.inf) if floors is None else floors.copy()
    for name, *segment in segments:
        on = np.flatnonzero((first == name) == (floors is None))
        if not len(on):
            continue
        hits = search_segment(query_ids[on], queries[on], limits[on], *segment, k)
        if not hits:
            continue
        q, v, s = (np.array(x, dtype=np.int64) for x in zip(*hits))
        place = np.concatenate([place, np.array([at[i] for i in q.tolist()], dtype=np.int64)])
        found, scores = np.concatenate([found, v]), np.concatenate([scores, s])
        top = _best(place, found, scores, k)
        place, found, scores = place[top], found[top], scores[top]
        last = np.flatnonzero(np.concatenate([place[1:] != place[:-1], [True]]))
        full = last[(np.bincount(place, minlength=len(at))[place[last]] == k) & (np.abs(scores[last].astype(np.float64)) < EXACT)]
        limits[place[full]] = np.maximum(limits[place[full]], scores[full])
    return list(zip(query_ids[place].tolist(), found.tolist(), scores.tolist()))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every row that
    `queries` (a condition on vec_id) selects, over all other rows; ties to the smaller vec_id.

    Fewer than k other rows: all of them. No valid rows, or no queries: no rows.
    """
    spark = vectors.sparkSession
    rows = materialize(integer_vectors(vectors, column), "topk-vectors")
    total = rows.count()
    size = max(SEGMENT, -(-total // MAX_SEGMENTS))
    index = materialize(build_index(rows, size), "topk-segments")
    extremes = index.select("segment", "n", "dim", "low", "high").mapInArrow(_segment_extremes, "segment long, dim int, low binary, high binary")
    known = extremes.collect()  # bounded: see MAX_SEGMENTS
    dim = max((r["dim"] for r in known), default=0)
    segments = np.array([r["segment"] for r in known], dtype=np.int64)
    low = np.concatenate([_fit(_unpack(r["low"], 1, r["dim"]), dim) for r in known]) if dim else np.zeros((len(known), 0), np.int64)
    high = np.concatenate([_fit(_unpack(r["high"], 1, r["dim"]), dim) for r in known]) if dim else low
    per = max(1, min(BUCKET // (size * max(dim, 1)), len(known) // BUCKETS))
    shared = spark.sparkContext.broadcast((segments, low, high))
    cells = "chunk long, dim int, ids binary, rows binary"

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for c, (ids, m) in enumerate(_packs(batches, CHUNK)):
            yield _batch(cells, [((part << 32) | c, m.shape[1], ids.astype("<i8").tobytes(), _pack(m))])

    chunked = materialize(_ordered(rows.where(queries)).mapInArrow(chunks, cells), "topk-queries")

    def reach(m: np.ndarray) -> np.ndarray:
        _, lo, hi = shared.value
        d = max(m.shape[1], lo.shape[1])
        q, lo, hi = _numbers(*(_fit(x, d) for x in (m, lo, hi)))
        return np.where(q > 0, q, 0) @ hi.T + np.where(q < 0, q, 0) @ lo.T

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = {int(x): i // per for i, x in enumerate(shared.value[0])}
        for row in (r for b in batches for r in b.to_pylist()):
            yield _batch(_WORK, [(bucket[row["segment"]], row["segment"], *(row[c] for c in ("dim", "ids", "rows", "low", "high")), None, None)])

    def asked(bucket: int, ids: np.ndarray, m: np.ndarray, floor: np.ndarray | None, first: np.ndarray) -> pa.RecordBatch:
        floor = None if floor is None else floor.astype("<f8").tobytes()
        return _batch(_WORK, [(bucket, None, m.shape[1], ids.astype("<i8").tobytes(), _pack(m), None, None, floor, first.astype("<i8").tobytes())])

    def work(seed: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = shared.value[0]
            for row in (r for b in batches for r in b.to_pylist()):
                ids = np.frombuffer(row["ids"], "<i8")
                m = _unpack(row["rows"], len(ids), row["dim"])
                bound = reach(m)
                best = np.argmax(bound, axis=1)
                if seed:
                    for bucket in np.unique(best // per):
                        on = best // per == bucket
                        yield asked(int(bucket), ids[on], m[on], None, names[best[on]])
                    continue
                floors = {f["query_id"]: f["score"] for f in row["floors"] or ()}
                floor = np.array([float(floors.get(int(i), -np.inf)) for i in ids])
                floor = np.where(np.abs(floor) < EXACT, floor, np.nextafter(floor, -np.inf))
                open_ = (bound >= floor[:, None]).astype(bool)
                open_[np.arange(len(ids)), best] = False
                for bucket in range(-(-len(names) // per)):
                    on = open_[:, bucket * per : (bucket + 1) * per].any(axis=1)
                    if on.any():
                        yield asked(bucket, ids[on], m[on], floor[on], names[best[on]])

        return run

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for row in (r for b in batches for r in b.to_pylist()):
            if row["bucket"] != bucket:
                bucket, held = row["bucket"], []
            ids, dim = np.frombuffer(row["ids"], "<i8"), row["dim"]
            if row["segment"] is not None:
                blocks = -(-len(ids) // BLOCK)
                held.append((row["segment"], ids, _unpack(row["rows"], len(ids), dim), *(_unpack(row[c], blocks, dim) for c in ("low", "high"))))
                continue
            floor = None if row["floor"] is None else np.frombuffer(row["floor"], "<f8")
            hits = search_bucket(ids, _unpack(row["rows"], len(ids), dim), floor, np.frombuffer(row["first"], "<i8"), held, k)
            yield _batch(_HITS, hits)

    kept = index.mapInArrow(stored, _WORK)

    def scored(work: DataFrame) -> DataFrame:
        # a bucket's segments come before its queries
        dealt = kept.unionByName(work).repartition("bucket").sortWithinPartitions("bucket", F.col("segment").asc_nulls_last())
        return dealt.mapInArrow(score, _HITS)

    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def best(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)

    with small_batches(spark, BATCH):
        first = scored(chunked.mapInArrow(work(True), _WORK))
        first = materialize(best(first).select("query_id", "vec_id", "score", "rank"), "topk-first")
        # a chunk's own floors, at most one for each of its queries
        floors = first.where(F.col("rank") == k).select("query_id", "score")
        owner = chunked.select("chunk", "ids").mapInArrow(_query_ids, "query_id long, chunk long")
        floors = owner.join(floors, "query_id").groupBy("chunk").agg(F.collect_list(F.struct("query_id", "score")).alias("floors"))
        later = materialize(scored(chunked.join(floors, "chunk", "left").mapInArrow(work(False), _WORK)), "topk-later")
    merged = first.select("query_id", "vec_id", "score").unionByName(later)
    return best(merged).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _segment_extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = "segment long, dim int, low binary, high binary"
    for row in (r for b in batches for r in b.to_pylist()):
        blocks = -(-row["n"] // BLOCK)
        low, high = _unpack(row["low"], blocks, row["dim"]), _unpack(row["high"], blocks, row["dim"])
        yield _batch(schema, [(row["segment"], row["dim"], _pack(low.min(axis=0)), _pack(high.max(axis=0)))])


def _query_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in (r for b in batches for r in b.to_pylist()):
        ids = np.frombuffer(row["ids"], "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), row["chunk"]))], names=["query_id", "chunk"])


SQL = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM valid q JOIN valid c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


def op2_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
