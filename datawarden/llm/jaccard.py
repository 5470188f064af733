"""N-gram Jaccard join: exact, in the metric space of Jaccard distances.

A document's point is its set of distinct word shingles. Two points within RADIUS of each other are
linked; the result is each document's component under links.

Distances between unrelated texts are all about 1, so no small set of pivots tells them apart: with
pivots taken from a sample, every document lies in the window of every region. The pivots are
therefore chosen where points can be near, by a filter that loses no link: in any fixed order of all
shingles, two linked sets share m among their first n - ceil(t n) + m. The order is by hash, with
the most frequent shingles last, so passages that many documents share seldom enter these prefixes;
and m grows with n, so a long document that shares a few passages with others is no candidate.

1. Sets are written once. Equal sets are one point from here on.
2. The points that share a prefix shingle are chained by size: linked ones differ by less than
   1 - t, so a wider gap parts them. A point stays if it has company for m of its prefix shingles.
   The sets of those that stay are written, each once.
3. Among them, all shingles are counted and prefixes taken again, the rarest shingles first: a copy
   with many changes begins with its own, and meets nobody. The place of the first shingle that two
   sets share also bounds the size of the other one, a point's reach in that chain.
   In each chain, the point with the most frequent shingles (the centre of a group of copies) is the
   pivot. A point belongs to the region of every pivot in whose chains it is; points near a border
   belong to several.
4. A region computes its points' distances to the pivot. Points within RADIUS are linked to it and
   need no pair among themselves. For the others, a triangle-inequality window bounds the distance
   to the pivot of any point they can be linked with; the region is joined again around the next
   pivot within the window, until no pair is open. Distances to all pivots so far narrow it.
5. A region too large for a task is dealt over several by size, each with the pivot. Points not linked
   to the pivot are replicated to the other parts with sizes in their reach.
6. Links of all regions are joined into components by rounds of label passing.

Every comparison is of whole sets, and exact up to 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datawarden.llm.common import discard, materialize, narrow, release, small_batches, written
from datawarden.llm.sieve import sieve_of
from datawarden.llm.words import Block, blocks, mix, windows

SHINGLE = 4
#: Links: PERCENT * union <= 100 * intersection.
PERCENT = 85
#: Percent of a set's size by which prefixes are longer than one common shingle needs.
EXTRA = 5
#: Frequent shingles put last: counts from HOT on, at most HOT_MOST of them.
HOT, HOT_MOST = 16, 1 << 17
#: Points of a region that one task joins.
PART = 512

_TOP = np.uint64(1) << np.uint64(63)


# --- sets -----------------------------------------------------------------------------------------


def shingle_sets(block: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a block's documents, one after the other, and where each
    document's begin. A text of fewer words has its whole sequence as one shingle."""
    at, hashes = windows(block, size)
    words = np.diff(block.first)
    first = np.searchsorted(at, block.first)
    hashes &= ~_TOP
    whole = {}
    for short in range(1, size):
        if (words == short).any():
            w_at, w_hash = windows(block, short)
            for i in np.flatnonzero(words == short):
                whole[i] = w_hash[np.searchsorted(w_at, block.first[i])][None] & ~_TOP
    sets = []
    for i in range(block.n):
        own = whole[i] if i in whole else np.sort(hashes[first[i] : first[i + 1]])
        sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _write_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), lower=True, block_bytes=1 << 19):
                values, at = shingle_sets(block, size)
                n = np.diff(at)
                # of a set: order-free sum of spread hashes
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(0x5BD1E995)), dtype=np.uint64)])
                node = mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.row, block.n),
                        batch.column("row").slice(block.row, block.n),
                        pa.array(node),
                        pa.array(n),
                        pa.array([values[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()),
                    ],
                    names=["doc_id", "row", "node", "n", "shingles"],
                )

    return run


def document_sets(docs: DataFrame, size: int = SHINGLE) -> tuple[DataFrame, str]:
    """(doc_id, row, node, n, shingles) and their folder: row is a key of id and text, node 64 bits of
    the set, equal for equal sets."""
    rows = narrow(docs, doc_id="long", text="string").withColumn("row", F.xxhash64("doc_id", "text"))
    schema = "doc_id long, row long, node long, n long, shingles binary"
    return written(rows.mapInArrow(_write_sets(size), schema), "jaccard-sets")


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Of two linked sets, these many first elements of each share `common` of the smaller size."""
    return n - -(-(n * percent) // 100) + 1 + n * EXTRA // 100


class Order:
    """The fixed order of all shingles: by hash, the frequent ones last."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = np.sort(frequent)
        self.small = np.zeros(1 << 22, dtype=bool)
        self.small[(self.frequent >> np.uint64(41)).astype(np.int64)] = True

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """Sort keys: the hash, with the top bit set for frequent shingles."""
        maybe = np.flatnonzero(self.small[(shingles >> np.uint64(41)).astype(np.int64)])
        out = shingles.copy()
        if len(maybe) and len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, shingles[maybe]), len(self.frequent) - 1)
            out[maybe[self.frequent[at] == shingles[maybe]]] |= _TOP
        return out

    def prefixes(self, shingles: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(set, key) of the prefixes of sorted sets."""
        keys = self.keys(shingles)
        n = np.diff(at)
        owner = np.repeat(np.arange(len(n)), n)
        hot = keys >= _TOP
        # sets are sorted by hash already: a stable partition into rare and frequent is the order
        rare = np.cumsum(~hot)
        rare_before = np.concatenate([[0], rare])[at[:-1]]
        rare_in = np.concatenate([[0], rare])[at[1:]] - rare_before
        place = np.arange(len(keys)) - at[owner]
        rank = np.where(hot, rare_in[owner] + place - (rare - rare_before[owner]), rare - 1 - rare_before[owner])
        keep = rank < prefix_length(n, percent)[owner]
        return owner[keep], keys[keep]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of packed sets."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if len(column) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), dtype=np.uint64), (offsets - offsets[0]) // 8


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


# --- regions --------------------------------------------------------------------------------------


def frequent_shingles(sets: DataFrame, percent: int = PERCENT) -> np.ndarray:
    """Shingles that stand in many prefixes by hash: HOT_MOST at most, by falling count."""
    plain = Order(np.zeros(0, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            _, keys = plain.prefixes(*_flat(batch.column("shingles")), percent)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["h"])

    counts = sets.select("shingles").mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= HOT)
    counts = materialize(counts, "jaccard-frequent")
    step = F.floor(F.log2("count") * 16).cast("int")
    held, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("count").alias("least")).collect(), reverse=True):
        if held + r["n"] > HOT_MOST:
            break
        held, least = held + r["n"], r["least"]
    if least is None:
        return np.zeros(0, dtype=np.uint64)
    return counts.where(F.col("count") >= least).select("h").toArrow().column("h").to_numpy().view(np.uint64)


def _company(found: DataFrame, percent: int) -> DataFrame:
    """The rows (h, node, n, ...) that have another one of their shingle next to them in size."""
    by_size = Window.partitionBy("h").orderBy("n", "node")
    smaller = F.coalesce(F.lag("n").over(by_size) * 100 >= F.col("n") * percent, F.lit(False))
    larger = F.coalesce(F.col("n") * 100 >= F.lead("n").over(by_size) * percent, F.lit(False))
    return found.withColumn("near", smaller | larger).where("near").drop("near")


def _kept(company: DataFrame, percent: int) -> DataFrame:
    """(node): points with company for as many prefix shingles as a link needs."""
    least = F.floor(F.floor(F.col("n") * percent / 100) * EXTRA / 100) + 1
    kept = company.groupBy("node").agg(F.count("*").alias("met"), F.min("n").alias("n"))
    return kept.where(F.col("met") >= least).select("node")


def candidates(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node): every point that has a link, and others; by prefixes in the order of hashes."""
    spark = sets.sparkSession
    order = spark.sparkContext.broadcast(Order(frequent_shingles(sets, percent)))
    release(spark)

    def postings(batches: Iterator[pa.RecordBatch], passes=None) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            shingles, at = _flat(batch.column("shingles"))
            owner, keys = order.value.prefixes(shingles, at, percent)
            if passes is not None:
                keep = passes(keys.view(np.int64))
                owner, keys = owner[keep], keys[keep]
            node, n = batch.column("node").to_numpy(), np.diff(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(node[owner]), pa.array(n[owner])], names=["h", "node", "n"]
            )

    schema, rows = "h long, node long, n long", sets.where("n > 0").select("node", "shingles")
    shared = (
        rows.mapInArrow(postings, schema)
        .groupBy("h")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"))
        .where("low < high")
        .select("h")
    )
    shared, path = written(shared, "jaccard-shared")
    sieve = spark.sparkContext.broadcast(sieve_of(shared, "h"))
    discard(spark, path)
    # shingles that only passed the sieve have one point, and no company below
    found = rows.mapInArrow(lambda b: postings(b, sieve.value.passes), schema).distinct()
    company = materialize(_company(found, percent), "jaccard-company")
    kept = materialize(_kept(company, percent), "jaccard-candidates")
    order.destroy()
    sieve.destroy()
    release(spark)
    return kept


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches, 64):
        shingles, at = _flat(batch.column("shingles"))
        n = np.diff(at)
        node = batch.column("node").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(shingles.view(np.int64)), pa.array(np.repeat(node, n)), pa.array(np.repeat(n.astype(np.int32), n))], names=["h", "node", "n"]
        )


def rare_prefixes(held: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(h, node, n, reach, off): prefixes in the order of counts among `held`, without the shingles of
    one point only, which come first. Two linked points are within each other's reach at the first
    shingle that they share: their overlap is at most what follows from there. `off` is the lower
    the more frequent all of a point's shingles are."""
    counts = F.count("*").over(Window.partitionBy("h"))
    rows = held.mapInArrow(_all_shingles, "h long, node long, n int").withColumn("met", counts).where("met > 1")
    own = Window.partitionBy("node")
    # from 1 on; the shingles of this point only stand before all that are left
    rank = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("met", "h"))
    rows = rows.withColumn("rank", rank).withColumn("off", -F.floor(F.sum(F.log2("met")).over(own) * 100 / F.col("n")))
    rows = rows.where(F.expr(f"rank <= n - (n * {percent} + 99) div 100 + 1 + n * {EXTRA} div 100"))
    reach = F.expr(f"(n - rank + 1) * {100 + percent} div {percent} - n")
    return rows.select("h", "node", F.col("n").cast("long").alias("n"), reach.cast("long").alias("reach"), F.col("off").cast("int").alias("off"))


def regions(held: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(region, node, n, reach): the points of each pivot's region, the pivot among them, and the
    largest size that a partner in the region can have. A region's name is its pivot's node."""
    company = materialize(_company(rare_prefixes(held, percent), percent), "jaccard-company")
    # drops points and so the company of others; more rounds would be right too, and drop few
    company = _company(company.join(_kept(company, percent), "node", "left_semi"), percent)
    company = materialize(company, "jaccard-company")

    def chained(rows: DataFrame) -> DataFrame:
        by_size = Window.partitionBy("h").orderBy("n", "node")
        smaller = F.coalesce(F.lag("n").over(by_size) * 100 >= F.col("n") * percent, F.lit(False))
        return rows.withColumn("cut", F.when(smaller, 0).otherwise(1)).withColumn("chain", F.sum("cut").over(by_size)).drop("cut")

    chain = Window.partitionBy("h", "chain")
    # who reaches no size in the chain has its first shared shingle elsewhere
    reaching = chained(company).withColumn("least", F.min("n").over(chain)).where("reach >= least").drop("chain", "least")
    pivots = chained(_company(reaching, percent)).withColumn("pivot", F.min(F.struct("off", "node")).over(chain))
    members = pivots.groupBy(F.col("pivot.node").alias("region"), "node").agg(F.max("n").alias("n"), F.max("reach").alias("reach"))
    members = materialize(members, "jaccard-regions")
    release(held.sparkSession)
    return members


# --- joins within a region ------------------------------------------------------------------------


class Points:
    """The sets of a region's points, with exact overlaps of one point with many at once. `reach` is
    the largest size of a set that each can be linked with here."""

    def __init__(self, sets: list[np.ndarray], percent: int, reach: np.ndarray):
        self.sets, self.percent, self.reach = sets, percent, reach
        self.n = np.array([len(s) for s in sets], dtype=np.int64)

    def overlap(self, p: int, others: np.ndarray) -> np.ndarray:
        values = np.concatenate([self.sets[i] for i in others])
        own = self.sets[p]
        at = np.minimum(np.searchsorted(own, values), len(own) - 1)
        return np.bincount(np.repeat(np.arange(len(others)), self.n[others]), weights=own[at] == values, minlength=len(others)).astype(np.int64)

    def linked(self, p: int, others: np.ndarray, overlap: np.ndarray) -> np.ndarray:
        return 100 * overlap >= self.percent * (self.n[p] + self.n[others] - overlap)

    def distance(self, p: int, others: np.ndarray, overlap: np.ndarray) -> np.ndarray:
        return 1 - overlap / (self.n[p] + self.n[others] - overlap)


def join_region(points: Points, pivot: int, open_: np.ndarray, slack: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links (a spanning forest of them) among a region's points, and which are linked to the pivot.

    `open_` says which points still need partners other than through the pivot; a pair of which
    neither is open is left to other parts of the region.
    """
    m = len(points.sets)
    root = np.arange(m)
    links: list[tuple[int, int]] = []

    def join(a: int, b: int) -> None:
        if root[a] != root[b]:
            links.append((a, b))
            root[root == root[b]] = root[a]

    everyone = np.arange(m)
    overlap = points.overlap(pivot, everyone)
    near = points.linked(pivot, everyone, overlap)
    table = [points.distance(pivot, everyone, overlap)]
    for i in np.flatnonzero(near):
        if i != pivot:
            join(pivot, int(i))
    # pairs of two points linked to the pivot are settled; the others are joined around new pivots
    todo = everyone[~near & open_]
    settled = np.zeros(m, dtype=bool)
    settled[pivot] = True
    for p in todo[np.argsort(table[0][todo], kind="stable")]:
        others = everyone[~settled & (everyone != p)]
        others = others[root[others] != root[p]]
        others = others[(points.n[others] <= points.reach[p]) & (points.n[p] <= points.reach[others])]
        small, large = np.minimum(points.n[others], points.n[p]), np.maximum(points.n[others], points.n[p])
        others = others[100 * small >= points.percent * large]
        for d in table[:1] + table[1:][-7:]:
            others = others[~(np.abs(d[others] - d[p]) > slack)]  # an unknown distance (NaN) rules nothing out
        settled[p] = True
        if not len(others):
            continue
        overlap = points.overlap(p, others)
        for i in others[points.linked(p, others, overlap)]:
            join(int(p), int(i))
        if len(others) >= 32:
            d = np.full(m, np.nan)
            d[others] = points.distance(p, others, overlap)
            d[p] = 0.0
            table.append(d)
    return links, near


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one (region, part) after the other, from a partition sorted by them."""
    key, held = None, []
    for batch in _sliced(batches, 64):
        for row in batch.to_pylist():
            if (row["region"], row["part"]) != key:
                if held:
                    yield held
                key, held = (row["region"], row["part"]), []
            held.append(row)
    if held:
        yield held


_LINKS = "a long, b long, region long, part int, node long"


def _join_parts(percent: int, second: bool):
    """Joins the groups of a partition. First pass: all pairs of a part, and the points that are not
    linked to the pivot of a divided region. Second pass: those points, replicated, against the
    points of the other parts."""
    slack = 1 - percent / 100 + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            nodes = [r["node"] for r in rows]
            region = rows[0]["region"]
            if region not in nodes:
                continue  # a part that only holds replicas
            reach = np.array([r["reach"] for r in rows], dtype=np.int64)
            points = Points([np.frombuffer(r["shingles"], dtype=np.uint64) for r in rows], percent, reach)
            pivot = nodes.index(region)
            foreign = np.array([bool(r["foreign"]) for r in rows])
            links, near = join_region(points, pivot, foreign if second else np.ones(len(rows), dtype=bool), slack)
            out = [(nodes[a], nodes[b], None, None, None) for a, b in links]
            if not second and rows[0]["parts"] > 1:
                out += [(None, None, region, rows[0]["part"], n) for n, ok in zip(nodes, near) if not ok]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                names = [f.split()[0] for f in _LINKS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def _dealt(members: DataFrame) -> DataFrame:
    return members.repartition("region", "part").sortWithinPartitions("region", "part")


def active_sets(sets: DataFrame, nodes: DataFrame) -> tuple[DataFrame, str]:
    """(node, shingles) of these points, each once, and their folder."""
    spark = sets.sparkSession
    active = spark.sparkContext.broadcast(sieve_of(nodes, "node"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # equal sets leave a task once
        for batch in _sliced(batches):
            node = batch.column("node").to_numpy()
            keep = []
            for i in np.flatnonzero(active.value.passes(node)):
                if int(node[i]) not in sent:
                    sent.add(int(node[i]))
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    held = sets.where("n > 0").select("node", "shingles").mapInArrow(once, "node long, shingles binary")
    held = held.join(nodes, "node", "left_semi").dropDuplicates(["node"])
    held, path = written(held, "jaccard-active")
    active.destroy()
    release(spark)
    return held, path


def region_links(held: DataFrame, members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links that connect what the regions' links connect."""
    spark = held.sparkSession
    region = Window.partitionBy("region")
    # in parts of like sizes, so that a reach leaves parts out
    place = F.row_number().over(region.orderBy("n", "node")) - 1
    placed = members.withColumn("parts", F.ceil(F.count("*").over(region) / PART).cast("int"))
    placed = materialize(placed.withColumn("part", F.floor(place / PART).cast("int")), "jaccard-parts")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    # the pivot goes to every part of its region
    own = placed.where("node <> region").unionByName(placed.where("node = region").withColumn("part", every))
    first = own.withColumn("foreign", F.lit(False)).join(held, "node")
    links = materialize(_dealt(first).mapInArrow(_join_parts(percent, False), _LINKS), "jaccard-links")
    release(spark)
    # points beyond the pivot's reach, in the parts that they have not met and that hold sizes in their own
    ranges = placed.where("parts > 1").groupBy("region", "part")
    ranges = ranges.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("reach").alias("most"))
    loose = links.where("node IS NOT NULL").select("region", "node", F.col("part").alias("home"))
    loose = loose.join(placed.drop("part"), ["region", "node"]).join(ranges, "region").where("part <> home")
    loose = loose.where(f"reach >= low AND n <= most AND high * 100 >= n * {percent}")
    loose = materialize(loose.withColumn("foreign", F.lit(True)).select(*own.columns, "foreign"), "jaccard-loose")
    divided = own.join(loose.select("region", "part").distinct(), ["region", "part"], "left_semi").withColumn("foreign", F.lit(False))
    second = divided.unionByName(loose).join(held, "node")
    more = _dealt(second).mapInArrow(_join_parts(percent, True), _LINKS)
    return materialize(links.select("a", "b").unionByName(more.select("a", "b")).where("a IS NOT NULL").distinct(), "jaccard-forest")


# --- components -----------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link: the smallest node that it reaches.

    Rounds of star contraction: every node points to the smallest node that it or a neighbour points
    at, first from the larger to the smaller side, then from the smaller; a round at least halves
    long chains. Each round is written, so that a lost executor costs one round's tasks.
    """
    spark = links.sparkSession
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = links.where("a <> b")
    while True:
        # large star: neighbours above a node point to the least of its neighbourhood
        near = both(edges)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and the neighbours below it point to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        below = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = below.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = materialize(after, "jaccard-round")
        # done when every node points to a root: none is pointed at and points elsewhere
        stars = after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty()
        single = after.groupBy("a").count().where("count > 1").isEmpty()
        edges = after
        release(spark)
        if stars and single:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def labelled(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, row, n, component): the component's name is the least node in it."""
    spark = docs.sparkSession
    with small_batches(spark):
        sets, sets_path = document_sets(docs, size)
        points = materialize(sets.select("doc_id", "row", "node", "n"), "jaccard-points")
        held, held_path = active_sets(sets, candidates(sets, percent))
        discard(spark, sets_path)
        members = regions(held, percent)
        links = region_links(held, members, percent)
        discard(spark, held_path)
    rows = points.join(components(links), "node", "left")
    return rows.select("doc_id", "row", "n", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of `docs` (doc_id, text).

    Words are lower-cased (A-Z). Null, empty and wordless texts have the empty set, are linked with
    nothing and are their own component. Repeated rows have equal sets and so one component; rows
    that share an id are points of their own. Null ids take part, but are never a component's name
    unless it has no other. No rows: no rows.
    """
    rows = labelled(docs, size, percent)
    names = materialize(rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("name")), "jaccard-names")
    return rows.join(names, "component", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("name")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`docs` with one row of each component: that of the smallest id (a null one last). Texts
    without words stay, but for repeated rows."""
    rows = labelled(docs, size, percent)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    kept = rows.where("n > 0").groupBy("component").agg(F.min(order).alias("kept")).select(F.col("kept.row").alias("_row"))
    kept = materialize(kept.unionByName(rows.where("n = 0").select(F.col("row").alias("_row"))).distinct(), "jaccard-kept")
    keyed = docs.withColumn("_row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return keyed.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
