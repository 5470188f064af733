import math
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from datawarden.llm import jaccard, suffix_tree, topk
from datawarden.llm.common import ship
from datawarden.llm.words import Sorted

DOCS = "doc_id long, text string, n_shingles int, score double, component_id long"
VECTORS = "vec_id long, embedding array<float>, rank int, score double"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


# --- top-k ---


def _brute(rows, k=5, every=3):
    kept = {}
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(256 * float(np.float32(x))) for x in v]
        kept[i] = min(kept.get(i, ints), ints)
    out = []
    for q, a in kept.items():
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 1, 0.5) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8, 1, 0.5) for i in range(150)]  # one frequent vector
    rows += [(2000, None, 0, 0.0), (2001, [1.0, None], 0, 0.0), (2004, [math.nan] * 8, 0, 0.0), (2007, [math.inf] * 8, 0, 0.0)]
    rows += [(None, [1.0] * 8, 0, 0.0), (-3, [-1.0] * 8, 0, 0.0), (6, rows[6][1], 0, 0.0), (3000, [0.25, 0.5], 0, 0.0), (3003, [], 0, 0.0)]
    monkeypatch.setattr(topk, "SEGMENT", 100)
    monkeypatch.setattr(topk, "CHUNK", 7)
    out = topk.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 3 == 0)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, out.collect())) == _brute(rows)


@pytest.mark.parametrize("scale", [1.0, 3000.0, 2.0**30])
def test_top_k_in_buckets_matches_brute_force(spark, monkeypatch, scale):
    """Several segments a bucket and several buckets; products in single floats, doubles and integers."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in scale * rng.normal(size=6)], 1, 0.5) for i in range(400)]
    rows += [(1000 + i, [0.25 * scale] * 6, 1, 0.5) for i in range(60)]
    for name, value in (("SEGMENT", 64), ("CHUNK", 16), ("BUCKET", 64 * 6 * 2), ("BUCKETS", 1), ("BATCH", 1)):
        monkeypatch.setattr(topk, name, value)
    out = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 3 == 0).collect()))
    limit = (1 << 63) - 1
    want = [(q, r, i, max(-limit - 1, min(limit, s))) for q, r, i, s in _brute(rows)]
    assert out == want if scale < 2**30 else [(q, r, s) for q, r, _, s in out] == [(q, r, s) for q, r, _, s in want]


def test_a_chunk_of_queries_is_not_repeated_for_each_query():
    n, dim = topk.CHUNK, 64
    packed = [pa.array([x], pa.binary()) for x in (np.arange(n).astype("<i8").tobytes(), np.ones((n, dim), "<i8").tobytes())]
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([dim], pa.int32()), *packed], names=["chunk", "dim", "ids", "rows"])
    out = list(topk._query_ids(iter([batch])))
    assert sum(b.num_rows for b in out) == n
    assert sum(b.nbytes for b in out) < batch.nbytes


def test_top_k_small_inputs(spark):
    few = spark.createDataFrame([(0, [1.0], 0, 0.0), (1, [2.0], 0, 0.0)], VECTORS)
    assert [tuple(r) for r in topk.top_k(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(few, F.col("vec_id") == 9).collect() == []
    assert topk.top_k(few.where("vec_id < 0"), F.col("vec_id") == 0).collect() == []
    large = spark.createDataFrame([(i, [float(2**40 + i * 2**20), 3.0], 0, 0.0) for i in range(6)], VECTORS)
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(large, F.col("vec_id") == 0).collect()}
    assert got[(0, 5)] == min((1 << 63) - 1, 2**48 * (2**48 + 5 * 2**28) + 768 * 768)


def test_blocks_are_pruned():
    rng = np.random.default_rng(0)
    m = np.sort(rng.integers(0, 1000, size=(640, 4)), axis=0)
    starts = np.arange(0, 640, 64)
    low, high = np.minimum.reduceat(m, starts), np.maximum.reduceat(m, starts)

    hits = topk.search_segment(np.array([-1]), np.ones((1, 4), np.int64), np.array([-np.inf]), np.arange(640), m, low, high, 5, step=1)
    want = sorted(((-int(s), i) for i, s in enumerate(m.sum(axis=1))))[:5]
    assert sorted((-s, i) for _, i, s in hits) == want
    assert topk.search_segment(np.array([-1]), np.ones((1, 4), np.int64), np.array([1e9]), np.arange(640), m, low, high, 5) == []


# --- Jaccard join ---


def _sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset())
    return out


def _components(rows):
    sets = _sets([r[1] for r in rows])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    names = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            names[find(i)] = min(names.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), len(sets[i]), str(names.get(find(i)))) for i, r in enumerate(rows))


def _copies(seed=5):
    rng = np.random.default_rng(seed)
    word = lambda: "w%d" % rng.integers(0, 4000)
    passage = [word() for _ in range(30)]
    rows = []
    for g in range(25):
        base = [word() for _ in range(int(rng.integers(20, 160)))]
        for c in range(int(rng.integers(1, 14))):
            text = list(base)
            for _ in range(int(rng.integers(0, 5))):
                text[int(rng.integers(0, len(text)))] = word()
            if c % 3 == 0:
                text += passage
            rows.append((len(rows) * 7, " ".join(text), 0, 0.0, 0))
    # a chain: each linked with the next only
    chain = [word() for _ in range(200)]
    for step in range(12):
        chain[step * 9 : step * 9 + 2] = [word(), word()]
        rows.append((9000 - step, " ".join(chain), 0, 0.0, 0))
    rows += [(20000, None, 0, 0.0, 0), (20001, "", 0, 0.0, 0), (20002, " \t\n", 0, 0.0, 0), (20003, "one Two", 0, 0.0, 0),
             (20004, "ONE two", 0, 0.0, 0), (20005, "one", 0, 0.0, 0), (None, "one two", 0, 0.0, 0), (None, "alone here", 0, 0.0, 0),
             (20003, "one Two", 0, 0.0, 0), (20009, "a b c d " * 8000, 0, 0.0, 0), (20010, "a b c d " * 9000, 0, 0.0, 0), (20011, "É é", 0, 0.0, 0)]
    return rows


@pytest.mark.parametrize("part,hot", [(512, 16), (4, 3)])
def test_jaccard_join_matches_brute_force(spark, monkeypatch, part, hot):
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "HOT", hot)
    rows = _copies()
    out = jaccard.near_duplicates(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out.collect()) == _components(rows)


def test_jaccard_join_of_one_large_group(spark, monkeypatch):
    """Copies of one text that are near it but not near each other, over several parts."""
    monkeypatch.setattr(jaccard, "PART", 16)
    rng = np.random.default_rng(8)
    base = ["b%d" % i for i in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(int(rng.integers(0, 5))):
            text[int(rng.integers(0, len(text)))] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(text), 0, 0.0, 0))
    out = jaccard.near_duplicates(spark.createDataFrame(rows, DOCS))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out.collect()) == _components(rows)


def _variants(n=160, words=120):
    """Copies of one text with up to two fifths of its words changed, some cut short, some changed alike."""
    rng = np.random.default_rng(21)
    base = ["b%d" % i for i in range(words)]
    rows = []
    for i in range(n):
        text = base[: words - int(rng.integers(0, 12))] if i % 4 == 0 else list(base)
        for _ in range(int(rng.integers(0, 2 * words // 5)) if i % 3 else i % 5):
            text[int(rng.integers(0, len(text)))] = f"x{rng.integers(0, 400)}"
        rows.append((i, " ".join(text), 0, 0.0, 0))
    return rows


def test_jaccard_regions_leave_out_copies_with_many_changes(spark, monkeypatch):
    """Copies too far from the pivot and from each other are no pairs of every part."""
    monkeypatch.setattr(jaccard, "PART", 16)
    monkeypatch.setattr(jaccard, "HOT", 3)
    met, write = {}, jaccard.materialize

    def counted(df, purpose):
        out = write(df, purpose)
        met[purpose] = out.count()
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    rows = _variants()
    out = jaccard.near_duplicates(spark.createDataFrame(rows, DOCS))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out.collect())
    assert got == _components(rows)
    grouped = len(rows) - len({g[2] for g in got})
    assert grouped == 40 and met["jaccard-regions"] < 3 * grouped


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_of_sizes_at_their_reach(spark, monkeypatch, seed):
    """Sets that hold one another, of every size, so that links end within a shingle of the bound."""
    monkeypatch.setattr(jaccard, "PART", 5)
    monkeypatch.setattr(jaccard, "HOT", 1000)
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(3):
        base = ["g%dw%d" % (g, i) for i in range(90)]
        for _ in range(40):
            text = base[int(rng.integers(0, 25)) : 90 - int(rng.integers(0, 25))]
            text += ["y%d" % rng.integers(0, 30) for _ in range(int(rng.integers(0, 12)))]
            rows.append((len(rows), " ".join(text), 0, 0.0, 0))
    out = jaccard.near_duplicates(spark.createDataFrame(rows, DOCS))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out.collect()) == _components(rows)


def test_jaccard_join_without_rows(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    one = jaccard.near_duplicates(spark.createDataFrame([(4, "", 0, 0.0, 0)], DOCS)).collect()
    assert [tuple(r) for r in one] == [(4, 0, 4)]


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (300, 299)]
    got = {r.node: r.component for r in jaccard.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 299: 299, 300: 299}


# --- suffix tree ---


def _texts():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        lang = [["the", "cat", "sat"], ["le", "chat", "dort"]][i % 2]
        rows.append((i, " ".join(rng.choice(lang, 30)) + f" rare{i}", 0, 0.0, 0))
    return rows + [(900, None, 0, 0.0, 0), (901, "", 0, 0.0, 0), (None, "The THE the", 0, 0.0, 0), (902, "unseen " * 20000, 0, 0.0, 0), (0, rows[0][1], 0, 0.0, 0)]


@pytest.mark.parametrize("vocabulary", [1 << 19, 5])
def test_suffix_tree_base_and_gain(spark, vocabulary):
    rows = _texts()
    docs = spark.createDataFrame(rows, DOCS).withColumn("held_out", suffix_tree.held_out(F.col("doc_id")))
    tree, rare = suffix_tree.learn(docs.where("NOT held_out").select("text"), vocabulary=vocabulary)
    out = suffix_tree.score_texts(docs.select("doc_id", "text", "held_out"), tree, rare).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    split = lambda t: [*(t or "").encode().lower().split(), None]
    counts = {}
    for r in rows:
        for w in split(r[1]) if not held(r[0]) else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(r[0]), held(r[0]), len(split(r[1])), sum(counts.get(w, 0) > 0 for w in split(r[1])), n,
         round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in split(r[1])), 3))
        for r in rows
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in out) == want
    if vocabulary > 5:
        test = [r for r in out if r.held_out and r.n_tokens == 32]
        assert sum(r.score for r in test) > sum(r.base_score for r in test) + 4 * len(test)


class TreeByHand:
    """The tree from its definition, with dictionaries keyed by the words themselves."""

    def __init__(self, texts, depth):
        self.grams = {}
        for t in texts:
            w = [*(t or "").encode().lower().split(), None]
            for size in range(1, depth + 2):
                for i in range(len(w) - size + 1):
                    g = tuple(w[i : i + size])
                    self.grams[g] = self.grams.get(g, 0) + 1
        one = {g[0]: c for g, c in self.grams.items() if len(g) == 1}
        self.one, self.n, self.v = one, sum(one.values()), len(one)
        self.states, self.entries = {}, {}
        for size in range(1, depth + 1):
            found = {}
            for g, c in self.grams.items():
                if len(g) == size + 1 and c >= suffix_tree.MIN_NEXT and self.grams[g[:-1]] >= suffix_tree.MIN_CONTEXT:
                    found.setdefault(g[:-1], {})[g[-1]] = c
            for context, kept in found.items():
                total = self.grams[context]
                suffix = {w: self.p(context[1:], w) for w in kept}
                rest = 1 - sum(c - suffix_tree.DISCOUNT for c in kept.values()) / total
                gain = sum(c / total * math.log(c / total / suffix[w]) for w, c in kept.items())
                left, before = 1 - sum(kept.values()) / total, sum(suffix.values())
                if left > 1e-12 and before < 1:
                    gain += left * math.log(left / max(1 - before, 1e-12))
                if total * gain > len(kept) * (math.log(max(self.v, 2)) + 0.5 * math.log(max(total, 2))):
                    self.states[context] = rest
                    self.entries |= {(context, w): (c - suffix_tree.DISCOUNT) / total + rest * suffix[w] for w, c in kept.items()}

    def p(self, context, word):
        if not context:
            return (self.one.get(word, 0) + 1) / (self.n + self.v + 1)
        if context not in self.states:
            return self.p(context[1:], word)
        own = self.entries.get((context, word))
        return self.states[context] * self.p(context[1:], word) if own is None else own

    def score(self, text, depth):
        w = [*(text or "").encode().lower().split(), None]
        return sum(math.log10(self.p(tuple(w[max(0, i - depth) : i]), x)) for i, x in enumerate(w))


@pytest.mark.parametrize("depth,frequent", [(5, 1 << 20), (5, 60), (2, 0)])
def test_suffix_tree_against_brute_force(spark, monkeypatch, depth, frequent):
    monkeypatch.setattr(suffix_tree, "CHUNK", 7)
    rng = np.random.default_rng(4)
    rows = [r for r in _texts() if r[0] != 902] + [(903, "le chat dort " * 300, 0, 0.0, 0)]
    phrase = "one phrase of eight words that comes thrice"
    rows += [(2000 + i, f"a{i} {phrase} b{i}", 0, 0.0, 0) for i in (0, 1, 3)] + [(2010, phrase, 0, 0.0, 0), (2011, "thrice comes that", 0, 0.0, 0)]
    rows += [(3000 + i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 60)), 0, 0.0, 0) for i in range(60)]
    for i in range(80):  # words that follow from what stands two to five words before
        k = i % 2
        rows.append((4001 + 4 * i, f"c{k} o p{k} x{i} e{k} i j f{k} y{i} m{k} q r s t{k} z{i} g{k} a b c d h{k}", 0, 0.0, 0))
    docs = spark.createDataFrame(rows, DOCS).withColumn("held_out", F.col("doc_id") % 4 == 2)
    hand = TreeByHand([r[1] for r in rows if not (r[0] is not None and r[0] % 4 == 2)], depth)
    tree, rare = suffix_tree.learn(docs.where("NOT coalesce(held_out, false)").select("text"), depth=depth, frequent=frequent)
    assert len(tree.frequent[0]) == tree.grams.count() if frequent > 60 else len(tree.frequent[0]) <= frequent
    assert tree.depth == depth and {len(c) for c in hand.states} == set(range(1, depth + 1))
    states = tree.grams.where("rest IS NOT NULL").count()
    assert (states, tree.grams.where("entry IS NOT NULL").count()) == (len(hand.states), len(hand.entries))
    out = suffix_tree.score_texts(docs.select("doc_id", "text", "held_out"), tree, rare).collect()
    want = sorted((str(r[0]), round(hand.score(r[1], depth), 6)) for r in rows)
    got = sorted((str(r.doc_id), round(r.score, 6)) for r in out)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=2e-6)
    # a phrase that was seen three times is worth more than its words, in any corpus
    by_id = {r.doc_id: r for r in out}
    assert by_id[2010].score > by_id[2010].base_score + 8
    for context in ((b"the",), (b"le", b"chat"), (b"phrase", b"of"), (b"rare7",)):
        words = [*hand.one, b"never seen"]
        assert sum(hand.p(context[-depth:], w) for w in words) == pytest.approx(1.0, abs=1e-9)


@pytest.mark.parametrize("set_before", [None, "10"])
def test_near_duplicates_hand_few_rows_at_once_to_python(spark, monkeypatch, set_before):
    key, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, p: seen.append(int(spark.conf.get(key))) or write(df, p))
    rows = [(i, f"a b c d e f g h i j {i // 2}", 0, 0.0, 0) for i in range(6)]
    if set_before:
        spark.conf.set(key, set_before)
    try:
        out = jaccard.one_of_each(spark.createDataFrame(rows, DOCS), percent=100)
        after = spark.conf.get(key)
    finally:
        spark.conf.unset(key)
    assert sorted(r.doc_id for r in out.collect()) == [0, 2, 4]
    assert seen and max(seen) <= 1024 and after == (set_before or spark.conf.get(key))


def test_suffix_tree_frees_each_slice_before_the_next(spark, monkeypatch):
    rows = [(i, f"w{i % 7} follows the word x{i % 3} and w{i % 7} again", 0, 0.0, 0) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("held_out", F.col("doc_id") % 4 == 2)
    tree, rare = suffix_tree.learn(docs.where("NOT held_out").select("text"), vocabulary=4, frequent=4)
    docs, held, sent = docs.select("doc_id", "text", "held_out"), set(), []
    write, free, broadcast = suffix_tree.written, suffix_tree.discard, spark.sparkContext.broadcast

    def written(df, purpose):
        assert purpose != "tree-scores" or not held
        out = write(df, purpose)
        if purpose == "tree-scores":
            held.add(out[1])
        return out

    monkeypatch.setattr(suffix_tree, "written", written)
    monkeypatch.setattr(suffix_tree, "discard", lambda spark, *paths: held.difference_update(paths) or free(spark, *paths))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(broadcast(value)) or sent[-1])
    score = lambda: sorted((r.doc_id, r.n_known, round(r.score, 9)) for r in suffix_tree.score_texts(docs, tree, rare).collect())
    sliced = score()
    assert not held and sent and all(not os.path.exists(b._path) for b in sent)
    monkeypatch.setattr(suffix_tree, "SLICES", 1)
    assert sliced == score() and len(sliced) == 60


def _nested(monkeypatch, page_tokens):
    """Texts with contexts of all lengths that are heavy at so many tokens a page, and the tree by hand."""
    monkeypatch.setattr(suffix_tree, "PAGE_TOKENS", page_tokens)
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 40)), 0, 0.0, 0) for i in range(90)]
    rows += [(200 + i, f"a{i} one common line of eight words here then {['x', 'y'][i % 2]} b{i}", 0, 0.0, 0) for i in range(60)]
    rows += [(300 + i, f"k{i % 20} k{(i + i // 20) % 20} of the k{(i + i // 20) % 20} q{i % 20}", 0, 0.0, 0) for i in range(80)]
    rows += [(400, None, 0, 0.0, 0), (401, "unseen words", 0, 0.0, 0), (None, "one common line", 0, 0.0, 0), (200, rows[90][1], 0, 0.0, 0)]
    return rows, TreeByHand([r[1] for r in rows if not (r[0] is not None and r[0] % 4 == 2)], 5)


@pytest.mark.parametrize("page_tokens,vocabulary,frequent", [(9, 12, 30)])
def test_suffix_tree_spreads_heavy_contexts(spark, monkeypatch, page_tokens, vocabulary, frequent):
    rows, hand = _nested(monkeypatch, page_tokens)
    heavies, add = [], suffix_tree.Heavy.add
    monkeypatch.setattr(suffix_tree.Heavy, "add", lambda self, keys, total, n: add(self, keys, total, n) or heavies.append((n, len(keys), self.pages)))
    docs = spark.createDataFrame(rows, DOCS).withColumn("held_out", F.coalesce(F.col("doc_id") % 4 == 2, F.lit(False)))
    tree, rare = suffix_tree.learn(docs.where("NOT held_out").select("text"), vocabulary=vocabulary, frequent=frequent)
    assert [n for n, keys, _ in heavies if keys] == [1, 2, 3, 4, 5] and heavies[-1][2] > 20
    n = lambda what: tree.grams.where(f"{what} IS NOT NULL").count()
    assert (n("rest"), n("entry")) == (len(hand.states), len(hand.entries)) and len(hand.states) > 20
    out = suffix_tree.score_texts(docs.select("doc_id", "text", "held_out"), tree, rare)
    got, want = (sorted(x) for x in ([(str(r.doc_id), r.score) for r in out.collect()], [(str(r[0]), hand.score(r[1], 5)) for r in rows]))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-9)


@pytest.mark.parametrize("page_tokens,vocabulary,depth", [(55, 12, 5)])
def test_suffix_tree_scores_in_the_pages(spark, monkeypatch, page_tokens, vocabulary, depth):
    """The whole corpus is scored where the tree is built: no grams are looked up, and no more than a part of the pages is dealt at once."""
    rows, _ = _nested(monkeypatch, page_tokens)
    hand = TreeByHand([r[1] for r in rows if not (r[0] is not None and r[0] % 4 == 2)], depth)
    docs = spark.createDataFrame(rows, DOCS).withColumn("held_out", F.coalesce(F.col("doc_id") % 4 == 2, F.lit(False))).select("doc_id", "text", "held_out")
    monkeypatch.setattr(suffix_tree, "HELD_COUNTS", 40)
    tree, rare = suffix_tree.learn(docs.where("NOT held_out").select("text"), vocabulary=vocabulary, depth=depth)
    key = lambda r: (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens)
    want = sorted((*key(r), r.base_score, r.score) for r in suffix_tree.score_texts(docs, tree, rare).collect())
    monkeypatch.setattr(suffix_tree, "near_gains", None)
    got = sorted((*key(r), r.base_score, r.score) for r in suffix_tree.score_corpus(docs, vocabulary, depth).collect())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [x for g in got for x in g[5:]] == pytest.approx([x for w in want for x in w[5:]], abs=1e-9)
    assert [g[6] for g in got] == pytest.approx([x[1] for x in sorted((str(r[0]), hand.score(r[1], depth)) for r in rows)], abs=1e-9)


def test_suffix_tree_deals_every_context_to_one_part(monkeypatch):
    monkeypatch.setattr(suffix_tree, "PAGE_TOKENS", 50)
    text = [" ".join(f"w{i % 7} w{j % 11} z{i}" for j in range(20)) for i in range(20)]
    (block,) = suffix_tree.blocks(pa.array(text), lower=True)
    hashes = suffix_tree.tokens(block)[0]
    words, counts = np.unique(hashes, return_counts=True)
    lexicon = suffix_tree.Lexicon(suffix_tree.Tree(words, counts, len(hashes), len(words)), None)
    heavy, many = suffix_tree.Heavy(1 + len(hashes) // 50), counts > 50
    heavy.add(words[many], counts[many], 1)
    train = np.arange(block.n) % 3 > 0
    parts = [suffix_tree._deal_tokens(block, lexicon, heavy, 5, train, 2, own) for own in (0, 1)]
    numbers = [suffix_tree._dealt_tokens(data, 5, numbered=True)[2] for _, data in parts]
    assert many.any() and all(set(page % 2) == {own} for own, (page, _) in enumerate(parts))
    assert max(len(x) for x in numbers) < 0.7 * sum(len(x) for x in numbers)
    assert sum(len(x) for x in numbers) == sum(len(t.split()) for t in text)  # all but each text's first token
    assert {(int(x) >> 1, bool(x & 1)) for x in np.concatenate(numbers)} == set(enumerate(train))


def test_suffix_tree_page_holds_no_more_than_its_share(monkeypatch):
    monkeypatch.setattr(suffix_tree, "PAGE_TOKENS", 50)
    text = [" ".join(f"the w{(i * 7 + j) % 97}" for j in range(30)) for i in range(40)]
    (block,) = suffix_tree.blocks(pa.array(text), lower=True)
    hashes = suffix_tree.tokens(block)[0]
    words, counts = np.unique(hashes, return_counts=True)
    lexicon = suffix_tree.Lexicon(suffix_tree.Tree(words, counts, len(hashes), len(words)), None)
    heavy = suffix_tree.Heavy(1 + 1200 // 50)
    heavy.add(words[counts == 1200], np.array([1200]), 1)
    pages, data = suffix_tree._deal_tokens(block, lexicon, heavy, 5)
    sizes = [suffix_tree._dealt_tokens([d], 5)[0].shape[1] for d in data]
    # each "the" but the first of a text follows a word; the words after it are dealt by the word before it
    assert sum(sizes) == 1200 + 1200 - 40 and max(sizes) <= 4 * 50 and {heavy.length_of(int(p)) for p in pages} == {0, 1}


def test_tokens_with_a_known_longest_context_look_nothing_up():
    hashes = np.array([5, 6, 7], dtype=np.uint64) << np.uint64(50)
    doc, pair = np.zeros(3, dtype=np.int64), suffix_tree.grams(hashes, 2)
    triple = suffix_tree.grams(hashes, 3)
    rows = {int(hashes[0]): (np.nan, -0.1), int(pair[0]): (0.3, -0.2), int(triple[0]): (0.9, np.nan)}
    known = np.array(sorted(rows), dtype=np.uint64)
    frequent = (Sorted(known), *(np.array([rows[int(x)][i] for x in known]) for i in (0, 1)))
    # the pair of the last two words is of the tree and not frequent, but the triple's entry settles the last one
    in_tree = np.append(known, pair[1])
    gains, opened, places, *_ = suffix_tree.near_gains(hashes, doc, 2, frequent, lambda x: np.isin(x, in_tree))
    assert not opened.any() and not len(places) and gains.tolist() == [0.0, 0.3, 0.9]


def test_suffix_tree_without_training_texts(spark):
    empty = spark.createDataFrame([], DOCS)
    tree, rare = suffix_tree.learn(empty.select("text"))
    docs = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held_out boolean")
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in suffix_tree.score_texts(docs, tree, rare).collect()] == [(3, 0, 0.0, 0.0)]
    assert suffix_tree.score_texts(docs.where("doc_id = 0"), tree, rare).collect() == []
