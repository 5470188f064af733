import hashlib
import importlib.util
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from datawarden.llm import mixing, packing, substrings
from datawarden.llm.common import ship
from datawarden.llm.words import blocks
from test_search import _copies
from test_text import LanguagesByHand

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _deduplicated(rows, length=13):
    """(doc_id, words, kept words) of (doc_id, text) rows."""
    last = float("inf")
    first = {}
    for i, text in rows:
        w = _words(text)
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, last), last if i is None else i)
    out = []
    for i, text in rows:
        w = _words(text)
        keep = [True] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < (last if i is None else i):
                keep[k : k + length] = [False] * length
        out.append((i, w, [x for x, ok in zip(w, keep) if ok]))
    return out


def _passages():
    rng = np.random.default_rng(6)
    word = lambda: "w%d" % rng.integers(0, 60)
    shared = [" ".join(word() for _ in range(int(n))) for n in (13, 12, 20, 60, 200)]
    rows = []
    for i in range(160):
        parts = [" ".join(word() for _ in range(int(rng.integers(0, 40))))]
        for _ in range(int(rng.integers(0, 3))):
            parts += [shared[int(rng.integers(0, len(shared)))], word()]
        rows.append((int((i * 37) % 1000), "  ".join(parts)))
    rows += [rows[5], (rows[5][0], "other text " + rows[9][1]), (None, shared[3]), (None, "x " + shared[3]), (-4, None), (2000, ""), (2001, " \t\v"),
             (2002, shared[4][:300]), (3000, "a " * 20000), (3001, "a " * 30000 + "b"), (3002, "\u00a0".join(shared[2].split()))]
    rows += [(5000 + i, shared[3] + f" end{i}") for i in range(60)]  # a passage in very many documents
    return rows


@pytest.mark.parametrize("shard,stream", [(40_000, 200_000), (150, 400)])
def test_substring_dedup_matches_brute_force(spark, monkeypatch, shard, stream):
    monkeypatch.setattr(substrings, "SHARD", shard)
    monkeypatch.setattr(substrings, "STREAM", stream)
    rows = _passages()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words int, kept string")
    want = sorted((str(i), len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest(), " ".join(k)) for i, w, k in _deduplicated(rows))
    out = substrings.dedup_substrings(docs)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"]
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in out.collect()) == want
    assert sum(w[2] for w in want) > 5000


def test_kept_words_are_taken_in_runs():
    """What is left of a text costs its runs of kept words, not its words: no word is hashed or cut out alone."""
    text = " a  b\tc d\u00a0e \v f "
    (block,) = blocks(pa.array(["before", text, None]), hashed=False)
    a, b = int(block.first[1]), int(block.first[2])
    assert len(block.hash) == 0 and b - a == 5
    assert [block.joined(a + i, a + j).decode() for i, j in ((0, 5), (1, 3), (4, 5), (2, 2))] == ["a b c d\u00a0e f", "b c", "f", ""]


def test_sequence_hashes_tell_sequences_apart():
    words = substrings.mix(np.arange(60, dtype=np.uint64) % np.uint64(7))
    for size in (1, 2, 6, 13):
        hashes = substrings.sequence_hashes(words, size)
        same = [[(words[i : i + size] == words[j : j + size]).all() for j in range(len(hashes))] for i in range(len(hashes))]
        assert len(hashes) == 61 - size and ((hashes[:, None] == hashes[None, :]) == np.array(same)).all()
    assert len(substrings.sequence_hashes(words, 61)) == 0


def test_substring_dedup_without_rows(spark):
    assert substrings.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_automaton_matches_every_window():
    rng = np.random.default_rng(0)
    for _ in range(60):
        docs = [(d, rng.integers(0, 3, size=int(rng.integers(1, 25))).tolist()) for d in range(6)]
        automaton = substrings.SuffixAutomaton()
        for d, words in docs:
            automaton.add(words, d)
        for d, words in docs:
            want = [False] * len(words)
            for k in range(len(words) - 3):
                window = words[k : k + 4]
                if any(o < d and any(other[j : j + 4] == window for j in range(len(other) - 3)) for o, other in docs):
                    want[k : k + 4] = [True] * 4
            got = [False] * len(words)
            for a, b in automaton.repeated(words, d, 4):
                got[a:b] = [True] * (b - a)
            assert got == want


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = [(-1, None, None, None, None), (-2, "123 456", "en", "src0", 7), (-3, "", None, "src1", 0)]
    first = docs.select(*corpus_pipeline.COLUMNS).collect()
    extra += [tuple(first[3]), tuple(first[4])]  # repeated rows
    # foreign ones: unknown scripts, and a language that hardly any document has
    extra += [(-4, "漢字 かな交じり 文", None, "src0", 10), (-5, "Это русский текст о погоде", "en", "src1", 26)]
    extra += [(-6, "Sana ei ole suomea täällä " * 20, "fi", "src1", 520)]
    extra += [(-7, next(r.text for r in first if r.lang == "en" and len(r.text) > 400)[:300] + " tail", "de", "src2", 305)]  # a wrong label
    docs = docs.select(*corpus_pipeline.COLUMNS).unionByName(spark.createDataFrame(extra, docs.select(*corpus_pipeline.COLUMNS).schema))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "repeated_passages", "source_mix", "packing"]
    before, outs = docs, []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, sf_dir)
        rows = out.collect()
        outs.append((out.columns, rows))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == list(corpus_pipeline.COLUMNS)
            before = spark.createDataFrame(rows, out.schema)
    given = docs.collect()
    model, kept = LanguagesByHand([(r.text, r.lang) for r in given]), []
    for r in given:
        lang, score = model.predict(r.text)
        share = model.shares.get(lang, 1)
        if lang != "und" and share >= corpus_pipeline.MIN_SHARE and score >= corpus_pipeline.MIN_SCORE and score > share * (1 + 1e-9):
            kept.append((r.doc_id, r.text, lang, r.source, r.n_chars))
    assert sorted(map(str, map(tuple, outs[0][1]))) == sorted(map(str, kept))
    gone = {r.doc_id for r in given} - {k[0] for k in kept}
    assert {-1, -2, -3, -4, -5, -6} <= gone and len(gone) <= 8 and (-7, "en") in {(k[0], k[2]) for k in kept}
    want = _one_of_each([k[:2] for k in kept])
    assert sorted(str((r.doc_id, r.text)) for r in outs[1][1]) == sorted(map(str, want))
    cleaned = {}
    for r, (i, w, k) in zip(outs[1][1], _deduplicated([(r.doc_id, r.text) for r in outs[1][1]])):
        if k or not w:
            cleaned[i] = r.text if len(k) == len(w) else " ".join(k)
    assert {r.doc_id: r.text for r in outs[2][1]} == cleaned
    assert all(r.n_chars == len(r.text) for r in outs[2][1])
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(spark.createDataFrame(outs[2][1], COLUMNS)).collect()}
    copies = {}
    for r in outs[3][1]:
        assert r.text == cleaned[r.doc_id]
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {i: n for i, n in plan.items() if n}
    encoder, lengths = packing.Encoder(packing.tokenizer_path()), {}
    for r in outs[4][1]:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        if r.piece == 0:
            ids = [*encoder.whole.encode(cleaned[r.doc_id], add_special_tokens=False).ids, 2][: r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    assert lengths == {i: n * (len(encoder.whole.encode(cleaned[i], add_special_tokens=False).ids) + 1) for i, n in copies.items()}


def _one_of_each(rows):
    """(doc_id, text) rows without those linked to a smaller id by 0.8 of their five-word shingles."""
    rows, sets = list(dict.fromkeys(rows)), []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                group = [group[j] if g == group[i] else g for g in group]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first = {}
    for i in order:
        first.setdefault(group[i], i)
    return [rows[i] for i in first.values()]


def test_near_duplicates_by_five_words(spark):
    rng = np.random.default_rng(11)
    rows = [(r[0], r[1]) for r in _copies()]
    for g, run in enumerate((70, 85, 100, 106, 112, 150)):  # 4 words and 0.85 link the first alone
        text = [f"t{g}_{i}" for i in range(1000)]
        rows.append((30000 + 2 * g, " ".join(text)))
        text[400 : 400 + run] = [f"u{g}_{i}" for i in range(run)]
        rows.append((30001 + 2 * g, " ".join(text)))
    for g, edits in enumerate((15, 21, 24)):
        text = [f"v{g}_{i}" for i in range(1000)]
        rows.append((40000 + 2 * g, " ".join(text)))
        for i in range(edits):
            text[i * 40 + int(rng.integers(5, 30))] = f"x{g}_{i}"
        rows.append((40001 + 2 * g, " ".join(text)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, None).collect()]
    assert sorted(map(str, got)) == sorted(map(str, _one_of_each(rows)))
    ids = {i for i, _ in got}
    assert [i for i in (30001, 30003, 30005, 30007, 30009, 30011) if i in ids] == [30009, 30011]
    assert [i for i in (40001, 40003, 40005) if i in ids] == [40005]


def test_pipeline_of_an_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.collect() == []


def test_registered_queries(spark, sf_dir):
    spec = importlib.util.spec_from_file_location("entry", os.path.join(os.path.dirname(corpus_pipeline.__file__), "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    names = set(module.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
