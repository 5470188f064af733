import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from datawarden.llm import language, licenses, packing, words
from datawarden.llm.common import ship

DOCS = "doc_id long, text string, lang string, score double, n_words int"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ é\t\n\x0b\x1c日", max_size=30)), max_size=12))
def test_words_are_those_of_the_pattern(texts):
    column = pa.array(texts, pa.string())
    got = {}
    for block in words.blocks(column, lower=True, block_bytes=16):
        for i in range(block.n):
            got[block.row + i] = [block.word(j) for j in range(block.first[i], block.first[i + 1])]
            hashes = block.hash[block.first[i] : block.first[i + 1]]
            assert len(set(hashes.tolist())) == len(set(got[block.row + i]))
    want = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").replace("Z", "z").encode()) for i, t in enumerate(texts)}
    assert got == want


def test_hashes_of_spans_take_memory_by_span_and_not_by_byte():
    rng = np.random.default_rng(1)
    parts = [bytes(rng.integers(97, 100, int(n)).astype(np.uint8)) for n in [*range(1, 40), *rng.integers(1, 30, 3000), 5000, 100_000]]
    parts += [b"abc", b"abc\0\0\5", b"abc\0", b"\0", b"\0\0", b"x" * 8, b"x" * 9, b"x" * 16]
    parts += parts[::-1]
    length = np.array([len(x) for x in parts])
    hashes = words.hash_spans(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(length) - length, length)
    by_part = dict(zip(parts, hashes.tolist()))
    assert hashes.tolist() == [by_part[x] for x in parts] and len(set(by_part.values())) == len(by_part)
    data = rng.integers(97, 123, 1 << 20).astype(np.uint8)
    start = np.arange(0, len(data), 8)
    tracemalloc.start()
    words.hash_spans(data, start, np.full(len(start), 7))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(data)


@pytest.mark.parametrize("values", [0, 1, 5000])
def test_sorted_hashes_are_found(values):
    have = np.unique(words.mix(np.arange(values, dtype=np.uint64)))
    asked = np.concatenate([words.mix(np.arange(9000, dtype=np.uint64)), np.array([0, 2**64 - 1], np.uint64)])
    at, hit = words.Sorted(have).find(asked)
    assert hit.tolist() == np.isin(asked, have).tolist() and (not values or (have[at[hit]] == asked[hit]).all())


def test_windows_stay_in_documents():
    column = pa.array(["a b c d", "b c", None, "a b c", "x"])
    block = next(words.blocks(column))
    at, hashes = words.windows(block, 3)
    assert at.tolist() == [0, 1, 6] and hashes[0] == hashes[2] != hashes[1]


# --- language ---


def _languages(n=120):
    rng = np.random.default_rng(1)
    stems = {"en": ["the", "and", "with", "house"], "fr": ["le", "une", "maison", "été"], "de": ["der", "und", "haus", "straße"]}
    rows = []
    for i in range(n):
        lang = list(stems)[i % 3]
        rows.append((i, " ".join(rng.choice(stems[lang], 20)), lang, 9.0, 0))
    return rows


def test_language_words_and_backoff(spark):
    rows = _languages()
    extra = [(500, None, "en", 0.0, 0), (501, "", "en", 0.0, 0), (502, "123 -- 45", "en", 0.0, 0), (503, "MAISON, UNE!", None, 0.0, 0),
             (504, "maisonette", None, 0.0, 0), (None, "der und", None, 0.0, 0), (506, "the " * 50000, "en", 0.0, 0), (506, "the", "en", 0.0, 0)]
    docs = spark.createDataFrame(rows + extra, DOCS)
    model = language.fit(docs)
    out = language.predict(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "n_words", "lang_pred", "score"]
    got = [(r.doc_id, r.text, r.lang_pred, r.score) for r in out.collect()]
    assert len(got) == len(rows) + len(extra)
    by_id = {g[0]: g for g in got}
    for r in rows:
        assert by_id[r[0]][2] == r[2]
    assert [by_id[i][2] for i in (500, 501, 502, 503, 504, None)] == ["und", "und", "und", "fr", "fr", "de"]
    assert all(0 <= g[3] <= 1 for g in got)


def test_language_grams_are_of_characters():
    texts = ["abcdefg", "привет", "日本語の文章", "aé日😀zé日😀z", "x", "ß"]
    block = next(words.blocks(pa.array([" ".join(texts)]), words.LETTERS, lower=True))
    for size in language.LENGTHS:
        word, key = language._grams(block.data, block.start, block.length, size)
        want = [(i, t[j : j + size]) for i, t in enumerate(texts) for j in range(len(t) - size + 1)]
        assert word.tolist() == [i for i, _ in want]
        assert len(set(zip(key.tolist(), (g for _, g in want)))) == len(set(key.tolist())) == len({g for _, g in want})
        assert key[: 7 - size + 1].tolist() == [int.from_bytes(g.encode(), "little") for i, g in want if i == 0]


def test_language_backoff_beyond_ascii(spark):
    """Two languages whose words have the same runs of three letters, as often, and differ in longer ones."""
    cycles = {"xa": "аааб" + "аббб", "xb": "аааб" + "ббаб"}
    word = lambda lang, i, n: "".join(cycles[lang][(i + j) % 8] for j in range(n))
    rows = [(k, " ".join(word(lang, i, 16) for i in range(8)), lang, 0.0, 0) for lang in cycles for k in range(5)]
    model = language.fit(spark.createDataFrame(rows, DOCS))
    asked = [(i, word(lang, i, 17), lang, 0.0, 0) for lang in cycles for i in range(8)]
    out = language.predict(spark.createDataFrame(asked, DOCS), model).collect()
    assert len(out) == 16 and all(r.lang_pred == r.lang for r in out)


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "words here", None, None, None)], DOCS)
    assert language.predict(docs, language.fit(docs)).first().lang_pred == "und"
    empty = spark.createDataFrame([], DOCS)
    assert language.predict(empty, language.fit(empty)).collect() == []


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    out = language.op6_language_id(spark, sf_dir)
    rows = out.join(docs, "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert rows and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    held = {r.doc_id for r in out.where("held_out").collect()}
    assert held == {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}


class LanguagesByHand:
    """The model from its definition, over (text, lang) rows."""

    def __init__(self, rows):
        rows = [r for r in rows if r[0] is not None and r[1] is not None]
        self.langs = sorted({r[1] for r in rows})
        self.shares = {x: sum(r[1] == x for r in rows) / len(rows) for x in self.langs}
        counts = {}
        for text, lang in rows:
            for w in self.words(text):
                for size, feature in [(0, w), *((k, w[i : i + k]) for k in language.LENGTHS for i in range(len(w) - k + 1))]:
                    counts.setdefault(size, {}).setdefault(feature, {}).setdefault(lang, 0)
                    counts[size][feature][lang] += 1
        self.logs = {}
        for size, features in counts.items():
            kept = {f: {x: n for x, n in c.items() if n >= language.MIN_COUNT} for f, c in features.items()}
            kept = {f: c for f, c in kept.items() if c}
            total = {x: sum(c.get(x, 0) + language.SMOOTHING for c in kept.values()) for x in self.langs}
            self.logs[size] = {f: [np.log((c.get(x, 0) + language.SMOOTHING) / total[x]) for x in self.langs] for f, c in kept.items()}

    @staticmethod
    def words(text):
        text = "".join(" " if c in language.SIGNS else c for c in text).lower()
        return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)

    def predict(self, text):
        if not re.search(r"[^\W\d_]", text or ""):
            return "und", 0.0
        total = np.log([self.shares[x] for x in self.langs])
        for w in self.words(text):
            found = [self.logs[0][w]] if w in self.logs[0] else []
            for k in language.LENGTHS if not found else ():
                found = [self.logs[k][g] for i in range(len(w) - k + 1) if (g := w[i : i + k]) in self.logs.get(k, {})]
                if found:
                    break
            if found:
                total = total + np.mean(found, axis=0)
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def test_language_id_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = docs.where("doc_id % 3 = 0")
    hand = LanguagesByHand([(r.text, r.lang) for r in docs.where("doc_id % 3 <> 0").collect()])
    model = language.fit(docs.where("doc_id % 3 <> 0"))
    assert {k: len(v) for k, v in model.keys.items()} == {k: len(v) for k, v in hand.logs.items()}
    extra = ["\u201cThe house\u201d \u2014 \u00abil est\u00bb", "ÉTÉ Straße", "漢字 かな", "12 34", "", None, "zq", "The\u00a0end\u2026"]
    rows = held.unionByName(spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(extra)], held.schema))
    got = language.predict(rows, model).collect()
    assert len(got) == held.count() + len(extra)
    for r in got:
        lang, score = hand.predict(r.text)
        assert (r.lang_pred, r.score) == (lang, pytest.approx(score, abs=1e-6)), r.text


# --- licenses ---


def _base(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    hits = []
    for phrase, label in licenses.BASE.items():
        want = phrase.split()
        hits += [(i, label) for i in range(len(found)) if found[i : i + len(want)] == want]
    return len(found), sorted(hits)


def test_license_scan(spark):
    texts = [
        "Released under the MIT License. Under the mit-license!",
        "x Apache License, Version 2.0 and CC-BY-NC, cc by nc by nc",
        "distributed under teh MIT Licence terms",  # three edits: a swap and a substitution
        "distributed under the MIT Licence terms",
        "und er the mit license",
        "GNU General Public Licence",
        "apache license version 2x",
        "undér the mit license",
        "under the mit",
        "license",
        "",
        None,
        "... ,,, \t",
        "word " * 40000 + "under the mit license",
        "cc by nc cc by nc",
        "plain words about a house under the sea",
    ]
    docs = spark.createDataFrame([(i % 15, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    out = licenses.scan_licenses(docs).collect()
    assert len(out) == len(texts)
    for text, r in zip(texts, out):
        n, hits = _base(text)
        assert (r.n_words, r.n_base) == (n, len(hits))
        assert (r.first_word, r.last_word) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({h[1] for h in hits}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    labels = [r.labels for r in out]
    assert labels[0] == "mit" and labels[1] == "apache-2,cc-by-nc" and labels[2] == "" and labels[3] == "mit"
    assert labels[5] == "gpl" and labels[8:13] == [""] * 5 and labels[15] == ""
    assert out[3].score == pytest.approx(1 - 1 / 21) and out[0].score == 1.0 and out[15].score == 0.0
    spans = licenses.license_spans(docs.where("text LIKE '%Licence terms'")).collect()
    assert [(s.first_word, s.last_word, s.edits, s.matched) for s in spans if s.label == "mit"] == [(1, 4, 1, "under the mit licence")]
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).collect() == []


def test_deciding_words_allow_no_edit(spark):
    want = {
        "CC BY-ND 4.0": "cc-by-nd",
        "CC-BY 4.0": "cc-by",
        "CC BY-NC-SA": "cc-by-nc,cc-by-nc-sa",  # the first by the base's phrase
        "BSD 2-Clause License": "bsd-2",
        "BSD 3 Clause Licence": "bsd-3",
        "BSD 5-Clause License": "",
        "Apache License, Version 1.1": "apache-1.1",
        "Apache License, Version 3.0": "",
        "Apache License Version 12": "",
        "the Apache Licence, Version 2.0": "apache-2",
        "under the bit license": "",
        "under the mit licence": "mit",
        "Creative Commons Attribution-NonCommercial": "cc-by-nc",
        "Creative Commons Atribution": "cc-by",
        "GNU Lesser General Public License": "lgpl",
        "GNU General Public License, version 3": "gpl-3",
    }
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(want)], DOCS)
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(docs).collect()}
    assert {t: got[i] for i, t in enumerate(want)} == want


def test_fuzzy_search_finds_all_that_a_plain_scan_finds():
    import regex

    rng = np.random.default_rng(4)
    notices = licenses.compiled(licenses.BASE)
    for _ in range(300):
        phrase = list(str(rng.choice(list(licenses.BASE))))
        for _ in range(rng.integers(0, 4)):
            at = int(rng.integers(0, len(phrase)))
            phrase[at : at + int(rng.integers(0, 2))] = [str(rng.choice(list("abel"))), ""][int(rng.integers(0, 2))]
        text = "some words " + "".join(phrase) + " and more"
        block = next(words.blocks(pa.array([text]), words.WORDY, lower=True))
        raw, begin = licenses.joined_words(block)
        found = {s[2] for s in licenses.fuzzy_spans(raw, begin, notices)}
        plain = {n.label for n in notices if regex.search(n.pattern, raw)}
        assert found == plain, text


# --- packing ---


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.tokenizer_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abst'rev ldm  \n\t é1²!,İ日\x1c\xa0<|endoftxt>", max_size=25), max_size=6))
def test_ids_are_the_tokenizers(encoder, texts):
    ids, at = encoder.encode(texts)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == encoder.whole.encode(text, add_special_tokens=False).ids


def test_pieces_and_places(spark, sf_dir, encoder):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (None, "no id"), (-3, "again"), (-3, "again")], "doc_id long, text string"))
    out = packing.pack(docs).collect()
    pieces = {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
    for d in docs.collect():
        ids = encoder.whole.encode(d.text or "", add_special_tokens=False).ids + [2]
        mine = sorted(pieces[d.doc_id], key=lambda r: r.piece)
        if d.doc_id == -3:
            assert len(mine) == 2
            continue
        assert [r.piece for r in mine] == list(range(-(-len(ids) // 1024)))
        assert all(r.length == 1024 for r in mine[1:])
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
        assert sum(r.length for r in mine) == len(ids)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(r.length for r in out)
    assert len(sequences) <= -(-total // 1024) * 1.02 + 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30))
def test_plan_places_every_rank_once(histogram):
    table = packing.plan_sequences(histogram, 64)
    for length, n in histogram.items():
        rows = table[table.length == length].sort_values("from_rank")
        assert rows.from_rank.tolist() == [0, *rows.to_rank.tolist()[:-1]] and rows.to_rank.iloc[-1] == n
    fill = {}
    for r in table.itertuples():
        for k in range(r.to_rank - r.from_rank):
            fill.setdefault(r.sequence + k, []).append((r.offset, r.length))
    for spans in fill.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 64
