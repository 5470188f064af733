import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from datawarden.llm import chat, mixing, syncmers

DOCS = "doc_id long, text string, source string, n_words int"
TURNS = "conv_id long, turn long, role string, text string, formatted string"


def test_chats_round_trip(spark):
    rows = [
        (1, 2, "assistant", "a\\|b <|end|> |> <s>", "x"),
        (1, 1, "user", "hi\n<|role|>assistant<|text|>", "x"),
        (1, 3, "assistant", None, "x"),
        (1, 4, "assistant", "tail<", "x"),
        (1, 5, "user<|text|>", "", "x"),
        (2, None, None, None, None),
        (3, 1, "user", "same", None),
        (3, 1, "user", "same", None),
        (None, 1, "assistant", "|><|é😀", None),
        (4, 1, "assistant", "word " * 30000, None),
    ]
    out = {r.conv_id: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, TURNS))).collect()}
    assert len(out) == 5
    for conv in out:
        want = sorted(((-1 if r[1] is None else r[1]), r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        assert [(t.role, t.text) for t in out[conv].turns] == [w[1:] for w in want]
        assert out[conv].loss_text == "".join(w[2] for w in want if w[1] == "assistant")
    # one block for the three adjacent turns, no control string of a text left
    assert out[1].formatted.count("<|role|>") == 3 and out[1].formatted.count("<|turn|>") == 2
    assert "<s>" not in out[1].formatted
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], TURNS))).collect() == []


def test_mix_reaches_targets(spark):
    rows = [(i, "w " * (i % 7), "a" if i % 3 else "b", 0) for i in range(300)]
    rows += [(900, None, None, 0), (901, "x y", None, 0), (902, "x y", None, 0), (None, "q", "c", 1), (5, "w " * 5, "a", 0)]
    out = mixing.mix_plan(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    sizes, taken, targets = {}, {}, {}
    for r in out:
        assert r.taken == r.copies * r.size and r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        targets[r.source] = r.target
    total = sum(sizes.values())
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    # by hand: shares by 3, 1, 2, 3 for a, b, c, null with caps of twice the size
    weights, left, free, want = {"a": 3, "b": 1, "c": 2, None: 3}, 1.5 * total, {"a", "b", "c", None}, {}
    while True:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= want[s]
        free -= over
    want |= {s: level * weights[s] for s in free}
    for s in sizes:
        assert targets[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 6
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_plan(spark.createDataFrame(rows, DOCS)).collect()))
    mixed = mixing.mixed_documents(spark.createDataFrame(rows, DOCS))
    assert mixed.columns == ["doc_id", "text", "source", "n_words"]
    assert mixed.where("doc_id = 901").count() == 2
    assert mixing.mix_plan(spark.createDataFrame([], DOCS)).collect() == []


def _hash64(words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64(w.encode(), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def _anchors(text, k=syncmers.K, s=syncmers.S):
    words = (text or "").lower().split()
    if len(words) < k:
        return [tuple(words)] if words else []
    small = [_hash64(words[i : i + s]) for i in range(len(words) - s + 1)]
    span = k - s + 1
    found = [tuple(words[i : i + k]) for i in range(len(words) - k + 1) if min(small[i : i + span]) in (small[i], small[i + span - 1])]
    return list(dict.fromkeys(found))


def test_syncmers_match_brute_force(spark):
    base = " ".join(f"w{(i * i) % 97}" for i in range(4000))
    texts = ["", None, "One two", base, base, base[:200] + " zz " + base[200:], "é😀 b c d e f g h i j", "a " * 700, "   "]
    rows = [(i * 300, t, "s", 1) for i, t in enumerate(texts)] + [(0, "tie", "s", 1), (None, "null id", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    out = {(r.doc_id, r.n_chars, r.edited): r for r in syncmers.edited_neighbours(docs).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = {}
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        want[(r[0], len(text), text[: len(text) - half] + after[:half])] = (text, after)
    assert set(out) == set(want)
    for key, (text, after) in want.items():
        r = out[key]
        for got, source in ((r.anchors, text), (r.next_anchors, after), (r.edited_anchors, key[2])):
            assert len(got) == len(_anchors(source))
        a, b = set(_anchors(text)), set(_anchors(key[2]))
        assert len(set(r.anchors) & set(r.edited_anchors)) == len(a & b)
    prints = syncmers.fingerprints(docs).groupBy("text").agg(F.count_distinct("fingerprint").alias("n"))
    assert {r.n for r in prints.collect()} == {1}
    assert syncmers.edited_neighbours(spark.createDataFrame([], DOCS)).collect() == []
    one = syncmers.edited_neighbours(spark.createDataFrame([(1, "abcd", "s", 1)], DOCS)).first()
    assert one.edited == "abab"


def test_short_texts_have_an_anchor(spark):
    """Six to eight words are one to three windows, of which often none is chosen."""
    texts = [" ".join(f"w{n}x{i}x{j}" for j in range(n)) for n in (1, 5, 6, 7, 8, 9, 12) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], DOCS)
    found = {r.text: tuple(r.anchors) for r in syncmers.fingerprints(docs).collect()}
    assert all(found[t] for t in texts) and len(set(found.values())) == len(texts)
    bare = [t for t in texts if len(t.split()) in (6, 7, 8) and not _chosen(t.split())]
    assert len(bare) > 20 and all(len(found[t]) == 1 for t in bare)
    rows = syncmers.edited_neighbours(docs).select(syncmers.likeness(F.col("anchors"), F.col("next_anchors")).alias("near"))
    assert {r.near for r in rows.collect()} == {0.0}


def _chosen(words, k=syncmers.K, s=syncmers.S):
    small, span = [_hash64(words[i : i + s]) for i in range(len(words) - s + 1)], k - s + 1
    return [i for i in range(len(words) - k + 1) if min(small[i : i + span]) in (small[i], small[i + span - 1])]


def test_edited_digest_of_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in syncmers.op7_syncmers(spark, sf_dir).collect()}
    for i, r in enumerate(rows):
        half, after = len(r.text) // 2, rows[(i + 1) % len(rows)].text
        edited = r.text[: len(r.text) - half] + after[:half]
        assert got[r.doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert sum(r.near_edited for r in got.values()) > 3 * sum(r.near_next for r in got.values())
