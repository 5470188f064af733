"""License scans: fuzzy search for short notices.

Texts are lower-cased and reduced to their words with single blanks between, whole blocks at a time.
A notice that may have e edits is split into e + 1 pieces; by the pigeonhole principle one of them
stands unedited in every match, so exact search for the pieces finds all candidates. The regex
library's bounded-error matching then verifies a window around each candidate and reports the span
and its edits. Edits are counted in UTF-8 bytes, and matches begin and end at word edges.

Words that decide which license it is (a version, a number of clauses, nc, nd, sa) stand in braces
in a notice, and allow no edit. Of matches that overlap, the one with the most words gives the label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from datawarden.llm.common import narrow
from datawarden.llm.words import WORDY, Block, blocks

#: Phrases whose exact places are counted. Fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
_RIGHTS = ("noncommercial", "noderivatives", "sharealike")
_SHORT = {"noncommercial": "nc", "noderivatives": "nd", "sharealike": "sa"}
_KINDS = ((), *((r,) for r in _RIGHTS), ("noncommercial", "noderivatives"), ("noncommercial", "sharealike"))


def _creative_commons() -> dict[str, str]:
    """The licenses by their long and their short names."""
    out = {}
    for rights in _KINDS:
        label = "-".join(["cc-by", *(_SHORT[r] for r in rights)])
        out[" ".join(["creative commons attribution", *(f"{{{r}}}" for r in rights)])] = label
        out[" ".join(["{cc} {by}", *(f"{{{_SHORT[r]}}}" for r in rights)])] = label
    return out


#: Notices that the fuzzy search looks for: those of the base, with their deciding words, and others.
MORE = {
    "under the {mit} license": "mit",
    "apache license version {2}": "apache-2",
    "apache license version {1} {1}": "apache-1.1",
    "bsd {2} clause license": "bsd-2",
    "bsd {3} clause license": "bsd-3",
    "bsd {4} clause license": "bsd-4",
    "gnu general public license": "gpl",
    "gnu general public license version {2}": "gpl-2",
    "gnu general public license version {3}": "gpl-3",
    "gnu {lesser} general public license": "lgpl",
    "gnu {affero} general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "mozilla public license version {2}": "mpl-2",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "under the {isc} license": "isc",
    "released into the public domain": "public-domain",
    "{cc0} universal public domain dedication": "cc0",
} | _creative_commons()

SPANS = "doc_id long, label string, first_word long, last_word long, edits int, likeness double, matched string"
SCAN = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double"
)


def parts_of(notice: str) -> list[tuple[str, bool]]:
    """A notice's runs of text and whether each is guarded; blanks belong to the runs outside."""
    out = []
    for k, run in enumerate(re.split(r"[{}]", notice)):
        if run:
            out.append((run, k % 2 == 1))
    return out


def allowed_edits(notice: str) -> int:
    """One edit for each eight bytes that may be edited, two at most."""
    return min(2, sum(len(run.encode()) for run, guarded in parts_of(notice) if not guarded) // 8)


def pieces(phrase: bytes, edits: int) -> list[tuple[int, bytes]]:
    """(offset, piece) of the edits + 1 pieces of a phrase."""
    bounds = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(bounds, bounds[1:])]


def places(text: bytes, piece: bytes) -> list[int]:
    found, at = [], text.find(piece)
    while at >= 0:
        found.append(at)
        at = text.find(piece, at + 1)
    return found


def joined_words(block: Block) -> tuple[bytes, np.ndarray]:
    """The block's words, a blank before and after each, a line break before each document; and
    where each word begins. Neither byte belongs to words, so no match crosses documents."""
    doc = block.doc_of()
    begin = np.cumsum(block.length + 1) - block.length - 1 + 2 * (doc + 1)
    size = int(block.length.sum()) + len(block.length) + 2 * block.n + 1
    out = np.full(size, 32, dtype=np.uint8)
    out[np.concatenate([begin[block.first[:-1][np.diff(block.first) > 0]] - 2, [size - 1]])] = 10
    place = np.arange(int(block.length.sum())) - np.repeat(np.cumsum(block.length) - block.length, block.length)
    out[np.repeat(begin, block.length) + place] = block.data[np.repeat(block.start, block.length) + place]
    return out.tobytes(), begin


@dataclass
class Notice:
    phrase: bytes
    label: str
    edits: int
    pattern: object
    seeds: list[tuple[int, bytes]]


def compiled(notices: Mapping[str, str]) -> list[Notice]:
    import regex

    out = []
    for notice, label in notices.items():
        edits, body = allowed_edits(notice), b""
        for run, guarded in parts_of(notice):
            plain = regex.escape(run.encode(), literal_spaces=True)
            # a guarded word is a whole word as it stands; edits go to what lies around it
            body += b"(?<=[ \n])" + plain + b"(?=[ \n])" if guarded else b"(?:" + plain + b"){e<=%d}" % edits
        pattern = regex.compile(b"(?b)(?<=[ \n])" + body + b"(?=[ \n])")
        raw = "".join(run for run, _ in parts_of(notice)).encode()
        out.append(Notice(raw, label, edits, pattern, pieces(raw, edits)))
    return out


def fuzzy_spans(text: bytes, begin: np.ndarray, notices: list[Notice]) -> list[tuple[int, int, str, int, float, bytes]]:
    """(first word, last word, label, edits, likeness, matched bytes) of the verified candidates, one
    for each label and place, without those that lie within a longer one."""
    found = {}
    for notice in notices:
        slack, size = notice.edits, len(notice.phrase)
        candidates = {(at, offset) for offset, piece in notice.seeds for at in places(text, piece)}
        for at, offset in sorted(candidates):
            a, b = max(0, at - offset - slack - 1), min(len(text), at - offset + size + slack + 1)
            a = max(a, text.rfind(b"\n", a, at) + 1)  # the document's edges bound the window
            edge = text.find(b"\n", at, b)
            hit = notice.pattern.search(text, pos=a, endpos=b if edge < 0 else edge)
            if hit is None:
                continue
            edits = sum(hit.fuzzy_counts)
            if edits > notice.edits:  # each run between guarded words kept its own bound
                continue
            start, stop = hit.span()
            first = int(np.searchsorted(begin, start, side="left"))
            last = int(np.searchsorted(begin, stop, side="left")) - 1
            if last < first:
                continue
            key = (first, notice.label)
            if key not in found or edits < found[key][3]:
                found[key] = (first, last, notice.label, edits, 1 - edits / size, hit.group())
    return longest(sorted(found.values()))


def longest(spans: list[tuple]) -> list[tuple]:
    """Spans (first, last, ...), in order, that lie within no other one of more words."""
    out: list[tuple] = []
    for span in sorted(spans, key=lambda s: (s[0], -s[1])):
        # by first word, longest first: one that holds this span came before it and reaches as far
        if out and out[-1][1] >= span[1] and out[-1][:2] != span[:2]:
            continue
        out.append(span)
    return out


def base_places(text: bytes, begin: np.ndarray, phrases: Mapping[str, str]) -> list[tuple[int, str]]:
    """(first word, label) wherever a phrase's words stand consecutively."""
    found = []
    for phrase, label in phrases.items():
        found += [(int(np.searchsorted(begin, at + 1)), label) for at in places(text, b" " + phrase.encode() + b" ")]
    return sorted(found)


def license_spans(docs: DataFrame, notices: Mapping[str, str] | None = None) -> DataFrame:
    """Every fuzzy match in `docs` (doc_id, text): its label, words from-to, edits and text."""
    table = dict(MORE if notices is None else notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = compiled(table)
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, SPANS.split(", "))])
        for batch in batches:
            for block in blocks(batch.column("text"), WORDY, lower=True):
                text, begin = joined_words(block)
                doc, rows = block.doc_of(), []
                for first, last, label, edits, likeness, matched in fuzzy_spans(text, begin, known):
                    row, base = int(doc[first]), int(block.first[doc[first]])
                    rows.append((batch.column("doc_id")[block.row + row].as_py(), label, first - base, last - base, edits, likeness, matched.decode("utf-8", "replace")))
                columns = list(zip(*rows)) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

    return narrow(docs, doc_id="long", text="string").mapInArrow(run, SPANS)


def scan_licenses(docs: DataFrame, base: Mapping[str, str] | None = None, more: Mapping[str, str] | None = None) -> DataFrame:
    """One row for each row of `docs` (doc_id, text).

    n_base counts all exact places of the base phrases, first_word and last_word are the smallest
    and largest of their starts (null without any). `labels` has those of exact and fuzzy matches,
    `score` the likeness of the best one, 0 without any. Null and empty texts have no words and no
    labels (empty strings). `more` are the notices of the fuzzy search, deciding words in braces. Repeated rows are scanned alike, null ids kept.
    """
    exact = dict(BASE if base is None else base)
    table = dict(MORE if more is None else more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = compiled(table)
        for batch in batches:
            for block in blocks(batch.column("text"), WORDY, lower=True):
                text, begin = joined_words(block)
                doc = block.doc_of()
                hits: dict[int, list[tuple[int, str]]] = {}
                labels: dict[int, set[str]] = {}
                score = np.zeros(block.n)
                for word, label in base_places(text, begin, exact):
                    hits.setdefault(int(doc[word]), []).append((word - int(block.first[doc[word]]), label))
                    labels.setdefault(int(doc[word]), set()).add(label)
                    score[doc[word]] = 1.0
                for first, _, label, _, likeness, _ in fuzzy_spans(text, begin, known):
                    labels.setdefault(int(doc[first]), set()).add(label)
                    score[doc[first]] = max(score[doc[first]], likeness)
                rows = range(block.n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.row, block.n),
                        pa.array(np.diff(block.first), pa.int64()),
                        pa.array([len(hits.get(i, ())) for i in rows], pa.int64()),
                        pa.array([min(hits[i])[0] if i in hits else None for i in rows], pa.int64()),
                        pa.array([max(hits[i])[0] if i in hits else None for i in rows], pa.int64()),
                        pa.array([",".join(sorted({x for _, x in hits.get(i, ())})) for i in rows], pa.string()),
                        pa.array([",".join(sorted(labels.get(i, ()))) for i in rows], pa.string()),
                        pa.array(score),
                    ],
                    names=[f.split()[0] for f in SCAN.split(", ")],
                )

    return narrow(docs, doc_id="long", text="string").mapInArrow(run, SCAN)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
