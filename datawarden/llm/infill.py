"""Fill-in-middle transformation with a sparse index of multibyte characters.

A text is cut twice into prefix, middle and suffix, which are written anew in another order behind
marks:

    psm: <P>prefix<S>suffix<M>middle      spm: <S>suffix<P>prefix<M>middle      plain: the text

Cuts are given in code points and made in bytes. For a block of texts only its characters of more
than one byte are recorded, each with its place and its excess bytes; a binary search among them
turns a code point into a byte and back, and between them, in ASCII spans, the conversion is plain
arithmetic. A text is never decoded.

Every row stands for itself: there is no shuffle, and a task holds one block of texts at a time (2 MB,
or one text where that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datawarden.llm.common import narrow
from datawarden.llm.words import BLOCK_BYTES, bytes_of

#: Fixed values of the query: marks of prefix, suffix and middle, and its two rates in percent.
MARKS = ("<P>", "<S>", "<M>")
TRANSFORMED_PERCENT = 90
SPM_PERCENT = 20

_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Exceptions:
    """The multibyte characters of some UTF-8 bytes: their places, in bytes and in code points, and
    the excess bytes up to and with each."""

    def __init__(self, data: np.ndarray):
        lead = np.flatnonzero(data >= 0xC0)
        first = data[lead]
        extra = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        self.excess = np.concatenate([np.zeros(1, np.int64), np.cumsum(extra)])
        self.byte = lead
        self.char = lead - self.excess[:-1]

    def to_byte(self, char: np.ndarray) -> np.ndarray:
        """Bytes before the code point at each place."""
        return char + self.excess[np.searchsorted(self.char, char)]

    def to_char(self, byte: np.ndarray) -> np.ndarray:
        """Code points before each byte that begins one."""
        return byte - self.excess[np.searchsorted(self.byte, byte)]


def check_marks(marks: tuple[str, str, str]) -> None:
    """No mark may arise where a text and a mark meet, or outputs could not be read back: a mark's
    first character stands nowhere else in any mark."""
    if len(set(marks)) != 3 or not all(marks):
        raise ValueError("three different marks are needed")
    if any(first in mark[1:] for first in {m[0] for m in marks} for mark in marks):
        raise ValueError("the first character of a mark must not stand inside a mark")


def _rearranged(marks: tuple[str, str, str]):
    p, s, m = (mark.encode() for mark in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = bytes_of(batch.column("text"))
            cuts = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cut_a", "cut_b")]
            kinds = batch.column("form").to_pylist()
            row, rows = 0, batch.num_rows
            while row < rows:
                n = max(1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1 - row)
                n = min(n, rows - row)
                block = slice(row, row + n)
                at = offsets[row : row + n + 1] - offsets[row]
                data = raw[offsets[row] : offsets[row + n]]
                index = Exceptions(data)
                begin = index.to_char(at)
                length = np.diff(begin)
                a, b = (c[block] % (length + 1) for c in cuts)
                low, high = np.minimum(a, b), np.maximum(a, b)
                low_byte, high_byte = (index.to_byte(begin[:-1] + x) for x in (low, high))
                text, form, out = data.tobytes(), [], []
                for i, kind in enumerate(kinds[block]):
                    start, x, y, end = int(at[i]), int(low_byte[i]), int(high_byte[i]), int(at[i + 1])
                    if kind == "plain" or start == end:
                        form.append("plain")
                        out.append(text[start:end])
                    elif kind == "spm":
                        form.append(kind)
                        out.append(b"".join((s, text[y:end], p, text[start:x], m, text[x:y])))
                    else:
                        form.append(kind)
                        out.append(b"".join((p, text[start:x], s, text[y:end], m, text[x:y])))
                plain = np.array([f == "plain" for f in form])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, n),
                        pa.array(length),
                        pa.array(form, pa.string()),
                        pa.array(low, mask=plain),
                        pa.array(high - low, mask=plain),
                        pa.array(out, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )
                row += n

    return run


def _draw(digest: str, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame,
    seed: int = 1,
    transformed_percent: int = TRANSFORMED_PERCENT,
    spm_percent: int = SPM_PERCENT,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of `docs` (doc_id, text).

    Draws come from the SHA-256 of seed and doc_id, so reruns agree and rows that share an id share
    their draws. A text that is empty or holds a mark stays plain. A null text is empty; a null
    doc_id is drawn for as an empty one; repeated rows give repeated results; an empty table
    gives none. Other columns of `docs` are ignored.
    """
    check_marks(marks)
    rows = narrow(docs, doc_id="long", text="string")
    seeded = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = rows.withColumn("digest", F.sha2(seeded, 256))
    holds = F.lit(False)
    for mark in marks:
        holds = holds | F.coalesce(F.contains("text", F.lit(mark)), F.lit(False))
    form = (
        F.when(holds | (_draw("digest", 2) % 100 >= transformed_percent), "plain")
        .when(_draw("digest", 3) % 100 < spm_percent, "spm")
        .otherwise("psm")
    )
    cuts = drawn.select("doc_id", "text", _draw("digest", 0).alias("cut_a"), _draw("digest", 1).alias("cut_b"), form.alias("form"))
    return cuts.mapInArrow(_rearranged(marks), _SCHEMA)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text of an output, from nothing but the output and its form."""
    p, s, m = marks

    def text(first: str, second: str, prefix_first: bool) -> Column:
        body = F.substr(output, F.lit(len(first) + 1))
        head = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(head) + len(second) + 1)
        tail = F.substring_index(rest, m, 1)
        middle = F.substr(rest, F.length(tail) + len(m) + 1)
        return F.concat(head, middle, tail) if prefix_first else F.concat(tail, middle, head)

    return F.when(form == "psm", text(p, s, True)).when(form == "spm", text(s, p, False)).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), numbers AS (
  SELECT doc_id, text, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
           OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
         WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT doc_id, text, n, form, least(a, b) AS x, greatest(a, b) AS y, substr(text, 1, x) AS prefix,
    substr(text, x + 1, y - x) AS middle, substr(text, y + 1) AS suffix FROM numbers
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                   ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
