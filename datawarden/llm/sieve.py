"""A bounded bitmap of 64-bit values, to keep most rows that a join would drop out of its shuffle.

A sieve lets every value of its table through and, by chance, some others: it saves work and never
decides. Its size is fixed (2^BITS bits, 16 MB), whatever the table's; with far more values than bits
it lets nearly all through, and the joins behind it carry the load.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datawarden.llm.words import mix

BITS = 27
_PAGE = 16  # bits of a page


def _slots(values: np.ndarray) -> np.ndarray:
    return (mix(values.view(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


class Sieve:
    def __init__(self, pages: list[tuple[int, bytes]]):
        self.bits = np.zeros(1 << (BITS - 3), dtype=np.uint8)
        for page, data in pages:
            at = page << (_PAGE - 3)
            self.bits[at : at + (1 << (_PAGE - 3))] = np.frombuffer(data, dtype=np.uint8)

    def passes(self, values: np.ndarray) -> np.ndarray:
        slot = _slots(values)
        return (self.bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _to_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot = np.unique(_slots(batch.column(0).to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([pa.array((slot >> _PAGE).astype(np.int32)), pa.array((slot & ((1 << _PAGE) - 1)).astype(np.int32))], names=["page", "bit"])


def _to_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}  # at most 2^(BITS - PAGE) pages of 8 KB
    for batch in batches:
        page, bit = (batch.column(i).to_numpy() for i in (0, 1))
        for p in np.unique(page):
            bits = held.setdefault(int(p), np.zeros(1 << _PAGE, dtype=bool))
            bits[bit[page == p]] = True
    for p, bits in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["page", "data"])


def sieve_of(df: DataFrame, column: str) -> Sieve:
    """The sieve of a non-null long column. The driver receives its set pages, 16 MB at most."""
    slots = df.select(F.col(column).cast("long").alias("v")).mapInArrow(_to_slots, "page int, bit int")
    pages = slots.repartition("page").mapInArrow(_to_pages, "page int, data binary")
    return Sieve([(r["page"], bytes(r["data"])) for r in pages.collect()])
