"""Words of whole texts as numpy arrays, block by block.

Texts come as Arrow columns; their UTF-8 bytes are cut into words and hashed for a whole block of
documents at once, without a loop over documents or words. Blocks are bounded in bytes; a document
is never split, so a block holds at least one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def give_back_memory() -> None:
    """Lets a process return large arrays to the system when they are freed. Spark's Python workers
    serve stage after stage, and would else keep the most that any of them ever needed."""
    allocator = getattr(ctypes.CDLL(None), "mallopt", None)
    if allocator is not None:  # glibc: M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
        allocator(-3, 1 << 20)
        allocator(-1, 4 << 20)
    pa.set_memory_pool(pa.system_memory_pool())


give_back_memory()

BLOCK_BYTES = 2 << 20

#: ASCII white space ends a word; every other byte belongs to one.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Letters, digits and everything outside ASCII.
WORDY = np.zeros(256, dtype=bool)
WORDY[0x30:0x3A] = WORDY[0x41:0x5B] = WORDY[0x61:0x7B] = WORDY[0x80:] = True
#: The same without digits.
LETTERS = WORDY.copy()
LETTERS[0x30:0x3A] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15 | 5


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over the whole range, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = [np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        size = 1 << max(12, n.bit_length())
        with np.errstate(over="ignore"):
            _POWERS[0] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, dtype=np.uint64)]), dtype=np.uint64)
    return _POWERS[0][:n]


@dataclass
class Block:
    """Words of the rows `row` to `row + n - 1` of a batch. `first[i]:first[i + 1]` are the words of
    the i-th; `start` and `length` are places in `data`; `hash` is 64 bits of a word's bytes."""

    row: int
    n: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    length: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.length[i]].tobytes()

    def joined(self, begin: int, end: int) -> bytes:
        """Words `begin` to `end` - 1 of one document, cut at white space, with one blank between."""
        if begin == end:
            return b""
        return b" ".join(self.data[self.start[begin] : self.start[end - 1] + self.length[end - 1]].tobytes().split())

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.first))


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


#: The bits of a little-endian number that hold its first 0 to 8 bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _eight(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from byte `at` on, as little-endian numbers."""
    place, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
    return (words[place] >> shift) | ((words[place + 1] << np.uint64(1)) << (np.uint64(63) - shift))


def hash_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes, equal hashes. Bytes are taken eight at a time, so the
    arrays have an element for each span and not for each byte."""
    if len(start) == 0:
        return np.zeros(0, dtype=np.uint64)
    padded = np.zeros((len(data) // 8 + 3) * 8, dtype=np.uint8)
    padded[: len(data)] = data
    words = padded.view("<u8")
    out = mix(_eight(words, start) & _FIRST[np.minimum(length, 8)])
    more = np.flatnonzero(length > 8)
    if len(more):
        rest = length[more] - 8
        parts = (rest + 7) >> 3
        begin = np.cumsum(parts) - parts
        place = np.arange(begin[-1] + parts[-1]) - np.repeat(begin, parts)
        at = np.repeat(start[more] + 8, parts) + 8 * place
        left = np.minimum(np.repeat(rest, parts) - 8 * place, 8)
        values = mix(_eight(words, at) & _FIRST[left]) * _powers(int(parts.max()) + 1)[place + 1]
        out[more] += np.add.reduceat(values, begin)
    return mix(out + length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


class Sorted:
    """A sorted array of hashes, searched by their first bits: hashes are spread evenly, so a few
    steps from the place of their first bits find them."""

    BITS = 20

    def __init__(self, values: np.ndarray):
        self.values = values
        first = np.arange(1 << self.BITS, dtype=np.uint64) << np.uint64(64 - self.BITS)
        self.heads = np.searchsorted(values, first).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the array, and whether the hashes stand there."""
        if not len(self.values):
            return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
        last = len(self.values) - 1
        at = np.minimum(self.heads[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)], last).astype(np.int64)
        todo = np.flatnonzero(self.values[at] < hashes)
        while len(todo):
            todo = todo[at[todo] < last]
            at[todo] += 1
            todo = todo[self.values[at[todo]] < hashes[todo]]
        return at, self.values[at] == hashes


def blocks(
    column: pa.Array | pa.ChunkedArray,
    inside: np.ndarray = SPACED,
    lower: bool = False,
    block_bytes: int = BLOCK_BYTES,
    hashed: bool = True,
) -> Iterator[Block]:
    """Blocks of words; `inside` says which bytes belong to words, `lower` maps A-Z to a-z. Without
    `hashed` there are no hashes of the words."""
    raw, offsets = bytes_of(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        n = max(1, int(np.searchsorted(offsets, offsets[row] + block_bytes, side="right")) - 1 - row)
        n = min(n, rows - row)
        at = offsets[row : row + n + 1] - offsets[row]
        data = raw[offsets[row] : offsets[row + n]]
        data = _LOWER[data] if lower else data
        yield _block(row, n, data, at, inside, hashed)
        row += n


def _block(row: int, n: int, data: np.ndarray, at: np.ndarray, inside: np.ndarray, hashed: bool = True) -> Block:
    word = np.zeros(len(data) + 1, dtype=bool)
    word[:-1] = inside[data]
    begins = word[:-1].copy()
    begins[1:] &= ~word[:-2]
    heads = at[:-1][at[:-1] < at[1:]]  # a word never crosses the edge of a document
    begins[heads] = word[heads]
    ends = word[:-1] & ~word[1:]
    tails = at[1:][at[:-1] < at[1:]] - 1
    ends[tails] = word[tails]
    start = np.flatnonzero(begins)
    length = np.flatnonzero(ends) + 1 - start
    hashes = hash_spans(data, start, length) if hashed else np.zeros(0, np.uint64)
    return Block(row, n, data, at, start, length, hashes, np.searchsorted(start, at))


def windows(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows of `size` consecutive words within one document, and their hashes."""
    total = len(block.hash) - size + 1
    if total <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    doc = block.doc_of()
    at = np.flatnonzero(doc[:total] == doc[size - 1 :])
    sums = np.zeros(total, dtype=np.uint64)
    weights = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    for j in range(size):
        sums += block.hash[j : j + total] * weights[j]
    return at, mix(sums)[at]


def unique_counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_counts=True)


def hash_spans16(chars: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of adjacent spans that cover all of an array of 16-bit characters."""
    if len(start) == 0:
        return np.zeros(0, dtype=np.uint64)
    place = np.arange(len(chars), dtype=np.int64) - np.repeat(start, length)
    values = chars.astype(np.uint64) + np.uint64(1)
    values *= _powers(int(length.max()))[place]
    return mix(np.add.reduceat(values, start) ^ (length.astype(np.uint64) << np.uint64(40)))
