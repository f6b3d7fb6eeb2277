"""Words and shingles of whole Arrow batches as NumPy arrays, without a Python object per word.

A word's hash is a polynomial over random 64-bit byte values, taken from prefix sums of the whole
slice and then mixed. Texts are worked on in slices of whole documents of a few megabytes, so memory
follows the slice (or the longest document), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000

_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        table = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spaced_table() -> np.ndarray:
    """Words are what stands between ASCII white space; A-Z are lowered. 0 separates."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[32, 9, 10, 11, 12, 13, 0]] = 0
    table[0] = 255  # a NUL byte is part of a word; 255 never occurs in UTF-8
    return table


def letters_table() -> np.ndarray:
    """Words are runs of letters: a-z (A-Z lowered) and all bytes beyond ASCII. 0 separates."""
    table = np.zeros(256, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def alnum_table() -> np.ndarray:
    """Words are runs of letters, digits and bytes beyond ASCII; A-Z are lowered. 0 separates."""
    table = letters_table()
    table[48:58] = np.arange(48, 58)
    return table


SPACED = spaced_table()
ALNUM = alnum_table()
LETTERS = letters_table()


@dataclass
class Texts:
    """A slice of whole documents: their bytes, and where each begins and ends."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array | pa.ChunkedArray, slice_bytes: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of a column; null is an empty text. A longer document is a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + slice_bytes, "right")) - 1
        end = min(max(end, at + 1), len(column))
        own = offsets[at : end + 1]
        yield Texts(at, data[own[0] : own[-1]], own - own[0])
        at = end


@dataclass
class Words:
    """All words of a slice in order: document (within the slice), hash, and byte span."""

    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray  # words of document d are bounds[d]:bounds[d + 1]
    sums: np.ndarray

    def prefix_hash(self, n: int) -> np.ndarray:
        """Hash of the first n bytes of each word; of the whole word where it is shorter."""
        return mix(_span_hash(self.sums, self.start, np.minimum(self.start + n, self.end)) + np.uint64(n))

    def suffix_hash(self, n: int) -> np.ndarray:
        return mix(_span_hash(self.sums, np.maximum(self.end - n, self.start), self.end) + np.uint64(n << 8))


def _span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * _power_table(_BASE_INVERSE, len(sums))[start]


def words(texts: Texts, table: np.ndarray = SPACED) -> Words:
    folded = table[texts.data]
    n = len(folded)
    inside = np.zeros(n + 2, bool)
    np.not_equal(folded, 0, out=inside[1:-1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cuts = texts.offsets[(texts.offsets > 0) & (texts.offsets < n)]
    first[cuts] = inside[1:-1][cuts]
    last[cuts - 1] = inside[1:-1][cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[folded] * _power_table(_BASE, n), out=sums[1:])
    bounds = np.searchsorted(start, texts.offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    return Words(doc, mix(_span_hash(sums, start, end)), start, end, bounds, sums)


def shingles(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles: their hashes, sorted in each document, and the bounds of documents.

    A document with fewer words has its whole sequence as its one shingle; without words, none.
    """
    counts = np.diff(found.bounds)
    factors = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    m = len(found.hash)
    per_doc = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = np.repeat(found.bounds[:-1], per_doc) + _within(per_doc)
    size = np.minimum(np.repeat(counts, per_doc), n)
    total = size.astype(np.uint64)
    for k in range(n):
        here = np.minimum(at + k, max(m - 1, 0))
        total += np.where(k < size, found.hash[here] * factors[k], np.uint64(0)) if m else np.uint64(0)
    total = mix(total)
    bounds = np.concatenate(([0], np.cumsum(per_doc)))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        total[a:b].sort()
    fresh = np.ones(len(total), bool)
    fresh[1:] = total[1:] != total[:-1]
    fresh[bounds[:-1][per_doc > 0]] = True
    kept = np.concatenate(([0], np.cumsum(fresh)))
    return total[fresh], kept[bounds]


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... inside each run."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


within = _within
