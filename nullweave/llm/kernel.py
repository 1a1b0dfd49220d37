"""Vectorised text kernels over Arrow string columns.

A chunk of documents is one run of UTF-8 bytes plus document offsets, so words, word hashes and n-gram hashes of
a whole chunk come out of a handful of numpy calls, with no loop over documents or words.  Hashes are polynomial
prefix hashes modulo 2**64, whose multipliers are odd and therefore invertible, finished by a bijective mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once.  Bounds the working memory of a task, whatever the size of an Arrow batch.
CHUNK_BYTES = 1 << 19

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (the finaliser of the SplitMix64 generator)."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Poly:
    """Polynomial hash of runs of 64-bit values: hash(a[i:j]) = sum of a[t] * r**(t-i)."""

    def __init__(self, seed: int):
        self.r = U64((2 * seed + 1) & (2**64 - 1))
        self.inv = U64(pow(int(self.r), -1, 2**64))
        self._up = self._down = np.ones(1, U64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            n = max(n, 2 * len(self._up))
            self._up, self._down = (np.cumprod(np.concatenate([[U64(1)], np.full(n - 1, x, U64)])) for x in (self.r, self.inv))
        return self._up, self._down

    def runs(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = self.powers(len(values) + 1)
        prefix = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], out=prefix[1:])
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))


#: Two independent families, for 128-bit fingerprints.
BYTE_TABLE = [mix(np.arange(256, dtype=U64) + U64(0x1234567 + 0x10001 * k)) for k in range(2)]
BYTE_POLY = [Poly(0x2545F4914F6CDD1D), Poly(0x369DEA0F31A53F85)]
WORD_POLY = [Poly(0x1B873593CC9E2D51), Poly(0x5851F42D4C957F2D)]


class Chunk:
    """Documents rows lo..hi of a string column: bytes, document offsets, and words on demand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
        self.data, self.offsets, self.lo, self.hi, self.n = data, offsets, lo, hi, hi - lo
        self._words = None

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte start and end of each maximal run of non-separators, and where each document's words begin."""
        if self._words is None:
            self._words = self.runs(~SEPARATOR[self.data])
        return self._words

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each maximal run of marked bytes within a document, and where each document's runs begin."""
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(self.data))]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        start = np.flatnonzero(first)
        return start, np.flatnonzero(last) + 1, np.searchsorted(start, self.offsets)

    def lowered(self) -> np.ndarray:
        """The bytes with ASCII and Latin-1 capitals made small."""
        low = _LOWER[self.data].astype(np.uint8)
        wide = np.flatnonzero(self.data[:-1] == 0xC3) + 1
        b = self.data[wide]
        low[wide] = b + 32 * ((b >= 0x80) & (b <= 0x9E) & (b != 0x97)).astype(np.uint8)
        return low

    def code_points(self) -> np.ndarray:
        """For each byte position, the code points of its document before it."""
        ahead = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=ahead[1:])
        return ahead

    def word_hashes(self, family: int = 0, lower: bool = False) -> np.ndarray:
        table = BYTE_TABLE[family]
        start, end, _ = self.words
        return BYTE_POLY[family].runs((table[_LOWER] if lower else table)[self.data], start, end)

    def texts(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist())]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The column in runs of rows of at most ``limit`` bytes (a longer text comes alone); null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, raw_offsets, raw = column.buffers()
    off = np.frombuffer(raw_offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield Chunk(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lo, hi)
        lo = hi


def owners(offsets: np.ndarray) -> np.ndarray:
    """The row that each item of a ragged array belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ngrams(values: np.ndarray, offsets: np.ndarray, n: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's runs of n items, and their offsets; ``positions`` gives where they start."""
    pos, off = ngram_positions(offsets, n)
    return WORD_POLY[family].runs(values, pos, pos + n), off


def ngram_positions(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.maximum(np.diff(offsets) - n + 1, 0)
    off = np.concatenate([[0], np.cumsum(size)])
    pos = np.arange(off[-1]) + np.repeat(offsets[:-1] - off[:-1], size)
    return pos, off


def distinct_sorted(values: np.ndarray, offsets: np.ndarray, rank: np.ndarray | None = None, bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values without repeats, sorted, or in the order of the ``rank`` of their upper ``bits`` and then sorted.

    Row, rank and as many further bits of the value as there is room for are one integer that is sorted at once; where two
    different values agree in it, the slower sort by all keys decides."""
    row = owners(offsets)
    n = U64(max(1, (len(offsets) - 1).bit_length()))
    key = row.astype(U64) << (U64(64) - n)
    if rank is None:
        key |= values >> n
        keys = (values, row)
    else:
        of = rank[(values >> U64(64 - bits)).astype(np.int64)]
        key |= of.astype(U64) << (U64(64 - bits) - n) | (values & U64((1 << (64 - bits)) - 1)) >> n
        keys = (values, of, row)
    order = np.argsort(key)
    v, k = values[order], key[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    if (new[1:] & (k[1:] == k[:-1])).any():
        order = np.lexsort(keys)
        v = values[order]
        new[1:] = v[1:] != v[:-1]
    r = row[order]
    new[1:] |= r[1:] != r[:-1]
    v, r = v[new], r[new]
    return v, np.searchsorted(r, np.arange(len(offsets)))


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row of a ragged array, along the first axis."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), values.dtype if values.dtype.kind != "b" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the smallest of each ``width`` consecutive keys; keys are compared by their upper 40 bits."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    assert len(keys) < 1 << 24
    x = (keys & ~U64((1 << 24) - 1)) | np.arange(len(keys), dtype=U64)
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    x = np.minimum(x[:n], x[width - span : width - span + n])
    return (x & U64((1 << 24) - 1)).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def ragged(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
