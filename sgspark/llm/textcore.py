"""Vectorised word and n-gram hashing over Arrow string columns.

Everything here works on flat UTF-8 bytes with numpy, slice by slice, so memory is bounded by
``SLICE_BYTES`` (or by one text, if a single text is longer). Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text makes a slice of its own.
SLICE_BYTES = 250_000

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_NGRAM_BASE = 0xD1342543DE82EF95 | 1
_NGRAM_INV = pow(_NGRAM_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def keys(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit keys that depend on the seed only."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(_BASE) + U64(seed))


_BYTE_KEY = keys(11, 256)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown once and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, U64(base), dtype=U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 20:
            _powers[base] = have
    return have[:n]


def table(ranges: list[tuple[int, int]], inside: bool) -> np.ndarray:
    """A 256-entry boolean table that is ``inside`` for bytes in the closed ranges."""
    out = np.full(256, not inside)
    for a, b in ranges:
        out[a : b + 1] = inside
    return out


#: Bytes of words [^\x20\x09-\x0D]+.
NOT_SPACE = table([(0x20, 0x20), (0x09, 0x0D)], inside=False)
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after lower-casing A-Z.
ALNUM = table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], inside=False)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Slice:
    """Some consecutive texts: flat bytes, and the offset at which each text starts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def runs(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Like words(), for maximal runs of bytes of one kind; kind 0 is left out."""
        kind = kinds[self.data]
        cut = np.empty(len(kind) + 1, dtype=bool)
        cut[:1] = cut[-1:] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:-1])
        cut[self.offsets] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        real = kind[starts] != 0
        starts, ends = starts[real], ends[real]
        return starts, ends, np.searchsorted(starts, self.offsets)

    def words(self, inside: np.ndarray, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and the number of the first word of each text."""
        data = self.data if data is None else data
        n = len(data)
        flag = inside[data]
        before = np.empty(n, dtype=bool)
        before[:1] = False
        before[1:] = flag[:-1]
        heads = self.offsets[:-1]
        heads = heads[heads < n]
        before[heads] = False
        starts = np.flatnonzero(flag & ~before)
        after = np.empty(n, dtype=bool)
        after[-1:] = False
        after[:-1] = flag[1:]
        tails = self.offsets[1:] - 1
        after[tails[tails >= 0]] = False
        ends = np.flatnonzero(flag & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a string column into slices of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        stop = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        stop = min(n, max(stop, at + 1))
        yield Slice(data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at], at)
        at = stop


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; equal words get equal hashes in every slice."""
    if not len(starts):
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, dtype=U64)
        sums[0] = 0
        np.cumsum(_BYTE_KEY[data] * powers(_BASE, len(data)), out=sums[1:])
        h = (sums[ends] - sums[starts]) * powers(_INV, len(data))[starts]
        return mix(h + (ends - starts).astype(U64))


def ngram_hashes(words: np.ndarray, n: int, base: int = _NGRAM_BASE) -> np.ndarray:
    """Hash of each n consecutive words; texts aren't told apart here."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    inv = _NGRAM_INV if base == _NGRAM_BASE else pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        sums = np.empty(len(words) + 1, dtype=U64)
        sums[0] = 0
        np.cumsum(words * powers(base, len(words)), out=sums[1:])
        h = (sums[n:] - sums[:-n]) * powers(inv, len(words))[:count]
        return mix(h + U64(n))


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes laid end to end: each element's group, and its rank in it."""
    counts = np.asarray(counts, dtype=np.int64)
    group = np.repeat(np.arange(len(counts)), counts)
    starts = np.cumsum(counts) - counts
    return group, np.arange(len(group)) - starts[group]
