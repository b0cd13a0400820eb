"""Array work on batches of texts inside a task: words, hashes, chunks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19

_U = np.uint64
#: Bytes that separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a span that are hashed in blocks next to those of other spans.
LONG = 256
#: Masks of the first 0 to 8 bytes of a block.
_ENDS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def spans_hash(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of units (bytes or code points), taken in blocks of eight bytes.

    Every block is scrambled into what came before it by steps that are not linear, so no pattern of two
    strings cancels out, as it does in a sum of powers. Spans over LONG bytes go to a hash function of the standard library.
    """
    # Bytes and code points of the same letters have the same hash.
    data = np.ascontiguousarray(units, np.uint32).view(np.uint8)
    size, first = (ends - starts) * 4, starts * 4
    h = mix(size.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(1))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    blocks = np.ndarray((len(data) + 1,), np.uint64, buffer=padded, strides=(1,))
    rows = np.flatnonzero((size > 0) & (size <= LONG))
    step = 0
    while len(rows):
        left = size[rows] - step
        value = blocks[first[rows] + step]
        value &= _ENDS[np.minimum(left, 8)]
        value ^= h[rows]
        value *= _U(0x9FB21C651E98DF25)
        value ^= value >> _U(32)
        value *= _U(0xA24BAED4963EE407)
        value ^= value >> _U(29)
        h[rows] = value
        rows, step = rows[left > 8], step + 8
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(blake2b(data[first[i]:first[i] + size[i]], digest_size=8).digest(), "little")
    return mix(h)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, bytes, offsets)`` of runs of rows of about ``limit`` bytes; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, len(texts))
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b
    # What the batch took goes back, so that idle workers do not hold it.
    pa.default_memory_pool().release_unused()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, first word of each text)`` of the words of the texts in one buffer."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values between neighbouring offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def ragged(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``rows`` of a ragged array one after another, and their offsets."""
    return spans(values, offsets[rows], offsets[rows + 1])


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of an array one after another, and their offsets."""
    sizes = ends - starts
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return values[np.repeat(starts - out[:-1], sizes) + np.arange(out[-1])], out
