"""Numpy passes over the Arrow buffers of a text column: words, hashes, spans.

A batch of texts stays one byte buffer with offsets; words are spans of it. Nothing here loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are worked on at once; a longer document is worked on whole.
CHUNK = 500_000
#: The ASCII white space that separates words.
SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 128
#: Odd multipliers of the hashes and of the mixer.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: Masks of the first n of eight bytes.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets of the texts in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts [i, j) of at most ``most`` bytes together, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def texts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) in pieces of about CHUNK bytes."""
    for batch in batches:
        data, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        for i, j in slices(offsets):
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


@cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i < n."""
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, max(1 << 16, 1 << (int(n) - 1).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over the word."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX_1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_2)
    x ^= x >> np.uint64(31)
    return x


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+``, and the n + 1 places of the texts' first words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = IS_SPACE[data]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = space[1:] | space[:-1]
    edge[inner] = True
    starts = np.flatnonzero(edge[:-1] & ~space)
    ends = np.flatnonzero(edge[1:] & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the bytes ``data``.

    Blocks of eight bytes are mixed one after another, so it is no polynomial: no pattern of letters makes
    long spans collide. Of spans of up to eight bytes, two of one length never collide. Spans of more than
    LONG_SPAN bytes are hashed one by one by xxhash.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    blocks, size = eight_bytes(data), ends - starts
    out = mix(mix(blocks[starts] & FIRST_BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(WORD_BASE))
    left, k = np.flatnonzero((size > 8) & (size <= LONG_SPAN)), 8
    while len(left):
        block = blocks[starts[left] + k] & FIRST_BYTES[np.minimum(size[left] - k, 8)]
        out[left] = mix(out[left] ^ mix(block + np.uint64(BYTE_BASE)))
        k += 8
        left = left[size[left] > k]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, as a little-endian number; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def rolling(hashes: np.ndarray, width: int, base: int = WORD_BASE) -> np.ndarray:
    """Rabin-Karp: the polynomial hash of each run of ``width`` consecutive values."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[:n])


def windows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start places of all windows of ``width`` words that lie in one text, and the text of each."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    begun = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - begun[owner] + first[:-1][owner], owner


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the spans [start, end)."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def loosened(column: pa.Array | pa.ChunkedArray) -> pa.Array | pa.ChunkedArray:
    """A struct column whose fields may all be null, as result schemas say."""
    return column.cast(pa.struct([f.with_nullable(True) for f in column.type]))
