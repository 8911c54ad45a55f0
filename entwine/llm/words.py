"""Words of Arrow text columns as 64-bit hashes, worked out over whole buffers at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes that separate words: white space, and all of ASCII but 0-9, A-Z and a-z.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

#: A-Z as a-z, other bytes as they are.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bits of the first k of eight bytes.
FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Words are read in steps of eight bytes; longer ones than this are hashed one by one.
LONG_WORD = 128


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """At each place of the bytes the eight that begin there, as one integer; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of rows (cut at offsets) begin and end."""
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    return np.flatnonzero(inside & (before | edge[:-1])), np.flatnonzero(inside & (after | edge[1:])) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every span of the bytes: eight bytes at a time enter a chain of `mix`, so equal hashes of different words are a matter of chance alone."""
    view, size = eights(data), ends - starts
    out = size.astype(np.uint64)
    rows, at, left = np.flatnonzero(size <= LONG_WORD), 0, size
    while len(rows):
        chunk = view[starts[rows] + at] & FIRST_BYTES[np.minimum(left[rows] - at, 8)]
        out[rows] = mix((out[rows] + np.uint64(0x9E3779B97F4A7C15)) ^ mix(chunk + np.uint64(0xD1B54A32D192ED03)))
        at += 8
        rows = rows[left[rows] > at]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and where each row begins (one entry more at the end); null as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def word_hashes(column: pa.Array, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all rows in order, and for each row where its words begin (one entry more at the end); A-Z count as a-z, null as empty."""
    data, offsets = text_bytes(column)
    starts, ends = spans(data, offsets, separators)
    return hashes(_LOWER[data], starts, ends), np.searchsorted(starts, offsets)
