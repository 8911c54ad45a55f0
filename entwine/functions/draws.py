"""Draws from MD5, for whole ranges of numbers in numpy.

The message is a prefix and a number's digits, so of the sixteen words of its block only those that hold digits differ between
numbers of one length; everything else is one value for the whole range. Prefixes of one length go together as rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHIFTS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
BEGIN = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Bytes of a message that fit one block, and numbers that are hashed together.
ONE_BLOCK, TOGETHER = 55, 1 << 14


def heads(prefixes: list[bytes], numbers: np.ndarray, digits: int) -> np.ndarray:
    """The first 52 bits of the MD5 of each prefix (rows) and each number (columns); prefixes have one length, numbers as many digits."""
    size = len(prefixes[0]) + digits
    if size > ONE_BLOCK:
        return np.array([[int(hashlib.md5(p + b"%d" % n).hexdigest()[:13], 16) for n in numbers.tolist()] for p in prefixes], np.uint64)
    rest_of_block = b"\0" * digits + b"\x80" + b"\0" * (55 - size) + (8 * size).to_bytes(8, "little")
    fixed = np.frombuffer(b"".join(p + rest_of_block for p in prefixes), "<u4").reshape(len(prefixes), 16)
    words = [fixed[:, i, None] for i in range(16)]
    rest = numbers.astype(np.uint64)[None, :]
    for at in range(size - 1, len(prefixes[0]) - 1, -1):
        rest, digit = np.divmod(rest, np.uint64(10))
        words[at // 4] = words[at // 4] + ((digit.astype(np.uint32) + np.uint32(48)) << np.uint32(8 * (at % 4)))
    a, b, c, d = (np.full((len(prefixes), len(numbers)), v, np.uint32) for v in BEGIN)
    for i in range(64):
        if i < 16:
            mixed, word = d ^ (b & (c ^ d)), i
        elif i < 32:
            mixed, word = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            mixed, word = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, word = c ^ (b | ~d), 7 * i % 16
        mixed += a
        mixed += words[word]
        mixed += SINES[i]
        shift = SHIFTS[i // 16][i % 4]
        turned = (mixed << np.uint32(shift)) | (mixed >> np.uint32(32 - shift))
        turned += b
        a, d, c, b = d, c, b, turned
    return (((a + BEGIN[0]).byteswap().astype(np.uint64)) << np.uint64(20)) | ((b + BEGIN[1]).byteswap().astype(np.uint64) >> np.uint64(12))


def drawn(prefixes: list[str], begin: int, end: int, whole: int, ends: np.ndarray) -> np.ndarray:
    """For each prefix (all of one length), how many numbers of begin to end (without it) fall into each class: their draw is the head of their MD5 modulo `whole`, and classes end (without it) at `ends`."""
    counts = np.zeros((len(prefixes), len(ends)), np.int64)
    starts = [p.encode() for p in prefixes]
    while begin < end:
        digits = len(str(begin))
        to = min(end, 10**digits, begin + TOGETHER)
        rows = max(1, TOGETHER // (to - begin))
        for at in range(0, len(starts), rows):
            draw = heads(starts[at : at + rows], np.arange(begin, to), digits) % np.uint64(whole)
            marks = np.searchsorted(ends, draw.astype(np.int64), side="right") + np.arange(len(draw))[:, None] * len(ends)
            counts[at : at + rows] += np.bincount(marks.ravel(), minlength=len(draw) * len(ends)).reshape(len(draw), -1)
        begin = to
    return counts


@F.arrow_udf(T.ArrayType(T.LongType()))
def class_counts(prefix: pa.Array, begin: pa.Array, end: pa.Array, whole: pa.Array, ends: pa.Array) -> pa.Array:
    """drawn() of columns; rows that only differ in prefixes of one length go together."""
    rows = list(zip(*(c.to_pylist() for c in (prefix, begin, end, whole, ends))))
    alike: dict[tuple, list[int]] = {}
    for i, row in enumerate(rows):
        alike.setdefault((len(row[0].encode()), *row[1:4], tuple(row[4])), []).append(i)
    made: list = [None] * len(rows)
    for (_, *span, last), own in alike.items():
        for i, counts in zip(own, drawn([rows[i][0] for i in own], *span, np.array(last, np.int64)).tolist()):
            made[i] = counts
    return pa.array(made, pa.list_(pa.int64()))
