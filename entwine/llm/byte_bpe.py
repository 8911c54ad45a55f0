"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Each match of the split pattern is encoded separately. Texts of plain Latin letters are split here, over the bytes of whole Arrow
batches, and every distinct match is given to the library's model once, its ids being kept in a bounded cache by the match's own bytes; any
other text is given to the library whole. Decoding reverses the byte-to-character table: ids become bytes, and characters that two or more ids split
come together again because bytes, not characters, are joined.

Defined cases: a null text encodes as the empty text; an empty text has no ids; strings of special tokens in a text
are ordinary text; texts of any length are encoded whole; rows are independent, so repeated rows and ties give repeated results; an input column that has
an output's name is replaced; an empty table gives an empty table. An id without bytes in the vocabulary raises
ValueError on decoding.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from entwine.llm.common import SLICE_BYTES, release, slices, with_arrays, with_fields
from entwine.llm.words import FIRST_BYTES, eights, mix, text_bytes

#: Distinct matches whose ids a worker keeps, for later tasks too; at this number the cache starts anew.
CACHE = 1_200_000
#: Bytes of matches of more than 16 bytes among them, as these may have any length; beyond that it starts anew, too.
LONG_BYTES = 16 << 20


def byte_characters() -> dict[int, str]:
    """The byte-level table: printable Latin-1 bytes stand for themselves, the others for characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge list behind a rank file: for each token of two or more bytes, the two parts left when only lower ranks merge."""
    found = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            found.append((parts[0], parts[1]))
    return found


def place(name: str) -> str:
    """A path, or the name of a file of the installed public tokenizers, looked up where this runs."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: Classes of bytes: white space, letters (those of two-byte characters too), digits, signs; and bytes that only other texts have.
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[0x21:0x7F] = SIGN
CLASS[[9, 10, 13, 32]] = SPACE
CLASS[ord("0") : ord("9") + 1] = DIGIT
CLASS[ord("A") : ord("Z") + 1] = CLASS[ord("a") : ord("z") + 1] = LETTER
CLASS[0x80:0xC0] = CLASS[0xC3:0xC9] = LETTER  # U+00C0 to U+023F
#: How many matches are given to the library in one text, and the byte between them, which no text has.
TOGETHER, BETWEEN = 100, b"\xff"
#: The byte-level table, in which BETWEEN is a blank.
CHARACTERS = np.array([ord(c) for _, c in sorted(byte_characters().items())], "<u4")
CHARACTERS[BETWEEN[0]] = ord(" ")
APOSTROPHE, BLANK = ord("'"), ord(" ")


def usual_rows(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which rows hold nothing but characters on whose classes all engines agree."""
    odd = kind == OTHER
    # the signs among the letters of that range
    odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    usual = np.ones(len(offsets) - 1, bool)
    usual[np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1] = False
    return usual


def match_starts(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the matches of the split pattern begin, in rows that are usual.

    A run of one class is a match, together with a blank before it. Of white space before anything else the last character is
    left out of the match, and is one of its own unless it is that blank. An apostrophe alone, with s, t, m, d, re, ve or ll
    after it, is a match with these letters.
    """
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    edge = first[:-1]
    changed = np.ones(n, bool)
    changed[1:] = kind[1:] != kind[:-1]
    changed |= edge
    blank = np.zeros(n, bool)  # the character before, in the same row, is a blank
    blank[1:] = data[:-1] == BLANK
    blank &= ~edge
    space = kind == SPACE
    last = np.zeros(n, bool)  # followed by something else in the same row
    last[:-1] = ~space[1:]
    last[:-1] &= ~first[1:-1]
    start = (changed & (space | ~blank)) | (space & last)
    at = np.flatnonzero((data == APOSTROPHE) & changed & ~blank)
    if len(at):
        inside = np.append(data, np.zeros(3, np.uint8))
        stop = np.append(first, np.ones(2, bool))  # whether a row ends there
        one, two = inside[at + 1], inside[at + 2]
        one = np.where(stop[at + 1], 0, one)
        two = np.where((one == 0) | stop[at + 2], 0, two)
        is_ = lambda values, letters: np.isin(values, np.frombuffer(letters.encode(), np.uint8))
        short = is_(one, "stmd")
        long = (is_(one, "rv") & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[at[short | long] + 1] = False
        for ends in (at[short] + 2, at[long] + 3):
            start[ends[ends < n]] = True
    return np.flatnonzero(start)


def name_of(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of a match's bytes."""
    return mix(low + mix(high + np.uint64(0x9E3779B97F4A7C15)))


def roomy(values: np.ndarray, n: int) -> np.ndarray:
    """The values, with places for n in all; new places come by the half, so that adding values doesn't copy all of them each time."""
    if n <= len(values):
        return values
    out = np.empty(max(n, len(values) * 3 // 2), values.dtype)
    out[: len(values)] = values
    return out


class Known:
    """Matches of up to 16 bytes by their bytes, as two integers, in a table with open addressing.

    The table holds numbers alone; the bytes stand in the order of the numbers, so that those of frequent matches, which are met early,
    stay in the processor's cache.
    """

    def __init__(self, bits: int = 21):
        self.mask, self.shift = np.uint64((1 << bits) - 1), np.uint64(64 - bits)
        self.number = np.zeros(1 << bits, np.int32)  # from 1 on; 0 is an empty place
        self.low, self.high = np.zeros((2, 1), np.uint64)  # no match is without bytes, so none has the zeros of number 0

    def place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15)
        h ^= high * np.uint64(0xD1B54A32D192ED03)
        h >>= self.shift
        return h.view(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each match, -1 of those that aren't in the table."""
        at = self.place(low, high)
        out = self.number.take(at).astype(np.int64)
        same = self.low.take(out) == low
        same &= self.high.take(out) == high
        rows = np.flatnonzero(~same)
        rows = rows[out[rows] != 0]
        at = at[rows]
        while len(rows):  # another match is there
            at = (at + 1) & np.int64(self.mask)
            found = self.number[at].astype(np.int64)
            out[rows] = found
            on = (found != 0) & ((self.low[found] != low[rows]) | (self.high[found] != high[rows]))
            rows, at = rows[on], at[on]
        out -= 1
        return out

    def add(self, low: np.ndarray, high: np.ndarray, numbers: np.ndarray) -> None:
        """Put different new matches in."""
        rows, at, numbers = np.arange(len(low)), self.place(low, high), numbers + 1
        most = int(numbers.max()) + 1
        self.low, self.high = roomy(self.low, most), roomy(self.high, most)
        self.low[numbers], self.high[numbers] = low, high
        while len(rows):
            free = np.flatnonzero(self.number[at] == 0)
            self.number[at[free]] = numbers[rows[free]]
            on = self.number[at] != numbers[rows]  # of those that want one place, one has it
            rows, at = rows[on], (at[on] + 1) & np.int64(self.mask)


class Codec:
    """One vocabulary in one worker. `vocab` is a rank file (.tiktoken) or a file of the tokenizers library (.json)."""

    def __init__(self, vocab: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        to_char = byte_characters()
        path = place(vocab)
        if path.endswith(".json"):
            self.tokenizer = Tokenizer.from_file(path)
            to_byte = {c: b for b, c in to_char.items()}
            special = {i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
            self.bytes_of = {i: (t.encode() if i in special else bytes(to_byte[c] for c in t)) for t, i in self.tokenizer.get_vocab(True).items()}
        else:
            import base64

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
            chars = lambda token: "".join(to_char[b] for b in token)
            model = models.BPE(vocab={chars(t): r for t, r in ranks.items()}, merges=[(chars(a), chars(b)) for a, b in merges_of(ranks)])
            self.tokenizer = Tokenizer(model)
            self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.bytes_of = {r: t for t, r in ranks.items()}
        self.tokenizer.encode_special_tokens = True
        # the same model for texts that are split already: matches in the characters of the byte-level table, with blanks between them
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        ends = sorted(self.bytes_of)
        sizes = np.zeros((ends[-1] if ends else 0) + 2, np.int64)
        for i in ends:
            sizes[i + 1] = len(self.bytes_of[i])
        self.byte_ends = np.cumsum(sizes)
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of[i] for i in ends), np.uint8)
        self.forget()

    def forget(self) -> None:
        """Start the cache anew: the number of each match, then the ids by number."""
        self.known, self.long, self.long_bytes = Known(), {}, 0
        self.starts, self.flat, self.learned = np.zeros(1, np.int64), np.empty(0, "<u4"), 0

    def learn(self, matches: list[bytes]) -> np.ndarray:
        """Numbers of new matches, which are given to the library many at a time, as one text, with blanks between them."""
        raw = [BETWEEN.join(matches[k : k + TOGETHER]) for k in range(0, len(matches), TOGETHER)]
        runs = [CHARACTERS.take(np.frombuffer(r, np.uint8)).tobytes().decode("utf-32-le") for r in raw]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(runs, add_special_tokens=False)])
        ends = np.cumsum(self.byte_ends[ids.astype(np.int64) + 1] - self.byte_ends[ids])
        wanted = np.cumsum(np.fromiter(map(len, matches), np.int64, len(matches)))
        edges = np.searchsorted(ends, wanted) + 1
        if not len(ends) or ends[-1] != wanted[-1] or (ends[edges - 1] != wanted).any():
            raise ValueError("a run of matches was split at other places")
        first, used = self.learned, int(self.starts[self.learned])
        self.learned = first + len(matches)
        self.starts, self.flat = roomy(self.starts, self.learned + 1), roomy(self.flat, used + len(ids))
        self.starts[first + 1 : self.learned + 1] = used + edges
        self.flat[used : used + len(ids)] = ids
        return np.arange(first, self.learned)

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of every match; new ones are given to the library once."""
        view, size = eights(np.append(data, np.zeros(8, np.uint8))), ends - starts
        low = view[starts] & FIRST_BYTES[np.minimum(size, 8)]
        high, more = np.zeros(len(starts), np.uint64), np.flatnonzero(size > 8)
        high[more] = view[starts[more] + 8] & FIRST_BYTES[np.minimum(size[more] - 8, 8)]
        out = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(size <= 16)
        out[short] = self.known.find(low[short], high[short])
        new = short[out[short] < 0]
        if len(new):
            _, first, which = np.unique(name_of(low[new], high[new]), return_index=True, return_inverse=True)
            sample = new[first]
            same = (low[sample][which] == low[new]) & (high[sample][which] == high[new])
            if not same.all():  # two matches of one hash
                sample, which = np.concatenate([sample, new[~same]]), np.where(same, which, len(sample) + np.cumsum(~same) - 1)
            whole = data.tobytes()
            made = self.learn([whole[a:b] for a, b in zip(starts[sample].tolist(), ends[sample].tolist())])
            self.known.add(low[sample], high[sample], made)
            out[new] = made[which]
        rest = np.flatnonzero(size > 16)
        texts = [data[starts[i] : ends[i]].tobytes() for i in rest]
        unknown = [t for t in dict.fromkeys(texts) if t not in self.long]
        if unknown:
            self.long |= dict(zip(unknown, self.learn(unknown).tolist()))
            self.long_bytes += sum(map(len, unknown))
        out[rest] = [self.long[t] for t in texts]
        return out

    def ids(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers; null is empty."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if self.learned >= CACHE or self.long_bytes > LONG_BYTES:
            self.forget()
        data, offsets = text_bytes(column)
        kind = np.frombuffer(data.tobytes().translate(CLASS.tobytes()), np.uint8)
        usual = usual_rows(data, offsets, kind)
        starts = match_starts(data, offsets, kind)
        ends = np.append(starts[1:], len(data))
        per_row = np.diff(np.searchsorted(starts, offsets))  # a match begins wherever a row does
        if not usual.all():
            keep = np.repeat(usual, per_row)
            starts, ends, per_row = starts[keep], ends[keep], per_row * usual
        n = self.numbers(data, starts, ends)
        first, size = self.starts[n], self.starts[n + 1] - self.starts[n]
        done = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(first - done[:-1], size)
        at += np.arange(len(at))
        flat = self.flat.take(at)
        edges = done[np.concatenate([[0], np.cumsum(per_row)])]
        out = [flat[a:b] for a, b in zip(edges.tolist(), edges[1:].tolist())]
        rare = np.flatnonzero(~usual).tolist()
        for i, e in zip(rare, self.tokenizer.encode_batch_fast([column[i].as_py() for i in rare], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4")
        return out

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, one after the other, and where each id's begin (one entry more at the end)."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.byte_ends) - 1 or (len(self.bytes_of) < len(self.byte_ends) - 1 and not np.isin(ids, list(self.bytes_of)).all())):
            raise ValueError("an id is not in the vocabulary")
        begin, size = self.byte_ends[ids], self.byte_ends[ids + 1] - self.byte_ends[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.all_bytes[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])], ends

    def decode(self, ids) -> bytes:
        """The bytes of the ids."""
        try:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        except KeyError as e:
            raise ValueError(f"id {e.args[0]} is not in the vocabulary") from None


@functools.lru_cache(maxsize=2)
def codec(vocab: str) -> Codec:
    """The worker's codec for a vocabulary, made once."""
    found = Codec(vocab)
    gc.freeze()  # it stays as long as the worker, so `release` need not walk through it after every task
    return found


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """A list<int32> array of the ids."""
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.empty(0, "<u4")]).astype(np.int32)))


def encode_batches(batches: Iterator[pa.RecordBatch], vocab: str, text: str = "text", out: str = "ids") -> Iterator[pa.RecordBatch]:
    """Batches with the column `out` of ids."""
    own = codec(vocab)
    for batch in slices(batches, text, SLICE_BYTES // 2):
        yield with_arrays(batch, {out: lists(own.ids(batch.column(text)))})
    release()


def decode_batches(batches: Iterator[pa.RecordBatch], vocab: str, ids: str = "ids", out: str = "decoded") -> Iterator[pa.RecordBatch]:
    """Batches with the column `out` of bytes; null ids decode to no bytes."""
    own = codec(vocab)
    for batch in batches:
        flat = batch.column(ids)
        values, ends = flat.values.to_numpy(zero_copy_only=False), flat.offsets.to_numpy()
        made, begin = own.decode_all(values[ends[0] : ends[-1]])
        places = begin[ends - ends[0]].astype(np.int32)
        yield with_arrays(batch, {out: pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(places), pa.py_buffer(made)])})


def encode(df: DataFrame, vocab: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of `text` as array<int>."""
    return df.mapInArrow(lambda it: encode_batches(it, vocab, text, out), with_fields(df, [(out, T.ArrayType(T.IntegerType()))]))


def encode_with_offsets(df: DataFrame, vocab: str, text: str = "text") -> DataFrame:
    """df with `ids` and, for each id, `starts` and `ends`: the code points of the text that it covers; ids that split a character cover all of it."""

    def run(batches):
        own = codec(vocab)
        for batch in slices(batches, text, SLICE_BYTES // 8):
            found = own.tokenizer.encode_batch([t or "" for t in batch.column(text).to_pylist()], add_special_tokens=False)
            kind = pa.list_(pa.int32())
            yield with_arrays(batch, {"ids": pa.array([e.ids for e in found], kind), "starts": pa.array([[a for a, _ in e.offsets] for e in found], kind), "ends": pa.array([[b for _, b in e.offsets] for e in found], kind)})

    ints = T.ArrayType(T.IntegerType())
    return df.mapInArrow(run, with_fields(df, [("ids", ints), ("starts", ints), ("ends", ints)]))


def decode(df: DataFrame, vocab: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes of `ids`."""
    return df.mapInArrow(lambda it: decode_batches(it, vocab, ids, out), with_fields(df, [(out, T.BinaryType())]))


def round_trip(df: DataFrame, vocab: str, text: str = "text") -> DataFrame:
    """df with `ids` and `decoded`, both made in one worker."""
    schema = with_fields(df, [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.BinaryType())])
    return df.mapInArrow(lambda it: decode_batches(encode_batches(it, vocab, text), vocab), schema)


def digests(df: DataFrame, vocab: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode and digest in one worker: key, n_tokens, ids_sha256 (little-endian 32-bit), decoded_sha256."""

    def run(batches):
        for batch in decode_batches(encode_batches(batches, vocab, text), vocab):
            ids = batch.column("ids")
            values, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.array([hashlib.sha256(values[a:b]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string()),
                    pa.array([hashlib.sha256(d.as_buffer()).hexdigest() for d in batch.column("decoded")], pa.string()),
                ],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = T.StructType([df.schema[key], *(T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())))])
    return df.select(key, text).mapInArrow(run, schema)
