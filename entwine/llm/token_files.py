"""Token-id files: an adaptive context-mixing range coder over independent blocks.

A block holds up to BLOCK ids and starts from nothing: no block needs another to be read, and each carries its length and
the CRC-32 of its ids. For every id an order-2 and an order-1 table give the id that followed the same two and the same one
ids last, with a count of how often in a row that was right. The chances that adaptive probabilities give to these and
to order 0 are mixed in the logistic domain by weights that learn in the block; the mixed chance drives the
arithmetic coding of "the predicted id". Any other id is coded by the order-0 model: one of 16 classes of ids with
adaptive counts, then the place in the class. All arithmetic is exact on integers, so it is the same on every machine.

Python would be slow for one block at a time, so the blocks of a shard (four to eight millions of ids where a part has as many) are
coded in step: every numpy operation handles one id of each block.

Files are Parquet with a row for each shard: part, shard, keys and counts of its documents, and its blocks. Parts and
shards are in ascending order of the keys.

Defined cases: null text is empty and gives the end id alone; ids must be below 65,536; rows of equal keys stand in the order
of their texts, null keys first; texts of any length are encoded whole, and a shard may be one text; only key and text are read, so other columns cannot clash; an empty table
gives an empty file; a block that was cut or altered raises ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entwine.llm.byte_bpe import codec
from entwine.llm.common import slices

BLOCK = 1024
#: A shard has fewer ids than this and its last texts together, and half as many or more if its part has.
SHARD_IDS = 8_000_000
MAGIC, HEADER = b"CMR1", struct.Struct("<4sII")
#: Entries of the order-1 and order-2 tables of a block.
ENTRIES = 1024
#: Classes of ids from id 0 on: four of each of these sizes (powers of two), so that the last end beyond 65,536.
CLASS_BITS = np.repeat([8, 10, 12, 14], 4)
CLASSES = len(CLASS_BITS)
CLASS_START = np.concatenate([[0], np.cumsum(1 << CLASS_BITS)])
#: 12-bit chances in the logistic domain: a rational curve, so that integers suffice.
STRETCH = np.array([((2 * c - 4096) << 8) // (4096 - abs(2 * c - 4096)) if c else -(1 << 20) for c in range(4096)], np.float64)
#: The same, and behind it what a chance counts for when another id than its own is the prediction.
SIGNED = np.concatenate([STRETCH, -np.abs(STRETCH)])


def moved(rate: int) -> np.ndarray:
    """Chances after the id was another one, and behind them after it was right."""
    c = np.arange(4096)
    return np.clip(np.concatenate([c + ((right - c) >> rate) for right in (0, 4096)]), 16, 4080)


#: What becomes of a chance of a run, and of the chance that any prediction is right.
NEXT_CHANCE, NEXT_ANY = moved(4).astype(np.int16), moved(5)
#: For each run, where the id was another one and, behind that, where it was right: what of an entry stays (the rest is the new id's),
#: and what is added to it.
RUN = np.arange(16)
STAYS = np.concatenate([np.where(RUN < 2, 0, -1), np.full(16, -1)]).astype(np.int32)
GROWS = np.concatenate([np.where(RUN < 2, 0, (RUN >> 1) - RUN), RUN < 15]).astype(np.int32)
#: The class of every id.
CLASS_OF = np.repeat(np.arange(CLASSES, dtype=np.uint8), 1 << CLASS_BITS)[: 1 << 16]
ABOVE = np.arange(1, CLASSES + 1, dtype=np.int16)[:, None]
U = np.uint64
START_OF, BITS_OF = CLASS_START.astype(U), CLASS_BITS.astype(U)
TOP, BOTTOM, MOST_PLACE = U(1 << 48), U(1 << 32), U((1 << 14) - 1)


class Model:
    """The predictions of `rows` blocks, in step. Where arrays have two rows, they are of order 1 and order 2.

    Chances and weights are floats that hold integers of less than 2^53, whose sums, products and rounded quotients are exact.
    Choices are made by arithmetic and by small tables, as numpy takes several times longer over a mask.
    """

    def __init__(self, rows: int):
        self.rows = rows
        # entries of one context stand beside each other: frequent ones then stay in the processor's cache
        self.tables = np.arange(rows) + np.array([[0], [ENTRIES * rows]])
        self.both = np.arange(2 * rows).reshape(2, rows)
        self.held = np.zeros(2 * rows * ENTRIES, np.int32)  # id and, in the last four bits, how often in a row it was right
        self.chance = np.full(2 * rows * 16, 1024, np.int16)
        self.any = np.full(rows, 1024, np.int64)
        self.weights = np.full((3, rows), 24000.0)
        self.inputs, self.parts = np.empty((2, 3, rows))
        self.hashes = np.zeros((2, rows), np.uint16)
        self.before = np.zeros(rows, np.uint16)
        self.ends = np.repeat(np.arange(CLASSES + 1, dtype=np.int16)[:, None], rows, 1)  # of the classes' counts; at most 16,024
        self.kinds, self.more = np.empty(rows, np.int16), np.empty((CLASSES, rows), np.int16)

    def look(self) -> None:
        """Look up what followed the last ids."""
        self.at = self.hashes.astype(np.int64)
        self.at *= self.rows
        self.at += self.tables
        self.found = found = self.held.take(self.at)
        self.guess = found >> 4
        self.run = (found & 15).astype(np.int64)
        self.chance_at = self.run * (2 * self.rows)  # side by side, as most runs are short
        self.chance_at += self.both
        self.best = (found[1] == 0).astype(np.int32)  # order 2 has met nothing
        self.best *= self.guess[0]
        self.best += self.guess[1]

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The predicted id of each block and its chance in 16 bits."""
        guess, x = self.best, self.inputs
        self.now = now = self.chance.take(self.chance_at).astype(np.int64)
        STRETCH.take(self.any, out=x[0], mode="clip")
        signed = (self.guess[0] != guess).astype(np.int64)
        signed <<= 12
        signed += now[0]
        SIGNED.take(signed, out=x[1], mode="clip")
        STRETCH.take(now[1], out=x[2], mode="clip")
        mixed = np.multiply(self.weights, x, out=self.parts)[0]
        mixed += self.parts[1]
        mixed += self.parts[2]
        mixed *= 1 / 65536
        np.floor(mixed, out=mixed)
        size = np.abs(mixed)
        size += 256
        mixed *= 32768
        mixed /= size
        self.p = np.floor(mixed, out=mixed)
        mixed += 32768
        np.minimum(np.maximum(mixed, 48, out=mixed), 65536 - 48, out=mixed)
        return guess, mixed.astype(np.int64).view(U)

    def enter(self, ids: np.ndarray) -> None:
        """Put the blocks' ids into what was looked up."""
        self.right = right = (self.guess == ids).astype(np.int64)
        right <<= 4
        self.run += right
        anew = ids << 4
        anew |= 1
        found = self.found
        found ^= anew
        found &= STAYS.take(self.run)
        found ^= anew
        found += GROWS.take(self.run)
        self.held[self.at] = found
        last = ids.astype(np.uint16)
        np.multiply(last, 40503, out=self.hashes[0])  # only bits 4 to 13 count
        np.multiply(last, 30011, out=self.hashes[1])
        self.hashes[1] += self.before
        self.before = last * np.uint16(50021)
        self.hashes >>= 4
        self.hashes &= ENTRIES - 1

    def learn(self, hit: np.ndarray) -> None:
        """Learn chances and weights from the ids that were entered."""
        error = self.p * (-1 / 4096)
        error += hit.astype(np.float64) * 16
        step = np.multiply(self.inputs, error, out=self.parts)
        self.weights += np.floor(step, out=step)
        np.minimum(np.maximum(self.weights, -(1 << 19), out=self.weights), 1 << 19, out=self.weights)
        hit = hit.astype(np.int64)
        hit <<= 12
        self.any += hit
        self.any = NEXT_ANY.take(self.any)
        self.right <<= 8
        self.now += self.right
        self.chance[self.chance_at] = NEXT_CHANCE.take(self.now)

    def span(self, rows: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the counts of the rows' classes begin, and how large they are."""
        at, flat = kind * self.rows, self.ends.reshape(-1)
        at += rows
        start = flat.take(at)
        at += self.rows
        return start.astype(U), (flat.take(at) - start).astype(U)

    def total(self, rows: np.ndarray) -> np.ndarray:
        return self.ends[CLASSES].take(rows).astype(U)

    def kind(self, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        """In which class's counts each value lies."""
        self.kinds[rows] = values.astype(np.int16)
        return np.add.reduce((self.ends[1:-1] <= self.kinds).view(np.int8), 0, dtype=np.int8).take(rows).astype(np.int64)

    def count(self, kinds: np.ndarray) -> None:
        """Order 0 takes in the class of each block; CLASSES and more are none."""
        more = np.subtract(kinds, ABOVE, out=self.more)
        more >>= 15
        more &= 24
        self.ends[1:] += more
        if self.ends[CLASSES].max() > 16000:
            full = np.flatnonzero(self.ends[CLASSES] > 16000)
            self.ends[1:, full] = np.cumsum((np.diff(self.ends[:, full], axis=0) + 1) >> 1, 0)


class Coder:
    """Range coders of `rows` blocks, in step, without carries: the range is cut where one would come.

    The blocks' first words stand side by side in `words`, then their second ones, as blocks are near one place at any time; `at` is where
    each block's next word stands there. Decoding, `ahead` is how far the code lies above `low`.
    """

    def __init__(self, words: np.ndarray, decode: bool = False):
        self.rows = rows = words.shape[1]
        self.low, self.range, self.ahead = np.zeros(rows, U), np.full(rows, ~U(0), U), None
        self.words, self.at = words.reshape(-1), np.arange(rows)
        if decode:
            self.ahead = np.zeros(rows, U)
            for _ in range(4):
                self.ahead <<= U(16)
                self.ahead |= self.words.take(self.at)
                self.at += rows

    def pick(self, rows: np.ndarray) -> Coder:
        """The coders of some of the rows."""
        own = Coder.__new__(Coder)
        own.rows, own.words = self.rows, self.words
        own.low, own.range, own.at = self.low.take(rows), self.range.take(rows), self.at.take(rows)
        own.ahead = None if self.ahead is None else self.ahead.take(rows)
        return own

    def put_back(self, rows: np.ndarray, own: Coder) -> None:
        self.low[rows], self.range[rows], self.at[rows] = own.low, own.range, own.at
        if self.ahead is not None:
            self.ahead[rows] = own.ahead

    def go(self, start: np.ndarray, wide: np.ndarray) -> None:
        """Go into a part of the range: `start` above its begin, and `wide`. Where that settles words, they are written or read."""
        low, ahead, words = self.low, self.ahead, self.words
        low += start
        if ahead is not None:
            ahead -= start
        self.range = wide
        ends = low + wide
        ends ^= low
        same = ends < TOP
        rows = (same | (wide < BOTTOM)).nonzero()[0]
        if not len(rows):
            return
        one, size, at, same = low.take(rows), wide.take(rows), self.at.take(rows), same.take(rows)
        if ahead is not None:
            on = ahead.take(rows)
        while True:
            if not same.all():
                size = np.where(same, size, (~one + U(1)) & (BOTTOM - U(1)))
            if ahead is None:
                words[at] = (one >> U(48)).astype(np.uint16)
            else:
                on <<= U(16)
                on |= words.take(at, mode="clip").astype(U)
                ahead[rows] = on
            at += self.rows
            one <<= U(16)
            size <<= U(16)
            low[rows], wide[rows], self.at[rows] = one, size, at
            ends = one + size
            ends ^= one
            same = ends < TOP
            again = (same | (size < BOTTOM)).nonzero()[0]
            if not len(again):
                return
            rows, one, size, at, same = rows.take(again), one.take(again), size.take(again), at.take(again), same.take(again)
            if ahead is not None:
                on = on.take(again)

    def flag(self, p: np.ndarray, hit: np.ndarray | None = None) -> np.ndarray:
        """Code whether the prediction is right, which has the chance p in 16 bits; decoding, find it out."""
        unit = self.range >> U(16)
        of_hit = p * unit
        if hit is None:
            hit = self.ahead < of_hit
        missed = hit.astype(U)
        missed -= U(1)  # all bits, or none
        unit <<= U(16)
        unit -= of_hit
        unit -= of_hit
        unit &= missed
        unit += of_hit
        of_hit &= missed
        self.go(of_hit, unit)
        return hit


def turned(values: np.ndarray, kind: str) -> np.ndarray:
    """Columns as rows of the given type, some at a time so that they stay in the processor's cache."""
    out = np.empty(values.shape[::-1], kind)
    for i in range(0, len(values), 64):
        out[:, i : i + 64] = values[i : i + 64].T
    return out


def room_of(ids: int) -> int:
    """Words that a block of so many ids can have."""
    return 3 * ids + 8


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of a run of ids, with their headers."""
    ids = np.asarray(ids)
    if not len(ids):
        return []
    if ids.max() >= 1 << 16:
        raise ValueError("ids must be below 65,536")
    n = -(-len(ids) // BLOCK)
    sizes = np.full(n, BLOCK)
    sizes[-1] = len(ids) - (n - 1) * BLOCK
    most = int(sizes[0])
    grid = np.zeros(n * most, np.uint16)  # the last block's ids go on with zeros, which are left out of its bytes
    grid[: len(ids)] = ids
    grid = grid.reshape(n, most)
    steps, model, coder = turned(grid, "u2"), Model(n), Coder(np.zeros((room_of(most), n), np.uint16))
    for t in range(most):
        if t == sizes[-1]:
            last = coder.low[-1], coder.at[-1]
        now = steps[t].astype(np.int32)
        model.look()
        model.enter(now)  # while the entries are in the processor's cache
        guess, p = model.predict()
        hit = guess == now
        coder.flag(p, hit)
        model.learn(hit)
        missed = (~hit).nonzero()[0]
        if len(missed):
            own = now.take(missed)
            kind = CLASS_OF.take(own).astype(np.int64)
            part = coder.pick(missed)
            start, size = model.span(missed, kind)
            unit = part.range // model.total(missed)
            start *= unit
            size *= unit
            part.go(start, size)
            unit = part.range >> BITS_OF.take(kind)
            place = own.astype(U)
            place -= START_OF.take(kind)
            place *= unit
            part.go(place, unit)
            coder.put_back(missed, part)
            kinds = hit * np.int16(CLASSES)
            kinds += CLASS_OF.take(now)
            model.count(kinds)
    if sizes[-1] < most:
        coder.low[-1], coder.at[-1] = last
    for shift in (48, 32, 16, 0):
        coder.words[coder.at] = (coder.low >> U(shift)).astype(np.uint16)
        coder.at += n
    used = coder.at // n
    words = turned(coder.words.reshape(-1, n)[: used.max()], "<u2")
    return [HEADER.pack(MAGIC, size, zlib.crc32(row[:size].astype("<u4"))) + own[:end].tobytes() for size, row, own, end in zip(sizes.tolist(), grid, words, used.tolist())]


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    """The ids of the blocks; only the last may be short."""
    if not blocks:
        return np.empty(0, "<u4")
    heads = [HEADER.unpack_from(b) if len(b) >= HEADER.size else (b"", 0, 0) for b in blocks]
    sizes = np.array([h[1] for h in heads])
    if any(h[0] != MAGIC for h in heads) or sizes.max() > BLOCK or (sizes[:-1] != BLOCK).any():
        raise ValueError("not a block of this format, or cut")
    n, most = len(blocks), int(sizes[0])
    lengths = [min((len(b) - HEADER.size) // 2, room_of(most)) for b in blocks]
    words = np.zeros((n, max(lengths) + 4), np.uint16)
    for row, block, length in zip(words, blocks, lengths):
        row[:length] = np.frombuffer(block, "<u2", length, HEADER.size)
    steps, model, coder = np.empty((most, n), np.uint16), Model(n), Coder(turned(words, "u2"), decode=True)
    for t in range(most):  # what comes after a short last block's end is left out
        model.look()
        now, p = model.predict()
        hit = coder.flag(p)
        missed = (~hit).nonzero()[0]
        if len(missed):
            part = coder.pick(missed)
            total = model.total(missed)
            unit = part.range // total
            total -= U(1)
            kind = model.kind(missed, np.minimum(part.ahead // unit, total))
            start, size = model.span(missed, kind)
            start *= unit
            size *= unit
            part.go(start, size)
            unit = part.range >> BITS_OF.take(kind)
            place = np.minimum(part.ahead // unit, MOST_PLACE)
            now[missed] = (START_OF.take(kind) + place).astype(np.int32)
            place *= unit
            part.go(place, unit)
            coder.put_back(missed, part)
            kinds = np.full(n, CLASSES, np.int16)
            kinds[missed] = kind.astype(np.int16)
            model.count(kinds)
        steps[t] = now
        model.enter(now)
        model.learn(hit)
    ids = turned(steps, "<u4").reshape(-1)[: int(sizes.sum())]
    ends = np.cumsum(sizes).tolist()
    for size, end, (_, _, check) in zip(sizes.tolist(), ends, heads):
        if zlib.crc32(ids[end - size : end]) != check:
            raise ValueError("a block's ids do not have its checksum")
    return ids


def shards(batches: Iterator[pa.RecordBatch], vocab: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """The shards of one part's rows. When SHARD_IDS ids wait, half of them are written, so that the last shard isn't small either."""
    own, end = codec(vocab), np.array([end_id], "<u4")
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    waiting, size, number, part = deque(), 0, 0, None

    def shard(least: int) -> pa.RecordBatch:
        nonlocal size, number
        keys, found, n = [], [], 0
        while waiting and n < least:
            more_keys, more, k = waiting.popleft()
            keys.append(more_keys)
            found += more
            n += k
        counts = pa.array([len(ids) + 1 for ids in found], pa.int64())
        found = np.concatenate([x for ids in found for x in (ids, end)])
        more = None  # noqa: F841
        made = [part, pa.array([number], pa.int32()), one(pa.concat_arrays(keys)), one(counts), one(pa.array(encode_blocks(found), pa.binary()))]
        size, number = size - n, number + 1
        return pa.RecordBatch.from_arrays(made, names=["part", "shard", "keys", "counts", "blocks"])

    for batch in slices(batches, "text"):
        ids = own.ids(batch.column("text"))
        n = sum(map(len, ids)) + len(ids)
        waiting.append((batch.column("key"), ids, n))
        size, part, ids = size + n, batch.column("part").slice(0, 1), None
        while size >= SHARD_IDS:
            yield shard(SHARD_IDS // 2)
    if waiting:
        yield shard(size)


def write(docs: DataFrame, path: str, vocab: str, end_id: int, key: str = "doc_id", text: str = "text", parts: int | None = None) -> None:
    """Encode every text, append end_id, and write the ids in ascending key order."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).repartitionByRange(parts, F.col("key").asc_nulls_first())
    rows = rows.withColumn("part", F.spark_partition_id()).sortWithinPartitions(F.col("key").asc_nulls_first(), F.col("text").asc_nulls_first())
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("blocks", T.ArrayType(T.BinaryType()))])
    rows.mapInArrow(lambda it: shards(it, vocab, end_id), schema).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, shard, keys, counts and ids (array<int>) of a written file's shards."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = decode_blocks(batch.column("blocks")[i].as_py())
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in ("part", "shard", "keys", "counts")), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids.astype(np.int32)))], names=["part", "shard", "keys", "counts", "ids"])

    df = spark.read.parquet(path)
    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in ("part", "shard", "keys", "counts")), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, shard and before: ids in all earlier shards of the file."""
    sizes = spark.read.parquet(path).select("part", "shard", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    parts = sorted((r["part"], r["n"]) for r in sizes.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row for each part
    before, rows = 0, []
    for part, n in parts:
        rows.append((part, before))
        before += n
    bases = spark.createDataFrame(rows, "part int, base long")
    inside = F.sum("n").over(W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    return sizes.withColumn("inside", inside).join(F.broadcast(bases), "part").select("part", "shard", (F.col("base") + F.col("inside")).alias("before"))


def read_digests(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers) of every document in the file."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, counts = decode_blocks(batch.column("blocks")[i].as_py()), batch.column("counts")[i].values.to_numpy()
                ends = np.cumsum(counts)
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("part")[i].as_py()] * n, pa.int32()), pa.array([batch.column("shard")[i].as_py()] * n, pa.int32()), batch.column("keys")[i].values, pa.array(ends - counts), pa.array(counts), pa.array([zlib.crc32(ids[a:b]) for a, b in zip(ends - counts, ends)], pa.int64())],
                    names=["part", "shard", "key", "inside", "n_tokens", "ids_crc32"],
                )

    df = spark.read.parquet(path)
    kind = df.schema["keys"].dataType.elementType
    fields = [("part", T.IntegerType()), ("shard", T.IntegerType()), ("key", kind), ("inside", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType())]
    found = df.select("part", "shard", "keys", "counts", "blocks").mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))
    return found.join(shard_starts(spark, path), ["part", "shard"]).select(F.col("key").alias(key), (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
