"""Benchmark decontamination with a distributed positional inverted index.

Every shard of documents (a few megabytes of text) stores, for each term, the ascending positions at which it stands; the
shards are a Parquet table in the shared folder. Benchmark items are cut into windows of words. In each shard a window
starts from its rarest term over all documents: the term's positions, less its offset in the window, are the possible beginnings,
and the offset-adjusted positions of the next rarest terms are intersected with them until none is left or all terms agree,
which is an exact phrase match. Proximity matching asks only that all terms stand within a span.

Words are 64-bit hashes of the whole word. Postings are kept for all terms of all documents, so an index answers any benchmark.
Windows are sent in blocks of MOST_WINDOWS, one block after the other; each block meets all shards.

Defined cases: null or empty text has no words; an item without words has no window, one with fewer words than a
window is one window; a window does not reach over the end of a document; repeated items each count, repeated rows of
documents each get a row, null keys too; a null item key counts as the empty string; items are in the order of their keys as
strings, so equal keys are one; texts of any length are taken whole, a shard being one text where that is longer than
SHARD_BYTES; only the named columns are read, so other columns cannot clash; an empty benchmark hits nothing; an empty
table of documents gives an empty table. A window that stands in very many items carries all of their keys, as the result does.
"""

from __future__ import annotations

import functools
import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entwine.llm.common import LARGE_ROWS, cut, cut_rows, slices
from entwine.llm.words import NOT_ALNUM, word_hashes

WINDOW = 8
SHARD_BYTES = 4 << 20
MOST_WINDOWS = 200_000


def benchmark_windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: terms (array<long>) and items (the keys as strings, sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, ends = word_hashes(batch.column("text"), NOT_ALNUM)
            names, rows = [], []
            for name, a, b in zip(batch.column("item").to_pylist(), ends, ends[1:]):
                for i in range(a, max(a + (b > a), b - window + 1)):
                    names.append(name)
                    rows.append(words[i : min(i + window, b)].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(rows, pa.list_(pa.int64()))], names=["item", "terms"])

    made = items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(run, "item string, terms array<long>")
    return made.groupBy("terms").agg(F.sort_array(F.collect_set(F.coalesce("item", F.lit("")))).alias("items"))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all terms: one row for each shard, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SHARD_BYTES):
            pieces = [word_hashes(piece.column("text"), NOT_ALNUM) for piece in cut_rows(batch, "text")]
            words = np.concatenate([w for w, _ in pieces])
            before = np.cumsum([0] + [len(w) for w, _ in pieces])
            first = np.concatenate([ends[:-1] + n for (_, ends), n in zip(pieces, before)] + [before[-1:]])
            at = np.argsort(words, kind="stable").astype(np.int32)
            own = words[at]
            last = np.flatnonzero(np.concatenate([own[1:] != own[:-1], [True]])) if len(own) else np.empty(0, np.int64)
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
            keys = batch.column("key")
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), one(first.astype(np.int32), pa.int32()), one(own[last].view(np.int64), pa.int64()), one((last + 1).astype(np.int32), pa.int32()), one(at, pa.int32())],
                names=["shard", "keys", "first", "terms", "ends", "positions"],
            )

    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("shard", T.StringType()), T.StructField("keys", T.ArrayType(kind)), *(T.StructField(n, T.ArrayType(t)) for n, t in (("first", T.IntegerType()), ("terms", T.LongType()), ("ends", T.IntegerType()), ("positions", T.IntegerType())))])
    return cut(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema), "postings", LARGE_ROWS)


def document_frequencies(index: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """term and n: how often each term of the index, or each wanted one (column term), stands in all documents."""
    counts = F.transform("ends", lambda e, i: F.struct(F.get("terms", i).alias("term"), (e - F.coalesce(F.get("ends", i - 1), F.lit(0))).alias("n")))
    rows = index.select(F.explode(counts).alias("c")).select("c.term", "c.n")
    if wanted is not None:
        rows = rows.join(wanted, "term", "left_semi")
    return rows.groupBy("term").agg(F.sum("n").alias("n"))


@dataclass
class Windows:
    """A block of windows in a task: terms padded to one width, each window's order from the rarest term on, and its items."""

    terms: np.ndarray
    sizes: np.ndarray
    order: np.ndarray
    items: list[list[str]]

    @classmethod
    def of(cls, rows: list, counts: dict[int, int]) -> Windows:
        rows = [r for r in rows if all(t in counts for t in r["terms"])]
        width = max((len(r["terms"]) for r in rows), default=1)
        terms, order = np.zeros((len(rows), width), np.uint64), np.zeros((len(rows), width), np.int16)
        for i, r in enumerate(rows):
            n = len(r["terms"])
            terms[i] = np.resize(np.array(r["terms"], np.int64).view(np.uint64), width)
            terms[i, n:] = terms[i, 0]
            order[i, :n] = sorted(range(n), key=lambda j: (counts[r["terms"][j]], j))
        return cls(terms, np.array([len(r["terms"]) for r in rows], np.int64), order, [list(r["items"]) for r in rows])


class Shard:
    """One row of the index in a task."""

    def __init__(self, first, terms, ends, positions):
        self.first = np.asarray(first, np.int64)
        self.terms = np.asarray(terms, np.int64).view(np.uint64)
        self.ends = np.concatenate([[0], np.asarray(ends, np.int64)])
        self.positions = np.asarray(positions, np.int64)

    def present(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the windows all of whose terms stand in the shard, and the place of each term."""
        if not len(self.terms) or not len(windows.terms):
            return np.empty(0, np.int64), np.empty((0, 1), np.int64)
        at = np.minimum(np.searchsorted(self.terms, windows.terms), len(self.terms) - 1)
        found = np.flatnonzero((self.terms[at] == windows.terms).all(1))
        return found, at[found]

    def list_of(self, place: int) -> np.ndarray:
        return self.positions[self.ends[place] : self.ends[place + 1]]

    def document_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, side="right") - 1

    def phrases(self, windows: Windows) -> Iterator[tuple[int, np.ndarray]]:
        """Window and the positions at which it begins, for every window that occurs."""
        for w, places in zip(*self.present(windows)):
            n, begin = windows.sizes[w], None
            for j in windows.order[w, :n]:
                own = self.list_of(places[j]) - j
                if begin is None:
                    begin = own
                else:
                    at = np.searchsorted(own, begin)
                    begin = begin[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] == begin)]
                if not len(begin):
                    break
            if len(begin):
                begin = begin[begin >= 0]
                begin = begin[self.document_of(begin) == self.document_of(begin + n - 1)]
                if len(begin):
                    yield int(w), begin

    def near(self, windows: Windows, slop: int) -> Iterator[tuple[int, np.ndarray]]:
        """Window and the documents in which all its terms stand within its length plus slop words."""
        for w, places in zip(*self.present(windows)):
            n = windows.sizes[w]
            span = n + slop
            pivot = self.list_of(places[windows.order[w, 0]])
            begin = np.unique((pivot[:, None] - np.arange(span)[None, :]).ravel())
            document = self.document_of(np.maximum(begin, 0))
            begin, document = begin[begin >= self.first[document]], document[begin >= self.first[document]]
            end = np.minimum(begin + span, self.first[document + 1])
            for place in np.unique(places[:n]):
                own = self.list_of(place)
                held = np.searchsorted(own, end) > np.searchsorted(own, begin)
                begin, end, document = begin[held], end[held], document[held]
            if len(document):
                yield int(w), np.unique(document)


def blocks_of(windows: DataFrame, index: DataFrame, most: int = MOST_WINDOWS) -> Iterator[Windows]:
    """The windows with their terms' frequencies, in blocks of about `most`; the driver holds one block at a time."""
    parts = max(1, -(-windows.count() // most))
    counts = cut(document_frequencies(index, windows.select(F.explode("terms").alias("term")).distinct()), "frequencies")
    for part in range(parts):
        own = windows if parts == 1 else windows.where(F.pmod(F.xxhash64("terms"), F.lit(parts)) == part)
        used = counts if parts == 1 else counts.join(own.select(F.explode("terms").alias("term")), "term", "left_semi")
        frequencies = {r["term"]: r["n"] for r in used.toLocalIterator()}
        yield Windows.of(sorted(own.toLocalIterator(), key=lambda r: list(r["terms"])), frequencies)


def shards_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, Shard]]:
    """The shards of index batches, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            parts = [batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("first", "terms", "ends", "positions")]
            yield batch.column("shard")[i].as_py(), batch.column("keys")[i].values, Shard(*parts)


def phrase_matches(index: DataFrame, block: Windows) -> DataFrame:
    """key, items, start and n_words of every exact occurrence of a window of the block."""
    sent = index.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        for _, keys, shard in shards_in(batches):
            for w, begin in shard.phrases(sent.value):
                document = shard.document_of(begin)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(document)), pa.array([sent.value.items[w]] * len(begin), pa.list_(pa.string())), pa.array(begin - shard.first[document], pa.int32()), pa.array(np.full(len(begin), sent.value.sizes[w]), pa.int32())],
                    names=["key", "items", "start", "n_words"],
                )

    kind = index.schema["keys"].dataType.elementType
    return index.mapInArrow(run, T.StructType([T.StructField("key", kind), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("start", T.IntegerType()), T.StructField("n_words", T.IntegerType())]))


def proximity_matches(index: DataFrame, block: Windows, slop: int = 4) -> DataFrame:
    """key and items of every document in which all terms of a window stand within its length plus `slop` words."""
    sent = index.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        for _, keys, shard in shards_in(batches):
            for w, documents in shard.near(sent.value, slop):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(documents)), pa.array([sent.value.items[w]] * len(documents), pa.list_(pa.string()))], names=["key", "items"])

    kind = index.schema["keys"].dataType.elementType
    return index.mapInArrow(run, T.StructType([T.StructField("key", kind), T.StructField("items", T.ArrayType(T.StringType()))]))


def document_hits(index: DataFrame, sent: Broadcast, positions: bool) -> DataFrame:
    """A row for each document: shard, row, key, n_words, n_hit, items (sorted) and, if asked for, the hit positions. sent: a block of windows."""

    def run(batches):
        own = sent.value
        for name, keys, shard in shards_in(batches):
            change = np.zeros(shard.first[-1] + 1, np.int64)
            found: list[set] = [set() for _ in range(len(keys))]
            for w, begin in shard.phrases(own):
                np.add.at(change, begin, 1)
                np.add.at(change, begin + own.sizes[w], -1)
                for d in np.unique(shard.document_of(begin)):
                    found[d].update(own.items[w])
            hit = np.cumsum(change)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(hit)])
            spots = np.flatnonzero(hit)
            n_hit = total[shard.first[1:]] - total[shard.first[:-1]]
            lists = [(spots[a:b] - s).tolist() for a, b, s in zip(total[shard.first[:-1]], total[shard.first[1:]], shard.first)] if positions else [None] * len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(keys)), pa.array(range(len(keys)), pa.int32()), keys, pa.array(np.diff(shard.first)), pa.array(n_hit), pa.array([sorted(f) for f in found], pa.list_(pa.string())), pa.array(lists, pa.list_(pa.int32()))],
                names=["shard", "row", "key", "n_words", "n_hit", "items", "hits"],
            )

    kind = index.schema["keys"].dataType.elementType
    fields = [("shard", T.StringType()), ("row", T.IntegerType()), ("key", kind), ("n_words", T.LongType()), ("n_hit", T.LongType()), ("items", T.ArrayType(T.StringType())), ("hits", T.ArrayType(T.IntegerType()))]
    return index.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """key, n_words, n_hit (words inside an occurring window) and items (with occurring windows, sorted as strings) of every document."""
    windows = cut(benchmark_windows(items, item_key, item_text, window), "windows")
    index = build_index(docs, key, text)
    send = docs.sparkSession.sparkContext.broadcast
    blocks = blocks_of(windows, index, most_windows)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = document_hits(index, send(first), False)
    else:
        hits, every = [], itertools.chain([first, second], blocks)
        first = second = None
        for block in every:
            sent = send(block)
            hits.append(cut(document_hits(index, sent, True).where("n_hit > 0").select("shard", "row", "hits", "items"), "hits"))
            sent.destroy()
        one = functools.reduce(DataFrame.union, hits).groupBy("shard", "row").agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        rows = index.select("shard", F.posexplode(F.arrays_zip("keys", F.slice("first", 1, F.size("keys")).alias("a"), F.slice("first", 2, F.size("keys")).alias("b"))).alias("row", "d"))
        rows = rows.select("shard", "row", F.col("d.keys").alias("key"), (F.col("d.b") - F.col("d.a")).cast("long").alias("n_words"))
        found = rows.join(one, ["shard", "row"], "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return found.select(F.col("key").alias(key), "n_words", "n_hit", "items")
