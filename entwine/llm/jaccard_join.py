"""N-gram Jaccard join with rare-first prefixes, length, positional and suffix filters, and the classes that its links form.

A document's set holds the hashes of its distinct n-word shingles. Documents with one set are one node, so copies cost one row
for each task that sees them. Shingles are ordered rare first: by how many documents hold them, counted for all
documents in a table of 2^CELL_BITS cells that every task gets (any order gives the same links; this one keeps
prefixes selective), then by hash. Two sets that link share a shingle of their prefixes.

A shingle's nodes are not paired with each other. First each is paired with pivots of its shingle (among sets of about its
length: the one that holds the shingle earliest, and the first and the last by hash); where very many documents hold a shingle its
nodes are dealt to salts with pivots of their own, and the pivots are paired in turn. Pairs that pass the length and
positional filters go through a suffix filter and are verified once, by the exact overlap of the sets, and their links are
joined to components. Then only nodes of a shingle that are still in different components are paired, all of them, so no
component misses a link: a pair that is left out lies in one component already. Where a shingle has many such pairs, chunks of
its nodes are checked against each other in one task, without a row for each pair.

Defined cases: A-Z count as a-z; with fewer words than n the whole sequence is the one shingle; null or empty text has an
empty set, links with nothing and is a component of its own; equal sets always link; rows of equal keys are rows
of their own; texts of any length are taken whole; ties between pivots go to the smaller or larger hash, which changes no link; a component's id is its smallest key, null keys only if there are no others; only key and text are read, so
other columns cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entwine.llm.common import cut, slices
from entwine.llm.components import components
from entwine.llm.words import SPACE, mix, word_hashes

CELL_BITS, BLOCK_BITS = 22, 16
#: Classes of a set's profile, a power of two.
PROFILE = 512
#: Where a cell counts more documents than this, its shingles' nodes are dealt to SALTS.
HOT, SALTS = 4096, 32
#: A shingle with more pairs than this between its components is checked in chunks of about so many nodes.
MOST_PAIRS, CHUNK = 4096, 512
#: Keys whose texts are fetched by sending them to every task; beyond that by a join.
MOST_SENT = 2_000_000


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    words, ends = word_hashes(column, SPACE)
    if len(words) >= n:
        whole = words[: len(words) - n + 1].copy()
        for i in range(1, n):
            whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    out = []
    for a, b in zip(ends.tolist(), ends[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for i in range(a, b):
                h = mix((h + np.uint64(0xD1B54A32D192ED03)) ^ words[i : i + 1])
            out.append(h)
        else:
            out.append(words[:0])
    return out


def name_of(values: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(mix(np.atleast_1d(mix(values ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(values))))[0].view(np.int64))


def profile(values: np.ndarray) -> bytes:
    """How many of a set's shingles fall into each of PROFILE classes by hash, 255 at most."""
    return np.minimum(np.bincount((values & np.uint64(PROFILE - 1)).astype(np.int64), minlength=PROFILE), 255).astype(np.uint8).tobytes()


def cells_of(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def measure(docs: DataFrame, n: int) -> DataFrame:
    """One row for each document (key, node, n, profile) and, from each task, its counts of cells (block, counts), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "node", "n", "profile", "block", "counts"]
        counts, kind, seen = np.zeros(1 << CELL_BITS, np.uint32), None, 0
        for batch in slices(batches, "text"):
            sets, kind = shingle_sets(batch.column("text"), n), batch.column("key").type
            some = np.concatenate([*sets, np.empty(0, np.uint64)])
            seen += len(some)
            np.add.at(counts, cells_of(some), np.uint32(1))
            rows = len(sets)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([name_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([profile(s) for s in sets], pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
        if seen:
            parts = counts.reshape(-1, 1 << BLOCK_BITS)
            n_parts = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(n_parts, kind), pa.nulls(n_parts, pa.int64()), pa.nulls(n_parts, pa.int64()), pa.nulls(n_parts, pa.binary()), pa.array(range(n_parts), pa.int32()), pa.array([zlib.compress(p.astype("<u4").tobytes(), 1) for p in parts], pa.binary())], names=names)

    schema = T.StructType([T.StructField("key", docs.schema["key"].dataType), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("profile", T.BinaryType()), T.StructField("block", T.IntegerType()), T.StructField("counts", T.BinaryType())])
    return cut(docs.mapInArrow(run, schema), "sets")


def frequency_classes(measured: DataFrame) -> np.ndarray:
    """For each cell eight times the binary logarithm of its count, one byte a cell: 2^CELL_BITS bytes whatever the input."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                own = np.frombuffer(zlib.decompress(counts), "<u4").astype(np.float64)
                total[block] = total.get(block, 0) + own
        made = [np.minimum(255, 8 * np.log2(1 + t)).astype(np.uint8).tobytes() for t in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(made, pa.binary())], names=["block", "classes"])

    blocks = 1 << (CELL_BITS - BLOCK_BITS)
    sums = measured.where("block is not null").select("block", "counts").repartition(blocks, "block").mapInArrow(run, "block int, classes binary")
    out = np.zeros(1 << CELL_BITS, np.uint8)
    for r in sums.collect():
        out[r["block"] << BLOCK_BITS : (r["block"] + 1) << BLOCK_BITS] = np.frombuffer(r["classes"], np.uint8)
    return out


def prefix_rows(docs: DataFrame, n: int, share: Fraction, classes: np.ndarray) -> DataFrame:
    """token, node, pos, n and hot: the rare-first prefix of each set, once for each set and task."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)
    up, down, hot = share.numerator, share.denominator, int(8 * np.log2(1 + HOT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of = set(), sent.value
        for batch in slices(batches, "text"):
            tokens, nodes, sizes, places = [], [], [], []
            for values in shingle_sets(batch.column("text"), n):
                size, name = len(values), name_of(values)
                if not size or name in known:
                    continue
                known.add(name)
                length = size + (-up * size) // down + 1  # size - ceil(share * size) + 1
                ranked = (of[cells_of(values)].astype(np.uint64) << np.uint64(56)) | (values >> np.uint64(8))
                tokens.append(np.sort(np.partition(ranked, length - 1)[:length] if length < size else ranked))
                nodes.append(name), sizes.append(size), places.append(length)
            if not tokens:
                continue
            flat, places = np.concatenate(tokens), np.array(places)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(places) - places, places)
            # a shingle whose cell counted one document is in no other set
            kept = np.flatnonzero((flat >> np.uint64(56)) > 8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat.view(np.int64)[kept]), pa.array(np.repeat(np.array(nodes, np.int64), places)[kept]), pa.array(pos.astype(np.int32)[kept]), pa.array(np.repeat(np.array(sizes, np.int32), places)[kept]), pa.array(((flat >> np.uint64(56)) > hot)[kept])],
                names=["token", "node", "pos", "n", "hot"],
            )

    return docs.mapInArrow(run, "token long, node long, pos int, n int, hot boolean")


def may_link(a: Column, b: Column, share: Fraction) -> Column:
    """Length and positional filter of two prefix rows (structs with n and pos) of one token."""
    up, down = share.numerator, share.denominator
    length = (F.least(a["n"], b["n"]) * down) >= (F.greatest(a["n"], b["n"]) * up)
    most = F.least(a["pos"], b["pos"]) + 1 + F.least(a["n"] - a["pos"], b["n"] - b["pos"]) - 1
    return length & (most * (up + down) >= (a["n"] + b["n"]) * up)


def pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a["node"], b["node"]).alias("a"), F.greatest(a["node"], b["node"]).alias("b")]


def overlaps(one: np.ndarray, other: np.ndarray, up: int, down: int) -> bool:
    """Whether the sorted sets link."""
    need = -(-up * (len(one) + len(other)) // (up + down))
    if min(len(one), len(other)) < need:
        return False
    at = np.minimum(np.searchsorted(other, one), len(other) - 1)
    return int((other[at] == one).sum()) >= need


def profiles_of(nodes: DataFrame, measured: DataFrame) -> DataFrame:
    """node, n and profile of the nodes."""
    wanted = cut(nodes.select(F.col("node").alias("_node")).distinct(), "profiled")
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_SENT else wanted
    return measured.where("block is null").select("node", "n", "profile").join(wanted, F.col("node") == F.col("_node"), "left_semi").dropDuplicates(["node"])


def suffix_filter(pairs: DataFrame, measured: DataFrame, share: Fraction) -> DataFrame:
    """The pairs whose sets can link by their profiles: the suffixes are split by hash, and the differences of the parts' sizes add up to no more than sets that link may differ by."""
    up, down = share.numerator, share.denominator
    own = profiles_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), measured)

    def check(batches):
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PROFILE).astype(np.int16) for c in ("pa", "pb"))
            apart = np.abs(a - b).sum(1)
            need = -(-up * (na + nb) // (up + down))
            kept = np.flatnonzero(apart <= na + nb - 2 * need)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept)) for c in ("a", "b")], names=["a", "b"])

    both = pairs.join(own.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("profile").alias("pa")), "a").join(own.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("profile").alias("pb")), "b")
    return cut(both.mapInArrow(check, "a long, b long"), "pairs")


def sets_of(wanted_nodes: DataFrame, docs: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """node and values (the set's hashes) of the nodes, written to the shared folder; keys: node and key, one document for each node. Rows of one key in several tasks give a node several equal rows."""
    nodes = cut(wanted_nodes.distinct().join(keys, "node"), "fetch")
    wanted = nodes.select(F.col("key").alias("_key"))
    if nodes.count() <= MOST_SENT:
        wanted = F.broadcast(wanted)

    def sets(batches):
        known = set()
        for batch in slices(batches, "text"):
            found = {name_of(s): s.tobytes() for s in shingle_sets(batch.column("text"), n)}
            made = [name for name in found if name not in known]
            known.update(made)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.int64()), pa.array([found[m] for m in made], pa.binary())], names=["node", "values"])

    texts = docs.join(wanted, F.col("key").eqNullSafe(F.col("_key")), "left_semi").select("text")
    return cut(texts.mapInArrow(sets, "node long, values binary"), "fetched")


def verify(pairs: DataFrame, held: DataFrame, share: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    up, down = share.numerator, share.denominator

    def check(batches):
        for batch in batches:
            a, b = batch.column("one"), batch.column("other")
            kept = [i for i in range(batch.num_rows) if overlaps(np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64), up, down)]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept, pa.int32())) for c in ("a", "b")], names=["a", "b"])

    both = pairs.join(held.select(F.col("node").alias("a"), F.col("values").alias("one")), "a").join(held.select(F.col("node").alias("b"), F.col("values").alias("other")), "b")
    return cut(both.mapInArrow(check, "a long, b long").distinct(), "links")


def dealt(few: DataFrame, many: DataFrame, held: DataFrame):
    """Both sides of the shingles dealt to pairs of chunks of about CHUNK nodes, with what is held of each node, cogrouped by the pair of chunks."""
    counts = few.groupBy("token").agg(F.ceil(F.count("*") / CHUNK).alias("few_chunks")).join(many.groupBy("token").agg(F.ceil(F.count("*") / CHUNK).alias("many_chunks")), "token")

    def deal(df, own, other):
        rows = df.join(counts, "token").select("token", "node", "root", F.pmod(F.xxhash64("node"), F.col(own)).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("other"))
        return rows.join(held.select("node", "n", "values"), "node")

    one = deal(few, "few_chunks", "many_chunks").select("token", F.col("own").alias("x"), F.col("other").alias("y"), "node", "root", "n", "values")
    other = deal(many, "many_chunks", "few_chunks").select("token", F.col("other").alias("x"), F.col("own").alias("y"), "node", "root", "n", "values")
    other = other.toDF("of", "of_x", "of_y", "other_node", "other_root", "other_n", "other_values")
    return one.groupBy("token", "x", "y").cogroup(other.groupBy("of", "of_x", "of_y"))


def block_filter(few: DataFrame, many: DataFrame, measured: DataFrame, share: Fraction) -> DataFrame:
    """token and node of the nodes that a node of the other side may link with by length and profile."""
    up, down = share.numerator, share.denominator

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        alive: set[int] = set()
        if left.num_rows and right.num_rows:
            whole = np.frombuffer(b"".join(right.column("other_values").to_pylist()), np.uint8).reshape(-1, PROFILE).astype(np.int16)
            nodes, roots, sizes = (right.column(f"other_{c}").to_numpy() for c in ("node", "root", "n"))
            for node, root, n, value in zip(*(left.column(c).to_pylist() for c in ("node", "root", "n", "values"))):
                need = -(-up * (sizes + n) // (up + down))
                other = np.flatnonzero((np.minimum(sizes, n) >= need) & (roots != root))
                apart = np.abs(whole[other] - np.frombuffer(value, np.uint8).astype(np.int16)).sum(1)
                other = other[apart <= sizes[other] + n - 2 * need[other]]
                if len(other):
                    alive.add(node)
                    alive.update(nodes[other].tolist())
        token = [left.column("token")[0].as_py() if left.num_rows else 0] * len(alive)
        return pa.table({"token": pa.array(token, pa.int64()), "node": pa.array(sorted(alive), pa.int64())})

    held = profiles_of(many, measured).withColumnRenamed("profile", "values")
    return cut(dealt(few, many, held).applyInArrow(check, "token long, node long").distinct(), "alive")


def verify_blocks(few: DataFrame, many: DataFrame, held: DataFrame, share: Fraction) -> DataFrame:
    """Links (a, b) between the nodes of two sides, for shingles with many of both: token, node and root on either side, in different roots.

    Each side of a shingle is dealt to chunks, and a task takes two: it lists the second's nodes by shingle and adds up overlaps,
    so pairs are neither written nor moved; only links are.
    """
    up, down = share.numerator, share.denominator

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in right.column("other_values")]
            sizes = np.array([len(v) for v in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            nodes, roots = right.column("other_node").to_numpy(), right.column("other_root").to_numpy()
            for node, root, value in zip(left.column("node").to_pylist(), left.column("root").to_pylist(), left.column("values")):
                values = np.frombuffer(value.as_buffer(), np.uint64)
                begin, end = np.searchsorted(flat, values, "left"), np.searchsorted(flat, values, "right")
                count = end - begin
                at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
                shared = np.bincount(owner[at], minlength=len(sets))
                linked = (shared * (up + down) >= (sizes + len(values)) * up) & (roots != root)
                a += [node] * int(linked.sum())
                b += nodes[linked].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    held = held.withColumn("n", F.lit(0))
    found = dealt(few, many, held).applyInArrow(check, "a long, b long")
    return cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")


def classes_of(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, share: Fraction = Fraction(85, 100)) -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links) of every row."""
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    measured = measure(docs, n)
    rows = measured.where("block is null").select("key", "node", "n")
    keys = cut(rows.where("n > 0").groupBy("node").agg(F.min("key").alias("key")), "nodes")
    prefixes = prefix_rows(docs, n, share, frequency_classes(measured))
    salt = F.when(F.col("hot"), 1 + F.pmod(F.col("node"), F.lit(SALTS))).otherwise(0).cast("int")
    band = F.floor(F.log(F.col("n")) / float(-np.log(float(share)))).cast("int")
    row = F.struct("pos", "n", "node")
    near, bucket = W.partitionBy("token", "salt", "band"), W.partitionBy("token", "salt")
    pivots = F.array_distinct(F.array(F.min(row).over(near), F.min_by(row, F.xxhash64("node")).over(near), F.max_by(row, F.xxhash64("node")).over(near)))
    shared = cut(
        prefixes.withColumn("salt", salt).withColumn("band", band).withColumn("pivots", pivots)
        .withColumn("first", F.min("node").over(bucket)).withColumn("last", F.max("node").over(bucket))
        .where("first <> last or salt > 0").drop("hot", "first", "last"),
        "shared",
    )
    own = F.struct("pos", "n", "node")
    starred = shared.select("token", own.alias("x"), F.explode("pivots").alias("y"))
    salted = shared.where("salt > 0").select("token", "band", F.get("pivots", F.lit(0)).alias("x")).distinct().withColumn("y", F.min("x").over(W.partitionBy("token", "band"))).select("token", "x", "y")
    first = starred.union(salted).where((F.col("x")["node"] != F.col("y")["node"]) & may_link(F.col("x"), F.col("y"), share)).select(*pair(F.col("x"), F.col("y"))).distinct()
    first = suffix_filter(cut(first, "pairs"), measured, share)
    links = verify(first, sets_of(first.select(F.explode(F.array("a", "b")).alias("node")), docs, keys, n), share)
    roots = cut(components(links), "roots")

    rooted = cut(shared.select("token", own.alias("x")).join(roots, F.col("x")["node"] == F.col("node"), "left").select("token", "x", F.coalesce("root", F.col("x")["node"]).alias("root")), "rooted")
    sizes = rooted.groupBy("token", "root").agg(F.count("*").alias("size"))
    major = sizes.groupBy("token").agg(F.max_by("root", "size").alias("major"), F.sum("size").alias("all"), F.max("size").alias("most"), F.count("*").alias("roots")).where("roots > 1")
    large = (F.col("all") - F.col("most")) * F.col("all") > MOST_PAIRS
    mixed = cut(rooted.join(major.select("token", "major", large.alias("large")), "token"), "mixed")
    rest = mixed.where("root <> major").select("token", F.col("x").alias("y"), F.col("root").alias("other"))
    second = mixed.where("not large").join(rest, "token").where((F.col("root") != F.col("other")) & ((F.col("root") == F.col("major")) | (F.col("x")["node"] < F.col("y")["node"])) & may_link(F.col("x"), F.col("y"), share))
    second = suffix_filter(cut(second.select(*pair(F.col("x"), F.col("y"))).distinct(), "pairs"), measured, share)
    many = cut(mixed.where("large").select("token", F.col("x.node").alias("node"), "root", (F.col("root") != F.col("major")).alias("few")), "many")
    alive = block_filter(many.where("few").drop("few"), many.drop("few"), measured, share)
    many = cut(many.join(alive, ["token", "node"], "left_semi"), "many")
    held = sets_of(second.select(F.explode(F.array("a", "b")).alias("node")).union(many.select("node")), docs, keys, n)
    more = verify(second, held, share).union(verify_blocks(many.where("few").drop("few"), many.drop("few"), held, share))
    if not more.isEmpty():
        roots = components(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    placed = rows.join(roots, "node", "left").select("key", "n", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("root"))
    least = placed.where("root is not null").groupBy("root").agg(F.min("key").alias("least"))
    return placed.join(least, "root", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("key")).alias("component_id"))
