"""Line dedup with a log-template tree.

A line is cut into tokens; tokens with a digit are variable fields. The tree has a fixed depth: the number of tokens, then the first
LEADING tokens, lead to a leaf. A line whose tokens, with variable fields generalised, stand in at least `least`
documents of different text is a recurring template; a line of LONG or more tokens recurs from `least_long` documents on.

A leaf holds any number of templates. Lines of a leaf are alike if they agree in at least `alike` of all positions; they may
differ in m positions, so of m + 1 pieces of what follows the leading tokens they share one as it is. Lines meet
in groups that share a leaf and a piece (a leaf is one group where everything after the leading tokens may differ). In each group
the line that stands in the most texts (of equals the one with the larger hash) is a template, and the lines alike to it are its
instances; of the others again the most frequent one is a template, until none is left. Templates that share an instance
are one. A template recurs if its instances stand in enough documents. Of a recurring template the first instance in
the document with the smallest key stays; all others are dropped. Groups whose lines don't stand in enough documents, and
lines in no other group, cannot recur and go no further, and of groups of the same lines one is worked out, so few lines are
ever compared. A group of up to GROUP lines is worked out in one task; of a larger one each round takes a template by an aggregate and a join that adaptive execution can split.

Texts that are equal count as one document, so copies of a document don't make its lines recur.

Defined cases: blank lines stay and are no template; null text stays null; an empty text stays; a text whose lines all go
becomes empty; ties between lines go to the larger hash; texts and lines of any length are taken whole; repeated rows are documents with one text and each
loses what the other loses; rows with a null key keep a template only if every document with it has a null key; other columns
are handed on, but for n_lines and n_dropped, which are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entwine.llm.common import cut, slices, with_arrays, with_fields
from entwine.llm.components import components

LEADING = 3
LEAST, ALIKE = 3, 0.8
#: A line of so many tokens is a passage, which recurs from so many documents on.
LONG, LEAST_LONG = 50, 2
DIGIT, FIELD = re.compile(r"\d"), re.compile(r"\S*\d\S*")
#: Lines of a group that one task works out.
GROUP = 4096
#: Decisions or leaves that are sent to every task at once; more leaves are sent in blocks, more decisions meet the texts by a join.
MOST_SENT = 2_000_000


def signed(text: str) -> int:
    """A 64-bit hash as a signed integer."""
    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def line_keys(text: str) -> list[tuple[int, int, str] | None]:
    """For each line of a text the hash of the generalised line, its leaf (odd for a line of LONG or more tokens), and the line itself (tokens with single blanks); None for a blank line."""
    lines = text.split("\n")
    # most texts have single blanks between tokens and no other white space, which is quick to see
    plain = "  " not in text and "\n " not in text and " \n" not in text and text[:1] != " " and text[-1:] != " " and "".join(lines).isprintable()
    digits = DIGIT.search(text) is not None
    out: list = []
    for line in lines:
        if not plain:
            line = " ".join(line.split())
        if not line:
            out.append(None)
            continue
        if digits and DIGIT.search(line):
            line = FIELD.sub("<*>", line)
        n = line.count(" ")
        leaf = signed(f"{n} " + " ".join(line.split(" ", LEADING)[:LEADING]))
        out.append((signed(line), leaf | 1 if n + 1 >= LONG else leaf & -2, line))
    return out


def lines_of(docs: DataFrame) -> DataFrame:
    """line, leaf, text (hash), key: the distinct lines of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lines, leaves, texts, keys = [], [], [], []
            for key, text, hash in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("hash").to_pylist()):
                found = dict(k[:2] for k in line_keys(text or "") if k)
                lines += found
                leaves += found.values()
                texts += [hash] * len(found)
                keys += [key] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.int64()), pa.array(leaves, pa.int64()), pa.array(texts, pa.int64()), pa.array(keys, batch.column("key").type)], names=["line", "leaf", "text", "key"])

    kind = docs.schema["key"].dataType
    return docs.withColumn("hash", F.xxhash64("text")).mapInArrow(run, T.StructType([*(T.StructField(n, T.LongType()) for n in ("line", "leaf", "text")), T.StructField("key", kind)]))


def places(sorted_values: np.ndarray, wanted: list[int]) -> np.ndarray:
    """Where each wanted value stands among the sorted ones, -1 where it doesn't."""
    own = np.array(wanted, np.int64)
    if not len(sorted_values):
        return np.full(len(own), -1)
    at = np.minimum(np.searchsorted(sorted_values, own), len(sorted_values) - 1)
    return np.where(sorted_values[at] == own, at, -1)


def tokens_of(docs: DataFrame, leaves: DataFrame, most: int) -> DataFrame:
    """line, leaf, tokens (hashes): the distinct lines of a task that belong to the leaves; leaves are sent in blocks of about `most`."""
    parts, found = max(1, -(-leaves.count() // most)), None
    for part in range(parts):
        block = leaves if parts == 1 else leaves.where(F.pmod(F.xxhash64("leaf"), F.lit(parts)) == part)
        sent = docs.sparkSession.sparkContext.broadcast(np.sort(block.select("leaf").toArrow().column("leaf").to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            wanted = sent.value
            for batch in slices(batches, "text"):
                found = [k for text in batch.column("text").to_pylist() for k in line_keys(text or "") if k]
                at = places(wanted, [k[1] for k in found])
                seen: dict = {}
                for i in np.flatnonzero(at >= 0):
                    line, leaf, words = found[i]
                    if line not in seen:
                        seen[line] = (leaf, [signed(t) for t in words.split(" ")])
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.list_(pa.int64()))], names=["line", "leaf", "tokens"])

        own = docs.select("text").mapInArrow(run, "line long, leaf long, tokens array<long>")
        found = own if found is None else found.union(own)
    return found.dropDuplicates(["line"])


def pieces(alike: float) -> Column:
    """Hashes of the pieces of a line (leaf, tokens), one of which every line shares that is alike to it."""
    n = F.size("tokens")
    differ = n - F.ceil(n * F.lit(alike) - F.lit(1e-9)).cast("int")
    rest = F.greatest(n - LEADING, F.lit(0))
    edge = lambda i: F.lit(LEADING + 1) + F.floor(i * rest / (differ + 1)).cast("int")
    piece = lambda i: F.xxhash64("leaf", i, F.slice("tokens", edge(i), edge(i + 1) - edge(i)))
    return F.when(differ >= rest, F.array(F.xxhash64("leaf"))).otherwise(F.transform(F.sequence(F.lit(0), differ), piece))


def templates_in(lines: np.ndarray, texts: np.ndarray, tokens: np.ndarray, alike: float) -> Iterator[tuple[np.ndarray, int]]:
    """Instances and template for each template of one group of lines: the most frequent line is a template, then that of the others, until none is left."""
    left = np.lexsort((-lines, -texts))
    while len(left) > 1:
        best, others = left[0], left[1:]
        same = (tokens[others] == tokens[best]).sum(1) >= tokens.shape[1] * alike - 1e-9
        yield lines[others[same]], int(lines[best])
        left = others[~same]


def instances_in(batches: Iterator[pa.RecordBatch], alike: float) -> Iterator[pa.RecordBatch]:
    """line and template of the instances in groups (piece, line, texts, tokens) that follow one another."""
    kept: list = []
    for batch in itertools.chain(batches, [None]):
        kept += [] if batch is None else [batch]
        if not kept:
            return
        rows = pa.Table.from_batches(kept).combine_chunks()
        piece = rows.column("piece").to_numpy()
        ends = np.append(np.flatnonzero(piece[1:] != piece[:-1]) + 1, [len(piece)] if batch is None else [])
        if not len(ends):
            kept = rows.to_batches()
            continue
        lines, texts = rows.column("line").to_numpy(), rows.column("texts").to_numpy()
        lists = pa.concat_arrays(rows.column("tokens").chunks)
        flat, places = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        out, of, begin = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for end in ends.astype(np.int64).tolist():
            own = flat[places[begin] : places[end]].reshape(end - begin, -1)
            for found, template in templates_in(lines[begin:end], texts[begin:end], own, alike):
                out.append(found)
                of.append(np.full(len(found), template))
            begin = end
        kept = [] if batch is None else rows.slice(begin).to_batches()
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate(of))], names=["line", "template"])
        if batch is None:
            return


def groups_of(tokens: DataFrame, least: int, alike: float, least_long: int, most: int = GROUP) -> DataFrame:
    """node (a line) and root: lines of one template have one root. tokens: line, leaf, tokens, texts. Groups of up to `most` lines are worked out in one task each; of larger ones each round takes a template."""
    rows = cut(tokens.select("line", "texts", enough("leaf", least, least_long).alias("least"), F.explode(F.array_distinct(pieces(alike))).alias("piece")), "pieces")
    # Near copies share most of their pieces, so many groups hold the same lines: of those, which are told by two hashes of the lines, one is worked out.
    held = [F.bit_xor(F.xxhash64("line", F.lit(seed))).alias(f"held{seed}") for seed in (1, 2)]
    live = rows.groupBy("piece", "least").agg(F.count("*").alias("lines"), F.sum("texts").alias("all"), *held).where((F.col("lines") > 1) & (F.col("all") >= F.col("least")))
    live = live.groupBy("lines", "held1", "held2").agg(F.min("piece").alias("piece")).select("piece", "lines")
    rows = cut(rows.drop("least").join(live, "piece"), "live")
    small, links = [rows.where(F.col("lines") <= most).drop("lines").join(tokens.select("line", "tokens"), "line")], []
    rows = rows.where(F.col("lines") > most).drop("lines")
    if not rows.isEmpty():
        rows = cut(rows.join(tokens.select("line", "tokens"), "line"), "large")
    while not rows.isEmpty():
        first = rows.groupBy("piece").agg(F.max(F.struct("texts", "line", "tokens")).alias("t")).select("piece", F.col("t.line").alias("template"), F.col("t.tokens").alias("pattern"))
        same = F.size(F.filter(F.zip_with("tokens", "pattern", lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
        judged = cut(rows.join(first, "piece").withColumn("instance", same >= F.size("tokens") * alike - 1e-9).drop("pattern"), "judged")
        links.append(judged.where("instance and line <> template").select("line", "template"))
        others = judged.where("not instance").select(*rows.columns)
        sizes = cut(others.groupBy("piece").agg(F.count("*").alias("lines")), "sizes")
        small.append(others.join(sizes.where(F.col("lines").between(2, most)), "piece", "left_semi"))
        rows = others.join(sizes.where(F.col("lines") > most), "piece", "left_semi")
    for part in small:
        together = part.repartition("piece").sortWithinPartitions("piece").select("piece", "line", "texts", "tokens")
        links.append(together.mapInArrow(lambda batches: instances_in(batches, alike), "line long, template long"))
    return components(functools.reduce(DataFrame.union, links), "line", "template")


def enough(leaf: str, least: int, least_long: int) -> Column:
    """In how many texts a line of the leaf must stand."""
    return F.when(F.col(leaf).bitwiseAND(F.lit(1)) == 1, least_long).otherwise(least)


def recurring(docs: DataFrame, least: int = LEAST, alike: float = ALIKE, most_sent: int = MOST_SENT, least_long: int = LEAST_LONG) -> tuple[DataFrame, DataFrame]:
    """line, template (a line) and first (the key that keeps it): the lines of recurring templates; and line, text (hash) and key of all lines. docs: key, text."""
    rows = cut(lines_of(docs).groupBy("line", "leaf", "text").agg(F.min("key").alias("key")), "lines")
    lines = cut(rows.groupBy("line", "leaf").agg(F.count("*").alias("texts"), F.min("key").alias("first")), "line-counts")
    exact = lines.where(F.col("texts") >= enough("leaf", least, least_long)).select("line", F.col("line").alias("template"), "first")
    # leaves with several lines in enough documents; a line counts its documents, so this bound is never too low
    mixed = cut(lines.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("texts").alias("texts")).where((F.col("lines") > 1) & (F.col("texts") >= enough("leaf", least, least_long))).select("leaf"), "leaves")
    if alike > 1 or mixed.isEmpty():
        return cut(exact, "recurring"), rows
    tokens = cut(tokens_of(docs, mixed, most_sent).join(lines.select("line", "texts"), "line"), "tokens")
    instances = cut(groups_of(tokens, least, alike, least_long).select(F.col("node").alias("line"), F.col("root").alias("template")), "instances")
    groups = rows.join(instances, "line").groupBy("template", F.col("leaf").bitwiseAND(F.lit(1)).alias("long")).agg(F.count_distinct("text").alias("texts"), F.min("key").alias("first")).where(F.col("texts") >= enough("long", least, least_long))
    general = instances.join(groups.select("template", "first"), "template").select("line", "template", "first")
    return cut(general.union(exact.join(general.select("line"), "line", "left_anti")), "recurring"), rows


def less(lines: list[str], keys: list, decided: dict, own) -> list[str]:
    """The lines of a document that stay: decided has template and first for the hashes of recurring lines."""
    kept, done = [], set()
    for line, key in zip(lines, keys):
        found = decided.get(key[0]) if key else None
        if found is not None:
            template, first = found
            if first != own or template in done:
                continue
            done.add(template)
        kept.append(line)
    return kept


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, alike: float = ALIKE, most_sent: int = MOST_SENT, least_long: int = LEAST_LONG) -> DataFrame:
    """df with `text` less the lines of recurring templates, n_lines (before) and n_dropped."""
    found, rows = recurring(df.select(F.col(key).alias("key"), F.col(text).alias("text")), least, alike, most_sent, least_long)
    out = df.withColumn("n_lines", F.lit(None).cast("long")).withColumn("n_dropped", F.lit(0).cast("long"))
    schema = with_fields(out, [("n_lines", T.LongType()), ("n_dropped", T.LongType())])
    names = schema.fieldNames()
    everywhere = found.count() <= most_sent
    sent = None
    if everywhere:
        own = found.toArrow().sort_by("line")
        sent = df.sparkSession.sparkContext.broadcast((own.column("line").to_numpy(), own.column("template").to_numpy(), own.column("first").combine_chunks()))
    else:  # each text meets the decisions on its own lines
        own = rows.join(found, "line").groupBy(F.col("text").alias("_text")).agg(F.collect_list(F.struct("line", "template", "first")).alias("_lines"))
        out = out.join(own, F.xxhash64(text) == F.col("_text"), "left").drop("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, template, first = sent.value if everywhere else (None, None, None)
        for batch in slices(batches, text):
            values = batch.column(text).to_pylist()
            lines = [[] if v is None else v.split("\n") for v in values]
            keys = [[] if v is None else line_keys(v) for v in values]
            if everywhere:
                flat = [k[0] for own in keys for k in own if k]
                at = places(known, flat)
                decided = {flat[i]: (int(template[at[i]]), first[int(at[i])].as_py()) for i in np.flatnonzero(at >= 0)}
                of = [decided] * len(values)
            else:
                of = [{r["line"]: (r["template"], r["first"]) for r in own or ()} for own in batch.column("_lines").to_pylist()]
            kept = [less(*x) for x in zip(lines, keys, of, batch.column(key).to_pylist())]
            columns = {
                text: pa.array([None if v is None else "\n".join(k) for v, k in zip(values, kept)], pa.string()),
                "n_lines": pa.array([len(x) for x in lines], pa.int64()),
                "n_dropped": pa.array([len(x) - len(k) for x, k in zip(lines, kept)], pa.int64()),
            }
            yield with_arrays(batch, columns).select(names)

    return out.mapInArrow(run, schema)
