"""The best BM25 rows of every query, worked out block by block.

Queries and names that are the same text are one: a chunk of different queries is one task, and the different names stream past it in
packs. Some ten thousands of names at a time are turned into postings of the chunk's phrases, each query adds up its parts for the
block in one array, and only its best rows so far are kept. So every query meets every name that shares a phrase with it (the exact job,
quadratic by nature), but no pair is ever a row: what moves between machines are the names' texts, once for each chunk,
and the lists that are found. A task holds one block, its queries' best rows, and the ids of the names that passed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Different queries of one task at most, and different names that are scored at once.
MOST_QUERIES, BLOCK = 8_192, 32_768


class Vocabulary:
    """The phrases of a chunk, sorted, and where each stands in the queries."""

    def __init__(self, phrases: list[str]) -> None:
        self.phrases = phrases
        self.number = {p: i for i, p in enumerate(phrases)}


def gram_codes(texts: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (points[:-2] << 42) | (points[1:-1] << 21) | points[2:] if len(points) > 2 else np.zeros(0, np.int64)


def counted(phrase: np.ndarray, name: np.ndarray, names: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """phrase, name and hits of equal pairs, sorted by phrase."""
    keys = np.sort(phrase * names + name)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    hits = np.diff(np.append(first, len(keys)))
    return keys[first] // names, keys[first] % names, hits


def gram_hits(vocabulary: Vocabulary, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """phrase, name and hits of the character trigrams of names that are phrases."""
    lengths = np.fromiter(map(len, names), np.int64, len(names))
    codes = gram_codes(names)
    owner = np.repeat(np.arange(len(names)), lengths)[: len(codes)]
    whole = np.arange(len(codes)) + 2 < np.cumsum(lengths)[owner]  # grams don't go from one name into the next
    codes, owner = codes[whole], owner[whole]
    wanted = gram_codes(vocabulary.phrases)[::3]
    order = np.argsort(wanted)
    at = np.minimum(np.searchsorted(wanted[order], codes), len(wanted) - 1)
    some = wanted[order][at] == codes
    return counted(order[at[some]], owner[some], len(names))


def prefix_hits(vocabulary: Vocabulary, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """phrase, name and hits: how many words of a name begin with a phrase."""
    words = [[w for w in n.split(" ") if w] for n in names]
    numbers: dict[str, int] = {}
    token = np.array([numbers.setdefault(w, len(numbers)) for ws in words for w in ws], np.int64)
    owner = np.repeat(np.arange(len(names)), np.fromiter(map(len, words), np.int64, len(words)))
    number = vocabulary.number
    begun = [[p for n in range(2, len(w) + 1) if (p := number.get(w[:n])) is not None] for w in numbers]
    count = np.fromiter(map(len, begun), np.int64, len(begun))
    flat, first = np.array([p for ps in begun for p in ps], np.int64), np.cumsum(count) - count
    times = count[token] if len(token) else token
    at = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    return counted(flat[np.repeat(first[token] if len(token) else token, times) + at], np.repeat(owner, times), len(names))


HITS: dict[str, Callable] = {"words": prefix_hits, "trigrams": gram_hits}
LENGTHS: dict[str, Callable] = {"words": lambda n: sum(1 for w in n.split(" ") if w), "trigrams": lambda n: max(len(n) - 2, 0)}


class Chunk:
    """The queries of one task and their best names so far."""

    def __init__(self, texts: list[str], phrases: list[list[str]], weights: list[list[float]], kind: str, rows: int, limit: int, digits: int, k1: float, b: float, mean: float) -> None:
        self.texts, self.kind, self.rows, self.limit, self.k1, self.b, self.mean = texts, kind, rows, limit, k1, b, mean
        self.scale = 10.0**digits
        vocabulary = Vocabulary(sorted({p for ps in phrases for p in ps}))
        self.vocabulary = vocabulary
        self.phrases = [np.array([vocabulary.number[p] for p in ps], np.int64) for ps in phrases]
        self.weights = weights
        self.best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in texts]  # score, first name_id, number of the name
        self.first = np.zeros(1, np.int64)  # of each name's rows
        self.ids: list[np.ndarray] = []
        self.owners: list[pa.Array] = []
        self.active: list[np.ndarray] = []

    def block(self, names: list[str], counts: np.ndarray, ids: np.ndarray, owners: pa.Array, active: np.ndarray) -> None:
        """Score different names. counts: rows of each, in order of name_id; ids, owners, active: name_id, ror_id of the rows, and whether they count."""
        before = len(self.first) - 1
        firsts = ids[np.cumsum(counts) - counts]
        self.first = np.append(self.first, self.first[-1] + np.cumsum(counts))
        self.ids.append(ids)
        self.owners.append(owners)
        self.active.append(active)
        phrase, name, hits = HITS[self.kind](self.vocabulary, names)
        lengths = np.fromiter(map(LENGTHS[self.kind], names), np.float64, len(names))
        share = lengths / self.mean if self.mean > 0 else np.zeros(len(names))
        part = hits * (self.k1 + 1) / (hits + self.k1 * (1 - self.b + self.b * share[name]))
        ends = np.searchsorted(phrase, np.arange(len(self.vocabulary.phrases) + 1)).tolist()
        for q, own in enumerate(self.phrases):
            spans = [(ends[p], ends[p + 1], w) for p, w in zip(own.tolist(), self.weights[q]) if ends[p] < ends[p + 1]]
            if not spans:
                continue
            sums = np.bincount(np.concatenate([name[x:y] for x, y, _ in spans]), np.concatenate([part[x:y] * w for x, y, w in spans]), len(names))
            self.keep(q, sums, firsts, before)

    def keep(self, q: int, sums: np.ndarray, firsts: np.ndarray, before: int) -> None:
        old_scores, old_firsts, old_numbers = self.best[q]
        full = len(old_scores) == self.rows
        found = np.flatnonzero(sums >= old_scores[-1] - 2 / self.scale) if full else np.flatnonzero(sums)
        if len(found) > self.rows:  # ties by rounding stay in
            least = np.partition(sums[found], len(found) - self.rows)[len(found) - self.rows]
            found = found[sums[found] >= least - 2 / self.scale]
        if not len(found):
            return
        scores = np.concatenate([old_scores, np.floor(sums[found] * self.scale + 0.5) / self.scale])
        ids, numbers = np.concatenate([old_firsts, firsts[found]]), np.concatenate([old_numbers, found + before])
        order = np.lexsort((ids, -scores))[: self.rows]
        self.best[q] = scores[order], ids[order], numbers[order]

    def lists(self) -> Iterator[tuple[str, list[str], list[float]]]:
        """Each query's text with its owners by their best row, the first `limit`, and those rows' scores (the smaller, the better)."""
        if not self.ids:
            return
        ids, active = np.concatenate(self.ids), np.concatenate(self.active)
        owners = pa.chunked_array(self.owners).combine_chunks()
        for text, (scores, _, numbers) in zip(self.texts, self.best):
            if not len(scores):
                continue
            counts = self.first[numbers + 1] - self.first[numbers]
            enough = int(np.searchsorted(np.cumsum(counts), self.rows))
            if enough < len(scores):  # names that are as good as the last one that is needed share its rows' order
                some = int(np.searchsorted(-scores, -scores[enough], side="right"))
                scores, numbers, counts = scores[:some], numbers[:some], counts[:some]
            rows = np.repeat(self.first[numbers], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            marks = np.repeat(scores, counts)
            order = np.lexsort((ids[rows], -marks))[: self.rows]
            order = order[active[rows[order]]]
            best: dict[str, float] = {}
            for owner, mark in zip(owners.take(pa.array(rows[order])).to_pylist(), marks[order].tolist()):
                best.setdefault(owner, mark)
            listed = sorted((-mark, owner) for owner, mark in best.items())[: self.limit]
            if listed:
                yield text, [o for _, o in listed], [m for m, _ in listed]


def scorer(kind: str, rows: int, limit: int, digits: int, k1: float, b: float, mean: float) -> Callable:
    """Function of a task's Arrow batches: first rows of queries (text, phrases, weights), then packs of names (text and rows each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, phrases, weights, chunk = [], [], [], None
        waiting: list[pa.StructArray] = []

        def flush() -> None:
            packs = pa.concat_arrays(waiting)
            waiting.clear()
            listed = packs.field("rows")
            counts = listed.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            each = listed.flatten()
            chunk.block(packs.field("norm").to_pylist(), counts, each.field("name_id").to_numpy(zero_copy_only=False), each.field("ror_id"), each.field("active").to_numpy(zero_copy_only=False))

        for batch in batches:
            own = batch.column("pack").is_null()
            asked = batch.filter(own)
            texts += asked.column("norm").to_pylist()
            phrases += asked.column("phrases").to_pylist()
            weights += asked.column("weights").to_pylist()
            packs = batch.filter(pa.compute.invert(own)).column("pack").flatten()
            if not len(packs) or not texts:
                continue
            if chunk is None:
                chunk = Chunk(texts, phrases, weights, kind, rows, limit, digits, k1, b, mean)
            at = 0
            while at < len(packs):
                room = BLOCK - sum(map(len, waiting))
                waiting.append(packs.slice(at, room))
                at += room
                if sum(map(len, waiting)) >= BLOCK:
                    flush()
        if chunk is not None:
            if waiting:
                flush()
            made: list[tuple] = []
            for row in chunk.lists():
                made.append(row)
                if len(made) == 1_000:
                    yield as_batch(made)
                    made = []
            yield as_batch(made)

    return run


def as_batch(made: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.string())), pa.array([m[2] for m in made], pa.list_(pa.float64()))], names=["norm", "ror_ids", "bests"])


#: What scorer's function takes and gives.
TAKES = "norm string, phrases array<string>, weights array<double>, pack array<struct<norm:string,rows:array<struct<name_id:bigint,ror_id:string,active:boolean>>>>"
GIVES = "norm string, ror_ids array<string>, bests array<double>"
