"""Language identification by hierarchical discrimination.

A text's features are the frequencies of its letter trigrams (lower case, other characters as word breaks), hashed to
DIMENSIONS places. Linear support vector machines, one for each pair of language families, vote for the family; within
it, one for each pair of its languages vote for the language. They are fitted on at most `per_language` different labelled
texts of each language, chosen by a hash of the text, so copies take no places, and at most about `in_all` of all; every
language that labels have is learned. Each machine is fitted in a task of its own, on sparse rows. Everything else works on every
row. Prediction sees the text alone, the whole of it, whatever its length.

The machines choose among the learned languages only. Whether a text is of the chosen one at all is told by the mean
logarithm of the frequencies that its trigrams have there: the score is multiplied by a value in (0, 1) that is one half
where the text lies BOUND deviations below the labelled texts of the language. So gibberish and other languages have a low
score, while lang_pred stays the most similar language. A language with a single labelled text has no such bound.

Defined cases: a null text or one without letters is "und" with score 0; a language without an entry in FAMILIES is a
family of its own; with one language learned it is always that one; with none, every text is "und"; ties of votes go to
the larger sum of margins; repeated rows get the same result; only the named columns are read, so other columns cannot
clash; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entwine.llm.common import cut, slices, with_arrays, with_fields

DIMENSIONS = 1 << 13
#: At most so many labelled texts of each language are learned from, and about so many of all (one of each language at least).
PER_LANGUAGE, IN_ALL = 300, 30_000
#: Language families of ISO 639-1 codes, fixed values.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "sinitic": "zh",
    "semitic": "ar he mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Byte -> byte with all but letters as a blank; bytes of characters beyond ASCII count as letters.
LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)
#: Deviations below the middle of a language's labelled texts at which a text is as likely none of them; frequency added to that of every trigram.
BOUND, ADDED = 12.0, 1e-6
HAS_LETTER = re.compile(r"[^\W\d_]").search


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all trigrams of the texts, one after the other, and the number of them in each text."""
    parts = [f" {t.lower()} ".encode() for t in texts]
    flat = LETTERS[np.frombuffer(b"".join(parts), np.uint8)]
    text = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    blank = flat == 32
    keep = np.ones(len(flat), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    flat, text = flat[keep].astype(np.uint32), text[keep]
    code = (flat[:-2] << 16) | (flat[1:-1] << 8) | flat[2:]
    inside = text[2:] == text[:-2]
    place = ((code * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int32)[inside]
    return place, np.bincount(text[2:][inside], minlength=len(parts))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the values of each run; runs may be empty."""
    ends = np.cumsum(counts)
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[ends] - total[ends - counts]


class Rows:
    """Texts' trigram frequencies by place."""

    def __init__(self, places: list[bytes], values: list[bytes]):
        self.places = [np.frombuffer(p, "<u2") for p in places]
        self.values = [np.frombuffer(v, "<f4").astype(np.float64) for v in values]
        self.total = np.zeros(DIMENSIONS)
        for p, v in zip(self.places, self.values):
            self.total[p] += v

    def __len__(self) -> int:
        return len(self.places)


def svm(rows: Rows, y: np.ndarray, c: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge) by dual coordinate descent, for frequencies as they are; y is -1 or 1; the last weight is the bias."""
    mean = rows.total / len(rows)
    near, whole = np.array([v @ mean[p] for p, v in zip(rows.places, rows.values)]), mean @ mean
    order, alpha = np.random.default_rng(0), np.zeros(len(rows))
    # features are 100 * (frequency - mean); weights are kept as own + shift * mean, so a step touches a text's trigrams only
    own, shift, along, bias = np.zeros(DIMENSIONS), 0.0, 0.0, 0.0
    diagonal = (np.array([v @ v for v in rows.values]) - 2 * near + whole) * 1e4 + 1 + 0.5 / c
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            p, v = rows.places[i], rows.values[i]
            margin = 100 * (v @ own[p] + shift * (near[i] - whole) - along) + bias
            new = max(0.0, alpha[i] - (y[i] * margin - 1 + alpha[i] * 0.5 / c) / diagonal[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                own[p] += 100 * step * v
                shift, along, bias, alpha[i] = shift - 100 * step, along + 100 * step * near[i], bias + step, new
    weights = 100 * (own + shift * mean)
    return np.append(weights, bias - weights @ mean)


def bound_of(rows: Rows) -> tuple[np.ndarray, float, float, float]:
    """Logarithms of a language's trigram frequencies; the middle of its texts' mean logarithms, each under the frequencies of the other texts; their variance between texts (from the median deviation, so wrong labels count little), and that of one trigram."""
    n = len(rows)
    logs = np.log(rows.total / max(n, 1) + ADDED)
    own = np.array([v @ np.log(np.maximum(rows.total[p] - v, 0) / max(n - 1, 1) + ADDED) for p, v in zip(rows.places, rows.values)])
    middle = float(np.median(own)) if n > 1 else -1e9
    share = rows.total / max(n, 1)
    return logs, middle, float((1.4826 * np.median(np.abs(own - middle))) ** 2), float(max(0.0, share @ logs**2 - (share @ logs) ** 2))


class Model:
    """The machines of both levels; `pairs` lists them as (level, first, second), `weights` has a row for each. A language's bound is in `logs`, `middle`, `between` and `within`."""

    def __init__(self, languages: list[str], pairs: list[tuple[str, str, str]], weights: np.ndarray, bounds: list[tuple]):
        self.languages, self.pairs, self.weights = languages, pairs, weights
        self.family = {lang: FAMILY_OF.get(lang, lang) for lang in languages}
        self.logs = np.array([b[0] for b in bounds], np.float32).reshape(len(languages), DIMENSIONS)
        self.middle, self.between, self.within = (np.array([b[k] for b in bounds]) for k in (1, 2, 3))

    def known(self, place: np.ndarray, counts: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """For each text a value in (0, 1): how much it is like the labelled texts of its language (an index)."""
        n = np.maximum(counts, 1)
        own = sums(self.logs[np.repeat(lang, counts), place], counts) / n
        z = (own - self.middle[lang]) / np.sqrt(self.between[lang] + self.within[lang] / n + 1e-9)
        return 1 / (1 + np.exp(-np.clip(z + BOUND, -30, 30)))

    def vote(self, margins: np.ndarray, level: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each row the index of the winning name and its least margin over the others, as a value in (0, 1)."""
        votes = np.zeros((len(margins), len(names)))
        least = np.full((len(margins), len(names)), 20.0)
        for k, (kind, a, b) in enumerate(self.pairs):
            if kind == level and a in names and b in names:
                i, j, m = names.index(a), names.index(b), margins[:, k]
                votes[:, i] += (m > 0) + np.tanh(m) * 1e-3
                votes[:, j] += (m <= 0) - np.tanh(m) * 1e-3
                least[:, i], least[:, j] = np.minimum(least[:, i], m), np.minimum(least[:, j], -m)
        best = votes.argmax(1)
        return best, 1 / (1 + np.exp(-np.clip(2 * least[np.arange(len(best)), best], -30, 30)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and HAS_LETTER(t)] if self.languages else []
        if not rows:
            return langs, scores
        place, counts = trigrams([texts[i] for i in rows])
        margins = np.stack([sums(w[:-1][place], counts) / np.maximum(counts, 1) + w[-1] for w in self.weights], 1) if self.pairs else np.zeros((len(rows), 0))
        families = sorted(set(self.family.values()))
        family, sure = self.vote(margins, "family", families)
        chosen, score = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        for f, name in enumerate(families):
            members = [lang for lang in self.languages if self.family[lang] == name]
            of = np.flatnonzero(family == f)
            best, inside = self.vote(margins[of], "language", members)
            for i, b, s in zip(of, best, inside * sure[of]):
                chosen[i], score[i] = self.languages.index(members[b]), s
        score *= self.known(place, counts, chosen)
        for i, row in enumerate(rows):
            langs[row], scores[row] = self.languages[chosen[i]], float(score[i])
        return langs, scores


def sample(labelled: DataFrame, text: str, lang: str, per_language: int, in_all: int) -> DataFrame:
    """lang, places and values: trigram frequencies of the texts with the smallest hashes of each language, written to the shared folder. Equal texts of a language count once; features are made on the executors."""
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    counts = cut(usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("different")), "languages")
    most = max(1, min(per_language, in_all // max(1, counts.count())))
    drawn = usable.withColumn("u", F.col("h").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).join(counts, "lang").where(F.col("u") <= F.lit(2.0 * most) / F.greatest("different", F.lit(1)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in slices(batches, "text"):
            langs, keys, places, values = [], [], [], []
            for name, u, t in zip(batch.column("lang").to_pylist(), batch.column("u").to_pylist(), batch.column("text").to_pylist()):
                if (name, u) not in seen and HAS_LETTER(t):
                    seen.add((name, u))
                    place, n = trigrams([t])
                    at, times = np.unique(place, return_counts=True)
                    langs.append(name), keys.append(u), places.append(at.astype("<u2").tobytes()), values.append((times / max(1, n[0])).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.float64()), pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=["lang", "u", "places", "values"])

    made = drawn.select("lang", "u", "text").mapInArrow(features, "lang string, u double, places binary, values binary").dropDuplicates(["lang", "u"])
    order = F.row_number().over(W.partitionBy("lang").orderBy("u"))
    return cut(made.withColumn("_n", order).where(F.col("_n") <= most).drop("_n"), "labelled")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> Model:
    """The model of labelled texts. Each machine, and each language's bound, is fitted in a task of its own; the driver gets weights only."""
    spark = labelled.sparkSession
    chosen = sample(labelled, text, lang, per_language, in_all)
    languages = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    family = {name: FAMILY_OF.get(name, name) for name in languages}
    pairs = [("family", a, b) for a, b in itertools.combinations(sorted(set(family.values())), 2)]
    pairs += [("language", a, b) for a, b in itertools.combinations(languages, 2) if family[a] == family[b]]
    if not languages:
        return Model([], [], np.zeros((0, DIMENSIONS + 1), np.float32), [])
    jobs = [(k, name, 1.0 if side == 0 else -1.0) for k, (level, *both) in enumerate(pairs) for side in (0, 1) for name in languages if both[side] == (family[name] if level == "family" else name)]
    jobs += [(len(pairs) + k, name, 0.0) for k, name in enumerate(languages)]

    def learn(group: pa.Table) -> pa.Table:
        group = group.sort_by([("lang", "ascending"), ("u", "ascending")])
        rows, side = Rows(group.column("places").to_pylist(), group.column("values").to_pylist()), group.column("side").to_numpy()
        made, *rest = (svm(rows, side), 0.0, 0.0, 0.0) if side[0] else bound_of(rows)
        return pa.table({"job": group.column("job")[:1], "made": pa.array([made.astype("<f4").tobytes()], pa.binary()), "rest": pa.array([rest], pa.list_(pa.float64()))})

    todo = chosen.join(F.broadcast(spark.createDataFrame(jobs, "job int, lang string, side double")), "lang")
    found = {r["job"]: r for r in todo.groupBy("job").applyInArrow(learn, "job int, made binary, rest array<double>").toLocalIterator()}
    vector = lambda job: np.frombuffer(found[job]["made"], "<f4")
    weights = np.array([vector(k) for k in range(len(pairs))], np.float32).reshape(len(pairs), DIMENSIONS + 1)
    return Model(languages, pairs, weights, [(vector(len(pairs) + k), *found[len(pairs) + k]["rest"]) for k in range(len(languages))])


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred and score; columns of these names in df are replaced."""
    def run(batches):
        for batch in slices(batches, text):
            langs, scores = model.predict(batch.column(text).to_pylist())
            yield with_arrays(batch, {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    return df.mapInArrow(run, with_fields(df, [("lang_pred", T.StringType()), ("score", T.DoubleType())]))


def is_held_out(key: str = "doc_id"):
    """True where crc32 of the key as text is divisible by five; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
