"""Jaccard join, components and decontamination against plain Python."""

import random
import re
from collections import defaultdict
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import entwine.llm.decontaminate as decontaminate
import entwine.llm.jaccard_join as jaccard_join
from entwine.llm.components import components
from entwine.llm.words import SPACE, word_hashes


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def roots_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def sets_of(rows, n):
    out = {}
    for key, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", low(text))
        out[key] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one TWO"), (5, "one two three four"), (6, "Ünï çödé wörds hére ok")]
    base = [rng.choice(vocabulary) for _ in range(120)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for i in range(60):  # near copies, some too far to link
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, " ".join(base).upper()) for i in range(5)]
    rows += [(300 + i, " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))])) for i in range(30)]
    rows += [(400 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 200)))) for i in range(40)]
    rows.append((900, " ".join(f"long{i}" for i in range(30_000))))
    return rows


@pytest.mark.parametrize("n, share, most_pairs", [(4, Fraction(85, 100), 4096), (5, Fraction(8, 10), 0)])
def test_jaccard_join_matches_brute_force(spark, monkeypatch, n, share, most_pairs):
    monkeypatch.setattr(jaccard_join, "MOST_PAIRS", most_pairs)
    monkeypatch.setattr(jaccard_join, "CHUNK", 16)
    rows = corpus()
    sets = sets_of(rows, n)
    keys = sorted(sets)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) * share.denominator >= len(sets[a] | sets[b]) * share.numerator]
    roots = roots_of(links, keys)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.classes_of(docs, n=n, share=share).collect()}
    assert found == {k: (len(sets[k]), roots[k]) for k in keys}
    assert len(set(roots.values())) < len(keys) - 40


def test_jaccard_join_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.classes_of(empty).collect() == []
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (8, None)]
    found = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard_join.classes_of(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(0, 2, 7), (7, 2, 7), (7, 2, 7), (8, 0, 8)]


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 150)] + [(5, 5), (200, None), (300, 299), (299, 300)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {n for a, b in pairs if b is not None and a != b for n in (a, b)}
    assert found == roots_of([(a, b) for a, b in pairs if b is not None], nodes)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_words_that_polynomials_confuse(spark):
    """Long words of two letters in the order of Thue and Morse, which polynomial hashes modulo 2^64 cannot tell apart."""
    letters = lambda ab, n: "".join(ab[bin(i).count("1") % 2] for i in range(n))
    for size in (64, 120, 128, 136, 1024, 4096):
        found, ends = word_hashes(pa.array([letters("ab", size) + " " + letters("ba", size), letters("AB", size), None, " "]), SPACE)
        assert found[0] != found[1] and found[0] == found[2] and ends.tolist() == [0, 2, 3, 3, 3]
    text = " w" * 10
    docs = spark.createDataFrame([(1, letters("ab", 2048) + text), (2, letters("ba", 2048) + text), (3, letters("AB", 2048) + text)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.classes_of(docs, n=20).collect()) == [(1, 1), (2, 2), (3, 1)]
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 20))) for _ in range(3000)]
    found, _ = word_hashes(pa.array([" ".join(words)]), SPACE)
    assert len(set(found.tolist())) == len(set(words)) and len(found) == len(words)


def hits_of(docs, items, window=8):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = defaultdict(set)
    for key, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)) if w else []:
            windows[tuple(w[i : i + window])].add(str(key))
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                own = windows.get(tuple(w[i : i + size]))
                if own:
                    hit.update(range(i, i + size))
                    found |= own
        out.append((key, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


ITEMS = [(1, "Alpha beta, gamma delta: epsilon zeta eta theta iota kappa"), (10, "short one"), (2, None), (3, ""), (4, "the the the the the the the the the"), (5, "beta gamma delta epsilon zeta eta theta iota")]
DOCS = [
    (1, "x ALPHA beta gamma-delta epsilon zeta eta theta y"), (2, "a short-one here, Short one"), (3, None), (4, ""), (5, "the " * 30), (6, "alpha beta gamma delta epsilon zeta eta"), (6, "theta iota"),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 2), (7, "été alpha beta"), (8, "word " * 20_000 + "short one"),
]


@pytest.mark.parametrize("most_windows, shard", [(200_000, 4 << 20), (2, 64)])
def test_contamination_matches_brute_force(spark, monkeypatch, most_windows, shard):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("items", F.lit(1))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("terms", F.lit("clash"))
    found = decontaminate.contamination(docs, items, most_windows=most_windows).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in found), key=str) == hits_of(DOCS, ITEMS)


def test_postings_of_many_shards_stay_in_small_row_groups(spark, monkeypatch, tmp_path):
    """Readers and writers hold a row group and its pages in memory, however many shards a task makes."""
    import pyarrow.parquet as pq

    monkeypatch.setattr("entwine.llm.common.shared_dir", lambda spark: f"file://{tmp_path}")
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(700_000)), lambda i: F.hex(i * 7 + F.col("doc_id"))))
    index = decontaminate.build_index(spark.range(0, 6, numPartitions=1).withColumnRenamed("id", "doc_id").withColumn("text", text))
    assert index.count() == 6
    files = [pq.ParquetFile(p).metadata for p in tmp_path.rglob("*.parquet")]
    assert max(m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)) <= 2


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, items).collect() == []
    assert decontaminate.contamination(spark.createDataFrame([(1, "a b")], none.schema), items).collect()[0]["n_hit"] == 0


def test_phrase_and_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "p q alpha x beta gamma r"), (2, "alpha beta gamma"), (3, "gamma alpha beta"), (4, "alpha z z z z z z z z z beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    windows = decontaminate.benchmark_windows(items)
    index = decontaminate.build_index(docs)
    block = next(decontaminate.blocks_of(windows, index))
    assert [(r["key"], r["start"], r["n_words"]) for r in decontaminate.phrase_matches(index, block).collect()] == [(2, 0, 3)]
    assert sorted(r["key"] for r in decontaminate.proximity_matches(index, block, 2).collect()) == [1, 2, 3]
