"""What queries move and work out grows with the input, and results stay those of the plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from entwine.config import MatchConfig
from entwine.functions import similarity as S
from entwine.operators import best_rows, blocking, matching
from entwine.sources.registry import active


def moved(spark) -> int:
    """Rows that stages have written for others so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = sc._jsc.sc().statusStore()
    total, at = 0, 0
    while True:
        try:
            stage = store.lastStageAttempt(at)
        except Exception:
            return total
        total, at = total + stage.shuffleWriteRecords(), at + 1


def tables(spark, norms, statuses=None):
    names = spark.createDataFrame([(i, f"o{i}", n, n, "label") for i, n in enumerate(norms)], "name_id long, ror_id string, value string, norm string, kind string")
    orgs = spark.createDataFrame([(f"o{i}", n, None, None, None, (statuses or {}).get(i), [], []) for i, n in enumerate(norms)], "ror_id string, name string, country string, country_code string, city string, status string, types array<string>, locations array<struct<country:string,country_code:string,city:string>>")
    return orgs.persist(), names.persist()


def asked(spark, norms):
    return matching.prepare(spark.createDataFrame([(f"q{i}", n, None, None) for i, n in enumerate(norms)], "query_id string, query string, country string, city string")).persist()


def plain_shortlist(scores, names, orgs, limit):
    best = scores.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("score", "name_id"))).where(F.col("n") <= blocking.WIDEN * limit)
    rows = best.join(names.select("name_id", "ror_id"), "name_id").join(active(orgs).select("ror_id"), "ror_id").groupBy("query_id", "ror_id").agg(F.min("score").alias("best"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("best", "ror_id"))).where(F.col("place") <= limit)


def some_names(count):
    draw = random.Random(5)
    words = ["".join(draw.choice("aeinst") for _ in range(draw.randint(1, 5))) for _ in range(40)]
    made = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 5))) for _ in range(count)]
    return made + made[: count // 2] + [made[0]] * 40 + ["ab"] * 3  # copies, and one name that many have


@pytest.mark.parametrize("kind,plain", [("words", blocking.word_scores), ("trigrams", blocking.trigram_scores)])
def test_shortlists_are_those_of_all_scores(spark, monkeypatch, kind, plain):
    """blocks, packs and chunks of any size, copies, ties and organisations that aren't active."""
    monkeypatch.setattr(blocking, "PACK", 7)
    monkeypatch.setattr(blocking, "FEWEST", 20)
    norms = some_names(120)
    orgs, names = tables(spark, norms, {i: "withdrawn" for i in range(0, len(norms), 3)})
    queries = asked(spark, norms[:60] + norms[:25] + ["", "zzzz", "ab cd"])
    found = sorted(map(tuple, blocking.shortlist(kind, queries, names, orgs, 4, True).select("query_id", "ror_id", "best", "place").collect()))
    assert found == sorted(map(tuple, plain_shortlist(plain(queries, names), names, orgs, 4).select("query_id", "ror_id", "best", "place").collect())) and len(found) > 200


def test_blocks_give_what_one_block_gives(monkeypatch):
    """queries' best rows are the same when names come in blocks of three."""
    import pyarrow as pa

    norms = sorted(set(some_names(100)))
    grams = [sorted({n[i : i + 3] for i in range(len(n) - 2)}) for n in norms]
    found = []
    for size in (len(norms), 3):
        chunk = best_rows.Chunk(norms, grams, [[1.5] * len(g) for g in grams], "trigrams", 10, 5, 9, 1.2, 0.75, 8.0)
        for at in range(0, len(norms), size):
            own = norms[at : at + size]
            ids = np.arange(at, at + len(own))
            chunk.block(own, np.ones(len(own), np.int64), ids, pa.array([f"o{i}" for i in ids]), np.ones(len(own), bool))
        found.append(list(chunk.lists()))
    assert found[0] == found[1] and len(found[0]) > 50


@pytest.mark.parametrize("kind", ["words", "trigrams"])
def test_pairs_of_queries_and_names_are_no_rows(spark, kind):
    """1,000 queries that share all phrases with 1,000 names make a million pairs, which used to move as rows."""
    norms = [f"common name of all numbers {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(1000)]
    orgs, names = tables(spark, norms)
    queries = asked(spark, norms)
    names.count(), queries.count()
    before = moved(spark)
    assert blocking.shortlist(kind, queries, names, orgs, 5, True).count() == 5000
    assert moved(spark) - before < 100_000


def test_registry_of_many_parts(spark, tmp_path):
    """files read in more than 64 parts; numbers of records and names keep the order and don't overflow."""
    from entwine.sources import registry

    for i in range(130):
        (tmp_path / f"{i:03}.json").write_text('[{"id":"a%d","name":"Name %d","aliases":["Other %d"]},{"id":"b%d","name":"Second %d"}]' % (i, i, i, i, i))
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    try:
        records = registry.read_records(spark, str(tmp_path))
        assert records.rdd.getNumPartitions() == 130
        rows = registry.tables(registry.parse_records(records))[1].orderBy("name_id").collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    assert len({r["name_id"] for r in rows}) == 390
    assert [r["value"].split()[0] for r in rows] == ["Name", "Other", "Second"] * 130
    assert all(len({r["value"].split()[1] for r in rows[i : i + 3]}) == 1 for i in range(0, 390, 3))


def pairs_of_strings():
    draw = random.Random(9)
    words = ["".join(draw.choice("aeinstlr") for _ in range(draw.randint(1, 7))) for _ in range(60)]
    text = lambda: " ".join(draw.choice(words) for _ in range(draw.randint(1, 8)))
    made = [(text(), text()) for _ in range(300)]
    made += [(a, a[:2] + a[3:]) for a, _ in made[:60]] + [(a, a + " " + b) for a, b in made[:60]] + [(b, a) for a, b in made[:60]]
    return made + [("", "a"), ("a", ""), ("", ""), ("a b a", "b a"), ("x" * 70 + " yy", "y" * 80), ("q w", "w" * 70), ("q" * 64, "q" * 63 + "w" * 9), ("aa bb", "cc dd"), ("é ü", "ü é x"), ("".join(map(chr, range(200, 300))) + " aaaa", "aaab")]


@pytest.mark.parametrize("size", [1 << 17, 50])
def test_batches_of_pairs_score_like_single_pairs(monkeypatch, size):
    """F2 to F11, F19, F23: the same numbers to the last bit, in passes of any size."""
    from entwine.functions import batches

    monkeypatch.setattr(batches, "MOST_WINDOWS", size)
    monkeypatch.setattr(batches, "MOST_TOKEN_PAIRS", size)
    pairs = pairs_of_strings()
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    found = batches.kinds(a, b)
    for kind, function in S.KINDS.items():
        assert found[kind].tolist() == [function(x, y) for x, y in pairs], kind
    for least, threshold in ((3, 0.84), (1, 0.5), (9, 0.84)):
        assert batches.coverages(a, b, least, threshold, 0.35).tolist() == [S.coverage(x, y, least, threshold, 0.35) for x, y in pairs]


def test_alike_queries_are_scored_once(spark, monkeypatch):
    """F2 to F11, F19, F23: 400 queries of one text meet 60 candidates each; pairs used to move for each of them."""
    monkeypatch.setattr(blocking, "MOST_ALIKE", 64)
    norms = [f"institute of letters {chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    orgs, names = tables(spark, norms)
    queries = asked(spark, ["institute of letter"] * 400 + ["letters ab"])
    found = matching.found_of(queries, names, orgs)
    assert found.groupBy("norm").count().count() == 2
    before = moved(spark)
    rows = matching.decide(matching.score(found, queries, names, orgs)).collect()
    assert moved(spark) - before < 15_000 < len(rows)
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append((r["rank"], r["ror_id"], r["score"], r["margin"]))
    assert len(by) == 401 and len({tuple(sorted(v)) for k, v in by.items() if k != "q400"}) == 1
    best = {r["ror_id"]: r["name_score"] for r in rows if r["query_id"] == "q400"}
    for ror_id, score in best.items():
        name = norms[int(ror_id[1:])]
        config = MatchConfig()
        cover = S.coverage("letters ab", name, config.min_scoring_token_len, config.token_coverage_threshold, config.compactness_exponent)
        assert score == (S.raw_score("letters ab", name) * cover if cover else 0.0)


def test_names_that_many_share_are_ranked_once(spark, monkeypatch):
    """1,500 queries and organisations of one name are over two million pairs; each query is given the first ten."""
    monkeypatch.setattr(blocking, "MOST_ALIKE", 100)
    orgs, names = tables(spark, ["one name"] * 1500 + ["another"], {3: "withdrawn"})
    queries = asked(spark, ["one name"] * 1500 + ["another", "none"])
    before = moved(spark)
    rows = blocking.exact(queries, names, orgs, 10, True).collect()
    assert moved(spark) - before < 60_000
    first = sorted(f"o{i}" for i in range(1500) if i != 3)[:10]
    assert len(rows) == 1500 * 10 + 1 and {(r["ror_id"], r["place"]) for r in rows if r["query_id"] != "q1500"} == set(zip(first, range(1, 11)))


def test_ablation_retrieves_and_scores_once(spark, monkeypatch):
    """six configurations read one table of scored pairs; each has the outcomes that it has alone."""
    from entwine.operators import evaluation, experiments

    norms = [f"academy of {w} {x}" for w in ("music", "science", "letters") for x in ("north", "south", "east")] + ["music", "academy"]
    orgs, names = tables(spark, norms)
    cases = spark.createDataFrame([(f"c{i}", n.replace("a", "e", 1) if i % 2 else n, None, None, f"o{i}" if i % 3 else None, "s") for i, n in enumerate(norms)], "case_id string, query string, country string, city string, expected_ror_id string, stratum string")
    calls = []
    plain = experiments.staged
    monkeypatch.setattr(experiments, "staged", lambda *a, **k: (calls.append(1), plain(*a, **k))[1])
    rows = experiments.ablation(cases, names, orgs).collect()
    assert len(calls) == 1 and [r["step"] for r in rows] == list(range(6))
    for r, config in list(zip(rows, experiments.ablations().values()))[::2]:
        alone = experiments.evaluate(cases, names, orgs, config).agg(*evaluation.counters([])).first()
        assert [r[c] for c in evaluation.COUNTERS] == [alone[c] for c in evaluation.COUNTERS]


def test_report_works_outcomes_out_once(spark):
    """a report counts its outcomes in one job, and none are an error."""
    from entwine.operators import intervals

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(i % 3 == 0, i % 2 == 0, i % 4 == 0, False) for i in range(40)], "known boolean, answered boolean, correct_answered boolean, correct_abstention boolean")
    found = {r["metric"]: (r["successes"], r["trials"]) for r in intervals.report(rows.mapInArrow(count, rows.schema)).collect()}
    assert found == {"selective_precision": (10, 20), "no_match_specificity": (0, 26)} and seen.value == 40
    with pytest.raises(ValueError):
        intervals.report(rows.limit(0))


def test_draws_are_those_of_md5():
    """heads of MD5 for ranges of numbers, over ends of digits, prefixes of any length, and classes that they fall in."""
    import hashlib

    from entwine.functions import draws

    for prefix in ("42|0|EN|", "42|1999|é|", "x" * 50 + "|", "y" * 53 + "|", "z" * 90 + "|"):
        for begin, end, whole in ((0, 130, 13), (95, 1105, 1105), (99_990, 100_020, 7)):
            told = [int(hashlib.md5(f"{prefix}{n}".encode()).hexdigest()[:13], 16) % whole for n in range(begin, end)]
            ends = [whole // 3, whole // 2, whole]
            found = draws.drawn([prefix, prefix[::-1]], begin, end, whole, np.array(ends))
            assert found[0].tolist() == [sum(d < ends[0] for d in told), sum(ends[0] <= d < ends[1] for d in told), sum(d >= ends[1] for d in told)]


def test_bootstrap_is_dealt_to_many_tasks(spark):
    """draws are few bytes and much work, so they need more tasks than their bytes would be given."""
    from entwine.operators import evaluation

    flags = "case_id string, stratum string, known boolean, blocking_hit boolean, top1_hit boolean, answered boolean, correct_answered boolean, correct_abstention boolean"
    rows = spark.createDataFrame([(f"c{i}", "ab"[i % 2], i % 3 > 0, i % 3 == 1, i % 6 == 1, i % 4 == 0, i % 12 == 4, i % 3 == 0 and i % 4 > 0) for i in range(400)], flags)
    store = spark.sparkContext._jsc.sc().statusStore()
    before = len(evaluation.bootstrap(rows, 300).collect())
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tasks, at = [], 0
    while True:
        try:
            tasks.append(store.lastStageAttempt(at).numTasks())
        except Exception:
            break
        at += 1
    assert before == 7 and max(tasks[-8:]) >= evaluation.LEAST_TASKS
