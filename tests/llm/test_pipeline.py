"""The corpus pipeline stage by stage, and the guard around it."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_texts import SPEECH
from tests.llm.test_words_and_pairs import hits_of, roots_of, sets_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    path = str(tmp_path_factory.mktemp("tables"))
    say = lambda lang, n: " ".join(rng.choice(SPEECH[lang]) + rng.choice(["", "", "a", "o"]) for _ in range(n))
    rows = []
    for i, lang in enumerate(["en", "de", "fr", "es"] * 15):
        rows.append((i, "\n".join(say(lang, 25) for _ in range(3)), lang, "s"))
    rows += [(100 + i, rows[0][1], "en", "t") for i in range(3)]  # copies
    rows += [(110, rows[1][1] + " zusatz", "de", "t"), (120, "12 34", "en", "s"), (121, None, "en", "s"), (122, "", None, None)]
    item = say("en", 12)
    rows.append((130, say("en", 40) + " " + item + " " + say("en", 30), "en", "s"))
    rows += [(140 + i, say("en", 30) + "\nplease read our terms before you use this site", "en", "s") for i in range(5)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "never said anywhere at all in these few texts of ours")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_keep_and_drop(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "byte_bpe"]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    told = corpus_pipeline.language_id(spark, docs, folder)
    after = {r["doc_id"]: r["text"] for r in told.collect()}
    assert told.columns == docs.columns and set(before) - set(after) == {120, 121, 122}
    lines = corpus_pipeline.drop_lines(spark, told, folder)
    after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.collect()}
    assert lines.columns == docs.columns and all(n == len(t) for t, n in after.values())
    assert sum("terms before you" in t for t, _ in after.values()) == 1
    single = corpus_pipeline.near_duplicates(spark, lines, folder)
    rows = [(k, t) for k, (t, _) in after.items()]
    sets = sets_of(rows, 5)
    keys = sorted(sets)
    roots = roots_of([(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) * 10 >= len(sets[a] | sets[b]) * 8], keys)
    kept = {r["doc_id"]: r["text"] for r in single.collect()}
    assert set(kept) == {k for k in keys if roots[k] == k} and not {100, 101, 102, 110} & set(kept) and {0, 1} <= set(kept)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in corpus_pipeline.decontamination(spark, single, folder).collect()}
    assert clean == {k for k, _, hit, _ in hits_of(list(kept.items()), items) if not hit} and 130 not in clean
    assert len(clean) >= 60


def test_rows_of_one_id_and_clashing_columns(spark, folder):
    """Rows are dropped, not ids; names of columns that the operators use, nulls, empty and long texts go through."""
    rng = random.Random(10)
    say = lambda n: " ".join(rng.choice(SPEECH["en"]) + rng.choice(["", "a", "o", "u"]) for _ in range(n))
    one, other, third, long = say(40), say(40), say(40), say(20_000)
    rows = [(5, one), (5, one), (5, other), (7, one), (None, one), (None, third), (None, third), (8, ""), (9, None), (9, None), (3, long), (4, long + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], DOCS + ", name string").withColumn("hash", F.lit(1)).withColumn("node", F.lit(2)).repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert sorted(kept.columns) == sorted(docs.columns)
    expected = [(5, one), (5, other), (None, third), (8, ""), (9, None), (9, None), (3, long)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(expected, key=str)
    item = [(1, " ".join(other.split()[5:15])), (2, None)]
    spark.createDataFrame(item, "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/odd/benchmark.parquet")
    clean = corpus_pipeline.decontamination(spark, kept, f"{folder}/odd")
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == sorted([x for x in expected if x[1] != other], key=str)
    stages = [corpus_pipeline.language_id, corpus_pipeline.drop_lines]
    told = stages[0](spark, spark.read.parquet(f"{folder}/documents.parquet").unionByName(kept.select("doc_id", "text", "lang", "source", "n_chars")).withColumn("leaf", F.lit(1)).withColumn("score", F.lit(2)), folder)
    lines = stages[1](spark, told, folder)
    assert told.columns == lines.columns and (5, other) in {(r["doc_id"], r["text"]) for r in lines.collect()}


OTHER = {
    "fi": "ja on ei se hän että oli joka mutta kun niin mitä tämä olla minä myös vain kuin kaikki sitten nyt jos hänen ovat voi mukaan jälkeen ennen kanssa vuonna suomen ihmiset täytyy pitäisi yhteiskunta",
    "tr": "bir ve bu için çok daha gibi kadar sonra olarak değil her şey ancak zaman büyük olduğu yeni içinde önce kendi arasında bunun üzerine şekilde çünkü herkes yılında başka türkiye insanlar söyledi",
    "pl": "nie jest się że jak ale tak przez dla jego które było tylko może został jeszcze bardzo kiedy wszystko także przed między również ponieważ człowiek życie szczęście dzień wśród każdy więc",
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой человек год один такой время сказать если только себя ещё другой когда уже для вот",
}


def test_other_languages_and_gibberish_go(spark, folder):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(OTHER[lang].split()) for _ in range(60)) for lang in OTHER for _ in range(5)]
    texts += [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(60)) for _ in range(5)]
    texts += ["これは日本語の文章であり学習した言語のどれでもありません" * 3, "qzx" * 80]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(1000 + i, t, None, "odd", len(t)) for i, t in enumerate(texts)], DOCS)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(odd), folder).collect()}
    assert {k for k in kept if k >= 1000} == set() and len(kept) == docs.count() - 3


def test_run_and_empty_table(spark, folder, tmp_path):
    out = corpus_pipeline.run(spark, folder)
    rows = out.collect()
    assert rows and all(r["n_tokens"] == len(r["ids"]) and re.fullmatch("[0-9a-f]{64}", r["decoded_sha256"]) for r in rows)
    path = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).collect() == []
