"""Registry, matching, reconciling and what follows, over a small registry of its own."""

import json
import threading
import urllib.parse
import urllib.request
import zipfile

import pytest
from pyspark.sql import functions as F

from entwine import openrefine
from entwine.config import MatchConfig, ablations
from entwine.operators import analysis, blocking, evaluation, experiments, intervals, matching, reconcile, sampling
from entwine.sources import lookup, registry, tabular


def record(key, names, country, code, city, status="active"):
    return {"id": f"r:{key}", "status": status, "types": ["education"], "names": [{"value": v, "types": [k], "lang": None} for v, k in names], "locations": [{"geonames_details": {"country_code": code, "country_name": country, "name": city}}]}


UK, DE, US = ("United Kingdom", "GB"), ("Germany", "DE"), ("United States", "US")
RECORDS = [
    record("ucl", [("University College London", "ror_display"), ("UCL", "acronym"), ("London University", "alias")], *UK, "London"),
    record("lon", [("University of London", "ror_display"), ("London University", "alias")], *UK, "London"),
    record("koln", [("University of Cologne", "ror_display"), ("Universität zu Köln", "alias")], *DE, "Köln"),
    record("mpg", [("Max Planck Society", "ror_display"), ("Max-Planck-Gesellschaft zur Förderung der Wissenschaften", "alias"), ("MPG", "acronym")], *DE, "Munich"),
    record("adv-gb", [("Institute for Advanced Studies", "ror_display")], *UK, "London"),
    record("adv-us", [("Institute for Advanced Studies", "ror_display")], *US, "Princeton"),
    record("wye", [("Wye College", "ror_display"), ("The College of St Gregory and St Martin at Wye", "alias")], *UK, "Wye"),
    record("gone", [("Gone Academy", "ror_display")], *UK, "York", "withdrawn"),
    {"id": "r:old", "name": "Old Shape Institute", "aliases": ["OSI House"], "acronyms": ["OSI"], "labels": ["Altform", {"label": "Vieille Forme"}], "addresses": [{"city": "Bern", "country": {"country_name": "Switzerland", "country_code": "CH"}}]},
    {"ror_id": "r:flat", "name": "Flat Country Lab", "country": "Norway"}, {"name": "no id"}, {"id": "r:noname"},
]


def index(spark, tmp, records=RECORDS, wrap=None):
    path = f"{tmp}/registry.json"
    with open(path, "w") as f:
        json.dump({wrap: records} if wrap else records, f)
    return registry.tables(registry.parse_records(registry.read_records(spark, path)))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    orgs, names = index(spark, tmp_path_factory.mktemp("registry"))
    return orgs.persist(), names.persist()


def ask(spark, tables, query, country=None, city=None, config=MatchConfig(), limit=None):
    orgs, names = tables
    rows = spark.createDataFrame([("q", query, country, city, limit)], openrefine.QUERIES)
    return sorted(matching.match(rows, names, orgs, config).collect(), key=lambda r: r["rank"])


def test_registry_shapes(spark, tables, tmp_path):
    orgs, names = tables
    found = {r["ror_id"]: r for r in orgs.collect()}
    assert set(found) == {"r:ucl", "r:lon", "r:koln", "r:mpg", "r:adv-gb", "r:adv-us", "r:wye", "r:gone", "r:old", "r:flat"}
    assert found["r:old"]["name"] == "Old Shape Institute" and found["r:old"]["country_code"] == "CH" and found["r:flat"]["country"] == "Norway"
    listed = [(r["value"], r["kind"]) for r in names.where("ror_id = 'r:old'").orderBy("name_id").collect()]
    assert listed == [("Old Shape Institute", "name"), ("OSI House", "alias"), ("OSI", "acronym"), ("Altform", "label"), ("Vieille Forme", "label")]
    wrapped = index(spark, tmp_path, RECORDS[:2], "items")[0]
    assert wrapped.count() == 2
    with open(f"{tmp_path}/bad.json", "w") as f:
        json.dump({"nothing": 1}, f)
    with pytest.raises(ValueError):
        registry.read_records(spark, f"{tmp_path}/bad.json")
    with zipfile.ZipFile(f"{tmp_path}/r.zip", "w") as z:
        z.writestr("deep/a.json", "[]")
        z.writestr("registry.json", json.dumps(RECORDS[:3]))
    assert registry.read_records(spark, f"{tmp_path}/r.zip").count() == 3


def test_index_is_written_and_guarded(spark, tables, tmp_path):
    orgs, names = tables
    path = f"{tmp_path}/index"
    assert registry.write_index(orgs, names, path) == 10
    assert registry.read_index(spark, path)[1].count() == names.count()
    with pytest.raises(ValueError):
        registry.write_index(orgs.union(orgs), names, path)
    assert registry.read_index(spark, path)[0].count() == 10
    registry.write_index(orgs.limit(0), names.limit(0), f"{tmp_path}/none")
    with pytest.raises(ValueError):
        registry.read_index(spark, f"{tmp_path}/none")
    whole = registry.records_for(orgs, names, spark.createDataFrame([("r:ucl", 0), ("r:nobody", 1)], "ror_id string, position int")).collect()
    assert [r["ror_id"] for r in whole] == ["r:ucl"] and [n["kind"] for n in whole[0]["names"]] == ["acronym", "alias", "ror_display"]


def test_exact_acronym_and_fuzzy_alias(spark, tables):
    first = ask(spark, tables, "UCL", "GB", "London")[0]
    assert first["ror_id"] == "r:ucl" and first["match"] and first["exact_match"] and first["score"] == 1.0
    first = ask(spark, tables, "Max Planck Gesellschaft", "DE")[0]
    assert first["ror_id"] == "r:mpg" and first["match"] and first["name_score"] == pytest.approx(0.6**0.35)
    assert ask(spark, tables, "Universitat zu Koln", "DE", "Koln")[0]["match"]


def test_country_decides_between_equal_names(spark, tables):
    found = ask(spark, tables, "Institute for Advanced Studies", "US")
    assert found[0]["ror_id"] == "r:adv-us" and found[0]["match"] and not found[1]["match"] and found[1]["country_match"] is False
    found = ask(spark, tables, "Institute for Advanced Studies")
    assert found[0]["margin"] == 0 and not any(r["match"] for r in found)


def test_abstains(spark, tables):
    assert not any(r["match"] for r in ask(spark, tables, "Fictional Moon Research Institute", "US", "Houston"))
    assert not any(r["match"] for r in ask(spark, tables, "de la", "GB"))
    assert ask(spark, tables, "") == [] and ask(spark, tables, "()") == []
    assert ask(spark, tables, "Gone Academy") == [] or ask(spark, tables, "Gone Academy")[0]["ror_id"] != "r:gone"


def test_typo_needs_trigrams(spark, tables):
    first = ask(spark, tables, "Universty College Londn", "GB", "London", MatchConfig(shortlist_limit=1))[0]
    assert first["ror_id"] == "r:ucl" and first["match"]
    assert len(ask(spark, tables, "London", "GB", limit=2)) <= 2


def test_blocking_keeps_the_order_of_stages(spark, tables):
    orgs, names = tables
    queries = matching.prepare(spark.createDataFrame([("q", "London University", None, None)], "query_id string, query string, country string, city string"))
    found = blocking.candidates(queries, names, orgs).orderBy("source_order").collect()
    assert [r["ror_id"] for r in found[:2]] == ["r:lon", "r:ucl"] and all(r["by_exact"] for r in found[:2])
    assert {r["ror_id"] for r in blocking.blocking_ids(queries, names, orgs).collect()} == {r["ror_id"] for r in found}


CSV = "﻿name;organisationID;country;city;projectID;ecContribution;activityType;vatNumber;extra\n University College London ;1;UK;London;p1;\"1,000.5\";HES;secret;x\nUCL;1;UK;London;p2;5;HES;s;y\nNowhere Ltd;;FR;;p1;;PRC;s;z\nUniversity of Cologne;3;DE;Köln;p3;7;HES;s;w\n"


def test_participants_keep_every_row(spark, tables, tmp_path):
    orgs, names = tables
    path = f"{tmp_path}/organization.csv"
    with open(path, "w") as f:
        f.write(CSV)
    rows = tabular.read_participants(spark, path)
    assert "vatNumber" not in rows.columns and rows.count() == 4 and rows.first()["name"] == "University College London"
    with zipfile.ZipFile(f"{tmp_path}/p.zip", "w") as z:
        z.write(path, "data/Organization.csv")
    assert tabular.read_participants(spark, f"{tmp_path}/p.zip", 2).count() == 2
    done, evidence, counts = reconcile.reconcile(rows, names, orgs)
    found = {r["row_idx"]: r for r in done.collect()}
    assert [found[i]["match_status"] for i in sorted(found)][:2] == ["matched", "matched"] and len(found) == 4
    assert found[1]["ror_id"] == "r:ucl" and found[2]["ror_id"] == "" and found[3]["ror_id"] == "r:koln" and found[0]["extra"] == "x"
    assert counts.first().asDict() == {"unique_organizations": 3, "matched_organizations": 2, "abstained_organizations": 1}
    listed = {r["organization_identity"]: r for r in evidence.collect()}
    assert json.loads(listed["cordis:1"]["candidates"][0])["id"] == "r:ucl" and listed["cordis:1"]["source"]["name"] == "University College London"
    tabular.write_csv(done.orderBy("row_idx"), f"{tmp_path}/out.csv")
    tabular.write_jsonl(evidence, f"{tmp_path}/out.jsonl")
    assert tabular.read_csv(spark, f"{tmp_path}/out.csv").count() == 4 and len(open(f"{tmp_path}/out.jsonl").readlines()) == 3

    fetched = []

    def fetch(url):
        fetched.append(url)
        if "koln" in url:
            return 404, {}, b""
        years = [{"year": y, "works_count": w, "cited_by_count": c} for y, w, c in ((2024, 7, 30), (2023, 5, 20), (2022, 3, 10), (None, 9, 9))]
        return 200, {}, json.dumps({"id": "I1", "display_name": "UCL", "works_count": 100, "counts_by_year": years}).encode()

    client = lookup.Institutions(f"{tmp_path}/cache.json", fetch, interval=0)
    enriched = reconcile.enrich(done, client.table(spark, done), 2023, 2024)
    assert len(fetched) == 2 and lookup.Institutions(f"{tmp_path}/cache.json").lookup("r:koln") is None
    state = {r["row_idx"]: r for r in enriched.collect()}
    assert [state[i]["openalex_status"] for i in range(4)] == ["joined", "joined", "not_matched", "not_found"]
    assert state[0]["openalex_works_count_period"] == "12" and state[0]["openalex_cited_by_count_period"] == "50" and state[2]["openalex_counts_by_year"] == "[]"
    assert [c["year"] for c in json.loads(state[0]["openalex_counts_by_year"])] == [2023, 2024]
    own = analysis.organizations(enriched).collect()
    assert len(own) == 1 and own[0]["cordis_project_count"] == 2 and own[0]["cordis_ec_contribution"] == 1005.5 and own[0]["openalex_works_count_period"] == 12
    with pytest.raises(ValueError):
        reconcile.enrich(done, client.table(spark, done), 2024, 2023)


def test_lookup_retries_and_errors(tmp_path):
    waits, answers = [], [(429, {"Retry-After": "3"}, b""), (503, {}, b""), (200, {}, b'{"items": [{"organization": {"id": "r:1", "names": [{"value": "N", "types": ["ror_display"]}]}, "score": 0.5, "chosen": true}, {"score": 1}]}')]
    client = lookup.HostedSearch(f"{tmp_path}/c.json", lambda url: answers.pop(0), interval=0, sleep=waits.append)
    assert client.search("q") == [{"ror_id": "r:1", "name": "N", "score": 0.5, "chosen": True}] and waits == [3.0, 1.0]
    failing = lookup.HostedSearch(f"{tmp_path}/d.json", lambda url: (500, {}, b""), interval=0, retries=1, sleep=waits.append)
    assert failing.search("q") == [] and failing.lookup_error("q") == "status 500"


def test_analysis_does_not_fan_out(spark):
    base = dict(country="GB", activityType="HES", openalex_from_year="1", openalex_to_year="2", openalex_cited_by_count_period="50")
    rows = [
        dict(base, row_idx=0, ror_id="a", ror_name="A", projectID="p1", ecContribution="10", openalex_status="joined", openalex_works_count_period="12"), dict(base, row_idx=1, ror_id="a", ror_name="A", projectID="p2", ecContribution="20", openalex_status="joined", openalex_works_count_period="12"),
        dict(base, row_idx=2, ror_id="b", ror_name="B", projectID="p1", ecContribution="5", openalex_status="joined", openalex_works_count_period="6"), dict(base, row_idx=3, ror_id="", ror_name="", projectID="p9", ecContribution="1", openalex_status="not_matched", openalex_works_count_period=""),
    ]
    df = spark.createDataFrame(rows)
    orgs = analysis.organizations(df)
    assert [(r["ror_id"], r["cordis_project_count"], r["cordis_ec_contribution"], r["openalex_works_count_period"]) for r in orgs.collect()] == [("a", 2, 30.0, 12), ("b", 1, 5.0, 6)]
    total = analysis.summary(df, orgs).first()
    assert (total["source_rows"], total["unmatched_rows"], total["joined_organizations"], total["project_count_works_pearson"]) == (4, 1, 2, 1.0)
    assert analysis.summary(df.limit(1), analysis.organizations(df.limit(1))).first()["project_count_works_pearson"] is None


GOLD = [("c1", "University College London", "GB", "London", "r:ucl", "easy"), ("c2", "UCL", "GB", None, "r:ucl", "acronym"), ("c3", "Universitat zu Koln", "DE", None, "r:koln", "easy"), ("c4", "Max Planck Gesellschaft", "DE", None, "r:mpg", "easy"), ("c5", "Institute for Advanced Studies", "GB", None, "r:adv-gb", "hard"), ("c6", "Fictional Moon Research Institute", "US", None, None, "hard")]


def test_evaluation(spark, tables):
    orgs, names = tables
    cases = spark.createDataFrame(GOLD, "case_id string, query string, country string, city string, expected_ror_id string, stratum string")
    found = experiments.evaluate(cases, names, orgs).persist()
    total = evaluation.summarize(found).where("stratum is null").first()
    assert (total["cases"], total["known_matches"], total["correct_answers"], total["correct_abstentions"], total["selective_precision"]) == (6, 5, 5, 1, 1.0)
    assert {r["error"]: r["cases"] for r in evaluation.errors(found).collect()} == dict.fromkeys(evaluation.ERRORS, 0) | {"correct_answer": 5, "correct_abstention": 1}
    assert {(r["low"], r["high"]) for r in evaluation.bootstrap(found, 50, 17).where("metric = 'selective_precision'").collect()} == {(1.0, 1.0)}
    report = {r["metric"]: r for r in intervals.report(found).collect()}
    assert report["selective_precision"]["low"] == pytest.approx(0.025 ** (1 / 5))
    grid = experiments.sweep(cases, names, orgs, (0.8,), (0.86, 1.1)).collect()
    assert [(r["threshold"], r["answered"]) for r in grid] == [(0.86, 5), (1.1, 0)]
    assert list(ablations()) == ["normalized_exact", "lexical", "coverage", "properties", "margin_and_guard", "full_with_trigram"] and ablations()["full_with_trigram"] == MatchConfig()
    with pytest.raises(ValueError):
        evaluation.validate(cases.union(cases.withColumn("case_id", F.lit("z"))))


def test_intervals():
    assert intervals.clopper_pearson(28, 28)[0] == pytest.approx(0.025 ** (1 / 28)) and intervals.clopper_pearson(0, 30)[1] == pytest.approx(1 - 0.025 ** (1 / 30))
    assert intervals.clopper_pearson(5, 10) == pytest.approx((0.187086, 0.812914), abs=1e-6)
    low, high = intervals.clopper_pearson(3, 17)
    assert intervals.clopper_pearson(14, 17) == pytest.approx((1 - high, 1 - low))
    for bad in ((1, 0), (-1, 5), (6, 5), (1, 5, 1.0)):
        with pytest.raises(ValueError):
            intervals.clopper_pearson(*bad)
    with pytest.raises(TypeError):
        intervals.clopper_pearson(True, 5)


def test_split_and_cohort(spark):
    cases = spark.createDataFrame([(f"c{i}", ["a", "b", "c"][i % 3] if i < 30 else "single", "x" if i % 2 else None) for i in range(31)], "case_id string, stratum string, expected_ror_id string")
    parts = sampling.split(cases).collect()
    assert len(parts) == 31 and 15 <= sum(r["part"] == "dev" for r in parts) <= 16 and [r["part"] for r in parts if r["case_id"] == "c30"] == ["test"]
    rows = spark.createDataFrame([(i, str(i // 2), "n", "DE" if i < 16 else "FR") for i in range(20)], "row_idx long, organisationID string, name string, country string")
    found = sampling.cohort(rows, 4).collect()
    assert len(found) == 8 and sum(r["country"] == "FR" for r in found) == 4


def test_service(spark, tables):
    orgs, names = tables
    server = openrefine.serve(spark, names, orgs, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    read = lambda url, data=None: json.loads(urllib.request.urlopen(url, data).read())
    queries = json.dumps({"a": {"query": "UCL", "limit": 1, "properties": [{"pid": "Country", "v": [{"id": "GB"}]}]}, "b": {"query": ""}})
    try:
        assert read(base)["versions"] == ["0.2"] and read(f"{base}/health")["organizations"] == 10 and len(read(f"{base}/suggest/property?prefix=cit")["result"]) == 1
        for found in (read(f"{base}/?queries={urllib.parse.quote(queries)}"), read(base, urllib.parse.urlencode({"queries": queries}).encode())):
            assert found["b"] == {"result": []} and found["a"]["result"][0]["id"] == "r:ucl" and found["a"]["result"][0]["match"] and len(found["a"]["result"]) == 1
            assert {"id": "country_match", "value": True} in found["a"]["result"][0]["features"]
        for bad in ("[]", "{", '{"a": 1}', '{"a": {"properties": 3}}'):
            with pytest.raises(urllib.error.HTTPError) as e:
                read(f"{base}/?queries={urllib.parse.quote(bad)}")
            assert e.value.code == 400
    finally:
        server.shutdown()
        server.server_close()


def test_stream(spark, tables, tmp_path):
    from entwine.streaming.reconcile_stream import reconcile_stream

    orgs, names = tables
    spark.createDataFrame([("q1", "UCL", "GB", None, 1)], openrefine.QUERIES).write.parquet(f"{tmp_path}/in")
    found = []
    query = reconcile_stream(spark.readStream.schema(openrefine.QUERIES).parquet(f"{tmp_path}/in"), names, orgs, lambda batch, n: found.extend(batch.collect()), f"{tmp_path}/cp")
    query.processAllAvailable()
    query.stop()
    assert [(r["query_id"], r["ror_id"]) for r in found] == [("q1", "r:ucl")]


REQUESTS = {
    '{"a":{"query":"Foo","limit":3,"properties":[{"pid":" Country ","v":"DE"},{"pid":"city","v":[[{"id":"","name":"Bonn"}]]}]},"b":{"query":5,"limit":"7"}}': [("a", "Foo", "DE", "Bonn", 3), ("b", "5", None, None, 7)],
    '{"c":{"limit":99.7,"properties":[{"pid":"city","v":true},{"pid":"organisation_city","v":null},3]},"d":{"query":null,"limit":"x","properties":null}}': [("c", "", None, None, 20), ("d", "", None, None, None)],
    '{"e":{"query":"x","limit":true,"properties":{}},"f":{"query":true,"limit":-4,"properties":[{"pid":"city","v":{"value":7}},{"pid":"country","v":[]}]}}': [("e", "x", None, None, 1), ("f", "True", None, "7", 1)],
    "{}": [],
}


def test_parse_requests(spark):
    found = openrefine.parse_requests(spark.createDataFrame(list(enumerate(REQUESTS)), "request int, body string")).collect()
    for i, expected in enumerate(REQUESTS.values()):
        assert sorted((r["query_id"], r["query"], r["country"], r["city"], r["limit"]) for r in found if r["request"] == i) == expected
    assert not any(r["error"] for r in found)
    bad = {"nope": openrefine.NOT_QUERIES, "[1]": openrefine.NOT_QUERIES, None: openrefine.NOT_QUERIES, '{"a":3}': openrefine.NOT_A_QUERY, '{"a":{"query":"x","properties":"no"}}': openrefine.NOT_PROPERTIES}
    rows = openrefine.parse_requests(spark.createDataFrame(list(enumerate(bad)), "request int, body string")).collect()
    assert {r["request"]: r["error"] for r in rows} == dict(enumerate(bad.values()))


def test_hot_phrases_are_salted(spark, monkeypatch):
    """A token that all names and queries have: the same scores with one salt and with many, and no task with most of the pairs."""
    names = spark.createDataFrame([(i, f"n{i}", f"Common word{i % 50}", f"common word{i % 50}", "label") for i in range(600)], "name_id long, ror_id string, value string, norm string, kind string")
    queries = spark.createDataFrame([(f"q{i}", f"common word{i}") for i in range(60)], "query_id string, norm string")
    one = sorted(map(tuple, blocking.word_scores(queries, names).collect()))
    monkeypatch.setattr(blocking, "MOST_PAIRS", 1000)
    assert sorted(map(tuple, blocking.word_scores(queries, names).collect())) == one and len(one) == 600 * 60
