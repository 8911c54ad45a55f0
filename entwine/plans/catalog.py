"""The registered queries of the reconciliation engine and their SQL equivalents.

A query's name begins with the part of the engine that it shows: e normalisation, c and d retrieval, f scoring and decision, g reconciling
and sampling, h statistics and evaluation, i the service. All run over whole tables in the roles of roles.py.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import functions as F

from entwine import openrefine
from entwine.config import MatchConfig, ablations
from entwine.functions import normalize as N
from entwine.functions import similarity as S
from entwine.functions.rounding import round_exact
from entwine.operators import analysis, blocking, evaluation, experiments, intervals, matching, reconcile, sampling
from entwine.plans import files, fuzzy_sql, roles, sql
from entwine.plans.roles import table
from entwine.sources import lookup, registry
from entwine.sources.shared import bound_batches

EXACT = ablations()["normalized_exact"]
EXACT_WITH_EVIDENCE = replace(EXACT, use_country=True, use_city=True, use_margin=True)


def e_normalize(spark, sf_dir):
    _, names = roles.registry(spark, sf_dir)
    return names.select("name_id", N.normalize_text(F.col("value")).alias("text"), "norm", F.array_join(N.search_tokens(F.col("value")), " ").alias("search"), F.array_join(N.scoring_tokens(F.col("norm")), " ").alias("scoring"), N.provisional_stratum(F.col("value")).alias("stratum"))


def e_country(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("country"))
    langs = table(spark, sf_dir, "documents").select(F.col("lang").alias("country")).distinct()
    return nation.union(langs).select("country", N.normalize_country(F.col("country")).alias("country_n"))


def e_case_identifier(spark, sf_dir):
    return roles.queries(spark, sf_dir).select("query_id", N.case_identifier(F.lit(None).cast("string"), F.col("query"), F.col("country"), F.col("city")).alias("case_id"))


def e_amounts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", N.first_amount(F.lit(""), F.concat(F.lit("€"), F.format_number("o_totalprice", 2))).alias("amount"), N.as_int(F.col("o_totalprice").cast("string")).alias("whole"))


def e_identity(spark, sf_dir):
    rows = roles.participants(spark, sf_dir)
    kept = rows.withColumn("organisationID", F.when(F.col("activityType") != "BUILDING", F.col("organisationID")).otherwise(""))
    return reconcile.with_identity(kept).select("row_idx", "identity")


def c1_exact(spark, sf_dir):
    orgs, names = roles.registry(spark, sf_dir)
    queries = names.select(F.col("name_id").alias("query_id"), "norm")
    return blocking.exact(queries, names, orgs, 500, True).select("query_id", "ror_id", F.col("place").cast("long").alias("place"))


def c2_active(spark, sf_dir):
    return registry.active(roles.registry(spark, sf_dir)[0]).select("ror_id", "name", "country_code", "city")


def c6_count(spark, sf_dir):
    return roles.registry(spark, sf_dir)[0].agg(F.count("*").alias("organizations"))


def c7_records(spark, sf_dir):
    orgs, names = roles.registry(spark, sf_dir)
    wanted = orgs.select("ror_id").withColumn("position", F.lit(0))
    return registry.records_for(orgs, names, wanted).select("ror_id", "name", F.array_join(F.transform("names", lambda n: F.concat_ws("=", n["kind"], n["value"])), "|").alias("names"))


def c9_phrases(spark, sf_dir):
    return blocking.query_phrases(roles.prepared(spark, sf_dir))


def c10_trigrams(spark, sf_dir):
    return roles.prepared(spark, sf_dir).select("query_id", F.array_join(N.trigrams(F.col("norm")), ",").alias("grams"))


def c3_bm25_words(spark, sf_dir):
    orgs, names = roles.registry(spark, sf_dir)
    found = blocking.shortlist("words", roles.prepared(spark, sf_dir), names, orgs, 50, True)
    return found.select("query_id", "ror_id", F.round("best", 6).alias("best"), F.col("place").cast("long").alias("place"))


def c4_bm25_trigrams(spark, sf_dir):
    orgs, names = roles.registry(spark, sf_dir)
    found = blocking.shortlist("trigrams", roles.prepared(spark, sf_dir), names, orgs, 50, True)
    return found.select("query_id", "ror_id", F.round("best", 6).alias("best"), F.col("place").cast("long").alias("place"))


def d1_candidates(spark, sf_dir):
    orgs, names = roles.registry(spark, sf_dir)
    found = blocking.candidates(roles.prepared(spark, sf_dir), names, orgs)
    return found.select("query_id", "ror_id", F.col("source_order").cast("long").alias("source_order"), "by_exact", "by_words", "by_trigrams")


def d2_blocking_hits(spark, sf_dir):
    orgs, names = roles.registry(spark, sf_dir)
    cases = roles.cases(spark, sf_dir).where("expected_ror_id is not null")
    found = blocking.blocking_ids(roles.prepared(spark, sf_dir), names, orgs)
    return cases.select(F.col("case_id").alias("query_id"), F.col("expected_ror_id").alias("ror_id")).join(found, ["query_id", "ror_id"], "left_semi")


def d3_prefix_hits(spark, sf_dir):
    _, names = roles.registry(spark, sf_dir)
    return blocking.prefix_hits(blocking.query_phrases(roles.prepared(spark, sf_dir)), blocking.word_postings(names))


def d4_trigram_postings(spark, sf_dir):
    return blocking.trigram_postings(roles.registry(spark, sf_dir)[1])


def own_limits(queries):
    """queries with a limit of their own for seven in eight, 0 meaning none."""
    return queries.withColumn("limit", F.nullif(F.regexp_extract("query_id", r"(\d+)$", 1).cast("int") % 8, F.lit(7)))


def found_candidates(spark, sf_dir, config=MatchConfig(), limits=False):
    """queries, names, organizations and the candidates of the queries' normal forms."""
    orgs, names = roles.registry(spark, sf_dir)
    queries = roles.prepared(spark, sf_dir)
    return own_limits(queries) if limits else queries, names, orgs, matching.found_of(queries, names, orgs, config)


def f1_ratio(spark, sf_dir):
    """Fuzzy ratios of all kinds for every different pair of a query and a name of its candidates."""
    _, names, _, found = found_candidates(spark, sf_dir)
    bound_batches(spark)
    pairs = found.select("ror_id", F.col("norm").alias("a")).join(names.select("ror_id", F.col("norm").alias("b")), "ror_id").where("a <> b").select("a", "b").distinct()
    return pairs.withColumn("s", S.similarities()("a", "b")).select("a", "b", *(round_exact(F.col(f"s.{k}"), 6).alias(k) for k in S.KINDS))


def f6_coverage(spark, sf_dir):
    queries, names, _, found = found_candidates(spark, sf_dir)
    return matching.best_names(found, queries, names, MatchConfig()).select("query_id", "ror_id", "best_name", "best_kind", round_exact(F.col("name_score"), 6).alias("name_score"), "exact_match")


def decided(spark, sf_dir, config=MatchConfig(), limits=False):
    queries, names, orgs, found = found_candidates(spark, sf_dir, config, limits)
    return matching.decide(matching.score(found, queries, names, orgs, config), config)


def f8_evidence(spark, sf_dir):
    queries, names, orgs, found = found_candidates(spark, sf_dir)
    return matching.score(found, queries, names, orgs).select("query_id", "ror_id", "country_match", "city_match", round_exact(F.col("score"), 6).alias("score"))


def f12_decision(spark, sf_dir):
    return decided(spark, sf_dir).select("query_id", "ror_id", F.col("rank").cast("long").alias("rank"), round_exact(F.col("margin"), 6).alias("margin"), "match")


def f13_exact_decision(spark, sf_dir):
    """The decision without fuzzy retrieval and without the guard: titles against the registry's own names."""
    orgs, names = roles.registry(spark, sf_dir)
    queries = matching.prepare(orgs.select(F.col("ror_id").alias("query_id"), F.col("name").alias("query"), F.col("country_code").alias("country"), F.lit("example com").alias("city"))).persist()
    own = matching.decide(matching.score(matching.found_of(queries, names, orgs, EXACT_WITH_EVIDENCE), queries, names, orgs, EXACT_WITH_EVIDENCE), EXACT_WITH_EVIDENCE)
    return own.select("query_id", "ror_id", F.col("rank").cast("long").alias("rank"), round_exact(F.col("margin"), 6).alias("margin"), "match")


def f14_limited(spark, sf_dir):
    return matching.limited(decided(spark, sf_dir, limits=True)).select("query_id", "ror_id", F.col("rank").cast("long").alias("rank"))


def f15_batch(spark, sf_dir):
    """One batch of all queries with limits of their own, by match()."""
    orgs, names = roles.registry(spark, sf_dir)
    return matching.match(own_limits(roles.prepared(spark, sf_dir)), names, orgs).groupBy("query_id").agg(F.count("*").alias("returned"), F.count_if("match").alias("matched"))


def f16_struct(spark, sf_dir):
    """Candidates as the service gives them, read back from their JSON."""
    orgs, names = roles.registry(spark, sf_dir)
    return as_rows(matching.as_service(matching.match(roles.prepared(spark, sf_dir), names, orgs), orgs), "query_id")


ITEM = "id string, name string, type array<struct<id string, name string>>, score double, match boolean, description string, features array<struct<id string, value string>>"


def as_rows(listed, key):
    """One row for each candidate of a service answer (key, result)."""
    rows = listed.select(key, F.posexplode("result").alias("place", "item")).select(key, F.col("place").cast("long").alias("place"), F.from_json("item", ITEM).alias("i"))
    value = lambda name: F.get(F.filter("i.features", lambda f: f["id"] == name), F.lit(0))["value"]
    return rows.select(key, "place", "i.id", "i.name", F.array_join(F.transform("i.type", lambda t: F.concat_ws("=", t["id"], t["name"])), ",").alias("types"), "i.score", "i.match", "i.description", *(value(n).cast("double").alias(n) for n in ("name_fuzzy", "final_score", "margin")), *(value(n).cast("boolean").alias(n) for n in ("exact_name", "country_match", "city_match")))


def pipeline_reconcile(spark, sf_dir):
    orgs, names = roles.registry(spark, sf_dir)
    found = matching.match(roles.prepared(spark, sf_dir), names, orgs)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "ror_id", "best_name", "best_kind", round_exact(F.col("name_score"), 6).alias("name_score"), round_exact(F.col("score"), 6).alias("score"), round_exact(F.col("margin"), 6).alias("margin"), "country_match", "city_match", "exact_match", "match")


def g1_repeated(spark, sf_dir):
    return evaluation.repeated_cases(roles.cases(spark, sf_dir))


def g2_identities(spark, sf_dir):
    return reconcile.first_of_identity(reconcile.with_identity(roles.participants(spark, sf_dir))).select("identity", "row_idx")


def g3_identity_queries(spark, sf_dir):
    return reconcile.identity_queries(reconcile.first_of_identity(reconcile.with_identity(roles.participants(spark, sf_dir))))


def page_rows(spark, sf_dir):
    queries = roles.queries(spark, sf_dir)
    return queries.select(F.col("query_id").alias("organisationID"), F.col("query").alias("name"), "country", "city", F.substring("query_id", 3, 20).cast("long").alias("row_idx"))


def g4_join_back(spark, sf_dir):
    orgs, names = roles.registry(spark, sf_dir)
    rows, _, _ = reconcile.reconcile(page_rows(spark, sf_dir), names, orgs)
    return rows.drop("identity")


def g5_evidence(spark, sf_dir):
    orgs, names = roles.registry(spark, sf_dir)
    _, found, _ = reconcile.reconcile(page_rows(spark, sf_dir), names, orgs)
    return found.select("organization_identity", F.to_json("source").alias("source"), "match_status", F.array_join(F.transform("candidates", lambda c: F.concat_ws("=", F.get_json_object(c, "$.id"), F.get_json_object(c, "$.match"))), ",").alias("candidates"))


def g6_run_counts(spark, sf_dir):
    orgs, names = roles.registry(spark, sf_dir)
    return reconcile.reconcile(page_rows(spark, sf_dir), names, orgs)[2]


def enriched(spark, sf_dir):
    return reconcile.enrich(roles.participants(spark, sf_dir), roles.institutions(spark, sf_dir), 5, 20)


def g7_enrich(spark, sf_dir):
    return enriched(spark, sf_dir).select("row_idx", "ror_id", "openalex_status", "openalex_works_count_total", "openalex_works_count_period", "openalex_cited_by_count_period", "openalex_counts_by_year")


def g9_cohort(spark, sf_dir):
    return sampling.cohort(roles.participants(spark, sf_dir), 100).select("row_idx", "organisationID", "country")


def g10_gold_template(spark, sf_dir):
    return sampling.gold_template(roles.participants(spark, sf_dir), 50)


def g11_split(spark, sf_dir):
    return sampling.split(roles.cases(spark, sf_dir)).select("case_id", "part")


def h1_organizations(spark, sf_dir):
    return analysis.organizations(enriched(spark, sf_dir))


def h2_groups(spark, sf_dir):
    return analysis.groups(analysis.organizations(enriched(spark, sf_dir)))


def h3_summary(spark, sf_dir):
    rows = enriched(spark, sf_dir)
    return analysis.summary(rows, analysis.organizations(rows))


def case_outcomes(spark, sf_dir):
    """Outcomes of the gold cases under the whole configuration."""
    orgs, names = roles.registry(spark, sf_dir)
    return experiments.evaluate(roles.cases(spark, sf_dir), names, orgs)


def h5_outcomes(spark, sf_dir):
    return case_outcomes(spark, sf_dir).select("case_id", "predicted_ror_id", "known", "blocking_hit", "top1_hit", "answered", "correct_answered", "correct_abstention")


def h6_metrics(spark, sf_dir):
    return evaluation.summarize(case_outcomes(spark, sf_dir))


def h8_errors(spark, sf_dir):
    return evaluation.errors(case_outcomes(spark, sf_dir))


def h8_error_cases(spark, sf_dir):
    return evaluation.error_cases(case_outcomes(spark, sf_dir))


def h9_held_out(spark, sf_dir):
    """Outcomes of the test half by system, this engine and the hosted search."""
    test = sampling.split(roles.cases(spark, sf_dir)).where("part = 'test'").select("case_id")
    flags = lambda rows, error: rows.select("case_id", "known", "answered", (F.col("correct_answered") | F.col("correct_abstention")).alias("correct"), error.alias("error")).join(test, "case_id", "left_semi").drop("case_id")
    return evaluation.held_out_counts(flags(case_outcomes(spark, sf_dir), F.lit(False)), flags(hosted(spark, sf_dir), F.col("error")))


def h10_bootstrap(spark, sf_dir):
    return evaluation.bootstrap(case_outcomes(spark, sf_dir))


def h12_ablation(spark, sf_dir):
    orgs, names = roles.registry(spark, sf_dir)
    return experiments.ablation(roles.cases(spark, sf_dir), names, orgs)


def h13_sweep(spark, sf_dir):
    orgs, names = roles.registry(spark, sf_dir)
    return experiments.sweep(roles.cases(spark, sf_dir), names, orgs)


def hosted(spark, sf_dir):
    """Outcomes of a hosted search that the exact index plays: its first two hits by id, and errors for some cases without."""
    orgs, names = roles.registry(spark, sf_dir)
    cases = roles.cases(spark, sf_dir).withColumn("query", F.col("case_id"))
    found = blocking.exact(roles.prepared(spark, sf_dir), names, orgs, 2)
    listed = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "ror_id"))).alias("r"))
    cache = cases.select("query").join(listed, F.col("query") == F.col("query_id"), "left").select("query", F.transform(F.coalesce("r", F.array().cast("array<struct<place:int,ror_id:string>>")), lambda x: F.struct(x["ror_id"].alias("ror_id"), F.lit("").alias("name"), F.lit(1.0).alias("score"), F.lit(True).alias("chosen"))).alias("results"), F.when(F.col("r").isNull() & F.col("query").endswith("7"), "status 500").alias("error"))
    return evaluation.hosted_outcomes(cases, cache)


def h14_hosted(spark, sf_dir):
    return evaluation.summarize(hosted(spark, sf_dir))


def h15_intervals(spark, sf_dir):
    """Intervals of every customer's share of urgent orders."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderpriority").startswith("1")).alias("successes"), F.count("*").alias("trials"))
    return counts.withColumn("i", intervals.interval()("successes", "trials")).select("o_custkey", "successes", "trials", F.round("i.low", 6).alias("low"), F.round("i.high", 6).alias("high"))


def h16_report(spark, sf_dir):
    return intervals.report(case_outcomes(spark, sf_dir)).select("metric", "successes", "trials", F.round("estimate", 6).alias("estimate"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def e14_flags(spark, sf_dir):
    """Booleans as text, in the spellings that files have."""
    spelled = F.when(F.col("l_linenumber") % 2 == 0, "TRUE ").otherwise(" false")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.as_bool(spelled).alias("even"))


def e15_quoted(spark, sf_dir):
    """Ids and names quoted for URLs."""
    return table(spark, sf_dir, "part").select("p_partkey", lookup.quoted(F.concat(F.lit("https://ror.org/é "), "p_name")).alias("quoted"))


def e16_rounding(spark, sf_dir):
    """Prices with a third decimal, rounded to two by their exact binary value."""
    return table(spark, sf_dir, "orders").select("o_orderkey", round_exact(F.col("o_totalprice") / 10, 2).alias("tenth"), round_exact(-F.col("o_totalprice") / 1000, 4).alias("thousandth"), round_exact(F.col("o_orderkey") / 8, 2).alias("eighth"))


def requests(spark, sf_dir):
    """Requests of 50 queries each: properties as text, in lists and in objects, with odd spellings, limits as numbers and text."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("k"))), r"(?s)^.{5}(.*).$", 1)
    rows = roles.queries(spark, sf_dir).select("query_id", *(F.coalesce(F.nullif(quoted(c), F.lit("")), F.lit('""')).alias(c) for c in ("query", "country", "city"))).withColumn("n", F.regexp_extract("query_id", r"(\d+)$", 1).cast("long"))
    shape = lambda c: F.when(F.col("n") % 4 == 0, F.col(c)).when(F.col("n") % 4 == 1, F.concat(F.lit("[["), c, F.lit("], 1]"))).when(F.col("n") % 4 == 2, F.concat(F.lit('{"id":"","name":'), c, F.lit("}"))).otherwise(F.concat(F.lit('[{"value":'), c, F.lit(',"id":null}]')))
    limit = F.when(F.col("n") % 8 == 7, F.lit('"many"')).when(F.col("n") % 2 == 0, (F.col("n") % 8).cast("string")).otherwise(F.concat(F.lit('"'), (F.col("n") % 8).cast("string"), F.lit('"')))
    item = F.concat(F.lit('"'), "query_id", F.lit('":{"query":'), "query", F.lit(',"limit":'), limit, F.lit(',"properties":[7,{"pid":"city","v":"nowhere"},{"pid":" Country ","v":'), shape("country"), F.lit('},{"pid":"organisation_CITY","v":'), shape("city"), F.lit("}]}"))
    return rows.select(F.floor(F.col("n") / 50).alias("request"), item.alias("item")).groupBy("request").agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("item")), ","), F.lit("}")).alias("body"))


def i1_manifest(spark, sf_dir):
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True, separators=(",", ":"))) for k, v in openrefine.manifest("http://local/").items()], "key string, value string")


def i2_respond(spark, sf_dir):
    """The service's answers to all requests, read back from their JSON."""
    orgs, names = roles.registry(spark, sf_dir)
    answers = openrefine.respond(requests(spark, sf_dir), names, orgs)
    listed = answers.select("request", "status", F.explode(F.from_json("response", "map<string,struct<result:array<struct<id:string,score:double,match:boolean,description:string>>>>")).alias("query_id", "r"))
    return listed.select("request", "status", "query_id", F.posexplode("r.result").alias("place", "i")).select("request", F.col("status").cast("int").alias("status"), "query_id", F.col("place").cast("long").alias("place"), "i.*")


def i3_parse(spark, sf_dir):
    return openrefine.parse_requests(requests(spark, sf_dir))


def i5_health(spark, sf_dir):
    return roles.registry(spark, sf_dir)[0].agg(F.lit(True).alias("ok"), F.count("*").alias("organizations"))


def i4_suggest(spark, sf_dir):
    return spark.createDataFrame([(p["id"], p["name"]) for p in openrefine.suggest_properties("c")["result"]], "id string, name string")


def e13_property(spark, sf_dir):
    """The text of a property in every event's JSON, given as it is, in lists and in objects."""
    props = table(spark, sf_dir, "events").select("event_id", F.coalesce("props", F.lit("null")).alias("p"), (F.col("event_id") % 4).alias("n"))
    value = F.coalesce(F.get_json_object("p", "$.k"), F.lit(""))
    text = F.regexp_extract(F.to_json(F.struct(value.alias("k"))), r"(?s)^.{5}(.*).$", 1)
    shaped = F.when(F.col("n") == 0, text).when(F.col("n") == 1, F.concat(F.lit("[["), text, F.lit("]]"))).when(F.col("n") == 2, F.concat(F.lit('{"id":0,"name":'), text, F.lit("}"))).otherwise(F.lit("[]"))
    return props.select("event_id", openrefine.property_text(F.try_parse_json(shaped)).alias("value"))


_ALL = [
    e_normalize, e_country, e_case_identifier, e_amounts, e_identity, e13_property, e14_flags, e15_quoted, e16_rounding, c1_exact, c2_active, c3_bm25_words, c4_bm25_trigrams, c6_count, c7_records, c9_phrases, c10_trigrams,
    d1_candidates, d2_blocking_hits, d3_prefix_hits, d4_trigram_postings, f1_ratio, f6_coverage, f8_evidence, f12_decision, f13_exact_decision, f14_limited, f15_batch, f16_struct, pipeline_reconcile,
    g1_repeated, g2_identities, g3_identity_queries, g4_join_back, g5_evidence, g6_run_counts, g7_enrich, g9_cohort, g10_gold_template, g11_split,
    h1_organizations, h2_groups, h3_summary, h5_outcomes, h6_metrics, h8_errors, h8_error_cases, h9_held_out, h10_bootstrap, h12_ablation, h13_sweep, h14_hosted, h15_intervals, h16_report, i1_manifest, i2_respond, i3_parse, i4_suggest, i5_health,
]


def queries() -> dict:
    """Name -> function of (spark, sf_dir)."""
    return {f.__name__: f for f in _ALL} | files.QUERIES


def oracle_sql() -> dict:
    """Name -> DuckDB SQL with the same rows."""
    return sql.ORACLES | fuzzy_sql.ORACLES | files.ORACLES
