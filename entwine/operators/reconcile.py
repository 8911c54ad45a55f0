"""Reconciling participant rows with the registry, and joining yearly counts to accepted ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from entwine.config import MatchConfig
from entwine.functions.normalize import clean, identity
from entwine.functions.rounding import round_exact
from entwine.operators.matching import as_service, match, top

RESULT = ["match_status", "ror_id", "ror_name", "candidate_ror_id", "candidate_ror_name", "score", "name_score", "margin", "best_name", "best_name_kind", "country_match", "city_match", "exact_match", "candidate_count"]


def column_or_null(rows: DataFrame, name: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast("string")


def with_identity(rows: DataFrame) -> DataFrame:
    """rows with identity, from organisationID or else name, country and city."""
    return rows.withColumn("identity", identity(*(column_or_null(rows, c) for c in ("organisationID", "name", "shortName", "country", "city"))))


def first_of_identity(rows: DataFrame, order: str = "row_idx") -> DataFrame:
    """The first row of every identity."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("identity").orderBy(order))).where("_n = 1").drop("_n")


def identity_queries(sources: DataFrame) -> DataFrame:
    """query_id (the identity), query, country and city of each identity's first row."""
    name = F.coalesce(F.nullif(column_or_null(sources, "name"), F.lit("")), column_or_null(sources, "shortName"), F.lit(""))
    return sources.select(F.col("identity").alias("query_id"), F.coalesce(clean(name), F.lit("")).alias("query"), clean(column_or_null(sources, "country")).alias("country"), clean(column_or_null(sources, "city")).alias("city"))


def status() -> Column:
    return F.when(F.col("_match"), "matched").when(F.col("_candidate").isNotNull(), "abstained").otherwise("no_candidates")


def join_back(rows: DataFrame, decided: DataFrame, orgs: DataFrame) -> DataFrame:
    """Every row with its identity's result; an id is given only where it is accepted."""
    best = top(decided, orgs).select(F.col("query_id").alias("identity"), F.col("match").alias("_match"), F.col("ror_id").alias("_candidate"), F.col("ror_name").alias("_name"), round_exact(F.col("score"), 6).alias("score"), round_exact(F.col("name_score"), 6).alias("name_score"), round_exact(F.col("margin"), 6).alias("margin"), "best_name", F.col("best_kind").alias("best_name_kind"), "country_match", "city_match", "exact_match", "candidate_count")
    kept = [c for c in rows.columns if c not in RESULT]
    text = lambda c: F.coalesce(c, F.lit(""))
    joined = rows.select(*kept).join(best, "identity", "left")
    return joined.select(
        *kept, status().alias("match_status"), text(F.when(F.col("_match"), F.col("_candidate"))).alias("ror_id"), text(F.when(F.col("_match"), F.col("_name"))).alias("ror_name"), text(F.col("_candidate")).alias("candidate_ror_id"), text(F.col("_name")).alias("candidate_ror_name"),
        "score", "name_score", "margin", text(F.col("best_name")).alias("best_name"), text(F.col("best_name_kind")).alias("best_name_kind"), "country_match", "city_match", "exact_match", F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
    )


def evidence(sources: DataFrame, decided: DataFrame, orgs: DataFrame) -> DataFrame:
    """One row for each identity: its source row, status and candidates as the service gives them."""
    listed = as_service(decided, orgs).withColumnRenamed("query_id", "identity")
    state = decided.where("rank = 1").select(F.col("query_id").alias("identity"), F.col("match").alias("_match"), F.col("ror_id").alias("_candidate"))
    kept = sorted(c for c in sources.columns if c not in ("identity", "row_idx"))
    return sources.select("identity", F.struct(*kept).alias("source")).join(state, "identity", "left").join(listed, "identity", "left").select(F.col("identity").alias("organization_identity"), "source", status().alias("match_status"), F.col("result").alias("candidates"))


def run_counts(sources: DataFrame, decided: DataFrame) -> DataFrame:
    """unique_organizations, matched_organizations and abstained_organizations (all that aren't matched)."""
    matched = decided.where("match").select(F.col("query_id").alias("identity")).distinct().withColumn("_m", F.lit(True))
    return sources.select("identity").join(matched, "identity", "left").agg(F.count("*").alias("unique_organizations"), F.count_if(F.coalesce("_m", F.lit(False))).alias("matched_organizations"), F.count_if(~F.coalesce("_m", F.lit(False))).alias("abstained_organizations"))


def reconcile(rows: DataFrame, names: DataFrame, orgs: DataFrame, config: MatchConfig = MatchConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Result rows, evidence and counts for participant rows with row_idx. Each identity is matched once; its matches are kept for the three results."""
    own = with_identity(rows)
    sources = first_of_identity(own)
    decided = match(identity_queries(sources), names, orgs, config).persist()
    return join_back(own, decided, orgs), evidence(sources, decided, orgs), run_counts(sources, decided)


def enrich(rows: DataFrame, institutions: DataFrame, from_year: int, to_year: int) -> DataFrame:
    """rows (ror_id) with their institution's totals and its counts from from_year to to_year.

    institutions: ror_id, id, display_name, type, country_code, works_count, cited_by_count, counts_by_year. An id without an institution is
    not_found, no id not_matched; both get empty values.
    """
    if from_year > to_year:
        raise ValueError("from_year must not be after to_year")
    years = F.array_sort(F.filter("counts_by_year", lambda c: c["year"].isNotNull() & c["year"].between(from_year, to_year)), lambda a, b: (a["year"] - b["year"]).cast("int"))
    total = lambda field: F.aggregate("_years", F.lit(0).cast("long"), lambda n, c: n + F.coalesce(c[field], F.lit(0)).cast("long"))
    found = institutions.dropDuplicates(["ror_id"]).select(F.col("ror_id").alias("_ror"), F.col("id").alias("_id"), "display_name", "type", F.col("country_code").alias("_code"), "works_count", "cited_by_count", F.coalesce(years, F.array().cast(institutions.schema["counts_by_year"].dataType)).alias("_years"))
    made = found.withColumn("_works", total("works_count")).withColumn("_cited", total("cited_by_count"))
    joined = rows.join(made, F.nullif(F.col("ror_id"), F.lit("")) == F.col("_ror"), "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    state = F.when(F.coalesce("ror_id", F.lit("")) == "", "not_matched").when(F.col("_ror").isNull(), "not_found").otherwise("joined")
    ordered = F.transform("_years", lambda c: F.struct(F.coalesce(c["cited_by_count"], F.lit(0)).alias("cited_by_count"), F.coalesce(c["works_count"], F.lit(0)).alias("works_count"), c["year"].alias("year")))
    return joined.select(
        *rows.columns, state.alias("openalex_status"), text("_id").alias("openalex_id"), text("display_name").alias("openalex_name"), text("type").alias("openalex_type"), text("_code").alias("openalex_country_code"),
        text("works_count").alias("openalex_works_count_total"), text("cited_by_count").alias("openalex_cited_by_count_total"),
        F.when(F.col("_ror").isNotNull(), F.lit(str(from_year))).otherwise("").alias("openalex_from_year"), F.when(F.col("_ror").isNotNull(), F.lit(str(to_year))).otherwise("").alias("openalex_to_year"),
        text("_works").alias("openalex_works_count_period"), text("_cited").alias("openalex_cited_by_count_period"), F.coalesce(F.to_json(ordered), F.lit("[]")).alias("openalex_counts_by_year"),
    )
