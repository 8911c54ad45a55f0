"""Aggregates of enriched rows without counting an organisation's yearly totals more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from entwine.functions.normalize import as_int, clean, first_amount


def organizations(rows: DataFrame) -> DataFrame:
    """One row for each joined organisation: first row's attributes, distinct projects, contributions once a project, totals once.

    rows: row_idx, ror_id, ror_name, country, activityType, projectID, ecContribution (and its other names), openalex_* columns.
    """
    have = set(rows.columns)
    amounts = [F.col(c) for c in ("ecContribution", "netEcContribution", "ec_contribution") if c in have]
    own = rows.where("openalex_status = 'joined'").withColumn("_key", F.coalesce(clean(F.col("projectID")), F.concat(F.lit("row:"), F.col("row_idx").cast("string")))).withColumn("_amount", first_amount(*amounts))
    first = F.row_number().over(W.partitionBy("ror_id", "_key").orderBy("row_idx")) == 1
    marked = own.withColumn("_first", first)
    taken = lambda c, name: F.min_by(F.col(c), "row_idx").alias(name)
    return marked.groupBy("ror_id").agg(
        taken("ror_name", "ror_name"), taken("country", "country"), taken("activityType", "activity_type"),
        F.count_if("_first").alias("cordis_project_count"), F.round(F.coalesce(F.sum(F.when(F.col("_first"), F.col("_amount"))), F.lit(0.0)), 2).alias("cordis_ec_contribution"),
        F.count_if(F.col("_first") & F.col("_amount").isNotNull()).alias("cordis_contribution_rows"),
        taken("openalex_from_year", "openalex_from_year"), taken("openalex_to_year", "openalex_to_year"),
        F.min_by(as_int(F.col("openalex_works_count_period")), "row_idx").alias("openalex_works_count_period"), F.min_by(as_int(F.col("openalex_cited_by_count_period")), "row_idx").alias("openalex_cited_by_count_period"),
    ).orderBy(F.desc("cordis_project_count"), "ror_id")


def groups(orgs: DataFrame) -> DataFrame:
    """Sums of organisations by country and activity."""
    return orgs.groupBy("country", "activity_type").agg(
        F.count("*").alias("organization_count"), F.sum("cordis_project_count").alias("cordis_project_participations"), F.round(F.sum("cordis_ec_contribution"), 2).alias("cordis_ec_contribution"),
        F.sum("openalex_works_count_period").alias("openalex_works_count_period"), F.sum("openalex_cited_by_count_period").alias("openalex_cited_by_count_period"),
    ).orderBy("country", "activity_type")


def pearson(x: Column, y: Column) -> Column:
    """Pearson's r to six digits as an aggregate; null for fewer than two rows or a constant side."""
    some = (F.count(x) >= 2) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(some, F.round(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), 6))


def summary(rows: DataFrame, orgs: DataFrame) -> DataFrame:
    """Counters of the run and both correlations."""
    counts = rows.agg(F.count("*").alias("source_rows"), F.count_if(F.coalesce("ror_id", F.lit("")) == "").alias("unmatched_rows"))
    made = orgs.agg(
        F.count("*").alias("joined_organizations"), pearson(F.col("cordis_project_count"), F.col("openalex_works_count_period")).alias("project_count_works_pearson"),
        pearson(F.col("cordis_ec_contribution"), F.col("openalex_works_count_period")).alias("contribution_works_pearson"),
    )
    return counts.crossJoin(made)
