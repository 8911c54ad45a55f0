"""The driver's tables in the roles of the engine's relations.

Registry: a page is an organisation, its title and its host are its names, the language in its path is its country, its top
domain its city; pages read over https are active. Queries: each page's title without its third character and with a legal form.
Participants: orders with their customers. Institutions: users of events, days of the month as years.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entwine.functions.normalize import normalize_name
from entwine.operators.matching import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_parts(pages: DataFrame) -> DataFrame:
    """page_id, title, host, lang (upper case), city and status."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    return pages.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), host.alias("host"), F.upper(F.regexp_extract("url", r"^[a-z]+://[^/?#]*/([a-z]{2})/", 1)).alias("lang"),
        F.regexp_extract(host, r"([a-z]+\.[a-z]+)$", 1).alias("city"), F.when(F.col("url").startswith("https"), "active").otherwise("withdrawn").alias("status"),
    )


def registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """organizations and names, kept: the same tables are read by many parts of a plan, and by other queries."""
    parts = page_parts(table(spark, sf_dir, "pages"))
    text = F.lit(None).cast("string")
    orgs = parts.select(F.concat(F.lit("page-"), F.col("page_id")).alias("ror_id"), F.col("title").alias("name"), text.alias("country"), F.col("lang").alias("country_code"), "city", "status", F.array().cast("array<string>").alias("types"), F.array(F.struct(text.alias("country"), F.col("lang").alias("country_code"), F.col("city").alias("city"))).alias("locations"))
    values = F.array(F.struct(F.lit(0).alias("at"), F.col("title").alias("value"), F.lit("ror_display").alias("kind")), F.struct(F.lit(1).alias("at"), F.col("host").alias("value"), F.lit("alias").alias("kind")))
    named = parts.select("page_id", F.explode(values).alias("v")).select(F.col("page_id").alias("_p"), "v.*")
    names = named.select((F.col("_p") * 2 + F.col("at")).alias("name_id"), F.concat(F.lit("page-"), F.col("_p")).alias("ror_id"), "value", normalize_name(F.col("value")).alias("norm"), "kind").where("norm <> ''")
    return orgs.persist(), names.persist()


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query, country and city."""
    parts = page_parts(table(spark, sf_dir, "pages"))
    query = F.concat(F.substring("title", 1, 2), F.substring("title", 4, 1 << 30), F.lit(" GmbH"))
    return parts.select(F.concat(F.lit("q-"), F.col("page_id")).alias("query_id"), query.alias("query"), F.col("lang").alias("country"), F.col("city").alias("city"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries with their normal forms, kept."""
    return prepare(queries(spark, sf_dir)).persist()


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold cases: a page's query should find the page if it is active."""
    parts = page_parts(table(spark, sf_dir, "pages")).select(F.concat(F.lit("q-"), F.col("page_id")).alias("query_id"), F.when(F.col("status") == "active", F.concat(F.lit("page-"), F.col("page_id"))).alias("expected_ror_id"))
    return queries(spark, sf_dir).join(parts, "query_id").select(F.col("query_id").alias("case_id"), "query", "country", "city", "expected_ror_id", F.coalesce(F.nullif("country", F.lit("")), F.lit("default")).alias("stratum"))


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each order: project, amount, organisation, country and activity."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("string").alias("ecContribution"))
    return orders.join(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("row_idx"), F.col("o_custkey").cast("string").alias("organisationID"), F.col("c_name").alias("name"), F.lit("").alias("shortName"), F.col("n_name").alias("country"), F.lit("").alias("city"),
        F.col("c_mktsegment").alias("activityType"), (F.col("o_orderkey") - F.col("o_orderkey") % 3).cast("string").alias("projectID"), "ecContribution", F.col("o_custkey").cast("string").alias("ror_id"), F.col("c_name").alias("ror_name"),
    )


def institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An institution for each user: events a day as works, the days' whole values as citations."""
    days = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("ror_id"), F.dayofmonth("ts").alias("year")).agg(F.count("*").alias("works_count"), F.sum(F.floor("value")).cast("long").alias("cited_by_count"))
    return days.groupBy("ror_id").agg(F.sum("works_count").alias("works_count"), F.sum("cited_by_count").alias("cited_by_count"), F.sort_array(F.collect_list(F.struct("year", "works_count", "cited_by_count"))).alias("counts_by_year")).select(
        "ror_id", F.concat(F.lit("I"), F.col("ror_id")).alias("id"), F.concat(F.lit("User "), F.col("ror_id")).alias("display_name"), F.lit("user").alias("type"), F.lit("").alias("country_code"), "works_count", "cited_by_count", "counts_by_year"
    )
