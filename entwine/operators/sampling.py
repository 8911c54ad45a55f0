"""Balanced cohorts, gold templates and stratified splits.

Orders come from a hash of seed and key, so they are the same in every run and need no single task; SHA-256 is used
so that other engines can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from entwine.functions.normalize import clean, provisional_stratum
from entwine.operators.reconcile import column_or_null, first_of_identity, with_identity


def draw(seed: int, key: Column) -> Column:
    """A key's place in the random order of a seed."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), key).cast("binary"), 256)


def balanced(rows: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """The first rows of `limit` identities, dealt in turn over the countries."""
    if limit < 1:
        raise ValueError("limit must be positive")
    sources = first_of_identity(with_identity(rows)).withColumn("_country", F.coalesce(clean(column_or_null(rows, "country")), F.lit("unknown")))
    turn = F.row_number().over(W.partitionBy("_country").orderBy(draw(seed, F.col("identity")), "identity"))
    return sources.withColumn("_turn", turn).orderBy("_turn", "_country").limit(limit)


def cohort(rows: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """All rows of a balanced choice of identities."""
    own = with_identity(rows)
    return own.join(balanced(rows, limit, seed).select("identity"), "identity", "left_semi").select(*rows.columns)


def gold_template(rows: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """Unlabelled cases of a balanced choice of identities."""
    chosen = balanced(rows, size, seed)
    query = F.coalesce(clean(column_or_null(rows, "name")), clean(column_or_null(rows, "shortName")), F.lit(""))
    return chosen.select(F.col("identity").alias("source"), query.alias("query"), clean(column_or_null(rows, "country")).alias("country"), clean(column_or_null(rows, "city")).alias("city"), F.lit(None).cast("string").alias("expected_ror_id"), provisional_stratum(query).alias("stratum"), F.lit("unlabelled").alias("notes"))


def split(cases: DataFrame, dev_fraction: float = 0.5, seed: int = 42) -> DataFrame:
    """cases (case_id, stratum, expected_ror_id, position) with part: dev or test, each group of stratum and known match divided.

    A group of one goes to test; larger ones give dev between one and all but one. Groups are then topped up or
    trimmed, never emptied, to the whole's share.
    """
    if not 0 < dev_fraction < 1:
        raise ValueError("dev_fraction must be between 0 and 1")
    group = W.partitionBy("stratum", "_known")
    ranked = cases.withColumn("_known", F.col("expected_ror_id").isNotNull()).withColumn("_draw", draw(seed, F.col("case_id"))).withColumn("_n", F.count("*").over(group)).withColumn("_place", F.row_number().over(group.orderBy("_draw", "case_id")))
    quota = F.when(F.col("_n") == 1, 0).otherwise(F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.bround(F.col("_n") * dev_fraction, 0).cast("long"))))
    own = ranked.withColumn("_dev", F.col("_place") <= quota)
    more = own.agg(F.bround(F.count("*") * dev_fraction, 0).cast("long") - F.count_if("_dev")).first()[0] or 0
    movable = F.when(F.col("_dev"), F.col("_place") > 1).otherwise((F.col("_n") > 1) & (F.col("_place") < F.col("_n")))
    # groups miss their share by less than one case each, so what moves is fewer than the groups are
    moved = own.where(movable & (F.col("_dev") == F.lit(more < 0))).orderBy("_draw", "case_id").limit(abs(more)).select("case_id", F.lit(True).alias("_moved"))
    placed = own.join(moved, "case_id", "left")
    return placed.select(*(F.col(c) for c in cases.columns), F.when(F.col("_dev") != F.coalesce("_moved", F.lit(False)), "dev").otherwise("test").alias("part"))
