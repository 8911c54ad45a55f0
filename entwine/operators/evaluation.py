"""Outcomes of gold cases, metrics overall and by stratum, errors, and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entwine.functions.draws import class_counts
from entwine.functions.normalize import as_bool, case_identifier, clean
from entwine.functions.rounding import round_exact

METRICS = ["blocking_recall", "top1_accuracy_known", "selective_precision", "coverage", "answerable_coverage", "end_to_end_recall", "no_match_specificity"]
COUNTERS = ["cases", "known_matches", "blocking_hits", "top1_correct_known", "answered", "answered_known", "correct_answers", "correct_abstentions"]
ERRORS = ["correct_answer", "correct_abstention", "accepted_wrong", "blocking_miss", "ranking_error", "threshold_or_margin_abstention"]


def gold_cases(rows: DataFrame) -> DataFrame:
    """Cases of raw rows: either name of a column, blank queries dropped, an identifier for each."""
    pick = lambda *names: F.coalesce(*(clean(F.col(n)) for n in names if n in rows.columns), F.lit(None).cast("string"))
    query, country, city = pick("query", "name"), pick("country"), pick("city")
    cases = rows.select(case_identifier(pick("case_id"), query, country, city).alias("case_id"), query.alias("query"), country.alias("country"), city.alias("city"), pick("expected_ror_id", "ror_id").alias("expected_ror_id"), F.coalesce(pick("stratum"), F.lit("default")).alias("stratum"), pick("source").alias("source"), pick("notes").alias("notes"))
    return cases.where("query is not null")


def repeated_cases(cases: DataFrame) -> DataFrame:
    """Keys (query, country, city in lower case) that stand more than once."""
    key = [F.lower(F.coalesce(clean(F.col(c)), F.lit(""))).alias(c) for c in ("query", "country", "city")]
    return cases.select(*key).groupBy("query", "country", "city").count().where("count > 1")


def validate(cases: DataFrame) -> DataFrame:
    """The cases; ValueError if one is repeated."""
    found = repeated_cases(cases).limit(1).collect()
    if found:
        raise ValueError(f"repeated case: {found[0]['query']}")
    return cases


def outcomes(cases: DataFrame, best: DataFrame, blocked: DataFrame) -> DataFrame:
    """One row for each case. best: query_id, ror_id, ror_name, match, score, name_score, margin of first candidates; blocked: query_id, ror_id of all candidates."""
    hit = cases.select("case_id", "expected_ror_id").join(blocked.select(F.col("query_id").alias("case_id"), F.col("ror_id").alias("expected_ror_id")).distinct(), ["case_id", "expected_ror_id"]).select("case_id", F.lit(True).alias("_hit"))
    joined = cases.join(best.select(F.col("query_id").alias("case_id"), F.col("ror_id").alias("_top"), F.col("ror_name").alias("_name"), F.col("match").alias("_match"), "score", "name_score", "margin"), "case_id", "left").join(hit, "case_id", "left")
    known, answered = F.col("expected_ror_id").isNotNull(), F.coalesce("_match", F.lit(False))
    right = F.coalesce(F.col("_top") == F.col("expected_ror_id"), F.lit(False))
    return joined.select(
        "case_id", "query", "country", "city", "stratum", "expected_ror_id", F.col("_top").alias("predicted_ror_id"), F.col("_name").alias("predicted_name"), known.alias("known"), (known & F.coalesce("_hit", F.lit(False))).alias("blocking_hit"),
        (known & right).alias("top1_hit"), answered.alias("answered"), (answered & right).alias("correct_answered"), (~known & ~answered).alias("correct_abstention"), "score", "name_score", "margin",
    )


def counters(by: list[str], times: Column | None = None) -> list[Column]:
    """The eight counters of outcomes; times: how often each row counts."""
    number = F.count_if if times is None else lambda c: F.coalesce(F.sum(F.when(c if isinstance(c, Column) else F.col(c), times)), F.lit(0).cast("long"))
    return [
        number(F.lit(True)).alias("cases"), number("known").alias("known_matches"), number("blocking_hit").alias("blocking_hits"), number("top1_hit").alias("top1_correct_known"), number("answered").alias("answered"),
        number(F.col("answered") & F.col("known")).alias("answered_known"), number("correct_answered").alias("correct_answers"), number("correct_abstention").alias("correct_abstentions"),
    ]


def ratios() -> list[Column]:
    """The seven metrics of a row of counters, 0.0 where there is nothing to divide by."""
    share = lambda a, b, name: round_exact(F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0)), 4).alias(name)
    known, cases = F.col("known_matches"), F.col("cases")
    return [
        share("blocking_hits", known, "blocking_recall"), share("top1_correct_known", known, "top1_accuracy_known"), share("correct_answers", F.col("answered"), "selective_precision"), share("answered", cases, "coverage"),
        share("answered_known", known, "answerable_coverage"), share("correct_answers", known, "end_to_end_recall"), share("correct_abstentions", cases - known, "no_match_specificity"),
    ]


def summarize(rows: DataFrame) -> DataFrame:
    """Counters and metrics of all outcomes (stratum null) and of each stratum."""
    sets = rows.groupingSets([[], ["stratum"]], "stratum").agg(*counters([]))
    return sets.select("stratum", *COUNTERS, *ratios())


def error_of() -> Column:
    """The first of the error classes that fits an outcome."""
    return (
        F.when(F.col("correct_answered"), "correct_answer").when(F.col("correct_abstention"), "correct_abstention").when(F.col("answered"), "accepted_wrong")
        .when(~F.col("blocking_hit"), "blocking_miss").when(~F.col("top1_hit"), "ranking_error").otherwise("threshold_or_margin_abstention")
    )


def errors(rows: DataFrame) -> DataFrame:
    """error and cases for every class, those without cases too."""
    found = rows.select(error_of().alias("error")).groupBy("error").agg(F.count("*").alias("cases"))
    classes = rows.sparkSession.createDataFrame([(e,) for e in ERRORS], "error string")
    return classes.join(found, "error", "left").select("error", F.coalesce("cases", F.lit(0).cast("long")).alias("cases"))


def error_cases(rows: DataFrame) -> DataFrame:
    """error and case_id of every case."""
    return rows.select(error_of().alias("error"), "case_id")


FLAGS = ["known", "blocking_hit", "top1_hit", "answered", "correct_answered", "correct_abstention"]
#: Draws that one row makes.
DRAWS = 1 << 16
LEAST_TASKS = 48


def bootstrap(rows: DataFrame, iterations: int = 2000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """metric, low and high: percentile intervals of the metrics over draws with replacement within each stratum.

    Cases with the same flags are alike, so a stratum is at most 64 classes in a fixed order, and a draw is a hash of seed, iteration,
    stratum and number, taken modulo the stratum's size: the class in which it falls is counted where it is drawn, thousands of draws at a
    time. Neither cases nor draws move between machines, only sums for each iteration.
    """
    if iterations < 1 or not 0 < confidence < 1:
        raise ValueError("iterations must be positive and confidence between 0 and 1")
    classes = rows.groupBy("stratum", *FLAGS).agg(F.count("*").alias("n"))
    order = F.sort_array(F.collect_list(F.struct(*FLAGS, "n")))
    ends = F.transform("classes", lambda c, i: F.struct(*(c[f].alias(f) for f in FLAGS), F.aggregate(F.slice("classes", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("end")))
    strata = classes.groupBy("stratum").agg(F.sum("n").alias("n"), order.alias("classes")).withColumn("classes", ends)
    turns = strata.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(DRAWS).cast("long"))))
    tasks = max(LEAST_TASKS, 4 * rows.sparkSession.sparkContext.defaultParallelism)  # a number of its own: by their bytes all rows would be one task
    prefix = F.concat(F.concat_ws("|", F.lit(str(seed)), "iteration", "stratum"), F.lit("|"))
    picks = turns.repartition(tasks, "stratum", "iteration", "begin").withColumn("counts", class_counts(prefix, F.col("begin"), F.least(F.col("begin") + DRAWS, F.col("n")), F.col("n"), F.transform("classes", lambda c: c["end"])))
    hit = picks.select("iteration", F.posexplode("counts").alias("at", "times"), "classes").select("iteration", "times", F.get("classes", F.col("at")).alias("c")).select("iteration", "times", "c.*")
    drawn = hit.groupBy("iteration").agg(*counters([], F.col("times"))).select(*ratios())
    tail = (1 - confidence) / 2
    both = drawn.agg(*(F.percentile(m, F.array(F.lit(tail), F.lit(1 - tail))).alias(m) for m in METRICS))
    return both.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), round_exact(F.get(m, F.lit(0)), 4).alias("low"), round_exact(F.get(m, F.lit(1)), 4).alias("high")) for m in METRICS))).alias("r")).select("r.*")


def held_out_counts(local: DataFrame, hosted: DataFrame) -> DataFrame:
    """system, known and the numbers of correct, wrong, unresolved and error outcomes. Both: known, answered, correct, error."""
    both = local.withColumn("system", F.lit("local")).unionByName(hosted.withColumn("system", F.lit("hosted")))
    kind = F.when(F.col("error"), "error").when(F.col("correct"), "correct").when(F.col("answered"), "wrong").otherwise("unresolved")
    return both.select("system", "known", kind.alias("kind")).groupBy("system", "known").pivot("kind", ["correct", "wrong", "unresolved", "error"]).count().na.fill(0)


def hosted_outcomes(cases: DataFrame, cache: DataFrame) -> DataFrame:
    """Outcomes of the hosted search from its cache (query, results array<struct<ror_id,name,score,chosen>>, error): the first result always answers; a failed lookup is no abstention."""
    top = F.get("results", F.lit(0))
    joined = cases.join(cache.select("query", "results", F.col("error").isNotNull().alias("failed")), "query", "left")
    failed, known = F.coalesce("failed", F.lit(False)), F.col("expected_ror_id").isNotNull()
    answered = top["ror_id"].isNotNull()
    right = F.coalesce(top["ror_id"] == F.col("expected_ror_id"), F.lit(False))
    listed = F.coalesce(F.exists("results", lambda r: r["ror_id"] == F.col("expected_ror_id")), F.lit(False))
    return joined.select("case_id", "stratum", known.alias("known"), (known & listed).alias("blocking_hit"), (known & right).alias("top1_hit"), answered.alias("answered"), (answered & right).alias("correct_answered"), (~known & ~answered & ~failed).alias("correct_abstention"), failed.alias("error"))


def read_outcomes(rows: DataFrame) -> DataFrame:
    """Outcomes of a saved cases file, booleans and numbers typed."""
    flags = FLAGS
    numbers = [c for c in ("score", "name_score", "margin", "latency_ms") if c in rows.columns]
    return rows.select(*(c for c in rows.columns if c not in flags + numbers), *(as_bool(F.col(c)).alias(c) for c in flags), *(F.col(c).try_cast("double").alias(c) for c in numbers))
