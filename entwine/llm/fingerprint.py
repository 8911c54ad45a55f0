"""Document fingerprints by consistent weighted sampling, with column functions only.

The terms of a text are its words (runs without white space), weighted by how often they occur. Weights are whole numbers, so
a term of weight w is the elements (term, 0) to (term, w - 1), and each of POSITIONS positions draws one element of the
text: consistently, as every element's draws are hashes of itself alone, and uniformly over all elements. Two texts agree at
a position with a probability that equals the generalised Jaccard similarity of their weighted terms, and the likeness
of two fingerprints is the share of positions that agree.

The draw is that of fast similarity sketching: in each round every element falls on one position, by hash, with a random
value; a position takes the smallest value of the first round in which any element falls on it. After ROUNDS rounds
each position that is still empty draws from all elements by a hash of its own. So no position stays empty, and a
long text needs one round only. How many rounds are worked out for a text doesn't change its fingerprint; the first
pass takes as many as fill all positions nearly always, and the rest is worked out where it did not. A fingerprint keeps
16 bits of each draw.

Defined cases: null text is empty; a text without words has an empty fingerprint, which is 1.0 like another empty one
and 0.0 like any other; equal texts have equal fingerprints; only key and text are read, so other columns cannot clash; rows
with equal or null keys each get a row; an empty table gives an empty table. Words are compared as they are.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POSITIONS, ROUNDS = 64, 64
#: Draws of the first pass over a text, at least (as far as ROUNDS go): a position stays empty in about one text of a thousand.
FIRST_DRAWS = 700
#: Rows of one run of neighbouring keys, and the most runs; neighbours across runs meet through one row a run.
RUN_ROWS, MOST_RUNS = 500, 1 << 16


def draw(element: Column, number: Column, position: Column | None = None) -> Column:
    """position, round and 50 random bits of an element in one long; the smaller, the earlier at its position."""
    bits = F.xxhash64(element, number)
    if position is None:
        position = bits.bitwiseAND(F.lit(POSITIONS - 1))
    return F.shiftleft(position.cast("long"), 57) + F.shiftleft(F.least(number, F.lit(ROUNDS)).cast("long"), 50) + F.shiftrightunsigned(bits, 14)


def first_of(draws: Column) -> Column:
    """The smallest draw at each position. The sorted draws are bound once, as the only value of a list."""
    pick = lambda ks: F.filter(ks, lambda k, i: (i == 0) | (F.shiftright(k, 57) != F.shiftright(F.get(ks, i - 1), 57)))
    return F.element_at(F.transform(F.array(F.sort_array(draws)), pick), 1)


def with_samples(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`: array<int> of (position, 16 bits of the position's draw), by position. Each step is a column, so none is worked out twice."""
    step = df.withColumn("_h", F.sort_array(F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))))
    step = step.withColumn("_at", F.filter(F.when(F.size("_h") > 0, F.sequence(F.lit(0), F.size("_h") - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (F.get("_h", i) != F.get("_h", i - 1))))
    times = lambda at, i: F.coalesce(F.get("_at", i + 1), F.size("_h")) - at
    step = step.withColumn("_el", F.flatten(F.transform("_at", lambda at, i: F.transform(F.sequence(F.lit(0), times(at, i) - 1), lambda o: F.xxhash64(F.get("_h", at), o)))))
    rounds = lambda n: F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.transform("_el", lambda e: draw(e, r))))
    enough = F.least(F.lit(ROUNDS), F.ceil(F.lit(FIRST_DRAWS) / F.greatest(F.size("_el"), F.lit(1))).cast("int"))
    step = step.withColumn("_k", first_of(rounds(enough)))
    own = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(POSITIONS - 1)), lambda p: F.transform("_el", lambda e: draw(e, p + ROUNDS, p))))
    step = step.withColumn("_k", F.when((F.size("_el") == 0) | (F.size("_k") == POSITIONS), F.col("_k")).otherwise(first_of(F.concat(rounds(F.lit(ROUNDS)), own))))
    sample = F.transform("_k", lambda k: (F.shiftright(k, 57) * F.lit(65536) + F.xxhash64(k).bitwiseAND(F.lit(65535))).cast("int"))
    return step.withColumn(out, sample).drop("_h", "_at", "_el", "_k")


def as_string(samples: Column) -> Column:
    """The fingerprint: six hex digits for each position."""
    return F.array_join(F.transform(samples, lambda s: F.lower(F.lpad(F.hex(s), 6, "0"))), "")


def likeness(one: Column, other: Column) -> Column:
    """Share of agreeing positions; 1.0 of two fingerprints without any."""
    return F.when((F.size(one) == 0) & (F.size(other) == 0), 1.0).otherwise(F.size(F.array_intersect(one, other)) / F.lit(POSITIONS))


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """df with fingerprint."""
    return with_samples(df, text, "_s").withColumn("fingerprint", as_string(F.col("_s"))).drop("_s")


def run_of(df: DataFrame, key: str) -> Column:
    """The run of a row's key (an integer), ascending with the key; -1 for null. Runs are cut at quantiles on two levels, so a row looks at about the square root of their number."""
    runs = max(1, min(MOST_RUNS, df.count() // RUN_ROWS))
    at = F.lit(0)
    if runs > 1:
        own = F.col(key).cast("bigint")
        parts = math.ceil(math.sqrt(runs))
        cuts = F.percentile_approx(own, [i / parts for i in range(1, parts)], 100 * parts).alias("cuts")
        below = lambda bounds: F.size(F.filter(bounds, lambda b: b <= own))
        constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
        coarse = below(constant(sorted(set(df.select(cuts).first()["cuts"] or [])), "array<bigint>"))
        # at most `parts` rows of `parts` keys
        fine = {r["part"]: sorted(set(r["cuts"] or [])) for r in df.where(F.col(key).isNotNull()).groupBy(coarse.alias("part")).agg(cuts).collect()}
        within = F.get(constant([fine.get(i, []) for i in range(parts + 1)], "array<array<bigint>>"), coarse)
        at = coarse * (parts + 1) + below(within)
    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(at)


def followed(df: DataFrame, key: str, text: str, samples: str) -> DataFrame:
    """df (key, text) with its samples, _next_text and _next_s: those of the row that follows in descending key order, after the last those of the first.

    Keys are cut into runs at quantiles (at most MOST_RUNS of them), and a row's follower is found inside its run; each run
    also gets a copy of the first row of the next run, so that its last row has a follower. Rows of equal keys stand in
    the order of their texts; null keys come last.
    """
    placed = with_samples(df, text, samples).withColumn("_run", run_of(df, key))
    # one row for each run, so MOST_RUNS + 1 at most: its highest key
    tops = sorted((r["_run"], r["_top"]) for r in placed.groupBy("_run").agg(F.max(key).alias("_top")).collect())[::-1]
    before = [(tops[i - 1][0], top) for i, (_, top) in enumerate(tops)]
    firsts = df.sparkSession.createDataFrame(before, f"_run int, _top {df.schema[key].dataType.simpleString()}")
    copies = df.join(F.broadcast(firsts), F.col(key).eqNullSafe(F.col("_top"))).groupBy("_run").agg(F.min(text).alias(text))
    copies = with_samples(copies, text, samples).withColumn(key, F.lit(None).cast(df.schema[key].dataType)).withColumn("_copy", F.lit(1))
    order = W.partitionBy("_run").orderBy("_copy", F.col(key).desc_nulls_last(), F.col(text))
    both = placed.withColumn("_copy", F.lit(0)).unionByName(copies)
    both = both.withColumn("_next_text", F.lead(text).over(order)).withColumn("_next_s", F.lead(samples).over(order))
    return both.where("_copy = 0").drop("_run", "_copy")


def compare_with_edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the row that
    follows in descending key order.
    """
    own = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    n = F.length("_text")
    both = followed(own, key, "_text", "_s").withColumn("_n", n).withColumn("_cut", F.floor(n / 3).cast("int"))
    both = both.withColumn("_edited", F.concat(F.substring(F.col("_text"), F.lit(1), F.col("_n") - F.col("_cut")), F.substring(F.col("_next_text"), F.lit(1), F.col("_cut"))))
    both = with_samples(both.select(key, "_n", "_s", "_next_s", "_edited"), "_edited", "_e")
    return both.select(
        key,
        F.col("_n").cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("_s")).alias("fingerprint"),
        as_string(F.col("_e")).alias("edited_fingerprint"),
        likeness(F.col("_s"), F.col("_e")).alias("near_edited"),
        likeness(F.col("_s"), F.col("_next_s")).alias("near_next"),
    )
