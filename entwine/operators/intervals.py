"""Exact binomial intervals."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entwine.sources.shared import written

#: Steps of halving (53 give all bits of a double), and the most terms of a continued fraction; it needs about the root of the trials.
HALVINGS, MOST_TERMS = 60, 1_000_000
TINY = 1e-300


def beta_share(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function of arrays with 0 < x < 1 and a, b > 0, by its continued fraction (modified Lentz)."""
    turned = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(turned, 1 - x, x), np.where(turned, b, a), np.where(turned, a, b)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    guard = lambda v: np.where(np.abs(v) < TINY, TINY, v)
    c, d = np.ones_like(x), 1 / guard(1 - (a + b) * x / (a + 1))
    value = d.copy()
    for m in range(1, MOST_TERMS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / guard(1 + even * d), guard(1 + even / c)
        value = value * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / guard(1 + odd * d), guard(1 + odd / c)
        step = d * c
        value = value * step
        if (np.abs(step - 1) < 1e-15).all():
            break
    share = front * value
    return np.where(turned, 1 - share, share)


def lgamma(values: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in values.tolist()])


def quantile(chance: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the incomplete beta function reaches a chance, by halving all rows at once."""
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        above = beta_share(np.clip(middle, TINY, 1 - 1e-16), a, b) > chance
        low, high = np.where(above, low, middle), np.where(above, middle, high)
    return (low + high) / 2


def bounds_of(successes: np.ndarray, trials: np.ndarray, confidence: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Both Clopper-Pearson bounds of every row: the chances at which each tail is half of what is left of the confidence."""
    s, n, tail = successes.astype(np.float64), trials.astype(np.float64), (1 - confidence) / 2
    low, high = np.zeros(len(s)), np.ones(len(s))
    some = s > 0
    low[some] = quantile(tail, s[some], n[some] - s[some] + 1)
    some = s < n
    high[some] = quantile(1 - tail, s[some] + 1, n[some] - s[some])
    return low, high


def clopper_pearson(successes: int, trials: int, confidence: float = 0.95) -> tuple[float, float]:
    """Both bounds of one row."""
    if isinstance(successes, bool) or isinstance(trials, bool) or not isinstance(successes, int) or not isinstance(trials, int):
        raise TypeError("successes and trials must be integers")
    if trials < 1 or not 0 <= successes <= trials or not 0 < confidence < 1:
        raise ValueError("0 <= successes <= trials, trials > 0 and 0 < confidence < 1 are needed")
    low, high = bounds_of(np.array([successes]), np.array([trials]), confidence)
    return float(low[0]), float(high[0])


_BOUNDS = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])


def interval(confidence: float = 0.95):
    """Column function of (successes, trials): struct of low and high; null without trials."""

    @F.arrow_udf(_BOUNDS)
    def bounds(successes: pa.Array, trials: pa.Array) -> pa.Array:
        some = pc.fill_null(pc.and_(pc.is_valid(successes), pc.greater(trials, 0)), False)
        s, n = (pc.filter(v, some).to_numpy(zero_copy_only=False) for v in (successes, trials))
        if len(s) and ((s < 0) | (s > n)).any():
            raise ValueError("successes must be between 0 and trials")
        made = [{"low": a, "high": b} for a, b in zip(*(v.tolist() for v in bounds_of(s, n, confidence)))]
        rows = iter(made)
        return pa.array([next(rows) if k else None for k in some.to_pylist()], pa.struct([("low", pa.float64()), ("high", pa.float64())]))

    return bounds


def report(outcomes: DataFrame, confidence: float = 0.95) -> DataFrame:
    """metric, successes, trials, estimate, low and high of precision and specificity; an empty table raises ValueError."""
    sums = written(outcomes.agg(F.count("*").alias("n"), F.count_if("correct_answered").alias("a"), F.count_if("answered").alias("b"), F.count_if("correct_abstention").alias("c"), F.count_if(~F.col("known")).alias("d")), "counts")
    if not sums.first()["n"]:
        raise ValueError("no outcomes")
    row = lambda name, s, n: F.struct(F.lit(name).alias("metric"), F.col(s).alias("successes"), F.col(n).alias("trials"))
    rows = sums.select(F.explode(F.array(row("selective_precision", "a", "b"), row("no_match_specificity", "c", "d"))).alias("r")).select("r.*")
    return rows.withColumn("i", interval(confidence)("successes", "trials")).select("metric", "successes", "trials", F.try_divide(F.col("successes").cast("double"), "trials").alias("estimate"), "i.low", "i.high")
