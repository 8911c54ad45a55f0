"""Normalisation and similarity."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from entwine.functions import normalize as N
from entwine.functions import similarity as S
from entwine.functions.rounding import round_exact
from entwine.operators.intervals import clopper_pearson


def values(spark, function, rows, schema="v string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(function(*(F.col(c) for c in df.columns))).collect()]


NAMES = {
    "Max-Planck-Gesellschaft zur Forderung e.V.": "max planck gesellschaft zur forderung", "Acme Robotics GmbH": "acme robotics", "Bath Spa University": "bath spa university", "SAS Institute": "sas institute", "x e v ltd": "x e v",
    "x e v": "x", "e.V.": "", "GmbH": "gmbh", "A & B (old) Co": "a and b co", "Universität zu Köln": "universitat zu koln", "ﬁne ½": "fine 1 2", "Łódź": "odz", None: "", "  ": "", "Foo Ltd LLC": "foo", "AG": "ag",
}


def test_names(spark):
    assert dict(zip(NAMES, values(spark, N.normalize_name, NAMES))) == NAMES


def test_countries(spark):
    cases = {"de": "DE", "United Kingdom": "united kingdom", "UK": "GB", "EL": "GR", " fr ": "FR", "": "", None: "", "D1": "d1", "Österreich": "osterreich"}
    assert dict(zip(cases, values(spark, N.normalize_country, cases))) == cases


def test_tokens_and_grams(spark):
    assert values(spark, N.search_tokens, ["University of the Arts OR Design", "a bb bb"]) == [["university", "arts", "design"], ["bb", "bb"]]
    assert values(spark, N.scoring_tokens, ["de la ab universidad zur for research research"]) == [["universidad", "research", "research"]]
    assert values(spark, N.trigrams, ["abcab cabx", "ab", ""]) == [["abc", "abx", "bca", "cab"], [], []]


def test_identities_and_strata(spark):
    rows = [(" 12 ", "n", "s", "c", "t"), (None, "Acme GmbH", "x", "uk", "Köln"), ("", "", "Short", None, None)]
    assert values(spark, N.identity, rows, "a string, b string, c string, d string, e string") == ["cordis:12", "fallback:acme|GB|koln", "fallback:short||"]
    assert values(spark, N.provisional_stratum, ["UCL", "Köln", "two words", "one two three", ""]) == ["acronym", "multilingual", "short_name", "standard", "short_name"]


def test_amounts(spark):
    rows = [("1,234.50", "9"), ("", "€7"), (None, None), ("n/a", "5"), (" 3 ", "1")]
    assert values(spark, N.first_amount, rows, "a string, b string") == [1234.5, 7.0, None, None, 3.0]
    assert values(spark, N.as_int, ["12.9", "-3.7", "", None, "x"]) == [12, -3, 0, 0, 0]
    assert values(spark, N.as_bool, ["true", " FALSE "]) == [True, False]
    with pytest.raises(Exception, match="not a boolean"):
        values(spark, N.as_bool, ["yes"])


def test_case_identifiers(spark):
    rows = [("own", "q", "c", "t"), (None, " Query ", "DE", None), (" ", "QUERY", "de", "")]
    found = values(spark, N.case_identifier, rows, "a string, b string, c string, d string")
    assert found[0] == "own" and found[1] == found[2] and found[1].startswith("case-") and len(found[1]) == 17


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = following(row, x, b)
    return row[-1]


def following(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(out[j], row[j + 1]))
    return out


def test_lcs_against_the_table():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert S.lcs(a, b) == slow_lcs(a, b)


#: Saved name scores: query, name, score.
SCORES = [
    ("universite des sciences et technique de masuku", "universite des sciences et techniques de masuku", 0.989247311827957), ("forum for agricultural research in africa ghana", "forum for agricultural research in africa", 0.8),
    ("department of land and natural resources", "department of lands and natural resources", 0.9876543209876543), ("universite de ghardaia", "university of ghardaia", 0.8636363636363636),
    ("royal university of agriculture", "royal university of agriculture cambodia", 0.904214448113396), ("universidad cientifica del sur sac", "universidad cientifica del sur", 0.8),
]


@pytest.mark.parametrize("query, name, score", SCORES)
def test_saved_scores(query, name, score):
    assert S.raw_score(query, name) * S.coverage(query, name, 3, 0.84, 0.35) == pytest.approx(score, abs=1e-9)


def test_ratios():
    assert S.ratio("", "") == 100 and S.ratio("ab", "") == 0 and S.ratio("kitten", "sitting") == pytest.approx(100 * 8 / 13)
    assert S.token_sort_ratio("b a", "a b") == 100 and S.token_set_ratio("a b c", "a b") == 100 and S.token_set_ratio("", "a") == 0
    assert S.partial_ratio("abc", "xxabcxx") == 100 and S.partial_ratio("", "a") == 0
    assert S.weighted_ratio("new york", "the wonderful new york mets") == pytest.approx(90)
    assert S.coverage("de la", "de la", 3, 0.84, 0.35) == 0


def test_exact_rounding(spark):
    rng = random.Random(4)
    numbers = [0.285, 1.005, 2.675, 0.125, -0.125, 0.375, 2.5, 0.0, -0.0, 1e-9, 123456.78950, 9007199254740993.0, 5e15, float("inf")]
    numbers += [rng.choice([-1, 1]) * rng.randint(0, 10**7) / 10 ** rng.randint(0, 7) for _ in range(3000)] + [rng.randint(0, 10**6) / 2 ** rng.randint(1, 12) for _ in range(3000)]
    df = spark.createDataFrame([(float(x),) for x in numbers] + [(None,)], "x double")
    for digits in (0, 2, 3, 4, 6):
        found = [r[0] for r in df.select(round_exact(F.col("x"), digits)).collect()]
        assert found[-1] is None and found[:-1] == [round(float(x), digits) for x in numbers]


def test_interval_bounds():
    """Both bounds against sums of the binomial's terms in whole fractions."""
    rng = random.Random(5)
    for n in (1, 2, 7, 40, 263):
        for s in {0, n, n // 2, rng.randint(0, n)}:
            low, high = clopper_pearson(s, n)
            tail = lambda p, ks: sum(math.comb(n, k) * Fraction(p) ** k * (1 - Fraction(p)) ** (n - k) for k in ks)
            assert low == 0 if s == 0 else abs(float(tail(low, range(s, n + 1))) - 0.025) < 1e-9
            assert high == 1 if s == n else abs(float(tail(high, range(s + 1))) - 0.025) < 1e-9
    low, high = clopper_pearson(500_000, 1_000_000)
    assert abs(low - 0.4990195) < 1e-6 and abs(high - 0.5009805) < 1e-6
