"""Normalisation of names, countries and cities as column functions.

Only the folding of accents needs Python (Spark has no Unicode normalisation); it works on Arrow batches and lets
ASCII strings pass as they are. Everything after it is built in.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Legal forms at the end of names, words that retrieval leaves out, words that scoring leaves out.
LEGAL_SUFFIXES = "ag as bv ev gmbh inc kg ltd llc lp nv oy plc sa sas spa srl".split()
SEARCH_STOPWORDS = "and for not of or the".split()
SCORING_STOPWORDS = "and das de der des die for la le of or the zu zur".split()
COUNTRY_ALIASES = {"UK": "GB", "EL": "GR"}
SPACE = r"[\s\u0085   -     　\u001c-\u001f]"


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.arrow_udf(T.StringType())
def fold_ascii(values: pa.Array) -> pa.Array:
    """Compatibility decomposition without combining marks."""
    return pa.array([v if v is None or v.isascii() else _fold(v) for v in values.to_pylist()], pa.string())


def clean(value: Column) -> Column:
    """White space trimmed, empty to null."""
    return F.nullif(F.regexp_replace(value, f"^{SPACE}+|{SPACE}+$", ""), F.lit(""))


def normalize_text(value: Column) -> Column:
    """Folded, lower case, without parentheses, & as and, only a-z and 0-9 in words with single blanks; null to empty."""
    text = F.lower(fold_ascii(F.coalesce(value, F.lit(""))))
    text = F.replace(F.regexp_replace(text, r"\([^)]*\)", " "), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def strip_legal(text: Column) -> Column:
    """A normalised name without 'e v' at its end, then without legal forms at its end; one token always stays."""
    text = F.regexp_replace(text, "(^| )e v$", "")
    return F.regexp_replace(text, f"(?<=[a-z0-9])( ({'|'.join(LEGAL_SUFFIXES)}))+$", "")


def normalize_name(value: Column) -> Column:
    return strip_legal(normalize_text(value))


def normalize_city(value: Column) -> Column:
    return normalize_text(value)


def normalize_country(value: Column) -> Column:
    """Two letters to an upper-case code (UK and EL to their official ones), anything else as text; null to empty."""
    text = F.coalesce(clean(value), F.lit(""))
    code = F.upper(text)
    alias = F.create_map(*[F.lit(x) for pair in COUNTRY_ALIASES.items() for x in pair])
    return F.when(text.rlike(r"^\p{L}{2}$"), F.coalesce(F.try_element_at(alias, code), code)).otherwise(normalize_text(text))


def words(text: Column) -> Column:
    """Words of a normalised text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def search_tokens(value: Column) -> Column:
    """Tokens of a name for retrieval: two characters at least, no stopwords, repeated ones kept."""
    return F.filter(words(normalize_name(value)), lambda w: (F.length(w) >= 2) & ~w.isin(*SEARCH_STOPWORDS))


def scoring_tokens(norm: Column, least: int = 3) -> Column:
    """Tokens of a normalised name that carry signal."""
    return F.filter(words(norm), lambda w: (F.length(w) >= least) & ~w.isin(*SCORING_STOPWORDS))


def trigrams(norm: Column, most: int = 64) -> Column:
    """Distinct character trigrams without a blank, sorted, the first `most`."""
    grams = F.transform(F.when(F.length(norm) >= 3, F.sequence(F.lit(1), F.length(norm) - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(norm, i, F.lit(3)))
    return F.slice(F.array_sort(F.array_distinct(F.filter(grams, lambda g: ~g.contains(" ")))), 1, most)


def identity(org_id: Column, name: Column, short_name: Column, country: Column, city: Column) -> Column:
    """Key of a participant: its id if it has one, else its normalised name, country and city."""
    own = clean(org_id)
    fallback = F.concat(F.lit("fallback:"), F.concat_ws("|", normalize_name(F.coalesce(F.nullif(name, F.lit("")), short_name)), normalize_country(country), normalize_city(city)))
    return F.when(own.isNotNull(), F.concat(F.lit("cordis:"), own)).otherwise(fallback)


def provisional_stratum(query: Column) -> Column:
    """multilingual, acronym, short_name or standard."""
    tokens = F.size(F.filter(F.split(query, r"\s+"), lambda w: w != ""))
    return F.when(query.rlike(r"[^\x00-\x7F]"), "multilingual").when((F.length(query) <= 6) & (tokens == 1), "acronym").when(tokens <= 2, "short_name").otherwise("standard")


def case_identifier(given: Column, query: Column, country: Column, city: Column) -> Column:
    """The given id, or one made of a digest of query, country and city."""
    key = F.concat_ws("|", *(F.lower(F.coalesce(clean(c), F.lit(""))) for c in (query, country, city)))
    return F.coalesce(clean(given), F.concat(F.lit("case-"), F.substring(F.sha2(key.cast("binary"), 256), 1, 12)))


def first_amount(*values: Column) -> Column:
    """The first filled value as a number; commas and the euro sign are dropped, an unreadable one is null."""
    first = F.coalesce(*(F.nullif(v.cast("string"), F.lit("")) for v in values))
    return F.trim(F.regexp_replace(first, "[,€]", "")).try_cast("double")


def as_int(value: Column) -> Column:
    """A number cut to an integer; 0 if empty or unreadable."""
    number = value.cast("string").try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(0)).otherwise(number).cast("bigint")


def as_bool(value: Column) -> Column:
    """true or false; anything else is an error."""
    text = F.lower(F.trim(value))
    return F.when(text == "true", True).when(text == "false", False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(value, F.lit("null")))).cast("boolean"))
