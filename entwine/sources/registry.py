"""The registry of organisations: reading its JSON, its tables, and lookups in them.

Two record shapes are read with one schema that is their union; fields that are a string in one and an object in the other
are VARIANT. Tables: organizations (ror_id, name, country, country_code, city, status, types, locations) and names
(name_id, ror_id, value, norm, kind), name_id ascending in the order of records and of names in them.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from entwine.functions.normalize import clean, normalize_name
from entwine.sources import archive

KINDS = ("ror_display", "label", "alias", "acronym")
_DETAILS = "country_code:string,country_name:string,name:string"
RECORD = (
    "id string, ror_id string, name string, status string, types array<string>,"
    " names array<struct<value:string,types:array<string>,lang:string>>, aliases array<string>, acronyms array<string>, labels array<variant>,"
    f" locations array<struct<geonames_details:struct<{_DETAILS}>,{_DETAILS},city:string>>,"
    " addresses array<struct<city:string,country_name:string,country_code:string,country:struct<country_name:string,country_code:string>>>, country variant"
)
FIELDS = ["id", "ror_id", "name", "status", "types", "names", "aliases", "acronyms", "labels", "locations", "addresses", "country"]
ENVELOPE = ("items", "records", "organizations", "data")
NAME, PLACE = "struct<value:string,kind:string>", "struct<country:string,country_code:string,city:string>"


def packed_records(archives: DataFrame) -> DataFrame:
    """The records of ZIP files (path, content) with a JSON member each, as read_records gives them."""
    lists = ", ".join(f"{k} array<struct<{RECORD}>>" for k in ENVELOPE)
    rows = archive.texts(archives).select(F.explode(F.from_json("text", f"array<struct<{RECORD}, {lists}>>")).alias("r")).select("r.*")
    return of_documents(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of JSON files (a list, or an object with a list under one of the envelope's names), with `position`. A ZIP gives its JSON member."""
    if path.lower().endswith(".zip"):
        found = packed_records(archive.files(spark, path))
    else:
        lists = ", ".join(f"{k} array<struct<{RECORD}>>" for k in ENVELOPE)
        found = of_documents(spark.read.schema(f"{RECORD}, {lists}").json(path, multiLine=True))
    head = found.select(F.col("nothing")).limit(2).collect()
    if len(head) == 1 and head[0]["nothing"]:
        raise ValueError(f"no list of records in {path}")
    return found.drop("nothing")


def of_documents(rows: DataFrame) -> DataFrame:
    """position, nothing (whether a record has no field at all) and the fields of the records in rows of documents: each a record itself or an envelope of some."""
    fields = FIELDS
    listed = F.coalesce(*(F.col(k) for k in ENVELOPE))
    nothing = listed.isNull()
    for f in fields:
        nothing &= F.col(f).isNull()
    each = rows.select(nothing.alias("nothing"), F.explode(F.coalesce(listed, F.array(F.struct(*fields)))).alias("_r"))
    return each.select(F.monotonically_increasing_id().alias("position"), "nothing", "_r.*")


def record_names(r: str = "") -> Column:
    """All names of a record in a fixed order: names, name, aliases, acronyms, labels; each with its kind."""

    def kind(types: Column) -> Column:
        return F.coalesce(*(F.when(F.array_contains(types, k), F.lit(k)) for k in KINDS), F.get(types, F.lit(0)), F.lit("name"))

    def entry(value: Column, of: Column) -> Column:
        return F.struct(clean(value).alias("value"), of.alias("kind"))

    none = F.array().cast(f"array<{NAME}>")
    plain = lambda column, of: F.coalesce(F.transform(F.col(column), lambda v: entry(v, F.lit(of))), none)
    label = lambda v: F.coalesce(F.try_variant_get(v, "$.label", "string"), F.try_variant_get(v, "$.value", "string"), F.when(~F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "string")))
    every = F.concat(
        F.coalesce(F.transform("names", lambda n: entry(n["value"], kind(n["types"]))), none),
        F.when(F.col("name").isNotNull(), F.array(entry(F.col("name"), F.lit("name")))).otherwise(none),
        plain("aliases", "alias"),
        plain("acronyms", "acronym"),
        F.coalesce(F.transform("labels", lambda v: entry(label(v), F.lit("label"))), none),
    )
    return F.filter(every, lambda n: n["value"].isNotNull())


def record_locations() -> Column:
    """Distinct places of a record: locations and addresses, or else the country."""

    def place(country: Column, code: Column, city: Column) -> Column:
        return F.struct(clean(country).alias("country"), clean(code).alias("country_code"), clean(city).alias("city"))

    none = F.array().cast(f"array<{PLACE}>")
    located = F.coalesce(F.transform("locations", lambda x: place(F.coalesce(x["geonames_details"]["country_name"], x["country_name"]), F.coalesce(x["geonames_details"]["country_code"], x["country_code"]), F.coalesce(x["geonames_details"]["name"], x["city"], x["name"]))), none)
    addressed = F.coalesce(F.transform("addresses", lambda x: place(F.coalesce(x["country_name"], x["country"]["country_name"]), F.coalesce(x["country_code"], x["country"]["country_code"]), x["city"])), none)
    get = lambda *keys: F.coalesce(*(F.try_variant_get("country", f"$.{k}", "string") for k in keys))
    text = F.when(~F.schema_of_variant("country").startswith("OBJECT"), F.try_variant_get("country", "$", "string"))
    legacy = place(F.coalesce(get("country_name", "name"), text), get("country_code", "code"), F.lit(None).cast("string"))
    filled = lambda p: p["country"].isNotNull() | p["country_code"].isNotNull() | p["city"].isNotNull()
    own = F.filter(F.concat(located, addressed), filled)
    return F.array_distinct(F.when(F.size(own) > 0, own).otherwise(F.filter(F.array(legacy), filled)))


def parse_records(records: DataFrame) -> DataFrame:
    """Records to position, ror_id, name, status, types, names and locations; those without an id or a name are dropped."""
    rows = records.select("position", F.coalesce(clean(F.col("id")), clean(F.col("ror_id"))).alias("ror_id"), clean(F.col("name")).alias("legacy"), clean(F.col("status")).alias("status"), F.coalesce("types", F.array().cast("array<string>")).alias("types"), record_names().alias("names"), record_locations().alias("locations"))
    of = lambda kind: F.get(F.filter("names", lambda n: n["kind"] == kind), F.lit(0))["value"]
    shown = F.coalesce("legacy", of("ror_display"), of("label"), F.get("names", F.lit(0))["value"])
    first = F.get("locations", F.lit(0))
    rows = rows.withColumn("name", shown).where(F.col("ror_id").isNotNull() & F.col("name").isNotNull())
    return rows.select("position", "ror_id", "name", first["country"].alias("country"), first["country_code"].alias("country_code"), first["city"].alias("city"), "status", "types", "names", "locations")


def number_of(position: Column, at: Column) -> Column:
    """name_id of the name `at` of the record at `position`, in that order: 20 bits for the part that a record was read in, 27 for its place there, 16 for the name."""
    part, place = F.shiftright(position, 33), position.bitwiseAND((1 << 33) - 1)
    fits = (part < 1 << 20) & (place < 1 << 27) & (at < 1 << 16)
    number = F.shiftleft(part, 43) + place * 65536 + at
    return F.when(fits, number).otherwise(F.raise_error(F.concat(F.lit("too many records or names at position "), position.cast("string"))).cast("long"))


def tables(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """organizations and names of parsed records. Names equal in (norm, kind) keep the first; empty ones go. A repeated id is an error on writing."""
    place = F.struct(F.col("country"), F.col("country_code"), F.col("city"))
    some = F.col("country").isNotNull() | F.col("country_code").isNotNull() | F.col("city").isNotNull()
    located = F.when(F.size("locations") > 0, F.col("locations")).when(some, F.array(place)).otherwise(F.col("locations"))
    orgs = parsed.select("ror_id", "name", "country", "country_code", "city", "status", "types", located.alias("locations"))
    rows = parsed.select("position", "ror_id", F.posexplode("names").alias("at", "n")).select("position", "ror_id", "at", "n.value", "n.kind").withColumn("norm", normalize_name(F.col("value"))).where("norm <> ''")
    first = W.partitionBy("ror_id", "norm", "kind").orderBy("position", "at")
    names = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(number_of(F.col("position").cast("long"), F.col("at").cast("long")).alias("name_id"), "ror_id", "value", "norm", "kind")
    return orgs, names


def write_index(orgs: DataFrame, names: DataFrame, path: str) -> int:
    """Both tables as Parquet under `path`, replacing what is there; returns the number of organisations. A repeated id raises ValueError and leaves the old index."""
    spark = orgs.sparkSession
    twice = orgs.groupBy("ror_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated id: {twice[0]['ror_id']}")
    orgs.write.mode("overwrite").parquet(os.path.join(path, "organizations"))
    names.write.mode("overwrite").parquet(os.path.join(path, "names"))
    return spark.read.parquet(os.path.join(path, "organizations")).count()


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The tables of an index; an empty one raises ValueError."""
    orgs, names = spark.read.parquet(os.path.join(path, "organizations")), spark.read.parquet(os.path.join(path, "names"))
    if orgs.isEmpty():
        raise ValueError(f"no organisations in {path}")
    return orgs, names


def active(orgs: DataFrame) -> DataFrame:
    """Organisations that are active or have no status."""
    return orgs.where(F.coalesce("status", F.lit("active")) == "active")


def record(orgs: DataFrame, names: DataFrame, ror_id: str) -> DataFrame:
    """The whole record of one id; no row if it is unknown."""
    return records_for(orgs.where(F.col("ror_id") == ror_id), names, orgs.sparkSession.createDataFrame([(ror_id, 0)], "ror_id string, position int"))


def records_for(orgs: DataFrame, names: DataFrame, wanted: DataFrame) -> DataFrame:
    """Whole records of wanted ids (ror_id, position), with names by kind and value; unknown ids are left out."""
    listed = names.join(wanted.select("ror_id").distinct(), "ror_id", "left_semi").groupBy("ror_id").agg(F.array_sort(F.collect_list(F.struct("kind", "value", "norm"))).alias("names"))
    return wanted.join(orgs, "ror_id").join(listed, "ror_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<struct<kind:string,value:string,norm:string>>")))
