"""Queries over files: the driver's tables are written in the formats of the engine's sources to the shared folder, and read back."""

from __future__ import annotations

import io
import json
import zipfile
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import functions as F

from entwine.operators import evaluation
from entwine.plans import roles, sql
from entwine.sources import lookup, registry, tabular
from entwine.sources.shared import new_path



def documents(spark, sf_dir):
    """A JSON document for every 40 pages, with its number: pages as records in both shapes, in a list or under one of the envelope's names."""
    p = roles.page_parts(roles.table(spark, sf_dir, "pages"))
    host, title, lang, city = F.col("host"), F.col("title"), F.col("lang"), F.col("city")
    new = F.to_json(F.struct(
        F.concat(F.lit(" page-"), "page_id").alias("id"), "status", F.array(F.lit("education")).alias("types"),
        F.array(F.struct(host.alias("value"), F.array(F.lit("alias")).alias("types")), F.struct(F.concat(F.lit(" "), title).alias("value"), F.array(F.lit("label"), F.lit("ror_display")).alias("types"))).alias("names"),
        F.array(F.struct(F.struct(lang.alias("country_code"), F.lit(" ").alias("country_name"), city.alias("name")).alias("geonames_details")), F.struct(F.struct(lang.alias("country_code"), F.lit("").alias("country_name"), city.alias("name")).alias("geonames_details"))).alias("locations"),
    ))
    old = F.to_json(F.struct(
        F.concat(F.lit("page-"), "page_id").alias("ror_id"), title.alias("name"), "status", F.array(host, F.lit("")).alias("aliases"), F.array(F.substring("title", 1, 3)).alias("acronyms"), F.array(F.struct(title.alias("label"), F.lit("en").alias("iso639"))).alias("labels"),
        F.when(F.col("page_id") % 4 == 1, F.array(F.struct(city.alias("city"), F.struct(lang.alias("country_code")).alias("country")))).alias("addresses"), F.struct(lang.alias("country_code"), F.lit("Land").alias("country_name")).alias("country"),
    ))
    each = p.select(F.floor(F.col("page_id") / 40).alias("number"), F.struct("page_id", F.when(F.col("page_id") % 2 == 0, new).otherwise(old).alias("r")).alias("r"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("rs", lambda r: r["r"]), ","), F.lit(',{"id":"nameless"},{"name":"without id"}]'))
    key = F.element_at(F.array(*(F.lit(k) for k in registry.ENVELOPE)), (F.col("number") % 4 + 1).cast("int"))
    whole = F.when(F.col("number") % 5 == 4, listed).otherwise(F.concat(F.lit('{"'), key, F.lit('":'), listed, F.lit("}")))
    return each.groupBy("number").agg(F.array_sort(F.collect_list("r")).alias("rs")).select("number", whole.alias("value"))


def from_files(spark, sf_dir):
    path = new_path(spark, "registry")
    documents(spark, sf_dir).write.partitionBy("number").text(path)
    return registry.tables(registry.parse_records(registry.read_records(spark, path)))


def zipped(df, member):
    """path and content: a ZIP file for every row (number, value), with the value in a member beside others."""

    def run(batches):
        for batch in batches:
            made = []
            for value in batch.column("value").to_pylist():
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as packed:
                    packed.writestr("about/readme.txt", "none")
                    packed.writestr(f"deep/{member}", '[{"id":"wrong","name":"wrong"}]' if member.endswith("json") else value)
                    if member.endswith("json"):
                        packed.writestr(f"a-longer-{member}", value)
                made.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([f"{n}.zip" for n in batch.column("number").to_pylist()], pa.string()), pa.array(made, pa.binary())], names=["path", "content"])

    return df.select("number", "value").mapInArrow(run, "path string, content binary")


def shown(orgs):
    place = lambda p: F.concat_ws("/", F.coalesce(p["country"], F.lit("-")), F.coalesce(p["country_code"], F.lit("-")), F.coalesce(p["city"], F.lit("-")))
    return orgs.select("ror_id", "name", "country", "country_code", "city", "status", F.array_join("types", ",").alias("types"), F.array_join(F.transform("locations", place), ";").alias("locations"))


def a4_organizations(spark, sf_dir):
    """Organisations of registry JSON: envelopes, both record shapes, display names, places."""
    return shown(from_files(spark, sf_dir)[0])


def a8_names(spark, sf_dir):
    """Names of registry JSON, each kind and normal form once."""
    return from_files(spark, sf_dir)[1].select("ror_id", "value", "norm", "kind")


def a2_zipped(spark, sf_dir):
    """Organisations of zipped registry JSON."""
    records = registry.packed_records(zipped(documents(spark, sf_dir), "registry.json")).drop("nothing")
    return shown(registry.tables(registry.parse_records(records))[0])


def participant_rows(spark, sf_dir):
    rows = roles.participants(spark, sf_dir)
    return rows.select(F.concat(F.lit(" "), "organisationID", F.lit("  ")).alias("organisationID"), F.concat(F.lit('He said "'), "name", F.lit('"; so it is')).alias("name"), "country", "projectID", F.format_number(F.col("ecContribution").cast("double"), 2).alias("ecContribution"), F.lit("secret").alias("vatNumber"), F.lit("").alias("city"), F.col("row_idx").cast("string").alias("order"))


def a12_participants(spark, sf_dir):
    """Participants of semicolon-separated files with quotes, blanks and private columns."""
    path = new_path(spark, "participants")
    participant_rows(spark, sf_dir).write.csv(path, sep=";", header=True, quote='"', escape='"')
    rows = tabular.read_participants(spark, path)
    return rows.select("organisationID", "name", "country", "projectID", "ecContribution", "city", "order", F.lit(",".join(sorted(rows.columns))).alias("columns"))


def a13_zipped_participants(spark, sf_dir):
    """Participants of zipped files, some of whose rows are too short."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    lines = participant_rows(spark, sf_dir).select((F.col("order").cast("long") % 7).alias("number"), F.concat_ws(";", F.col("order"), quoted("organisationID"), quoted("name"), F.when(F.col("order").cast("long") % 3 > 0, quoted("country"))).alias("line"))
    bodies = lines.groupBy("number").agg(F.concat(F.lit("order;organisationID;name;country\n"), F.array_join(F.sort_array(F.collect_list("line")), "\n")).alias("value"))
    rows = tabular.participants_of(tabular.packed_csv(zipped(bodies, "Organization.csv"), "organization.csv"))
    return rows.select("order", "organisationID", "name", "country")


def a14_reconciled(spark, sf_dir):
    """A result file written by all tasks and read back."""
    path = new_path(spark, "reconciled")
    tabular.write_csv_parts(roles.participants(spark, sf_dir).select("row_idx", F.when(F.col("row_idx") % 3 > 0, F.col("ror_id")).alias("ror_id"), F.concat(F.col("name"), F.lit(', "x"\nsecond line')).alias("name"), (F.col("row_idx") / 8).alias("score")), path)
    return tabular.read_csv(spark, path)


def a15_gold(spark, sf_dir):
    """Gold cases of a file with other column names, blanks and cases without a query."""
    path = new_path(spark, "gold")
    cases = roles.cases(spark, sf_dir)
    number = F.regexp_extract("case_id", r"(\d+)$", 1).cast("int")
    tabular.write_csv_parts(cases.select(F.when(number % 2 == 0, F.col("case_id")).alias("case_id"), F.when(number % 5 > 0, F.concat(F.lit(" "), "query")).alias("name"), "country", "city", F.col("expected_ror_id").alias("ror_id"), F.when(number % 3 > 0, F.col("stratum")).alias("stratum")), path)
    return evaluation.gold_cases(tabular.read_csv(spark, path))


def fake_institution(url):
    """What the service would say of a page's id: nothing for every third."""
    number = int(unquote(url).rsplit("-", 1)[1])
    if number % 3 == 0:
        return 404, {}, b"{}"
    years = [{"year": 2020 + k, "works_count": number * k, "cited_by_count": None} for k in (3, 1, 2)] + [{"year": None, "works_count": 9}]
    return 200, {}, json.dumps({"id": f"I{number}", "display_name": f"Page {number}", "works_count": number * 6, "cited_by_count": "7", "counts_by_year": years}).encode()


def a16_lookup(spark, sf_dir):
    """Institutions of all pages, looked up by several tasks into a cache that is there the second time."""
    cache = new_path(spark, "institutions")
    wanted = roles.registry(spark, sf_dir)[0].select("ror_id")
    few = wanted.where(F.col("ror_id").endswith("1"))
    lookup.institutions_of(few, fake_institution, 2, cache, interval=0.0)
    found = lookup.institutions_of(wanted.union(wanted), fake_institution, 4, cache, interval=0.0)
    return found.select("ror_id", "id", "display_name", "works_count", "cited_by_count", F.array_join(F.transform("counts_by_year", lambda c: F.concat_ws(":", c["year"], c["works_count"], c["cited_by_count"])), ",").alias("years"))


def fake_search(url):
    """What the search would say: both result shapes, one without an id, and errors."""
    query = unquote(url).split("=", 1)[1]
    if len(query) % 5 == 0:
        return 418, {}, b""
    items = [{"organization": {"id": "r:" + query[:3], "names": [{"value": query, "types": ["ror_display"]}]}, "score": 0.5, "chosen": True}, {"name": "no id"}, {"id": "r:second", "name": "Second", "score": None}]
    return 200, {}, json.dumps({"items": items}).encode()


def a18_hosted(spark, sf_dir):
    """Hosted searches of all queries."""
    found = lookup.hosted_of(roles.queries(spark, sf_dir).select("query"), fake_search, 4, interval=0.0)
    return found.select("query", F.array_join(F.transform("results", lambda r: F.concat_ws(":", r["ror_id"], r["name"], r["score"], r["chosen"])), ",").alias("results"), "error")


def b1_index(spark, sf_dir):
    """An index written and read: its organisations with the numbers of their names."""
    path = new_path(spark, "index")
    registry.write_index(*roles.registry(spark, sf_dir), path)
    orgs, names = registry.read_index(spark, path)
    return orgs.select("ror_id", "name", "status").join(names.groupBy("ror_id").agg(F.count("*").alias("names")), "ror_id", "left")


def b2_jsonl(spark, sf_dir):
    """Rows written as JSON lines by all tasks and read back."""
    path = new_path(spark, "lines")
    tabular.write_jsonl_parts(roles.queries(spark, sf_dir).withColumn("nothing", F.lit(None).cast("string")), path)
    lines = spark.read.text(path).select(F.get_json_object("value", "$.query_id").alias("query_id"), F.get_json_object("value", "$.query").alias("query"), F.regexp_replace("value", '"[^"]*":("(?:[^"\\\\]|\\\\.)*"|null)', "k").alias("shape"), F.array_join(F.json_object_keys("value"), ",").alias("keys"))
    return lines


def b7_gold_file(spark, sf_dir):
    """A gold file in its fixed columns, read back."""
    path = new_path(spark, "gold")
    cases = roles.cases(spark, sf_dir)
    tabular.write_csv_parts(cases.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if c in cases.columns else F.lit("").alias(c) for c in tabular.GOLD_FIELDS)), path)
    return tabular.read_csv(spark, path)


def c5_record(spark, sf_dir):
    """The whole record of one id."""
    orgs, names = roles.registry(spark, sf_dir)
    return registry.record(orgs, names, "page-7").select("ror_id", "name", "status", F.array_join(F.transform("names", lambda n: n["value"]), "|").alias("names"))


_ALL = [a2_zipped, a4_organizations, a8_names, a12_participants, a13_zipped_participants, a14_reconciled, a15_gold, a16_lookup, a18_hosted, b1_index, b2_jsonl, b7_gold_file, c5_record]
QUERIES = {f.__name__: f for f in _ALL}

RECORDS = f"""{sql.PARTS}, shaped AS (SELECT 'page-' || page_id AS ror_id, trim(title) AS name, CASE WHEN page_id % 4 = 3 THEN 'Land' END AS country, nullif(lang, '') AS country_code, CASE WHEN page_id % 4 = 3 THEN NULL ELSE nullif(city, '') END AS city, status, CASE WHEN page_id % 2 = 0 THEN 'education' ELSE '' END AS types FROM parts WHERE trim(title) <> '')"""
ORGANIZATIONS = f"WITH {RECORDS} SELECT *, coalesce(country, '-') || '/' || coalesce(country_code, '-') || '/' || coalesce(city, '-') AS locations FROM shaped"
PEOPLE = sql.PARTICIPANTS
ORACLES = {
    "a2_zipped": ORGANIZATIONS,
    "a4_organizations": ORGANIZATIONS,
    "a8_names": f"""WITH {sql.PARTS}, every AS (SELECT page_id, host AS value, 'alias' AS kind FROM parts UNION ALL SELECT page_id, title, 'ror_display' FROM parts WHERE page_id % 2 = 0 UNION ALL SELECT page_id, title, 'name' FROM parts WHERE page_id % 2 = 1
  UNION ALL SELECT page_id, substr(title, 1, 3), 'acronym' FROM parts WHERE page_id % 2 = 1 UNION ALL SELECT page_id, title, 'label' FROM parts WHERE page_id % 2 = 1)
 SELECT 'page-' || page_id AS ror_id, trim(value) AS value, {sql.name('value')} AS norm, kind FROM every WHERE {sql.name('value')} <> ''""",
    "a12_participants": f"""WITH {PEOPLE} SELECT org AS "organisationID", 'He said "' || name || '"; so it is' AS name, country, project AS "projectID", format('{{:,.2f}}', amount) AS "ecContribution", '' AS city, CAST(row_idx AS VARCHAR) AS "order", 'city,country,ecContribution,name,order,organisationID,projectID,row_idx' AS columns FROM participants""",
    "a13_zipped_participants": f"""WITH {PEOPLE} SELECT CAST(row_idx AS VARCHAR) AS "order", org AS "organisationID", 'He said "' || name || '"; so it is' AS name, CASE WHEN row_idx % 3 > 0 THEN country ELSE '' END AS country FROM participants""",
    "a14_reconciled": f"""WITH {PEOPLE} SELECT CAST(row_idx AS VARCHAR) AS row_idx, CASE WHEN row_idx % 3 > 0 THEN org ELSE '' END AS ror_id, name || ', "x"' || chr(10) || 'second line' AS name, CAST(row_idx / 8 AS VARCHAR) AS score FROM participants""",
    "a15_gold": f"""WITH {sql.PARTS}, {sql.RAW}, {sql.CASES}, n AS (SELECT *, CAST(regexp_extract(case_id, '(\\d+)$', 1) AS INT) AS i FROM cases)
 SELECT CASE WHEN i % 2 = 0 THEN case_id ELSE 'case-' || substr(sha256(lower(trim(query)) || '|' || lower(trim(country)) || '|' || lower(trim(city))), 1, 12) END AS case_id, trim(query) AS query, nullif(trim(country), '') AS country, nullif(trim(city), '') AS city, expected_ror_id,
  CASE WHEN i % 3 > 0 THEN stratum ELSE 'default' END AS stratum, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS notes FROM n WHERE i % 5 > 0""",
    "a16_lookup": "SELECT 'page-' || page_id AS ror_id, 'I' || page_id AS id, 'Page ' || page_id AS display_name, page_id * 6 AS works_count, 7 AS cited_by_count, '2021:' || page_id || ':0,2022:' || 2 * page_id || ':0,2023:' || 3 * page_id || ':0' AS years FROM pages WHERE page_id % 3 <> 0",
    "a18_hosted": f"WITH {sql.PARTS}, {sql.RAW}, q AS (SELECT DISTINCT query FROM raw_queries) SELECT query, CASE WHEN len(query) % 5 = 0 THEN '' ELSE 'r:' || substr(query, 1, 3) || ':' || query || ':0.5:true,r:second:Second:0.0:false' END AS results, CASE WHEN len(query) % 5 = 0 THEN 'status 418' END AS error FROM q",
    "b1_index": f"WITH {sql.NAMES} SELECT o.ror_id, o.name, o.status, nullif(count(n.name_id), 0) AS names FROM orgs o LEFT JOIN names n USING (ror_id) GROUP BY ALL",
    "b2_jsonl": f"WITH {sql.PARTS}, {sql.RAW} SELECT query_id, query, '{{k,k,k,k,k}}' AS shape, 'city,country,nothing,query,query_id' AS keys FROM raw_queries",
    "b7_gold_file": f"WITH {sql.PARTS}, {sql.RAW}, {sql.CASES} SELECT case_id, query, country, city, coalesce(expected_ror_id, '') AS expected_ror_id, stratum, '' AS source, '' AS notes FROM cases",
    "c5_record": f"WITH {sql.NAMES} SELECT o.ror_id, o.name, o.status, string_agg(value, '|' ORDER BY kind, value) AS names FROM orgs o JOIN names USING (ror_id) WHERE o.ror_id = 'page-7' GROUP BY ALL",
}
