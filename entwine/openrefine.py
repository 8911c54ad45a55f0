"""The reconciliation service's requests and responses, and a small HTTP server over them."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entwine.config import MatchConfig
from entwine.functions.normalize import clean
from entwine.operators.matching import as_service, match, prepare
from entwine.sources.shared import written

#: Names of the evidence properties.
COUNTRY_IDS = ("country", "country_code", "organization_country", "organisation_country")
CITY_IDS = ("city", "organization_city", "organisation_city")
PROPERTIES = [{"id": "country", "name": "Country code or country name"}, {"id": "city", "name": "City"}]
QUERIES = "query_id string, query string, country string, city string, limit int"
#: What is said of requests that cannot be read.
NOT_QUERIES = "the request is not a JSON object of queries"
NOT_A_QUERY = "a query is not an object"
NOT_PROPERTIES = "the properties of a query are not a list"


class BadRequest(ValueError):
    """A request that cannot be read; status 400."""


def manifest(base: str) -> dict:
    """What the service says of itself; the keys and spaces are fixed values of the protocol."""
    return {
        "versions": ["0.2"], "name": "Local organisation reconciliation", "identifierSpace": "https://ror.org/", "schemaSpace": "https://ror.org/", "defaultTypes": [{"id": "organization", "name": "Organization"}],
        "batchSize": 50, "view": {"url": "{{id}}"}, "suggest": {"property": {"service_url": base.rstrip("/"), "service_path": "/suggest/property"}},
    }


def kind_of(value: Column) -> Column:
    """ARRAY, OBJECT, STRING and so on: the type of a VARIANT; VOID of JSON's null, null of none."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def text_of(value: Column) -> Column:
    """A VARIANT as trimmed text, empty to null; true and false begin with a capital."""
    text = F.try_variant_get(value, "$", "string")
    return clean(F.when(kind_of(value) == "BOOLEAN", F.initcap(text)).otherwise(text))


def bound(value: Column, function) -> Column:
    """function(value), with the value worked out and written into the plan once."""
    return F.element_at(F.transform(F.array(value), function), 1)


def property_text(value: Column) -> Column:
    """The text of a property's VARIANT: of a list its first element, however deep; of an object the first of id, name and value that says something."""
    steps = lambda v: F.filter(F.sequence(F.lit(0), F.length(F.regexp_extract(F.to_json(v), r"^\[*", 0))), lambda n: n > 0)
    inner = lambda v: F.aggregate(steps(v), v, lambda x, _: F.try_variant_get(x, "$[0]", "variant"))
    said = lambda v: F.filter(F.array(*(F.try_variant_get(v, f"$.{k}", "variant") for k in ("id", "name", "value"))), lambda x: x.isNotNull() & ~F.to_json(x).isin('""', "0", "0.0", "false", "null", "[]", "{}"))
    named = lambda v: F.when(kind_of(v) == "OBJECT", F.get(said(v), F.lit(0))).when(kind_of(v) != "VOID", v)
    return bound(bound(bound(value, inner), named), text_of)


def limit_of(value: Column) -> Column:
    """A VARIANT as a number of candidates from 1 to 20, cut to an integer; null if it is none."""
    kind = kind_of(value)
    text = F.trim(F.try_variant_get(value, "$", "string"))
    number = F.when(kind == "STRING", F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("double"))).when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).when(~kind.isin("ARRAY", "OBJECT", "VOID"), F.try_variant_get(value, "$", "double"))
    return F.when(number.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(20), number.cast("int"))))


def parse_requests(requests: DataFrame) -> DataFrame:
    """request, query_id, query, country, city, limit and error of every query in the JSON of requests (request, body).

    A body that is no JSON object is one row with an error and without query_id, an empty object no row. A query that is no object,
    or whose properties are no list, has an error of its own. Of repeated properties the last counts.
    """
    parsed = requests.select("request", F.try_parse_json("body").alias("v"))
    listed = F.when(kind_of(F.col("v")) == "OBJECT", F.try_variant_get("v", "$", "map<string,variant>"))
    rows = parsed.withColumn("m", listed).where("m is null or size(m) > 0").select("request", F.explode_outer("m").alias("query_id", "q"))
    get = lambda key: F.try_variant_get("q", f"$.{key}", "variant")
    rows = rows.select("request", "query_id", kind_of(F.col("q")).alias("kind"), get("query").alias("said"), get("limit").alias("limit"), get("properties").alias("given"))
    listed = F.filter(F.coalesce(F.try_variant_get("given", "$", "array<variant>"), F.array().cast("array<variant>")), lambda p: kind_of(p) == "OBJECT")
    pairs = F.transform(listed, lambda p: F.struct(F.lower(F.coalesce(text_of(F.try_variant_get(p, "$.pid", "variant")), F.lit(""))).alias("pid"), F.try_variant_get(p, "$.v", "variant").alias("v")))
    is_list = F.coalesce(kind_of(F.col("given")), F.lit("VOID")).isin("ARRAY", "VOID") | F.to_json("given").isin("{}", '""', "0", "false")
    error = F.when(F.col("query_id").isNull(), NOT_QUERIES).when(F.coalesce("kind", F.lit("")) != "OBJECT", NOT_A_QUERY).when(~is_list, NOT_PROPERTIES)
    rows = rows.select("request", "query_id", "said", "limit", pairs.alias("pairs"), error.alias("error"))

    def last(ids: tuple[str, ...]) -> Column:
        return property_text(F.get(F.reverse(F.filter("pairs", lambda p: p["pid"].isin(*ids))), F.lit(0))["v"])

    text = F.try_variant_get("said", "$", "string")
    query = F.when(kind_of(F.col("said")) == "BOOLEAN", F.when(text == "true", "True")).when(F.to_json("said") != "0", text)
    return rows.select("request", "query_id", F.coalesce(query, F.lit("")).alias("query"), last(COUNTRY_IDS).alias("country"), last(CITY_IDS).alias("city"), limit_of(F.col("limit")).alias("limit"), "error")


def respond(requests: DataFrame, names: DataFrame, orgs: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """request, status and response (JSON) of every request (request, body): one plan for all queries of all requests.

    A request with an error anywhere has status 400 and says which. Keys are in the order of their names.
    """
    parsed = written(parse_requests(requests), "requests")
    failed = parsed.groupBy("request").agg(F.min("error").alias("error"))
    key = F.concat_ws("\n", F.col("request").cast("string"), "query_id")
    good = parsed.where("query_id is not null").withColumn("key", key)
    own = prepare(good.where("error is null").select(F.col("key").alias("query_id"), "query", "country", "city", "limit")).persist()
    found = as_service(match(own, names, orgs, config), orgs)
    result = F.concat(F.lit('{"result":['), F.array_join(F.coalesce("result", F.array().cast("array<string>")), ","), F.lit("]}"))
    entry = F.concat(F.regexp_extract(F.to_json(F.struct(F.col("good.query_id").alias("k"))), '(?s)^.{5}(.*).$', 1), F.lit(":"), result)
    entries = good.alias("good").join(found.alias("found"), F.col("good.key") == F.col("found.query_id"), "left").select("request", F.struct(F.col("good.query_id").alias("k"), entry.alias("entry")).alias("e"))
    whole = entries.groupBy("request").agg(F.array_sort(F.collect_list("e")).alias("e")).select("request", F.concat(F.lit("{"), F.array_join(F.transform("e", lambda x: x["entry"]), ","), F.lit("}")).alias("body"))
    rows = requests.select("request").join(failed, "request", "left").join(whole, "request", "left")
    bad = F.col("error").isNotNull()
    return rows.select("request", F.when(bad, 400).otherwise(200).alias("status"), F.when(bad, F.to_json(F.struct(F.col("error").alias("detail")))).otherwise(F.coalesce("body", F.lit("{}"))).alias("response"))


def reconcile_json(spark: SparkSession, raw: str, names: DataFrame, orgs: DataFrame, config: MatchConfig = MatchConfig()) -> dict:
    """The response to one request: {key: {"result": [...]}}; BadRequest if it has an error."""
    answer = respond(spark.createDataFrame([(0, raw)], "request int, body string"), names, orgs, config).first()
    if answer["status"] != 200:
        raise BadRequest(json.loads(answer["response"])["detail"])
    return json.loads(answer["response"])


def suggest_properties(prefix: str) -> dict:
    """Properties whose id or name contains the prefix."""
    own = prefix.lower()
    return {"result": [p for p in PROPERTIES if own in p["id"] or own in p["name"].lower()]}


def serve(spark: SparkSession, names: DataFrame, orgs: DataFrame, host: str = "127.0.0.1", port: int = 8000, config: MatchConfig = MatchConfig()) -> ThreadingHTTPServer:
    """A server over an index whose tables are kept in memory; the caller runs and closes it."""
    names, orgs = names.persist(), orgs.persist()
    total = orgs.count()

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, value) -> None:
            body = json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def reconcile(self, raw: str) -> None:
            try:
                self.answer(200, reconcile_json(spark, raw, names, orgs, config))
            except BadRequest as e:
                self.answer(400, {"detail": str(e)})

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            query = parse_qs(url.query)
            if url.path == "/health":
                self.answer(200, {"ok": True, "organizations": total})
            elif url.path == "/suggest/property":
                self.answer(200, suggest_properties(query.get("prefix", [""])[0]))
            elif url.path != "/":
                self.answer(404, {"detail": "Not Found"})
            elif "queries" in query:
                self.reconcile(query["queries"][0])
            else:
                self.answer(200, manifest(f"http://{self.headers.get('Host', host)}"))

        def do_POST(self) -> None:
            form = parse_qs(self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode())
            self.reconcile(form.get("queries", [""])[0])

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
