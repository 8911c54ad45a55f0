"""Lookups over HTTP with a persistent cache: institutions by id and hosted name search.

The cache is a table that plans join; only ids that it lacks are fetched, by one client in each of some tasks, with a least
interval between requests and retries. A small cache file serves single lookups. Tests give their own `fetch`.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entwine.sources.shared import written
from entwine.sources.tabular import write_json

RETRIED = (429, 500, 502, 503, 504)
INSTITUTION = "ror_id string, id string, display_name string, type string, country_code string, works_count long, cited_by_count long, counts_by_year array<struct<year:int,works_count:long,cited_by_count:long>>"
HOSTED = "query string, results array<struct<ror_id:string,name:string,score:double,chosen:boolean>>, error string"


def quoted(value: Column) -> Column:
    """A value with everything but letters, digits and _ . - ~ percent-encoded."""
    return F.replace(F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def get(url: str) -> tuple[int, dict, bytes]:
    """Status, headers and body of a GET."""
    try:
        with urllib.request.urlopen(url, timeout=30) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


def institution(payload: dict) -> dict:
    """A payload's fields: null years are left out, years ascend, missing numbers are 0."""
    years = [{k: int(c.get(k) or 0) for k in ("year", "works_count", "cited_by_count")} for c in payload.get("counts_by_year") or [] if c.get("year") is not None]
    return {"id": payload.get("id") or "", "display_name": payload.get("display_name") or "", "type": payload.get("type") or "", "country_code": payload.get("country_code") or "", "works_count": int(payload.get("works_count") or 0), "cited_by_count": int(payload.get("cited_by_count") or 0), "counts_by_year": sorted(years, key=lambda c: c["year"])}


def hosted_result(item: dict) -> dict | None:
    """A search result's id, name, score and choice; None without an id. Both shapes, with the organisation inside or flat."""
    org = item.get("organization") or item
    if not org.get("id"):
        return None
    shown = next((n.get("value") for n in org.get("names") or [] if "ror_display" in (n.get("types") or [])), "")
    return {"ror_id": org["id"], "name": org.get("name") or shown or "", "score": float(item.get("score") or 0.0), "chosen": bool(item.get("chosen"))}


class Cached:
    """A cache file of one kind of lookup. Entries of another version are forgotten; the file is replaced as a whole."""

    def __init__(self, path: str | None, fetch=get, interval: float = 0.11, retries: int = 4, sleep=time.sleep):
        self.path, self.fetch, self.interval, self.retries, self.sleep = path, fetch, interval, retries, sleep
        self.last, self.entries = 0.0, {}
        if path and os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                kept = json.load(f)
            if isinstance(kept, dict) and kept.get("schema_version") == 1:
                self.entries = kept.get("entries") or {}

    def save(self) -> None:
        write_json({"schema_version": 1, "entries": self.entries}, self.path)

    def request(self, url: str) -> tuple[int, bytes]:
        """Status and body after retries; a Retry-After header is obeyed, else waits double from half a second."""
        for n in range(self.retries + 1):
            wait = self.interval - (time.monotonic() - self.last)
            if wait > 0:
                self.sleep(wait)
            status, headers, body = self.fetch(url)
            self.last = time.monotonic()
            if status not in RETRIED or n == self.retries:
                return status, body
            after = headers.get("Retry-After", "")
            self.sleep(float(after) if after.replace(".", "", 1).isdigit() else 0.5 * 2**n)
        raise AssertionError


def fetched(wanted: DataFrame, key: str, client, ask, clients: int = 1, cache: str | None = None, refresh: bool = False) -> DataFrame:
    """key and answer (JSON) of every distinct filled key of `wanted`, asked by `clients` tasks with a client each.

    client() makes a client, ask(client, key) gives a dictionary. `cache` is a Parquet folder of earlier answers: only keys that
    it lacks are asked for, and their answers are added to it; with `refresh` all are asked again, and the latest answer counts.
    """
    spark = wanted.sparkSession
    keys = wanted.where(F.coalesce(key, F.lit("")) != "").select(key).distinct()
    try:
        known = spark.read.schema("key string, answer string, asked timestamp").parquet(cache) if cache else None
    except AnalysisException:  # no cache yet
        known = None
    missing = keys if known is None or refresh else keys.join(known.select(F.col("key").alias(key)), key, "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = client()
        for batch in batches:
            asked = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(asked, pa.string()), pa.array([json.dumps(ask(own, k)) for k in asked], pa.string())], names=["key", "answer"])

    answers = missing.repartition(clients, key).mapInArrow(run, "key string, answer string").withColumn("asked", F.current_timestamp())
    if cache:
        written(answers, "answers").write.mode("append").parquet(cache)
        answers = spark.read.schema("key string, answer string, asked timestamp").parquet(cache)
    else:
        answers = written(answers, "answers")
    latest = answers.groupBy("key").agg(F.max_by("answer", "asked").alias("answer"))
    return latest.withColumnRenamed("key", key).join(keys, key, "left_semi")


def institutions_of(wanted: DataFrame, fetch=get, clients: int = 1, cache: str | None = None, refresh: bool = False, interval: float = 0.11) -> DataFrame:
    """Institutions of the distinct ids in `wanted` (ror_id), looked up by `clients` tasks; unknown ids have no row."""
    found = fetched(wanted, "ror_id", lambda: Institutions(None, fetch, interval), lambda own, k: {"found": own.lookup(k)}, clients, cache, refresh)
    record = INSTITUTION.removeprefix("ror_id string, ")
    return found.select("ror_id", F.from_json("answer", f"found struct<{record}>")["found"].alias("r")).where("r is not null").select("ror_id", "r.*")


def hosted_of(wanted: DataFrame, fetch=get, clients: int = 1, cache: str | None = None, refresh: bool = False, interval: float = 0.11) -> DataFrame:
    """query, results and error of the distinct queries in `wanted` (query), searched by `clients` tasks."""
    found = fetched(wanted, "query", lambda: HostedSearch(None, fetch, interval), lambda own, k: {"results": own.search(k), "error": own.lookup_error(k)}, clients, cache, refresh)
    return found.select("query", F.from_json("answer", HOSTED.removeprefix("query string, ")).alias("r")).select("query", "r.results", "r.error")


class Institutions(Cached):
    """Institutions by registry id; one that isn't there is remembered as such."""

    base = "https://api.openalex.org/institutions/ror:"

    def lookup(self, ror_id: str, refresh: bool = False) -> dict | None:
        if refresh or ror_id not in self.entries:
            status, body = self.request(self.base + urllib.parse.quote(ror_id, safe=""))
            if status not in (200, 404):
                raise RuntimeError(f"lookup of {ror_id} failed with {status}")
            self.entries[ror_id] = {"fetched_at": datetime.now(timezone.utc).isoformat(), "record": institution(json.loads(body)) if status == 200 else None}
        return self.entries[ror_id]["record"]

    def table(self, spark: SparkSession, wanted: DataFrame, refresh: bool = False) -> DataFrame:
        """Institutions of the distinct ids in `wanted` (ror_id), fetched where the cache lacks them."""
        rows = []
        for r in wanted.where("coalesce(ror_id, '') <> ''").select("ror_id").distinct().toLocalIterator():
            found = self.lookup(r["ror_id"], refresh)
            if found:
                rows.append({"ror_id": r["ror_id"], **found})
        self.save()
        return spark.createDataFrame(rows, INSTITUTION)


class HostedSearch(Cached):
    """Hosted name search; a lookup that fails after its retries is remembered as an error without results."""

    base = "https://api.ror.org/organizations?affiliation="

    def search(self, query: str, refresh: bool = False) -> list[dict]:
        if refresh or query not in self.entries:
            error, items = None, []
            try:
                status, body = self.request(self.base + urllib.parse.quote(query, safe=""))
                if status == 200:
                    items = [r for r in map(hosted_result, json.loads(body).get("items") or []) if r]
                else:
                    error = f"status {status}"
            except (OSError, ValueError) as e:
                error = str(e)
            self.entries[query] = {"fetched_at": datetime.now(timezone.utc).isoformat(), "results": items, "error": error}
        return self.entries[query]["results"]

    def lookup_error(self, query: str) -> str | None:
        return (self.entries.get(query) or {}).get("error")

    def table(self, spark: SparkSession) -> DataFrame:
        """The cache as a relation."""
        return spark.createDataFrame([{"query": q, "results": e["results"], "error": e["error"]} for q, e in self.entries.items()], HOSTED)
