"""Delimited files with their quirks, and the writers of every result."""

from __future__ import annotations

import csv
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entwine.functions.normalize import clean
from entwine.sources import archive

PRIVATE = ("vatNumber", "street", "postCode", "contactForm")
GOLD_FIELDS = ["case_id", "query", "country", "city", "expected_ror_id", "stratum", "source", "notes"]


def delimiter_of(head: str) -> str:
    """The delimiter of a file's head: semicolon, comma or tab; if none can be told, semicolon unless commas are more."""
    try:
        return csv.Sniffer().sniff(head, delimiters=";,\t").delimiter
    except csv.Error:
        return ";" if head.count(";") >= head.count(",") else ","


def delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter of the file or folder at a path, by its first lines."""
    lines = spark.read.text(path, lineSep="\n").limit(64).collect()
    return delimiter_of("\n".join(r["value"] for r in lines).lstrip("\ufeff")[:8192])


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as strings, a byte-order mark dropped, empty cells as empty strings. Longer rows are cut to the header, shorter ones filled with ''."""
    rows = spark.read.csv(path, sep=sep, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', nullValue="\u0000", emptyValue="")
    names = [c.lstrip("﻿") for c in rows.columns]
    rows = rows.toDF(*names)
    return rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names))


def packed_csv(archives: DataFrame, suffix: str) -> DataFrame:
    """Rows of a delimited member of ZIP files (path, content) with row_idx, all columns of the first header as strings; shorter rows are filled with '', cells beyond the header dropped."""
    rows = archive.cells(archives, suffix, delimiter_of)
    header = rows.where("line = 0").orderBy("path").first()
    names = header["cells"] if header else []
    own = rows.where("line > 0").select(F.monotonically_increasing_id().alias("row_idx"), "cells")
    return own.select("row_idx", *(F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)))


def read_participants(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Participant rows with row_idx: cells trimmed, private columns dropped. A ZIP gives its organization.csv."""
    if path.lower().endswith(".zip"):
        rows = packed_csv(archive.files(spark, path), "organization.csv")
    else:
        rows = read_csv(spark, path, delimiter(spark, path)).select(F.monotonically_increasing_id().alias("row_idx"), "*")
    rows = participants_of(rows)
    return rows.orderBy("row_idx").limit(limit) if limit else rows


def participants_of(rows: DataFrame) -> DataFrame:
    """Rows with row_idx, trimmed and without private columns."""
    rows = rows.drop(*PRIVATE)
    return rows.select("row_idx", *(F.coalesce(clean(F.col(f"`{c}`")), F.lit("")).alias(c) for c in rows.columns if c != "row_idx"))


def write_csv_parts(df: DataFrame, path: str) -> None:
    """CSV files with headers in a folder, written by all tasks; null as empty."""
    df.write.csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")


def write_jsonl_parts(df: DataFrame, path: str) -> None:
    """Files of one JSON object a line in a folder, keys in the order of their names."""
    df.select(*sorted(df.columns)).write.json(path, ignoreNullFields=False)


def _one_file(df: DataFrame, path: str, write) -> None:
    """Stream df's rows in order into one file, by way of another that takes its place at the end."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8", newline="") as f:
        write(f, (r.asDict(recursive=True) for r in df.toLocalIterator()))
    os.replace(part, path)


def write_csv(df: DataFrame, path: str, header_if_empty: bool = True) -> None:
    """One CSV file with a header, null as empty. Without rows and header_if_empty the file is empty."""

    def write(f, rows):
        out = csv.DictWriter(f, df.columns)
        first = next(rows, None)
        if first is not None or header_if_empty:
            out.writeheader()
        for r in ([] if first is None else [first]):
            out.writerow({k: "" if v is None else v for k, v in r.items()})
        for r in rows:
            out.writerow({k: "" if v is None else v for k, v in r.items()})

    _one_file(df, path, write)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, keys sorted, characters as they are."""

    def write(f, rows):
        for r in rows:
            f.write(json.dumps(r, ensure_ascii=False, sort_keys=True, default=str) + "\n")

    _one_file(df, path, write)


def write_json(value, path: str) -> None:
    """One JSON file."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True, default=str)
    os.replace(f"{path}.part", path)


def write_gold(cases: DataFrame, path: str) -> None:
    """Gold cases in their fixed columns."""
    write_csv(cases.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if c in cases.columns else F.lit("").alias(c) for c in GOLD_FIELDS)), path)
