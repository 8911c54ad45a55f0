"""Members of ZIP files as rows. Archives are read by Spark and opened where they are read, so no machine needs a file of its own."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Cells that one Arrow batch holds, about.
BATCH_CELLS = 100_000


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the files at a path."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def member_name(packed: zipfile.ZipFile, path: str, suffix: str, root_first: bool) -> str:
    """The member with a suffix: one in the root before others, then the shortest name; or the first."""
    names = [n for n in packed.namelist() if n.lower().endswith(suffix) and not n.endswith("/")]
    if not names:
        raise ValueError(f"no {suffix} file in {path}")
    return min(names, key=lambda n: ("/" in n, len(n), n)) if root_first else names[0]


def texts(archives: DataFrame, suffix: str = ".json", root_first: bool = True) -> DataFrame:
    """path and text of one member of every archive (path, content). An archive without such a member is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as packed:
                    text = packed.read(member_name(packed, path, suffix, root_first)).decode("utf-8-sig")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text], pa.string())], names=["path", "text"])

    return archives.mapInArrow(run, "path string, text string")


def cells(archives: DataFrame, suffix: str, sniff) -> DataFrame:
    """path, line and cells of a delimited member of every archive, the header being line 0; the member is read as a stream. sniff: a head of text -> its delimiter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as packed:
                    name = member_name(packed, path, suffix, False)
                    with packed.open(name) as member:
                        sep = sniff(io.TextIOWrapper(member, "utf-8-sig", newline="").read(8192))
                    with packed.open(name) as member:
                        rows, size, line = [], 0, 0
                        for row in csv.reader(io.TextIOWrapper(member, "utf-8-sig", newline=""), delimiter=sep):
                            if row:
                                rows.append((line, row))
                                line, size = line + 1, size + len(row)
                            if size >= BATCH_CELLS:
                                yield made(path, rows)
                                rows, size = [], 0
                        yield made(path, rows)

    return archives.mapInArrow(run, "path string, line long, cells array<string>")


def made(path: str, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.list_(pa.string()))], names=["path", "line", "cells"])
