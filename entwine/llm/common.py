"""What the operators share: reading tables, cutting lineage, walking Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Text bytes that a Python worker takes at a time, so that its memory doesn't follow the batch size.
SLICE_BYTES = 1 << 19


#: Bytes of an Arrow batch on its way to Python; Spark's own bound is several times that in each task.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches under BATCH_BYTES, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="entwine-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: For rows of megabytes: sizes are looked at after every row (else after 100), so neither a page nor a row group holds many of them.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(8 << 20)}


def cut(df: DataFrame, name: str = "cut", options: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lost executor then costs no recomputation before this point."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options or {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give a worker's free memory back to the machine: workers are used again by other stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def cut_rows(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch that hold about `most` bytes of `column` each; a longer value stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        done, at = int(ends[to - 1]), to


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The slices of all batches. At the end free memory is released."""
    for batch in batches:
        yield from cut_rows(batch, column, most)
    batch = None  # noqa: F841
    release()


def with_fields(df: DataFrame, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    """df's schema with the given fields at the end; a field of that name in df is replaced."""
    bound_batches(df.sparkSession)
    new = {n for n, _ in fields}
    return T.StructType([f for f in df.schema.fields if f.name not in new] + [T.StructField(n, t, True) for n, t in fields])


def with_arrays(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with the given columns at the end; a column of that name is replaced."""
    kept = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + list(columns.values()), names=kept + list(columns))
