"""What the operators share: reading tables, words, batches for Python tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WHITE = r"\x20\x09-\x0D"
WORD = rf"[^{WHITE}]+"
ARROW_ROWS = 2000  # rows of an Arrow batch
ARROW_BYTES = 8 << 20  # and its bytes, since texts may be long
PART_BYTES = 2 << 20  # stored bytes of input behind one part of a dealt table
CHUNK_BYTES = 1 << 20  # bytes of text that a Python task looks at together


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Long texts: Arrow batches bounded by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def boxed(df: DataFrame) -> Column:
    """A row of ``df`` as one struct, so that helper columns cannot clash with its names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def unboxed(names: list[str]) -> list[Column]:
    return [F.col("_row").getField(c).alias(c) for c in names]


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WHITE}]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the n+1 offsets of its values; null reads as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each (at least one row)."""
    for batch in batches:
        sizes = np.diff(text_bytes(batch.column(column))[1])
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back_memory()


def give_back_memory() -> None:
    """Return freed memory to the system: a Python worker lives on after its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (SplitMix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def input_parts(documents: DataFrame) -> int:
    """Parts for tables that grow with the documents, from the size Spark estimates."""
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, min(size // PART_BYTES, 1 << 22))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more.

    The session holds on to the plan it ran last, so a tiny one runs first.
    """
    spark.range(1).count()
    gc.collect()
    spark._jvm.System.gc()
