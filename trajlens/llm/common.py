"""Helpers shared by the corpus operators: intermediate tables, packed rows, shards in id order."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlens.session import shared_folder

#: Text handled at once inside a task, so that a batch of very long texts stays small.
PIECE_CHARS = 4_000_000


def keep(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and return a scan of it."""
    path = f"{shared_folder(df.sparkSession)}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete intermediate tables that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that are no longer referenced."""
    # Once for the plans, once for what they held; Spark's cleaner runs in the background.
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


_remembering: list = []


def remember(*caches) -> None:
    """Name the caches that the task at hand uses; those of an operator that this Python worker served before are emptied."""
    others = [cache for cache in _remembering if not any(cache is own for own in caches)]
    _remembering[:] = caches
    if others:
        for cache in others:
            cache.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        # Where the C library can, it hands free memory back; elsewhere it stays for this worker's next task.
        getattr(ctypes.CDLL(None), "malloc_trim", int)(0)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def packed(df: DataFrame) -> Column:
    """The whole row as one struct, so that work columns cannot clash with the table's own."""
    return F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("_row")


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("_row").getField(name).alias(name) for name in columns])


def pieces(batches: Iterator[pa.RecordBatch], column: str, chars: int = PIECE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of bounded text; a longer text makes a slice of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for place, length in enumerate(lengths):
            if total + length > chars and place > start:
                yield batch.slice(start, place - start)
                start, total = place, 0
            total += length
        if start < len(lengths):
            yield batch.slice(start)


def shard_edges(df: DataFrame, column: str, shards: int) -> list[int]:
    """Ascending cut points that deal the ids out to about ``shards`` ranges of like size.

    Only the id column is scanned, and the driver gets one number per shard.
    """
    if shards < 2:
        return []
    cuts = df.select(F.col(column).cast("double").alias("_id")).na.drop().approxQuantile(
        "_id", [place / shards for place in range(1, shards)], 0.2 / shards
    )
    return sorted({int(cut) for cut in cuts})


def shard_of(column: Column, edges: list[int]) -> Column:
    """Number of the range that holds an id: 0 for ids up to the first edge and for null."""
    if not edges:
        return F.lit(0)
    # A balanced tree of comparisons keeps the expression shallow.
    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column > edges[middle], tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(edges))


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers on any machine; once per application."""
    context = spark.sparkContext
    if getattr(context, "_package_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = f"{tempfile.mkdtemp()}/{root.name}_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(archive)
    context._package_shipped = True
