"""Session construction and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", app: str = "trajlens") -> SparkSession:
    """Local session for tests and benchmarks; a cluster supplies its own."""
    parallelism = "8" if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parallelism)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    A temporary folder is used only in local mode and only when nothing is configured; on a cluster a
    missing setting is an error, because executors could not read each other's local disks.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def store(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write an intermediate table that several branches read, and return a scan of it.

    Unlike a checkpoint the scan keeps column pruning, filter pushdown and size statistics.
    """
    path = path or new_table_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_bucketed(df: DataFrame, keys: list[str], dealt: bool = False) -> DataFrame:
    """Write a table in buckets of ``keys``, so that joins and groupings on them read it without a shuffle.

    There are as many buckets as shuffle partitions, and one file each. ``dealt`` says that the rows are already dealt
    out by these keys into that many partitions, as after a join with such a table.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df if dealt else df.repartition(buckets, *keys)
    path = new_table_path(spark)
    name = f"stored_{path.rsplit('/', 1)[1]}"
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", path).saveAsTable(name)
    return spark.table(name)


def dealt(df: DataFrame, keys: list[str], rows: int = 25_000) -> DataFrame:
    """Rows dealt out by ``keys``, about ``rows`` to a task, for work that makes many rows of each and sorts them in place."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), *keys)


def new_table_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"


def input_state(spark: SparkSession, path: str) -> tuple[int, int]:
    """Size and modification time of an input, to notice that it changed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getContentSummary(hadoop).getLength(), files.getFileStatus(hadoop).getModificationTime()


def still_stored(spark: SparkSession, path: str) -> bool:
    return still_there(spark, f"{path}/_SUCCESS")


def still_there(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers on any machine; once per application."""
    context = spark.sparkContext
    if getattr(context, "_package_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = f"{tempfile.mkdtemp()}/{root.name}_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(archive)
    context._package_shipped = True
