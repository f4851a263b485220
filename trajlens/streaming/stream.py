"""Structured Streaming over append-only trajectory logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlens.session import shared_folder, ship_package, still_there
from trajlens.sources import located
from trajlens.sources.logs import trajectory_key


def stream_trajectories(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Failure-free trajectories of a growing JSON-lines folder with ``trajectory_key`` and ``ord`` (file and byte).

    Unreadable lines stop the stream. Copies stay in; :func:`run_first_records` keeps the first of each key.
    """
    ship_package(spark)
    located.register(spark)
    lines = spark.readStream.format("located_lines").option("path", folder).load().filter(F.trim("value") != "")
    record = F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    rows = lines.select(F.struct("file", "place").alias("ord"), "value", record.alias("r"))
    message = F.concat("ord.file", F.lit(" at byte "), F.col("ord.place").cast("string"), F.lit(": not a record"))
    ok = F.when(F.col("r").isNotNull() & F.col("r._broken").isNull(), F.col("ord")).otherwise(
        F.raise_error(message).cast("struct<file:string,place:bigint>")
    )
    rows = rows.select(ok.alias("ord"), "r.*").drop("_broken").where("ord is not null")
    return rows.filter(F.coalesce("error", F.lit("")) == "").withColumn("trajectory_key", trajectory_key())


def run_first_records(stream: DataFrame, key: str = "trajectory_key", order: str = "ord") -> DataFrame:
    """Process what is there now and return the first record per key by ``order``, as the batch merge does.

    Every batch reduces to one record per key and is written to a folder named by its number, so a batch that is done again
    replaces itself; reading takes the first over all batches. There is no state to bound and no copy comes too late.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"

    def first(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")

    def write(batch: DataFrame, number: int) -> None:
        first(batch).write.mode("overwrite").parquet(f"{base}/table/{number}")

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    done = spark.createDataFrame([], stream.schema)
    if still_there(spark, f"{base}/table"):
        done = spark.read.schema(stream.schema).parquet(f"{base}/table/*")
    return first(done)


def stream_ledger_counts(ledger: DataFrame, window: str = "1 day", watermark: str = "1 hour", time: str = "ts") -> DataFrame:
    """Step statuses per tumbling window.

    In append mode a window is emitted once the watermark has passed its end; :func:`run_complete` also gives the
    windows that are still open.
    """
    return (
        ledger.withWatermark(time, watermark)
        .groupBy(F.window(time, window).alias("w"), "status")
        .agg(F.count(F.lit(1)).alias("steps"))
        .select(F.col("w.start").alias("window_start"), "status", "steps")
    )


def run_available(stream: DataFrame, output_mode: str = "append") -> DataFrame:
    """Process what is there now into a table in the shared folder and return that table."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode(output_mode).format("parquet")
        .option("path", f"{base}/table").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def run_complete(stream: DataFrame) -> DataFrame:
    """Process what is there now and return the whole result of an aggregation, open windows included.

    Every batch writes the result so far to a folder of its own, named by its number; the newest one is returned.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/table/{number}")
        done.append(number)

    query = (
        stream.writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{base}/table/{max(done)}")
