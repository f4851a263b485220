"""Helpers that keep work evenly spread: salted lookups, dense global numbering, hash draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlens.session import store


def salted_lookup(
    left: DataFrame, right: DataFrame, on: list[str], spread_by: list[str], salts: int = 8, how: str = "left",
    hot: Column | None = None,
) -> DataFrame:
    """Join a large table to a lookup that is unique on ``on`` when one key may hold much of the table.

    Rows of a hot key go to ``salts`` partitions by a hash of ``spread_by``; each lookup row is copied as
    often. ``hot`` limits this to keys that can be hot (a condition on the key columns), so the others are
    not copied. The salt is a hash, not a random number, so a re-run task produces the same rows.
    """
    hot = F.lit(True) if hot is None else hot
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    salted = left.withColumn("_salt", F.when(hot, salt).otherwise(0))
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(right.withColumn("_salt", F.explode(copies)), [*on, "_salt"], how).drop("_salt")


def hash_text(*parts: Column) -> Column:
    return F.md5(F.concat(*[part.cast("string") for part in parts]))


def hash_draw(text: Column, count: Column) -> Column:
    """Integer in [0, count) from the first 60 bits of the md5 of ``text``."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % count


def global_index(df: DataFrame, order_hash: Column, tie: Column) -> DataFrame:
    """Add ``_index`` (0-based, dense, ordered by an md5 text and then ``tie``) and ``_total``.

    No global sort in one task: rows are numbered inside 4096 hash-prefix buckets, and only the 4096
    bucket counts are summed up in one place.
    """
    keyed = df.withColumn("_hash", order_hash).withColumn("_bucket", F.substring("_hash", 1, 3))
    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # At most 4096 rows: one per three-digit hexadecimal prefix.
    everything = Window.partitionBy(F.lit(0))
    offsets = counts.select(
        "_bucket",
        (F.sum("_n").over(everything.orderBy("_bucket")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(everything).alias("_total"),
    )
    inside = Window.partitionBy("_bucket").orderBy("_hash", tie)
    return (
        keyed.withColumn("_row", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn("_index", F.col("_before") + F.col("_row"))
        .drop("_hash", "_bucket", "_before", "_row")
    )


def ordered_index(df: DataFrame, column: str, index: str = "_index") -> DataFrame:
    """Add the 0-based place of each row in the order of a unique column.

    Rows are range-partitioned and written once, numbered inside their range, and shifted by the counts of
    the ranges before: one small row per range is all that is ever summed in one place.
    """
    ranged = store(df.repartitionByRange(column).withColumn("_range", F.spark_partition_id()))
    everything = Window.partitionBy(F.lit(0)).orderBy("_range")
    before = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", (F.sum("_n").over(everything) - F.col("_n")).alias("_before")
    )
    inside = Window.partitionBy("_range").orderBy(column)
    return (
        ranged.withColumn("_row", F.row_number().over(inside) - 1)
        .join(F.broadcast(before), "_range")
        .withColumn(index, F.col("_before") + F.col("_row"))
        .drop("_range", "_row", "_before")
    )
