"""Column expressions over task identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_name(task_id: Column) -> Column:
    return F.regexp_extract(task_id, r"([^/]*)/*$", 1)


def path_stem(task_id: Column) -> Column:
    """Last path component without its final extension."""
    return F.regexp_replace(path_name(task_id), r"(?<=.)\.[^.]+$", "")


def parent_name(task_id: Column) -> Column:
    return F.regexp_extract(task_id, r"([^/]*)/+[^/]*/*$", 1)


def seed_in_name(task_id: Column) -> Column:
    return F.nullif(F.regexp_extract(path_stem(task_id), r"seed(\d+)", 1), F.lit("")).cast("bigint")


def task_attributes(df: DataFrame) -> DataFrame:
    """Seed, game id, parent folder, and world task, variation and simplification of world task ids.

    World ids are ``scienceworld://task/variation/simplification`` or ``task:variation:simplification``;
    missing parts default to variation 0 and simplification ``easy``.
    """
    task = F.trim(F.col("task_id"))
    remote = F.startswith(task, F.lit("scienceworld://"))
    parts = F.when(remote, F.split(F.regexp_replace(task, "^scienceworld://", ""), "/")).otherwise(
        F.split(task, ":")
    )
    return df.select(
        "*",
        seed_in_name(F.col("task_id")).alias("inferred_seed"),
        path_stem(F.col("task_id")).alias("stem"),
        parent_name(F.col("task_id")).alias("parent"),
        F.get(parts, 0).alias("world_task"),
        F.coalesce(F.get(parts, 1).try_cast("int"), F.lit(0)).alias("world_variation"),
        F.coalesce(F.get(parts, 2), F.lit("easy")).alias("world_simplification"),
    )
