"""Cluster bootstrap by sufficient statistics.

Step rows are reduced to one row of additive counts per cluster first. The replicates then work on those
rows only, and every metric is computed from the weighted sums of a replicate.
"""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlens.functions.ranks import ratio_or_null, safe_div
from trajlens.functions.spread import global_index, hash_draw, hash_text
from trajlens.operators.ledger import decomposition_metrics, decomposition_stats
from trajlens.operators.ranking import evaluate_ranking, ranking_sums
from trajlens.session import ship_package, store

DECOMPOSITION_METRICS = (
    "certified_misranking_step_rate",
    "candidate_absent_step_rate",
    "repair_same_as_executed_step_rate",
    "no_repair_found_step_rate",
    "avg_preferred_rank_on_certified_preferences",
)
# Cumulative Poisson(1) probabilities; twelve terms exceed the 32-bit resolution of the draw.
POISSON_STEPS = tuple(math.exp(-1.0) * sum(1.0 / math.factorial(i) for i in range(k + 1)) for k in range(12))

#: Clusters that are drawn from in one place.
BUCKET_CLUSTERS = 128


def cluster_id() -> Column:
    return F.concat(F.col("task_id"), F.lit(":seed"), F.col("seed").cast("string"))


def poisson_weights(clusters: DataFrame, iterations: int, seed: int) -> DataFrame:
    """Rows (replicate, weight, statistics): an independent Poisson(1) count per cluster, from a hash of its id.

    Counts come from a uniform number of 32 bits and stop at twelve.
    """
    # A cluster row is small but stands for ``iterations`` draws: spread rows evenly before multiplying them.
    tasks = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limits = F.array(*[F.lit(limit) for limit in POISSON_STEPS])

    def draw(replicate: Column) -> Column:
        text = F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), F.col("cluster"))
        uniform = hash_draw(text, F.lit(2**32)) / F.lit(float(2**32))
        # The one-item array makes the hash a bound value, computed once per draw.
        count = F.transform(F.array(uniform), lambda u: F.size(F.filter(limits, lambda limit: limit <= u)))
        return F.struct(replicate.alias("replicate"), F.get(count, 0).alias("weight"))

    draws = F.transform(F.sequence(F.lit(0), F.lit(iterations - 1)), draw)
    return clusters.repartition(tasks, "cluster").select("*", F.inline(F.filter(draws, lambda d: d["weight"] > 0)))


def _binomial(text: Column, trials: Column, part: Column, whole: Column) -> Column:
    """How many of ``trials`` fall into the first ``part`` of ``whole`` equally likely places.

    Each trial is a uniform number whose binary digits are drawn only until it differs from part / whole: about
    two bits a trial, sixty from one hash. Trials still open after 62 digits (one in 2^62) count as outside.
    """
    def ones(count: Column, digit: Column) -> Column:
        def word(total: Column, at: Column) -> Column:
            bits = F.conv(F.substring(F.md5(F.concat_ws(":", text, digit, at)), 1, 15), 16, 10).cast("bigint")
            left = count - at * 60
            used = F.when(left >= 60, bits).otherwise(bits.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), left.cast("int")) - 1))
            return total + F.bit_count(used)

        words = F.sequence(F.lit(0).cast("bigint"), F.floor((count - 1) / 60).cast("bigint"))
        return F.aggregate(words, F.lit(0), word).cast("bigint")

    def step(held: Column, digit: Column) -> Column:
        twice = held["rest"] * 2
        inside = twice >= whole
        rest = F.when(inside, twice - whole).otherwise(twice)
        decided = F.transform(
            F.array(ones(held["open"], digit)),
            lambda k: F.struct(
                F.when(rest == 0, F.lit(0).cast("bigint")).when(inside, k).otherwise(held["open"] - k).alias("open"),
                (held["won"] + F.when(inside, held["open"] - k).otherwise(0)).alias("won"), rest.alias("rest"),
            ),
        )
        return F.when(held["open"] == 0, held).otherwise(F.get(decided, 0))

    start = F.struct(trials.cast("bigint").alias("open"), F.lit(0).cast("bigint").alias("won"), part.cast("bigint").alias("rest"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(61)), start, step, lambda held: held["won"])


def bucket_draws(spark: SparkSession, clusters: int, levels: int, iterations: int, seed: int) -> DataFrame:
    """``replicate, bucket, draws``: how many of a replicate's draws fall into each of 2^levels ranges of clusters.

    The draws are split down a binary tree: at a node the left child gets a binomial share by its number of clusters. A
    node's share depends on seed, replicate and node only, so this needs no data but the number of clusters.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(0, iterations, 1, tasks).select(
        F.col("id").cast("int").alias("replicate"), F.lit(0).cast("bigint").alias("bucket"), F.lit(clusters).cast("bigint").alias("draws")
    )
    for level in range(levels):
        def edge(at: Column, depth: int) -> Column:
            return F.shiftright(at * clusters, depth)

        here = F.col("bucket")
        low, middle, high = edge(here, level), edge(here * 2 + 1, level + 1), edge(here + 1, level)
        text = F.concat_ws(":", F.lit(f"{seed}:split"), "replicate", F.lit(level), here)
        split = rows.withColumn("_left", _binomial(text, F.col("draws"), middle - low, high - low))
        rows = split.select("replicate", F.inline(F.array(
            F.struct((here * 2).alias("bucket"), F.col("_left").alias("draws")),
            F.struct((here * 2 + 1).alias("bucket"), (F.col("draws") - F.col("_left")).alias("draws")),
        )))
    return rows


def _sums_of_draws(statistics: dict[str, str], iterations: int, seed: int):
    """Draws of whole buckets and their sums per replicate; a task keeps one row of sums per replicate, whatever it reads."""
    dtypes = [np.int64 if kind == "bigint" else np.float64 for kind in statistics.values()]

    def run(batches):
        totals = [np.zeros(iterations, dtype) for dtype in dtypes]
        seen = [np.zeros(iterations, np.int64) for _ in dtypes]
        places: list[bytes] = []
        buckets = 0
        for batch in batches:
            buckets += batch.num_rows
            for row in range(batch.num_rows):
                bucket = batch.column("bucket")[row].as_py()
                items, draws = batch.column("items")[row].values, batch.column("draws")[row].values
                replicates, counts = draws.field("replicate").to_numpy(), draws.field("draws").to_numpy()
                places += [b"%d" % n for n in range(len(places), int(counts.max()))]
                found = bytearray()
                for replicate, count in zip(replicates.tolist(), counts.tolist(), strict=True):
                    start = b"%d:%d:%d:" % (seed, replicate, bucket)
                    found += b"".join([md5(start + place).digest() for place in places[:count]])
                # The first 60 bits of each digest, as in :func:`hash_draw`.
                drawn = (np.frombuffer(found, ">u8")[::2] >> np.uint64(4)) % np.uint64(len(items))
                cell = np.repeat(np.arange(len(counts)), counts) * len(items) + drawn.astype(np.int64)
                weights = np.bincount(cell, minlength=len(counts) * len(items)).reshape(len(counts), len(items))
                for name, dtype, total, known in zip(statistics, dtypes, totals, seen, strict=True):
                    column = items.field(name)
                    total[replicates] += weights @ column.fill_null(0).to_numpy(zero_copy_only=False).astype(dtype)
                    known[replicates] += weights @ column.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
        if not buckets:
            return
        arrays = [pa.array(total, mask=known == 0) for total, known in zip(totals, seen, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(iterations, dtype=np.int32)), *arrays], ["replicate", *statistics])

    return run


def multinomial_sums(clusters: DataFrame, iterations: int, seed: int, capacity: int = BUCKET_CLUSTERS) -> DataFrame:
    """Sums per replicate over exactly n draws with replacement among n clusters.

    Clusters are numbered and kept in buckets of at most ``capacity``; how many draws a bucket gets comes from
    :func:`bucket_draws`, and the draws are made where the bucket's clusters are. What is shuffled is one small row per bucket and
    replicate, and one row of sums per task and replicate; single draws are never rows. Statistics are whole numbers or doubles.
    """
    ship_package(clusters.sparkSession)
    whole = ("tinyint", "smallint", "int", "bigint")
    statistics = {name: "bigint" if kind in whole else "double" for name, kind in clusters.dtypes if name != "cluster"}
    numbered = store(global_index(clusters, hash_text(F.col("cluster")), F.col("cluster")))
    count = numbered.count()
    levels = max(0, math.ceil(math.log2(max(count, 1) / capacity)))
    # At most ``capacity`` small rows in an array.
    buckets = numbered.select(
        F.expr(f"((_index + 1) * {1 << levels} - 1) div {max(count, 1)}").alias("bucket"),
        F.struct("_index", *[F.col(name).cast(kind).alias(name) for name, kind in statistics.items()]).alias("item"),
    ).groupBy("bucket").agg(F.array_sort(F.collect_list("item")).alias("items"))
    # At most one pair of numbers per replicate in an array.
    drawn = bucket_draws(clusters.sparkSession, count, levels, iterations, seed).where("draws > 0").groupBy("bucket").agg(
        F.collect_list(F.struct("replicate", "draws")).alias("draws")
    )
    # Buckets are few bytes but much work: the number of tasks is given.
    tasks = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = buckets.join(drawn, "bucket").repartition(min(tasks, 1 << levels), "bucket")
    schema = ", ".join(["replicate int", *[f"`{name}` {kind}" for name, kind in statistics.items()]])
    sums = rows.mapInArrow(_sums_of_draws(statistics, iterations, seed), schema)
    return sums.groupBy("replicate").agg(*[F.sum(name).alias(name) for name in statistics])


def replicate_sums(clusters: DataFrame, iterations: int, seed: int, method: str) -> DataFrame:
    """Sums of all statistics per replicate; replicate -1 is the table as it is.

    ``multinomial`` draws exactly n clusters with replacement per replicate; ``poisson`` gives each cluster an independent
    Poisson(1) count.
    """
    statistics = [name for name in clusters.columns if name != "cluster"]
    if method == "multinomial":
        drawn = multinomial_sums(clusters, iterations, seed)
    elif method == "poisson":
        drawn = poisson_weights(clusters, iterations, seed).groupBy("replicate").agg(
            *[F.sum(F.col("weight") * F.col(name)).alias(name) for name in statistics]
        )
    else:
        raise ValueError(f"unknown bootstrap method: {method}")
    original = clusters.agg(*[F.sum(name).alias(name) for name in statistics])
    return original.select(F.lit(-1).alias("replicate"), *statistics).unionByName(drawn)


def intervals(sums: DataFrame, metrics: dict[str, Column], null_as_zero: bool) -> DataFrame:
    """One row per metric: point value and linearly interpolated 95 % bounds over the replicates."""
    values = sums.select("replicate", *[column.alias(name) for name, column in metrics.items()])
    drawn = F.col("replicate") >= 0

    def sample(name: str) -> Column:
        value = F.coalesce(F.col(name), F.lit(0.0)) if null_as_zero else F.col(name)
        return F.when(drawn, value)

    def point(name: str) -> Column:
        value = F.max(F.when(~drawn, F.col(name)))
        return F.coalesce(value, F.lit(0.0)) if null_as_zero else value

    total = values.agg(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                point(name).alias("point"),
                F.percentile(sample(name), 0.025).alias("ci_low"),
                F.percentile(sample(name), 0.975).alias("ci_high"),
            ).alias(name)
            for name in metrics
        ]
    )
    return total.select(F.inline(F.array(*[F.col(name) for name in metrics])))


def _ranking_statistics(records: DataFrame) -> DataFrame:
    return records.withColumn("cluster", cluster_id()).groupBy("cluster").agg(*ranking_sums())


def bootstrap_metrics(
    ledger: DataFrame, preferences: DataFrame, iterations: int = 1000, seed: int = 0, method: str = "multinomial"
) -> DataFrame:
    """Intervals of the decomposition rates and of the raw and oracle ranking, over (task, seed) clusters."""
    counts = decomposition_stats(
        ledger.withColumn("cluster", cluster_id()), preferences.withColumn("cluster", cluster_id()), ["cluster"]
    )
    ranking = _ranking_statistics(evaluate_ranking(preferences)).select("cluster", "n", "found", "raw_rr", "raw_gain")
    both = counts.unionByName(ranking, allowMissingColumns=True)
    clusters = both.groupBy("cluster").agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in both.columns if name != "cluster"]
    )
    all_metrics = decomposition_metrics()
    metrics = {name: all_metrics[name] for name in DECOMPOSITION_METRICS}
    metrics |= {
        "raw_mrr": safe_div(F.col("raw_rr"), F.col("n")),
        "oracle_mrr": safe_div(F.col("found"), F.col("n")),
        "raw_ndcg": safe_div(F.col("raw_gain"), F.col("n")),
        "oracle_ndcg": safe_div(F.col("found"), F.col("n")),
    }
    return intervals(replicate_sums(clusters, iterations, seed, method), metrics, null_as_zero=True)


def bootstrap_ranking(
    preferences: DataFrame, predictions: DataFrame, iterations: int = 1000, seed: int = 0,
    method: str = "multinomial",
) -> DataFrame:
    """Intervals of raw and learned ranking; replicates without a value are left out of that metric."""
    clusters = _ranking_statistics(evaluate_ranking(preferences, predictions))
    metrics = {
        "raw_mrr": safe_div(F.col("raw_rr"), F.col("n")),
        "learned_mrr": ratio_or_null(F.col("learned_rr"), F.col("active")),
        "raw_ndcg": safe_div(F.col("raw_gain"), F.col("n")),
        "learned_ndcg": ratio_or_null(F.col("learned_gain"), F.col("active")),
        "learned_top1_correction_rate": ratio_or_null(F.col("learned_top"), F.col("active")),
        "learned_abstain_rate": ratio_or_null(F.col("abstained"), F.col("predicted")),
    }
    return intervals(replicate_sums(clusters, iterations, seed, method), metrics, null_as_zero=False)


def nearest_quantile(values: Column, q: float) -> Column:
    """Item at round-half-even(q·(n−1)) of the sorted array."""
    place = F.bround(F.lit(q) * (F.size(values) - 1)).cast("int")
    return F.get(F.array_sort(values), place)


def bootstrap_delta(pairs: DataFrame, iterations: int = 1000, seed: int = 0, method: str = "multinomial") -> DataFrame:
    """Nearest-rank 95 % bounds of the mean success difference; ``pairs`` is unique on task_id."""
    clusters = pairs.select(
        F.col("task_id").alias("cluster"),
        F.lit(1).alias("n"),
        (F.col("treatment_success") - F.col("baseline_success")).alias("delta"),
    )
    sums = replicate_sums(clusters, iterations, seed, method)
    # One value per replicate, so the array holds ``iterations`` numbers.
    value = F.col("delta") / F.nullif(F.col("n"), F.lit(0).cast("bigint"))
    return sums.agg(
        F.max(F.when(F.col("replicate") < 0, value)).alias("success_delta"),
        F.collect_list(F.when(F.col("replicate") >= 0, value)).alias("values"),
    ).select(
        "success_delta",
        nearest_quantile(F.col("values"), 0.025).alias("ci_low"),
        nearest_quantile(F.col("values"), 0.975).alias("ci_high"),
    )
