"""Dataset builders over trajectories, preferences and replay evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlens.functions.actions import bound, judged_actions, judged_penalty, normalize_action, penalty_terms, rank_pool
from trajlens.functions.ranks import rank_of, safe_div, step_candidates_strict
from trajlens.functions.spread import global_index, hash_text, salted_lookup
from trajlens.functions.tasks import parent_name, path_stem, seed_in_name

STEP = ["task_id", "seed", "step_index"]
SPLIT_KEYS = ("seed", "game_id", "config_id", "trajectory_id", "task_id")


def optional(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


# ---------------------------------------------------------------- retention of right first candidates

def retention_labels(steps: DataFrame, include_failed: bool = False) -> DataFrame:
    """Steps with ``skip``: why they are no retention record, NULL when they are one."""
    before = optional(steps, "candidates_before", "array<string>")
    rows = steps.withColumn("candidates", step_candidates_strict(before, F.col("candidates")))
    first = F.get("candidates", 0)
    skip = (
        F.when(~F.coalesce(F.col("success"), F.lit(False)) & F.lit(not include_failed), "failed_trajectory")
        .when(F.col("gold_action").isNull(), "no_gold_action")
        .when(F.size("candidates") == 0, "no_candidates")
        .when(first != F.col("gold_action"), "gold_not_raw_top1")
        .when(F.size("candidates") < 2, "single_candidate")
        .when(F.coalesce(F.col("action"), F.lit("")) != F.col("gold_action"), "selected_not_gold")
        .when(F.size(F.array_remove("candidates", F.col("gold_action"))) == 0, "single_candidate")
    )
    return rows.withColumn("skip", skip)


def retention_dataset(steps: DataFrame, include_failed: bool = False, max_records: int | None = None) -> DataFrame:
    """Steps whose raw first candidate was gold and was executed; ``ord`` fixes which come first under a cap."""
    gold = F.col("gold_action")
    rejected = F.get(F.array_remove("candidates", gold), 0)
    keep = [name for name in ("trajectory_id", "game_seed", "history", "ord") if name in steps.columns]
    records = (
        retention_labels(steps, include_failed)
        .filter("skip is null")
        .select(
            *STEP,
            *keep,
            "candidates",
            F.size("candidates").alias("candidate_count"),
            gold.alias("preferred_action"),
            normalize_action(gold).alias("preferred_action_norm"),
            rejected.alias("rejected_action"),
            normalize_action(rejected).alias("rejected_action_norm"),
            F.lit(1).alias("preferred_rank_before"),
            rank_of(F.col("candidates"), rejected).alias("rejected_rank_before"),
            F.lit("success_policy_retention").alias("source"),
            F.lit("K1_success_policy_gold").alias("certificate_level"),
            F.lit("success").alias("original_outcome"),
            F.lit(True).alias("retention_target"),
        )
    )
    return records if max_records is None else records.orderBy("ord", "step_index").limit(max_records)


def retention_summary(steps: DataFrame, include_failed: bool = False, max_records: int | None = None) -> DataFrame:
    """Counts per skip reason; with a cap, over the rows up to the last record kept."""
    rows = retention_labels(steps, include_failed)
    everything = rows
    if max_records is not None:
        last = (
            rows.filter("skip is null").select(F.struct("ord", "step_index").alias("place"))
            .orderBy("place").limit(max_records).agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("place"))
            .select(F.when(F.col("n") == max_records, F.col("place")))
        )
        cut = last.scalar()
        rows = rows.filter(cut.isNull() | (F.struct("ord", "step_index") <= cut))
    reasons = ("failed_trajectory", "no_gold_action", "no_candidates", "gold_not_raw_top1", "single_candidate", "selected_not_gold")

    def per_trajectory(df: DataFrame) -> DataFrame:
        return df.groupBy("trajectory_id").agg(
            F.bool_or(F.coalesce("success", F.lit(False))).alias("won"),
            F.count_if(F.coalesce(F.col("skip"), F.lit("")) != "failed_trajectory").alias("considered"),
            F.count_if(F.col("skip").isNull()).alias("records"),
            *[F.count_if(F.col("skip") == reason).alias(reason) for reason in reasons],
        )

    def all_ids(df: DataFrame) -> Column:
        return df.select("trajectory_id").distinct().agg(F.count(F.lit(1))).scalar()

    return per_trajectory(rows).agg(
        F.count_if("won").alias("success_trajectories"),
        F.count_if(~F.col("won")).alias("failed_trajectories"),
        F.sum("considered").alias("considered_steps"),
        F.sum("records").alias("retention_records"),
        *[F.sum(reason).alias(f"skipped_{reason}") for reason in reasons],
    ).select(
        (F.col("success_trajectories") + F.col("failed_trajectories") if max_records is None else all_ids(everything)).alias("trajectories"),
        "*",
    )


# ---------------------------------------------------------------- soft targets from branch replay

def replay_value_targets(
    preferences: DataFrame, multiplicity: DataFrame, preferred_reward: float = 1.0, success_base: float = 0.55,
    success_bonus: float = 0.45, rejected_cap: float = 0.20,
) -> DataFrame:
    """Reward per candidate from the suffix length of its successful branch."""
    branches = multiplicity.select(*STEP, "successful_actions", "successful_suffix_lens")
    rows = preferences.join(branches, STEP, "left")
    pairs = F.arrays_zip("successful_actions", "successful_suffix_lens")

    def reward(action: Column) -> Column:
        same = F.filter(pairs, lambda p: normalize_action(p["successful_actions"]) == normalize_action(action))
        length = F.array_min(F.transform(same, lambda p: p["successful_suffix_lens"]))
        value = F.coalesce(F.lit(success_base) + F.lit(success_bonus) / (F.lit(1.0) + length), F.lit(0.0))
        preferred = action == F.col("preferred_action")
        return (
            F.when(preferred, F.greatest(value, F.lit(preferred_reward)))
            .when(action == F.col("rejected_action"), F.least(value, F.lit(rejected_cap)))
            .otherwise(value)
        )

    actions = F.array_distinct("candidates")
    rewards = F.map_from_arrays(actions, F.transform(actions, reward))
    return (
        rows.withColumn("candidate_rewards", rewards)
        .withColumn(
            "replay_value_successful_candidates",
            F.size(
                F.map_filter(
                    "candidate_rewards",
                    lambda action, value: (value > 0) & (action != F.col("rejected_action")),
                )
            ),
        )
        .drop("successful_actions", "successful_suffix_lens")
    )


def replay_value_summary(records: DataFrame) -> DataFrame:
    positive = F.size(F.filter(F.map_values("candidate_rewards"), lambda value: value > 0))
    return records.agg(
        F.count(F.lit(1)).alias("records"),
        F.count("candidate_rewards").alias("records_with_values"),
        F.count_if(positive > 1).alias("records_with_multiple_positive_values"),
    ).withColumn(
        "multiple_positive_rate",
        safe_div(F.col("records_with_multiple_positive_values"), F.col("records_with_values")),
    )


# ---------------------------------------------------------------- observation context

def attach_context(preferences: DataFrame, observations: DataFrame) -> DataFrame:
    """Add the initial and the current observation from an observation log.

    ``observations`` holds (task_id, seed, step_index, observation, valid), unique on the step key; step 0 is
    the initial one. The initial rows are one per (task, seed), so both lookups are equi-joins on fine keys.
    """
    start = observations.filter("step_index = 0").select("task_id", "seed", F.col("observation").alias("initial_observation"))
    here = observations.select(*STEP, "observation", F.col("valid").alias("_valid"))
    return (
        preferences.join(start, ["task_id", "seed"], "left")
        .join(here, STEP, "left")
        .withColumn("replay_context_valid", F.coalesce("_valid", F.lit(False)))
        .withColumn("observation", F.when(F.col("replay_context_valid"), F.col("observation")))
        .drop("_valid")
    )


def context_summary(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        F.count(F.lit(1)).alias("records"),
        F.count(F.lit(1)).alias("enriched"),
        F.count_if(~F.col("replay_context_valid")).alias("replay_context_errors"),
    )


# ---------------------------------------------------------------- policy targets over logged states

def shaped_rewards(
    candidates: Column, policy: Column, history: Column, objective: Column, gold_reward: float, suffix_reward: float,
    **penalties: float,
) -> Column:
    """Map candidate → reward: discounted place in the policy, gold bonus, minus structural penalties."""
    judged = judged_actions(candidates, history, objective, penalty_terms(**penalties))

    def rewards(reverse: Column) -> Column:
        def reward(item: Column) -> Column:
            place = F.size(reverse) - F.nullif(F.array_position(reverse, item["action"]), F.lit(0)) + 1
            return (
                F.coalesce(F.lit(suffix_reward) / place, F.lit(0.0))
                + F.when(item["action"] == F.get(reverse, F.size(reverse) - 1), gold_reward).otherwise(0.0)
                - judged_penalty(item, **penalties)
            )

        return F.transform(judged, reward)

    return F.map_from_arrays(candidates, bound(F.reverse(policy), rewards))


def online_policy_states(states: DataFrame, pool_limit: int, max_depth: int, force_gold: bool) -> DataFrame:
    """Logged states with their candidate pool and ``skip`` reason (NULL for usable ones).

    ``states``: trajectory_id, step key, history, admissible, policy, done, valid. Steps after the first done
    state of a trajectory are dropped, the done state itself is counted once.
    """
    place = Window.partitionBy("trajectory_id").orderBy("step_index")
    earlier = F.max(F.col("done").cast("int")).over(place.rowsBetween(Window.unboundedPreceding, -1))
    rows = states.withColumn("_over", F.coalesce(earlier, F.lit(0))).filter("_over = 0").drop("_over")
    gold = F.get("policy", 0)
    pool = F.slice(rank_pool(F.col("admissible"), F.col("history"), F.lit("")), 1, pool_limit)
    rows = rows.withColumn("_pool", pool)
    absent = ~F.array_contains("_pool", gold)
    with_gold = F.concat(F.slice(F.col("_pool"), F.lit(1), F.lit(pool_limit - 1)), F.array(gold))
    candidates = F.array_distinct(F.when(absent & F.lit(force_gold), with_gold).otherwise(F.col("_pool")))
    rows = rows.withColumn("candidates", F.when(F.size("policy") > 0, candidates).otherwise(F.col("_pool")))
    skip = (
        F.when(F.col("done"), "done_prefix")
        .when(~F.col("valid"), "invalid_replay")
        .when(F.size("policy") == 0, "no_policy")
        .when(absent & F.lit(not force_gold), "gold_absent")
        .when(F.size("candidates") < 2, "single_candidate")
    )
    return rows.withColumn("skip", skip).withColumn("policy", F.slice("policy", 1, max_depth)).drop("_pool")


def online_policy_records(
    states: DataFrame, pool_limit: int = 40, max_depth: int = 5, force_gold: bool = False, gold_reward: float = 2.0,
    suffix_reward: float = 0.8, max_trajectories: int | None = None, max_records: int | None = None, **penalties: float,
) -> DataFrame:
    """Candidate pools with shaped rewards; ``force_gold`` puts gold into a pool that lacks it.

    ``max_trajectories`` and ``max_records`` take the first ones by ``ord`` (of a trajectory its smallest) and step.
    """
    if max_trajectories is not None:
        first = states.groupBy("trajectory_id").agg(F.min("ord").alias("_first")).orderBy("_first", "trajectory_id").limit(max_trajectories)
        states = states.join(first.select("trajectory_id"), "trajectory_id", "left_semi")
    rows = online_policy_states(states, pool_limit, max_depth, force_gold).filter("skip is null")
    if max_records is not None:
        rows = rows.orderBy("ord", "trajectory_id", "step_index").limit(max_records)
    gold = F.get("policy", 0)
    objective = F.coalesce(optional(states, "objective", "string"), F.lit(""))
    rejected = F.get(F.array_remove("candidates", gold), 0)
    return rows.select(
        "trajectory_id",
        *STEP,
        "history",
        "candidates",
        F.size("candidates").alias("candidate_count"),
        gold.alias("preferred_action"),
        rejected.alias("rejected_action"),
        rank_of(F.col("candidates"), gold).alias("preferred_rank_before"),
        rank_of(F.col("candidates"), rejected).alias("rejected_rank_before"),
        shaped_rewards(
            F.col("candidates"), F.col("policy"), F.col("history"), objective, gold_reward, suffix_reward, **penalties
        ).alias("candidate_rewards"),
        F.col("policy").alias("policy_suffix"),
        F.lit("online_policy_suffix_reward").alias("source"),
        F.lit("K2_policy_suffix_online_pool").alias("certificate_level"),
    )


def online_policy_summary(states: DataFrame, pool_limit: int = 40, max_depth: int = 5, force_gold: bool = False) -> DataFrame:
    rows = online_policy_states(states, pool_limit, max_depth, force_gold)
    used = F.col("skip").isNull()
    rank = F.when(used, rank_of(F.col("candidates"), F.get("policy", 0)))
    reasons = ("done_prefix", "invalid_replay", "no_policy", "gold_absent", "single_candidate")
    per_trajectory = rows.groupBy("trajectory_id").agg(
        F.count_if(used).alias("records"),
        F.coalesce(F.sum(rank), F.lit(0)).alias("rank_sum"),
        F.count_if(rank == 1).alias("top1"),
        *[F.count_if(F.col("skip") == reason).alias(reason) for reason in reasons],
    )
    return per_trajectory.agg(
        F.count(F.lit(1)).alias("trajectories"),
        *[F.sum(name).alias(name) for name in ("records", "rank_sum", "top1", *reasons)],
    ).select(
        "trajectories",
        "records",
        safe_div(F.col("rank_sum"), F.col("records")).alias("avg_gold_rank"),
        safe_div(F.col("top1"), F.col("records")).alias("gold_top1_rate"),
        *[F.col(reason).alias(f"skipped_{reason}") for reason in reasons],
    )


# ---------------------------------------------------------------- group-safe splits

def group_key(df: DataFrame, split_by: str) -> Column:
    """Group text of a record; empty values and seed zero count as missing."""
    def text(name: str) -> Column:
        return F.nullif(optional(df, name, "string"), F.lit(""))

    task = F.coalesce(optional(df, "task_id", "string"), F.lit(""))
    seed = F.coalesce(optional(df, "seed", "bigint"), F.lit(0))
    nonzero = [F.nullif(optional(df, "game_seed", "bigint"), F.lit(0).cast("bigint")), F.nullif(seed_in_name(task), F.lit(0).cast("bigint"))]
    if split_by == "seed":
        return F.coalesce(*nonzero, seed).cast("string")
    if split_by == "game_id":
        return F.coalesce(text("game_id"), path_stem(task))
    if split_by == "config_id":
        return F.coalesce(text("config_id"), text("difficulty"), F.nullif(parent_name(task), F.lit("")), F.lit("default"))
    if split_by == "trajectory_id":
        game = F.coalesce(text("game_id"), path_stem(task))
        return F.coalesce(text("trajectory_id"), F.concat(game, F.lit(":seed"), seed.cast("string")))
    if split_by == "task_id":
        return task
    raise ValueError(f"unknown split key: {split_by}")


def assign_groups(groups: DataFrame, fractions: tuple[float, float, float], seed: int) -> DataFrame:
    """Split name per distinct group: test, valid, train over the hash order, with exact counts."""
    if min(fractions) < 0:
        raise ValueError("split fractions must be non-negative")
    if not 0.999 <= sum(fractions) <= 1.001:
        raise ValueError("split fractions must sum to 1.0")
    _train, valid_share, test_share = fractions
    numbered = global_index(groups, hash_text(F.lit(f"{seed}:"), F.col("split_group")), F.col("split_group"))
    total = F.col("_total")

    def rounded(share: float) -> Column:
        return F.bround(total * F.lit(float(share))).cast("bigint")

    test = F.when((F.lit(test_share) > 0) & (rounded(test_share) == 0), 1).otherwise(rounded(test_share))
    valid = F.when(
        (F.lit(valid_share) > 0) & (rounded(valid_share) == 0) & (total - test > 1), 1
    ).otherwise(rounded(valid_share))
    # At least one training group: valid gives way first, then test.
    over = F.greatest(test + valid - (total - 1), F.lit(0))
    valid_left = F.greatest(valid - over, F.lit(0))
    test_left = F.greatest(test - F.greatest(over - valid, F.lit(0)), F.lit(0))
    index = F.col("_index")
    return numbered.select(
        "split_group",
        F.when(total <= 1, "train")
        .when(index < test_left, "test")
        .when(index < test_left + valid_left, "valid")
        .otherwise("train")
        .alias("split"),
    )


def make_splits(
    df: DataFrame, split_by: str = "seed", fractions: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 0,
    spread_by: list[str] | None = None,
) -> DataFrame:
    """Add ``split_group`` and ``split``. A group may hold any share of the records: the lookup is salted."""
    rows = df.withColumn("split_group", group_key(df, split_by))
    groups = assign_groups(rows.select("split_group").distinct(), fractions, seed)
    return salted_lookup(rows, groups, ["split_group"], spread_by or STEP, how="inner")


def split_summary(splits: DataFrame) -> DataFrame:
    """Records and groups per split; ``leaking_groups`` counts groups seen in more than one split."""
    per_group = splits.groupBy("split_group", "split").agg(F.count(F.lit(1)).alias("n"))
    marked = per_group.groupBy("split_group").agg(
        F.count(F.lit(1)).alias("splits"), F.collect_list(F.struct("split", "n")).alias("parts")
    )
    # At most three parts per group: one per split.
    return (
        marked.select("splits", F.inline("parts"))
        .groupBy("split")
        .agg(
            F.sum("n").alias("records"),
            F.count(F.lit(1)).alias("groups"),
            F.count_if(F.col("splits") > 1).alias("leaking_groups"),
        )
    )


def assert_no_leakage(splits: DataFrame) -> None:
    """Raise when a group occurs in two splits (intersections of the group sets must be empty)."""
    sets = {
        name: splits.filter(F.col("split") == name).select("split_group") for name in ("train", "valid", "test")
    }
    names = sorted(sets)
    for number, left in enumerate(names):
        for right in names[number + 1 :]:
            shared = sets[left].intersect(sets[right])
            sample = shared.take(3)
            if sample:
                raise ValueError(f"group leakage between {left} and {right}: {[row[0] for row in sample]}")
