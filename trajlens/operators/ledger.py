"""Certification of repairs and the complete step ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlens.functions.actions import normalize_action
from trajlens.functions.ranks import (
    STATUSES,
    certificate_level,
    rank_of,
    ratio_or_null,
    safe_div,
    status_reason,
    step_candidates,
)

STEP = ["task_id", "seed", "step_index"]
STATUS_COLUMNS = {
    "certified_preference": "num_certified_preferences",
    "repair_not_in_candidates": "num_candidate_absent",
    "no_repair_found": "num_no_repair_found",
    "repair_same_as_executed": "num_repair_same_as_executed",
    "suffix_too_long": "num_suffix_too_long",
    "invalid_replay": "num_invalid_replay",
    "no_candidates_logged": "num_no_candidates_logged",
}


def with_history(steps: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Add the executed actions before each step; an episode is bounded, so its window is too.

    Empty and missing actions are left out, as compiling does; the retention and online policy builders count every step,
    so they want them kept, as empty texts.
    """
    before = Window.partitionBy("trajectory_id").orderBy("step_index").rowsBetween(
        Window.unboundedPreceding, -1
    )
    action = F.coalesce("action", F.lit("")) if keep_empty else F.nullif("action", F.lit(""))
    return steps.withColumn("history", F.collect_list(action).over(before))


def latest_reports(edits: DataFrame) -> DataFrame:
    """Edits of the last report per (task, seed), by ``report_ord``."""
    last = edits.groupBy("task_id", "seed").agg(F.max("report_ord").alias("report_ord"))
    return edits.join(last, ["task_id", "seed", "report_ord"], "left_semi")


def first_repairs(edits: DataFrame) -> DataFrame:
    """Best certified repair per step.

    Shortest suffix first, then edit type, then action text, then report order. The choice is a minimum over
    a struct, so partial results combine before the shuffle.
    """
    labels, suffix = F.col("labels"), F.col("repair_suffix")
    is_policy = (
        (F.col("edit_type") == "policy_suffix")
        & F.array_contains(labels, "policy_repair_candidate")
        & (F.size(suffix) > 0)
    )
    is_branch = (
        (F.col("edit_type") == "candidate_policy_suffix")
        & F.array_contains(labels, "candidate_policy_repair")
        & F.col("replacement").isNotNull()
    )
    is_match = (
        (F.col("edit_type") == "suffix_match_policy")
        & F.array_contains(labels, "suffix_match_repair")
        & F.col("replacement").isNotNull()
    )
    kind = F.when(is_policy, "policy").when(is_branch, "branch").when(is_match, "match")
    policy = F.col("kind") == "policy"
    action = F.when(policy, F.get("repair_suffix", 0)).otherwise(F.col("replacement"))
    choice = F.struct(
        F.when(policy, F.size(suffix)).otherwise(F.size(suffix) + 1).alias("repair_suffix_len"),
        F.when(F.col("kind") == "branch", 0).when(F.col("kind") == "match", 1).otherwise(2).alias("priority"),
        F.coalesce(normalize_action(action), F.lit("")).alias("norm"),
        F.col("edit_pos"),
        action.alias("repair_action"),
        F.when(policy, "policy_repair_suffix").otherwise(F.col("edit_type")).alias("repair_source"),
        certificate_level(
            F.coalesce(F.col("original_success"), F.lit(False)), F.col("original_len"), F.col("edited_len")
        ).alias("certificate_level"),
        F.nullif("edited_len", F.lit(0)).alias("edited_action_len"),
        F.nullif("original_len", F.lit(0)).alias("original_action_len"),
        F.when(F.coalesce(F.col("success"), F.lit(True)), "success").otherwise("fail").alias("repaired_outcome"),
    )
    return (
        edits.withColumn("kind", kind)
        .filter("kind is not null")
        .withColumn("step_index", F.when(policy, F.col("index") + 1).otherwise(F.col("index")))
        .groupBy(*STEP)
        .agg(F.min(choice).alias("best"))
        .select(
            *STEP,
            *[
                f"best.{name}"
                for name in (
                    "repair_action", "repair_source", "certificate_level", "repair_suffix_len",
                    "edited_action_len", "original_action_len", "repaired_outcome",
                )
            ],
        )
    )


def step_ledger(
    steps: DataFrame, repairs: DataFrame | None = None, source: str = "policy-repair",
    max_suffix: int | None = None,
) -> DataFrame:
    """One row per logged step with its preferred action, ranks and exactly one status.

    Other columns of ``steps`` are kept. Without ``repairs`` only gold actions can certify.
    """
    if source not in ("policy-repair", "gold", "both"):
        raise ValueError(f"unknown preference source: {source}")
    before = F.col("candidates_before") if "candidates_before" in steps.columns else F.lit(None).cast("array<string>")
    rows = steps.withColumn("candidates", step_candidates(before, F.col("candidates"))).withColumn(
        "action", F.coalesce("action", F.lit(""))
    )
    use_repair = source in ("policy-repair", "both") and repairs is not None
    use_gold = source in ("gold", "both")
    found = {
        "repair_action": "string", "repair_source": "string", "certificate_level": "string",
        "repair_suffix_len": "int", "edited_action_len": "int", "original_action_len": "int",
        "repaired_outcome": "string",
    }
    if use_repair:
        rows = rows.join(
            repairs.select(*STEP, *[F.col(name).cast(kind).alias(f"_{name}") for name, kind in found.items()]),
            STEP,
            "left",
        )
    else:
        rows = rows.withColumns({f"_{name}": F.lit(None).cast(kind) for name, kind in found.items()})

    def pick(name: str, gold: Column) -> Column:
        """The repair's value where there is a repair, else the value a gold action stands for."""
        if not use_gold:
            return F.col(f"_{name}")
        other = F.when(F.col("gold_action").isNotNull(), gold)
        return F.when(F.col("_repair_action").isNotNull(), F.col(f"_{name}")).otherwise(other)

    none = F.lit(None).cast("int")
    rows = rows.withColumns(
        {
            "_preferred": pick("repair_action", F.col("gold_action")),
            "_suffix": pick("repair_suffix_len", F.lit(0)),
            "_outcome": pick("repaired_outcome", F.lit("unknown")),
        }
    ).withColumn("_rank", rank_of(F.col("candidates"), F.col("_preferred")))
    preferred, executed, rank = F.col("_preferred"), F.col("action"), F.col("_rank")
    too_long = F.lit(False) if max_suffix is None else F.col("_suffix") > max_suffix
    rows = rows.withColumn(
        "status",
        F.when(F.size("candidates") == 0, "no_candidates_logged")
        .when(preferred.isNull(), "no_repair_found")
        .when(F.col("_outcome") == "fail", "invalid_replay")
        .when(too_long, "suffix_too_long")
        .when(preferred == executed, "repair_same_as_executed")
        .when(rank.isNull(), "repair_not_in_candidates")
        .otherwise("certified_preference"),
    )
    extra = [name for name in steps.columns if name not in ("candidates", "candidates_before", "action", "success")]
    return rows.select(
        *extra,
        "candidates",
        "status",
        executed.alias("executed_action"),
        normalize_action(executed).alias("executed_action_norm"),
        preferred.alias("repair_action"),
        normalize_action(preferred).alias("repair_action_norm"),
        rank.isNotNull().alias("repair_in_candidates"),
        rank.alias("repair_rank_before"),
        rank_of(F.col("candidates"), executed).alias("rejected_rank_before"),
        F.size("candidates").alias("candidate_count"),
        (F.size("candidates") > 0).alias("has_logged_candidates"),
        pick("certificate_level", F.lit("C0_candidate_only")).alias("certificate_level"),
        F.col("_suffix").alias("repair_suffix_len"),
        pick("edited_action_len", none).alias("edited_action_len"),
        pick("original_action_len", none).alias("original_action_len"),
        pick("repair_source", F.lit("gold_action")).alias("source"),
        F.when(F.coalesce(F.col("success"), F.lit(False)), "success").otherwise("fail").alias("original_outcome"),
        F.col("_outcome").alias("repaired_outcome"),
        status_reason(F.col("status")).alias("status_reason"),
    )


def compile_preferences(ledger: DataFrame) -> DataFrame:
    """Certified preferences of a ledger; ``history`` is kept when the ledger carries it."""
    certified = ledger.filter(F.col("status") == "certified_preference")
    keep = [name for name in ("trajectory_id", "history", "game_seed", "rollout", "event_id") if name in ledger.columns]
    return certified.select(
        *STEP,
        *keep,
        "candidates",
        "candidate_count",
        F.col("repair_action").alias("preferred_action"),
        F.col("repair_action_norm").alias("preferred_action_norm"),
        F.col("executed_action").alias("rejected_action"),
        F.col("executed_action_norm").alias("rejected_action_norm"),
        "executed_action",
        "executed_action_norm",
        F.col("repair_rank_before").alias("preferred_rank_before"),
        "rejected_rank_before",
        "original_outcome",
        "repaired_outcome",
        "certificate_level",
        "repair_suffix_len",
        "edited_action_len",
        "original_action_len",
        "source",
    )


def has_candidates() -> Column:
    return F.coalesce(F.col("has_logged_candidates"), F.coalesce(F.col("candidate_count"), F.lit(0)) > 0)


def status_counts_map(count_of) -> Column:
    """Map of the statuses that occur, in name order, from one count column per status."""
    return F.map_filter(
        F.create_map(*[item for name in STATUSES for item in (F.lit(name), count_of(name))]),
        lambda _name, count: count > 0,
    )


#: Fields of a nested ledger row, the step first, since rows are sorted by it.
NESTED_FIELDS = (
    "step_index", "trajectory_id", "task_id", "seed", "status", "executed_action", "executed_action_norm", "repair_action",
    "repair_action_norm", "repair_in_candidates", "repair_rank_before", "rejected_rank_before", "candidate_count",
    "has_logged_candidates", "certificate_level", "repair_suffix_len", "original_outcome", "repaired_outcome", "status_reason",
)


def trajectory_ledger(ledger: DataFrame, trajectories: DataFrame | None = None, nested: bool = True) -> DataFrame:
    """Counters per trajectory, with its whole ledger rows nested; ``trajectories`` adds those without any step."""
    row = F.struct(*[name for name in NESTED_FIELDS if name in ledger.columns])
    counts = [
        F.count_if(F.col("status") == status).alias(name) for status, name in STATUS_COLUMNS.items()
    ]
    steps = [F.array_sort(F.collect_list(row)).alias("step_statuses")] if nested else []
    out = ledger.groupBy("trajectory_id", "task_id", "seed").agg(
        F.min("original_outcome").alias("outcome"),
        F.count(F.lit(1)).alias("num_steps"),
        F.count_if(F.col("candidate_count") > 0).alias("num_candidate_steps"),
        *counts,
        *steps,
    )
    out = out.withColumn("status_counts", status_counts_map(lambda name: F.col(STATUS_COLUMNS[name])))
    if trajectories is None:
        return out
    ids = trajectories.select(
        "trajectory_id", "task_id", "seed",
        F.when(F.coalesce(F.col("success"), F.lit(False)), "success").otherwise("fail").alias("_outcome"),
    )
    joined = ids.join(out, ["trajectory_id", "task_id", "seed"], "left")
    zero = {name: 0 for name in ("num_steps", "num_candidate_steps", *STATUS_COLUMNS.values())}
    joined = joined.withColumn("outcome", F.col("_outcome")).drop("_outcome").fillna(zero)
    empty_counts = F.create_map().cast("map<string,bigint>")
    return joined.withColumn("status_counts", F.coalesce("status_counts", empty_counts))


def preference_summary(preferences: DataFrame) -> DataFrame:
    """Totals plus one row per source and per certificate, in one pass over grouping sets.

    ``tasks`` is exact: rows are first reduced to one per (source, certificate, task).
    """
    per_task = preferences.groupBy("source", "certificate_level", "task_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("preferred_rank_before").alias("rank_sum"),
        F.count("preferred_rank_before").alias("rank_n"),
    )
    sets = per_task.groupingSets(
        [["source"], ["certificate_level"], []], "source", "certificate_level"
    ).agg(
        F.grouping_id().alias("_grouping"),
        F.sum("n").alias("preferences"),
        F.countDistinct("task_id").alias("tasks"),
        safe_div(F.sum("rank_sum"), F.sum("rank_n")).alias("avg_preferred_rank_before"),
    )
    return sets.select(
        F.when(F.col("_grouping") == 1, "source").when(F.col("_grouping") == 2, "certificate").otherwise("all").alias("level"),
        F.coalesce("source", "certificate_level", F.lit("")).alias("value"),
        F.coalesce("preferences", F.lit(0)).alias("preferences"),
        "tasks",
        "avg_preferred_rank_before",
    )


def normalize_step_ledger(ledger: DataFrame) -> DataFrame:
    """Flatten a ledger whose rows may nest their steps in ``step_statuses``.

    As soon as one row is nested, flat rows are ignored; the test is a scalar subquery. Fields missing in a
    nested step are filled from its parent.
    """
    if "step_statuses" not in ledger.columns:
        return ledger
    has_nested = ledger.select(F.coalesce(F.bool_or(F.col("step_statuses").isNotNull()), F.lit(False))).scalar()
    parent = {"trajectory_id": "trajectory_id", "task_id": "task_id", "seed": "seed", "original_outcome": "outcome"}
    inner = ledger.schema["step_statuses"].dataType.elementType
    nested = ledger.filter("step_statuses is not null").select(
        *[F.col(column).alias(f"_{name}") for name, column in parent.items() if column in ledger.columns],
        F.explode("step_statuses").alias("step"),
    )
    columns = []
    for name in dict.fromkeys([*inner.fieldNames(), *parent, "candidate_count"]):
        options = []
        if name in inner.fieldNames():
            options.append(F.col(f"step.{name}"))
        if f"_{name}" in nested.columns:
            options.append(F.col(f"_{name}"))
        if name == "candidate_count":
            options.append(F.lit(0))
        if options:
            columns.append(F.coalesce(*options).alias(name))
    nested = nested.select(*columns)
    flat_only = [name for name in ledger.columns if name not in ("step_statuses", "outcome")]
    flat = ledger.filter("step_statuses is null").filter(~has_nested).select(*flat_only)
    return nested.unionByName(flat, allowMissingColumns=True)


# ---------------------------------------------------------------- failure decomposition

def _status_count(status: str, suffix: str, extra: Column) -> Column:
    return F.count_if((F.col("status") == status) & extra).alias(f"{STATUS_COLUMNS[status]}{suffix}")


def decomposition_stats(ledger: DataFrame, preferences: DataFrame | None, keys: list[str]) -> DataFrame:
    """Additive counts per cluster, over failed rows (``_f``) and over all rows (``_a``).

    Every decomposition metric is a ratio of sums of these columns, so summaries and bootstrap replicates
    never touch step rows again.
    """
    columns = []
    for suffix, extra in (("_f", F.col("original_outcome") == "fail"), ("_a", F.lit(True))):
        certified = (F.col("status") == "certified_preference") & F.col("repair_rank_before").isNotNull() & extra
        columns += [
            F.count_if(extra).alias(f"steps{suffix}"),
            F.count_if(has_candidates() & extra).alias(f"candidate_steps{suffix}"),
            *[_status_count(status, suffix, extra) for status in STATUS_COLUMNS],
            F.count_if(certified).alias(f"rank_n{suffix}"),
            F.sum(F.when(certified, F.col("repair_rank_before")).otherwise(0)).alias(f"rank_sum{suffix}"),
        ]
    out = ledger.groupBy(*keys).agg(*columns)
    if preferences is None:
        return out.withColumn("pref_n", F.lit(0).cast("bigint")).withColumn("pref_sum", F.lit(0).cast("bigint"))
    ranks = preferences.groupBy(*keys).agg(
        F.count("preferred_rank_before").alias("pref_n"),
        F.coalesce(F.sum("preferred_rank_before"), F.lit(0)).alias("pref_sum"),
    )
    both = out.unionByName(ranks, allowMissingColumns=True)
    sums = [name for name in both.columns if name not in keys]
    return both.groupBy(*keys).agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in sums])


def decomposition_metrics() -> dict[str, Column]:
    """Final columns from summed :func:`decomposition_stats`, with the failed-rows-or-all rule."""
    failed = F.col("steps_f") > 0

    def pick(name: str) -> Column:
        return F.when(failed, F.col(f"{name}_f")).otherwise(F.col(f"{name}_a"))

    candidate_steps = pick("candidate_steps")
    from_preferences = F.col("pref_n") > 0
    mean_rank = safe_div(
        F.when(from_preferences, F.col("pref_sum")).otherwise(pick("rank_sum")),
        F.when(from_preferences, F.col("pref_n")).otherwise(pick("rank_n")),
    )
    names = {
        "certified_preference": ("certified_preferences", "certified_misranking_step_rate"),
        "repair_not_in_candidates": ("candidate_absent", "candidate_absent_step_rate"),
        "repair_same_as_executed": ("repair_same_as_executed", "repair_same_as_executed_step_rate"),
        "no_repair_found": ("no_repair_found", "no_repair_found_step_rate"),
        "suffix_too_long": ("suffix_too_long", "suffix_too_long_step_rate"),
        "invalid_replay": ("invalid_replay", "invalid_replay_step_rate"),
    }
    out: dict[str, Column] = {"steps": pick("steps"), "candidate_steps": candidate_steps}
    for status, (count_name, rate_name) in names.items():
        count = pick(STATUS_COLUMNS[status])
        out[count_name] = count
        out[rate_name] = safe_div(count, candidate_steps)
    out["no_candidates_logged"] = pick("num_no_candidates_logged")
    out["no_candidates_logged_step_rate"] = safe_div(out["no_candidates_logged"], pick("steps"))
    out["avg_preferred_rank_on_certified_preferences"] = mean_rank
    return out


def failure_decomposition(ledger: DataFrame, preferences: DataFrame | None = None) -> DataFrame:
    """One row: how failed steps divide over the statuses (all steps when no trajectory failed)."""
    per_trajectory = decomposition_stats(ledger, preferences, ["trajectory_id"])
    sums = [name for name in per_trajectory.columns if name != "trajectory_id"]
    total = per_trajectory.agg(
        F.count_if(F.col("steps_a") > 0).alias("trajectories"),
        F.count_if(F.col("steps_f") > 0).alias("failed_trajectories"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in sums],
    )
    metrics = decomposition_metrics()
    summarized = F.when(F.col("failed_trajectories") > 0, F.col("failed_trajectories")).otherwise(F.col("trajectories"))
    return total.select(
        "trajectories",
        "failed_trajectories",
        summarized.alias("summarized_trajectories"),
        *[column.alias(name) for name, column in metrics.items()],
        metrics["certified_misranking_step_rate"].alias("candidate_misranking_rate"),
        metrics["candidate_absent_step_rate"].alias("candidate_absent_rate"),
        metrics["avg_preferred_rank_on_certified_preferences"].alias("avg_preferred_rank"),
    )


def decomposition_by_trajectory(ledger: DataFrame) -> DataFrame:
    """Counters per trajectory id; task, seed and outcome come from its first step."""
    first = F.min_by(
        F.struct("task_id", "seed", "original_outcome"), F.struct("step_index", "task_id", "seed")
    )
    return (
        ledger.groupBy("trajectory_id")
        .agg(
            first.alias("first"),
            F.count(F.lit(1)).alias("num_steps"),
            F.count_if(has_candidates()).alias("num_candidate_steps"),
            *[F.count_if(F.col("status") == status).alias(name) for status, name in STATUS_COLUMNS.items()],
        )
        .select(
            "trajectory_id",
            "first.task_id",
            "first.seed",
            F.col("first.original_outcome").alias("outcome"),
            "num_steps",
            "num_candidate_steps",
            *STATUS_COLUMNS.values(),
        )
    )


# ---------------------------------------------------------------- sensitivity

def _sensitivity(ledger: DataFrame, values: list[int | None], measure: str, absent_status: str) -> DataFrame:
    """Counts per limit, reduced to one row per (task, seed) before the limits are compared.

    The few limits become columns, not a join: one pass over the ledger, then one row per limit at the end.
    """
    size = F.coalesce(F.col(measure), F.lit(10**9))
    certified = F.col("status") == "certified_preference"
    per_limit = []
    for number, limit in enumerate(values):
        kept = certified if limit is None else certified & (size <= limit)
        per_limit += [
            F.count_if(kept).alias(f"kept_{number}"),
            F.sum(F.when(kept, size).otherwise(0)).alias(f"size_{number}"),
        ]
    clusters = ledger.groupBy("task_id", "seed", (F.col("original_outcome") == "fail").alias("failed")).agg(
        F.count_if(has_candidates()).alias("candidate_steps"),
        F.count_if(certified).alias("certified"),
        F.count_if(F.col("status") == absent_status).alias("base"),
        *per_limit,
    )
    totals = clusters.groupBy("failed").agg(
        *[F.sum(name).alias(name) for name in ("candidate_steps", "certified", "base")],
        *[
            column
            for number in range(len(values))
            for column in (
                F.sum(f"kept_{number}").alias(f"kept_{number}"),
                F.sum(f"size_{number}").alias(f"size_{number}"),
                F.count_if(F.col(f"kept_{number}") > 0).alias(f"trajectories_{number}"),
            )
        ],
    )
    # At most two rows remain: failed and successful; failed ones win when there are any.
    chosen = totals.agg(F.max_by(F.struct(*[c for c in totals.columns if c != "failed"]), "failed").alias("t"))
    rows = F.array(
        *[
            F.struct(
                F.lit(None if limit is None else limit).cast("int").alias("limit"),
                F.col(f"t.kept_{number}").alias("kept"),
                F.col(f"t.size_{number}").alias("size_sum"),
                F.col(f"t.trajectories_{number}").alias("trajectories"),
            )
            for number, limit in enumerate(values)
        ]
    )
    return chosen.select("t.candidate_steps", "t.certified", "t.base", F.inline(rows))


def top_k_sensitivity(ledger: DataFrame, ks: tuple[int, ...] = (2, 3, 4, 5)) -> DataFrame:
    """Certified preferences kept when lists are cut to k; lost ones count as candidate absent."""
    lost = F.col("certified") - F.col("kept")
    return _sensitivity(ledger, list(ks), "repair_rank_before", "repair_not_in_candidates").select(
        F.col("limit").alias("top_k"),
        F.col("kept").alias("certified_preferences_retained"),
        lost.alias("certified_preferences_lost"),
        safe_div(F.col("kept"), F.col("candidate_steps")).alias("certified_misranking_step_rate"),
        safe_div(F.col("base") + lost, F.col("candidate_steps")).alias("candidate_absent_step_rate"),
        F.col("trajectories").alias("repairable_trajectories"),
        safe_div(F.col("size_sum"), F.col("kept")).alias("avg_preferred_rank"),
    )


def suffix_budget_sensitivity(ledger: DataFrame, budgets: tuple[int, ...] = (3, 5, 7)) -> DataFrame:
    """The same for a cap on the repair suffix, with a ``full`` row without cap."""
    lost = F.col("certified") - F.col("kept")
    return _sensitivity(ledger, [*budgets, None], "repair_suffix_len", "suffix_too_long").select(
        F.coalesce(F.col("limit").cast("string"), F.lit("full")).alias("suffix_budget"),
        F.col("kept").alias("certified_preferences_retained"),
        lost.alias("certified_preferences_lost"),
        safe_div(F.col("kept"), F.col("candidate_steps")).alias("certified_misranking_step_rate"),
        safe_div(F.col("base") + lost, F.col("candidate_steps")).alias("suffix_too_long_step_rate"),
        F.col("trajectories").alias("repairable_trajectories"),
    )


# ---------------------------------------------------------------- repair multiplicity

def repair_multiplicity(steps: DataFrame, branch_outcomes: DataFrame, branch_keys: list[str]) -> DataFrame:
    """Per step, every logged candidate whose branch succeeds.

    ``branch_outcomes`` holds (``branch_keys``, action, success, suffix_len) and is unique on its keys. The
    arrays per step hold at most the logged candidates of that step.
    """
    before = F.col("candidates_before") if "candidates_before" in steps.columns else F.lit(None).cast("array<string>")
    from trajlens.functions.ranks import dedupe_actions

    base = steps.withColumn("_list", dedupe_actions(step_candidates(before, F.col("candidates"))))
    long = base.select(
        "trajectory_id", *STEP, *[k for k in branch_keys if k not in STEP],
        F.col("action").alias("executed_action"), F.size("_list").alias("candidate_count"),
        F.posexplode_outer("_list").alias("pos", "candidate"),
    )
    outcomes = branch_outcomes.select(
        *branch_keys, F.col("action").alias("candidate"), F.col("success").alias("_ok"), "suffix_len"
    )
    joined = long.join(outcomes, [*branch_keys, "candidate"], "left")
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    item = F.struct((F.col("pos") + 1).alias("rank"), F.col("candidate").alias("action"), "suffix_len")
    grouped = joined.groupBy("trajectory_id", *STEP, "executed_action", "candidate_count").agg(
        F.array_sort(F.collect_list(F.when(ok, item))).alias("found")
    )
    executed = normalize_action(F.col("executed_action"))
    alternatives = F.size(F.filter("found", lambda x: normalize_action(x["action"]) != executed))
    shortest = F.array_min(
        F.transform("found", lambda x: F.struct(x["suffix_len"].alias("suffix_len"), x["rank"].alias("rank"), x["action"].alias("action")))
    )
    first = F.get("found", 0)
    return grouped.select(
        "trajectory_id", *STEP, "executed_action", "candidate_count",
        F.size("found").alias("successful_logged_candidates"),
        alternatives.alias("successful_alternatives"),
        (F.size("found") > 0).alias("has_successful_logged_candidate"),
        (alternatives > 0).alias("has_successful_alternative"),
        (F.size("found") > 1).alias("has_multiple_successful_logged_candidates"),
        (alternatives > 1).alias("has_multiple_successful_alternatives"),
        F.transform("found", lambda x: x["action"]).alias("successful_actions"),
        F.transform("found", lambda x: x["rank"]).alias("successful_ranks"),
        F.transform("found", lambda x: x["suffix_len"]).alias("successful_suffix_lens"),
        first["action"].alias("first_rank_success"),
        shortest["action"].alias("shortest_suffix_success"),
        F.coalesce(
            normalize_action(first["action"]) != normalize_action(shortest["action"]), F.lit(False)
        ).alias("tie_break_disagreement"),
    )


def _shortest_ties(alternatives_only: bool) -> Column:
    pairs = F.arrays_zip("successful_actions", "successful_suffix_lens")
    if alternatives_only:
        executed = normalize_action(F.col("executed_action"))
        pairs = F.filter(pairs, lambda p: normalize_action(p["successful_actions"]) != executed)
    lens = F.transform(pairs, lambda p: p["successful_suffix_lens"])
    return F.size(F.filter(lens, lambda n: n == F.array_min(lens)))


def multiplicity_summary(rows: DataFrame) -> DataFrame:
    """Counts and rates over steps with candidates; one row per trajectory before the final sum."""
    some = F.col("candidate_count") > 0
    repairable = some & F.col("has_successful_logged_candidate")
    alternative = some & F.col("has_successful_alternative")
    multiple = some & F.col("has_multiple_successful_logged_candidates")
    counts = {
        "candidate_steps": some,
        "steps_with_successful_logged_candidate": repairable,
        "steps_with_successful_alternative": alternative,
        "steps_with_multiple_successful_logged_candidates": multiple,
        "steps_with_multiple_successful_alternatives": some & F.col("has_multiple_successful_alternatives"),
        "tie_break_disagreement_steps": multiple & F.col("tie_break_disagreement"),
        "steps_with_multiple_min_suffix_logged_candidates": repairable & (_shortest_ties(False) > 1),
        "steps_with_multiple_min_suffix_alternatives": repairable & (_shortest_ties(True) > 1),
    }
    per_trajectory = rows.groupBy("trajectory_id").agg(
        *[F.count_if(flag).alias(name) for name, flag in counts.items()],
        F.sum(F.when(repairable, F.col("successful_logged_candidates")).otherwise(0)).alias("_logged"),
        F.sum(F.when(alternative, F.col("successful_alternatives")).otherwise(0)).alias("_alternatives"),
    )
    total = per_trajectory.agg(
        F.count(F.lit(1)).alias("trajectories"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in [*counts, "_logged", "_alternatives"]],
    )
    rates = {
        "successful_logged_candidate_step_rate": ("steps_with_successful_logged_candidate", "candidate_steps"),
        "successful_alternative_step_rate": ("steps_with_successful_alternative", "candidate_steps"),
        "multiple_successful_logged_rate_over_candidate_steps": (
            "steps_with_multiple_successful_logged_candidates", "candidate_steps"),
        "multiple_successful_logged_rate_over_repairable_steps": (
            "steps_with_multiple_successful_logged_candidates", "steps_with_successful_logged_candidate"),
        "multiple_successful_alternative_rate_over_repairable_steps": (
            "steps_with_multiple_successful_alternatives", "steps_with_successful_logged_candidate"),
        "tie_break_disagreement_rate_over_multi_success_steps": (
            "tie_break_disagreement_steps", "steps_with_multiple_successful_logged_candidates"),
        "multiple_min_suffix_logged_rate_over_repairable_steps": (
            "steps_with_multiple_min_suffix_logged_candidates", "steps_with_successful_logged_candidate"),
        "multiple_min_suffix_alternative_rate_over_repairable_steps": (
            "steps_with_multiple_min_suffix_alternatives", "steps_with_successful_logged_candidate"),
    }
    return total.select(
        "trajectories",
        *counts,
        *[safe_div(F.col(a), F.col(b)).alias(name) for name, (a, b) in rates.items()],
        ratio_or_null(F.col("_logged"), F.col("steps_with_successful_logged_candidate")).alias(
            "avg_successful_logged_candidates_on_repairable_steps"),
        ratio_or_null(F.col("_alternatives"), F.col("steps_with_successful_alternative")).alias(
            "avg_successful_alternatives_on_alternative_steps"),
    )
