"""Analytics over logged agent runs: step diagnostics, episode metrics, run comparison."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlens.functions.ranks import rank_of, ratio_or_null, safe_div
from trajlens.operators.bootstrap import bootstrap_delta
from trajlens.session import store

RECENT = 4


# ---------------------------------------------------------------- steps and episodes

def raw_order(candidates: Column, raw_ranks: Column) -> Column:
    """Candidates in the order before reranking; unranked ones behind, in their current order."""
    missing = F.size(candidates) + 1
    keyed = F.transform(
        candidates,
        lambda action, pos: F.struct(
            F.coalesce(F.get(raw_ranks, pos), missing + pos).alias("rank"), pos.alias("pos"), action.alias("action")
        ),
    )
    known = F.exists(raw_ranks, lambda rank: rank.isNotNull())
    ordered = F.transform(F.array_sort(keyed), lambda item: item["action"])
    return F.when(F.coalesce(known, F.lit(False)), ordered).otherwise(candidates)


def step_diagnostics(steps: DataFrame) -> DataFrame:
    """Gold ranks before and after control and what the controller did.

    Needs candidates, raw_ranks, action, gold_action, top1_bad and ``controlled`` (a controller decided).
    """
    rows = steps.withColumn("candidates_before", raw_order(F.col("candidates"), F.col("raw_ranks")))
    before = rank_of(F.col("candidates_before"), F.col("gold_action"))
    is_gold = F.coalesce(F.col("action") == F.col("gold_action"), F.lit(False))
    top = F.get("candidates_before", 0)
    controlled = F.col("controlled")
    return rows.select(
        *[name for name in steps.columns if name not in ("candidates_before",)],
        "candidates_before",
        before.isNotNull().alias("gold_in_candidates"),
        before.alias("gold_rank_before"),
        rank_of(F.col("candidates"), F.col("gold_action")).alias("gold_rank_after"),
        is_gold.alias("selected_is_gold"),
        (controlled & F.coalesce(before != 1, F.lit(False)) & is_gold).alias("recovered_gold"),
        (controlled & F.coalesce(before == 1, F.lit(False)) & ~is_gold).alias("demoted_gold"),
        top.alias("top1_action"),
        (controlled & F.col("top1_bad") & F.coalesce(F.col("action") != top, F.lit(False))).alias("blocked_bad_top1"),
    )


def episode_metrics(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Thirty-one metrics per episode from its diagnosed steps.

    The only ordered measure, a repeat of one of the previous four actions, looks back over a frame of four
    rows inside one (bounded) episode.
    """
    recent = Window.partitionBy(*keys).orderBy("step_index").rowsBetween(-RECENT, -1)
    rows = steps.withColumn("_repeat", F.array_contains(F.collect_list("action").over(recent), F.col("action")))
    reasons = F.col("controller_reasons")
    acted = F.col("reranker_intervened")
    first = F.col("gold_rank_before") == 1
    gold = F.col("selected_is_gold")
    flags = {
        "invalid_actions": ~F.col("valid"),
        "repeated_actions": F.col("_repeat"),
        "noop_penalized": F.array_contains(reasons, "noop"),
        "seen_state_penalized": F.array_contains(reasons, "seen_state"),
        "inverse_penalized": F.array_contains(reasons, "inverse_with_previous"),
        "absorbed_penalized": F.array_contains(reasons, "absorbed_after_previous"),
        "gold_steps": F.col("gold_action").isNotNull(),
        "gold_in_candidates": F.col("gold_in_candidates"),
        "selected_gold": gold,
        "recovered_gold": F.col("recovered_gold"),
        "demoted_gold": F.col("demoted_gold"),
        "top1_structural_bad": F.col("top1_bad"),
        "blocked_bad_top1": F.col("blocked_bad_top1"),
        "reranker_steps": F.col("reranker_used"),
        "reranker_interventions": acted,
        "reranker_abstentions": F.col("reranker_abstained"),
        "reranker_recovered_gold": acted & F.coalesce(~first, F.lit(False)) & gold,
        "reranker_demoted_gold": acted & F.coalesce(first, F.lit(False)) & ~gold,
    }
    rates = {
        "invalid_action_rate": ("invalid_actions", "steps"),
        "repeated_action_rate": ("repeated_actions", "steps"),
        "gold_in_candidate_rate": ("gold_in_candidates", "gold_steps"),
        "selected_gold_rate": ("selected_gold", "gold_steps"),
        "top1_structural_bad_rate": ("top1_structural_bad", "steps"),
        "blocked_bad_top1_rate": ("blocked_bad_top1", "top1_structural_bad"),
        "reranker_intervention_rate": ("reranker_interventions", "reranker_steps"),
        "reranker_abstain_rate": ("reranker_abstentions", "reranker_steps"),
        "reranker_gold_demotion_rate": ("reranker_demoted_gold", "gold_steps"),
    }
    means = {
        "avg_gold_rank_before": "gold_rank_before",
        "avg_gold_rank_after": "gold_rank_after",
        "avg_reranker_margin": "reranker_margin",
    }
    counted = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("steps"),
        *[F.count_if(flag).cast("double").alias(name) for name, flag in flags.items()],
        *[F.coalesce(F.avg(column), F.lit(0.0)).alias(name) for name, column in means.items()],
    )
    return counted.select("*", *[safe_div(F.col(a), F.col(b)).alias(name) for name, (a, b) in rates.items()])


METRICS = (
    "steps", "invalid_actions", "invalid_action_rate", "repeated_actions", "repeated_action_rate", "noop_penalized",
    "seen_state_penalized", "inverse_penalized", "absorbed_penalized", "gold_steps", "gold_in_candidates",
    "gold_in_candidate_rate", "selected_gold", "selected_gold_rate", "recovered_gold", "demoted_gold",
    "avg_gold_rank_before", "avg_gold_rank_after", "top1_structural_bad", "top1_structural_bad_rate",
    "blocked_bad_top1", "blocked_bad_top1_rate", "reranker_steps", "reranker_interventions",
    "reranker_intervention_rate", "reranker_abstentions", "reranker_abstain_rate", "reranker_recovered_gold",
    "reranker_demoted_gold", "reranker_gold_demotion_rate", "avg_reranker_margin",
)


def run_summary(episodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Success rate, mean reward and the mean of every metric; a metric an episode lacks counts as zero."""
    present = [name for name in METRICS if name in episodes.columns]
    return episodes.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("episodes"),
        F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg(F.coalesce("total_reward", F.lit(0.0))), F.lit(0.0)).alias("avg_reward"),
        *[F.coalesce(F.avg(F.coalesce(name, F.lit(0.0))), F.lit(0.0)).alias(f"avg_{name}") for name in present],
    )


# ---------------------------------------------------------------- comparisons

def compare_runs(episodes: DataFrame) -> DataFrame:
    """One row per run. Failed tasks stay a table of their own (:func:`failed_tasks`): they are unbounded."""
    return episodes.groupBy("run").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg("steps").alias("avg_steps"),
        F.avg(F.coalesce("total_reward", F.lit(0.0))).alias("avg_reward"),
        F.avg(F.coalesce("repeated_action_rate", F.lit(0.0))).alias("avg_repeat"),
        F.count_if(~F.col("success")).alias("failures"),
    )


def failed_tasks(episodes: DataFrame) -> DataFrame:
    from trajlens.functions.tasks import path_stem

    return episodes.filter(~F.col("success")).select("run", path_stem(F.col("task_id")).alias("task"), "ord")


PAIR_METRICS = (
    "steps", "repeated_action_rate", "reranker_intervention_rate", "reranker_gold_demotion_rate",
    "reranker_interventions", "reranker_demoted_gold",
)


def paired_rows(baseline: DataFrame, treatment: DataFrame) -> DataFrame:
    """Inner join on task_id of the last episode per task of either run."""
    def last(df: DataFrame, prefix: str) -> DataFrame:
        value = F.struct(
            F.col("success").cast("int").alias("success"),
            *[(F.coalesce(name, F.lit(0.0)) if name in df.columns else F.lit(0.0)).alias(name) for name in PAIR_METRICS],
        )
        return df.groupBy("task_id").agg(F.max_by(value, "ord").alias(prefix))

    b, t = "baseline", "treatment"
    return last(baseline, b).join(last(treatment, t), "task_id").select(
        "task_id",
        F.col(f"{b}.success").alias("baseline_success"),
        F.col(f"{t}.success").alias("treatment_success"),
        F.col(f"{b}.steps").alias("baseline_steps"),
        F.col(f"{t}.steps").alias("treatment_steps"),
        F.col(f"{b}.repeated_action_rate").alias("baseline_repeat_rate"),
        F.col(f"{t}.repeated_action_rate").alias("treatment_repeat_rate"),
        F.col(f"{t}.reranker_intervention_rate").alias("treatment_intervention_rate"),
        F.col(f"{t}.reranker_gold_demotion_rate").alias("treatment_gold_demotion_rate"),
        F.col(f"{t}.reranker_interventions").cast("bigint").alias("treatment_interventions"),
        F.col(f"{t}.reranker_demoted_gold").cast("bigint").alias("treatment_demotions"),
    )


def log_gamma(x: Column) -> Column:
    """ln Γ(x) for x ≥ 1 by Stirling's series after shifting the argument up by eight."""
    shift = 8
    y = x.cast("double") + shift
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    value = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series
    for k in range(shift):
        value = value - F.log(x.cast("double") + k)
    return value


def sign_test_p(rescued: Column, harmed: Column) -> Column:
    """Two-sided exact binomial p of rescued against harmed; NULL without trials.

    Terms are summed downward from the smaller count. Beyond forty standard deviations they vanish in double
    precision, so the sum has O(√n) terms.
    """
    n = (rescued + harmed).cast("double")
    tail = F.least(rescued, harmed).cast("double")
    log_top = log_gamma(n + 1) - log_gamma(tail + 1) - log_gamma(n - tail + 1) - n * math.log(2.0)
    terms = F.least(tail, F.floor(40 * F.sqrt(n) + 50)).cast("bigint")
    start = F.struct(log_top.alias("log"), F.lit(0.0).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        k = tail - i.cast("double")
        return F.struct(
            (acc["log"] + F.log(F.greatest(k, F.lit(1.0))) - F.log(n - k + 1)).alias("log"),
            (acc["total"] + F.exp(acc["log"])).alias("total"),
        )

    total = F.aggregate(F.sequence(F.lit(0).cast("bigint"), terms), start, add, lambda acc: acc["total"])
    return F.when(n > 0, F.least(F.lit(1.0), 2.0 * total))


def paired_comparison(pairs: DataFrame, iterations: int = 1000, seed: int = 0, method: str = "multinomial") -> DataFrame:
    """Success delta with its bootstrap interval, rescued and harmed tasks, sign test, means."""
    means = [name for name in pairs.columns if name not in ("task_id", "treatment_interventions", "treatment_demotions")]
    total = pairs.agg(
        F.count(F.lit(1)).alias("episodes"),
        *[F.avg(name).alias(f"mean_{name}") for name in means],
        F.count_if((F.col("baseline_success") == 0) & (F.col("treatment_success") == 1)).alias("rescued_failures"),
        F.count_if((F.col("baseline_success") == 1) & (F.col("treatment_success") == 0)).alias("harmed_successes"),
    )
    bounds = bootstrap_delta(pairs, iterations, seed, method)
    return total.select(
        F.when(F.col("episodes") == 0, F.raise_error(F.lit("paired comparison requires at least one shared task_id")).cast("bigint"))
        .otherwise(F.col("episodes")).alias("episodes"),
        F.col("mean_baseline_success").alias("baseline_success_rate"),
        F.col("mean_treatment_success").alias("treatment_success_rate"),
        (F.col("mean_treatment_success") - F.col("mean_baseline_success")).alias("success_delta"),
        bounds.select("ci_low").scalar().alias("success_delta_ci_low"),
        bounds.select("ci_high").scalar().alias("success_delta_ci_high"),
        "rescued_failures",
        "harmed_successes",
        sign_test_p(F.col("rescued_failures"), F.col("harmed_successes")).alias("paired_sign_p_value"),
        F.col("mean_baseline_steps").alias("baseline_avg_steps"),
        F.col("mean_treatment_steps").alias("treatment_avg_steps"),
        F.col("mean_baseline_repeat_rate").alias("baseline_repeat_rate"),
        F.col("mean_treatment_repeat_rate").alias("treatment_repeat_rate"),
        F.col("mean_treatment_intervention_rate").alias("treatment_intervention_rate"),
        F.col("mean_treatment_gold_demotion_rate").alias("treatment_gold_demotion_rate"),
    )


def gold_diagnostics(steps: DataFrame, by: str = "run") -> DataFrame:
    """Per run: is gold among the candidates, chosen, recovered, demoted; are bad first candidates blocked."""
    has_gold = F.col("gold_action").isNotNull()
    rank = F.col("gold_rank_before")
    total = steps.groupBy(by).agg(
        F.count_if(has_gold).alias("gold_steps"),
        F.count_if(has_gold & F.col("gold_in_candidates")).alias("_found"),
        F.count_if(has_gold & F.col("selected_is_gold")).alias("_selected"),
        F.count_if(has_gold & F.coalesce(rank != 1, F.lit(False))).alias("recovery_opps"),
        F.count_if(has_gold & F.col("recovered_gold")).alias("_recovered"),
        F.count_if(has_gold & F.coalesce(rank == 1, F.lit(False))).alias("demotion_opps"),
        F.count_if(has_gold & F.col("demoted_gold")).alias("_demoted"),
        F.count_if("top1_bad").alias("bad_top1_steps"),
        F.count_if("blocked_bad_top1").alias("_blocked"),
    )
    return total.select(
        by,
        "gold_steps",
        safe_div(F.col("_found"), F.col("gold_steps")).alias("gold_in_topk_rate"),
        safe_div(F.col("_selected"), F.col("gold_steps")).alias("selected_gold_rate"),
        "recovery_opps",
        safe_div(F.col("_recovered"), F.col("recovery_opps")).alias("recovery_rate"),
        "demotion_opps",
        safe_div(F.col("_demoted"), F.col("demotion_opps")).alias("demotion_rate"),
        "bad_top1_steps",
        safe_div(F.col("_blocked"), F.col("bad_top1_steps")).alias("bad_top1_block_rate"),
    )


def gold_selector_summary(records: DataFrame) -> DataFrame:
    """Base against controlled first choice over states with a known right action."""
    rank = F.col("gold_rank_before")
    n = F.col("states")
    total = records.agg(
        F.count(F.lit(1)).alias("states"),
        F.count(rank).alias("gold_in_topk"),
        F.count_if(F.col("base_selected_gold")).alias("base_selected_gold"),
        F.count_if(F.col("controlled_selected_gold")).alias("controlled_selected_gold"),
        F.count_if(rank != 1).alias("recovery_opportunities"),
        F.count_if(F.col("recovered_gold")).alias("recovered_gold"),
        F.count_if(rank == 1).alias("demotion_opportunities"),
        F.count_if(F.col("demoted_gold")).alias("demoted_gold"),
        F.count_if(F.col("top1_bad")).alias("top1_structural_bad"),
        F.count_if(F.col("blocked_bad_top1")).alias("blocked_bad_top1"),
        F.coalesce(F.avg(rank), F.lit(0.0)).alias("avg_gold_rank_before"),
        F.coalesce(F.avg("gold_rank_after"), F.lit(0.0)).alias("avg_gold_rank_after"),
        F.count_if(F.col("valid_gold_step")).alias("_valid"),
    )
    rates = {
        "gold_in_topk_rate": ("gold_in_topk", n),
        "base_selected_gold_rate": ("base_selected_gold", n),
        "controlled_selected_gold_rate": ("controlled_selected_gold", n),
        "recovery_rate": ("recovered_gold", F.col("recovery_opportunities")),
        "demotion_rate": ("demoted_gold", F.col("demotion_opportunities")),
        "top1_structural_bad_rate": ("top1_structural_bad", n),
        "blocked_bad_top1_rate": ("blocked_bad_top1", F.col("top1_structural_bad")),
        "valid_gold_step_rate": ("_valid", n),
    }
    return total.select("*", *[safe_div(F.col(a), b).alias(name) for name, (a, b) in rates.items()]).drop("_valid")


# ---------------------------------------------------------------- learning traces

def rl_trace_summary(rl_steps: DataFrame, window: int = 20) -> DataFrame:
    """Per (prior, run): success, success over the last episodes, first success, return and step measures.

    ``rl_steps``: prior, run, episode_index, reward, success, reasons (array), blocked (count).
    """
    keys = ["prior", "run"]
    episodes = rl_steps.groupBy(*keys, "episode_index").agg(
        F.bool_or("success").alias("success"),
        F.sum("reward").alias("total"),
        F.count(F.lit(1)).alias("steps"),
        F.count_if(F.arrays_overlap("reasons", F.array(F.lit("noop"), F.lit("seen_state")))).alias("idle"),
        F.sum("blocked").alias("blocked"),
    )
    total = episodes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("episodes"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.min(F.when(F.col("success"), F.col("episode_index"))).alias("first_success_episode"),
        F.avg("total").alias("avg_return"),
        F.avg("steps").alias("avg_steps"),
        safe_div(F.sum("idle"), F.sum("steps")).alias("noop_or_seen_selected_rate"),
        safe_div(F.sum("blocked"), F.sum("steps")).alias("avg_blocked_actions_per_step"),
    )
    # Only the last rows of each run travel: the rank filter is applied before the shuffle as well.
    newest = Window.partitionBy(*keys).orderBy(F.col("episode_index").desc())
    last = (
        episodes.select(*keys, "episode_index", "success")
        .withColumn("_place", F.row_number().over(newest))
        .filter(F.col("_place") <= window)
        .groupBy(*keys)
        .agg(F.avg(F.col("success").cast("double")).alias("last_window_success_rate"))
    )
    return total.join(last, keys)


def rl_run_summary(summaries: DataFrame) -> DataFrame:
    """Mean of the run summaries per prior; runs that never succeeded do not count for the first success."""
    return summaries.groupBy("prior").agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("success_rate").alias("avg_success_rate"),
        F.avg("last_window_success_rate").alias("avg_last_window_success_rate"),
        F.coalesce(F.avg("first_success_episode"), F.lit(0.0)).alias("avg_first_success_episode"),
        F.avg("avg_return").alias("avg_return"),
        F.avg("avg_steps").alias("avg_steps"),
        F.avg("noop_or_seen_selected_rate").alias("avg_noop_or_seen_selected_rate"),
        F.avg("avg_blocked_actions_per_step").alias("avg_blocked_actions_per_step"),
    )


# ---------------------------------------------------------------- whole-run report

#: Ranges that an interval of values is cut into per pass of a rank selection.
RANGES = 256


def values_at(counts: DataFrame, ranks: list[int]) -> dict[int, int]:
    """The values at 0-based places of the sorted multiset ``value, n`` (integers), exactly.

    Every pass counts what falls into ``RANGES`` equal ranges of each place's interval and goes on in the range that holds it,
    so a pass brings a few hundred numbers to the driver whatever the number of values, and 64 bits take eight passes at most.
    """
    bounds = counts.agg(F.min("value").alias("low"), F.max("value").alias("high")).first()
    # Place -> lowest and highest value it can have, and how many values lie below.
    spans = {rank: (bounds["low"], bounds["high"], 0) for rank in ranks}
    while any(low < high for low, high, _ in spans.values()):
        open_spans = sorted({span for span in spans.values() if span[0] < span[1]})
        hits = F.array_compact(F.array(*[
            F.when(
                F.col("value").between(low, high),
                F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"),
                         F.expr(f"(cast(value as decimal(20, 0)) - {low}) div {(high - low) // RANGES + 1}").cast("int").alias("range")),
            )
            for low, high, _ in open_spans
        ]))
        held: dict[tuple[int, int], dict[int, int]] = {}
        for row in counts.select("n", F.inline(hits)).groupBy("low", "high", "range").agg(F.sum("n").alias("n")).collect():
            held.setdefault((row["low"], row["high"]), {})[row["range"]] = row["n"]
        for rank, (low, high, below) in spans.items():
            if low == high:
                continue
            width = (high - low) // RANGES + 1
            for place in sorted(held[low, high]):
                count = held[low, high][place]
                if below + count > rank:
                    spans[rank] = (low + place * width, min(low + (place + 1) * width - 1, high), below)
                    break
                below += count
    return {rank: low for rank, (low, _, _) in spans.items()}


def number_summary(df: DataFrame, column: str) -> DataFrame:
    """Mean, median and nearest-rank 90 % point of an integer column; zeros where it has no value.

    Values are counted and written once; the points are selected by :func:`values_at`, so no sorted list is ever in one place.
    """
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("bigint").alias("value"))
    counts = store(values.groupBy("value").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n").alias("n"), F.sum(F.col("value") * F.col("n")).alias("sum")).first()
    mean = median = p90 = 0.0
    if total["n"]:
        n = total["n"]
        low, high, far = (n - 1) // 2, n // 2, round(0.9 * (n - 1))
        found = values_at(counts, sorted({low, high, far}))
        mean, median, p90 = total["sum"] / n, (found[low] + found[high]) / 2, float(found[far])
    return df.sparkSession.createDataFrame([(mean, median, p90)], "mean double, median double, p90 double")


def run_report(
    ledger: DataFrame, preferences: DataFrame, iterations: int = 1000, seed: int = 0, method: str = "multinomial"
) -> DataFrame:
    """Long report (section, name, value, ci_low, ci_high) of one compiled run."""
    from trajlens.operators import bootstrap as B
    from trajlens.operators import ledger as L
    from trajlens.operators import ranking as R

    nothing = F.lit(None).cast("double")

    def long(df: DataFrame, section: str, columns: list[str]) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).cast("double").alias("value")) for name in columns])
        return df.select(F.inline(rows)).select(
            F.lit(section).alias("section"), "name", "value", nothing.alias("ci_low"), nothing.alias("ci_high")
        )

    decomposition = L.failure_decomposition(ledger)
    clusters = ledger.groupBy("trajectory_id").agg(
        F.bool_or(F.col("original_outcome") == "fail").alias("failed"),
        F.bool_or(F.col("status") == "certified_preference").alias("certified"),
    ).agg(
        F.count_if(~F.col("failed")).alias("successful_trajectories"),
        F.count_if(F.col("failed") & F.col("certified")).alias("repairable_failed_trajectories"),
        safe_div(F.count_if(F.col("failed") & F.col("certified")), F.count_if("failed")).alias("repairable_failed_trajectory_rate"),
    )
    ranking = R.ranking_summary(R.evaluate_ranking(preferences))
    certificates = preferences.groupBy(F.coalesce("certificate_level", F.lit("unknown")).alias("name")).agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )
    parts = [
        long(decomposition, "data", ["trajectories", "failed_trajectories", "candidate_steps", "certified_preferences", "invalid_replay"]),
        long(clusters, "repairable", ["successful_trajectories", "repairable_failed_trajectories", "repairable_failed_trajectory_rate"]),
        long(ranking, "oracle", ["preferences", "preferred_in_candidates", "preferred_top1_before", "avg_preferred_rank_before"]),
        long(number_summary(preferences, "repair_suffix_len"), "suffix", ["mean", "median", "p90"]),
        certificates.select(F.lit("certificate").alias("section"), "name", "value", nothing.alias("ci_low"), nothing.alias("ci_high")),
        B.bootstrap_metrics(ledger, preferences, iterations, seed, method).select(
            F.lit("interval").alias("section"), F.col("metric").alias("name"), F.col("point").alias("value"), "ci_low", "ci_high"
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


