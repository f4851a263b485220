"""Evaluation of candidate rankings against certified preferences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.functions.actions import action_group, action_verb
from trajlens.functions.ranks import (
    learned_order,
    rank_of,
    ratio_or_null,
    reciprocal_rank,
    safe_div,
    single_ndcg,
    step_candidates,
)
from trajlens.functions.tasks import path_stem

STEP = ["task_id", "seed", "step_index"]


def last_predictions(predictions: DataFrame) -> DataFrame:
    """Latest prediction per step key by ``ord``; missing columns read as absent."""
    def column(name: str, kind: str) -> Column:
        return (F.col(name) if name in predictions.columns else F.lit(None)).cast(kind)

    scores = column("scores", "map<string,double>")
    if "candidate_scores" in predictions.columns:
        scores = F.coalesce(scores, F.col("candidate_scores"))
    abstain = F.coalesce(column("abstain", "boolean"), column("abstained", "boolean"), F.lit(False))
    value = F.struct(
        scores.alias("scores"), column("ranked_actions", "array<string>").alias("ranked"), abstain.alias("abstain")
    )
    return predictions.groupBy(*STEP).agg(F.max_by(value, F.col("ord")).alias("prediction"))


def evaluate_ranking(preferences: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """Raw, oracle and learned rank measures per preference."""
    rows = preferences
    if predictions is None:
        rows = rows.withColumn(
            "prediction",
            F.lit(None).cast("struct<scores:map<string,double>,ranked:array<string>,abstain:boolean>"),
        )
    else:
        rows = rows.join(last_predictions(predictions), STEP, "left")
    rows = rows.withColumn(
        "order",
        F.when(
            ~F.col("prediction.abstain"),
            learned_order(F.col("candidates"), F.col("prediction.ranked"), F.col("prediction.scores")),
        ),
    )
    raw_rank = rank_of(F.col("candidates"), F.col("preferred_action"))
    learned_rank = rank_of(F.col("order"), F.col("preferred_action"))
    active = F.coalesce(~F.col("prediction.abstain"), F.lit(False))
    raw_top = F.coalesce(raw_rank == 1, F.lit(False))
    learned_top = F.coalesce(learned_rank == 1, F.lit(False))
    found = F.when(raw_rank.isNotNull(), 1.0).otherwise(0.0)
    keep = [name for name in ("trajectory_id", "game_seed") if name in preferences.columns]
    return rows.select(
        *STEP,
        *keep,
        "preferred_action",
        "rejected_action",
        raw_rank.alias("preferred_rank_before"),
        rank_of(F.col("candidates"), F.col("rejected_action")).alias("rejected_rank_before"),
        raw_rank.isNotNull().alias("preferred_in_candidates"),
        raw_top.alias("raw_top1_is_preferred"),
        reciprocal_rank(raw_rank).alias("raw_mrr"),
        found.alias("oracle_mrr"),
        single_ndcg(raw_rank).alias("raw_ndcg"),
        found.alias("oracle_ndcg"),
        F.col("prediction").isNotNull().alias("has_learned_prediction"),
        F.col("prediction.abstain").alias("learned_abstained"),
        learned_rank.alias("learned_rank"),
        F.get("order", 0).alias("learned_top1"),
        F.when(active, reciprocal_rank(learned_rank)).alias("learned_mrr"),
        F.when(active, single_ndcg(learned_rank)).alias("learned_ndcg"),
        F.when(active, learned_top).alias("learned_top1_is_preferred"),
        (raw_top & active & ~learned_top).alias("learned_demoted_raw_gold"),
    )


def ranking_sums(where: Column | None = None, suffix: str = "") -> list[Column]:
    """Additive statistics of ranking records; every ranking metric is a ratio of these."""
    here = F.lit(True) if where is None else where
    predicted = here & F.col("has_learned_prediction")
    active = predicted & F.coalesce(~F.col("learned_abstained"), F.lit(False))

    def total(name: str, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(name))), F.lit(0.0))

    return [
        F.count_if(here).alias(f"n{suffix}"),
        F.count_if(here & F.col("preferred_in_candidates")).alias(f"found{suffix}"),
        F.count_if(here & F.col("raw_top1_is_preferred")).alias(f"raw_top{suffix}"),
        F.coalesce(F.sum(F.when(here, F.col("preferred_rank_before"))), F.lit(0)).alias(f"rank_total{suffix}"),
        total("raw_mrr", here).alias(f"raw_rr{suffix}"),
        total("raw_ndcg", here).alias(f"raw_gain{suffix}"),
        F.count_if(predicted).alias(f"predicted{suffix}"),
        F.count_if(predicted & F.col("learned_abstained")).alias(f"abstained{suffix}"),
        F.count_if(active).alias(f"active{suffix}"),
        total("learned_mrr", active).alias(f"learned_rr{suffix}"),
        total("learned_ndcg", active).alias(f"learned_gain{suffix}"),
        F.count_if(active & F.col("learned_top1_is_preferred")).alias(f"learned_top{suffix}"),
        F.count_if(active & F.col("raw_top1_is_preferred")).alias(f"active_raw_top{suffix}"),
        F.count_if(active & F.col("learned_demoted_raw_gold")).alias(f"demoted{suffix}"),
    ]


def ranking_metrics(suffix: str = "") -> dict[str, Column]:
    def col(name: str) -> Column:
        return F.col(f"{name}{suffix}")

    demotion = ratio_or_null(col("demoted"), col("active_raw_top"))
    return {
        "preferences": col("n"),
        "preferred_in_candidates": col("found"),
        "candidate_coverage_rate": safe_div(col("found"), col("n")),
        "preferred_top1_before": col("raw_top"),
        "avg_preferred_rank_before": safe_div(col("rank_total"), col("found")),
        "raw_mrr": safe_div(col("raw_rr"), col("n")),
        "oracle_mrr": safe_div(col("found"), col("n")),
        "learned_mrr": ratio_or_null(col("learned_rr"), col("active")),
        "raw_ndcg": safe_div(col("raw_gain"), col("n")),
        "oracle_ndcg": safe_div(col("found"), col("n")),
        "learned_ndcg": ratio_or_null(col("learned_gain"), col("active")),
        "learned_predictions": col("predicted"),
        "learned_evaluated_preferences": col("active"),
        "learned_prediction_coverage_rate": safe_div(col("predicted"), col("n")),
        "learned_abstain_rate": ratio_or_null(col("abstained"), col("predicted")),
        "learned_top1_correction_rate": ratio_or_null(col("learned_top"), col("active")),
        "gold_demotion_rate": demotion,
        "learned_harm_rate": demotion,
    }


def ranking_summary(records: DataFrame) -> DataFrame:
    return records.agg(*ranking_sums()).select(
        *[column.alias(name) for name, column in ranking_metrics().items()]
    )


def ranking_by_action_type(preferences: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """The ranking summary for all, navigation and other preferences, in one pass."""
    records = evaluate_ranking(preferences, predictions)
    moves = action_group(F.col("preferred_action")) == "navigation"
    groups = {"all": F.lit(True), "navigation": moves, "non_navigation": ~moves}
    total = records.agg(*[c for name, where in groups.items() for c in ranking_sums(where, f"_{name}")])
    rows = [
        F.struct(
            F.lit(name).alias("action_group"),
            *[column.alias(metric) for metric, column in ranking_metrics(f"_{name}").items()],
        )
        for name in groups
    ]
    return total.select(F.inline(F.array(*rows)))


def verb_counts(preferences: DataFrame) -> DataFrame:
    return preferences.groupBy(action_verb(F.col("preferred_action")).alias("verb")).agg(
        F.count(F.lit(1)).alias("preferences")
    )


def gold_demotion(retention: DataFrame, predictions: DataFrame) -> DataFrame:
    """How a reranker treats steps whose raw first candidate was already right."""
    records = evaluate_ranking(retention, predictions)
    held = F.count_if(
        F.col("has_learned_prediction") & ~F.col("learned_abstained")
        & F.col("raw_top1_is_preferred") & F.col("learned_top1_is_preferred")
    ).alias("held")
    total = records.agg(*ranking_sums(), held)
    predicted, active = F.col("predicted"), F.col("active")
    return total.select(
        F.col("n").alias("retention_records"),
        predicted.alias("predicted_records"),
        safe_div(predicted, F.col("n")).alias("prediction_coverage_rate"),
        F.col("abstained"),
        ratio_or_null(F.col("abstained"), predicted).alias("abstain_rate"),
        active.alias("intervened"),
        ratio_or_null(active, predicted).alias("intervention_rate"),
        F.col("demoted").alias("gold_demotions"),
        ratio_or_null(F.col("demoted"), predicted).alias("gold_demotion_rate_over_all_predicted"),
        ratio_or_null(F.col("demoted"), active).alias("gold_demotion_rate_when_intervened"),
        ratio_or_null(F.col("abstained") + F.col("held"), predicted).alias("gold_retention_rate_with_abstention"),
        ratio_or_null(F.col("held"), active).alias("gold_retention_rate_when_intervened"),
    )


def evaluate_against_run(run_steps: DataFrame, preferences: DataFrame) -> DataFrame:
    """Preferences looked up in a logged run by (task, seed, history length), then by task stem.

    ``run_steps`` needs ``ord``: the last step wins among equal keys. Unmatched preferences stay as rows.
    """
    before = F.col("candidates_before") if "candidates_before" in run_steps.columns else F.lit(None).cast("array<string>")
    keyed = run_steps.select(
        F.explode(F.array_distinct(F.array("task_id", path_stem(F.col("task_id"))))).alias("run_task"),
        "seed",
        "step_index",
        "ord",
        F.struct(
            step_candidates(before, F.col("candidates")).alias("candidates"), F.col("action").alias("action")
        ).alias("step"),
    )
    lookup = keyed.groupBy("run_task", "seed", "step_index").agg(F.max_by("step", "ord").alias("step"))
    rows = preferences.select(
        "task_id", "seed", F.size("history").alias("step_index"), "preferred_action", "rejected_action", "source"
    )
    by_task = lookup.select(F.col("run_task").alias("task_id"), "seed", "step_index", F.col("step").alias("exact"))
    by_stem = lookup.select(F.col("run_task").alias("stem"), "seed", "step_index", F.col("step").alias("loose"))
    matched = (
        rows.join(by_task, STEP, "left")
        .withColumn("stem", path_stem(F.col("task_id")))
        .join(by_stem, ["stem", "seed", "step_index"], "left")
        .withColumn("step", F.coalesce("exact", "loose"))
    )
    rank = rank_of(F.col("step.candidates"), F.col("preferred_action"))
    found = F.when(rank.isNotNull(), 1.0).otherwise(0.0)
    return matched.select(
        *STEP,
        "preferred_action",
        "rejected_action",
        F.when(F.col("step").isNotNull(), F.coalesce(F.col("step.action"), F.lit(""))).alias("selected_action"),
        rank.alias("preferred_rank_before"),
        rank_of(F.col("step.candidates"), F.col("rejected_action")).alias("rejected_rank_before"),
        F.coalesce(F.col("step.action") == F.col("rejected_action"), F.lit(False)).alias("selected_was_rejected"),
        rank.isNotNull().alias("preferred_in_candidates"),
        rank.isNotNull().alias("would_make_preferred_top1"),
        F.coalesce(rank > 1, F.lit(False)).alias("preferred_misranked"),
        reciprocal_rank(rank).alias("raw_mrr"),
        found.alias("oracle_mrr"),
        single_ndcg(rank).alias("raw_ndcg"),
        found.alias("oracle_ndcg"),
        "source",
        F.col("step").isNull().alias("missing_step"),
    )


def run_preference_summary(records: DataFrame) -> DataFrame:
    total = records.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("missing_step")).alias("matched"),
        F.count_if(F.col("preferred_in_candidates")).alias("found"),
        F.count_if(F.col("selected_was_rejected")).alias("repeated"),
        F.count_if(F.col("preferred_rank_before") == 1).alias("top"),
        F.count_if(F.col("preferred_misranked")).alias("misranked"),
        F.count_if(F.col("would_make_preferred_top1")).alias("repairable"),
        F.sum("preferred_rank_before").alias("rank_total"),
        *[F.sum(name).alias(name) for name in ("raw_mrr", "raw_ndcg")],
    )
    n, matched, found = F.col("n"), F.col("matched"), F.col("found")
    nothing = F.lit(None).cast("double")
    return total.select(
        n.alias("preferences"),
        matched.alias("matched_steps"),
        found.alias("preferred_in_candidates"),
        safe_div(found, n).alias("candidate_coverage_rate"),
        safe_div(matched - found, matched).alias("candidate_absent_rate"),
        F.col("repeated").alias("selected_was_rejected"),
        safe_div(F.col("repeated"), matched).alias("selected_is_rejected_rate"),
        F.col("top").alias("preferred_top1_before"),
        F.col("misranked").alias("preferred_misranked"),
        safe_div(F.col("misranked"), found).alias("misranking_rate"),
        F.col("repairable").alias("would_make_preferred_top1"),
        safe_div(F.col("repairable"), found).alias("oracle_top1_repairable_rate"),
        safe_div(F.col("rank_total"), found).alias("avg_preferred_rank_before"),
        safe_div(F.col("raw_mrr"), n).alias("raw_mrr"),
        safe_div(found, n).alias("oracle_mrr"),
        nothing.alias("learned_mrr"),
        safe_div(F.col("raw_ndcg"), n).alias("raw_ndcg"),
        safe_div(found, n).alias("oracle_ndcg"),
        nothing.alias("learned_ndcg"),
        nothing.alias("learned_top1_correction_rate"),
        nothing.alias("learned_abstain_rate"),
        nothing.alias("learned_harm_rate"),
    )


def method_table(summaries: dict[str, DataFrame]) -> DataFrame:
    """Raw row of the first summary and the oracle row, then the learned row of every named summary.

    Reference rows by definition: the raw order corrects no first candidate and never abstains, the oracle corrects
    all and has no abstention rate.
    """
    def row(source: DataFrame, name: str, *values: Column | float | None) -> DataFrame:
        named = zip(("mrr", "ndcg", "top1_correction", "abstain_rate"), values, strict=True)
        return source.select(
            F.lit(name).alias("method"),
            *[(value if isinstance(value, Column) else F.lit(value)).cast("double").alias(column) for column, value in named],
        )

    first = next(iter(summaries.values()))
    out = row(first, "raw", F.col("raw_mrr"), F.col("raw_ndcg"), 0.0, 0.0).unionByName(row(first, "oracle", 1.0, 1.0, 1.0, None))
    learned = ("learned_mrr", "learned_ndcg", "learned_top1_correction_rate", "learned_abstain_rate")
    for name, summary in summaries.items():
        out = out.unionByName(row(summary, name, *[F.col(column) for column in learned]))
    return out


def retention_table(summaries: dict[str, DataFrame]) -> DataFrame:
    """One row per margin from the summaries of :func:`gold_demotion`."""
    rows = [
        summary.select(
            F.lit(margin).alias("margin"), "abstain_rate", "intervention_rate",
            F.col("gold_demotion_rate_over_all_predicted").alias("gold_demotion_rate"),
            F.col("gold_retention_rate_with_abstention").alias("gold_retention_rate"),
        )
        for margin, summary in summaries.items()
    ]
    return reduce(DataFrame.unionByName, rows)
