"""Column expressions over ranked candidate lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajlens.functions.actions import normalize_action

# Certificate names and the reason text per step status.
STATUS_REASONS = {
    "repair_not_in_candidates": "verified repair action absent from logged candidates",
    "repair_same_as_executed": "verified repair action is the executed action",
    "no_repair_found": "no certified repair action found for this step",
    "suffix_too_long": "verified repair suffix exceeds configured maximum length",
    "invalid_replay": "candidate repair did not replay to success",
    "no_candidates_logged": "no candidate actions were logged for this step",
}
STATUSES = (
    "certified_preference",
    "invalid_replay",
    "no_candidates_logged",
    "no_repair_found",
    "repair_not_in_candidates",
    "repair_same_as_executed",
    "suffix_too_long",
)


def safe_div(numerator: Column, denominator: Column) -> Column:
    """0.0 for an empty denominator."""
    return F.coalesce(
        numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0)), F.lit(0.0)
    )


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def rank_of(candidates: Column, action: Column) -> Column:
    """1-based position of the first exact match, NULL when absent."""
    return F.nullif(F.array_position(candidates, action), F.lit(0).cast("bigint"))


def empty_actions() -> Column:
    return F.array().cast("array<string>")


def step_candidates(before: Column, after: Column) -> Column:
    """Raw-order list; an empty or missing one falls through to the final list."""
    return F.when(F.size(before) > 0, before).otherwise(F.coalesce(after, empty_actions()))


def step_candidates_strict(before: Column, after: Column) -> Column:
    """Only a missing raw-order list falls through; an empty one stays empty."""
    return F.coalesce(before, after, empty_actions())


def dedupe_actions(candidates: Column) -> Column:
    """First of each group of candidates that are equal after normalisation."""
    norms = F.transform(candidates, normalize_action)
    return F.filter(
        candidates, lambda action, pos: F.array_position(norms, normalize_action(action)) == pos + 1
    )


def replacement_candidates(candidates: Column, executed: Column, limit: int) -> Column:
    others = F.filter(candidates, lambda action: action != executed)
    return F.slice(F.array_distinct(others), 1, limit)


def reciprocal_rank(rank: Column) -> Column:
    return F.when(rank > 0, F.lit(1.0) / rank).otherwise(0.0)


def single_ndcg(rank: Column) -> Column:
    return F.when(rank > 0, F.lit(1.0) / F.log2(rank + F.lit(1.0))).otherwise(0.0)


def certificate_level(original_success: Column, original_len: Column, edited_len: Column) -> Column:
    return (
        F.when(original_success & (edited_len > 0) & (edited_len < original_len), "C3_shorter_success")
        .when(~original_success, "C3_failure_repair")
        .otherwise("C1_oracle_suffix")
    )


def status_reason(status: Column) -> Column:
    pairs = [F.lit(text) for pair in STATUS_REASONS.items() for text in pair]
    return F.try_element_at(F.create_map(*pairs), status)


def learned_order(candidates: Column, ranked: Column, scores: Column) -> Column:
    """Candidates in predicted order.

    A ranked list wins when present: its known candidates first, the others behind in logged order.
    Otherwise by score, missing scores last, ties in logged order.
    """
    by_list = F.array_distinct(F.concat(F.array_intersect(ranked, candidates), candidates))
    keyed = F.transform(
        candidates,
        lambda action, pos: F.struct(
            (-F.coalesce(F.try_element_at(scores, action), F.lit(float("-inf")))).alias("down"),
            pos.alias("pos"),
            action.alias("action"),
        ),
    )
    by_score = F.transform(F.array_sort(keyed), lambda item: item["action"])
    return F.when(ranked.isNotNull(), by_list).otherwise(by_score)
