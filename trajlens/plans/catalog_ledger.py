"""Registered queries: certification, ledger, sensitivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlens.operators import ledger as L
from trajlens.plans import oracle_ctes as O
from trajlens.plans.shape import cols

QUERIES: dict = {}

_LEDGER_COLUMNS = cols(
    raw="trajectory_id; task_id; status; executed_action := action; repair_action := preferred; original_outcome;"
    "repaired_outcome; certificate_level := level; repair_in_candidates := preferred_rank is not null;"
    "executed_action_norm := lower(action); repair_action_norm := lower(preferred)",
    ints="seed; step_index; repair_rank_before := preferred_rank; rejected_rank_before := rejected_rank;"
    "candidate_count; repair_suffix_len",
)
_REASON = """case status when 'repair_not_in_candidates' then 'verified repair action absent from logged candidates'
 when 'repair_same_as_executed' then 'verified repair action is the executed action'
 when 'no_repair_found' then 'no certified repair action found for this step'
 when 'suffix_too_long' then 'verified repair suffix exceeds configured maximum length'
 when 'invalid_replay' then 'candidate repair did not replay to success'
 when 'no_candidates_logged' then 'no candidate actions were logged for this step' end as status_reason"""


def _ledger_rows(ledger, *more):
    return ledger.select(
        *more,
        "trajectory_id", "task_id", "seed", "step_index", "status", "executed_action", "executed_action_norm",
        "repair_action", "repair_action_norm", "repair_in_candidates", "repair_rank_before",
        "rejected_rank_before", "candidate_count", "certificate_level", "repair_suffix_len", "original_outcome",
        "repaired_outcome", "status_reason",
    )


for _name, _source, _limit in (
    ("step_ledger_gold", "gold", None),
    ("step_ledger_repair", "policy-repair", None),
    ("step_ledger_both", "both", None),
    ("step_ledger_capped_suffix", "both", 5),
):
    QUERIES[_name] = (
        lambda t, s=_source, m=_limit: _ledger_rows(t.ledger(s, m)),
        O.with_ledger(f"select {_LEDGER_COLUMNS}, {_REASON} from led", _source, _limit),
    )

QUERIES["first_repairs"] = (
    lambda t: t.repairs,
    O.with_edits(
        "select " + cols(
            raw="task_id; repair_action; repair_source; certificate_level;"
            "repaired_outcome := case when edit_success then 'success' else 'fail' end",
            ints="seed; step_index; repair_suffix_len := suffix_len; edited_action_len := edited_len;"
            "original_action_len := original_len",
        ) + " from repairs",
        O._REPAIRS,
    ),
)

QUERIES["explode_steps"] = (
    lambda t: t.history.select("trajectory_id", "step_index", "action", "history", F.size("history").alias("history_len")),
    O.with_history("select " + cols(raw="trajectory_id; action", ints="step_index; history_len := len(history)", arrs="history") + " from hist"),
)

QUERIES["compile_preferences"] = (
    lambda t: t.preferences(history=True).drop("game_seed", "rollout", "event_id", "trajectory_id", "executed_action_norm"),
    O.with_ledger(
        "select " + cols(
            raw="task_id; preferred_action := preferred; preferred_action_norm := lower(preferred); rejected_action := action;"
            "rejected_action_norm := lower(action); executed_action := action; original_outcome; repaired_outcome;"
            "certificate_level := level; source",
            ints="seed; step_index; candidate_count; preferred_rank_before := preferred_rank;"
            "rejected_rank_before := rejected_rank; repair_suffix_len;"
            "edited_action_len := case when r_ok then edited_len end; original_action_len := case when r_ok then original_len end",
            arrs="history; candidates",
        ) + " from prefs",
        "both", None, O.PREFS,
    ),
)

_COUNTS = (
    "num_certified_preferences := count(*) filter (where status = 'certified_preference');"
    "num_candidate_absent := count(*) filter (where status = 'repair_not_in_candidates');"
    "num_no_repair_found := count(*) filter (where status = 'no_repair_found');"
    "num_repair_same_as_executed := count(*) filter (where status = 'repair_same_as_executed');"
    "num_suffix_too_long := count(*) filter (where status = 'suffix_too_long');"
    "num_invalid_replay := count(*) filter (where status = 'invalid_replay');"
    "num_no_candidates_logged := count(*) filter (where status = 'no_candidates_logged')"
)

QUERIES["trajectory_ledger"] = (
    lambda t: L.trajectory_ledger(
        t.ledger(), t.steps.select("trajectory_id", "task_id", "seed", "success").distinct(), nested=False
    ),
    O.with_ledger(
        "select " + cols(
            raw="trajectory_id; task_id; outcome := original_outcome",
            ints="seed; num_steps := count(*); num_candidate_steps := count(*) filter (where candidate_count > 0);" + _COUNTS,
        ) + """, (select string_agg(status || '=' || n, '|' order by status) from
              (select status, count(*) as n from led l2 where l2.trajectory_id = led.trajectory_id group by status))
              as status_counts
            from led group by trajectory_id, task_id, seed, original_outcome"""
    ),
)

QUERIES["trajectory_ledger_nested_steps"] = (
    lambda t: L.trajectory_ledger(t.ledger()).select(
        "trajectory_id", F.transform("step_statuses", lambda s: F.concat(s["step_index"].cast("string"), F.lit(":"), s["status"])).alias("steps")
    ),
    O.with_ledger(
        "select trajectory_id, string_agg(step_index || ':' || status, '|' order by step_index) as steps from led group by 1"
    ),
)

QUERIES["trajectory_ledger_nested_rows"] = (
    lambda t: _ledger_rows(L.normalize_step_ledger(L.trajectory_ledger(t.ledger("both")).select(
        "trajectory_id", "task_id", "seed", "outcome", "step_statuses")), "has_logged_candidates"),
    O.with_ledger(f"select {_LEDGER_COLUMNS}, candidate_count > 0 as has_logged_candidates, {_REASON} from led", "both", None),
)

QUERIES["preference_summary"] = (
    lambda t: L.preference_summary(t.preferences()),
    O.with_ledger(
        """, lv as (select 'all' as level, '' as value, * from prefs union all select 'source', source, * from prefs
           union all select 'certificate', level, * from prefs)
        select """.replace(", lv", ", lv", 1) + cols(
            raw="level; value", ints="preferences := count(*); tasks := count(distinct task_id)",
            dbls="avg_preferred_rank_before := avg(preferred_rank)",
        ) + " from lv group by level, value",
        "both", None, O.PREFS,
    ).replace("certified_preference') , lv", "certified_preference'), lv"),
)

# The legacy layout: nested ledger rows are flattened back and counted per trajectory.
QUERIES["normalize_step_ledger"] = (
    lambda t: L.normalize_step_ledger(
        L.trajectory_ledger(t.ledger()).select("trajectory_id", "task_id", "seed", "outcome", "step_statuses")
    ).select("trajectory_id", "task_id", "seed", "step_index", "status", "original_outcome", "candidate_count", "repair_rank_before"),
    O.with_ledger(
        "select " + cols(
            raw="trajectory_id; task_id; status; original_outcome",
            ints="seed; step_index; candidate_count; repair_rank_before := preferred_rank",
        ) + " from led"
    ),
)

_DECOMP = """, tgt as (select * from led where original_outcome = 'fail' or not exists
   (select 1 from led where original_outcome = 'fail')),
 k as (select count(*) as steps, count(*) filter (where candidate_count > 0) as cs,
   count(*) filter (where status = 'certified_preference') as cp, count(*) filter (where status = 'repair_not_in_candidates') as ca,
   count(*) filter (where status = 'no_repair_found') as nr, count(*) filter (where status = 'repair_same_as_executed') as rs,
   count(*) filter (where status = 'suffix_too_long') as st, count(*) filter (where status = 'invalid_replay') as ir,
   count(*) filter (where status = 'no_candidates_logged') as nc, count(distinct trajectory_id) as tr,
   avg(preferred_rank) filter (where status = 'certified_preference') as lr from tgt)
"""


def _decomposition_sql(rank: str) -> str:
    return "select " + cols(
        ints="trajectories := (select count(distinct trajectory_id) from led);"
        "failed_trajectories := (select count(distinct trajectory_id) from led where original_outcome = 'fail');"
        "summarized_trajectories := tr; steps; candidate_steps := cs; certified_preferences := cp; candidate_absent := ca;"
        "no_repair_found := nr; repair_same_as_executed := rs; suffix_too_long := st; invalid_replay := ir;"
        "no_candidates_logged := nc",
        dbls="certified_misranking_step_rate := cp / cs; candidate_absent_step_rate := ca / cs;"
        "repair_same_as_executed_step_rate := rs / cs; no_repair_found_step_rate := nr / cs;"
        "suffix_too_long_step_rate := st / cs; invalid_replay_step_rate := ir / cs;"
        "no_candidates_logged_step_rate := nc / steps;"
        f"avg_preferred_rank_on_certified_preferences := {rank};"
        f"candidate_misranking_rate := cp / cs; candidate_absent_rate := ca / cs; avg_preferred_rank := {rank}",
    ) + " from k"


QUERIES["failure_decomposition"] = (
    lambda t: L.failure_decomposition(t.ledger("gold")),
    O.with_ledger(_DECOMP + _decomposition_sql("coalesce(lr, 0)"), "gold"),
)
QUERIES["failure_decomposition_with_preferences"] = (
    lambda t: L.failure_decomposition(t.ledger("both", 6), t.preferences("both")),
    O.with_ledger(
        ",".join(["", "plain as (" + O.with_ledger("select preferred_rank from led where status = 'certified_preference'", "both") + ")"])
        + _DECOMP + _decomposition_sql("(select avg(preferred_rank) from plain)"),
        "both", 6,
    ),
)

QUERIES["decomposition_by_trajectory"] = (
    lambda t: L.decomposition_by_trajectory(t.ledger()),
    O.with_ledger(
        "select " + cols(
            raw="trajectory_id; task_id; outcome := original_outcome",
            ints="seed; num_steps := count(*); num_candidate_steps := count(*) filter (where candidate_count > 0);" + _COUNTS,
        ) + " from led group by trajectory_id, task_id, seed, original_outcome"
    ),
)

_SENS = """, tgt as (select *, task_id || ':seed' || seed as tid from led where original_outcome = 'fail' or not exists
   (select 1 from led where original_outcome = 'fail')),
 b as (select count(*) filter (where candidate_count > 0) as cs, count(*) filter (where status = 'certified_preference') as cp,
   count(*) filter (where status = 'repair_not_in_candidates') as ca, count(*) filter (where status = 'suffix_too_long') as st from tgt)
"""
QUERIES["top_k_sensitivity"] = (
    lambda t: L.top_k_sensitivity(t.ledger()),
    O.with_ledger(
        _SENS + """, kv as (select unnest([2,3,4,5]) as k), r as (select k, count(preferred_rank) as n, sum(preferred_rank) as s,
          count(distinct tid) filter (where preferred_rank is not null) as tr from kv left join
          (select * from tgt where status = 'certified_preference') x on x.preferred_rank <= k group by k)
        select """ + cols(
            ints="top_k := k; certified_preferences_retained := n; certified_preferences_lost := cp - n; repairable_trajectories := tr",
            dbls="certified_misranking_step_rate := n / cs; candidate_absent_step_rate := (ca + cp - n) / cs;"
            "avg_preferred_rank := coalesce(s / n, 0)",
        ) + " from r, b"
    ),
)
QUERIES["suffix_budget_sensitivity"] = (
    lambda t: L.suffix_budget_sensitivity(t.ledger("both", 7)),
    O.with_ledger(
        _SENS + """, kv as (select unnest([3,5,7,1000000]) as k), r as (select k, count(repair_suffix_len) as n,
          count(distinct tid) filter (where repair_suffix_len is not null) as tr from kv left join
          (select * from tgt where status = 'certified_preference') x on x.repair_suffix_len <= k group by k)
        select """ + cols(
            raw="suffix_budget := case when k = 1000000 then 'full' else cast(k as varchar) end",
            ints="certified_preferences_retained := n; certified_preferences_lost := cp - n; repairable_trajectories := tr",
            dbls="certified_misranking_step_rate := n / cs; suffix_too_long_step_rate := (st + cp - n) / cs",
        ) + " from r, b",
        "both", 7,
    ),
)

# Branch evidence per logged candidate: the last successful edit that names it at this step.
_BRANCH = """, br as (select task_id, seed, step_index, repair_action as action, bool_or(edit_success) as ok,
    min(suffix_len) as suffix_len from edits group by all),
 f as (select h.trajectory_id, h.task_id, h.seed, h.step_index, h.action as executed_action, h.candidates, c.pos, c.cand, br.ok, br.suffix_len
   from hist h, unnest(list_transform(range(1, len(candidates) + 1), lambda i: {'pos': i, 'cand': candidates[i]})) u(c)
   left join br on br.task_id = h.task_id and br.seed = h.seed and br.step_index = h.step_index and br.action = c.cand),
 m as (select trajectory_id, task_id, seed, step_index, executed_action, len(candidates) as candidate_count,
   coalesce(list(cand order by pos) filter (where ok), []) as acts, coalesce(list(pos order by pos) filter (where ok), []) as ranks,
   coalesce(list(suffix_len order by pos) filter (where ok), []) as lens,
   count(*) filter (where ok and cand <> executed_action) as alts,
   arg_min(cand, pos) filter (where ok) as first_rank, arg_min(cand, suffix_len * 1000 + pos) filter (where ok) as shortest,
   coalesce(list(suffix_len order by pos) filter (where ok and cand <> executed_action), []) as alt_lens
   from f group by all)
"""


def branch_outcomes(t):
    """Branch result per (step, candidate), taken from the replay evidence."""
    action = F.when(F.col("edit_type") == "policy_suffix", F.get("repair_suffix", 0)).otherwise(F.col("replacement"))
    length = F.size("repair_suffix") + F.when(F.col("edit_type") == "policy_suffix", 0).otherwise(1)
    return (
        t.edits.withColumn("act", action)
        .groupBy("task_id", "seed", "step_index", F.col("act").alias("action"))
        .agg(F.bool_or("success").alias("success"), F.min(length).alias("suffix_len"))
    )


def multiplicity(t):
    return L.repair_multiplicity(t.steps, branch_outcomes(t), ["task_id", "seed", "step_index"])


QUERIES["repair_multiplicity"] = (
    multiplicity,
    O.with_ledger(
        _BRANCH + "select " + cols(
            raw="trajectory_id; task_id; executed_action; has_successful_logged_candidate := len(acts) > 0;"
            "has_successful_alternative := alts > 0; has_multiple_successful_logged_candidates := len(acts) > 1;"
            "has_multiple_successful_alternatives := alts > 1; first_rank_success := first_rank;"
            "shortest_suffix_success := shortest; tie_break_disagreement := coalesce(first_rank <> shortest, false)",
            ints="seed; step_index; candidate_count; successful_logged_candidates := len(acts); successful_alternatives := alts",
            arrs="successful_actions := acts; successful_ranks := ranks; successful_suffix_lens := lens",
        ) + " from m"
    ),
)
QUERIES["multiplicity_summary"] = (
    lambda t: L.multiplicity_summary(multiplicity(t)),
    O.with_ledger(
        _BRANCH + """, z as (select count(distinct trajectory_id) as trajectories, count(*) as cs,
          count(*) filter (where len(acts) > 0) as r, count(*) filter (where alts > 0) as a, count(*) filter (where len(acts) > 1) as ml,
          count(*) filter (where alts > 1) as ma, count(*) filter (where len(acts) > 1 and first_rank <> shortest) as d,
          count(*) filter (where len(list_filter(lens, lambda x: x = list_min(lens))) > 1) as tl,
          count(*) filter (where len(list_filter(alt_lens, lambda x: x = list_min(alt_lens))) > 1) as ta,
          sum(len(acts)) as sl, sum(alts) as sa from m)
        select """ + cols(
            ints="trajectories; candidate_steps := cs; steps_with_successful_logged_candidate := r; steps_with_successful_alternative := a;"
            "steps_with_multiple_successful_logged_candidates := ml; steps_with_multiple_successful_alternatives := ma;"
            "tie_break_disagreement_steps := d; steps_with_multiple_min_suffix_logged_candidates := tl;"
            "steps_with_multiple_min_suffix_alternatives := ta",
            dbls="successful_logged_candidate_step_rate := r / cs; successful_alternative_step_rate := a / cs;"
            "multiple_successful_logged_rate_over_candidate_steps := ml / cs;"
            "multiple_successful_logged_rate_over_repairable_steps := coalesce(ml / r, 0);"
            "multiple_successful_alternative_rate_over_repairable_steps := coalesce(ma / r, 0);"
            "tie_break_disagreement_rate_over_multi_success_steps := coalesce(d / ml, 0);"
            "multiple_min_suffix_logged_rate_over_repairable_steps := coalesce(tl / r, 0);"
            "multiple_min_suffix_alternative_rate_over_repairable_steps := coalesce(ta / r, 0);"
            "avg_successful_logged_candidates_on_repairable_steps := sl / r;"
            "avg_successful_alternatives_on_alternative_steps := sa / a",
        ) + " from z"
    ),
)
