"""Registered queries: run analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlens.operators import runs as R
from trajlens.plans import oracle_ctes as O
from trajlens.plans.catalog_ranking import _CLUSTERS, _DRAW, _REPS, _interval_sql
from trajlens.operators.bootstrap import DECOMPOSITION_METRICS
from trajlens.plans.shape import cols

QUERIES: dict = {}
REPLICATES = 1000
EPISODE = ["trajectory_id", "task_id", "seed", "rollout", "success"]


def run_log(t):
    """The step log with controller and reranker diagnostics."""
    return t.steps.select(
        *EPISODE, "event_id", "step_index", "candidates", "action", "gold_action", "game_seed",
        F.col("value").alias("reward"),
        F.expr("if(event_id % 4 = 0, cast(null as array<int>), transform(sequence(0, 4), j ->"
               " if((event_id + j) % 7 = 0, null, cast((event_id + 3 * j) % 5 + 1 as int))))").alias("raw_ranks"),
        F.expr("event_id % 3 <> 1").alias("controlled"),
        F.expr("event_id % 7 = 0").alias("top1_bad"),
        F.expr("event_id % 19 <> 0").alias("valid"),
        F.expr("filter(array(if(event_id % 5 = 0, 'noop', ''), if(event_id % 6 = 0, 'seen_state', ''),"
               " if(event_id % 8 = 0, 'inverse_with_previous', ''), if(event_id % 9 = 0, 'absorbed_after_previous', '')), r -> r <> '')").alias("controller_reasons"),
        F.expr("event_id % 3 = 0").alias("reranker_used"),
        F.expr("event_id % 6 = 0").alias("reranker_intervened"),
        F.expr("event_id % 6 = 3").alias("reranker_abstained"),
        F.expr("if(event_id % 3 = 0, cast(event_id % 50 as double) / 10, null)").alias("reranker_margin"),
    )


def diagnosed(t):
    return R.step_diagnostics(run_log(t))


def episodes(t):
    metrics = R.episode_metrics(diagnosed(t), EPISODE)
    return metrics


def _episodes_with_ids(t):
    steps = diagnosed(t)
    extra = steps.groupBy("trajectory_id").agg(F.min("event_id").alias("ord"), F.sum("reward").alias("total_reward"))
    return R.episode_metrics(steps, EPISODE).join(extra, "trajectory_id").withColumn(
        "run", F.concat(F.lit("run"), F.col("rollout").cast("string"))
    )


_LOG = """rl as (select *, value as reward, case when event_id % 4 <> 0 then list_transform(range(0, 5), lambda j:
     case when (event_id + j) % 7 = 0 then null else (event_id + 3 * j) % 5 + 1 end) end as raw_ranks,
     event_id % 3 <> 1 as controlled, event_id % 7 = 0 as top1_bad, event_id % 19 <> 0 as valid,
     event_id % 3 = 0 as ru, event_id % 6 = 0 as ri, event_id % 6 = 3 as ra, case when event_id % 3 = 0 then (event_id % 50) / 10 end as margin from steps),
 sd0 as (select *, case when raw_ranks is null or len(list_filter(raw_ranks, lambda x: x is not null)) = 0 then candidates else
     list_transform(list_sort(list_transform(range(1, 6), lambda i: {'r': coalesce(raw_ranks[i], 5 + i), 'p': i, 'a': candidates[i]})), lambda z: z.a) end as cb from rl),
 sd as (select *, nullif(list_position(cb, gold_action), 0) as gb, nullif(list_position(candidates, gold_action), 0) as ga,
     coalesce(action = gold_action, false) as sg, coalesce(list_contains(list(action) over (partition by trajectory_id order by step_index
       rows between 4 preceding and 1 preceding), action), false) as rep from sd0),
 sx as (select *, controlled and coalesce(gb <> 1, false) and sg as rec, controlled and coalesce(gb = 1, false) and not sg as dem,
     controlled and top1_bad and action <> cb[1] as blk from sd)"""
QUERIES["step_diagnostics"] = (
    lambda t: diagnosed(t).select("trajectory_id", "step_index", "candidates_before", "gold_in_candidates", "gold_rank_before", "gold_rank_after",
                                  "selected_is_gold", "recovered_gold", "demoted_gold", "top1_action", "blocked_bad_top1"),
    f"with {O._STEPS}, {_LOG} select " + cols(
        raw="trajectory_id; gold_in_candidates := gb is not null; selected_is_gold := sg; recovered_gold := rec; demoted_gold := dem;"
        "top1_action := cb[1]; blocked_bad_top1 := blk", ints="step_index; gold_rank_before := gb; gold_rank_after := ga",
        arrs="candidates_before := cb") + " from sx",
)


def _n(condition):
    return f"count(*) filter (where {condition})"


_EP = """ep as (select trajectory_id, task_id, seed, rollout, success, min(event_id) as ord, sum(reward) as total_reward, count(*)::double as steps, """ + ", ".join(
    f"{_n(c)} as {n}" for n, c in (
        ("invalid_actions", "not valid"), ("repeated_actions", "rep"), ("noop_penalized", "event_id % 5 = 0"), ("seen_state_penalized", "event_id % 6 = 0"),
        ("inverse_penalized", "event_id % 8 = 0"), ("absorbed_penalized", "event_id % 9 = 0"), ("gold_steps", "gold_action is not null"),
        ("gold_in_candidates", "gb is not null"), ("selected_gold", "sg"), ("recovered_gold", "rec"), ("demoted_gold", "dem"),
        ("top1_structural_bad", "top1_bad"), ("blocked_bad_top1", "blk"), ("reranker_steps", "ru"), ("reranker_interventions", "ri"),
        ("reranker_abstentions", "ra"), ("reranker_recovered_gold", "ri and gb <> 1 and sg"), ("reranker_demoted_gold", "ri and gb = 1 and not sg"),
    )
) + """, coalesce(avg(gb), 0) as avg_gold_rank_before, coalesce(avg(ga), 0) as avg_gold_rank_after, coalesce(avg(margin), 0) as avg_reranker_margin
   from sx group by 1, 2, 3, 4, 5),
 em as (select *, """ + ", ".join(
    f"coalesce({a} / nullif({b}, 0), 0) as {n}" for n, a, b in (
        ("invalid_action_rate", "invalid_actions", "steps"), ("repeated_action_rate", "repeated_actions", "steps"),
        ("gold_in_candidate_rate", "gold_in_candidates", "gold_steps"), ("selected_gold_rate", "selected_gold", "gold_steps"),
        ("top1_structural_bad_rate", "top1_structural_bad", "steps"), ("blocked_bad_top1_rate", "blocked_bad_top1", "top1_structural_bad"),
        ("reranker_intervention_rate", "reranker_interventions", "reranker_steps"), ("reranker_abstain_rate", "reranker_abstentions", "reranker_steps"),
        ("reranker_gold_demotion_rate", "reranker_demoted_gold", "gold_steps"),
    )
) + " from ep)"
QUERIES["episode_metrics"] = (
    episodes,
    f"with {O._STEPS}, {_LOG}, {_EP} select " + cols(raw="trajectory_id; task_id; success", ints="seed; rollout", dbls=";".join(R.METRICS)) + " from em",
)
QUERIES["run_summary"] = (
    lambda t: R.run_summary(_episodes_with_ids(t)),
    f"with {O._STEPS}, {_LOG}, {_EP} select " + cols(
        ints="episodes := count(*)", dbls="success_rate := avg(success::int); avg_reward := avg(total_reward);" + ";".join(f"avg_{m} := avg({m})" for m in R.METRICS)) + " from em",
)
QUERIES["compare_runs"] = (
    lambda t: R.compare_runs(_episodes_with_ids(t)),
    f"with {O._STEPS}, {_LOG}, {_EP} select " + cols(
        raw="run := concat('run', rollout)", ints="episodes := count(*); failures := count(*) filter (where not success)",
        dbls="success_rate := avg(success::int); avg_steps := avg(steps); avg_reward := avg(total_reward); avg_repeat := avg(repeated_action_rate)") + " from em group by rollout",
)
QUERIES["failed_tasks"] = (
    lambda t: R.failed_tasks(_episodes_with_ids(t)),
    f"with {O._STEPS}, {_LOG}, {_EP} select " + cols(raw="run := concat('run', rollout); task := regexp_extract(task_id, '(arc_seed[0-9]+)', 1)", ints="ord") + " from em where not success",
)


def _pairs(t, by_user=True):
    """Baseline and treatment runs of the same player, or of the same task with last wins."""
    eps = _episodes_with_ids(t)
    if by_user:
        eps = eps.withColumn("task_id", F.expr("concat(task_id, '#', (seed % 1000000000) div 3, '#', seed div 1000000000)"))
    return R.paired_rows(eps.filter("rollout = 0"), eps.filter("rollout = 1"))


_PAIR = """pe as (select *, {key} as tk from em),
 pl as (select * from (select *, row_number() over (partition by rollout, tk order by ord desc) as rn from pe) where rn = 1),
 pr as (select b.tk, b.success::int as bs, w.success::int as ts, b.steps as bst, w.steps as tst, b.repeated_action_rate as br, w.repeated_action_rate as tr_,
     w.reranker_intervention_rate as ti, w.reranker_gold_demotion_rate as td, w.reranker_interventions as tn, w.reranker_demoted_gold as tdn
   from pl b join pl w on b.tk = w.tk and b.rollout = 0 and w.rollout = 1)"""
_USER = "concat(task_id, '#', (seed % 1000000000) // 3, '#', seed // 1000000000)"
_DELTA = """cl as (select tk as cluster, 1 as n, ts - bs as delta from pr), """ + _DRAW.format(n=REPLICATES) + """,
 dv as (select b, sum(w * delta)::double / sum(w * n) as v from wt group by b),
 dq as (select max(v) filter (where b < 0) as point, list(v order by v) filter (where b >= 0) as vs from dv),
 di as (select point, vs[cast(round_even(0.025 * (len(vs) - 1), 0) as int) + 1] as lo, vs[cast(round_even(0.975 * (len(vs) - 1), 0) as int) + 1] as hi from dq)"""
_P = """, rh as (select count(*) filter (where bs = 0 and ts = 1) as r, count(*) filter (where bs = 1 and ts = 0) as h from pr),
 pv as (select case when r + h > 0 then least(1.0, 2 * (select sum(exp(lgamma(r + h + 1) - lgamma(k + 1) - lgamma(r + h - k + 1) - (r + h) * ln(2)))
   from range(least(r, h) + 1) x(k))) end as p, r, h from rh)"""


def _pair_sql(key):
    return f"with recursive {O._STEPS}, {_LOG}, {_EP}, {_PAIR.format(key=key)}, {_DELTA} {_P} select " + cols(
        ints="episodes := count(*); rescued_failures := any_value(pv.r); harmed_successes := any_value(pv.h)",
        dbls="baseline_success_rate := avg(bs); treatment_success_rate := avg(ts); success_delta := avg(ts) - avg(bs);"
        "success_delta_ci_low := any_value(di.lo); success_delta_ci_high := any_value(di.hi); paired_sign_p_value := any_value(pv.p);"
        "baseline_avg_steps := avg(bst); treatment_avg_steps := avg(tst); baseline_repeat_rate := avg(br); treatment_repeat_rate := avg(tr_);"
        "treatment_intervention_rate := avg(ti); treatment_gold_demotion_rate := avg(td)") + " from pr, pv, di"


QUERIES["paired_rows"] = (
    lambda t: _pairs(t, by_user=False),
    f"with {O._STEPS}, {_LOG}, {_EP}, {_PAIR.format(key='task_id')} select " + cols(
        raw="task_id := tk", ints="baseline_success := bs; treatment_success := ts; treatment_interventions := tn; treatment_demotions := tdn",
        dbls="baseline_steps := bst; treatment_steps := tst; baseline_repeat_rate := br; treatment_repeat_rate := tr_;"
        "treatment_intervention_rate := ti; treatment_gold_demotion_rate := td") + " from pr",
)
QUERIES["paired_comparison"] = (lambda t: R.paired_comparison(_pairs(t), REPLICATES), _pair_sql(_USER))
QUERIES["bootstrap_delta"] = (
    lambda t: R.bootstrap_delta(_pairs(t), REPLICATES),
    f"with recursive {O._STEPS}, {_LOG}, {_EP}, {_PAIR.format(key=_USER)}, {_DELTA} select " + cols(
        dbls="success_delta := point; ci_low := lo; ci_high := hi") + " from di",
)
QUERIES["gold_diagnostics"] = (
    lambda t: R.gold_diagnostics(diagnosed(t).withColumn("run", F.concat(F.lit("run"), F.col("rollout").cast("string")))),
    f"with {O._STEPS}, {_LOG}, g as (select rollout, " + ", ".join(f"{_n(c)} as {n}" for n, c in (
        ("gs", "gold_action is not null"), ("f", "gb is not null"), ("s", "sg"), ("ro", "gb <> 1"), ("rc", "rec"), ("d_o", "gb = 1"), ("dm", "dem"), ("bt", "top1_bad"), ("bl", "blk"),
    )) + " from sx group by rollout) select " + cols(
        raw="run := concat('run', rollout)", ints="gold_steps := gs; recovery_opps := ro; demotion_opps := d_o; bad_top1_steps := bt",
        dbls="gold_in_topk_rate := f / gs; selected_gold_rate := s / gs; recovery_rate := rc / ro; demotion_rate := dm / d_o; bad_top1_block_rate := bl / bt") + " from g",
)
QUERIES["gold_selector_summary"] = (
    lambda t: R.gold_selector_summary(
        diagnosed(t).filter("gold_action is not null").withColumn("base_selected_gold", F.coalesce(F.col("gold_rank_before") == 1, F.lit(False)))
        .withColumn("controlled_selected_gold", F.col("selected_is_gold")).withColumn("valid_gold_step", F.col("valid"))),
    f"with {O._STEPS}, {_LOG}, g as (select count(*) as n, " + ", ".join(f"{_n(c)} as {n}" for n, c in (
        ("f", "gb is not null"), ("b1", "gb = 1"), ("s", "sg"), ("ro", "gb <> 1"), ("rc", "rec"), ("dm", "dem"), ("bt", "top1_bad"), ("bl", "blk"), ("vl", "valid"),
    )) + ", avg(gb) as ab, avg(ga) as aa from sx where gold_action is not null) select " + cols(
        ints="states := n; gold_in_topk := f; base_selected_gold := b1; controlled_selected_gold := s; recovery_opportunities := ro; recovered_gold := rc;"
        "demotion_opportunities := b1; demoted_gold := dm; top1_structural_bad := bt; blocked_bad_top1 := bl",
        dbls="gold_in_topk_rate := f / n; base_selected_gold_rate := b1 / n; controlled_selected_gold_rate := s / n; recovery_rate := rc / ro;"
        "demotion_rate := dm / b1; top1_structural_bad_rate := bt / n; blocked_bad_top1_rate := bl / bt; valid_gold_step_rate := vl / n;"
        "avg_gold_rank_before := ab; avg_gold_rank_after := aa") + " from g",
)


def rl_steps(t):
    """Learning log: every player-block is an episode of a run per game; the first step opens the numbering."""
    log = run_log(t)
    first = log.groupBy("trajectory_id").agg(F.min("event_id").alias("episode_index"))
    return log.join(first, "trajectory_id").select(
        F.expr("element_at(array('none', 'soft', 'hard'), cast(game_seed % 3 as int) + 1)").alias("prior"),
        F.col("game_seed").alias("run"), "episode_index", "reward", "success", F.col("controller_reasons").alias("reasons"),
        F.expr("event_id % 4").alias("blocked"),
    )


_RL = """ef as (select trajectory_id, min(event_id) as ei from steps group by 1),
 re as (select ['none', 'soft', 'hard'][game_seed % 3 + 1] as prior, game_seed as run, ei, bool_or(success) as ok, sum(reward) as tot, count(*) as st,
     count(*) filter (where event_id % 5 = 0 or event_id % 6 = 0) as idle, sum(event_id % 4) as bl, row_number() over (partition by game_seed order by ei desc) as rn
   from rl join ef using (trajectory_id) group by game_seed, ei),
 rs as (select prior, run, count(*) as episodes, avg(ok::int) as success_rate, avg(ok::int) filter (where rn <= 20) as last_window_success_rate,
     min(ei) filter (where ok) as first_success_episode, avg(tot) as avg_return, avg(st) as avg_steps, sum(idle) / sum(st) as noop_or_seen_selected_rate,
     sum(bl) / sum(st) as avg_blocked_actions_per_step from re group by prior, run)"""
QUERIES["rl_trace_summary"] = (
    lambda t: R.rl_trace_summary(rl_steps(t)),
    f"with {O._STEPS}, {_LOG}, {_RL} select " + cols(
        raw="prior", ints="run; episodes; first_success_episode",
        dbls="success_rate; last_window_success_rate; avg_return; avg_steps; noop_or_seen_selected_rate; avg_blocked_actions_per_step") + " from rs",
)
QUERIES["rl_run_summary"] = (
    lambda t: R.rl_run_summary(R.rl_trace_summary(rl_steps(t))),
    f"with {O._STEPS}, {_LOG}, {_RL} select " + cols(
        raw="prior", ints="runs := count(*)",
        dbls="avg_success_rate := avg(success_rate); avg_last_window_success_rate := avg(last_window_success_rate);"
        "avg_first_success_episode := avg(first_success_episode); avg_return := avg(avg_return); avg_steps := avg(avg_steps);"
        "avg_noop_or_seen_selected_rate := avg(noop_or_seen_selected_rate); avg_blocked_actions_per_step := avg(avg_blocked_actions_per_step)") + " from rs group by prior",
)
QUERIES["number_summary"] = (
    lambda t: R.number_summary(t.preferences(), "repair_suffix_len"),
    O.with_ledger("select " + cols(
        dbls="mean := avg(repair_suffix_len); median := median(repair_suffix_len);"
        "p90 := list_sort(list(repair_suffix_len))[cast(round_even(0.9 * (count(*) - 1), 0) as int) + 1]") + " from prefs", "both", None, O.PREFS),
)
_REPORT = """, tr_ as (select trajectory_id, bool_or(original_outcome = 'fail') as f, bool_or(status = 'certified_preference') as c from led group by 1),
 ff as (select count(*) filter (where f) as f, count(*) as n, count(*) filter (where f and c) as rc from tr_),
 fl as (select count(*) filter (where candidate_count > 0) as cs, count(*) filter (where status = 'certified_preference') as cp,
   count(*) filter (where status = 'invalid_replay') as ir from led where original_outcome = 'fail' or not exists (select 1 from led where original_outcome = 'fail')),
 px as (select count(*) as n, count(*) filter (where preferred_rank = 1) as t1, avg(preferred_rank) as ar, avg(repair_suffix_len) as sm, median(repair_suffix_len) as sd,
   list_sort(list(repair_suffix_len))[cast(round_even(0.9 * (count(*) - 1), 0) as int) + 1] as sp from led where status = 'certified_preference'),
 iv as (%s),
 out as (select 'data' as section, 'trajectories' as name, n::double as value, null::double as ci_low, null::double as ci_high from ff
   union all select 'data', 'failed_trajectories', f, null, null from ff union all select 'data', 'candidate_steps', cs, null, null from fl
   union all select 'data', 'certified_preferences', cp, null, null from fl union all select 'data', 'invalid_replay', ir, null, null from fl
   union all select 'repairable', 'successful_trajectories', n - f, null, null from ff union all select 'repairable', 'repairable_failed_trajectories', rc, null, null from ff
   union all select 'repairable', 'repairable_failed_trajectory_rate', rc / f, null, null from ff
   union all select 'oracle', 'preferences', n, null, null from px union all select 'oracle', 'preferred_in_candidates', n, null, null from px
   union all select 'oracle', 'preferred_top1_before', t1, null, null from px union all select 'oracle', 'avg_preferred_rank_before', ar, null, null from px
   union all select 'suffix', 'mean', sm, null, null from px union all select 'suffix', 'median', sd, null, null from px union all select 'suffix', 'p90', sp, null, null from px
   union all select 'certificate', level, count(*), null, null from led where status = 'certified_preference' group by level
   union all select 'interval', metric, point, ci_low, ci_high from iv)
""" % _interval_sql([*DECOMPOSITION_METRICS, "raw_mrr", "oracle_mrr", "raw_ndcg", "oracle_ndcg"], True)
QUERIES["run_report"] = (
    lambda t: R.run_report(*t.compiled(), REPLICATES),
    O.with_ledger(_REPORT + "select " + cols(raw="section; name", dbls="value; ci_low; ci_high") + " from out", "both", None, _CLUSTERS, _DRAW.format(n=REPLICATES), _REPS),
)
