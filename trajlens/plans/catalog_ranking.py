"""Registered queries: ranking evaluation, bootstrap, dataset builders, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlens.operators import bootstrap as B
from trajlens.operators import datasets as D
from trajlens.operators import ledger as L
from trajlens.operators import ranking as R
from trajlens.plans import oracle_ctes as O
from trajlens.plans.catalog_ledger import _BRANCH, multiplicity
from trajlens.plans.shape import cols

QUERIES: dict = {}
REPLICATES = 1000

# ---------------------------------------------------------------- ranking records and summaries

_RECORDS = """,
 rk0 as (select x.*, pr.abstain, case when not pr.abstain then
     list_transform(list_sort(list_transform(range(1, len(x.candidates) + 1),
       lambda i: {'s': -pr.scores[i], 'p': i, 'a': x.candidates[i]})), lambda z: z.a) end as ord_list, pr.step_index is not null as has_p
   from %s x left join preds pr on pr.task_id = x.task_id and pr.seed = x.seed and pr.step_index = x.step_index),
 rk as (select *, nullif(list_position(candidates, pref), 0) as r, nullif(list_position(candidates, rej), 0) as rr,
     nullif(list_position(ord_list, pref), 0) as lr, has_p and not abstain as act, ord_list[1] as lt from rk0)"""
_PREF_IN = """, pin as (select *, preferred as pref, action as rej from prefs)"""


def _ranking_sql(body, *more):
    return O.with_ledger(
        body, "both", None, O.PREFS, _PREF_IN[2:], O.PREDS, (_RECORDS % "pin")[2:], *more
    )


QUERIES["evaluate_ranking"] = (
    lambda t: R.evaluate_ranking(t.preferences(), t.predictions).drop("trajectory_id", "game_seed"),
    _ranking_sql(
        "select " + cols(
            raw="task_id; preferred_action := pref; rejected_action := rej; preferred_in_candidates := r is not null;"
            "raw_top1_is_preferred := coalesce(r = 1, false); has_learned_prediction := has_p; learned_abstained := abstain;"
            "learned_top1 := lt; learned_top1_is_preferred := case when act then coalesce(lr = 1, false) end;"
            "learned_demoted_raw_gold := coalesce(r = 1, false) and act and not coalesce(lr = 1, false)",
            ints="seed; step_index; preferred_rank_before := r; rejected_rank_before := rr; learned_rank := lr",
            dbls="raw_mrr := coalesce(1.0 / r, 0); oracle_mrr := case when r is null then 0 else 1 end;"
            "raw_ndcg := coalesce(1.0 / log2(r + 1), 0); oracle_ndcg := case when r is null then 0 else 1 end;"
            "learned_mrr := case when act then coalesce(1.0 / lr, 0) end;"
            "learned_ndcg := case when act then coalesce(1.0 / log2(lr + 1), 0) end",
        ) + " from rk"
    ),
)

_SUMMARY = cols(
    ints="preferences := count(*); preferred_in_candidates := count(r); preferred_top1_before := count(*) filter (where r = 1);"
    "learned_predictions := count(*) filter (where has_p); learned_evaluated_preferences := count(*) filter (where act)",
    dbls="candidate_coverage_rate := coalesce(count(r) / nullif(count(*), 0), 0); avg_preferred_rank_before := coalesce(avg(r), 0);"
    "raw_mrr := coalesce(avg(coalesce(1.0 / r, 0)), 0); oracle_mrr := coalesce(count(r) / nullif(count(*), 0), 0);"
    "learned_mrr := avg(coalesce(1.0 / lr, 0)) filter (where act); raw_ndcg := coalesce(avg(coalesce(1.0 / log2(r + 1), 0)), 0);"
    "oracle_ndcg := coalesce(count(r) / nullif(count(*), 0), 0); learned_ndcg := avg(coalesce(1.0 / log2(lr + 1), 0)) filter (where act);"
    "learned_prediction_coverage_rate := coalesce(count(*) filter (where has_p) / nullif(count(*), 0), 0);"
    "learned_abstain_rate := count(*) filter (where has_p and abstain) / nullif(count(*) filter (where has_p), 0);"
    "learned_top1_correction_rate := count(*) filter (where act and lr = 1) / nullif(count(*) filter (where act), 0);"
    "gold_demotion_rate := count(*) filter (where act and r = 1 and coalesce(lr, 0) <> 1) / nullif(count(*) filter (where act and r = 1), 0);"
    "learned_harm_rate := count(*) filter (where act and r = 1 and coalesce(lr, 0) <> 1) / nullif(count(*) filter (where act and r = 1), 0)",
)
QUERIES["ranking_summary"] = (
    lambda t: R.ranking_summary(R.evaluate_ranking(t.preferences(), t.predictions)),
    _ranking_sql("select " + _SUMMARY + " from rk"),
)
QUERIES["ranking_by_action_type"] = (
    lambda t: R.ranking_by_action_type(t.preferences(), t.predictions),
    _ranking_sql(
        "select g as action_group, " + _SUMMARY + " from rk, (select unnest(['all', 'navigation', 'non_navigation']) as g)"
        " where g = 'all' or (g = 'navigation') = (split_part(pref, ' ', 1) = 'go') group by g"
    ),
)
QUERIES["verb_counts"] = (
    lambda t: R.verb_counts(t.preferences()),
    _ranking_sql("select split_part(pref, ' ', 1) as verb, cast(count(*) as bigint) as preferences from rk group by 1"),
)
QUERIES["method_table"] = (
    lambda t: R.method_table({"scores": R.ranking_summary(R.evaluate_ranking(t.preferences(), t.predictions))}),
    _ranking_sql(
        ", s as (select " + _SUMMARY + " from rk) select " + cols(
            raw="method", dbls="mrr; ndcg; top1_correction; abstain_rate") +
        """ from (select 'raw' as method, raw_mrr as mrr, raw_ndcg as ndcg, 0.0 as top1_correction, 0.0 as abstain_rate from s
            union all select 'oracle', 1.0, 1.0, 1.0, null from s
            union all select 'scores', learned_mrr, learned_ndcg, learned_top1_correction_rate, learned_abstain_rate from s)"""
    ),
)

# ---------------------------------------------------------------- retention and demotion

_SKIP = """ret as (select *, case when not success then 'failed_trajectory' when gold_action is null then 'no_gold_action'
   when candidates[1] <> gold_action then 'gold_not_raw_top1' when action <> gold_action then 'selected_not_gold' end as skip from hist)"""


def _retention(t, cap=None):
    return D.retention_dataset(L.with_history(t.steps, keep_empty=True).withColumn("ord", F.col("event_id")), max_records=cap)


QUERIES["retention_dataset"] = (
    lambda t: _retention(t).drop("ord", "trajectory_id", "game_seed"),
    O.with_history(
        "select " + cols(
            raw="task_id; preferred_action := gold_action; preferred_action_norm := lower(gold_action);"
            "rejected_action := candidates[2]; rejected_action_norm := lower(candidates[2]); source := 'success_policy_retention';"
            "certificate_level := 'K1_success_policy_gold'; original_outcome := 'success'; retention_target := true",
            ints="seed; step_index; candidate_count := 5; preferred_rank_before := 1; rejected_rank_before := 2",
            arrs="history; candidates",
        ) + " from ret where skip is null", _SKIP,
    ),
)
QUERIES["retention_summary"] = (
    lambda t: D.retention_summary(t.steps),
    O.with_history(
        "select " + cols(
            ints="trajectories := count(distinct trajectory_id); success_trajectories := count(distinct trajectory_id) filter (where success);"
            "failed_trajectories := count(distinct trajectory_id) filter (where not success);"
            "considered_steps := count(*) filter (where success); retention_records := count(*) filter (where skip is null);"
            + ";".join(
                f"skipped_{r} := count(*) filter (where skip = '{r}')"
                for r in ("failed_trajectory", "no_gold_action", "no_candidates", "gold_not_raw_top1", "single_candidate", "selected_not_gold")
            )
        ) + " from ret", _SKIP,
    ),
)
_RET_IN = "rin as (select *, gold_action as pref, candidates[2] as rej from ret where skip is null)"
_DEMOTED = """, z as (select count(*) as n, count(*) filter (where has_p) as p, count(*) filter (where has_p and abstain) as ab,
            count(*) filter (where act) as iv, count(*) filter (where act and r = 1 and coalesce(lr, 0) <> 1) as de,
            count(*) filter (where act and r = 1 and lr = 1) as held from rk) """
QUERIES["gold_demotion"] = (
    lambda t: R.gold_demotion(_retention(t), t.predictions),
    O.with_history(
        _DEMOTED + "select " + cols(
            ints="retention_records := n; predicted_records := p; abstained := ab; intervened := iv; gold_demotions := de",
            dbls="prediction_coverage_rate := p / n; abstain_rate := ab / nullif(p, 0); intervention_rate := iv / nullif(p, 0);"
            "gold_demotion_rate_over_all_predicted := de / nullif(p, 0); gold_demotion_rate_when_intervened := de / nullif(iv, 0);"
            "gold_retention_rate_with_abstention := (ab + held) / nullif(p, 0); gold_retention_rate_when_intervened := held / nullif(iv, 0)",
        ) + " from z",
        _SKIP, _RET_IN, O.PREDS, (_RECORDS % "rin")[2:],
    ),
)
QUERIES["retention_table"] = (
    lambda t: R.retention_table({"0": R.gold_demotion(_retention(t), t.predictions)}),
    O.with_history(
        _DEMOTED + "select " + cols(
            raw="margin := '0'", dbls="abstain_rate := ab / nullif(p, 0); intervention_rate := iv / nullif(p, 0);"
            "gold_demotion_rate := de / nullif(p, 0); gold_retention_rate := (ab + held) / nullif(p, 0)",
        ) + " from z",
        _SKIP, _RET_IN, O.PREDS, (_RECORDS % "rin")[2:],
    ),
)

# ---------------------------------------------------------------- preferences against a recorded run


def _run(t):
    """A run whose even games are logged by stem only and which lacks one step in thirteen."""
    return t.steps.filter("event_id % 13 <> 0").select(
        F.expr("if(game_seed % 2 = 0, concat('arc_seed', game_seed), task_id)").alias("task_id"),
        "seed", "step_index", "candidates", "action", F.col("event_id").alias("ord"),
    )


_AGAINST = """rn as (select case when game_seed % 2 = 0 then concat('arc_seed', game_seed) else task_id end as run_task, * from steps
     where event_id % 13 <> 0),
 ag as (select p.task_id, p.seed, p.step_index, p.preferred as pref, p.action as rej, p.source, r.action as sel, r.event_id is null as missing,
     nullif(list_position(r.candidates, p.preferred), 0) as r, nullif(list_position(r.candidates, p.action), 0) as rr
   from prefs p left join rn r on r.seed = p.seed and r.step_index = len(p.history)
     and (r.run_task = p.task_id or r.run_task = concat('arc_seed', p.game_seed)))"""
QUERIES["evaluate_against_run"] = (
    lambda t: R.evaluate_against_run(_run(t), t.preferences(history=True)),
    O.with_ledger(
        "select " + cols(
            raw="task_id; preferred_action := pref; rejected_action := rej; selected_action := sel; source; missing_step := missing;"
            "selected_was_rejected := coalesce(sel = rej, false); preferred_in_candidates := r is not null;"
            "would_make_preferred_top1 := r is not null; preferred_misranked := coalesce(r > 1, false)",
            ints="seed; step_index; preferred_rank_before := r; rejected_rank_before := rr",
            dbls="raw_mrr := coalesce(1.0 / r, 0); oracle_mrr := case when r is null then 0 else 1 end;"
            "raw_ndcg := coalesce(1.0 / log2(r + 1), 0); oracle_ndcg := case when r is null then 0 else 1 end",
        ) + " from ag",
        "both", None, O.PREFS, _AGAINST,
    ),
)
QUERIES["run_preference_summary"] = (
    lambda t: R.run_preference_summary(R.evaluate_against_run(_run(t), t.preferences(history=True))),
    O.with_ledger(
        """, z as (select count(*) as n, count(*) filter (where not missing) as m, count(r) as f, count(*) filter (where sel = rej) as sr,
            count(*) filter (where r = 1) as top, count(*) filter (where r > 1) as mis, avg(r) as ar,
            sum(coalesce(1.0 / r, 0)) as rr, sum(coalesce(1.0 / log2(r + 1), 0)) as rn from ag) select """ + cols(
            ints="preferences := n; matched_steps := m; preferred_in_candidates := f; selected_was_rejected := sr;"
            "preferred_top1_before := top; preferred_misranked := mis; would_make_preferred_top1 := f",
            dbls="candidate_coverage_rate := f / n; candidate_absent_rate := (m - f) / m; selected_is_rejected_rate := sr / m;"
            "misranking_rate := mis / f; oracle_top1_repairable_rate := f / f; avg_preferred_rank_before := ar; raw_mrr := rr / n;"
            "oracle_mrr := f / n; learned_mrr := null; raw_ndcg := rn / n; oracle_ndcg := f / n; learned_ndcg := null;"
            "learned_top1_correction_rate := null; learned_abstain_rate := null; learned_harm_rate := null",
        ) + " from z",
        "both", None, O.PREFS, _AGAINST,
    ),
)

# ---------------------------------------------------------------- replay values, context

_VALUES = """rv0 as (select p.task_id, p.seed, p.step_index, p.preferred as pref, p.action as rej, p.candidates, c.pos, c.cand,
     case when br.ok then 0.55 + 0.45 / (1 + br.suffix_len) else 0 end as base
   from prefs p, unnest(list_transform(range(1, len(p.candidates) + 1), lambda i: {'pos': i, 'cand': p.candidates[i]})) u(c)
   left join br on br.task_id = p.task_id and br.seed = p.seed and br.step_index = p.step_index and br.action = c.cand),
 rv as (select *, case when cand = pref then greatest(base, 1.0) when cand = rej then least(base, 0.2) else base end as v from rv0)"""
QUERIES["replay_value_targets"] = (
    lambda t: D.replay_value_targets(t.preferences(), multiplicity(t)).select(
        "task_id", "seed", "step_index", "preferred_action", "rejected_action", "replay_value_successful_candidates",
        F.posexplode(F.map_entries("candidate_rewards")).alias("pos", "entry"),
    ).select("task_id", "seed", "step_index", "preferred_action", "rejected_action", "replay_value_successful_candidates",
             F.col("entry.key").alias("candidate"), F.col("entry.value").alias("reward")),
    O.with_ledger(
        "select " + cols(
            raw="task_id; preferred_action := pref; rejected_action := rej; candidate := cand",
            ints="seed; step_index; replay_value_successful_candidates := count(*) filter (where v > 0 and cand <> rej)"
            " over (partition by task_id, seed, step_index)",
            dbls="reward := v",
        ) + " from rv",
        "both", None, O.PREFS, _BRANCH.strip().lstrip(","), _VALUES,
    ),
)
QUERIES["replay_value_summary"] = (
    lambda t: D.replay_value_summary(D.replay_value_targets(t.preferences(), multiplicity(t))),
    O.with_ledger(
        ", g as (select count(*) filter (where v > 0) as pos from rv group by task_id, seed, step_index) select " + cols(
            ints="records := count(*); records_with_values := count(*); records_with_multiple_positive_values := count(*) filter (where pos > 1)",
            dbls="multiple_positive_rate := count(*) filter (where pos > 1) / count(*)",
        ) + " from g",
        "both", None, O.PREFS, _BRANCH.strip().lstrip(","), _VALUES,
    ),
)


def observations(t):
    """Observation log: one text per step from the logged state, some steps missing, some invalid."""
    return t.steps.filter("event_id % 23 <> 0").select(
        "task_id", "seed", "step_index",
        F.expr("concat('state ', pre_state, ' of ', game_seed)").alias("observation"),
        F.expr("event_id % 17 <> 0").alias("valid"),
    )


_OBS = """obs as (select task_id, seed, step_index, concat('state ', pre_state, ' of ', game_seed) as observation, event_id % 17 <> 0 as valid
   from steps where event_id % 23 <> 0),
 ctx as (select p.*, i.observation as initial_observation, case when o.valid then o.observation end as observation,
     coalesce(o.valid, false) as ok from prefs p
   left join (select * from obs where step_index = 0) i on i.task_id = p.task_id and i.seed = p.seed
   left join obs o on o.task_id = p.task_id and o.seed = p.seed and o.step_index = p.step_index)"""
QUERIES["attach_context"] = (
    lambda t: D.attach_context(t.preferences(), observations(t)).select(
        "task_id", "seed", "step_index", "preferred_action", "initial_observation", "observation", "replay_context_valid"),
    O.with_ledger(
        "select " + cols(raw="task_id; preferred_action := preferred; initial_observation; observation; replay_context_valid := ok", ints="seed; step_index")
        + " from ctx", "both", None, O.PREFS, _OBS,
    ),
)
QUERIES["context_summary"] = (
    lambda t: D.context_summary(D.attach_context(t.preferences(), observations(t))),
    O.with_ledger(
        "select " + cols(ints="records := count(*); enriched := count(*); replay_context_errors := count(*) filter (where not ok)") + " from ctx",
        "both", None, O.PREFS, _OBS,
    ),
)

# ---------------------------------------------------------------- splits

_SPLIT = """gr as (select g, md5('7:' || g) as h, row_number() over (order by md5('7:' || g), g) - 1 as i, count(*) over () as n
   from (select distinct cast({key} as varchar) as g from prefs)),
 sp as (select p.*, gr.g, case when n <= 1 then 'train' when i < greatest(1, round_even(n * 0.3, 0)) then 'test'
     when i < greatest(1, round_even(n * 0.3, 0)) + greatest(1, round_even(n * 0.1, 0)) then 'valid' else 'train' end as split
   from prefs p join gr on gr.g = cast({key} as varchar))"""


def _splits(t, by):
    return D.make_splits(t.preferences(), by, (0.6, 0.1, 0.3), seed=7)


for _by, _key in (
    ("seed", "coalesce(nullif(game_seed, 0), seed)"), ("game_id", "concat('arc_seed', game_seed)"),
    ("config_id", "'games'"), ("trajectory_id", "trajectory_id"), ("task_id", "task_id"),
):
    QUERIES[f"make_splits_by_{_by}"] = (
        lambda t, by=_by: _splits(t, by).select("task_id", "seed", "step_index", "split_group", "split"),
        O.with_ledger("select " + cols(raw="task_id; split_group := g; split", ints="seed; step_index") + " from sp",
                      "both", None, O.PREFS, _SPLIT.format(key=_key)),
    )


def seed_splits(t):
    return _splits(t, "seed")


SPLIT_ORACLE = O.with_ledger("select " + cols(raw="task_id; split", ints="seed; step_index") + " from sp", "both", None, O.PREFS,
                             _SPLIT.format(key="coalesce(nullif(game_seed, 0), seed)"))


def checked_splits(t):
    splits = seed_splits(t)
    D.assert_no_leakage(splits)
    return splits.select("task_id", "seed", "step_index", "split")


QUERIES["assert_no_leakage"] = (checked_splits, SPLIT_ORACLE)
QUERIES["split_summary"] = (
    lambda t: D.split_summary(_splits(t, "seed")),
    O.with_ledger(
        "select " + cols(raw="split", ints="records := count(*); groups := count(distinct g); leaking_groups := 0") + " from sp group by split",
        "both", None, O.PREFS, _SPLIT.format(key="coalesce(nullif(game_seed, 0), seed)"),
    ),
)

# ---------------------------------------------------------------- bootstrap

# Draws are split down a tree of ranges of clusters (bt: one digit of one node at a time), then made inside a range.
_DRAW = """nb as (select *, row_number() over (order by md5(cluster), cluster) - 1 as idx from cl),
 sz as (select count(*) as total, greatest(0, ceil(log2(greatest(count(*), 1) / {size}.0)))::int as levels from cl),
 bt as (select levels, total, unnest([struct_pack(b := r.b, level := 0, node := 0::bigint, draws := total, digit := 0, o := total, won := 0::bigint,
     rest := (total // 2)::bigint, whole := total::bigint)], recursive := true) from sz, range({n}) r(b)
   union all select levels, total, unnest(case when o > 0 then [struct_pack(b := b, level := level, node := node, draws := draws, digit := digit + 1,
         o := case when r2 = 0 then 0 when bit then k else o - k end, won := won + case when bit then o - k else 0 end, rest := r2, whole := whole)]
       else [struct_pack(b := b, level := level + 1, node := c, draws := case when c % 2 = 0 then won else draws - won end, digit := 0,
         o := case when c % 2 = 0 then won else draws - won end, won := 0::bigint,
         rest := (((c * 2 + 1) * total) >> (level + 2)) - ((c * total) >> (level + 1)),
         whole := (((c + 1) * total) >> (level + 1)) - ((c * total) >> (level + 1))) for c in [node * 2, node * 2 + 1]] end, recursive := true)
     from (select *, rest * 2 >= whole as bit, case when rest * 2 >= whole then rest * 2 - whole else rest * 2 end as r2,
         coalesce(list_sum([bit_count(('0x' || substr(md5(concat('0:split:', b, ':', level, ':', node, ':', digit, ':', w)), 1, 15))::bigint
           & case when o - w * 60 >= 60 then -1 else (1::bigint << (o - w * 60)::int) - 1 end) for w in range((o + 59) // 60)]), 0)::bigint as k
       from bt where level < levels)),
 dr as (select b, lo + ('0x' || substr(md5(concat('0:', b, ':', node, ':', j)), 1, 15))::bigint % (hi - lo) as idx
   from (select b, node, draws, (node * total) >> levels as lo, ((node + 1) * total) >> levels as hi from bt where level = levels), range(draws) r(j)),
 wt as (select -1 as b, 1 as w, nb.* from nb union all
   select dr.b, 1 as w, nb.* from dr join nb on nb.idx = dr.idx)"""
_DRAW = _DRAW.replace("{size}", str(B.BUCKET_CLUSTERS))
_POISSON = "wt as (select -1 as b, 1 as w, cl.* from cl union all select * from (select b, " + " + ".join(
    f"(case when ('0x' || substr(md5(concat('0:', b, ':', cluster)), 1, 15))::bigint % 4294967296 / 4294967296.0 >= {limit!r} then 1 else 0 end)"
    for limit in B.POISSON_STEPS
) + " as w, cl.* from cl, range({n}) r(b)) where w > 0)"
_CLUSTERS = """cl0 as (select task_id || ':seed' || seed as cluster, *, original_outcome = 'fail' as f from led),
 cl as (select cluster, count(*) as sa, count(*) filter (where f) as sf,
   count(*) filter (where candidate_count > 0) as ca, count(*) filter (where candidate_count > 0 and f) as cf,
   """ + ", ".join(
    f"count(*) filter (where status = '{s}') as {n}a, count(*) filter (where status = '{s}' and f) as {n}f"
    for s, n in (("certified_preference", "cp"), ("repair_not_in_candidates", "ab"), ("repair_same_as_executed", "rs"), ("no_repair_found", "nr"))
) + """, count(preferred_rank) filter (where status = 'certified_preference') as pn,
   coalesce(sum(preferred_rank) filter (where status = 'certified_preference'), 0) as ps,
   coalesce(sum(1.0 / preferred_rank) filter (where status = 'certified_preference'), 0) as rr,
   coalesce(sum(1.0 / log2(preferred_rank + 1)) filter (where status = 'certified_preference'), 0) as rg
   from cl0 group by cluster)"""
_REPS = """rp as (select b, """ + ", ".join(
    f"sum(w * {c}) as {c}" for c in ("sa", "sf", "ca", "cf", "cpa", "cpf", "aba", "abf", "rsa", "rsf", "nra", "nrf", "pn", "ps", "rr", "rg")
) + """ from wt group by b),
 mv as (select b, case when sf > 0 then cpf / nullif(cf, 0) else cpa / nullif(ca, 0) end as certified_misranking_step_rate,
   case when sf > 0 then abf / nullif(cf, 0) else aba / nullif(ca, 0) end as candidate_absent_step_rate,
   case when sf > 0 then rsf / nullif(cf, 0) else rsa / nullif(ca, 0) end as repair_same_as_executed_step_rate,
   case when sf > 0 then nrf / nullif(cf, 0) else nra / nullif(ca, 0) end as no_repair_found_step_rate,
   ps / nullif(pn, 0) as avg_preferred_rank_on_certified_preferences, rr / nullif(pn, 0) as raw_mrr,
   pn / nullif(pn, 0) as oracle_mrr, rg / nullif(pn, 0) as raw_ndcg, pn / nullif(pn, 0) as oracle_ndcg from rp)"""


def _interval_sql(names, zero):
    wrap = "coalesce({}, 0.0)" if zero else "{}"
    return " union all ".join(
        "select " + cols(
            raw=f"metric := '{name}'",
            dbls=f"point := max({wrap.format(name)}) filter (where b < 0);"
            f"ci_low := quantile_cont({wrap.format(name)}, 0.025) filter (where b >= 0);"
            f"ci_high := quantile_cont({wrap.format(name)}, 0.975) filter (where b >= 0)",
        ) + " from mv" for name in names
    )


for _name, _method, _text in (("bootstrap_metrics", "multinomial", _DRAW), ("bootstrap_metrics_poisson", "poisson", _POISSON)):
    QUERIES[_name] = (
        lambda t, m=_method: B.bootstrap_metrics(*t.compiled(), REPLICATES, 0, m),
        O.with_ledger(
            _interval_sql([*B.DECOMPOSITION_METRICS, "raw_mrr", "oracle_mrr", "raw_ndcg", "oracle_ndcg"], True),
            "both", None, _CLUSTERS, _text.format(n=REPLICATES), _REPS,
        ),
    )

_RCL = """cl as (select task_id || ':seed' || seed as cluster, count(*) as n, sum(coalesce(1.0 / r, 0)) as rr, sum(coalesce(1.0 / log2(r + 1), 0)) as rg,
   count(*) filter (where has_p) as p, count(*) filter (where has_p and abstain) as ab, count(*) filter (where act) as a,
   coalesce(sum(coalesce(1.0 / lr, 0)) filter (where act), 0) as lrr, coalesce(sum(coalesce(1.0 / log2(lr + 1), 0)) filter (where act), 0) as lg,
   count(*) filter (where act and lr = 1) as lt1 from rk group by 1)"""
_RREPS = "rp as (select b, " + ", ".join(f"sum(w * {c}) as {c}" for c in ("n", "rr", "rg", "p", "ab", "a", "lrr", "lg", "lt1")) + """ from wt group by b),
 mv as (select b, rr / n as raw_mrr, lrr / nullif(a, 0) as learned_mrr, rg / n as raw_ndcg, lg / nullif(a, 0) as learned_ndcg,
   lt1 / nullif(a, 0) as learned_top1_correction_rate, ab / nullif(p, 0) as learned_abstain_rate from rp)"""
QUERIES["bootstrap_ranking"] = (
    lambda t: B.bootstrap_ranking(t.preferences(), t.predictions, REPLICATES),
    _ranking_sql(
        _interval_sql(["raw_mrr", "learned_mrr", "raw_ndcg", "learned_ndcg", "learned_top1_correction_rate", "learned_abstain_rate"], False),
        _RCL, _DRAW.format(n=REPLICATES), _RREPS,
    ),
)
