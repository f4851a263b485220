"""Registered queries: state transitions, rerankers, gates and controllers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trajlens.operators import ledger as L
from trajlens.operators import rerank as G
from trajlens.operators import transitions as I
from trajlens.plans import oracle_ctes as O
from trajlens.plans.catalog_actions import UNDO, _ADM, _STATES  # noqa: F401 - shared CTE text
from trajlens.plans.shape import cols
from trajlens.sources.fixtures import _vocabulary

QUERIES: dict = {}

# ---------------------------------------------------------------- inputs


def transitions(t):
    """Logged transitions with a validity flag that depends on state and action only."""
    log = t.transitions.withColumn("valid", F.expr("(state * 5 + length(action)) % 11 <> 0"))
    return I.build_transitions(log)


_T = "tv as (select *, (state * 5 + length(action)) % 11 <> 0 as valid from trans)"


def pairs(t):
    """Action pairs to relate: each executed action with the next one and with its first candidate."""
    order = Window.partitionBy("trajectory_id").orderBy("step_index")
    rows = t.steps.withColumn("following", F.lead("action").over(order))
    return rows.select(
        "task_id", "seed", F.col("pre_state").alias("state"), F.col("action").alias("action_a"),
        F.explode(F.array_compact(F.array("following", F.get("candidates", 0)))).alias("action_b"),
    )


def contexts(t):
    """Decision contexts: state, previous state, history, seen states, admissible actions, scored candidates."""
    order = Window.partitionBy("trajectory_id").orderBy("step_index")
    rows = I.with_seen_states(t.history.withColumn("previous_state", F.lag("pre_state").over(order)))
    return rows.select(
        "trajectory_id", "task_id", "seed", "step_index", "event_id", F.col("pre_state").alias("state"), "previous_state", "history", "seen_states",
        "candidates", "action", "game_seed",
        F.expr("transform(sequence(0, 4), j -> cast((event_id * 17 + j * 29) % 40 as double) / 10)").alias("scores"),
        F.expr("case event_id % 3 when 0 then cast(array() as array<string>) when 1 then array_append(slice(candidates, 1, 4), 'look')"
               " else concat(candidates, array('look', 'inventory')) end").alias("admissible"),
        F.expr("if(event_id % 4 = 0, cast(null as array<int>), transform(sequence(0, 4), j ->"
               " if((event_id + j) % 7 = 0, null, cast((event_id + 3 * j) % 5 + 1 as int))))").alias("raw_ranks"),
    )


_CX = """cx as (select h.*, lag(pre_state) over (partition by trajectory_id order by step_index) as prev_state,
     list_distinct(list(pre_state) over (partition by trajectory_id order by step_index rows between unbounded preceding and current row)) as seen,
     list_transform(range(0, 5), lambda j: ((event_id * 17 + j * 29) % 40) / 10) as sc,
     case event_id % 3 when 0 then []::varchar[] when 1 then candidates[1:4] || ['look'] else candidates || ['look', 'inventory'] end as adm,
     case when event_id % 4 <> 0 then list_transform(range(0, 5), lambda j: case when (event_id + j) % 7 = 0 then null else (event_id + 3 * j) % 5 + 1 end) end as raw_ranks
   from hist h),
 cc as (select cx.*, i - 1 as pos, candidates[i] as cand, sc[i] as s from cx, range(1, 6) r(i))"""


def _cx_sql(body, *more):
    return "with recursive " + ",".join([O._STEPS, O._HISTORY, O._TRANS, _T, _CX, *more]) + " " + body


# ---------------------------------------------------------------- transitions

QUERIES["build_transitions"] = (
    lambda t: I.build_transitions(t.transitions.withColumn("action", F.expr("split_part(action, ' ', 1)"))),
    O.with_transitions("""select task_id, seed, state, action, min(next_state) as next_state, max(reward) as reward, min(case when rk = 1 then done::int end)::boolean as done, true as valid,
        count(*) as observations, count(distinct next_state::varchar || done::varchar) > 1 as conflict from (select *, dense_rank() over (partition by task_id, seed, state, action order by next_state, done) as rk
        from (select task_id, seed, pre_state as state, split_part(action, ' ', 1) as action, post_state as next_state,
          case when post_state = game_seed % 6 and post_state <> pre_state then 1.0 else 0.0 end as reward, post_state = game_seed % 6 and post_state <> pre_state as done from steps)) group by all"""
        .replace("select task_id, seed, state, action, min(next_state) as next_state, max(reward) as reward", "select task_id, seed, cast(state as bigint) as state, action, cast(min(next_state) as bigint) as next_state, round(cast(max(reward) as double), 9) as reward")),
)
QUERIES["transition_conflicts"] = (
    lambda t: I.conflict_report(I.build_transitions(t.transitions.withColumn("action", F.expr("split_part(action, ' ', 1)")))),
    O.with_transitions(", k as (select count(*) as n, count(distinct post_state) > 1 as c from steps group by task_id, seed, pre_state, split_part(action, ' ', 1)) select " + cols(
        ints="transitions := count(*); observations := sum(n); conflicts := count(*) filter (where c)", dbls="conflict_rate := count(*) filter (where c) / count(*)") + " from k"),
)
_PAIRS = """pq as (select task_id, seed, pre_state as state, action as a, lead(action) over (partition by trajectory_id order by step_index) as b from steps
   union all select task_id, seed, pre_state, action, candidates[1] from steps),
 pp as (select distinct * from pq where b is not null),
 rl as (select pp.*, ta.next_state as sa, ta.valid as va, tb.next_state as sb, tb.valid as vb,
     xab.next_state as sab, case when not ta.valid then false when ta.valid then xab.valid end as vab, xba.next_state as sba, case when not tb.valid then false when tb.valid then xba.valid end as vba,
     xaa.next_state as saa, case when not ta.valid then false when ta.valid then xaa.valid end as vaa, xbb.next_state as sbb, case when not tb.valid then false when tb.valid then xbb.valid end as vbb
   from pp left join tv ta on ta.task_id = pp.task_id and ta.seed = pp.seed and ta.state = pp.state and ta.action = pp.a
     left join tv tb on tb.task_id = pp.task_id and tb.seed = pp.seed and tb.state = pp.state and tb.action = pp.b
     left join tv xab on xab.task_id = pp.task_id and xab.seed = pp.seed and xab.state = ta.next_state and xab.action = pp.b
     left join tv xba on xba.task_id = pp.task_id and xba.seed = pp.seed and xba.state = tb.next_state and xba.action = pp.a
     left join tv xaa on xaa.task_id = pp.task_id and xaa.seed = pp.seed and xaa.state = ta.next_state and xaa.action = pp.a
     left join tv xbb on xbb.task_id = pp.task_id and xbb.seed = pp.seed and xbb.state = tb.next_state and xbb.action = pp.b)"""
QUERIES["action_relations"] = (
    lambda t: I.action_relations(pairs(t), transitions(t)),
    O.with_transitions("select " + cols(
        raw="""task_id; action_a := a; action_b := b; a_ok := va; b_ok := vb; ab_ok := vab; ba_ok := vba; aa_ok := vaa; bb_ok := vbb;
          commute := case when vab and vba then sab = sba end; idempotent_a := case when va and vaa then sa = saa end; idempotent_b := case when vb and vbb then sb = sbb end;
          inverse_ab := case when va and vab then state <> sa and state = sab end; inverse_ba := case when vb and vba then state <> sb and state = sba end;
          absorb_ab := case when va and vab then sa = sab end; absorb_ba := case when vb and vba then sb = sba end;
          dependency_a_then_b := not vb and vab; dependency_b_then_a := not va and vba""", ints="seed; state") + " from rl", _T, _PAIRS),
)
_DIST = """rd(task_id, seed, state, d) as (select distinct task_id, seed, state, 1 from tv where done and valid
   union select t.task_id, t.seed, t.state, d + 1 from rd join tv t on t.task_id = rd.task_id and t.seed = rd.seed and t.next_state = rd.state
     and not t.done and t.valid where d < 12),
 ds as (select task_id, seed, state, min(d) as d from rd group by all),
 bo as (select tv.*, case when not tv.valid then null when tv.done then 0 else ds.d end as ln from tv left join ds on ds.task_id = tv.task_id and ds.seed = tv.seed and ds.state = tv.next_state)"""
QUERIES["state_distances"] = (
    lambda t: I.state_distances(transitions(t)),
    O.with_transitions("select " + cols(raw="task_id", ints="seed; state; distance := d") + " from ds", _T, _DIST),
)
QUERIES["branch_outcomes"] = (
    lambda t: I.branch_outcomes(transitions(t)),
    O.with_transitions("select " + cols(raw="task_id; action; valid; success := ln is not null", ints="seed; state; suffix_len := coalesce(ln, 13)") + " from bo", _T, _DIST),
)
def some_invalid(t):
    """The log with a third of the steps that change nothing marked invalid."""
    return t.steps.withColumn("valid", F.expr("not (post_state = pre_state and event_id % 3 = 0)"))


_STRIP = """vs as (select *, not (post_state = pre_state and event_id % 3 = 0) as ok from steps),
 rs(trajectory_id, i, stack, nn, na, ni) as (select distinct trajectory_id, -1, []::struct(action varchar, pre int, post int, ok boolean)[], 0, 0, 0 from steps
   union all select trajectory_id, step_index, case when still then stack when back then stack[1:len(stack) - 1]
       else list_append(stack, {'action': action, 'pre': pre_state, 'post': post_state, 'ok': ok}) end,
     nn + (still and not paired)::int, na + (still and paired)::int, ni + back::int
   from (select s.*, stack, nn, na, ni, ok and post_state = pre_state as still, coalesce(stack[len(stack)].ok, false) as paired,
       ok and post_state <> pre_state and coalesce(stack[len(stack)].ok and stack[len(stack)].pre = post_state, false) as back
     from rs join vs s on s.trajectory_id = rs.trajectory_id and s.step_index = rs.i + 1)),
 sr as (select rs.*, i + 1 as n, f.task_id, f.seed, f.pre_state as first_state, e.fine, len(list_filter(stack, lambda x: not x.ok)) = 0 as kept_fine
   from rs join (select trajectory_id, max(step_index) as m, bool_and(ok) as fine from vs group by 1) e on e.trajectory_id = rs.trajectory_id and e.m = rs.i
   join (select * from steps where step_index = 0) f on f.trajectory_id = rs.trajectory_id)"""
QUERIES["strip_trace"] = (
    lambda t: I.strip_trace(some_invalid(t)),
    O.with_transitions("select " + cols(raw="trajectory_id; task_id; state_preserved := true; original_valid := fine; normalized_valid := kept_fine",
                                        ints="seed; original_len := n; normalized_len := len(stack); remove_noop := nn; remove_absorbed_second := na; remove_inverse_pair := ni; first_state",
                                        arrs="normalized_actions := list_transform(stack, lambda x: x.action)") + " from sr", _STRIP),
)
QUERIES["normal_form_summary"] = (
    lambda t: I.normal_form_summary(I.strip_trace(some_invalid(t))),
    O.with_transitions("select " + cols(
        ints="traces := count(*); state_preserved := count(*); compressed_traces := count(*) filter (where len(stack) < n); remove_noop := sum(nn); remove_absorbed_second := sum(na);"
        "remove_inverse_pair := sum(ni); original_valid := count(*) filter (where fine); normalized_valid := count(*) filter (where kept_fine)",
        dbls="state_preservation_rate := 1; avg_original_len := avg(n); avg_normalized_len := avg(len(stack)); compression_ratio := sum(len(stack)) / sum(n)") + " from sr", _STRIP),
)
QUERIES["unique_traces"] = (
    lambda t: I.unique_traces(t.history.select("task_id", "seed", F.col("history").alias("prefix_actions"))),
    O.with_history("select distinct " + cols(raw="task_id", ints="seed", arrs="prefix_actions := history") + " from hist where len(history) > 0"),
)
QUERIES["structural_reasons"] = (
    lambda t: I.structural_reasons(t.history.withColumn("valid", F.expr("event_id % 19 <> 0"))),
    _cx_sql("select " + cols(raw="trajectory_id; task_id; action", ints="seed; step_index", arrs="""reasons := list_filter([case when list_contains(history[-4:], action) then 'recent_repeat' end,
        case when event_id % 19 = 0 then 'invalid' end, case when event_id % 19 <> 0 and post_state = pre_state then 'noop' end,
        case when event_id % 19 <> 0 and list_contains(seen, post_state) then 'seen_state' end], lambda x: x is not null)""") + " from cx"),
)
# One decision of one trace per turn of the recursion; the lists are cut and joined around its place.
_CANON = """tr as (select trajectory_id, task_id, seed, list(action order by step_index) as acts,
     list(pre_state order by step_index) || [arg_max(post_state, step_index)] as sts from steps group by all),
 cn as (select trajectory_id, task_id, seed, acts as cur, sts as st, 1 as i, false as ch, 0 as ps, 0 as c1, 0 as c2, 0 as c3, 0 as c4, 'go' as r from tr
   union all select trajectory_id, task_id, seed,
     case r when 'n' then cur[1:i - 1] || cur[i + 1:] when 'v' then cur[1:i - 1] || cur[i + 2:] when 'b' then cur[1:i] || cur[i + 2:]
       when 's' then cur[1:i - 1] || [cur[i + 1], cur[i]] || cur[i + 2:] else cur end,
     case r when 'n' then st[1:i] || st[i + 2:] when 'v' then st[1:i] || st[i + 3:] when 'b' then st[1:i + 1] || st[i + 3:]
       when 's' then st[1:i] || [t] || st[i + 2:] else st end,
     case r when 'n' then greatest(i - 1, 1) when 'v' then greatest(i - 1, 1) when 'b' then i when 's' then greatest(i - 1, 1) when 'p' then 1 else i + 1 end,
     case when r in ('n', 'v', 'b', 's') then true when r = 'p' then false else ch end, ps + (r in ('p', 'end'))::int,
     c1 + (r = 'n')::int, c2 + (r = 'v')::int, c3 + (r = 'b')::int, c4 + (r = 's')::int, case when r = 'end' then 'end' else 'go' end
   from (select cn.* exclude (r), x.next_state as t, case when i > len(cur) then case when ch and ps + 1 < 20 then 'p' else 'end' end
       when st[i] = st[i + 1] then 'n' when i = len(cur) then 'go' when st[i] = st[i + 2] then 'v' when st[i + 1] = st[i + 2] then 'b'
       when cur[i] > cur[i + 1] and x.next_state is not null and y.next_state = st[i + 2] then 's' else 'go' end as r
     from cn left join trans x on x.task_id = cn.task_id and x.seed = cn.seed and x.state = st[i] and x.action = cur[i + 1]
     left join trans y on y.task_id = cn.task_id and y.seed = cn.seed and y.state = x.next_state and y.action = cur[i] where cn.r <> 'end'))"""
QUERIES["canonical_traces"] = (
    lambda t: I.canonical_traces(t.steps, t.transitions).drop("passes", "last_state"),
    O.with_transitions("select " + cols(
        raw="trajectory_id; task_id", ints="seed; original_len := len(tr.acts); normalized_len := len(cur); remove_noop := c1; remove_inverse_pair := c2;"
        "remove_absorbed_second := c3; swap_commuting_pair := c4", arrs="normalized_actions := cur") + " from cn join tr using (trajectory_id, task_id, seed) where r = 'end'", _CANON),
)
# Without cycles that pay, full updates settle after as many rounds as the longest way to the goal; twelve are more than that.
_ROUNDS = 12


def _q_sql(alpha, rounds):
    return "q0 as (select *, 0.0::double as q from trans)" + "".join(
        f""",\n q{k} as materialized (select p.* replace (p.q + {alpha} * (p.reward + 0.9 * (case when p.done then 0.0 else coalesce(v.m, 0.0) end) - p.q) as q) from q{k - 1} p
   left join (select task_id, seed, state, max(q) as m from q{k - 1} group by all) v on v.task_id = p.task_id and v.seed = p.seed and v.state = p.next_state)""" for k in range(1, rounds + 1))


_Q, _Q_SETTLED = _q_sql(0.5, 5), _q_sql(1.0, _ROUNDS)
QUERIES["fitted_q"] = (
    lambda t: I.fitted_q(t.transitions, 0.9, 0.5),
    O.with_transitions("select " + cols(raw="task_id; action", ints="seed; state", dbls="q") + " from q5", _Q),
)
QUERIES["settled_q"] = (
    lambda t: I.fitted_q(t.transitions, 0.9, 1.0, None, 1e-12),
    O.with_transitions("select " + cols(raw="task_id; action", ints="seed; state", dbls="q") + f" from q{_ROUNDS}", _Q_SETTLED),
)
_CERTAIN = """cv as (select task_id, seed, state, split_part(action, ' ', 1) as action, min(next_state) as next_state, max(reward) as reward, bool_and(done) as done from trans
   group by task_id, seed, state, split_part(action, ' ', 1) having count(distinct next_state::varchar || done::varchar) = 1)"""
QUERIES["fitted_q_conflicts"] = (
    lambda t: I.fitted_q(t.transitions.withColumn("action", F.expr("split_part(action, ' ', 1)")), 0.9, 0.5),
    O.with_transitions("select " + cols(raw="task_id; action", ints="seed; state", dbls="q") + " from q5", _CERTAIN, _Q.replace("from trans)", "from cv)")),
)
_BLOCKED = "(state + length(action)) % 3 = 0"
for _mode, _order in (("none", "q desc, action"), ("soft", f"q - (case when {_BLOCKED} then 0.3 else 0 end) desc, action"), ("hard", f"({_BLOCKED})::int, q desc, action")):
    _value = f"q - (case when {_BLOCKED} then 0.3 else 0 end)" if _mode == "soft" else "q"
    QUERIES[f"greedy_policy_{_mode}"] = (
        lambda t, m=_mode: I.greedy_policy(
            I.fitted_q(t.transitions, 0.9, 1.0, None, 1e-12),
            t.transitions.filter(_BLOCKED).select("task_id", "seed", "state", "action").distinct().withColumn("penalty", F.lit(0.3)), m),
        O.with_transitions(f"select {cols(raw='task_id; action', ints='seed; state', dbls='value := ' + _value)} from (select *, row_number() over (partition by task_id, seed, state order by {_order}) as rn from q{_ROUNDS}) where rn = 1", _Q_SETTLED),
    )

# ---------------------------------------------------------------- baselines

_KEYED = "list_transform(list_sort(list_transform(range(1, len(candidates) + 1), lambda i: {{'k': {key}, 'p': i, 'a': candidates[i]}})), lambda z: z.a)"
_RANKED = cols(raw="task_id; abstain := false", ints="seed; step_index; ord := 0", arrs="ranked_actions := {r}")
for _name, _fn, _key in (
    ("rerank_random", lambda t: G.rerank_random(t.preferences(), 7), "md5(concat('7:', task_id, ':', seed, ':', step_index, ':', candidates[i]))"),
    ("rerank_navigation_prior", lambda t: G.rerank_heuristic(t.preferences(), "navigation-prior"), "case when split_part(candidates[i], ' ', 1) = 'go' then 0 else 1 end"),
    ("rerank_anti_static", lambda t: G.rerank_heuristic(t.preferences(), "anti-static"), "case when split_part(candidates[i], ' ', 1) in ('look', 'inventory', 'examine') then 1 else 0 end"),
):
    QUERIES[_name] = (_fn, O.with_ledger("select " + _RANKED.format(r=_KEYED.format(key=_key)) + " from prefs", "both", None, O.PREFS))


def split_preferences(t, history=False):
    prefs = t.preferences(history=history)
    return prefs.filter("game_seed % 3 <> 0"), prefs.filter("game_seed % 3 = 0")


_TT = "tn as (select *, preferred as pref, action as rej from prefs where game_seed % 3 <> 0), te as (select p.*, i as pos, candidates[i] as cand from prefs p, range(1, 6) r(i) where game_seed % 3 = 0)"
QUERIES["rerank_verb_prior"] = (
    lambda t: G.rerank_verb_prior(*split_preferences(t)),
    O.with_ledger(", vp as (select verb, ln((sum(up) + 1.0) / (count(*) - sum(up) + 1.0)) as prior from (select split_part(pref, ' ', 1) as verb, 1 as up from tn"
                  " union all select split_part(rej, ' ', 1), 0 from tn) group by verb) select " + cols(
                      raw="task_id; abstain := false", ints="seed; step_index; ord := 0", arrs="ranked_actions := list(cand order by round(coalesce(prior, 0), 12) desc, pos)")
                  + " from te left join vp on vp.verb = split_part(cand, ' ', 1) group by task_id, seed, step_index", "both", None, O.PREFS, _TT),
)
QUERIES["rerank_exact_memory"] = (
    lambda t: G.rerank_exact_memory(*split_preferences(t, history=True)),
    O.with_ledger(", mv as (select history, a, sum(v) as v from (select history, pref as a, 1 as v from tn union all select history, rej, -1 from tn) group by all) select " + cols(
        raw="task_id; abstain := false", ints="seed; step_index; ord := 0", arrs="ranked_actions := list(cand order by coalesce(v, 0) desc, pos)")
        + " from te left join mv on mv.history = te.history and mv.a = te.cand group by task_id, seed, step_index", "both", None, O.PREFS, _TT),
)

# ---------------------------------------------------------------- preference bonus, controllers


def stem_preferences(t):
    """Compiled preferences of failed steps, half of them stored under the task stem."""
    return t.preferences(history=True).filter("original_outcome = 'fail'").withColumn(
        "task_id", F.expr("if(event_id % 2 = 0, regexp_extract(task_id, '(arc_seed[0-9]+)', 1), task_id)"))


QUERIES["rerank_preference_bonus"] = (
    lambda t: G.rerank_preference_bonus(contexts(t), stem_preferences(t)),
    "with " + ",".join([O._STEPS, O._HISTORY, O._EDITS, O._REPAIRS, O._ledger("led", "both", None), O.PREFS, O._TRANS, _T, _CX]) + """,
      sp as (select distinct seed, game_seed, history, preferred as g, action as b from prefs where original_outcome = 'fail'),
      m as (select cc.*, coalesce((select bool_or(sp.g = cc.cand) from sp where sp.seed = cc.seed and sp.game_seed = cc.game_seed and sp.history = cc.history), false) as good,
          coalesce((select bool_or(sp.b = cc.cand) from sp where sp.seed = cc.seed and sp.game_seed = cc.game_seed and sp.history = cc.history), false) as bad,
          exists (select 1 from sp where sp.seed = cc.seed and sp.game_seed = cc.game_seed and sp.history = cc.history) as hit from cc),
      n as (select *, s + (case when good then 100 else 0 end) - (case when bad then 100 else 0 end) as fs from m)
      select """ + cols(raw="task_id; matched := hit", ints="seed; step_index",
                        arrs="ranked_actions := list(cand order by case when hit then -fs else pos end, cand);"
                        "ranked_scores := list(round(fs::double, 9) order by case when hit then -fs else pos end, cand)") + " from n group by task_id, seed, step_index, hit",
)
_PRIOR = """lk as (select cc.*, tv.next_state as nx, len(adm) > 0 and not list_contains(adm, cand) as barred from cc left join tv on tv.task_id = cc.task_id and tv.seed = cc.seed
     and tv.state = cc.pre_state and tv.action = cc.cand and tv.valid),
 pr as (select *, coalesce(nx = pre_state, false) as noop, coalesce(list_contains(seen, nx), false) as sn, coalesce(list_contains(history[-4:], cand), false) as rp,
     coalesce(len(history) > 0 and event_id % 4 <> 1 and prev_state <> pre_state and nx = prev_state, false) as iv from lk),
 ps_ as (select *, s - (case when barred then 100 else (case when noop then 6 else 0 end) + (case when sn then 4 else 0 end) + (case when rp then 2 else 0 end)
     + (case when noop and len(history) > 0 and event_id % 4 <> 1 then 3 else 0 end) + (case when iv then 4 else 0 end) end) as fs,
     case when barred then ['invalid'] else list_filter([case when noop then 'noop' end, case when sn then 'seen_state' end, case when rp then 'recent_repeat' end,
       case when noop and len(history) > 0 and event_id % 4 <> 1 then 'absorbed_after_previous' end, case when iv then 'inverse_with_previous' end], lambda x: x is not null) end as reasons from pr)"""
QUERIES["rerank_prior"] = (
    lambda t: G.rerank_prior(contexts(t).withColumn("previous_valid", F.expr("event_id % 4 <> 1")), transitions(t)),
    _cx_sql("select " + cols(raw="task_id; action := cand", ints="seed; step_index; pos; rank := row_number() over (partition by task_id, seed, step_index order by fs desc, cand)",
                             dbls="score := fs", arrs="reasons") + " from ps_", _PRIOR),
)
_BR = _DIST + """, cb as (select cc.*, coalesce(bo.ln is not null, false) as ok, coalesce(bo.ln, 13) as sl from cc left join bo on bo.task_id = cc.task_id and bo.seed = cc.seed
     and bo.state = cc.pre_state and bo.action = cc.cand)"""
QUERIES["rerank_replay_repair"] = (
    lambda t: G.rerank_replay_repair(contexts(t), I.branch_outcomes(transitions(t))),
    _cx_sql("select " + cols(
        raw="task_id; action := cand; ok; reason := case when ok then concat('replay_success_suffix_', sl) end",
        ints="seed; step_index; pos; suffix_len := sl; rank := row_number() over (partition by task_id, seed, step_index order by s + (case when ok then 1000 - sl else 0 end) desc, cand)",
        dbls="score := s + (case when ok then 1000 - sl else 0 end)") + " from cb", _BR),
)
_VP = """vr as (select *, case when raw_ranks is null or len(list_filter(raw_ranks, lambda x: x is not null)) = 0 then pos else coalesce(raw_ranks[pos + 1], 6 + pos) end as rp from cb),
 vt as (select task_id, seed, step_index, arg_min(cand, rp * 10 + pos) as top, arg_min(ok, rp * 10 + pos) as tok, arg_min(sl, rp * 10 + pos) as tsl,
     list(cand order by rp, pos) as raw from vr group by all),
 vq as (select vr.*, top, tok, tsl, raw, row_number() over (partition by vr.task_id, vr.seed, vr.step_index order by (cand = top)::int, pos) as k from vr join vt using (task_id, seed, step_index)),
 vs as (select task_id, seed, step_index, top, tok, tsl, raw, arg_min({'a': cand, 'l': sl}, {'l': sl, 's': -s, 'a': cand}) filter (where cand <> top and k <= 3 and ok and (not tok or sl + 1 <= tsl)) as ch
   from vq group by all)"""
QUERIES["select_verified_proposal"] = (
    lambda t: G.select_verified_proposal(contexts(t), I.branch_outcomes(transitions(t)), 3),
    _cx_sql("select " + cols(
        raw="task_id; raw_action := top; raw_success := tok; selected_action := coalesce(ch.a, top); fallback := ch is null;"
        "reason := case when ch is null then 'fallback_raw' else concat('verified_proposal_suffix_', ch.l) end",
        ints="seed; step_index; raw_suffix_len := tsl", arrs="ranked_actions := list_prepend(coalesce(ch.a, top), list_filter(raw, lambda a: a <> coalesce(ch.a, top)))") + " from vs", _BR, _VP),
)

# ---------------------------------------------------------------- gates


def scored(t):
    rows = contexts(t)
    return rows.withColumn("scores", F.map_from_arrays("candidates", "scores")).withColumn(
        "gate_probability", F.expr("cast(event_id % 10 as double) / 10")).withColumn("verifier_allows", F.expr("event_id % 6 <> 5")).withColumn(
        "verifier_reason", F.lit("test"))


_GATE = """gt0 as (select cx.*, list_transform(list_sort(list_transform(range(1, 6), lambda i: {'k': -sc[i], 'p': i, 'a': candidates[i]})), lambda z: z.a) as ranked,
     candidates[1] as raw_top from cx),
 gt1 as (select *, ranked[1] as lt, sc[list_position(candidates, ranked[1])] - sc[1] as mg from gt0),
 gt2 as (select *, coalesce(list_contains(history[-4:], raw_top), false) as rr, coalesce(list_contains(history[-4:], lt), false) as lr,
     split_part(raw_top, ' ', 1) as rv, split_part(lt, ' ', 1) as lv from gt1),
 gt as (select *, case when lt = raw_top then null when mg < 0.5 then 'below_margin' {mode} {gate} end as why from gt2)"""
_CONS = """when (rr or rv in ('look', 'inventory', 'examine')) and lv not in ('look', 'inventory', 'examine') then null
   when rv in ('take', 'drop', 'open', 'close', 'unlock', 'lock', 'put', 'insert', 'eat') and lv = 'go' then 'would_demote_manipulation' else 'raw_top_not_suspicious'"""
_GATES = {
    "none": ("", {}),
    "no-repeat": ("when lr then 'learned_top_recent_repeat'", {"safety_mode": "no-repeat"}),
    "conservative": ("when lr then 'learned_top_recent_repeat' " + _CONS, {"safety_mode": "conservative"}),
    "loop-safe": ("when lr then 'learned_top_recent_repeat' when raw_top = history[-1] and rv = 'go' and lv = 'go' then 'protect_immediate_navigation_repeat' " + _CONS, {"safety_mode": "loop-safe"}),
}
for _mode, (_text, _args) in _GATES.items():
    QUERIES["gate_interventions_" + _mode.replace("-", "_")] = (
        lambda t, a=_args: G.gate_interventions(scored(t).drop("verifier_allows"), 0.5, **a),
        _cx_sql("select " + cols(
            raw="task_id; reranker_used := true; reranker_abstained := why is not null; reranker_intervened := lt <> raw_top and why is null; reranker_safety_reason := coalesce(why, '')",
            ints="seed; step_index", dbls="reranker_margin := mg", arrs="ranked_actions := case when why is null then ranked else candidates end;"
            "raw_ranks := list_transform(case when why is null then ranked else candidates end, lambda a: list_position(candidates, a))") + " from gt",
            _GATE.replace("{mode}", _text).replace("{gate}", "")),
    )
QUERIES["gate_interventions_gated"] = (
    lambda t: G.gate_interventions(scored(t), 0.5, gate_threshold=0.5),
    _cx_sql("select " + cols(
        raw="task_id; reranker_used := true; reranker_abstained := why is not null; reranker_intervened := lt <> raw_top and why is null; reranker_safety_reason := coalesce(why, '')",
        ints="seed; step_index", dbls="reranker_margin := mg", arrs="ranked_actions := case when why is null then ranked else candidates end;"
        "raw_ranks := list_transform(case when why is null then ranked else candidates end, lambda a: list_position(candidates, a))") + " from gt",
        _GATE.replace("{mode}", "").replace("{gate}", "when event_id % 10 < 5 then 'learned_intervention_gate' when event_id % 6 = 5 then 'llm_verifier:test'")),
)
QUERIES["loop_break"] = (
    lambda t: G.loop_break(scored(t)),
    _cx_sql(""", v as (select *, count(*) over (partition by trajectory_id, pre_state order by step_index rows between unbounded preceding and current row) as visits from gt2),
      w as (select *, case when visits >= 2 then list_filter(ranked, lambda a: a <> raw_top and not coalesce(list_contains(history[-4:], a), false))[1] end as ch from v) select """ + cols(
        raw="task_id; reranker_abstained := ch is null; reranker_intervened := ch is not null;"
        "reranker_safety_reason := case when visits < 2 then 'state_not_revisited' when ch is null then 'no_loop_breaking_candidate' else 'loop_break' end",
        ints="seed; step_index", dbls="reranker_margin := case when ch is null then mg else sc[list_position(candidates, ch)] - sc[1] end",
        arrs="ranked_actions := case when ch is null then candidates else list_prepend(ch, list_filter(ranked, lambda a: a <> ch)) end") + " from w",
        _GATE.replace("{mode}", "").replace("{gate}", "")),
)
_NOISE = """nz as (select *, candidates || list_filter(adm, lambda a: not list_contains(candidates, a) and (a in ('look', 'inventory') or coalesce(list_contains(history[-4:], a), false))) as all_ from cx),
 nr as (select *, list_transform(list_sort(list_transform(all_, lambda a: {'k': -(case when coalesce(list_contains(history[-4:], a), false) then 3
     when a in ('look', 'inventory') then 2 when a like 'examine %' then 1 else 0 end), 'a': a})), lambda z: z.a)[1:5] as r from nz)"""
QUERIES["perturb_candidates"] = (
    lambda t: G.perturb_candidates(contexts(t), "frontload-structural", 5),
    _cx_sql("select " + cols(raw="task_id", ints="seed; step_index", arrs="ranked_actions := r; ranked_scores := list_transform(range(len(r)), lambda i: (len(r) - i)::double)") + " from nr", _NOISE),
)
QUERIES["propose_heuristic"] = (
    lambda t: G.propose_heuristic(t.history.withColumn("admissible", F.expr(_ADM % _vocabulary())), 5),
    O.with_history("select " + cols(raw="task_id", ints="seed; step_index", arrs="candidates := p; scores := list_transform(range(len(p)), lambda i: (5 - i)::double)") +
                   " from (select *, pool[1:5] as p from (select task_id, seed, step_index, pool from ps1))", UNDO, _STATES),
)
_MULTI = """mu as (select trajectory_id, task_id, seed, step_index, action, len(candidates) as cn, list(cand order by pos) filter (where ok) as acts,
     coalesce(list(sl order by pos) filter (where ok), []) as lens, count(*) filter (where ok and cand <> action) as alts from cb group by all)"""
QUERIES["repair_multiplicity_from_log"] = (
    lambda t: L.repair_multiplicity(
        t.steps.withColumn("state", F.col("pre_state")), I.branch_outcomes(transitions(t)), ["task_id", "seed", "state"]
    ).select("trajectory_id", "task_id", "seed", "step_index", "candidate_count", "successful_logged_candidates", "successful_alternatives", "successful_actions", "successful_suffix_lens"),
    _cx_sql("select " + cols(raw="trajectory_id; task_id", ints="seed; step_index; candidate_count := cn; successful_logged_candidates := coalesce(len(acts), 0); successful_alternatives := alts",
                             arrs="successful_actions := coalesce(acts, []); successful_suffix_lens := lens") + " from mu", _BR, _MULTI),
)
