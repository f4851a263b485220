"""Registered queries: column expressions over the step log."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlens.functions import actions as A
from trajlens.functions import ranks as K
from trajlens.functions import suffixes as U
from trajlens.operators import datasets as D
from trajlens.plans import oracle_ctes as O
from trajlens.plans.shape import cols

QUERIES: dict = {}
KEY = ["trajectory_id", "step_index"]

QUERIES["normalize_action"] = (
    lambda t: t.steps.select(*KEY, A.normalize_action(F.expr(
        "concat('  ', upper(action), chr(9), '  X ', if(event_id % 4 = 0, null, gold_action), chr(160))")).alias("norm")),
    O.with_steps("select " + cols(raw="trajectory_id; norm := case when event_id % 4 <> 0 then concat(lower(action), ' x ', lower(gold_action)) end"
                                  .replace("concat(lower(action), ' x ', lower(gold_action))", "lower(action) || ' x ' || lower(gold_action)"), ints="step_index") + " from steps"),
)
QUERIES["rank_of"] = (
    lambda t: t.steps.select(*KEY, K.rank_of(F.col("candidates"), F.col("action")).alias("action_rank"),
                             K.rank_of(F.col("candidates"), F.col("gold_action")).alias("gold_rank"),
                             K.reciprocal_rank(K.rank_of(F.col("candidates"), F.col("gold_action"))).alias("rr"),
                             K.single_ndcg(K.rank_of(F.col("candidates"), F.col("gold_action"))).alias("gain")),
    O.with_steps("select " + cols(raw="trajectory_id", ints="step_index; action_rank := nullif(list_position(candidates, action), 0);"
                                  "gold_rank := nullif(list_position(candidates, gold_action), 0)",
                                  dbls="rr := coalesce(1.0 / nullif(list_position(candidates, gold_action), 0), 0);"
                                  "gain := coalesce(1.0 / log2(1 + nullif(list_position(candidates, gold_action), 0)), 0)") + " from steps"),
)
_BEFORE = "case event_id % 3 when 0 then null when 1 then cast(array() as array<string>) else reverse(candidates) end"
QUERIES["step_candidates"] = (
    lambda t: t.steps.withColumn("before", F.expr(_BEFORE)).select(
        *KEY, K.step_candidates(F.col("before"), F.col("candidates")).alias("loose"),
        K.step_candidates_strict(F.col("before"), F.col("candidates")).alias("strict")),
    O.with_steps("select " + cols(raw="trajectory_id", ints="step_index",
                                  arrs="loose := case when event_id % 3 = 2 then list_reverse(candidates) else candidates end;"
                                  "strict := case event_id % 3 when 2 then list_reverse(candidates) when 1 then [] else candidates end") + " from steps"),
)
QUERIES["dedupe_actions"] = (
    lambda t: t.steps.select(*KEY, K.dedupe_actions(F.expr(
        "concat(candidates, array(upper(candidates[0]), concat(' ', action, '  '), 'Wait  Here'), array('wait here'))")).alias("kept")),
    O.with_steps(""", d2 as (select trajectory_id, step_index, candidates || [upper(candidates[1]), ' ' || action || '  ', 'Wait  Here', 'wait here'] as c,
        list_transform(candidates || [upper(candidates[1]), ' ' || action || '  ', 'Wait  Here', 'wait here'], lambda x: trim(regexp_replace(lower(x), '\\s+', ' ', 'g'))) as n from steps)
        select """ + cols(raw="trajectory_id", ints="step_index", arrs="kept := list_filter(c, lambda x, i: list_position(n, n[i]) = i)") + " from d2"),
)
QUERIES["replacement_candidates"] = (
    lambda t: t.steps.select(*KEY, K.replacement_candidates(F.concat("candidates", "candidates"), F.col("action"), 3).alias("others")),
    O.with_steps("select " + cols(raw="trajectory_id", ints="step_index", arrs="others := list_filter(candidates, lambda a: a <> action)[1:3]") + " from steps"),
)
_NAV = "('go', 'north', 'south', 'east', 'west')"
_MAN = "('take', 'drop', 'open', 'close', 'unlock', 'lock', 'put', 'insert', 'eat')"
QUERIES["action_classes"] = (
    lambda t: t.history.select(
        *KEY, A.action_verb(F.upper("action")).alias("verb"), A.action_group(F.col("action")).alias("action_group"),
        A.is_navigation(F.col("action")).alias("navigation"), A.is_static(F.col("action")).alias("static"),
        A.is_manipulation(F.col("action")).alias("manipulation"), A.is_recent_repeat(F.col("action"), F.col("history")).alias("recent_repeat"),
        A.structural_distractor_rank(F.col("action"), F.col("history")).alias("distractor")),
    O.with_history(f""", q as (select *, split_part(action, ' ', 1) as verb, coalesce(list_contains(history[-4:], action), false) as rep from hist) select """ + cols(
        raw="trajectory_id; verb; action_group := case when verb = 'go' then 'navigation' when verb in ('take','drop','put','open','close','unlock','lock','insert')"
        " then 'manipulation' when verb in ('look','inventory','examine','read') then 'inspection' else 'other' end;"
        f"navigation := verb in {_NAV}; static := verb in ('look', 'inventory', 'examine'); manipulation := verb in {_MAN}; recent_repeat := rep",
        ints="step_index; distractor := case when rep then 3 when action in ('look','inventory') then 2 when action like 'examine %' then 1 else 0 end") + " from q"),
)

# ---------------------------------------------------------------- pairs of previous action and candidate

_STOP = "['with', 'in', 'into', 'on', 'the', 'a', 'an']"


def _moved(x):
    return (f"case when {x} like 'take %' then split_part(substr({x}, 6), ' from ', 1) when {x} like 'drop %' then substr({x}, 6)"
            f" when {x} like 'put %' or {x} like 'insert %' then regexp_extract({x}, '^(put|insert) (.*?)( (on|in|into|onto) .*)?$', 2) else '' end")


def _rest(x):
    return f"list_filter(string_split({x}, ' ')[2:], lambda w: not list_contains({_STOP}, w))"


UNDO = f"""und0 as (select p, c, split_part(p, ' ', 1) as pv, split_part(c, ' ', 1) as cv,
     p || '>' || c in ('go north>go south', 'go south>go north', 'go east>go west', 'go west>go east') as inv
   from (select unnest({O.V}) as p), (select unnest({O.V}) as c)),
 und as (select p, c, inv, case when inv then true when pv || cv in ('openclose', 'closeopen') then substr(p, length(pv) + 2) = substr(c, length(cv) + 2)
     when pv || cv in ('unlocklock', 'lockunlock') then list_has_any({_rest('p')}, {_rest('c')})
     when (pv = 'take' and cv in ('drop', 'put', 'insert')) or (cv = 'take' and pv in ('drop', 'put', 'insert')) then ({_moved('p')}) <> '' and ({_moved('p')}) = ({_moved('c')})
     else false end as undo from und0)"""
CAND = """cd as (select h.*, i as pos, candidates[i] as cand, history[-1] as prev, history[-3:] as h3 from hist h, range(1, 6) r(i))"""
QUERIES["inverse_and_undo"] = (
    lambda t: t.history.select(*KEY, F.get("history", F.size("history") - 1).alias("prev"), F.posexplode("candidates").alias("pos", "cand")).select(
        *KEY, "pos", A.is_inverse_navigation(F.col("prev"), F.col("cand")).alias("inverse"), A.is_semantic_undo(F.col("prev"), F.col("cand")).alias("undo"),
        A.moved_object(F.col("cand")).alias("moved")),
    O.with_history("select " + cols(
        raw=f"trajectory_id; inverse := coalesce(und.inv, false); undo := coalesce(und.undo, false); moved := {_moved('cand')}", ints="step_index; pos := pos - 1") +
        " from cd left join und on und.p = cd.prev and und.c = cd.cand", UNDO, CAND),
)
OBJECTIVE = "concat('Find the KEY, then go ', element_at(array('north', 'south', 'upstairs'), cast(game_seed % 3 as int) + 1), ' & open the chest.')"
_OBJ_SQL = "concat('find the key  then go ', ['north', 'south', 'upstairs'][game_seed % 3 + 1], '   open the chest ')"


def _overlap(cand):
    toks = f"list_filter(string_split({cand}, ' '), lambda w: length(w) > 2)"
    return (f"(case when len({toks}) = 0 then 0.0 when {cand} like 'go %' and contains(goal, substr({cand}, 4)) then 1.0"
            f" else len(list_filter({toks}, lambda w: contains(goal, w)))::double / len({toks}) end)")


OVER = f"""ov as (select cd.*, {_OBJ_SQL} as goal from cd),
 ox as (select ov.*, {_overlap('cand')} as overlap, coalesce(list_contains(history[-4:], cand), false) as rep, coalesce(u1.inv, false) as inv,
     coalesce((select bool_or(undo) from und where und.c = ov.cand and list_contains(ov.h3, und.p)), false) as undone, split_part(cand, ' ', 1) as verb
   from ov left join und u1 on u1.p = ov.prev and u1.c = ov.cand),
 op as (select *, (case verb when 'go' then 0.0 when 'open' then 1.0 when 'unlock' then 1.0 when 'take' then 1.4 when 'put' then 2.0 when 'insert' then 2.0
     when 'drop' then 2.2 when 'eat' then 2.2 when 'close' then 2.4 when 'lock' then 2.4 when 'read' then 3.0 when 'look' then 5.0 when 'inventory' then 5.0
     when 'examine' then 5.0 else 3.2 end) + (case when rep then 4.0 else 0 end) + (case when inv then 3.0 else 0 end) + (case when undone then 3.0 else 0 end) - overlap as prio,
     (case when rep then 1.0 else 0 end) + (case when inv then 2.0 else 0 end) + (case when verb in ('look', 'inventory', 'examine') then 0.5 else 0 end)
     + (case when undone then 1.5 else 0 end)
     + (case when verb in ('take', 'drop', 'put', 'open', 'close', 'unlock', 'lock', 'insert', 'eat') and overlap <= 0 then 0.9 else 0 end) - 0.7 * overlap
     - (case when cand like 'go %' then 0.3 else 0 end) as penalty from ox)"""
PENALTIES = dict(recent_repeat=1.0, inverse=2.0, static=0.5, semantic_undo=1.5, overlap_bonus=0.7, navigation_bonus=0.3, off_objective=0.9)
QUERIES["candidate_priorities"] = (
    lambda t: t.history.select(*KEY, F.inline(A.judged_actions(F.col("candidates"), F.col("history"), F.expr(OBJECTIVE)))).select(
        *KEY, "pos", "overlap", A.judged_priority(F.struct("*")).alias("priority"), A.judged_penalty(F.struct("*"), **PENALTIES).alias("penalty")),
    O.with_history("select " + cols(raw="trajectory_id", ints="step_index; pos := pos - 1", dbls="overlap; priority := prio; penalty") + " from op", UNDO, CAND, OVER),
)
QUERIES["rank_pool"] = (
    lambda t: t.history.select(
        *KEY, A.rank_pool(F.col("candidates"), F.col("history"), F.expr(OBJECTIVE), "progress").alias("progress"),
        A.rank_pool(F.col("candidates"), F.col("history"), F.lit(""), "default").alias("default_order")),
    O.with_history("select " + cols(raw="trajectory_id", ints="step_index", arrs="progress := list(cand order by round(prio, 9), pos);"
                                    "default_order := list(cand order by (rep or cand in ('look', 'inventory'))::int, pos)") + " from op group by trajectory_id, step_index",
                   UNDO, CAND, OVER),
)

# ---------------------------------------------------------------- plans and suffixes

_PLAN = "reverse(candidates)"
# One step of the greedy match per item of the plan (five here, all of it).
_MATCH = "".join(
    f""", m{k} as (select *, {'case when p' + str(k - 1) + ' > 0 then' if k > 1 else ''} coalesce(list_position(history[{' + '.join(f'p{j}' for j in range(1, k)) or '0'} + 1:], plan[{k}]), 0)
      {'else 0 end' if k > 1 else ''} as p{k} from m{k - 1})""" for k in range(1, 6)
)
QUERIES["remaining_suffix"] = (
    lambda t: t.history.select(*KEY, U.remaining_suffix(F.expr(_PLAN), F.col("history")).alias("left_over")),
    O.with_history(", m0 as (select trajectory_id, step_index, history, list_reverse(candidates) as plan from hist)" + _MATCH + " select " + cols(
        raw="trajectory_id", ints="step_index", arrs="left_over := plan[1 + " + " + ".join(f"(p{k} > 0)::int" for k in range(1, 6)) + ":]") + " from m5"),
)
_SUFFIX = """case event_id % 7 when 0 then {a}'open door to hall', 'go to hall', action{z} when 1 then {a}'go to hall', action{z}
   when 2 then {a}'use thermometer in inventory on pot', 'wait'{z} when 3 then {a}'focus on seed in inventory'{z} when 4 then {a}'examine desk', action{z}
   when 5 then {a}'open door to hall', 'look'{z} else {e} end"""
_ADMIT = """case event_id % 4 when 0 then {a}'teleport to hall', 'use thermometer on pot'{z} when 1 then {a}'focus on seed', 'look in desk'{z}
   when 2 then {a}'look at desk', 'look in desk', 'go to hall'{z} else {a}'examine desk', 'open door to hall'{z} end"""
QUERIES["adapt_suffix"] = (
    lambda t: t.steps.withColumn("suffix", F.expr(_SUFFIX.format(a="array(", z=")", e="cast(array() as array<string>)"))).withColumn(
        "admissible", F.expr(_ADMIT.format(a="array(", z=")"))).select(*KEY, U.adapt_suffix(F.col("suffix"), F.col("admissible")).alias("adapted")),
    O.with_steps(f""", a as (select trajectory_id, step_index, event_id % 4 as k, {_SUFFIX.format(a='[', z=']', e='[]::varchar[]')} as s, {_ADMIT.format(a='[', z=']')} as adm from steps)
      select """ + cols(raw="trajectory_id", ints="step_index", arrs="""adapted := case when s[1] = 'open door to hall' and s[2] = 'go to hall' and k = 0 then ['teleport to hall'] || s[3:]
        when s[1] = 'go to hall' and k = 0 then ['teleport to hall'] || s[2:] when list_contains(adm, s[1]) then s
        when s[1] = 'use thermometer in inventory on pot' and k = 0 then ['use thermometer on pot'] || s[2:]
        when s[1] = 'focus on seed in inventory' and k = 1 then ['focus on seed'] || s[2:]
        when s[1] = 'examine desk' and k = 2 then ['look at desk'] || s[2:] when s[1] = 'examine desk' and k = 1 then ['look in desk'] || s[2:] else s end""") + " from a"),
)

# ---------------------------------------------------------------- policy targets over logged states

_ADM = "transform(sequence(0, 9), j -> element_at(%s, cast((event_id * 3 + j * 7) %% 20 as int) + 1))"


def policy_states(t):
    from trajlens.sources.fixtures import _vocabulary

    return t.history.select(
        "trajectory_id", "task_id", "seed", "step_index", "history", F.expr(_ADM % _vocabulary()).alias("admissible"),
        F.expr("if(gold_action is null, cast(array() as array<string>), array(gold_action, candidates[1], gold_action, candidates[3]))").alias("policy"),
        F.expr("event_id % 129 = 0").alias("done"), F.expr("event_id % 17 <> 0").alias("valid"), F.expr(OBJECTIVE).alias("objective"),
    )


_STATES = f"""ps0 as (select *, list_transform(range(0, 10), lambda j: ({O.V})[cast((event_id * 3 + j * 7) % 20 as int) + 1]) as adm,
     case when gold_action is null then []::varchar[] else [gold_action, candidates[2], gold_action, candidates[4]] end as policy,
     event_id % 129 = 0 as done, event_id % 17 <> 0 as valid, {_OBJ_SQL} as goal from hist),
 ps1 as (select *, coalesce(max(done::int) over (partition by trajectory_id order by step_index rows between unbounded preceding and 1 preceding), 0) as over_,
     (list_filter(adm, lambda a: not (coalesce(list_contains(history[-4:], a), false) or a in ('look', 'inventory')))
      || list_filter(adm, lambda a: coalesce(list_contains(history[-4:], a), false) or a in ('look', 'inventory')))[1:40] as pool from ps0),
 ps2 as (select *, case when (FORCED) and len(policy) > 0 and not list_contains(pool, policy[1]) then pool[1:39] || [policy[1]] else pool end as cs from ps1 where over_ = 0),
 ps as (select *, case when done then 'done_prefix' when not valid then 'invalid_replay' when len(policy) = 0 then 'no_policy'
     when not (FORCED) and not list_contains(pool, policy[1]) then 'gold_absent' end as skip from ps2),
 pc0 as (select ps.*, i as pos, cs[i] as cand, history[-1] as prev, history[-3:] as h3 from ps, range(1, len(cs) + 1) r(i) where skip is null),
 pc1 as (select pc0.*, {_overlap('cand')} as overlap, split_part(cand, ' ', 1) as verb, coalesce(list_contains(history[-4:], cand), false) as rep, coalesce(u1.inv, false) as inv,
     coalesce((select bool_or(undo) from und where und.c = pc0.cand and list_contains(pc0.h3, und.p)), false) as undone
   from pc0 left join und u1 on u1.p = pc0.prev and u1.c = pc0.cand),
 pc as (select *, (case when cand = policy[4] then 1.0 / 4 when cand = policy[3] then 1.0 / 3 when cand = policy[2] then 1.0 / 2 else 0 end)
     + (case when cand = policy[1] then 2.0 else 0 end) - (case when rep then 1.0 else 0 end) - (case when inv then 2.0 else 0 end)
     - (case when undone then 1.5 else 0 end) - (case when verb in ('look', 'inventory', 'examine') then 0.5 else 0 end) + 0.7 * overlap
     + (case when cand like 'go %' then 0.3 else 0 end)
     - (case when verb in ('take', 'drop', 'put', 'open', 'close', 'unlock', 'lock', 'insert', 'eat') and overlap <= 0 then 0.9 else 0 end) as reward from pc1)"""
for _suffix, _forced in (("", False), ("_forced", True)):
    QUERIES["online_policy_records" + _suffix] = (
            lambda t, forced=_forced: D.online_policy_records(policy_states(t), force_gold=forced, suffix_reward=1.0, **PENALTIES).select(
            *KEY, "preferred_action", "rejected_action", "preferred_rank_before", "rejected_rank_before", "candidate_count",
            F.posexplode(F.map_entries("candidate_rewards")).alias("pos", "e")).select(
            *KEY, "preferred_action", "rejected_action", "preferred_rank_before", "rejected_rank_before", "candidate_count", "pos",
            F.col("e.key").alias("candidate"), F.col("e.value").alias("reward")),
        O.with_history("select " + cols(
            raw="trajectory_id; preferred_action := policy[1]; rejected_action := list_filter(cs, lambda a: a <> policy[1])[1]; candidate := cand",
            ints="step_index; preferred_rank_before := list_position(cs, policy[1]);"
            "rejected_rank_before := list_position(cs, list_filter(cs, lambda a: a <> policy[1])[1]); candidate_count := len(cs); pos := pos - 1", dbls="reward") + " from pc",
            UNDO, _STATES.replace("FORCED", str(_forced).lower())),
    )
    QUERIES["online_policy_summary" + _suffix] = (
            lambda t, forced=_forced: D.online_policy_summary(policy_states(t), force_gold=forced),
        O.with_history("select " + cols(
            ints="trajectories := count(distinct trajectory_id); records := count(*) filter (where skip is null);"
            + ";".join(f"skipped_{r} := count(*) filter (where skip = '{r}')" for r in ("done_prefix", "invalid_replay", "no_policy", "gold_absent", "single_candidate")),
            dbls="avg_gold_rank := avg(list_position(cs, policy[1])) filter (where skip is null);"
            "gold_top1_rate := avg((cs[1] = policy[1])::int) filter (where skip is null)") + " from ps", UNDO, _STATES.replace("FORCED", str(_forced).lower())),
    )
