"""DuckDB text of the derived tables, shared by the oracle queries."""

from __future__ import annotations

from trajlens.sources.fixtures import HORIZON, VOCABULARY, _DELTA

V = "[" + ",".join(f"'{action}'" for action in VOCABULARY) + "]"

_STEPS = f"""
p as (select event_id, user_id, value, event_type, ts, user_id % 50 as game_seed,
        cast((extract(day from ts) - 1) // 10 as int) as rollout,
        ({V})[cast((event_id * 7 + (case when event_id % 5 = 0 then 3 else 0 end)) % 20 as int) + 1] as action
      from events),
d as (select *, {_DELTA} as delta,
        row_number() over (partition by user_id, rollout order by ts, event_id) - 1 as place,
        coalesce(bool_or(event_type = 'purchase' and value > 70) over (partition by user_id, rollout), false) as success
      from p),
c as (select *, (user_id // 50) * 3 + rollout + (place // {HORIZON}) * 1000000000 as seed,
        cast(coalesce(sum(delta) over (partition by user_id, rollout order by place
             rows between unbounded preceding and 1 preceding), 0) as bigint) as pre0
      from d),
steps as (select event_id, concat('games/arc_seed', game_seed, '.z8') as task_id, cast(seed as bigint) as seed, rollout,
        concat('arc_seed', game_seed, ':seed', seed, ':rollout', rollout) as trajectory_id, game_seed,
        cast(place % {HORIZON} as int) as step_index, success,
        list_transform(range(0, 5), lambda j: ({V})[cast((event_id * 7 + j * 3) % 20 as int) + 1]) as candidates,
        action,
        case when event_id % 11 = 0 then null else
          ({V})[cast((event_id * 7 + 3 * ((event_id * 13 + user_id) % 8)) % 20 as int) + 1] end as gold_action,
        value, cast(((pre0 % 6) + 6) % 6 as int) as pre_state,
        cast((((pre0 + delta) % 6) + 6) % 6 as int) as post_state
      from c)"""

_HISTORY = """
hist as (select *, coalesce(list(action) filter (where action <> '') over (partition by trajectory_id order by step_index
        rows between unbounded preceding and 1 preceding), []::varchar[]) as history from steps)"""

_EDITS = f"""
edits as (select task_id, seed, rollout, trajectory_id, step_index, j as edit_pos, (event_id + j) % 3 as kind, action,
        case (event_id + j) % 3 when 0 then 'policy_suffix' when 1 then 'candidate_policy_suffix'
             else 'suffix_match_policy' end as edit_type,
        case when (event_id + j) % 3 = 0 then step_index - 1 else step_index end as edit_index,
        case (event_id + j) % 3 when 0 then 'policy_repair_candidate' when 1 then 'candidate_policy_repair'
             else 'suffix_match_repair' end as label,
        case when j = 0 then gold_action else candidates[2] end as repair_action,
        cast(1 + (event_id * 3 + j * 5) % 9 as int) as suffix_len,
        step_index + cast(1 + (event_id * 3 + j * 5) % 9 as int) as edited_len, {HORIZON // 4} as original_len,
        (event_id + j) % 7 <> 0 as edit_success, success as original_success
      from steps cross join (select unnest([0, 1]) as j) e
      where gold_action is not null and (event_id + j) % 4 <> 1)"""

_REPAIRS = """
rep0 as (select *, case kind when 0 then 2 when 1 then 0 else 1 end as prio,
        case kind when 0 then 'policy_repair_suffix' when 1 then 'candidate_policy_suffix'
             else 'suffix_match_policy' end as repair_source,
        case when original_success and edited_len < original_len then 'C3_shorter_success'
             when not original_success then 'C3_failure_repair' else 'C1_oracle_suffix' end as certificate_level
      from edits),
repairs as (select * from (select *, row_number() over (partition by task_id, seed, step_index
        order by suffix_len, prio, repair_action, edit_pos) as rn from rep0) where rn = 1)"""


def _ledger(name: str, source: str, limit: int | None, steps: str = "hist") -> str:
    use_repair = "true" if source in ("policy-repair", "both") else "false"
    use_gold = "true" if source in ("gold", "both") else "false"
    cap = "false" if limit is None else f"(r_ok and suffix_len > {limit})"
    return f"""
{name}_0 as (select s.*, ({use_repair} and r.step_index is not null) as r_ok,
        case when {use_repair} and r.step_index is not null then r.repair_action
             when {use_gold} then s.gold_action end as preferred,
        r.suffix_len, r.edit_success, r.repair_source, r.certificate_level as r_level, r.edited_len, r.original_len
      from {steps} s left join repairs r on s.task_id = r.task_id and s.seed = r.seed and s.step_index = r.step_index),
{name} as (select *, nullif(list_position(candidates, preferred), 0) as preferred_rank,
        nullif(list_position(candidates, action), 0) as rejected_rank, len(candidates) as candidate_count,
        case when success then 'success' else 'fail' end as original_outcome,
        case when r_ok then r_level when preferred is not null then 'C0_candidate_only' end as level,
        case when r_ok then suffix_len when preferred is not null then 0 end as repair_suffix_len,
        case when r_ok then (case when edit_success then 'success' else 'fail' end)
             when preferred is not null then 'unknown' end as repaired_outcome,
        case when r_ok then repair_source when preferred is not null then 'gold_action' end as source,
        case when len(candidates) = 0 then 'no_candidates_logged'
             when preferred is null then 'no_repair_found'
             when r_ok and not edit_success then 'invalid_replay'
             when {cap} then 'suffix_too_long'
             when preferred = action then 'repair_same_as_executed'
             when coalesce(list_position(candidates, preferred), 0) = 0 then 'repair_not_in_candidates'
             else 'certified_preference' end as status
      from {name}_0)"""


_PREDS = """
preds as (select task_id, seed, step_index,
        list_transform(range(0, 5), lambda j: cast((event_id * 17 + j * 29) % 100 as double) / 10) as scores,
        event_id % 9 = 0 as abstain from steps where event_id % 10 <> 3)"""

_TRANS = """
trans as (select distinct task_id, seed, pre_state as state, action, post_state as next_state,
        case when post_state = game_seed % 6 and post_state <> pre_state then 1.0 else 0.0 end as reward,
        post_state = game_seed % 6 and post_state <> pre_state as done from steps)"""


def with_steps(body: str) -> str:
    return f"with {_STEPS} {body}"


def with_history(body: str, *more: str) -> str:
    return "with " + ",".join([_STEPS, _HISTORY, *more]) + " " + body


def with_edits(body: str, *more: str) -> str:
    return "with " + ",".join([_STEPS, _EDITS, *more]) + " " + body


def with_ledger(body: str, source: str = "both", limit: int | None = None, *more: str) -> str:
    parts = [_STEPS, _HISTORY, _EDITS, _REPAIRS, _ledger("led", source, limit), *more]
    return "with recursive " + ",".join(parts) + " " + body


def with_transitions(body: str, *more: str) -> str:
    return "with recursive " + ",".join([_STEPS, _TRANS, *more]) + " " + body


PREFS = """
prefs as (select * from led where status = 'certified_preference')"""
PREDS = _PREDS
TRANS = _TRANS
HISTORY = _HISTORY
EDITS = _EDITS
