"""Registered queries: reading, merging and parsing logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlens.functions.tasks import task_attributes
from trajlens.plans import oracle_ctes as O
from trajlens.plans.catalog_ranking import SPLIT_ORACLE, seed_splits
from trajlens.plans.shape import cols
from trajlens.session import new_table_path
from trajlens.sources import logs as S

QUERIES: dict = {}


def trajectory_lines(t):
    """The log as JSON text in the accepted shapes: bare record, wrapped, listed and in a named container."""
    rows = t.trajectories.select(
        "ord", F.col("ord").alias("n"),
        F.to_json(F.struct("task_id", "seed", "rollout_seed", "game_seed", "success", "trajectory_id",
                           F.transform("steps", lambda s: F.struct(s["step_index"].alias("step_index"), s["action"].alias("action"),
                                                                   s["candidates"].alias("candidates"), s["gold_action"].alias("gold_action"))).alias("steps"))).alias("doc"),
    )
    return rows.select("ord", F.expr(
        "case n % 5 when 0 then doc when 1 then concat('{\"episode\":', doc, '}') when 2 then concat('{\"episodes\":[', doc, ']}')"
        " when 3 then concat('[', doc, ']') else concat('{\"runs\":{\"episodes\":[', doc, ']},\"note\":\"x\"}') end").alias("value"))


def written(t, lines):
    """Log text written as a folder of plain and of compressed line files; its path."""
    path = new_table_path(t.spark)
    even = F.pmod(F.xxhash64("value"), F.lit(2)) == 0
    lines.filter(even).select("value").write.text(f"{path}/plain")
    lines.filter(~even).select("value").write.option("compression", "gzip").text(f"{path}/packed")
    return path


QUERIES["read_trajectories"] = (
    lambda t: S.read_trajectories(t.spark, written(t, trajectory_lines(t))).select(
        "trajectory_id", "task_id", "seed", "game_seed", "success", F.size("steps").alias("num_steps"),
        F.transform("steps", lambda s: s["action"]).alias("actions")),
    O.with_steps("select " + cols(raw="trajectory_id; task_id; success", ints="seed; game_seed; num_steps := count(*)", arrs="actions := list(action order by step_index)")
                 + " from steps group by trajectory_id, task_id, success, seed, game_seed"),
)
QUERIES["explode_logged_steps"] = (
    lambda t: S.explode_steps(S.parse_trajectories(trajectory_lines(t))).select(
        "trajectory_id", "step_index", "action", "gold_action", "candidates", "history"),
    O.with_history("select " + cols(raw="trajectory_id; action; gold_action", ints="step_index", arrs="candidates; history") + " from hist"),
)


def report_lines(t):
    edits = t.edits.groupBy("task_id", "seed", "original_success").agg(
        F.array_sort(F.collect_list(F.struct("step_index", "edit_pos", "edit_type", "index", "labels", "replacement", "repair_suffix", "success"))).alias("edits"))
    doc = F.to_json(F.struct("task_id", "seed", "original_success", F.lit(None).cast("array<string>").alias("original_actions"), "edits"))
    return edits.select(F.col("seed").alias("ord"), F.concat(F.lit('{"reports":['), doc, F.lit("]}")).alias("value"))


QUERIES["read_reports"] = (
    lambda t: S.report_edits(S.read_reports(t.spark, written(t, report_lines(t)))).groupBy("task_id", "seed", "edit_type", "original_success").agg(
        F.count(F.lit(1)).alias("edits"), F.sum(F.size("repair_suffix")).alias("suffix_actions"), F.count_if("success").alias("good"),
        F.min("index").alias("first_index")),
    O.with_edits("select " + cols(raw="task_id; edit_type; original_success", ints="seed; edits := count(*); good := count(*) filter (where edit_success);"
                                  "suffix_actions := sum(case when kind = 0 then suffix_len else suffix_len - 1 end); first_index := min(edit_index)")
                 + " from edits group by task_id, seed, edit_type, original_success"),
)
QUERIES["read_predictions"] = (
    lambda t: S.read_predictions(t.spark, written(t, t.predictions.select("ord", F.to_json(F.struct(
        "task_id", "seed", "step_index", F.when(F.col("ord") % 3 == 0, F.col("scores")).alias("scores"),
        F.when(F.col("ord") % 3 == 1, F.col("scores")).alias("candidate_scores"),
        F.when(F.col("ord") % 3 == 2, F.transform(F.map_entries("scores"), lambda e: F.struct(e["key"].alias("action"), e["value"].alias("score")))).alias("scores"),
        F.when(F.col("ord") % 2 == 0, F.col("abstain")).alias("abstain"), F.when(F.col("ord") % 2 == 1, F.col("abstain")).alias("abstained"),
    ), {"ignoreNullFields": "true"}).alias("value")))).select(
        "task_id", "seed", "step_index", "abstain", F.size("scores").alias("n_scores"),
        F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, v: a + v).alias("total")),

    O.with_history("select " + cols(raw="task_id; abstain", ints="seed; step_index; n_scores := 5", dbls="total := list_sum(scores)") + " from preds", O.PREDS),
)
QUERIES["read_preferences"] = (
    lambda t: S.read_preferences(t.spark, written(t, t.preferences(history=True).select(F.col("event_id").alias("ord"), F.to_json(F.struct(
        "task_id", "seed", "history", "candidates", "preferred_action", "rejected_action", "certificate_level")).alias("value")))).select(
        "task_id", "seed", "step_index", "preferred_action", "rejected_action", "certificate_level", "candidates"),
    O.with_ledger("select " + cols(raw="task_id; preferred_action := preferred; rejected_action := action; certificate_level := level",
                                   ints="seed; step_index := len(history)", arrs="candidates") + " from prefs", "both", None, O.PREFS),
)

# Every seventh line is cut short, every eleventh has another shape: both are listed, and both stop a plain read.
def broken_lines(t):
    return trajectory_lines(t).withColumn("value", F.expr(
        "case when ord % 7 = 0 then concat('cut ', ord, '{') when ord % 11 = 0 then concat('{\"other\": ', ord, '}') else value end"))


_TRAJ = "tj as (select trajectory_id, min(event_id) as ord, count(*) as n from steps group by all)"
QUERIES["unreadable_records"] = (
    lambda t: S.read_trajectories(t.spark, written(t, broken_lines(t)), bad="keep").select("problem", "value"),
    O.with_history("select 'no episodes found' as problem, case when ord % 7 = 0 then concat('cut ', ord, '{') else concat('{\"other\": ', ord, '}') end as value"
                   " from tj where ord % 7 = 0 or ord % 11 = 0", _TRAJ),
)
QUERIES["readable_records"] = (
    lambda t: S.read_trajectories(t.spark, written(t, broken_lines(t)), bad="drop").select("trajectory_id", F.size("steps").alias("num_steps")),
    O.with_history("select " + cols(raw="trajectory_id", ints="num_steps := n") + " from tj where ord % 7 <> 0 and ord % 11 <> 0", _TRAJ),
)


def written_splits(t):
    """Preferences written by split and read back, the split from the folder names."""
    path = new_table_path(t.spark)
    S.write_table(seed_splits(t).select("task_id", "seed", "step_index", "split"), path, "json")
    return t.spark.read.schema("task_id string, seed bigint, step_index bigint, split string").json(path)


QUERIES["write_table"] = (written_splits, SPLIT_ORACLE)


def verifier_requests(t):
    """What the verifier would be asked at each step; its history is what has been done so far."""
    return t.steps.select(
        "task_id", F.lit("verifier").alias("model"), F.expr("concat('state ', pre_state)").alias("observation"),
        F.expr("array(candidates[0], candidates[1])").alias("candidates"), F.expr("candidates[0]").alias("raw_action"),
        F.expr("candidates[1]").alias("proposed_action"),
    )


def shards(t):
    """Two overlapping shards: the second repeats every third trajectory, changed, and some records failed."""
    rows = t.trajectories.withColumn("error", F.expr("if(ord % 11 = 0, 'boom', null)"))
    return {
        "first": rows.filter("ord % 4 <> 1"),
        "second": rows.filter("ord % 4 = 1 or ord % 3 = 0").withColumn("success", ~F.col("success")),
    }


_SHARDS = """t as (select trajectory_id, task_id, seed, game_seed, success, count(*) as n, min(event_id) as ord from steps group by all),
 sh as (select 'first' as source, 0 as s, ord % 11 = 0 as err, * from t where ord % 4 <> 1 union all
   select 'second', 1, ord % 11 = 0, * replace (not success as success) from t where ord % 4 = 1 or ord % 3 = 0),
 mg as (select * from (select *, row_number() over (partition by trajectory_id order by s, ord) as rn from sh where not err) where rn = 1)"""
QUERIES["merge_trajectories"] = (
    lambda t: S.merge_trajectories(shards(t)).select("trajectory_id", "task_id", "seed", "success", "source", F.size("steps").alias("num_steps")),
    O.with_history("select " + cols(raw="trajectory_id; task_id; success; source", ints="seed; num_steps := n") + " from mg", _SHARDS),
)
QUERIES["merge_summary"] = (
    lambda t: S.merge_summary(shards(t)),
    O.with_history("select " + cols(
        ints="written_trajectories := count(*); successful_trajectories := count(*) filter (where success); failed_trajectories := count(*) filter (where not success);"
        "errored_trajectories := 0; total_steps := sum(n); skipped_error_records := (select count(*) from sh where err);"
        "duplicate_records := (select count(*) from sh where not err) - count(*)",
        raw="source_counts_unique := concat('first=', count(*) filter (where source = 'first'), '|second=', count(*) filter (where source = 'second'))") + " from mg", _SHARDS),
)


def responses(t):
    """Model answers: JSON of both shapes for steps, free text from the conversations."""
    admissible = F.expr("array_append(candidates, 'look')")
    answers = t.steps.select(
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("id"), admissible.alias("admissible"),
        F.expr("case event_id % 4 when 0 then to_json(named_struct('actions', array(candidates[2], 'fly', concat(' ', candidates[0], ' '), candidates[2])))"
               " when 1 then to_json(named_struct('candidate_actions', array(candidates[1], 'look')))"
               " when 2 then to_json(array(candidates[3], action)) else concat('{\"actions\": [\"', candidates[0]) end").alias("response"),
    )
    talk = t.table("conversations").select(
        F.expr("concat('c', conv_id, '-', turn)").alias("id"), F.expr("array('look')").alias("admissible"), F.col("text").alias("response"))
    return answers.unionByName(talk)


QUERIES["parse_candidate_responses"] = (
    lambda t: S.parse_candidate_responses(responses(t)).select("id", "actions"),
    O.with_steps("select " + cols(raw="id := concat('s', event_id)", arrs="""actions := case event_id % 4 when 0 then [candidates[3], candidates[1]]
       when 1 then (case when candidates[2] = 'look' then ['look'] else [candidates[2], 'look'] end)
       when 2 then list_filter(case when candidates[4] = action then [action] else [candidates[4], action] end,
         lambda a: list_contains(candidates, a) or a = 'look') else [] end""") +
        " from steps union all select concat('c', conv_id, '-', turn), '' from conversations"),
)
QUERIES["parse_choice_responses"] = (
    lambda t: S.parse_choice_responses(t.steps.select("event_id", F.expr(
        "case event_id % 5 when 0 then to_json(named_struct('choice', 'PROPOSED')) when 1 then to_json(named_struct('choice', 'raw', 'why', 'proposed is worse'))"
        " when 2 then 'I would take the Proposed one' when 3 then to_json(named_struct('answer', 'proposed')) else action end").alias("response"))).select("event_id", "choice"),
    O.with_steps("select event_id, case when event_id % 5 in (0, 2) then 'proposed' else 'raw' end as choice from steps"),
)
QUERIES["task_attributes"] = (
    lambda t: task_attributes(t.steps.select("event_id", F.expr(
        "case event_id % 4 when 0 then task_id when 1 then concat('scienceworld://boil/', game_seed, '/hard') when 2 then concat('melt:', game_seed)"
        " else concat('a/b/plain_', game_seed) end").alias("task_id"))),
    O.with_steps("select event_id, " + cols(
        raw="""task_id := case event_id % 4 when 0 then task_id when 1 then concat('scienceworld://boil/', game_seed, '/hard') when 2 then concat('melt:', game_seed)
          else concat('a/b/plain_', game_seed) end; stem := case event_id % 4 when 0 then concat('arc_seed', game_seed) when 1 then 'hard' when 2 then concat('melt:', game_seed) else concat('plain_', game_seed) end;
          parent := case event_id % 4 when 0 then 'games' when 1 then game_seed::varchar when 2 then '' else 'b' end;
          world_task := case event_id % 4 when 0 then task_id when 1 then 'boil' when 2 then 'melt' else concat('a/b/plain_', game_seed) end;
          world_simplification := case when event_id % 4 = 1 then 'hard' else 'easy' end""",
        ints="inferred_seed := case when event_id % 4 = 0 then game_seed end; world_variation := case when event_id % 4 in (1, 2) then game_seed else 0 end") + " from steps"),
)
QUERIES["select_tasks"] = (
    lambda t: S.select_tasks(t.steps.select("task_id").distinct(), 5, 40, 20),
    O.with_steps("select distinct task_id from steps where game_seed between 5 and 40 order by task_id limit 20"),
)
QUERIES["rollout_worklist"] = (
    lambda t: S.rollout_worklist(t.steps.select("task_id").distinct(), 3, 10, 100),
    O.with_steps(", k as (select task_id, row_number() over (order by task_id) - 1 as i from (select distinct task_id from steps)) select " + cols(
        raw="task_id", ints="rollout_index := r; rollout_seed := 10 + r; agent_seed := 100 + i * 3 + r") + " from k, range(3) x(r)"),
)
QUERIES["collection_summary"] = (
    lambda t: S.collection_summary(t.trajectories.withColumn("error", F.expr("if(ord % 11 = 0, 'boom', null)")), write_errors=False),
    O.with_history("select " + cols(
        ints="attempted_trajectories := count(*); written_trajectories := count(*) filter (where ord % 11 <> 0);"
        "failed_trajectories := count(*) filter (where ord % 11 <> 0 and not success); successful_trajectories := count(*) filter (where ord % 11 <> 0 and success);"
        "errored_trajectories := count(*) filter (where ord % 11 = 0)") + " from t", _SHARDS.split(",\n sh as")[0]),
)
QUERIES["dedupe_requests"] = (
    lambda t: S.dedupe_requests(t.steps.select("task_id", "step_index", F.col("candidates").alias("admissible_actions"), F.lit("m").alias("model"))).drop("request_key"),
    O.with_steps("select " + cols(raw="task_id; model := 'm'", ints="step_index; requests := count(*)", arrs="admissible_actions := candidates")
                 + " from steps group by task_id, step_index, candidates"),
)
QUERIES["dedupe_verifier_requests"] = (
    lambda t: S.dedupe_requests(verifier_requests(t), "verifier").drop("request_key"),
    O.with_steps("select " + cols(raw="task_id; model := 'verifier'; observation := concat('state ', pre_state); raw_action := candidates[1];"
                                  "proposed_action := candidates[2]", ints="requests := count(*)", arrs="candidates := [candidates[1], candidates[2]]")
                 + " from steps group by task_id, pre_state, candidates[1], candidates[2]"),
)
