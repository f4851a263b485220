"""Trajectory-shaped tables derived from the ``events`` table.

An episode is a user's activity inside a ten-day block, cut every ``HORIZON`` steps, so no episode is ever
longer than that whatever one user contributes. Actions come from a fixed vocabulary; the state is a running
sum modulo six, so (task, seed, state, action) always leads to one next state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HORIZON = 64

# The action vocabulary.
VOCABULARY = (
    "go north", "go south", "go east", "go west", "take key", "drop key", "open door", "close door",
    "take apple", "put apple in fridge", "look", "inventory", "examine desk", "unlock chest", "lock chest",
    "open chest", "read note", "eat apple", "insert coin", "take coin",
)
TRAJECTORY = ["task_id", "seed"]
STEP = ["task_id", "seed", "step_index"]

_DELTA = """
case when action = 'go north' then 1 when action = 'go south' then -1
     when action = 'go east' then 2 when action = 'go west' then -2
     when action like 'open %' then 3 when action like 'close %' then -3
     when action like 'take %' then 1
     when action like 'drop %' or action like 'put %' or action like 'insert %' then -1 else 0 end
"""


def _vocabulary() -> str:
    return "array(" + ", ".join(f"'{action}'" for action in VOCABULARY) + ")"


def fixture_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat step log.

    Positions inside a (user, block) session are a prefix count over minutes plus a row number inside the
    minute: a session that holds a third of all events is numbered by tens of thousands of tasks, and the
    window over a session sees at most 14 400 rows (minutes in ten days).
    """
    events = (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .select("event_id", "user_id", "value", "event_type", "ts")
        .withColumn("rollout", F.expr("cast((day(ts) - 1) div 10 as int)"))
        .withColumn("minute", F.expr("datediff(cast(ts as date), date'1970-01-01') * 1440 + hour(ts) * 60 + minute(ts)"))
        .withColumn(
            "action",
            F.expr(
                f"element_at({_vocabulary()}, cast((event_id * 7 + if(event_id % 5 = 0, 3, 0)) % 20 as int) + 1)"
            ),
        )
        .withColumn("delta", F.expr(_DELTA))
    )
    chunk = ["user_id", "rollout", "minute"]
    session = Window.partitionBy("user_id", "rollout")
    running = session.orderBy("minute")
    chunks = (
        events.groupBy(*chunk)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("delta").alias("moved"),
            F.max(F.expr("event_type = 'purchase' and value > 70")).alias("won"),
        )
        .select(
            *chunk,
            (F.sum("n").over(running) - F.col("n")).alias("steps_before"),
            (F.sum("moved").over(running) - F.col("moved")).alias("moved_before"),
            F.coalesce(F.max("won").over(session), F.lit(False)).alias("success"),
        )
    )
    inside = Window.partitionBy(*chunk).orderBy("ts", "event_id")
    placed = (
        events.join(chunks, chunk)
        .withColumn("place", F.col("steps_before") + F.row_number().over(inside) - 1)
        .withColumn("moved", F.col("moved_before") + F.sum("delta").over(inside) - F.col("delta"))
    )
    return (
        placed.withColumn("game_seed", F.expr("user_id % 50"))
        .withColumn("seed", F.expr(f"(user_id div 50) * 3 + rollout + (place div {HORIZON}) * 1000000000"))
        .select(
            "event_id",
            F.expr("concat('games/arc_seed', game_seed, '.z8')").alias("task_id"),
            "seed",
            "rollout",
            F.expr("concat('arc_seed', game_seed, ':seed', seed, ':rollout', rollout)").alias("trajectory_id"),
            "game_seed",
            F.expr(f"cast(place % {HORIZON} as int)").alias("step_index"),
            "success",
            F.expr(
                f"transform(sequence(0, 4), j -> element_at({_vocabulary()},"
                " cast((event_id * 7 + j * 3) % 20 as int) + 1))"
            ).alias("candidates"),
            "action",
            F.expr(
                f"case when event_id % 11 = 0 then null else element_at({_vocabulary()},"
                " cast((event_id * 7 + 3 * ((event_id * 13 + user_id) % 8)) % 20 as int) + 1) end"
            ).alias("gold_action"),
            "value",
            F.expr("cast(pmod(moved, 6) as int)").alias("pre_state"),
            F.expr("cast(pmod(moved + delta, 6) as int)").alias("post_state"),
        )
    )


def fixture_trajectories(steps: DataFrame) -> DataFrame:
    """The same log as nested trajectories (at most ``HORIZON`` steps each)."""
    step = F.struct(
        "step_index", "action", F.col("candidates").alias("candidates_before"), "candidates", "gold_action",
        F.lit(True).alias("valid"), F.col("value").alias("reward"),
    )
    return (
        steps.groupBy("trajectory_id", "task_id", "seed", "rollout", "game_seed", "success")
        .agg(F.array_sort(F.collect_list(step)).alias("steps"), F.min("event_id").alias("ord"))
        .withColumn("rollout_seed", F.col("seed"))
    )


def fixture_edits(steps: DataFrame) -> DataFrame:
    """Replay evidence: up to two repair edits per step with a gold action, one in seven unsuccessful."""
    return (
        steps.filter("gold_action is not null")
        .withColumn("edit_pos", F.explode(F.sequence(F.lit(0), F.lit(1))))
        .filter("(event_id + edit_pos) % 4 <> 1")
        .withColumn("kind", F.expr("(event_id + edit_pos) % 3"))
        .withColumn("repair_action", F.expr("if(edit_pos = 0, gold_action, candidates[1])"))
        .withColumn("suffix_len", F.expr("cast(1 + (event_id * 3 + edit_pos * 5) % 9 as int)"))
        .select(
            *STEP,
            "rollout",
            "trajectory_id",
            "edit_pos",
            F.expr(
                "element_at(array('policy_suffix', 'candidate_policy_suffix', 'suffix_match_policy'),"
                " cast(kind as int) + 1)"
            ).alias("edit_type"),
            F.expr("if(kind = 0, step_index - 1, step_index)").alias("index"),
            "action",
            F.expr(
                "array(element_at(array('policy_repair_candidate', 'candidate_policy_repair',"
                " 'suffix_match_repair'), cast(kind as int) + 1))"
            ).alias("labels"),
            F.expr("if(kind = 0, null, repair_action)").alias("replacement"),
            F.expr(
                "if(kind = 0, concat(array(repair_action), array_repeat('look', suffix_len - 1)),"
                " array_repeat('look', suffix_len - 1))"
            ).alias("repair_suffix"),
            F.expr("step_index + suffix_len").alias("edited_len"),
            F.expr("(event_id + edit_pos) % 7 <> 0").alias("success"),
            F.col("success").alias("original_success"),
            F.lit(HORIZON // 4).alias("original_len"),
        )
    )


def fixture_predictions(steps: DataFrame) -> DataFrame:
    """Scores per candidate; one step in ten has none, one prediction in nine abstains."""
    scores = F.expr(
        "map_from_arrays(candidates, transform(sequence(0, 4),"
        " j -> cast((event_id * 17 + j * 29) % 100 as double) / 10))"
    )
    return steps.filter("event_id % 10 <> 3").select(
        *STEP,
        scores.alias("scores"),
        F.lit(None).cast("array<string>").alias("ranked_actions"),
        F.expr("event_id % 9 = 0").alias("abstain"),
        F.col("event_id").alias("ord"),
    )


def fixture_transitions(steps: DataFrame) -> DataFrame:
    """Logged transitions, one row per step; terminal when the goal state of the game is entered."""
    return steps.select(
        "task_id",
        "seed",
        F.col("pre_state").alias("state"),
        "action",
        F.col("post_state").alias("next_state"),
        F.expr("if(post_state = game_seed % 6 and post_state <> pre_state, 1.0D, 0.0D)").alias("reward"),
        F.expr("post_state = game_seed % 6 and post_state <> pre_state").alias("done"),
        F.lit(True).alias("valid"),
    )
