from conftest import one, rows
from pyspark.sql import functions as F

from trajlens.operators import ledger as L

STEPS = """task_id string, trajectory_id string, seed bigint, step_index int, success boolean, action string,
 candidates_before array<string>, candidates array<string>, gold_action string"""
EDITS = """task_id string, seed bigint, edit_pos int, edit_type string, index int, labels array<string>, replacement string,
 repair_suffix array<string>, edited_len int, original_len int, original_success boolean, success boolean"""


def step(task, i, action, candidates, gold=None, success=False, before=None):
    return (task, f"{task}:seed0", 0, i, success, action, before, candidates, gold)


def policy_edit(task, index, suffix, success=None, pos=0, original=False, edited=1, length=2):
    return (task, 0, pos, "policy_suffix", index, ["policy_repair_candidate"], None, suffix, edited, length, original, success)


def branch_edit(task, index, action, suffix, success=None, pos=0):
    return (task, 0, pos, "candidate_policy_suffix", index, ["candidate_policy_repair"], action, suffix, 3, 2, False, success)


def ledger_of(spark, steps, edits, source="policy-repair", limit=None):
    frame = L.with_history(spark.createDataFrame(steps, STEPS))
    repairs = L.first_repairs(spark.createDataFrame(edits, EDITS)) if edits else None
    return L.step_ledger(frame, repairs, source, limit)


def test_certified_repair(spark):
    ledger = ledger_of(spark, [step("g", 0, "look", ["look", "open door"])], [policy_edit("g", -1, ["open door"])])
    row = one(L.compile_preferences(ledger))
    assert (row["preferred_rank_before"], row["rejected_rank_before"]) == (2, 1)
    assert (row["certificate_level"], row["repair_suffix_len"]) == ("C3_failure_repair", 1)
    assert (row["original_outcome"], row["repaired_outcome"], row["source"]) == ("fail", "success", "policy_repair_suffix")


def test_gold_source_and_absent_gold(spark):
    row = one(L.compile_preferences(ledger_of(spark, [step("g", 0, "inventory", ["inventory", "take coin"], "take coin")], [], "gold")))
    assert (row["certificate_level"], row["repair_suffix_len"], row["repaired_outcome"]) == ("C0_candidate_only", 0, "unknown")
    absent = ledger_of(spark, [step("g", 0, "inventory", ["inventory", "look"], "take coin")], [], "gold")
    assert rows(L.compile_preferences(absent)) == []
    assert one(absent)["status"] == "repair_not_in_candidates"


def test_status_precedence(spark):
    steps = [
        step("none", 0, "look", []),
        step("nothing", 0, "look", ["look"]),
        step("failed", 0, "look", ["look", "a"]),
        step("long", 0, "look", ["look", "a"]),
        step("same", 0, "look", ["look", "a"]),
        step("absent", 0, "look", ["look"]),
        step("good", 0, "look", ["look", "a"]),
    ]
    edits = [
        policy_edit("none", -1, ["a"]), policy_edit("failed", -1, ["a"], success=False),
        policy_edit("long", -1, ["a", "b", "c", "d"]), policy_edit("same", -1, ["look"]),
        policy_edit("absent", -1, ["a"]), policy_edit("good", -1, ["a"], success=True),
    ]
    got = {r["task_id"]: r for r in rows(ledger_of(spark, steps, edits, limit=3))}
    assert {k: v["status"] for k, v in got.items()} == {
        "none": "no_candidates_logged", "nothing": "no_repair_found", "failed": "invalid_replay", "long": "suffix_too_long",
        "same": "repair_same_as_executed", "absent": "repair_not_in_candidates", "good": "certified_preference",
    }
    assert got["good"]["status_reason"] is None and got["none"]["status_reason"].startswith("no candidate actions")


def test_repair_wins_over_gold_only_where_present(spark):
    steps = [step("g", 0, "x", ["x", "a", "b"], "b"), step("g", 1, "x", ["x", "a", "b"], "b")]
    got = {r["step_index"]: r["repair_action"] for r in rows(ledger_of(spark, steps, [policy_edit("g", -1, ["a"])], "both"))}
    assert got == {0: "a", 1: "b"}


def test_first_repair_choice(spark):
    edits = [
        policy_edit("g", 0, ["p"], pos=0),            # step 1, length 1, lowest priority
        branch_edit("g", 1, "q", [], pos=1),          # step 1, length 1, highest priority
        branch_edit("g", 2, "z", ["k"], pos=2),       # step 2, length 2
        branch_edit("g", 2, "B  b", ["k"], pos=3),    # step 2, length 2, smaller normalised text
        ("g", 0, 4, "replace", 1, ["repair_candidate"], "r", [], 2, 2, False, True),
    ]
    got = {r["step_index"]: r for r in rows(L.first_repairs(spark.createDataFrame(edits, EDITS)))}
    assert got[1]["repair_action"] == "q" and got[1]["repair_source"] == "candidate_policy_suffix"
    assert got[2]["repair_action"] == "B  b" and got[2]["repair_suffix_len"] == 2


def test_shorter_success_certificate(spark):
    edits = [policy_edit("g", -1, ["a"], original=True, edited=1, length=2), policy_edit("h", -1, ["a"], original=True, edited=2, length=2)]
    got = {r["task_id"]: r["certificate_level"] for r in rows(L.first_repairs(spark.createDataFrame(edits, EDITS)))}
    assert got == {"g": "C3_shorter_success", "h": "C1_oracle_suffix"}


def test_normalised_text_and_empty_list_fallback(spark):
    steps = [step("g", 0, "  LOOK   ", [], None), step("h", 0, "look", ["look", "Open   Door"], before=[])]
    got = {r["task_id"]: r for r in rows(ledger_of(spark, steps, [policy_edit("g", -1, ["Open   Door"]), policy_edit("h", -1, ["Open   Door"])]))}
    assert got["g"]["status"] == "no_candidates_logged"
    assert (got["g"]["executed_action_norm"], got["g"]["repair_action_norm"]) == ("look", "open door")
    assert got["h"]["status"] == "certified_preference" and got["h"]["candidate_count"] == 2


def test_history_skips_empty_actions(spark):
    frame = spark.createDataFrame([step("g", 0, "a", []), step("g", 1, "", []), step("g", 2, "b", []), step("g", 3, "c", [])], STEPS)
    got = {r["step_index"]: r["history"] for r in rows(L.with_history(frame))}
    assert got == {0: [], 1: ["a"], 2: ["a"], 3: ["a", "b"]}


LEDGER = "trajectory_id string, task_id string, seed bigint, step_index int, status string, original_outcome string, has_logged_candidates boolean, candidate_count int, repair_rank_before int, repair_suffix_len int"


def entry(t, i, status, outcome="fail", has=None, n=5, rank=None, length=None):
    return (t, t, 0, i, status, outcome, has, n, rank, length)


def test_decomposition_uses_failed_rows(spark):
    data = [
        entry("f", 0, "certified_preference", rank=2), entry("f", 1, "certified_preference", rank=4),
        entry("f", 2, "repair_not_in_candidates"), entry("f", 3, "no_repair_found"),
        entry("f", 4, "no_candidates_logged", n=0), entry("s", 0, "certified_preference", "success", rank=3),
    ]
    row = one(L.failure_decomposition(spark.createDataFrame(data, LEDGER)))
    assert (row["trajectories"], row["failed_trajectories"], row["summarized_trajectories"]) == (2, 1, 1)
    assert (row["steps"], row["candidate_steps"], row["certified_preferences"]) == (5, 4, 2)
    assert (row["certified_misranking_step_rate"], row["candidate_absent_step_rate"], row["avg_preferred_rank"]) == (0.5, 0.25, 3.0)
    assert row["no_candidates_logged_step_rate"] == 0.2


def test_decomposition_without_failures_and_empty(spark):
    row = one(L.failure_decomposition(spark.createDataFrame([entry("s", 0, "certified_preference", "success", rank=3)], LEDGER)))
    assert (row["failed_trajectories"], row["summarized_trajectories"], row["certified_preferences"]) == (0, 1, 1)
    row = one(L.failure_decomposition(spark.createDataFrame([], LEDGER)))
    assert (row["steps"], row["certified_misranking_step_rate"], row["avg_preferred_rank"]) == (0, 0.0, 0.0)


def test_legacy_nested_ledger(spark):
    data = [("t", "fail", [("repair_same_as_executed", 5), ("no_repair_found", 5)]), ("flat", "fail", None)]
    nested = spark.createDataFrame(data, "trajectory_id string, outcome string, step_statuses array<struct<status:string,candidate_count:int>>")
    flat = L.normalize_step_ledger(nested)
    assert sorted(r["status"] for r in rows(flat)) == ["no_repair_found", "repair_same_as_executed"]
    assert {r["original_outcome"] for r in rows(flat)} == {"fail"}


def test_top_k_and_suffix_budget(spark):
    data = [entry("a", 0, "certified_preference", rank=2, length=3), entry("b", 0, "certified_preference", rank=5, length=7), entry("b", 1, "repair_not_in_candidates")]
    frame = spark.createDataFrame(data, LEDGER)
    got = {r["top_k"]: r for r in rows(L.top_k_sensitivity(frame, (3, 5)))}
    assert [got[k]["certified_preferences_retained"] for k in (3, 5)] == [1, 2]
    assert abs(got[3]["candidate_absent_step_rate"] - 2 / 3) < 1e-12 and got[3]["repairable_trajectories"] == 1
    got = {r["suffix_budget"]: r for r in rows(L.suffix_budget_sensitivity(spark.createDataFrame(data[:2], LEDGER), (5,)))}
    assert (got["5"]["certified_preferences_retained"], got["5"]["certified_preferences_lost"], got["5"]["suffix_too_long_step_rate"]) == (1, 1, 0.5)
    assert got["full"]["certified_preferences_retained"] == 2


def test_trajectory_ledger_keeps_empty_trajectories(spark):
    frame = ledger_of(spark, [step("g", 0, "look", ["look", "a"], "a"), step("g", 1, "look", ["look"], None)], [], "gold")
    all_ids = spark.createDataFrame([("g:seed0", "g", 0, False), ("e:seed0", "e", 0, True)], "trajectory_id string, task_id string, seed bigint, success boolean")
    got = {r["task_id"]: r for r in rows(L.trajectory_ledger(frame, all_ids))}
    assert got["g"]["status_counts"] == {"certified_preference": 1, "no_repair_found": 1} and len(got["g"]["step_statuses"]) == 2
    assert (got["e"]["num_steps"], got["e"]["outcome"], got["e"]["status_counts"]) == (0, "success", {})


def test_multiplicity(spark):
    steps = [step("g", 0, "a", ["a", "b", "B ", "c"]), step("g", 1, "a", ["a"]), step("g", 2, "x", ["y", "z"])]
    outcomes = [("g", 0, 0, "a", True, 3), ("g", 0, 0, "b", True, 1), ("g", 0, 0, "c", True, 1), ("g", 0, 2, "y", True, 2), ("g", 0, 2, "z", False, 13)]
    got = L.repair_multiplicity(
        spark.createDataFrame(steps, STEPS),
        spark.createDataFrame(outcomes, "task_id string, seed bigint, step_index int, action string, success boolean, suffix_len int"),
        ["task_id", "seed", "step_index"])
    by_step = {r["step_index"]: r for r in rows(got)}
    assert by_step[0]["candidate_count"] == 3 and by_step[0]["successful_actions"] == ["a", "b", "c"]
    assert (by_step[0]["first_rank_success"], by_step[0]["shortest_suffix_success"], by_step[0]["tie_break_disagreement"]) == ("a", "b", True)
    total = one(L.multiplicity_summary(got))
    assert (total["candidate_steps"], total["steps_with_successful_logged_candidate"], total["tie_break_disagreement_steps"]) == (3, 2, 1)
    assert (total["steps_with_multiple_min_suffix_logged_candidates"], total["steps_with_multiple_min_suffix_alternatives"]) == (1, 1)


def test_every_step_has_one_status_whatever_the_partitioning(spark):
    from trajlens.plans.inputs import Inputs

    t = Inputs(spark, "/root/testdata/sf0.001")
    direct = t.ledger()
    shuffled = L.step_ledger(t.steps.repartition(5, "event_id"), L.first_repairs(t.edits.repartition(3, "edit_pos")), "both")
    count = lambda df: sorted((r["status"], r["count"]) for r in rows(df.groupBy("status").count()))
    assert count(direct) == count(shuffled)
    assert direct.count() == t.steps.count() == direct.select("task_id", "seed", "step_index").distinct().count()
    assert direct.filter(F.col("status").isNull()).isEmpty()


def test_history_with_and_without_empty_actions(spark):
    steps = spark.createDataFrame([("t", n, a) for n, a in enumerate(["x", "", None, "y"])], "trajectory_id string, step_index int, action string")
    assert [r["history"] for r in rows(L.with_history(steps).orderBy("step_index"))][-1] == ["x"]
    assert [r["history"] for r in rows(L.with_history(steps, keep_empty=True).orderBy("step_index"))][-1] == ["x", "", ""]
