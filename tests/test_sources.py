import gzip
import json

import pytest
from conftest import one, rows

from trajlens.functions.tasks import task_attributes
from trajlens.sources import located
from trajlens.sources import logs as S
from trajlens.streaming.stream import run_first_records, stream_trajectories

EPISODE = {"task_id": "games/g_seed3.z8", "seed": 2, "success": True, "steps": [
    {"action": "look", "candidates": ["look", "go"]}, {"action": ""}, {"action": "go", "step_index": 9}]}


@pytest.mark.parametrize("shape", ["record", "episode", "episodes", "list", "container"])
def test_accepted_shapes(spark, tmp_path, shape):
    doc = {
        "record": EPISODE, "episode": {"episode": EPISODE}, "episodes": {"episodes": [EPISODE]}, "list": [EPISODE],
        "container": {"run": {"episodes": [EPISODE]}, "note": 3},
    }[shape]
    (tmp_path / "log.json").write_text(json.dumps(doc, indent=1))
    found = S.read_trajectories(spark, str(tmp_path / "log.json"))
    assert one(found.select("trajectory_id", "success")) == {"trajectory_id": "g_seed3:seed2", "success": True}
    steps = rows(S.explode_steps(found).orderBy("pos"))
    assert [s["step_index"] for s in steps] == [0, 1, 9] and steps[2]["history"] == ["look"]


def test_run_key_and_jsonl(spark, tmp_path):
    (tmp_path / "runs.json").write_text(json.dumps({"a": {"episodes": [EPISODE]}, "b": {"episodes": [EPISODE, EPISODE]}}))
    assert S.read_trajectories(spark, str(tmp_path / "runs.json"), "b").count() == 2
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps(EPISODE), "", json.dumps({**EPISODE, "seed": 5})]))
    assert sorted(r["seed"] for r in rows(S.read_trajectories(spark, str(tmp_path / "log.jsonl")).select("seed"))) == [2, 5]


def test_last_report_wins(spark, tmp_path):
    def report(action):
        return {"task_id": "g", "seed": 0, "original_actions": ["a", "b"], "edits": [
            {"edit_type": "policy_suffix", "index": -1, "labels": ["policy_repair_candidate"], "repair_suffix": [action], "edited_actions": [action]}]}
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(report(a)) for a in ("x", "y")))
    from trajlens.operators.ledger import first_repairs

    row = one(first_repairs(S.report_edits(S.read_reports(spark, str(tmp_path / "r.jsonl")))))
    assert (row["repair_action"], row["edited_action_len"], row["original_action_len"], row["repaired_outcome"]) == ("y", 1, 2, "success")


def test_prediction_score_encodings(spark, tmp_path):
    docs = [
        {"task_id": "a", "seed": 0, "step_index": 1, "scores": {"x": 1, "y": 2.5}},
        {"task_id": "b", "seed": 0, "history": ["p", "q"], "candidate_scores": [{"action": "x", "score": 3}, {"score": 1}, {"action": "x", "score": 4}], "abstained": True},
        {"task_id": "c", "seed": 0, "step_index": 0, "ranked_actions": ["x"]},
    ]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, docs)))
    got = {r["task_id"]: r for r in rows(S.read_predictions(spark, str(tmp_path / "p.jsonl")))}
    assert got["a"]["scores"] == {"x": 1.0, "y": 2.5} and got["a"]["abstain"] is False
    assert got["b"]["scores"] == {"x": 4.0} and got["b"]["abstain"] is True and got["b"]["step_index"] == 2
    assert got["c"]["scores"] is None and got["c"]["ranked_actions"] == ["x"]


TRAJECTORIES = "trajectory_id string, task_id string, seed bigint, rollout_seed bigint, game_seed bigint, success boolean, error string, steps array<int>, ord bigint"


def test_merge_keeps_first_and_skips_errors(spark):
    first = spark.createDataFrame([("t1", "g", 0, 0, 5, True, None, [1, 2], 0), ("bad", "g", 1, 1, 1, False, "boom", [], 1)], TRAJECTORIES)
    second = spark.createDataFrame([("t1", "g", 0, 0, 5, False, None, [1], 0), ("t0", "g", 0, 0, None, False, None, [], 1)], TRAJECTORIES)
    merged = rows(S.merge_trajectories({"a": first, "b": second}))
    assert [(r["trajectory_id"], r["success"], r["source"]) for r in merged] == [("t1", True, "a"), ("t0", False, "b")]
    total = one(S.merge_summary({"a": first, "b": second}))
    assert (total["written_trajectories"], total["duplicate_records"], total["skipped_error_records"]) == (2, 1, 1)
    assert total["source_counts_unique"] == {"a": 1, "b": 1}


def test_response_parsing(spark):
    frame = spark.createDataFrame([
        (0, '{"actions": ["go", "fly", " look ", "go"]}', ["look", "go"]), (1, '["look"]', ["look"]), (2, "not json", ["look"]),
        (3, '{"actions": [], "candidate_actions": ["go"]}', ["go"]), (4, '"look"', ["look"]),
    ], "id int, response string, admissible array<string>")
    assert {r["id"]: r["actions"] for r in rows(S.parse_candidate_responses(frame))} == {0: ["go", "look"], 1: ["look"], 2: [], 3: ["go"], 4: []}
    frame = spark.createDataFrame([(0, '{"choice": "PROPOSED"}'), (1, '{"choice": "raw", "note": "proposed"}'), (2, "I pick proposed."), (3, "")], "id int, response string")
    assert [r["choice"] for r in rows(S.parse_choice_responses(frame).orderBy("id"))] == ["proposed", "raw", "proposed", "raw"]


def test_task_attributes_and_selection(spark):
    frame = spark.createDataFrame([("a/b/x_seed12.z8",), ("scienceworld://boil/3",), ("melt:4:hard",)], "task_id string")
    got = {r["task_id"]: r for r in rows(task_attributes(frame))}
    assert (got["a/b/x_seed12.z8"]["inferred_seed"], got["a/b/x_seed12.z8"]["stem"], got["a/b/x_seed12.z8"]["parent"]) == (12, "x_seed12", "b")
    assert (got["scienceworld://boil/3"]["world_task"], got["scienceworld://boil/3"]["world_variation"], got["scienceworld://boil/3"]["world_simplification"]) == ("boil", 3, "easy")
    assert got["melt:4:hard"]["world_simplification"] == "hard"
    catalog = spark.createDataFrame([(f"g_seed{i}.z8",) for i in (3, 1, 2)], "task_id string")
    assert [r["task_id"] for r in rows(S.select_tasks(catalog, 2, None, 1))] == ["g_seed2.z8"]
    with pytest.raises(ValueError):
        S.select_tasks(catalog, 9)
    work = rows(S.rollout_worklist(catalog, 2, 10, 100).orderBy("agent_seed"))
    assert [(r["task_id"], r["rollout_seed"], r["agent_seed"]) for r in work][2:4] == [("g_seed2.z8", 10, 102), ("g_seed2.z8", 11, 103)]


def test_written_splits_are_partitioned(spark, tmp_path):
    frame = spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")
    S.write_table(frame, str(tmp_path / "out"), "parquet")
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"split=train", "split=test"}


def numbered(count):
    return [json.dumps({**EPISODE, "seed": n, "note": "é" * (n % 5)}, ensure_ascii=False) for n in range(count)]


def test_located_lines_of_any_split_size(spark, tmp_path):
    lines = [*numbered(20), "", "x" * 70, "last without end é"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "in" / "b.jsonl.gz").write_bytes(gzip.compress("\r\n".join(lines).encode() + b"\n"))
    (tmp_path / "in" / "_hidden").write_text("no")
    want = {}
    for name, end in (("a.jsonl", 1), ("b.jsonl.gz", 2)):
        place = 0
        for line in lines:
            want[name, place] = line
            place += len(line.encode()) + end
    located.register(spark)
    for size in (1, 37, 300, 1 << 20):
        found = rows(spark.read.format("located_lines").option("path", str(tmp_path / "in")).option("split_bytes", size).load())
        assert len(found) == len(want)
        assert {(r["file"].rsplit("/", 1)[1], r["place"]): r["value"] for r in found} == want
    assert len(located.splits({"a": 100, "c.gz": 7}, 30)) == 5


def test_unreadable_records_raise_or_are_listed(spark, tmp_path):
    good = json.dumps(EPISODE)
    broken = ['{"task_id": "g", "steps": [', '{"other": 1}', '[1, 2]', json.dumps([EPISODE, {"x": 1}])]
    (tmp_path / "log.jsonl").write_text("\n".join([good, *broken, json.dumps({"episodes": []}), "[]"]))
    path = str(tmp_path / "log.jsonl")
    with pytest.raises(Exception, match="log.jsonl at byte .*no episodes found"):
        S.read_trajectories(spark, path).select("trajectory_id").collect()
    # A count must not pass over them either.
    with pytest.raises(Exception, match="no episodes found"):
        S.read_trajectories(spark, path).count()
    listed = rows(S.read_trajectories(spark, path, bad="keep"))
    assert {r["value"] for r in listed} == set(broken)
    assert f"{path} at byte {len(good) + 1}" in {r["source"] for r in listed}
    assert S.read_trajectories(spark, path, bad="drop").count() == 1
    (tmp_path / "p.jsonl").write_text("\n".join(['{"task_id": "a", "seed": 1}', '{"task_id": "b"', "no json", '{"seed": 3}', '{"task_id": "c", "seed": "x"}']))
    path = str(tmp_path / "p.jsonl")
    for read in (S.read_preferences, S.read_predictions):
        assert sorted(r["problem"] for r in rows(read(spark, path, bad="keep"))) == ["no task_id", "not a record", "not a record", "not a record"]
        assert [r["task_id"] for r in rows(read(spark, path, bad="drop"))] == ["a"]
        with pytest.raises(Exception, match="p.jsonl at byte"):
            read(spark, path).collect()
    with pytest.raises(FileNotFoundError):
        located._sizes({"path": str(tmp_path / "nothing")})


def test_located_lines_stream_takes_each_line_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    file = tmp_path / "in" / "grow.jsonl"
    located.register(spark)
    stream = spark.readStream.format("located_lines").option("path", str(tmp_path / "in")).option("split_bytes", 16).load()

    def take():
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        query.awaitTermination()
        return sorted(r["value"] for r in rows(spark.read.parquet(str(tmp_path / "out"))))

    file.write_text("one\ntwo\nunfin")
    assert take() == ["one", "two"]
    with file.open("a") as out:
        out.write("ished\nthree\n")
    assert take() == ["one", "three", "two", "unfinished"]


def test_stream_keeps_the_first_record_of_a_key(spark, tmp_path):
    """Copies that differ, in one batch and in later ones: the stream ends with what the batch merge keeps."""
    schema = "trajectory_id string, task_id string, seed bigint, rollout_seed bigint, game_seed bigint, success boolean, error string"
    (tmp_path / "feed").mkdir()
    lines = [{"trajectory_id": f"t{n % 4}", "task_id": "g", "seed": n, "success": n % 2 == 0} for n in range(12)] + [{"trajectory_id": "t9", "task_id": "g", "error": "boom"}]
    (tmp_path / "feed" / "b.jsonl").write_text("".join(json.dumps(line) + "\n" for line in lines))
    (tmp_path / "feed" / "a.jsonl").write_text(json.dumps({"trajectory_id": "t3", "task_id": "g", "seed": 77}) + "\n")
    found = {r["trajectory_id"]: r["seed"] for r in rows(run_first_records(stream_trajectories(spark, str(tmp_path / "feed"), schema)))}
    assert found == {"t0": 0, "t1": 1, "t2": 2, "t3": 77}
    (tmp_path / "feed" / "c.jsonl").write_text("no json\n")
    with pytest.raises(Exception, match="not a record"):
        run_first_records(stream_trajectories(spark, str(tmp_path / "feed"), schema))
