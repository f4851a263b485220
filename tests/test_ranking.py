from conftest import one, rows
from pyspark.sql import functions as F

from trajlens.operators import bootstrap as B
from trajlens.operators import datasets as D
from trajlens.operators import ranking as R

PREFS = "task_id string, seed bigint, step_index int, history array<string>, candidates array<string>, preferred_action string, rejected_action string, source string, game_seed bigint"
PREDS = "task_id string, seed bigint, step_index int, scores map<string,double>, ranked_actions array<string>, abstain boolean, ord bigint"


def prefs(spark, *items):
    return spark.createDataFrame([(t, 0, i, h, c, p, r, "x", 0) for t, i, h, c, p, r in items], PREFS)


ONE = ("game.z8", 0, [], ["look", "open door"], "open door", "look")


def preds(spark, *items):
    return spark.createDataFrame([("game.z8", 0, 0, s, r, a, o) for s, r, a, o in items], PREDS)


def test_without_predictions(spark):
    row = one(R.ranking_summary(R.evaluate_ranking(prefs(spark, ONE))))
    assert (row["raw_mrr"], row["oracle_mrr"], row["learned_mrr"], row["learned_abstain_rate"]) == (0.5, 1.0, None, None)


def test_scores_last_prediction_and_abstention(spark):
    good = preds(spark, ({"look": 5.0}, None, False, 0), ({"look": 0.0, "open door": 2.0}, None, False, 1))
    row = one(R.ranking_summary(R.evaluate_ranking(prefs(spark, ONE), good)))
    assert (row["learned_mrr"], row["learned_ndcg"], row["learned_top1_correction_rate"], row["learned_abstain_rate"]) == (1.0, 1.0, 1.0, 0.0)
    row = one(R.ranking_summary(R.evaluate_ranking(prefs(spark, ONE), preds(spark, ({}, None, True, 0)))))
    assert (row["learned_abstain_rate"], row["learned_mrr"], row["learned_predictions"]) == (1.0, None, 1)


def test_learned_order_is_a_permutation(spark):
    item = ("game.z8", 0, [], ["a", "b", "c", "d"], "d", "a")
    ranked = one(R.evaluate_ranking(prefs(spark, item), preds(spark, (None, ["d", "zzz", "b", "d"], False, 0))))
    assert (ranked["learned_rank"], ranked["learned_top1"]) == (1, "d")
    scored = one(R.evaluate_ranking(prefs(spark, item), preds(spark, ({"c": 1.0, "b": 1.0}, None, False, 0))))
    assert (scored["learned_top1"], scored["learned_rank"]) == ("b", 4)


def test_action_types(spark):
    frame = prefs(spark, ("n.z8", 0, [], ["open door", "go west"], "go west", "open door"), ("i.z8", 0, [], ["go west", "take key"], "take key", "go west"))
    got = {r["action_group"]: r["preferences"] for r in rows(R.ranking_by_action_type(frame))}
    assert got == {"all": 2, "navigation": 1, "non_navigation": 1}
    assert {r["verb"]: r["preferences"] for r in rows(R.verb_counts(frame))} == {"go": 1, "take": 1}
    empty = {r["action_group"]: r for r in rows(R.ranking_by_action_type(frame.limit(0)))}
    assert len(empty) == 3 and empty["all"]["raw_mrr"] == 0.0


def test_against_run_by_stem_and_missing(spark):
    run = spark.createDataFrame(
        [("game", 0, 0, ["look", "open door"], "look", 1), ("game", 0, 0, ["open door"], "open door", 2)],
        "task_id string, seed bigint, step_index int, candidates array<string>, action string, ord bigint")
    got = rows(R.evaluate_against_run(run, prefs(spark, ONE, ("game.z8", 5, ["a", "b"], ["x"], "x", "y"))))
    by_step = {r["step_index"]: r for r in got}
    assert by_step[0]["selected_action"] == "open door" and by_step[0]["preferred_rank_before"] == 1
    assert by_step[2]["missing_step"] and by_step[2]["selected_action"] is None
    total = one(R.run_preference_summary(R.evaluate_against_run(run, prefs(spark, ONE))))
    assert (total["matched_steps"], total["misranking_rate"], total["learned_mrr"]) == (1, 0.0, None)


STEPS = "trajectory_id string, task_id string, seed bigint, step_index int, ord bigint, success boolean, action string, candidates array<string>, gold_action string, history array<string>"


def test_retention_and_demotion(spark):
    steps = spark.createDataFrame([
        ("t", "game.z8", 0, 0, 1, True, "go", ["go", "look"], "go", []),
        ("t", "game.z8", 0, 1, 1, True, "look", ["look", "go"], "go", ["go"]),
        ("t", "game.z8", 0, 2, 1, True, "go", ["go"], "go", ["go", "look"]),
        ("u", "game.z8", 1, 0, 2, False, "go", ["go", "look"], "go", []),
    ], STEPS)
    kept = D.retention_dataset(steps)
    assert [(r["step_index"], r["rejected_action"]) for r in rows(kept)] == [(0, "look")]
    total = one(D.retention_summary(steps))
    assert (total["retention_records"], total["skipped_gold_not_raw_top1"], total["skipped_single_candidate"], total["skipped_failed_trajectory"]) == (1, 1, 1, 1)
    assert (total["considered_steps"], total["trajectories"]) == (3, 2)
    capped = one(D.retention_summary(steps, include_failed=True, max_records=1))
    assert (capped["retention_records"], capped["considered_steps"], capped["trajectories"], capped["failed_trajectories"]) == (1, 1, 2, 0)
    bad = one(R.gold_demotion(kept, preds(spark, ({"look": 2.0, "go": 1.0}, None, False, 0))))
    assert (bad["gold_demotion_rate_when_intervened"], bad["gold_retention_rate_when_intervened"]) == (1.0, 0.0)
    held = one(R.gold_demotion(kept, preds(spark, ({"look": 2.0}, None, True, 0))))
    assert held["gold_retention_rate_with_abstention"] == 1.0


def test_replay_values(spark):
    frame = prefs(spark, ("g", 0, [], ["a", "b", "c", "d"], "b", "a"))
    found = spark.createDataFrame([("g", 0, 0, ["A", "c", "a"], [1, 3, 0])], "task_id string, seed bigint, step_index int, successful_actions array<string>, successful_suffix_lens array<int>")
    row = one(D.replay_value_targets(frame, found))
    assert {k: round(v, 6) for k, v in row["candidate_rewards"].items()} == {"a": 0.2, "b": 1.0, "c": 0.6625, "d": 0.0}
    assert row["replay_value_successful_candidates"] == 2


def test_splits_are_exact_and_leak_free(spark):
    frame = spark.createDataFrame([(f"arc_seed{s}.z8", 0, i, None) for s in range(201, 207) for i in range(2)], "task_id string, seed bigint, step_index int, game_seed bigint")
    parts = D.make_splits(frame, "seed", (0.5, 0.25, 0.25), 3)
    D.assert_no_leakage(parts)
    got = {r["split"]: (r["records"], r["groups"], r["leaking_groups"]) for r in rows(D.split_summary(parts))}
    assert got == {"train": (4, 2, 0), "valid": (4, 2, 0), "test": (4, 2, 0)}
    assert "201" in {r["split_group"] for r in rows(parts)}
    again = D.make_splits(frame.repartition(3), "seed", (0.5, 0.25, 0.25), 3)
    key = lambda df: sorted((r["task_id"], r["step_index"], r["split"]) for r in rows(df))
    assert key(parts) == key(again)


def test_zero_seed_is_missing_and_single_group(spark):
    frame = spark.createDataFrame([("x/plain.z8", 7, 0, 0)], "task_id string, seed bigint, step_index int, game_seed bigint")
    row = one(D.make_splits(frame, "seed"))
    assert (row["split_group"], row["split"]) == ("7", "train")


def test_leakage_is_reported(spark):
    import pytest

    frame = spark.createDataFrame([("g", "train"), ("g", "test")], "split_group string, split string")
    with pytest.raises(ValueError, match="leakage"):
        D.assert_no_leakage(frame)


def test_bootstrap_points_and_bounds(spark):
    frame = prefs(spark, *[(f"t{i}.z8", 0, [], ["a", "b", "c"], "abc"[i % 3], "a") for i in range(30)])
    predictions = spark.createDataFrame([(f"t{i}.z8", 0, 0, {"b": 1.0}, None, False, 0) for i in range(0, 30, 2)], PREDS)
    for method in ("multinomial", "poisson"):
        got = {r["metric"]: r for r in rows(B.bootstrap_ranking(frame, predictions, 50, 1, method))}
        assert abs(got["raw_mrr"]["point"] - (1 + 0.5 + 1 / 3) / 3) < 1e-9
        assert all(r["ci_low"] <= r["point"] <= r["ci_high"] for r in got.values())
    none = {r["metric"]: r for r in rows(B.bootstrap_ranking(frame, predictions.limit(0), 10))}
    assert none["learned_mrr"]["point"] is None and none["learned_mrr"]["ci_low"] is None


def test_multinomial_replicates_draw_exactly_n(spark):
    clusters = spark.createDataFrame([(f"c{i}", 1) for i in range(40)], "cluster string, n int")
    sums = rows(B.replicate_sums(clusters, 20, 5, "multinomial"))
    assert len(sums) == 21 and {r["n"] for r in sums} == {40}


def test_split_draws_follow_the_multinomial_law(spark):
    """Totals are exact; means, variances and covariances of bucket counts are those of n draws among n clusters."""
    n, levels, iterations = 1000, 3, 3000
    found = B.bucket_draws(spark, n, levels, iterations, 5).toPandas().pivot(index="replicate", columns="bucket", values="draws")
    assert found.shape == (iterations, 8) and (found.sum(axis=1) == n).all()
    share = 1 / 8
    assert abs(found.mean() - n * share).max() < 5 * (n * share * (1 - share) / iterations) ** 0.5
    spread = found.cov().to_numpy()
    want = -n * share * share
    assert all(abs(spread[a][a] / (n * share * (1 - share)) - 1) < 0.15 for a in range(8))
    others = [spread[a][b] for a in range(8) for b in range(a)]
    assert abs(sum(others) / len(others) / want - 1) < 0.1
    # Unequal children: 3 clusters under the left child, 4 under the right one.
    small = B.bucket_draws(spark, 7, 1, 4000, 1).where("bucket = 0").toPandas()["draws"]
    assert abs(small.mean() - 3) < 0.1 and abs(small.var() - 7 * 3 / 7 * 4 / 7) < 0.15


def test_replicates_are_the_same_law_whatever_the_buckets(spark):
    clusters = spark.createDataFrame([(f"c{i:03d}", 1, float(i)) for i in range(300)], "cluster string, n int, value double")
    for capacity in (7, 300):
        sums = B.multinomial_sums(clusters, 800, 2, capacity).toPandas()
        assert len(sums) == 800 and (sums["n"] == 300).all()
        mean, variance = 299 / 2, (300**2 - 1) / 12
        assert abs(sums["value"].mean() / 300 - mean) < 5 * (variance / 300 / 800) ** 0.5
        assert abs(sums["value"].var() / (300 * variance) - 1) < 0.2
    assert B.replicate_sums(clusters.limit(0), 3, 0, "multinomial").where("replicate >= 0").count() == 0


def test_values_at_any_rank(spark):
    import random

    from trajlens.operators import runs

    draw = random.Random(2)
    for values in ([5], [3, 3, 9], [draw.randrange(-(2**63), 2**63) for _ in range(300)], [draw.randrange(20) for _ in range(500)]):
        counts = spark.createDataFrame([(v, 1) for v in values], "value bigint, n bigint").groupBy("value").sum("n").withColumnRenamed("sum(n)", "n")
        ranks = sorted({0, len(values) // 2, len(values) - 1, draw.randrange(len(values))})
        ordered = sorted(values)
        assert runs.values_at(counts, ranks) == {rank: ordered[rank] for rank in ranks}
    frame = spark.createDataFrame([(v,) for v in [1, 2, 3, 10, None]], "x int")
    assert one(runs.number_summary(frame, "x")) == {"mean": 4.0, "median": 2.5, "p90": 10.0}
    assert one(runs.number_summary(frame.limit(0), "x")) == {"mean": 0.0, "median": 0.0, "p90": 0.0}


def test_multinomial_draws_are_never_rows(spark):
    from hashlib import md5

    data = [(f"c{i}", i % 7, None if i % 3 else i / 4) for i in range(300)]
    clusters = spark.createDataFrame(data, "cluster string, n int, part double")
    sums = B.multinomial_sums(clusters, 20, 5, capacity=64)
    assert "explode(sequence" not in sums._jdf.queryExecution().analyzed().toString()
    order = sorted(data, key=lambda row: (md5(row[0].encode()).hexdigest(), row[0]))
    want = {b: [0, 0.0] for b in range(20)}
    for b, bucket, draws in B.bucket_draws(spark, 300, 3, 20, 5).collect():
        items = order[bucket * 300 >> 3 : (bucket + 1) * 300 >> 3]
        for j in range(draws):
            row = items[int(md5(f"5:{b}:{bucket}:{j}".encode()).hexdigest()[:15], 16) % len(items)]
            want[b][0] += row[1]
            want[b][1] += row[2] or 0.0
    assert {r["replicate"]: [r["n"], round(r["part"], 6)] for r in sums.collect()} == {b: [n, round(p, 6)] for b, (n, p) in want.items()}
    assert B.multinomial_sums(clusters.limit(0), 20, 5).count() == 0
    empty = B.multinomial_sums(clusters.withColumn("part", F.lit(None).cast("double")), 3, 5).collect()
    assert len(empty) == 3 and all(r["part"] is None for r in empty)
