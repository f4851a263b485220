from conftest import one, rows
from pyspark.ml.feature import Tokenizer
from pyspark.sql import functions as F

from trajlens.operators import learn as M
from trajlens.operators import ranking as R
from trajlens.operators import rerank as G
from trajlens.operators import runs as H

PREFS = "task_id string, seed bigint, step_index int, history array<string>, candidates array<string>, preferred_action string, rejected_action string, certificate_level string, game_seed bigint"


def prefs(spark, *items):
    return spark.createDataFrame([(t, 0, 0, h, c, p, r, "C3_failure_repair", 0) for t, h, c, p, r in items], PREFS)


ONE = ("game.z8", [], ["look", "open door"], "open door", "look")


def test_random_is_stable_and_complete(spark):
    frame = prefs(spark, ONE)
    a, b = one(G.rerank_random(frame, 7)), one(G.rerank_random(frame, 7))
    assert a == b and sorted(a["ranked_actions"]) == ["look", "open door"]


def test_heuristics_and_memories(spark):
    frame = prefs(spark, ("g", [], ["open door", "go west", "look"], "go west", "open door"))
    assert one(G.rerank_heuristic(frame))["ranked_actions"] == ["go west", "open door", "look"]
    assert one(G.rerank_heuristic(prefs(spark, ONE), "anti-static"))["ranked_actions"][0] == "open door"
    train = prefs(spark, ("t", ["go east", "take key"], ["open chest", "go west"], "go west", "open chest"))
    test = prefs(spark, ("u", ["go east", "take key"], ["open chest", "go south"], "go south", "open chest"))
    assert one(G.rerank_verb_prior(train, test))["ranked_actions"][0] == "go south"
    same = prefs(spark, ("u", ["go east", "take key"], ["open chest", "go west"], "go west", "open chest"))
    assert one(G.rerank_exact_memory(train, same))["ranked_actions"][0] == "go west"
    other = prefs(spark, ("u", ["go north"], ["open chest", "go west"], "go west", "open chest"))
    assert one(G.rerank_exact_memory(train, other))["ranked_actions"][0] == "open chest"
    assert one(M.rerank_nn_memory(train, same, 1))["ranked_actions"][0] == "go west"


def test_feature_reranker(spark):
    frame = prefs(spark, ONE)
    delta = dict(zip(M.FEATURES, one(M.pairwise_rows(frame))["delta"]))
    assert (delta["is_rejected_action"], delta["verb_open"], delta["verb_look"], delta["raw_rank_reciprocal"]) == (-1.0, 1.0, -1.0, -0.5)
    for loss in ("pairwise", "listwise"):
        weights = M.train_feature_reranker(frame, loss, epochs=5)
        found = M.score_predictions(frame, weights)
        assert one(found)["ranked_actions"][0] == "open door"
    summary = one(R.ranking_summary(R.evaluate_ranking(frame, found)))
    assert (summary["raw_mrr"], summary["learned_mrr"], summary["learned_top1_correction_rate"]) == (0.5, 1.0, 1.0)
    masked = M.train_feature_reranker(frame, feature_set="rank-only")
    assert masked["verb_open"] == 0.0
    held = M.score_predictions(frame, weights, abstain_margin=999.0)
    assert one(held)["abstain"] is True
    assert one(R.ranking_summary(R.evaluate_ranking(frame, held)))["learned_mrr"] is None


def test_support_policy_gradient_direction(spark):
    frame = prefs(spark, ONE, ("h", [], ["look", "go west", "open box"], "open box", "look"))
    found = M.score_predictions(frame, M.train_support_policy(frame, frame, epochs=10))
    assert {r["task_id"]: r["ranked_actions"][0] for r in rows(found)} == {"game.z8": "open door", "h": "open box"}


def test_text_rows(spark):
    record = prefs(spark, ("game.z8", ["go east", "open door"], ["look", "go west"], "go west", "look"))
    got = rows(M.pointwise_rows(record).orderBy("pos"))
    assert [r["label"] for r in got] == [0.0, 1.0]
    assert "Recent executed actions" in got[0]["context"] and "1. look" in got[0]["context"]
    seen = record.withColumn("initial_observation", F.lit("water the fern in the hall")).withColumn("observation", F.lit("A dry fern stands beside the stairs"))
    text = rows(M.pointwise_rows(seen, max_observation_chars=120))[0]["context"]
    assert "Objective/state excerpt" in text and "Current observation excerpt" in text
    assert "fern" not in rows(M.pointwise_rows(seen))[0]["context"]


SCORED = "task_id string, seed bigint, step_index int, history array<string>, candidates array<string>, scores map<string,double>, gate_probability double, trajectory_id string, state int"


def gate(spark, history, candidates, scores, probability=1.0, **options):
    frame = spark.createDataFrame([("g", 0, 0, history, candidates, scores, probability, "t", 0)], SCORED)
    return one(G.gate_interventions(frame, **options))


def test_gates(spark):
    good = {"look": 0.0, "open door": 10.0}
    row = gate(spark, [], ["look", "open door"], good)
    assert row["ranked_actions"] == ["open door", "look"] and row["reranker_intervened"] and row["raw_ranks"] == [2, 1]
    row = gate(spark, [], ["look", "open door"], {"look": 0.0, "open door": 1.0}, abstain_margin=5.0)
    assert row["ranked_actions"] == ["look", "open door"] and row["reranker_safety_reason"] == "below_margin"
    assert gate(spark, [], ["look", "open door"], good, 0.1, gate_threshold=0.5)["reranker_safety_reason"] == "learned_intervention_gate"
    assert gate(spark, [], ["look", "open door"], good, 0.9, gate_threshold=0.5)["reranker_abstained"] is False
    row = gate(spark, [], ["open door", "go west"], {"go west": 5.0, "open door": 0.0}, safety_mode="conservative")
    assert row["reranker_safety_reason"] == "would_demote_manipulation"
    row = gate(spark, ["go south"], ["go south", "go west"], {"go west": 5.0, "go south": 0.0}, safety_mode="loop-safe")
    assert row["reranker_safety_reason"] == "protect_immediate_navigation_repeat"
    row = gate(spark, ["go west"], ["look", "go west"], {"go west": 5.0, "look": 0.0}, safety_mode="no-repeat")
    assert row["reranker_safety_reason"] == "learned_top_recent_repeat"
    assert gate(spark, [], ["look"], {"look": 1.0})["reranker_used"] is False


def test_loop_break(spark):
    data = [("g", 0, i, ["a"] * i, ["look", "a", "open door"], {"look": 0.0, "a": 9.0, "open door": 1.0}, 1.0, "t", s) for i, s in enumerate([1, 1, 2])]
    got = {r["step_index"]: r for r in rows(G.loop_break(spark.createDataFrame(data, SCORED)))}
    assert got[0]["reranker_safety_reason"] == "state_not_revisited" and got[2]["reranker_abstained"]
    assert got[1]["ranked_actions"] == ["open door", "a", "look"] and got[1]["reranker_margin"] == 1.0


CONTEXT = "task_id string, seed bigint, step_index int, state int, previous_state int, history array<string>, seen_states array<int>, admissible array<string>, candidates array<string>, scores array<double>, raw_ranks array<int>"
TRANS = "task_id string, seed bigint, state int, action string, next_state int, valid boolean"


def test_prior_controller(spark):
    context = spark.createDataFrame([("g", 0, 3, 1, 0, ["go north"], [0, 1], ["a", "b", "go south", "n"], ["a", "b", "go south", "x", "n"], [5.0, 4.0, 3.0, 2.0, 1.0], None)], CONTEXT)
    table = spark.createDataFrame([("g", 0, 1, "a", 1, True), ("g", 0, 1, "b", 7, True), ("g", 0, 1, "go south", 0, True)], TRANS)
    got = {r["action"]: r for r in rows(G.rerank_prior(context, table))}
    assert got["a"]["reasons"] == ["noop", "seen_state", "absorbed_after_previous"] and got["a"]["score"] == 5 - 6 - 4 - 3
    assert got["go south"]["reasons"] == ["seen_state", "inverse_with_previous"]
    after_invalid = {r["action"]: r["reasons"] for r in rows(G.rerank_prior(context.withColumn("previous_valid", F.lit(False)), table))}
    assert after_invalid["a"] == ["noop", "seen_state"] and after_invalid["go south"] == ["seen_state"]
    assert got["x"]["reasons"] == ["invalid"] and got["x"]["score"] == -98.0 and got["b"]["rank"] == 1 and got["n"]["reasons"] == []


def test_prior_shuffles_no_history_with_candidates(spark):
    context = spark.createDataFrame([("g", 0, 0, 1, None, [], [1], [], ["p"], [9.0], [4])], CONTEXT)
    table = spark.createDataFrame([("g", 0, 1, "p", 2, True)], "task_id string, seed bigint, state int, action string, next_state int, valid boolean")
    plan = G.rerank_prior(context, table)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(n for n, line in enumerate(plan) if "Join" in line)
    # What the join reads is projected first; neither list is in it.
    carried = next(line for line in plan[join + 1 :] if "Project" in line)
    assert "seen_states" in carried and not [line for line in plan[: join + 1] if "history" in line or "admissible" in line]


def test_verified_proposals_and_replay(spark):
    context = spark.createDataFrame([("g", 0, 0, 1, None, [], [1], [], ["p", "q", "r", "w"], [9.0, 8.0, 7.0, 6.0], [4, 1, 2, 3])], CONTEXT)
    branches = spark.createDataFrame([("g", 0, 1, "p", True, 4), ("g", 0, 1, "q", True, 6), ("g", 0, 1, "r", True, 2), ("g", 0, 1, "w", False, 13)],
                                     "task_id string, seed bigint, state int, action string, success boolean, suffix_len int")
    row = one(G.select_verified_proposal(context, branches, 2))
    assert (row["raw_action"], row["selected_action"], row["reason"]) == ("q", "r", "verified_proposal_suffix_2")
    assert row["ranked_actions"] == ["r", "q", "w", "p"]
    assert one(G.select_verified_proposal(context, branches, 1))["selected_action"] == "p"
    assert one(G.select_verified_proposal(context, branches, 2, min_improvement=5))["fallback"] is True
    assert one(G.select_verified_proposal(context, branches, 2, require_raw_failure=True))["reason"] == "fallback_raw"
    assert [r["action"] for r in rows(G.rerank_replay_repair(context, branches).orderBy("rank"))] == ["p", "r", "q", "w"]


def test_preference_bonus_by_stem(spark):
    context = spark.createDataFrame([("x/game.z8", 0, 0, ["a"], ["look", "open door"], [2.0, 1.0]), ("x/game.z8", 0, 1, ["b"], ["look", "open door"], [2.0, 1.0])],
                                    "task_id string, seed bigint, step_index int, history array<string>, candidates array<string>, scores array<double>")
    known = prefs(spark, ("game", ["a"], [], "open door", "look"))
    got = {r["step_index"]: r for r in rows(G.rerank_preference_bonus(context, known))}
    assert got[0]["ranked_actions"] == ["open door", "look"] and got[0]["ranked_scores"] == [101.0, -98.0]
    assert got[1]["ranked_actions"] == ["look", "open door"] and got[1]["matched"] is False


def test_threshold_grid_and_selection(spark):
    assert M.threshold_grid(0.5, 0.53, 0.01) == [0.5, 0.51, 0.52, 0.53]
    table = spark.createDataFrame([(0.5, 0.25, 0.10, 0.001), (0.6, 0.25, 0.30, 0.02)],
                                  "threshold double, valid_overall_top1_correction double, retention_intervention_rate double, retention_demotion_rate double")
    assert one(M.select_threshold(table, "coverage"))["threshold"] == 0.6 and one(M.select_threshold(table, "safety"))["threshold"] == 0.5


EPISODE = "task_id string, success boolean, steps double, repeated_action_rate double, reranker_intervention_rate double, ord bigint"


def test_paired_runs(spark):
    base = spark.createDataFrame([("a", False, 3.0, 0.1, 0.0, 1), ("a", True, 3.0, 0.1, 0.0, 0), ("b", True, 2.0, 0.0, 0.0, 2), ("c", True, 1.0, 0.0, 0.0, 3), ("z", True, 1.0, 0.0, 0.0, 4)], EPISODE)
    treat = spark.createDataFrame([("a", True, 3.0, 0.1, 1.0, 1), ("b", False, 2.0, 0.0, 1.0, 2), ("c", True, 1.0, 0.0, 0.0, 3)], EPISODE)
    row = one(H.paired_comparison(H.paired_rows(base, treat), 50))
    assert (row["episodes"], row["rescued_failures"], row["harmed_successes"], row["success_delta"]) == (3, 1, 1, 0.0)
    assert abs(row["treatment_intervention_rate"] - 2 / 3) < 1e-12 and row["paired_sign_p_value"] == 1.0


def test_sign_test_matches_exact(spark):
    from math import comb

    data = [(0, 0), (1, 0), (5, 2), (40, 12), (300, 260), (0, 9), (4000, 3900)]
    got = [r[0] for r in spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(data)], "i int, a bigint, b bigint").orderBy("i").select(H.sign_test_p(F.col("a"), F.col("b"))).collect()]
    for (a, b), p in zip(data, got):
        if a + b == 0:
            assert p is None
        else:
            want = min(1.0, 2 * sum(comb(a + b, k) for k in range(min(a, b) + 1)) / 2 ** (a + b))
            assert abs(p - want) < 1e-8 * max(1.0, want)


def test_similar_sets_against_all_pairs(spark, monkeypatch):
    import random

    draw = random.Random(6)
    words = [f"w{n}" for n in range(14)]

    def some(count):
        # A word that nearly all sets hold, and groups of near copies.
        out = []
        for n in range(count):
            size = draw.choice([1, 2, 3, 5, 8, 11])
            tokens = set(draw.sample(words, size)) | ({"hot"} if draw.random() < 0.9 else set())
            out.append((f"s{n}", draw.choice("xy"), sorted(tokens)))
        return out

    left, right = some(90), some(160)
    queries = spark.createDataFrame(left, "query_id string, action string, tokens array<string>")
    sets = spark.createDataFrame(right, "set_id string, action string, tokens array<string>")
    for radius in (0.2, 0.5, 0.6, 0.8, 1.0):
        monkeypatch.setattr(M, "LIST_SETS", draw.choice([3, 5000]))
        want = set()
        for q, x, a in left:
            for s, y, b in right:
                both = len(set(a) & set(b))
                if x == y and both / (len(a) + len(b) - both) >= radius - 1e-9:
                    want.add((q, s, round(both / (len(a) + len(b) - both), 9)))
        got = [(r["query_id"], r["set_id"], round(r["similarity"], 9)) for r in rows(M.similar_sets(queries, sets, ["action"], radius))]
        assert len(got) == len(set(got)) and set(got) == want


def test_similar_sets_go_through_the_join_once_whatever_their_keys(spark, monkeypatch):
    # Nine keys fit one row, so the set is one row per token of its beginning.
    kept = []
    monkeypatch.setattr(M, "store", lambda df: kept.append(df) or df)
    tokens = [f"t{n}" for n in range(8)]
    table = spark.createDataFrame([("s", f"k{n}", tokens) for n in range(9)] + [("s", None, tokens)], "id string, action string, tokens array<string>")
    queries, sets = table.withColumnRenamed("id", "query_id"), table.withColumnRenamed("id", "set_id")
    found = M.similar_sets(queries, sets, ["action"], 0.5)
    assert sorted(r["action"] for r in rows(found)) == [f"k{n}" for n in range(9)]
    assert [df.count() for df in kept if "at" in df.columns] == [5]
    monkeypatch.setattr(M, "ROW_KEYS", 2)
    assert sorted(map(tuple, rows(M.similar_sets(queries, sets, ["action"], 0.5)))) == sorted(map(tuple, rows(found)))


def test_similar_sets_in_long_lists_meet_by_two_tokens(spark, monkeypatch):
    import random

    draw = random.Random(9)
    words = [f"w{n}" for n in range(9)]
    table = [(f"s{n}", draw.choice("xy"), sorted(draw.sample(words, draw.choice([1, 1, 2, 3, 4, 6, 9])))) for n in range(150)]
    queries = spark.createDataFrame(table[:70], "query_id string, action string, tokens array<string>")
    sets = spark.createDataFrame(table[70:], "set_id string, action string, tokens array<string>")
    want = {(q, s) for q, x, a in table[:70] for s, y, b in table[70:] if x == y and len({*a} & {*b}) / len({*a} | {*b}) >= 0.5}
    monkeypatch.setattr(M, "LIST_SETS", 1)
    for longest, dealt in ((128, 200_000), (4, 20)):
        monkeypatch.setattr(M, "PAIRED_TOKENS", longest)
        monkeypatch.setattr(M, "DEALT_SETS", dealt)
        found = M.similar_sets(queries, sets, ["action"], 0.5)
        got = [(r["query_id"], r["set_id"]) for r in rows(found)]
        assert len(got) == len(set(got)) and set(got) == want
        # No token lists go through the join that finds the pairs.
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join Inner" in line and "bit_count" in line]
        assert joins and all("tokens" not in line for line in joins)


def test_nearest_memory_uses_whole_histories_and_ties(spark):
    long = ["go east"] + [f"step {n}" for n in range(30)]
    train = prefs(spark, ("t", long, ["a", "b"], "a", "b"), ("t2", ["zzz"], ["a", "b"], "b", "a"), ("t3", ["zzz"], ["a", "b"], "b", "a"))
    near = one(M.rerank_nn_memory(train, prefs(spark, ("u", long[:-1] + ["step x"], ["b", "a"], "a", "b")), 1))
    far = one(M.rerank_nn_memory(train, prefs(spark, ("u", ["other"], ["a", "b"], "a", "b")), 1))
    assert near["ranked_actions"] == ["a", "b"] and far["ranked_actions"] == ["b", "a"]
    assert one(M.rerank_nn_memory(train.limit(0), prefs(spark, ("u", ["x"], ["a", "b"], "a", "b"))))["ranked_actions"] == ["a", "b"]


def test_pairwise_training_ends_at_the_minimum(spark):
    import random

    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    draw = random.Random(4)
    data = [(draw.choice([1.0, 0.4]), [draw.gauss(0.3 * k, 1.0) for k in range(4)]) for _ in range(300)]
    frame = spark.createDataFrame(data, "weight double, delta array<double>")
    at, worst = M.newton_pairwise(frame, 4, 1e-3)
    x, w = np.array([d for _, d in data]), np.array([v for v, _ in data])
    gradient = -(w / (1 + np.exp(x @ at))) @ x / w.sum() + 1e-3 * at
    assert worst <= 1e-9 and np.abs(gradient).max() < 1e-8
    both = frame.select("weight", "delta", F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("s")).select(
        "weight", F.when(F.col("s") > 0, 1.0).otherwise(0.0).alias("label"), array_to_vector(F.transform("delta", lambda v: v * F.col("s"))).alias("features"))
    other = LogisticRegression(regParam=1e-3, fitIntercept=False, standardization=False, weightCol="weight", maxIter=200, tol=1e-12).fit(both)
    assert np.allclose(other.coefficients.toArray(), at, atol=1e-4)
    nothing, none = M.newton_pairwise(frame.limit(0), 4, 1e-3)
    assert none == 0.0 and not nothing.any()


def test_tree_training_holds_equal_rows_once(spark, monkeypatch):
    many = [(f"g{n}", ["look"], ["look", "open door", "go west"], "open door", "look") for n in range(30)]
    frame = prefs(spark, *many, ("h", [], ["take key", "look", "go west"], "take key", "look"))
    seen = []
    monkeypatch.setattr(M, "_fit", lambda estimator, data, fit=M._fit: seen.append(data.collect()) or fit(estimator, data))
    ranked = {r["task_id"]: r["ranked_actions"] for r in rows(M.rerank_classifier(frame, frame, "tree"))}
    # One row for each candidate of the two kinds of steps, with the number of its copies; the last candidate is the same in both.
    assert sorted(row["weight"] for row in seen[0]) == [1.0, 1.0, 30.0, 30.0, 31.0]
    assert ranked["g7"][0] == "open door" and ranked["h"][0] == "take key"


def test_policy_rows_hold_equal_steps_once(spark):
    kinds = [(["look"], ["look", "open door", "go west"], "open door", "look"), ([], ["take key", "look"], "take key", "look")]
    few = prefs(spark, *[(f"g{n}", *kind) for n, kind in enumerate(kinds)])
    many = prefs(spark, *[(f"g{n}", *kinds[n % 2]) for n in range(40)])
    assert sorted(r["steps"] for r in rows(M._policy_rows(many, M.FEATURES))) == [20, 20]
    one_each, copies = M.train_support_policy(few, few, epochs=3), M.train_support_policy(many, many, epochs=3)
    assert all(abs(one_each[name] - copies[name]) < 1e-12 for name in M.FEATURES) and any(one_each.values())
    uneven = [kinds[0]] * 3 + [kinds[1]]
    skewed = M.train_support_policy(prefs(spark, *[(f"g{n}", *kind) for n, kind in enumerate(uneven)]), epochs=3)
    assert any(abs(one_each[name] - skewed[name]) > 1e-3 for name in M.FEATURES)


def test_joint_words_are_those_of_the_whole_text(spark):
    frame = prefs(
        spark, ("g A", ["Go  west", "look "], ["Open door", "take\tkey ", "", " x", "Élan\n\n"], "look", "look"), ("h", [], ["look"], "look", "look"),
    ).withColumn("context", M.context_text(F.col("task_id"), F.col("history"), F.col("candidates")))
    found = frame.select("task_id", F.posexplode(M.joint_words(F.col("context"), F.col("candidates"))).alias("pos", "words"))
    texts = frame.select("task_id", "context", F.posexplode("candidates").alias("pos", "action"))
    whole = Tokenizer(inputCol="text", outputCol="words").transform(texts.withColumn("text", M.joint_text(F.col("context"), F.col("action"))))
    assert {(r["task_id"], r["pos"]): r["words"] for r in rows(found)} == {(r["task_id"], r["pos"]): r["words"] for r in rows(whole)}


def test_embedding_training_keeps_no_texts(spark, monkeypatch):
    frame = prefs(spark, *[(f"g{n}", ["look"], ["look", "open door"], "open door", "look") for n in range(20)])
    kept = []
    monkeypatch.setattr(M, "_fit", lambda estimator, data, fit=M._fit: kept.append(data.columns) or fit(estimator, data))
    assert {tuple(r["ranked_actions"]) for r in rows(M.rerank_embedding(frame, frame))} == {("open door", "look")}
    assert not any("text" in columns or "words" in columns for columns in kept)
