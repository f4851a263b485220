"""Registered queries: training rows, trained rerankers, gates, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trajlens.functions import prompts as P
from trajlens.operators import datasets as D
from trajlens.operators import learn as M
from trajlens.operators import ledger as L
from trajlens.operators import ranking as R
from trajlens.operators import rerank as G
from trajlens.plans import oracle_ctes as O
from trajlens.plans.catalog_ranking import observations
from trajlens.plans.shape import cols
from trajlens.session import shared_folder, store
from trajlens.sources import fixtures as X
from trajlens.streaming import stream as S

QUERIES: dict = {}


def train_test(t):
    """Preferences with history, written once because training reads them repeatedly."""
    prefs = store(t.preferences(history=True))
    return prefs.filter("game_seed % 3 <> 0"), prefs.filter("game_seed % 3 = 0")


# ---------------------------------------------------------------- texts and training rows

_CTX = """'Task: ' || task_id || chr(10) || chr(10) || 'Recent executed actions:' || chr(10) || (case when len(history) > 0 then array_to_string(history[-8:], chr(10)) else '<none>' end)
  || chr(10) || chr(10) || 'Logged candidates:' || chr(10) || array_to_string(list_transform(candidates, lambda a, i: concat(i, '. ', a)), chr(10))"""
QUERIES["pointwise_rows"] = (
    lambda t: M.pointwise_rows(t.preferences(history=True)),
    O.with_ledger(f"select {cols(raw=f'task_id; context := {_CTX}; action := candidates[k]', ints='seed; step_index; pos := k - 1', dbls='label := (candidates[k] = preferred)::int')}"
                  " from prefs, range(1, 6) r(k)", "both", None, O.PREFS),
)
_FEATS = {
    "is_raw_top1": "(list_position(candidates, {a}) = 1)::int", "raw_rank_reciprocal": "1.0 / list_position(candidates, {a})",
    "raw_rank_from_bottom": "(6.0 - list_position(candidates, {a})) / 5", "is_rejected_action": "({a} = action)::int",
    "is_navigation": "(split_part({a}, ' ', 1) = 'go')::int",
    "is_manipulation": "(split_part({a}, ' ', 1) in ('take','drop','open','close','unlock','lock','put','insert','eat'))::int",
    "is_static": "(split_part({a}, ' ', 1) in ('look','inventory','examine'))::int",
    "is_recent_repeat": "coalesce(list_contains(history[-4:], {a}), false)::int", "is_last_action": "coalesce(history[-1] = {a}, false)::int",
} | {f"verb_{v}": "(split_part({a}, ' ', 1) = '" + v + "')::int" for v in M.VERBS}
QUERIES["pairwise_rows"] = (
    lambda t: M.pairwise_rows(t.preferences(history=True)).select(
        "task_id", "seed", "step_index", "preferred_action", "other", "weight",
        *[F.col("delta")[i].alias(name) for i, name in enumerate(M.FEATURES)]),
    O.with_ledger("select " + cols(
        raw="task_id; preferred_action := preferred; other := c", ints="seed; step_index",
        dbls="weight := case level when 'C1_oracle_suffix' then 0.7 when 'C0_candidate_only' then 0.4 else 1.0 end;"
        + ";".join(f"{name} := ({text.format(a='preferred')}) - ({text.format(a='c')})" for name, text in _FEATS.items()))
        + " from (select prefs.*, candidates[k] as c from prefs, range(1, 6) r(k)) where c <> preferred", "both", None, O.PREFS),
)
QUERIES["context_text"] = (
    lambda t: D.attach_context(t.preferences(history=True), observations(t)).select(
        "task_id", "seed", "step_index", P.context_text(
            F.col("task_id"), F.col("history"), F.col("candidates"), F.col("initial_observation"), F.col("observation"), 8, 1000).alias("context")),
    O.with_ledger("""select p.task_id, p.seed, cast(p.step_index as bigint) as step_index, 'Task: ' || p.task_id
        || (case when i.observation is not null then chr(10) || chr(10) || 'Objective/state excerpt:' || chr(10) || i.observation else '' end)
        || (case when o.valid then chr(10) || chr(10) || 'Current observation excerpt:' || chr(10) || o.observation else '' end)
        || substr(""" + _CTX.replace("task_id", "p.task_id") + """, length('Task: ' || p.task_id) + 1) as context from prefs p
        left join (select * from obs where step_index = 0) i on i.task_id = p.task_id and i.seed = p.seed
        left join obs o on o.task_id = p.task_id and o.seed = p.seed and o.step_index = p.step_index""", "both", None, O.PREFS,
        "obs as (select task_id, seed, step_index, concat('state ', pre_state, ' of ', game_seed) as observation, event_id % 17 <> 0 as valid from steps where event_id % 23 <> 0)"),
)
QUERIES["model_requests"] = (
    lambda t: t.history.withColumn("obs", F.expr("concat('state ', pre_state)")).select(
        "trajectory_id", "step_index",
        P.candidate_request(F.col("task_id"), F.col("step_index"), F.lit(""), F.col("obs"), F.col("history"), F.col("candidates"), 5).alias("proposal"),
        P.verification_request(F.col("task_id"), F.col("step_index"), F.lit("goal"), F.col("obs"), F.col("history"), F.col("candidates"),
                               F.get("candidates", 0), F.get("candidates", 1)).alias("verification")),
    O.with_history(""", q as (select *, concat('state ', pre_state) as ob, chr(10) as n, case when len(history) > 0 then array_to_string(history[-12:], chr(10)) else '<empty>' end as hs,
        array_to_string(list_transform(candidates, lambda a: '- ' || a), chr(10)) as cs from hist)
      select trajectory_id, cast(step_index as bigint) as step_index,
        'Task: ' || task_id || n || 'Step: ' || step_index || n || 'Initial observation and objective:' || n || ob || n || n || 'Recent action history:' || n || hs || n || n
          || 'Observation:' || n || ob || n || n || 'Admissible actions:' || n || cs || n || n || 'Return up to 5 candidate actions as JSON.' as proposal,
        'Task: ' || task_id || n || 'Step: ' || step_index || n || 'Initial observation and objective:' || n || 'goal' || n || n || 'Recent action history:' || n || hs || n || n
          || 'Current observation:' || n || ob || n || n || 'Logged candidate list:' || n || cs || n || n || 'RAW action: ' || candidates[1] || n || 'PROPOSED action: ' || candidates[2]
          || n || n || 'Choose whether to keep RAW or execute PROPOSED.' as verification from q"""),
)

# ---------------------------------------------------------------- trained models (rows-only check)

# A fixed linear model makes the scorer itself checkable.
_WEIGHTS = {"raw_rank_reciprocal": 0.5, "is_manipulation": 1.0, "is_recent_repeat": -0.75, "is_static": -0.5, "verb_go": 0.25}
_SCORE = " + ".join(f"({w}) * ({_FEATS[n].format(a='candidates[k]')})" for n, w in _WEIGHTS.items())
QUERIES["score_predictions"] = (
    lambda t: M.score_predictions(t.preferences(history=True), _WEIGHTS, 0.3).drop("scores"),
    O.with_ledger(f""", z as (select task_id, seed, step_index, k, candidates[k] as c, round({_SCORE}, 9) as s from prefs, range(1, 6) r(k)),
      y as (select task_id, seed, step_index, list(c order by s desc, k) as ra, max(s) - max(s) filter (where k = 1) as mg, arg_min(k, -s * 100 + k * 0.001) as b from z group by all)
      select """ + cols(raw="task_id; abstain := b > 1 and mg < 0.3", ints="seed; step_index; ord := 0", dbls="margin_over_raw_top1 := mg", arrs="ranked_actions := ra") + " from y", "both", None, O.PREFS),
)


def evaluated(test, predictions):
    return R.ranking_summary(R.evaluate_ranking(test, predictions))


def feature_reranker(t, **options):
    train, test = train_test(t)
    return evaluated(test, M.score_predictions(test, M.train_feature_reranker(train, **options)))


QUERIES["feature_reranker_pairwise"] = (lambda t: feature_reranker(t), None)
QUERIES["feature_reranker_rejected_only"] = (lambda t: feature_reranker(t, negative_scope="rejected", certificate_weight=False), None)
QUERIES["feature_reranker_listwise"] = (lambda t: feature_reranker(t, loss="listwise"), None)
QUERIES["feature_reranker_rank_only"] = (lambda t: feature_reranker(t, feature_set="rank-only"), None)


def _classifier(kind):
    def build(t):
        train, test = train_test(t)
        return evaluated(test, M.rerank_classifier(train, test, kind))
    return build


QUERIES["tree_reranker"] = (_classifier("tree"), None)
QUERIES["mlp_reranker"] = (_classifier("mlp"), None)


def _embedding(t):
    train, test = train_test(t)
    return evaluated(test, M.rerank_embedding(train, test))


QUERIES["embedding_reranker"] = (_embedding, None)


def _policy(t):
    train, test = train_test(t)
    fit, held_out = train.filter("game_seed % 3 = 1"), train.filter("game_seed % 3 = 2")
    return evaluated(test, M.score_predictions(test, M.train_support_policy(fit, held_out)))


QUERIES["support_policy"] = (_policy, None)
_TOKENS = """list_sort(list_distinct(list_transform(range(1, len(history) + 2), lambda i: (case when i <= 2 then '^' else history[i - 2] end) || '>'
     || (case when i = 1 then '^' else history[i - 1] end) || '>' || (case when i = len(history) + 1 then '$' else history[i] end))))"""
_TT = f"""tn as (select {_TOKENS} as tok, preferred as pref, action as rej from prefs where game_seed % 3 <> 0),
 ex as (select tok, a, sum(v) as votes, count(*) as n from (select tok, pref as a, 1 as v from tn union all select tok, rej, -1 from tn) group by all),
 te as (select p.task_id, p.seed, p.step_index, {_TOKENS} as tok, i - 1 as pos, candidates[i] as cand from prefs p, range(1, 6) r(i) where game_seed % 3 = 0),
 tq as (select distinct tok, cand from te),
 pr as (select tq.tok, tq.cand, len(list_intersect(tq.tok, ex.tok))::double / (len(tq.tok) + len(ex.tok) - len(list_intersect(tq.tok, ex.tok))) as sim, votes, n
   from tq join ex on ex.a = tq.cand and len(ex.tok) * 2 >= len(tq.tok) and len(tq.tok) * 2 >= len(ex.tok)),
 ps as (select tok, cand, sim, sum(votes) as votes, sum(n) as n from pr where sim >= 0.5 - 1e-9 group by all),
 pk as (select *, coalesce(sum(n) over (partition by tok, cand order by sim desc rows between unbounded preceding and 1 preceding), 0) as b from ps),
 sc as (select tok, cand, sum(votes) / sum(n) as s from pk where b < 5 group by all),
 ov as (select a, sum(votes) / sum(n) as o from ex group by a),
 tv_ as (select te.task_id, te.seed, te.step_index, te.pos, te.cand, coalesce(sc.s, ov.o, 0) as s from te left join sc on sc.tok = te.tok and sc.cand = te.cand
   left join ov on ov.a = te.cand)"""
QUERIES["rerank_nn_memory"] = (
    lambda t: M.rerank_nn_memory(*train_test(t), 5),
    O.with_ledger("select " + cols(raw="task_id; abstain := false", ints="seed; step_index; ord := 0", arrs="ranked_actions := list(cand order by coalesce(s, 0) desc, pos)")
                  + " from tv_ group by task_id, seed, step_index", "both", None, O.PREFS, _TT),
)


def _gate(t):
    train, test = train_test(t)
    weights = M.train_feature_reranker(train)
    gate = M.train_intervention_gate(train, M.score_predictions(train, weights))
    return gate, M.score_predictions(test, weights), test


def gate_probabilities(t):
    gate, predictions, test = _gate(t)
    return M.gate_probabilities(gate, test, predictions)


QUERIES["intervention_gate"] = (gate_probabilities, None)


def gate_inputs(t):
    """Gate probabilities from the log itself, so that threshold selection can be checked exactly."""
    rows = t.steps.filter("gold_action is not null").select(
        F.expr("candidates[0]").alias("raw_top"), F.col("action").alias("proposed"), F.col("gold_action").alias("preferred_action"),
        F.expr("cast(event_id % 101 as double) / 100").alias("gate_probability"), "success")
    return rows.filter("not success"), rows.filter("success").withColumn("preferred_action", F.col("raw_top"))


_GRID = M.threshold_grid(0.3, 0.6, 0.05)
_TH = f""", g as (select unnest({_GRID}) as threshold), r as (select candidates[1] as raw, action as prop, case when success then candidates[1] else gold_action end as pref,
     (event_id % 101) / 100 as p, success from steps where gold_action is not null),
 th as (select threshold, avg((case when raw <> prop and p >= threshold then prop = pref else raw = pref end)::int) filter (where not success) as c,
     avg((raw <> prop and p >= threshold)::int) filter (where success) as i, avg((raw <> prop and p >= threshold and raw = pref)::int) filter (where success) as d from g, r group by threshold)"""
_TH_COLS = cols(dbls="threshold; valid_overall_top1_correction := c; retention_intervention_rate := i; retention_demotion_rate := d")
QUERIES["threshold_table"] = (lambda t: M.threshold_table(*gate_inputs(t), _GRID), O.with_steps(_TH + f" select {_TH_COLS} from th"))
for _mode, _order in (("coverage", "c desc, i desc, d, threshold"), ("safety", "c desc, d, i desc, threshold")):
    QUERIES[f"select_threshold_{_mode}"] = (
        lambda t, m=_mode: M.select_threshold(M.threshold_table(*gate_inputs(t), _GRID), m),
        O.with_steps(_TH + f" select {_TH_COLS} from th order by {_order} limit 1"),
    )
QUERIES["split_robustness"] = (
    lambda t: M.split_robustness(store(t.preferences()), lambda train, _valid, test: G.rerank_verb_prior(train, test)), None,
)

# ---------------------------------------------------------------- streams

_STREAM_STATUS = """case when gold is null then 'no_repair_found' when gold = act then 'repair_same_as_executed' when list_position(c, gold) > 0 then 'certified_preference'
   else 'repair_not_in_candidates' end"""


def event_stream(t):
    """Every event as one logged step, read as a stream of files."""
    schema = t.table("events").schema
    rows = t.spark.readStream.schema(schema).parquet(f"{t.folder}/event[s].parquet")
    v = X._vocabulary()
    return rows.select(
        F.col("ts").cast("timestamp").alias("ts"), F.lit(True).alias("success"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("task_id"), F.col("user_id").alias("seed"),
        F.col("event_id").cast("int").alias("step_index"),
        F.expr(f"transform(sequence(0, 4), j -> element_at({v}, cast((event_id * 7 + j * 3) % 20 as int) + 1))").alias("candidates"),
        F.expr(f"element_at({v}, cast((event_id * 7 + if(event_id % 5 = 0, 3, 0)) % 20 as int) + 1)").alias("action"),
        F.expr(f"if(event_id % 11 = 0, null, element_at({v}, cast((event_id * 7 + 3 * ((event_id * 13 + user_id) % 8)) % 20 as int) + 1))").alias("gold_action"),
    )


QUERIES["stream_ledger_counts"] = (
    lambda t: S.run_complete(S.stream_ledger_counts(L.step_ledger(event_stream(t), None, "gold"))).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "status", "steps"),
    f"""with e as (select ts, list_transform(range(0, 5), lambda j: ({O.V})[cast((event_id * 7 + j * 3) % 20 as int) + 1]) as c,
          ({O.V})[cast((event_id * 7 + (case when event_id % 5 = 0 then 3 else 0 end)) % 20 as int) + 1] as act,
          case when event_id % 11 = 0 then null else ({O.V})[cast((event_id * 7 + 3 * ((event_id * 13 + user_id) % 8)) % 20 as int) + 1] end as gold from events)
        select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, {_STREAM_STATUS} as status, cast(count(*) as bigint) as steps from e group by 1, 2""",
)


def trajectory_stream(t):
    """The log written as JSON lines, some failed and some once more with another outcome, read back as a stream."""
    rows = t.trajectories.select(
        "trajectory_id", "task_id", "seed", "rollout_seed", "game_seed", "success", F.size("steps").alias("num_steps"),
        F.expr("if(ord % 11 = 0, 'boom', null)").alias("error"), "ord",
    )
    folder = f"{shared_folder(t.spark)}/feeds/{uuid.uuid4().hex}"
    rows.write.json(f"{folder}/0-first")
    rows.filter("ord % 3 = 0").withColumn("success", ~F.col("success")).write.json(f"{folder}/1-again")
    schema = "trajectory_id string, task_id string, seed bigint, rollout_seed bigint, game_seed bigint, success boolean, num_steps int, error string"
    return S.stream_trajectories(t.spark, folder, schema)


QUERIES["stream_trajectories"] = (
    lambda t: S.run_first_records(trajectory_stream(t)).select("trajectory_id", "task_id", "seed", "success", "num_steps"),
    O.with_steps(", t as (select trajectory_id, task_id, seed, success, count(*) as n, min(event_id) as ord from steps group by all) select " + cols(
        raw="trajectory_id; task_id; success", ints="seed; num_steps := n") + " from t where ord % 11 <> 0"),
)
