"""Batch rerankers over candidate tables, intervention gates and controllers.

A reranker returns a prediction table: task_id, seed, step_index, ranked_actions, abstain, ord. Formulas whose
original source is not public knowledge here (random, heuristic, verb prior, exact and nearest memory) are
this package's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlens.functions.actions import (
    action_verb,
    is_manipulation,
    is_navigation,
    is_recent_repeat,
    is_static,
    rank_pool,
    structural_distractor_rank,
)
from trajlens.functions.ranks import rank_of
from trajlens.functions.spread import hash_text, salted_lookup
from trajlens.functions.tasks import path_stem
from trajlens.operators.datasets import optional

STEP = ["task_id", "seed", "step_index"]


def _predictions(rows: DataFrame, ranked: Column) -> DataFrame:
    return rows.select(
        *STEP, ranked.alias("ranked_actions"), F.lit(False).alias("abstain"), F.lit(0).cast("bigint").alias("ord")
    )


def _sorted_by(candidates: Column, key) -> Column:
    """Candidates by ascending ``key(action)``, ties in list order."""
    keyed = F.transform(
        candidates, lambda a, i: F.struct(key(a).alias("key"), i.alias("pos"), a.alias("action"))
    )
    return F.transform(F.array_sort(keyed), lambda item: item["action"])


# ---------------------------------------------------------------- baselines

def rerank_random(preferences: DataFrame, seed: int = 0) -> DataFrame:
    """A shuffle that is the same on every run: order by a hash of seed, step key and action."""
    def key(action: Column) -> Column:
        parts = [F.lit(f"{seed}:"), F.col("task_id"), F.lit(":"), F.col("seed"), F.lit(":"), F.col("step_index"), F.lit(":")]
        return hash_text(*parts, action)

    return _predictions(preferences, _sorted_by(F.col("candidates"), key))


def rerank_heuristic(preferences: DataFrame, name: str = "navigation-prior") -> DataFrame:
    """``navigation-prior`` puts moves first, ``anti-static`` puts look, inventory and examine last."""
    keys = {
        "navigation-prior": lambda a: F.when(is_navigation(a), 0).otherwise(1),
        "anti-static": lambda a: F.when(is_static(a), 1).otherwise(0),
    }
    if name not in keys:
        raise ValueError(f"unknown heuristic: {name}")
    return _predictions(preferences, _sorted_by(F.col("candidates"), keys[name]))


def _long(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*STEP, *keep, F.posexplode("candidates").alias("pos", "action"))


def _ranked_by_score(long: DataFrame) -> DataFrame:
    """Fold (step, pos, action, score) back to one ranked list per step; lists are as long as the logged ones."""
    item = F.struct((-F.col("score")).alias("down"), "pos", "action")
    grouped = long.groupBy(*STEP).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return _predictions(grouped, F.transform("items", lambda x: x["action"]))


def verb_prior(train: DataFrame) -> DataFrame:
    """Log odds of a verb being preferred against rejected, with one added to both counts."""
    said = train.select(
        F.explode(
            F.array(
                F.struct(action_verb(F.col("preferred_action")).alias("verb"), F.lit(1).alias("up")),
                F.struct(action_verb(F.col("rejected_action")).alias("verb"), F.lit(0).alias("up")),
            )
        ).alias("r")
    )
    return said.groupBy("r.verb").agg(
        F.log((F.sum("r.up") + 1.0) / (F.count(F.lit(1)) - F.sum("r.up") + 1.0)).alias("prior")
    )


def rerank_verb_prior(train: DataFrame, test: DataFrame) -> DataFrame:
    """Order by the training prior of the verb. Few verbs carry most rows, so the lookup is salted."""
    long = _long(test).withColumn("verb", action_verb(F.col("action")))
    scored = salted_lookup(long, verb_prior(train), ["verb"], [*STEP, "pos"])
    return _ranked_by_score(scored.withColumn("score", F.coalesce("prior", F.lit(0.0))))


def rerank_exact_memory(train: DataFrame, test: DataFrame) -> DataFrame:
    """Votes of training steps with the very same history; without any, the logged order.

    Very short histories are shared by many steps, so their lookup is salted.
    """
    votes = train.select(
        "history",
        F.explode(
            F.array(
                F.struct(F.col("preferred_action").alias("action"), F.lit(1).alias("vote")),
                F.struct(F.col("rejected_action").alias("action"), F.lit(-1).alias("vote")),
            )
        ).alias("r"),
    ).groupBy("history", F.col("r.action").alias("action")).agg(F.sum("r.vote").alias("votes"))
    scored = salted_lookup(
        _long(test, "history"), votes, ["history", "action"], [*STEP, "pos"], hot=F.size("history") <= 2
    )
    return _ranked_by_score(scored.withColumn("score", F.coalesce("votes", F.lit(0)).cast("double")))


# ---------------------------------------------------------------- reranking with compiled preferences

def rerank_preference_bonus(contexts: DataFrame, preferences: DataFrame, bonus: float = 100.0) -> DataFrame:
    """Add or take ``bonus`` for preferred and rejected actions of the same (task or stem, seed, history).

    ``contexts``: step key, history, candidates, scores (array). Contexts without any preference keep their
    order; the others are ordered by score, then action.
    """
    def keys(task: Column) -> Column:
        return F.explode(F.array_distinct(F.array(task, path_stem(task))))

    known = preferences.select(
        keys(F.col("task_id")).alias("_key"), "seed", "history", "preferred_action", "rejected_action"
    ).groupBy("_key", "seed", "history").agg(
        F.collect_set("preferred_action").alias("_good"), F.collect_set("rejected_action").alias("_bad")
    )
    looked = contexts.withColumn("_key", keys(F.col("task_id"))).join(known, ["_key", "seed", "history"], "left")
    flat = looked.groupBy(*STEP).agg(
        F.first("candidates").alias("candidates"),
        F.first("scores").alias("scores"),
        F.flatten(F.collect_list("_good")).alias("_good"),
        F.flatten(F.collect_list("_bad")).alias("_bad"),
    )
    scored = F.transform(
        F.arrays_zip("candidates", "scores"),
        lambda c: F.struct(
            (
                -c["scores"]
                - F.when(F.array_contains("_good", c["candidates"]), bonus).otherwise(0.0)
                + F.when(F.array_contains("_bad", c["candidates"]), bonus).otherwise(0.0)
            ).alias("down"),
            c["candidates"].alias("action"),
        ),
    )
    items = F.when(F.size("_good") + F.size("_bad") > 0, F.array_sort(scored)).otherwise(scored)
    return flat.select(
        *STEP,
        F.transform(items, lambda x: x["action"]).alias("ranked_actions"),
        F.transform(items, lambda x: -x["down"]).alias("ranked_scores"),
        (F.size("_good") + F.size("_bad") > 0).alias("matched"),
    )


# ---------------------------------------------------------------- controllers

PRIOR_WEIGHTS = {
    "invalid": 100.0, "noop": 6.0, "seen_state": 4.0, "recent_repeat": 2.0, "absorbed": 3.0, "inverse": 4.0,
}


def rerank_prior(
    contexts: DataFrame, transitions: DataFrame, weights: dict[str, float] | None = None, pair_penalties: bool = True
) -> DataFrame:
    """Structural penalties per candidate with the reasons, ordered by score, then action.

    ``contexts``: step key, state, previous_state, history, seen_states, admissible, candidates, scores. One
    lookup gives the next state; whether the previous action absorbs or is undone follows from it, since the
    previous action led from ``previous_state`` to ``state``. After an invalid action (``previous_valid`` false)
    neither is known, and neither is penalised; without the column, or where it is null, it was valid.
    """
    w = PRIOR_WEIGHTS | (weights or {})
    # What history and admissible actions say is decided before the lookup, so that neither is shuffled with each candidate.
    long = contexts.select(
        *STEP, "state", "previous_state", F.array_distinct("seen_states").alias("seen_states"), "history", "admissible",
        F.coalesce(optional(contexts, "previous_valid", "boolean"), F.lit(True)).alias("previous_valid"),
        F.posexplode(F.arrays_zip("candidates", "scores")).alias("pos", "c"),
    ).select(
        *STEP, "state", "previous_state", "seen_states", "pos", F.col("c.candidates").alias("action"), F.col("c.scores").alias("base"),
        ((F.size("admissible") > 0) & ~F.array_contains("admissible", F.col("c.candidates"))).alias("barred"),
        is_recent_repeat(F.col("c.candidates"), F.col("history")).alias("repeat"),
        (F.lit(pair_penalties) & (F.size("history") > 0) & F.col("previous_valid")).alias("has_pair"),
    )
    table = transitions.filter("valid")
    if "conflict" in transitions.columns:
        table = table.filter(~F.col("conflict"))
    table = table.select("task_id", "seed", "state", "action", F.col("next_state").alias("_next"))
    rows = long.join(table, ["task_id", "seed", "state", "action"], "left")
    following, state, previous = F.col("_next"), F.col("state"), F.col("previous_state")
    barred, has_pair = F.col("barred"), F.col("has_pair")
    checks = [
        ("noop", "noop", following == state),
        ("seen_state", "seen_state", F.array_contains("seen_states", following)),
        ("recent_repeat", "recent_repeat", F.col("repeat")),
        ("absorbed", "absorbed_after_previous", has_pair & (following == state)),
        ("inverse", "inverse_with_previous", has_pair & (previous != state) & (following == previous)),
    ]
    reasons = F.when(F.coalesce(barred, F.lit(False)), F.array(F.lit("invalid"))).otherwise(
        F.array_compact(F.array(*[F.when(hit, text) for _name, text, hit in checks]))
    )
    penalty = F.when(F.coalesce(barred, F.lit(False)), w["invalid"]).otherwise(
        sum((F.when(F.coalesce(hit, F.lit(False)), w[name]).otherwise(0.0) for name, _text, hit in checks), F.lit(0.0))
    )
    scored = rows.withColumn("score", F.col("base") - penalty).withColumn("reasons", reasons)
    place = F.row_number().over(Window.partitionBy(*STEP).orderBy(F.col("score").desc(), "action"))
    return scored.select(*STEP, "pos", "action", "score", "reasons", place.alias("rank"))


def _with_branches(contexts: DataFrame, branches: DataFrame, max_suffix: int, *keep: str) -> DataFrame:
    long = contexts.select(
        *STEP, "state", *keep, F.posexplode(F.arrays_zip("candidates", "scores")).alias("pos", "c")
    ).select(*STEP, "state", *keep, "pos", F.col("c.candidates").alias("action"), F.col("c.scores").alias("score"))
    known = branches.select(
        "task_id", "seed", "state", "action", F.col("success").alias("_ok"), F.col("suffix_len").alias("_len")
    )
    return long.join(known, ["task_id", "seed", "state", "action"], "left").select(
        *STEP, *keep, "pos", "action", "score",
        F.coalesce("_ok", F.lit(False)).alias("ok"), F.coalesce("_len", F.lit(max_suffix + 1)).alias("suffix_len"),
    )


def rerank_replay_repair(
    contexts: DataFrame, branches: DataFrame, success_bonus: float = 1000.0, suffix_penalty: float = 1.0,
    max_suffix: int = 12,
) -> DataFrame:
    """Promote candidates whose branch succeeds, shorter suffixes first."""
    rows = _with_branches(contexts, branches, max_suffix)
    score = F.col("score") + F.when(F.col("ok"), success_bonus - suffix_penalty * F.col("suffix_len")).otherwise(0.0)
    rows = rows.withColumn("score", score)
    place = F.row_number().over(Window.partitionBy(*STEP).orderBy(F.col("score").desc(), "action"))
    reason = F.when(F.col("ok"), F.concat(F.lit("replay_success_suffix_"), F.col("suffix_len").cast("string")))
    return rows.select(*STEP, "pos", "action", "score", "ok", "suffix_len", reason.alias("reason"), place.alias("rank"))


def select_verified_proposal(
    contexts: DataFrame, branches: DataFrame, max_proposals: int | None = None, require_raw_failure: bool = False,
    min_improvement: int = 1, max_suffix: int = 12,
) -> DataFrame:
    """Verify the first proposals that differ from the raw first choice; fall back to it when none is certified.

    ``contexts``: step key, state, candidates in proposed order, scores, raw_ranks (array, may hold NULLs).
    """
    rows = _with_branches(contexts, branches, max_suffix, "raw_ranks")
    known = F.exists("raw_ranks", lambda rank: rank.isNotNull())
    raw_place = F.when(
        F.coalesce(known, F.lit(False)),
        F.coalesce(F.get("raw_ranks", F.col("pos")), F.size("raw_ranks") + 1 + F.col("pos")),
    ).otherwise(F.col("pos"))
    item = F.struct("pos", "action", "score", "ok", "suffix_len", raw_place.alias("raw_place"))
    grouped = rows.groupBy(*STEP).agg(F.array_sort(F.collect_list(item)).alias("items"))
    raw_sorted = F.array_sort(
        F.transform("items", lambda x: F.struct(x["raw_place"].alias("p"), x["pos"].alias("q"), x.alias("item")))
    )
    grouped = grouped.withColumn("raw", F.transform(raw_sorted, lambda x: x["item"])).withColumn("top", F.get("raw", 0))
    others = F.filter("items", lambda x: x["action"] != F.col("top.action"))
    proposals = others if max_proposals is None else F.slice(others, 1, max(0, max_proposals))

    def certified(x: Column) -> Column:
        better = ~F.col("top.ok") | (x["suffix_len"] + min_improvement <= F.col("top.suffix_len"))
        return x["ok"] & better & ~(F.lit(require_raw_failure) & F.col("top.ok"))

    choice = F.array_min(
        F.transform(
            F.filter(proposals, certified),
            lambda x: F.struct(x["suffix_len"].alias("suffix_len"), (-x["score"]).alias("down"), x["action"].alias("action")),
        )
    )
    grouped = grouped.withColumn("choice", choice)
    selected = F.coalesce("choice.action", "top.action")
    rest = F.filter(F.transform("raw", lambda x: x["action"]), lambda a: a != selected)
    return grouped.select(
        *STEP,
        F.col("top.action").alias("raw_action"),
        F.col("top.ok").alias("raw_success"),
        F.col("top.suffix_len").alias("raw_suffix_len"),
        selected.alias("selected_action"),
        F.col("choice").isNull().alias("fallback"),
        F.when(F.col("choice").isNull(), F.lit("fallback_raw"))
        .otherwise(F.concat(F.lit("verified_proposal_suffix_"), F.col("choice.suffix_len").cast("string")))
        .alias("reason"),
        F.concat(F.array(selected), rest).alias("ranked_actions"),
    )


# ---------------------------------------------------------------- intervention gates

SAFETY_MODES = ("none", "no-repeat", "conservative", "loop-safe")


def _learned(scored: DataFrame) -> DataFrame:
    """Add learned order, both top actions and the margin; ``scores`` maps candidates to learned scores."""
    candidates = F.col("candidates")
    ranked = _sorted_by(
        F.filter(candidates, lambda a: F.map_contains_key("scores", a)), lambda a: -F.try_element_at("scores", a)
    )
    rows = scored.withColumn("ranked", ranked).withColumn("raw_top", F.get("candidates", 0)).withColumn(
        "learned_top", F.get("ranked", 0)
    )
    top_score = F.coalesce(F.try_element_at("scores", "learned_top"), F.lit(0.0))
    raw_score = F.coalesce(F.try_element_at("scores", "raw_top"), F.lit(0.0))
    return rows.withColumn("margin", top_score - raw_score)


def gate_interventions(
    scored: DataFrame, abstain_margin: float = 0.0, safety_mode: str = "none", gate_threshold: float | None = None
) -> DataFrame:
    """Promote the learned first choice or abstain, with the reason.

    ``scored``: step key, history, candidates, scores (map); optional ``gate_probability`` (used when a
    threshold is given) and ``verifier_allows`` / ``verifier_reason``.
    """
    if safety_mode not in SAFETY_MODES:
        raise ValueError(f"unknown reranker safety mode: {safety_mode}")
    rows = _learned(scored)
    raw, learned, history = F.col("raw_top"), F.col("learned_top"), F.col("history")
    changed = learned != raw
    checks = F.lit(None).cast("string")
    if safety_mode in ("conservative", "loop-safe"):
        suspicious = is_recent_repeat(raw, history) | is_static(raw)
        checks = (
            F.when(suspicious & ~is_static(learned), None)
            .when(is_manipulation(raw) & is_navigation(learned), "would_demote_manipulation")
            .otherwise("raw_top_not_suspicious")
        )
        if safety_mode == "loop-safe":
            again = (raw == F.get(history, F.size(history) - 1)) & is_navigation(raw) & is_navigation(learned)
            checks = F.when(again, "protect_immediate_navigation_repeat").otherwise(checks)
    if safety_mode != "none":
        checks = F.when(is_recent_repeat(learned, history), "learned_top_recent_repeat").otherwise(checks)
    reason = F.when(F.col("margin") < abstain_margin, "below_margin").otherwise(checks)
    if gate_threshold is not None:
        gated = F.when(F.col("gate_probability") < gate_threshold, "learned_intervention_gate")
        reason = F.coalesce(reason, gated)
    if "verifier_allows" in scored.columns:
        refused = F.concat(F.lit("llm_verifier:"), F.coalesce("verifier_reason", F.lit("")))
        reason = F.coalesce(reason, F.when(~F.col("verifier_allows"), refused))
    used = (F.size("candidates") > 1) & (F.size("ranked") > 0)
    reason = F.when(used & changed, reason)
    abstained = reason.isNotNull()
    final = F.when(~used | abstained, F.col("candidates")).otherwise(F.col("ranked"))
    return rows.select(
        *STEP,
        used.alias("reranker_used"),
        abstained.alias("reranker_abstained"),
        (used & changed & ~abstained).alias("reranker_intervened"),
        F.when(used, F.col("margin")).alias("reranker_margin"),
        F.coalesce(reason, F.lit("")).alias("reranker_safety_reason"),
        final.alias("ranked_actions"),
        F.transform(final, lambda a: rank_of(F.col("candidates"), a)).alias("raw_ranks"),
    )


def loop_break(scored: DataFrame) -> DataFrame:
    """Act only when the current state was visited before: take the best candidate that leaves the loop.

    ``scored`` also needs trajectory_id and ``state``.
    """
    visits = Window.partitionBy("trajectory_id", "state").orderBy("step_index").rowsBetween(
        Window.unboundedPreceding, 0
    )
    rows = _learned(scored.withColumn("visits", F.count(F.lit(1)).over(visits)))
    fresh = F.filter(
        "ranked", lambda a: (a != F.col("raw_top")) & ~is_recent_repeat(a, F.col("history"))
    )
    rows = rows.withColumn("chosen", F.when(F.col("visits") >= 2, F.get(fresh, 0)))
    used = (F.size("candidates") > 1) & (F.size("ranked") > 0)
    acted = used & F.col("chosen").isNotNull()
    reason = (
        F.when(~used, "").when(F.col("visits") < 2, "state_not_revisited")
        .when(F.col("chosen").isNull(), "no_loop_breaking_candidate").otherwise("loop_break")
    )
    rest = F.filter("ranked", lambda a: a != F.col("chosen"))
    margin = F.coalesce(F.try_element_at("scores", "chosen"), F.lit(0.0)) - F.coalesce(
        F.try_element_at("scores", "raw_top"), F.lit(0.0)
    )
    return rows.select(
        *STEP,
        (used & ~acted).alias("reranker_abstained"),
        acted.alias("reranker_intervened"),
        F.when(acted, margin).otherwise(F.when(used, F.col("margin"))).alias("reranker_margin"),
        reason.alias("reranker_safety_reason"),
        F.when(acted, F.concat(F.array("chosen"), rest)).otherwise(F.col("candidates")).alias("ranked_actions"),
    )


# ---------------------------------------------------------------- noise and proposals

def perturb_candidates(contexts: DataFrame, mode: str = "frontload-structural", limit: int | None = None) -> DataFrame:
    """Move structural distractors to the front, optionally adding admissible ones; scores become n..1."""
    if mode not in ("none", "frontload-existing-structural", "frontload-structural"):
        raise ValueError(f"unknown noise mode: {mode}")
    candidates, history = F.col("candidates"), F.col("history")
    if mode == "none":
        return contexts.select(*STEP, candidates.alias("ranked_actions"), F.col("scores").alias("ranked_scores"))
    if mode == "frontload-structural":
        extra = F.filter(
            F.array_except("admissible", candidates),
            lambda a: a.isin("look", "inventory") | is_recent_repeat(a, history),
        )
        candidates = F.concat(candidates, extra)
    keyed = F.transform(
        candidates, lambda a: F.struct((-structural_distractor_rank(a, history)).alias("down"), a.alias("action"))
    )
    ranked = F.transform(F.array_sort(keyed), lambda x: x["action"])
    ranked = ranked if limit is None else F.slice(ranked, 1, limit)
    rows = contexts.select(*STEP, ranked.alias("ranked_actions"))
    return rows.withColumn(
        "ranked_scores",
        F.transform("ranked_actions", lambda _a, i: (F.size("ranked_actions") - i).cast("double")),
    )


def propose_heuristic(contexts: DataFrame, limit: int = 5) -> DataFrame:
    """The first admissible actions in default pool order, scored limit, limit − 1, …"""
    pool = F.slice(rank_pool(F.col("admissible"), F.col("history"), F.lit("")), 1, limit)
    return contexts.select(
        *STEP, pool.alias("candidates"), F.transform(pool, lambda _a, i: (F.lit(limit) - i).cast("double")).alias("scores")
    )
