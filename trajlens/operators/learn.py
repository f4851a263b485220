"""Trained rerankers and gates: candidate features, MLlib models, and a linear policy over logged candidates.

The published source of these models is not available, only what they are called with and what comes out, so
features and formulas are this package's own and no numeric equality is claimed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlens.functions.actions import (
    MANIPULATION_VERBS,
    NAVIGATION_VERBS,
    STATIC_VERBS,
    action_verb,
    is_manipulation,
    is_navigation,
    is_recent_repeat,
    is_static,
)
from trajlens.functions.prompts import context_text, joint_text
from trajlens.functions.ranks import rank_of
from trajlens.functions.spread import salted_lookup
from trajlens.operators.datasets import make_splits
from trajlens.operators.ranking import evaluate_ranking, ranking_summary
from trajlens.session import store

STEP = ["task_id", "seed", "step_index"]

# The verbs with a feature of their own.
VERBS = (
    "go", "open", "close", "take", "drop", "put", "insert", "unlock", "lock", "eat", "look", "inventory",
    "examine", "read",
)
RANK_FEATURES = ("is_raw_top1", "raw_rank_reciprocal", "raw_rank_from_bottom")
TYPE_FEATURES = ("is_navigation", "is_manipulation", "is_static")
HISTORY_FEATURES = ("is_recent_repeat", "is_last_action")
OTHER_FEATURES = ("is_rejected_action",)
VERB_FEATURES = tuple(f"verb_{verb}" for verb in VERBS)
FEATURES = RANK_FEATURES + OTHER_FEATURES + TYPE_FEATURES + HISTORY_FEATURES + VERB_FEATURES
FEATURE_SETS = {
    "all": FEATURES,
    "rank-only": RANK_FEATURES,
    "action-only": TYPE_FEATURES + VERB_FEATURES,
    "no-rank": tuple(f for f in FEATURES if f not in RANK_FEATURES),
    "no-action-type": tuple(f for f in FEATURES if f not in TYPE_FEATURES + VERB_FEATURES),
    "no-history": tuple(f for f in FEATURES if f not in HISTORY_FEATURES),
}
CERTIFICATE_WEIGHTS = {"C3_shorter_success": 1.0, "C3_failure_repair": 1.0, "C1_oracle_suffix": 0.7, "C0_candidate_only": 0.4}


def candidate_features(
    action: Column, candidates: Column, history: Column, rejected: Column, verb: Column | None = None
) -> dict[str, Column]:
    """Features of one candidate as column expressions; they work on a column and inside an array lambda.

    Pass ``verb`` inside a lambda, where repeated parts of an expression are not shared.
    """
    rank = rank_of(candidates, action).cast("double")
    verb = action_verb(action) if verb is None else verb

    def flag(condition: Column) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), 1.0).otherwise(0.0)

    return {
        "is_raw_top1": flag(rank == 1),
        "raw_rank_reciprocal": F.coalesce(1.0 / rank, F.lit(0.0)),
        "raw_rank_from_bottom": F.coalesce((F.size(candidates) - rank + 1) / F.size(candidates), F.lit(0.0)),
        "is_rejected_action": flag(action == rejected),
        "is_navigation": flag(verb.isin(*NAVIGATION_VERBS)),
        "is_manipulation": flag(verb.isin(*MANIPULATION_VERBS)),
        "is_static": flag(verb.isin(*STATIC_VERBS)),
        "is_recent_repeat": flag(is_recent_repeat(action, history)),
        "is_last_action": flag(F.get(history, F.size(history) - 1) == action),
        **{f"verb_{name}": flag(verb == name) for name in VERBS},
    }


def _vector(action: Column, names: tuple[str, ...] = FEATURES, verb: Column | None = None) -> Column:
    features = candidate_features(action, F.col("candidates"), F.col("history"), F.col("rejected_action"), verb)
    return F.array(*[features[name] for name in names])


def _with_verbs(candidates: Column) -> Column:
    return F.transform(candidates, lambda a: F.struct(a.alias("action"), action_verb(a).alias("verb")))


def pairwise_rows(
    preferences: DataFrame, negative_scope: str = "all", names: tuple[str, ...] = FEATURES
) -> DataFrame:
    """Preferred against each other candidate (or only the rejected one): feature differences."""
    if negative_scope not in ("all", "rejected"):
        raise ValueError(f"unknown negative scope: {negative_scope}")
    others = F.array_distinct(F.array_remove("candidates", F.col("preferred_action")))
    if negative_scope == "rejected":
        others = F.array_intersect(others, F.array("rejected_action"))
    rows = preferences.withColumn("other", F.explode(others))
    delta = F.zip_with(
        _vector(F.col("preferred_action"), names), _vector(F.col("other"), names), lambda a, b: a - b
    )
    weights = F.create_map(*[F.lit(x) for pair in CERTIFICATE_WEIGHTS.items() for x in pair])
    weight = F.coalesce(F.try_element_at(weights, F.col("certificate_level")), F.lit(0.5))
    return rows.select(*STEP, "preferred_action", "other", delta.alias("delta"), weight.alias("weight"))


def pointwise_rows(preferences: DataFrame, max_history: int = 8, max_observation_chars: int = 0) -> DataFrame:
    """One (context text, candidate, label) row per candidate."""
    def text(name: str) -> Column | None:
        return F.col(name) if name in preferences.columns else None

    context = context_text(
        F.col("task_id"), F.col("history"), F.col("candidates"), text("initial_observation"), text("observation"),
        max_history, max_observation_chars,
    )
    return preferences.select(
        *STEP, context.alias("context"), "preferred_action", F.posexplode("candidates").alias("pos", "action")
    ).select(
        *STEP, "pos", "context", "action", F.when(F.col("action") == F.col("preferred_action"), 1.0).otherwise(0.0).alias("label")
    )


# ---------------------------------------------------------------- linear models over features

def score_predictions(preferences: DataFrame, weights: dict[str, float], abstain_margin: float = 0.0) -> DataFrame:
    """Score every candidate with a linear model inside its row: no join, no shuffle.

    Abstains when the best candidate leads the raw first one by less than the margin.
    """
    names = tuple(name for name in FEATURES if weights.get(name))

    def score(action: Column, verb: Column) -> Column:
        features = candidate_features(action, F.col("candidates"), F.col("history"), F.col("rejected_action"), verb)
        return sum((F.lit(float(weights[name])) * features[name] for name in names), F.lit(0.0))

    keyed = F.transform(
        _with_verbs(F.col("candidates")),
        lambda s, i: F.struct((-score(s["action"], s["verb"])).alias("down"), i.alias("pos"), s["action"].alias("action")),
    )
    rows = preferences.withColumn("_items", F.array_sort(keyed))
    raw = F.filter("_items", lambda x: x["pos"] == 0)
    margin = F.get(raw, 0)["down"] - F.get("_items", 0)["down"]
    distinct = F.array_distinct(F.transform("_items", lambda x: x["action"]))
    return rows.select(
        *STEP,
        F.transform("_items", lambda x: x["action"]).alias("ranked_actions"),
        F.map_from_arrays(
            distinct,
            F.transform(distinct, lambda a: F.round(-F.get(F.filter("_items", lambda x: x["action"] == a), 0)["down"], 9)),
        ).alias("scores"),
        margin.alias("margin_over_raw_top1"),
        ((F.get("_items", 0)["pos"] > 0) & (margin < abstain_margin)).alias("abstain"),
        F.lit(0).cast("bigint").alias("ord"),
    )


def _fit(estimator, rows: DataFrame):
    """Fit with the rows kept across the solver's passes; blocks that do not fit in memory go to disk."""
    kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return estimator.fit(kept)
    finally:
        kept.unpersist()


def _logistic(l2: float, intercept: bool, **options) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="features", labelCol="label", regParam=l2, fitIntercept=intercept, standardization=False,
        maxIter=25, aggregationDepth=3, **options,
    )


def train_feature_reranker(
    train: DataFrame, loss: str = "pairwise", feature_set: str = "all", negative_scope: str = "all",
    certificate_weight: bool = True, l2: float = 1e-3, epochs: int = 20, learning_rate: float = 0.5,
) -> dict[str, float]:
    """Linear weights per feature; features outside the set get exactly zero.

    Pairwise: logistic loss of feature differences without intercept, at its minimum (:func:`newton_pairwise`). Listwise:
    cross entropy of the preferred candidate among the logged ones.
    """
    names = FEATURE_SETS[feature_set]
    if loss == "listwise":
        return train_support_policy(
            train, epochs=epochs, learning_rate=learning_rate, feature_set=feature_set, reward_weight=0.0,
            kl_weight=0.0, pair_weight=0.0, list_weight=1.0, l2=l2,
        )
    if loss != "pairwise":
        raise ValueError(f"unknown loss: {loss}")
    rows = pairwise_rows(train, negative_scope, names)
    weight = F.col("weight") if certificate_weight else F.lit(1.0)
    solved, _ = newton_pairwise(rows.select(weight.alias("weight"), "delta"), len(names), l2)
    learned = dict(zip(names, solved.tolist()))
    return {name: learned.get(name, 0.0) for name in FEATURES}


def _pairwise_sums(at: np.ndarray):
    """Partial sums of weight, loss, gradient and curvature of the pairwise log loss, one row per task."""
    def run(batches):
        size = len(at)
        weight, loss, gradient, curvature = 0.0, 0.0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            if batch.empty:
                continue
            x, w = np.stack(batch["delta"].to_numpy()), batch["weight"].to_numpy()
            gap = x @ at
            wrong = 1.0 / (1.0 + np.exp(np.clip(gap, -700, 700)))
            weight += w.sum()
            loss += float(w @ np.logaddexp(0.0, -gap))
            gradient -= (w * wrong) @ x
            curvature += (x * (w * wrong * (1.0 - wrong))[:, None]).T @ x
        yield pd.DataFrame({"w": [weight], "loss": [loss], "g": [gradient.tolist()], "h": [curvature.ravel().tolist()]})

    return run


def newton_pairwise(rows: DataFrame, size: int, l2: float, tolerance: float = 1e-9, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Weights of least regularised pairwise loss, and the largest component of the gradient there.

    ``rows``: weight, delta (feature differences). The loss is strictly convex for a positive ``l2``, so it has one minimum and a
    small gradient proves that the weights are near it. A round is one pass that adds up a gradient and a matrix of
    ``size`` by ``size``; Newton's step is halved while it does not lower the loss. Rounds end by the gradient, not by a count;
    a loss that does not get there raises.
    """
    kept = store(rows)

    def sums(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        partial = kept.mapInPandas(_pairwise_sums(at), "w double, loss double, g array<double>, h array<double>")
        total = partial.agg(
            F.sum("w").alias("w"), F.sum("loss").alias("loss"),
            F.array(*[F.sum(F.get("g", i)) for i in range(size)]).alias("g"),
            F.array(*[F.sum(F.get("h", i)) for i in range(size * size)]).alias("h"),
        ).first()
        w = total["w"] or 1.0
        gradient = np.array([value or 0.0 for value in total["g"]]) / w + l2 * at
        curvature = np.array([value or 0.0 for value in total["h"]]).reshape(size, size) / w + l2 * np.eye(size)
        return (total["loss"] or 0.0) / w + l2 / 2 * float(at @ at), gradient, curvature

    at = np.zeros(size)
    loss, gradient, curvature = sums(at)
    for _ in range(rounds):
        worst = float(np.abs(gradient).max(initial=0.0))
        if worst <= tolerance:
            return at, worst
        step = np.linalg.solve(curvature, gradient)
        for _ in range(30):
            new_loss, new_gradient, new_curvature = sums(at - step)
            if new_loss <= loss + 1e-12:
                break
            step = step / 2
        at, loss, gradient, curvature = at - step, new_loss, new_gradient, new_curvature
    raise ValueError(f"gradient of {worst} after {rounds} rounds")


# ---------------------------------------------------------------- policy over the logged candidates

def _policy_gradient(names_count: int, weights: np.ndarray, mix: dict[str, float]) -> Callable:
    """Partial sums of gradient, objective and top-1 hits, one row per task."""
    def run(batches):
        gradient, value, hits, count = np.zeros(names_count), 0.0, 0.0, 0.0
        for batch in batches:
            if batch.empty:
                continue
            sizes = batch["k"].to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            x = np.concatenate(batch["x"].to_numpy()).reshape(-1, names_count)
            reward = np.concatenate(batch["reward"].to_numpy())
            prior = np.concatenate(batch["prior"].to_numpy())
            preferred = starts + batch["preferred"].to_numpy()
            rejected, steps = batch["rejected"].to_numpy(), batch["steps"].to_numpy().astype(float)
            s = x @ weights
            s = s - np.maximum.reduceat(s, starts)[owner]
            e = np.exp(s)
            p = e / np.add.reduceat(e, starts)[owner]
            mean_reward = np.add.reduceat(p * reward, starts)
            log_ratio = np.log(np.maximum(p, 1e-300)) - np.log(prior)
            kl = np.add.reduceat(p * log_ratio, starts)
            pull = mix["reward"] * p * (reward - mean_reward[owner]) - mix["kl"] * p * (log_ratio - kl[owner])
            pull -= mix["list"] * p
            pull[preferred] += mix["list"]
            gradient += (pull * steps[owner]) @ x
            value += float(steps @ (mix["reward"] * mean_reward - mix["kl"] * kl + mix["list"] * np.log(p[preferred])))
            paired = rejected >= 0
            if mix["pair"] and paired.any():
                good, bad = preferred[paired], starts[paired] + rejected[paired]
                gap = s[good] - s[bad]
                weight = (batch["weight"].to_numpy() * steps)[paired]
                strength = weight / (1.0 + np.exp(gap))
                gradient += mix["pair"] * (strength @ (x[good] - x[bad]))
                value -= float(mix["pair"] * np.sum(weight * np.log1p(np.exp(-gap))))
            best = np.maximum.reduceat(s, starts)
            hits += float(steps @ (s[preferred] >= best))
            count += float(steps.sum())
        yield pd.DataFrame({"g": [gradient.tolist()], "value": [value], "hits": [hits], "n": [count]})

    return run


def _policy_rows(preferences: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Flat feature block, rewards, rank prior, places of preferred and rejected: one row for all steps that are equal in these."""
    c = F.col("candidates")
    rewards = F.transform(
        c,
        (lambda a: F.coalesce(F.try_element_at("candidate_rewards", a), F.lit(0.0)))
        if "candidate_rewards" in preferences.columns
        else (lambda a: F.when(a == F.col("preferred_action"), 1.0).otherwise(0.0)),
    )
    total = F.aggregate(F.sequence(F.lit(1), F.size(c)), F.lit(0.0), lambda acc, i: acc + 1.0 / i)
    weights = F.create_map(*[F.lit(x) for pair in CERTIFICATE_WEIGHTS.items() for x in pair])
    rows = preferences.filter(F.array_contains("candidates", F.col("preferred_action"))).select(
        F.size(c).alias("k"),
        F.flatten(F.transform(_with_verbs(c), lambda s: _vector(s["action"], names, s["verb"]))).alias("x"),
        rewards.alias("reward"),
        F.transform(c, lambda _a, i: 1.0 / ((i + 1) * total)).alias("prior"),
        (F.array_position(c, F.col("preferred_action")) - 1).cast("int").alias("preferred"),
        F.coalesce(F.array_position(c, F.col("rejected_action")) - 1, F.lit(-1)).cast("int").alias("rejected"),
        F.coalesce(F.try_element_at(weights, F.col("certificate_level")), F.lit(0.5)).alias("weight"),
    )
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("steps"))


def train_support_policy(
    train: DataFrame, valid: DataFrame | None = None, epochs: int = 20, learning_rate: float = 0.5,
    feature_set: str = "all", reward_weight: float = 1.0, kl_weight: float = 0.05, pair_weight: float = 0.5,
    list_weight: float = 0.0, l2: float = 1e-3,
) -> dict[str, float]:
    """Softmax policy restricted to the logged candidates, linear in the features.

    Objective per step: expected reward, minus divergence from the rank prior, plus the weighted log odds of
    preferred over rejected (and, for listwise training, the log likelihood of the preferred one). Feature
    blocks are written once, equal ones as one row with their number; an epoch is one distributed pass that returns one small row per task, reduced on
    the executors before the driver updates the weights. The epoch with the best validation top-1 wins.
    """
    names = FEATURE_SETS[feature_set]
    rows = store(_policy_rows(train, names))
    held_out = store(_policy_rows(valid, names)) if valid is not None else None
    mix = {"reward": reward_weight, "kl": kl_weight, "pair": pair_weight, "list": list_weight}
    weights = np.zeros(len(names))
    best, best_score = weights, -1.0

    def sweep(df: DataFrame, at: np.ndarray):
        partial = df.mapInPandas(_policy_gradient(len(names), at, mix), "g array<double>, value double, hits double, n double")
        return partial.agg(
            *[F.sum(F.get("g", i)).alias(f"g{i}") for i in range(len(names))],
            F.sum("value").alias("value"), F.sum("hits").alias("hits"), F.sum("n").alias("n"),
        ).first()

    for _ in range(epochs):
        step = sweep(rows, weights)
        if not step["n"]:
            break
        gradient = np.array([step[f"g{i}"] for i in range(len(names))]) / step["n"]
        weights = weights + learning_rate * (gradient - l2 * weights)
        if held_out is not None:
            check = sweep(held_out, weights)
            score = check["hits"] / check["n"] if check["n"] else 0.0
            if score > best_score:
                best, best_score = weights, score
    chosen = weights if held_out is None or best_score < 0 else best
    learned = dict(zip(names, chosen.tolist()))
    return {name: learned.get(name, 0.0) for name in FEATURES}


# ---------------------------------------------------------------- MLlib classifiers over candidates

def _candidate_rows(preferences: DataFrame) -> DataFrame:
    rows = preferences.select(
        *STEP, "candidates", "history", "rejected_action", "preferred_action", F.posexplode("candidates").alias("pos", "action")
    )
    return rows.select(
        *STEP, "pos", "action", F.when(F.col("action") == F.col("preferred_action"), 1.0).otherwise(0.0).alias("label"),
        array_to_vector(_vector(F.col("action"))).alias("features"),
    )


def _weighted(rows: DataFrame) -> DataFrame:
    """Rows for training: equal features with equal label as one row, whose weight is their number."""
    return rows.withColumn("x", vector_to_array("features")).groupBy("x", "label").agg(F.count(F.lit(1)).cast("double").alias("weight")).select(
        "label", "weight", array_to_vector("x").alias("features")
    )


def _model_predictions(scored: DataFrame) -> DataFrame:
    item = F.struct((-F.col("score")).alias("down"), "pos", "action")
    return scored.groupBy(*STEP).agg(F.array_sort(F.collect_list(item)).alias("items")).select(
        *STEP, F.transform("items", lambda x: x["action"]).alias("ranked_actions"), F.lit(False).alias("abstain"),
        F.lit(0).cast("bigint").alias("ord"),
    )


def rerank_classifier(train: DataFrame, test: DataFrame, kind: str = "tree", seed: int = 0) -> DataFrame:
    """Pointwise tree or multilayer classifier on the candidate features."""
    if kind == "tree":
        estimator = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=10, maxDepth=4, seed=seed)
    elif kind == "mlp":
        estimator = MultilayerPerceptronClassifier(
            featuresCol="features", labelCol="label", layers=[len(FEATURES), 16, 2], maxIter=40, seed=seed
        )
    else:
        raise ValueError(f"unknown classifier: {kind}")
    rows = _candidate_rows(train).select("features", "label")
    model = _fit(estimator, _weighted(rows) if kind == "tree" else rows)
    scored = model.transform(_candidate_rows(test)).withColumn("score", vector_to_array("probability")[1])
    return _model_predictions(scored)


def joint_words(context: Column, actions: Column) -> Column:
    """Lower-case words of each action's :func:`joint_text`, as ``Tokenizer`` gives them; the context is split once for all."""
    def words(text: Column) -> Column:
        # Empty words at the end of a text do not count.
        text = F.regexp_replace(F.lower(text), r"\s+$", "")
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, r"\s"))

    # Bound as a variable, so that the context is not split again for each action.
    shared = F.array(words(joint_text(context, F.lit(""))))
    return F.flatten(F.transform(shared, lambda first: F.transform(actions, lambda action: F.concat(first, words(action)))))


def rerank_embedding(train: DataFrame, test: DataFrame, size: int = 1 << 12) -> DataFrame:
    """Classifier on a hashed bag of words of the joint state and action text."""
    hashing = HashingTF(inputCol="words", outputCol="features", numFeatures=size)

    def rows(df: DataFrame) -> DataFrame:
        context = context_text(F.col("task_id"), F.col("history"), F.col("candidates"))
        items = F.arrays_zip(F.col("candidates").alias("action"), joint_words(context, F.col("candidates")).alias("words"))
        return hashing.transform(df.select(
            *STEP, "preferred_action", F.posexplode(items).alias("pos", "item")
        ).select(
            *STEP, "pos", "item.action", "item.words",
            F.when(F.col("item.action") == F.col("preferred_action"), 1.0).otherwise(0.0).alias("label"),
        )).drop("words")

    # Only features and labels are kept for the solver's passes, no texts.
    estimator = LogisticRegression(featuresCol="features", labelCol="label", regParam=1e-3, maxIter=20, aggregationDepth=3)
    model = _fit(estimator, rows(train).select("features", "label"))
    scored = model.transform(rows(test)).withColumn("score", vector_to_array("probability")[1])
    return _model_predictions(scored)


def history_tokens(history: Column) -> Column:
    """Sorted distinct runs of three neighbouring actions, with the start and the end of the history marked.

    Runs are numbers of 64 bits, which are quick to compare.
    """
    ahead = F.concat(history, F.array(F.lit("$")))

    def earlier(i: Column, back: int) -> Column:
        return F.when(i < back, F.lit("^")).otherwise(F.get(history, i - back))

    return F.array_sort(F.array_distinct(F.transform(ahead, lambda action, i: F.xxhash64(earlier(i, 2), earlier(i, 1), action))))


#: Sets with one prefix token that are scanned together; a token with more of them is dealt out by a second token.
LIST_SETS = 1_000
#: Longer lists than this, where no second token tells their sets apart, are dealt out by a hash.
DEALT_SETS = 200_000
#: Sets of more tokens are found by one token only, as pairs of tokens grow with the square.
PAIRED_TOKENS = 128
#: Values of the ``on`` columns that one row of a set carries.
ROW_KEYS = 64


def _mask(tokens: Column, half: int) -> Column:
    """Half of 128 bits, one of which each token sets."""
    def bit(token: Column) -> Column:
        number = F.pmod(F.xxhash64(token), F.lit(128)).cast("int")
        return F.when(F.floor(number / 64) == half, F.call_function("shiftleft", F.lit(1).cast("bigint"), number % 64)).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(tokens, F.lit(0).cast("bigint"), lambda bits, token: bits.bitwiseOR(bit(token)))


def similar_sets(queries: DataFrame, sets: DataFrame, on: list[str], radius: float) -> DataFrame:
    """All pairs (``query_id, set_id``, similarity) of the same ``on`` columns with a Jaccard similarity of ``radius`` or more.

    Both tables hold an id, the ``on`` columns and ``tokens``; rows of one id have the same tokens. Two sets that alike share one
    of the first size - ceil(radius * size) + 1 tokens of each, in an order that puts rare tokens first; only these are joined,
    sizes that cannot reach the radius are passed over. A set goes through the join once per token of its beginning, whatever the
    number of its ``on`` values, and without its tokens: bit masks of them sort out nearly all pairs that are not alike. Pairs
    left over are then compared once each, by their tokens.

    Sets that must share two tokens share them in a beginning one token longer. So a token with more than ``LIST_SETS`` sets is
    joined together with the second shared token, and lists stay short where the tokens are few and the sets many. Sets that may
    share a single token, or are too long for pairs, still meet at the one token; the few lists of very many sets are dealt out by
    a hash, and their queries copied as often.
    """
    def folded(df: DataFrame, key: str) -> DataFrame:
        rows = df.na.drop(subset=on).groupBy(key)
        return store(rows.agg(F.any_value("tokens").alias("tokens"), F.collect_set(F.struct(*on)).alias("keys")))

    def exploded(df: DataFrame) -> DataFrame:
        return df.select(*df.columns, F.explode("tokens").alias("token"))

    queries, sets = folded(queries, "query_id"), folded(sets, "set_id")
    both = exploded(queries.select("tokens")).select("token").unionByName(exploded(sets.select("tokens")).select("token"))
    held = store(both.groupBy("token").agg(F.count(F.lit(1)).alias("held")))

    def least(size: Column) -> Column:
        """Tokens that a set of this size shares at least with one alike."""
        return F.ceil(size * F.lit(radius) - 1e-9).cast("int")

    def beginnings(df: DataFrame, key: str) -> DataFrame:
        # A set's tokens come back together, rare ones first; they are bounded by the history they come from.
        ordered = salted_lookup(exploded(df.select(key, "tokens")), held, ["token"], [key], how="inner").groupBy(key).agg(
            F.array_sort(F.collect_list(F.struct("held", "token"))).alias("ordered")
        )
        first = ordered.select(key, F.transform("ordered", lambda x: x["token"]).alias("tokens"))
        size = F.size("tokens")
        masks = [_mask(F.col("tokens"), half).alias(name) for half, name in enumerate(("low", "high"))]
        return first.select("*", *masks).select("*", F.posexplode(F.slice("tokens", F.lit(1), size - least(size) + 1)).alias("at", "token"))

    def keyed(df: DataFrame, key: str) -> DataFrame:
        """A row per key: the token alone, or with each second token behind it. ``at`` is the place of a key's last token."""
        n, long = F.col("n"), F.col("long")
        alone = ~long | (n * F.lit(radius) <= 1 + 1e-9) | (n >= F.lit(radius * PAIRED_TOKENS) - 1e-9)
        upto = n - F.greatest(least(n), F.lit(2)) + 2
        behind = F.slice("tokens", F.col("at") + 2, F.greatest(upto - F.col("at") - 1, F.lit(0)))
        none = F.slice("tokens", 1, 0)
        # A null stands for no second token.
        chosen = F.concat(F.when(alone, F.array(F.get("tokens", F.lit(-1)))).otherwise(none), F.when(long & (n <= PAIRED_TOKENS), behind).otherwise(none))
        rows = df.withColumn("n", F.size("tokens")).withColumn("_alone", alone.cast("int")).select(
            "*", F.posexplode(chosen).alias("_place", "_second")
        )
        paired = F.col("_second").isNotNull()
        # Other tokens of the same hash only bring pairs that are then found to be unlike.
        return rows.select(
            key, "n", "low", "high", "long", "parts", F.xxhash64("token", "_second").alias("key"), paired.alias("paired"),
            F.when(paired, F.col("at") + 1 + F.col("_place") - F.col("_alone")).otherwise(F.col("at")).alias("at"),
        )

    left, right = beginnings(queries, "query_id"), store(beginnings(sets, "set_id"))
    parts = right.groupBy("token").agg(F.count(F.lit(1)).alias("n")).select(
        "token", (F.col("n") > LIST_SETS).alias("long"), F.ceil(F.col("n") / DEALT_SETS).cast("int").alias("parts")
    )
    left, right = keyed(left.join(parts, "token"), "query_id"), keyed(right.join(parts, "token"), "set_id")
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    right = right.withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int")).drop("parts", "long", "paired")
    right = right.withColumnsRenamed({"n": "m", "at": "other_at", "low": "other_low", "high": "other_high"})
    n, m, paired = F.col("n"), F.col("m"), F.col("paired")
    share = F.lit(radius / (1 + radius))
    need = share * (n + m) - 1e-9

    def missing(here: str, there: str) -> Column:
        return sum(F.bit_count(F.col(here + half).bitwiseAND(F.bitwise_not(F.col(there + half)))) for half in ("low", "high"))

    pairs = left.join(right, ["key", "part"]).filter(F.least(n, m) >= F.lit(radius) * F.greatest(n, m) - 1e-9)
    # In a long list the one token is for those pairs that need not share two, or are too long.
    pairs = pairs.filter(~F.col("long") | (paired != ((share * (n + m) <= 1 + 1e-9) | (F.greatest(n, m) > PAIRED_TOKENS))))
    # A pair is found at its first shared tokens, so this is what their places, then the masks, leave possible.
    pairs = pairs.filter(F.least(n - F.col("at"), m - F.col("other_at")) + paired.cast("int") >= need)
    pairs = pairs.filter((n - missing("", "other_") >= need) & (m - missing("other_", "") >= need))
    pairs = pairs.select("query_id", "set_id").distinct()

    def whole(df: DataFrame) -> DataFrame:
        starts = F.sequence(F.lit(1), F.size("keys"), F.lit(ROW_KEYS))
        return df.withColumn("keys", F.explode(F.transform(starts, lambda at: F.slice("keys", at, F.lit(ROW_KEYS)))))

    pairs = pairs.join(whole(queries), "query_id").join(
        whole(sets).withColumnsRenamed({"tokens": "other_tokens", "keys": "other_keys"}), "set_id"
    ).filter(F.arrays_overlap("keys", "other_keys"))
    shared = F.size(F.array_intersect("tokens", "other_tokens"))
    similarity = shared / (F.size("tokens") + F.size("other_tokens") - shared)
    pairs = pairs.withColumn("similarity", similarity).filter(F.col("similarity") >= F.lit(radius) - 1e-9)
    pairs = pairs.select("query_id", "set_id", F.explode(F.array_intersect("keys", "other_keys")).alias("k"), "similarity")
    return pairs.select("query_id", "set_id", "k.*", "similarity")


def rerank_nn_memory(train: DataFrame, test: DataFrame, neighbors: int = 5, radius: float = 0.5) -> DataFrame:
    """Votes of the training exemplars with the nearest histories.

    Preferred actions are positive and rejected ones negative exemplars. Nearness is the Jaccard similarity of the
    histories' :func:`history_tokens`, over whole histories. For a candidate, the exemplars of that action as near as the
    ``neighbors``-th nearest decide by their mean vote, ties included; none is farther than ``radius``. Without any, all
    exemplars of the action decide; an action never seen has 0.

    Equal histories are one set with summed votes. See :func:`similar_sets` for the join; nothing is paired beyond it.
    """
    def keyed(df: DataFrame, *columns) -> DataFrame:
        rows = df.withColumn("tokens", history_tokens(F.col("history")))
        return rows.select(*columns, "tokens", F.unhex(F.md5(F.array_join(F.col("tokens").cast("array<string>"), "|"))).alias("id"))

    votes = F.array(
        F.struct(F.col("preferred_action").alias("action"), F.lit(1).alias("vote")),
        F.struct(F.col("rejected_action").alias("action"), F.lit(-1).alias("vote")),
    )
    exemplars = keyed(train, F.explode(votes).alias("r")).groupBy("id", "r.action").agg(
        F.any_value("tokens").alias("tokens"), F.sum("r.vote").alias("votes"), F.count(F.lit(1)).alias("exemplars")
    )
    exemplars = store(exemplars.withColumnRenamed("id", "set_id"))
    # Tokens are written once per step, not once per candidate.
    asked = store(keyed(test, *STEP, "candidates").withColumnRenamed("id", "query_id"))
    long = asked.select(*STEP, "query_id", F.posexplode("candidates").alias("pos", "action"))
    queries = asked.select("query_id", "tokens", F.explode("candidates").alias("action"))
    pairs = similar_sets(queries, exemplars.select("set_id", "action", "tokens"), ["action"], radius)
    # By value of the similarity, of which there are few, before anything is ranked.
    near = pairs.join(exemplars.drop("tokens"), ["set_id", "action"]).groupBy("query_id", "action", "similarity").agg(
        F.sum("votes").alias("votes"), F.sum("exemplars").alias("exemplars")
    )
    down = Window.partitionBy("query_id", "action").orderBy(F.col("similarity").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_before", F.coalesce(F.sum("exemplars").over(down), F.lit(0))).filter(F.col("_before") < neighbors)
    near = near.groupBy("query_id", "action").agg((F.sum("votes") / F.sum("exemplars")).alias("score"))
    overall = exemplars.groupBy("action").agg((F.sum("votes") / F.sum("exemplars")).alias("overall"))
    scored = long.join(near, ["query_id", "action"], "left")
    scored = salted_lookup(scored, overall, ["action"], [*STEP, "pos"])
    return _model_predictions(scored.select(*STEP, "pos", "action", F.coalesce("score", "overall", F.lit(0.0)).alias("score")))


# ---------------------------------------------------------------- intervention gate

GATE_FEATURES = ("margin", "raw_rank_reciprocal", "raw_static", "raw_repeat", "learned_navigation", "learned_manipulation", "learned_repeat")


def gate_rows(preferences: DataFrame, predictions: DataFrame) -> DataFrame:
    """Steps on which the prediction proposes another first action; label 1 when the proposal is right."""
    rows = preferences.join(predictions.select(*STEP, "ranked_actions", "margin_over_raw_top1"), STEP)
    rows = rows.withColumn("raw_top", F.get("candidates", 0)).withColumn("proposed", F.get("ranked_actions", 0))
    rows = rows.filter(F.col("raw_top") != F.col("proposed"))

    def flag(condition: Column) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), 1.0).otherwise(0.0)

    raw, proposed, history = F.col("raw_top"), F.col("proposed"), F.col("history")
    values = (
        F.coalesce("margin_over_raw_top1", F.lit(0.0)),
        F.coalesce(1.0 / rank_of(F.col("candidates"), proposed), F.lit(0.0)),
        flag(is_static(raw)),
        flag(is_recent_repeat(raw, history)),
        flag(is_navigation(proposed)),
        flag(is_manipulation(proposed)),
        flag(is_recent_repeat(proposed, history)),
    )
    return rows.select(
        *STEP, raw.alias("raw_top"), proposed.alias("proposed"), "preferred_action",
        flag(proposed == F.col("preferred_action")).alias("label"),
        array_to_vector(F.array(*values)).alias("features"),
    )


def train_intervention_gate(preferences: DataFrame, predictions: DataFrame, threshold: float = 0.5) -> dict:
    model = _fit(_logistic(1e-3, True), gate_rows(preferences, predictions))
    return {"model": model, "threshold": threshold}


def gate_probabilities(gate: dict, preferences: DataFrame, predictions: DataFrame) -> DataFrame:
    """Step key, both actions and ``gate_probability`` of the proposal being right."""
    scored = gate["model"].transform(gate_rows(preferences, predictions))
    return scored.select(
        *STEP, "raw_top", "proposed", "preferred_action", vector_to_array("probability")[1].alias("gate_probability")
    )


def threshold_grid(start: float, stop: float, step: float) -> list[float]:
    """Grid from start to the rounded stop, both included."""
    count = int(round((stop - start) / step))
    return [round(start + i * step, 10) for i in range(count + 1)]


def threshold_table(valid: DataFrame, retention: DataFrame, grid: list[float]) -> DataFrame:
    """Per threshold: top-1 correctness on validation, intervention and demotion rate on retention steps.

    Inputs hold raw_top, proposed, preferred_action and gate_probability. Rows are first counted by how many
    thresholds their probability reaches, so only grid-sized tables are expanded per threshold.
    """
    levels = F.array(*[F.lit(float(value)) for value in grid])
    reached = F.size(F.filter(levels, lambda level: F.col("gate_probability") >= level))

    def counts(df: DataFrame, kind: int) -> DataFrame:
        changed = F.col("proposed") != F.col("raw_top")
        raw_ok = F.col("raw_top") == F.col("preferred_action")
        new_ok = F.col("proposed") == F.col("preferred_action")
        level = F.when(changed, F.coalesce(reached, F.lit(0))).otherwise(0)
        return df.groupBy(level.alias("level")).agg(
            F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.count_if(raw_ok).alias("raw_ok"),
            F.count_if(new_ok).alias("new_ok"), F.count_if(raw_ok & ~new_ok).alias("lost"),
        )

    table = counts(valid, 0).unionByName(counts(retention, 1))
    rows = table.select("*", F.posexplode(levels).alias("i", "threshold"))
    acts = F.col("level") > F.col("i")

    def total(kind: int, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0)).cast("double")

    def share(kind: int, value: Column) -> Column:
        return F.coalesce(total(kind, value) / F.nullif(total(kind, F.col("n")), F.lit(0.0)), F.lit(0.0))

    zero = F.lit(0)
    return rows.groupBy("threshold").agg(
        share(0, F.when(acts, F.col("new_ok")).otherwise(F.col("raw_ok"))).alias("valid_overall_top1_correction"),
        share(1, F.when(acts, F.col("n")).otherwise(zero)).alias("retention_intervention_rate"),
        share(1, F.when(acts, F.col("lost")).otherwise(zero)).alias("retention_demotion_rate"),
    )


def selection_key(mode: str) -> Column:
    """``coverage`` prefers more interventions on equal correctness, ``safety`` fewer demotions."""
    correction, intervention = F.col("valid_overall_top1_correction"), F.col("retention_intervention_rate")
    demotion = F.col("retention_demotion_rate")
    if mode == "coverage":
        return F.struct(correction.alias("a"), intervention.alias("b"), (-demotion).alias("c"))
    if mode == "safety":
        return F.struct(correction.alias("a"), (-demotion).alias("b"), intervention.alias("c"))
    raise ValueError(f"unknown selection mode: {mode}")


def select_threshold(table: DataFrame, mode: str = "coverage") -> DataFrame:
    """The best row of a threshold table; equal rows go to the smaller threshold."""
    order = F.struct(selection_key(mode).alias("key"), (-F.col("threshold")).alias("t"))
    return table.agg(F.max_by(F.struct(*table.columns), order).alias("r")).select("r.*")


# ---------------------------------------------------------------- robustness over splits

def split_robustness(
    preferences: DataFrame, reranker: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], splits: int = 10, split_by: str = "seed",
    fractions: tuple[float, float, float] = (0.6, 0.1, 0.3), seed_start: int = 0,
) -> DataFrame:
    """Split, train and evaluate repeatedly; mean, population deviation, minimum and maximum per metric.

    ``reranker(train, valid, test)`` returns predictions for ``test``. The loop runs on the driver; each turn
    writes one summary row, so that no plan holds more than one split.
    """
    metrics = ("train_preferences", "valid_preferences", "test_preferences", "raw_mrr", "learned_mrr", "raw_ndcg",
               "learned_ndcg", "learned_top1_correction_rate")
    rows = None
    for number in range(seed_start, seed_start + splits):
        parts = make_splits(preferences, split_by, fractions, number)
        train, valid, test = (parts.filter(F.col("split") == name).drop("split", "split_group") for name in ("train", "valid", "test"))
        summary = ranking_summary(evaluate_ranking(test, reranker(train, valid, test)))
        sizes = parts.agg(*[F.count_if(F.col("split") == name).alias(name) for name in ("train", "valid", "test")])
        row = summary.select(
            *[sizes.select(name).scalar().cast("double").alias(f"{name}_preferences") for name in ("train", "valid", "test")],
            *[F.col(name).cast("double").alias(name) for name in metrics[3:]],
        )
        row = store(row)
        rows = row if rows is None else rows.unionByName(row)
    total = rows.agg(
        *[
            F.struct(
                F.lit(name).alias("metric"), F.avg(name).alias("mean"), F.coalesce(F.stddev_pop(name), F.lit(0.0)).alias("std"),
                F.min(name).alias("min"), F.max(name).alias("max"),
            ).alias(name)
            for name in metrics
        ]
    )
    return total.select(F.inline(F.array(*[F.col(name) for name in metrics])))
