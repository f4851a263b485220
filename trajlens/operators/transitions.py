"""Work over logged state transitions: determinism, action relations, shortest suffixes, trace stripping, Q values.

Every operator keeps to what the log has seen. Soundness rests on determinism, so keys with conflicting
outcomes are marked by :func:`build_transitions` and left out by the operators that look outcomes up.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlens.functions.actions import is_recent_repeat
from trajlens.functions.ranks import safe_div
from trajlens.operators.datasets import optional
from trajlens.session import ship_package, store, store_bucketed

PLACE = ["task_id", "seed"]
KEY = [*PLACE, "state", "action"]
TRACE = ["trajectory_id", *PLACE]
REWRITES = ("remove_noop", "remove_absorbed_second", "remove_inverse_pair")


def build_transitions(steps: DataFrame) -> DataFrame:
    """One row per (task, seed, state, action) with ``conflict`` when its outcomes differ.

    Outcomes are compared by minimum and maximum, so repeated observations combine before the shuffle.
    """
    outcome = F.struct("next_state", "done", "valid")
    return steps.groupBy(*KEY).agg(
        F.min(outcome).alias("low"),
        F.max(outcome).alias("high"),
        F.max("reward").alias("reward"),
        F.count(F.lit(1)).alias("observations"),
    ).select(
        *KEY, "low.next_state", "reward", "low.done", "low.valid", "observations",
        (F.col("low") != F.col("high")).alias("conflict"),
    )


def conflict_report(transitions: DataFrame) -> DataFrame:
    return transitions.agg(
        F.count(F.lit(1)).alias("transitions"),
        F.coalesce(F.sum("observations"), F.lit(0)).alias("observations"),
        F.count_if("conflict").alias("conflicts"),
    ).withColumn("conflict_rate", safe_div(F.col("conflicts"), F.col("transitions")))


def usable(transitions: DataFrame) -> DataFrame:
    return transitions.filter(~F.col("conflict")) if "conflict" in transitions.columns else transitions


# ---------------------------------------------------------------- relations between two actions

def action_relations(pairs: DataFrame, transitions: DataFrame) -> DataFrame:
    """Relations of the requested ``pairs`` (task_id, seed, state, action_a, action_b), three-valued.

    A leg the log has not seen is NULL; an invalid leg is false. Each pair is looked up in two rounds, first
    a and b from the state, then the second actions from where they lead, and folded back to one row: two
    joins and one aggregation instead of six joins.
    """
    pair = [*PLACE, "state", "action_a", "action_b"]
    table = usable(transitions).select(
        *PLACE, F.col("state").alias("_at"), F.col("action").alias("_act"), F.col("next_state").alias("_to"),
        F.col("valid").alias("_ok"),
    )
    # A leg is known by two numbers, 0 for a and 1 for b; the first half of the way is looked up once for both second actions.
    turns = F.array(F.lit(0).cast("tinyint"), F.lit(1).cast("tinyint"))

    def acted(turn: str) -> Column:
        return F.when(F.col(turn) == 0, F.col("action_a")).otherwise(F.col("action_b"))

    firsts = pairs.select(*pair).distinct().withColumn("first", F.explode(turns))
    one = firsts.withColumns({"_at": F.col("state"), "_act": acted("first")}).join(table, [*PLACE, "_at", "_act"], "left")
    one = one.select(
        *pair, "first", F.col("_to").alias("first_state"), F.col("_ok").alias("first_ok"), F.explode(turns).alias("second")
    )
    two = one.withColumns({"_at": F.col("first_state"), "_act": acted("second")}).join(
        table, [*PLACE, "_at", "_act"], "left"
    )
    both_ok = F.when(~F.col("first_ok"), F.lit(False)).otherwise(F.when(F.col("first_ok"), F.col("_ok")))
    two = two.select(
        *pair, "first", "second", "first_state", "first_ok", F.col("_to").alias("second_state"),
        both_ok.alias("second_ok"),
    )

    def at(name: str, column: str) -> Column:
        first, second = ("ab".index(letter) for letter in name)
        return F.max(F.when((F.col("first") == first) & (F.col("second") == second), F.col(column)))

    wide = two.groupBy(*pair).agg(
        *[at(f"{x}b", "first_state").alias(f"{x}_state") for x in "ab"],
        *[at(f"{x}b", "first_ok").alias(f"{x}_ok") for x in "ab"],
        *[at(n, "second_state").alias(f"{n}_state") for n in ("ab", "ba", "aa", "bb")],
        *[at(n, "second_ok").alias(f"{n}_ok") for n in ("ab", "ba", "aa", "bb")],
    )

    def known(*names: str) -> Column:
        out = F.lit(True)
        for name in names:
            out = out & F.coalesce(F.col(f"{name}_ok"), F.lit(False))
        return out

    def state(name: str) -> Column:
        return F.col("state") if name == "s" else F.col(f"{name}_state")

    def equal(left: str, right: str, *needed: str) -> Column:
        return F.when(known(*needed), state(left) == state(right))

    def inverse(first: str, pair_leg: str) -> Column:
        return F.when(
            known(first, pair_leg), (state("s") != state(first)) & (state("s") == state(pair_leg))
        )

    return wide.select(
        *pair,
        *[f"{name}_ok" for name in ("a", "b", "ab", "ba", "aa", "bb")],
        equal("ab", "ba", "ab", "ba").alias("commute"),
        equal("a", "aa", "a", "aa").alias("idempotent_a"),
        equal("b", "bb", "b", "bb").alias("idempotent_b"),
        inverse("a", "ab").alias("inverse_ab"),
        inverse("b", "ba").alias("inverse_ba"),
        equal("a", "ab", "a", "ab").alias("absorb_ab"),
        equal("b", "ba", "b", "ba").alias("absorb_ba"),
        (~F.col("b_ok") & F.col("ab_ok")).alias("dependency_a_then_b"),
        (~F.col("a_ok") & F.col("ba_ok")).alias("dependency_b_then_a"),
    )


# ---------------------------------------------------------------- shortest logged suffixes

def state_distances(transitions: DataFrame, max_steps: int = 12) -> DataFrame:
    """Fewest logged actions from a state to success, for states that reach it within ``max_steps``.

    Breadth-first search backwards from terminal transitions. Each round joins only the newest states with
    the transition table and is written before the next, so plans do not grow; it stops when nothing is new.
    """
    table = usable(transitions).filter("valid").select(*PLACE, "state", "next_state", "done").distinct()
    # In buckets of the state that links lead to, which every round joins on: links are shuffled once in all.
    table = store_bucketed(table, [*PLACE, "next_state"])
    frontier = store(table.filter("done").select(*PLACE, "state").distinct().withColumn("distance", F.lit(1)))
    found = frontier
    links = table.filter(~F.col("done"))
    for distance in range(2, max_steps + 1):
        reached = links.join(frontier.select(*PLACE, F.col("state").alias("next_state")), [*PLACE, "next_state"], "left_semi")
        frontier = store(
            reached.select(*PLACE, "state").distinct().join(found, [*PLACE, "state"], "left_anti")
            .withColumn("distance", F.lit(distance))
        )
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def branch_outcomes(transitions: DataFrame, max_steps: int = 12) -> DataFrame:
    """Per (state, action): does the branch reach success in the log, and how many actions follow.

    A lower bound on what live replay would certify: only logged paths count, and the shortest one is taken.
    Suffix length is 0 when the action itself succeeds and ``max_steps`` + 1 on failure.
    """
    distances = state_distances(transitions, max_steps).select(
        *PLACE, F.col("state").alias("next_state"), "distance"
    )
    rows = usable(transitions).select(*KEY, "next_state", "done", "valid").distinct().join(
        distances, [*PLACE, "next_state"], "left"
    )
    length = F.when(~F.col("valid"), None).when(F.col("done"), 0).otherwise(F.col("distance"))
    return rows.select(
        *KEY, "valid", length.isNotNull().alias("success"),
        F.coalesce(length, F.lit(max_steps + 1)).alias("suffix_len"),
    )


# ---------------------------------------------------------------- trace stripping

def strip_trace(steps: DataFrame) -> DataFrame:
    """Actions left after removing no-ops, absorbed actions and inverse pairs until none is left.

    One pass over the ordered steps with a stack. A valid step that does not change the state is dropped: absorbed by a
    valid action on top of the stack, else a no-op. A valid step that returns to where the valid top started removes
    that top. Anything else is pushed. Invalid steps (``valid`` false) are kept, and nothing is paired with them;
    without the column, or where it is null, a step is valid.
    """
    valid = F.coalesce(optional(steps, "valid", "boolean"), F.lit(True))
    item = F.struct(
        "step_index", "action", F.col("pre_state").alias("pre"), F.col("post_state").alias("post"), valid.alias("valid")
    )
    ordered = steps.groupBy(*TRACE).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = steps.schema["pre_state"].dataType.simpleString()
    empty = F.array().cast(f"array<struct<action:string,pre:{kind},post:{kind},valid:boolean>>")
    counts = ("noops", "absorbed", "inverse")
    start = F.struct(empty.alias("stack"), *[F.lit(0).alias(name) for name in counts])

    def fold(acc: Column, step: Column) -> Column:
        stack = acc["stack"]
        top = F.get(stack, F.size(stack) - 1)
        paired = F.coalesce(top["valid"], F.lit(False))
        still = step["valid"] & F.coalesce(step["post"] == step["pre"], F.lit(False))
        back = step["valid"] & ~still & paired & F.coalesce(top["pre"] == step["post"], F.lit(False))
        pushed = F.concat(stack, F.array(F.struct(*[step[name].alias(name) for name in ("action", "pre", "post", "valid")])))
        hits = dict(zip(counts, (still & ~paired, still & paired, back), strict=True))
        return F.struct(
            F.when(still, stack).when(back, F.slice(stack, F.lit(1), F.size(stack) - 1)).otherwise(pushed).alias("stack"),
            *[(acc[name] + hit.cast("int")).alias(name) for name, hit in hits.items()],
        )

    rows = ordered.withColumn("r", F.aggregate("items", start, fold))
    last = F.get("r.stack", F.size("r.stack") - 1)
    first_state = F.get("items", 0)["pre"]
    return rows.select(
        *TRACE,
        F.size("items").alias("original_len"),
        F.transform("r.stack", lambda s: s["action"]).alias("normalized_actions"),
        F.size("r.stack").alias("normalized_len"),
        F.col("r.noops").alias("remove_noop"),
        F.col("r.absorbed").alias("remove_absorbed_second"),
        F.col("r.inverse").alias("remove_inverse_pair"),
        F.forall("items", lambda s: s["valid"]).alias("original_valid"),
        F.forall("r.stack", lambda s: s["valid"]).alias("normalized_valid"),
        first_state.alias("first_state"),
        (F.coalesce(last["post"], first_state) == F.get("items", F.size("items") - 1)["post"]).alias("state_preserved"),
    )


# ---------------------------------------------------------------- canonical traces

RULES = ("remove_noop", "remove_inverse_pair", "remove_absorbed_second", "swap_commuting_pair")
_LEG = "struct<state:string,action:string,next:string,ok:boolean>"
_WORK = (
    "trajectory_id string, task_id string, seed bigint, original_len int, actions array<string>, states array<string>, "
    f"oks array<boolean>, at int, changed boolean, passes int, {', '.join(f'{rule} int' for rule in RULES)}, legs array<{_LEG}>, "
    "whole boolean, needed array<struct<state:string,action:string>>"
)
#: A place with at most this many legs gives them to its traces at once; traces of other places ask for what they need.
PLACE_LEGS = 256


def rewrite_trace(row: dict, max_passes: int) -> dict:
    """Go on rewriting one trace until it is in normal form or needs a leg that has not been looked up.

    ``states`` holds the state before each action and the last one. At a place the rules are tried in the order of RULES, and
    the walk steps back by one after each hit; passes end when one changes nothing. Two actions out of text order are
    swapped if both orders are valid and lead to the same state. ``whole`` says that a leg that is not there was never seen.
    """
    actions, states, oks = list(row["actions"]), list(row["states"]), list(row["oks"])
    legs = {(leg["state"], leg["action"]): (leg["next"], leg["ok"]) for leg in row["legs"] or ()}
    counts = {rule: row[rule] for rule in RULES}
    at, changed, passes, needed, whole = row["at"], row["changed"], row["passes"], None, row["whole"]

    def drop(place: int, count: int) -> None:
        # The state after what is dropped is the one before it, so the later of the two goes.
        del actions[place : place + count], oks[place : place + count], states[place + 1 : place + 1 + count]

    def ahead() -> list[dict]:
        """Legs that are missing at this place and, as the order now stands, at later ones; asked for together."""
        wanted = {}
        for place in range(at, len(actions) - 1):
            first, second = actions[place], actions[place + 1]
            if first > second and oks[place] and oks[place + 1]:
                other = (states[place], second)
                last = (legs[other][0], first) if other in legs and legs[other][1] else other
                if last not in legs:
                    wanted[last] = {"state": last[0], "action": last[1]}
        return list(wanted.values())

    while passes < max_passes and needed is None:
        if at >= len(actions):
            passes += 1
            if not changed:
                break
            at, changed = 0, False
            continue
        rule = None
        start, after = states[at], states[at + 1]
        if oks[at] and after == start:
            rule, back = "remove_noop", at
            drop(at, 1)
        elif at + 1 < len(actions) and oks[at] and oks[at + 1]:
            first, second, end = actions[at], actions[at + 1], states[at + 2]
            if end == start:
                rule, back = "remove_inverse_pair", at
                drop(at, 2)
            elif end == after:
                rule, back = "remove_absorbed_second", at + 1
                drop(at + 1, 1)
            elif first > second:
                other = (start, second)
                if other not in legs:
                    needed = None if whole else ahead()
                elif legs[other][1]:
                    last = (legs[other][0], first)
                    if last not in legs:
                        needed = None if whole else ahead()
                    elif legs[last][1] and legs[last][0] == end:
                        rule, back = "swap_commuting_pair", at
                        actions[at], actions[at + 1], states[at + 1] = second, first, legs[other][0]
        if rule:
            counts[rule] += 1
            at, changed = max(back - 1, 0), True
        elif needed is None:
            at += 1
    return row | counts | {
        "actions": actions, "states": states, "oks": oks, "at": at, "changed": changed, "passes": passes,
        "legs": row["legs"] if needed else [], "needed": needed or [],
    }


def canonical_traces(steps: DataFrame, transitions: DataFrame, max_passes: int = 20) -> DataFrame:
    """Normal form of each trace: no no-ops, inverse pairs and absorbed actions, and commuting neighbours in text order.

    Whether two actions commute is asked of the log: all four legs must have been seen, without conflict, and be valid.
    Traces start with the legs of their place and actions, unless the place has more than ``PLACE_LEGS``, and then walk to the
    end in one go. The others walk on until they need a leg; the legs wanted by all waiting traces, here and ahead of them, are
    looked up in one join, and so on until no trace waits. Only waiting traces are read again. Invalid steps stay and pair with
    nothing.
    """
    ship_package(steps.sparkSession)
    valid = F.coalesce(optional(steps, "valid", "boolean"), F.lit(True))
    item = F.struct("step_index", "action", F.col("pre_state").cast("string").alias("pre"), F.col("post_state").cast("string").alias("post"), valid.alias("ok"))
    ordered = steps.groupBy(*TRACE).agg(F.array_sort(F.collect_list(item)).alias("items"))
    actions = F.transform("items", lambda x: F.coalesce(x["action"], F.lit("")))
    work = ordered.select(
        *[F.col(name).cast(kind) for name, kind in zip(TRACE, ("string", "string", "bigint"), strict=True)],
        F.size("items").alias("original_len"), actions.alias("actions"),
        F.concat(F.transform("items", lambda x: x["pre"]), F.array(F.element_at("items", -1)["post"])).alias("states"),
        F.transform("items", lambda x: x["ok"]).alias("oks"), F.lit(0).alias("at"), F.lit(False).alias("changed"), F.lit(0).alias("passes"),
        *[F.lit(0).alias(rule) for rule in RULES],
    )
    keyed = transitions if "conflict" in transitions.columns else build_transitions(transitions)
    seen = store(usable(keyed).select(
        *PLACE, F.col("state").cast("string").alias("state"), "action", F.col("next_state").cast("string").alias("next"), F.col("valid").alias("ok")
    ))

    few = seen.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= PLACE_LEGS).drop("_n")
    leg = F.struct("state", "action", "next", F.coalesce("ok", F.lit(False)).alias("ok"))
    known = seen.join(few, PLACE).groupBy(*PLACE).agg(F.collect_list(leg).alias("_known"))
    own = F.filter("_known", lambda x: F.array_contains("actions", x["action"]))
    work = work.join(known, PLACE, "left").withColumns({
        "legs": F.coalesce(own, F.array()).cast(f"array<{_LEG}>"), "whole": F.col("_known").isNotNull(),
        "needed": F.array().cast("array<struct<state:string,action:string>>"),
    }).select(*TRACE, *[name for name in work.columns if name not in TRACE], "legs", "whole", "needed")

    def walk(batches):
        for batch in batches:
            rows = [rewrite_trace(row, max_passes) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    finished: list[DataFrame] = []
    while True:
        walked = store(work.mapInArrow(walk, _WORK))
        finished.append(walked.where("size(needed) = 0"))
        waiting = walked.where("size(needed) > 0")
        if waiting.isEmpty():
            break
        asked = waiting.select(*TRACE, F.inline("needed"))
        # Traces of one task share legs; each is looked up once.
        found = asked.select(*PLACE, "state", "action").distinct().join(seen, [*PLACE, "state", "action"], "left").select(
            *PLACE, "state", "action", F.struct("state", "action", "next", F.coalesce("ok", F.lit(False)).alias("ok")).alias("_found")
        )
        answers = asked.join(found, [*PLACE, "state", "action"]).groupBy(*TRACE).agg(F.collect_list("_found").alias("_legs"))
        work = waiting.join(answers, TRACE).withColumn("legs", F.concat("legs", "_legs")).select(*walked.columns)
    rows = reduce(DataFrame.unionByName, finished)
    return rows.select(
        *TRACE, "original_len", F.col("actions").alias("normalized_actions"), F.size("actions").alias("normalized_len"),
        *RULES, "passes", F.get("states", F.size("states") - 1).alias("last_state"),
    )


def unique_traces(records: DataFrame) -> DataFrame:
    """Distinct non-empty prefixes per (task, seed)."""
    return records.filter(F.size("prefix_actions") > 0).select(*PLACE, "prefix_actions").distinct()


def normal_form_summary(stripped: DataFrame) -> DataFrame:
    return stripped.agg(
        F.count(F.lit(1)).alias("traces"),
        F.count_if("state_preserved").alias("state_preserved"),
        F.sum("original_len").alias("_before"),
        F.sum("normalized_len").alias("_after"),
        F.count_if(F.col("normalized_len") < F.col("original_len")).alias("compressed_traces"),
        *[F.count_if(name).alias(name) for name in ("original_valid", "normalized_valid")],
        *[F.sum(name).alias(name) for name in REWRITES],
    ).select(
        "traces",
        "state_preserved",
        safe_div(F.col("state_preserved"), F.col("traces")).alias("state_preservation_rate"),
        safe_div(F.col("_before"), F.col("traces")).alias("avg_original_len"),
        safe_div(F.col("_after"), F.col("traces")).alias("avg_normalized_len"),
        safe_div(F.col("_after"), F.col("_before")).alias("compression_ratio"),
        "compressed_traces",
        "original_valid",
        "normalized_valid",
        *REWRITES,
    )


def with_seen_states(steps: DataFrame) -> DataFrame:
    """Add ``seen_states``: distinct states from the start of the (bounded) episode up to the current one."""
    sofar = Window.partitionBy(*TRACE).orderBy("step_index").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("seen_states", F.collect_set("pre_state").over(sofar))


def structural_reasons(steps: DataFrame) -> DataFrame:
    """Why an executed action looks useless: recent repeat, invalid, no-op, state seen before.

    Needs ``history`` (see ``ledger.with_history``), pre_state, post_state and valid.
    """
    rows = with_seen_states(steps)
    post = F.col("post_state")
    reasons = F.array_compact(
        F.array(
            F.when(is_recent_repeat(F.col("action"), F.col("history")), "recent_repeat"),
            F.when(~F.col("valid"), "invalid"),
            F.when(F.col("valid") & (post == F.col("pre_state")), "noop"),
            F.when(F.col("valid") & F.array_contains("seen_states", post), "seen_state"),
        )
    )
    return rows.select(*TRACE, "step_index", "action", reasons.alias("reasons"))


# ---------------------------------------------------------------- Q values over the log

def fitted_q(
    transitions: DataFrame, gamma: float = 0.95, alpha: float = 0.5, iterations: int | None = 5, tolerance: float | None = None
) -> DataFrame:
    """Q values by repeated batch updates over the logged transitions, all starting from zero.

    The value of the next state is the best logged action there, zero when there is none or the step ended.
    Keys with conflicting outcomes are left out, so there is one row per key. With ``tolerance`` rounds go on until no value
    changes by more, at most ``iterations`` of them if given.

    The table lies in buckets of the next state. A round reduces it to one value per state, shuffles these only, and writes the
    next table from where its rows are; transitions are shuffled once in all.
    """
    if iterations is None and tolerance is None:
        raise ValueError("give a number of iterations or a tolerance")
    keyed = transitions if "conflict" in transitions.columns else build_transitions(transitions)
    outcome, target_state = [*KEY, "next_state", "reward", "done"], [*PLACE, "next_state"]
    q = store_bucketed(usable(keyed).select(*outcome, F.lit(0.0).alias("q"), F.lit(0.0).alias("change")), target_state)
    done = 0
    while iterations is None or done < iterations:
        best = q.groupBy(*PLACE, F.col("state").alias("next_state")).agg(F.max("q").alias("v"))
        target = F.col("reward") + gamma * F.when(F.col("done"), 0.0).otherwise(F.coalesce("v", F.lit(0.0)))
        rows = q.join(best.hint("shuffle_merge"), target_state, "left").select(*outcome, "q", (alpha * (target - F.col("q"))).alias("change"))
        q = store_bucketed(rows.withColumn("q", F.col("q") + F.col("change")), target_state, dealt=True)
        done += 1
        if tolerance is not None and (q.agg(F.max(F.abs("change"))).first()[0] or 0.0) <= tolerance:
            break
    return q.select(*KEY, "q")


def greedy_policy(q: DataFrame, blocked: DataFrame | None = None, mode: str = "none") -> DataFrame:
    """Best action per state, ties by action text.

    ``soft`` takes ``penalty`` off the value; ``hard`` drops actions with a positive penalty unless that
    leaves none. ``blocked``: task_id, seed, state, action, penalty.
    """
    if mode not in ("none", "soft", "hard"):
        raise ValueError(f"unknown prior: {mode}")
    rows = q.withColumn("penalty", F.lit(0.0))
    if mode != "none":
        rows = q.join(blocked.select(*KEY, "penalty"), KEY, "left").fillna({"penalty": 0.0})
    score = F.col("q") - F.col("penalty") if mode == "soft" else F.col("q")
    barred = (F.col("penalty") > 0) if mode == "hard" else F.lit(False)
    order = F.struct(barred.alias("barred"), (-score).alias("down"), F.col("action"))
    return rows.groupBy(*PLACE, "state").agg(F.min(order).alias("best")).select(
        *PLACE, "state", "best.action", (-F.col("best.down")).alias("value")
    )
