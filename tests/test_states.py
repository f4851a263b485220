import itertools
import random

from conftest import one, rows

from trajlens.operators import transitions as I

T = "task_id string, seed bigint, state int, action string, next_state int, reward double, done boolean, valid boolean"


def table(spark, *items):
    return I.build_transitions(spark.createDataFrame([("g", 0, s, a, n, 1.0 if d else 0.0, d, v) for s, a, n, d, v in items], T))


def test_conflicts_are_left_out(spark):
    found = table(spark, (0, "a", 1, False, True), (0, "a", 2, False, True), (0, "b", 1, False, True), (0, "b", 1, False, True))
    assert one(I.conflict_report(found))["conflicts"] == 1
    assert {r["action"]: (r["conflict"], r["observations"]) for r in rows(found)} == {"a": (True, 2), "b": (False, 2)}
    assert [r["action"] for r in rows(I.usable(found))] == ["b"]


def test_relations_are_three_valued(spark):
    found = table(
        spark, (0, "a", 1, False, True), (1, "a", 1, False, True), (1, "b", 0, False, True), (0, "b", 0, False, False), (0, "c", 2, False, True),
        (1, "c", 3, False, True), (2, "a", 3, False, True))
    pairs = spark.createDataFrame([("g", 0, 0, "a", "b"), ("g", 0, 0, "a", "c"), ("g", 0, 0, "a", "z")], "task_id string, seed bigint, state int, action_a string, action_b string")
    got = {r["action_b"]: r for r in rows(I.action_relations(pairs, found))}
    assert got["b"]["inverse_ab"] is True and got["b"]["dependency_a_then_b"] is True and got["b"]["commute"] is None
    assert got["b"]["idempotent_a"] is True and got["b"]["idempotent_b"] is None
    assert got["c"]["commute"] is True and got["c"]["absorb_ab"] is False
    assert got["z"]["ab_ok"] is None and got["z"]["dependency_a_then_b"] is None and got["z"]["inverse_ab"] is None


def test_branch_outcomes_against_search(spark):
    rng = random.Random(4)
    items = {}
    for s, a in itertools.product(range(12), "abc"):
        items[(s, a)] = (rng.randrange(12), rng.random() < 0.06, rng.random() < 0.85)
    found = table(spark, *[(s, a, n, d, v) for (s, a), (n, d, v) in items.items()])

    def length(state):
        frontier, seen, depth = {state}, {state}, 0
        while frontier and depth < 4:
            depth += 1
            if any(items[(s, a)][1] and items[(s, a)][2] for s in frontier for a in "abc"):
                return depth
            frontier = {items[(s, a)][0] for s in frontier for a in "abc" if items[(s, a)][2]} - seen
            seen |= frontier
        return None

    for r in rows(I.branch_outcomes(found, 4)):
        n, done, valid = items[(r["state"], r["action"])]
        want = None if not valid else 0 if done else length(n)
        assert (r["success"], r["suffix_len"]) == (want is not None, 5 if want is None else want)


STEPS = "trajectory_id string, task_id string, seed bigint, step_index int, action string, pre_state int, post_state int"


def test_strip_trace(spark):
    moves = [("n", 0, 1), ("look", 1, 1), ("e", 1, 2), ("w", 2, 1), ("s", 1, 0), ("take", 0, 5)]
    frame = spark.createDataFrame([("t", "g", 0, i, a, p, q) for i, (a, p, q) in enumerate(moves)], STEPS)
    row = one(I.strip_trace(frame))
    assert row["normalized_actions"] == ["take"] and [row[name] for name in I.REWRITES] == [0, 1, 2]
    assert row["state_preserved"] and row["first_state"] == 0
    again = spark.createDataFrame([("t", "g", 0, 0, "take", 0, 5)], STEPS)
    assert one(I.strip_trace(again))["normalized_actions"] == ["take"]
    total = one(I.normal_form_summary(I.strip_trace(frame)))
    assert (total["compressed_traces"], total["avg_original_len"]) == (1, 6.0)


def test_invalid_and_absorbed_steps(spark):
    moves = [("look", 0, 0, True), ("north", 0, 1, True), ("eat rock", 1, 1, False), ("look", 1, 1, True), ("south", 1, 0, True), ("look", 0, 0, None)]
    frame = spark.createDataFrame([("t", "g", 0, i, a, p, q, v) for i, (a, p, q, v) in enumerate(moves)], STEPS + ", valid boolean")
    row = one(I.strip_trace(frame))
    # The invalid step stays and keeps north and south apart.
    assert row["normalized_actions"] == ["north", "eat rock", "south"]
    assert [row[name] for name in I.REWRITES] == [2, 1, 0]
    assert (row["original_valid"], row["normalized_valid"], row["state_preserved"]) == (False, False, True)
    total = one(I.normal_form_summary(I.strip_trace(frame)))
    assert (total["original_valid"], total["normalized_valid"], total["remove_absorbed_second"]) == (0, 0, 1)


def test_q_values_leave_conflicting_keys_out(spark):
    log = [("g", 0, 0, "a", 1, 0.0, False, True), ("g", 0, 0, "a", 2, 0.0, False, True), ("g", 0, 1, "b", 2, 1.0, True, True), ("g", 0, 3, "c", 1, 0.0, False, True)]
    got = rows(I.fitted_q(spark.createDataFrame(log * 2, T), 0.5, 1.0, 4))
    assert {(r["state"], r["action"]): r["q"] for r in got} == {(1, "b"): 1.0, (3, "c"): 0.5} and len(got) == 2


def test_q_values_and_policies(spark):
    found = table(spark, (0, "a", 1, False, True), (1, "b", 2, True, True), (0, "c", 0, False, True))
    q = {(r["state"], r["action"]): r["q"] for r in rows(I.fitted_q(found, 0.9, 1.0, 3))}
    assert q == {(0, "a"): 0.9, (1, "b"): 1.0, (0, "c"): 0.9 * 0.9}
    table_q = I.fitted_q(found, 0.9, 1.0, 3)
    blocked = spark.createDataFrame([("g", 0, 0, "a", 5.0), ("g", 0, 1, "b", 5.0)], "task_id string, seed bigint, state int, action string, penalty double")
    pick = lambda mode: {r["state"]: r["action"] for r in rows(I.greedy_policy(table_q, blocked, mode))}
    assert pick("none") == {0: "a", 1: "b"} and pick("soft") == {0: "c", 1: "b"} and pick("hard") == {0: "c", 1: "b"}


def plain_normal_form(actions, states, oks, legs, max_passes=20):
    """The same rewriting with every leg at hand, one rule at a time."""
    actions, states, oks, counts = list(actions), list(states), list(oks), dict.fromkeys(I.RULES, 0)
    for _ in range(max_passes):
        changed, at = False, 0
        while at < len(actions):
            a, s, s1 = actions[at], states[at], states[at + 1]
            pair = at + 1 < len(actions) and oks[at] and oks[at + 1]
            b, s2 = (actions[at + 1], states[at + 2]) if pair else (None, None)
            middle = legs.get((s, b)) if pair else None
            if oks[at] and s == s1:
                actions[at:at + 1], states[at + 1:at + 2], oks[at:at + 1] = [], [], []
                rule, back = "remove_noop", at
            elif pair and s2 == s:
                actions[at:at + 2], states[at + 1:at + 3], oks[at:at + 2] = [], [], []
                rule, back = "remove_inverse_pair", at
            elif pair and s2 == s1:
                actions[at + 1:at + 2], states[at + 2:at + 3], oks[at + 1:at + 2] = [], [], []
                rule, back = "remove_absorbed_second", at + 1
            elif pair and a > b and middle is not None and legs.get((middle, a)) == s2:
                actions[at:at + 2], states[at + 1] = [b, a], middle
                rule, back = "swap_commuting_pair", at
            else:
                at += 1
                continue
            counts[rule] += 1
            changed, at = True, max(back - 1, 0)
        if not changed:
            break
    return actions, counts


def test_canonical_traces_against_every_order(spark):
    """On a grid where all moves commute, every order of a trace has one normal form, found only from legs the log has."""
    import itertools
    import random

    moves = {"east": (1, 0), "north": (0, 1), "up": (2, 0), "wait": (0, 0)}
    draw, logged, traces = random.Random(4), {}, []

    def place(state, action):
        x, y = map(int, state.split(","))
        return f"{x + moves[action][0]},{y + moves[action][1]}"

    orders = sorted(set(itertools.permutations(["north", "east", "up", "wait"])))
    for order in orders:
        traces.append((order, 0))
    for _ in range(40):
        traces.append((tuple(draw.choice(list(moves)) for _ in range(draw.randrange(1, 8))), draw.randrange(1, 4)))
    steps = []
    for number, (actions, seed) in enumerate(traces):
        state = "0,0"
        for index, action in enumerate(actions):
            steps.append((f"t{number}", "g", seed, index, action, state, place(state, action), True))
            logged[seed, state, action] = place(state, action)
            state = place(state, action)
    frame = spark.createDataFrame(steps, "trajectory_id string, task_id string, seed bigint, step_index int, action string, pre_state string, post_state string, valid boolean")
    moved = spark.createDataFrame(
        [("g", seed, state, action, to, 0.0, False, True) for (seed, state, action), to in logged.items()],
        "task_id string, seed bigint, state string, action string, next_state string, reward double, done boolean, valid boolean")
    found = {r["trajectory_id"]: r for r in rows(I.canonical_traces(frame, moved))}
    assert len(found) == len(traces)
    for number, (actions, seed) in enumerate(traces):
        states = ["0,0"]
        for action in actions:
            states.append(place(states[-1], action))
        legs = {(state, action): to for (s, state, action), to in logged.items() if s == seed}
        want, counts = plain_normal_form(actions, states, [True] * len(actions), legs)
        row = found[f"t{number}"]
        assert row["normalized_actions"] == want and {rule: row[rule] for rule in I.RULES} == counts
        assert row["last_state"] == states[-1]
    assert all(found[f"t{number}"]["normalized_actions"] == ["east", "north", "up"] for number in range(len(orders)))
    assert sum(row["swap_commuting_pair"] for row in found.values()) > 20


def test_canonical_traces_of_small_places_walk_once(spark, monkeypatch):
    states = [("s", "c", "p"), ("p", "b", "q"), ("q", "a", "r"), ("s", "b", "u"), ("u", "c", "q"), ("u", "a", "v"), ("v", "c", "r"), ("s", "a", "w"),
              ("w", "b", "v"), ("p", "a", "x"), ("x", "b", "r")]
    steps = spark.createDataFrame(
        [(f"t{n}", "k", n, i, a, b, c) for n in range(3) for i, (b, a, c) in enumerate(states[:3])],
        "trajectory_id string, task_id string, seed bigint, step_index int, action string, pre_state string, post_state string")
    # The log of the last trace has no legs but the trace's own.
    moved = spark.createDataFrame(
        [("k", n, b, a, c, 0.0, False, True) for n in range(3) for b, a, c in (states if n < 2 else states[:3])],
        "task_id string, seed bigint, state string, action string, next_state string, reward double, done boolean, valid boolean")
    written = []
    monkeypatch.setattr(I, "store", lambda df, kept=I.store: written.append(df) or kept(df))

    def found():
        written.clear()
        return {r["trajectory_id"]: (r["normalized_actions"], r["swap_commuting_pair"]) for r in rows(I.canonical_traces(steps, moved))}

    at_once = found()
    assert at_once == {"t0": (["a", "b", "c"], 3), "t1": (["a", "b", "c"], 3), "t2": (["c", "b", "a"], 0)}
    # The legs, and one walk.
    assert len(written) == 2
    monkeypatch.setattr(I, "PLACE_LEGS", 4)
    assert found() == at_once and len(written) > 2


def test_canonical_traces_keep_invalid_steps_and_unseen_orders(spark):
    steps = spark.createDataFrame(
        [("t", "g", 0, 0, "b", "0", "1", True), ("t", "g", 0, 1, "a", "1", "2", True), ("u", "g", 0, 0, "b", "0", "0", False), ("u", "g", 0, 1, "a", "0", "0", True)],
        "trajectory_id string, task_id string, seed bigint, step_index int, action string, pre_state string, post_state string, valid boolean")
    moved = spark.createDataFrame([("g", 0, "0", "a", "3", 0.0, False, True)], "task_id string, seed bigint, state string, action string, next_state string, reward double, done boolean, valid boolean")
    found = {r["trajectory_id"]: r["normalized_actions"] for r in rows(I.canonical_traces(steps, moved))}
    assert found == {"t": ["b", "a"], "u": ["b"]}
    assert I.canonical_traces(steps.limit(0), moved).count() == 0
