"""Column expressions over action text and action history."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verb vocabularies, inverse moves and pool priorities of the log format.
INVERSE_MOVES = {
    "go north": "go south",
    "go south": "go north",
    "go east": "go west",
    "go west": "go east",
    "go up": "go down",
    "go down": "go up",
}
GROUP_MANIPULATION = ("take", "drop", "put", "open", "close", "unlock", "lock", "insert")
GROUP_INSPECTION = ("look", "inventory", "examine", "read")
NAVIGATION_VERBS = ("go", "north", "south", "east", "west")
STATIC_VERBS = ("look", "inventory", "examine")
MANIPULATION_VERBS = ("take", "drop", "open", "close", "unlock", "lock", "put", "insert", "eat")
POOL_PRIORITY = {
    "go": 0.0, "open": 1.0, "unlock": 1.0, "take": 1.4, "put": 2.0, "insert": 2.0, "drop": 2.2,
    "eat": 2.2, "close": 2.4, "lock": 2.4, "read": 3.0, "look": 5.0, "inventory": 5.0, "examine": 5.0,
}
POOL_PRIORITY_OTHER = 3.2
DIRECTION_ALIASES = {
    "north": ("north",),
    "south": ("south",),
    "east": ("east",),
    "west": ("west",),
    "up": ("up", "upstairs"),
    "down": ("down", "downstairs"),
}
PUT_STOP_WORDS = ("on", "in", "into", "onto")
OBJECT_STOP_WORDS = ("with", "in", "into", "on", "the", "a", "an")
RECENT_WINDOW = 4

# Words of ASCII letters and digits with one space between: texts that the patterns below leave as they are. Most actions are
# such, and this is found much faster than the patterns are applied.
SIMPLE = r"^[a-z0-9]++(?: [a-z0-9]++)*+\z"

# Unicode white space plus the ASCII separators, as one class.
SPACES = r"(?U)[\s\x1c-\x1f]+"


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a lambda's argument is a value, a column used twice is computed twice."""
    return F.get(F.transform(F.array(value), use), 0)


def lookup_map(values: dict) -> Column:
    return F.create_map(*[F.lit(item) for pair in values.items() for item in pair])


def normalize_action(action: Column) -> Column:
    """Lower case, outer space removed, inner space runs collapsed; NULL stays NULL."""
    lower = F.lower(action)
    return F.when(lower.rlike(SIMPLE), lower).otherwise(F.trim(F.regexp_replace(lower, SPACES, " ")))


def action_verb(action: Column) -> Column:
    """First word in lower case, '' for blank text."""
    return F.get(F.split(normalize_action(action), " "), F.lit(0))


def leading_word(action: Column) -> Column:
    """Text up to the first space, without stripping, in lower case."""
    return F.lower(F.substring_index(action, " ", 1))


def action_group(action: Column) -> Column:
    verb = action_verb(action)
    return (
        F.when(verb == "go", "navigation")
        .when(verb.isin(*GROUP_MANIPULATION), "manipulation")
        .when(verb.isin(*GROUP_INSPECTION), "inspection")
        .otherwise("other")
    )


def is_navigation(action: Column) -> Column:
    return action_verb(action).isin(*NAVIGATION_VERBS)


def is_static(action: Column) -> Column:
    return action_verb(action).isin(*STATIC_VERBS)


def is_manipulation(action: Column) -> Column:
    return action_verb(action).isin(*MANIPULATION_VERBS)


def last_items(items: Column, count: int) -> Column:
    """The last ``count`` array items (all of them for shorter arrays)."""
    start = F.greatest(F.size(items) - F.lit(count - 1), F.lit(1))
    return F.slice(items, start, F.lit(count))


def is_recent_repeat(action: Column, history: Column, window: int = RECENT_WINDOW) -> Column:
    return F.array_contains(last_items(history, window), action)


def is_inverse_navigation(previous: Column, current: Column) -> Column:
    return F.coalesce(F.try_element_at(lookup_map(INVERSE_MOVES), previous) == current, F.lit(False))


def plain_text(text: Column) -> Column:
    """Lower case with every sign that is neither letter, digit nor space blanked."""
    return F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}\s\x1c-\x1f]", " ")


def word_text(text: Column) -> Column:
    """Runs of letters and digits in lower case, with one space between."""
    lower = F.lower(text)
    return F.when(lower.rlike(SIMPLE), lower).otherwise(F.trim(F.regexp_replace(lower, r"[^\p{L}\p{N}]+", " ")))


def text_after_verb(action: Column) -> Column:
    rest = F.coalesce(F.get(F.split(action, " ", 2), F.lit(1)), F.lit(""))
    spaced = F.trim(F.regexp_replace(plain_text(rest), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    return F.when(F.lower(action).rlike(SIMPLE), F.lower(rest)).otherwise(spaced)


def _after_first(words: Column) -> Column:
    """Text behind the first word of a :func:`word_text`, with a space at both ends."""
    return F.concat(F.substring(words, F.length(F.substring_index(words, " ", 1)) + 1, F.length(words)), F.lit(" "))


def _until(words: Column, stops: tuple[str, ...]) -> Column:
    for stop in stops:
        words = F.concat(F.substring_index(words, f" {stop} ", 1), F.lit(" "))
    return words


def _moved(words: Column) -> Column:
    verb, rest = F.substring_index(words, " ", 1), _after_first(words)
    return F.trim(
        F.when(verb == "take", _until(rest, ("from",)))
        .when(verb == "drop", rest)
        .when(verb.isin("put", "insert"), _until(rest, PUT_STOP_WORDS))
        .otherwise("")
    )


def moved_object(action: Column) -> Column:
    """Object phrase of a take/drop/put/insert action, '' for anything else."""
    return _moved(word_text(action))


def _change_keys(action: Column, words: Column, undo: bool) -> Column:
    """Keys of what an action (with its :func:`word_text`) does or, with ``undo``, of what it takes back."""
    text, verb = F.lower(action), leading_word(action)
    move = F.try_element_at(lookup_map(INVERSE_MOVES), text) if undo else text
    objects = F.array_except(F.split(F.trim(_after_first(words)), " "), F.array(*[F.lit(word) for word in ("", *OBJECT_STOP_WORDS)]))

    def side(kind: str, first: str) -> Column:
        # Two sides of a pair of verbs: what one does is what the other takes back.
        return F.when(verb == first, f"{kind}{'-' if undo else '+'}:").otherwise(f"{kind}{'+' if undo else '-'}:")

    return F.coalesce(
        F.when(text.isin(*INVERSE_MOVES), F.array(F.concat(F.lit("move:"), move)))
        .when(verb.isin("open", "close"), F.array(F.concat(side("open", "open"), text_after_verb(text))))
        .when(verb.isin("unlock", "lock"), F.transform(objects, lambda name: F.concat(side("lock", "unlock"), name)))
        .when(verb.isin("take", "drop", "put", "insert") & (_moved(words) != ""), F.array(F.concat(side("take", "take"), _moved(words)))),
        F.array().cast("array<string>"),
    )


def changes_of(actions: Column) -> Column:
    """Keys of what a list of actions did, to be compared with :func:`undone_by`."""
    return F.flatten(F.transform(actions, lambda action: bound(word_text(action), lambda words: _change_keys(action, words, False))))


def is_semantic_undo(previous: Column, current: Column) -> Column:
    """Whether the current action takes back what the previous one did."""
    return F.arrays_overlap(_change_keys(previous, word_text(previous), False), _change_keys(current, word_text(current), True))


def objective_goal(objective: Column) -> Column:
    """Objective as :func:`goal_overlap` wants it; NULL when there is none."""
    return F.when(objective != "", plain_text(objective))


def goal_overlap(action: Column, words: Column, goal: Column) -> Column:
    def share_of(tokens: Column) -> Column:
        found = F.size(F.filter(tokens, lambda word: F.contains(goal, word)))
        share = F.least(found / F.nullif(F.size(tokens), F.lit(0)).cast("double"), F.lit(1.0))
        return F.when(F.size(tokens) == 0, 0.0).when(F.startswith(action, F.lit("go ")) & named, 1.0).otherwise(share)

    direction = F.get(F.split(action, " ", 2), F.lit(1))
    aliases = F.coalesce(
        F.try_element_at(
            F.create_map(
                *[
                    item
                    for name, words in DIRECTION_ALIASES.items()
                    for item in (F.lit(name), F.array(*[F.lit(word) for word in words]))
                ]
            ),
            direction,
        ),
        F.array(direction),
    )
    named = F.exists(aliases, lambda word: F.contains(goal, word))
    tokens = F.filter(F.split(words, " "), lambda word: F.length(word) > 2)
    return F.when(goal.isNull(), 0.0).otherwise(bound(tokens, share_of))


def objective_overlap(action: Column, objective: Column) -> Column:
    """Share of the action's longer words found inside the objective text; 1 when a named direction is."""
    return bound(objective_goal(objective), lambda goal: goal_overlap(action, word_text(action), goal))


JUDGEMENTS = ("repeat", "inverse", "undone", "overlap")


def judged_actions(actions: Column, history: Column, objective: Column, terms: tuple[str, ...] = JUDGEMENTS) -> Column:
    """Structs (action, pos and ``terms``): whether an action repeats, reverses or undoes recent ones, and its objective overlap.

    What depends on history and objective alone is computed once for the whole list, each action's texts once.
    """
    sources = {
        "repeat": last_items(history, RECENT_WINDOW), "inverse": F.get(history, F.size(history) - 1),
        "undone": changes_of(last_items(history, 3)), "overlap": objective_goal(objective),
    }
    judges = {
        "repeat": lambda action, _words, recent: F.array_contains(recent, action),
        "inverse": lambda action, _words, previous: is_inverse_navigation(previous, action),
        "undone": lambda action, words, changes: F.arrays_overlap(changes, _change_keys(action, words, True)),
        "overlap": goal_overlap,
    }
    known = F.struct(F.lit(0).alias("_"), *[sources[term].alias(term) for term in terms])
    texts = F.transform(actions, lambda action, pos: F.struct(action.alias("action"), pos.alias("pos"), word_text(action).alias("words")))

    def judge(given: Column) -> Column:
        return F.transform(
            texts,
            lambda item: F.struct(
                item["action"].alias("action"), item["pos"].alias("pos"),
                *[judges[term](item["action"], item["words"], given[term]).alias(term) for term in terms],
            ),
        )

    return bound(known, judge)


def judged_priority(item: Column) -> Column:
    base = F.coalesce(
        F.try_element_at(lookup_map(POOL_PRIORITY), leading_word(item["action"])), F.lit(POOL_PRIORITY_OTHER)
    )
    return (
        base
        + F.when(item["repeat"], 4.0).otherwise(0.0)
        + F.when(item["inverse"], 3.0).otherwise(0.0)
        + F.when(item["undone"], 3.0).otherwise(0.0)
        - item["overlap"]
    )


def pool_priority(action: Column, history: Column, objective: Column) -> Column:
    """Smaller is tried first: verb class, then repeat, reversal and undo malus, objective bonus."""
    return F.get(F.transform(judged_actions(F.array(action), history, objective), judged_priority), 0)


def rank_pool(actions: Column, history: Column, objective: Column, mode: str = "default") -> Column:
    """Ordered action pool.

    ``default`` keeps the given order but moves recent repeats, ``look`` and ``inventory`` behind the rest;
    ``progress`` sorts by :func:`pool_priority`, ties in the given order.
    """
    if mode == "default":
        def split(recent: Column) -> Column:
            def fresh(action):
                return ~F.array_contains(recent, action) & ~action.isin("look", "inventory")

            return F.concat(F.filter(actions, fresh), F.filter(actions, lambda action: ~fresh(action)))

        return bound(last_items(history, RECENT_WINDOW), split)
    if mode != "progress":
        raise ValueError(f"unknown pool order: {mode}")
    scored = F.transform(
        judged_actions(actions, history, objective),
        lambda item: F.struct(judged_priority(item).alias("score"), item["pos"].alias("pos"), item["action"].alias("action")),
    )
    return F.transform(F.array_sort(scored), lambda item: item["action"])


def penalty_terms(**weights: float) -> tuple[str, ...]:
    """Judgements that penalties with these weights need."""
    needs = {"recent_repeat": "repeat", "inverse": "inverse", "semantic_undo": "undone", "off_objective": "overlap", "overlap_bonus": "overlap"}
    return tuple(term for term in JUDGEMENTS if any(weights.get(name) for name, need in needs.items() if need == term))


def judged_penalty(
    item: Column,
    recent_repeat: float = 0.0,
    inverse: float = 0.0,
    static: float = 0.0,
    semantic_undo: float = 0.0,
    overlap_bonus: float = 0.0,
    navigation_bonus: float = 0.0,
    off_objective: float = 0.0,
) -> Column:
    """Penalty of an item of :func:`judged_actions`; a zero weight leaves its term out of the plan."""
    action = item["action"]
    total = F.lit(0.0)
    if recent_repeat:
        total = total + F.when(item["repeat"], recent_repeat).otherwise(0.0)
    if inverse:
        total = total + F.when(item["inverse"], inverse).otherwise(0.0)
    if static:
        trimmed = F.when(F.lower(action).rlike(SIMPLE), action).otherwise(F.trim(F.regexp_replace(action, SPACES, " ")))
        first = F.substring_index(trimmed, " ", 1)
        total = total + F.when(first.isin(*STATIC_VERBS), static).otherwise(0.0)
    if semantic_undo:
        total = total + F.when(item["undone"], semantic_undo).otherwise(0.0)
    if off_objective:
        off = leading_word(action).isin(*MANIPULATION_VERBS) & (item["overlap"] <= 0.0)
        total = total + F.when(off, off_objective).otherwise(0.0)
    if overlap_bonus:
        total = total - overlap_bonus * item["overlap"]
    if navigation_bonus:
        total = total - F.when(F.startswith(action, F.lit("go ")), navigation_bonus).otherwise(0.0)
    return total


def structural_penalty(action: Column, history: Column, objective: Column, **weights: float) -> Column:
    """Additive penalty (bonuses count negative) by the weights of :func:`judged_penalty`."""
    judged = judged_actions(F.array(action), history, objective, penalty_terms(**weights))
    return F.get(F.transform(judged, lambda item: judged_penalty(item, **weights)), 0)


def structural_distractor_rank(action: Column, history: Column) -> Column:
    return (
        F.when(is_recent_repeat(action, history), 3)
        .when(action.isin("look", "inventory"), 2)
        .when(F.startswith(action, F.lit("examine ")), 1)
        .otherwise(0)
    )
