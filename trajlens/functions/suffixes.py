"""Column expressions over known action plans and suffixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tail(items: Column, start: Column) -> Column:
    """Items from 1-based ``start``."""
    return F.slice(items, start, F.greatest(F.size(items) - start + 1, F.lit(0)))


def remaining_suffix(plan: Column, history: Column) -> Column:
    """Plan left after matching the history greedily as an ordered subsequence."""
    matched = F.aggregate(
        history,
        F.lit(0),
        lambda done, action: done + F.when(F.coalesce(F.get(plan, done) == action, F.lit(False)), 1).otherwise(0),
    )
    return _tail(plan, matched + 1)


def adapt_suffix(suffix: Column, admissible: Column) -> Column:
    """Replace the first action(s) by an admissible equivalent.

    A door opening plus walk, or a walk, becomes a teleport; thermometer, focus and examine phrases fall back
    to their shorter forms. Without an admissible equivalent the suffix stays as it is.
    """
    first, second = F.get(suffix, 0), F.coalesce(F.get(suffix, 1), F.lit(""))

    def target(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(first, pattern, 1), F.lit(""))

    def allowed(action: Column) -> Column:
        return F.when(F.array_contains(admissible, action), action)

    room = target(r"^open door to (.+)$")
    walk = target(r"^go to (.+)$")
    after_door = F.when(
        second == F.concat(F.lit("go to "), room), allowed(F.concat(F.lit("teleport to "), room))
    )
    after_walk = allowed(F.concat(F.lit("teleport to "), walk))
    examined = target(r"^examine (.+)$")
    same = F.coalesce(
        allowed(first),
        allowed(F.concat(F.lit("use thermometer on "), target(r"^use thermometer in inventory on (.+)$"))),
        allowed(F.concat(F.lit("focus on "), target(r"^focus on (.+) in inventory$"))),
        allowed(F.concat(F.lit("look at "), examined)),
        allowed(F.concat(F.lit("look in "), examined)),
    )
    return (
        F.when(F.size(suffix) == 0, suffix)
        .when(after_door.isNotNull(), F.concat(F.array(after_door), _tail(suffix, F.lit(3))))
        .when(after_walk.isNotNull(), F.concat(F.array(after_walk), _tail(suffix, F.lit(2))))
        .when(same.isNotNull(), F.concat(F.array(same), _tail(suffix, F.lit(2))))
        .otherwise(suffix)
    )
