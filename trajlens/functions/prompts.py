"""Column expressions that render a decision as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajlens.functions.actions import last_items


def _numbered(candidates: Column) -> Column:
    return F.array_join(
        F.transform(candidates, lambda a, i: F.concat((i + 1).cast("string"), F.lit(". "), a)), "\n"
    )


def _recent(history: Column, limit: int, empty: str) -> Column:
    text = F.array_join(last_items(history, limit), "\n")
    return F.when(F.size(history) > 0, text).otherwise(F.lit(empty))


def context_text(
    task_id: Column, history: Column, candidates: Column, initial: Column | None = None,
    observation: Column | None = None, max_history: int = 8, max_observation_chars: int = 0,
) -> Column:
    """State text of a decision: recent actions, numbered candidates and, when a length is given, excerpts."""
    parts = [F.concat(F.lit("Task: "), task_id)]
    if max_observation_chars > 0:
        for head, text in (("Objective/state excerpt", initial), ("Current observation excerpt", observation)):
            if text is not None:
                excerpt = F.substring(F.coalesce(text, F.lit("")), 1, max_observation_chars)
                parts.append(F.when(F.length(excerpt) > 0, F.concat(F.lit(f"{head}:\n"), excerpt)))
    parts.append(F.concat(F.lit("Recent executed actions:\n"), _recent(history, max_history, "<none>")))
    parts.append(F.concat(F.lit("Logged candidates:\n"), _numbered(candidates)))
    return F.concat_ws("\n\n", *parts)


def joint_text(context: Column, action: Column) -> Column:
    return F.concat(F.lit("Text-game decision state\n"), context, F.lit("\n\nProposed action: "), action)


# Fixed format: the layout of the two model requests.
def _request_head(task_id: Column, step_index: Column, initial: Column, observation: Column, history: Column) -> list[Column]:
    start = F.coalesce(F.nullif(initial, F.lit("")), observation)
    return [
        F.concat(F.lit("Task: "), task_id, F.lit("\nStep: "), step_index.cast("string"),
                 F.lit("\nInitial observation and objective:\n"), start),
        F.concat(F.lit("Recent action history:\n"), _recent(history, 12, "<empty>")),
    ]


def _bulleted(actions: Column) -> Column:
    return F.array_join(F.transform(actions, lambda a: F.concat(F.lit("- "), a)), "\n")


def candidate_request(
    task_id: Column, step_index: Column, initial: Column, observation: Column, history: Column, admissible: Column,
    limit: int,
) -> Column:
    return F.concat_ws(
        "\n\n",
        *_request_head(task_id, step_index, initial, observation, history),
        F.concat(F.lit("Observation:\n"), observation),
        F.concat(F.lit("Admissible actions:\n"), _bulleted(admissible)),
        F.lit(f"Return up to {limit} candidate actions as JSON."),
    )


def verification_request(
    task_id: Column, step_index: Column, initial: Column, observation: Column, history: Column, candidates: Column,
    raw: Column, proposed: Column,
) -> Column:
    return F.concat_ws(
        "\n\n",
        *_request_head(task_id, step_index, initial, observation, history),
        F.concat(F.lit("Current observation:\n"), observation),
        F.concat(F.lit("Logged candidate list:\n"), _bulleted(candidates)),
        F.concat(F.lit("RAW action: "), raw, F.lit("\nPROPOSED action: "), proposed),
        F.lit("Choose whether to keep RAW or execute PROPOSED."),
    )
