"""Readers, writers and reshaping of trajectory, report, preference and prediction logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlens import schemas as S
from trajlens.functions.spread import ordered_index
from trajlens.functions.tasks import path_stem, seed_in_name
from trajlens.session import ship_package
from trajlens.sources import located


def read_lines(spark: SparkSession, path: str, multi_line: bool | None = None, split_bytes: int = 64 << 20) -> DataFrame:
    """Log text with ``ord`` and ``source``: one row per line, or one per file with ``multi_line``.

    Folders and compressed files are read line by line. Unless told otherwise, only paths that name ``.json`` files
    are taken for one document per file.
    ``ord`` orders rows by file and byte, so first and last records are well defined; ``source`` names them to a reader.
    """
    whole = path.endswith(".json") if multi_line is None else multi_line
    if whole:
        rows = spark.read.text(path, wholetext=True).select(
            "value", F.struct(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("bigint").alias("place")).alias("ord")
        )
    else:
        ship_package(spark)
        located.register(spark)
        lines = spark.read.format("located_lines").option("path", path).option("split_bytes", split_bytes).load()
        rows = lines.select("value", F.struct("file", "place").alias("ord"))
    return rows.filter(F.trim("value") != "").withColumn("source", F.concat_ws(" at byte ", "ord.file", "ord.place"))


def _source(lines: DataFrame) -> Column:
    return F.col("source") if "source" in lines.columns else F.concat(F.lit("record "), F.to_json(F.struct("ord")))


def _checked(rows: DataFrame, bad: str) -> DataFrame:
    """Rows with ``_problem`` (null if readable), ``_source`` and ``_text`` treated as asked.

    ``raise`` fails the query that reads them, naming the first such record met; ``keep`` returns only them, as source,
    problem and value; ``drop`` leaves them out.
    """
    if bad == "keep":
        return rows.where("_problem is not null").select(
            F.col("_source").alias("source"), F.col("_problem").alias("problem"), F.col("_text").alias("value")
        )
    if bad == "drop":
        return rows.where("_problem is null").drop("_problem", "_source", "_text")
    if bad != "raise":
        raise ValueError(f"unknown treatment of unreadable records: {bad}")
    message = F.concat("_source", F.lit(": "), "_problem", F.lit(": "), F.substring("_text", 1, 200))
    # The test is part of the key that every reader keeps, so no plan can prune it away.
    ok = F.when(F.col("_problem").isNull(), F.col("ord")).otherwise(F.raise_error(message).cast(rows.schema["ord"].dataType))
    return rows.withColumn("ord", ok).where("ord is not null").drop("_problem", "_source", "_text")


def _records(
    lines: DataFrame, plural: str, singular: str, fields: str, marker: str, run_key: str | None, bad: str
) -> DataFrame:
    """Records from a list, ``{plural: [...]}``, ``{singular: {...}}``, a bare record or one nested container.

    Text of another shape is unreadable, also where only one item of a list is, and also where the run asked for is missing.
    """
    record = f"struct<{fields}>"
    text = F.col("value")
    if run_key is not None:
        text = F.try_element_at(F.from_json(text, "map<string,string>"), F.lit(run_key))
    lines = lines.withColumn("_source", _source(lines)).withColumn("_text", F.col("value")).withColumn("value", text)
    shape = f"array<struct<{plural}:array<{record}>,{singular}:{record},{fields}>>"
    parsed = lines.withColumn("docs", F.from_json("value", shape))

    def bare(doc: Column) -> Column:
        return doc["task_id"].isNotNull() & doc[marker].isNotNull()

    def records_of(doc: Column) -> Column:
        return (
            F.when(doc[plural].isNotNull(), doc[plural])
            .when(doc[singular].isNotNull(), F.array(doc[singular]))
            .when(bare(doc), F.array(F.struct(*[doc[name].alias(name) for name in _names(fields)])))
            .otherwise(F.array().cast(f"array<{record}>"))
        )

    known = F.coalesce(
        F.forall("docs", lambda doc: F.coalesce(doc[plural].isNotNull() | doc[singular].isNotNull() | bare(doc), F.lit(False))), F.lit(False)
    )
    found = F.coalesce(F.flatten(F.transform("docs", records_of)), F.array().cast(f"array<{record}>"))
    containers = F.filter(
        F.transform(
            F.map_values(F.from_json("value", "map<string,string>")),
            lambda inner: F.from_json(inner, f"struct<{plural}:array<{record}>>")[plural],
        ),
        lambda inner: inner.isNotNull(),
    )
    # The container shape is only parsed for documents in which nothing else was found.
    nested = F.when(~known & (F.size(containers) == 1), F.get(containers, 0))
    rows = parsed.withColumn("_nested", nested).withColumn("_records", F.when(known, found).otherwise(F.col("_nested"))).select(
        "ord", "_source", "_text", F.when(F.col("_records").isNull(), F.lit(f"no {plural} found")).alias("_problem"),
        # An empty list has no rows, an unreadable record has one without a record.
        F.posexplode(F.coalesce("_records", F.array(F.lit(None).cast(record)))).alias("pos", "record"),
    )
    checked = _checked(rows, bad)
    return checked if bad == "keep" else checked.select(F.struct("ord", "pos").alias("ord"), "record.*")


def _names(fields: str) -> list[str]:
    names, depth, start = [], 0, 0
    for place, sign in enumerate(fields + ","):
        depth += (sign == "<") - (sign == ">")
        if sign == "," and depth == 0:
            names.append(fields[start:place].split(":", 1)[0].strip())
            start = place + 1
    return names


def parse_trajectories(lines: DataFrame, run_key: str | None = None, bad: str = "raise") -> DataFrame:
    """Trajectories from log text (columns ``value`` and ``ord``); ``bad`` as in :func:`_checked`."""
    rows = _records(lines, "episodes", "episode", S.TRAJECTORY_FIELDS, "steps", run_key, bad)
    if bad == "keep":
        return rows
    seed = F.coalesce("seed", F.lit(0).cast("bigint"))
    fallback = F.concat(path_stem(F.col("task_id")), F.lit(":seed"), seed.cast("string"))
    return (
        rows.withColumn("trajectory_id", F.coalesce(F.nullif("trajectory_id", F.lit("")), fallback))
        .withColumn("seed", seed)
        .withColumn("success", F.coalesce("success", F.lit(False)))
        .withColumn("steps", F.coalesce("steps", F.array().cast(f"array<{S.STEP}>")))
    )


def read_trajectories(spark: SparkSession, path: str, run_key: str | None = None, bad: str = "raise") -> DataFrame:
    """Trajectories of files. Unreadable records stop the query; ``bad="keep"`` lists them, ``bad="drop"`` passes over them."""
    return parse_trajectories(read_lines(spark, path), run_key, bad)


def explode_steps(trajectories: DataFrame) -> DataFrame:
    """One row per step with the history before it.

    Everything comes from the trajectory's own array, so there is neither a shuffle nor a window.
    ``step_index`` falls back to the length of the history.
    """
    actions = F.transform("steps", lambda step: F.coalesce(step["action"], F.lit("")))
    keep = [name for name in trajectories.columns if name != "steps"]
    rows = trajectories.select(*keep, actions.alias("_actions"), F.posexplode("steps").alias("pos", "step"))
    history = F.filter(F.slice("_actions", F.lit(1), F.col("pos")), lambda action: action != "")
    rows = rows.withColumn("history", history)
    return rows.select(
        *keep,
        "pos",
        F.coalesce("step.step_index", F.size("history")).alias("step_index"),
        F.coalesce("step.action", F.lit("")).alias("action"),
        F.col("step.candidates_before").alias("candidates_before"),
        F.col("step.candidates").alias("candidates"),
        F.col("step.gold_action").alias("gold_action"),
        F.col("step.valid").alias("valid"),
        F.col("step.reward").alias("reward"),
        F.col("step.done").alias("done"),
        "history",
    )


def parse_reports(lines: DataFrame, bad: str = "raise") -> DataFrame:
    rows = _records(lines, "reports", "report", S.REPORT_FIELDS, "edits", None, bad)
    if bad == "keep":
        return rows
    return rows.withColumn("seed", F.coalesce("seed", F.lit(0).cast("bigint"))).withColumn(
        "original_success", F.coalesce("original_success", F.lit(False))
    )


def read_reports(spark: SparkSession, path: str, bad: str = "raise") -> DataFrame:
    return parse_reports(read_lines(spark, path), bad)


def report_edits(reports: DataFrame) -> DataFrame:
    """Edits of the last report per (task, seed), ready for repair selection."""
    rows = reports.groupBy("task_id", "seed").agg(
        F.max_by(F.struct("original_actions", "original_success", "edits"), "ord").alias("r")
    )
    return rows.select(
        "task_id", "seed", F.coalesce(F.size("r.original_actions"), F.lit(0)).alias("original_len"),
        F.col("r.original_success").alias("original_success"), F.posexplode("r.edits").alias("edit_pos", "e"),
    ).select(
        "task_id", "seed", "original_success", F.greatest("original_len", F.lit(0)).alias("original_len"), "edit_pos",
        "e.edit_type", F.coalesce("e.index", F.lit(-1)).alias("index"), "e.action",
        F.coalesce("e.labels", F.array().cast("array<string>")).alias("labels"), "e.replacement",
        F.coalesce("e.repair_suffix", F.array().cast("array<string>")).alias("repair_suffix"),
        F.coalesce(F.size("e.edited_actions"), F.lit(0)).alias("edited_len"), "e.success",
        "e.second_index", "e.second_action",
    ).withColumn("edited_len", F.greatest("edited_len", F.lit(0)))


def parse_scores(text: Column) -> Column:
    """Scores as a map, from a JSON object or a JSON list of {action, score}."""
    listed = F.from_json(text, "array<struct<action:string,score:double>>")
    pairs = F.filter(listed, lambda item: item["action"].isNotNull() & item["score"].isNotNull())
    # A later entry for the same action wins.
    last = F.filter(
        pairs,
        lambda item, i: ~F.array_contains(
            F.transform(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["action"]), item["action"]
        ),
    )
    as_list = F.map_from_entries(
        F.transform(last, lambda item: F.struct(item["action"].alias("key"), item["score"].alias("value")))
    )
    is_list = F.startswith(F.ltrim(text), F.lit("["))
    return F.when(is_list, as_list).otherwise(F.from_json(text, "map<string,double>"))


def _flat_records(lines: DataFrame, fields: str, bad: str) -> DataFrame:
    """One record per line; text that is no JSON object, or one with a field of another type or without a task, is unreadable."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    record = F.from_json("value", f"{fields}, _broken string", options)
    rows = lines.select("ord", _source(lines).alias("_source"), F.col("value").alias("_text"), record.alias("r"))
    problem = F.when(F.col("r").isNull() | F.col("r._broken").isNotNull(), "not a record").when(F.col("r.task_id").isNull(), "no task_id")
    checked = _checked(rows.withColumn("_problem", problem), bad)
    return checked if bad == "keep" else checked.select("ord", "r.*").drop("_broken")


def parse_preferences(lines: DataFrame, bad: str = "raise") -> DataFrame:
    rows = _flat_records(lines, S.PREFERENCE_FIELDS, bad)
    if bad == "keep":
        return rows
    return rows.withColumn("seed", F.coalesce("seed", F.lit(0).cast("bigint"))).withColumn(
        "step_index", F.coalesce("step_index", F.greatest(F.size("history"), F.lit(0)), F.lit(0))
    )


def parse_predictions(lines: DataFrame, bad: str = "raise") -> DataFrame:
    rows = _flat_records(lines, S.PREDICTION_FIELDS, bad)
    if bad == "keep":
        return rows
    text = F.coalesce("scores", "candidate_scores")
    return (
        rows.withColumn("scores", parse_scores(text))
        .withColumn("seed", F.coalesce("seed", F.lit(0).cast("bigint")))
        .withColumn("step_index", F.coalesce("step_index", F.greatest(F.size("history"), F.lit(0)), F.lit(0)))
        .withColumn("abstain", F.coalesce("abstain", "abstained", F.lit(False)))
        .drop("candidate_scores", "abstained", "history")
    )


def read_preferences(spark: SparkSession, path: str, bad: str = "raise") -> DataFrame:
    return parse_preferences(read_lines(spark, path), bad)


def read_predictions(spark: SparkSession, path: str, bad: str = "raise") -> DataFrame:
    return parse_predictions(read_lines(spark, path), bad)


def write_table(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Write a table; a ``split`` column becomes the directory level."""
    writer = df.write.mode(mode)
    if "split" in df.columns:
        writer = writer.partitionBy("split")
    writer.format(fmt).save(path)


# ---------------------------------------------------------------- merging shards

def trajectory_key() -> Column:
    seed = F.coalesce("seed", "rollout_seed", F.lit(0).cast("bigint")).cast("string")
    rollout = F.coalesce("rollout_seed", "seed", F.lit(0).cast("bigint")).cast("string")
    built = F.concat(F.coalesce("task_id", F.lit("")), F.lit(":seed"), seed, F.lit(":rollout"), rollout)
    return F.coalesce(F.nullif("trajectory_id", F.lit("")), built)


def _tagged(sources: dict[str, DataFrame]) -> DataFrame:
    frames = [
        df.withColumn("source", F.lit(name)).withColumn("_source", F.lit(number))
        for number, (name, df) in enumerate(sources.items())
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _has_error() -> Column:
    return F.coalesce(F.col("error"), F.lit("")) != ""


def merge_trajectories(sources: dict[str, DataFrame], include_errors: bool = False, ordered: bool = True) -> DataFrame:
    """Union of shards with the first record per trajectory key, by source order and then ``ord``.

    First-wins is a minimum, so copies of one key meet their partial minimum before the shuffle.
    """
    rows = _tagged(sources)
    if not include_errors:
        rows = rows.filter(~_has_error())
    names = [name for name in rows.columns if name != "_source"]
    first = rows.groupBy(trajectory_key().alias("_key")).agg(
        F.min_by(F.struct(*names), F.struct("_source", "ord")).alias("r")
    )
    out = first.select("r.*")
    if not ordered:
        return out
    return out.orderBy(
        F.coalesce("game_seed", F.lit(10**12)),
        F.coalesce("rollout_seed", "seed", F.lit(0).cast("bigint")),
        F.coalesce("trajectory_id", F.lit("")),
    )


def merge_summary(sources: dict[str, DataFrame], include_errors: bool = False) -> DataFrame:
    """Totals of a merge and the unique records per source, in name=count form."""
    rows = _tagged(sources)
    usable = F.lit(True) if include_errors else ~_has_error()
    value = F.struct(
        "source", F.coalesce("success", F.lit(False)).alias("success"), _has_error().alias("failed"),
        F.greatest(F.size("steps"), F.lit(0)).alias("steps"),
    )
    per_key = rows.groupBy(trajectory_key().alias("_key")).agg(
        F.min_by(F.when(usable, value), F.when(usable, F.struct("_source", "ord"))).alias("r"),
        F.count_if(usable).alias("usable"),
        F.count_if(~usable).alias("skipped"),
    )
    kept = F.col("usable") > 0
    counts = F.map_from_arrays(
        F.array(*[F.lit(name) for name in sources]),
        F.array(*[F.count_if(kept & (F.col("r.source") == name)) for name in sources]),
    )
    return per_key.agg(
        F.count_if(kept).alias("written_trajectories"),
        F.count_if(kept & F.col("r.success")).alias("successful_trajectories"),
        F.count_if(kept & ~F.col("r.success")).alias("failed_trajectories"),
        F.count_if(kept & F.col("r.failed")).alias("errored_trajectories"),
        F.coalesce(F.sum(F.when(kept, F.col("r.steps"))), F.lit(0)).alias("total_steps"),
        F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped_error_records"),
        F.coalesce(F.sum(F.greatest(F.col("usable") - 1, F.lit(0))), F.lit(0)).alias("duplicate_records"),
        counts.alias("source_counts_unique"),
    )


# ---------------------------------------------------------------- model answers

def parse_candidate_responses(responses: DataFrame) -> DataFrame:
    """Admissible actions named in a JSON answer, in order and without repeats; empty for anything else.

    ``responses`` has ``response`` (text) and ``admissible`` (array).
    """
    text = F.col("response")
    shape = F.from_json(text, "struct<actions:array<string>,candidate_actions:array<string>>")
    plain = F.from_json(text, "array<string>")
    none = F.array().cast("array<string>")
    listed = F.startswith(F.ltrim(text), F.lit("["))
    raw = F.when(listed, plain).otherwise(
        F.when(F.size(shape["actions"]) > 0, shape["actions"]).otherwise(shape["candidate_actions"])
    )
    named = F.transform(F.coalesce(raw, none), lambda action: F.regexp_replace(action, r"(?U)^\s+|\s+$", ""))
    return responses.withColumn(
        "actions", F.array_distinct(F.filter(named, lambda action: F.array_contains("admissible", action)))
    )


def parse_choice_responses(responses: DataFrame) -> DataFrame:
    """``proposed`` when the answer (or its ``choice`` field) says so, else ``raw``."""
    fields = F.from_json("response", "map<string,string>")
    said = F.when(fields.isNotNull(), F.coalesce(F.try_element_at(fields, F.lit("choice")), F.lit(""))).otherwise(
        F.col("response")
    )
    return responses.withColumn(
        "choice", F.when(F.contains(F.lower(said), F.lit("proposed")), "proposed").otherwise("raw")
    )


# The fields that make two model requests identical.
CANDIDATE_REQUEST_KEY = (
    "task_id", "seed", "step_index", "history", "observation", "admissible_actions", "model", "temperature",
    "max_candidates", "system_prompt",
)
VERIFIER_REQUEST_KEY = (
    "task_id", "seed", "step_index", "history", "observation", "candidates", "raw_action", "proposed_action",
    "model", "temperature", "system_prompt",
)


def dedupe_requests(requests: DataFrame, kind: str = "candidates") -> DataFrame:
    """One row per distinct request with its key hash and how many requests it answers."""
    fields = {"candidates": CANDIDATE_REQUEST_KEY, "verifier": VERIFIER_REQUEST_KEY}[kind]
    known = [name for name in fields if name in requests.columns]
    key = F.sha2(F.to_json(F.struct(*known), {"ignoreNullFields": "false"}), 256)
    return requests.groupBy(key.alias("request_key")).agg(
        F.min(F.struct(*known)).alias("r"), F.count(F.lit(1)).alias("requests")
    ).select("request_key", "requests", "r.*")


# ---------------------------------------------------------------- task catalogue and collection

def select_tasks(
    catalog: DataFrame, min_seed: int | None = None, max_seed: int | None = None, count: int | None = None
) -> DataFrame:
    """Tasks in name order within a seed range; the first ``count`` of them. Nothing left is an error."""
    seed = F.nullif(seed_in_name(F.col("task_id")), F.lit(0).cast("bigint"))
    rows = catalog
    if min_seed is not None:
        rows = rows.filter(F.coalesce(seed, F.lit(-1)) >= min_seed)
    if max_seed is not None:
        rows = rows.filter(F.coalesce(seed, F.lit(10**12)) <= max_seed)
    rows = rows.orderBy("task_id")
    if count is not None:
        rows = rows.limit(count)
    if rows.isEmpty():
        raise ValueError("no tasks matched the selection")
    return rows


def rollout_worklist(catalog: DataFrame, rollouts: int, seed_start: int = 0, agent_seed: int = 0) -> DataFrame:
    """Task × rollout rows; the agent seed counts through tasks in name order."""
    placed = ordered_index(catalog.select("task_id"), "task_id", "task_index")
    return placed.select(
        "task_id",
        "task_index",
        F.explode(F.sequence(F.lit(0), F.lit(rollouts - 1))).alias("rollout_index"),
    ).select(
        "task_id",
        "rollout_index",
        (F.col("rollout_index") + seed_start).alias("rollout_seed"),
        (F.lit(agent_seed) + F.col("task_index") * rollouts + F.col("rollout_index")).alias("agent_seed"),
    )


def collection_summary(
    trajectories: DataFrame, include_successes: bool = True, write_errors: bool = True
) -> DataFrame:
    """Counts of attempted, written, failed, successful and errored trajectories."""
    won = F.coalesce("success", F.lit(False))
    written = (F.lit(include_successes) | ~won) & (F.lit(write_errors) | ~_has_error())
    return trajectories.agg(
        F.count(F.lit(1)).alias("attempted_trajectories"),
        F.count_if(written).alias("written_trajectories"),
        F.count_if(written & ~won).alias("failed_trajectories"),
        F.count_if(written & won).alias("successful_trajectories"),
        F.count_if(_has_error()).alias("errored_trajectories"),
    )
