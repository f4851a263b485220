"""Repair of conversation structure by a shortest path whose weights are single integers.

A repair turns the roles of a conversation into ``(s?(ua)+)?`` (system, user, assistant) by edits: Keep, Rerole, Delete
and Insert. A path through the graph of (row, automaton state, inserts so far) has an integer as its weight: the high digits
are the cost, below them one octal digit per edit, the first edit highest, zeros after the last. Digits ascend with the
letters D, I, K, R, so the least integer is the cheapest repair, and of equally cheap ones the first in ASCII order. Every
decision is a plain minimum of integers.

Rows stream through a task in order of turn. What all open paths agree on is handed out and taken off the weights every
``WINDOW`` rows, so a long conversation needs neither its rows nor its weights at once (unless its end alone decides
between repairs that differ from the start, as in an odd number of turns that each fit either way).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlens.llm.common import ship

WINDOW = 256
BLANKS = " \t\n\x0b\x0c\r"
#: Octal digits of the audit letters, ascending as ASCII does.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = {str(digit): letter for letter, digit in DIGIT.items()}
#: States of (s?(ua)+)?: nothing yet, after the system turn, after a user turn, after an assistant turn.
MOVES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPTED = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
EDITS = (
    "conv_id long, turn long, fault string, role_before string, edit string, cost long, role string, text string"
)


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self):
        if self.insert <= 0 or min(self.keep, self.rerole, self.delete, self.truncated) < 0:
            raise ValueError("inserts must cost something and no edit may cost less than nothing")


def fault_of(text: str, repeated: bool) -> str | None:
    """The first fault of a row: blank, duplicate or truncated."""
    seen = text.rstrip(BLANKS)
    if not seen:
        return "blank"
    if repeated:
        return "duplicate"
    return None if seen[-1] in ".!?" else "truncated"


class Repair:
    """Shortest repair of one conversation whose rows arrive in order as (turn, role, text, fault)."""

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        #: Open paths at a window's edge: (state, inserts) -> (cost, letters not handed out yet).
        self.open: dict[tuple[int, int], tuple[int, str]] = {(0, 0): (0, "")}
        self.rows: list[tuple] = []
        self.waiting: list[tuple] = []
        self.state = 0

    def add(self, row: tuple) -> list[tuple]:
        self.waiting.append(row)
        return self._advance() if len(self.waiting) >= WINDOW else []

    def finish(self) -> list[tuple]:
        return self._advance(last=True)

    def _advance(self, last: bool = False) -> list[tuple]:
        rows, self.waiting = self.waiting, []
        held = max(len(letters) for _, letters in self.open.values())
        # At most two inserts in a row can serve: a third would close a circle.
        width = held + 3 * len(rows) + 2
        paths = {
            key: (cost << 3 * width) + (int("".join(str(DIGIT[x]) for x in letters).ljust(width, "0"), 8))
            for key, (cost, letters) in self.open.items()
        }
        done = {key: len(letters) for key, (_, letters) in self.open.items()}
        # Letters written so far are the rows passed plus the inserts, less what was handed out: one number for all paths.
        start = next(length - inserts for (_, inserts), length in done.items())
        for place, row in enumerate(rows):
            paths = self._step(self._inserts(paths, start + place, width), row, start + place, width)
        if last:
            end = self._inserts(paths, start + len(rows), width)
            (_, inserts), best = min(((key, value) for key, value in end.items() if key[0] in ACCEPTED), key=lambda x: x[1])
            letters = self._letters(best, start + len(rows) + inserts, width)
            self.rows += rows
            return self._hand_out(letters)
        self.open = {
            (state, inserts): (value >> 3 * width, self._letters(value, start + len(rows) + inserts, width))
            for (state, inserts), value in paths.items()
        }
        self.rows += rows
        self._drop_hopeless()
        texts = [letters for _, letters in self.open.values()]
        low, high = min(texts), max(texts)
        agreed = next((at for at, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        if not agreed:
            return []
        self.open = {key: (cost, letters[agreed:]) for key, (cost, letters) in self.open.items()}
        return self._hand_out(low[:agreed])

    @staticmethod
    def _letters(value: int, length: int, width: int) -> str:
        digits = f"{value & ((1 << 3 * width) - 1):o}".rjust(width, "0")[:length]
        return "".join(map(LETTER.__getitem__, digits))

    @staticmethod
    def _least(paths: dict[tuple[int, int], int], width: int) -> dict[tuple[int, int], int]:
        """Per state only the counts of inserts of least cost: what follows costs the same from each."""
        if len(paths) == len({state for state, _ in paths}):
            return paths
        best: dict[int, int] = {}
        for (state, _), value in paths.items():
            best[state] = min(best.get(state, value), value)
        return {key: value for key, value in paths.items() if value >> 3 * width == best[key[0]] >> 3 * width}

    def _drop_hopeless(self) -> None:
        """Leave out paths that cost more than another one that could still follow them at its own expense."""
        insert, delete = self.costs.insert, self.costs.delete
        # What it takes at most to go on from one state as from another: inserts, or deleting the system turn.
        detours = {
            (3, 2): insert, (2, 3): insert, (0, 2): insert, (0, 3): 2 * insert, (1, 2): insert, (1, 3): 2 * insert, (3, 0): delete,
            (2, 0): insert + delete, (3, 1): 0, (2, 1): insert, (0, 1): 0, (1, 0): 2 * insert + delete,
        }
        cheapest: dict[int, int] = {}
        for (state, _), (cost, _) in self.open.items():
            cheapest[state] = min(cheapest.get(state, cost), cost)
        self.open = {
            (state, inserts): (cost, letters) for (state, inserts), (cost, letters) in self.open.items()
            if all(cost <= other + detours[at, state] for at, other in cheapest.items() if at != state)
        }

    def _inserts(self, paths: dict, place: int, width: int) -> dict:
        out, fresh = dict(paths), paths
        for _ in range(2):
            more: dict[tuple[int, int], int] = {}
            for (state, inserts), value in fresh.items():
                weight = (self.costs.insert << 3 * width) + (DIGIT["I"] << 3 * (width - 1 - place - inserts))
                for symbol in ROLES:
                    if symbol in MOVES[state]:
                        key = (MOVES[state][symbol], inserts + 1)
                        more[key] = min(more.get(key, value + weight), value + weight)
            for key, value in more.items():
                out[key] = min(out.get(key, value), value)
            fresh = more
        return self._least(out, width)

    def _step(self, paths: dict, row: tuple, place: int, width: int) -> dict:
        _, role, _, fault = row
        extra = self.costs.truncated if fault == "truncated" else 0
        out: dict[tuple[int, int], int] = {}

        def offer(state: int, inserts: int, value: int, cost: int, letter: str) -> None:
            value += (cost << 3 * width) + (DIGIT[letter] << 3 * (width - 1 - place - inserts))
            out[state, inserts] = min(out.get((state, inserts), value), value)

        for (state, inserts), value in paths.items():
            offer(state, inserts, value, self.costs.delete, "D")
            if fault in ("blank", "duplicate"):
                continue
            if role[:1] in MOVES[state]:
                offer(MOVES[state][role[:1]], inserts, value, self.costs.keep + extra, "K")
            for symbol in ROLES:
                if symbol in MOVES[state]:
                    offer(MOVES[state][symbol], inserts, value, self.costs.rerole + extra, "R")
        return self._least(out, width)

    def _hand_out(self, letters: str) -> list[tuple]:
        """Edits as (turn, fault, role before, letter, cost, role, text); the letters alone fix every new role."""
        out, used, costs = [], 0, self.costs
        for letter in letters:
            if letter == "I":
                symbol = "a" if self.state == 2 else "u"
                self.state = MOVES[self.state][symbol]
                out.append((None, None, None, "I", costs.insert, ROLES[symbol], ""))
                continue
            turn, role, text, fault = self.rows[used]
            used += 1
            if letter == "D":
                out.append((turn, fault, role, "D", costs.delete, None, None))
                continue
            symbol = role[:1] if letter == "K" else "a" if self.state == 2 else "u"
            self.state = MOVES[self.state][symbol]
            cost = (costs.keep if letter == "K" else costs.rerole) + (costs.truncated if fault == "truncated" else 0)
            out.append((turn, fault, role, letter, cost, role if letter == "K" else ROLES[symbol], text))
        del self.rows[:used]
        return out


def _schema(kinds: str) -> pa.Schema:
    types = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, types[kind]) for name, kind in (field.split(" ") for field in kinds.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _edits(costs: Costs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(EDITS)
        current, repair, any_row = object(), None, False

        def close() -> list[tuple]:
            if repair is None:
                return []
            found = [(current, *edit) for edit in repair.finish()]
            # A conversation that lost all its rows still shows up once.
            return found if found or any_row else [(current, *[None] * 7)]

        for batch in batches:
            out: list[tuple] = []
            for conv, turn, role, text, gone, repeated in zip(*(column.to_pylist() for column in batch.columns)):
                if conv != current:
                    out += close()
                    current, repair, any_row = conv, Repair(costs), False
                if not gone:
                    any_row = True
                    out += [(conv, *edit) for edit in repair.add((turn, role, text, fault_of(text, repeated)))]
            yield _batch(out, schema)
        yield _batch(close(), schema)

    return run


def repaired(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per edit, in order: conv_id, turn, fault, role_before, edit, cost, role, text.

    ``turns`` has conv_id, turn, role, text and optionally ``gone``: such a row only keeps its conversation's id alive. A
    null role or text counts as one space, null ids are one conversation, null turns come first, rows of one turn go by role
    and text. Deleted rows have no role and text, inserted ones no turn; a conversation without rows gives one row without
    an edit. An empty role, or one of another initial, cannot stay. An empty table gives an empty table.

    Repeats are found over (conv_id, role, text) and so spread even where one conversation holds most rows; after that
    a conversation's rows pass through one task in order, without being held.
    """
    ship(turns.sparkSession)
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in turns.columns else F.lit(False)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"),
    )
    copies = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("repeated", F.row_number().over(copies) > 1)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "repeated")
    return rows.mapInArrow(_edits(costs), EDITS)


SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


class _Summary:
    def __init__(self, conv: int | None):
        self.conv = conv
        self.low = self.high = self.before = None
        self.turns = self.illegal = self.cost = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.audit: list[str] = []
        self.digest, self.any = hashlib.sha256(), False

    def add(self, turn, fault, role_before, edit, cost, role, text) -> None:
        if edit is None:
            return
        self.audit.append(edit)
        self.cost += cost
        if edit != "I":
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high, self.turns = turn, self.turns + 1
            if fault:
                self.faults[fault] += 1
            if self.before is not None and self.before + role_before[:1] not in LEGAL:
                self.illegal += 1
            self.before = role_before[:1]
        if edit != "D":
            line = f"{role}:{text}"
            self.digest.update((f"\n{line}" if self.any else line).encode())
            self.any = True

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (
            self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest(),
        )


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, open_one = _schema(SUMMARY), None
    for batch in batches:
        out = []
        for conv, *edit in zip(*(column.to_pylist() for column in batch.columns)):
            if open_one is None or open_one.conv != conv:
                if open_one is not None:
                    out.append(open_one.row())
                open_one = _Summary(conv)
            open_one.add(*edit)
        yield _batch(out, schema)
    yield _batch([] if open_one is None else [open_one.row()], schema)


def summaries(edits: DataFrame) -> DataFrame:
    """Per conversation of :func:`repaired`, whose order it relies on: gaps, faults, illegal neighbours, cost, audit, digest."""
    return edits.mapInArrow(_summaries, SUMMARY)


def _text_or_space(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Damage by crc32 of ``conv_id:turn`` modulo 20; a dropped row stays as ``gone`` without role and text."""
    fate = F.crc32(F.concat(_text_or_space(F.col("conv_id")), F.lit(":"), _text_or_space(F.col("turn"))).cast("binary")) % 20
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        fate.alias("fate"),
    )
    text = F.when(F.col("fate").isin(0, 1), "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 0, "").when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") == 0).alias("gone"), F.explode(times).alias("copy"),
    ).drop("copy")
