"""Token counts of fields by offset-mapped attribution.

The fields of a row are joined by a separator and encoded once. Token character spans are joined with the spans
of the fields (both in text order), and each token is credited to the field it lies in. A token that crosses a
boundary is allocated by rule: ``most`` gives it to the part that holds most of its characters (the first of equals),
``first`` to the part of its first character, ``share`` divides it by characters. Tokens that lie in, or go to, a
separator are counted under the name ``between``. A character whose bytes are spread over tokens belongs to the span
of each.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.llm.common import pieces, ship

SEPARATOR = "\n\n"
BETWEEN = "between"
RULES = ("most", "first", "share")


class RankCoder:
    """Byte-level encoder of a rank file, with the span of each token."""

    def __init__(self, file: bytes, pattern: str):
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines()) if token}
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token, and the one after its last."""
        ids = self.coder.encode_ordinary(text)
        ends = np.cumsum(self.sizes[np.array(ids, np.int64)]) if ids else np.empty(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
        raw = text.encode("utf-8", "replace")
        if len(raw) == len(text):
            return starts, ends
        character = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
        return character[starts], character[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens credited to each part; part k reaches up to character ``cuts[k]``."""
    first = np.searchsorted(cuts, starts, "right")
    last = np.searchsorted(cuts, ends - 1, "right")
    crossing = first != last
    inside = np.bincount(first[~crossing], minlength=len(cuts)).astype(float)
    crossed = np.zeros(len(cuts))
    for token in np.flatnonzero(crossing):
        parts = np.arange(first[token], last[token] + 1)
        low = np.maximum(starts[token], np.concatenate([[0], cuts])[parts])
        held = np.maximum(0, np.minimum(ends[token], cuts[parts]) - low)
        if rule == "share":
            crossed[parts] += held / held.sum()
        else:
            crossed[parts[0] if rule == "first" else parts[int(held.argmax())]] += 1
    return inside + crossed, crossed


_coders: dict[int, RankCoder] = {}


def _count(held, number: int, pattern: str, fields: list[str], rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _coders:
            _coders.clear()
            _coders[number] = RankCoder(held.value, pattern)
        coder = _coders[number]
        for batch in pieces(batches, fields[-1]):
            texts = [batch.column(field).to_pylist() for field in fields]
            names, chars, counts, crossed, rows = [], [], [], [], []
            for row, values in enumerate(zip(*texts, strict=True)):
                values = [value or "" for value in values]
                lengths = [size for value in values for size in (len(value), len(SEPARATOR))][:-1]
                cuts = np.cumsum(lengths)
                found, over = attribute(*coder.spans(SEPARATOR.join(values)), cuts, rule)
                names += [*fields, BETWEEN]
                chars += [len(value) for value in values] + [len(SEPARATOR) * (len(values) - 1)]
                counts += [*found[::2], found[1::2].sum()]
                crossed += [*over[::2], over[1::2].sum()]
                rows += [row] * (len(fields) + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id").take(pa.array(rows, pa.int64())), pa.array(names), pa.array(chars, pa.int64()),
                    pa.array(counts, pa.float64()), pa.array(crossed, pa.float64()),
                ],
                ["_id", "field", "n_chars", "n_tokens", "n_crossing"],
            )

    return run


def field_token_counts(
    docs: DataFrame, path: str, pattern: str, fields: Sequence[tuple[str, Column]], id_column: str = "doc_id", rule: str = "most"
) -> DataFrame:
    """One row per row and field (and ``between``): characters, tokens, and how many of them crossed a boundary.

    Fields are (name, column); null counts as empty. Repeated rows are counted each; ``n_tokens`` is a double because
    ``share`` divides tokens. The longest field should be the last: batches are cut by its length.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(docs.sparkSession)
    with open(path, "rb") as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_column).alias("_id"), *[column.cast("string").alias(f"f_{name}") for name, column in fields])
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(
        _count(held, held._jbroadcast.id(), pattern, [f"f_{name}" for name, _ in fields], rule),
        f"_id {kind}, field string, n_chars long, n_tokens double, n_crossing double",
    )
    return out.withColumn("field", F.regexp_replace("field", "^f_", "")).withColumnRenamed("_id", id_column)
