"""Prefix trie of conversations by union-find over the common prefixes of sorted neighbours.

Equal conversations are first made one sequence with a count, so copies of any number are one row. Sequences are sorted
over range partitions. Inside one, the length of the common prefix of each two neighbours is an edge; edges are taken in
descending depth, each joins the components on its two sides, and what becomes one component at a depth is a branching
node. The chain above it up to the next join has the same members. All figures of a node are sums over its sequences.

Only nodes on the paths of a partition's first and last sequence can reach into another partition. These are kept
apart with partial sums (the contracted forest), corrected by the common prefix across the boundary, and added up by node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlens.llm.common import keep, ship

#: Bytes of one turn in a path.
TURN = 16
ID_BLOCK_BITS = 12
NO_ENDS = hashlib.sha256(b"").hexdigest()
_PARTS = (
    "part int, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, spent long, fresh long, "
    "above long, ends string, at_left boolean, at_right boolean, node_key binary, parent_key binary, first_path binary, "
    "first_sums array<long>, last_path binary"
)

def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, turn_key, chars``: place from 1, a 128-bit digest of (role, text), code points of the text.

    Null turns come first, rows of one turn go by role and text, a null role or text is empty. Rows without an id
    belong to no conversation.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    return rows.withColumn("place", F.row_number().over(order)).select(
        "conv_id", "place", digest.alias("turn_key"), F.length("text").cast("long").alias("chars")
    )


def gathered(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: a conversation's turns in order, 28 bytes a turn; texts stay behind."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "turn_key", "chars"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the first h turns of conversation c - c % 100, then c's own after its first h; h = crc32(c) % 6."""
    own = keep(gathered(ordered_turns(conversations)))
    heads = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("head"), F.slice("turns", 1, 5).alias("head_turns"))
    size = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    empty = F.array().cast(own.schema["turns"].dataType)
    rows = own.withColumn("head", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", size)
    return rows.join(heads, "head", "left").select(
        "conv_id",
        F.concat(
            F.slice(F.coalesce("head_turns", empty), F.lit(1), F.col("h")),
            F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))),
        ).alias("turns"),
    )


def distinct_sequences(conversations: DataFrame) -> DataFrame:
    """``path, chars, n, conv_id, ends`` of each distinct sequence of conv_id, turns: count, least id, digest of all ids."""
    rows = conversations.select(
        "conv_id", F.transform("turns", lambda turn: turn["chars"]).alias("chars"),
        F.array_join(F.transform("turns", lambda turn: F.hex(turn["turn_key"])), "").alias("hex"),
    ).select("conv_id", "chars", F.unhex("hex").alias("path"), F.md5(F.col("hex").cast("binary")).alias("key"))
    rows = keep(rows)
    # Ids in blocks of numbers, so that the last step of a group of any size reads few rows.
    blocks = rows.groupBy("key", F.shiftright("conv_id", ID_BLOCK_BITS).alias("block")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids")
    ).repartition("key").sortWithinPartitions("key", "block")
    ends = blocks.mapInArrow(_ends, "key string, ends string")
    groups = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.any_value("path").alias("path"),
        F.any_value("chars").alias("chars"),
    )
    return groups.join(ends, "key").select("path", "chars", "n", "conv_id", "ends")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the joined ids of each key; rows come in order of key and block."""
    current, digest = None, None
    for batch in batches:
        out = []
        for key, _, ids in zip(*(column.to_pylist() for column in batch.columns)):
            if key != current:
                if digest is not None:
                    out.append((current, digest.hexdigest()))
                current, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield _pairs(out)
    yield _pairs([] if digest is None else [(current, digest.hexdigest())])


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    keys, ends = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ends, pa.string())], ["key", "ends"])


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * TURN : middle * TURN] == b[low * TURN : middle * TURN]:
            low = middle
        else:
            high = middle - 1
    return low


class Forest:
    """Components of consecutive sequences; the root of each holds the sums of its members."""

    def __init__(self, paths: list[bytes], sums: list[np.ndarray], n: list[int], ids: list[int]):
        size = len(paths)
        self.sums = sums
        self.lengths = [len(path) // TURN for path in paths]
        self.common = [0] + [common_turns(a, b) for a, b in zip(paths, paths[1:])]
        self.up = list(range(size))
        self.first, self.last = list(range(size)), list(range(size))
        self.n, self.least = list(n), list(ids)
        self.spent = [count * int(total[-1]) for count, total in zip(n, sums)]
        # What a component's first sequence adds depends on the node, so it is left out here.
        self.fresh, self.branches = [0] * size, [0] * size
        # Whether the last sequence is a leaf depends on the next partition.
        self.leaves = [int(self.common[place + 1] < self.lengths[place]) for place in range(size - 1)] + [0]
        self.depth = list(self.lengths)
        #: Closed chains: [root's figures at closing, depth, depth of the node above, least id of the node above].
        self.closed: list[list] = []
        self.orphans: list[list[int]] = [[] for _ in range(size)]

    def find(self, place: int) -> int:
        while self.up[place] != place:
            self.up[place] = self.up[self.up[place]]
            place = self.up[place]
        return place

    def fresh_below(self, place: int, known: int) -> int:
        """Code points of the nodes that a sequence has below a depth."""
        return int(self.sums[place][-1] - self.sums[place][known])

    def _close(self, root: int, above: int) -> None:
        for chain in self.orphans[root]:
            self.closed[chain][3] = self.least[root]
        figures = (
            self.first[root], self.last[root], self.least[root], self.n[root], self.branches[root], self.leaves[root],
            self.spent[root], self.fresh[root],
        )
        self.orphans[root] = [len(self.closed)]
        self.closed.append([figures, self.depth[root], above, None])

    def grow(self) -> list[list]:
        """Join over the edges in descending depth and return the closed chains."""
        size = len(self.up)
        for place in sorted(range(1, size), key=lambda place: -self.common[place]):
            depth = self.common[place]
            left, right = self.find(place - 1), self.find(place)
            branches = 1
            for side in (left, right):
                if self.depth[side] > depth:
                    self._close(side, depth)
                else:
                    branches += self.branches[side]
            self.fresh[left] += self.fresh[right] + self.fresh_below(self.first[right], depth)
            self.up[right], self.last[left] = left, self.last[right]
            self.n[left] += self.n[right]
            self.least[left] = min(self.least[left], self.least[right])
            self.spent[left] += self.spent[right]
            self.leaves[left] += self.leaves[right]
            self.orphans[left] += self.orphans[right]
            self.orphans[right] = []
            self.branches[left], self.depth[left] = branches, depth
        if size:
            self._close(self.find(0), -1)
        return self.closed


def _rows_of(part: int, columns: dict[str, list]) -> Iterator[tuple]:
    """Nodes of one partition: final ones, and partial ones on the paths of its first and last sequence."""
    paths = columns["path"]
    sums = [np.concatenate([[0], np.cumsum(np.array(chars, np.int64))]) for chars in columns["chars"]]
    forest = Forest(paths, sums, columns["n"], columns["conv_id"])
    size = len(paths)
    # Depth to which each sequence agrees with the first and with the last one.
    with_first = np.minimum.accumulate(np.array([forest.lengths[0], *forest.common[1:]]))
    with_last = np.minimum.accumulate(np.array([*forest.common[1:], forest.lengths[-1]])[::-1])[::-1]
    for (first, last, least, n, branches, leaves, spent, fresh), depth, above, parent in forest.grow():
        path, total = paths[first], sums[first]
        for level in range(depth, above, -1):
            at_left, at_right = first == 0, last == size - 1
            known = max(level - 1, 0)
            edge = level > 0 and (with_first[first] >= level - 1 or with_last[first] >= level - 1)
            yield (
                part, level, least, None if level == 0 or edge else least if level - 1 > above else parent, n,
                (branches if level == depth else 0) + (0 if at_left else int(forest.lengths[first] > level)), leaves, spent,
                fresh + (0 if at_left else forest.fresh_below(first, known)), int(total[known]),
                columns["ends"][first] if forest.lengths[first] == level else None, at_left, at_right,
                hashlib.md5(path[: level * TURN]).digest() if at_left or at_right else None,
                hashlib.md5(path[: (level - 1) * TURN]).digest() if edge else None, None, None, None,
            )
    yield (part, *[None] * 14, paths[0], sums[0].tolist(), paths[-1])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = list(batches)
    schema = pa.schema([
        *[(name, pa.int32()) for name in ("part", "depth")],
        *[(name, pa.int64()) for name in (
            "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "spent", "fresh", "above"
        )],
        ("ends", pa.string()), ("at_left", pa.bool_()), ("at_right", pa.bool_()), ("node_key", pa.binary()),
        ("parent_key", pa.binary()), ("first_path", pa.binary()), ("first_sums", pa.list_(pa.int64())),
        ("last_path", pa.binary()),
    ])
    if not sum(batch.num_rows for batch in batches):
        return
    table = pa.Table.from_batches(batches)
    columns = {name: table.column(name).to_pylist() for name in table.column_names}
    rows = _rows_of(TaskContext.get().partitionId(), columns)
    while chunk := list(islice(rows, 8192)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*chunk), schema)], schema=schema)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: depth shared with the partition before, its first sequence's figures, whether its last one is a leaf."""
    rows, before = [], None
    for batch in batches:
        for part, first, sums, last in zip(*(column.to_pylist() for column in batch.columns)):
            shared = -1 if before is None else common_turns(before, first)
            if rows:
                rows[-1][-1] = int(shared < len(before) // TURN)
            rows.append([part, shared, sums[max(shared, 0)], sums[-1], len(sums) - 1, 1])
            before = last
    names = ["part", "shared", "shared_chars", "first_chars", "first_length", "last_leaf"]
    columns = list(zip(*rows)) if rows else [()] * 6
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names)


def trie(members: DataFrame, turns_per_task: int = 50_000) -> DataFrame:
    """All nodes of the prefix trie of ``conv_id, turns`` (turns: array of place, turn_key, chars), one row each.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. The root has depth
    0 and no parent. An empty table has no nodes. A task holds about ``turns_per_task`` turns of distinct sequences; a single
    sequence is not divided (28 bytes a turn).
    """
    ship(members.sparkSession)
    groups = keep(distinct_sequences(members))
    turns = groups.agg(F.sum(F.size("chars"))).first()[0] or 0
    ordered = groups.repartitionByRange(1 + turns // turns_per_task, "path").sortWithinPartitions("path")
    found = keep(ordered.mapInArrow(_parts, _PARTS))
    # One row per partition of the sort.
    borders = found.where("depth is null").select("part", "first_path", "first_sums", "last_path").repartition(1)
    borders = borders.sortWithinPartitions("part").mapInArrow(
        _borders, "part int, shared int, shared_chars long, first_chars long, first_length int, last_leaf long"
    )
    nodes = found.where("depth is not null").drop("first_path", "first_sums", "last_path")
    joined = F.col("shared") >= F.col("depth")
    partial = keep(nodes.where("at_left or at_right").join(borders, "part").select(
        "part", "depth", "conv_id", "n_convs", "spent", "above", "ends", "node_key", "parent_key",
        (F.col("n_children") + F.when(~F.col("at_left"), 0).when(joined, (F.col("shared") == F.col("depth")).cast("int"))
         .otherwise((F.col("first_length") > F.col("depth")).cast("int"))).alias("n_children"),
        (F.col("n_leaves") + F.when(F.col("at_right"), F.col("last_leaf")).otherwise(0)).alias("n_leaves"),
        (F.col("fresh") + F.when(~F.col("at_left"), 0).when(joined, F.col("first_chars") - F.col("shared_chars"))
         .otherwise(F.col("first_chars") - F.col("above"))).alias("fresh"),
    ))
    merged = keep(partial.groupBy("node_key").agg(
        F.min("conv_id").alias("conv_id"), *[F.any_value(name).alias(name) for name in ("depth", "above", "parent_key")],
        *[F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "spent", "fresh")], F.max("ends").alias("ends"),
    ))
    # Partial nodes are named once per partition, so that the children of a node with many join in their own partition's name.
    names = partial.select("part", "node_key").join(merged.select("node_key", F.col("conv_id").alias("named")), "node_key")
    inner = nodes.where("not (at_left or at_right)")
    inner = inner.where("parent_key is null").unionByName(
        inner.where("parent_key is not null").drop("parent_conv_id").join(
            names.withColumnsRenamed({"node_key": "parent_key", "named": "parent_conv_id"}), ["part", "parent_key"]
        ).select(inner.columns)
    )
    tops = merged.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    outer = merged.join(tops, "parent_key", "left")
    saved = F.col("spent") - F.col("n_convs") * F.col("above") - F.col("fresh")
    figures = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves"]
    return inner.select(*figures, "spent", "above", "fresh", "ends").unionByName(
        outer.select(*figures, "spent", "above", "fresh", "ends")
    ).select(
        *[F.col(name).cast("long").alias(name) for name in figures], saved.alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
