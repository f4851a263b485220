"""N-gram Jaccard join: sets of word shingles, size-aware heavy-light, classes of linked documents.

Two sets link when their Jaccard similarity reaches the threshold (whole percent). With sizes n <= m that is an
overlap of at least c = ceil(T (n + m) / (100 + T)), or a symmetric difference of at most
(100 - T) (n + m) / (100 + T).

* **Light sets** (pairs whose smaller side has at most ``boundary`` shingles) enumerate all subsets of the fixed
  size c. Two sets link exactly if they meet in a subset, so nothing is verified.
* **Heavy sets** are found by scanning inverted lists. Lists of single shingles would hold every document that
  quotes a shared passage, so the lists are keyed by blocks: the shingle space is cut into more blocks than the
  largest symmetric difference of the size class, hence two linked sets agree on some whole block. Empty blocks say
  little and would make long lists. A set that has shingles in more blocks than it can differ in agrees with each
  linked set on a block with shingles too, so only the rare other sets list their empty blocks.
* The **boundary** is the size up to which enumerating costs less than scanning and verifying (``cost_boundary``).

A list is scanned in two steps. First its hub, the member found in most lists, is compared with each other member;
links to hubs hold most of a group of near copies together. What may be left are links between members of
different classes. For these, members are dealt into blocks of bounded size, and pairs of blocks are scanned by
parity sketches: every shingle flips one of ``SKETCH_BITS`` bits, so two sketches differ in no more bits than the sets
in shingles, and a pair beyond the difference allowed cannot link. Only pairs that pass are compared. Links inside a
class that other links hold together are not listed; no class is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlens.llm.common import discard, keep, packed, pieces, release, remember, unpacked
from trajlens.llm.components import components

#: Relative costs: a list or subset entry (shuffled twice), and fetching and comparing one candidate.
ENTRY_COST, CANDIDATE_COST, CANDIDATE_RATE = 2.0, 60.0, 0.33
SKETCH_BITS = 4096
#: Passes over the list keys, and over the hubs of candidate pairs.
KEY_RANGES = 2
#: Row keys (8 bytes each) up to this number are broadcast, more are joined by shuffle.
BROADCAST_KEYS = 100_000
#: Members of a list that are scanned as one block.
BLOCK_MEMBERS = 256
#: Words whose hash a worker remembers.
REMEMBERED_WORDS = 150_000
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _SHIFT)) * _STEP
    values = (values ^ (values >> _SHIFT)) * _STEP
    return values ^ (values >> _SHIFT)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; A-Z count as a-z.

    A text with fewer words than ``width`` is one shingle; no words give the empty set.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    rolled = np.full(len(words) - size + 1, size, np.uint64)
    for place in range(size):
        rolled = _mix(rolled) + hashes[place : len(hashes) - size + 1 + place]
    return np.unique(_mix(rolled))


class Sizes:
    """What the threshold implies for set sizes."""

    def __init__(self, threshold: int, boundary: int | None = None):
        self.t = threshold
        edges = [1]
        while edges[-1] < 2**40:
            edges.append(edges[-1] * 3 // 2 + 1)
        self.edges = np.array(edges)
        self._blocks: dict[int, int] = {}
        self.boundary = self.cost_boundary() if boundary is None else boundary

    def links(self, both: int, union: int) -> bool:
        return 100 * both >= self.t * union

    def overlap(self, n: int, m: int) -> int:
        return -(-self.t * (n + m) // (100 + self.t))

    def largest(self, n: int) -> int:
        return 100 * n // self.t

    def smallest(self, n: int) -> int:
        return -(-self.t * n // 100)

    def most_apart(self, n: int) -> int:
        """Largest symmetric difference between a set of n and a linked one of at least its size."""
        return (100 - self.t) * (n + self.largest(n)) // (100 + self.t)

    def blocks(self, size_class: int) -> int:
        """Fewest blocks of which most sets of the class fill more than they can differ in."""
        if size_class not in self._blocks:
            self._blocks[size_class] = self._fewest_blocks(size_class)
        return self._blocks[size_class]

    def _fewest_blocks(self, size_class: int) -> int:
        largest = int(self.edges[size_class + 1]) - 1
        apart = self.most_apart(largest)
        count = apart + 1
        while True:
            empty = (1 - 1 / count) ** largest
            if count * (1 - empty) - (count * empty * (1 - empty)) ** 0.5 >= apart + 1 or empty > 0.5:
                return count
            count += 1 + count // 200

    def apart_within(self, n: int, size_class: int) -> int:
        """Largest symmetric difference between a set of n and a linked one, the smaller of them of the size class."""
        if size_class == self.size_class(n):
            return self.most_apart(n)
        return (100 - self.t) * (int(self.edges[size_class + 1]) - 1 + n) // (100 + self.t)

    def size_class(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def classes(self, n: int) -> list[int]:
        """Classes of the smaller side of heavy pairs that a set of n shingles can be part of."""
        own = self.size_class(n)
        out = []
        for k in range(self.size_class(max(1, self.smallest(n))), own + 1):
            low, high = int(self.edges[k]), int(self.edges[k + 1]) - 1
            if max(low, self.smallest(n), self.boundary + 1) <= min(high, n):
                out.append(k)
        return out

    def roles(self, n: int, boundary: int) -> list[tuple[int, int, int, int]]:
        """(smaller size, larger size, subset size, role) for light pairs; role 1 smaller, 2 larger, 3 both."""
        out = []
        if n <= boundary:
            out += [(n, m, self.overlap(n, m), 1) for m in range(n + 1, self.largest(n) + 1)]
            if self.overlap(n, n) < n:
                out.append((n, n, self.overlap(n, n), 3))
        out += [(s, n, self.overlap(s, n), 2) for s in range(self.smallest(n), n) if 1 <= s <= boundary]
        return [role for role in out if role[2] <= role[0]]

    def cost_boundary(self) -> int:
        best = 0
        for n in range(1, 200):
            subsets = ENTRY_COST * sum(comb(n, c) for _s, _l, c, _r in self.roles(n, n))
            lists = ENTRY_COST * self.blocks(self.size_class(n)) + CANDIDATE_RATE * (CANDIDATE_COST + n)
            if subsets > lists:
                break
            best = n
        return best


def block_keys(items: np.ndarray, sizes: Sizes) -> np.ndarray:
    """One list key per filled block and size class: a hash of the shingles that fall into the block.

    Sets that fill no more blocks than they can differ in have a key for each empty block as well.
    """
    n, out = len(items), []
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(items))])
    for k in sizes.classes(n):
        count = sizes.blocks(k)
        # Items are sorted, so equal high halves scaled to the count are consecutive.
        block = ((items >> _SHIFT) * np.uint64(count)) >> _SHIFT
        place = np.unique(block)
        if len(place) <= sizes.apart_within(n, k):
            place = np.arange(count, dtype=np.uint64)
        content = sums[np.searchsorted(block, place, "right")] - sums[np.searchsorted(block, place, "left")]
        seed = _mix(place + np.array([k << 40], np.uint64))
        out.append(_mix(content + seed))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def subset_keys(items: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, list[int]]:
    mixed, keys, roles = _mix(items), [], []
    for small, large, size, role in sizes.roles(len(items), sizes.boundary):
        left_out = np.array(list(combinations(mixed, len(items) - size)), np.uint64).reshape(comb(len(items), size), -1)
        content = mixed.sum(dtype=np.uint64) - left_out.sum(axis=1, dtype=np.uint64)
        keys.append(_mix(content + _mix(np.array([small << 32 | large], np.uint64))))
        roles += [role] * len(content)
    return (np.concatenate(keys) if keys else np.empty(0, np.uint64)), roles


def _arrays(values: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(value) for value in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64) if kind is None else flat.astype(kind)))


def _profiles(width: int, sizes: Sizes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember(_hashes)
        for batch in pieces(batches, "text"):
            nodes, counts, sketches, lists, subsets, roles = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                items = shingle_set(text, width)
                counts.append(len(items))
                nodes.append(_node(items))
                sketches.append(sketch_of(items))
                lists.append(block_keys(items, sizes))
                keys, kinds = subset_keys(items, sizes)
                subsets.append(keys)
                roles.append(np.array(kinds, np.int8))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("row_key"), pa.array(nodes, pa.int64()), pa.array(counts, pa.int64()),
                    _arrays(sketches, None), _arrays(lists, None), _arrays(subsets, None), _arrays(roles, np.int8),
                ],
                ["id", "row_key", "node", "n_shingles", "sketch", "lists", "subsets", "roles"],
            )

    return run


def _node(items: np.ndarray) -> int | None:
    """Identity of a set: a 64-bit hash of its sorted shingles, null when empty."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(items.tobytes())).astype(np.int64)) if len(items) else None


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember(_hashes)
        for batch in pieces(batches, "text"):
            found = [shingle_set(text, width) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_node(items) for items in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())],
                ["node", "items"],
            )

    return run


def _verify(sizes: Sizes):
    """Keep the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember(_hashes)
        for batch in batches:
            linked = []
            for hub, items in zip(batch.column("hub_items"), batch.column("items"), strict=True):
                hub = np.frombuffer(hub.as_buffer(), np.uint64)
                items = np.frombuffer(items.as_buffer(), np.uint64)
                both = int((hub[np.minimum(np.searchsorted(hub, items), len(hub) - 1)] == items).sum())
                linked.append(sizes.links(both, len(hub) + len(items) - both))
            chosen = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("hub").filter(chosen), batch.column("node").filter(chosen)], ["a", "b"])

    return run


def _could_link(pairs: DataFrame, about: DataFrame, sizes: Sizes) -> DataFrame:
    """The pairs whose sizes and sketches allow a link."""
    low, high = 100 - sizes.t, 100 + sizes.t
    hubs = about.select(F.col("node").alias("hub"), F.col("n_shingles").alias("m"), F.col("sketch").alias("other"))
    both = pairs.join(about, "node").join(hubs, "hub")
    apart = sum(F.bit_count(F.col("sketch")[word].bitwiseXOR(F.col("other")[word])) for word in range(SKETCH_BITS // 64))
    near = F.greatest(apart, F.abs(F.col("n_shingles") - F.col("m"))) * high <= (F.col("n_shingles") + F.col("m")) * low
    return both.where(near).select("hub", "node")


def _linked(pairs: DataFrame, profiles: DataFrame, source: DataFrame, width: int, sizes: Sizes) -> DataFrame:
    """The pairs (``hub, node``) that link, as ``a, b``; only the texts that pairs ask for are read again."""
    pairs = keep(pairs)
    needed = pairs.select("node").union(pairs.select("hub")).distinct()
    chosen = keep(
        profiles.select("node", "row_key").join(needed, "node", "left_semi").groupBy("node").agg(F.min("row_key").alias("row_key"))
        .select("row_key")
    )
    if chosen.count() <= BROADCAST_KEYS:
        texts = source.select("row_key", "text").join(F.broadcast(chosen), "row_key", "left_semi")
    else:
        texts = source.select("row_key", "text").join(chosen, "row_key", "left_semi")
    sets = keep(
        texts.select("text").mapInArrow(_sets(width), "node long, items binary").groupBy("node").agg(F.first("items").alias("items"))
    )
    hubs = sets.select(F.col("node").alias("hub"), F.col("items").alias("hub_items"))
    # Pairs are taken in ranges of hubs, so that the sets shuffled for one range at a time are on disk.
    found = []
    for part in range(KEY_RANGES):
        mine = F.pmod(F.xxhash64("hub"), F.lit(KEY_RANGES)) == part
        both = pairs.where(mine).join(sets, "node").join(hubs.where(mine), "hub").select("hub", "node", "hub_items", "items")
        found.append(keep(both.mapInArrow(_verify(sizes), "a long, b long")))
        del both
        release(profiles.sparkSession)
    discard(pairs, chosen, sets)
    return reduce(DataFrame.unionByName, found)


def sketch_of(items: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of SKETCH_BITS slots."""
    counts = np.bincount((items & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits(counts.astype(np.uint8) & 1).view(np.uint64)


def _near_pairs(sizes: Sizes):
    """Pairs of a block, or of two, that differ in few sketch bits and are of different classes."""
    low, high = 100 - sizes.t, 100 + sizes.t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember(_hashes)
        for batch in batches:
            left, right = [], []
            for group in batch.column("found"):
                found = group.values.flatten()
                side, node, size, root = (column.to_numpy() for column in found[:4])
                bits = found[4].flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
                rows = np.flatnonzero(side == side.min())
                columns = np.flatnonzero(side == side.max())
                apart = np.zeros((len(rows), len(columns)), np.int64)
                for word in range(bits.shape[1]):
                    apart += np.bitwise_count(bits[rows, word][:, None] ^ bits[columns, word][None, :])
                total = size[rows][:, None] + size[columns][None, :]
                near = (high * apart <= low * total) & (root[rows][:, None] != root[columns][None, :])
                near &= np.abs(size[rows][:, None] - size[columns][None, :]) * high <= low * total
                x, y = np.nonzero(near)
                left.append(node[rows[x]])
                right.append(node[columns[y]])
            left = np.concatenate(left) if left else np.empty(0, np.int64)
            right = np.concatenate(right) if right else np.empty(0, np.int64)
            pairs = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["hub", "node"])

    return run


def _rest(members: DataFrame, roots: DataFrame, about: DataFrame, sizes: Sizes) -> DataFrame:
    """Pairs (``hub, node``) that could link although their classes differ so far."""
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # With two members, the pair has been compared.
    mixed = placed.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("root").alias("low"), F.max("root").alias("top")).where(
        "low < top and held > 2"
    ).select("key", F.ceil(F.col("held") / BLOCK_MEMBERS).cast("long").alias("blocks"))
    dealt = placed.join(mixed, "key").join(about, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # A member goes to every pair of blocks that its own is part of; blocks * members rows.
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    groups = spread.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list(F.struct("own", "node", "n_shingles", "root", "sketch")).alias("found")
    )
    return groups.select("found").mapInArrow(_near_pairs(sizes), "hub long, node long").distinct()


def shingle_classes(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, threshold: int = 90,
    boundary: int | None = None,
) -> DataFrame:
    """One row per input row: its id, ``n_shingles``, ``component_id`` (smallest id it is linked with, itself included).

    Null or blank texts have no shingles and link with nothing; their component is their own id. Repeated rows are
    kept, each with the same class. Rows with equal sets are one node. A null id is a component id only where the
    whole class has no other. Other columns of ``docs`` are ignored.
    """
    placed = _placed(docs, id_column, text_column, width, threshold, boundary)
    least = placed.where("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    return placed.join(least, "root", "left").select(
        F.col("id").alias(id_column), "n_shingles", F.coalesce("least", "id").alias("component_id")
    )


def one_per_class(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, threshold: int = 80
) -> DataFrame:
    """The rows of ``docs`` that come first in their class (smallest id), with all their columns.

    Rows without words stay, whatever their number. Rows equal in id and text are one document, of which one row
    stays. A null id comes after every other id.
    """
    placed = _placed(docs, id_column, text_column, width, threshold, None)
    first = placed.where("root is not null").groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row_key"))["row_key"].alias("row_key")
    )
    kept = first.select("row_key").unionByName(placed.where("root is null").select("row_key")).distinct()
    rows = docs.select(packed(docs), F.col(id_column).alias("id"), F.col(text_column).alias("text")).select(
        "_row", "id", F.xxhash64("id", "text").alias("row_key")
    )
    return unpacked(rows.join(kept, "row_key", "left_semi").dropDuplicates(["id", "row_key"]), docs.columns)


def _placed(
    docs: DataFrame, id_column: str, text_column: str, width: int, threshold: int, boundary: int | None
) -> DataFrame:
    """``id, row_key, node, n_shingles, root`` of every input row; root is null where the set is empty."""
    sizes = Sizes(threshold, boundary)
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn(
        "row_key", F.xxhash64("id", "text")
    )
    kind = source.schema["id"].dataType.simpleString()
    # One pass over the texts; every document leaves its list keys, nothing pairs documents yet.
    profiles = keep(
        source.mapInArrow(
            _profiles(width, sizes),
            f"id {kind}, row_key long, node long, n_shingles long, sketch array<long>, lists array<long>, subsets array<long>, roles array<tinyint>",
        )
    )

    # Light sets: a subset shared by the smaller and the larger role is a link.
    subsets = profiles.select("node", F.explode(F.arrays_zip("subsets", "roles")).alias("z")).select(
        "node", F.col("z.subsets").alias("key"), F.col("z.roles").alias("role")
    )
    meet = subsets.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top"), F.bit_or("role").alias("r"))
    light = subsets.join(meet.where("hub < top and r = 3").select("key", "hub"), "key").where("hub != node")
    links = [keep(light.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())]

    # Heavy sets: members of lists that hold two different sets. Keys are taken in ranges, one after the other, so that
    # the shuffled entries of one range at a time are on disk.
    found = []
    for part in range(KEY_RANGES):
        entries = profiles.select("node", F.explode("lists").alias("key")).where(F.pmod("key", F.lit(KEY_RANGES)) == part)
        shared = entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("top")).where("low < top")
        found.append(keep(entries.join(shared.select("key"), "key", "left_semi").distinct()))
        del entries, shared
        release(profiles.sparkSession)
    members = reduce(DataFrame.unionByName, found)
    needed = members.select("node").distinct()
    about = keep(profiles.select("node", "n_shingles", "sketch").join(needed, "node", "left_semi").dropDuplicates(["node"]))
    reach = members.groupBy("node").agg(F.count(F.lit(1)).alias("reach"))
    hubs = members.join(reach, "node").groupBy("key").agg(F.max(F.struct("reach", "node"))["node"].alias("hub"))
    pairs = members.join(hubs, "key").where("hub != node").select("hub", "node").distinct()
    links.append(_linked(_could_link(pairs, about, sizes), profiles, source, width, sizes))
    release(profiles.sparkSession)
    roots = keep(components(reduce(DataFrame.unionByName, links)))
    late = _linked(_rest(members, roots, about, sizes), profiles, source, width, sizes)
    if not late.isEmpty():
        roots = keep(components(reduce(DataFrame.unionByName, [*links, late])))
    discard(*found, about)
    return profiles.select("id", "row_key", "node", "n_shingles").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    )
