"""Document fingerprints by consistent weighted sampling.

A text is a bag of words, weighted by their number. For every sample k and term, two gamma variates r, c and a uniform
one b are fixed by a hash. With weight S the term gets t = floor(ln S / r + b), y = exp(r (t - b)) and a = c / (y exp(r)); the
term with the smallest a, together with its t, is the sample. Two texts share a sample with a probability equal to their
generalised Jaccard similarity (sum of minima over sum of maxima of the weights), so the share of equal samples
estimates it. Terms are hashed into ``TERMS`` slots, whose variates every worker makes once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlens.llm.common import shard_edges, shard_of, ship

TERMS, SAMPLES = 1 << 17, 64
REMEMBERED_WORDS = 400_000
#: Terms of one text handled at once.
BLOCK = 4096


def _uniform(count: int, stream: int, seed: int) -> np.ndarray:
    """Hashed uniform numbers in (0, 1)."""
    x = np.arange(count, dtype=np.uint64) + np.uint64((seed * 64 + stream) << 36)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53 + 2.0**-54


class Sampler:
    """Variates of all slots and samples."""

    def __init__(self, samples: int = SAMPLES, seed: int = 1, terms: int = TERMS):
        shape, count = (terms, samples), terms * samples
        self.terms, self.samples = terms, samples
        # A gamma variate of shape two is the sum of two exponential ones.
        r = -np.log(_uniform(count, 1, seed)) - np.log(_uniform(count, 2, seed))
        c = -np.log(_uniform(count, 3, seed)) - np.log(_uniform(count, 4, seed))
        self.r = r.astype(np.float32).reshape(shape)
        self.log_c = np.log(c).astype(np.float32).reshape(shape)
        self.b = _uniform(count, 5, seed).astype(np.float32).reshape(shape)
        self.slots: dict[bytes, int] = {}

    def _slot(self, word: bytes) -> int:
        if len(self.slots) >= REMEMBERED_WORDS:
            self.slots.clear()
        value = self.slots[word] = xxhash.xxh3_64_intdigest(word) % self.terms
        return value

    def sample(self, text: str) -> np.ndarray:
        """Hashed samples of a text; a text without words has zeros."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(self.samples, np.uint16)
        known = self.slots.get
        slots, counts = np.unique(np.array([known(w) or self._slot(w) for w in words], np.int64), return_counts=True)
        least, chosen, level = None, None, None
        for start in range(0, len(slots), BLOCK):
            part = slots[start : start + BLOCK]
            r, b = self.r[part], self.b[part]
            t = np.floor(np.log(counts[start : start + BLOCK]).astype(np.float32)[:, None] / r + b)
            value = self.log_c[part] - r * (t - b + 1)
            at = value.argmin(axis=0)
            column = np.arange(self.samples)
            value, t = value[at, column], t[at, column]
            if least is None:
                least, chosen, level = value, part[at], t
            else:
                better = value < least
                least, chosen, level = np.where(better, value, least), np.where(better, part[at], chosen), np.where(better, t, level)
        mixed = (chosen.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (level.astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return np.maximum((mixed * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(48), 1).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


_samplers: dict[tuple[int, int], Sampler] = {}


def _sampler(samples: int, seed: int) -> Sampler:
    if (samples, seed) not in _samplers:
        _samplers.clear()
        _samplers[samples, seed] = Sampler(samples, seed)
    return _samplers[samples, seed]


def _fingerprints(samples: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(samples, seed)
        for batch in batches:
            prints = [sampler.sample(text or "").astype(">u2").tobytes().hex() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pa.string())], ["id", "fingerprint"])

    return run


def fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", samples: int = SAMPLES, seed: int = 1
) -> DataFrame:
    """``id, fingerprint`` of every row (four hexadecimal digits per sample); null and blank texts give zeros."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints(samples, seed), f"id {kind}, fingerprint string").withColumnRenamed("id", id_column)


def _compare(samples: int, seed: int):
    """Rows come in descending order; each is finished when the next one of its shard is seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(samples, seed)
        before = None
        for batch in batches:
            ids, counts, digests, prints, edits, near, far = [], [], [], [], [], [], []
            columns = [batch.column(name).to_pylist() for name in ("shard", "guest", "id", "text")]
            for shard, guest, number, text in zip(*columns, strict=True):
                text = text or ""
                mark = sampler.sample(text)
                if before is not None and before[0] == shard:
                    old, old_text, old_mark = before[1:]
                    half = len(old_text) // 2
                    edited = old_text[: len(old_text) - half] + text[:half]
                    edited_mark = sampler.sample(edited)
                    ids.append(old)
                    counts.append(len(old_text))
                    digests.append(hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest())
                    prints.append(old_mark.astype(">u2").tobytes().hex())
                    edits.append(edited_mark.astype(">u2").tobytes().hex())
                    near.append(likeness(old_mark, edited_mark))
                    far.append(likeness(old_mark, mark))
                before = None if guest else (shard, number, text, mark)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, batch.schema.field("id").type), pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
                    pa.array(prints, pa.string()), pa.array(edits, pa.string()), pa.array(near, pa.float64()), pa.array(far, pa.float64()),
                ],
                ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return run


def compare_with_edits(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", samples: int = SAMPLES, seed: int = 1,
    shards: int | None = None,
) -> DataFrame:
    """Fingerprints of every text and of its edit, whose second half comes from the next row in descending id order.

    The row after the last is the first. Rows are dealt out by id ranges and shuffled once; a range also receives the
    top row of the range after it as a guest. Null texts are empty; null ids come last; rows that repeat an id are
    ordered by descending text. A table of one row is its own next row. Ids must be whole numbers.
    """
    spark = docs.sparkSession
    ship(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.withColumn("shard", shard_of(F.col("id"), shard_edges(rows, "id", shards)))
    # One row per shard: the id of its top row, and the shard that comes after in descending order.
    tops = sorted((row["shard"], row["id"]) for row in rows.groupBy("shard").agg(F.max("id").alias("id")).collect())
    hosts = spark.createDataFrame(
        [(tops[place + 1 if place + 1 < len(tops) else 0][0], number) for place, (_shard, number) in enumerate(tops)],
        f"host int, top {kind}",
    )
    # At most one row per shard, as counted above.
    found = rows.join(F.broadcast(hosts), F.col("id").eqNullSafe(F.col("top"))).groupBy("host", "id").agg(F.max("text").alias("text"))
    guests = found.select("id", "text", F.col("host").alias("shard"), F.lit(True).alias("guest"))
    dealt = (
        rows.withColumn("guest", F.lit(False)).unionByName(guests).repartition(shards, "shard")
        .sortWithinPartitions("shard", "guest", F.col("id").desc_nulls_last(), F.col("text").desc())
    )
    out = dealt.select("shard", "guest", "id", "text").mapInArrow(
        _compare(samples, seed),
        f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
    return out.withColumnRenamed("id", id_column)
