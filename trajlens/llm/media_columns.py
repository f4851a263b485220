"""Media columns: bytes of texts as lossless WebP images in a binary column.

The UTF-8 bytes of a text are filled up with bytes 255 to a positive multiple of 576 and stored as the 8-bit samples
of grey images, 576 to a row and at most ``TILE_ROWS`` rows to an image; a longer text has its images one after the
other in the column. Reading splits the column into files, decodes them and joins the samples.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlens.llm.common import keep, pieces, ship
from trajlens.llm.webp import decode_samples, encode_samples

UNIT, TILE_ROWS, TOGETHER = 576, 16, 256
FILL = 255
TAIL = 32


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes([FILL]) * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def files_of(media: bytes) -> list[bytes]:
    """The WebP files that a column value holds."""
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at : at + size])
        at += size
    return out


def to_media(payloads: list[bytes]) -> list[bytes]:
    step = UNIT * TILE_ROWS
    tiles = [np.frombuffer(p[at : at + step], np.uint8) for p in payloads for at in range(0, len(p), step)]
    # Tiles are encoded some at a time, so that the memory of a long text does not grow with it.
    files = [file for at in range(0, len(tiles), TOGETHER) for file in encode_samples(tiles[at : at + TOGETHER], UNIT)]
    out, at = [], 0
    for payload in payloads:
        count = -(-len(payload) // step)
        out.append(b"".join(files[at : at + count]))
        at += count
    return out


def to_payloads(media: list[bytes]) -> list[bytes]:
    files = [files_of(value) for value in media]
    found, out, at = decode_samples([file for value in files for file in value]), [], 0
    for value in files:
        out.append(b"".join(part.tobytes() for part in found[at : at + len(value)]))
        at += len(value)
    return out


def features_of(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, then the share of each sixteenth of the range, in thousandths."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    shares = counts[counts > 0] / len(samples)
    head = [samples.mean(), samples.std(), -(shares * np.log2(shares)).sum()]
    return " ".join([f"{value:.3f}" for value in head] + [str(n * 1000 // len(samples)) for n in counts.reshape(16, 16).sum(axis=1).tolist()])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        texts = batch.column("text").to_pylist()
        sizes = [len((text or "").encode("utf-8", "surrogatepass")) for text in texts]
        media = to_media([payload_of(text) for text in texts])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"]
        )


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "media", 2_000_000):
        media = batch.column("media").to_pylist()
        payloads = to_payloads(media)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"), batch.column("n_bytes"), pa.array(map(len, payloads), pa.int64()),
                pa.array([hashlib.sha256(value).hexdigest() for value in payloads]),
                pa.array([zlib.crc32(value[-TAIL:]) for value in payloads], pa.int64()), pa.array(map(len, media), pa.int64()),
                pa.array([hashlib.sha256(value).hexdigest() for value in media]), pa.array(map(features_of, payloads), pa.string()),
            ],
            ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def media_table(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Store the texts: ``id, n_bytes, media`` of every row, written to the shared folder. Null texts are empty."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return keep(rows.mapInArrow(_store, f"id {kind}, n_bytes long, media binary"))


def describe(media: DataFrame) -> DataFrame:
    """Read a media table back: sizes, digests and features of what the images hold."""
    ship(media.sparkSession)
    kind = media.schema["id"].dataType.simpleString()
    return media.select("id", "n_bytes", "media").mapInArrow(
        _describe,
        f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string",
    )
