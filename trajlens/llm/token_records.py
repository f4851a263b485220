"""Token ids as length-delimited binary records with masked checksums, and offset indexes for shuffled reads.

A record is: length of the data (8 bytes, little-endian), masked CRC-32C of these 8 bytes (4), the data, masked CRC-32C
of the data (4). The mask rotates the checksum right by 15 bits and adds 0xA282EAD8. The data are a head (id of the
document as 8 bytes, 1 byte: 1 if the document has an id) and the token ids, 2 bytes each (4 if the vocabulary
needs it). Records are in ascending id order within a shard, shards are in ascending id order too. Next to a shard lies
its index: for each record its offset and data length (8 bytes each), so that any record can be read alone.

Shards are written to the shared folder under a name of the attempt and renamed; a repeated task writes the same bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trajlens.llm.common import keep, pieces, shard_edges, shard_of, ship
from trajlens.llm.segment_bpe import Splitter, byte_symbols
from trajlens.session import shared_folder

END_ID = 1
REMEMBERED_WORDS = 600_000
MASK = 0xA282EAD8
#: Bytes whose checksums are made together.
BLOCK = 2048
HEAD = 9


def _crc_table() -> np.ndarray:
    """CRC-32C of single bytes, reflected polynomial 0x82F63B78."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1)
    return table


_TABLE = _crc_table()


def _position_tables(size: int) -> np.ndarray:
    """Row k: effect of a byte that k more bytes follow."""
    rows = np.empty((size, 256), np.uint32)
    rows[0] = _TABLE
    for k in range(1, size):
        rows[k] = _TABLE[rows[k - 1] & 0xFF] ^ (rows[k - 1] >> 8)
    return rows


_EFFECTS = _position_tables(BLOCK)


def crc32c(data: bytes | np.ndarray) -> int:
    """CRC-32C; checksums are linear, so the effects of a block's bytes are looked up at once and combined."""
    data = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    state = 0xFFFFFFFF
    for start in range(0, len(data), BLOCK):
        part = data[start : start + BLOCK]
        if len(part) < 32:
            for byte in part.tolist():
                state = int(_TABLE[(state ^ byte) & 0xFF]) ^ (state >> 8)
            continue
        part = part.copy()
        part[:4] ^= np.array([state], "<u4").view(np.uint8)
        places = np.arange(len(part) - 1, -1, -1)
        state = int(np.bitwise_xor.reduce(_EFFECTS[places, part]))
    return state ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def record(data: bytes) -> bytes:
    length = len(data).to_bytes(8, "little")
    return b"".join([length, masked(crc32c(length)).to_bytes(4, "little"), data, masked(crc32c(data)).to_bytes(4, "little")])


def unframed(raw: bytes, size: int) -> memoryview:
    """Data of one record; raises if a length or checksum is wrong."""
    view = memoryview(raw)
    if int.from_bytes(view[:8], "little") != size or len(view) != size + 16:
        raise ValueError("record length differs from the index")
    data = view[12 : 12 + size]
    if int.from_bytes(view[8:12], "little") != masked(crc32c(bytes(view[:8]))):
        raise ValueError("checksum of the length is wrong")
    if int.from_bytes(view[12 + size :], "little") != masked(crc32c(np.frombuffer(data, np.uint8))):
        raise ValueError("checksum of the data is wrong")
    return data


class LibraryEncoder:
    """The tokenizers library's model, asked once per distinct pre-token; a text's ids are those of its pre-tokens."""

    def __init__(self, file: str):
        self.library = Tokenizer.from_str(file)
        self.splitter = Splitter(file)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.model, self.letters = self.library.model, byte_symbols()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def _word(self, word: str) -> bytes:
        letters = self.letters
        return self._bytes([token.id for token in self.model.tokenize("".join([letters[byte] for byte in word.encode()]))])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian numbers."""
        # Texts that hold a special token's name are left to the library whole.
        whole = [any(name in text for name in self.special) if "<|" in text else False for text in texts]
        parts = [[] if odd else self.splitter.words(text) for odd, text in zip(whole, texts, strict=True)]
        wanted = {word for words in parts for word in words}
        if len(self.known) + len(wanted) > REMEMBERED_WORDS:
            self.older, self.known = self.known, {}
        for word in wanted - self.known.keys():
            self.known[word] = self.older.get(word) or self._word(word)
        known = self.known
        return [
            self._bytes(self.library.encode(text, add_special_tokens=False).ids) if odd else b"".join([known[w] for w in words])
            for odd, text, words in zip(whole, texts, parts, strict=True)
        ]


_encoders: dict[int, LibraryEncoder] = {}


def _encoder(held, number: int) -> LibraryEncoder:
    if number not in _encoders:
        _encoders.clear()
        _encoders[number] = LibraryEncoder(held.value)
    return _encoders[number]


class _Shard:
    """Writes one shard and its index, then gives them their names."""

    def __init__(self, folder: str, number: int):
        self.files, root = pafs.FileSystem.from_uri(folder)
        self.files.create_dir(root, recursive=True)
        self.name = f"{root}/shard-{number:06d}"
        self.mark = uuid.uuid4().hex
        self.data = self.files.open_output_stream(f"{self.name}.{self.mark}.rec")
        self.index = self.files.open_output_stream(f"{self.name}.{self.mark}.idx")
        self.number, self.offset, self.rows, self.tokens = number, 0, 0, 0

    def add(self, head: bytes, ids: bytes, count: int) -> None:
        framed = record(head + ids)
        self.data.write(framed)
        self.index.write(np.array([self.offset, len(head) + len(ids)], "<u8").tobytes())
        self.offset += len(framed)
        self.rows += 1
        self.tokens += count

    def close(self) -> tuple[int, int, int, int]:
        for stream, kind in ((self.data, "rec"), (self.index, "idx")):
            stream.close()
            self.files.move(f"{self.name}.{self.mark}.{kind}", f"{self.name}.{kind}")
        return self.number, self.rows, self.tokens, self.offset


def _write(held, number: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, done = _encoder(held, number), None, []
        end = encoder._bytes([END_ID])
        for batch in pieces(batches, "text", 1_000_000):
            columns = batch.column("shard").to_pylist(), batch.column("id").to_pylist()
            texts = encoder.encode_batch([text or "" for text in batch.column("text").to_pylist()])
            for where, key, ids in zip(*columns, texts, strict=True):
                if shard is None or shard.number != where:
                    if shard is not None:
                        done.append(shard.close())
                    shard = _Shard(folder, where)
                head = (key or 0).to_bytes(8, "little", signed=True) + bytes([key is not None])
                shard.add(head, ids + end, len(ids) // encoder.width + 1)
        if shard is not None:
            done.append(shard.close())
        columns = list(zip(*done, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["shard", "records", "tokens", "bytes"])

    return run


def read_record(files, name: str, offset: int, size: int) -> memoryview:
    """One record by its index entry."""
    with files.open_input_file(f"{name}.rec") as file:
        return unframed(file.read_at(size + 16, offset), size)


def _read(folder: str, width: int):
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for number in batch.column("shard").to_pylist():
                name = f"{root}/shard-{number:06d}"
                index = np.frombuffer(files.open_input_file(f"{name}.idx").read(), "<u8").reshape(-1, 2).astype(np.int64)
                with files.open_input_file(f"{name}.rec") as file:
                    for start in range(0, len(index), 2000):
                        part = index[start : start + 2000]
                        base = int(part[0, 0])
                        raw = file.read_at(int(part[-1].sum()) + 16 - base, base)
                        keys, counts, checks = [], [], []
                        for offset, size in part.tolist():
                            data = unframed(raw[offset - base : offset - base + size + 16], size)
                            keys.append(int.from_bytes(data[:8], "little", signed=True) if data[8] else None)
                            ids = np.frombuffer(data[HEAD:], f"<u{width}").astype("<u4")
                            counts.append(len(ids))
                            checks.append(zlib.crc32(ids.tobytes()))
                        ends = np.cumsum(counts)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([number] * len(keys), pa.int64()), pa.array([start] * len(keys), pa.int64()),
                                pa.array(keys, pa.int64()), pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                                pa.array(checks, pa.int64()),
                            ],
                            ["shard", "chunk", "id", "inside", "n_tokens", "ids_crc32"],
                        )

    return run


def write_records(
    docs: DataFrame, path: str, folder: str, id_column: str = "doc_id", text_column: str = "text", shards: int | None = None
) -> DataFrame:
    """Write all texts as shards of ``folder``; returns ``shard, records, tokens, bytes``, one row per shard.

    Null texts are empty (only the end id); null ids come first; rows that repeat an id are ordered by text.
    """
    spark = docs.sparkSession
    ship(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    with open(path, encoding="utf-8") as file:
        held = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    rows = rows.withColumn("shard", shard_of(F.col("id"), shard_edges(rows, "id", shards)))
    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "text")
    return keep(
        dealt.select("shard", "id", "text").mapInArrow(
            _write(held, held._jbroadcast.id(), folder), "shard long, records long, tokens long, bytes long"
        )
    )


def read_records(written: DataFrame, folder: str, width: int) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of every record, read back from the shards; start counts over all shards."""
    # One small row per shard.
    everything = Window.partitionBy(F.lit(0)).orderBy("shard")
    bases = written.select("shard", (F.sum("tokens").over(everything) - F.col("tokens")).alias("base"))
    read = keep(
        written.select("shard").repartition(max(1, written.count()), "shard").mapInArrow(
            _read(folder, width), "shard long, chunk long, id long, inside long, n_tokens long, ids_crc32 long"
        )
    )
    chunks = read.groupBy("shard", "chunk").agg(F.sum("n_tokens").alias("held"))
    inside = Window.partitionBy("shard").orderBy("chunk")
    chunks = chunks.withColumn("earlier", F.sum("held").over(inside) - F.col("held")).join(bases, "shard")
    return read.join(chunks, ["shard", "chunk"]).select(
        "id", (F.col("base") + F.col("earlier") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write ``docs`` to a new folder of the shared space, read it back and describe each record."""
    folder = f"{shared_folder(docs.sparkSession)}/llm/records-{uuid.uuid4().hex}"
    folder = folder if ":" in folder.split("/")[0] else f"file://{folder}"
    if folder.startswith("file:/") and not folder.startswith("file:///"):
        folder = "file://" + folder.removeprefix("file:")
    written = write_records(docs, path, folder, id_column, text_column)
    with open(path, encoding="utf-8") as file:
        width = LibraryEncoder(file.read()).width
    return read_records(written, folder, width).withColumnRenamed("id", id_column)
