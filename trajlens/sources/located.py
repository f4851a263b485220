"""Data source ``located_lines``: text lines with the file and byte they start at, batch and streaming.

Spark's text source does not say where in its file a line stands, which is what a report on a broken record needs, and
what orders first and last records of growing logs. Columns: file string, place long (byte offset; of the unpacked text in
compressed files), value string (without the line end).

Options: ``path`` (a file, a folder read recursively, or several joined by commas), ``split_bytes`` (default 64 MB). Plain files are
cut into splits of that size, a line belonging to the split it starts in; ``.gz`` and ``.bz2`` files are one split each. As a stream,
every batch takes what complete lines the files have gained; offsets are the bytes read per file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, place long, value string"
PACKED = (".gz", ".bz2")
BATCH_BYTES = 4 << 20
_ARROW = pa.schema([("file", pa.string()), ("place", pa.int64()), ("value", pa.string())])


@dataclass
class Split(InputPartition):
    file: str
    start: int
    #: First byte of the next split; none for packed files.
    end: int | None


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _sizes(options: dict) -> dict[str, int]:
    """Bytes of every file under the path; names that start with a sign of hidden files are left out, as Spark does."""
    found = {}
    for path in options["path"].split(","):
        system, inside = _open(path.strip())
        info = system.get_file_info(inside)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        files = system.get_file_info(pafs.FileSelector(inside, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        root = path.strip().removesuffix(inside)
        for file in files:
            if file.type == pafs.FileType.File and not file.base_name.startswith(("_", ".")):
                found[root + file.path] = file.size
    return found


def splits(sizes: dict[str, int], split_bytes: int, taken: dict[str, int] | None = None) -> list[Split]:
    """Ranges of like size over what each file holds beyond ``taken``."""
    out = []
    for file, size in sorted(sizes.items()):
        start = (taken or {}).get(file, 0)
        if file.endswith(PACKED):
            out += [Split(file, 0, None)] * (not start)
        else:
            out += [Split(file, at, min(at + split_bytes, size)) for at in range(start, size, split_bytes)]
    return out


def lines_of(split: Split, complete: bool = False) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that start inside the split; with ``complete`` an unfinished last line waits."""
    system, inside = _open(split.file)
    if split.end is None:
        stream, place, end = system.open_input_stream(inside), 0, None
    else:
        stream, end = system.open_input_file(inside), split.end
        # One byte earlier, so that a line that starts exactly here is not taken for the rest of another.
        place = max(split.start - 1, 0)
        stream.seek(place)
    rest, skip = b"", split.start > 0
    with stream:
        while True:
            data = stream.read(BATCH_BYTES)
            rest += data
            *lines, rest = rest.split(b"\n")
            for line in lines:
                if not skip:
                    if end is not None and place >= end:
                        return
                    yield place, line
                skip = False
                place += len(line) + 1
            if end is not None and place >= end:
                return
            if not data:
                break
    if rest and not skip and not complete:
        yield place, rest


def _batches(split: Split, complete: bool = False) -> Iterator[pa.RecordBatch]:
    places: list[int] = []
    values: list[str] = []
    held = 0
    for place, line in lines_of(split, complete):
        places.append(place)
        values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
        held += len(line)
        if held >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([split.file] * len(places)), pa.array(places), pa.array(values)], schema=_ARROW)
            places, values, held = [], [], 0
    if places:
        yield pa.RecordBatch.from_arrays([pa.array([split.file] * len(places)), pa.array(places), pa.array(values)], schema=_ARROW)


class LocatedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "located_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Split]:
        return splits(_sizes(self.options), int(self.options.get("split_bytes", 64 << 20)))

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return _batches(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are JSON texts inside: {"files": {file: bytes taken}}."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        # Up to the last line end, so that a line still being written is taken whole later.
        ends = {}
        for file, size in _sizes(self.options).items():
            ends[file] = size if file.endswith(PACKED) else _last_line_end(file, size)
        return {"files": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return splits(json.loads(end["files"]), int(self.options.get("split_bytes", 64 << 20)), json.loads(start["files"]))

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return _batches(partition, complete=partition.end is not None)

    def commit(self, end: dict) -> None:
        pass


def _last_line_end(file: str, size: int) -> int:
    system, inside = _open(file)
    with system.open_input_file(inside) as stream:
        end = size
        while end > 0:
            start = max(0, end - (1 << 16))
            stream.seek(start)
            found = stream.read(end - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
    return 0


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(LocatedLines)
