"""Alignments from the binary streams that aligners of sequence graphs write, as a Spark data source.

    spark.dataSource.register(AlignmentStream)
    spark.read.format("alignment_stream").load("reads/*.gam")

A stream is plain or compressed in blocks of gzip. It is a row of groups: the number of
messages, then each message after its number of bytes, numbers in base 128. A group may
begin with a tag that names the type of its messages; groups of other types are passed over.
A message is in the protocol buffer encoding, of which only paths are read.

A file is a partition: messages lie across its blocks, so it is read from its beginning, in
batches and never as a whole. Messages that can't be parsed are dropped and not counted; a
file that ends within a message is an error.
"""

from __future__ import annotations

import glob
import gzip
import re
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from .schema import ALIGNMENTS

#: Messages in a batch.
BATCH = 2048
#: What names the type of alignments, and what any tag looks like. A message never begins with a capital letter.
TAG, _TAG = b"GAM", re.compile(rb"[A-Z][A-Za-z0-9_.+-]{0,24}")
_ROW_BITS = 40


class Malformed(ValueError):
    """A message that is no alignment."""


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number in base 128 and the place behind it."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise Malformed("a number does not end")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at += 1
        if byte < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7


def _signed(value: int, bits: int) -> int:
    value &= (1 << bits) - 1
    return value - (1 << bits) if value >> (bits - 1) else value


def _fields(data: bytes) -> Iterator[tuple[int, int, Any]]:
    """Number, wire type and value of each field: a number (0) or bytes (2). Those of fixed width are passed over."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        field, kind = key >> 3, key & 7
        if not 0 < field < 1 << 29:
            raise Malformed("a field has no valid number")
        if kind == 0:
            value, at = _number(data, at)
            yield field, kind, value
            continue
        if kind == 2:
            size, at = _number(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
        else:
            raise Malformed("a field has no valid type")
        if at + size > len(data):
            raise Malformed("a field is longer than its message")
        if kind == 2:
            yield field, kind, data[at : at + size]
        at += size


def _edit(data: bytes) -> dict:
    out = {"from_length": 0, "to_length": 0, "sequence": ""}
    for field, kind, value in _fields(data):
        if kind == 0 and field in (1, 2):
            out["from_length" if field == 1 else "to_length"] = _signed(value, 32)
        elif kind == 2 and field == 3:
            try:
                out["sequence"] = value.decode()
            except UnicodeDecodeError:
                raise Malformed("a text is not UTF-8") from None
    return out


def _mapping(data: bytes) -> dict:
    out: dict = {"node_id": 0, "offset": 0, "is_reverse": False, "edits": []}
    for field, kind, value in _fields(data):
        if (field, kind) == (1, 2):
            for f, k, v in _fields(value):
                if k == 0 and f in (1, 2):
                    out["node_id" if f == 1 else "offset"] = _signed(v, 64)
                elif (f, k) == (4, 0):
                    out["is_reverse"] = v != 0
        elif (field, kind) == (2, 2):
            out["edits"].append(_edit(value))
    return out


def path_of(message: bytes) -> list[dict]:
    """The path of an alignment: node_id, offset, is_reverse and edits of each mapping."""
    return [_mapping(m) for field, kind, path in _fields(message) if (field, kind) == (2, 2) for f, k, m in _fields(path) if (f, k) == (2, 2)]


def _take(stream: BinaryIO, n: int) -> bytes:
    parts, left = [], n
    while left and (part := stream.read(min(left, 1 << 20))):
        parts.append(part)
        left -= len(part)
    if left:
        raise EOFError("The stream ends within a message.")
    return b"".join(parts)


def _next_number(stream: BinaryIO) -> int | None:
    """The next number, or nothing at the end of the stream."""
    raw = b""
    while not raw or raw[-1] >= 0x80:
        byte = stream.read(1)
        if not byte and not raw:
            return None
        if not byte or len(raw) > 9:
            raise EOFError("The stream ends within a number.")
        raw += byte
    return _number(raw, 0)[0]


def messages(stream: BinaryIO) -> Iterator[bytes]:
    """The messages of the groups that hold alignments."""
    while (count := _next_number(stream)) is not None:
        wanted = True
        for i in range(count):
            size = _next_number(stream)
            if size is None:
                raise EOFError("The stream ends within a group.")
            message = _take(stream, size)
            if i == 0 and _TAG.fullmatch(message):
                wanted = message == TAG
            elif wanted:
                yield message


def _opened(path: str) -> BinaryIO:
    """A file by any file system that Arrow knows, plain or compressed."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    raw = store.open_input_file(inner)
    packed = raw.read(2) == b"\x1f\x8b"
    raw.seek(0)
    return gzip.GzipFile(fileobj=raw) if packed else raw


class _File(InputPartition):
    def __init__(self, path: str, number: int) -> None:
        super().__init__(number)
        self.path, self.number = path, number


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [p for part in options["path"].split(",") for p in (sorted(glob.glob(part)) if any(c in part for c in "*?[") else [part])]
        if not self.paths:
            raise FileNotFoundError(f"No file at {options['path']}.")

    def partitions(self) -> list[InputPartition]:
        return [_File(p, i) for i, p in enumerate(self.paths)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(ALIGNMENTS)
        rows: list[dict] = []
        n = partition.number << _ROW_BITS
        with _opened(partition.path) as stream:
            for message in messages(stream):
                try:
                    rows.append({"read_id": n, "path": path_of(message)})
                except Malformed:
                    continue
                n += 1
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_pylist(rows, kind)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)


class AlignmentStream(DataSource):
    """read_id (the file's number and the message's place in it) and path of every alignment."""

    @classmethod
    def name(cls) -> str:
        return "alignment_stream"

    def schema(self):
        return ALIGNMENTS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
