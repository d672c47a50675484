"""The binary trace format: seven consecutive msgpack integers for each record, no header, -1 for null.

read() decodes files of any Hadoop file system, one task a file (the format can't be split); register() adds a
"msgpack_trace" data source that writes one file for each partition, and reads local or mounted paths.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from critpath.schema import RECORD, RECORD_COLUMNS

#: msgpack's integer markers with the width and kind of what follows.
_MARKERS = {0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_FIELDS = 7
_TABLE = {m: (struct.Struct(f), struct.calcsize(f)) for m, f in _MARKERS.items()}


class DecodeError(ValueError):
    pass


def decode_integers(data: bytes, pos: int, n: int) -> tuple[list[int], int]:
    out = []
    for _ in range(n):
        if pos >= len(data):
            raise DecodeError("the record ends early")
        m = data[pos]
        pos += 1
        if m < 0x80:
            out.append(m)
        elif m >= 0xE0:
            out.append(m - 256)
        else:
            if m not in _TABLE:
                raise DecodeError(f"marker {m:#x} is no integer")
            kind, size = _TABLE[m]
            if pos + size > len(data):
                raise DecodeError("the record ends early")
            out.append(kind.unpack_from(data, pos)[0])
            pos += size
    return out, pos


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def decode_records(data: bytes, strict: bool = False) -> Iterator[tuple]:
    """Records as (ts, worker, activity, event, correlator, remote worker, operator); a bad marker is skipped by a byte
    and reading goes on, or, if strict, is an error; so is an end within a record."""
    pos = 0
    while pos < len(data):
        try:
            (ts, worker, activity, event, *rest), pos = decode_integers(data, pos, _FIELDS)
        except DecodeError:
            if strict:
                raise
            pos += 1
            continue
        yield _signed(ts), worker, activity, event, *(None if x in (-1, (1 << 64) - 1) else _signed(x) for x in rest)


def encode_integer(x: int, signed: bool) -> bytes:
    if 0 <= x < 0x80:
        return bytes([x])
    if x < 0:
        if x >= -32:
            return bytes([256 + x])
        return next(bytes([m]) + struct.pack(f, x) for m, f, low in ((0xD0, ">b", -(1 << 7)), (0xD1, ">h", -(1 << 15)), (0xD2, ">i", -(1 << 31)), (0xD3, ">q", -(1 << 63))) if x >= low)
    markers = ((0xD0, ">b", 7), (0xD1, ">h", 15), (0xD2, ">i", 31), (0xD3, ">q", 63)) if signed else ((0xCC, ">B", 8), (0xCD, ">H", 16), (0xCE, ">I", 32), (0xCF, ">Q", 64))
    return next(bytes([m]) + struct.pack(f, x) for m, f, bits in markers if x < 1 << bits)


def encode_record(r: tuple) -> bytes:
    """r: ts, worker, activity, event, correlator, remote worker, operator."""
    return b"".join([encode_integer(x & ((1 << 64) - 1), False) for x in r[:4]] + [encode_integer(-1 if x is None else x, True) for x in r[4:]])


#: Bits of seq for a record's place in its file; the file's number is above them.
PLACE_BITS = 40


def read(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """All records of the files at path, with seq by file (in the order of their paths) and place: unique in the trace, one
    file's records count from 0."""
    files = spark.read.format("binaryFile").load(path)
    # the driver has listed the files already; their paths, not their content, are what this collects
    numbers = {p: n << PLACE_BITS for n, p in enumerate(sorted(r.path for r in files.select("path").collect()))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, seq = [], numbers[name]
                for r in decode_records(data.as_py(), strict):
                    rows.append((seq, *r))
                    seq += 1
                    if len(rows) == 1 << 16:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return files.select("path", "content").mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=RECORD_COLUMNS)


class _File(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class _Reader(DataSourceReader):
    def __init__(self, path: str, strict: bool):
        self.path, self.strict = path, strict

    def partitions(self) -> list[InputPartition]:
        paths = glob.glob(os.path.join(self.path, "*") if os.path.isdir(self.path) else self.path)
        kept = sorted(p for p in paths if not os.path.isdir(self.path) or not os.path.basename(p).startswith(("_", ".")))
        return [_File(p, n) for n, p in enumerate(kept)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for seq, r in enumerate(decode_records(f.read(), self.strict), partition.number << PLACE_BITS):
                yield (seq, *r)


class _Writer(DataSourceWriter):
    """Files appear under their last name at commit; an aborted write leaves none."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f".part-{uuid.uuid4().hex}.msgpack")
        with open(name, "wb") as f:
            for row in iterator:
                f.write(encode_record(tuple(row[c] for c in RECORD_COLUMNS[1:])))
        return _Written(name)

    def commit(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                os.rename(m.name, os.path.join(os.path.dirname(m.name), os.path.basename(m.name)[1:]))

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.name):
                os.remove(m.name)


class _Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class MsgpackTrace(DataSource):
    @classmethod
    def name(cls) -> str:
        return "msgpack_trace"

    def schema(self):
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("strict", "false") == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MsgpackTrace)
