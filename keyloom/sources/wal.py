"""The binary log format: batches of operations in checksummed records, records in blocks of 32 KiB.

Bytes are made and read by plain functions; DataFrames go through them a batch or a file at a time, by Arrow.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes import crc32c, get_slice, masked, put_slice, unmasked
from ..functions.keys import from_little_endian
from .files import Corruption, Files, file_name

# Fixed values of the format.
BLOCK, HEADER = 32768, 7
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4


def encode_batch(seq: int, ops: list[tuple[int, bytes, bytes | None]]) -> bytes:
    """First sequence, count, and each operation's kind, key and (if put) value."""
    body = b"".join(bytes([op]) + put_slice(key) + (put_slice(value or b"") if op else b"") for op, key, value in ops)
    return struct.pack("<QI", seq, len(ops)) + body


def decode_batch(data: bytes) -> list[tuple[int, int, bytes, bytes | None]]:
    """(seq, op, key, value) of a batch; Corruption if it is short, has an unknown kind or another count."""
    if len(data) < 12:
        raise Corruption("a batch is too short")
    seq, count = struct.unpack_from("<QI", data)
    at, out = 12, []
    while at < len(data):
        op = data[at]
        if op > 1:
            raise Corruption(f"kind {op} is unknown")
        parts, at = [], at + 1
        for _ in range(1 + op):
            found = get_slice(data, at)
            if found is None:
                raise Corruption("an operation is cut off")
            part, at = found
            parts.append(part)
        out.append((seq + len(out), op, parts[0], parts[1] if op else None))
    if len(out) != count:
        raise Corruption(f"{len(out)} operations, not {count}")
    return out


def encode_records(records: list[bytes]) -> bytes:
    """Records cut so that none crosses a block's end; a block's rest too short for a header is zeros."""
    out = bytearray()
    for data in records:
        at, begin = 0, True
        while begin or at < len(data):
            room = BLOCK - len(out) % BLOCK
            if room < HEADER:
                out += bytes(room)
                room = BLOCK
            part = data[at : at + room - HEADER]
            at += len(part)
            end = at == len(data)
            kind = FULL if begin and end else FIRST if begin else LAST if end else MIDDLE
            out += struct.pack("<IHB", masked(crc32c(bytes([kind]) + part)), len(part), kind) + part
            begin = False
    return bytes(out)


#: What is wrong where a part of a log can't be used.
OVERLONG, DAMAGED, HEADLESS, ENDLESS, STRANGE = "a part is longer than its block", "a part's checksum is wrong", "a record lacks its beginning", "a record lacks its end", "a part's kind is unknown"


def _parts(data: bytes, start: int) -> Iterator[tuple[int, int, bytes, str, int]]:
    """(offset, kind, payload, trouble, bytes lost) of the parts in the block of `start` and those after it; kind 0 is a
    break in what can be read. The end of data that stops inside a part was being written, and is no trouble."""
    for block in range(start // BLOCK * BLOCK, len(data), BLOCK):
        at, end = block, block + BLOCK
        while end - at >= HEADER:
            if len(data) - at < HEADER:
                return
            stored, size, kind = struct.unpack_from("<IHB", data, at)
            body = at + HEADER
            if not kind and not size:  # zeros: laid out ahead, not used
                yield at, 0, b"", "", 0
                break
            if body + size > len(data) and (body + size <= end or len(data) <= end):
                return
            payload = data[body : body + size]
            trouble = OVERLONG if body + size > end else DAMAGED if unmasked(stored) != crc32c(bytes([kind]) + payload) else ""
            if trouble:  # its length can't be trusted, so the block's rest goes with it
                yield at, 0, b"", trouble, min(end, len(data)) - at
                break
            yield at, kind, payload, "", 0
            at = body + size


def decode_records(data: bytes, start: int = 0) -> Iterator[tuple[int, bytes | None, str, int]]:
    """(offset, record, trouble, bytes lost) of the records that begin at `start` or behind it. A start that leaves no
    room for a header in its block means the next block."""
    if BLOCK - start % BLOCK < HEADER:
        start += BLOCK - start % BLOCK
    held: list[bytes] = []
    begin, entered = 0, start < BLOCK
    for at, kind, payload, trouble, lost in _parts(data, start):
        opens, closes = kind in (FULL, FIRST), kind in (FULL, LAST)
        if not entered and kind in (MIDDLE, LAST):  # of a record that begins before the first block read
            entered = closes
            continue
        entered = True
        if held and (opens or kind not in (MIDDLE, LAST)):
            if opens or trouble:
                yield begin, None, ENDLESS, sum(map(len, held))
            held = []
        if trouble:
            yield at, None, trouble, lost
        elif kind > LAST:
            yield at, None, STRANGE, len(payload)
        elif opens:
            held, begin = [payload], at
        elif kind and not held:
            yield at, None, HEADLESS, len(payload)
            continue
        elif kind:
            held.append(payload)
        if closes and held:
            if begin >= start:
                yield begin, b"".join(held), "", 0
            held = []


SCHEMA = "path string, record_offset long, seq long, op int, user_key binary, value binary, _corrupt string, _lost long"
#: Operations of an Arrow batch that a log is read into.
AT_ONCE = 20_000


def read_wal(spark: SparkSession, path: str | list[str], start: int = 0, paranoid: bool = False) -> DataFrame:
    """Operations of log files, or of all in a folder. What can't be read is a row with _corrupt and the bytes lost, or
    with paranoid an error. A file is read by one task, so writers keep files small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int64()]
        names = ["path", "record_offset", "seq", "op", "user_key", "value", "_corrupt", "_lost"]

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for offset, record, trouble, lost in decode_records(data, start):
                    try:
                        rows += [(name, offset, *r, None, 0) for r in decode_batch(record)] if record is not None else []
                    except Corruption as e:
                        trouble, lost = str(e), len(record)
                    if trouble and paranoid:
                        raise Corruption(f"{name} at {offset}: {trouble}")
                    if trouble:
                        rows.append((name, offset, None, None, None, None, trouble, lost))
                    if len(rows) >= AT_ONCE:
                        yield sent(rows)
                        rows = []
                yield sent(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def write_logs(log: DataFrame, root: str, first: int = 1, per_file: int = 100_000, batch: int = 1000) -> list[str]:
    """Binary log files of a change log (as encoded()): `per_file` consecutive sequences each, numbered from `first` in
    that order. Tasks write the bytes where Spark writes text (a row is a file, with one byte behind it that is too
    short for a header); files get their names when all are there. The names are returned."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([encode_records(held)], pa.binary())], ["file", "data"])

        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and k != last:
                    yield sent()
                    held = []
                last = k
                held.append(data)
        if held:
            yield sent()

    files = Files(log.sparkSession, root)
    rows = encoded(log, batch).select(F.floor((F.col("first_seq") - 1) / per_file).alias("file"), "data", "first_seq")
    rows = rows.repartition("file").sortWithinPartitions("file", "first_seq").select("file", "data").mapInArrow(join, "file long, data binary")
    at = f"logs-{uuid.uuid4().hex}"
    rows.select("file", F.col("data").cast("string").alias("value")).write.option("lineSep", "\0").partitionBy("file").text(f"{files.root}/{at}")
    names = []
    for folder in sorted((x for x in files.list(at) if x.startswith("file=")), key=lambda x: int(x[5:])):
        (part,) = [x for x in files.list(f"{at}/{folder}") if x.startswith("part-")]
        names.append(file_name("log", first + len(names)))
        files.rename(f"{at}/{folder}/{part}", names[-1])
    files.delete(at)
    return names


def operations(rows: DataFrame, value: str = "string") -> DataFrame:
    """user_key, seq, op, value of the sound rows of read_wal()."""
    return rows.where("_corrupt is null").select(F.col("user_key").cast("string").alias("user_key"), "seq", "op", F.col("value").cast("string").cast(value).alias("value"))


def batch_header(data: Column) -> tuple[Column, Column]:
    """First sequence and count of a batch's bytes."""
    return from_little_endian(data, 0, 8), from_little_endian(data, 8, 4).cast("int")


def encoded(log: DataFrame, batch: int = 1000) -> DataFrame:
    """first_seq, data: the log (user_key, seq, op, value as text) as batches of consecutive sequences, each one
    record's payload. Sequences are dealt to batches by number, so a batch is one group of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ops, first = None, [], 0
        out: list[tuple[int, bytes]] = []
        for b in batches:
            for k, seq, op, key, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ops and (k != last or seq != first + len(ops)):
                    out.append((first, encode_batch(first, ops)))
                    ops = []
                if not ops:
                    first = seq
                last = k
                ops.append((op, key, value))
        if ops:
            out.append((first, encode_batch(first, ops)))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["first_seq", "data"])

    rows = log.select(F.floor((F.col("seq") - 1) / batch).alias("k"), "seq", "op", F.col("user_key").cast("binary").alias("user_key"), F.col("value").cast("string").cast("binary").alias("value"))
    return rows.repartition("k").sortWithinPartitions("k", "seq").mapInArrow(run, "first_seq long, data binary")


def decoded(batches: DataFrame) -> DataFrame:
    """user_key, seq, op, value (text) of encoded() batches."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [r for data in b.column(0).to_pylist() for r in decode_batch(data)]
            yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows], pa.binary()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.binary())], ["user_key", "seq", "op", "value"])

    out = batches.select("data").mapInArrow(run, "user_key binary, seq long, op int, value binary")
    return out.select(F.col("user_key").cast("string").alias("user_key"), "seq", "op", F.col("value").cast("string").alias("value"))
