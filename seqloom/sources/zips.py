"""Zip archives read by many tasks.

Each member of an archive begins with the same four bytes. Spark's text reader takes them for the end of a record,
so it cuts an archive into its members, wherever splits of bytes begin, and streams them through the tasks. The
four bytes may also occur inside a member's data: then its records are put together again until its stream of
compressed data ends, or all its bytes are there. Where a split begins with such a record, its check sum fails;
what does not end in one split, and what a split begins with before its first sound member, is put together in a
further step, in order. (Members of an archive that is itself stored in an archive look sound: the one that a
split begins with may be listed.)
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: marks of a member and of the list of members, the fixed part of a member's head,
#: a flag for sizes that follow the data, a flag for names in UTF-8, the two methods, and the size that points to
#: the extra field with its number.
MEMBER, LISTED = "PK\x03\x04", b"PK\x01\x02"
HEAD = struct.Struct("<HHHHHIIIHH")
TRAILING, UTF8 = 0x08, 0x800
STORED, DEFLATED = 0, 8
LONG, LONG_FIELD = 0xFFFFFFFF, 1


class Member:
    """A member whose records come in one by one."""

    def __init__(self, record: bytes):
        _, flags, self.method, _, _, self.sum, self.size, _, n, extra = HEAD.unpack_from(record)
        name = record[HEAD.size : HEAD.size + n]
        self.name = name.decode() if flags & UTF8 else name.decode("cp437")
        self.trailing = bool(flags & TRAILING)
        fields = record[HEAD.size + n : HEAD.size + n + extra]
        while self.size == LONG and len(fields) >= 4:
            number, size = struct.unpack_from("<HH", fields)
            if number == LONG_FIELD:
                (self.size,) = struct.unpack_from("<Q", fields, 12)  # after the size of the text
            fields = fields[4 + size :]
        self.inflate = zlib.decompressobj(-15) if self.method == DEFLATED else None
        if self.method not in (STORED, DEFLATED) or flags & 1:
            raise ValueError(f"{self.name}: method {self.method} or encryption is not read")
        if self.method == STORED and self.trailing:
            raise ValueError(f"{self.name}: stored data without its size")
        self.data, self.left, self.done = [], self.size, False
        self.feed(record[HEAD.size + n + extra :])

    def feed(self, data: bytes) -> None:
        if self.inflate:
            self.data.append(self.inflate.decompress(data))
            self.done = self.inflate.eof
            if self.done and self.trailing:  # the sum follows, maybe after a mark
                rest = self.inflate.unused_data
                rest = rest[4:] if rest[:4] == b"PK\x07\x08" else rest
                self.sum = struct.unpack_from("<I", rest)[0] if len(rest) >= 4 else None
        else:
            self.data.append(data[: self.left])
            self.left -= len(self.data[-1])
            self.done = self.left == 0

    def content(self) -> bytes:
        out = b"".join(self.data)
        if not self.done or (self.sum is not None and zlib.crc32(out) != self.sum):
            raise ValueError(f"{self.name} is not whole: it is damaged, or parted by a split (raise spark.sql.files.maxPartitionBytes)")
        return out


def members(records: Iterator[bytes]) -> Iterator[Member]:
    """The members of records that begin with a member; what follows the last one is passed over."""
    now: Member | None = None
    for record in records:
        if now and not now.done:
            now.feed(MEMBER.encode() + record)
        elif len(record) >= HEAD.size:
            now = Member(record)
        else:
            continue
        if now.done:
            yield now
    if now and not now.done:
        now.content()


def _sound(records: list[bytes]) -> Member | bool | None:
    """The member that these records make up; False if they do not, null if more may follow."""
    try:
        member = Member(records[0])
        for record in records[1:]:
            member.feed(MEMBER.encode() + record)
        if not member.done:
            return None
        member.content()
        return member
    except (ValueError, struct.error, zlib.error):
        return False


def parts(records: Iterator[bytes], known: bool) -> Iterator[tuple[Member | None, list[bytes]]]:
    """The members of one split, and records that another step has to put together: those before the first sound
    member, unless it is known that the split begins with one, and those of a member that does not end here."""
    waiting: list[bytes] = []
    for record in records:
        waiting.append(record)
        while waiting and (sound := _sound(waiting)) is not None:
            if sound:
                yield sound, []
                waiting, known = [], True
            elif known:
                if len(record) >= HEAD.size or len(waiting) > 1:
                    raise ValueError("a damaged archive")
                waiting = []
            else:
                yield None, waiting[:1]
                waiting = waiting[1:]
    if waiting:
        yield None, waiting


def read_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """archive, member, text of the files in zip archives whose names end like that (UTF-8 texts of 2 GB at most)."""
    raw = spark.read.option("lineSep", MEMBER).text(path).select(F.col("_metadata.file_path").alias("archive"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("record"))
    names = ["archive", "member", "text", "start", "n", "record"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    row = lambda *values: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)
    wanted = lambda member: member.name.endswith(suffix) and not member.name.endswith("/")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = ((a.as_py(), s.as_py(), r) for batch in batches for a, s, r in zip(*batch.columns))
        for (archive, start), group in groupby(lines, key=lambda line: line[:2]):
            records = (r.as_py() for _, _, r in group)
            if start == 0:
                next(records, None)  # empty: an archive begins with a member
            n = 0
            for member, pieces in parts(records, start == 0):
                if member and wanted(member):
                    yield row(archive, member.name, member.content().decode(), None, None, None)
                for piece in pieces:
                    yield row(archive, None, None, start, n, piece)
                    n += 1

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = ((a.as_py(), r) for batch in batches for a, r in zip(batch.column(0), batch.column(5)))
        for archive, group in groupby(lines, key=lambda line: line[0]):
            for member in members(r.as_py() for _, r in group):
                if wanted(member):
                    yield row(archive, member.name, member.content().decode(), None, None, None)

    schema = "archive string, member string, text string, start long, n long, record binary"
    found = raw.mapInArrow(split, schema)
    parted = found.where("record is not null").repartition("archive").sortWithinPartitions("archive", "start", "n").mapInArrow(join, schema)
    return found.where("member is not null").unionByName(parted).select("archive", "member", "text")
