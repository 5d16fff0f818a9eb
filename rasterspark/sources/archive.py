"""One stored ZIP archive from all rows of a table, written by all tasks at once.

A member's place follows from the sizes of those before it, so the places are known before a byte is written: the
members are dealt by ranges of their names, each range is summed, and the driver adds up as many sums as there
are ranges. Then every task writes its members, and their entries of the central directory, at its own places
of one hidden file, and the driver adds the record at the end and gives the file its name. A task that runs again
writes the same bytes at the same places. Archives of 4 GB and more, or of many members, are ZIP64.

The folder must be one that all executors share, mounted as a path, whose files can be written at any place.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterspark.functions.lineage import cut

#: Fixed values of the format: sizes of a local header and a directory entry without the name, of the extra field, and the limits of the short form.
LOCAL, ENTRY, EXTRA, MOST, MANY = 30, 46, 12, 0xFFFFFFFF, 0xFFFF
_UTF8, _DATE = 1 << 11, 1 << 5 | 1  # names are UTF-8; 1 January 1980, so equal assets give equal archives


def _local(name: bytes, content: bytes) -> bytes:
    return struct.pack("<4s5H3L2H", b"PK\3\4", 20, _UTF8, 0, 0, _DATE, zlib.crc32(content), len(content), len(content), len(name), 0) + name


def _entry(name: bytes, content: bytes, at: int, wide: bool) -> bytes:
    extra = struct.pack("<2HQ", 1, 8, at) if wide else b""
    return struct.pack("<4s6H3L5H2L", b"PK\1\2", 45 if wide else 20, 45 if wide else 20, _UTF8, 0, 0, _DATE, zlib.crc32(content), len(content), len(content), len(name), len(extra), 0, 0, 0, 0, MOST if wide else at) + name + extra


def _end(members: int, start: int, size: int, wide: bool) -> bytes:
    long_form = wide or members >= MANY or start + size >= MOST
    out = b""
    if long_form:
        out += struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, members, members, size, start) + struct.pack("<4sLQL", b"PK\6\7", 0, start + size, 1)
    return out + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, *[MANY if long_form else members] * 2, *((MOST, MOST) if long_form else (size, start)), 0)


def write_archive(assets: DataFrame, path: str, most: int = MOST, parts: int | None = None) -> int:
    """assets (name, content) -> one archive at path, its members in the order of their names; gives their number.

    A null content is empty; names are unique (unique_names) and not null. most: bytes from which the long form is used.
    An existing file is replaced when all is written. An empty table gives an empty archive.
    """
    path = path.removeprefix("file:")
    parts = parts or int(assets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    content = F.coalesce("content", F.lit(b""))
    rows = cut(assets.select("name", content.alias("content")).repartitionByRange(parts, "name").sortWithinPartitions("name"))
    sums = {r["part"]: r for r in rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.sum(F.octet_length("name")).alias("names"), F.sum(F.length("content")).alias("size")).collect()}
    members = sum(r["n"] for r in sums.values())
    local = {p: r["n"] * LOCAL + r["names"] + r["size"] for p, r in sums.items()}
    directory = sum(local.values())
    wide = directory >= most
    entries = {p: r["n"] * (ENTRY + EXTRA * wide) + r["names"] for p, r in sums.items()}
    starts, at, entry = {}, 0, directory
    for p in sorted(sums):
        starts[p] = at, entry
        at, entry = at + local[p], entry + entries[p]
    folder, name = os.path.split(path)
    os.makedirs(folder or ".", exist_ok=True)
    hidden = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
    with open(hidden, "wb") as f:
        f.truncate(entry)

    def write(batches):
        at, entry = starts.get(TaskContext.get().partitionId(), (0, 0))
        n = 0
        with open(hidden, "r+b") as f:
            for batch in batches:
                listed = []
                f.seek(at)
                for name, held in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                    member = name.encode()
                    head = _local(member, held)
                    f.write(head)
                    f.write(held)
                    listed.append(_entry(member, held, at, wide))
                    at += len(head) + len(held)
                f.seek(entry)
                f.write(b"".join(listed))
                entry += sum(map(len, listed))
                n += len(listed)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    try:
        written = rows.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
        if written != members:
            raise RuntimeError(f"{written} of {members} members were written")
        with open(hidden, "r+b") as f:
            f.seek(entry)
            f.write(_end(members, directory, entry - directory, wide))
        os.replace(hidden, path)
    except BaseException:
        os.remove(hidden)
        raise
    return members
