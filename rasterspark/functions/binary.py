"""Reads from binary columns, and PNG chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The chunks that change how a PNG renders.
RENDERING = ["IHDR", "PLTE", "IDAT", "IEND", "tRNS", "gAMA", "cHRM", "sRGB", "iCCP", "sBIT"]
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def read_uint(content: Column, at: Column | int, width: int = 4, little: bool = False) -> Column:
    """The unsigned integer of `width` bytes at a place counted from 0; null past the end."""
    place = F.lit(at) if isinstance(at, int) else at
    part = F.substring(content, place + 1, F.lit(width))
    if little:
        part = F.unhex(F.array_join(F.transform(F.sequence(F.lit(width), F.lit(1), F.lit(-1)), lambda k: F.hex(F.substring(part, k, F.lit(1)))), ""))
    return F.when(F.length(part) == width, F.conv(F.hex(part), 16, 10).cast("long"))


def png_chunk(kind: str, data: Column) -> Column:
    """A PNG chunk: length, kind, data, checksum."""
    body = F.concat(F.encode(F.lit(kind), "US-ASCII"), data)
    number = lambda v: F.unhex(F.lpad(F.hex(v), 8, "0"))
    return F.concat(number(F.length(data).cast("long")), body, number(F.crc32(body)))


def chunk_bounds(content: bytes) -> list[tuple[str, int, int]] | None:
    """(kind, begin, end) of each chunk up to IEND; None for another kind of file or a chunk cut short."""
    if content[:2] != SIGNATURE[:2]:
        return None
    at, found = len(SIGNATURE), []
    while at + 12 <= len(content):
        end = at + 12 + int.from_bytes(content[at : at + 4], "big")
        if end > len(content):
            return None
        found.append((content[at + 4 : at + 8].decode("latin-1"), at, end))
        at = end
        if found[-1][0] == "IEND":
            break
    return found


def strip_png(files: DataFrame) -> DataFrame:
    """(id long, content binary) -> id, content without chunks that do not render, the kinds found.

    A file that is no PNG, or whose chunks are cut short, comes back unchanged with null kinds.
    """

    def run(batches):
        for batch in batches:
            contents, kinds = [], []
            for content in batch.column("content").to_pylist():
                bounds = None if content is None else chunk_bounds(content)
                if bounds is not None:
                    content = content[: len(SIGNATURE)] + b"".join(content[a:b] for kind, a, b in bounds if kind in RENDERING)
                contents.append(content)
                kinds.append(None if bounds is None else [kind for kind, _, _ in bounds])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(contents, pa.binary()), pa.array(kinds, pa.list_(pa.string()))], names=["id", "content", "kinds"])

    return files.select("id", "content").mapInArrow(run, "id long, content binary, kinds array<string>")
