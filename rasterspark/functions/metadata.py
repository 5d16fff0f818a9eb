"""Metadata of image files: colour profiles, orientation, and what stripping leaves.

Containers are walked segment by segment in Python, a few steps a file and never over its pixels, as
Spark has no expression for a walk of unknown length; everything else is columns.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from rasterspark.functions.binary import RENDERING, SIGNATURE, chunk_bounds

#: JPEG application segments that change how an image renders (JFIF, colour profile, Adobe), the start of the scan, end, comment.
KEPT, SCAN, END, COMMENT = (0xE0, 0xE2, 0xEE), 0xDA, 0xD9, 0xFE
SRGB = re.compile(r"srgb|iec\s*61966", re.I)
PROFILE_MARK, EXIF_MARK, ORIENTATION = b"ICC_PROFILE", b"Exif\0\0", 0x0112


def segments(content: bytes):
    """(marker, begin, end) of a JPEG's segments up to the scan, whose end is the file's; a last (None, ..) if cut short."""
    at = 2
    while at + 4 <= len(content):
        if content[at] != 0xFF:
            yield None, at, len(content)
            return
        marker = content[at + 1]
        if marker == SCAN:
            yield marker, at, len(content)
            return
        end = at + 2 + int.from_bytes(content[at + 2 : at + 4], "big")
        if end > len(content):
            yield None, at, len(content)
            return
        yield marker, at, end
        if marker == END:
            return
        at = end


def is_jpeg(content: bytes) -> bool:
    return content[:2] == b"\xff\xd8"


def orientation(content: bytes) -> int:
    """The EXIF orientation, 1 to 8; 1 if there is none or it is out of range."""
    if not is_jpeg(content):
        return 1
    for marker, begin, end in segments(content):
        if marker in (None, SCAN, END):
            break
        if marker != 0xE1 or content[begin + 4 : begin + 10] != EXIF_MARK:
            continue
        tiff = content[begin + 10 :]
        order = "little" if tiff[:1] == b"I" else "big"
        number = lambda at, n: int.from_bytes(tiff[at : at + n], order)  # noqa: E731, B023
        first = number(4, 4)
        for entry in range(first + 2, first + 2 + 12 * number(first, 2), 12):
            if entry + 12 > len(tiff):
                break
            if number(entry, 2) == ORIENTATION:
                value = number(entry + 8, 2)
                return value if 1 <= value <= 8 else 1
        break
    return 1


def profile(content: bytes) -> bytes | None:
    """The colour profile; empty if it is there but can't be read, None if there is none."""
    if is_jpeg(content):
        parts = [content[b + 18 : e] for m, b, e in segments(content) if m == 0xE2 and content[b + 4 : b + 15] == PROFILE_MARK]
        return b"".join(parts) if parts else None
    for kind, begin, end in chunk_bounds(content) or ():
        if kind == "iCCP":
            body = content[begin + 8 : end - 4]
            try:
                return zlib.decompress(body[body.index(0) + 2 :])
            except (ValueError, zlib.error):
                return b""
        if kind == "IDAT":
            break
    return None


def description(profile: bytes) -> str | None:
    """The profile's name: of version 2 (one text) or 4 (texts by language, the first)."""
    number = lambda at: int.from_bytes(profile[at : at + 4], "big")
    for entry in range(132, min(132 + 12 * number(128), len(profile) - 11), 12):
        if profile[entry : entry + 4] != b"desc":
            continue
        at = number(entry + 4)
        kind = profile[at : at + 4]
        if kind == b"desc":
            return profile[at + 12 : at + 11 + max(1, number(at + 8))].decode("latin-1").rstrip("\0")
        if kind == b"mluc":
            begin = at + number(at + 24)
            return profile[begin : begin + number(at + 20) // 2 * 2].decode("utf-16-be", "replace")
    return None


def stripped(content: bytes) -> bytes:
    """The file without metadata that does not change how it renders; as it was if it is cut short, rotated by its
    metadata, or of another kind.
    """
    if not is_jpeg(content):
        bounds = chunk_bounds(content)
        return content if bounds is None else content[: len(SIGNATURE)] + b"".join(content[a:b] for kind, a, b in bounds if kind in RENDERING)
    found = list(segments(content))
    if not found or found[-1][0] != SCAN or orientation(content) > 1:
        return content
    dropped = lambda m: m == COMMENT or (0xE0 <= m <= 0xEF and m not in KEPT)
    return content[:2] + b"".join(content[a:b] for m, a, b in found if not dropped(m))


def inspect(files: DataFrame) -> DataFrame:
    """(id long, content binary) -> id, orientation, has_profile, description, looks_srgb, stripped.

    A profile without a readable name counts as sRGB. A null file has orientation 1 and no profile.
    """

    def run(batches):
        for batch in batches:
            out = []
            for content in batch.column("content").to_pylist():
                held = content or b""
                found = profile(held)
                name = description(found) if found else None
                out.append((orientation(held), found is not None, name, name is None or bool(SRGB.search(name)), None if content is None else stripped(content)))
            kinds = [pa.int32(), pa.bool_(), pa.string(), pa.bool_(), pa.binary()]
            columns = [pa.array(c, kind) for c, kind in zip(list(zip(*out)) or [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "orientation", "has_profile", "description", "looks_srgb", "stripped"])

    return files.select("id", "content").mapInArrow(run, "id long, orientation int, has_profile boolean, description string, looks_srgb boolean, stripped binary")
