"""Metadata of files, and resampling of whole images."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterspark.functions import metadata
from rasterspark.operators import resample


def segment(marker, data):
    return bytes([0xFF, marker]) + struct.pack(">H", len(data) + 2) + data


def exif(value, order):
    pack = lambda kind, *v: struct.pack(order + kind, *v)
    return segment(0xE1, b"Exif\0\0" + (b"II" if order == "<" else b"MM") + pack("H", 42) + pack("I", 8) + pack("H", 2) + pack("HHIHH", 0x0100, 3, 1, 9, 0) + pack("HHIHH", 0x0112, 3, 1, value, 0))


def icc(kind, name):
    if kind == "desc":
        tag = b"desc" + bytes(4) + struct.pack(">I", len(name) + 1) + name.encode() + b"\0"
    else:
        tag = b"mluc" + bytes(4) + struct.pack(">II", 1, 12) + b"enUS" + struct.pack(">II", 2 * len(name), 28) + name.encode("utf-16-be")
    return bytes(128) + struct.pack(">I", 1) + b"desc" + struct.pack(">II", 144, len(tag)) + tag


def png(*chunks):
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in chunks)


@pytest.mark.parametrize("order", "<>")
def test_orientation(order):
    for value, want in ((1, 1), (6, 6), (8, 8), (0, 1), (9, 1)):
        assert metadata.orientation(b"\xff\xd8" + exif(value, order) + b"\xff\xdascan") == want
    assert metadata.orientation(b"\xff\xd8" + exif(6, order)[:20]) == 1 and metadata.orientation(b"") == 1


def test_profiles_and_stripping(spark):
    tail = b"\xff\xda\x00\x04pixels"
    jfif, adobe = segment(0xE0, b"JFIF"), segment(0xEE, b"Adobe")
    split = icc("desc", "Wide Gamut")
    profile = segment(0xE2, b"ICC_PROFILE\0\x01\x02" + split[:90]) + segment(0xE2, b"ICC_PROFILE\0\x02\x02" + split[90:])
    full = b"\xff\xd8" + jfif + segment(0xE1, b"http xmp") + segment(0xFE, b"comment") + profile + adobe + segment(0xED, b"x") + segment(0xDB, b"table") + tail
    plain = b"\xff\xd8" + jfif + profile + adobe + segment(0xDB, b"table") + tail
    turned = b"\xff\xd8" + exif(3, ">") + segment(0xFE, b"c") + tail
    named = png((b"IHDR", bytes(13)), (b"iCCP", b"any\0\0" + zlib.compress(icc("mluc", "IEC 61966-2.1"))), (b"tEXt", b"t"), (b"IDAT", b"d"), (b"IEND", b""))
    broken = png((b"IHDR", bytes(13)), (b"iCCP", b"any\0\0nonsense"), (b"IEND", b""))
    files = [full, turned, full[:-len(tail)], full[:40], named, broken, b"RIFF....WEBP", b"", None]
    got = [r for r in metadata.inspect(spark.createDataFrame(list(enumerate(files)), "id long, content binary")).orderBy("id").collect()]
    assert [r.description for r in got] == ["Wide Gamut", None, "Wide Gamut", None, "IEC 61966-2.1", None, None, None, None]
    assert [(r.has_profile, r.looks_srgb) for r in got] == [(True, False), (False, True), (True, False), (False, True), (True, True), (True, True), (False, True), (False, True), (False, True)]
    assert bytes(got[0].stripped) == plain and bytes(got[1].stripped) == turned and bytes(got[2].stripped) == files[2] and bytes(got[3].stripped) == files[3]
    assert bytes(got[4].stripped) == named.replace(png((b"tEXt", b"t"))[8:], b"") and got[8].stripped is None and [r.orientation for r in got[:2]] == [1, 3]


def kernel(name, x):
    x = abs(x)
    if name == "lanczos3":
        return np.sinc(x) * np.sinc(x / 3) if x < 3 else 0.0
    if name == "triangle":
        return max(0.0, 1 - x)
    return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0


def matrix(name, n, m):
    ratio = n / m
    w = np.array([[kernel(name, (j + 0.5 - (k + 0.5) * ratio) / max(ratio, 1)) for j in range(n)] for k in range(m)])
    return w / w.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("name,premultiply,linear", [("lanczos3", True, True), ("catrom", True, True), ("triangle", False, False)])
def test_resample_matches_weight_matrices(spark, name, premultiply, linear):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for i, (w, h, tw, th) in enumerate([(9, 7, 5, 4), (6, 5, 11, 9), (4, 4, 1, 1)]):
        image = rng.integers(0, 256, (h, w, 4))
        image[0, 0, 3] = 0
        rows += [(i, w, h, x, y, *image[y, x].tolist()) for y in range(h) for x in range(w)]
        v = image / 255
        if linear:
            v[..., :3] = np.where(v[..., :3] <= 0.04045, v[..., :3] / 12.92, ((v[..., :3] + 0.055) / 1.055) ** 2.4)
        if premultiply:
            v[..., :3] *= v[..., 3:]
        out = np.einsum("ky,lx,yxc->klc", matrix(name, h, th), matrix(name, w, tw), v)
        alpha = out[..., 3:].clip(0, 1)
        colour = np.where(alpha > 0, out[..., :3] / np.where(alpha > 0, alpha, 1), 0) if premultiply else out[..., :3]
        colour = colour.clip(0, 1)
        if linear:
            colour = np.where(colour <= 0.0031308, colour * 12.92, 1.055 * colour ** (1 / 2.4) - 0.055)
        want[i] = np.concatenate([colour, alpha], axis=2) * 255
    px = spark.createDataFrame(rows, "image_id long, w int, h int, x int, y int, r int, g int, b int, a int")
    size = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("image_id") + 1).cast("int"))
    got = resample.resample(px, size(5, 11, 1), size(4, 9, 1), name, premultiply, linear).collect()
    assert len(got) == 5 * 4 + 11 * 9 + 1
    assert all(np.abs(want[r.image_id][r.y, r.x] - [r.r, r.g, r.b, r.a]).max() <= 0.501 and (r.h, r.w) == want[r.image_id].shape[:2] for r in got)


def test_resize_takes_the_kernel_by_direction(spark):
    px = spark.createDataFrame([(i, 4, 4, x, y, 10 * x, 20 * y, 5, 255) for i in range(3) for y in range(4) for x in range(4)], "image_id long, w int, h int, x int, y int, r int, g int, b int, a int")
    side = F.element_at(F.array(F.lit(4), F.lit(2), F.lit(7)), (F.col("image_id") + 1).cast("int"))
    got = resample.resize(px, side, side).collect()
    assert sorted((r.image_id, r.x, r.y, r.r) for r in got if r.image_id == 0) == sorted((0, x, y, 10 * x) for x in range(4) for y in range(4))
    assert sum(r.image_id == 1 for r in got) == 4 and sum(r.image_id == 2 for r in got) == 49
