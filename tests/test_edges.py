"""Edge cases of binary reads, chunks, regions, settings, selections and job states."""

import datetime
import struct
import zlib

from pyspark.sql import functions as F

from rasterspark.functions import binary
from rasterspark.operators import components, geometry, planes, selection
from rasterspark.plans import models, settings
from rasterspark.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def test_reads(spark):
    c = F.lit(b"\x01\x02\x03\x04\xff")
    assert one(spark, binary.read_uint(c, 0)) == 0x01020304 and one(spark, binary.read_uint(c, 0, little=True)) == 0x04030201
    assert one(spark, binary.read_uint(c, 3, 2)) == 0x04FF and one(spark, binary.read_uint(c, 2)) is None
    assert bytes(one(spark, binary.png_chunk("tEXt", F.lit(b"abc")))) == chunk(b"tEXt", b"abc")


def test_strip_png(spark):
    png = binary.SIGNATURE + chunk(b"IHDR", b"\0" * 13) + chunk(b"tIME", b"\1" * 7) + chunk(b"IDAT", b"x" * 9) + chunk(b"IEND", b"")
    plain = binary.SIGNATURE + chunk(b"IHDR", b"\0" * 13) + chunk(b"IDAT", b"x" * 9) + chunk(b"IEND", b"")
    rows = [(1, png + b"tail"), (2, png[:-20]), (3, png[:-16]), (4, b""), (5, None), (6, b"\xff\xd8\xff"), (None, plain)]
    got = {r.id: (None if r.content is None else bytes(r.content), r.kinds) for r in binary.strip_png(spark.createDataFrame(rows, "id long, content binary")).collect()}
    assert got[1] == (plain, ["IHDR", "tIME", "IDAT", "IEND"])
    assert got[2] == (png[:-20], None) and got[3] == (png[:-16], None)
    assert got[4] == (b"", None) and got[5] == (None, None) and got[6] == (b"\xff\xd8\xff", None) and got[None][0] == plain
    assert binary.strip_png(spark.createDataFrame([], "id long, content binary")).count() == 0


def test_regions_of_a_spiral_and_of_nothing(spark):
    art = ["#######", "......#", "#####.#", "#...#.#", "#.###.#", "#.....#", "#######", ".......", "#......"]
    rows = [(3, 7, x, y, ch == "#") for y, line in enumerate(art) for x, ch in enumerate(line)]
    mask = spark.createDataFrame(rows, "image_id long, w int, x int, y int, keep boolean")
    got = {(r.label, r.n, r.kept) for r in components.sizes(mask, 0.5).collect()}
    assert got == {(0, sum(line.count("#") for line in art) - 1, True), (56, 1, False)}
    assert components.sizes(mask.withColumn("keep", F.lit(False))).count() == 0


def test_resize_keeps_and_repeats(spark):
    plane = spark.createDataFrame([(1, 2, 1, 0, 0, 10.0), (1, 2, 1, 1, 0, 20.0)], "image_id long, w int, h int, x int, y int, v double")
    line = lambda w, h: [(r.x, r.y, r.v) for r in planes.bilinear_resize(plane, F.lit(w), F.lit(h)).orderBy("y", "x").collect()]
    assert line(2, 1) == [(0, 0, 10.0), (1, 0, 20.0)] and line(1, 1) == [(0, 0, 15.0)]
    assert line(4, 2) == [(x, y, v) for y in (0, 1) for x, v in enumerate((10.0, 12.5, 17.5, 20.0))]


def test_settings(spark):
    read = lambda s: one(spark, settings.merge(F.lit(s)))
    plain = read(None)
    assert plain.compression.custom.quality == 80 and plain.crop.padding == 8 and plain.resize.maxWidth == 1024
    assert read("not json") == plain and read("") == plain and read("{}") == plain
    some = read('{"resize":{"maxWidth":5},"compression":{"custom":{"lossless":true}},"new":1}')
    assert some.resize.maxWidth == 5 and some.resize.maxHeight == 1024 and some.compression.custom.lossless and some.compression.custom.quality == 80


def test_models(spark):
    go = lambda m, *off: one(spark, models.resolve(F.lit(m), F.array(*(F.lit(x) for x in off)).cast("array<string>")))
    assert go("birefnet-lite") == "birefnet-lite" and go("birefnet-lite", "birefnet-lite") == "rmbg-1.4"
    assert go("rmbg-1.4", "rmbg-1.4") == "rmbg-1.4" and go("none") is None
    assert models.usable(models.registry(spark), False).count() == 2
    devices = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, gpu boolean")
    assert {(r.id, r["count"]) for r in models.usable(models.offered(devices), F.col("gpu")).groupBy("id").count().collect()} == {(1, 3), (2, 2), (3, 2)}
    assert models.usable(models.offered(devices.limit(0)), F.col("gpu")).count() == 0


def test_selection_cases(spark):
    assert one(spark, geometry.aspect_differs(F.lit(None).cast("int"), F.lit(1), F.lit(1), F.lit(1))) and one(spark, geometry.aspect_differs(F.lit(5), F.lit(0), F.lit(1), F.lit(1)))
    assert not one(spark, geometry.aspect_differs(F.lit(1000), F.lit(1000), F.lit(1004), F.lit(1000)))
    roots = spark.createDataFrame([(1, "SLICE", False, None), (2, "GROUP", True, None), (3, "LINE", False, "locked"), (4, "TEXT", False, None)], "root long, kind string, has_children boolean, problem string")
    fills = spark.createDataFrame([(4,), (4,)], "root long")
    assert {(r.root, r.reason) for r in selection.unsupported(roots, fills).collect()} == {(1, "a slice holds no image"), (2, "no layer inside has an image"), (3, "locked")}


def test_job_state(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [(1, at(0), 1, "processing", "loading"), (1, at(1), 2, "failed", None), (1, at(2), 3, "processing", None), (2, at(0), 4, "pending", None), (3, at(1), 6, "processing", "resizing"), (3, at(1), 7, "completed", "complete")]
    got = {r.job: (r.status, r.stage, r.started_at, r.finished_at) for r in events.job_state(spark.createDataFrame(rows, "job long, ts timestamp, event_id long, status string, stage string"), "job").collect()}
    assert got == {1: ("processing", "loading", at(2), None), 2: ("pending", None, None, None), 3: ("completed", "complete", at(1), at(1))}


def test_scan(spark):
    rows = [(1, None, 2), (2, None, 1), (3, 1, 1), (4, 1, 0), (5, 4, 0), (8, 9, 0), (9, 8, 0)]
    nodes = spark.createDataFrame(rows, "node long, parent long, place int")
    got = [(r.node, r.root, r.depth) for r in selection.scan(nodes).orderBy("path").collect()]
    assert got == [(2, 2, 0), (1, 1, 0), (4, 1, 1), (5, 1, 2), (3, 1, 1)]
    assert selection.scan(nodes.limit(0)).count() == 0
