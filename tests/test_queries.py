"""Every query of the engine's own operators against its SQL in DuckDB, and some exact cases."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from rasterspark import catalog as queries
from rasterspark.functions import text
from rasterspark.operators import analysis, geometry, planes
from rasterspark.sources import pixels
from rasterspark.streaming import events

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v if isinstance(v, (bool, str)) else round(float(v), 5) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, small, duck, name):
    df = queries.QUERIES[name](spark, small)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    cur = duck.execute(queries.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in cur.fetchall()), key=repr)
    assert got == expected


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_geometry_cases(spark):
    size = lambda w, h, **k: tuple(one(spark, geometry.target_size(F.lit(w), F.lit(h), 1024, 1024, **k)))
    assert size(4000, 3000) == (1024, 768) and size(3000, 4000) == (768, 1024) and size(300, 200) == (300, 200)
    assert size(300, 200, upscale=True) == (1024, 683) and size(2000, 1000, reserved=16) == (1008, 504) and size(2000, 500, keep_aspect=False) == (1024, 500)
    fill = one(spark, geometry.visible_fill(F.lit(400), F.lit(200), F.lit(2000), F.lit(2000)))
    assert (fill.y, fill.height) == (0.25, 0.5)


def test_formats(spark):
    sniff = lambda b: one(spark, text.sniff_format(F.lit(b)))
    assert sniff(b"\0\0\0\x1cftypmif1\0\0\0\0miafavif....") == "avif" and sniff(b"\0\0\0\x14ftypmif1\0\0\0\0miafavif....") == "unknown"
    assert sniff(b"RIFF\0\0\0\0WEBP") == "webp" and sniff(b"") == "unknown" and sniff(b"BMx") == "bmp"
    assert one(spark, text.format_bytes(F.lit(1536))) == "1.5 KB" and one(spark, text.format_bytes(F.lit(15 * 1024))) == "15 KB" and one(spark, text.sanitize(F.lit("..My  Logo (1).."))) == "my-logo-1"


def test_bounds_of_an_empty_image(spark):
    px = pixels.grid(spark.createDataFrame([(1, 2, 3)], "image_id long, w int, h int")).select("*", *(F.lit(0).alias(c) for c in "rgba"))
    assert analysis.content_bounds(px).first().x is None and analysis.crop_and_pad(px, analysis.content_bounds(px), 1).count() == 0
    assert analysis.analyze(px).first().content_type == "illustration" or analysis.analyze(px).first().content_type == "exact-color"


def test_stored_rounds_half_to_even(spark):
    assert [one(spark, planes.stored(F.lit(v))) for v in (0.5, 1.5, 2.5, -3.0, 300.0)] == [0, 2, 2, 0, 255]


def test_debounce_streams_like_batch(spark, small, tmp_path):
    spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    batch = events.debounce(spark.read.parquet(str(tmp_path / "in")), "30 minutes")
    stream = events.debounce(spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in")), "30 minutes", lateness="1 hour")
    run = stream.writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r.user_id, r.event_id, r.n) for r in spark.table("bursts").collect()}
    want = {(r.user_id, r.event_id, r.n) for r in batch.collect()}
    assert got <= want and len(got) > 0.9 * len(want)
