"""What Spark makes of pixel relations, whose size it guesses from the small files that they come from."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as entry


def plan(df):
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain()
    return out.getvalue()


def exchanges(text):
    """Exchanges and broadcasts but those that deal the images, or rows that are made of part alone."""
    return re.findall(r"BroadcastHashJoin|Exchange hashpartitioning\([^)]*\b[xyrgbawh]#[^)]*\)", text)


@pytest.mark.parametrize("name", ["crop_pad_pixels", "pixel_pairs", "nearest_palette", "palette_population"])
def test_no_pixel_is_sent(spark, small, name):
    assert exchanges(plan(entry.queries()[name](spark, small))) == []


def test_regions_across_bands_of_rows(spark):
    """Images of several bands and batches, against a flood fill."""
    import numpy as np

    from rasterspark.operators import components

    drawn, rows, want = np.random.default_rng(1), [], {}
    for image, (w, h, share) in enumerate([(7, 5, 0.6), (20, 2 * components.BAND + 3, 0.62), (1, components.BAND + 9, 0.9)]):
        mask = drawn.random((h, w)) < share
        rows += [(image, w, x, y, bool(mask[y, x])) for y in range(h) for x in range(w)]
        for y, x in zip(*np.nonzero(mask)):
            if (image, x, y) not in want:
                todo = [(x, y)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < w and 0 <= b < h and mask[b, a] and (image, a, b) not in want:
                        want[image, a, b] = y * w + x
                        todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        found = components.regions(spark.createDataFrame(rows, "image_id long, w int, x int, y int, keep boolean")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.image_id, x, r.y): r.label for r in found for x in range(r.x0, r.x0 + r.n)} == want


@pytest.mark.parametrize("name", ["component_sizes"])
def test_regions_of_small_images_are_not_joined(spark, small, name):
    assert "Join" not in plan(entry.queries()[name](spark, small))


@pytest.mark.parametrize("name", ["clean_matte"])
def test_mattes_are_not_broadcast(spark, small, name):
    assert "BroadcastHashJoin" not in plan(entry.queries()[name](spark, small))


@pytest.mark.parametrize("name", ["guided_filter", "thumbnails"])
def test_neighbours_are_found_without_sending_pixels(spark, small, name):
    assert not re.search(r"Exchange hashpartitioning\([^)]*, ", re.sub(r", \d+\)", ")", "\n".join(x for x in plan(entry.queries()[name](spark, small)).splitlines() if "image_id" in x)))


@pytest.mark.parametrize("name", ["search_rounds"])
def test_searches_meet_their_answers_by_sorts(spark, small, name):
    assert "BroadcastHashJoin" not in plan(entry.queries()[name](spark, small))


def test_pixels_are_kept_as_lines(spark, small, monkeypatch):
    from rasterspark.sources import pixels

    written = []
    monkeypatch.setattr(pixels, "cut", lambda df, cut=pixels.cut: written.append(cut(df)) or written[-1])
    px = pixels.from_parts(spark.read.parquet(f"{small}/part.parquet").filter("p_partkey % 20 = 3")).withColumn("more", pixels.F.col("image_id") % 2 == 0)
    back = pixels.lined(px, "more")
    assert back.dtypes == px.dtypes and sorted(back.collect()) == sorted(px.collect())
    assert written[0].count() == px.select("image_id", "y").distinct().count()
    pairs = pixels.degraded(px.drop("more"))
    assert sorted(pixels.lined(pairs).collect()) == sorted(pairs.collect())


@pytest.mark.parametrize("name", ["refine_edges"])
def test_no_exchange_of_pixels_between_filters(spark, small, name):
    assert exchanges(plan(entry.queries()[name](spark, small))) == []


@pytest.mark.parametrize("name", ["compare_images", "kmeans_three", "remap_palette"])
def test_no_broadcast_of_colours(spark, small, name):
    assert "BroadcastHashJoin" not in plan(entry.queries()[name](spark, small))
