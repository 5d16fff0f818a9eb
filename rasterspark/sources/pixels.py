"""Pixel relations: one row a pixel, (image_id, w, h, x, y, r, g, b, a)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterspark.functions.lineage import cut, dealt


def grid(images: DataFrame) -> DataFrame:
    """Images (image_id, w, h) exploded to their pixel places, without a shuffle."""
    return images.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))


def from_parts(part: DataFrame, side: int = 8) -> DataFrame:
    """Images made from the part table in whole numbers; four kinds of content by id.

    They have few pixels each, so whole images are dealt to tasks, before there is a row for each pixel.
    """
    key = F.col("p_partkey").cast("long")
    images = part.select(key.alias("image_id"), (F.lit(side) + F.col("p_size") % 9).cast("int").alias("w"), (F.lit(side - 2) + key % 7).cast("int").alias("h"))
    i, x, y = F.col("image_id"), F.col("x"), F.col("y")
    kind = i % 4
    step = F.floor(x / 3)
    r = F.when(kind == 1, (i * 7 + step) % 256).otherwise((i * 7 + x * 13 + y * 29) % 256).cast("int")
    g = F.when(kind == 1, i * 3 % 256).when(kind == 2, F.col("r")).otherwise((i * 3 + x * x) % 256).cast("int")
    b = F.when(kind == 1, i % 256).when(kind == 2, F.col("r")).otherwise((y * y * 5 + i) % 256).cast("int")
    a = F.when(kind == 3, 255).when((x < 2) | (y < 1), 0).when(x == 2, i * 11 % 256).otherwise(255).cast("int")
    return grid(dealt(images, "image_id")).withColumn("r", r).withColumn("g", g).withColumn("b", b).withColumn("a", a)


def lined(px: DataFrame, *keep: str) -> DataFrame:
    """The same pixels, materialised as `cut` does, a row for each line of an image with a number for each pixel, which takes an
    eighth of the room; then dealt by image, as a checkpoint forgets how its rows were dealt. Channels are whole numbers from
    0 to 255; a candidate's r2, g2, b2 and a2 are a second number. keep: further columns, which don't differ within an image.
    """
    kinds = dict(px.dtypes)
    shares = {"v": [("x", 32, 0x7FFFFFFF), ("r", 24, 255), ("g", 16, 255), ("b", 8, 255), ("a", 0, 255)]}
    if "r2" in kinds:
        shares["v2"] = [(f"{c}2", bits, most) for c, bits, most in shares["v"][1:]]
    numbers = F.struct(*(sum(F.shiftleft(F.col(c).cast("long"), bits) for c, bits, _ in own).alias(name) for name, own in shares.items()))
    lines = cut(px.groupBy("image_id", "w", "h", "y", *keep).agg(F.collect_list(numbers if "v2" in shares else numbers["v"]).alias("_line")))
    rows = dealt(lines, "image_id").withColumn("_v", F.explode("_line"))
    number = lambda name: F.col("_v")[name] if "v2" in shares else F.col("_v")
    return rows.withColumns({c: F.shiftright(number(name), bits).bitwiseAND(F.lit(most)).cast(kinds[c]) for name, own in shares.items() for c, bits, most in own}).select(*px.columns)


def degraded(px: DataFrame) -> DataFrame:
    """The same pixels with the candidate's values r2, g2, b2, a2 beside them."""
    return px.select("*", F.least(F.lit(255), F.col("r") + F.col("x") * F.col("y") % 5).alias("r2"), F.greatest(F.lit(0), F.col("g") - F.col("x") % 3).alias("g2"), F.col("b").alias("b2"), F.greatest(F.lit(0), F.col("a") - F.col("y") % 4).alias("a2"))
