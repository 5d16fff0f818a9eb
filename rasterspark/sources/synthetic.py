"""Synthetic test images as pixel relations: gradients, illustrations, graphics, pixel art and noisy photographs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from rasterspark.operators.planes import stored
from rasterspark.operators.quantize import jump
from rasterspark.sources.pixels import grid


def canvas(spark: SparkSession, w: int, h: int, image_id: int = 0) -> DataFrame:
    return grid(spark.range(1).select(F.lit(image_id).cast("long").alias("image_id"), F.lit(w).alias("w"), F.lit(h).alias("h")))


def _pixels(df: DataFrame, r: Column, g: Column, b: Column, a: Column) -> DataFrame:
    return df.select("image_id", "w", "h", "x", "y", *(stored(v).alias(c) for c, v in zip("rgba", (r, g, b, a))))


def coverage(cx: float, cy: float, r: float) -> Column:
    """The share of a pixel's 4 x 4 sub-samples inside a disc."""
    inside = lambda i, j: F.when(F.pow(F.col("x") + (i + 0.5) / 4 - cx, 2) + F.pow(F.col("y") + (j + 0.5) / 4 - cy, 2) <= r * r, 1).otherwise(0)
    return sum(inside(i, j) for i in range(4) for j in range(4)) / 16


def gradient(spark: SparkSession, w: int = 512, h: int = 256, image_id: int = 0) -> DataFrame:
    x, y = F.col("x") / (w - 1), F.col("y") / (h - 1)
    return _pixels(canvas(spark, w, h, image_id), 255 * x, 200 * y + 30, 255 - 180 * x, F.lit(255))


def pixel_art(spark: SparkSession, side: int = 64, image_id: int = 0) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    i = (F.shiftright(x, 3) * 7 + F.shiftright(y, 3) * 3 + x.bitwiseXOR(y).bitwiseAND(F.lit(1))) % 16
    return _pixels(canvas(spark, side, side, image_id), i * 53 % 256, i * 97 % 256, i * 151 % 256, F.when(i == 0, 0).otherwise(255))


def flat_graphic(spark: SparkSession, w: int = 480, h: int = 320, image_id: int = 0) -> DataFrame:
    #: Background, and discs by place, radius (of the height) and colour.
    colours = [F.lit(float(v)) for v in (248, 246, 240)]
    for fx, fy, fr, rgb in ((0.3, 0.45, 0.22, (52, 101, 164)), (0.62, 0.55, 0.18, (237, 94, 72)), (0.8, 0.3, 0.1, (250, 196, 55))):
        c = coverage(fx * w, fy * h, fr * h)
        colours = [v * (1 - c) + k * c for v, k in zip(colours, rgb)]
    return _pixels(canvas(spark, w, h, image_id), *colours, F.lit(255))


def transparent_illustration(spark: SparkSession, w: int = 400, h: int = 300, image_id: int = 0) -> DataFrame:
    """A disc with a rim and a soft shadow on nothing."""
    cx, cy, r = 0.45 * w, 0.5 * h, 0.25 * min(w, h)
    apart = F.sqrt(F.pow(F.col("x") + 0.5 - cx - 12, 2) + F.pow(F.col("y") + 0.5 - cy - 14, 2))
    shadow = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (r + 10 - apart) / 20)) * 0.3
    df = canvas(spark, w, h, image_id).withColumns({"c": coverage(cx, cy, r), "i": coverage(cx, cy, r - 6), "s": shadow})
    df = df.withColumn("alpha", F.col("c") + F.col("s") * (1 - F.col("c")))
    colour = lambda inner, rim: F.when(F.col("alpha") > 0, (inner * F.col("i") + rim * (1 - F.col("i"))) * F.col("c") / F.col("alpha")).otherwise(0.0)
    return _pixels(df, colour(20, 240), colour(170, 120), colour(160, 30), F.floor(255 * F.col("alpha") + 0.5))


@F.pandas_udf(LongType())
def _drawn(nth: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series(jump(nth.to_numpy().astype(np.uint32), seed.to_numpy().astype(np.uint32)).astype(np.int64))


def photo_like(spark: SparkSession, w: int = 640, h: int = 480, seed: int = 1, image_id: int = 0) -> DataFrame:
    """Smooth colours with noise from the generator, drawn pixel by pixel for red, green and blue."""
    x, y = F.col("x"), F.col("y")
    noise = lambda k: (_drawn((y * w + x) * 3 + k + 1, F.lit(seed)) / 2**32 - 0.5) * 18
    base = 128 + 60 * F.sin(x / 37) * F.cos(y / 23) + 40 * F.sin((x + y) / 71)
    return _pixels(canvas(spark, w, h, image_id), base + 30 * F.sin(y / 13) + noise(0), 0.9 * base + 20 * F.cos(x / 19) + noise(1), 0.7 * base + 50 + noise(2), F.lit(255))


def catalogue(spark: SparkSession) -> DataFrame:
    """All of them, smaller than usual: gradient 0, pixel art 1, graphic 2, illustration 3, photograph 4."""
    images = gradient(spark, 128, 64, 0), pixel_art(spark, 64, 1), flat_graphic(spark, 240, 160, 2), transparent_illustration(spark, 200, 150, 3), photo_like(spark, 160, 120, 1, 4)
    out = images[0]
    for image in images[1:]:
        out = out.unionByName(image)
    return out
