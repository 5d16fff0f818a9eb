"""Per-pixel projections and neighbourhood filters on pixel relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Full-range BT.601 weights.
YCBCR = {"luma": (0.299, 0.587, 0.114, 0.0), "cb": (-0.168736, -0.331264, 0.5, 128.0), "cr": (0.5, -0.418688, -0.081312, 128.0)}


def stored(value: Column) -> Column:
    """A number as an 8-bit clamped array stores it: half to even, 0 to 255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.bround(value).cast("int")))


PLACE = ("image_id", "x", "y")


def at_places(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Two relations with each place (image_id, x, y) once at most, joined by it, columns as of a join by these names.

    Rows of both are grouped instead of joined: where both are dealt by image no pixel is sent, else each is sent once.
    how: inner or left.
    """
    mine, theirs = ([c for c in df.columns if c not in PLACE] for df in (left, right))
    both = left.withColumn("_mine", F.lit(True)).unionByName(right.withColumn("_theirs", F.lit(True)), allowMissingColumns=True)
    met = both.groupBy(*PLACE).agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("_mine", "_theirs", *mine, *theirs)))
    return met.filter(F.col("_mine") if how == "left" else F.col("_mine") & F.col("_theirs")).select(*PLACE, *mine, *theirs)


def flatten_onto(px: DataFrame, background: int = 255) -> DataFrame:
    share = F.col("a") / 255
    out = [stored(F.col(c) * share + (1 - share) * background).alias(c) for c in "rgb"]
    return px.select("image_id", "w", "h", "x", "y", *out, F.lit(255).alias("a"))


def ycbcr(px: DataFrame, background: int | None = 255, suffix: str = "") -> DataFrame:
    """Adds luma, cb and cr (single precision), composited on the background if one is given."""
    share = F.col(f"a{suffix}") / 255
    c = [F.col(f"{x}{suffix}") * share + (1 - share) * background if background is not None else F.col(f"{x}{suffix}") for x in "rgb"]
    return px.select("*", *((k[0] * c[0] + k[1] * c[1] + k[2] * c[2] + k[3]).cast("float").alias(f"{n}{suffix}") for n, k in YCBCR.items()))


def halve(plane: DataFrame) -> DataFrame:
    """(image_id, w, h, x, y, v) -> 2 x 2 means; an odd last row or column is left out."""
    even = plane.filter((F.col("x") < F.floor(F.col("w") / 2) * 2) & (F.col("y") < F.floor(F.col("h") / 2) * 2))
    return even.groupBy("image_id", F.floor(F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("y") / 2).cast("int").alias("y")).agg(F.avg("v").alias("v"))


def box_downscale(px: DataFrame, factor: int) -> DataFrame:
    """Premultiplied means of factor x factor boxes; incomplete boxes are left out."""
    whole = px.filter((F.col("x") < F.floor(F.col("w") / factor) * factor) & (F.col("y") < F.floor(F.col("h") / factor) * factor))
    s = whole.groupBy("image_id", F.floor(F.col("x") / factor).cast("int").alias("x"), F.floor(F.col("y") / factor).cast("int").alias("y")).agg(
        *(F.sum(F.col(c) * F.col("a")).alias(c) for c in "rgb"), F.sum("a").alias("a"))
    return s.select("image_id", "x", "y", *(F.when(F.col("a") > 0, stored(F.col(c) / F.col("a"))).otherwise(0).alias(c) for c in "rgb"), stored(F.col("a") / (factor * factor)).alias("a"))


def _line(across: str, along: str):
    return Window.partitionBy("image_id", across).orderBy(along)


def binomial_blur(plane: DataFrame) -> DataFrame:
    """Separable 1 2 1 blur with the border repeated."""

    def step(df, across, along):
        w = _line(across, along)
        return df.withColumn("v", (F.coalesce(F.lag("v").over(w), "v") + 2 * F.col("v") + F.coalesce(F.lead("v").over(w), "v")) / 4)

    return step(step(plane, "y", "x"), "x", "y")


def box_blur(plane: DataFrame, radius: float) -> DataFrame:
    """Separable mean over 2r + 1 places, clipped at the border; a radius of 0 or less changes nothing."""
    if radius <= 0:
        return plane
    r = max(1, int(radius + 0.5))
    out = plane
    for across, along in (("y", "x"), ("x", "y")):
        out = out.withColumn("v", F.avg("v").over(_line(across, along).rowsBetween(-r, r)))
    return out


def dilate(mask: DataFrame, radius: int) -> DataFrame:
    """(.., keep boolean) -> keep where any place within the radius, along x then y, is kept."""
    out = mask
    for across, along in (("y", "x"), ("x", "y")):
        out = out.withColumn("keep", F.max("keep").over(_line(across, along).rowsBetween(-radius, radius)))
    return out


def edge_map(px: DataFrame) -> DataFrame:
    """Dithering weight: 1 on flat ground, down to 0.15 at an edge, from integer luma."""
    v = px.withColumn("v", F.shiftright(F.col("r") * 54 + F.col("g") * 183 + F.col("b") * 19, 8) * (F.col("a") / 255))
    near = [f("v").over(_line(*d)) for d in (("y", "x"), ("x", "y")) for f in (F.lag, F.lead)]
    return v.withColumn("weight", F.greatest(F.lit(0.15), 1 - F.greatest(*(F.coalesce(F.abs(n - F.col("v")), F.lit(0)) for n in near)) / 40.0))


def area_downsample(px: DataFrame, width: int, height: int) -> DataFrame:
    """Means of colour and opacity over the cells of a width x height grid."""
    cx, cy = F.floor(F.col("x") * width / F.col("w")).cast("int"), F.floor(F.col("y") * height / F.col("h")).cast("int")
    return px.groupBy("image_id", cx.alias("cx"), cy.alias("cy")).agg(*(F.avg(c).alias(c) for c in "rgba"))


def normalize_mask(masks: DataFrame, mode: str) -> DataFrame:
    """(id, data array) -> values in 0 to 1: none, sigmoid, minmax, or auto."""
    clamp = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    d = F.transform("data", lambda v: v.cast("double"))
    low, high = F.array_min(d), F.array_max(d)
    plain, sigmoid = F.transform(d, clamp), F.transform(d, lambda v: 1 / (1 + F.exp(-v)))
    level = F.transform(d, lambda v: F.when(high > 0.5, 1.0).otherwise(0.0))
    spread = F.when(high - low < 1e-6, level).otherwise(F.transform(d, lambda v: (v - low) / (high - low)))
    chosen = {"none": plain, "sigmoid": sigmoid, "minmax": spread, "auto": F.when((low < -0.01) | (high > 1.01), sigmoid).otherwise(plain)}
    return masks.withColumn("data", chosen[mode])


def to_tensor(px: DataFrame, mean, std) -> DataFrame:
    """Long form of an NCHW tensor: (image_id, channel, y, x, value)."""
    values = F.array(*(F.struct(F.lit(i).alias("channel"), ((F.col(c) / 255 - m) / s).cast("float").alias("value")) for i, (c, m, s) in enumerate(zip("rgb", mean, std))))
    return px.select("image_id", "y", "x", F.explode(values).alias("t")).select("image_id", "t.channel", "y", "x", "t.value")


def compose_matte(px: DataFrame, alpha: Column) -> DataFrame:
    """Opacity times a matte: below 8/255 nothing, above 252/255 all; colour is cleared where nothing is left."""
    m = F.when(alpha < 8 / 255, 0.0).when(alpha > 252 / 255, 1.0).otherwise(alpha)
    out = px.withColumn("a", F.floor(m * F.col("a") + 0.5).cast("int"))
    return out.select("image_id", "w", "h", "x", "y", *(F.when(F.col("a") == 0, 0).otherwise(F.col(c)).alias(c) for c in "rgb"), "a")


def _resized(values: Column, size: Column) -> Column:
    """An array of samples at `size` places, pixel centres aligned, ends repeated."""
    n = F.size(values)

    def at(k: Column) -> Column:
        place = F.least((n - 1).cast("double"), F.greatest(F.lit(0.0), (k + 0.5) * (n / size) - 0.5))
        low = F.floor(place).cast("int")
        first = F.get(values, low)
        return first + (F.get(values, F.least(n - 1, low + 1)) - first) * (place - low).cast("float").cast("double")

    return F.transform(F.sequence(F.lit(0), size - 1), at)


def bilinear_resize(plane: DataFrame, width: Column, height: Column, by=("image_id",)) -> DataFrame:
    """(by, w, h, x, y, v) -> (by, x, y, v) at width x height places (columns of the row's w, h or by).

    Rows of an image are resized as arrays, then its columns; no array is longer than a side.
    """
    line = lambda at: F.transform(F.sort_array(F.collect_list(F.struct(at, "v"))), lambda s: s["v"].cast("double"))
    rows = plane.groupBy(*by, "w", "h", "y").agg(line("x").alias("line"))
    wide = rows.select(*by, "w", "h", "y", F.posexplode(_resized(F.col("line"), width)).alias("x", "v"))
    columns = wide.groupBy(*by, "w", "h", "x").agg(line("y").alias("line"))
    return columns.select(*by, "x", F.posexplode(_resized(F.col("line"), height)).alias("y", "v")).select(*by, "x", "y", F.col("v").cast("float").alias("v"))
