"""How far a candidate's pixels are from the reference's (r, g, b, a beside r2, g2, b2, a2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterspark.functions.lineage import bulky, owned
from rasterspark.operators.planes import YCBCR, at_places, stored, ycbcr

C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
WINDOW, STRIDE, BINS = 8, 4, 2000


def window_scores(pairs: DataFrame, by=("image_id",)) -> DataFrame:
    """(by, w, h, x, y, p, q) -> SSIM of every 8 x 8 window at stride 4 and of those flush with the end.

    Each axis is cut where any window begins or ends, so a window is made of whole cells. Pixels are
    summed to cells before the shuffle, and a cell is dealt to the windows that hold it (nine at most).
    """
    win = F.least(F.lit(WINDOW), F.col("w"), F.col("h"))
    stride = F.when(win < WINDOW, win).otherwise(STRIDE)
    p, q = F.col("p").cast("double"), F.col("q").cast("double")

    def cell(at: str, size: str):
        last = F.col(size) - win
        regular = (F.col(at) - F.col(at) % stride).cast("int")
        return F.when((F.col(at) >= last) & (regular < last), last).otherwise(regular)

    sums = {"n": F.lit(1), "sp": p, "sq": q, "spp": p * p, "sqq": q * q, "spq": p * q}
    cells = pairs.groupBy(*by, "w", "h", cell("x", "w").alias("cx"), cell("y", "h").alias("cy")).agg(*(F.sum(v).alias(k) for k, v in sums.items()))

    def starts(at: str, size: str):
        last, regular = F.col(size) - win, F.col(at) - F.col(at) % stride
        holds = lambda s: F.when((s >= 0) & (s <= last) & (s + win > F.col(at)), s)
        flush = F.when((last % stride != 0) & (F.col(at) >= last), last)
        return F.array(holds(regular), F.when(stride < win, holds(regular - stride)), flush)

    dealt = cells.withColumn("wx", F.explode(starts("cx", "w"))).filter("wx is not null").withColumn("wy", F.explode(starts("cy", "h"))).filter("wy is not null")
    s = dealt.groupBy(*by, "wx", "wy").agg(*(F.sum(k).alias(k) for k in sums))
    mp, mq = F.col("sp") / F.col("n"), F.col("sq") / F.col("n")
    vp, vq = F.greatest(F.lit(0.0), F.col("spp") / F.col("n") - mp * mp), F.greatest(F.lit(0.0), F.col("sqq") / F.col("n") - mq * mq)
    cov = F.col("spq") / F.col("n") - mp * mq
    return s.select(*by, "wx", "wy", ((2 * mp * mq + C1) * (2 * cov + C2) / ((mp * mp + mq * mq + C1) * (vp + vq + C2))).alias("score"))


def luma_pairs(px: DataFrame, background: int = 255) -> DataFrame:
    both = ycbcr(ycbcr(px, background), background, "2")
    return both.select("image_id", "w", "h", "x", "y", F.col("luma").alias("p"), F.col("luma2").alias("q"))


def ssim(pairs: DataFrame) -> DataFrame:
    return window_scores(pairs).groupBy("image_id").agg(F.avg("score").alias("ssim"))


def worst_block(pairs: DataFrame) -> DataFrame:
    """The centre of the histogram bin that holds the first hundredth of the windows' scores."""
    return first_hundredth(window_scores(pairs), ("image_id",)).withColumnRenamed("worst", "worst_block_ssim")


def first_hundredth(scores: DataFrame, by) -> DataFrame:
    bins = scores.withColumn("bin", F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("score") + 1) / 2 * BINS))).cast("int"))
    counted = bins.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    all_ = Window.partitionBy(*by)
    up_to = F.sum("n").over(all_.orderBy("bin"))
    target = F.greatest(F.lit(1), F.floor(F.sum("n").over(all_) * 0.01))
    return counted.withColumn("reached", up_to >= target).filter("reached").groupBy(*by).agg(((F.min("bin") + 0.5) / BINS * 2 - 1).alias("worst"))


def psnr(px: DataFrame, background: int = 255) -> DataFrame:
    """Of the composited colours; infinite for equal images."""
    on = lambda c, a: F.col(c) * F.col(a) / 255 + (1 - F.col(a) / 255) * background
    error = sum((on(c, "a") - on(f"{c}2", "a2")) ** 2 for c in "rgb") / 3
    return px.groupBy("image_id").agg(F.avg(error).alias("mse")).select("image_id", F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(65025 / F.when(F.col("mse") > 0, F.col("mse")))).alias("psnr"))


def max_alpha_error(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg(F.max(F.abs(F.col("a") - F.col("a2"))).alias("max_alpha_error"))


def pixel_pairs(reference: DataFrame, candidate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two pixel relations -> (pixels of both, those of the candidate as r2, g2, b2, a2; images of different size
    or without a candidate: image_id, error). Images are compared only where their sizes are equal.
    """
    size = lambda px, n: px.groupBy("image_id").agg(F.max("w").alias(f"w{n}"), F.max("h").alias(f"h{n}"))
    met = bulky(size(reference, 1)).join(size(candidate, 2), "image_id", "left")
    told = lambda n: F.concat(F.col(f"w{n}").cast("string"), F.lit("×"), F.col(f"h{n}").cast("string"))
    equal = F.coalesce((F.col("w1") == F.col("w2")) & (F.col("h1") == F.col("h2")), F.lit(False))
    errors = met.filter(~equal).select("image_id", F.coalesce(F.concat(told(1), F.lit(" against "), told(2)), F.lit("no candidate")).alias("error"))
    other = candidate.select("image_id", F.col("w").alias("_w"), F.col("h").alias("_h"), "x", "y", *(F.col(c).alias(f"{c}2") for c in "rgba"))
    both = at_places(reference, other).filter((F.col("w") == F.col("_w")) & (F.col("h") == F.col("_h"))).drop("_w", "_h")
    return both, errors


#: How much each plane counts, and the most pixels compared before images are shrunk.
PLANE_WEIGHTS, MOST_PIXELS = {"luma": 0.8, "cb": 0.1, "cr": 0.1}, 16_000_000


def shrunk(px: DataFrame, most: int = MOST_PIXELS) -> DataFrame:
    """Both images of a pair as premultiplied means of boxes where they have more than `most` pixels."""
    size = F.col("w").cast("long") * F.col("h")
    factor = F.ceil(F.sqrt(size / most)).cast("int")
    large = px.filter(size > most).withColumn("f", factor)
    side = {c: F.greatest(F.lit(1), F.floor(F.col(c) / F.col("f"))).cast("int") for c in "wh"}
    place = {c: F.floor(F.col(c) / F.col("f")).cast("int") for c in "xy"}
    boxes = large.filter((place["x"] < side["w"]) & (place["y"] < side["h"])).groupBy("image_id", "f", side["w"].alias("w"), side["h"].alias("h"), place["x"].alias("x"), place["y"].alias("y"))
    s = boxes.agg(*(F.sum(F.col(f"{c}{n}") * F.col(f"a{n}")).alias(f"{c}{n}") for n in ("", "2") for c in "rgb"), F.sum("a").alias("a"), F.sum("a2").alias("a2"))
    colour = lambda c, n: F.when(F.col(f"a{n}") > 0, stored(F.col(f"{c}{n}") / F.col(f"a{n}"))).otherwise(0).alias(f"{c}{n}")
    means = s.select("image_id", "w", "h", "x", "y", *(colour(c, n) for n in ("", "2") for c in "rgb"), *(stored(F.col(f"a{n}") / (F.col("f") * F.col("f"))).alias(f"a{n}") for n in ("", "2")))
    return px.filter(size <= most).select(*means.columns).unionByName(means)


def compare(px: DataFrame, dither_tolerant: bool = False, most: int = MOST_PIXELS) -> DataFrame:
    """(image_id, w, h, x, y, r, g, b, a, r2, g2, b2, a2) -> image_id, ssim, worst_block_ssim, psnr, max_alpha_error.

    Similarity is the weighted mean over luma and the two colour planes, those at half size from 16 x 16
    pixels on; the worst block is luma's. Images with any transparency are laid on black and on white,
    and the worse counts. dither_tolerant: half of each score is that of the blurred planes.
    """
    errors = max_alpha_error(px)
    alpha = px.groupBy("image_id").agg(F.max((F.col("a") < 255) | (F.col("a2") < 255)).alias("alpha"))
    laid = shrunk(px, most).join(owned(alpha), "image_id").withColumn("on", F.explode(F.when(F.col("alpha"), F.array(F.lit(0), F.lit(255))).otherwise(F.array(F.lit(-1)))))
    on = lambda c, n: F.when(F.col("on") < 0, F.col(f"{c}{n}").cast("double")).otherwise(F.col(f"{c}{n}") * (F.col(f"a{n}") / 255) + (1 - F.col(f"a{n}") / 255) * F.col("on"))
    flat = laid.select("image_id", "on", "w", "h", "x", "y", *(on(c, n).alias(f"{c}{n}") for n in ("", "2") for c in "rgb"))
    value = lambda k, n: (k[0] * F.col(f"r{n}") + k[1] * F.col(f"g{n}") + k[2] * F.col(f"b{n}") + k[3]).cast("float")
    planes = F.array(*(F.struct(F.lit(name).alias("plane"), value(k, "").alias("p"), value(k, "2").alias("q")) for name, k in YCBCR.items()))
    rows = flat.select("image_id", "on", "w", "h", "x", "y", F.explode(planes).alias("v")).select("image_id", "on", "w", "h", "x", "y", "v.*")
    by = ("image_id", "on", "plane")

    def scores(rows):
        small = (F.col("plane") == "luma") | (F.col("w") < 16) | (F.col("h") < 16)
        half = lambda c: F.floor(F.col(c) / 2).cast("int")
        inside = (F.col("x") < half("w") * 2) & (F.col("y") < half("h") * 2)
        means = rows.filter(~small & inside).groupBy(*by, half("w").alias("w"), half("h").alias("h"), half("x").alias("x"), half("y").alias("y")).agg(F.avg("p").cast("float").alias("p"), F.avg("q").cast("float").alias("q"))
        found = window_scores(rows.filter(small).unionByName(means), by)
        mean = found.groupBy(*by).agg(F.avg("score").alias("mean"))
        return bulky(mean).join(first_hundredth(found.filter("plane = 'luma'"), by), list(by), "left")

    def blurred(rows):
        for across, along in (("y", "x"), ("x", "y")):
            w = Window.partitionBy(*by, across).orderBy(along)
            rows = rows.withColumns({c: ((F.coalesce(F.lag(c).over(w), c) + 2 * F.col(c) + F.coalesce(F.lead(c).over(w), c)) / 4).cast("float") for c in "pq"})
        return rows

    found = scores(rows)
    if dither_tolerant:
        soft = scores(blurred(rows)).select(*by, F.col("mean").alias("mean2"), F.col("worst").alias("worst2"))
        found = bulky(found).join(soft, list(by)).withColumns({"mean": (F.col("mean") + F.col("mean2")) / 2, "worst": (F.col("worst") + F.col("worst2")) / 2})
    weight = F.create_map(*(F.lit(x) for pair in PLANE_WEIGHTS.items() for x in pair))[F.col("plane")]
    laid_scores = found.groupBy("image_id", "on").agg(F.sum(F.col("mean") * weight).alias("ssim"), F.max("worst").alias("worst"))
    error = sum((F.col(c) - F.col(f"{c}2")) ** 2 for c in "rgb") / 3
    noise = flat.groupBy("image_id", "on").agg(F.avg(error).alias("mse")).groupBy("image_id").agg(F.max("mse").alias("mse"))
    worst = laid_scores.groupBy("image_id").agg(F.least(F.lit(1.0), F.min("ssim")).alias("ssim"), F.least(F.lit(1.0), F.min("worst")).alias("worst_block_ssim"))
    psnr_ = F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(65025 / F.when(F.col("mse") > 0, F.col("mse"))))
    return bulky(worst).join(noise, "image_id").join(bulky(errors), "image_id").select("image_id", "ssim", "worst_block_ssim", psnr_.alias("psnr"), "max_alpha_error")
