"""An image's whole way: pixels, preparation, search, validation, delivery, with every failure a row.

`plans.process` prepares the pixels, `plans.rounds` searches the encodings, an independent reading of the chosen
file is held against the pixels, and what fails that is replaced by a lossless PNG. All images go through a
stage at once. An image that fails keeps its row, with the stage and the reason, and takes no part in later
stages; the others never notice. Encoding and reading files are the caller's: `encoders` and `inspect`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterspark.functions.lineage import bulky, cut, owned
from rasterspark.operators import metrics, planes
from rasterspark.plans import compression, process, rounds, rules, search
from rasterspark.sources.pixels import lined

PALETTES = ("png-quant", "webp-palette")


def candidate_settings(names: Column, preset: str) -> Column:
    """Names of candidates -> structs of how each is searched under a preset."""
    target = next(t for t in compression.TARGETS if t[0] == ("high" if preset == "custom" else preset))
    low_high = {"jpeg": target[3:5], "webp": target[5:7], "avif": target[7:9]}

    def one(c: Column) -> Column:
        kind = F.when(c.isin(*PALETTES), "palette").when(c.endswith("-lossless"), "lossless").otherwise("lossy")
        form = F.substring_index(c, "-", 1)
        end = lambda i: F.coalesce(*(F.when(form == f, F.lit(v[i])) for f, v in low_high.items()), F.lit(0))
        slow = form == "avif"
        return F.struct(c.alias("candidate"), kind.alias("kind"), end(0).alias("lo"), end(1).alias("hi"), F.when(slow, 3).otherwise(2).alias("tolerance"), F.when(slow, 5).otherwise(7).alias("most"))

    return F.transform(names, one)


def searched(prepared: DataFrame, options: process.Options, quality: float | None) -> DataFrame:
    """Prepared images -> the input of `rounds.compress`."""
    target = next(t for t in compression.TARGETS if t[0] == ("high" if options.preset == "custom" else options.preset))
    steps = search.palette_steps(F.lit(target[9]), F.col("unique_colors"), F.lit(False))
    custom = F.lit(quality if options.preset == "custom" else None).cast("double")
    return prepared.select("image_id", custom.alias("custom"), F.lit(target[1]).alias("min_ssim"), F.lit(target[2]).alias("min_worst"), steps.alias("steps"),
                           candidate_settings(F.col("primary"), options.preset).alias("primary"), candidate_settings(F.col("fallback"), options.preset).alias("fallback"))


#: Final pixels -> what measures requests on them (see rounds).
Encoders = Callable[[DataFrame], rounds.Measure]
#: chosen (image_id, candidate, level, final, format) -> (image_id, size, found, w, h, alpha, error: why it cannot be read), decoded pixels.
Inspect = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def deliver(px: DataFrame, sources: DataFrame, encoders: Encoders, inspect: Inspect, options: process.Options = process.Options(), quality: float | None = None, segment=None) -> DataFrame:
    """Pixels and sources (image_id, source_format, original_bytes, stripped_bytes: without metadata, or null) -> a row for each source:

    image_id, status, stage (where it failed), error, format, candidate, level, width, height, original_bytes, output_bytes,
    ssim, worst (of the decoded file), kept (the original), cropped, background_removed, resized, measured, warnings.
    quality: of the preset custom. segment: see `process.process`.
    """
    final, rows = process.process(px, sources.select("image_id", "source_format"), options, segment=segment)
    rows = cut(rows)
    ready = rows.filter("error is null")
    flat = ready.filter((F.col("format") == "jpeg") & F.col("has_alpha")).select("image_id")
    if not flat.isEmpty():
        final = lined(planes.flatten_onto(final.join(owned(flat), "image_id", "left_semi")).select(*final.columns).unionByName(final.join(owned(flat), "image_id", "left_anti")))
    measure = encoders(final)
    found = cut(rounds.compress(searched(ready, options, quality), measure))
    chosen = cut(found.filter("error is null").select("image_id", "best.*", "warning", "measured", "failed").withColumn("format", F.substring_index("candidate", "-", 1)))

    info, decoded = inspect(chosen.select("image_id", "candidate", "level", "final", "format"))
    both, sizes = metrics.pixel_pairs(final.join(owned(chosen.select("image_id")), "image_id", "left_semi"), decoded)
    scores = cut(metrics.compare(lined(both)).select("image_id", F.col("ssim").alias("_ssim"), F.col("worst_block_ssim").alias("_worst")))
    info = cut(info.select("image_id", "size", "found", F.col("w").alias("_w"), F.col("h").alias("_h"), "alpha", F.col("error").alias("_unread")))
    sizes = cut(sizes)
    seen = bulky(chosen).join(info, "image_id", "left").join(bulky(ready.select("image_id", "width", "height", "has_alpha")), "image_id").join(bulky(scores), "image_id", "left")
    seen = bulky(seen).join(sizes.select("image_id", F.col("error").alias("_pairs")), "image_id", "left")
    wrong = compression.validation_error(F.coalesce("size", F.lit(0)), F.col("found"), F.col("format"), F.col("_w"), F.col("_h"), F.col("width"), F.col("height"), F.col("alpha"), F.col("has_alpha"))
    seen = cut(seen.withColumn("invalid", F.coalesce(wrong, F.when(F.col("_unread").isNotNull(), F.concat(F.lit("unreadable: "), F.col("_unread"))), F.col("_pairs"))))
    bad = seen.filter("invalid is not null").select("image_id")
    png = measure(bad.select("image_id", F.lit("png-lossless").alias("candidate"), F.lit(100).alias("level"), F.lit(True).alias("final")))
    png = png if "error" in png.columns else png.withColumn("error", F.lit(None).cast("string"))
    seen = bulky(seen).join(png.select("image_id", F.col("bytes").alias("png_bytes"), F.col("error").alias("_png")), "image_id", "left")

    told = seen.select("image_id", "candidate", "level", "format", "bytes", "invalid", "png_bytes", "_png", "_ssim", "_worst", "warning", "measured", "failed")
    told = told.unionByName(found.filter("error is not null").select("image_id", F.col("error").alias("none"), "measured", "failed"), allowMissingColumns=True)
    met = bulky(sources).join(rows.drop("format", "source_format"), "image_id").join(bulky(told), "image_id", "left")
    replaced = F.col("invalid").isNotNull()
    size = F.when(replaced, F.col("png_bytes")).otherwise(F.col("bytes"))
    unmade = F.coalesce("none", F.when(replaced & F.col("png_bytes").isNull(), F.concat("invalid", F.lit("; no PNG either: "), F.coalesce("_png", F.lit("no answer")))))
    untouched = ~F.coalesce(F.col("cropped") | F.col("background_removed") | F.col("resized"), F.lit(True))
    original = rules.passed_through(F.col("source_format"), F.col("original_bytes"), F.coalesce("stripped_bytes", "original_bytes"), F.lit(None).cast("long"))
    kept = F.coalesce(compression.keep_original(untouched, F.lit(options.format), F.col("source_format"), F.lit(options.preset), original, size), F.lit(False)) & unmade.isNull()
    error = F.coalesce("error", unmade)
    done, exact, none = error.isNull(), kept | replaced, F.array().cast("array<string>")
    when = lambda condition, text: F.when(condition, F.array(text if isinstance(text, Column) else F.lit(text))).otherwise(none)
    alpha_lost = (F.col("format") == "jpeg") & F.col("has_alpha")
    warnings = F.concat(
        F.coalesce("warnings", none), when(alpha_lost & done, "laid on white, as JPEG has no transparency"), when(F.col("warning").isNotNull() & done, F.col("warning")),
        F.coalesce("failed", none), when(replaced & done, F.concat("invalid", F.lit("; lossless PNG instead"))), when(kept & done, "original kept"),
    )
    return met.select(
        "image_id", F.when(done, "completed").otherwise("failed").alias("status"),
        F.when(F.col("error").isNotNull(), "preparing").when(F.col("none").isNotNull(), "compressing").when(~done, "validating").alias("stage"), error.alias("error"),
        F.when(done, F.when(kept, F.col("source_format")).when(replaced, "png").otherwise(F.col("format"))).alias("format"),
        F.when(done & ~exact, F.col("candidate")).alias("candidate"), F.when(done & ~exact, F.col("level")).alias("level"), "width", "height", "original_bytes",
        F.when(done, F.when(kept, original).otherwise(size)).cast("long").alias("output_bytes"), F.when(done, F.when(exact, 1.0).otherwise(F.col("_ssim"))).alias("ssim"),
        F.when(done, F.when(exact, 1.0).otherwise(F.col("_worst"))).alias("worst"), kept.alias("kept"), "cropped", "background_removed", "resized", F.coalesce("measured", F.lit(0).cast("long")).alias("measured"), warnings.alias("warnings"),
    )


PACKED = "image_id long, w int, h int, rgba binary"


def packed(px: DataFrame) -> DataFrame:
    """A row for each image: its size and its pixels, row by row, four bytes each."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["y", "x"])
        return pd.DataFrame({"image_id": own["image_id"].iloc[:1], "w": own["w"].iloc[:1], "h": own["h"].iloc[:1], "rgba": [own[list("rgba")].to_numpy(np.uint8).tobytes()]})

    return px.select("image_id", "w", "h", "x", "y", *"rgba").groupBy("image_id").applyInPandas(run, PACKED)


def by_function(encode, dither_tolerant: bool = False) -> Encoders:
    """Encoders from a Python function: encode(pixels (h, w, 4), candidate, level, final) -> (size in bytes, decoded pixels).

    What the function raises becomes the answer's error; no other request notices. Answers are compared by `metrics.compare`.
    """

    def encoders(final: DataFrame) -> rounds.Measure:
        images = cut(packed(final))

        def run(batches):
            for batch in batches:
                out = []
                for r in batch.itertuples(index=False):
                    one = {"image_id": r.image_id, "candidate": r.candidate, "level": r.level, "final": r.final, "bytes": None, "error": None, "w": r.w, "h": r.h, "rgba": r.rgba, "made": None}
                    try:
                        size, made = encode(np.frombuffer(r.rgba, np.uint8).reshape(r.h, r.w, 4), r.candidate, r.level, r.final)
                        if made.shape != (r.h, r.w, 4):
                            raise ValueError(f"decoded to {made.shape[1]}×{made.shape[0]}")
                        one |= {"bytes": int(size), "made": np.ascontiguousarray(made, np.uint8).tobytes()}
                    except Exception as e:  # the caller's code: any failure is that request's alone
                        one["error"] = f"{type(e).__name__}: {e}"
                    out.append(one)
                yield pd.DataFrame(out, columns=ANSWER)

        def measure(requests: DataFrame) -> DataFrame:
            made = cut(bulky(requests).join(images, "image_id").mapInPandas(run, ANSWER_SCHEMA))
            key = F.concat_ws("/", F.col("image_id").cast("string"), "candidate")
            px = made.filter("made is not null").select(key.alias("image_id"), "w", "h", "rgba", "made").mapInPandas(pixel_rows, PAIRS)
            scores = metrics.compare(px, dither_tolerant).select(F.col("image_id").alias("_key"), "ssim", F.col("worst_block_ssim").alias("worst"))
            return bulky(made).join(scores, key == F.col("_key"), "left").select("image_id", "candidate", "level", "final", "bytes", "ssim", "worst", "error")

        return measure

    return encoders


def pixel_rows(batches):
    """Packed pairs of images, a row for each pixel."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            one, two = (np.frombuffer(v, np.uint8).reshape(-1, 4).astype(np.int32) for v in (r.rgba, r.made))
            i = np.arange(r.w * r.h, dtype=np.int32)
            colours = {f"{c}{n}": v[:, k] for n, v in (("", one), ("2", two)) for k, c in enumerate("rgba")}
            yield pd.DataFrame({"image_id": r.image_id, "w": r.w, "h": r.h, "x": i % r.w, "y": i // r.w} | colours)


PAIRS = "image_id string, w int, h int, x int, y int, " + ", ".join(f"{c}{n} int" for n in ("", "2") for c in "rgba")
ANSWER = ["image_id", "candidate", "level", "final", "bytes", "error", "w", "h", "rgba", "made"]
ANSWER_SCHEMA = "image_id long, candidate string, level int, final boolean, bytes long, error string, w int, h int, rgba binary, made binary"
