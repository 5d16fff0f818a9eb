"""Labels, changes and encoder descriptions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterspark.functions.text import FORMATS, sanitize
from rasterspark.plans.compression import png_level

#: Labels of stages, presets and candidates.
STAGES = {"loading": "Loading", "analyzing": "Analyzing", "removing-background": "Removing background", "cropping": "Cropping", "resizing": "Resizing", "compressing": "Compressing", "validating": "Validating", "complete": "Complete"}
PRESETS = {"maximum": "Maximum", "high": "High", "balanced": "Balanced", "small": "Small", "custom": "Custom"}
CANDIDATES = {
    "jpeg-420": "JPEG 4:2:0", "jpeg-444": "JPEG 4:4:4", "jpeg-gray": "JPEG grayscale", "webp": "WebP", "webp-lossless": "WebP lossless",
    "avif": "AVIF", "avif-lossless": "AVIF lossless", "png-quant": "PNG palette", "webp-palette": "WebP palette", "png-lossless": "PNG lossless",
}
#: Messages that mean a model ran out of memory.
MEMORY = "bad_alloc|out of memory|Cannot enlarge memory|memory access out of bounds|ERROR_CODE: 6"


def label(key: Column, names: dict[str, str]) -> Column:
    """The label of a key; null if there is none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key)


def asset_name(base: Column, form: Column) -> Column:
    """The file name of an output: a safe stem and the format's extension."""
    return F.concat(sanitize(base), F.lit("."), label(form, {f: e for f, _, e in FORMATS}))


def percent(share: Column) -> Column:
    return F.concat(F.format_string("%.1f", share * 100), F.lit("%"))


def format_change(before: Column, after: Column) -> Column:
    """Signed change in percent; a dash where nothing was before."""
    share = after / before - 1
    return F.when(before <= 0, "—").otherwise(F.concat(F.when(share > 0, "+").otherwise(""), percent(share)))


def format_saved(before: Column, after: Column) -> Column:
    return F.when(before <= 0, "—").otherwise(percent(1 - after / before))


def format_dimensions(w: Column, h: Column) -> Column:
    known = (F.coalesce(w, F.lit(0)) != 0) & (F.coalesce(h, F.lit(0)) != 0)
    return F.when(known, F.concat(w.cast("string"), F.lit("×"), h.cast("string"))).otherwise("—")


def format_metric(value: Column, digits: int = 4) -> Column:
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.format_string(f"%.{digits}f", value)).otherwise("∞")


def out_of_memory(message: Column) -> Column:
    return F.coalesce(message.rlike(f"(?i){MEMORY}"), F.lit(False))


def avif_subsample(gray: Column, content: Column, opaque: Column) -> Column:
    """Chroma layout by content: none for grey opaque images, halved for photos, full otherwise."""
    return F.when(gray & opaque, "4:0:0").when(content == "photo", "4:2:0").otherwise("4:4:4")


def encoder_parameters(candidate: Column, level: Column, final: Column, mp: Column, content: Column, has_alpha: Column, gray: Column, alpha_quality: Column) -> Column:
    """What a candidate encodes with at a level: struct(format, kind, quality, effort, subsample, colors)."""
    c = candidate
    form = F.substring_index(c, "-", 1)
    kind = F.when(c.isin("png-quant", "webp-palette"), "palette").when(c.endswith("-lossless"), "lossless").otherwise("lossy")
    lossless = F.when(mp <= 0.3, 6).when(mp <= 2, 5).otherwise(4)
    effort = (
        F.when(c == "webp", F.when(final & (mp <= 12), 6).otherwise(4)).when(c == "webp-lossless", lossless)
        .when(c == "webp-palette", F.when(~final, 2).when(mp <= 1, 6).otherwise(5))
        .when(form == "avif", F.when(~final, 8).when(mp <= 2, 6).otherwise(7))
        .when(c == "png-quant", F.when(final, png_level(mp)).otherwise(1)).when(c == "png-lossless", png_level(mp))
    )
    sub = F.when(c.isin("jpeg-420", "jpeg-gray"), "4:2:0").when(c == "jpeg-444", "4:4:4").when(c == "avif-lossless", "4:4:4").when(c == "avif", avif_subsample(gray, content, ~has_alpha))
    alpha = F.when(c == "webp", F.when(has_alpha, alpha_quality).otherwise(100)).when(c == "avif", F.least(F.lit(100), level + 20))
    return F.struct(
        form.alias("format"), kind.alias("kind"), F.when(kind == "lossy", level).when(c == "avif-lossless", 100).cast("int").alias("quality"), effort.cast("int").alias("effort"),
        sub.alias("subsample"), F.when(kind == "palette", level).cast("int").alias("colors"), alpha.cast("int").alias("alpha_quality"),
    )


def describe(candidate: Column, p: Column) -> Column:
    """The attempt in words, from its parameters."""
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    return (
        F.when(p["kind"] == "palette", text(F.upper(p["format"]), " palette, ", p["colors"], " colours, effort ", p["effort"]))
        .when(p["kind"] == "lossless", text(F.upper(p["format"]), " lossless, effort ", p["effort"]))
        .when(p["format"] == "jpeg", text("JPEG q", p["quality"], " progressive ", F.when(candidate == "jpeg-gray", "grayscale").otherwise(p["subsample"])))
        .when(p["format"] == "webp", text("WebP q", p["quality"], " m", p["effort"], " alpha q", p["alpha_quality"]))
        .otherwise(text("AVIF q", p["quality"], " ", p["subsample"], " s", p["effort"]))
    )
