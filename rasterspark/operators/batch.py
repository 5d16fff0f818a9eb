"""Summaries of batches of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where each stage starts and how much of the work it is.
STAGES = [("loading", 0.0, 0.05), ("analyzing", 0.05, 0.03), ("removing-background", 0.08, 0.32), ("cropping", 0.4, 0.02), ("resizing", 0.42, 0.04), ("compressing", 0.46, 0.46), ("validating", 0.92, 0.08), ("complete", 1.0, 0.0)]


def summary(items: DataFrame) -> DataFrame:
    """items (status, original, output) -> totals; savings over completed items only."""
    done = F.col("status") == "completed"
    return items.agg(
        F.count("*").alias("items"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum(F.when(done, F.col("original"))), F.lit(0)).alias("original"),
        F.coalesce(F.sum(F.when(done, F.col("output"))), F.lit(0)).alias("output"),
    ).withColumn("saved", F.when(F.col("original") > 0, F.round(1 - F.col("output") / F.col("original"), 6)).otherwise(0.0))


def progress(items: DataFrame, by: str) -> DataFrame:
    """items (by, status, stage, fraction) -> the mean progress of each group."""
    stages = items.sparkSession.createDataFrame(STAGES, "stage string, start double, span double")
    met = items.join(F.broadcast(stages), "stage", "left")
    share = F.when(F.col("status").isin("completed", "failed", "cancelled"), 1.0).when(F.col("status") == "processing", F.coalesce("start", F.lit(0.0)) + F.coalesce("span", F.lit(0.0)) * F.coalesce("fraction", F.lit(0.3))).otherwise(0.0)
    return met.groupBy(by).agg(F.round(F.least(F.lit(1.0), F.avg(share)), 6).alias("progress"))


def by_setting(results: DataFrame) -> DataFrame:
    """results (preset, format, original, output, ssim, ms) -> one row for each pair of settings and its roll-ups."""
    return results.rollup("preset", "format").agg(
        F.count("*").alias("n"), F.sum("original").alias("original"), F.sum("output").alias("output"), F.round(F.avg(1 - F.col("output") / F.col("original")), 6).alias("reduction"), F.min("ssim").alias("min_ssim"), F.round(F.avg("ms"), 4).alias("mean_ms"),
    )


def status_counts(items: DataFrame) -> DataFrame:
    """items (status) -> the number of items of each status."""
    return items.groupBy("status").agg(F.count("*").alias("n"))


def with_outcomes(items: DataFrame, outcomes: DataFrame, failures: DataFrame) -> DataFrame:
    """items (image_id, mode) with what became of each: applied (the mode, if it was), apply_error.

    outcomes and failures (image_id, pos, ok, error) are taken together, outcomes first, and an item's
    first one counts; an item without any stays as it is.
    """
    both = outcomes.select("image_id", F.lit(0).alias("part"), "pos", "ok", "error").unionByName(failures.select("image_id", F.lit(1).alias("part"), "pos", "ok", "error"))
    first = both.groupBy("image_id").agg(F.min_by(F.struct("ok", "error"), F.struct("part", "pos")).alias("o"))
    met = items.join(first, "image_id", "left")
    error = F.when(F.col("o.ok"), F.col("o.error")).when(F.col("o").isNotNull(), F.coalesce("o.error", F.lit("layer not updated")))
    return met.select(*items.columns, F.when(F.col("o.ok"), F.col("mode")).alias("applied"), error.alias("apply_error"))


def active(items: DataFrame, by: str) -> DataFrame:
    """items (by, image_id, status, started_at) -> of each group the running item that began last (ties: larger id)."""
    return items.filter(F.col("status") == "processing").groupBy(by).agg(F.max_by("image_id", F.struct("started_at", "image_id")).alias("active"))


def retried(items: DataFrame) -> DataFrame:
    """items (image_id, status, stage, error) -> failed and cancelled ones pending again, without stage and error."""
    again = F.col("status").isin("failed", "cancelled")
    return items.withColumns({
        "status": F.when(again, "pending").otherwise(F.col("status")), "stage": F.when(~again, F.col("stage")), "error": F.when(~again, F.col("error")), "retried": again,
    })


def timings(marks: DataFrame) -> DataFrame:
    """marks (image_id, stage, began, ended: timestamps) -> image_id, timings (stage -> milliseconds), total_ms."""
    ms = F.unix_millis("ended") - F.unix_millis("began")
    each = marks.groupBy("image_id", "stage").agg(F.sum(ms).alias("ms"))
    return each.groupBy("image_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "ms")))).alias("timings"), F.sum("ms").alias("total_ms"))


def by_size(results: DataFrame) -> DataFrame:
    """results (image_id, candidate, bytes) -> image_id, candidates: from the smallest file up, ties by name."""
    return results.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bytes", "candidate"))), lambda c: c["candidate"]).alias("candidates"))


def report(results: DataFrame) -> DataFrame:
    """results as by_setting takes them -> one line of a Markdown table for each pair of settings, in order."""
    rows = by_setting(results).filter("preset is not null and format is not null")
    text = F.concat_ws(" | ", "preset", "format", F.col("n").cast("string"), F.col("original").cast("string"), F.col("output").cast("string"), F.format_string("%.1f%%", F.col("reduction") * 100), F.format_string("%.4f", "min_ssim"))
    return rows.select("preset", "format", F.concat(F.lit("| "), text, F.lit(" |")).alias("line"))


def benchmark_grid(images: DataFrame, formats: list[str], presets: list[str], only: list[str] | None = None) -> DataFrame:
    """images (image_id, name, has_alpha) -> a row for each image, format and preset to measure: image_id, name, format, preset.

    only: names of the images that take part. An image with transparency has no JPEG row.
    """
    chosen = images if only is None else images.filter(F.col("name").isin(only))
    forms, quality = (F.array(*map(F.lit, v)).cast("array<string>") for v in (formats, presets))
    rows = chosen.withColumn("format", F.explode(forms)).withColumn("preset", F.explode(quality))
    return rows.filter(~((F.col("format") == "jpeg") & F.coalesce("has_alpha", F.lit(False)))).select("image_id", "name", "format", "preset")
