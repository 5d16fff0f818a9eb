"""Selections of fills, and writing results back to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterspark.functions.lineage import cut
from rasterspark.functions.text import crop_key


def dedupe(fills: DataFrame) -> DataFrame:
    """fills (pos, node, hash) -> one row an image: its first node, number of targets and of nodes."""
    return fills.groupBy("hash").agg(F.min_by("node", "pos").alias("first_node"), F.count("*").alias("targets"), F.count_distinct("node").alias("nodes"))


def dedupe_crops(fills: DataFrame) -> DataFrame:
    """fills (pos, node, name, hash, crop: struct(x, y, width, height) or null, full_w, full_h) -> one row an image
    and crop: its id, hash, first name and size, the size of the crop, and its targets in order.
    """
    key = F.when(F.col("crop").isNull(), F.col("hash").cast("string")).otherwise(crop_key(F.col("hash").cast("string"), *(F.col(f"crop.{c}") for c in ("x", "y", "width", "height"))))
    first = fills.groupBy(key.alias("id")).agg(F.min_by(F.struct("hash", "name", "crop", "full_w", "full_h"), "pos").alias("f"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda t: t["node"]).alias("targets"))
    side = lambda full, part: F.when(F.col("f.crop").isNull(), F.col(full)).otherwise(F.greatest(F.lit(1), F.floor(F.col(full) * F.col(part) + 0.5))).cast("int")
    return first.select("id", "f.hash", "f.name", side("f.full_w", "f.crop.width").alias("width"), side("f.full_h", "f.crop.height").alias("height"), "targets")


def originals(images: DataFrame, blobs: DataFrame) -> DataFrame:
    """images (pos, hash, name) and blobs (hash, content) -> one row a hash: its first name, content, and an error if
    the content is missing. The bytes are as they were.
    """
    first = images.groupBy("hash").agg(F.min_by("name", "pos").alias("name"), F.min("pos").alias("pos"))
    return first.join(blobs, "hash", "left").withColumn("error", F.when(F.col("content").isNull(), F.concat(F.col("name"), F.lit(": not found"))))


def with_sizes(images: DataFrame, sizes: DataFrame) -> DataFrame:
    """Unknown sizes stay null."""
    return images.join(sizes, "hash", "left")


def first_nodes(nodes: DataFrame, limit: int) -> DataFrame:
    """The first nodes in order, up to the scan's limit, and whether more were there."""
    kept = nodes.orderBy("pos").limit(limit + 1)
    nth = F.row_number().over(Window.orderBy("pos"))  # limit + 1 rows at most
    return kept.withColumn("nth", nth).withColumn("truncated", F.max("nth").over(Window.partitionBy()) > limit).filter(F.col("nth") <= limit).drop("nth")


def apply_results(targets: DataFrame, fills: DataFrame) -> DataFrame:
    """targets (image_id, node, idx, hash) against live fills (node, idx, live_hash, kind) -> outcome by image.

    A target is updated only where the fill is still the same image; its errors are named.
    """
    met = targets.join(fills, ["node", "idx"], "left")
    error = (
        F.when(F.col("kind").isNull(), "layer was deleted").when(F.col("kind") == "mixed", "mixed fills")
        .when((F.col("kind") != "IMAGE") | ~F.col("live_hash").eqNullSafe(F.col("hash")), "fill changed")
    )
    return met.withColumn("error", error).groupBy("image_id").agg(
        F.count_if(F.col("error").isNull()).alias("updated"), (F.count_if(F.col("error").isNull()) > 0).alias("ok"),
        F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("errors"),
    )


def size_gate(items: DataFrame, most: int = 4096) -> DataFrame:
    """Items too large to write back become failures."""
    return items.withColumn("error", F.when((F.col("width") > most) | (F.col("height") > most), F.lit(f"larger than {most} pixels")))


def counters(images: DataFrame) -> DataFrame:
    """images (targets, cropped) -> how many images, targets and crops a selection holds."""
    return images.agg(F.count("*").alias("images"), F.coalesce(F.sum("targets"), F.lit(0)).alias("targets"), F.count_if("cropped").alias("cropped"))


def unsupported(roots: DataFrame, fills: DataFrame) -> DataFrame:
    """roots (root, kind, has_children, problem) without an image fill (fills: root) -> root, kind, reason.

    The first problem met in the subtree is the reason; without one, the kind of the root gives it.
    """
    kind = F.col("kind")
    plain = (
        F.when(F.col("has_children"), "no layer inside has an image").when(kind == "SLICE", "a slice holds no image")
        .when(kind.isin("CONNECTOR", "LINE"), F.concat(F.lit("a "), F.lower(kind), F.lit(" holds no image")))
        .when(kind == "TEXT", "text that no image fills").otherwise("no image fills it")
    )
    return roots.join(fills.select("root").distinct(), "root", "left_anti").select("root", "kind", F.coalesce("problem", plain).alias("reason"))


def inserted(items: DataFrame, boxes: DataFrame, center_x: float, center_y: float, gap: int = 40) -> DataFrame:
    """items (image_id, name, format, width, height, node) beside their first target's box (node, bx, by, bw).

    Without a box the new layer is centred in view.
    """
    label = F.concat("name", F.lit(" — "), F.upper("format"), F.lit(" "), F.col("width").cast("string"), F.lit("×"), F.col("height").cast("string"))
    met = items.join(boxes, "node", "left")
    x = F.coalesce(F.col("bx") + F.col("bw") + gap, center_x - F.col("width") / 2)
    y = F.when(F.col("bx").isNotNull(), F.col("by").cast("double")).otherwise(center_y - F.col("height") / 2)
    return met.select("image_id", label.alias("layer"), x.cast("double").alias("x"), y.alias("y"))


def provenance(original, processed, at):
    """The JSON kept with a layer that was written."""
    return F.to_json(F.struct(original.alias("originalImageHash"), processed.alias("processedImageHash"), at.alias("processedAt")))


def scan(nodes: DataFrame) -> DataFrame:
    """nodes (node, parent, place) -> (node, root, depth, path) of every node below a root (null parent).

    path holds the places from the root down, so ordering by it is a walk from parents to children in
    order. One join a level; a node that no root reaches, as in a ring of parents, does not appear.
    """
    level = cut(nodes.filter(F.col("parent").isNull()).select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.array(F.col("place").cast("long")).alias("path")))
    found = level
    while level.limit(1).count():
        above = level.select(F.col("node").alias("parent"), "root", "depth", "path")
        below = nodes.join(above, "parent").select("node", "root", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array(F.col("place").cast("long"))).alias("path"))
        level = cut(below)
        found = found.union(level)
    return found
