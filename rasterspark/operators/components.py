"""Connected regions of masks, and connected components of any edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterspark.functions.lineage import bulky, cut


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a long, b long) -> (node long, label long), label = least node of the component.

    Each round hooks every node to its least neighbour, follows the hooks to their roots by pointer
    jumping, and contracts the edges to the roots, so links inside a found group are never joined
    again. At least half of the nodes with an edge left go each round. Nodes without an edge do not
    appear; loops are harmless; an empty table gives an empty one. All tables are checkpointed, so a
    lost executor costs one step.
    """
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    labels = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label")))
    left = cut(edges.filter("a <> b").select(*pair).distinct())
    while left.limit(1).count():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
        while True:
            over = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = cut(bulky(hooks).join(over, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            hooks = jumped.select("node", "root")
            if not jumped.filter("moved").limit(1).count():
                break
        labels = cut(bulky(labels).join(hooks.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("root", "label").alias("label")))
        half = bulky(left).join(hooks, left.a == hooks.node).select(F.col("root").alias("a"), "b")
        left = cut(bulky(half).join(hooks, half.b == hooks.node).select("a", F.col("root").alias("b")).filter("a <> b").select(*pair).distinct())
    return labels


#: Rows of an image that a task labels at once.
BAND = 64
LABELLED = "image_id long, x0 int, y int, n long, node long"


def _label(batches):
    """Runs in the order of image, row and start -> with the least run of those that they touch within their band of rows.

    What is held is a batch and the band that it ends in.
    """
    left = None
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("image_id", "y", "x0", "n", "node")])
        rows = rows if left is None else np.concatenate([left, rows], axis=1)
        if rows.shape[1]:
            band = (rows[0] != rows[0, -1]) | (rows[1] // BAND != rows[1, -1] // BAND)
            end = int(np.flatnonzero(band)[-1]) + 1 if band.any() else 0
            left = rows[:, end:]
            yield _linked(rows[:, :end])
    if left is not None:
        yield _linked(left)


def _linked(rows: np.ndarray) -> pa.RecordBatch:
    """Whole bands of runs, labelled: every run takes the least label of those above and below until none differs."""
    image, y, x0, n, node = rows
    label = np.arange(rows.shape[1])
    if rows.shape[1]:
        # places on one line: a row after the other, and a gap where the row below is of another image or band, or is missing
        begun = np.ones(len(y), bool)
        begun[1:] = (image[1:] != image[:-1]) | (y[1:] != y[:-1])
        next_ = np.ones(len(y), bool)
        next_[1:] = (image[1:] != image[:-1]) | (y[1:] != y[:-1] + 1) | (y[1:] % BAND == 0)
        width = int((x0 + n).max()) + 1
        at = np.cumsum(np.where(begun, np.where(next_, 2, 1), 0)) * width + x0
        first, after = np.searchsorted(at + n - 1, at - width), np.searchsorted(at, at + n - 1 - width, side="right")
        count = np.maximum(after - first, 0)
        below = np.repeat(label, count)
        above = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(below))
        while True:
            a, b = label[above], label[below]
            differ = a != b
            if not differ.any():
                break
            above, below, a, b = above[differ], below[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label = jumped
    columns = [pa.array(image), pa.array(x0.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(n), pa.array(node[label])]
    return pa.RecordBatch.from_arrays(columns, names=["image_id", "x0", "y", "n", "node"])


def regions(mask: DataFrame) -> DataFrame:
    """(image_id, w, x, y, keep) -> (image_id, x0, y, n, label) for each horizontal run of kept pixels.

    Runs that touch in neighbouring rows (4-connected) share a label, the least place y * w + x of
    the region. Runs are labelled within bands of rows, each by one task; only where an image has several
    bands, the labels that touch across two of them are joined. Labels are numbered by image and
    place; a place of 2^27 (134 megapixels) or more, or an image_id outside 0 to 2^36 - 1, ends the job.
    """
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    kept = mask.filter("keep").select("image_id", "w", "y", "x").withColumn("run", F.col("x") - F.row_number().over(row))
    runs = kept.groupBy("image_id", "y", "run").agg(F.min("x").alias("x0"), F.count("*").alias("n"), F.max("w").alias("w"))
    image, spot = F.col("image_id").cast("long"), F.col("y").cast("long") * F.col("w") + F.col("x0")
    fits = image.between(0, (1 << 36) - 1) & (spot < 1 << 27)
    node = F.when(fits, F.shiftleft(image, 27) + spot).otherwise(F.raise_error(F.concat(F.lit("no node number for image "), image.cast("string"), F.lit(", place "), spot.cast("string"))).cast("long"))
    band = F.floor(F.col("y") / BAND)
    ordered = runs.select(image.alias("image_id"), F.col("y").cast("int").alias("y"), F.col("x0").cast("int").alias("x0"), "n", node.alias("node")).repartition("image_id", band).sortWithinPartitions("image_id", "y", "x0")
    local = ordered.mapInArrow(_label, LABELLED)
    place = F.col("node").bitwiseAND(F.lit((1 << 27) - 1))
    if mask.filter("keep").filter(F.col("y") >= BAND).isEmpty():
        return local.select("image_id", "x0", "y", "n", place.alias("label"))
    local = cut(local)
    edge = local.filter((F.col("y") % BAND).isin(0, BAND - 1)).select("image_id", "y", "node", F.explode(F.sequence("x0", F.col("x0") + F.col("n").cast("int") - 1)).alias("x"))
    touched = edge.withColumn("above", F.when(F.lag("y").over(column) == F.col("y") - 1, F.lag("node").over(column))).filter("above <> node")
    labels = connected_components(touched.select(F.col("above").alias("a"), F.col("node").alias("b")).distinct())
    return bulky(local).join(labels, "node", "left").select("image_id", "x0", "y", "n", F.coalesce("label", "node").bitwiseAND(F.lit((1 << 27) - 1)).alias("label"))


def sizes(mask: DataFrame, least_share: float = 0.002) -> DataFrame:
    """Regions of a mask with their size, and whether each has at least that share of the image's largest."""
    found = regions(mask).groupBy("image_id", "label").agg(F.sum("n").alias("n"))
    return found.withColumn("kept", F.col("n") >= F.max("n").over(Window.partitionBy("image_id")) * least_share)
