"""Cutting the lineage of iterative jobs, and what the planner cannot know of the rows that they make."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def bulky(df: DataFrame) -> DataFrame:
    """One side of a join of two large tables: both are sorted, and none goes whole to every task by way of the driver.

    Spark takes a table's size from its files and what is selected, so rows made of a small file, as an image's pixels
    are, look small; what is checkpointed is guessed so too.
    """
    return df.hint("merge")


def owned(df: DataFrame) -> DataFrame:
    """The side of a join that has few and short rows an image, beside the image's pixels: a task holds those of its own images, and
    the pixels are neither sorted nor sent anywhere by way of the driver.
    """
    return df.hint("shuffle_hash")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as there are shuffle partitions, also where it is small: for rows that are about to be
    made many. What is grouped, windowed or joined by these keys then stays where it is.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the folder that all executors share and forget its lineage.

    The folder is the session's spark.checkpoint.dir; a temporary one only in local mode (tests).
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.getConf().get("spark.checkpoint.dir") and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="rasterspark-"))
    return df.checkpoint(eager=True)
