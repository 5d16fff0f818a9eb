"""The registry of segmentation models, and which of them a request ends at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Model, its fallback, whether it needs a GPU.
MODELS = [("rmbg-1.4", None, False), ("rmbg-1.4-full", "rmbg-1.4", False), ("birefnet-lite", "rmbg-1.4", True)]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "model string, fallback string, needs_gpu boolean")


def offered(devices: DataFrame) -> DataFrame:
    """A row for each device and registered model; the registry travels as a literal of its few rows."""
    known = F.array(*(F.struct(F.lit(name).alias("model"), F.lit(other).cast("string").alias("fallback"), F.lit(needs).alias("needs_gpu")) for name, other, needs in MODELS))
    return devices.select("*", F.inline(known))


def usable(models: DataFrame, gpu: bool | Column) -> DataFrame:
    """Models that run with or without a GPU; gpu may be a column of the rows. A device that says nothing has none."""
    if isinstance(gpu, Column):
        return models.filter(F.coalesce(gpu, F.lit(False)) | ~F.col("needs_gpu"))
    return models.filter(F.lit(gpu) | ~F.col("needs_gpu"))


def resolve(model: Column, unusable: Column) -> Column:
    """The first model down the fallbacks that is not in the array `unusable`, or the last one of them.

    Null for a model that is not registered.
    """
    known = model.isin([name for name, _, _ in MODELS])
    fallback = F.create_map(*(F.lit(x) for name, other, _ in MODELS if other for x in (name, other)))
    for _ in MODELS:
        model = F.when(F.array_contains(unusable, model), F.coalesce(fallback[model], model)).otherwise(model)
    return F.when(known, model)
