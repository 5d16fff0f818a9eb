"""Stored settings laid over the defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Field, type and default, by group.
DEFAULTS = {
    "backgroundRemoval": [("enabled", "boolean", True), ("model", "string", "rmbg-1.4"), ("skipIfTransparent", "boolean", True), ("refineEdges", "boolean", True), ("decontaminateColors", "boolean", True)],
    "crop": [("enabled", "boolean", True), ("padding", "int", 8), ("alphaThreshold", "int", 0)],
    "resize": [("enabled", "boolean", True), ("maxWidth", "int", 1024), ("maxHeight", "int", 1024), ("preserveAspectRatio", "boolean", True), ("allowUpscale", "boolean", False)],
    "compression": [("format", "string", "original"), ("preset", "string", "high"), ("allowAvifInAuto", "boolean", True), ("fullPalette", "boolean", False)],
}
CUSTOM = [("quality", "int", 80), ("lossless", "boolean", False)]


def _type(fields) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind, _ in fields)


def merge(stored: Column) -> Column:
    """Settings as JSON -> a struct in which every field that is missing, null or not readable has its default."""
    custom = f"custom: struct<{_type(CUSTOM)}>"
    groups = [f"{g}: struct<{_type(fields)}{', ' + custom if g == 'compression' else ''}>" for g, fields in DEFAULTS.items()]
    read = F.from_json(stored, f"struct<{', '.join(groups)}>")

    def filled(at: Column, fields):
        return [F.coalesce(at[name], F.lit(default)).alias(name) for name, _, default in fields]

    inner = {"compression": [F.struct(*filled(read["compression"]["custom"], CUSTOM)).alias("custom")]}
    return F.struct(*(F.struct(*filled(read[g], fields), *inner.get(g, [])).alias(g) for g, fields in DEFAULTS.items()))
