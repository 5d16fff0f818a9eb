"""Connected components over an edge table: the engine's own operator, under the name used here."""

from __future__ import annotations

from rasterspark.operators.components import connected_components

__all__ = ["connected_components"]
