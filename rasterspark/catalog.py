"""All registered queries of the engine's own operators."""

from rasterspark import queries, queries_delivery, queries_plans  # noqa: F401

QUERIES, SQL = queries.QUERIES, queries.SQL
