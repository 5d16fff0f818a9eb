"""Exact top-k inner products by pivot-table elimination.

Components are quantised to floor(scale * x). Pivots are taken from a bounded sample of rows,
farthest first, and a table of the distances from every row and query to every pivot is made once. The
largest difference of the two distances over all pivots is a lower bound on the distance of query and
row, hence (with their lengths) an upper bound on their inner product. Rows are evaluated in the
order of that bound, and a query stops when the bound falls below its k-th best score; scores that tie
with it are still evaluated, so the result is exact whatever the pivots.

Rows belong to the cell of their nearest pivot. A query first searches its own cell; its k-th best
score there is then held against bounds for whole cells (from the least and largest distance of a
cell's rows to each pivot and their largest length), so it is sent on only to cells that can still
hold a better row, and starts there from the score it has.

Queries and rows meet in blocks: each task gets one block of queries and one of rows of a cell, both of
bounded size, and returns k rows a query at most, which are merged by rank. The query set is stated (ids
divisible by 100), so this is a search, not a join of all pairs; where nothing can be ruled out, as in
random vectors of many dimensions, it still compares each query with every row.

Null vectors and vectors with null, NaN or infinite components take no part. Vectors of unequal
length aren't compared. A query isn't compared with rows of its own vec_id; rows that repeat a
vec_id each count. A query id that repeats is one query, scored by each of its rows: its list holds the k best
of all of these scores, so a candidate can stand in it once for each row. Other columns are ignored, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterspark.llm.common import scratch


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every row of v to every pivot."""
    return np.stack([np.sqrt(((v - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def farthest_first(v: np.ndarray, most: int) -> np.ndarray:
    """Rows that are far from those before, the longest first."""
    chosen = [int(np.argmax((v * v).sum(axis=1)))]
    nearest = np.full(len(v), np.inf)
    while len(chosen) < min(most, len(v)):
        nearest = np.minimum(nearest, ((v - v[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(np.argmax(nearest)))
    return v[chosen]


def bounds(qq, xx, low):
    """The largest inner product of vectors of squared lengths qq and xx at distance low or more, rounding allowed for."""
    return (xx + qq - low * low) / 2 + 1e-9 * (xx + qq) + 1e-6


def search(q, q_ids, q_table, x, x_ids, x_table, k: int, known: np.ndarray | None = None, step: int = 512):
    """Rows (query row, vec_id, score) of the k best x for every q, ties to the smaller id, and how many were evaluated.

    Tables: distances to the pivots. known: scores below which a row is of no use to each query.
    """
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    xx, qq = (x * x).sum(axis=1), (q * q).sum(axis=1)
    if largest >= 2**53:  # exact integers, for very large components
        q, x = (np.array([[int(c) for c in row] for row in side], object) for side in (q, x))
    found, evaluated = [], 0
    for i in range(len(q)):
        low = np.abs(x_table - q_table[i]).max(axis=1)
        bound = bounds(qq[i], xx, low)
        order = np.argsort(-bound, kind="stable")
        order = order[x_ids[order] != q_ids[i]]
        least = -np.inf if known is None else known[i]
        ids, scores = np.zeros(0, np.int64), np.zeros(0, q.dtype)
        for at in range(0, len(order), step):
            if bound[order[at]] < max(least, scores[-1] if len(ids) == k else -np.inf):
                break
            part = order[at : at + step]
            evaluated += len(part)
            ids = np.concatenate([ids, x_ids[part]])
            scores = np.concatenate([scores, x[part] @ q[i]])
            best = np.array(sorted(range(len(ids)), key=lambda r: (-scores[r], ids[r]))[:k]) if q.dtype == object else np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
        found += [(i, int(ids[r]), int(scores[r])) for r in range(len(ids)) if scores[r] >= least]
    return found, evaluated


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<double> of whole numbers, dims); unusable vectors left out."""
    good = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter("vec_id is not null and embedding is not null").filter(good).select(
        F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"), F.size("embedding").alias("dims")
    )


def tabled(rows: DataFrame, pivots: int, sample: int) -> DataFrame:
    """rows (vec_id, v, dims), and their distances to the pivots of their dims, the nearest pivot (cell) and squared length.

    The pivots are of `sample` rows, those with the least hashes; dims without any there have the origin.
    """
    spark = rows.sparkSession
    by_dims: dict[int, list] = {}
    for r in rows.filter("dims > 0").orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).collect():
        by_dims.setdefault(r.dims, []).append(r.v)
    held = spark.sparkContext.broadcast({d: farthest_first(np.array(v), pivots) for d, v in by_dims.items()})

    def run(batches):
        for pdf in batches:
            out = []
            for dims, part in pdf.groupby("dims"):
                v = np.array(part["v"].tolist(), np.float64).reshape(len(part), -1)
                table = distances(v, held.value.get(dims, np.zeros((1, dims))))
                out.append(part.assign(distance=list(table), cell=table.argmin(axis=1).astype(np.int32), length=(v * v).sum(axis=1)))
            if out:
                yield pd.concat(out)

    return scratch(rows.mapInPandas(run, "vec_id long, v array<double>, dims int, distance array<double>, cell int, length double"))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, block: int = 8192, query_block: int = 4096, pivots: int = 32, sample: int = 2000) -> DataFrame:
    """embeddings (vec_id, embedding) -> query_id, rank, vec_id, score."""
    rows = tabled(quantised(vectors, scale), pivots, sample)
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    cell = ["dims", "cell"]
    # one row for each cell: as many as pivots
    cells = rows.groupBy(*cell).agg(
        F.count("*").alias("rows"), F.max("length").alias("longest"),
        *(f(F.get("distance", F.lit(p))).alias(f"{name}{p}") for p in range(pivots) for f, name in ((F.min, "least"), (F.max, "most"))),
    )
    sizes = cells.select(*cell, F.ceil(F.col("rows") / block).cast("int").alias("parts"), "longest", F.array(*(F.col(f"least{p}") for p in range(pivots))).alias("least"), F.array(*(F.col(f"most{p}") for p in range(pivots))).alias("most"))
    n = asked.groupBy("dims").agg(F.ceil(F.count("*") / query_block).cast("int").alias("query_parts"))
    key = [*cell, "part", "query_part"]
    # columns of their own, as both sides of a meeting come from the same table
    others = rows.select(*(F.col(c).alias(c) for c in rows.columns)).join(F.broadcast(sizes.select(*cell, "parts")), cell).join(F.broadcast(n), "dims").select(
        *cell, F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("query_part"), "vec_id", "v", "distance")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            q, x, q_table, x_table = (np.array(side[c].tolist(), np.float64).reshape(len(side), -1) for c in ("v", "distance") for side in (left, right))
            q_ids = left["vec_id"].to_numpy()
            best, _ = search(q, q_ids, q_table, x, right["vec_id"].to_numpy(), x_table, k, left["known"].fillna(-np.inf).to_numpy())
            found = [(q_ids[i], vec, score) for i, vec, score in best]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    def met(queries: DataFrame) -> DataFrame:
        """queries (dims, cell to search, vec_id, v, distance, known) against the rows of these cells."""
        dealt = queries.join(F.broadcast(sizes.select(*cell, "parts")), cell).join(F.broadcast(n), "dims").select(
            *cell, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("vec_id"), F.col("query_parts")).cast("int").alias("query_part"), "vec_id", "v", "distance", "known")
        return dealt.groupBy(*key).cogroup(others.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score long")

    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    own = scratch(ranked(met(asked.withColumn("known", F.lit(None).cast("double")))))
    known = own.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("known"))
    # how near a row of the cell can be, by each pivot
    gap = F.array_max(F.zip_with("least", F.zip_with("most", "distance", lambda m, d: F.struct(m.alias("m"), d.alias("d"))), lambda low, s: F.greatest(F.lit(0.0), low - s["d"], s["d"] - s["m"])))
    first = asked.join(known, "vec_id", "left").withColumnRenamed("cell", "_own")
    allowed = first.join(F.broadcast(sizes.drop("parts")), "dims").withColumn("gap", gap).filter((F.col("cell") != F.col("_own")) & (F.col("known").isNull() | (bounds(F.col("length"), F.col("longest"), F.col("gap")) >= F.col("known"))))
    more = met(allowed.select(*cell, "vec_id", "v", "distance", "known"))
    return ranked(own.drop("rank").union(more)).select("query_id", "rank", "vec_id", "score")
