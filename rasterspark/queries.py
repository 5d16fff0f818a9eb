"""The registered queries of the engine's own operators, and their DuckDB SQL, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterspark.functions import binary, text
from rasterspark.operators import analysis, batch, components, geometry, metrics, palette, planes, selection
from rasterspark.plans import compression, models, settings
from rasterspark.sources import pixels
from rasterspark.streaming import events as ev

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _px(spark, d, side=8):
    return pixels.from_parts(_t(spark, d, "part"), side)


def _px_sql(side: int = 8) -> str:
    return f"""
img AS (SELECT p_partkey AS i, CAST({side} + p_size % 9 AS INTEGER) AS w, CAST({side - 2} + p_partkey % 7 AS INTEGER) AS h FROM part),
g0 AS (SELECT i, w, h, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM img, unnest(generate_series(0, w - 1)) AS tx(x), unnest(generate_series(0, h - 1)) AS ty(y)),
g1 AS (SELECT *, CAST(CASE WHEN i % 4 = 1 THEN (i * 7 + x // 3) % 256 ELSE (i * 7 + x * 13 + y * 29) % 256 END AS INTEGER) AS r FROM g0),
px AS (SELECT i AS image_id, w, h, x, y, r,
  CAST(CASE i % 4 WHEN 1 THEN i * 3 % 256 WHEN 2 THEN r ELSE (i * 3 + x * x) % 256 END AS INTEGER) AS g,
  CAST(CASE i % 4 WHEN 1 THEN i % 256 WHEN 2 THEN r ELSE (y * y * 5 + i) % 256 END AS INTEGER) AS b,
  CAST(CASE WHEN i % 4 = 3 THEN 255 WHEN x < 2 OR y < 1 THEN 0 WHEN x = 2 THEN i * 11 % 256 ELSE 255 END AS INTEGER) AS a FROM g1)"""


PX = "WITH" + _px_sql()
PAIR = PX + """,
pair AS (SELECT *, least(255, r + x * y % 5) AS r2, greatest(0, g - x % 3) AS g2, b AS b2, greatest(0, a - y % 4) AS a2 FROM px)"""
# luma on white, single precision, as the planes are stored
LUMA = PAIR + """,
lum AS (SELECT image_id, w, h, x, y,
  CAST(0.299::DOUBLE * (r * (a / 255) + (1 - a / 255) * 255) + 0.587::DOUBLE * (g * (a / 255) + (1 - a / 255) * 255) + 0.114::DOUBLE * (b * (a / 255) + (1 - a / 255) * 255) AS FLOAT) AS p,
  CAST(0.299::DOUBLE * (r2 * (a2 / 255) + (1 - a2 / 255) * 255) + 0.587::DOUBLE * (g2 * (a2 / 255) + (1 - a2 / 255) * 255) + 0.114::DOUBLE * (b2 * (a2 / 255) + (1 - a2 / 255) * 255) AS FLOAT) AS q FROM pair)"""
WINDOWS = LUMA + """,
dim AS (SELECT DISTINCT image_id, w, h, least(8, w, h) AS win, CASE WHEN least(8, w, h) < 8 THEN least(8, w, h) ELSE 4 END AS st FROM lum),
wx AS (SELECT DISTINCT image_id, win, s AS wx FROM dim, unnest(list_append(generate_series(0, w - win, st), w - win)) AS t(s)),
wy AS (SELECT DISTINCT image_id, s AS wy FROM dim, unnest(list_append(generate_series(0, h - win, st), h - win)) AS t(s)),
m AS (SELECT image_id, wx, wy, count(*) AS n, sum(p::DOUBLE) / count(*) AS mp, sum(q::DOUBLE) / count(*) AS mq, sum(p::DOUBLE * p::DOUBLE) / count(*) AS pp, sum(q::DOUBLE * q::DOUBLE) / count(*) AS qq, sum(p::DOUBLE * q::DOUBLE) / count(*) AS pq
      FROM lum JOIN wx USING (image_id) JOIN wy USING (image_id) WHERE x >= wx AND x < wx + win AND y >= wy AND y < wy + win GROUP BY image_id, wx, wy),
sc AS (SELECT image_id, (2 * mp * mq + 6.5025) * (2 * (pq - mp * mq) + 58.5225) / ((mp * mp + mq * mq + 6.5025) * (greatest(0, pp - mp * mp) + greatest(0, qq - mq * mq) + 58.5225)) AS score FROM m)"""


@query(PX + """,
k AS (SELECT *, CASE WHEN a = 0 THEN 0 ELSE r * 16777216::BIGINT + g * 65536 + b * 256 + a END AS key FROM px),
f AS (SELECT *, CASE WHEN key = lag(key) OVER (PARTITION BY image_id, y ORDER BY x) THEN 1 ELSE 0 END AS flat FROM k),
s AS (SELECT image_id, w, h, count(*) AS n, sum(flat) AS flat, least(count(DISTINCT key), 65537) AS c, count_if(a = 0) AS clear, count_if(a > 0 AND a < 255) AS part,
  bool_and(a = 0 OR (r = g AND g = b)) AS gray, avg(CASE WHEN a = 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (x = 0 OR y = 0 OR x = w - 1 OR y = h - 1) AS border FROM f GROUP BY ALL),
t AS (SELECT *, flat / greatest(1, n - h) AS ratio FROM s)
SELECT image_id, w AS width, h AS height, clear + part > 0 AS has_alpha, CASE WHEN clear + part = 0 THEN 'opaque' WHEN part = 0 THEN 'binary' ELSE 'soft' END AS alpha_kind,
  round(border, 6) AS border_ratio, CAST(c AS INTEGER) AS unique_colors, gray AS is_grayscale,
  CASE WHEN c <= 256 AND NOT (gray AND c > 64 AND ratio < 0.9) THEN 'exact-color' WHEN ratio > 0.75 AND c < 8192 THEN 'flat-graphic'
       WHEN ratio > 0.35 OR (clear + part > 0 AND clear / n > 0.2 AND ratio > 0.2) THEN 'illustration' ELSE 'photo' END AS content_type FROM t""")
def analyze_image(spark, d):
    return analysis.analyze(_px(spark, d))


@query(PX + """ SELECT image_id, min(x) FILTER (a > 8) AS x, min(y) FILTER (a > 8) AS y, max(x) FILTER (a > 8) - min(x) FILTER (a > 8) + 1 AS width, max(y) FILTER (a > 8) - min(y) FILTER (a > 8) + 1 AS height FROM px GROUP BY image_id""")
def content_bounds(spark, d):
    return analysis.content_bounds(_px(spark, d), 8)


def _sums(df, *names, by=("image_id",)):
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.round(F.sum(F.col(c).cast("double") * (1 + F.col("x") + 2 * F.col("y"))), 4).alias(f"sum_{c}") for c in names))


def _sums_sql(source: str, *names: str) -> str:
    return f"SELECT image_id, count(*) AS n, {', '.join(f'round(sum({c}::DOUBLE * (1 + x + 2 * y)), 4) AS sum_{c}' for c in names)} FROM {source} GROUP BY image_id"


@query(PX + """,
box AS (SELECT image_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM px WHERE a > 0 GROUP BY image_id),
o AS (SELECT image_id, x - x0 + 2 AS x, y - y0 + 2 AS y, r, g, b, a FROM px JOIN box USING (image_id) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)
SELECT image_id, CAST((any_value(x1) - any_value(x0) + 5) * (any_value(y1) - any_value(y0) + 5) AS BIGINT) AS n,
  round(sum(r::DOUBLE * (1 + x + 2 * y)), 4) AS sum_r, round(sum(g::DOUBLE * (1 + x + 2 * y)), 4) AS sum_g, round(sum(b::DOUBLE * (1 + x + 2 * y)), 4) AS sum_b, round(sum(a::DOUBLE * (1 + x + 2 * y)), 4) AS sum_a
FROM o JOIN box USING (image_id) GROUP BY image_id""")
def crop_pad_pixels(spark, d):
    px = _px(spark, d)
    return _sums(analysis.crop_and_pad(px, analysis.content_bounds(px), 2), "r", "g", "b", "a")


@query(PX + ", o AS (SELECT image_id, x, y, " + ", ".join(f"least(255, greatest(0, round_even({c} * (a / 255) + (1 - a / 255) * 255, 0))) AS {c}" for c in "rgb") + " FROM px) " + _sums_sql("o", "r", "g", "b"))
def flatten_onto(spark, d):
    return _sums(planes.flatten_onto(_px(spark, d)), "r", "g", "b")


@query(LUMA + """ SELECT image_id, count(*) AS n, round(sum(p::DOUBLE), 3) AS luma, round(sum(q::DOUBLE), 3) AS luma2 FROM lum GROUP BY image_id""")
def ycbcr_planes(spark, d):
    return metrics.luma_pairs(pixels.degraded(_px(spark, d))).groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("p").cast("double")), 3).alias("luma"), F.round(F.sum(F.col("q").cast("double")), 3).alias("luma2"))


@query(PX + """, o AS (SELECT image_id, x // 2 AS x, y // 2 AS y, avg(r) AS v FROM px WHERE x < w // 2 * 2 AND y < h // 2 * 2 GROUP BY ALL) """ + _sums_sql("o", "v"))
def halve_plane(spark, d):
    return _sums(planes.halve(_px(spark, d).withColumn("v", F.col("r").cast("double"))), "v")


@query(PX + """, s AS (SELECT image_id, x // 3 AS x, y // 3 AS y, sum(r * a) AS r, sum(g * a) AS g, sum(b * a) AS b, sum(a) AS a FROM px WHERE x < w // 3 * 3 AND y < h // 3 * 3 GROUP BY ALL),
o AS (SELECT image_id, x, y, """ + ", ".join(f"CASE WHEN a > 0 THEN round_even({c} / a, 0) ELSE 0 END AS {c}" for c in "rgb") + ", round_even(a / 9, 0) AS a FROM s) " + _sums_sql("o", "r", "g", "b", "a"))
def box_downscale(spark, d):
    return _sums(planes.box_downscale(_px(spark, d), 3), "r", "g", "b", "a")


@query(PX + """, o1 AS (SELECT image_id, x, y, (coalesce(lag(r) OVER u, r) + 2 * r + coalesce(lead(r) OVER u, r)) / 4 AS v FROM px WINDOW u AS (PARTITION BY image_id, y ORDER BY x)),
o AS (SELECT image_id, x, y, (coalesce(lag(v) OVER u, v) + 2 * v + coalesce(lead(v) OVER u, v)) / 4 AS v FROM o1 WINDOW u AS (PARTITION BY image_id, x ORDER BY y)) """ + _sums_sql("o", "v"))
def binomial_blur(spark, d):
    return _sums(planes.binomial_blur(_px(spark, d).withColumn("v", F.col("r").cast("double"))), "v")


@query(PX + """, o1 AS (SELECT image_id, x, y, avg(a) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM px),
o AS (SELECT image_id, x, y, avg(v) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM o1) """ + _sums_sql("o", "v"))
def box_blur(spark, d):
    return _sums(planes.box_blur(_px(spark, d).withColumn("v", F.col("a").cast("double")), 2), "v")


@query(PX + """, o1 AS (SELECT image_id, x, y, max(CASE WHEN a > 127 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS k FROM px),
o AS (SELECT image_id, x, y, max(k) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM o1) """ + _sums_sql("o", "v"))
def dilate_core(spark, d):
    return _sums(planes.dilate(_px(spark, d).withColumn("keep", F.col("a") > 127), 1).withColumn("v", F.col("keep").cast("int")), "v")


@query(PX + """, l AS (SELECT image_id, x, y, ((r * 54 + g * 183 + b * 19) >> 8) * (a / 255) AS v FROM px),
o AS (SELECT image_id, x, y, greatest(0.15::DOUBLE, 1 - greatest(coalesce(abs(lag(v) OVER u - v), 0), coalesce(abs(lead(v) OVER u - v), 0), coalesce(abs(lag(v) OVER t - v), 0), coalesce(abs(lead(v) OVER t - v), 0)) / 40) AS weight
  FROM l WINDOW u AS (PARTITION BY image_id, y ORDER BY x), t AS (PARTITION BY image_id, x ORDER BY y)) """ + _sums_sql("o", "weight"))
def edge_map(spark, d):
    return _sums(planes.edge_map(_px(spark, d)), "weight")


@query(PX + """ SELECT image_id, CAST(x * 4 // w AS INTEGER) AS cx, CAST(y * 3 // h AS INTEGER) AS cy, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b, round(avg(a), 6) AS a FROM px GROUP BY ALL""")
def area_downsample(spark, d):
    return planes.area_downsample(_px(spark, d), 4, 3).select("image_id", "cx", "cy", *(F.round(c, 6).alias(c) for c in "rgba"))


@query(PX + """ SELECT image_id, c AS channel, round(sum(CAST((v / 255 - 0.5) / 0.25 AS FLOAT)::DOUBLE), 3) AS total FROM
(SELECT image_id, 0 AS c, r AS v FROM px UNION ALL SELECT image_id, 1, g FROM px UNION ALL SELECT image_id, 2, b FROM px) GROUP BY ALL""")
def to_tensor(spark, d):
    return planes.to_tensor(_px(spark, d), (0.5,) * 3, (0.25,) * 3).groupBy("image_id", "channel").agg(F.round(F.sum(F.col("value").cast("double")), 3).alias("total"))


@query(PX + """, m AS (SELECT *, (x * 37 + y * 11) % 256 / 255 AS t FROM px),
o AS (SELECT image_id, x, y, r, CAST(floor(CASE WHEN t < 8 / 255 THEN 0 WHEN t > 252 / 255 THEN 1 ELSE t END * a + 0.5) AS INTEGER) AS a FROM m),
o2 AS (SELECT image_id, x, y, CASE WHEN a = 0 THEN 0 ELSE r END AS r, a FROM o) """ + _sums_sql("o2", "r", "a"))
def compose_matte(spark, d):
    return _sums(planes.compose_matte(_px(spark, d), (F.col("x") * 37 + F.col("y") * 11) % 256 / 255), "r", "a")


@query(WINDOWS + " SELECT image_id, round(avg(score), 6) AS ssim FROM sc GROUP BY image_id")
def ssim_luma(spark, d):
    return metrics.ssim(metrics.luma_pairs(pixels.degraded(_px(spark, d)))).select("image_id", F.round("ssim", 6).alias("ssim"))


@query(WINDOWS + """, b AS (SELECT image_id, CAST(least(1999, greatest(0, floor((score + 1) / 2 * 2000))) AS INTEGER) AS bin, count(*) AS n FROM sc GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY image_id) AS total FROM b)
SELECT image_id, round((min(bin) + 0.5) / 2000 * 2 - 1, 6) AS worst_block_ssim FROM c WHERE upto >= greatest(1, floor(total * 0.01)) GROUP BY image_id""")
def worst_block(spark, d):
    return metrics.worst_block(metrics.luma_pairs(pixels.degraded(_px(spark, d)))).select("image_id", F.round("worst_block_ssim", 6).alias("worst_block_ssim"))


@query(PAIR + """, e AS (SELECT image_id, avg((""" + " + ".join(f"power({c} * a / 255 + (1 - a / 255) * 255 - ({c}2 * a2 / 255 + (1 - a2 / 255) * 255), 2)" for c in "rgb") + """) / 3) AS mse FROM pair GROUP BY image_id)
SELECT image_id, CASE WHEN mse = 0 THEN CAST('inf' AS DOUBLE) ELSE round(10 * log10(65025 / mse), 6) END AS psnr FROM e""")
def psnr(spark, d):
    return metrics.psnr(pixels.degraded(_px(spark, d))).select("image_id", F.round("psnr", 6).alias("psnr"))


@query(PAIR + " SELECT image_id, max(abs(a - a2)) AS max_alpha_error FROM pair GROUP BY image_id")
def max_alpha_error(spark, d):
    return metrics.max_alpha_error(pixels.degraded(_px(spark, d)))


PALETTE = PX + """, pal AS (SELECT p_partkey AS image_id, CAST(k AS INTEGER) AS idx, CAST(k * 60 AS INTEGER) AS r, CAST((k * 83 + p_partkey) % 256 AS INTEGER) AS g, CAST((k * 37) % 256 AS INTEGER) AS b, CAST(CASE WHEN k = 0 THEN 0 ELSE 255 END AS INTEGER) AS a FROM part, unnest(generate_series(0, 4)) AS t(k)),
col AS (SELECT image_id, r, g, b, a, count(*) AS n FROM px GROUP BY ALL),
dist AS (SELECT col.*, idx, round(power(col.r * (col.a / 255) * 0.6378::DOUBLE - pal.r * (pal.a / 255) * 0.6378::DOUBLE, 2) + power(col.g * (col.a / 255) * 2.1456::DOUBLE - pal.g * (pal.a / 255) * 2.1456::DOUBLE, 2)
  + power(col.b * (col.a / 255) * 0.2166::DOUBLE - pal.b * (pal.a / 255) * 0.2166::DOUBLE, 2) + power(col.a * 1.5::DOUBLE - pal.a * 1.5::DOUBLE, 2), 6) AS d FROM col JOIN pal USING (image_id)),
near AS (SELECT image_id, r, g, b, a, n, idx FROM dist QUALIFY row_number() OVER (PARTITION BY image_id, r, g, b, a ORDER BY d, idx) = 1)"""


def _palette(spark, d):
    k, key = F.col("idx"), F.col("image_id")
    return _t(spark, d, "part").select(F.col("p_partkey").cast("long").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("idx")).select(
        "image_id", "idx", (k * 60).alias("r"), ((k * 83 + key) % 256).cast("int").alias("g"), (k * 37 % 256).alias("b"), F.when(k == 0, 0).otherwise(255).alias("a"))


@query(PALETTE + " SELECT image_id, idx, count(*) AS colors, CAST(sum(n) AS BIGINT) AS n FROM near GROUP BY image_id, idx")
def nearest_palette(spark, d):
    return palette.nearest(_px(spark, d), _palette(spark, d)).groupBy("image_id", "idx").agg(F.count("*").alias("colors"), F.sum("n").alias("n"))


@query(PALETTE + " SELECT image_id, idx, CAST(sum(n) AS BIGINT) AS n FROM near GROUP BY image_id, idx")
def palette_population(spark, d):
    return palette.population(_px(spark, d), _palette(spark, d))


@query(PALETTE + """, mean AS (SELECT image_id, idx, sum(r * a * n) / sum(n) / 255 AS r, sum(g * a * n) / sum(n) / 255 AS g, sum(b * a * n) / sum(n) / 255 AS b, sum(a * n) / sum(n) AS a FROM near GROUP BY ALL)
SELECT pal.image_id, pal.idx, round(coalesce(mean.r, pal.r * (pal.a / 255)), 4) AS mr, round(coalesce(mean.g, pal.g * (pal.a / 255)), 4) AS mg, round(coalesce(mean.b, pal.b * (pal.a / 255)), 4) AS mb, round(coalesce(mean.a, pal.a), 4) AS ma
FROM pal LEFT JOIN mean ON pal.image_id = mean.image_id AND pal.idx = mean.idx""")
def kmeans_step(spark, d):
    return palette.kmeans_step(_px(spark, d), _palette(spark, d)).select("image_id", "idx", *(F.round(f"m{c}", 4).alias(f"m{c}") for c in "rgba"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 4) AS v FROM embeddings),
m AS (SELECT vec_id, v, list_min(v) AS lo, list_max(v) AS hi FROM v)
SELECT vec_id, round(list_sum(list_transform(v, lambda x: least(1, greatest(0, x)))), 6) AS plain,
  round(list_sum(list_transform(v, lambda x: (x - lo) / (hi - lo))), 6) AS spread,
  round(list_sum(CASE WHEN lo < -0.01 OR hi > 1.01 THEN list_transform(v, lambda x: 1 / (1 + exp(-x))) ELSE list_transform(v, lambda x: least(1, greatest(0, x))) END), 6) AS auto FROM m""")
def mask_normalize(spark, d):
    masks = _t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 4).alias("data"))
    out = masks.withColumn("raw", F.col("data"))
    for mode, name in (("none", "plain"), ("minmax", "spread"), ("auto", "auto")):
        out = planes.normalize_mask(out.withColumn("data", F.col("raw")), mode).withColumnRenamed("data", name)
    add = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6).alias(c)
    return out.select("vec_id", add("plain"), add("spread"), add("auto"))


FILL = """WITH f AS (SELECT l_orderkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS idx,
  l_partkey AS hash, l_discount, l_tax, CAST(l_extendedprice AS BIGINT) AS bytes, l_quantity FROM lineitem)"""


def _fills(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("node"), F.row_number().over(order).cast("long").alias("idx"), F.col("l_partkey").alias("hash"), "l_discount", "l_tax", F.bround("l_extendedprice").cast("long").alias("bytes"), "l_quantity")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(least(greatest(floor(l_discount * 640 + 0.5), 0), 639) AS INTEGER) AS x, CAST(least(greatest(floor(l_tax * 480 + 0.5), 0), 479) AS INTEGER) AS y,
 CAST(least(greatest(floor((l_discount + l_quantity / 50) * 640 + 0.5), least(greatest(floor(l_discount * 640 + 0.5), 0), 639) + 1), 640) - least(greatest(floor(l_discount * 640 + 0.5), 0), 639) AS INTEGER) AS width,
 CAST(least(greatest(floor((l_tax + l_quantity / 100) * 480 + 0.5), least(greatest(floor(l_tax * 480 + 0.5), 0), 479) + 1), 480) - least(greatest(floor(l_tax * 480 + 0.5), 0), 479) AS INTEGER) AS height FROM lineitem""")
def pixel_rect(spark, d):
    q = F.col("l_quantity")
    r = geometry.pixel_rect(F.col("l_discount"), F.col("l_tax"), q / 50, q / 100, F.lit(640), F.lit(480))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", r.alias("rect")).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "rect.*")


SIZE = "WITH s AS (SELECT p_partkey, p_size * 97 + p_partkey % 61 AS w, p_size * 53 + p_partkey % 89 AS h FROM part)"


def _sizes(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    return _t(spark, d, "part").select("p_partkey", (s * 97 + k % 61).alias("w"), (s * 53 + k % 89).alias("h"))


@query(SIZE + """, t AS (SELECT *, least(1, least(1008::DOUBLE / w, 1008::DOUBLE / h)) AS a FROM s)
SELECT p_partkey, CAST(greatest(1, floor(w * a + 0.5)) AS INTEGER) AS width, CAST(greatest(1, floor(h * a + 0.5)) AS INTEGER) AS height, CAST(least(w, 1024) AS INTEGER) AS free_width, CAST(h AS INTEGER) AS free_height FROM t""")
def target_size(spark, d):
    w, h = F.col("w"), F.col("h")
    return _sizes(spark, d).select("p_partkey", geometry.target_size(w, h, 1024, 1024, reserved=16).alias("s"), geometry.target_size(w, h, 1024, 0, keep_aspect=False).alias("f")).select(
        "p_partkey", F.col("s.width"), F.col("s.height"), F.col("f.width").alias("free_width"), F.col("f.height").alias("free_height"))


@query(SIZE + """, t AS (SELECT *, least(1024::DOUBLE / least(w, h), 2048::DOUBLE / greatest(w, h)) AS a FROM s)
SELECT p_partkey, CAST(greatest(32, floor(w * a / 32 + 0.5) * 32) AS INTEGER) AS width, CAST(greatest(32, floor(h * a / 32 + 0.5) * 32) AS INTEGER) AS height FROM t""")
def model_input_size(spark, d):
    return _sizes(spark, d).select("p_partkey", geometry.model_input_size(F.col("w"), F.col("h"), 1024, 32, 2048).alias("s")).select("p_partkey", "s.width", "s.height")


@query(SIZE + """, t AS (SELECT *, greatest(400::DOUBLE / w, 200::DOUBLE / h) AS a FROM s), v AS (SELECT *, least(1, 400 / (w * a)) AS vw, least(1, 200 / (h * a)) AS vh FROM t)
SELECT p_partkey, CASE WHEN NOT (vw >= 0.998 AND vh >= 0.998) THEN round((1 - vw) / 2, 6) END AS x, CASE WHEN NOT (vw >= 0.998 AND vh >= 0.998) THEN round((1 - vh) / 2, 6) END AS y,
 CASE WHEN NOT (vw >= 0.998 AND vh >= 0.998) THEN round(vw, 6) END AS width, CASE WHEN NOT (vw >= 0.998 AND vh >= 0.998) THEN round(vh, 6) END AS height FROM v""")
def visible_region(spark, d):
    r = geometry.visible_fill(F.lit(400), F.lit(200), F.col("w"), F.col("h"))
    return _sizes(spark, d).select("p_partkey", r.alias("r")).select("p_partkey", *(F.round(f"r.{c}", 6).alias(c) for c in ("x", "y", "width", "height")))


@query("SELECT * REPLACE (CAST(min_ssim AS DOUBLE) AS min_ssim, CAST(min_worst AS DOUBLE) AS min_worst, CAST(dithering AS DOUBLE) AS dithering) FROM (VALUES " + ", ".join(str(r) for r in compression.TARGETS) + ") AS t(" + ", ".join(x.split()[0] for x in compression.NAMES.split(", ")) + ")")
def quality_targets(spark, d):
    return compression.quality_targets(spark)


ATTEMPT = FILL + ", t AS (SELECT hash AS image_id, row_number() OVER (PARTITION BY hash ORDER BY node, idx) AS pos, bytes, 1 - l_discount AS ssim, l_discount < 0.05 AS passed FROM f)"


def _attempts(spark, d):
    pos = F.row_number().over(Window.partitionBy("hash").orderBy("node", "idx")).cast("long")
    return _fills(spark, d).select(F.col("hash").alias("image_id"), pos.alias("pos"), "bytes", (1 - F.col("l_discount")).alias("ssim"), (F.col("l_discount") < 0.05).alias("passed"))


@query(ATTEMPT + " SELECT image_id, pos, bytes, ssim, passed FROM t QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY passed DESC, CASE WHEN passed THEN bytes END, CASE WHEN NOT passed THEN -ssim END, pos) = 1")
def best_candidate(spark, d):
    return compression.best_candidate(_attempts(spark, d))


@query(ATTEMPT + ", u AS (SELECT image_id, 256 - pos AS colors, bool_and(passed) OVER (PARTITION BY image_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ok FROM t) SELECT image_id, min(colors) AS colors FROM u WHERE ok GROUP BY image_id")
def palette_walk(spark, d):
    return compression.palette_walk(_attempts(spark, d).withColumn("colors", 256 - F.col("pos")))


@query("""WITH t AS (SELECT p_partkey, p_size / 10 AS mp, p_size * 2 AS q FROM part)
SELECT p_partkey, CAST(CASE WHEN mp <= 0.5 THEN 4 WHEN mp <= 2 THEN 3 WHEN mp <= 8 THEN 2 ELSE 1 END AS INTEGER) AS png_level, CASE WHEN mp <= 0.3 THEN 'q100/m6' WHEN mp <= 2 THEN 'q80/m5' ELSE 'q60/m4' END AS effort,
CAST(greatest(2, least(256, floor(power(2, 1 + q / 100 * 7) + 0.5))) AS INTEGER) AS colors FROM t""")
def encoder_effort(spark, d):
    mp = F.col("p_size") / 10
    return _t(spark, d, "part").select("p_partkey", compression.png_level(mp).alias("png_level"), compression.lossless_effort(mp).alias("effort"), compression.palette_budget(F.col("p_size") * 2).alias("colors"))


_KIND = "CASE p_size % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' WHEN 3 THEN 'gif' ELSE 'avif' END"


def _kind():
    c = F.col("p_size") % 5
    return F.when(c == 0, "png").when(c == 1, "jpeg").when(c == 2, "webp").when(c == 3, "gif").otherwise("avif")


@query(f"""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN {_KIND} ELSE CASE p_partkey % 2 WHEN 0 THEN 'jpeg' ELSE 'auto' END END AS f, p_partkey % 4 = 0 AS al FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN f WHEN f = 'jpeg' AND al OR f NOT IN ('png', 'jpeg', 'webp', 'avif') THEN 'png' ELSE f END AS format FROM t""")
def resolve_format(spark, d):
    k = F.col("p_partkey")
    wanted = F.when(k % 3 == 0, "original").when(k % 2 == 0, "jpeg").otherwise("auto")
    return _t(spark, d, "part").select("p_partkey", compression.resolve_format(wanted, _kind(), k % 4 == 0).alias("format"))


@query(f"""WITH t AS (SELECT p_partkey, {_KIND} AS s, CAST(p_retailprice * 100 AS BIGINT) AS o, CAST(p_retailprice * 100 AS BIGINT) - p_partkey % 200 + 100 AS n FROM part)
SELECT p_partkey, p_partkey % 2 = 0 AND s IN ('png', 'jpeg', 'webp', 'avif') AND o <= n * CASE WHEN s = 'png' THEN 1.0 ELSE 1.05 END AS kept, round(o / n, 6) AS ratio, round(1 - n / o, 6) AS savings FROM t""")
def keep_original(spark, d):
    o = F.bround(F.col("p_retailprice") * 100).cast("long")
    n = o - F.col("p_partkey") % 200 + 100
    return _t(spark, d, "part").select("p_partkey", compression.keep_original(F.col("p_partkey") % 2 == 0, F.lit("auto"), _kind(), F.lit("high"), o, n).alias("kept"), F.round(o / n, 6).alias("ratio"), F.round(1 - n / o, 6).alias("savings"))


@query("WITH a AS (" + SQL["analyze_image"] + """),
t AS (SELECT image_id, CASE image_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'webp' WHEN 2 THEN 'avif' WHEN 3 THEN 'jpeg' ELSE 'auto' END AS f, content_type = 'exact-color' AS e, content_type = 'photo' AS p, content_type = 'flat-graphic' OR unique_colors <= 4096 AS k,
 has_alpha AS al, is_grayscale AND NOT has_alpha AS g, is_grayscale AS gray, image_id % 23 AS mp, image_id % 3 = 0 AS most, image_id % 11 = 0 AS ll, unique_colors AS c FROM a),
q AS (SELECT *, NOT e OR (c > 64 AND NOT most) AS q, mp <= 16 AS av FROM t),
r AS (SELECT *, CASE f WHEN 'png' THEN CASE WHEN ll THEN 'png-lossless' WHEN e THEN concat_ws(',', CASE WHEN q THEN 'png-quant' END, 'png-lossless') WHEN q THEN 'png-quant' ELSE 'png-lossless' END
 WHEN 'webp' THEN CASE WHEN ll THEN 'webp-lossless' WHEN e THEN concat_ws(',', 'webp-lossless', CASE WHEN q THEN 'webp-palette' END) ELSE concat_ws(',', 'webp', CASE WHEN q AND (NOT p OR al) THEN 'webp-palette' END, CASE WHEN k THEN 'webp-lossless' END) END
 WHEN 'avif' THEN CASE WHEN ll THEN 'avif-lossless' ELSE 'avif' END
 WHEN 'jpeg' THEN CASE WHEN g THEN 'jpeg-gray' WHEN NOT p OR mp <= 1.5 OR most THEN 'jpeg-420,jpeg-444' ELSE 'jpeg-420' END
 ELSE CASE WHEN ll THEN 'png-lossless,webp-lossless' WHEN e THEN CASE WHEN q THEN 'png-quant,webp-palette,' ELSE '' END || 'png-lossless,webp-lossless'
  WHEN p AND NOT al THEN concat_ws(',', 'webp', CASE WHEN gray THEN 'jpeg-gray' ELSE 'jpeg-420' END, CASE WHEN av THEN 'avif' END)
  WHEN p THEN concat_ws(',', 'webp', CASE WHEN av THEN 'avif' END, CASE WHEN q AND mp <= 4 THEN 'png-quant,webp-palette' END)
  ELSE concat_ws(',', CASE WHEN q THEN 'png-quant,webp-palette' END, 'webp', CASE WHEN k THEN 'webp-lossless' END, CASE WHEN av THEN 'avif' END) END END AS pr FROM q)
SELECT image_id, f AS format, pr AS primary, CASE WHEN ll OR e THEN '' WHEN f = 'png' AND q THEN 'png-lossless' WHEN f = 'webp' AND NOT k THEN 'webp-lossless'
 WHEN f = 'auto' THEN CASE WHEN contains(pr, 'webp-lossless') THEN 'png-lossless' ELSE 'webp-lossless,png-lossless' END ELSE '' END AS fallback FROM r""")
def choose_candidates(spark, d):
    a = analyze_image(spark, d)
    i = F.col("image_id")
    form = F.element_at(F.array(*(F.lit(x) for x in ("png", "webp", "avif", "jpeg", "auto"))), (i % 5 + 1).cast("int"))
    primary, fallback = compression.candidates(form, F.col("content_type"), F.col("has_alpha"), F.col("is_grayscale"), F.col("unique_colors"), i % 23, F.when(i % 3 == 0, "maximum").otherwise("high"), i % 11 == 0)
    return a.select("image_id", form.alias("format"), F.array_join(primary, ",").alias("primary"), F.array_join(fallback, ",").alias("fallback"))


_HEADS = [("89504E470D0A1A0A", "png"), ("FFD8FFE0", "jpeg"), ("474946383961", "gif"), ("524946460000000057454250", "webp"), ("0000001C667479706D696631000000006D69663161766966", "avif"), ("424D", "bmp"), ("00010203", "unknown")]


@query("""SELECT p_partkey, CASE p_partkey % 7 """ + " ".join(f"WHEN {i} THEN '{n}'" for i, (_, n) in enumerate(_HEADS)) + " END AS format FROM part")
def sniff_format(spark, d):
    heads = F.array(*(F.unhex(F.lit(h)) for h, _ in _HEADS))
    files = _t(spark, d, "part").select("p_partkey", F.concat(F.element_at(heads, (F.col("p_partkey") % 7 + 1).cast("int")), F.encode("p_name", "UTF-8")).alias("content"))
    return files.select("p_partkey", text.sniff_format(F.col("content")).alias("format"))


@query("SELECT * FROM (VALUES " + ", ".join(str(r) for r in text.FORMATS) + ") AS t(format, mime, extension)")
def mime_map(spark, d):
    return spark.createDataFrame(text.FORMATS, "format string, mime string, extension string")


@query(r"""WITH s AS (SELECT p_partkey, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_name || ' #' || p_size || '!', '[^a-zA-Z0-9._ -]+', '-', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'))[1:80] AS n FROM part)
SELECT p_partkey, CASE WHEN n = '' THEN 'image' ELSE n END AS name FROM s""")
def sanitize_name(spark, d):
    return _t(spark, d, "part").select("p_partkey", text.sanitize(F.concat("p_name", F.lit(" #"), "p_size", F.lit("!"))).alias("name"))


@query("""WITH s AS (SELECT p_partkey, replace(p_name, ' ', '-') AS stem, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)
SELECT p_partkey, stem || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.png' AS name FROM s""")
def unique_names(spark, d):
    files = _t(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("pos"), F.regexp_replace("p_name", " ", "-").alias("stem"), F.lit("png").alias("ext"))
    return text.unique_names(files).select("p_partkey", "name")


@query("""WITH t AS (SELECT o_orderkey, CAST(o_totalprice * (1 + o_orderkey % 97) AS BIGINT) // (1 + o_orderkey % 5 * 1000) AS n FROM orders)
SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 10240 THEN (floor(n * 10 / 1024 + 0.5)::BIGINT // 10) || '.' || (floor(n * 10 / 1024 + 0.5)::BIGINT % 10) || ' KB' WHEN n < 1048576 THEN floor(n / 1024 + 0.5)::BIGINT || ' KB'
WHEN n < 10485760 THEN (floor(n * 100 / 1048576 + 0.5)::BIGINT // 100) || '.' || lpad((floor(n * 100 / 1048576 + 0.5)::BIGINT % 100)::VARCHAR, 2, '0') || ' MB' ELSE (floor(n * 10 / 1048576 + 0.5)::BIGINT // 10) || '.' || (floor(n * 10 / 1048576 + 0.5)::BIGINT % 10) || ' MB' END AS size FROM t""")
def format_bytes(spark, d):
    n = F.floor(F.bround(F.col("o_totalprice") * (1 + F.col("o_orderkey") % 97)).cast("long") / (1 + F.col("o_orderkey") % 5 * 1000)).cast("long")
    return _t(spark, d, "orders").select("o_orderkey", text.format_bytes(n).alias("size"))


@query(FILL + " SELECT node, idx, hash || '@' || printf('%.4f', l_discount) || ',' || printf('%.4f', l_tax) || ',' || printf('%.4f', 0.5) || ',' || printf('%.4f', 0.25) AS key FROM f")
def crop_key(spark, d):
    return _fills(spark, d).select("node", "idx", text.crop_key(F.col("hash").cast("string"), F.col("l_discount"), F.col("l_tax"), F.lit(0.5), F.lit(0.25)).alias("key"))


@query(FILL + " SELECT hash, arg_min(node, node * 100 + idx) AS first_node, count(*) AS targets, count(DISTINCT node) AS nodes FROM f GROUP BY hash")
def selection_dedupe(spark, d):
    return selection.dedupe(_fills(spark, d).withColumn("pos", F.col("node") * 100 + F.col("idx")))


@query("""WITH f AS (SELECT DISTINCT l_partkey AS hash FROM lineitem) SELECT hash, CASE WHEN p_size <= 40 THEN p_size * 10 END AS width, CASE WHEN p_size <= 40 THEN p_size * 7 END AS height FROM f LEFT JOIN part ON hash = p_partkey""")
def image_sizes_left_join(spark, d):
    sizes = _t(spark, d, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("hash"), (F.col("p_size") * 10).alias("width"), (F.col("p_size") * 7).alias("height"))
    return selection.with_sizes(_t(spark, d, "lineitem").select(F.col("l_partkey").alias("hash")).distinct(), sizes)


@query("SELECT o_orderkey AS pos, o_orderkey AS node, (SELECT count(*) FROM orders) > 1000 AS truncated FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) <= 1000")
def node_cap(spark, d):
    return selection.first_nodes(_t(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("node")), 1000)


@query(FILL + """, live AS (SELECT node, idx, CASE WHEN node % 7 = 0 THEN hash + 1 ELSE hash END AS lh, CASE WHEN node % 11 = 0 THEN 'mixed' ELSE 'IMAGE' END AS kind FROM f WHERE node % 5 <> 0),
m AS (SELECT f.hash AS image_id, CASE WHEN kind IS NULL THEN 'layer was deleted' WHEN kind = 'mixed' THEN 'mixed fills' WHEN lh <> hash THEN 'fill changed' END AS error FROM f LEFT JOIN live ON f.node = live.node AND f.idx = live.idx)
SELECT image_id, CAST(count_if(error IS NULL) AS BIGINT) AS updated, count_if(error IS NULL) > 0 AS ok, coalesce(string_agg(DISTINCT error, '; ' ORDER BY error), '') AS errors FROM m GROUP BY image_id""")
def apply_replace(spark, d):
    f = _fills(spark, d)
    live = f.filter("node % 5 <> 0").select("node", "idx", F.when(F.col("node") % 7 == 0, F.col("hash") + 1).otherwise(F.col("hash")).alias("live_hash"), F.when(F.col("node") % 11 == 0, "mixed").otherwise("IMAGE").alias("kind"))
    return selection.apply_results(f.select(F.col("hash").alias("image_id"), "node", "idx", "hash"), live)


@query(SIZE + " SELECT p_partkey, CASE WHEN w > 4096 OR h > 4096 THEN 'larger than 4096 pixels' END AS error FROM s")
def size_gate(spark, d):
    return selection.size_gate(_sizes(spark, d).withColumnsRenamed({"w": "width", "h": "height"})).select("p_partkey", "error")


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END"


def _jobs(spark, d):
    s = F.col("o_orderstatus")
    k, n = F.col("o_orderkey"), len(batch.STAGES)
    stage = F.element_at(F.array(*(F.lit(x[0]) for x in batch.STAGES)), (k % n + 1).cast("int"))
    price = F.bround(F.col("o_totalprice")).cast("long")
    return _t(spark, d, "orders").select("o_orderpriority", "o_orderkey", F.when(s == "F", "completed").when(s == "O", "processing").otherwise("failed").alias("status"), stage.alias("stage"), F.when(k % 3 > 0, (k % 10) / 10).alias("fraction"), price.alias("original"), F.floor(price / 3).cast("long").alias("output"))


@query(f"""WITH t AS (SELECT {_STATUS} AS s, CAST(o_totalprice AS BIGINT) AS o FROM orders)
SELECT count(*) AS items, CAST(count_if(s = 'failed') AS BIGINT) AS failed, CAST(sum(o) FILTER (s = 'completed') AS BIGINT) AS original, CAST(sum(o // 3) FILTER (s = 'completed') AS BIGINT) AS output, round(1 - sum(o // 3) FILTER (s = 'completed') / sum(o) FILTER (s = 'completed'), 6) AS saved FROM t""")
def batch_summary(spark, d):
    return batch.summary(_jobs(spark, d))


@query("WITH st AS (SELECT row_number() OVER () - 1 AS k, * FROM (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for _, a, b in batch.STAGES) + f""") AS v(start, span)),
t AS (SELECT o_orderpriority, {_STATUS} AS s, start, span, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 10) / 10 END AS f FROM orders JOIN st ON k = o_orderkey % 8)
SELECT o_orderpriority, round(least(1, avg(CASE WHEN s IN ('completed', 'failed') THEN 1 ELSE start + span * coalesce(f, 0.3::DOUBLE) END)), 6) AS progress FROM t GROUP BY 1""")
def batch_progress(spark, d):
    return batch.progress(_jobs(spark, d), "o_orderpriority")


@query("""SELECT l_returnflag AS preset, l_linestatus AS format, count(*) AS n, CAST(sum(CAST(l_extendedprice AS BIGINT)) AS BIGINT) AS original, CAST(sum(CAST(l_extendedprice AS BIGINT) // 2) AS BIGINT) AS output,
round(avg(1 - (CAST(l_extendedprice AS BIGINT) // 2) / CAST(l_extendedprice AS BIGINT)), 6) AS reduction, min(1 - l_discount) AS min_ssim, round(avg(l_quantity), 4) AS mean_ms FROM lineitem GROUP BY ROLLUP (1, 2)""")
def benchmark_summary(spark, d):
    n = F.bround("l_extendedprice").cast("long")
    rows = _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("preset"), F.col("l_linestatus").alias("format"), n.alias("original"), F.floor(n / 2).cast("long").alias("output"), (1 - F.col("l_discount")).alias("ssim"), F.col("l_quantity").alias("ms"))
    return batch.by_setting(rows)


def _events(spark, d):
    return _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM o)
SELECT user_id, count(*) AS n, max(ts) AS last_ts, CAST(arg_max(event_id, (ts, event_id)) AS BIGINT) AS event_id FROM s GROUP BY user_id, burst""")
def debounce(spark, d):
    return ev.debounce(_events(spark, d), "30 minutes").select("user_id", "n", F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "event_id")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_wins(spark, d):
    return ev.latest(_events(spark, d), "user_id")


@query("SELECT event_id, user_id FROM events QUALIFY date_trunc('day', ts) = max(date_trunc('day', ts)) OVER (PARTITION BY user_id)")
def stale_drop(spark, d):
    return ev.drop_stale(_events(spark, d).withColumn("generation", F.date_trunc("day", "ts")), "user_id", "generation").select("event_id", "user_id")


@query("""WITH q AS (SELECT event_id, ts FROM events WHERE event_id % 2 = 0), a AS (SELECT event_id - 1 AS event_id, ts FROM events WHERE event_id % 2 = 1)
SELECT q.event_id AS request_id, q.ts AS asked, a.ts AS answered FROM q LEFT JOIN a ON q.event_id = a.event_id AND a.ts >= q.ts AND a.ts <= q.ts + INTERVAL 60 SECOND""")
def request_timeout(spark, d):
    e = _events(spark, d)
    requests = e.filter("event_id % 2 = 0").select(F.col("event_id").alias("request_id"), "ts")
    responses = e.filter("event_id % 2 = 1").select((F.col("event_id") - 1).alias("request_id"), "ts")
    return ev.answered(requests, responses, "60 seconds").select("request_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("asked", "answered")))


@query(PX + """, o AS (SELECT *, w + 3 AS w2, greatest(1, h // 2) AS h2 FROM (SELECT DISTINCT image_id, w, h FROM px)),
g AS (SELECT *, least(w - 1::DOUBLE, greatest(0, (x + 0.5::DOUBLE) * (w / w2) - 0.5::DOUBLE)) AS px_, least(h - 1::DOUBLE, greatest(0, (y + 0.5::DOUBLE) * (h / h2) - 0.5::DOUBLE)) AS py_
  FROM (SELECT image_id, w, h, w2, h2, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM o, unnest(generate_series(0, w2 - 1)) AS tx(x), unnest(generate_series(0, h2 - 1)) AS ty(y))),
n AS (SELECT *, CAST(floor(px_) AS INTEGER) AS x0, CAST(floor(py_) AS INTEGER) AS y0, CAST(px_ - floor(px_) AS FLOAT)::DOUBLE AS tx, CAST(py_ - floor(py_) AS FLOAT)::DOUBLE AS ty FROM g),
q AS (SELECT n.image_id, n.x, n.y, CAST(a.r + (b.r - a.r) * tx + (c.r + (d.r - c.r) * tx - (a.r + (b.r - a.r) * tx)) * ty AS FLOAT) AS v FROM n
  JOIN px a ON a.image_id = n.image_id AND a.x = x0 AND a.y = y0 JOIN px b ON b.image_id = n.image_id AND b.x = least(n.w - 1, x0 + 1) AND b.y = y0
  JOIN px c ON c.image_id = n.image_id AND c.x = x0 AND c.y = least(n.h - 1, y0 + 1) JOIN px d ON d.image_id = n.image_id AND d.x = least(n.w - 1, x0 + 1) AND d.y = least(n.h - 1, y0 + 1)) """
       + "SELECT image_id, count(*) AS n, round(sum(v::DOUBLE * (1 + x + 2 * y)), 2) AS sum_v FROM q GROUP BY image_id")
def bilinear_resize(spark, d):
    out = planes.bilinear_resize(_px(spark, d).withColumn("v", F.col("r").cast("double")), F.col("w") + 3, F.greatest(F.lit(1), F.floor(F.col("h") / 2).cast("int")))
    return out.groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v").cast("double") * (1 + F.col("x") + 2 * F.col("y"))), 2).alias("sum_v"))


@query(SIZE + """, t AS (SELECT *, p_partkey % 7 AS pad, greatest(1, w // 3) AS ow, greatest(1, h // 2) AS oh FROM s)
SELECT p_partkey, round(5 - pad * w / ow, 6) AS x, round(3 - pad * h / oh, 6) AS y, round(w + 2 * pad * w / ow, 6) AS width, round(h + 2 * pad * h / oh, 6) AS height FROM t""")
def placement(spark, d):
    w, h = F.col("w"), F.col("h")
    out = geometry.placement(F.lit(5), F.lit(3), w, h, F.greatest(F.lit(1), F.floor(w / 3)), F.greatest(F.lit(1), F.floor(h / 2)), F.col("p_partkey") % 7)
    return _sizes(spark, d).select("p_partkey", out.alias("o")).select("p_partkey", *(F.round(f"o.{c}", 6).alias(c) for c in ("x", "y", "width", "height")))


@query(SIZE + " SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR h = 0 OR w = 0 THEN TRUE ELSE abs(w / h - (w // 2 + 1) / (h // 2 + 1)) / (w / h) > 0.005 END AS differs FROM s")
def aspect_differs(spark, d):
    w, h = F.col("w"), F.col("h")
    known = F.when(F.col("p_partkey") % 5 > 0, w)
    return _sizes(spark, d).select("p_partkey", geometry.aspect_differs(known, h, F.floor(w / 2) + 1, F.floor(h / 2) + 1).alias("differs"))


@query("""WITH p AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{r[0]}', {r[1]}::DOUBLE, {r[2]}::DOUBLE)" for i, r in enumerate(compression.TARGETS)) + """) AS v(k, preset, s, b)),
t AS (SELECT preset, 0.9::DOUBLE + l_discount + l_tax / 100 AS ssim, 0.8::DOUBLE + l_discount * 2 AS worst, s, b FROM lineitem JOIN p ON k = l_partkey % 4)
SELECT preset, CAST(count_if(ssim >= s AND worst >= b) AS BIGINT) AS met, CAST(count_if(ssim >= s - 0.003::DOUBLE AND worst >= b - 0.015::DOUBLE) AS BIGINT) AS near, count(*) AS n FROM t GROUP BY preset""")
def meets_target(spark, d):
    names = F.array(*(F.lit(r[0]) for r in compression.TARGETS))
    rows = _t(spark, d, "lineitem").select(F.element_at(names, (F.col("l_partkey") % 4 + 1).cast("int")).alias("preset"), (0.9 + F.col("l_discount") + F.col("l_tax") / 100).alias("ssim"), (0.8 + F.col("l_discount") * 2).alias("worst"))
    args = [F.col(c) for c in ("ssim", "worst", "min_ssim", "min_worst")]
    return rows.join(F.broadcast(compression.quality_targets(spark)), "preset").groupBy("preset").agg(
        F.count_if(compression.meets_target(*args)).alias("met"), F.count_if(compression.near_miss(*args)).alias("near"), F.count("*").alias("n"))


@query(f"""WITH t AS (SELECT p_partkey, {_KIND} AS f, CASE WHEN p_partkey % 6 = 0 THEN 'unknown' ELSE {_KIND} END AS found, p_size, p_partkey % 4 > 0 AS alpha FROM part)
SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'the encoded file is empty' WHEN found <> f THEN 'asked for ' || f || ', but the file is ' || found
 WHEN p_partkey % 10 = 1 THEN 'the file has ' || (p_size + 1) || '×' || p_size || ' pixels, not ' || p_size || '×' || p_size WHEN f <> 'jpeg' AND NOT alpha THEN 'the file has lost its transparency' END AS error FROM t""")
def validation_error(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    error = compression.validation_error(s % 9, F.when(k % 6 == 0, "unknown").otherwise(_kind()), _kind(), F.when(k % 10 == 1, s + 1).otherwise(s), s, s, s, k % 4 > 0, F.lit(True))
    return _t(spark, d, "part").select("p_partkey", error.alias("error"))


@query("SELECT p_partkey, p_partkey * 65537 % 4294967296 AS big, (p_partkey * 65537 % 4294967296 // 65536) AS head, CAST(length(p_name) >= 4 AS BOOLEAN) AS more, p_name AS text FROM part")
def read_u32(spark, d):
    n = F.col("p_partkey") * 65537 % 4294967296
    content = F.concat(F.unhex(F.lpad(F.hex(n), 8, "0")), F.encode("p_name", "UTF-8"))
    rows = _t(spark, d, "part").select("p_partkey", "p_name", content.alias("c"))
    return rows.select("p_partkey", binary.read_uint(F.col("c"), 0).alias("big"), binary.read_uint(F.col("c"), 0, 2).alias("head"), binary.read_uint(F.col("c"), 4).isNotNull().alias("more"), F.decode(F.substring("c", 5, 1000), "ISO-8859-1").alias("text"))


@query("SELECT page_id, base64(encode(html)) AS coded, octet_length(encode(html)) AS n_bytes FROM pages")
def base64_roundtrip(spark, d):
    rows = _t(spark, d, "pages").select("page_id", F.regexp_replace(F.base64(F.encode("html", "UTF-8")), r"\s", "").alias("coded"))
    return rows.select("page_id", "coded", F.length(F.unbase64("coded")).cast("long").alias("n_bytes"))


@query("SELECT p_partkey, 'IHDR,tEXt,IDAT,IEND' AS kinds, CAST(8 + 25 + 12 + length(p_type) + 12 AS BIGINT) AS n_bytes, p_type AS data FROM part")
def png_chunks(spark, d):
    header = F.unhex(F.lit("00000001000000010806000000"))
    utf8 = lambda c: F.encode(c, "UTF-8")
    content = F.concat(F.lit(binary.SIGNATURE), binary.png_chunk("IHDR", header), binary.png_chunk("tEXt", utf8("p_name")), binary.png_chunk("IDAT", utf8("p_type")), binary.png_chunk("IEND", F.lit(b"")))
    out = binary.strip_png(_t(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), content.alias("content")))
    length = F.length("content")
    return out.select(F.col("id").alias("p_partkey"), F.array_join("kinds", ",").alias("kinds"), length.cast("long").alias("n_bytes"), F.decode(F.substring(F.col("content"), F.lit(42), length - 57), "UTF-8").alias("data"))


@query("""WITH r AS (SELECT o_orderkey AS root, CASE o_orderkey % 5 WHEN 0 THEN 'SLICE' WHEN 1 THEN 'CONNECTOR' WHEN 2 THEN 'TEXT' WHEN 3 THEN 'LINE' ELSE 'FRAME' END AS kind, o_orderkey % 3 = 0 AS ch, CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority END AS problem FROM orders)
SELECT root, kind, CASE WHEN problem IS NOT NULL THEN problem WHEN ch THEN 'no layer inside has an image' WHEN kind = 'SLICE' THEN 'a slice holds no image' WHEN kind = 'CONNECTOR' THEN 'a connector holds no image'
 WHEN kind = 'LINE' THEN 'a line holds no image' WHEN kind = 'TEXT' THEN 'text that no image fills' ELSE 'no image fills it' END AS reason FROM r WHERE root NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)""")
def unsupported_roots(spark, d):
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("SLICE", "CONNECTOR", "TEXT", "LINE", "FRAME"))), (k % 5 + 1).cast("int"))
    roots = _t(spark, d, "orders").select(k.alias("root"), kind.alias("kind"), (k % 3 == 0).alias("has_children"), F.when(k % 7 == 0, F.col("o_orderpriority")).alias("problem"))
    return selection.unsupported(roots, _t(spark, d, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("root")))


@query(SIZE + """, i AS (SELECT s.*, p_name, CASE WHEN s.p_partkey % 2 = 0 THEN 'png' ELSE 'webp' END AS f FROM s JOIN part USING (p_partkey))
SELECT p_partkey AS image_id, p_name || ' — ' || upper(f) || ' ' || w || '×' || h AS layer, CAST(CASE WHEN p_partkey % 3 = 0 THEN 100 - w / 2 ELSE p_partkey * 2 + w + 40 END AS DOUBLE) AS x, CAST(CASE WHEN p_partkey % 3 = 0 THEN 50 - h / 2 ELSE p_partkey * 3 END AS DOUBLE) AS y FROM i""")
def apply_insert(spark, d):
    k = F.col("p_partkey")
    rows = _sizes(spark, d).join(_t(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    items = rows.select(k.alias("image_id"), F.col("p_name").alias("name"), F.when(k % 2 == 0, "png").otherwise("webp").alias("format"), F.col("w").alias("width"), F.col("h").alias("height"), k.alias("node"))
    boxes = _sizes(spark, d).filter(k % 3 > 0).select(k.alias("node"), (k * 2).alias("bx"), (k * 3).alias("by"), F.col("w").alias("bw"))
    return selection.inserted(items, boxes, 100, 50)


@query("""SELECT p_partkey, '{"originalImageHash":"' || p_brand || '","processedImageHash":"' || p_type || '","processedAt":' || p_partkey * 1000 || '}' AS provenance FROM part""")
def provenance_json(spark, d):
    return _t(spark, d, "part").select("p_partkey", selection.provenance(F.col("p_brand"), F.col("p_type"), F.col("p_partkey") * 1000).alias("provenance"))


@query(FILL + ", g AS (SELECT hash, count(*) AS t, bool_or(l_discount > 0.05) AS c FROM f GROUP BY hash) SELECT count(*) AS images, CAST(sum(t) AS BIGINT) AS targets, CAST(count_if(c) AS BIGINT) AS cropped FROM g")
def selection_counters(spark, d):
    return selection.counters(_fills(spark, d).groupBy("hash").agg(F.count("*").alias("targets"), F.bool_or(F.col("l_discount") > 0.05).alias("cropped")))


@query(f"SELECT {_STATUS} AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, d):
    return batch.status_counts(_jobs(spark, d))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'rmbg-1.4' WHEN 1 THEN 'rmbg-1.4-full' WHEN 2 THEN 'birefnet-lite' ELSE 'other' END AS m, p_size % 2 = 0 AS off, p_size % 3 = 0 AS base_off FROM part)
SELECT p_partkey, m AS model, CASE WHEN m = 'other' THEN NULL WHEN m = 'birefnet-lite' AND off THEN 'rmbg-1.4' ELSE m END AS resolved FROM t""")
def model_fallback_chain(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    model = F.element_at(F.array(*(F.lit(x) for x in ("rmbg-1.4", "rmbg-1.4-full", "birefnet-lite", "other"))), (k % 4 + 1).cast("int"))
    unusable = F.concat(F.when(s % 2 == 0, F.array(F.lit("birefnet-lite"))).otherwise(F.array().cast("array<string>")), F.when(s % 3 == 0, F.array(F.lit("rmbg-1.4"))).otherwise(F.array().cast("array<string>")))
    return _t(spark, d, "part").select("p_partkey", model.alias("model"), models.resolve(model, unusable).alias("resolved"))


@query("""SELECT c_custkey, list_aggregate(list(model ORDER BY model), 'string_agg', ',') AS models, count(*) AS n FROM customer,
 (VALUES ('rmbg-1.4', false), ('rmbg-1.4-full', false), ('birefnet-lite', true)) AS t(model, needs_gpu) WHERE c_nationkey % 3 = 0 OR NOT needs_gpu GROUP BY 1""")
def usable_models(spark, d):
    """The models that each device can run; customers stand for devices, every third nation's have a GPU."""
    devices = _t(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 3 == 0).alias("gpu"))
    return models.usable(models.offered(devices), F.col("gpu")).groupBy("c_custkey").agg(F.array_join(F.array_sort(F.collect_list("model")), ",").alias("models"), F.count("*").alias("n"))


@query("""SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size * 10 ELSE 1024 END AS INTEGER) AS max_width, 1024 AS max_height, CASE WHEN p_partkey % 3 = 1 THEN 'small' ELSE 'high' END AS preset,
 CAST(CASE WHEN p_partkey % 3 = 1 THEN p_size ELSE 80 END AS INTEGER) AS quality, FALSE AS lossless, 'rmbg-1.4' AS model, 8 AS padding FROM part""")
def settings_merge(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    stored = F.when(k % 3 == 0, F.concat(F.lit('{"resize":{"maxWidth":'), s * 10, F.lit("}}"))).when(k % 3 == 1, F.concat(F.lit('{"compression":{"preset":"small","custom":{"quality":'), s, F.lit("}}}")))
    return _t(spark, d, "part").select("p_partkey", settings.merge(stored).alias("s")).select(
        "p_partkey", F.col("s.resize.maxWidth").alias("max_width"), F.col("s.resize.maxHeight").alias("max_height"), "s.compression.preset", "s.compression.custom.quality", "s.compression.custom.lossless", "s.backgroundRemoval.model", "s.crop.padding")


@query("""WITH c AS (SELECT *, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'processing' END AS status, CASE WHEN event_id % 3 > 0 THEN event_type END AS stage FROM events),
b AS (SELECT user_id, arg_max(status, (ts, event_id)) AS status, arg_max(stage, (ts, event_id)) FILTER (stage IS NOT NULL) AS stage,
  max((ts, event_id)) FILTER (status = 'processing') AS b, max((ts, event_id)) FILTER (status <> 'processing') AS e, max(ts) FILTER (status = 'processing') AS started_at, max(ts) FILTER (status <> 'processing') AS ended FROM c GROUP BY user_id)
SELECT user_id, status, stage, started_at, CASE WHEN b IS NULL OR e > b THEN ended END AS finished_at FROM b""")
def job_state(spark, d):
    kind, e = F.col("event_type"), _events(spark, d)
    changes = e.select("user_id", "ts", "event_id", F.when(kind == "error", "failed").when(kind == "purchase", "completed").otherwise("processing").alias("status"), F.when(F.col("event_id") % 3 > 0, kind).alias("stage"))
    return ev.job_state(changes, "user_id").select("user_id", "status", "stage", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "finished_at")))


@query(PX.replace("WITH", "WITH RECURSIVE", 1) + """, k AS (SELECT image_id, x, y, y * w + x AS p FROM px WHERE r > 127),
reach(image_id, p, x, y, l) AS (SELECT image_id, p, x, y, p FROM k UNION
  SELECT k.image_id, k.p, k.x, k.y, o.l FROM (SELECT r.*, x + dx AS nx, y + dy AS ny FROM reach r, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS d(dx, dy)) o JOIN k ON k.image_id = o.image_id AND k.x = nx AND k.y = ny AND k.p > o.l),
c AS (SELECT image_id, l, count(*) AS n FROM (SELECT image_id, p, min(l) AS l FROM reach GROUP BY ALL) GROUP BY ALL)
SELECT image_id, CAST(l AS BIGINT) AS label, n, n >= max(n) OVER (PARTITION BY image_id) * 0.1::DOUBLE AS kept FROM c""")
def component_sizes(spark, d):
    return components.sizes(_px(spark, d).withColumn("keep", F.col("r") > 127), 0.1)


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS node, CASE WHEN p_partkey >= 10 THEN p_partkey // 10 END AS parent, (p_partkey * 7) % 10 AS place FROM part),
t(node, root, depth, path) AS (SELECT node, node, 0, CAST(place AS VARCHAR) FROM n WHERE parent IS NULL UNION ALL SELECT n.node, t.root, t.depth + 1, t.path || '/' || n.place FROM t JOIN n ON n.parent = t.node)
SELECT node, root, CAST(depth AS INTEGER) AS depth, path FROM t""")
def scan_selection(spark, d):
    k = F.col("p_partkey")
    nodes = _t(spark, d, "part").select(k.alias("node"), F.when(k >= 10, F.floor(k / 10).cast("long")).alias("parent"), (k * 7 % 10).alias("place"))
    return selection.scan(nodes).select("node", "root", "depth", F.array_join("path", "/").alias("path"))
