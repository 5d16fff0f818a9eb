"""Registered queries of the closed-loop search, the delivery of images and the models that cut them out."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterspark.functions.lineage import bulky, dealt, owned
from rasterspark.operators import batch, snapshot
from rasterspark.plans import delivery, process, rounds, segmentation
from rasterspark.queries import SQL, _px, _t, query
from rasterspark.queries_plans import _CURVE, _attempt
from rasterspark.sources import pixels


def _halving(name: str, lo: int, tolerance: int, most: int) -> str:
    """The search of one lossy candidate from lo to 98 as common tables: {name} has its outcome, {name}n what it asks for."""
    return f"""
{name}s(image_id, n, lo, hi, best, best_bytes, stop) AS (SELECT img.image_id, 0, {lo}, 98, CAST(NULL AS INTEGER), CAST(NULL AS BIGINT), CAST(NULL AS INTEGER) FROM img UNION ALL
 SELECT s.image_id, s.n + 1, CASE WHEN ok THEN lo ELSE l + 1 END, CASE WHEN ok THEN l - 1 ELSE hi END, CASE WHEN ok AND (best IS NULL OR bytes < best_bytes) THEN l ELSE best END, CASE WHEN ok AND (best IS NULL OR bytes < best_bytes) THEN bytes ELSE best_bytes END,
  CASE WHEN stop IS NULL AND NOT ok AND bytes > limit_{name} THEN l ELSE stop END
 FROM {name}s s JOIN c ON c.image_id = s.image_id AND f = 0 AND l = CAST(floor((lo + hi) / 2 + 0.5) AS INTEGER) JOIN {name}l ON {name}l.image_id = s.image_id WHERE n < {most} AND hi - lo >= {tolerance}),
{name}e AS (SELECT image_id, max(n) AS n, arg_max(best, n) AS best, max(stop) AS stop FROM {name}s GROUP BY image_id),
{name}t AS (SELECT e.*, CASE WHEN best IS NOT NULL THEN best WHEN c.ok THEN 98 END AS p, c.bytes > limit_{name} AS top_big FROM {name}e e JOIN c ON c.image_id = e.image_id AND f = 0 AND l = 98 JOIN {name}l ON {name}l.image_id = e.image_id),
{name}g AS (SELECT t.*, CASE WHEN f1.ok OR p = 98 THEN p ELSE least(98, p + {tolerance + 1}) END AS q FROM {name}t t LEFT JOIN c f1 ON f1.image_id = t.image_id AND f1.f = 1 AND f1.l = p),
{name}n AS (SELECT image_id, n + CASE WHEN best IS NULL THEN 1 ELSE 0 END + 1 + CASE WHEN q <> p THEN 1 ELSE 0 END AS asked FROM {name}g),
{name}r AS (SELECT g.image_id, CASE WHEN stop IS NOT NULL THEN stop WHEN p IS NULL THEN 98 WHEN z.ok AND z.bytes <= y.bytes THEN q ELSE p END AS level,
 CASE WHEN stop IS NOT NULL THEN 0 WHEN p IS NULL THEN CAST(NOT top_big AS INTEGER) ELSE CAST(z.ok AND z.bytes <= y.bytes AS INTEGER) END AS f, stop IS NOT NULL OR (p IS NULL AND top_big) AS pruned, p IS NULL AS top
 FROM {name}g g LEFT JOIN c y ON y.image_id = g.image_id AND y.f = 0 AND y.l = p LEFT JOIN c z ON z.image_id = g.image_id AND z.f = 1 AND z.l = q),
{name} AS (SELECT r.image_id, level, bytes, ssim, NOT pruned AND CASE WHEN top AND r.f = 1 THEN ssim >= need - 0.003 ELSE ok END AS passed, pruned FROM {name}r r JOIN c ON c.image_id = r.image_id AND c.l = level AND c.f = r.f)"""


_SEARCH = ("WITH RECURSIVE " + _CURVE + """,
p1l AS (SELECT image_id, 1e300::DOUBLE AS limit_p1 FROM img),""" + _halving("p1", 70, 2, 7) + """,
p2l AS (SELECT image_id, bytes * 1.12::DOUBLE AS limit_p2 FROM p1),""" + _halving("p2", 60, 3, 5) + """,
x AS (SELECT image_id, NOT b.pruned AND CASE WHEN b.passed <> a.passed THEN b.passed WHEN NOT b.passed THEN b.ssim > a.ssim ELSE b.bytes < a.bytes END AS other, a, b FROM p1 a JOIN p2 b USING (image_id)),
y AS (SELECT image_id, CASE WHEN other THEN 'avif' ELSE 'webp' END AS candidate, CASE WHEN other THEN b.level ELSE a.level END AS level, CASE WHEN other THEN b.bytes ELSE a.bytes END AS bytes, CASE WHEN other THEN b.passed ELSE a.passed END AS passed FROM x)
""")


@query(_SEARCH + """SELECT y.image_id, CASE WHEN passed THEN candidate ELSE 'png-lossless' END AS candidate, CASE WHEN passed THEN level ELSE 100 END AS level, CASE WHEN passed THEN bytes ELSE 9000 END AS bytes, TRUE AS passed,
 CAST(n1.asked + n2.asked + CASE WHEN passed THEN 0 ELSE 1 END AS BIGINT) AS measured, CAST(greatest(n1.asked, n2.asked) AS INTEGER) AS most_measured
FROM y JOIN p1n n1 USING (image_id) JOIN p2n n2 USING (image_id)""")
def search_rounds(spark, d):
    """The search that measures only what it asks for: two lossy candidates and a lossless fallback, the curve being the encoder."""
    one = lambda name, kind, lo, tol, most: F.struct(F.lit(name).alias("candidate"), F.lit(kind).alias("kind"), F.lit(lo).alias("lo"), F.lit(98).alias("hi"), F.lit(tol).alias("tolerance"), F.lit(most).alias("most"))
    parts = _t(spark, d, "part").select(F.col("p_partkey").alias("image_id"), "p_size")
    images = parts.select(
        "image_id", F.lit(None).cast("double").alias("custom"), F.lit(0.985).alias("min_ssim"), F.lit(0.0).alias("min_worst"), F.array(F.lit(256)).alias("steps"),
        F.array(one("webp", "lossy", 70, 2, 7), one("avif", "lossy", 60, 3, 5)).alias("primary"), F.array(one("png-lossless", "lossless", 0, 0, 0)).alias("fallback"))

    def measure(requests):
        lossy = F.when(F.col("level").between(58, 98), _attempt(F.col("image_id"), F.col("p_size"), F.col("level"), F.col("final").cast("int")))
        a = F.when(F.col("candidate") == "png-lossless", F.struct(F.lit(9000).cast("long").alias("bytes"), F.lit(1.0).alias("ssim"), F.lit(1.0).alias("worst"))).otherwise(lossy)
        return bulky(requests).join(parts, "image_id").select("image_id", "candidate", "level", "final", a.alias("a")).select("image_id", "candidate", "level", "final", "a.*")

    return rounds.compress(images, measure).select("image_id", "best.candidate", "best.level", "best.bytes", "best.passed", "measured", "most_measured")


SQL["compress_search"] = _SEARCH + """SELECT image_id, CASE WHEN passed THEN candidate ELSE 'png-lossless' END AS candidate, CASE WHEN passed THEN level ELSE 100 END AS level,
 CASE WHEN passed THEN bytes ELSE 9000 END AS bytes, TRUE AS passed, CASE WHEN passed THEN 2 ELSE 3 END AS tried, CAST(NULL AS VARCHAR) AS warning FROM y"""


def posterised(px, requests):
    """An encoder in column expressions: fewer steps a channel at lower levels; its size follows the runs that are left."""
    step = F.when(F.col("candidate").endswith("-lossless"), 1).otherwise(F.greatest(F.lit(1), F.floor((102 - F.col("level")) / 4))).cast("int")
    made = px.join(owned(requests), "image_id").withColumn("_s", F.when(F.col("candidate").isin(*delivery.PALETTES), F.greatest(F.lit(1), F.floor(F.lit(256) / F.col("level")))).otherwise(step).cast("int"))
    return made.select(*requests.columns, "w", "h", "x", "y", *"rgb", "a", *(F.least(F.lit(255), F.floor(F.col(c) / F.col("_s")) * F.col("_s") + F.floor(F.col("_s") / 2)).cast("int").alias(f"{c}2") for c in "rgb"), F.col("a").alias("a2"))


def _measured(px, broken):
    """What measures by `posterised`: similarity from the mean squared error, size from the distinct colours."""
    def measure(requests):
        rows = posterised(px, requests).groupBy("image_id", "candidate", "level", "final").agg(
            F.count_distinct("r2", "g2", "b2", "a2").alias("n"), F.avg(sum((F.col(c) - F.col(f"{c}2")) ** 2 for c in "rgb") / 3).alias("mse"), F.max(F.abs(F.col("r") - F.col("r2"))).alias("most"))
        told = rows.select("image_id", "candidate", "level", "final", (60 + F.col("n") * 4 - F.col("final").cast("int") * 2).cast("long").alias("bytes"), (1 - F.col("mse") / 2000).alias("ssim"), (1 - F.col("most") / 500).alias("worst"))
        return told.withColumn("error", F.when(broken, F.lit("the encoder stopped")))

    return measure


def delivered_images(spark, d, side: int = 8, planted: bool = True):
    """Whole way of every image of part. Planted: encoders that stop (every 13th image), wrong files (17th), unreadable ones (19th)."""
    options = process.Options(remove_background=False, padding=1, max_width=9, max_height=9, format="auto", avif_in_auto=True)
    px, k = _px(spark, d, side), F.col("image_id")
    part = _t(spark, d, "part").select(F.col("p_partkey").cast("long").alias("image_id"), F.col("p_size"))
    sources = part.select("image_id", F.when(k % 3 == 0, "png").otherwise("webp").alias("source_format"), (F.col("p_size") * 12 + 40).cast("long").alias("original_bytes"), (F.col("p_size") * 12 + 30).cast("long").alias("stripped_bytes"))
    kept = {}

    def encoders(final):
        kept["px"] = final
        return _measured(final, F.lit(planted) & (k % 13 == 0) & ~((F.col("candidate") == "png-lossless") & (k % 2 == 0)))

    def inspect(chosen):
        rows = posterised(kept["px"], chosen)
        decoded = rows.select("image_id", "w", "h", "x", "y", *(F.col(f"{c}2").alias(c) for c in "rgba"))
        info = rows.groupBy("image_id", "w", "h", "format").agg(F.max((F.col("a") < 255)).alias("alpha"))
        return info.select("image_id", F.lit(1).alias("size"), F.when(F.lit(planted) & (k % 17 == 0), "unknown").otherwise(F.col("format")).alias("found"), "w", "h", "alpha", F.when(F.lit(planted) & (k % 19 == 0), "cut short").alias("error")), decoded

    return delivery.deliver(px, sources, encoders, inspect, options)


@query()
def deliver_images(spark, d):
    """A test holds single images, planted failures and the whole against a plain walk over the same rules."""
    rows = delivered_images(spark, d)
    return rows.withColumn("warnings", F.array_join("warnings", "; ")).withColumns({c: F.round(c, 9) for c in ("ssim", "worst")})


_LABEL = "CASE {} " + " ".join(f"WHEN '{m.name}' THEN '{m.label}'" for m in segmentation.DEFAULT.models.values()) + " END"


def _mask_models(image):
    """Which model an image asks for."""
    return F.when(image % 4 == 0, "rmbg-1.4").when(image % 4 == 1, "rmbg-1.4-full").when(image % 4 == 2, "birefnet-lite").otherwise("other")


def masks_of_embeddings(spark, d, side: int = 8, failing: str = "rmbg-1.4-full"):
    """A runner whose masks come from embeddings: an image's pixel is in the foreground by its component's sign. One model is
    unavailable, and every seventh image fails in all.
    """
    vectors = dealt(_t(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("image_id"), "embedding"), "image_id")
    sizes = pixels.grid(vectors.select("image_id", F.lit(side).alias("w"), F.lit(side).alias("h"), "embedding"))

    def run(requests):
        gone, broken = F.col("model") == failing, F.col("image_id") % 7 == 0
        told = requests.select("image_id", F.when(gone, "out of memory").when(broken, "no object found").alias("error"), gone.alias("unavailable"))
        value = F.try_element_at("embedding", F.pmod(F.col("y") * F.col("w") + F.col("x"), F.size("embedding")) + 1).cast("double")
        made = sizes.join(owned(requests.filter(~gone & ~broken)), "image_id")
        return made.select("image_id", "w", "h", "x", "y", (1 / (1 + F.exp(-8 * F.coalesce(value, F.lit(0.0))))).alias("p")), told

    return run


@query(f"""WITH e AS (SELECT CAST(vec_id AS BIGINT) AS image_id, CASE vec_id % 4 WHEN 0 THEN 'rmbg-1.4' WHEN 1 THEN 'rmbg-1.4-full' WHEN 2 THEN 'birefnet-lite' ELSE 'other' END AS requested FROM embeddings),
f AS (SELECT min(image_id) AS first FROM e WHERE requested = 'rmbg-1.4-full'),
r AS (SELECT image_id, requested, CASE WHEN requested = 'other' THEN 'unknown model: other' WHEN image_id % 7 = 0 THEN 'no object found' END AS error,
 CASE WHEN requested = 'other' THEN 0 ELSE 1 END + CASE WHEN requested = 'rmbg-1.4-full' AND image_id = first THEN 1 ELSE 0 END AS asked FROM e, f)
SELECT image_id, requested, CASE WHEN error IS NULL THEN 'rmbg-1.4' END AS model, CAST(asked AS INTEGER) AS asked, CAST(CASE WHEN error IS NULL THEN 64 ELSE 0 END AS BIGINT) AS pixels,
 CASE WHEN error IS NULL AND requested <> 'rmbg-1.4' THEN {_LABEL.format("'rmbg-1.4'")} || ' in place of ' || {_LABEL.format("requested")} || ': ' || CASE requested WHEN 'birefnet-lite' THEN 'it needs a GPU' ELSE 'out of memory' END END AS warning, error FROM r""")
def segment_images(spark, d):
    """Models with fallbacks, asked in rounds: one is unavailable, one needs a GPU, one is not registered."""
    wanted = _t(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("image_id")).withColumn("requested", _mask_models(F.col("image_id")))
    masks, told = segmentation.segment(wanted, masks_of_embeddings(spark, d))
    n = masks.groupBy("image_id").agg(F.count("*").alias("pixels"))
    return bulky(told).join(n, "image_id", "left").withColumn("pixels", F.coalesce("pixels", F.lit(0).cast("long")))


@query()
def cut_out_images(spark, d):
    """Images of part without their background, by masks that follow embeddings: cropped, padded and planned; every image a row."""
    px = _px(spark, d)
    n = _t(spark, d, "embeddings").count()
    run = masks_of_embeddings(spark, d)

    def segment(own):
        wanted = own.groupBy("image_id").agg(F.count("*").alias("_n")).select("image_id", _mask_models(F.col("image_id") % 3).alias("requested"))
        # an image's mask is that of the vector of its number
        vector = F.pmod(F.col("image_id"), F.lit(n))

        def by_vector(requests):
            numbered = requests.withColumn("_v", vector)
            masks, _ = run(numbered.select(F.col("_v").alias("image_id"), F.lit("rmbg-1.4").alias("model")).distinct())
            gone = F.col("model") == "rmbg-1.4-full"
            told = numbered.select("image_id", F.when(gone, "out of memory").when(F.col("_v") % 7 == 0, "no object found").alias("error"), gone.alias("unavailable"))
            return bulky(masks.withColumnRenamed("image_id", "_v")).join(numbered.filter(~gone & (F.col("_v") % 7 != 0)).select("image_id", "_v"), "_v").drop("_v"), told

        return segmentation.segment(wanted, by_vector)

    sources = px.select("image_id").distinct().withColumn("source_format", F.lit("png"))
    options = process.Options(padding=1, max_width=9, max_height=9, format="auto")
    _, rows = process.process(px, sources, options, segment=segment)
    return rows.select("image_id", "status", "error", "width", "height", "cropped", "background_removed", "resized", "format", F.array_join("warnings", "; ").alias("warnings"), F.to_json("region").alias("region"))


# one snapshot of a selection

_TREE = """f AS (SELECT *, l_orderkey * 64 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS node, l_partkey * 7 % 5 AS place FROM lineitem),
nodes AS (SELECT o_orderkey * 64 AS node, CAST(NULL AS BIGINT) AS parent, o_orderkey * 31 % 1009 AS place, FALSE AS mixed, o_orderkey % 5 AS k, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS ch FROM orders
 UNION ALL SELECT node, CASE WHEN node % 64 = 1 THEN node - 1 ELSE node // 64 * 64 + node % 64 // 2 END, place, l_discount = 0.1, 9, FALSE FROM f),
t(node, root, path) AS (SELECT node, node, [[place, node]] FROM nodes WHERE parent IS NULL UNION ALL SELECT n.node, t.root, list_append(t.path, [n.place, n.node]) FROM t JOIN nodes n ON n.parent = t.node),
w AS (SELECT node, root, nth FROM (SELECT node, root, row_number() OVER (ORDER BY path) - 1 AS nth FROM t) WHERE nth < 5000),
fills AS (SELECT node, CASE WHEN l_quantity > 40 THEN 'IMAGE' WHEN l_quantity < 5 THEN 'VIDEO' ELSE 'SOLID' END AS type, CASE WHEN l_tax <> 0.08 THEN l_partkey END AS hash FROM f),
s AS (SELECT w.*, mixed, type, hash FROM w JOIN nodes USING (node) LEFT JOIN fills USING (node)),
img AS (SELECT * FROM s WHERE NOT mixed AND type = 'IMAGE' AND hash IS NOT NULL),
pr AS (SELECT root, arg_min(CASE WHEN mixed THEN 'mixed fills' WHEN type = 'VIDEO' THEN 'a video fill' ELSE 'an image without data' END, nth) AS problem FROM s WHERE mixed OR type = 'VIDEO' OR (type = 'IMAGE' AND hash IS NULL) GROUP BY root),
un AS (SELECT node AS root, CASE WHEN problem IS NOT NULL THEN problem WHEN ch THEN 'no layer inside has an image' WHEN k = 0 THEN 'a slice holds no image' WHEN k = 1 THEN 'text that no image fills' ELSE 'no image fills it' END AS reason
 FROM nodes LEFT JOIN pr ON pr.root = nodes.node WHERE parent IS NULL AND node NOT IN (SELECT root FROM img))"""


def _snapshot(spark, d):
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    f = _t(spark, d, "lineitem").withColumn("i", F.row_number().over(line)).withColumn("node", F.col("l_orderkey") * 64 + F.col("i"))
    o, q = F.col("o_orderkey"), F.col("l_quantity")
    held = f.select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("has_children", F.lit(True))
    kind = F.when(o % 5 == 0, "SLICE").when(o % 5 == 1, "TEXT").otherwise("FRAME")
    roots = _t(spark, d, "orders").join(held, "o_orderkey", "left").select((o * 64).alias("node"), F.lit(None).cast("long").alias("parent"), (o * 31 % 1009).alias("place"), kind.alias("kind"), F.lit(False).alias("mixed"), F.coalesce("has_children", F.lit(False)).alias("has_children"))
    parent = F.when(F.col("i") == 1, F.col("node") - 1).otherwise(F.col("l_orderkey") * 64 + F.floor(F.col("i") / 2).cast("int"))
    lines = f.select("node", parent.cast("long").alias("parent"), (F.col("l_partkey") * 7 % 5).alias("place"), F.lit("RECT").alias("kind"), (F.col("l_discount") == 0.1).alias("mixed"), F.lit(False).alias("has_children"))
    nodes = roots.unionByName(lines).withColumns({"name": F.col("kind"), "width": F.lit(400), "height": F.lit(200)})
    fills = f.select("node", F.lit(0).alias("idx"), F.when(q > 40, "IMAGE").when(q < 5, "VIDEO").otherwise("SOLID").alias("type"), F.when(F.col("l_tax") != 0.08, F.col("l_partkey")).alias("hash"), F.lit(0).alias("rotation"))
    sizes = _t(spark, d, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("hash"), (F.col("p_size") * 10).alias("width"), (F.col("p_size") * 10).alias("height"))
    return snapshot.snapshot(nodes, fills, sizes)


@query("WITH RECURSIVE " + _TREE + """ SELECT CAST((SELECT count(*) FROM w) AS BIGINT) AS scanned, (SELECT count(*) FROM t) > 5000 AS truncated, count(DISTINCT (hash, p_size <= 40)) AS images, count(*) AS targets,
 count(DISTINCT hash) FILTER (p_size <= 40) AS cropped, (SELECT count(*) FROM un) AS unsupported FROM img LEFT JOIN part ON p_partkey = hash""")
def snapshot_totals(spark, d):
    """A layer of 2 to 1 over square images: those of known size are cropped."""
    return _snapshot(spark, d)[2]


@query("WITH RECURSIVE " + _TREE + " SELECT root, reason FROM un")
def snapshot_unsupported(spark, d):
    return _snapshot(spark, d)[1].select("root", "reason")


@query("WITH RECURSIVE " + _TREE + """ SELECT hash, count(*) AS targets, arg_min(node, nth) AS first_node FROM img GROUP BY hash""")
def snapshot_images(spark, d):
    return _snapshot(spark, d)[0].select("hash", F.size("targets").cast("long").alias("targets"), F.get("targets", F.lit(0)).alias("first_node"))


@query("""WITH i AS (SELECT p_partkey AS image_id, p_brand AS name, p_partkey % 4 <> 3 AS al FROM part)
SELECT image_id, name, format, preset FROM i, unnest(['png', 'jpeg', 'webp', 'avif']) AS f(format), unnest(['high', 'small']) AS p(preset) WHERE NOT (format = 'jpeg' AND al) AND name IN ('Brand#11', 'Brand#23', 'Brand#45')""")
def benchmark_grid(spark, d):
    """What a benchmark measures: chosen images by format and preset, JPEG only where nothing is transparent."""
    images = _t(spark, d, "part").select(F.col("p_partkey").alias("image_id"), F.col("p_brand").alias("name"), (F.col("p_partkey") % 4 != 3).alias("has_alpha"))
    return batch.benchmark_grid(images, ["png", "jpeg", "webp", "avif"], ["high", "small"], only=["Brand#11", "Brand#23", "Brand#45"])
