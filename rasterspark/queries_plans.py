"""Registered queries of labels, rules, batches, selections and the compression search, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterspark.functions import labels, metadata, text
from rasterspark.operators import analysis, batch, geometry, matte, metrics, planes, quantize, resample, selection
from rasterspark.operators.palette import WEIGHTS, coordinates
from rasterspark.operators.planes import YCBCR
from rasterspark.plans import process, rules, search
from rasterspark.queries import _STATUS, FILL, PALETTE, PX, _fills, _jobs, _palette, _px, _px_sql, _sums, _sums_sql, _t, query
from rasterspark.sources import pixels, synthetic

_NAMES = "CASE p_partkey % 11 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(labels.CANDIDATES)) + " ELSE 'other' END"


def _pick(column, names):
    """The n-th of the names; null beyond."""
    return F.try_element_at(F.array(*map(F.lit, names)), (column + 1).cast("int"))


def _candidate():
    return F.coalesce(_pick(F.col("p_partkey") % 11, labels.CANDIDATES), F.lit("other"))


@query(f"""WITH t AS (SELECT p_partkey, {_NAMES} AS c, CASE p_partkey % 3 WHEN 0 THEN 'loading' WHEN 1 THEN 'removing-background' ELSE 'nothing' END AS s, CASE p_partkey % 2 WHEN 0 THEN 'maximum' ELSE 'custom' END AS p FROM part)
SELECT p_partkey, CASE c """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.CANDIDATES.items()) + """ END AS candidate,
CASE s WHEN 'loading' THEN 'Loading' WHEN 'removing-background' THEN 'Removing background' END AS stage, CASE p WHEN 'maximum' THEN 'Maximum' ELSE 'Custom' END AS preset FROM t""")
def label_names(spark, d):
    k = F.col("p_partkey")
    return _t(spark, d, "part").select(
        "p_partkey", labels.label(_candidate(), labels.CANDIDATES).alias("candidate"), labels.label(_pick(k % 3, ["loading", "removing-background", "nothing"]), labels.STAGES).alias("stage"),
        labels.label(_pick(k % 2, ["maximum", "custom"]), labels.PRESETS).alias("preset"))


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE CAST(p_size * 97 AS BIGINT) END AS o, CAST(p_partkey % 89 * 41 AS BIGINT) AS n FROM part)
SELECT p_partkey, CASE WHEN o <= 0 THEN '—' ELSE CASE WHEN n / o - 1 > 0 THEN '+' ELSE '' END || printf('%.1f', (n / o - 1) * 100) || '%' END AS change,
 CASE WHEN o <= 0 THEN '—' ELSE printf('%.1f', (1 - n / o) * 100) || '%' END AS saved, CASE WHEN o <> 0 AND n <> 0 THEN o || '×' || n ELSE '—' END AS dimensions,
 CASE WHEN o = 0 THEN '∞' ELSE printf('%.4f', n / o) END AS metric FROM t""")
def format_changes(spark, d):
    k = F.col("p_partkey")
    t = _t(spark, d, "part").select("p_partkey", F.when(k % 7 == 0, F.lit(0).cast("long")).otherwise((F.col("p_size") * 97).cast("long")).alias("o"), (k % 89 * 41).cast("long").alias("n"))
    o, n = F.col("o"), F.col("n")
    return t.select("p_partkey", labels.format_change(o, n).alias("change"), labels.format_saved(o, n).alias("saved"), labels.format_dimensions(o, n).alias("dimensions"),
                    labels.format_metric(F.when(o == 0, F.lit(float("inf"))).otherwise(n / o)).alias("metric"))


_SAFE = r"regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[^a-zA-Z0-9._ -]+', '-', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g')), '^$', 'image')"


@query("SELECT p_partkey, left(" + _SAFE.format("p_name") + ", 80) || CASE p_partkey % 2 WHEN 0 THEN '.jpg' ELSE '.webp' END AS name FROM part")
def asset_name(spark, d):
    return _t(spark, d, "part").select("p_partkey", labels.asset_name(F.col("p_name"), _pick(F.col("p_partkey") % 2, ["jpeg", "webp"])).alias("name"))


@query("SELECT doc_id, left(" + _SAFE.format("strip_accents(text)") + ", 80) AS name FROM documents")
def sanitize_accents(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.sanitize(F.col("text"), accents=True).alias("name"))


@query("SELECT event_id, regexp_matches(event_type || CASE event_id % 3 WHEN 0 THEN ': std::bad_alloc' WHEN 1 THEN ': OUT OF MEMORY' ELSE ': timeout' END, '(?i)bad_alloc|out of memory') AS memory FROM events")
def out_of_memory(spark, d):
    told = F.concat("event_type", _pick(F.col("event_id") % 3, [": std::bad_alloc", ": OUT OF MEMORY", ": timeout"]))
    return _t(spark, d, "events").select("event_id", labels.out_of_memory(told).alias("memory"))


@query("""WITH t AS (SELECT p_partkey, p_size / 50 AS border, p_partkey % 3 > 0 AS skip, p_partkey % 2 = 0 AS crop, p_size % 9 AS padding, p_partkey % 5 = 0 AS cropped, p_partkey % 7 = 0 AS removed FROM part)
SELECT p_partkey, skip AND border >= 0.6 AS skipped, crop AND padding > 0 AND (cropped OR removed) AS padded, border >= 0.03 AND border < 0.998 AS soft,
 CASE WHEN removed AND cropped THEN '4:0:0' WHEN crop THEN '4:2:0' ELSE '4:4:4' END AS subsample FROM t""")
def pipeline_rules(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    border, crop, cropped, removed = s / 50, k % 2 == 0, k % 5 == 0, k % 7 == 0
    return _t(spark, d, "part").select(
        "p_partkey", rules.cut_out_already(border, k % 3 > 0).alias("skipped"), rules.padding_applies(crop, s % 9, cropped, removed).alias("padded"), rules.soft_edge(border).alias("soft"),
        labels.avif_subsample(removed, F.when(crop, "photo").otherwise("flat-graphic"), cropped).alias("subsample"))


@query(f"""WITH t AS (SELECT p_partkey, {_NAMES} AS c, p_size * 2 AS q, p_partkey % 2 = 0 AS f, p_size / 10 AS mp, p_partkey % 3 = 0 AS al, p_partkey % 5 = 0 AS gray, CASE WHEN p_partkey % 4 = 0 THEN 'photo' ELSE 'flat-graphic' END AS content FROM part),
u AS (SELECT *, split_part(c, '-', 1) AS form, CASE WHEN c IN ('png-quant', 'webp-palette') THEN 'palette' WHEN ends_with(c, '-lossless') THEN 'lossless' ELSE 'lossy' END AS kind,
 CASE WHEN mp <= 0.3 THEN 6 WHEN mp <= 2 THEN 5 ELSE 4 END AS el, CASE WHEN mp <= 0.5 THEN 4 WHEN mp <= 2 THEN 3 WHEN mp <= 8 THEN 2 ELSE 1 END AS pl FROM t)
SELECT p_partkey, c AS candidate, form AS format, kind, CAST(CASE WHEN kind = 'lossy' THEN q WHEN c = 'avif-lossless' THEN 100 END AS INTEGER) AS quality,
 CAST(CASE WHEN c = 'webp' THEN CASE WHEN f AND mp <= 12 THEN 6 ELSE 4 END WHEN c = 'webp-lossless' THEN el WHEN c = 'webp-palette' THEN CASE WHEN NOT f THEN 2 WHEN mp <= 1 THEN 6 ELSE 5 END
  WHEN form = 'avif' THEN CASE WHEN NOT f THEN 8 WHEN mp <= 2 THEN 6 ELSE 7 END WHEN c = 'png-quant' THEN CASE WHEN f THEN pl ELSE 1 END WHEN c = 'png-lossless' THEN pl END AS INTEGER) AS effort,
 CASE WHEN c IN ('jpeg-420', 'jpeg-gray') THEN '4:2:0' WHEN c IN ('jpeg-444', 'avif-lossless') THEN '4:4:4' WHEN c = 'avif' THEN CASE WHEN gray AND NOT al THEN '4:0:0' WHEN content = 'photo' THEN '4:2:0' ELSE '4:4:4' END END AS subsample,
 CAST(CASE WHEN kind = 'palette' THEN q END AS INTEGER) AS colors, CAST(CASE WHEN c = 'webp' THEN CASE WHEN al THEN 90 ELSE 100 END WHEN c = 'avif' THEN least(100, q + 20) END AS INTEGER) AS alpha_quality FROM u""")
def encoder_parameters(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    p = labels.encoder_parameters(_candidate(), s * 2, k % 2 == 0, s / 10, F.when(k % 4 == 0, "photo").otherwise("flat-graphic"), k % 3 == 0, k % 5 == 0, F.lit(90))
    return _t(spark, d, "part").select("p_partkey", _candidate().alias("candidate"), p.alias("p")).select("p_partkey", "candidate", "p.*")


@query(f"""WITH c AS (SELECT p_partkey, {_NAMES} AS c, p_size * 2 AS q FROM part)
SELECT p_partkey, CASE c WHEN 'jpeg-420' THEN 'JPEG q' || q || ' progressive 4:2:0' WHEN 'jpeg-444' THEN 'JPEG q' || q || ' progressive 4:4:4' WHEN 'jpeg-gray' THEN 'JPEG q' || q || ' progressive grayscale'
 WHEN 'webp' THEN 'WebP q' || q || ' m6 alpha q100' WHEN 'webp-lossless' THEN 'WEBP lossless, effort 5' WHEN 'avif' THEN 'AVIF q' || q || ' 4:4:4 s6' WHEN 'avif-lossless' THEN 'AVIF lossless, effort 6'
 WHEN 'png-quant' THEN 'PNG palette, ' || q || ' colours, effort 3' WHEN 'webp-palette' THEN 'WEBP palette, ' || q || ' colours, effort 6' WHEN 'png-lossless' THEN 'PNG lossless, effort 3' END AS settings FROM c WHERE c <> 'other'""")
def describe_attempt(spark, d):
    p = labels.encoder_parameters(_candidate(), F.col("p_size") * 2, F.lit(True), F.lit(1.0), F.lit("flat-graphic"), F.lit(False), F.lit(False), F.lit(90))
    return _t(spark, d, "part").filter(_candidate() != "other").select("p_partkey", labels.describe(_candidate(), p).alias("settings"))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' ELSE 'avif' END AS f, CAST(p_size * 100 AS BIGINT) AS o, CAST(p_size * 90 AS BIGINT) AS s, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size * 60 + p_partkey AS BIGINT) END AS z FROM part)
SELECT p_partkey, CASE f WHEN 'png' THEN least(s, coalesce(z, s)) WHEN 'jpeg' THEN s ELSE o END AS bytes FROM t""")
def pass_through(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    return _t(spark, d, "part").select("p_partkey", rules.passed_through(_pick(k % 4, ["png", "jpeg", "webp", "avif"]), s * 100, s * 90, F.when(k % 3 > 0, s * 60 + k)).alias("bytes"))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'jpeg' ELSE 'webp' END AS f, p_size * 10 AS b, CASE WHEN p_partkey % 3 = 0 THEN 'bad size' END AS e, p_size * 30 AS p, p_partkey % 5 = 0 AS k, p_size * 9 AS o FROM part)
SELECT p_partkey AS image_id, CASE WHEN k THEN 'png' WHEN e IS NOT NULL THEN 'png' ELSE f END AS format, CASE WHEN k THEN o WHEN e IS NOT NULL THEN p ELSE b END AS bytes, k OR e IS NOT NULL AS exact,
 concat_ws(';', 'first', CASE WHEN e IS NOT NULL THEN e || '; lossless PNG instead' END, CASE WHEN k THEN 'original kept' END) AS warnings FROM t""")
def delivered(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = _t(spark, d, "part").select(
        k.alias("image_id"), (s * 10).alias("encoded_bytes"), _pick(k % 2, ["jpeg", "webp"]).alias("encoded_format"), F.when(k % 3 == 0, "bad size").alias("error"), (s * 30).alias("png_bytes"),
        (k % 5 == 0).alias("kept"), (s * 9).alias("original_bytes"), F.lit("png").alias("original_format"), F.array(F.lit("first")).alias("warnings"))
    return rules.delivered(rows).withColumn("warnings", F.concat_ws(";", "warnings"))


@query(f"""WITH j AS (SELECT o_orderkey AS image_id, {_STATUS} AS status FROM orders)
SELECT image_id, CASE WHEN status IN ('failed', 'cancelled') THEN 'pending' ELSE status END AS status, CASE WHEN status NOT IN ('failed', 'cancelled') THEN 'resizing' END AS stage, CASE WHEN status NOT IN ('failed', 'cancelled') THEN 'x' END AS error, status IN ('failed', 'cancelled') AS retried FROM j""")
def retry_failed(spark, d):
    return batch.retried(_jobs(spark, d).select(F.col("o_orderkey").alias("image_id"), "status", F.lit("resizing").alias("stage"), F.lit("x").alias("error")))


@query("""WITH b AS (SELECT event_id AS image_id, user_id AS pos, event_id % 3 > 0 AS ok, CASE WHEN event_id % 2 = 0 THEN 'late' END AS error, 0 AS part FROM events WHERE event_id % 4 < 3
UNION ALL SELECT event_id, user_id, FALSE, 'broken', 1 FROM events WHERE event_id % 5 < 2),
f AS (SELECT image_id, arg_min(ok, (part, pos)) AS ok, arg_min(coalesce(error, ''), (part, pos)) AS error FROM b GROUP BY image_id)
SELECT e.event_id AS image_id, 'replace' AS mode, CASE WHEN ok THEN 'replace' END AS applied, CASE WHEN ok THEN nullif(error, '') WHEN f.image_id IS NOT NULL THEN coalesce(nullif(error, ''), 'layer not updated') END AS apply_error
FROM events e LEFT JOIN f ON f.image_id = e.event_id""")
def apply_outcomes(spark, d):
    e, k = _t(spark, d, "events"), F.col("event_id")
    row = lambda ok, error: [k.alias("image_id"), F.col("user_id").alias("pos"), ok.alias("ok"), error.alias("error")]
    outcomes = e.filter(k % 4 < 3).select(*row(k % 3 > 0, F.when(k % 2 == 0, "late")))
    failures = e.filter(k % 5 < 2).select(*row(F.lit(False), F.lit("broken")))
    return batch.with_outcomes(e.select(k.alias("image_id"), F.lit("replace").alias("mode")), outcomes, failures)


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS active FROM events WHERE event_type = 'click' GROUP BY user_id")
def active_item(spark, d):
    items = _t(spark, d, "events").select("user_id", F.col("event_id").alias("image_id"), F.col("ts").alias("started_at"), F.when(F.col("event_type") == "click", "processing").otherwise("completed").alias("status"))
    return batch.active(items, "user_id")


@query("""WITH m AS (SELECT user_id, event_type AS stage, CAST(sum(event_id % 1000) AS BIGINT) AS ms FROM events GROUP BY ALL)
SELECT user_id AS image_id, string_agg(stage || '=' || ms, ',' ORDER BY stage) AS timings, CAST(sum(ms) AS BIGINT) AS total_ms FROM m GROUP BY user_id""")
def stage_timings(spark, d):
    ts = F.col("ts").cast("timestamp")
    marks = _t(spark, d, "events").select(F.col("user_id").alias("image_id"), F.col("event_type").alias("stage"), ts.alias("began"), F.timestamp_millis(F.unix_millis(ts) + F.col("event_id") % 1000).alias("ended"))
    told = F.transform(F.map_entries("timings"), lambda t: F.concat(t["key"], F.lit("="), t["value"].cast("string")))
    return batch.timings(marks).select("image_id", F.concat_ws(",", told).alias("timings"), "total_ms")


@query(FILL + ", c AS (SELECT hash, idx, min(bytes) AS b FROM f GROUP BY ALL) SELECT hash AS image_id, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY b, CAST(idx AS VARCHAR)) AS candidates FROM c GROUP BY hash")
def candidates_by_size(spark, d):
    results = _fills(spark, d).groupBy(F.col("hash").alias("image_id"), F.col("idx").cast("string").alias("candidate")).agg(F.min("bytes").alias("bytes"))
    return batch.by_size(results).withColumn("candidates", F.concat_ws(",", "candidates"))


@query("""WITH r AS (SELECT o_orderpriority AS preset, o_orderstatus AS f, count(*) AS n, CAST(sum(CAST(o_totalprice AS BIGINT)) AS BIGINT) AS o, CAST(sum(CAST(o_totalprice AS BIGINT) // 2 + o_orderkey % 100) AS BIGINT) AS p,
 round(avg(1 - (CAST(o_totalprice AS BIGINT) // 2 + o_orderkey % 100) / CAST(o_totalprice AS BIGINT)), 6) AS red, min(o_orderkey % 1000 / 1000) AS s FROM orders GROUP BY ALL)
SELECT preset, f AS format, '| ' || preset || ' | ' || f || ' | ' || n || ' | ' || o || ' | ' || p || ' | ' || printf('%.1f%%', red * 100) || ' | ' || printf('%.4f', s) || ' |' AS line FROM r""")
def benchmark_report(spark, d):
    k, size = F.col("o_orderkey"), F.bround("o_totalprice").cast("long")
    return batch.report(_t(spark, d, "orders").select(F.col("o_orderpriority").alias("preset"), F.col("o_orderstatus").alias("format"), size.alias("original"), (F.floor(size / 2) + k % 100).alias("output"), (k % 1000 / 1000).alias("ssim"), F.lit(1).alias("ms")))


_CROP = """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 100 / (p_size + 20) ELSE p_size / 60 END AS a, CASE WHEN p_partkey % 4 = 0 THEN 90 / (p_size + 20) ELSE p_size / 55 END AS d,
 CASE WHEN p_partkey % 9 = 0 THEN 0.1 ELSE 0 END AS b, (p_partkey % 13 - 3) / 20 AS tx, (p_partkey % 17 - 5) / 20 AS ty FROM part),
i AS (SELECT *, a > 1.001 OR d > 1.001 AS inv FROM t WHERE a > 0 AND d > 0 AND b = 0),
n AS (SELECT p_partkey, CASE WHEN inv THEN 1 / a ELSE a END AS w, CASE WHEN inv THEN 1 / d ELSE d END AS h, CASE WHEN inv THEN -tx / a ELSE tx END AS x, CASE WHEN inv THEN -ty / d ELSE ty END AS y FROM i),
c AS (SELECT p_partkey, greatest(0, x) AS x, greatest(0, y) AS y, least(1, x + w) - greatest(0, x) AS w, least(1, y + h) - greatest(0, y) AS h FROM n)"""


@query(_CROP + """ SELECT t.p_partkey, round(c.x, 6) AS x, round(c.y, 6) AS y, round(c.w, 6) AS width, round(c.h, 6) AS height FROM t LEFT JOIN c ON c.p_partkey = t.p_partkey AND c.w > 0 AND c.h > 0 AND NOT (c.w >= 0.998 AND c.h >= 0.998)""")
def visible_crop(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    a, dd = F.when(k % 4 == 0, 100 / (s + 20)).otherwise(s / 60), F.when(k % 4 == 0, 90 / (s + 20)).otherwise(s / 55)
    r = geometry.visible_crop(a, F.when(k % 9 == 0, 0.1).otherwise(0.0), (k % 13 - 3) / 20, F.lit(0.0), dd, (k % 17 - 5) / 20)
    return _t(spark, d, "part").select("p_partkey", r.alias("r")).select("p_partkey", *(F.round(f"r.{c}", 6).alias(c) for c in ("x", "y", "width", "height")))


@query(FILL + """, k AS (SELECT *, CASE WHEN idx % 2 = 0 THEN hash || '@' || printf('%.4f', (hash % 5) / 8) || ',0.0000,0.5000,' || printf('%.4f', (idx % 4) / 8 + 0.25) ELSE CAST(hash AS VARCHAR) END AS id, idx % 2 = 0 AS c, (node * 100 + idx) AS pos FROM f)
SELECT id, any_value(hash) AS hash, 'layer ' || arg_min(node, pos) AS name, CAST(CASE WHEN any_value(c) THEN greatest(1, floor((any_value(hash) % 700) * 0.5 + 0.5)) ELSE any_value(hash) % 700 END AS INTEGER) AS width,
 CAST(CASE WHEN any_value(c) THEN greatest(1, floor(300 * (any_value(idx) % 4 / 8 + 0.25) + 0.5)) ELSE 300 END AS INTEGER) AS height, string_agg(CAST(node AS VARCHAR), ',' ORDER BY pos) AS targets FROM k GROUP BY id""")
def dedupe_crops(spark, d):
    h, i = F.col("hash"), F.col("idx")
    crop = F.when(i % 2 == 0, F.struct(((h % 5) / 8).alias("x"), F.lit(0.0).alias("y"), F.lit(0.5).alias("width"), (i % 4 / 8 + 0.25).alias("height")))
    fills = _fills(spark, d).select((F.col("node") * 100 + i).alias("pos"), "node", F.concat(F.lit("layer "), F.col("node").cast("string")).alias("name"), "hash", crop.alias("crop"), (h % 700).alias("full_w"), F.lit(300).alias("full_h"))
    return selection.dedupe_crops(fills).withColumn("targets", F.concat_ws(",", "targets"))


@query(FILL + """, i AS (SELECT hash, arg_min(node, node * 100 + idx) AS node, CAST(min(node * 100 + idx) AS BIGINT) AS pos FROM f GROUP BY hash)
SELECT hash, CAST(node AS VARCHAR) AS name, pos, p_name AS content, CASE WHEN p_name IS NULL THEN node || ': not found' END AS error FROM i LEFT JOIN part ON p_partkey = hash AND p_size % 3 > 0""")
def download_originals(spark, d):
    images = _fills(spark, d).select((F.col("node") * 100 + F.col("idx")).alias("pos"), "hash", F.col("node").cast("string").alias("name"))
    blobs = _t(spark, d, "part").filter(F.col("p_size") % 3 > 0).select(F.col("p_partkey").alias("hash"), F.col("p_name").alias("content"))
    return selection.originals(images, blobs)


# the search

_CURVE = """img AS (SELECT p_partkey AS image_id, p_size, CAST(2000 + p_partkey % 997 AS BIGINT) AS base, 0.985::DOUBLE AS need, CASE WHEN p_partkey % 3 = 0 THEN 4000::DOUBLE ELSE 1e18::DOUBLE END AS prune FROM part),
curve AS (SELECT image_id, need, prune, CAST(f AS INTEGER) AS f, CAST(l AS INTEGER) AS l, CAST(base + l * l // 2 - f * 40 + (image_id + l) % 5 * f * 20 AS BIGINT) AS bytes, 1 - (p_size + 5)::DOUBLE / (l * 12)::DOUBLE - f * 0.0004::DOUBLE AS ssim
 FROM img, unnest(generate_series(58, 98)) AS t(l), unnest([0, 1]) AS u(f)),
c AS (SELECT *, ssim >= need AS ok FROM curve)"""


def _attempt(k, s, v, f):
    """What the encoder makes of an image at level v; f: 1 for the final encode, else 0."""
    return F.struct((2000 + k % 997 + F.floor(v * v / 2) - f * 40 + (k + v) % 5 * f * 20).cast("long").alias("bytes"), (1 - (s + 5) / (v * 12) - f * 0.0004).alias("ssim"), F.lit(1.0).alias("worst"))


def _curves(spark, d):
    """Images with an attempt at every level from 58 to 98, quick and final."""
    k, s = F.col("p_partkey"), F.col("p_size")
    level = F.sequence(F.lit(58), F.lit(98))

    def attempts(f):
        return F.transform(level, lambda v: _attempt(k, s, v, f))

    both = F.map_from_arrays(F.concat(level, F.transform(level, lambda v: v + search.FINAL)), F.concat(attempts(0), attempts(1)))
    return _t(spark, d, "part").select(k.alias("image_id"), both.alias("attempts"), F.when(k % 3 == 0, 4000.0).otherwise(1e18).alias("prune"))


@query("WITH RECURSIVE " + _CURVE + """,
s(image_id, n, lo, hi, best, best_bytes, stop) AS (SELECT image_id, 0, 58, 98, CAST(NULL AS INTEGER), CAST(NULL AS BIGINT), CAST(NULL AS INTEGER) FROM img UNION ALL
 SELECT s.image_id, n + 1, CASE WHEN ok THEN lo ELSE l + 1 END, CASE WHEN ok THEN l - 1 ELSE hi END, CASE WHEN ok AND (best IS NULL OR bytes < best_bytes) THEN l ELSE best END, CASE WHEN ok AND (best IS NULL OR bytes < best_bytes) THEN bytes ELSE best_bytes END,
  CASE WHEN NOT ok AND bytes > prune THEN l END FROM s JOIN c ON c.image_id = s.image_id AND f = 0 AND l = CAST(floor((lo + hi) / 2 + 0.5) AS INTEGER) WHERE n < 7 AND hi - lo >= 2 AND stop IS NULL),
e AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC) = 1),
t AS (SELECT e.image_id, stop, CASE WHEN best IS NOT NULL THEN best WHEN c.ok THEN 98 END AS p, c.ok AS top_ok, c.bytes > c.prune AS top_big FROM e JOIN c ON c.image_id = e.image_id AND c.f = 0 AND c.l = 98),
g AS (SELECT t.*, CASE WHEN f1.ok OR p = 98 THEN p ELSE least(98, p + 3) END AS q FROM t LEFT JOIN c f1 ON f1.image_id = t.image_id AND f1.f = 1 AND f1.l = p),
r AS (SELECT g.image_id, CASE WHEN stop IS NOT NULL THEN stop WHEN p IS NULL THEN 98 WHEN z.ok AND z.bytes <= y.bytes THEN q ELSE p END AS level,
 CASE WHEN stop IS NOT NULL THEN FALSE WHEN p IS NULL THEN NOT top_big ELSE z.ok AND z.bytes <= y.bytes END AS final, stop IS NOT NULL OR (p IS NULL AND top_big) AS pruned
 FROM g LEFT JOIN c y ON y.image_id = g.image_id AND y.f = 0 AND y.l = p LEFT JOIN c z ON z.image_id = g.image_id AND z.f = 1 AND z.l = q)
SELECT r.image_id, level, final, c.bytes, CASE WHEN pruned THEN FALSE WHEN final THEN ssim >= need - CASE WHEN r.level = 98 AND NOT ok THEN 0.003 ELSE 0 END ELSE ok END AS passed, pruned FROM r JOIN c ON c.image_id = r.image_id AND c.l = level AND c.f = CAST(final AS INTEGER)""")
def lossy_search(spark, d):
    found = search.Search(F.col("attempts"), F.lit(0.985), F.lit(0.0), F.col("prune")).lossy(F.lit(58), F.lit(98), F.lit(2), F.lit(7))
    return _curves(spark, d).select("image_id", found.alias("o")).select("image_id", "o.level", "o.final", "o.bytes", "o.passed", "o.pruned")


_WALK = """WITH img AS (SELECT p_partkey AS image_id, p_size, 8 + p_partkey % 20 AS least, 40 + p_partkey % 400 AS uniq, CASE WHEN p_partkey % 3 = 0 THEN 2000::DOUBLE ELSE 1e18::DOUBLE END AS prune FROM part),
c AS (SELECT *, CAST(1500 + image_id % 97 + n * 4 AS BIGINT) AS bytes, 1 - (p_size + 5)::DOUBLE / (n * 50)::DOUBLE >= 0.985 AS ok, CAST(1500 + image_id % 97 + n * 4 - 7 + image_id % 2 * 9 AS BIGINT) AS fbytes FROM img, unnest([256, 192, 128, 96, 64, 48, 32, 24, 16, 8]) AS t(n) WHERE n >= least AND n < uniq),
w AS (SELECT *, coalesce(bool_and(ok) OVER (PARTITION BY image_id ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS before FROM c),
p AS (SELECT image_id, min(n) FILTER (before AND ok) AS best, max(n) FILTER (before AND NOT ok AND bytes > prune) AS stop FROM w GROUP BY image_id)"""


@query(_WALK + """ SELECT img.image_id, CAST(coalesce(stop, best) AS INTEGER) AS level, CASE WHEN stop IS NOT NULL THEN c.bytes WHEN fbytes <= c.bytes THEN fbytes ELSE c.bytes END AS bytes, CASE WHEN coalesce(stop, best) IS NOT NULL THEN stop IS NOT NULL END AS pruned
FROM img LEFT JOIN p ON p.image_id = img.image_id LEFT JOIN c ON c.image_id = img.image_id AND c.n = coalesce(stop, best)""")
def palette_search(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    steps = F.array(*map(F.lit, search.PALETTE_STEPS))
    row = lambda n, f: F.struct((1500 + k % 97 + n * 4 + f * (k % 2 * 9 - 7)).cast("long").alias("bytes"), (1 - (s + 5) / (n * 50)).alias("ssim"), F.lit(1.0).alias("worst"))
    attempts = F.map_from_arrays(F.concat(steps, F.transform(steps, lambda n: n + search.FINAL)), F.concat(F.transform(steps, lambda n: row(n, 0)), F.transform(steps, lambda n: row(n, 1))))
    found = search.Search(attempts, F.lit(0.985), F.lit(0.0), F.when(k % 3 == 0, 2000.0).otherwise(1e18)).palette(search.palette_steps(8 + k % 20, 40 + k % 400, F.lit(False)))
    return _t(spark, d, "part").select(k.alias("image_id"), found.alias("o")).select("image_id", "o.level", "o.bytes", "o.pruned")


@query(FILL.replace("WITH", "WITH RECURSIVE", 1) + """, t AS (SELECT hash AS image_id, row_number() OVER (PARTITION BY hash ORDER BY node, idx) AS pos, bytes, 1 - l_discount AS ssim, l_discount < 0.05 AS passed FROM f),
b(image_id, pos, bytes, before, pruned, bb, bs, bp) AS (SELECT image_id, pos, bytes, CAST(NULL AS BIGINT), FALSE, bytes, ssim, passed FROM t WHERE pos = 1 UNION ALL
 SELECT t.image_id, t.pos, t.bytes, bb, NOT passed AND t.bytes > bb * 1.12::DOUBLE,
  CASE WHEN win THEN t.bytes ELSE bb END, CASE WHEN win THEN ssim ELSE bs END, CASE WHEN win THEN passed ELSE bp END
 FROM (SELECT t.*, bb, bs, bp, NOT (NOT passed AND t.bytes > bb * 1.12::DOUBLE) AND CASE WHEN passed <> bp THEN passed WHEN NOT passed THEN ssim > bs ELSE t.bytes < bb END AS win FROM b JOIN t ON t.image_id = b.image_id AND t.pos = b.pos + 1) t)
SELECT image_id, pos, bytes, before, pruned FROM b""")
def running_best(spark, d):
    pos = F.row_number().over(Window.partitionBy("hash").orderBy("node", "idx")).cast("long")
    return search.running_best(_fills(spark, d).select(F.col("hash").alias("image_id"), pos.alias("pos"), "bytes", (1 - F.col("l_discount")).alias("ssim"), (F.col("l_discount") < 0.05).alias("passed")))


@query("""WITH c AS (SELECT * FROM (VALUES ('webp', 'lossy', 70, 100), ('png-quant', 'palette', 0, 0), ('png-lossless', 'lossless', 0, 0)) AS t(candidate, kind, lo, hi)),
l AS (SELECT p_partkey AS image_id, candidate, kind, unnest(CASE kind WHEN 'lossless' THEN [100] WHEN 'palette' THEN [256, 192, 128, 96, 64, 48, 32, 24, 16, 8] ELSE generate_series(lo, hi) END) AS level, p_size * 6 AS u FROM part, c)
SELECT image_id, candidate, CAST(level AS INTEGER) AS level FROM l WHERE kind <> 'palette' OR (level >= 24 AND level < u)""")
def candidate_ladder(spark, d):
    few = spark.createDataFrame([("webp", "lossy", 70, 100), ("png-quant", "palette", 0, 0), ("png-lossless", "lossless", 0, 0)], "candidate string, kind string, lo int, hi int")
    return search.ladder(_t(spark, d, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 6).alias("unique_colors"), F.lit(24).alias("min_palette")), few)


@query()
def compress_search(spark, d):
    """The whole search over two lossy candidates and a lossless fallback; a test walks through the attempts."""
    attempts = F.map_concat("attempts", F.create_map(F.lit(1100), F.struct(F.lit(9000).cast("long").alias("bytes"), F.lit(1.0).alias("ssim"), F.lit(1.0).alias("worst"))))
    one = lambda name, kind, lo, tol, most: F.struct(F.lit(name).alias("candidate"), F.lit(kind).alias("kind"), F.lit(lo).alias("lo"), F.lit(98).alias("hi"), F.lit(tol).alias("tolerance"), F.lit(most).alias("most"), attempts.alias("attempts"))
    images = _curves(spark, d).select(
        "image_id", F.lit(None).cast("double").alias("custom"), F.lit(0.985).alias("min_ssim"), F.lit(0.0).alias("min_worst"), F.array(F.lit(256)).alias("steps"),
        F.array(one("webp", "lossy", 70, 2, 7), one("avif", "lossy", 60, 3, 5)).alias("primary"), F.array(one("png-lossless", "lossless", 0, 0, 0)).alias("fallback"))
    return search.compress(images).select("image_id", "best.candidate", "best.level", "best.bytes", "best.passed", F.size("results").alias("tried"), "warning")


# the comparison of images

_LAID = "WITH" + _px_sql(20) + """,
pair AS (SELECT *, least(255, r + x * y % 5) AS r2, greatest(0, g - x % 3) AS g2, b AS b2, greatest(0, a - y % 4) AS a2 FROM px),
al AS (SELECT image_id, bool_or(a < 255 OR a2 < 255) AS al, max(abs(a - a2)) AS alpha_error FROM pair GROUP BY image_id),
o AS (SELECT pair.*, bg FROM pair JOIN al USING (image_id) JOIN (VALUES (-1), (0), (255)) AS v(bg) ON CASE WHEN al THEN bg >= 0 ELSE bg < 0 END),
flat AS (SELECT image_id, bg, w, h, x, y, """ + ", ".join(f"CASE WHEN bg < 0 THEN {c}{n}::DOUBLE ELSE {c}{n} * (a{n} / 255) + (1 - a{n} / 255) * bg END AS {c}{n}" for n in ("", "2") for c in "rgb") + """ FROM o),
pl AS (""" + " UNION ALL ".join(
    f"SELECT image_id, bg, '{name}' AS c, w, h, x, y, " + ", ".join(f"CAST({k[0]}::DOUBLE * r{n} + {k[1]}::DOUBLE * g{n} + {k[2]}::DOUBLE * b{n} + {k[3]}::DOUBLE AS FLOAT) AS {v}" for n, v in (("", "p"), ("2", "q"))) + " FROM flat"
    for name, k in YCBCR.items()) + """),
hv AS (SELECT * FROM pl WHERE c = 'luma' OR w < 16 OR h < 16 UNION ALL
 SELECT image_id, bg, c, w // 2, h // 2, x // 2, y // 2, CAST(avg(p::DOUBLE) AS FLOAT), CAST(avg(q::DOUBLE) AS FLOAT) FROM pl WHERE c <> 'luma' AND w >= 16 AND h >= 16 AND x < w // 2 * 2 AND y < h // 2 * 2 GROUP BY image_id, bg, c, w // 2, h // 2, x // 2, y // 2),
dim AS (SELECT DISTINCT image_id, c, w, h, least(8, w, h) AS win, CASE WHEN least(8, w, h) < 8 THEN least(8, w, h) ELSE 4 END AS st FROM hv),
wx AS (SELECT DISTINCT image_id, c, win, s AS wx FROM dim, unnest(list_append(generate_series(0, w - win, st), w - win)) AS t(s)),
wy AS (SELECT DISTINCT image_id, c, s AS wy FROM dim, unnest(list_append(generate_series(0, h - win, st), h - win)) AS t(s)),
m AS (SELECT image_id, bg, c, wx, wy, avg(p::DOUBLE) AS mp, avg(q::DOUBLE) AS mq, avg(p::DOUBLE * p::DOUBLE) AS pp, avg(q::DOUBLE * q::DOUBLE) AS qq, avg(p::DOUBLE * q::DOUBLE) AS pq
      FROM hv JOIN wx USING (image_id, c) JOIN wy USING (image_id, c) WHERE x >= wx AND x < wx + win AND y >= wy AND y < wy + win GROUP BY ALL),
sc AS (SELECT image_id, bg, c, (2 * mp * mq + 6.5025) * (2 * (pq - mp * mq) + 58.5225) / ((mp * mp + mq * mq + 6.5025) * (greatest(0, pp - mp * mp) + greatest(0, qq - mq * mq) + 58.5225)) AS score FROM m),
b AS (SELECT image_id, bg, CAST(least(1999, greatest(0, floor((score + 1) / 2 * 2000))) AS INTEGER) AS bin, count(*) AS n FROM sc WHERE c = 'luma' GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY image_id, bg ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY image_id, bg) AS total FROM b),
wo AS (SELECT image_id, min(worst) AS worst FROM (SELECT image_id, bg, (min(bin) + 0.5) / 2000 * 2 - 1 AS worst FROM u WHERE upto >= greatest(1, floor(total * 0.01)) GROUP BY ALL) GROUP BY image_id),
me AS (SELECT image_id, bg, c, avg(score) AS mean FROM sc GROUP BY ALL),
si AS (SELECT image_id, min(s) AS ssim FROM (SELECT image_id, bg, sum(mean * CASE c WHEN 'luma' THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END) AS s FROM me GROUP BY ALL) GROUP BY image_id),
er AS (SELECT image_id, max(mse) AS mse FROM (SELECT image_id, bg, avg((power(r - r2, 2) + power(g - g2, 2) + power(b - b2, 2)) / 3) AS mse FROM flat GROUP BY ALL) GROUP BY image_id)"""


@query(_LAID + """ SELECT image_id, round(least(1, ssim), 6) AS ssim, round(least(1, worst), 6) AS worst_block_ssim, CASE WHEN mse = 0 THEN CAST('inf' AS DOUBLE) ELSE round(10 * log10(65025 / mse), 6) END AS psnr, alpha_error AS max_alpha_error
FROM si JOIN wo USING (image_id) JOIN er USING (image_id) JOIN al USING (image_id)""")
def compare_images(spark, d):
    found = metrics.compare(pixels.degraded(_px(spark, d, 20)))
    return found.select("image_id", *(F.round(c, 6).alias(c) for c in ("ssim", "worst_block_ssim", "psnr")), "max_alpha_error")


@query(PX + """, s AS (SELECT image_id, w, h, count(*) AS n, CAST(sum(r * 3 + a) AS BIGINT) AS total FROM px GROUP BY ALL)
SELECT image_id, CASE WHEN image_id % 7 > 0 AND image_id % 11 > 0 THEN n END AS n, CASE WHEN image_id % 7 > 0 AND image_id % 11 > 0 THEN total END AS total,
 CASE WHEN image_id % 11 = 0 THEN 'no candidate' WHEN image_id % 7 = 0 THEN w || '×' || h || ' against ' || (w - 1) || '×' || h END AS error FROM s""")
def pixel_pairs(spark, d):
    px = _px(spark, d)
    narrow = F.when(F.col("image_id") % 7 == 0, F.col("w") - 1).otherwise(F.col("w"))
    other = px.filter(F.col("image_id") % 11 > 0).withColumn("w", narrow).filter(F.col("x") < F.col("w"))
    both, errors = metrics.pixel_pairs(px, other)
    sums = both.groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.col("r") + F.col("r2") * 2 + F.col("a2")).alias("total"))
    return sums.select("image_id", "n", "total", F.lit(None).cast("string").alias("error")).unionByName(errors, allowMissingColumns=True)


# resampling and metadata


def _kernel_sql(x: str) -> str:
    near, far = f"(1.5::DOUBLE * pow({x}, 3) - 2.5::DOUBLE * pow({x}, 2) + 1)", f"(-0.5::DOUBLE * pow({x}, 3) + 2.5::DOUBLE * pow({x}, 2) - 4 * {x} + 2)"
    lanczos = f"CASE WHEN {x} < 1e-9 THEN 1 WHEN {x} < 3 THEN sin({x} * pi()) / ({x} * pi()) * sin({x} / 3 * pi()) / ({x} / 3 * pi()) ELSE 0 END"
    return f"CASE WHEN up THEN CASE WHEN {x} < 1 THEN {near} WHEN {x} < 2 THEN {far} ELSE 0 END ELSE {lanczos} END"


def _taps_sql(name: str, n: str, size: str) -> str:
    return f"""{name} AS (SELECT DISTINCT i AS image_id, {n} AS n, {size} AS m, i % 2 = 1 AS up FROM img),
{name}t AS (SELECT image_id, up, k, j, abs((j + 0.5 - (k + 0.5) * (n / m)) / greatest(n / m, 1))::DOUBLE AS t FROM {name}, unnest(generate_series(0, m - 1)) AS a(k), unnest(generate_series(0, n - 1)) AS b(j)),
{name}w AS (SELECT image_id, k, j, {_kernel_sql('t')} AS wt FROM {name}t)"""


@query(PX + ", " + _taps_sql("tx", "w", "CASE WHEN i % 2 = 1 THEN w + 3 ELSE w * 2 // 3 END") + ", " + _taps_sql("ty", "h", "CASE WHEN i % 2 = 1 THEN h + 2 ELSE h // 2 END") + """,
hz AS (SELECT px.image_id, y, k AS x, sum(wt * r) / sum(wt) AS v FROM px JOIN txw ON txw.image_id = px.image_id AND j = x GROUP BY px.image_id, y, k),
o AS (SELECT hz.image_id, x, k AS y, sum(wt * v) / sum(wt) AS v FROM hz JOIN tyw ON tyw.image_id = hz.image_id AND j = y GROUP BY hz.image_id, x, k)
SELECT image_id, count(*) AS n, round(sum(v * (1 + x + 2 * y)), 3) AS sum_v FROM o GROUP BY image_id""")
def resample_planes(spark, d):
    px = _px(spark, d).withColumn("v", F.col("r").cast("double"))
    up = F.col("image_id") % 2 == 1
    grown = resample.resample_planes(px.filter(up), F.col("w") + 3, F.col("h") + 2, "catrom")
    shrunk = resample.resample_planes(px.filter(~up), F.floor(F.col("w") * 2 / 3).cast("int"), F.floor(F.col("h") / 2).cast("int"), "lanczos3")
    return grown.unionByName(shrunk).groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v") * (1 + F.col("x") + 2 * F.col("y"))), 3).alias("sum_v"))


@query("""SELECT p_partkey AS id, CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 + p_size % 8 ELSE 1 END AS INTEGER) AS orientation, p_partkey % 2 = 0 AS has_profile, CASE WHEN p_partkey % 2 = 0 THEN p_brand || CASE WHEN p_partkey % 4 = 0 THEN ' sRGB' ELSE '' END END AS description,
 p_partkey % 4 <> 2 AS looks_srgb, CAST(2 + CASE WHEN p_partkey % 2 = 0 THEN 18 + 168 + length(p_brand) + CASE WHEN p_partkey % 4 = 0 THEN 5 ELSE 0 END ELSE 0 END + 2 + length(p_type)
 + CASE WHEN p_partkey % 3 = 0 AND p_size % 8 > 0 THEN 36 + 4 + length(p_name) ELSE 0 END AS BIGINT) AS n_bytes FROM part""")
def jpeg_metadata(spark, d):
    """Files of a comment, EXIF and a colour profile in front of the scan."""
    k, utf8 = F.col("p_partkey"), lambda c: F.encode(c, "UTF-8")
    u = lambda v, n: F.unhex(F.lpad(F.hex(v.cast("long")), 2 * n, "0"))
    part = lambda marker, data: F.concat(F.unhex(F.lit(f"FF{marker:02X}")), u(F.length(data) + 2, 2), data)
    nothing = F.lit(b"")
    exif = part(0xE1, F.concat(F.lit(b"Exif\0\0MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01"), u(1 + F.col("p_size") % 8, 2), F.lit(b"\0\0"), F.lit(b"\0\0\0\0")))
    name = utf8(F.concat("p_brand", F.when(k % 4 == 0, " sRGB").otherwise("")))
    icc = F.concat(F.lit(bytes(128) + b"\0\0\0\x01desc\0\0\0\x90\0\0\0\0desc\0\0\0\0"), u(F.length(name) + 1, 4), name, F.lit(bytes(12)))
    profile = part(0xE2, F.concat(F.lit(b"ICC_PROFILE\0\x01\x01"), icc))
    content = F.concat(F.lit(b"\xff\xd8"), part(0xFE, utf8("p_name")), F.when(k % 3 == 0, exif).otherwise(nothing), F.when(k % 2 == 0, profile).otherwise(nothing), F.lit(b"\xff\xda"), utf8("p_type"))
    found = metadata.inspect(_t(spark, d, "part").select(k.cast("long").alias("id"), content.alias("content")))
    return found.select("id", "orientation", "has_profile", "description", "looks_srgb", F.length("stripped").cast("long").alias("n_bytes"))


# palettes


@query(PALETTE + """, least AS (SELECT image_id, arg_min(r, (a, idx)) AS lr, arg_min(g, (a, idx)) AS lg, arg_min(b, (a, idx)) AS lb, arg_min(a, (a, idx)) AS la FROM pal GROUP BY image_id),
o AS (SELECT px.image_id, x, y, """ + ", ".join(f"CASE WHEN px.a = 0 THEN l{c} ELSE pal.{c} END AS {c}" for c in "rgba") + """ FROM px JOIN near ON near.image_id = px.image_id AND near.r = px.r AND near.g = px.g AND near.b = px.b AND near.a = px.a
 JOIN pal ON pal.image_id = px.image_id AND pal.idx = near.idx JOIN least ON least.image_id = px.image_id) """ + _sums_sql("o", "r", "g", "b", "a"))
def remap_palette(spark, d):
    return _sums(quantize.remap(_px(spark, d), _palette(spark, d)), "r", "g", "b", "a")


_MOVED = """{0} AS (SELECT c.image_id, c.idx, {means} FROM {1} c LEFT JOIN (SELECT image_id, idx, {sums} FROM
 (SELECT d.*, k.idx FROM dc d JOIN {1} k ON k.image_id = d.image_id QUALIFY row_number() OVER (PARTITION BY d.image_id, d.r, d.g, d.b, d.a ORDER BY round(pow(d.cr - k.cr, 2) + pow(d.cg - k.cg, 2) + pow(d.cb - k.cb, 2) + pow(d.ca - k.ca, 2), 6), k.idx) = 1) GROUP BY image_id, idx) m
 ON m.image_id = c.image_id AND m.idx = c.idx)"""


def _moved(name: str, before: str) -> str:
    return _MOVED.format(name, before, means=", ".join(f"coalesce(m{c}, c.c{c}) AS c{c}" for c in "rgba"), sums=", ".join(f"sum({c} * a * n) / sum(n) / 255 * {w}::DOUBLE AS m{c}" if c != "a" else f"sum(a * n) / sum(n) * {w}::DOUBLE AS ma" for c, w in WEIGHTS.items()))


_SPACE = "{0}r * ({0}a / 255) * 0.6378::DOUBLE AS cr, {0}g * ({0}a / 255) * 2.1456::DOUBLE AS cg, {0}b * ({0}a / 255) * 0.2166::DOUBLE AS cb, {0}a * 1.5::DOUBLE AS ca"


@query(PALETTE + ", dc AS (SELECT image_id, n, r, g, b, a, " + _SPACE.format("") + " FROM col), k0 AS (SELECT image_id, idx, " + _SPACE.format("") + " FROM pal), " + ", ".join((_moved("k1", "k0"), _moved("k2", "k1"), _moved("k3", "k2")))
       + " SELECT image_id, idx, cr, cg, cb, ca FROM k3")
def kmeans_three(spark, d):
    colours = coordinates(_px(spark, d).groupBy("image_id", "r", "g", "b", "a").agg(F.count("*").alias("n"))).select("image_id", *"rgba", *quantize.COORDS, "n")
    return quantize.lloyd(colours, coordinates(_palette(spark, d)).select("image_id", "idx", *quantize.COORDS))


@query()
def quantize_images(spark, d):
    """Palettes of 16 entries and the images redrawn with them, with error diffusion; tests hold the steps against plain loops."""
    px = _px(spark, d)
    return _sums(quantize.remap_dithered(px, quantize.quantize(px, 16), 0.9), "r", "g", "b", "a")


# mattes

_PAIRS = ["rr", "rg", "rb", "gg", "gb", "bb", "rp", "gp", "bp"]


def _box_sql(name: str, source: str, columns, radius: int = 2, kept: str = "") -> str:
    mean = lambda c, part: f"avg({c}) OVER ({part} ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS {c}"
    return f"""{name}x AS (SELECT image_id, x, y{kept}, {', '.join(mean(c, 'PARTITION BY image_id, y ORDER BY x') for c in columns)} FROM {source}),
{name} AS (SELECT image_id, x, y{kept}, {', '.join(mean(c, 'PARTITION BY image_id, x ORDER BY y') for c in columns)} FROM {name}x)"""


def _guided_sql(epsilon: str) -> str:
    """The guided filter's coefficients of c (image_id, x, y, r, g, b, p) as common tables, the last o."""
    return "c2 AS (SELECT *, " + ", ".join(f"{k[0]} * {k[1]} AS {k}" for k in _PAIRS) + " FROM c), " + _box_sql("m", "c2", [*"rgbp", *_PAIRS]) + """,
v AS (SELECT image_id, x, y, r, g, b, p, """ + ", ".join(f"{k} - {k[0]} * {k[1]} + {epsilon if k[0] == k[1] else '0'}::DOUBLE AS v{k}" for k in _PAIRS) + """ FROM m),
i AS (SELECT *, vgg * vbb - vgb * vgb AS irr, vgb * vrb - vrg * vbb AS irg, vrg * vgb - vgg * vrb AS irb, vrr * vbb - vrb * vrb AS igg, vrb * vrg - vrr * vgb AS igb, vrr * vgg - vrg * vrg AS ibb FROM v),
d AS (SELECT *, vrr * irr + vrg * irg + vrb * irb AS det FROM i),
k AS (SELECT image_id, x, y, r, g, b, p, (irr * vrp + irg * vgp + irb * vbp) / det AS kr, (irg * vrp + igg * vgp + igb * vbp) / det AS kg, (irb * vrp + igb * vgp + ibb * vbp) / det AS kb FROM d),
k2 AS (SELECT image_id, x, y, kr, kg, kb, p - kr * r - kg * g - kb * b AS k FROM k), """ + _box_sql("o", "k2", ["kr", "kg", "kb", "k"])


def _stretched_sql(name: str, source: str, along: str, size: str, have: int) -> str:
    """The coefficients of source at every place along an axis, between the centres of `have` samples."""
    other = "y" if along == "x" else "x"
    cells = ", ".join(f"a.{c} + (b.{c} - a.{c}) * f AS {c}" for c in ("kr", "kg", "kb", "k"))
    return f"""{name}p AS (SELECT image_id, CAST(t AS INTEGER) AS {along}, least({have - 1}::DOUBLE, greatest(0::DOUBLE, (t + 0.5::DOUBLE) * ({have} / {size}) - 0.5::DOUBLE)) AS place FROM (SELECT DISTINCT image_id, w, h FROM px), unnest(generate_series(0, {size} - 1)) AS q(t)),
{name}g AS (SELECT *, CAST(floor(place) AS INTEGER) AS lo, CAST(CAST(place - floor(place) AS FLOAT) AS DOUBLE) AS f FROM {name}p),
{name} AS (SELECT g.image_id, g.{along}, a.{other}, {cells} FROM {name}g g JOIN {source} a ON a.image_id = g.image_id AND a.{along} = lo JOIN {source} b ON b.image_id = g.image_id AND b.{along} = least({have - 1}, lo + 1) AND b.{other} = a.{other})"""


def _parted_sql(name: str, source: str, fore: str, back: str, radius: int) -> str:
    """Blurred foreground f and background b of the columns, by the opacity al."""
    blurred = ["m", *(n + c for n in "fb" for c in "rgb")]
    own = ", r, g, b, al"
    return f"{name}0 AS (SELECT image_id, x, y{own}, al AS m, " + ", ".join(f"{fore}{c} * al AS f{c}, {back}{c} * (1 - al) AS b{c}" for c in "rgb") + f" FROM {source}), " + _box_sql(f"{name}1", f"{name}0", blurred, radius, own) + f""",
{name}2 AS (SELECT image_id, x, y{own}, """ + ", ".join(f"f{c} / (m + 1e-5::DOUBLE) AS f{c}, b{c} / (1 - m + 1e-5::DOUBLE) AS b{c}" for c in "rgb") + f""" FROM {name}1),
{name} AS (SELECT *, """ + ", ".join(f"greatest(0::DOUBLE, least(1::DOUBLE, f{c} + al * ({c} - al * f{c} - (1 - al) * b{c}))) AS u{c}, b{c} AS w{c}" for c in "rgb") + f" FROM {name}2)"


@query(PX + ", c AS (SELECT image_id, x, y, r / 255 AS r, g / 255 AS g, b / 255 AS b, ((x * 37 + y * 11) % 256) / 255 AS p FROM px), " + _guided_sql("1e-2") + " " + _sums_sql("o", "kr", "kg", "kb", "k").replace(", 4)", ", 3)"))
def guided_filter(spark, d):
    px = matte.colour_planes(_px(spark, d)).withColumn("p", (F.col("x") * 37 + F.col("y") * 11) % 256 / 255)
    out = matte.guided_coefficients(px, F.lit(2), 1e-2)
    return out.groupBy("image_id").agg(F.count("*").alias("n"), *(F.round(F.sum(F.col(c) * (1 + F.col("x") + 2 * F.col("y"))), 3).alias(f"sum_{c}") for c in ("kr", "kg", "kb", "k")))


@query(PX.replace("WITH", "WITH RECURSIVE", 1) + """, m AS (SELECT image_id, w, h, x, y, y * w + x AS p, a / 255 * ((x * 53 + y * 29) % 11 / 10) AS alpha FROM px),
k AS (SELECT image_id, x, y, p FROM m WHERE alpha >= 0.5::DOUBLE),
reach(image_id, p, x, y, l) AS (SELECT image_id, p, x, y, p FROM k UNION
  SELECT k.image_id, k.p, k.x, k.y, o.l FROM (SELECT r.*, x + dx AS nx, y + dy AS ny FROM reach r, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS d(dx, dy)) o JOIN k ON k.image_id = o.image_id AND k.x = nx AND k.y = ny AND k.p > o.l),
c AS (SELECT image_id, p, min(l) AS l FROM reach GROUP BY ALL), s AS (SELECT image_id, l, count(*) AS n FROM c GROUP BY ALL),
t AS (SELECT image_id, l, n >= max(n) OVER (PARTITION BY image_id) * 0.2::DOUBLE AS kept FROM s),
met AS (SELECT m.*, kept, m.image_id IN (SELECT image_id FROM s) AS sure FROM m LEFT JOIN c ON c.image_id = m.image_id AND c.p = m.p LEFT JOIN t ON t.image_id = c.image_id AND t.l = c.l),
n1 AS (SELECT *, max(CAST(coalesce(kept, false) AS INTEGER)) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n1 FROM met),
n2 AS (SELECT *, max(n1) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n2 FROM n1),
o AS (SELECT image_id, x, y, CASE WHEN sure AND (n2 = 0 OR kept = false) THEN 0 ELSE alpha END AS alpha FROM n2) """ + _sums_sql("o", "alpha"))
def clean_matte(spark, d):
    """Mattes made from the pixels' opacity and place, cleaned; a test holds it against plain loops."""
    px = _px(spark, d).withColumn("alpha", F.col("a") / 255 * ((F.col("x") * 53 + F.col("y") * 29) % 11 / 10))
    return _sums(matte.clean(px, halo=F.lit(1), least_share=0.2), "alpha")


@query(PX + """, c AS (SELECT image_id, x * 5 // w AS x, y * 4 // h AS y, avg(r) / 255 AS r, avg(g) / 255 AS g, avg(b) / 255 AS b, avg(a) / 255 AS p FROM px GROUP BY image_id, x * 5 // w, y * 4 // h), """
       + _guided_sql("1e-4") + ", " + _stretched_sql("ux", "o", "x", "w", 5) + ", " + _stretched_sql("uy", "ux", "y", "h", 4) + """,
s0 AS (SELECT px.image_id, px.x, px.y, r / 255 AS r, g / 255 AS g, b / 255 AS b, greatest(0::DOUBLE, least(1::DOUBLE, """ + " + ".join(f"CAST(CAST(k{c} AS FLOAT) AS DOUBLE) * ({c} / 255)" for c in "rgb") + """ + CAST(CAST(k AS FLOAT) AS DOUBLE))) AS al
 FROM px JOIN uy ON uy.image_id = px.image_id AND uy.x = px.x AND uy.y = px.y), """ + _parted_sql("s1", "s0", "", "", 2) + ", " + _parted_sql("s2", "s1", "u", "w", 1) + """,
f AS (SELECT image_id, x, y, r, g, b, al AS alpha, """ + ", ".join(f"CAST(CAST({n}{c} AS FLOAT) AS DOUBLE) AS {n}{c}" for n in "fb" for c in "rgb") + """ FROM s2),
e AS (SELECT image_id, x, y, alpha, """ + ", ".join(f"CASE WHEN alpha >= 0.03::DOUBLE AND alpha < 0.998::DOUBLE THEN floor(greatest(0::DOUBLE, least(1::DOUBLE, f{c} + alpha * ({c} - alpha * f{c} - (1 - alpha) * b{c}))) * 255 + 0.5::DOUBLE) ELSE round({c} * 255) END AS {c}" for c in "rgb") + " FROM f) " + _sums_sql("e", "r", "g", "b", "alpha"))
def refine_edges(spark, d):
    """Coarse masks raised to the image's size along its edges, and the colours of soft pixels made the foreground's."""
    px = _px(spark, d)
    coarse = planes.area_downsample(px, 5, 4).select("image_id", F.lit(5).alias("w"), F.lit(4).alias("h"), F.col("cx").alias("x"), F.col("cy").alias("y"), *((F.col(c) / 255).alias(c) for c in "rgb"), (F.col("a") / 255).alias("p"))
    alpha = matte.guided_upsample(coarse, px, F.lit(2), 1e-4)
    return _sums(matte.estimate_foreground(planes.at_places(px, alpha)), "r", "g", "b", "alpha")


# synthetic images


@query("""WITH g AS (SELECT x, y, round_even(255 * (x / 127), 0) AS r, round_even(200 * (y / 63) + 30, 0) AS g, round_even(255 - 180 * (x / 127), 0) AS b, 255 AS a FROM range(128) AS t(x), range(64) AS u(y)),
p AS (SELECT x, y, ((x >> 3) * 7 + (y >> 3) * 3 + (xor(x, y) & 1)) % 16 AS i FROM range(64) AS t(x), range(64) AS u(y)),
o AS (SELECT 0 AS image_id, * FROM g UNION ALL SELECT 1, x, y, i * 53 % 256, i * 97 % 256, i * 151 % 256, CASE WHEN i = 0 THEN 0 ELSE 255 END FROM p) """ + _sums_sql("o", "r", "g", "b", "a"))
def synthetic_plain(spark, d):
    return _sums(synthetic.catalogue(spark).filter("image_id < 2"), "r", "g", "b", "a")


@query()
def synthetic_analysis(spark, d):
    """What the analysis makes of the synthetic images; a test knows what each of them is."""
    return analysis.analyze(synthetic.catalogue(spark))


# the pipeline of an image


@query()
def process_images(spark, d):
    """Crop, resize, padding and encoder plan of every image; tests hold single images against what must come out."""
    options = process.Options(remove_background=False, padding=1, max_width=7, max_height=7, format="auto")
    px = _px(spark, d)
    sources = _t(spark, d, "part").select(F.col("p_partkey").cast("long").alias("image_id"), F.lit("png").alias("source_format"))
    _, rows = process.process(px, sources, options)
    return rows.drop("source_format", "has_alpha", "unique_colors").withColumns({c: F.concat_ws(",", c) for c in ("warnings", "primary", "fallback")}).withColumn("region", F.to_json("region"))


@query(PX + """, t AS (SELECT image_id, w, h, CASE WHEN w <= 6 AND h <= 6 THEN w ELSE CAST(greatest(1, floor(w * least(1, 6::DOUBLE / greatest(w, h)) + 0.5)) AS INTEGER) END AS tw,
 CASE WHEN w <= 6 AND h <= 6 THEN h ELSE CAST(greatest(1, floor(h * least(1, 6::DOUBLE / greatest(w, h)) + 0.5)) AS INTEGER) END AS th FROM px GROUP BY image_id, w, h)
SELECT image_id, tw AS w, th AS h, CAST(tw * th AS BIGINT) AS n FROM t""")
def thumbnails(spark, d):
    return resample.thumbnail(_px(spark, d), 6).groupBy("image_id", "w", "h").agg(F.count("*").alias("n"))
