"""The whole way of images with planted failures, encoders in Python that fail, and models with fallbacks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterspark import queries_delivery
from rasterspark.plans import delivery, process, segmentation
from rasterspark.plans.segmentation import Model, Registry
from test_process import PX, rows_of


def test_planted_failures_leave_the_others_alone(spark, small):
    run = lambda planted: {r.image_id: r.asDict() for r in queries_delivery.delivered_images(spark, small, planted=planted).collect()}
    clean, got = run(False), run(True)
    assert len(got) == len(clean) == 200 and all(r["status"] == "completed" and r["stage"] is None and r["error"] is None for r in clean.values())
    for i, r in got.items():
        stopped, wrong = i % 13 == 0, i % 17 == 0 or i % 19 == 0
        if not stopped and not wrong:
            assert r == clean[i]
        elif stopped and i % 2:
            assert (r["status"], r["stage"], r["format"], r["output_bytes"], r["kept"]) == ("failed", "compressing", None, None, False) and r["error"] and "the encoder stopped" in " ".join(r["warnings"])
        elif stopped:
            assert r["status"] == "completed" and r["format"] in ("png", r["format"] if r["kept"] else "png") and any("the encoder stopped" in w for w in r["warnings"])
        else:
            assert r["status"] == "completed" and (r["kept"] or r["format"] == "png") and r["ssim"] == 1.0 and any("lossless PNG instead" in w for w in r["warnings"])
    for r in clean.values():
        assert 0 < r["ssim"] <= 1 and r["measured"] > 0 and r["output_bytes"] > 0
        assert not r["kept"] or r["output_bytes"] <= r["original_bytes"]
        assert r["kept"] or r["ssim"] >= 0.9
    assert len({(r["format"], r["kept"]) for r in clean.values()}) > 2


def test_a_python_encoder_fails_alone(spark):
    def encode(image, candidate, level, final):
        """Coarser colours at lower levels; some images stop the encoder, one comes out too small."""
        if image[0, 0, 0] == 7:
            raise RuntimeError("stuck")
        if image[0, 0, 0] == 9:
            return 10, image[:-1]
        step = 1 if "lossless" in candidate else max(1, (104 - level) // 4)
        made = image.copy()
        made[..., :3] = made[..., :3] // step * step
        return 100 + 2000 // step, made

    rng = np.random.default_rng(4)
    images = {i: rng.integers(0, 256, (20, 24, 4)) for i in range(4)}
    for i, v in images.items():
        v[..., 3], v[0, 0, 0] = 255, (0, 7, 9, 0)[i]
    images[3][:10, :, 3] = 200
    px = spark.createDataFrame([r for i, v in images.items() for r in rows_of(i, v)], PX)
    sources = spark.createDataFrame([(i, "jpeg", 100_000, None) for i in images], "image_id long, source_format string, original_bytes long, stripped_bytes long")
    stored = {}

    def encoders(final):
        stored["px"] = final
        return delivery.by_function(encode)(final)

    def inspect(chosen):
        decoded = stored["px"].join(chosen.select("image_id"), "image_id", "left_semi")
        info = decoded.groupBy("image_id", "w", "h").agg(F.lit(True).alias("alpha")).join(chosen, "image_id")
        return info.select("image_id", F.lit(5).alias("size"), F.col("format").alias("found"), "w", "h", "alpha", F.lit(None).cast("string").alias("error")), decoded

    options = process.Options(remove_background=False, crop=False, resize=False, format="jpeg", preset="balanced")
    got = {r.image_id: r for r in delivery.deliver(px, sources, encoders, inspect, options).collect()}
    assert [(got[i].status, got[i].stage) for i in range(4)] == [("completed", None), ("failed", "compressing"), ("failed", "compressing"), ("completed", None)]
    assert "RuntimeError: stuck" in " ".join(got[1].warnings) and "decoded to 24×19" in " ".join(got[2].warnings)
    assert got[0].format == "jpeg" and not got[0].warnings and got[0].output_bytes < 2100 and got[0].ssim == 1.0
    assert "laid on white" in got[3].warnings[0] and got[3].format == "jpeg"


def test_custom_quality_and_a_missing_answer(spark):
    image = np.full((4, 4, 4), 255)
    px = spark.createDataFrame(rows_of(0, image), PX)
    sources = spark.createDataFrame([(0, "png", 10, 8), (1, "png", 10, 8)], "image_id long, source_format string, original_bytes long, stripped_bytes long")
    asked = []

    def encoders(final):
        def measure(requests):
            asked.extend(tuple(r) for r in requests.collect())
            return requests.withColumns({"bytes": F.lit(50), "ssim": F.lit(0.5), "worst": F.lit(0.5)})

        return measure

    options = process.Options(remove_background=False, crop=False, resize=False, format="webp", preset="custom")
    nothing = lambda chosen: (spark.createDataFrame([], "image_id long, size int, found string, w int, h int, alpha boolean, error string"), px.limit(0))
    got = {r.image_id: r for r in delivery.deliver(px, sources, encoders, nothing, options, quality=61.0).collect()}
    assert {(c, n, final) for _, c, n, final in asked} >= {("webp-lossless", 61, True)} and all(final for *_, final in asked)
    assert (got[1].status, got[1].stage, got[1].error) == ("failed", "preparing", "no pixels")
    assert got[0].format == "png" and got[0].warnings[-1].endswith("lossless PNG instead")  # nobody read the file, so it is not handed out


MODELS = Registry([Model("a", "A"), Model("b", "B", "a"), Model("c", "C", "b"), Model("g", "G", "a", True), Model("x", "X", "y"), Model("y", "Y", "x")])


def runner(gone, broken, log):
    def run(requests):
        rows = requests.collect()
        log.extend((r.image_id, r.model) for r in rows)
        told = requests.select("image_id", F.when(F.col("model").isin(*gone), F.concat("model", F.lit(" is down"))).when(F.col("image_id").isin(*broken), "hurt").alias("error"), F.col("model").isin(*gone).alias("unavailable"))
        good = requests.filter(~F.col("model").isin(*gone) & ~F.col("image_id").isin(*broken))
        return good.select("image_id", F.lit(1).alias("w"), F.lit(1).alias("h"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0.5).alias("p")), told

    return run


@pytest.mark.parametrize("gone,want", [([], "abcbax"), (["c"], "abbbax"), (["c", "b"], "aaaaax"), (["a"], "-bcb-x"), (["x", "y"], "abcba-")])
def test_models_with_fallbacks(spark, gone, want):
    asked = [(i, m) for i in range(0, 60, 6) for i, m in zip(range(i, i + 6), "abcbgx")]
    log = []
    masks, told = segmentation.segment(spark.createDataFrame([*asked, (99, "none"), (98, None)], "image_id long, requested string"), runner(gone or ["-"], [7], log), MODELS)
    got = {r.image_id: r for r in told.collect()}
    assert len(got) == 62 and got[99].error == "unknown model: none" and got[98].error == "unknown model: none" and got[99].asked == 0
    for i, m in asked:
        final = want["abcbgx".index(m)] if m != "b" else want[1]
        if i == 7 and final != "-":
            assert got[i].error == "hurt" and got[i].model is None
        else:
            assert (got[i].model or "-") == final and (got[i].error is None) == (final != "-")
            assert (got[i].warning is not None) == (final not in ("-", m))
    for m in gone:  # a model that is down is asked for one image
        assert sum(model == m for _, model in log) == 1
    assert len(set(log)) == len(log)
    assert {r.image_id for r in masks.collect()} == {i for i, r in got.items() if r.error is None}
    if gone == ["c"]:
        assert got[2].warning == "B in place of C: c is down" and got[4].warning == "A in place of G: it needs a GPU"


def test_models_of_no_image_and_the_registry(spark):
    masks, told = segmentation.segment(spark.createDataFrame([], "image_id long, requested string"), runner(["-"], [], []), MODELS)
    assert masks.count() == told.count() == 0
    held = MODELS.register(Model("a", "New")).register(Model("n", "N", "a"))
    assert held.get("a").label == "New" and held.chain("n") == ["n", "a"] and MODELS.get("a").label == "A" and MODELS.chain("x") == ["x", "y"]
    with pytest.raises(KeyError):
        held.get("nothing")


def test_background_removal_in_the_pipeline(spark):
    image = np.full((12, 12, 4), 255)
    image[3:9, 3:9, :3] = 0
    px = spark.createDataFrame([r for i in range(4) for r in rows_of(i, image)], PX)
    sources = spark.createDataFrame([(i, "png") for i in range(4)], "image_id long, source_format string")

    def segment(own):
        ids = own.select("image_id").distinct()
        mask = ids.filter("image_id < 2").select("image_id", F.lit(12).alias("w"), F.lit(12).alias("h"), F.explode(F.sequence(F.lit(0), F.lit(143))).alias("i"))
        masks = mask.select("image_id", "w", "h", (F.col("i") % 12).alias("x"), F.floor(F.col("i") / 12).cast("int").alias("y")).withColumn("p", (F.col("x").between(3, 8) & F.col("y").between(3, 8)).cast("double"))
        return masks, ids.filter("image_id < 3").select("image_id", F.when(F.col("image_id") == 1, "second model").alias("warning"), F.when(F.col("image_id") == 2, "no object").alias("error"))

    final, rows = process.process(px, sources, process.Options(refine=False, padding=0, resize=False), segment=segment)
    got = {r.image_id: r for r in rows.collect()}
    assert [(got[i].status, got[i].error, got[i].warnings) for i in range(4)] == [("completed", None, []), ("completed", None, ["second model"]), ("failed", "no object", []), ("failed", "the model gave no answer", [])]
    assert all(got[i].background_removed and got[i].cropped and got[i].width < 12 for i in (0, 1)) and {r.image_id for r in final.select("image_id").distinct().collect()} == {0, 1}
