"""The compression search as rounds that measure only the levels it asks for.

A candidate's encoder and the comparison of what it makes are the caller's: `measure` gets a DataFrame of
requests (image_id, candidate, level, final) and returns their answers, one row for each at most: the same
four columns with bytes, ssim and worst, or an error. What a search asks for next follows from what it has been
told, so the state of a candidate is the map of its answers, and one expression over it gives the next level.

A round sends the open candidates of all images at once, joins the answers, works out the next requests and
writes the frontier, so a lost executor costs one round at most. Decided candidates leave the frontier; it only
shrinks. A lossy candidate asks nine times at most (seven halvings, and the final encodes), a palette once for
each of its sizes and once more, all others once; the number of images does not change the number of rounds.

Candidates of an image are searched side by side, and `search.compress` then chooses over what was measured: it
gives up a candidate early where an earlier one is much smaller, which only shortens a search, never asks for
more. Fallbacks are measured for the images alone that reach no target without them. An encoder that fails takes
its candidate out, with the reason; an image without any candidate left has an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterspark.functions.lineage import bulky, cut
from rasterspark.plans import search
from rasterspark.plans.search import FINAL, let

ANSWERS = "map<int,struct<bytes:bigint,ssim:double,worst:double>>"
#: Palettes ask most often: all sizes, and the final encode.
MOST = len(search.PALETTE_STEPS) + 1
SETTINGS = ("kind", "lo", "hi", "tolerance", "most")


class Asked:
    """What a candidate's search wants to know next, from the answers it has: a level, FINAL + level, or null."""

    def __init__(self, answers: Column, min_ssim: Column, min_worst: Column):
        self.answers, self.min_ssim, self.min_worst = answers, min_ssim, min_worst

    def known(self, key: Column) -> Column:
        return F.try_element_at(self.answers, key.cast("int"))

    def passed(self, key: Column) -> Column:
        """Null while there is no answer."""
        return let(self.known(key), lambda a: (a["ssim"] >= self.min_ssim) & (a["worst"] >= self.min_worst))

    def once(self, key: Column) -> Column:
        return F.when(self.known(key).isNull(), key.cast("int"))

    def palette(self, steps: Column) -> Column:
        """Down the sizes until one fails, then the last good one for good."""
        start = F.struct(F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("ask"), F.lit(False).alias("over"))

        def step(s, colours):
            colours = colours.cast("int")
            told = lambda ok: F.struct(F.when(ok, colours).otherwise(s["good"]).alias("good"), F.when(ok.isNull(), colours).alias("ask"), F.coalesce(~ok, F.lit(True)).alias("over"))
            return F.when(s["over"], s).otherwise(let(self.passed(colours), told))

        return F.aggregate(steps, start, step, lambda s: F.coalesce(s["ask"], self.once(s["good"] + FINAL)))

    def lossy(self, low: Column, high: Column, tolerance: Column, most: Column) -> Column:
        """Halving, then the ceiling if nothing passed, then the final encodes."""
        empty = F.lit(None).cast("int")
        start = F.struct(low.cast("int").alias("lo"), high.cast("int").alias("hi"), empty.alias("good"), F.lit(None).cast("long").alias("size"), empty.alias("ask"))

        def step(s, _):
            mid = F.floor((s["lo"] + s["hi"]) / 2 + 0.5).cast("int")

            def told(ok):
                size = self.known(mid)["bytes"]
                smaller = ok & (s["good"].isNull() | (size < s["size"]))
                return F.struct(
                    F.when(~ok, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(ok, mid - 1).otherwise(s["hi"]).alias("hi"), F.when(smaller, mid).otherwise(s["good"]).alias("good"),
                    F.when(smaller, size).otherwise(s["size"]).alias("size"), F.when(ok.isNull(), mid).alias("ask"),
                )

            return F.when(s["ask"].isNotNull() | (s["hi"] - s["lo"] < tolerance), s).otherwise(let(self.passed(mid), told))

        def final(level):
            above = F.least(high, level + tolerance + 1).cast("int") + FINAL
            return let(self.passed(level + FINAL), lambda ok: F.when(ok.isNull(), level + FINAL).when(~ok & (level < high), self.once(above)))

        def end(s):
            ceiling = let(self.passed(high), lambda ok: F.when(ok.isNull(), high.cast("int")).when(ok, final(high.cast("int"))).otherwise(self.once(high + FINAL)))
            return F.coalesce(s["ask"], F.when(s["good"].isNotNull(), final(s["good"])).otherwise(ceiling))

        return F.aggregate(F.sequence(F.lit(1), most), start, step, end)


def _next() -> Column:
    """The next key of a row of the frontier."""
    c = {n: F.col(n) for n in SETTINGS}
    asked = Asked(F.col("answers"), F.col("min_ssim"), F.col("min_worst"))
    fixed = F.when(c["kind"] == "palette", search.fixed_colours(F.col("custom"))).otherwise(search.fixed_quality(F.col("custom"))) + FINAL
    return (
        F.when(F.col("custom").isNotNull(), asked.once(fixed)).when(c["kind"] == "lossless", asked.once(F.lit(100 + FINAL)))
        .when(c["kind"] == "palette", asked.palette(F.col("steps"))).otherwise(asked.lossy(c["lo"], c["hi"], c["tolerance"], c["most"]))
    )


def frontier(images: DataFrame, group: str) -> DataFrame:
    """A row for each candidate of an image's group, nothing asked yet."""
    one = images.select("image_id", "custom", "min_ssim", "min_worst", "steps", F.posexplode(group).alias("place", "c"))
    return one.select("image_id", "custom", "min_ssim", "min_worst", "steps", F.lit(group).alias("group"), "place", "c.candidate", *(f"c.{n}" for n in SETTINGS))


Measure = Callable[[DataFrame], DataFrame]


def asked_for(rows: DataFrame, measure: Measure) -> DataFrame:
    """A frontier -> its rows with all answers that their searches asked for, and an error where one failed."""
    state = rows.withColumn("answers", F.create_map().cast(ANSWERS)).withColumn("error", F.lit(None).cast("string"))
    state = cut(state.withColumn("ask", _next()))
    columns, settled = state.columns, None
    for _ in range(MOST + 1):
        done = state.filter("ask is null")
        settled = done if settled is None else settled.unionByName(done)
        state = state.filter("ask is not null")
        if state.isEmpty():
            break
        requests = state.select("image_id", "candidate", (F.col("ask") % FINAL).alias("level"), (F.col("ask") >= FINAL).alias("final"))
        told = measure(requests)
        told = told if "error" in told.columns else told.withColumn("error", F.lit(None).cast("string"))
        told = told.select("image_id", "candidate", F.col("bytes").cast("long").alias("_bytes"), F.col("ssim").cast("double").alias("_ssim"), F.col("worst").cast("double").alias("_worst"), F.col("error").alias("_error"))
        met = bulky(state).join(told, ["image_id", "candidate"], "left")
        good = F.col("_bytes").isNotNull() & F.col("_ssim").isNotNull() & F.col("_worst").isNotNull() & F.col("_error").isNull()
        answer = F.create_map("ask", F.struct(F.col("_bytes").alias("bytes"), F.col("_ssim").alias("ssim"), F.col("_worst").alias("worst")))
        met = met.withColumn("answers", F.when(good, F.map_concat("answers", answer)).otherwise(F.col("answers")))
        met = met.withColumn("error", F.when(~good, F.coalesce("_error", F.lit("no answer"))))
        state = cut(met.withColumn("ask", F.when(good, _next())).select(*columns))
    return settled


def _arrays(images: DataFrame, found: DataFrame) -> DataFrame:
    """images with the candidates that were measured in full, in their order, and the sums over all requests."""
    own = F.struct("place", "candidate", *SETTINGS, F.col("answers").alias("attempts"))
    listed = lambda g: F.transform(F.array_sort(F.collect_list(F.when((F.col("group") == g) & F.col("error").isNull(), own)), lambda a, b: a["place"] - b["place"]), lambda c: c.dropFields("place"))
    told = found.groupBy(F.col("image_id").alias("_id")).agg(
        listed("primary").alias("primary"), listed("fallback").alias("fallback"), F.sum(F.size("answers")).alias("measured"), F.max(F.size("answers")).alias("most_measured"),
        F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.concat("candidate", F.lit(": "), "error")))).alias("failed"),
    )
    none = F.array().cast(dict(told.dtypes)["primary"])
    met = bulky(images.drop("primary", "fallback")).join(told, F.col("image_id") == F.col("_id"), "left").drop("_id")
    return met.withColumns({c: F.coalesce(c, none) for c in ("primary", "fallback")})


def compress(images: DataFrame, measure: Measure) -> DataFrame:
    """images as of `search.compress`, their candidates without attempts -> its columns, and measured (answers in all),
    most_measured (of one candidate), failed (candidates whose encoder failed, with the reason).

    image_id is unique, and so is a candidate's name in an image. An image without candidates has an error.
    """
    images = cut(images)
    first = asked_for(frontier(images, "primary"), measure)
    chosen = search.compress(_arrays(images, first)).select("image_id", F.coalesce("best.passed", F.lit(False)).alias("_done"))
    short = bulky(images).join(chosen.filter("_done"), "image_id", "left_anti")
    every = _arrays(images, first.unionByName(asked_for(frontier(short, "fallback"), measure)))
    counts = every.select("image_id", F.coalesce("measured", F.lit(0).cast("long")).alias("measured"), F.coalesce("most_measured", F.lit(0)).alias("most_measured"), F.coalesce("failed", F.array().cast("array<string>")).alias("failed"))
    return bulky(search.compress(every)).join(counts, "image_id")
