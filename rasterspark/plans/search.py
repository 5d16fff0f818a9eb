"""The search for the smallest encoding that looks good enough, over measured attempts.

An encoder's attempts are a map from level to (bytes, ssim, worst), quick ones under the level and
final ones under FINAL + level. The searches are folds over arrays inside a row: Spark evaluates them
in place, without a shuffle, a Python worker, or a row for each attempt. An outcome is null if
nothing is usable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The palette sizes that are tried, and how much larger than the best a failing attempt may be.
PALETTE_STEPS, MARGIN = [256, 192, 128, 96, 64, 48, 32, 24, 16, 8], 1.12
FINAL = 1000
OUTCOME = "struct<level:int,final:boolean,bytes:bigint,ssim:double,worst:double,passed:boolean,pruned:boolean>"


def none() -> Column:
    return F.lit(None).cast(OUTCOME)


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class Search:
    """One encoder's attempts under a target. custom: any attempt counts as passed."""

    def __init__(self, attempts: Column, min_ssim: Column, min_worst: Column, prune_at: Column):
        self.attempts, self.min_ssim, self.min_worst, self.prune_at = attempts, min_ssim, min_worst, prune_at

    def attempt(self, level: Column, final: bool = False, near: bool = False) -> Column:
        """The outcome at a level; null if it was not measured. near: a near miss counts as passed."""
        slack = (0.003, 0.015) if near else (0.0, 0.0)
        passed = lambda a: (a["ssim"] >= self.min_ssim - slack[0]) & (a["worst"] >= self.min_worst - slack[1])
        made = lambda a: F.struct(level.cast("int").alias("level"), F.lit(final).alias("final"), a["bytes"].cast("long").alias("bytes"), a["ssim"].alias("ssim"), a["worst"].alias("worst"), passed(a).alias("passed"), F.lit(False).alias("pruned"))
        return let(F.try_element_at(self.attempts, level.cast("int") + (FINAL if final else 0)), lambda a: F.when(a.isNotNull(), made(a))).cast(OUTCOME)

    def hopeless(self, a: Column) -> Column:
        return ~a["passed"] & (a["bytes"] > self.prune_at)

    def lossless(self) -> Column:
        return self.attempt(F.lit(100), final=True)

    def fixed(self, level: Column) -> Column:
        return self.attempt(level, final=True).withField("passed", F.lit(True))

    def palette(self, steps: Column) -> Column:
        """Down the steps until one fails; the last that passed, encoded for good if that is no larger."""
        start = F.struct(none().alias("best"), none().alias("stop"), F.lit(False).alias("over"))

        def step(s, colors):
            def met(a):
                stop = F.when(self.hopeless(a), a.withField("pruned", F.lit(True))).otherwise(s["stop"]).cast(OUTCOME)
                return F.struct(F.when(a["passed"], a).otherwise(s["best"]).cast(OUTCOME).alias("best"), stop.alias("stop"), F.coalesce(~a["passed"], F.lit(True)).alias("over"))

            return F.when(s["over"], s).otherwise(let(self.attempt(colors), met))

        def end(s):
            last = let(self.attempt(s["best"]["level"], final=True), lambda f: F.when(f["passed"] & (f["bytes"] <= s["best"]["bytes"]), f).otherwise(s["best"]))
            return F.when(s["stop"].isNotNull(), s["stop"]).when(s["best"].isNotNull(), last)

        return F.aggregate(steps, start, step, end)

    def lossy(self, low: Column, high: Column, tolerance: Column, most: Column) -> Column:
        """Binary search for the lowest quality that passes, then the final encode there or a little above."""
        start = F.struct(low.cast("int").alias("lo"), high.cast("int").alias("hi"), none().alias("best"), none().alias("stop"))

        def step(s, _):
            mid = F.floor((s["lo"] + s["hi"]) / 2 + 0.5).cast("int")

            def met(a):
                smaller = a["passed"] & (s["best"].isNull() | (a["bytes"] < s["best"]["bytes"]))
                return F.struct(
                    F.when(a["passed"], s["lo"]).otherwise(a["level"] + 1).alias("lo"), F.when(a["passed"], a["level"] - 1).otherwise(s["hi"]).alias("hi"),
                    F.when(smaller, a).otherwise(s["best"]).cast(OUTCOME).alias("best"), F.when(self.hopeless(a), a.withField("pruned", F.lit(True))).cast(OUTCOME).alias("stop"),
                )

            return F.when(s["stop"].isNotNull() | (s["hi"] - s["lo"] < tolerance), s).otherwise(let(self.attempt(mid), met))

        def finish(p):
            above = F.least(high, p["level"] + tolerance + 1)
            first = self.attempt(p["level"], final=True)
            second = let(first, lambda f: F.when(~f["passed"] & (p["level"] < high), self.attempt(above, final=True)).otherwise(f))
            return let(second, lambda f: F.when(f["passed"] & (f["bytes"] <= p["bytes"]), f).otherwise(p))

        def end(s):
            ceiling = lambda top: F.when(self.hopeless(top), top.withField("pruned", F.lit(True))).when(~top["passed"], self.attempt(high, final=True, near=True)).otherwise(finish(top))
            return F.when(s["stop"].isNotNull(), s["stop"]).when(s["best"].isNotNull(), finish(s["best"])).otherwise(let(self.attempt(high), ceiling))

        return F.aggregate(F.sequence(F.lit(1), most), start, step, end)


def palette_steps(least: Column, unique: Column, full: Column) -> Column:
    """The sizes to try: not below the target's least, and only below the image's own number of colours."""
    steps = F.when(full, F.array(F.lit(256))).otherwise(F.array(*map(F.lit, PALETTE_STEPS)))
    return F.filter(steps, lambda c: (c >= least) & (c < unique))


def better(a: Column, b: Column, custom: Column) -> Column:
    """Whether outcome a replaces the best so far, b (null: none yet)."""
    fixed = F.when(a["ssim"] + 0.004 < b["ssim"], False).when(b["ssim"] + 0.004 < a["ssim"], True).otherwise(a["bytes"] < b["bytes"])
    searched = F.when(a["passed"] != b["passed"], a["passed"]).when(~a["passed"], a["ssim"] > b["ssim"]).otherwise(a["bytes"] < b["bytes"])
    return F.when(b.isNull(), True).when(custom, fixed).otherwise(searched)


def fixed_quality(custom: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(100), F.floor(custom + 0.5))).cast("int")


def fixed_colours(custom: Column) -> Column:
    """A palette's size at a fixed quality."""
    return F.greatest(F.lit(2), F.least(F.lit(256), F.floor(F.pow(F.lit(2.0), 1 + fixed_quality(custom) / 100 * 7) + 0.5))).cast("int")


RESULT = OUTCOME.replace("struct<", "struct<candidate:string,")


def compress(images: DataFrame) -> DataFrame:
    """images -> image_id, best (an outcome and its candidate), results (one a candidate, in order), error, warning.

    images: image_id, custom (fixed quality, else null), min_ssim, min_worst, steps (palette sizes), and
    the arrays primary and fallback of candidates in order: struct(candidate, kind: lossless, palette or
    lossy, lo, hi, tolerance, most, attempts). Fallbacks are tried only if no primary candidate
    passed. The best size so far decides which later candidates are given up early.
    """
    custom, ssim, worst = F.col("custom"), F.col("min_ssim"), F.col("min_worst")
    start = F.struct(F.lit(None).cast(RESULT).alias("best"), F.array().cast(f"array<{RESULT}>").alias("results"))

    def outcome(c, best):
        s = Search(c["attempts"], ssim, worst, F.coalesce(best["bytes"] * MARGIN, F.lit(float("inf"))))
        return (
            F.when(custom.isNotNull(), s.fixed(F.when(c["kind"] == "palette", fixed_colours(custom)).otherwise(fixed_quality(custom))))
            .when(c["kind"] == "lossless", s.lossless()).when(c["kind"] == "palette", s.palette(F.col("steps")))
            .otherwise(s.lossy(c["lo"], c["hi"], c["tolerance"], c["most"]))
        )

    def step(s, c):
        def met(o):
            made = F.struct(c["candidate"].alias("candidate"), o["level"].alias("level"), o["final"].alias("final"), o["bytes"].alias("bytes"), o["ssim"].alias("ssim"), o["worst"].alias("worst"), (o["passed"] & ~o["pruned"]).alias("passed"), o["pruned"].alias("pruned"))
            wins = ~o["pruned"] & better(made, s["best"], custom.isNotNull())
            return F.when(o.isNull(), s).otherwise(F.struct(F.when(wins, made).otherwise(s["best"]).cast(RESULT).alias("best"), F.concat(s["results"], F.array(made.cast(RESULT))).alias("results")))

        return let(outcome(c, s["best"]), met)

    first = images.withColumn("s", F.aggregate("primary", start, step))
    done = F.coalesce(F.col("s.best.passed"), F.lit(False))
    second = first.withColumn("s", F.when(done, F.col("s")).otherwise(F.aggregate("fallback", F.col("s"), step)))
    best = F.col("s.best")
    return second.select(
        "image_id", best.alias("best"), F.col("s.results").alias("results"), F.when(best.isNull(), "no encoder produced a result").alias("error"),
        F.when(best.isNotNull() & ~best["passed"], "target not reached").alias("warning"),
    )


def running_best(results: DataFrame) -> DataFrame:
    """results (image_id, pos, bytes, ssim, passed) -> each with the best size before it and whether it was given up.

    A failing candidate larger than MARGIN times the best so far is given up and never the best.
    """
    one = "struct<pos:bigint,bytes:bigint,ssim:double,passed:boolean>"
    out = "struct<pos:bigint,bytes:bigint,before:bigint,pruned:boolean>"
    start = F.struct(F.lit(None).cast(one).alias("best"), F.array().cast(f"array<{out}>").alias("all"))

    def step(s, r):
        pruned = F.coalesce(~r["passed"] & (r["bytes"] > s["best"]["bytes"] * MARGIN), F.lit(False))
        row = F.struct(r["pos"].alias("pos"), r["bytes"].alias("bytes"), s["best"]["bytes"].alias("before"), pruned.alias("pruned"))
        return F.struct(F.when(~pruned & better(r, s["best"], F.lit(False)), r).otherwise(s["best"]).cast(one).alias("best"), F.concat(s["all"], F.array(row.cast(out))).alias("all"))

    ordered = F.array_sort(F.collect_list(F.struct(*(F.col(n).cast(kind).alias(n) for n, kind in (x.split(":") for x in one[7:-1].split(","))))))
    return results.groupBy("image_id").agg(ordered.alias("r")).select("image_id", F.inline(F.aggregate("r", start, step, lambda s: s["all"])))


def ladder(images: DataFrame, candidates: DataFrame, most: int = 64) -> DataFrame:
    """images (image_id, unique_colors, min_palette) x candidates (candidate, kind, lo, hi) -> every level to measure.

    candidates is the engine's own table of encoders, at most `most` rows: it becomes an array that every
    image is exploded by, without a join.
    """
    known = candidates.limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"more than {most} candidates")
    listed = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in ("candidate", "kind", "lo", "hi"))) for r in known))
    levels = F.when(F.col("kind") == "lossless", F.array(F.lit(100))).when(F.col("kind") == "palette", palette_steps(F.col("min_palette"), F.col("unique_colors"), F.lit(False))).otherwise(F.sequence("lo", "hi"))
    met = images.select("*", F.inline(listed))
    return met.select("image_id", "candidate", F.explode(levels).alias("level"))
