"""Event operators. Each says how it runs on a stream; all run on batches.

debounce (append mode with `lateness`, else update), latest and job_state (update mode) and answered
(append mode with `lateness`) are the same code for both. drop_stale needs all events of a key, so
streams have drop_stale_within, which keeps the newest generation of each key until the key has been quiet
for a horizon, and drop_stale_stream, which keeps it for ever.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

from rasterspark.functions.text import sniff_format


def debounce(events: DataFrame, gap: str, key: str = "user_id", lateness: str | None = None) -> DataFrame:
    """The last event of every burst: events of a key closer than the gap count as one."""
    if lateness:
        events = events.withWatermark("ts", lateness)
    return events.groupBy(key, F.session_window("ts", gap).alias("burst")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.max(F.struct("ts", "event_id")).getField("event_id").alias("event_id"))


def latest(events: DataFrame, key: str) -> DataFrame:
    """The newest event of each key."""
    return events.groupBy(key).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m")).select(key, "m.event_id", "m.event_type")


def drop_stale(events: DataFrame, key: str, generation: str) -> DataFrame:
    """Events of each key's newest generation."""
    newest = events.groupBy(key).agg(F.max(generation).alias("_newest"))
    return events.join(newest, key).filter(F.col(generation) == F.col("_newest")).drop("_newest")


def drop_stale_stream(events: DataFrame, key: str, generation: str) -> DataFrame:
    """Events of a stream, in append mode, but for those of a generation older than one already seen for their key.

    In a micro-batch the newest generation counts, as in drop_stale; an event let through by an earlier
    micro-batch can't be taken back. The state is one value a key. Null generations are dropped.
    """
    kinds = dict(events.dtypes)

    def run(_, batches, state):
        rows = pd.concat(list(batches))
        newest = rows[generation].max()
        if state.exists:
            held = state.get[0]
            newest = held if pd.isna(newest) else max(newest, held)
        if not pd.isna(newest):
            state.update((newest,))
        yield rows[rows[generation] == newest]

    return events.groupBy(key).applyInPandasWithState(run, events.schema, f"newest {kinds[generation]}", "append", GroupStateTimeout.NoTimeout)


def drop_stale_within(events: DataFrame, key: str, generation: str, horizon_s: int, lateness: str, time: str = "ts") -> DataFrame:
    """As drop_stale_stream, with state that ends: a key is forgotten once the watermark is `horizon_s` seconds beyond its
    newest event. What arrives later than the watermark is not judged: it comes out with `late`, so that it can be counted,
    and changes no state. A key that comes back after it was forgotten begins anew.
    """
    kinds = dict(events.dtypes)
    timed = events.withWatermark(time, lateness).withColumn("_ms", F.unix_millis(time))

    def run(_, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        late = rows["_ms"] < state.getCurrentWatermarkMs()
        told = rows.drop(columns="_ms").assign(late=late)
        if late.any():
            yield told[late]
        if late.all():
            return
        own = told[~late]
        newest, seen = own[generation].max(), int(rows["_ms"].max())
        if state.exists:
            held, before = state.get
            if before + 1000 * horizon_s >= state.getCurrentWatermarkMs():  # else it is over, though its time-out comes after this
                newest, seen = held if pd.isna(newest) else newest if pd.isna(held) else max(newest, held), max(seen, before)
        state.update((None if pd.isna(newest) else newest, seen))
        state.setTimeoutTimestamp(max(seen + 1000 * horizon_s, state.getCurrentWatermarkMs() + 1))
        yield own[own[generation] == newest]

    return timed.groupBy(key).applyInPandasWithState(run, StructType([*events.schema, StructField("late", BooleanType())]), f"newest {kinds[generation]}, seen long", "append", GroupStateTimeout.EventTimeTimeout)


def answered(requests: DataFrame, responses: DataFrame, timeout: str, lateness: str | None = None) -> DataFrame:
    """requests (request_id, ts) with the response's time, if one came within the timeout (left outer join).

    On streams, both sides get a watermark, so unanswered requests come out once it has passed.
    """
    q, a = requests.withColumnRenamed("ts", "asked"), responses.select(F.col("request_id").alias("_id"), F.col("ts").alias("answered"))
    if lateness:
        q, a = q.withWatermark("asked", lateness), a.withWatermark("answered", lateness)
    within = (F.col("request_id") == F.col("_id")) & (F.col("answered") >= F.col("asked")) & (F.col("answered") <= F.col("asked") + F.expr(f"interval {timeout}"))
    return q.join(a, within, "left_outer").drop("_id")


def job_state(changes: DataFrame, key: str) -> DataFrame:
    """Changes (key, ts, event_id, status, stage) -> each job's state after its newest change.

    A stage stays until another is named; a job that runs again has its newest start and no finish
    before that. Only partial aggregates, so it runs in update mode on a stream.
    """
    at = F.struct("ts", "event_id")
    over = F.col("status").isin("completed", "failed", "cancelled")
    s = changes.groupBy(key).agg(
        F.max(F.struct("ts", "event_id", "status")).getField("status").alias("status"),
        F.max(F.when(F.col("stage").isNotNull(), F.struct("ts", "event_id", "stage"))).getField("stage").alias("stage"),
        F.max(F.when(F.col("status") == "processing", at)).alias("began"), F.max(F.when(over, at)).alias("ended"),
    )
    return s.select(key, "status", "stage", F.col("began.ts").alias("started_at"), F.when(F.col("began").isNull() | (F.col("ended") > F.col("began")), F.col("ended.ts")).alias("finished_at"))


FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, files_a_trigger: int = 1000) -> DataFrame:
    """A stream of the files that arrive in a folder: path, arrived, n_bytes, format (by their first bytes), content.

    Spark passes over empty files.
    """
    files = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_a_trigger).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("modificationTime").alias("arrived"), F.col("length").alias("n_bytes"), sniff_format(F.col("content")).alias("format"), "content")


def write_once(folder: str):
    """What foreachBatch does with assets (name, content): a folder for each micro-batch, `batch=<id>`, that appears whole.

    A batch that is replayed after a crash finds its folder and writes nothing; one that was cut off while writing
    left hidden files only. The folder is one that all executors share, mounted as a path.
    """
    import os
    import shutil

    from rasterspark.sources.sinks import AssetSink

    def write(batch: DataFrame, number: int) -> None:
        final = os.path.join(folder, f"batch={number}")
        if os.path.exists(final):
            return
        hidden = os.path.join(folder, f".batch={number}")
        shutil.rmtree(hidden, ignore_errors=True)  # of an attempt that was cut off; a stream has one writer
        os.makedirs(hidden)
        batch.sparkSession.dataSource.register(AssetSink)
        batch.write.format("assets").mode("append").save(hidden)
        os.replace(hidden, final)

    return write


def deliver(assets: DataFrame, folder: str, checkpoint: str, **trigger):
    """Starts a stream of assets (name, content) into folders by micro-batch, each written once; trigger as of writeStream."""
    return assets.select("name", "content").writeStream.foreachBatch(write_once(folder)).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
