"""Streams in their modes, files that arrive, and the asset sink."""

import datetime
import zipfile

from pyspark.sql import functions as F

from rasterspark.sources import archive
from rasterspark.sources.sinks import AssetSink
from rasterspark.streaming import events


def run(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def batches(spark, folder, rows, schema):
    """One file for each list of rows, read one a micro-batch."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_stale_events_of_a_stream(spark, tmp_path):
    rows = [[(1, "a", 1), (2, "a", 2), (3, "b", 5)], [(4, "a", 1), (5, "a", 2), (6, "b", None), (7, "c", None)], [(8, "a", 3), (9, "b", 4), (10, "a", 2)]]
    schema = "event_id long, user_id string, generation long"
    got = run(events.drop_stale_stream(batches(spark, tmp_path, rows, schema), "user_id", "generation"), "append", "stale")
    assert sorted(r.event_id for r in got) == [2, 3, 5, 8]
    whole = events.drop_stale(spark.createDataFrame([r for part in rows for r in part], schema), "user_id", "generation").collect()
    assert sorted(r.event_id for r in whole) == [3, 8]


def test_latest_and_job_state_in_update_mode(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [[(1, "a", at(1), "click")], [(3, "a", at(3), "view"), (2, "a", at(2), "error")]]
    schema = "event_id long, user_id string, ts timestamp, event_type string"
    got = run(events.latest(batches(spark, tmp_path / "x", rows, schema), "user_id"), "update", "latest")
    assert got[-1].event_id == 3
    changes = batches(spark, tmp_path / "y", rows, schema).select("event_id", "user_id", "ts", F.lit("processing").alias("status"), F.col("event_type").alias("stage"))
    assert run(events.job_state(changes, "user_id"), "update", "jobs")[-1].stage == "view"


def test_arriving_files(spark, tmp_path):
    for name, content in (("a.bin", b"\x89PNG\r\n\x1a\nrest"), ("b.bin", b"\xff\xd8\xff\xe0"), ("c.bin", b"")):
        (tmp_path / name).write_bytes(content)
    got = run(events.arriving(spark, str(tmp_path), 1), "append", "arrivals")
    assert sorted((r.path.rsplit("/", 1)[1], r.format, r.n_bytes, bytes(r.content)[:2]) for r in got) == [("a.bin", "png", 12, b"\x89P"), ("b.bin", "jpeg", 4, b"\xff\xd8")]


def test_assets_are_written_as_files_and_stored_archives(spark, tmp_path):
    spark.dataSource.register(AssetSink)
    assets = spark.createDataFrame([(f"n{i}.png", bytes([i]) * i) for i in range(7)] + [("null.png", None)], "name string, content binary")
    assets.repartition(3).write.format("assets").mode("append").save(str(tmp_path / "files"))
    found = {p.name: p.read_bytes() for p in (tmp_path / "files").iterdir()}
    assert found == {f"n{i}.png": bytes([i]) * i for i in range(7)} | {"null.png": b""}
    assets.repartition(2).write.format("assets").option("zip", "all").mode("append").save(str(tmp_path / "zips"))
    held = {}
    for p in (tmp_path / "zips").iterdir():
        with zipfile.ZipFile(p) as z:
            assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
            held |= {n: z.read(n) for n in z.namelist()}
    assert held == found


def test_one_archive_of_many_tasks(spark, tmp_path):
    rows = [(f"d/é{i:03d}.bin", bytes([i % 251]) * (i * 7 % 300)) for i in range(240)] + [("null.bin", None)]
    assets = spark.createDataFrame(rows, "name string, content binary").repartition(7)
    want = {n: c or b"" for n, c in rows}
    for most in (archive.MOST, 100):  # the short form, and ZIP64
        path = tmp_path / f"all{most}.zip"
        assert archive.write_archive(assets, str(path), most, 5) == len(rows)
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and z.namelist() == sorted(want) and {n: z.read(n) for n in z.namelist()} == want
            assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
    first = (tmp_path / "all100.zip").read_bytes()
    archive.write_archive(assets.repartition(3), f"file:{tmp_path}/all100.zip", 100, 9)  # equal assets, equal archives
    assert (tmp_path / "all100.zip").read_bytes() == first and [p.name for p in tmp_path.iterdir() if p.name.startswith(".")] == []
    assert archive.write_archive(assets.limit(0), str(tmp_path / "empty.zip")) == 0 and zipfile.ZipFile(tmp_path / "empty.zip").namelist() == []


def test_replayed_batches_write_nothing_twice(spark, tmp_path):
    folder, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    folder.mkdir()

    def arrive(*names):
        for n in names:
            (folder / n).write_bytes(n.encode() * 3)
        assets = events.arriving(spark, str(folder), 2).select(F.concat(F.element_at(F.split("path", "/"), -1), F.lit(".out")).alias("name"), F.upper(F.decode("content", "UTF-8")).cast("binary").alias("content"))
        events.deliver(assets, str(out), str(check)).awaitTermination()

    arrive("a", "b", "c")
    found = lambda: {f.name: (f.read_bytes(), f.stat().st_mtime_ns) for f in out.glob("batch=*/*") if not f.name.startswith(".")}
    before = found()
    assert {n: c for n, (c, _) in before.items()} == {f"{n}.out": n.upper().encode() * 3 for n in "abc"}
    # a crash after the batch was written and before Spark noted it; and one while the next was being written
    last = max((check / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    for crc in (check / "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    half = out / f".batch={int(last.name) + 1}"
    half.mkdir()
    (half / "half.out").write_bytes(b"cut off")
    arrive("d")
    after = found()
    assert {n: after[n] for n in before} == before and set(after) == {*before, "d.out"} and not half.exists()


def test_state_that_ends(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = [
        [(1, "a", at(0), 2), (2, "a", at(1), 1), (3, "b", at(1), 7), (4, "n", at(1), None)],
        [(5, "a", at(2), 1), (6, "a", at(3), 2)],
        [(7, "c", at(200), 1)],  # the watermark passes everybody's horizon
        [(8, "a", at(5), 9), (9, "a", at(201), 1), (10, "c", at(202), 1)],  # 8 is late; a begins anew
        [(11, "z", at(900), 1)], [(12, "z", at(901), 1)],
    ]
    schema = "event_id long, user_id string, ts timestamp, generation long"
    df = events.drop_stale_within(batches(spark, tmp_path / "in", rows, schema), "user_id", "generation", 600, "1 minute")
    q = df.writeStream.outputMode("append").format("memory").queryName("ending").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("ending").collect()
    assert sorted(r.event_id for r in got if not r.late) == [1, 3, 6, 7, 9, 10, 11, 12] and [r.event_id for r in got if r.late] == [8]
    states = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    assert max(s["numRowsTotal"] for s in states) >= 3 and states[-1]["numRowsTotal"] == 1


def test_answers_on_streams_are_those_of_a_batch(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    asked = [[(i, at(i * 10)) for i in range(k, k + 20)] for k in range(0, 100, 20)]
    replies = [[(i, at(i * 10 + d)) for i in range(k, k + 20) for d in [(-5, 3, 40, 70)[i % 4]]] for k in range(0, 100, 20)]
    schema = "request_id long, ts timestamp"
    frame = lambda rows: spark.createDataFrame([r for part in rows for r in part], schema)
    whole = {(r.request_id, r.answered) for r in events.answered(frame(asked), frame(replies), "60 seconds").collect()}
    assert len(whole) == 100 and sum(a is None for _, a in whole) == 50
    stream = events.answered(batches(spark, tmp_path / "q", asked, schema), batches(spark, tmp_path / "a", replies, schema), "60 seconds", lateness="30 seconds")
    got = {(r.request_id, r.answered) for r in run(stream, "append", "answers")}
    assert got <= whole
    # what is missing: requests still open when the streams ended, within timeout and lateness of the newest event
    newest = max(t for part in (*asked, *replies) for _, t in part)
    assert all(a is None and at(i * 10) >= newest - datetime.timedelta(seconds=250) for i, a in whole - got)
