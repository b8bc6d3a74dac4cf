import json
import math
import os
import random
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from readlake.sources import readers as X
from readlake.sources.tables import BucketedTable
from readlake.streaming import sessions as R

UPDATES = "reader bigint, book bigint, event_id bigint, ts timestamp, event string, position bigint"


def updates(n=400, seed=4):
    rnd, at = random.Random(seed), datetime(2026, 1, 1, 22)
    rows = []
    for i in range(n):
        at += timedelta(seconds=rnd.choice([0, 0.0003, 5, 60, 600]))
        rows.append((rnd.randrange(3), rnd.randrange(2), i, at, rnd.choice(["start", "update", "update", "update", "pause"]), rnd.randrange(300)))
    return rows


def test_batch_tracker_equals_fold(spark):
    rows = updates()
    got = {(r.reader, r.book, str(r.day)): (r.ms, r.characters) for r in R.track_reading_batch(spark.createDataFrame(rows, UPDATES)).collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        own = [(int(r[3].timestamp() * 1000), r[4], r[5]) for r in rows if r[:2] == key]
        offset = int((rows[0][3] - datetime(1970, 1, 1)).total_seconds() * 1000) - int(rows[0][3].timestamp() * 1000)
        for day, (ms, c) in R.Tracker().feed([(a + offset, b, p) for a, b, p in own]).items():
            want[(*key, str((datetime(1970, 1, 1) + timedelta(days=day)).date()))] = (ms, c)
    assert got == want


def test_session_never_falls_below_zero(spark):
    at = datetime(2026, 1, 1)
    rows = [(0, 0, i, at + timedelta(seconds=i), e, p) for i, (e, p) in enumerate([("start", 100), ("update", 150), ("update", 120), ("update", 0)])]
    assert R.track_reading_batch(spark.createDataFrame(rows, UPDATES)).first().characters == 0


@pytest.fixture
def no_idle_batches(spark):
    """Without this, a stream with processing-time timeouts runs batches without data for ever."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_stream_tracker_equals_batch(spark, tmp_path, no_idle_batches):
    rows = updates()
    for k in range(4):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], UPDATES).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = R.track_reading(stream).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.sql("SELECT reader, book, day, sum(ms), sum(characters) FROM tracked GROUP BY 1, 2, 3").collect()}
    assert got == {tuple(r) for r in R.track_reading_batch(spark.createDataFrame(rows, UPDATES)).collect()}


def frames(*runs, size=500):
    return [(p, size) for p, n in runs for _ in range(n)]


def segments(spark, runs, **limits):
    rows = [(1, i, p, n) for i, (p, n) in enumerate(runs)]
    df = spark.createDataFrame(rows, "recording bigint, ord bigint, probability double, samples bigint")
    return sorted((r.start, r.end, r.hard_cut) for r in R.hysteresis_segments(df, **limits).collect())


def test_hysteresis(spark):
    assert segments(spark, frames((0.1, 3), (0.8, 18), (0.4, 5), (0.2, 17))) == [(1500, 13000, False)]
    assert segments(spark, frames((0.7, 5), (0.3, 17))) == []  # too short
    assert segments(spark, frames((0.4, 50))) == []  # never opens
    assert segments(spark, frames((0.9, 25), (0.1, 16)), cap=10000) == [(0, 10000, True), (10000, 12500, False)]
    assert segments(spark, frames((0.9, 18), (0.1, 4), (0.9, 10)), cap=10000) == [(0, 9000, False), (11000, 16000, False)]  # the cap falls into a silence
    assert segments(spark, frames((0.9, 20), (0.1, 16)), cap=10000) == [(0, 10000, True), (10000, 10000, False)]  # what follows a hard cut is kept
    assert segments(spark, frames((0.9, 12), (0.2, 3))) == [(0, 6000, False)]  # the end closes
    first = R.hysteresis_segments(spark.createDataFrame([(1, 0, 0.9, 20000)], "recording bigint, ord bigint, probability double, samples bigint")).first()
    assert (first.padded_start, first.padded_end) == (0, 24000)


def test_stream_segments_equal_batch(spark, tmp_path, no_idle_batches):
    rnd = random.Random(9)
    schema = "recording bigint, ord bigint, probability double, samples bigint"
    rows = [(k % 2, k, rnd.choice([0.1, 0.1, 0.4, 0.6, 0.9]) if k // 90 % 2 else rnd.choice([0.2, 0.9, 0.9]), 700) for k in range(1200)]
    rows += [(k, 2000 + i, 0.9 if i < 20 else 0.1, 700) for k in (0, 1) for i in range(40)]  # all is closed at the end
    for k in range(0, len(rows), 331):
        spark.createDataFrame(rows[k : k + 331], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k:05}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    how = {"quiet": 2100, "cap": 14000, "least": 1500}
    q = R.hysteresis_segments_stream(stream, **how).writeStream.format("memory").queryName("active").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.sql("SELECT * FROM active").collect()))
    want = sorted(map(tuple, R.hysteresis_segments(spark.createDataFrame(rows, schema), **how).collect()))
    assert got == want and len(want) > 40 and any(r[3] for r in want)


def stitched(spark, *batches):
    schema = "recording bigint, segment_start double, through double, tokens array<struct<text: string, start: double, end: double>>"
    rows = R.stitch_batches(spark.createDataFrame([(1, a, b, t) for a, b, t in batches], schema)).orderBy("ord").collect()
    return [(r.text, r.start, r.end) for r in rows]


def test_stitching(spark):
    one = (0.0, 2.0, [("ta", 0.0, 1.0), ("ki", 1.0, 2.0)])
    assert stitched(spark, one, (1.0, 4.0, [("ki", 1.125, 2.0), ("no", 2.0, 3.0)])) == [("ta", 0.0, 1.0), ("ki", 1.0, 2.0), ("no", 2.0, 3.0)]
    # another word at the same time is no repeat: it gets the time up to the next one
    assert stitched(spark, one, (1.0, 4.0, [("mi", 1.5, 2.0), ("no", 3.0, 4.0)]))[2:] == [("mi", 2.0, 3.0), ("no", 3.0, 4.0)]
    # a single symbol may move less than a phrase
    assert len(stitched(spark, one, (0.0, 4.0, [("ki", 1.5, 2.0), ("no", 3.0, 4.0)]))) == 4
    assert len(stitched(spark, one, (0.0, 4.0, [("ta", 0.5, 1.0), ("ki", 1.5, 2.0), ("no", 3.0, 4.0)]))) == 3
    # a stretch of its own, and batches that add nothing
    assert stitched(spark, one, (9.0, 12.0, [("ki", 9.5, 10.0)]), (9.0, 12.0, [("zu", 11.0, 12.0)]), (13.0, 14.0, []))[2:] == [("ki", 9.5, 10.0)]


def test_upserted_stream(spark, tmp_path):
    schema = "k bigint, v bigint, ord bigint"
    spark.createDataFrame([(1, 1, 1), (2, 5, 1)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")

    def merge(before, batch):
        rows = batch if before is None else before.unionByName(batch)
        return rows.groupBy("k").agg(F.max_by("v", "ord").alias("v"), F.max("ord").alias("ord"))

    table = BucketedTable(spark, f"{tmp_path}/t", ["k"], buckets=8)
    run = lambda: R.upsert_stream(stream, table, merge, f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    run()
    spark.createDataFrame([(1, 9, 2), (2, 4, 0)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    run()
    assert table.versions() == [0, 1] and sorted((r.k, r.v) for r in table.read().collect()) == [(1, 9), (2, 5)]


def test_upsert_writes_what_it_touches(spark, tmp_path):
    """Bytes follow the batch, not the table; a crash between files and manifest loses nothing; a version that is there stays."""
    keep_last = lambda before, batch: (batch if before is None else before.unionByName(batch)).groupBy("k").agg(F.max_by("v", "ord").alias("v"), F.max("ord").alias("ord")).where("v != -1")
    frame = lambda rows: spark.createDataFrame(rows, "k bigint, v bigint, ord bigint")
    table = BucketedTable(spark, f"{tmp_path}/t", ["k"], buckets=16)
    assert table.read() is None
    table.upsert(frame([(k, k, 0) for k in range(500)]), keep_last, 0)
    files = lambda v: sorted(os.listdir(f"{tmp_path}/t/data/v={v}"))
    assert len([f for f in files(0) if f.startswith("bucket=")]) == 16
    table._commit, commit = lambda *a: (_ for _ in ()).throw(OSError("lost")), table._commit
    with pytest.raises(OSError):
        table.upsert(frame([(3, 77, 1), (4, 78, 1)]), keep_last, 1)
    assert table.versions() == [0] and table.read().where("k = 3").first().v == 3
    table._commit = commit
    table.upsert(frame([(3, 30, 1)]), keep_last, 1)
    assert [f for f in files(1) if f.startswith("bucket=")] == [f"bucket={k}" for k, v in table.manifest(1).items() if v == 1] and list(table.manifest(1).values()).count(1) == 1
    table.upsert(frame([(3, 99, 2)]), keep_last, 1)
    assert {r.k: r.v for r in table.read().collect()} == {k: k for k in range(500)} | {3: 30}
    table.upsert(frame([(k, -1, 3) for k in range(500)]), keep_last, 2)
    assert table.manifest(2) == {} and table.read() is None and table.read(1).count() == 500
    table.upsert(frame([(7, 1, 1)]), keep_last, 3)
    table.vacuum(keep=1)
    assert table.versions() == [3] and [r.k for r in table.read().collect()] == [7] and sorted(os.listdir(f"{tmp_path}/t/data")) == ["v=3"]
    with pytest.raises(ValueError):
        BucketedTable(spark, f"{tmp_path}/t", ["k"], buckets=4).read()


def test_stitched_stream_equals_batches(spark, tmp_path, no_idle_batches):
    """Random splits over micro-batches; a batch that comes late is ignored."""
    rnd = random.Random(3)
    schema = "recording bigint, segment_start double, through double, tokens array<struct<text: string, start: double, end: double>>"
    rows = []
    for recording in range(6):
        words, at = [rnd.choice("abcd") + rnd.choice("xyz") for _ in range(60)], 0
        while at < 60:
            n = rnd.randrange(3, 12)
            drift = rnd.choice([0, 0.125, 0.25])
            heard = [(words[k], k * 0.5 + drift, k * 0.5 + drift + 0.5) for k in range(max(0, at - 2), min(60, at + n))]
            rows.append((recording, heard[0][1], heard[-1][2], heard))
            at += n
    want = sorted(map(tuple, R.stitch_batches(spark.createDataFrame(rows, schema)).collect()))
    late = (0, 0.0, 1.0, [("late", 0.0, 1.0)])
    turn, parts = {r: rnd.choice([1, 2]) for r in range(6)}, [[], [], []]
    for recording in range(6):
        own = sorted((r for r in rows if r[0] == recording), key=lambda r: r[2])
        cuts = sorted(rnd.randrange(1, len(own) + 1) for _ in range(turn[recording]))
        for k, r in enumerate(own):
            parts[sum(k >= c for c in cuts)].append(r)
    os.makedirs(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for k, part in enumerate(parts):
        spark.createDataFrame([*part, *([late] if k == 2 else [])], schema).coalesce(2).write.parquet(f"{tmp_path}/in/{k}")
        R.stitch_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(a - b) < 1e-9 for g, w in zip(got, want) for a, b in zip(g[3:], w[3:])) and len(want) > 200


def test_sidecars(spark, tmp_path):
    for folder, text in (("Book A", json.dumps([{"title": "A", "dateKey": "2026-01-01", "charactersRead": 5, "extra": 1}, {"dateKey": "2026-01-02"}])), ("b", "{broken"), ("c", "[]")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "statistics.json").write_text(text)
    rows, corrupt = X.read_sidecars(spark, "statistics", f"{tmp_path}/*/statistics.json")
    assert [(r.folder, r.ord, r.dateKey, r.charactersRead) for r in rows.orderBy("ord").collect()] == [("Book A", 0, "2026-01-01", 5), ("Book A", 1, "2026-01-02", None)]
    assert [r.folder for r in corrupt.collect()] == ["b"]
    (tmp_path / "c" / "metadata.json").write_text(json.dumps({"id": "x", "title": "T"}))
    meta, _ = X.read_sidecars(spark, "metadata", f"{tmp_path}/*/metadata.json")
    folders = spark.createDataFrame([("b",), ("c",)], "folder string")
    assert {(r.folder, r.id, r.title) for r in X.with_default_metadata(folders, meta.drop("folder").withColumn("folder", F.lit("c"))).collect()} == {("b", "b", None), ("c", "x", "T")}


def test_epub(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "my book.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        z.writestr("OEBPS/c.opf", '<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:language>ja</dc:language></metadata><manifest><item id="a" href="text/1.xhtml" media-type="application/xhtml+xml"/><item id="i" href="x.png" media-type="image/png"/><item id="b" href="text/2.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest><spine><itemref idref="b" linear="no"/><itemref idref="i"/><itemref idref="a"/></spine></package>')
        z.writestr("OEBPS/text/1.xhtml", "<p>one</p>")
        z.writestr("OEBPS/text/2.xhtml", "<p>two</p>")
    (tmp_path / "broken.epub").write_bytes(b"no archive")
    books, chapters, errors = X.read_epubs(spark, str(tmp_path))
    assert [r.book for r in errors.collect()] == ["broken"]
    assert [tuple(r) for r in books.collect()] == [("my book", "my book", "ja", None)]
    assert [(r.ord, r.href, r.linear, r.html) for r in chapters.orderBy("ord").collect()] == [(0, "OEBPS/text/2.xhtml", False, "<p>two</p>"), (1, "OEBPS/text/1.xhtml", True, "<p>one</p>")]


def test_directory_and_days(spark, tmp_path):
    (tmp_path / "d" / "Sub").mkdir(parents=True)
    for name in ("d/b.srt", "d/Sub/A.srt", "d/.hidden.srt", "d/x.txt"):
        (tmp_path / name).write_text("1\n00:00:01,000 --> 00:00:02,000\nhi")
    assert [r.name for r in X.scan_directory(spark, f"{tmp_path}/d", "*.srt").collect()] == ["b.srt", "Sub/A.srt"]
    assert {r.book for r in X.read_srt(spark, f"{tmp_path}/d/*.srt").collect()} >= {"b"}
    days = spark.createDataFrame([("a", 1), ("b", 2)], "folder string, v int")
    X.write_days(days, f"{tmp_path}/t")
    X.write_days(spark.createDataFrame([("a", 9)], "folder string, v int"), f"{tmp_path}/t")
    assert {(r.folder, r.v) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {("a", 9), ("b", 2)}
    with pytest.raises(ValueError, match="a cannot be read|of a cannot"):
        X.write_days(days, f"{tmp_path}/t", unreadable=spark.createDataFrame([("a",)], "folder string"))


def test_match_and_book_info(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "match.json").write_text(json.dumps({"unmatched": 2, "matches": [{"id": "1", "startTime": 0.5, "endTime": 1, "text": "t", "chapterIndex": 0, "start": 3, "length": 4, "more": 0}]}))
    (tmp_path / "x" / "bookinfo.json").write_text(json.dumps({"characterCount": 9, "chapterInfo": {"a.xhtml": {"spineIndex": 0, "currentTotal": 0, "chapterCount": 9, "fragmentOffsets": {"f": 1}}}, "images": ["i.png"]}))
    match = X.read_sidecars(spark, "match", f"{tmp_path}/*/match.json")[0].first()
    assert (match.folder, match.unmatched, match.source, match.matches[0].start) == ("x", 2, None, 3)
    info = X.read_sidecars(spark, "bookinfo", f"{tmp_path}/*/bookinfo.json")[0].first()
    assert info.chapterInfo["a.xhtml"].fragmentOffsets == {"f": 1} and info.images == ["i.png"] and info.readerFactsVersion is None


def test_publication(spark, tmp_path, no_idle_batches):
    """The first batch at once, and later only the last state of what changed."""
    for k in range(3):
        spark.createDataFrame([(k % 2, k)], "key int, v int").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("key int, v int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = []
    R.publish(stream.groupBy("key").agg(F.sum("v").alias("v")), lambda df, n: got.append(sorted(map(tuple, df.collect()))), f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert got[0] and sum(map(len, got)) == 3 and {k: v for batch in got for k, v in batch} == {0: 2, 1: 1}


def test_transcripts(spark):
    df = spark.createDataFrame([(9.0, 10.0, None), (9.0, 10.0, "x"), (10.0, 10.0, "x"), (0.0, 0.0, None)], "through double, duration double, source string")
    assert [r.complete for r in X.transcript_complete(df).collect()] == [True, False, True, False]


def test_noise_floor_slides(spark):
    rnd = random.Random(1)
    levels = [(1, k, rnd.uniform(-120, 10)) for k in range(60)]
    got = {r.ord: r.floor for r in R.noise_floor_activity(spark.createDataFrame(levels, "recording int, ord int, level double"), frames_back=20).collect()}
    for k in range(60):
        bins = sorted([0] * max(0, 19 - k) + [math.floor(max(-100.0, min(0.0, x)) + 0.5) + 100 for _, _, x in levels[max(0, k - 19) : k + 1]])
        assert got[k] == bins[2] - 100
