"""Archives against a plain reader of WARC files, and their records against the pages."""

import glob
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from readlake.llm import warc

SCHEMA = "page_id bigint, url string, html string, row string, archive int, offset int, refers_to string, payload string"


def pages(seed=3, n=150):
    rnd = random.Random(seed)
    copies = [f"<html>page {k} " + "ü " * 60 + "</html>" for k in range(3)] + ["<p>short</p>", "", None, "<html>\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n" + "x" * 100]
    rows = []
    for k in range(n):
        html = rnd.choice(copies) if rnd.random() < 0.6 else f"<html>{k} " + rnd.choice("aé日") * rnd.randrange(400) + "</html>"
        rows.append((rnd.choice([k, k, k, None, 7]), rnd.choice([f"http://host{k % 5}/a b\r\nc?{k}", None, ""]), html))
    return [(*r, "x", 1, 2, "y", "z") for r in [*rows, rows[0], rows[0]]]


def want(rows):
    """(page_id, bytes, digest, type, refers_to), by the rule; of equal page_ids any one may be the response."""
    least, out, used = {}, [], set()
    payloads = [(r[0], (r[2] or "").encode()) for r in rows]
    for i, p in payloads:
        least[p] = min(least.get(p, (True, 0)), (i is None, i or 0))
    for i, p in payloads:
        none, first = least[p]
        response = len(p) < 100 or ((i is None, i or 0) == least[p] and p not in used)
        used |= {p} if response else set()
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if response else "revisit", None if response or none else first))
    return sorted(out, key=repr)


CONTRACT = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.fixture
def small(monkeypatch):
    """Many archives, and reads of few records."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)


def test_round_trip(spark, tmp_path, small):
    rows = pages()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = warc.archived_pages(docs)
    assert sorted((tuple(r[c] for c in CONTRACT) for r in got.collect()), key=repr) == want(rows)
    assert got.where("error is not null").count() == 0
    docs.write.parquet(f"{tmp_path}/pages")
    stored = spark.read.parquet(f"{tmp_path}/pages")  # rows are named by file and place
    got = warc.archived_pages(stored, f"{tmp_path}/out")
    assert sorted((tuple(r[c] for c in CONTRACT) for r in got.collect()), key=repr) == want(rows)
    index = spark.read.parquet(f"{tmp_path}/out/index")
    whole = warc.whole_pages(index, f"{tmp_path}/out", "page_id = 7 or page_id is null").collect()
    assert sorted(((r.page_id, r.url, bytes(r.payload)) for r in whole), key=repr) == sorted(((r[0], r[1], (r[2] or "").encode()) for r in rows if r[0] in (7, None)), key=repr)


def test_files_are_plain_archives(spark, tmp_path):
    """Every file can be read from end to end without the index, and each record alone by its offset."""
    rows = pages()
    index = warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path), date="2024-05-06T07:08:09Z").collect()
    by_name, total = {f.rsplit("/", 1)[1]: f for f in glob.glob(f"{tmp_path}/archives/*.gz")}, 0
    for f in by_name.values():
        data = gzip.open(f).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            assert head.startswith(b"WARC/1.1") and fields["WARC-Date"] == "2024-05-06T07:08:09Z" and rest[size : size + 4] == b"\r\n\r\n"
            data, total = rest[size + 4 :], total + (fields["WARC-Type"] != "warcinfo")
    assert total == len(rows) == len(index)
    for r in index:
        with open(by_name[r.archive], "rb") as f:
            f.seek(r.offset)
            head, http, payload = warc.parsed(gzip.decompress(f.read(r.length)))
        assert head["WARC-Type"] == r.record_type and int(http["Content-Length"]) == r.payload_bytes and ("WARC-Target-URI" in head) == (r.url is not None)
        assert hashlib.sha256(payload).hexdigest() == r.payload_digest if r.record_type == "response" else payload == b""


def test_ranges_cover_selected_records_once(spark):
    rnd, rows = random.Random(5), []
    for archive in "abc":
        at = 0
        for _ in range(300):
            n = rnd.randrange(1, 900)
            rows.append((archive, at, n, len(rows)))
            at += n + (5000 if rnd.random() < 0.05 else 0)
    rows = [r for r in rows if rnd.random() < 0.5]
    index = spark.createDataFrame(rows, "archive string, offset bigint, length bigint, row bigint")
    ranges = warc.byte_ranges(index, gap=2000, most=4000).collect()
    assert sorted((r.archive, x.offset, x.length, x.row) for r in ranges for x in r.records) == sorted(rows)
    assert all(r.start == r.records[0].offset and r.stop == max(x.offset + x.length for x in r.records) and r.stop - r.start <= 4000 + 900 for r in ranges)
    assert all(b.offset - (a.offset + a.length) <= 2000 for r in ranges for a, b in zip(r.records, r.records[1:]))
    assert len(ranges) < len(rows) / 3


def test_damaged_records_are_reported(spark, tmp_path):
    index = warc.write_archives(spark.createDataFrame(pages(), SCHEMA).coalesce(1), str(tmp_path))
    rows = index.where("record_type = 'response' and payload_bytes > 100").orderBy("offset").collect()
    hurt, moved = rows[0], rows[1]
    name = f"{tmp_path}/archives/{hurt.archive}"
    data = bytearray(open(name, "rb").read())
    data[hurt.offset + hurt.length // 2] ^= 0x55
    open(name, "wb").write(data)
    shifted = index.withColumn("offset", F.when(F.col("row") == moved.row, F.lit(rows[2].offset)).otherwise(F.col("offset"))).withColumn("length", F.when(F.col("row") == moved.row, F.lit(rows[2].length)).otherwise(F.col("length")))
    bad = warc.read_records(shifted, str(tmp_path)).where("error is not null").collect()
    assert {r.row for r in bad} == {hurt.row, moved.row} and all(r.payload_digest is None for r in bad)


def test_no_pages_and_long_ones(spark):
    assert warc.archived_pages(spark.createDataFrame([], SCHEMA)).collect() == []
    long = [(1, "u", "é" * 6_000_000), (2, "u", "é" * 6_000_000), (3, "u", None)]
    got = warc.archived_pages(spark.createDataFrame(long, "page_id bigint, url string, html string"))
    assert sorted((tuple(r[c] for c in CONTRACT) for r in got.collect()), key=repr) == want(long)
    text_ids = spark.createDataFrame([("a:b>", "u", "x" * 100), ("a:c", "u", "x" * 100), (None, "u", "x" * 100)], "page_id string, url string, html string")
    assert {(r.page_id, r.record_type, r.refers_to) for r in warc.archived_pages(text_ids).collect()} == {("a:b>", "response", None), ("a:c", "revisit", "a:b>"), (None, "revisit", "a:b>")}
