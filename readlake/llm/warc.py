"""WARC archives with an index: written record by record, read back by coalesced byte ranges.

Writing: a first pass finds, of equal payloads, the page that gets the response record; the others get revisit records without a
payload.  Every task then writes archives of about ARCHIVE_BYTES, each record a gzip member of its own, and returns one index row a
record: archive, offset, length, URL, digest.  Archives have names of their own for each attempt of a task, and only rows of
attempts that succeeded reach the index, so what a lost task left behind is never read.

Reading starts from index rows, all or selected ones: rows of an archive are sorted by offset, records less than GAP apart are read
at once in ranges of about RANGE_BYTES, and ranges are dealt to tasks by archive and offset, in number by the bytes to be read.

Folders are URIs that Arrow's file systems open (file, hdfs, s3, gs) and that all executors share.
"""

from __future__ import annotations

import hashlib
import re
import time
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readlake.llm._shared import FEW_KEYS, ROW, Scratch, keeping_names, keyed_rows, release
from readlake.llm.groups import attach

ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
TASK_BYTES = 32 << 20
GAP = 64 << 10
#: Shorter payloads are never written as revisits.
LEAST_REVISIT = 100
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAKING = re.compile(r"[\x00-\x20\x7f]")
RECORD_ID = re.compile(r"<urn:(?:page:(.*):)?row:(-?\d+)>")
FIELDS = ["archive", "offset", "length", "url", "payload_digest", "payload_bytes", "page_id", "row", "record_type", "refers_to", "refers_row"]


def opened(folder: str):
    """The Arrow file system of a folder, and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", folder))


def record_id(page_id, row: int) -> str:
    return f"<urn:row:{row}>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}:row:{row}>"


def named(value: str) -> tuple[str | None, int]:
    """The page_id, as text, and the row that a record id names."""
    page, row = RECORD_ID.fullmatch(value).groups()
    return page if page is None else unquote(page), int(row)


def head(first: str, fields: dict[str, object]) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n").encode()


def record(kind: str, name: str, date: str, url: str | None, digest: str, size: int, payload: bytes | None, refers: str | None) -> bytes:
    """One WARC record; url gets its control characters and spaces quoted (the index has it as it is)."""
    block = head("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": size}) + (payload or b"")
    target = None if url is None else BREAKING.sub(lambda m: quote(m[0]), url)
    fields = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Date": date, "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha256:{digest}"}
    if refers is not None:
        fields |= {"WARC-Refers-To": refers, "WARC-Profile": PROFILE}
    return head("WARC/1.1", fields | {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}) + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields of a record, of the HTTP message in it, and the payload; raises ValueError for anything else."""

    def fields(text: bytes, first: str) -> dict[str, str]:
        lines = text.decode().split("\r\n")
        if not lines[0].startswith(first):
            raise ValueError(f"it begins with {lines[0][:40]!r}")
        return dict(line.split(": ", 1) for line in lines[1:])

    top, mark, rest = data.partition(b"\r\n\r\n")
    warc = fields(top, "WARC/1.")
    size = int(warc["Content-Length"])
    if not mark or rest[size:] != b"\r\n\r\n":
        raise ValueError("its length differs from Content-Length")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return warc, fields(http, "HTTP/"), payload


class Archive:
    """An archive that is being written."""

    def __init__(self, folder: str, date: str):
        self.files, path = opened(folder)
        self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
        self.stream = self.files.open_output_stream(f"{path}/{self.name}", compression=None)
        about = b"software: readlake\r\nformat: WARC File Format 1.1\r\n"
        self.add(head("WARC/1.1", {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "WARC-Filename": self.name, "Content-Type": "application/warc-fields", "Content-Length": len(about)}) + about + b"\r\n\r\n")

    def add(self, data: bytes) -> tuple[int, int]:
        data = member(data)
        self.stream.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)


def _firsts(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """ROW, refers_to, refers_row of the rows that revisit another one; digests alone are shuffled."""
    digests = scratch.table(rows.select(ROW, "page_id", F.unhex("payload_digest").alias("sha"), "payload_bytes").where(F.col("payload_bytes") >= LEAST_REVISIT).drop("payload_bytes"), "digests")
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id"), F.col(ROW).alias("row"))).alias("first")
    groups = scratch.table(digests.groupBy("sha").agg(F.count("*").alias("size"), first).where("size > 1"), "groups")
    found = attach(digests.select(ROW, "sha"), groups, "sha", "size", digests.count()).where(F.col(ROW) != F.col("first.row"))
    return scratch.table(found.select(ROW, F.col("first.page_id").alias("refers_to"), F.col("first.row").alias("refers_row")), "revisits")


@keeping_names
def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None) -> DataFrame:
    """Write one record for each row of pages under folder/archives, the index under folder/index; returns the index.

    Payloads are the html in UTF-8, null ones empty.  Of rows with equal payloads of LEAST_REVISIT bytes or more that with the
    smallest page_id (null ones last, then by place in the table) is the response, the others revisit it; repeated rows are records
    of their own.  Null URLs have no target.  Other columns are ignored, whatever their names; an empty table gives an empty index.
    """
    scratch = Scratch(pages.sparkSession)
    date, archives = date or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), f"{folder}/archives"
    files, path = opened(archives)
    files.create_dir(path, recursive=True)
    rows = keyed_rows(pages)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = rows.select(ROW, F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.sha2(html, 256).alias("payload_digest"), F.octet_length(html).cast("bigint").alias("payload_bytes"), html.alias("payload"))
    revisits = _firsts(rows.drop("url", "payload"), scratch)
    rows = rows.join(F.broadcast(revisits) if revisits.count() <= FEW_KEYS else revisits, ROW, "left")
    id_type = pages.schema[id_col].dataType.simpleString()
    rows = rows.select(ROW, "page_id", "url", "payload_digest", "payload_bytes", "refers_to", "refers_row", F.when(F.col("refers_row").isNull(), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            out = {k: [] for k in ("archive", "offset", "length", "record_type")}
            for k in range(batch.num_rows):
                row, page, url, digest, size, refers_to, refers_row, payload = (c[k].as_py() for c in batch.columns)
                if archive is None or archive.at >= ARCHIVE_BYTES:
                    if archive:
                        archive.stream.close()
                    archive = Archive(archives, date)
                kind = "response" if refers_row is None else "revisit"
                at, length = archive.add(record(kind, record_id(page, row), date, url, digest, size, payload, None if refers_row is None else record_id(refers_to, refers_row)))
                for name, value in (("archive", archive.name), ("offset", at), ("length", length), ("record_type", kind)):
                    out[name].append(value)
            column = dict(zip(("row", "page_id", "url", "payload_digest", "payload_bytes", "refers_to", "refers_row"), batch.columns)) | {k: pa.array(v, pa.int64() if k in ("offset", "length") else pa.string()) for k, v in out.items()}
            yield pa.RecordBatch.from_arrays([column[f] for f in FIELDS], FIELDS)
        if archive:
            archive.stream.close()
        release()

    index = rows.mapInArrow(run, f"archive string, offset bigint, length bigint, url string, payload_digest string, payload_bytes bigint, page_id {id_type}, row bigint, record_type string, refers_to {id_type}, refers_row bigint")
    index = Scratch(pages.sparkSession, folder).table(index, "index")
    for name in ("digests", "groups", "revisits"):
        scratch.drop(name)
    return index


def byte_ranges(index: DataFrame, gap: int = GAP, most: int = RANGE_BYTES) -> DataFrame:
    """archive, start, stop, records: reads that cover the records of index rows, each record in one of them; records lists (offset, length, row).

    Records at most gap bytes apart share a read of about most bytes, or of one record if that is longer.  Windows are over one
    archive, so over what fits ARCHIVE_BYTES.
    """
    order = Window.partitionBy("archive").orderBy("offset")
    end = F.col("offset") + F.col("length")
    rows = index.select("archive", "offset", "length", "row").withColumn("far", F.coalesce((F.col("offset") - F.lag(end).over(order) > gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("far").over(order))
    rows = rows.withColumn("part", F.floor((F.col("offset") - F.min("offset").over(Window.partitionBy("archive", "run"))) / most))
    return rows.groupBy("archive", "run", "part").agg(F.min("offset").alias("start"), F.max(end).alias("stop"), F.sort_array(F.collect_list(F.struct("offset", "length", "row"))).alias("records")).drop("run", "part")


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """row, page_id (text), url, record_type, refers_to (text), refers_row, payload_bytes, payload_digest, payload, error: one row for each index row.

    Payloads of responses are measured and held against their digest; revisits have no payload, and the size and digest that their
    record states.  A record that cannot be read, or whose payload has another digest, has an error and nulls.
    """
    archives = f"{folder}/archives"
    size = index.agg(F.sum("length")).first()[0] or 0
    ranges = byte_ranges(index)
    ranges = ranges.repartitionByRange(max(1, -(-size // TASK_BYTES)), "archive", "start").sortWithinPartitions("archive", "start")
    schema = "row bigint, page_id string, url string, record_type string, refers_to string, refers_row bigint, payload_bytes bigint, payload_digest string, payload binary, error string"
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = [f.split()[0] for f in schema.split(", ")]

    def one(data: bytes, row: int) -> tuple:
        try:
            warc, http, payload = parsed(zlib.decompress(data, 31))
            page, found = named(warc["WARC-Record-ID"])
            if found != row:
                raise ValueError(f"it is the record of row {found}")
            kind, digest, n = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha256:"), int(http["Content-Length"])
            if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError("its payload has another digest")
            refers = named(warc["WARC-Refers-To"]) if kind == "revisit" else (None, None)
            return row, page, warc.get("WARC-Target-URI"), kind, *refers, n, digest, payload if with_payload and kind == "response" else None, None
        except (ValueError, KeyError, AttributeError, zlib.error) as e:
            return row, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = opened(archives)
        name = stream = None
        for batch in batches:
            for k in range(batch.num_rows):
                archive, start, stop, records = (c[k].as_py() for c in batch.columns)
                if archive != name:
                    name, stream = archive, files.open_input_file(f"{path}/{archive}")
                data = stream.read_at(stop - start, start)
                found = [one(data[r["offset"] - start : r["offset"] - start + r["length"]], r["row"]) for r in records]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)
        release()

    return ranges.mapInArrow(run, schema)


def whole_pages(index: DataFrame, folder: str, selected: Column | str) -> DataFrame:
    """page_id, url, payload, error of the selected index rows; a revisit gets the payload of the response it refers to, which is read once."""
    chosen = index.where(selected).select("page_id", "url", F.coalesce("refers_row", "row").alias("row"))
    wanted = index.join(chosen.select("row").distinct(), "row", "left_semi")
    return chosen.join(read_records(wanted, folder).select("row", "payload", "error"), "row", "left").drop("row")


def archived_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as archives and read all records back: page_id, payload_bytes, payload_digest, record_type, refers_to, url, error.

    See write_archives for nulls, ties and repeated rows.  Without a folder the archives are intermediate files and go afterwards.
    """
    scratch = Scratch(pages.sparkSession)
    at = folder or f"{scratch.path}/warc"
    index = write_archives(pages, at, id_col, url_col, html_col)
    id_type = pages.schema[id_col].dataType
    found = read_records(index, at, with_payload=False)
    found = found.select(F.col("page_id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"), "url", "error")
    found = scratch.table(found, "records")
    if folder is None:
        scratch.drop("warc")
    return found
