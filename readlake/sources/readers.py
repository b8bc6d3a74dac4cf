"""Readers and writers of reading data: JSON sidecars of book folders, EPUB files, subtitles, directories and day tables."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "title string, dateKey string, charactersRead int, readingTime double, minReadingSpeed int, altMinReadingSpeed int, lastReadingSpeed int, maxReadingSpeed int, lastStatisticModified bigint"
SIDECARS = {
    "statistics": DAY,
    "metadata": "id string, title string, cover string, folder string, lastAccess double, renamedTitle string, epub string, profileId string, bookLanguage string, author string",
    "bookmark": "chapterIndex int, progress double, characterCount int, lastModified double",
    "highlights": "id string, character int, offset int, text string, color string, createdAt double, textFurigana string",
    "playback": "lastPosition double, delay double, rate float, audioUri string, audioFileName string",
    "shelves": "name string, bookIds array<string>",
    "match": "unmatched int, source string, matches array<struct<id: string, startTime: double, endTime: double, text: string, chapterIndex: int, start: int, length: int>>",
    "bookinfo": "characterCount int, chapterInfo map<string, struct<spineIndex: int, currentTotal: int, chapterCount: int, fragmentOffsets: map<string, int>>>, images array<string>, readerFactsVersion int",
    "transcript": "through double, duration double, source string, tokens array<struct<text: string, start: double, end: double>>",
}


def folder_of() -> Column:
    """The folder that holds the row's file, as it was named."""
    return F.url_decode(F.replace(F.element_at(F.split("_metadata.file_path", "/"), -2), F.lit("+"), F.lit("%2B")))


def read_sidecars(spark: SparkSession, kind: str, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON sidecars with their folder and place in the file, and the folders whose file cannot be read.

    A corrupt file drops its folder only.  Unknown fields are ignored, missing ones are null.
    """
    item = SIDECARS[kind]
    raw = spark.read.text(paths, wholetext=True).select(folder_of().alias("folder"), F.col("value"))
    many = raw.where("trim(value) like '[%'")
    parsed = many.select("folder", F.from_json("value", f"array<struct<{_ddl(item)}>>").alias("rows"))
    one = raw.where("trim(value) not like '[%'").select("folder", F.from_json("value", f"struct<{_ddl(item)}>").alias("row"))
    rows = parsed.select("folder", F.posexplode("rows").alias("ord", "row")).unionByName(one.where("row is not null").select("folder", F.lit(0).alias("ord"), "row"))
    broken = F.try_parse_json("value").isNull() if hasattr(F, "try_parse_json") else F.lit(False)
    corrupt = raw.where(broken).select("folder")
    return rows.join(corrupt, "folder", "left_anti").select("folder", F.col("ord").cast("bigint").alias("ord"), "row.*"), corrupt


def _ddl(item: str) -> str:
    from pyspark.sql.types import StructType

    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(item))


def with_default_metadata(folders: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata of all folders; a folder without a file has its own name as id and no title."""
    return folders.join(metadata.withColumnRenamed("id", "given"), "folder", "left").withColumn("id", F.coalesce("given", "folder")).drop("given")


def transcript_complete(transcripts: DataFrame) -> DataFrame:
    """Whether a transcript reaches its duration; one without a source may end a second and a half before."""
    reach = F.col("through") + F.when(F.col("source").isNull(), 1.5).otherwise(0.0)
    return transcripts.withColumn("complete", F.coalesce((F.col("duration") > 0) & (F.col("through") > 0) & (reach >= F.col("duration")), F.lit(False)))


def scan_directory(spark: SparkSession, root: str, pattern: str = "*", skip: str = r"(^|/)(\.|__MACOSX)") -> DataFrame:
    """Files under root by name pattern: name relative to it, size, place by lower-case name; hidden and virtual ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    name = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", ""), f"^{base.replace('.', '[.]')}/", "")
    return files.select(name.alias("name"), F.col("length").alias("bytes")).where(~F.col("name").rlike(skip)).orderBy(F.lower("name"), "name")


_NS = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf", "d": "http://purl.org/dc/elements/1.1/"}
_HTML = {"application/xhtml+xml", "text/html"}


def read_epubs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Books (book, title, language, author), chapters (book, ord, id, href, media_type, linear, properties, html) and errors (book, error).

    A file is opened where it is read; chapters are manifest items of HTML types in spine order, with paths from the content folder.
    A file that cannot be opened, or has no chapters, gives one row of errors and drops out of the others.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")
    names = ["book", "title", "language", "author", "ord", "id", "href", "media_type", "linear", "properties", "html"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(*r, None) for r in _chapters(name, data)]
                except (ValueError, KeyError, AttributeError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((_book_of(name), *[None] * 10, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[*names, "error"])

    rows = files.mapInPandas(parse, "book string, title string, language string, author string, ord bigint, id string, href string, media_type string, linear boolean, properties string, html string, error string")
    fine = rows.where("error is null")
    return fine.select("book", "title", "language", "author").distinct(), fine.drop("title", "language", "author", "error"), rows.where("error is not null").select("book", "error")


def _book_of(path: str) -> str:
    return posixpath.basename(unquote(path)).removesuffix(".epub")


def _chapters(path: str, data: bytes) -> list[tuple]:
    book, found = _book_of(path), []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf_path = container.find(".//c:rootfile", _NS).get("full-path")
        opf = ElementTree.fromstring(z.read(opf_path))
        root = posixpath.dirname(opf_path)
        items = {i.get("id"): i for i in opf.findall("o:manifest/o:item", _NS)}
        say = lambda tag: next((e.text.strip() for e in opf.findall(f"o:metadata/d:{tag}", _NS) if e.text and e.text.strip()), None)
        n = 0
        for ref in opf.findall("o:spine/o:itemref", _NS):
            item = items.get(ref.get("idref"))
            if item is None or item.get("media-type") not in _HTML:
                continue
            href = posixpath.normpath(posixpath.join(root, unquote(item.get("href"))))
            found.append((book, say("title") or book, say("language"), say("creator"), n, item.get("id"), href, item.get("media-type"), ref.get("linear") != "no", item.get("properties"), z.read(href).decode("utf-8", "replace")))
            n += 1
    if not found:
        raise ValueError(f"no chapters in {path}")
    return found


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """(book, content) of subtitle files, for alignment.parse_srt."""
    name = F.regexp_replace(F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -1)), r"\.srt$", "")
    return spark.read.text(path, wholetext=True).select(name.alias("book"), F.col("value").alias("content"))


def write_days(days: DataFrame, path: str, unreadable: DataFrame | None = None) -> None:
    """Write days by folder; only the folders in days are replaced.

    unreadable: (folder) whose history could not be read, as read_sidecars reports them; days of such a folder are refused, since
    writing them would replace a history that nobody has seen.
    """
    if unreadable is not None:
        refused = [r.folder for r in days.select("folder").distinct().join(unreadable.select("folder"), "folder", "left_semi").limit(5).collect()]
        if refused:
            raise ValueError(f"the history of {', '.join(sorted(refused))} cannot be read and is not overwritten")
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(path)
