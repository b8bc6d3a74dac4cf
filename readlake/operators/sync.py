"""Synchronisation: facts in file names, directions by last writer, and what only one side has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readlake.functions import dates as D
from readlake.functions import text as T

#: For each kind of file its prefix, the place of its time of change and of its value, and the type of the value.
KINDS = {"progress": ("progress_", 3, 4, "double"), "statistics": ("statistics_", 3, 4, "bigint"), "audio": ("audioBook_", 3, 4, "double"), "bookdata": ("bookdata_", 4, 5, "bigint")}


def file_facts(listing: DataFrame) -> DataFrame:
    """kind, modified and value of each file by its name; other files have kind 'cover' or null."""
    kind, modified, value = F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(None).cast("double")
    for name, (prefix, at, of, type_) in KINDS.items():
        here = F.col("name").startswith(prefix)
        kind = F.when(here, name).otherwise(kind)
        modified = F.when(here, T.file_fact(F.col("name"), prefix, at)).otherwise(modified)
        value = F.when(here, T.file_fact(F.col("name"), prefix, of, type_).cast("double")).otherwise(value)
    return listing.select("*", F.when(F.col("name").startswith("cover_"), "cover").otherwise(kind).alias("kind"), modified.alias("modified"), value.alias("value"))


def latest_files(listing: DataFrame) -> DataFrame:
    """For each folder the latest file of each kind, and its last access: of progress and audio, else of the book data."""
    order = Window.partitionBy("folder", "kind").orderBy(F.desc_nulls_last("modified"), "id")
    top = file_facts(listing).where("kind is not null").withColumn("n", F.row_number().over(order)).where("n = 1")
    wide = top.groupBy("folder").pivot("kind", ["progress", "statistics", "audio", "bookdata", "cover"]).agg(F.first(F.struct("id", "modified", "value")))
    access = F.coalesce(F.greatest("progress.modified", "audio.modified"), F.col("bookdata.value").cast("bigint"))
    return wide.select("folder", *(F.col(f"{k}.id").alias(f"{k}_id") for k in ("progress", "statistics", "audio", "bookdata", "cover")), access.alias("last_access"))


def sync_direction(bookmarks: DataFrame, remote: DataFrame, keys: Sequence[str] = ("book",)) -> DataFrame:
    """For each book 'export', 'import' or 'synced': the newer of the local bookmark (reference seconds) and the remote file (ms) wins."""
    local = bookmarks.select(*keys, ((F.col("lastModified") * 1000.0 + D.REFERENCE_EPOCH * 1000.0).cast("bigint")).alias("local_ms"))
    both = local.join(remote.select(*keys, F.col("modified").alias("remote_ms")), list(keys), "full_outer")
    a, b = F.col("local_ms"), F.col("remote_ms")
    return both.withColumn("direction", F.when(a.isNull() & b.isNull(), "synced").when(a.isNull(), "import").when(b.isNull(), "export").when(a > b, "export").when(b > a, "import").otherwise("synced"))


def remote_only(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote books with book data that no local title has; the title is the unescaped folder name."""
    titled = remote.where("bookdata_id is not null").withColumn("title", T.unescape_title(F.col("folder")))
    return titled.join(local.select("title"), "title", "left_anti").select("folder", "title", "bookdata_id")


def progress_file_name(modified, progress):
    return F.concat(F.lit("progress_1_6_"), modified.cast("string"), F.lit("_"), progress.cast("string"), F.lit(".json"))
