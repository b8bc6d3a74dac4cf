"""Bookshelves and storage: ordering, shelves, orphans and clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readlake.functions import text as T


def order_books(books: DataFrame, by: str = "recent", keys: tuple[str, ...] = ("shelf",)) -> DataFrame:
    """Place of each book on its shelf: by last access, latest first, or by natural title order."""
    order = [F.desc_nulls_last("last_access"), F.asc("book")] if by == "recent" else [T.natural_key(F.col("title")).asc(), F.asc("title"), F.asc("book")]
    return books.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def unshelved(books: DataFrame, shelves: DataFrame) -> DataFrame:
    """Books that no shelf lists."""
    return books.join(shelves.select(F.explode("books").alias("book")), "book", "left_anti")


def orphan_files(files: DataFrame, playback: DataFrame) -> DataFrame:
    """Files that their book's playback does not name."""
    return files.join(playback.select("book", "file"), ["book", "file"], "left_anti")


def apply_shelf_edits(shelves: DataFrame, edits: DataFrame) -> DataFrame:
    """Shelves (shelf, books) after moves (book, target shelf, null for none): a book leaves all shelves, then joins the end of its target."""
    stay = shelves.select("shelf", F.posexplode("books").alias("at", "book")).join(edits.select("book").distinct(), "book", "left_anti")
    added = edits.where("target is not null").select(F.col("target").alias("shelf"), F.lit(2147483647).alias("at"), "book")
    lists = stay.select("shelf", "at", "book").unionByName(added).groupBy("shelf").agg(F.array_sort(F.collect_list(F.struct("at", "book"))).alias("b"))
    empty = F.array().cast(shelves.schema["books"].dataType)
    return shelves.select("shelf").join(lists, "shelf", "left").select("shelf", F.coalesce(F.transform("b", lambda x: x["book"]), empty).alias("books"))


def shelf_sections(books: DataFrame, shelves: DataFrame, progress: DataFrame) -> DataFrame:
    """Sections of the bookshelf: books being read (0 < progress < 0.999), each shelf, and books on no shelf."""
    reading = books.join(progress.where("progress > 0 and progress < 0.999"), "book", "left_semi").select(F.lit(0).alias("section"), F.lit("reading").alias("name"), "book")
    on = shelves.select(F.lit(1).alias("section"), F.col("shelf").alias("name"), F.explode("books").alias("book")).join(books, "book", "left_semi").select("section", "name", "book")
    none = unshelved(books, shelves).select(F.lit(2).alias("section"), F.lit("unshelved").alias("name"), "book")
    return reading.unionByName(on).unionByName(none)


def apply_highlight_edits(highlights: DataFrame, edits: DataFrame) -> DataFrame:
    """Highlights with new colours, removed ones gone.  edits: (id, color, remove)."""
    out = highlights.join(edits.select("id", F.col("color").alias("new"), "remove"), "id", "left").where(~F.coalesce("remove", F.lit(False)))
    return out.withColumn("color", F.coalesce("new", "color")).drop("new", "remove")


def cleanup_report(files: DataFrame) -> DataFrame:
    """Bytes and items of each category and of all."""
    out = files.rollup("category").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("items"))
    return out.withColumn("category", F.coalesce("category", F.lit("total")))
