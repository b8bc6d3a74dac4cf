"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order; a row's fractional rank is (rank - 1/2) / rows of the source.  All rows in
order of fractional rank interleave the sources in proportion, and cutting that order into equal runs gives shards whose counts
differ by one at most and whose mixture of sources is that of the whole.

Ranks are exact and no task holds a whole source: the seeded hash deals rows into cells of about CELL_ROWS rows, a row's rank is
the count of rows in earlier cells plus its place in its cell, and the same scheme numbers the global order by cells of
fractional rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readlake.llm._shared import Scratch

CELL_ROWS = 2000
MAX_CELLS = 1 << 16


def _cells(n: int) -> int:
    return max(1, min(MAX_CELLS, n // CELL_ROWS))


def interleaved_shards(docs: DataFrame, shards: int = 8, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), source.

    Shard counts differ by one at most; slots of a shard run from 0 without gaps.  Null texts have size 1; null sources form a
    stratum of their own; null or repeated doc_ids are ordinary rows.  An empty table gives an empty result.  Other columns are
    ignored.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.monotonically_increasing_id().alias("uid"),
    )
    rows = scratch.table(rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32")), "rows")
    n = rows.count()
    cells, stratum = _cells(n), ["no_source", "source"]
    rows = rows.withColumn("cell", F.pmod("h", F.lit(cells)))
    counts = rows.groupBy(*stratum, "cell").agg(F.count("*").alias("in_cell"))
    by_source = Window.partitionBy(*stratum)
    counts = counts.select(*stratum, "cell", (F.sum("in_cell").over(by_source.orderBy("cell")) - F.col("in_cell")).alias("before"), F.sum("in_cell").over(by_source).alias("in_source"))
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*stratum, "cell").orderBy("h", "doc_id", "uid"))).join(counts, [*stratum, "cell"])
    fraction = (F.col("before") + F.col("place") - F.lit(0.5)) / F.col("in_source")
    ranked = scratch.table(ranked.select("doc_id", "size", "text_crc32", *stratum, "uid", fraction.alias("fraction"), F.floor(fraction * cells).cast("int").alias("run")), "ranked")
    runs = ranked.groupBy("run").agg(F.count("*").alias("in_run"))
    runs = runs.select("run", (F.sum("in_run").over(Window.orderBy("run")) - F.col("in_run")).alias("before"))  # at most MAX_CELLS rows
    order = Window.partitionBy("run").orderBy("fraction", *stratum, "uid")
    placed = ranked.withColumn("place", F.row_number().over(order)).join(F.broadcast(runs), "run").withColumn("at", F.col("before") + F.col("place") - 1)
    shard = F.floor(F.expr(f"(at * {shards}) div {max(n, 1)}"))
    placed = placed.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(shard * {max(n, 1)}L + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("at") - first).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.when(~F.col("no_source"), F.col("source")).alias("source"),
    )
