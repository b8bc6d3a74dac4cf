"""Exact duplicate documents by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 counts Bloom slots: every normalised text sets two slots of a bit field of fixed largest size; slots that at least two
rows set form the *repeated* field.  Pass 2 tests each row's two slots there.  A row with a clear slot cannot have an equal and
passes straight through; only the rest shuffle, by the SHA-256 of their normalised text, to find the row that stays.

The field has BITS_A_ROW bits for each row.  It is broadcast, so one task holds at most MAX_BITS of it; where the rows need more,
hashes are cut by prefix into parts (folders of the written table of hashes) with a field of their own, which are gone through one
after the other.  Rows of different parts cannot be equal, so every row is tested once whatever their number, and the share of
unique rows that shuffle stays the same.  Groups that hold over a thousandth of all rows (so at most a thousand groups) get their
answer by a broadcast join, the others by a shuffled one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm._shared import ROW, Scratch, keeping_names, keyed_rows, without

BITS_A_ROW = 16
MAX_BITS = 1 << 30  # 128 MB
PAGE = 32768  # bits in one value of bitmap_construct_agg


def normalised(text_col: str) -> F.Column:
    """The text with each run of the six ASCII white space characters replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _bit(pages: F.Column, place: F.Column) -> F.Column:
    byte = F.conv(F.hex(F.substring(pages, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0, F.lit(False))


def _tested(rows: DataFrame, size: int) -> DataFrame:
    """doc_id, uid, sha and whether both slots of a row are slots that two rows or more set, in a field of size bits."""
    slots = [F.pmod(F.col(h), F.lit(size)) for h in ("h1", "h2")]
    repeated = rows.select(F.explode(F.array_distinct(F.array(*slots))).alias("slot")).groupBy("slot").agg(F.count("*").alias("hits")).where("hits > 1")
    field = repeated.groupBy((F.col("slot") / PAGE).cast("int").alias("page")).agg(F.bitmap_construct_agg(F.col("slot") % PAGE).alias("pages"))
    for k, slot in enumerate(slots):
        side = field.select(F.col("page").alias(f"page{k}"), F.col("pages").alias(f"pages{k}"))
        rows = rows.withColumn(f"page{k}", (slot / PAGE).cast("int")).join(F.broadcast(side), f"page{k}", "left").withColumn(f"hit{k}", _bit(F.col(f"pages{k}"), (slot % PAGE).cast("int"))).drop(f"pages{k}", f"page{k}")
    return rows.select("doc_id", "uid", "sha", (F.col("hit0") & F.col("hit1")).alias("possible"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, key_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised text the smallest doc_id stays.  Null texts count as empty, so they are equal to each other
    and to empty texts (but not to texts of white space, which normalise to one space).  Null doc_ids sort last.  Of rows that
    repeat both doc_id and text exactly one is kept.  Other columns are ignored, whatever their names.  An empty table gives an
    empty result.  key_col, if given, names each row (unique, not null) and is returned too.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("text"), (F.monotonically_increasing_id() if key_col is None else F.col(key_col)).alias("uid"))
    rows = rows.select("doc_id", "uid", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"))
    n = docs.count()
    parts = max(1, -(-BITS_A_ROW * n // max_bits))
    size = PAGE
    while size < min(BITS_A_ROW * n / parts, max_bits):
        size *= 2
    if parts == 1:
        hashes = [scratch.table(rows, "hashes")]
    else:
        whole = scratch.table(rows.withColumn("part", F.pmod(F.xxhash64("h1"), F.lit(parts)).cast("int")), "hashes", by="part")
        hashes = [whole.where(F.col("part") == k).drop("part") for k in range(parts)]
    tested = None
    for k, part in enumerate(hashes):
        part = scratch.table(_tested(part, size), f"tested{k}")
        tested = part if tested is None else tested.unionByName(part)
    through = tested.where(~F.col("possible"))
    possible = tested.where("possible").drop("possible")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("uid"))).alias("first")
    groups = scratch.table(possible.groupBy("sha").agg(F.count("*").alias("group_size"), first), "groups")
    heavy = F.col("group_size") > max(1000, n // 1000)
    key = [] if key_col is None else [F.col("uid").alias(key_col)]
    cols = [*key, F.col("doc_id"), F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("first.uid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")]
    tagged = possible.join(F.broadcast(groups.where(heavy)), "sha", "left")
    in_heavy = tagged.where("first is not null").select(*cols)
    in_light = tagged.where("first is null").select("doc_id", "uid", "sha").join(groups.where(~heavy), "sha").select(*cols)
    alone = through.select(*key, "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return alone.unionByName(in_heavy).unionByName(in_light)


@keeping_names
def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns.

    Of equal texts one row stays: the smallest doc_id, null ones last.  Null and repeated doc_ids are rows like any other; null texts
    are equal to empty ones.  An empty table gives an empty result.  Columns may have any names.
    """
    rows = keyed_rows(docs)
    return without(rows, exact_dedup(rows, id_col, text_col, key_col=ROW).where(~F.col("kept")), Scratch(docs.sparkSession))
