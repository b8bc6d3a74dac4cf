"""A Merkle manifest of a dataset, as a content-addressed DAG, and proofs by descent.

Every row is a leaf: the SHA-256 of some of its columns.  The leaves of a group (documents of a language) in the order of their ids
are hashed in runs of FANOUT, level by level, to a subroot; the subroots in the order of their groups give the root in the same way.

Nodes live in a store from digest to children.  A record of the store holds LEVELS levels of children below its digest, so a tree of
a billion leaves is four records high.  Equal subtrees have equal digests, and are one record.

A proof is found from the root: the digits of a leaf's rank choose a child at each level, the others of its run are collected, and
the steps are reversed in the end.  Records are asked for once for all leaves below them: the first requests are few, and each
answer carries the path so far to the records below, so nothing is gathered beyond one record's leaves.

Ranks are exact without gathering a group: rows are sorted over the cluster by group and id, a row's place is the count of rows in
earlier partitions plus its place in its own, and its rank is that less the place of its group's first row.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readlake.llm._shared import FEW_KEYS, Scratch, release
from readlake.llm.groups import attach

FANOUT = 2
LEVELS = 9
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A row is tampered with if this divides the CRC-32 of its id.
TAMPER = 7


def digest(values: Sequence[Column]) -> Column:
    """SHA-256, in hex, of values that follow each other: '-' for null, else the length in bytes, ':' and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def joined(children: list[bytes]) -> bytes:
    """The digest above some digests, which are hashed as hex text."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def levels_above(leaves: list[bytes], fanout: int, levels: int) -> list[list[bytes]]:
    """The given row of digests and so many rows above it."""
    rows = [leaves]
    for _ in range(levels):
        rows.append([joined(rows[-1][k : k + fanout]) for k in range(0, len(rows[-1]), fanout)])
    return rows


def steps(rows: list[list[bytes]], place: int, fanout: int) -> bytes:
    """The proof of the leaf at a place of rows (the last one is not looked at): from the leaf up, for each level a byte for the place in the run, one for the run's length, and the others' digests."""
    found = []
    for level in range(len(rows) - 2, -1, -1):  # down from the root, by the digits of place
        at = place // fanout**level
        first = at - at % fanout
        run = rows[level][first : first + fanout]
        found.append(bytes((at - first, len(run))) + b"".join(run[: at - first] + run[at - first + 1 :]))
    return b"".join(reversed(found))


def siblings(proof: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Place in the run, and digests of the others, for each level from the leaf up."""
    at = 0
    while at < len(proof):
        place, others = proof[at], proof[at + 1] - 1
        yield place, [proof[at + 2 + 32 * k : at + 34 + 32 * k] for k in range(others)]
        at += 2 + 32 * others


def folded(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and a proof lead to."""
    for place, others in siblings(proof):
        leaf = joined(others[:place] + [leaf] + others[place:])
    return leaf


@dataclass
class Manifest:
    """Tables of a manifest: leaves (tree, rank, size, id, leaf, forged), groups (tree, group, size, subroot), store (digest, leaves, depth, children); and the root, none for an empty table."""

    leaves: DataFrame
    groups: DataFrame
    store: DataFrame
    root: bytes | None
    scratch: Scratch
    fanout: int
    depth: int
    most: int
    n_groups: int


def ranked(rows: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """rows with their place (from 0) in an order that no two rows share, as a written table."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    mask = (1 << 33) - 1  # monotonically_increasing_id counts within a partition in its lower bits
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(mask).alias("__in"))
    placed = scratch.table(placed, name)
    before = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = before.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a partition
    return placed.join(F.broadcast(before), "__part").withColumn("place", F.col("__before") + F.col("__in")).drop("__part", "__in", "__before")


def _grow(nodes: DataFrame, most: int, fanout: int, depth: int, scratch: Scratch, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Records of the store and the roots (tree, digest) of trees of nodes (tree, rank, size of the level, digest); most is the largest size."""
    width = fanout**depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops, counts, depths, children = [], [], [], []
            for size, below in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                levels = 0
                while levels < depth and fanout**levels < size:
                    levels += 1
                rows = levels_above([x["digest"] for x in below], fanout, levels)
                tops.append(rows[-1][0])
                counts.append(len(below))
                depths.append(levels)
                children.append(b"".join(d for row in rows[:-1] for d in row))
            cols = [batch.column(0), batch.column(1), batch.column(2), pa.array(tops, pa.binary()), pa.array(counts, pa.int32()), pa.array(depths, pa.int32()), pa.array(children, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["tree", "rank", "size", "digest", "leaves", "depth", "children"])
        release()

    roots, records, k = [nodes.where("size = 1").select("tree", "digest")], [], 0
    while most > 1:
        blocks = nodes.where("size > 1").groupBy("tree", F.floor(F.col("rank") / width).alias("block")).agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("below"))
        made = blocks.mapInArrow(run, "tree bigint, rank bigint, size bigint, digest binary, leaves int, depth int, children binary")
        made = scratch.table(made, f"{name}{k}")
        records.append(made.select("digest", "leaves", "depth", "children"))
        nodes = made.select("tree", "rank", F.ceil(F.col("size") / width).alias("size"), "digest")
        roots.append(nodes.where("size = 1").select("tree", "digest"))
        most, k = -(-most // width), k + 1
    return records, roots


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def build_manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group_col: str = "lang", id_col: str = "doc_id", fanout: int = FANOUT, depth: int = LEVELS, forge: str | None = None) -> Manifest:
    """The manifest of a table: leaves hash fields in the given order, groups are the values of group_col, leaves ascend by id_col.

    A null group comes first; null ids come last in their group; rows of one id ascend by digest; rows that are wholly equal are
    leaves of their own.  Groups ascend by their UTF-8 bytes.  forge names an integer column of fields to which tampering adds one.
    Other columns are ignored, whatever their names.  The manifest of an empty table has no root.
    """
    scratch = Scratch(docs.sparkSession)
    value = {f: docs[f] for f in fields}
    wrong = value | ({forge: docs[forge] + 1} if forge else {})
    hit = F.crc32(docs[id_col].cast("string").cast("binary")) % TAMPER == 0
    rows = docs.select(
        docs[id_col].alias("id"), docs[group_col].cast("string").alias("group"), F.unhex(digest([*value.values()])).alias("leaf"), F.monotonically_increasing_id().alias("uid"),
        (F.when(hit & docs[forge].isNotNull(), F.unhex(digest([*wrong.values()]))) if forge else F.lit(None).cast("binary")).alias("forged"),
    )
    rows = scratch.table(rows, "rows")
    in_groups = [F.col("group").isNotNull(), F.coalesce(F.col("group"), F.lit(""))]
    placed = ranked(rows, [*in_groups, F.col("id").isNull(), F.col("id"), F.col("leaf"), F.col("uid")], scratch, "placed")
    groups = ranked(scratch.table(placed.groupBy("group").agg(F.min("place").alias("first"), F.count("*").alias("size")), "sizes"), in_groups, scratch, "groups")
    groups = groups.select(F.col("place").alias("tree"), "group", F.col("first"), "size", F.col("group").isNull().alias("__none"), F.coalesce("group", F.lit("")).alias("__key"))
    sums = groups.agg(F.count("*"), F.max("size"), F.sum("size")).first()
    n_groups, most, n = (x or 0 for x in sums)
    by_key = groups.withColumn("__key", F.concat(F.col("__none").cast("string"), "__key")).drop("__none", "group")
    keyed = placed.withColumn("__key", F.concat(F.col("group").isNull().cast("string"), F.coalesce("group", F.lit("")))).drop("group")
    keyed = keyed.join(F.broadcast(by_key), "__key") if n_groups <= FEW_KEYS else attach(keyed, by_key, "__key", "size", n)
    leaves = scratch.table(keyed.select("tree", (F.col("place") - F.col("first")).alias("rank"), "size", "id", "leaf", "forged"), "leaves")
    records, roots = _grow(leaves.select("tree", "rank", "size", F.col("leaf").alias("digest")), most, fanout, depth, scratch, "segments")
    groups = scratch.table(groups.select("tree", "group", "size").join(_all(roots).withColumnRenamed("digest", "subroot"), "tree"), "subroots")
    top = groups.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("rank"), F.lit(n_groups).cast("bigint").alias("size"), F.col("subroot").alias("digest"))
    above, root = _grow(top, n_groups, fanout, depth, scratch, "above")
    store = scratch.table(_all([*records, *above]).dropDuplicates(["digest"]), "store") if records or above else None
    found = _all(root).first()
    return Manifest(leaves, groups, store, bytes(found.digest) if found else None, scratch, fanout, depth, most, n_groups)


def _descend(m: Manifest, starts: DataFrame, requests: DataFrame, most: int, name: str) -> DataFrame:
    """requests (tree, rank, size, and others) with the proof of each, its path in its tree and then that of the tree's root, and that root (top).

    starts has tree, size, digest and proof of each root.
    """
    width, fanout = m.fanout**m.depth, m.fanout
    carried = [c for c in requests.columns if c not in ("tree", "rank", "size")]
    done = requests.where("size = 1").join(starts.select("tree", "proof", F.col("digest").alias("top")), "tree").select(*carried, "proof", "top")
    heights = 0
    while width**heights < most:
        heights += 1
    if not heights:
        return done

    def rows_of(leaves: int, depth: int, children: bytes) -> list[list[bytes]]:
        rows, at = [], 0
        for _ in range(depth):
            rows.append([children[k : k + 32] for k in range(at, at + 32 * leaves, 32)])
            at, leaves = at + 32 * leaves, -(-leaves // fanout)
        return [*rows, []]

    def answers(inner: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for tree, block, proof, top, leaves, depth, children, asked in zip(*(c.to_pylist() for c in batch.columns)):
                    rows = rows_of(leaves, depth, children)
                    found = [steps(rows, x["digit"], fanout) + proof for x in asked]
                    if inner:
                        columns = [[tree] * len(asked), [block * width + x["digit"] for x in asked], [rows[0][x["digit"]] for x in asked], found, [top] * len(asked)]
                    else:
                        columns = [*([x[c] for x in asked] for c in carried), found, [top] * len(asked)]
                    fields = INNER if inner else outer
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])
            release()

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    outer = [(c, to_arrow_type(requests.schema[c].dataType)) for c in carried] + [("proof", pa.binary()), ("top", pa.binary())]
    state = None
    for k in range(heights - 1, -1, -1):
        least = width**k  # trees with more leaves than that, and no more than width times as many, are entered here
        entered = starts.where((F.col("size") > least) & (F.col("size") <= least * width)).select("tree", F.lit(0).cast("bigint").alias("block"), "digest", "proof", F.col("digest").alias("top"))
        here = entered if state is None else entered.unionByName(state)
        records = here.join(m.store, "digest").select("tree", "block", "proof", "top", "leaves", "depth", "children")
        asked = requests.where(F.col("size") > least)
        own = F.floor(F.col("rank") / least)
        if k:
            asked = asked.select("tree", own.alias("own")).distinct().select("tree", F.floor(F.col("own") / width).alias("block"), F.struct((F.col("own") % width).cast("int").alias("digit")).alias("request"))
        else:
            asked = asked.where("size > 1").select("tree", F.floor(own / width).alias("block"), F.struct((own % width).cast("int").alias("digit"), *carried).alias("request"))
        asked = asked.groupBy("tree", "block").agg(F.collect_list("request").alias("asked"))  # at most width requests of different leaves
        met = records.join(asked, ["tree", "block"])
        met = met.select("tree", "block", "proof", "top", "leaves", "depth", "children", "asked")
        if not k:
            fields = ", ".join(f"`{c}` {requests.schema[c].dataType.simpleString()}" for c in carried)
            return done.unionByName(met.mapInArrow(answers(False), f"{fields}, proof binary, top binary"))
        state = m.scratch.table(met.mapInArrow(answers(True), "tree bigint, block bigint, digest binary, proof binary, top binary"), f"{name}{k}")


INNER = [("tree", pa.int64()), ("block", pa.int64()), ("digest", pa.binary()), ("proof", pa.binary()), ("top", pa.binary())]


def prove(m: Manifest, selected: Column | str = "true") -> DataFrame:
    """id, leaf, forged, subroot and proof of the selected leaves (a condition on tree, rank, size, id, leaf, forged).

    proof has, from the leaf up to the root, a byte for the place in the run, one for the run's length, and the digests of the others.
    """
    spark, run = m.leaves.sparkSession, uuid.uuid4().hex
    if m.root is None:
        return m.leaves.select("id", "leaf", "forged", F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("binary").alias("proof"))
    start = spark.createDataFrame([(0, m.n_groups, bytearray(m.root), bytearray())], "tree bigint, size bigint, digest binary, proof binary")
    asked = m.groups.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("rank"), F.lit(m.n_groups).cast("bigint").alias("size"), F.col("tree").alias("group"), F.col("size").alias("leaves"), "subroot")
    tops = m.scratch.table(_descend(m, start, asked, m.n_groups, f"{run}-upper"), f"{run}-tops").select(F.col("group").alias("tree"), F.col("leaves").alias("size"), F.col("subroot").alias("digest"), "proof")
    wanted = m.leaves.where(selected)
    return _descend(m, tops, wanted, m.most, f"{run}-lower").select("id", "leaf", "forged", F.col("top").alias("subroot"), "proof")


def verified_documents(docs: DataFrame, fields: Sequence[str] = FIELDS, group_col: str = "lang", id_col: str = "doc_id", forge: str = "n_chars", fanout: int = FANOUT, depth: int = LEVELS) -> DataFrame:
    """Every row proved against the root, some after tampering: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where TAMPER divides the CRC-32 of the decimal id, one is added to the column forge before its leaf is folded again with the
    original siblings; nulls there, and rows with null ids, stay as they are.  See build_manifest for nulls, ties and repeated rows.
    An empty table gives an empty result.
    """
    m = build_manifest(docs, fields, group_col, id_col, fanout, depth, forge)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    root = m.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        for batch in batches:
            leaves, shas, folds, subroots = [], [], [], []
            for leaf, forged, subroot, proof in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                leaves.append(leaf.hex())
                subroots.append(subroot.hex())
                shas.append(hashlib.sha256(b"".join(d for _, others in siblings(proof) for d in others).hex().encode()).hexdigest())
                folds.append(folded(forged or leaf, proof))
            columns = [leaves, subroots, [root.hex()] * len(leaves), shas, [f.hex() for f in folds]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns), pa.array([f == root for f in folds], pa.bool_())], names)
        release()

    return prove(m).mapInArrow(run, schema)
