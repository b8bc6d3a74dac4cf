"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when their sets of word shingles have a Jaccard similarity of at least `least` hundredths.  Shingles are ordered
by document frequency, rarest first.  If two documents link, then for every l the first p + l - 1 shingles of each in that order
share l at least, where p = size - needed + 1.  Each document picks its own l by estimated cost: its prefix of l meets the sum
of the document frequencies in it, and about that sum / l documents come to be verified.  Two documents with different l are held
to the smaller one, for which both prefixes are long enough.

1. frequencies: blocks send their distinct shingles (48 bits of the hash; a collision only makes a shingle look more frequent) and
   get document frequencies back.  A document with too few shingles that occur twice can have no link and leaves here.
2. prefixes: the others give their prefix shingles and sets.  Documents with equal sets are one node from here on.
3. stars: groups of nodes with a common prefix shingle may be large, so pairs inside them are not listed.  In each round the group
   picks a centre (first the node with the most common shingles, like an original among edited copies), every node is verified
   against the one centre with which it shares most, and nodes linked with one centre get one root.
4. rest, groups of up to GROUP nodes: nodes that share enough prefix shingles and have different roots are verified pair by pair.
   A row meets GROUP others at most.
5. rest, larger groups: what all members share says nothing there, so each member is described by its *difference* to what most
   members of the cluster (all groups with one centre) have.  Two sets differ by just what their differences differ by, so two
   members whose differences are small enough link for certain, and all others must share some element of them.  These elements
   are rare again; members are joined on prefixes of their differences, rarest elements first.

No link is lost: a pair under one root is connected already and adds nothing to the classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readlake.llm._shared import ROW, Ranges, Scratch, bucket_count, keeping_names, keyed_rows, mix, pack, release, squeeze, unpack, without, word_hashes
from readlake.llm.groups import attach, components

BLOCK_BYTES = 2 << 20
LONGEST = 8  # the largest l
VERIFY_COST = 20  # cost of verifying a candidate against that of meeting it in a prefix
STAR_ROUNDS = 2
GROUP = 32  # nodes with a common prefix shingle that are paired without another look
LOW = np.uint64(16)  # frequencies are counted by the hash without its low 16 bits


def shingle_sets(body: bytes, sizes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Document index and hash of the distinct shingles of each text, in order of both."""
    hashes, counts = word_hashes(body.lower(), sizes)  # bytes.lower changes A-Z only
    n = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(counts) - counts
    start = first[doc] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    end = start + np.minimum(counts[doc], words)
    token = mix(Ranges(hashes).of(start, end) + (end - start).astype(np.uint64))
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (token[1:] != token[:-1]))[: len(doc)]
    return doc[new], token[new]


def _cut48(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    of = ((tokens >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)
    starts = np.flatnonzero(np.diff(of, prepend=np.uint64(buckets)))
    return of[starts].astype(np.int64), np.append(starts, len(tokens))


def _shorten(values: np.ndarray) -> bytes:
    """Ascending integers as differences: 4 bytes each where they fit."""
    steps = np.diff(values, prepend=np.uint64(0))
    narrow = steps[1:].max(initial=0) < 1 << 32
    return values[:1].tobytes() + (b"4" + steps[1:].astype(np.uint32).tobytes() if narrow else b"8" + steps[1:].tobytes())


def _lengthen(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint32 if data[8:9] == b"4" else np.uint64, offset=9).astype(np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], np.uint64), steps]), dtype=np.uint64)


def code(df: np.ndarray) -> np.ndarray:
    """Document frequencies in a byte: exact up to 15, then quarters of a doubling."""
    return np.where(df < 16, df, np.minimum(16 + 4 * (np.log2(np.maximum(df, 16)) - 4), 255)).astype(np.uint8)


def decode(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.float64)
    return np.where(c < 16, c, 2.0 ** (4 + (c - 16) / 4))


def _frequency_rows(words: int, buckets: int):
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for batch in batches:
            out = {n: [] for n in schema.names}
            for block, sizes, body in zip(*(batch.column(c).to_pylist() for c in ("block", "sizes", "body"))):
                _, token = shingle_sets(unpack(body), np.array(sizes), words)
                tokens, n = np.unique(token >> LOW, return_counts=True)
                of, bounds = _cut48(tokens, buckets)
                for b, i, j in zip(of.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    for name, value in zip(schema.names, (b, block, _shorten(tokens[i:j]), squeeze(n[i:j].astype(np.uint32).tobytes()))):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema)
        release()

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block, the coded document frequencies of its shingles."""
    parts = [_lengthen(t) for t in table.column("tokens").to_pylist()]
    counts = np.frombuffer(b"".join(unpack(c) for c in table.column("counts").to_pylist()), np.uint32)
    _, of = np.unique(np.concatenate(parts), return_inverse=True)
    df = code(np.bincount(of, counts))[of]
    coded = [squeeze(c.tobytes()) for c in np.split(df, np.cumsum([len(p) for p in parts])[:-1])]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "codes": pa.array(coded, pa.binary())})


_PREFIX = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("tokens", pa.binary()), ("levels", pa.binary()), ("afters", pa.binary()), ("l", pa.int32()), ("shared", pa.float64()), ("alive", pa.int64())])


def prefix_of(codes: np.ndarray, tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The prefix shingles that others have too, the smallest l whose prefix holds each, how many such shingles follow each, and the chosen l."""
    n = len(tokens)
    needed = -(-least * n // 100)
    base = n - needed + 1
    top = min(LONGEST, needed)
    order = np.lexsort((tokens, codes))[: base + top - 1]
    met = np.where(codes[order] > 1, decode(codes[order]) - 1, 0.0)
    sums = np.cumsum(met)[base - 1 :]
    l = int(np.argmin(sums * (1 + VERIFY_COST / np.arange(1, top + 1)))) + 1  # noqa: E741
    order = order[: base + l - 1]
    level = np.maximum(np.arange(len(order)) - base + 2, 1)
    shared = codes[order] > 1
    after = int((codes > 1).sum()) - np.cumsum(shared)[shared]
    return tokens[order][shared], level[shared].astype(np.int32), after.astype(np.int32), l


def _prefix_rows(words: int, buckets: int, least: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {n: [] for n in _PREFIX.names}
        replies = dict(zip(right.column("bucket").to_pylist(), right.column("codes").to_pylist()))
        for ids, sizes, body in zip(*(left.column(c).to_pylist() for c in ("ids", "sizes", "body"))):
            doc, token = shingle_sets(unpack(body), np.array(sizes), words)
            tokens, of_token = np.unique(token >> LOW, return_inverse=True)
            of, _ = _cut48(tokens, buckets)
            codes = np.frombuffer(b"".join(unpack(replies[b]) for b in of.tolist()), np.uint8)[of_token]
            bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
            alive = np.concatenate([[0], np.cumsum(codes > 1)])
            alive = alive[bounds[1:]] - alive[bounds[:-1]]
            seen = set()
            for k, (doc_id, i, j) in enumerate(zip(ids, bounds[:-1].tolist(), bounds[1:].tolist())):
                node = None
                if j > i and 100 * alive[k] >= least * (j - i):
                    node = int(mix(np.array([mix(token[i:j]).sum(dtype=np.uint64) + np.uint64(j - i)], np.uint64))[0] >> np.uint64(1))
                    if node not in seen:
                        seen.add(node)
                        some, level, after, l = prefix_of(codes[i:j], token[i:j], least)  # noqa: E741
                        for name, value in zip(_PREFIX.names, (1, None, j - i, node, some.tobytes(), level.tobytes(), after.tobytes(), l, float(np.log2(decode(codes[i:j])).mean()), int(alive[k]))):
                            out[name].append(value)
                        for name, value in zip(_PREFIX.names, (2, None, j - i, node, token[i:j].tobytes(), None, None, None, None, None)):
                            out[name].append(value)
                for name, value in zip(_PREFIX.names, (0, doc_id, j - i, node, None, None, None, None, None, None)):
                    out[name].append(value)
        return pa.Table.from_pydict(out, _PREFIX)

    return run


def _explode(batches):
    for batch in batches:
        tokens = [np.frombuffer(x, np.int64) for x in batch.column("tokens").to_pylist()]
        of = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        levels = [np.frombuffer(x, np.int32) for x in batch.column("levels").to_pylist()]
        afters = [np.frombuffer(x, np.int32) for x in batch.column("afters").to_pylist()]
        many = lambda c: batch.column(c).take(pa.array(of))
        flat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0, t), pa.from_numpy_dtype(t))
        yield pa.RecordBatch.from_arrays([flat(tokens, np.int64), many("node"), many("n"), flat(levels, np.int32), flat(afters, np.int32), many("l"), many("shared"), many("alive")], ["token", "node", "n", "level", "after", "l", "shared", "alive"])


def _verify(least: int):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_u"), batch.column("set_v")):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= least * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))
        release()

    return run


def _differences(batches):
    for batch in batches:
        sides = ([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(c)] for c in ("set_v", "set_c"))
        different = pa.array([np.setxor1d(a, b, assume_unique=True) for a, b in zip(*sides)], pa.list_(pa.int64()))
        names = ["c", "node", "n", "alive", "root"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), different], [*names, "d"])


def _by_differences(members: DataFrame, sets: DataFrame, least: int, sized: F.Column, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of clusters (c, node, n, alive, root): links that are certain, and other pairs that may link and have different roots.

    Sets of n and m elements link when (100 + least) * (elements in one of them only) <= (100 - least) * (n + m).  With
    w = (100 + least) * |difference| - (100 - least) * n for each, two link for certain when the sum of w is 0 or less; else their
    differences must share sum / span elements.  The hub, the member with the least w, links for certain with every member that
    some member does; the others are *loose*.  Of two members that the hub does not connect one is loose, which bounds the sum.
    """
    span = 2 * (100 + least)
    side = lambda key, out: sets.select(F.col("node").alias(key), F.col("tokens").alias(out))
    near = members.join(side("node", "set_v"), "node").join(side("c", "set_c"), "c").select("c", "node", "n", "alive", "root", "set_v", "set_c")
    near = scratch.table(near.mapInArrow(_differences, "c bigint, node bigint, n bigint, alive bigint, root bigint, d array<bigint>"), "near")
    rows = near.count()
    sizes = near.groupBy("c").agg(F.count("*").alias("members"))
    # elements in most differences; a cluster has at most twice as many as a mean difference
    most = near.select("c", F.explode("d").alias("t")).groupBy("c", "t").agg(F.count("*").alias("f")).join(sizes, "c").where("2 * f > members")
    flips = sizes.join(most.groupBy("c").agg(F.collect_list("t").alias("flip")), "c", "left").withColumn("flip", F.coalesce("flip", F.array().cast("array<bigint>")))
    flipped = attach(near, scratch.table(flips, "flips"), "c", "members", rows).withColumn("d", F.concat(F.array_except("d", "flip"), F.array_except("flip", "d")))
    weighed = scratch.table(flipped.select("c", "node", "n", "alive", "root", "d", ((100 + least) * F.size("d") - (100 - least) * F.col("n")).alias("w")), "weighed")
    w0 = F.col("hub.w0")
    hubs = weighed.groupBy("c").agg(F.min(F.struct(F.col("w").alias("w0"), F.col("node").alias("hub"))).alias("hub"), F.max("w").alias("top"), F.count("*").alias("members"))
    told = attach(weighed, scratch.table(hubs, "hubs"), "c", "members", rows).withColumn("loose", F.col("w") + w0 > 0)
    certain = told.where(~F.col("loose") & (F.col("node") != F.col("hub.hub"))).select(F.col("hub.hub").alias("u"), F.col("node").alias("v"))
    share = F.ceil(F.when(F.col("loose"), F.col("w") + w0).otherwise(F.col("w") - w0 + 1) / span)
    told = told.where(F.col("top") + w0 > 0).withColumn("prefix", F.size("d") - share + 1)
    elements = told.select("c", "node", "n", "alive", "root", "w", "loose", "prefix", F.size("d").alias("size"), F.explode("d").alias("t"))
    elements = scratch.table(elements, "elements")
    shared = elements.groupBy("c", "t").agg(F.count("*").alias("f"), F.max("loose").alias("open")).where("open")
    placed = elements.join(shared, ["c", "t"], "left").withColumn("place", F.row_number().over(Window.partitionBy("c", "node").orderBy(F.coalesce("f", F.lit(1)), "t")))
    chosen = scratch.table(placed.where("place <= prefix and f > 1").withColumn("after", F.col("size") - F.col("place")).drop("place", "prefix", "size", "f", "open"), "chosen")
    other = chosen.where("loose").select("c", "t", *(F.col(c).alias(d) for c, d in (("node", "u"), ("n", "m"), ("alive", "alive_u"), ("root", "ur"), ("w", "w_u"), ("after", "after_u"))))
    once = ~F.col("loose") | (F.col("u") < F.col("node"))
    pairs = chosen.join(other, ["c", "t"]).where(once & (F.col("u") != F.col("node")) & (F.col("root") != F.col("ur")) & sized)
    pairs = pairs.groupBy("c", "u", F.col("node").alias("v")).agg((F.count("*") + F.min(F.least("after", "after_u"))).alias("bound"), F.first(F.col("w") + F.col("w_u")).alias("sum"))
    return scratch.table(certain, "certain"), pairs.where(F.col("bound") * span >= F.col("sum")).select("u", "v")


def jaccard_classes(docs: DataFrame, least: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included).

    Shingles are distinct runs of `words` words [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased; a text with fewer words has one
    shingle of all of them; a null text or one without words has none and links with nothing.  Rows that repeat a doc_id are
    documents of their own.  Null doc_ids are ignored when the smallest is sought.  An empty table gives an empty result.  Other
    columns are ignored.
    """
    spark = docs.sparkSession
    scratch, buckets = Scratch(spark), bucket_count(spark)
    blocks = scratch.table(pack(docs, id_col, text_col, BLOCK_BYTES), "blocks")
    rows = blocks.select("block", "sizes", "body").mapInArrow(_frequency_rows(words, buckets), "bucket bigint, block bigint, tokens binary, counts binary")
    codes = scratch.table(rows.groupBy("bucket").applyInArrow(_frequencies, "block bigint, bucket bigint, codes binary"), "codes")
    mixed = blocks.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(_prefix_rows(words, buckets, least), "kind int, doc_id bigint, n bigint, node bigint, tokens binary, levels binary, afters binary, l int, shared double, alive bigint")
    mixed = scratch.table(mixed, "prefixes")
    scratch.drop("blocks"), scratch.drop("codes")
    found = mixed.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "node")
    sets = scratch.table(mixed.where("kind = 2").groupBy("node").agg(F.first("tokens").alias("tokens")), "sets")  # one of the equal sets of several blocks
    tokens = mixed.where("kind = 1").select("node", "n", "tokens", "levels", "afters", "l", "shared", "alive").mapInArrow(_explode, "token bigint, node bigint, n bigint, level int, after int, l int, shared double, alive bigint")
    tokens = scratch.table(tokens.groupBy("token", "node").agg(*(F.min(c).alias(c) for c in ("n", "level", "after", "l", "shared", "alive"))), "tokens")  # equal nodes of several blocks

    # shingles that no other document has are not common to a pair, so the fewer of those left bound what it shares
    most = F.least("alive", "alive_u")
    sized = (F.least("n", "m") * 100 >= F.greatest("n", "m") * least) & (most * 100 >= (F.col("n") + F.col("m") - most) * least)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        with_v = pairs.join(sets.select(F.col("node").alias("v"), F.col("tokens").alias("set_v")), "v")
        with_u = with_v.join(sets.select(F.col("node").alias("u"), F.col("tokens").alias("set_u")), "u")
        return scratch.table(with_u.select("u", "v", "set_u", "set_v").mapInArrow(_verify(least), "u bigint, v bigint"), name)

    def labelled(links: DataFrame | None) -> DataFrame:
        """A root for each node such that nodes of one root are connected; connected nodes may still have different roots."""
        if links is None:
            return tokens.withColumn("root", F.col("node"))
        centre = links.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("c"))
        twice = centre.join(centre.select(F.col("node").alias("c"), F.col("c").alias("cc")), "c", "left").select("node", F.coalesce("cc", "c").alias("root"))
        return tokens.join(twice, "node", "left").withColumn("root", F.coalesce("root", "node"))

    links = None
    for k in range(STAR_ROUNDS + 1):
        rooted = labelled(links)
        # first the node whose shingles are the most common, as those of an original among its edited copies; then any other
        rank = F.struct(-F.col("shared"), F.col("node")) if k == 0 else F.struct(F.lit(0.0), F.xxhash64(F.lit(k), "node"))
        groups = rooted.groupBy("token").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.min_by(F.struct("node", "n", "alive", "root"), rank).alias("c"), F.count("*").alias("members")).where("r1 != r2")
        open_ = scratch.table(rooted.join(groups.select("token", "members", F.col("c.node").alias("u"), F.col("c.n").alias("m"), F.col("c.alive").alias("alive_u"), F.col("c.root").alias("ur")), "token"), f"open{k}")
        if open_.isEmpty():
            break
        if k < STAR_ROUNDS:
            pairs = open_.where(F.col("root") != F.col("ur")).where(sized).groupBy("u", F.col("node").alias("v")).agg(F.count("*").alias("common"))
            pairs = pairs.groupBy("v").agg(F.max_by("u", F.struct("common", "u")).alias("u")).select("u", "v")
        else:
            side = open_.where(F.col("members") <= GROUP).select("token", "node", "n", "alive", "level", "after", "l", "root")
            other = side.select("token", *(F.col(c).alias(d) for c, d in (("node", "u"), ("n", "m"), ("alive", "alive_u"), ("level", "level_u"), ("after", "after_u"), ("l", "l_u"), ("root", "ur"))))
            fits = F.greatest("level", "level_u") <= F.least("l", "l_u")
            pairs = side.join(other, "token").where((F.col("u") < F.col("node")) & (F.col("root") != F.col("ur")) & sized & fits)
            # a pair shares what it shares in the prefixes, and after the last of that at most what either has left
            found_ = F.count("*").alias("common"), F.min(F.least("after", "after_u")).alias("left"), F.first(F.least("l", "l_u")).alias("l"), F.first("n").alias("n"), F.first("m").alias("m")
            bound = F.col("common") + F.col("left")
            pairs = pairs.groupBy("u", F.col("node").alias("v")).agg(*found_).where("common >= l").where(bound * 100 >= (F.col("n") + F.col("m") - bound) * least).select("u", "v")
            members = open_.where(F.col("members") > GROUP).select(F.col("u").alias("c"), "node", "n", "alive", "root").distinct()
            certain, more = _by_differences(members, sets, least, sized, scratch)
            pairs = pairs.unionByName(more).distinct()
            links = certain if links is None else links.unionByName(certain)
        new = verified(pairs, f"links{k}")
        links = new if links is None else links.unionByName(new)
    if links is None:
        links = spark.createDataFrame([], "u bigint, v bigint")
    roots = scratch.table(components(links, scratch, "roots"), "roots-last")
    found = found.join(roots, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root", "node")
    found = scratch.table(found, "found")
    classed = found.where(F.col("class").isNotNull())
    least_id = scratch.table(classed.groupBy("class").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members")), "classes")
    for name in ("prefixes", "sets", "tokens", "near", "flips", "weighed", "hubs", "elements", "chosen", "certain", "roots-last", *(f"{x}{k}" for k in range(STAR_ROUNDS + 1) for x in ("open", "links"))):
        scratch.drop(name)  # the result reads found and classes only
    many = attach(classed, least_id, "class", "members", found.count())
    alone = found.where(F.col("class").isNull()).withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    return many.select(*columns).unionByName(alone.select(*columns))


@keeping_names
def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of docs for each class, with all its columns: that of the smallest doc_id, null ones last.

    Of rows that repeat the smallest doc_id in a class one stays.  Null texts and texts without words are classes of their own.  An
    empty table gives an empty result.  Columns may have any names.
    """
    scratch, rows = Scratch(docs.sparkSession), keyed_rows(docs)
    classes = jaccard_classes(rows, id_col=ROW, text_col=text_col, **how).select(F.col("doc_id").alias(ROW), F.col("component_id").alias("class"))
    classes = scratch.table(classes, "classed")
    rank = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col(ROW))
    first = classes.join(rows.select(ROW, F.col(id_col).alias("id")), ROW).groupBy("class").agg(F.min(rank).alias("first"))
    return without(rows, classes.join(first.select(f"first.{ROW}"), ROW, "left_anti"), scratch)
