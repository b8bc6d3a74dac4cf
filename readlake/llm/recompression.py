"""Substring dedup by recompression.

A document is a sequence of words.  A round of recompression first renames every maximal run of one symbol, then every pair of a
"left" symbol followed by a "right" one, where a bit of the symbol's own name says which it is.  New names are 64-bit hashes of
what they stand for, so naming is global: equal substrings get equal symbols in every document, except near their ends.  With each
symbol goes its *context*, the stretch of words that decided it; a window that holds the context of a symbol has that symbol
wherever the window occurs.

Spark rounds over blocks of documents:

1. share: among the symbols whose context lies inside a window, the window's anchor is the one with the smallest name.  Blocks send
   their distinct anchors, keyed by the hash of the words of the context; those in two documents or more are shared.
2. verify: windows with a shared anchor (or none, as inside long runs) are sent as hashes of their own words with the smallest
   doc_id of the block; the smallest doc_id over all blocks comes back.
3. remove: each document drops the words under windows that also start in a document with a smaller doc_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from readlake.llm._shared import NO_ID, Ranges, Scratch, bits, bucket_count, cut, ids_of, mix, pack, spans_to_mask, squeeze, unbits, unpack, word_hashes

BLOCK_BYTES = 2 << 20
ROUNDS = 2
#: The symbol between documents; no window holds one.
EDGE = np.uint64(0xD6E8FEB86659FD93)


class Words:
    """The words of a block as hashes, with an edge before, between and after its documents."""

    def __init__(self, body: bytes, sizes: np.ndarray):
        hashes, counts = word_hashes(body, sizes)
        self.counts = counts
        self.first = 1 + np.cumsum(counts + 1) - (counts + 1)  # place of each document's first word
        self.hashes = np.full(int(counts.sum()) + len(counts) + 1, EDGE, np.uint64)
        inside = np.ones(len(self.hashes), bool)
        inside[np.append(self.first - 1, len(inside) - 1)] = False
        self.hashes[inside] = hashes
        self.ranges = Ranges(self.hashes)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The start of each window inside a document, and the index of that document."""
        n = np.maximum(self.counts - width + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + self.first[doc], doc


def symbols(hashes: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the symbols after some rounds, and the start and end of the context of each."""
    name, low = hashes, np.arange(len(hashes))
    high = low + 1
    for k in range(rounds):
        # runs: a block of equal neighbours gets the name of (symbol, length); the neighbours outside it belong to its context
        start = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        size = np.diff(np.append(start, len(name)))
        last = start + size - 1
        low, high = low[np.maximum(start - 1, 0)], high[np.minimum(last + 1, len(name) - 1)]
        name = np.where(size > 1, mix(name[start] + np.uint64(0x9E3779B97F4A7C15) * size.astype(np.uint64)), name[start])
        # pairs: left then right; an unpaired symbol also depends on the neighbour that it was not paired with
        left = mix(name + np.uint64(k + 1)) >> np.uint64(63) == 1
        pair = np.append(left[:-1] & ~left[1:], False)
        second = np.append(False, pair[:-1])
        after, before = np.append(np.arange(1, len(name)), len(name) - 1), np.maximum(np.arange(len(name)) - 1, 0)
        new = name.copy()
        at = np.flatnonzero(pair)
        new[at] = mix(name[at] * np.uint64(0xC2B2AE3D27D4EB4F) + mix(name[at + 1] + np.uint64(k)))
        high = np.where(left, high[after], high)
        low = np.where(left, low, low[before])
        keep = ~second
        name, low, high = new[keep], low[keep], high[keep]
    return name, low, high


def anchors(words: Words, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of each window's anchor, and which windows have one."""
    _, low, high = symbols(words.hashes)
    key = mix(words.ranges.of(low, high) ^ np.uint64(0xA0761D6478BD642F))
    from_ = np.searchsorted(low, starts)  # contexts never start or end before those of earlier symbols
    count = np.searchsorted(high, starts + width, "right") - from_
    best = np.full(len(starts), np.iinfo(np.uint64).max, np.uint64)
    for k in range(max(0, int(count.max(initial=0)))):
        at = np.flatnonzero(count > k)
        best[at] = np.minimum(best[at], key[from_[at] + k])
    return best, count > 0


def _distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys, and whether more than one document has each; docs ascend within equal keys after a stable sort."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    if not len(start):
        return keys, np.zeros(0, bool)
    last = np.append(start[1:], len(keys)) - 1
    return keys[start], docs[start] != docs[last]


def _share_rows(width: int, buckets: int):
    def run(batches):
        for batch in batches:
            out = {"bucket": [], "block": [], "keys": [], "many": []}
            for block, sizes, body in zip(*(batch.column(c).to_pylist() for c in ("block", "sizes", "body"))):
                words = Words(unpack(body), np.array(sizes))
                starts, doc = words.windows(width)
                key, has = anchors(words, starts, width)
                keys, many = _distinct(key[has], doc[has])
                of, bounds = cut(keys, buckets)
                for b, i, j in zip(of.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    out["bucket"].append(b), out["block"].append(block), out["keys"].append(keys[i:j].tobytes()), out["many"].append(bits(many[i:j]))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("many", pa.binary())]))

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block, which of its keys occur in two documents or more."""
    parts = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
    many = np.concatenate([unbits(m, len(p)) for m, p in zip(table.column("many").to_pylist(), parts)])
    keys, of, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared = n > 1
    shared[of[many]] = True
    flags = np.split(shared[of], np.cumsum([len(p) for p in parts])[:-1])
    rows = [(b, k, bits(f)) for b, k, f in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), flags) if f.any()]
    cols = list(zip(*rows)) or [[], [], []]
    return pa.table({"block": pa.array(cols[0], pa.int64()), "bucket": pa.array(cols[1], pa.int64()), "flags": pa.array(cols[2], pa.binary())})


def _window_rows(width: int, buckets: int):
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("least", pa.binary()), ("many", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {n: [] for n in schema.names}
        replies = dict(zip(right.column("bucket").to_pylist(), right.column("flags").to_pylist()))
        for block, ids, sizes, body in zip(*(left.column(c).to_pylist() for c in ("block", "ids", "sizes", "body"))):
            words = Words(unpack(body), np.array(sizes))
            starts, doc = words.windows(width)
            key, has = anchors(words, starts, width)
            keys, of_key = np.unique(key[has], return_inverse=True)
            of, bounds = cut(keys, buckets)
            shared = np.zeros(len(keys), bool)
            for b, i, j in zip(of.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                if b in replies:
                    shared[i:j] = unbits(replies[b], j - i)
            wanted = ~has
            wanted[has] = shared[of_key]
            at, who = starts[wanted], ids_of(ids)[doc[wanted]]
            order = np.argsort(who, kind="stable")
            hashes = mix(words.ranges.of(at, at + width))[order]
            who = who[order]
            first = np.argsort(hashes, kind="stable")
            hashes, who = hashes[first], who[first]
            start = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)])
            if not len(start):
                continue
            last = np.append(start[1:], len(hashes)) - 1
            keys, least, many = hashes[start], who[start], who[start] != who[last]
            of, bounds = cut(keys, buckets)
            for b, i, j in zip(of.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                out["bucket"].append(b), out["block"].append(block), out["keys"].append(keys[i:j].tobytes())
                out["least"].append(squeeze(least[i:j].tobytes())), out["many"].append(bits(many[i:j]))
        return pa.Table.from_pydict(out, schema)

    return run


def _least(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block, its windows that a smaller doc_id also has, and the smallest such doc_id."""
    parts = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
    own = np.concatenate([np.frombuffer(unpack(x), np.int64) for x in table.column("least").to_pylist()])
    many = np.concatenate([unbits(m, len(p)) for m, p in zip(table.column("many").to_pylist(), parts)])
    all_keys = np.concatenate(parts)
    _, of = np.unique(all_keys, return_inverse=True)
    least = np.full(int(of.max(initial=-1)) + 1, NO_ID, np.int64)
    np.minimum.at(least, of, own)
    least = least[of]
    told = many | (least < own)
    ends = np.cumsum([len(p) for p in parts])
    rows = []
    for block, i, j in zip(table.column("block").to_pylist(), ends - [len(p) for p in parts], ends):
        t = told[i:j]
        if t.any():
            rows.append((block, squeeze(all_keys[i:j][t].tobytes()), squeeze(least[i:j][t].tobytes())))
    cols = list(zip(*rows)) or [[], [], []]
    return pa.table({"block": pa.array(cols[0], pa.int64()), "keys": pa.array(cols[1], pa.binary()), "least": pa.array(cols[2], pa.binary())})


def _remove(width: int, with_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": []} | ({"text": []} if with_text else {})
        keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(unpack(k), np.uint64) for k in right.column("keys").to_pylist())])
        least = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(unpack(k), np.int64) for k in right.column("least").to_pylist())])
        order = np.argsort(keys)
        keys, least = keys[order], least[order]
        for ids, sizes, body in zip(*(left.column(c).to_pylist() for c in ("ids", "sizes", "body"))):
            body = unpack(body)
            gone = first = None
            if len(keys):
                words = Words(body, np.array(sizes))
                first = words.first.tolist()
                starts, doc = words.windows(width)
                hashes = mix(words.ranges.of(starts, starts + width))
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = starts[(keys[at] == hashes) & (least[at] < ids_of(ids)[doc])]
                gone = spans_to_mask(len(words.hashes), hit, hit + width)
            at = 0
            for k, (doc_id, size) in enumerate(zip(ids, sizes)):
                text = body[at : at + size].split()  # divides at the six ASCII white space characters
                at += size
                drop = gone[first[k] : first[k] + len(text)] if len(keys) else np.zeros(0, bool)
                removed = int(drop.sum())
                kept = b" ".join([w for w, x in zip(text, drop.tolist()) if not x] if removed else text)
                out["doc_id"].append(doc_id), out["n_words"].append(len(text)), out["n_removed"].append(removed), out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    out["text"].append(kept.decode())
        schema = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
        return pa.Table.from_pydict(out, pa.schema(schema + ([("text", pa.string())] if with_text else [])))

    return run


def substring_dedup(docs: DataFrame, width: int = 13, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (and text, the kept words joined by one space, if asked for).

    Words [^\\x20\\x09-\\x0D]+ are removed where a window of width of them also starts in a document with a smaller doc_id.  Null
    texts have no words.  A null doc_id counts as larger than any other; rows that share a doc_id do not remove each other's words.
    Texts shorter than the window stay whole.  An empty table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch, buckets = Scratch(spark), bucket_count(spark)
    blocks = scratch.table(pack(docs, id_col, text_col, BLOCK_BYTES), "blocks")
    rows = blocks.select("block", "sizes", "body").mapInArrow(_share_rows(width, buckets), "bucket bigint, block bigint, keys binary, many binary")
    shared = scratch.table(rows.groupBy("bucket").applyInArrow(_shared, "block bigint, bucket bigint, flags binary"), "shared")
    rows = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_window_rows(width, buckets), "bucket bigint, block bigint, keys binary, least binary, many binary")
    least = scratch.table(rows.groupBy("bucket").applyInArrow(_least, "block bigint, keys binary, least binary"), "least")
    scratch.drop("shared")
    out = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", text string" if with_text else "")
    return blocks.groupBy("block").cogroup(least.groupBy("block")).applyInArrow(_remove(width, with_text), out)


