"""Substring dedup over bytes with a sparse suffix array, sorted deep-shallow.

A string of `width` bytes has an *anchor*: the leftmost of its GRAM-byte strings with the smallest hash.  Wherever the string
occurs it has the same anchor at the same place, so only suffixes that start at anchors (about one in 170 bytes) need sorting.
An anchor's *context* is the bytes before and after it that strings with this anchor can hold.

1. gather: blocks send their distinct (anchor, context) hashes.  An anchor that occurs once repeats nothing.  A context that
   occurs twice repeats everything.  What is left are anchors met in different contexts.
2. sort: those contexts meet by anchor.  Multikey quicksort orders the suffixes to a shallow depth; blind tries order the groups
   that are still equal there and give the lengths of common prefixes between neighbours, and the same for the reversed bytes
   before the anchor.  Both together tell, for each context, the first and last string that another context shares.
   An anchor with over MANY contexts (a common passage in very many surroundings, some 3 MB of them) is not gathered in one task:
   its strings are compared as hashes, combined per block, over all tasks.
3. remove: each document drops the bytes under repeated strings.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from readlake.llm._shared import BYTE_VALUES, Ranges, Scratch, bits, bucket_count, cut, mix, pack, spans_to_mask, squeeze, unbits, unpack

BLOCK_BYTES = 1 << 20
GRAM = 64
SHALLOW = 16  # bytes that multikey quicksort looks at
MANY = 4096
FULL, SEND, HASH = 1, 2, 4  # what a reply says of a context


class Anchors:
    """Anchors of the strings of width bytes inside the texts of a block; first and last string start of each."""

    def __init__(self, body: bytes, sizes: np.ndarray, width: int):
        data = np.frombuffer(body, np.uint8)
        ends = np.cumsum(sizes).astype(np.int64)
        n = len(data) - width + 1
        if n <= 0:
            self.place = self.first = self.last = np.zeros(0, np.int64)
            self.key = self.context = np.zeros(0, np.uint64)
            return
        ranges = self.ranges = Ranges(BYTE_VALUES[data])
        starts = np.arange(len(data) - GRAM + 1)
        gram = mix(ranges.of(starts, starts + GRAM))
        below = np.uint64((1 << len(data).bit_length()) - 1)
        least = (gram & ~below) | starts.astype(np.uint64)  # the place breaks ties
        span, have = width - GRAM + 1, 1
        while 2 * have <= span:
            least = np.minimum(least[: len(least) - have], least[have:])
            have *= 2
        if have < span:
            least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
        valid = np.zeros(n + 1, np.int64)
        long = sizes >= width
        np.add.at(valid, ends[long] - sizes[long], 1)
        np.add.at(valid, ends[long] - width + 1, -1)
        s = np.flatnonzero(np.cumsum(valid[:n]) > 0)
        place = (least[s] & below).astype(np.int64)
        new = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
        self.place, self.first, self.last = place[new], s[new], s[np.append(new[1:], len(s)) - 1] if len(new) else new
        doc = np.searchsorted(ends, self.place, "right")
        self.low = np.maximum(self.place - (width - GRAM), (ends - sizes)[doc])
        self.high = np.minimum(self.place + width, ends[doc])
        self.key = gram[self.place]
        self.context = mix(ranges.of(self.low, self.high) + mix(((self.place - self.low) << 32 | (self.high - self.low)).astype(np.uint64)))


def _sketch(width: int):
    def run(body: bytes, sizes: np.ndarray, ids: np.ndarray) -> dict:
        a = Anchors(body, sizes, width)
        return {"anchors": squeeze(np.stack([a.place, a.first, a.last]).astype(np.int64).tobytes()), "hashes": np.stack([a.key, a.context]).tobytes()}

    return run


def _entries(hashes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, context) in order: keys, contexts, counts, the first anchor of each, and the entry of each anchor."""
    key, context = np.frombuffer(hashes, np.uint64).reshape(2, -1)
    order = np.lexsort((context, key))
    k, c = key[order], context[order]
    new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))[: len(k)]
    start = np.flatnonzero(new)
    of = np.zeros(len(k), np.int64)
    of[order] = np.cumsum(new) - 1
    return k[start], c[start], np.diff(np.append(start, len(k))), order[start], of


def _gather_rows(buckets: int):
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("contexts", pa.binary()), ("many", pa.binary())])

    def run(batches):
        for batch in batches:
            out = {n: [] for n in schema.names}
            for block, hashes in zip(batch.column("block").to_pylist(), batch.column("hashes").to_pylist()):
                keys, contexts, n, _, _ = _entries(hashes)
                of, bounds = cut(keys, buckets)
                for b, i, j in zip(of.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    for name, value in (("bucket", b), ("block", block), ("keys", keys[i:j].tobytes()), ("contexts", contexts[i:j].tobytes()), ("many", bits(n[i:j] > 1))):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema)

    return run


def _judge(table: pa.Table, most: int) -> pa.Table:
    """Of one bucket: for each block, what its contexts are."""
    keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    sizes = [len(k) for k in keys]
    many = np.concatenate([unbits(m, n) for m, n in zip(table.column("many").to_pylist(), sizes)])
    key, context = np.concatenate(keys), np.frombuffer(b"".join(table.column("contexts").to_pylist()), np.uint64)
    order = np.lexsort((context, key))
    k, c = key[order], context[order]
    new_key = np.append(True, k[1:] != k[:-1])
    new = new_key | np.append(True, c[1:] != c[:-1])
    entry, group = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    full = (np.bincount(entry) > 1) | (np.bincount(entry, many[order]) > 0)
    group_of = group[new]
    contexts = np.bincount(group_of)
    open_ = (contexts > 1) & (np.bincount(group_of, ~full) > 0)
    state = np.where(full, FULL, 0) + np.where(open_[group_of], np.where(contexts[group_of] > most, HASH, SEND), 0)
    out = np.zeros(len(key), np.uint8)
    # of a context that several blocks have only one block sends it: the others need no answer, for it is repeated
    out[order] = np.where(new | ~full[entry], state[entry], FULL)
    rows = [(b, kb, squeeze(f.tobytes())) for b, kb, f in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), np.split(out, np.cumsum(sizes)[:-1])) if f.any()]
    cols = list(zip(*rows)) or [[], [], []]
    return pa.table({"block": pa.array(cols[0], pa.int64()), "kind": pa.array([0] * len(rows), pa.int32()), "bucket": pa.array(cols[1], pa.int64()), "data": pa.array(cols[2], pa.binary())})


def _states(keys: np.ndarray, buckets: int, right: pa.Table) -> np.ndarray:
    replies = {b: d for k, b, d in zip(*(right.column(c).to_pylist() for c in ("kind", "bucket", "data"))) if k == 0}
    state = np.zeros(len(keys), np.uint8)
    of, bounds = cut(keys, buckets)
    for b, i, j in zip(of.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        if b in replies:
            state[i:j] = np.frombuffer(unpack(replies[b]), np.uint8)
    return state


def _string_hashes(a: Anchors, which: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all strings of some anchors."""
    n = a.last[which] - a.first[which] + 1
    s = np.repeat(a.first[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return s, mix(a.ranges.of(s, s + width))


_SORT_SCHEMA = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("entries", pa.binary()), ("flags", pa.binary()), ("lefts", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary())])


def _sort_rows(width: int, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {n: [] for n in _SORT_SCHEMA.names}
        if right.num_rows:
            for block, sizes, body, hashes in zip(*(left.column(c).to_pylist() for c in ("block", "sizes", "body", "hashes"))):
                keys, _, counts, first, of_entry = _entries(hashes)
                state = _states(keys, buckets, right)
                if not (state & (SEND | HASH)).any():
                    continue
                body = unpack(body)
                a = Anchors(body, np.array(sizes), width)
                send = np.flatnonzero(state & SEND)
                of, bounds = cut(keys[send], buckets)
                for b, i, j in zip(of.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    at = first[send[i:j]]
                    low, place, high = a.low[at], a.place[at], a.high[at]
                    row = (b, block, 0, keys[send[i:j]].tobytes(), send[i:j].astype(np.int64).tobytes(), bits(state[send[i:j]] & FULL > 0), (place - low).astype(np.int32).tobytes(), (high - low).astype(np.int32).tobytes(), squeeze(b"".join([body[x:y] for x, y in zip(low.tolist(), high.tolist())])))
                    for name, value in zip(_SORT_SCHEMA.names, row):
                        out[name].append(value)
                hot = np.flatnonzero(state & HASH)
                if len(hot):
                    _, strings = _string_hashes(a, np.flatnonzero(state[of_entry] & HASH), width)
                    distinct, n = np.unique(strings, return_counts=True)
                    of, bounds = cut(distinct, buckets)
                    for b, i, j in zip(of.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                        for name, value in zip(_SORT_SCHEMA.names, (b, block, 1, distinct[i:j].tobytes(), b"", bits(n[i:j] > 1), b"", b"", b"")):
                            out[name].append(value)
        return pa.Table.from_pydict(out, _SORT_SCHEMA)

    return run


def _chunk(x: bytes, depth: int) -> bytes:
    return x[depth : depth + 8]


def multikey_quicksort(items: list[bytes], depth: int, limit: int) -> list[tuple[list[int], bool]]:
    """Indexes of items in order by bytes [depth, limit), eight at a time, as groups; True: equal up to limit and not ended before."""
    out: list[tuple[list[int], bool]] = []
    todo: list[tuple[list[int], int, bool]] = [(list(range(len(items))), depth, False)]
    while todo:
        group, at, done = todo.pop()
        if done or len(group) == 1:
            out.append((group, len(group) > 1 and at >= limit))
            continue
        pivot = _chunk(items[group[len(group) // 2]], at)
        less, same, more = [], [], []
        for i in group:
            c = _chunk(items[i], at)
            (same if c == pivot else less if c < pivot else more).append(i)
        for part, to, end in ((more, at, False), (same, at + 8, len(pivot) < 8 or at + 8 >= limit), (less, at, False)):
            if part:
                todo.append((part, to, end))
    return out


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie(items: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of distinct items, and the length of the common prefix of each with the one before it (0 for the first).

    Inner nodes hold a depth and branch by the byte there (-1 after the end); bytes between depths are not stored.  An item first
    goes down by branching bytes only, then one comparison with the leaf it reaches tells where it belongs.
    """
    byte = lambda x, d: x[d] if d < len(x) else -1
    root: int | list = 0
    for i in range(1, len(items)):
        x, node = items[i], root
        while isinstance(node, list):
            node = node[1].get(byte(x, node[0])) if byte(x, node[0]) in node[1] else next(iter(node[1].values()))
        depth = common(x, items[node])
        other = byte(items[node], depth)
        parent, edge, node = None, None, root
        while isinstance(node, list) and node[0] < depth:
            parent, edge = node, byte(x, node[0])
            node = node[1][edge]
        if isinstance(node, list) and node[0] == depth:
            node[1][byte(x, depth)] = i
            continue
        branch = [depth, {other: node, byte(x, depth): i}]
        if parent is None:
            root = branch
        else:
            parent[1][edge] = branch
    order, lcp, todo = [], [], [(root, 0)]
    while todo:
        node, shared = todo.pop()
        if isinstance(node, list):
            children = sorted(node[1].items(), reverse=True)
            todo.extend((child, node[0]) for _, child in children[:-1])
            todo.append((children[-1][1], shared))
        else:
            order.append(node)
            lcp.append(shared)
    return order, lcp


def ordered(items: list[bytes]) -> tuple[list[int], np.ndarray]:
    """Indexes of items in order, and the length of the common prefix of each with the one before it (0 for the first)."""
    places: dict[bytes, list[int]] = {}
    for i, x in enumerate(items):
        places.setdefault(x, []).append(i)
    distinct = list(places)
    order: list[int] = []
    lcp: list[int] = []
    last = None
    for group, deep in multikey_quicksort(distinct, 0, SHALLOW):
        inner, shared = blind_trie([distinct[i] for i in group]) if len(group) > 1 else ([0], [0])
        for k, length in zip(inner, shared):
            x = distinct[group[k]]
            own = places[x]
            order += own
            lcp += [length if k != inner[0] else common(last, x) if last is not None else 0] + [len(x)] * (len(own) - 1)
            last = x
    return order, np.array(lcp, np.int64)


def shared_strings(contexts: list[tuple[int, bytes]], width: int) -> list[tuple[int, int]]:
    """For each (bytes before the anchor, context): most and least bytes before the anchor in a string that another context has; (-1, -1) if none.

    Contexts stand in the order of the bytes from the anchor on.  Neighbours are joined from the longest common prefix down, which
    grows sets whose members share that prefix at least; each set keeps its members in the order of the reversed bytes before the
    anchor.  When two sets join, only members that become neighbours there can share more than before, so each is compared with two
    others at a join; the members of the smaller set are put into the larger one.
    """
    n = len(contexts)
    if n < 2:
        return [(-1, -1)] * n
    right, right_lcp = ordered([c[k:] for k, c in contexts])
    left, left_lcp = ordered([c[:k][::-1] for k, c in contexts])
    if n == 2:
        depth, shared = min(int(right_lcp[1]), width), int(left_lcp[1])
        return [(shared, width - depth) if shared + depth >= width else (-1, -1)] * 2
    least_of = [left_lcp]  # least_of[k][i]: least of 2**k values from i on
    while 2 ** len(least_of) <= n:
        step = 2 ** (len(least_of) - 1)
        least_of.append(np.minimum(least_of[-1][:-step], least_of[-1][step:]))
    place = np.empty(n, np.int64)
    place[left] = np.arange(n)
    most, least = np.full(n, -1, np.int64), np.full(n, width + 1, np.int64)

    def meet(a: np.ndarray, b: np.ndarray, depth: int) -> None:
        """Members at places a < b share depth bytes from the anchor on."""
        size = (b - a).astype(np.int64)
        shared = np.empty(len(a), np.int64)
        level = np.frexp(size.astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            at = level == k
            shared[at] = np.minimum(least_of[k][a[at] + 1], least_of[k][b[at] + 1 - 2**k])
        ok = shared + depth >= width
        for x in (a[ok], b[ok]):
            np.maximum.at(most, x, shared[ok])
            np.minimum.at(least, x, width - depth)

    owner = list(range(n))

    def find(k: int) -> int:
        while owner[k] != k:
            owner[k] = owner[owner[k]]
            k = owner[k]
        return k

    sets = [place[i : i + 1] for i in right]
    for k in (np.argsort(-right_lcp[1:], kind="stable") + 1).tolist():
        a, b = find(k - 1), find(k)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        at = np.searchsorted(sets[a], sets[b])
        whole = np.insert(sets[a], at, sets[b])
        at = at + np.arange(len(at))
        depth = min(int(right_lcp[k]), width)
        before, after = at[at > 0], at[at + 1 < len(whole)]
        meet(whole[before - 1], whole[before], depth)
        meet(whole[after], whole[after + 1], depth)
        owner[b], sets[a], sets[b] = a, whole, whole[:0]
    return [(int(most[p]), int(least[p])) if most[p] >= 0 else (-1, -1) for p in place]


def _sorted(width: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one bucket: for each block, the shared strings of the contexts and string hashes that it sent."""
        cols = {c: table.column(c).to_pylist() for c in _SORT_SCHEMA.names}
        rows = []
        hashed = [i for i, k in enumerate(cols["kind"]) if k == 1]
        if hashed:
            parts = [np.frombuffer(cols["keys"][i], np.uint64) for i in hashed]
            many = np.concatenate([unbits(cols["flags"][i], len(p)) for i, p in zip(hashed, parts)])
            _, of, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            repeated = n > 1
            repeated[of[many]] = True
            for i, f in zip(hashed, np.split(repeated[of], np.cumsum([len(p) for p in parts])[:-1])):
                if f.any():
                    rows.append((cols["block"][i], 2, cols["bucket"][i], bits(f)))
        members = []
        for i, kind in enumerate(cols["kind"]):
            if kind == 0:
                keys, data, at = np.frombuffer(cols["keys"][i], np.uint64).tolist(), unpack(cols["bytes"][i]), 0
                full = unbits(cols["flags"][i], len(keys)).tolist()
                for k, e, f, n, size in zip(keys, np.frombuffer(cols["entries"][i], np.int64).tolist(), full, np.frombuffer(cols["lefts"][i], np.int32).tolist(), np.frombuffer(cols["sizes"][i], np.int32).tolist()):
                    members.append((k, (n, data[at : at + size]), i, e, f))
                    at += size
        members.sort(key=lambda m: m[0])
        told: dict[int, list[tuple[int, int, int]]] = {}
        for _, group in groupby(members, key=lambda m: m[0]):
            group = list(group)
            distinct = list({m[1]: 0 for m in group})
            answers = dict(zip(distinct, shared_strings(distinct, width)))
            for _, context, i, e, f in group:
                if not f and answers[context][0] >= 0:
                    told.setdefault(i, []).append((e, *answers[context]))
        for i, x in told.items():
            rows.append((cols["block"][i], 1, cols["bucket"][i], np.array(x, np.int64).T.tobytes()))
        out = list(zip(*rows)) or [[], [], [], []]
        return pa.table({"block": pa.array(out[0], pa.int64()), "kind": pa.array(out[1], pa.int32()), "bucket": pa.array(out[2], pa.int64()), "data": pa.array(out[3], pa.binary())})

    return run


def _remove(width: int, buckets: int, with_text: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept"] if with_text else [])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + ([("kept", pa.binary())] if with_text else []))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in names}
        for ids, sizes, body, anchors, hashes in zip(*(left.column(c).to_pylist() for c in ("ids", "sizes", "body", "anchors", "hashes"))):
            body = unpack(body)
            gone = np.zeros(len(body), bool)
            if right.num_rows:
                place, first, last = np.frombuffer(unpack(anchors), np.int64).reshape(3, -1)
                keys, _, _, _, of_entry = _entries(hashes)
                state = _states(keys, buckets, right)
                full = state[of_entry] & FULL > 0
                starts, ends = [first[full]], [last[full] + width]
                most, least = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
                strings = {}
                for kind, b, data in zip(*(right.column(c).to_pylist() for c in ("kind", "bucket", "data"))):
                    if kind == 1:
                        e, m, n = np.frombuffer(data, np.int64).reshape(3, -1)
                        most[e], least[e] = m, n
                    elif kind == 2:
                        strings[b] = data
                some = most[of_entry] >= 0
                starts.append(place[some] - most[of_entry[some]])
                ends.append(place[some] - least[of_entry[some]] + width)
                if strings:
                    a = Anchors(body, np.array(sizes), width)
                    s, h = _string_hashes(a, np.flatnonzero(state[of_entry] & HASH), width)
                    distinct, of_string = np.unique(h, return_inverse=True)
                    repeated = np.zeros(len(distinct), bool)
                    of, bounds = cut(distinct, buckets)
                    for b, i, j in zip(of.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                        if b in strings:
                            repeated[i:j] = unbits(strings[b], j - i)
                    s = s[repeated[of_string]]
                    starts.append(s)
                    ends.append(s + width)
                gone = spans_to_mask(len(body), np.concatenate(starts), np.concatenate(ends))
            data, at = np.frombuffer(body, np.uint8), 0
            for doc_id, size in zip(ids, sizes):
                drop = gone[at : at + size]
                removed = int(drop.sum())
                kept = data[at : at + size][~drop].tobytes() if removed else body[at : at + size]
                spans = int((drop & ~np.append(False, drop[:-1])).sum()) if removed else 0
                for name, value in zip(names, (doc_id, size, removed, spans, hashlib.sha256(kept).hexdigest(), kept)):
                    out[name].append(value)
                at += size
        return pa.Table.from_pydict(out, schema)

    return run


def repeated_bytes(docs: DataFrame, width: int = 400, with_text: bool = False, many: int = MANY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, if asked for).

    A byte of the UTF-8 text goes if a string of width bytes covers it that also starts anywhere else, in this or another text.
    Null texts count as empty; texts shorter than width stay whole; null and repeated doc_ids are ordinary rows.  width must exceed
    GRAM.  many: contexts of one anchor that one task compares at most.  An empty table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch, buckets = Scratch(spark), bucket_count(spark)
    blocks = scratch.table(pack(docs, id_col, text_col, BLOCK_BYTES, _sketch(width), "anchors binary, hashes binary"), "blocks")
    reply = "block bigint, kind int, bucket bigint, data binary"
    rows = blocks.select("block", "hashes").mapInArrow(_gather_rows(buckets), "bucket bigint, block bigint, keys binary, contexts binary, many binary")
    judged = scratch.table(rows.groupBy("bucket").applyInArrow(lambda table: _judge(table, many), reply), "judged")
    columns = blocks.select("block", "sizes", "body", "hashes")
    rows = columns.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(_sort_rows(width, buckets), "bucket bigint, block bigint, kind int, keys binary, entries binary, flags binary, lefts binary, sizes binary, bytes binary")
    rows = rows.repartition(buckets // 4, "bucket")  # sorting costs far more than its bytes tell, so these partitions are not merged
    found = scratch.table(rows.groupBy("bucket").applyInArrow(_sorted(width), reply), "found")
    replies = judged.unionByName(found)
    out = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else "")
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_remove(width, buckets, with_text), out)


