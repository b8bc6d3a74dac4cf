"""Language model scoring with a hidden Markov model over words.

Every word with LEAST occurrences or more in the training texts has its own emission probability in each state, so the vocabulary
grows with the corpus.  It has two parts: a *symbol* and the word inside the symbol.  Symbols are the words with at least a
1/FREQUENT part of the training tokens, the end of a text, CLASSES classes of the other words with LEAST occurrences by their last
bytes, and CLASSES more of all rarer words.  Inside a class of the first kind P(word | class, state) = (E + SMOOTH * b) / (sum of E
over the class + SMOOTH) with the expected count E of the word in the state and its share b of the class's tokens; inside one of
the second kind a word with count c has (c + 1) / (the class's sum of c + 1, and one more for words that training did not meet).
So probabilities of all texts sum to one, but for the rounding of expected counts to a 2^24th of a word's count on their way.  Symbols are as large as a model that every task holds may be; the table of words is
only ever dealt out by hash ranges.

1. counts: blocks send their distinct words with training counts and get the counts over the corpus back; this gives the base
   score, and each text becomes a row of symbols.
2. training: the first counts come from putting each training text into the state of its largest random projection.  Then rounds
   of Baum-Welch: every partition adds up the expected counts of its texts, the sums over partitions give the next model.  In the
   last round blocks also send the expected counts of each of their other words, and get the sums over the corpus back.
3. scoring: the scaled forward recursion gives the exact probability of each whole text, the end included.

Recursions run over all segments of LENGTH tokens of a block at once: products of the steps of a segment carry the state
distributions from segment to segment, then all segments are filled in.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm._shared import NO_ID, Scratch, bucket_count, cut, ids_of, mix, pack, squeeze, unpack, word_hashes, word_places

BLOCK_BYTES = 2 << 20
FREQUENT = 1 << 15
CLASSES = 256
STATES = 6
ROUNDS = 2
LENGTH = 128
CHUNKS = 16
FAN_IN = 64  # partial sums that one task adds up
SMOOTH = 500.0
LEAST = 4
SEED = 5
PRIOR = 2000.0  # tokens of the overall distribution that each state's counts get
END = mix(np.array([0x656E64], np.uint64))[0]


def held_out(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i == NO_ID else str(i).encode()) % 7 == 2 for i in ids.tolist()], bool)


class Tokens:
    """Tokens of a block: hash, class and document of each word and of the end of each text."""

    def __init__(self, body: bytes, sizes: np.ndarray):
        body = body.lower()  # bytes.lower changes A-Z only
        hashes, counts = word_hashes(body, sizes)
        start, end = word_places(body, sizes)
        data = np.frombuffer(body, np.uint8)
        last = np.zeros(len(end), np.uint64)
        for k in (1, 2, 3):  # the last bytes of the word, 0 where it has no more
            last = last << np.uint64(8) | np.where(end - k >= start, data[np.maximum(end - k, 0)] if len(data) else 0, 0).astype(np.uint64)
        self.sizes = counts + 1
        self.ends = np.cumsum(self.sizes)
        self.hashes = np.full(int(self.sizes.sum()), END, np.uint64)
        self.classes = np.zeros(len(self.hashes), np.uint8)
        word = np.ones(len(self.hashes), bool)
        word[self.ends - 1] = False
        self.hashes[word] = hashes
        self.classes[word] = (mix(last) % np.uint64(CLASSES)).astype(np.uint8)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct hashes, the index of each token among them, and their classes."""
        keys, first, of = np.unique(self.hashes, return_index=True, return_inverse=True)
        return keys, of, self.classes[first]


_COUNT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("classes", pa.binary())])
_REPLY = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int64()), ("counts", pa.binary()), ("keys", pa.binary()), ("known", pa.int64())])


def _count_rows(buckets: int):
    def run(batches):
        for batch in batches:
            out = {n: [] for n in _COUNT.names}
            for block, ids, sizes, body in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "sizes", "body"))):
                t = Tokens(unpack(body), np.array(sizes))
                keys, of, classes = t.distinct()
                train = np.repeat(~held_out(ids_of(ids)), t.sizes)
                counts = np.bincount(of[train], minlength=len(keys)).astype(np.uint32)
                bucket, bounds = cut(keys, buckets)
                for b, i, j in zip(bucket.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    for name, value in zip(_COUNT.names, (b, block, keys[i:j].tobytes(), squeeze(counts[i:j].tobytes()), classes[i:j].tobytes())):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, _COUNT)

    return run


def _counted(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Of one bucket: counts for each block (kind 0); frequent words (1), class sums and known words (2) for the driver."""
        parts = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
        own = np.concatenate([np.frombuffer(unpack(c), np.uint32) for c in table.column("counts").to_pylist()])
        classes = np.frombuffer(b"".join(table.column("classes").to_pylist()), np.uint8)
        keys, first, of = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        count = np.bincount(of, own, len(keys)).astype(np.int64)
        often = (count >= threshold) & (keys != END)
        rare = (count > 0) & ~often & (keys != END)
        bucket = table.column("bucket")[0].as_py()
        rows = [(0, b, bucket, squeeze(c.astype(np.int64).tobytes()), None, None) for b, c in zip(table.column("block").to_pylist(), np.split(count[of], np.cumsum([len(p) for p in parts])[:-1]))]
        rows.append((1, None, bucket, count[often].tobytes(), keys[often].tobytes(), None))
        own = rare & (count >= LEAST)
        low = rare & ~own
        sums = np.concatenate([np.bincount(classes[first][own], count[own], CLASSES), np.bincount(classes[first][low], count[low] + 1, CLASSES)])
        rows.append((2, None, bucket, sums.astype(np.int64).tobytes(), None, int((count > 0).sum())))
        if (keys == END).any():
            rows.append((3, None, bucket, None, None, int(count[keys == END][0])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _REPLY)], schema=_REPLY)

    return run


class Vocabulary(NamedTuple):
    keys: np.ndarray  # sorted hashes of frequent words
    class_sums: np.ndarray  # tokens of the words of each class, then count + 1 of those of each class of rarer words
    train_tokens: int
    known: int
    overall: np.ndarray  # smoothed probability of each symbol


_TEXTS = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("bounds", pa.list_(pa.int32())), ("word_counts", pa.binary()), ("word_classes", pa.binary()), ("words", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("symbols", pa.binary()), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("rest", pa.list_(pa.float64()))])
_TEXTS_DDL = "block bigint, keys binary, bounds array<int>, word_counts binary, word_classes binary, words binary, ids array<bigint>, sizes array<bigint>, symbols binary, known array<bigint>, base array<double>, rest array<double>"


def _pack_words(word: np.ndarray) -> bytes:
    narrow = word.max(initial=0) < 1 << 16
    return squeeze((b"2" if narrow else b"4") + word.astype(np.uint16 if narrow else np.uint32).tobytes())


def _unpack_words(data: bytes) -> np.ndarray:
    data = unpack(data)
    return np.frombuffer(data, np.uint16 if data[:1] == b"2" else np.uint32, offset=1).astype(np.int64)


def _symbol_rows(v: Vocabulary, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {n: [] for n in _TEXTS.names}
        replies = dict(zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist()))
        for block, ids, sizes, body in zip(*(left.column(c).to_pylist() for c in ("block", "ids", "sizes", "body"))):
            t = Tokens(unpack(body), np.array(sizes))
            keys, of, classes = t.distinct()
            bucket, _ = cut(keys, buckets)
            count = np.frombuffer(b"".join(unpack(replies[b]) for b in bucket.tolist()), np.int64)
            low = count < LEAST
            symbol = len(v.keys) + 1 + classes.astype(np.int64) + CLASSES * low
            rest = np.where(low, np.log10((count + 1) / (v.class_sums[CLASSES + classes.astype(np.int64)] + 1)), 0.0)
            own = ~low & (keys != END)  # words of classes that each state tells apart
            symbol[keys == END], rest[keys == END] = len(v.keys), 0.0
            if len(v.keys):
                at = np.minimum(np.searchsorted(v.keys, keys), len(v.keys) - 1)
                often = v.keys[at] == keys
                symbol[often], own[often], rest[often] = at[often], False, 0.0
            word = (np.cumsum(own) - 1)[of][own[of]]  # of each token of a class: its word among those of the block
            base = np.log10((count + 1) / (v.train_tokens + v.known + 1))
            starts = t.ends - t.sizes
            mine, cuts = cut(keys[own], buckets)
            bounds = np.zeros(buckets + 1, np.int32)
            bounds[mine + 1] = np.diff(cuts)
            row = (block, keys[own].tobytes(), np.cumsum(bounds), squeeze(count[own].tobytes()), classes[own].tobytes(), _pack_words(word), ids, t.sizes, squeeze(symbol[of].astype(np.uint16).tobytes()), np.add.reduceat((count > 0)[of].astype(np.int64), starts), np.add.reduceat(base[of], starts), np.add.reduceat(rest[of], starts))
            for name, value in zip(_TEXTS.names, row):
                out[name].append(value)
        return pa.Table.from_pydict(out, _TEXTS)

    return run


class Model(NamedTuple):
    initial: np.ndarray  # (states,)
    step: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states)
    in_class: np.ndarray | None = None  # expected counts of classes, without prior (classes, states)


class Lattice:
    """The recursions of a model over texts of symbols, text after text."""

    def __init__(self, model: Model, symbols: np.ndarray, sizes: np.ndarray, inside: np.ndarray | None = None):
        """inside: for each token a factor of its emission in each state, that of the word inside its class."""
        k = len(model.initial)
        parts = -(-sizes // LENGTH)
        self.doc = np.repeat(np.arange(len(sizes)), parts)
        rank = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        start = (np.cumsum(sizes) - sizes)[self.doc] + rank * LENGTH
        size = np.minimum(sizes[self.doc] - rank * LENGTH, LENGTH)
        steps = int(size.max(initial=0))
        self.model, self.symbols, self.sizes, self.rank, self.size, self.steps = model, symbols, sizes, rank, size, steps
        at = start[None, :] + np.arange(steps)[:, None]
        self.valid = np.arange(steps)[:, None] < size[None, :]
        self.at = np.where(self.valid, at, 0)
        emit = model.emit[symbols] if inside is None else model.emit[symbols] * inside
        self.emitted = np.where(self.valid[:, :, None], emit[self.at], 1.0) if len(emit) else np.ones((0, len(rank), k))
        self.first = rank == 0
        segments = len(rank)
        # state distribution before each segment: from products of the steps of the segments before it
        self.before = np.full((segments, k), 1.0 / k)
        self.long = np.flatnonzero(parts[self.doc] > 1)
        self.product = None
        if len(self.long):
            product = np.broadcast_to(np.eye(k), (len(self.long), k, k)).copy()
            first, emitted, valid = self.first[self.long], self.emitted[:, self.long], self.valid[:, self.long]
            for t in range(steps):
                moved = (product.reshape(-1, k) @ model.step).reshape(-1, k, k)
                if t == 0:
                    moved[first] = model.initial
                moved *= emitted[t][:, None, :]
                moved /= moved.sum(axis=(1, 2), keepdims=True)
                product = moved if valid[t].all() else np.where(valid[t][:, None, None], moved, product)
            self.product = product
            self.by_rank = [np.flatnonzero(rank[self.long] == r) for r in range(int(rank.max()) + 1)]
            for places in self.by_rank[1:]:
                x = np.einsum("ni,nij->nj", self.before[self.long[places] - 1], product[places - 1])
                self.before[self.long[places]] = x / x.sum(axis=1, keepdims=True)

    def forward(self, keep: bool = False) -> np.ndarray:
        """log10 probability of each text; keep: also the distributions at each step."""
        a, scores = self.before, np.zeros(len(self.before))
        self.alpha, self.scale = [], []
        for t in range(self.steps):
            x = a @ self.model.step
            if t == 0:
                x[self.first] = self.model.initial
            x *= self.emitted[t]
            total = x.sum(axis=1, keepdims=True)
            a = x / total
            scores += np.where(self.valid[t], np.log10(total[:, 0]), 0.0)
            if keep:
                self.alpha.append(a)
                self.scale.append(total)
        return np.bincount(self.doc, scores, len(self.sizes))

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of initial states, steps and emissions, and the log10 likelihood."""
        m, k = self.model, len(self.model.initial)
        score = float(self.forward(keep=True).sum())
        after = np.ones_like(self.before)
        if self.product is not None:
            for places in self.by_rank[:0:-1]:
                x = np.einsum("nij,nj->ni", self.product[places], after[self.long[places]])
                after[self.long[places] - 1] = x / x.sum(axis=1, keepdims=True)
        initial, step = np.zeros(k), np.zeros((k, k))
        gamma = np.zeros((len(self.symbols), k))
        beta = after
        for t in range(self.steps - 1, -1, -1):
            valid = self.valid[t]
            g = self.alpha[t] * beta
            g /= g.sum(axis=1, keepdims=True)
            gamma[self.at[t][valid]] = g[valid]
            weighted = self.emitted[t] * beta
            if t == 0:
                initial += g[self.first & valid].sum(axis=0)
            inner = valid & ~self.first if t == 0 else valid
            old = (self.before if t == 0 else self.alpha[t - 1])[inner]
            w = weighted[inner]
            norm = ((old @ m.step) * w).sum(axis=1, keepdims=True)
            step += (old / norm).T @ w
            back = weighted @ m.step.T
            back /= back.sum(axis=1, keepdims=True)
            beta = np.where(valid[:, None], back, beta)
        self.gamma = gamma
        emit = np.stack([np.bincount(self.symbols, gamma[:, z], len(m.emit)) for z in range(k)], axis=1)
        return initial, step * m.step, emit, score


_SUMS = "kind int, chunk int, part int, block bigint, keys binary, sums binary"
_PARTIAL = pa.schema([("kind", pa.int32()), ("chunk", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("sums", pa.binary())])


def _partial(model: Model | None, overall: np.ndarray, states: int, buckets: int = 0, first_class: int = 0):
    """Expected counts of a partition's training texts, in CHUNKS pieces (kind 0).

    With buckets also those of the words of each block that are no symbols, by hash range (kind 1, chunk is the range).  CLASSES symbols
    from first_class on have such words.
    """

    def run(batches):
        symbols_, part = len(overall), TaskContext.get().partitionId()
        initial, step, emit, score = np.zeros(states), np.zeros((states, states)), np.zeros((symbols_, states)), 0.0
        directions = np.random.default_rng(SEED).standard_normal((symbols_, states))
        directions -= overall @ directions
        for batch in batches:
            out: dict[str, list] = {n: [] for n in _PARTIAL.names}
            for block, keys, words, ids, sizes, data in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "words", "ids", "sizes", "symbols"))):
                sizes, symbols = np.array(sizes), np.frombuffer(unpack(data), np.uint16).astype(np.int64)
                train = ~held_out(ids_of(ids))
                tokens = np.repeat(train, sizes)
                all_symbols, symbols, sizes = symbols, symbols[tokens], sizes[train]
                if not len(sizes):
                    continue
                if model is None:
                    doc = np.repeat(np.arange(len(sizes)), sizes)
                    state = np.stack([np.bincount(doc, directions[symbols, z], len(sizes)) for z in range(states)]).argmax(axis=0)
                    emit += np.bincount(symbols * states + state[doc], minlength=symbols_ * states).reshape(-1, states)
                    initial += np.bincount(state, minlength=states)
                    continue
                lattice = Lattice(model, symbols, sizes)
                a, b, c, s = lattice.counts()
                initial, step, emit, score = initial + a, step + b, emit + c, score + s
                if buckets:
                    keys, word = np.frombuffer(keys, np.uint64), _unpack_words(words)
                    inside = (symbols >= first_class) & (symbols < first_class + CLASSES)
                    word = word[tokens[(all_symbols >= first_class) & (all_symbols < first_class + CLASSES)]]
                    sums = np.stack([np.bincount(word, lattice.gamma[inside, z], len(keys)) for z in range(states)], axis=1)
                    counts = np.bincount(word, minlength=len(keys)).astype(np.uint32)
                    of, bounds = cut(keys, buckets)
                    for bucket, i, j in zip(of.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                        for name, value in zip(_PARTIAL.names, (1, bucket, None, block, keys[i:j].tobytes(), squeeze(counts[i:j].tobytes() + _shares(sums[i:j], counts[i:j])))):
                            out[name].append(value)
            if out["kind"]:
                yield pa.RecordBatch.from_pydict(out, _PARTIAL)
        flat = np.concatenate([initial, step.ravel(), [score], emit.ravel()])
        rows = {"kind": [0] * CHUNKS, "chunk": list(range(CHUNKS)), "part": [part] * CHUNKS, "block": [None] * CHUNKS, "keys": [None] * CHUNKS, "sums": [x.tobytes() for x in np.array_split(flat, CHUNKS)]}
        yield pa.RecordBatch.from_pydict(rows, _PARTIAL)

    return run


def _add(table: pa.Table) -> pa.Table:
    """The sum of the pieces, in order of their parts."""
    table = table.sort_by("part")
    total = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
    return pa.table({"chunk": table.column("chunk")[:1], "part": table.column("part")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


SHARE = (1 << 24) - 1


def _shares(sums: np.ndarray, counts: np.ndarray) -> bytes:
    """Expected counts of words as shares of their counts, in 24 bits; the last state has what the others leave."""
    share = np.rint(sums[:, :-1] / np.maximum(counts, 1)[:, None] * SHARE).clip(0, SHARE).astype("<u4")
    return share.view(np.uint8).reshape(*share.shape, 4)[:, :, :3].transpose(2, 1, 0).tobytes()  # byte by byte, which compresses better


def _sums(data: bytes, counts: np.ndarray, states: int) -> np.ndarray:
    """The expected counts that _shares has packed."""
    places = np.frombuffer(data, np.uint8).reshape(3, states - 1, len(counts)).astype(np.int64)
    share = (places[0] + (places[1] << 8) + (places[2] << 16)).T / SHARE
    return np.concatenate([share, np.maximum(1 - share.sum(axis=1, keepdims=True), 0)], axis=1) * counts[:, None]


def _add_words(states: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one hash range: for each block, the expected counts over the corpus of its words, as shares of their counts there."""
        parts = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
        keys, of = np.unique(np.concatenate(parts), return_inverse=True)
        counts, total, at = np.zeros(len(keys), np.int64), np.zeros((len(keys), states)), 0
        for part, data in zip(parts, map(unpack, table.column("sums").to_pylist())):
            place, n = of[at : at + len(part)], np.frombuffer(data, np.uint32, len(part))  # words are distinct within a block
            counts[place] += n
            total[place] += _sums(data[4 * len(part) :], n, states)
            at += len(part)
        sums = [squeeze(_shares(total[x], counts[x])) for x in np.split(of, np.cumsum([len(p) for p in parts])[:-1])]
        return pa.table({"block": table.column("block"), "bucket": table.column("chunk"), "word_sums": pa.array(sums, pa.binary())})

    return run


def estimate(texts: DataFrame, model: Model | None, v: Vocabulary, states: int, scratch: Scratch | None = None, buckets: int = 0) -> tuple[Model, float, DataFrame | None]:
    """The next model from counts over all partitions, the log10 likelihood under the present one, and with buckets the words' sums."""
    columns = ["block", "keys", "words", "ids", "sizes", "symbols"] if buckets else ["block", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("words"), "ids", "sizes", "symbols"]
    sums = texts.select(*columns).mapInArrow(_partial(model, v.overall, states, buckets, len(v.keys) + 1), _SUMS)
    words = None
    if buckets:
        sums = scratch.table(sums, "sums")
        words = scratch.table(sums.where("kind = 1").select("chunk", "block", "keys", "sums").groupBy("chunk").applyInArrow(_add_words(states), "block bigint, bucket int, word_sums binary"), "words")
    pieces, parts = sums.where("kind = 0").select("chunk", "part", "sums"), texts.rdd.getNumPartitions()
    while parts > FAN_IN:  # a tree, so that no task reads a piece of every partition
        parts = -(-parts // FAN_IN)
        pieces = pieces.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int")).groupBy("chunk", "part").applyInArrow(_add, "chunk int, part int, sums binary")
    rows = pieces.groupBy("chunk").applyInArrow(_add, "chunk int, part int, sums binary").select("chunk", "sums").collect()  # as large as the symbols of the model, for any corpus
    flat = np.concatenate([np.frombuffer(r.sums, np.float64) for r in sorted(rows)]) if rows else np.zeros(states + states**2 + 1 + len(v.overall) * states)
    initial, step, score, emit = flat[:states], flat[states : states + states**2].reshape(states, states), flat[states + states**2], flat[states + states**2 + 1 :].reshape(-1, states)
    if model is None:
        step = np.full((states, states), 0.02 / states) + 0.98 * np.eye(states)
    else:
        step = step + 0.1
        step = step / step.sum(axis=1, keepdims=True)
    in_class = emit[len(v.keys) + 1 : len(v.keys) + 1 + CLASSES]
    emit = emit + PRIOR * v.overall[:, None]
    return Model((initial + 1) / (initial + 1).sum(), step, emit / emit.sum(axis=0), in_class), float(score), words


def word_factors(model: Model, v: Vocabulary, classes: np.ndarray, counts: np.ndarray, sums: np.ndarray, smooth: float) -> np.ndarray:
    """P(word | class, state) of words with their training counts and expected counts in each state."""
    b = counts / v.class_sums[classes]
    return (sums + smooth * b[:, None]) / (model.in_class[classes] + smooth)


def _score_rows(model: Model, v: Vocabulary, smooth: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        replies = dict(zip(right.column("bucket").to_pylist(), right.column("word_sums").to_pylist()))
        for bounds, counts, classes, words, ids, sizes, data, known, base, rest in zip(*(left.column(c).to_pylist() for c in _TEXTS.names if c not in ("block", "keys"))):
            n, symbols = np.array(sizes), np.frombuffer(unpack(data), np.uint16).astype(np.int64)
            counts = np.frombuffer(unpack(counts), np.int64)
            sums = np.zeros((bounds[-1], len(model.initial)))
            for bucket, reply in replies.items():
                own = slice(bounds[bucket], bounds[bucket + 1])
                sums[own] = _sums(unpack(reply), counts[own], len(model.initial))
            factors = word_factors(model, v, np.frombuffer(classes, np.uint8), counts, sums, smooth)
            inside = np.ones((len(symbols), len(model.initial)))
            inside[(symbols > len(v.keys)) & (symbols <= len(v.keys) + CLASSES)] = factors[_unpack_words(words)]
            score = Lattice(model, symbols, n, inside).forward() + np.array(rest)
            found.append(pa.table([pa.array(ids, pa.int64()), pa.array(held_out(ids_of(ids))), pa.array(n), pa.array(known, pa.int64()), pa.array(np.full(len(n), v.train_tokens, np.int64)), pa.array(base, pa.float64()), pa.array(score)], _SCORES))
        return pa.concat_tables(found) if found else _SCORES.empty_table()

    return run


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _train_tokens(body: bytes, sizes: np.ndarray, ids: np.ndarray) -> dict:
    counts = word_hashes(body, sizes)[1] + 1
    return {"train": int(counts[~held_out(ids)].sum())}


def fit(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, Model, Vocabulary]:
    """Texts as symbols and words (a written table), the words' expected counts by block, the trained model and its vocabulary."""
    spark = docs.sparkSession
    scratch, buckets = Scratch(spark), bucket_count(spark)
    blocks = scratch.table(pack(docs, id_col, text_col, BLOCK_BYTES, _train_tokens, "train bigint"), "blocks")
    n = blocks.agg(F.sum("train")).first()[0] or 0
    rows = blocks.select("block", "ids", "sizes", "body").mapInArrow(_count_rows(buckets), "bucket bigint, block bigint, keys binary, counts binary, classes binary")
    counted = scratch.table(rows.groupBy("bucket").applyInArrow(_counted(max(n / FREQUENT, 1.0)), "kind int, block bigint, bucket bigint, counts binary, keys binary, known bigint"), "counted")
    often = counted.where("kind = 1").select("keys", "counts").collect()  # FREQUENT words at most
    keys = np.frombuffer(b"".join(r.keys for r in often), np.uint64)
    counts = np.frombuffer(b"".join(r.counts for r in often), np.int64)[np.argsort(keys)]
    keys = np.sort(keys)
    class_sums, known = np.zeros(2 * CLASSES, np.int64), 0
    for r in counted.where("kind = 2").select("counts", "known").toLocalIterator():  # CLASSES numbers for each bucket
        class_sums, known = class_sums + np.frombuffer(r.counts, np.int64), known + r.known
    texts_in_training = sum(r.known for r in counted.where("kind = 3").select("known").collect())  # the hash range of the end has it
    weight = np.concatenate([counts, [texts_in_training], class_sums]) + 1.0
    v = Vocabulary(keys, class_sums, n, known, weight / weight.sum())
    symbols = blocks.select("block", "ids", "sizes", "body").groupBy("block").cogroup(counted.where("kind = 0").select("block", "bucket", "counts").groupBy("block"))
    texts = scratch.table(symbols.applyInArrow(_symbol_rows(v, buckets), _TEXTS_DDL), "texts")
    scratch.drop("blocks"), scratch.drop("counted")
    model = None
    for _ in range(rounds):
        model = estimate(texts, model, v, states)[0]
    model, _, words = estimate(texts, model, v, states, scratch, buckets)
    scratch.drop("sums")
    return texts, words, model, v


def score_documents(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, smooth: float = SMOOTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Trains on rows whose crc32(doc_id as text) mod 7 is not 2.  A null text counts as empty and has the end as its one token; a null
    doc_id counts as an empty text in the rule and so is in training.  Repeated rows count as often as they occur.  An empty table
    gives an empty result.  Other columns are ignored.
    """
    texts, words, model, v = fit(docs, states, max(rounds, 1), id_col, text_col)
    out = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return texts.drop("keys").groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_score_rows(model, v, smooth), out)
