"""Alignment of two tokenizers over a corpus, with each distinct text tokenised once.

Rows are shuffled by their full text (copies combine before the shuffle), and each distinct text is tokenised by a byte-level BPE
vocabulary (A) and a SentencePiece one (B) and aligned by byte offsets.  What a text links, as sorted distinct pairs of ids, is
written once; pair counts are sums over texts weighted by their number of copies.  The measures of a text are sums over its pairs,
and are joined to the doc_ids of its copies by a digest of the text.

Both tokenizers work inside units that no token crosses: A inside each match of its pattern, B inside a run of spaces and what
follows it up to the next space (no piece has a space after another character).  Units are remembered up to a bound, so a word is
tokenised once for many texts.  A unit alone is split by A as it is within a text: an earlier alternative of the pattern that
matched a beginning of it would have matched there too, and the one that looks ahead only makes a longer match of white space.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm._shared import FEW_KEYS, Scratch, release
from readlake.llm.groups import attach

#: Characters of texts that are aligned at once; a longer text is aligned alone.
BATCH = 2 << 20
#: Characters of units that a task remembers.
REMEMBERED = 8 << 20
BEYOND_LATIN = re.compile("[\u0250-\U0010ffff]").search
TEXT_SCHEMA = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable Latin-1 characters themselves, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Units:
    """Token ids of units, remembered up to a bound between batches.

    encode(units) gives the ids of each; pieces has the bytes of each id.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], pieces: list[bytes]):
        self.encode, self.pieces = encode, pieces
        self.lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.held = 0
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.faithful = np.zeros(0, bool)
        self.ids = np.zeros(0, np.int32)

    def of(self, units: list[str]) -> np.ndarray:
        if self.held > REMEMBERED:
            self.clear()
        new = [u for u in dict.fromkeys(units) if u not in self.index]
        if new:
            ids = self.encode(new)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.held += sum(map(len, new))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.faithful = np.concatenate([self.faithful, np.fromiter((b"".join(map(self.pieces.__getitem__, x)) == u.encode() for u, x in zip(new, ids)), bool, len(new))])
            self.ids = np.concatenate([self.ids, flat])
        return np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))

    def tokens(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts in units: all ids, the number of ids of each text, and whether each text's bytes are those of its tokens."""
        at = self.of([u for t in texts for u in t])
        units = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.starts[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        wrong = np.concatenate([[0], np.cumsum(~self.faithful[at])])[units]
        return ids, np.diff(ends[units]), np.diff(wrong) == 0


@lru_cache(maxsize=2)
def aligner(byte_level: str, piece_model: str) -> Aligner:
    return Aligner(byte_level, piece_model)


class Aligner:
    def __init__(self, byte_level: str, piece_model: str):
        import public_tokenizers
        import regex
        import sentencepiece
        from tokenizers import Tokenizer

        a, b = Tokenizer.from_file(byte_level), sentencepiece.SentencePieceProcessor(model_file=piece_model)
        a.encode_special_tokens = True
        with open(byte_level, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        of_character = byte_characters()
        pieces_a = [b""] * (1 + max(entries.values()))
        for entry, i in entries.items():
            pieces_a[i] = bytes(map(of_character.__getitem__, entry))
        pieces_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.vocab_size())]
        if any(" " in b.id_to_piece(i).lstrip("▁").replace("▁", " ") for i in range(b.vocab_size())):
            raise ValueError("a piece has a space after another character")
        self.whole = lambda texts: [x.ids for x in a.encode_batch_fast(texts, add_special_tokens=False)]

        def one_by_one(units: list[str]) -> list[list[int]]:
            found = a.encode(units, is_pretokenized=True, add_special_tokens=False)
            bounds = np.searchsorted(np.array(found.word_ids), np.arange(len(units) + 1)).tolist()
            ids = found.ids
            return [ids[s:e] for s, e in zip(bounds[:-1], bounds[1:])]

        self.a = Units(one_by_one, pieces_a)
        space = [b.piece_to_id("▁")]
        # B puts the first space itself, but for an empty text
        self.b = Units(lambda units: [x or space for x in b.encode([u[1:] for u in units], num_threads=1)], pieces_b)
        self.split_a = regex.compile(public_tokenizers.PATTERN).findall
        self.split_b = re.compile(" +[^ ]*").findall
        if len(pieces_a) * len(pieces_b) >= 1 << 62:
            raise ValueError("pairs of ids do not fit 64 bits")
        self.pairs_of = len(pieces_b)
        self.decimal = ([f"{i}{c}" for c in ("", ",", "|") for i in range(len(pieces_a))], [f"{i}{c}" for c in ("", ",", ";") for i in range(len(pieces_b))])

    @cached_property
    def unlike(self) -> Callable:
        """Finds characters that A's own pattern engine and the one used here class differently (they know different versions of Unicode); none is below U+0250."""
        import regex
        from tokenizers import Regex, pre_tokenizers

        text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        differs = np.zeros(len(text), bool)
        for kind in (r"\p{L}+", r"\p{N}+", r"\s+"):
            for start, end in (m.span() for m in regex.finditer(kind, text)):
                differs[start:end] ^= True
            for piece, (start, end) in pre_tokenizers.Split(Regex(kind), "isolated").pre_tokenize_str(text):
                if Aligner._matches(Regex(kind), piece[0]):
                    differs[start:end] ^= True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], differs.astype(np.int8), [0]])))
        ranges = "".join(f"\\U{ord(text[s]):08x}-\\U{ord(text[e - 1]):08x}" for s, e in zip(edges[::2], edges[1::2]))
        return regex.compile(f"[{ranges}]").search if ranges else lambda text: None

    @staticmethod
    def _matches(kind, character: str) -> bool:
        from tokenizers import pre_tokenizers

        return not pre_tokenizers.Split(kind, "removed").pre_tokenize_str(character)

    def align(self, texts: list[str]) -> Alignment:
        """texts without a token (empty, or with bytes that differ from those of their tokens) have no tokens in the result."""
        spaced = [" " + t if t else "" for t in texts]
        split = [None if BEYOND_LATIN(t) and self.unlike(t) else self.split_a(t) for t in spaced]
        strange = [k for k, units in enumerate(split) if units is None]
        for k in strange:
            split[k] = []
        ids_a, n_a, good_a = self.a.tokens(split)
        if strange:  # the whole text, by A itself
            found = dict(zip(strange, self.whole([spaced[k] for k in strange])))
            bounds = np.concatenate([[0], np.cumsum(n_a)])
            parts = [np.array(found[k], np.int32) if k in found else ids_a[bounds[k] : bounds[k + 1]] for k in range(len(texts))]
            ids_a, n_a = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
            for k in strange:
                good_a[k] = b"".join(map(self.a.pieces.__getitem__, found[k])) == spaced[k].encode()
        ids_b, n_b, good_b = self.b.tokens([self.split_b(t) for t in spaced])
        good = good_a & good_b
        return Alignment(self, ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)], n_a * good, n_b * good)


class Alignment:
    """Tokens, groups and links of texts that follow each other, as arrays over all of them."""

    def __init__(self, by: Aligner, ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        self.by, self.ids_a, self.ids_b, self.n_a, self.n_b = by, ids_a, ids_b, n_a, n_b
        ends_a, ends_b = np.cumsum(by.a.lengths[ids_a]), np.cumsum(by.b.lengths[ids_b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        text_ends = np.concatenate([[0], ends_a])[np.cumsum(n_a)]
        self.group_a, self.group_b, self.common = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b), common
        self.n_groups = np.diff(np.searchsorted(common, text_ends, "right"), prepend=0)
        ends = np.union1d(ends_a, ends_b)
        self.n_links = np.diff(np.searchsorted(ends, text_ends, "right"), prepend=0)
        self.link_a, self.link_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)  # each end closes one overlap

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of ids of each text (a * pieces of B + b), ascending; their links; and the number of pairs of each text."""
        text = np.repeat(np.arange(len(self.n_a)), self.n_links)
        pair = self.ids_a[self.link_a].astype(np.int64) * self.by.pairs_of + self.ids_b[self.link_b]
        order = np.lexsort((pair, text)) if len(self.n_a) * self.by.pairs_of * len(self.by.a.pieces) >= 1 << 62 else np.argsort(text * (self.by.pairs_of * len(self.by.a.pieces)) + pair)
        text, pair = text[order], pair[order]
        first = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(pair, prepend=-1) != 0))
        return pair[first], np.diff(np.append(first, len(pair))).astype(np.int32), np.bincount(text[first], minlength=len(self.n_a))

    def lines(self) -> list[str]:
        """Each text's groups: a1,a2|b1;a3|b2,b3, in decimal ids."""
        groups = len(self.common)
        in_a, in_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        at_a = np.arange(len(self.ids_a)) + (np.cumsum(in_b) - in_b)[self.group_a]
        at_b = np.arange(len(self.ids_b)) + np.cumsum(in_a)[self.group_b]
        last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (self.group_a, self.group_b))
        mark_b = 1 + last_b.astype(np.int64)
        mark_b[np.cumsum(self.n_b)[self.n_b > 0] - 1] = 0  # nothing follows the last token of a text
        out = np.empty(len(at_a) + len(at_b), object)
        table_a, table_b = self._tables()
        out[at_a] = table_a[self.ids_a + len(self.by.a.pieces) * (1 + last_a)]
        out[at_b] = table_b[self.ids_b + len(self.by.b.pieces) * mark_b]
        bounds = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        return ["".join(out[s:e].tolist()) for s, e in zip(bounds[:-1], bounds[1:])]

    def _tables(self) -> list[np.ndarray]:
        if not hasattr(self.by, "tables"):
            self.by.tables = [np.array(d, object) for d in self.by.decimal]
        return self.by.tables

    def groups(self) -> list[list[dict]]:
        """Each text's groups: ids of A, ids of B, and the bytes [start, end) of the text behind its leading space."""
        bounds = [np.concatenate([[0], np.cumsum(n)]) for n in (self.n_a, self.n_b, self.n_groups)]
        cut_a, cut_b = (np.searchsorted(g, np.arange(len(self.common) + 1)) for g in (self.group_a, self.group_b))
        out = []
        for k in range(len(self.n_a)):
            first, last = bounds[2][k], bounds[2][k + 1]
            start = base = self.common[first - 1] if first else 0
            row = []
            for g in range(first, last):
                row.append({"a": self.ids_a[cut_a[g] : cut_a[g + 1]].tolist(), "b": self.ids_b[cut_b[g] : cut_b[g + 1]].tolist(), "start": max(0, int(start - base) - 1), "end": int(self.common[g] - base) - 1})
                start = self.common[g]
            out.append(row)
        return out


def _runs(texts: list[str]) -> Iterator[list[str]]:
    held, run = 0, []
    for t in texts:
        if run and held + len(t) > BATCH:
            yield run
            held, run = 0, []
        run.append(t)
        held += len(t)
    if run:
        yield run


def _text(docs: DataFrame, text_col: str) -> F.Column:
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """sha, text, copies: one row for each distinct text; null counts as empty."""
    return docs.select(_text(docs, text_col).alias("text")).groupBy("text").agg(F.count("*").alias("copies")).select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "text", "copies")


def align_texts(texts: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """sha, copies, n_a, n_b, n_groups, n_links, groups_sha256, pairs (ascending ids of A * pieces of B + ids of B), times (links of each pair), for rows of distinct_texts."""
    paths = vocabularies or default_vocabularies()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(*paths)
        names = ["sha", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
        for batch in batches:
            done = 0
            for part in _runs(batch.column(1).to_pylist()):
                found = by.align(part)
                pairs, times, sizes = found.pairs()
                bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                digests = [hashlib.sha256(line.encode()).hexdigest() if n else "" for line, n in zip(found.lines(), found.n_a)]
                numbers = [pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
                lists = [pa.ListArray.from_arrays(bounds, pa.array(pairs, pa.int64())), pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), batch.column(2).slice(done, len(part)), *numbers, pa.array(digests, pa.string()), *lists], names)
                done += len(part)
        release()

    return texts.select("sha", "text", "copies").mapInArrow(run, f"sha binary, copies bigint, {TEXT_SCHEMA}, pairs array<bigint>, times array<int>")


def align_documents(docs: DataFrame, vocabularies: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and groups: array of (a, b, start, end), the ids that stand for bytes [start, end) of the UTF-8 text; without copies in between."""
    paths = vocabularies or default_vocabularies()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(*paths)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            done = 0
            for part in _runs(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), pa.array(by.align(part).groups(), kind)], ["doc_id", "groups"])
                done += len(part)
        release()

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), _text(docs, text_col).alias("text")).mapInArrow(run, "doc_id bigint, groups array<struct<a:array<int>,b:array<int>,start:bigint,end:bigint>>")


def pair_counts(aligned: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """pair, count, best: how many documents link a pair of ids, and whether no pair with the same id of A is linked by more."""
    width = F.lit(_piece_count((vocabularies or default_vocabularies())[1]))
    counts = aligned.select(F.explode("pairs").alias("pair"), "copies").groupBy("pair").agg(F.sum("copies").alias("count"))
    counts = Scratch(aligned.sparkSession).table(counts, "counts")
    id_a = F.floor(F.col("pair") / width)
    most = counts.groupBy(id_a.alias("id_a")).agg(F.max("count").alias("most"))  # at most the vocabulary of A
    return counts.withColumn("id_a", id_a).join(F.broadcast(most), "id_a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


@lru_cache(maxsize=4)
def _piece_count(piece_model: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model).vocab_size()


def alignment_measures(docs: DataFrame, vocabularies: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null, empty and unfaithful texts (whose tokens have other bytes, such as those with U+2581) have zeros and an empty digest.
    Null and repeated doc_ids are rows like any other, and repeated rows count as documents of their own.  Columns may have any
    names and extra ones are ignored.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    aligned = scratch.table(align_texts(distinct_texts(docs, text_col), vocabularies).withColumn("uid", F.monotonically_increasing_id()), "aligned")
    pairs = scratch.table(pair_counts(aligned, vocabularies), "pairs")
    links = aligned.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("uid", F.col("link.pairs").alias("pair"), F.col("link.times").cast("bigint").alias("times"))
    n = aligned.agg(F.sum("copies")).first()[0] or 0
    links = links.join(F.broadcast(pairs), "pair") if pairs.count() <= FEW_KEYS else attach(links, pairs, "pair", "count", n)
    sums = links.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    measures = aligned.drop("pairs", "times").join(sums, "uid", "left").drop("uid").fillna(0, ["n_best", "count_sum"])
    measures = scratch.table(measures, "measures")
    scratch.drop("aligned"), scratch.drop("pairs")
    rows = docs.select(docs[id_col].alias("doc_id"), F.unhex(F.sha2(_text(docs, text_col).cast("binary"), 256)).alias("sha"))
    return attach(rows, measures, "sha", "copies", n).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
