"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until pieces hold LEAF characters at most; leaves are encoded by tiktoken and neighbours are joined up the tree.
A join re-encodes a window around the seam.  The window grows on each side until it ends at a place where tokens outside provably
cannot change: between a character that is not white space and one that is.  No match of the pattern crosses such a place (white
space stands only at the start of a match, or makes up all of it) and the pattern never looks back, so both halves and the whole
text have a match boundary there, hence the same tokens on its far side.  Where a node has no such place, the window is all of it.

Decoding concatenates the bytes of the tokens up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm._shared import release

LEAF = 4096
WINDOW = 64
#: A character that is not white space, then white space as the pattern's \s (Unicode) has it.
SAFE = re.compile("\\S(?=[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000])")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


class Codec:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.leaf = self.library.encode_ordinary
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.decimal = {i: str(i) for i in ranks.values()}

    def encode(self, text: str) -> list[int]:
        return self._node(text, 0, len(text))

    def _node(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= LEAF:
            return self.leaf(text[start:end])
        middle = (start + end) // 2
        return self._join(text, start, middle, end, self._node(text, start, middle), self._node(text, middle, end))

    def _join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        a, width = start, WINDOW
        while middle - width > start:  # the last safe place before the seam
            places = [m.end() for m in SAFE.finditer(text, middle - width, middle)]
            if places and places[-1] < middle:
                a = places[-1]
                break
            width *= 2
        b, width = end, WINDOW
        while middle + width < end:  # the first safe place after it
            place = SAFE.search(text, middle, middle + width)
            if place:
                b = place.end()
                break
            width *= 2
        keep = self._count(left[::-1], len(text[a:middle].encode()))
        drop = self._count(right, len(text[middle:b].encode()))
        return left[: len(left) - keep] + self.leaf(text[a:b]) + right[drop:]

    def _count(self, tokens: list[int], size: int) -> int:
        """How many of the first tokens make up size bytes."""
        n = 0
        while size > 0:
            size -= len(self.bytes_of[tokens[n]])
            n += 1
        if size:
            raise AssertionError("a token crosses a safe place")
        return n

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> for each row of docs; null texts give empty arrays, null and repeated doc_ids are passed on.

    vocabulary is a tiktoken rank file that every executor can open.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path).encode
        for batch in batches:
            ids = pa.array([encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(tokens: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes (binary) for each row of tokens; null arrays count as empty, unknown ids raise."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return tokens.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, bytes binary")


def token_digests(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256, in one pass: each text is encoded up the tree, its ids decoded up the tree."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        decimal = c.decimal.__getitem__
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for text in batch.column(1):
                ids = c.encode(text.as_py())
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        release()

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
