"""Quality rules by tokeniser fertility.

Public vocabularies measure each text: characters per token (a SentencePiece vocabulary and a byte-level BPE one), the share of
tokens that fall back to single bytes, and the entropy of the tokens.  Bands for each language, or for the script of texts whose
language has none, say which values are accepted; a text outside any band is rejected.

No piece of either vocabulary spans white space, so words are measured once and remembered up to a bound; a text's figures are
sums over its words.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readlake.llm._shared import mix, release, spans_to_mask

BATCH = 2 << 20
#: Accepted (least, most) of each measure: characters per token of words for both vocabularies, share of byte fallback, entropy in
#: bits per token.  Short texts vary more, so the least characters per token are lowered by SLACK / sqrt(tokens); entropy is judged
#: where a text has ENTROPY_TOKENS tokens or more.  The least values of the four languages are what fit_bands finds on labelled
#: documents (tests repeat that); the other limits are wide, since nothing in these texts reaches them.
BANDS: Mapping[str, dict[str, tuple[float, float]]] = {
    "en": {"piece_chars": (1.99, 9.0), "byte_chars": (2.12, 9.0), "fallback": (0.0, 0.05), "entropy": (5.64, 16.0)},
    "de": {"piece_chars": (2.11, 9.0), "byte_chars": (2.19, 9.0), "fallback": (0.0, 0.05), "entropy": (5.65, 16.0)},
    "fr": {"piece_chars": (1.76, 9.0), "byte_chars": (1.91, 9.0), "fallback": (0.0, 0.05), "entropy": (5.65, 16.0)},
    "es": {"piece_chars": (1.85, 9.0), "byte_chars": (1.96, 9.0), "fallback": (0.0, 0.05), "entropy": (5.47, 16.0)},
    "Latin": {"piece_chars": (1.5, 10.0), "byte_chars": (1.5, 10.0), "fallback": (0.0, 0.10), "entropy": (4.0, 16.0)},
    "other": {"piece_chars": (0.2, 10.0), "byte_chars": (0.2, 10.0), "fallback": (0.0, 0.90), "entropy": (3.0, 16.0)},
}
MARGIN = 0.95
FIT_ROWS = 100_000
SLACK = 3.0
ENTROPY_TOKENS = 200
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
STARTS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a character
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LETTER = np.zeros(256, bool)
LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
LETTER[0xC3:0xCA] = True  # leading bytes of U+00C0 to U+027F
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, piece_chars double, byte_chars double, fallback double, entropy double, band string"


@lru_cache(maxsize=2)
def words_of(piece_model: str, byte_ranks: str) -> Words:
    return Words(piece_model, byte_ranks)


class Words:
    """Token counts and ids of words, remembered up to LIMIT words between batches."""

    LIMIT = 100_000

    def __init__(self, piece_model: str, byte_ranks: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(byte_ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        self.is_byte = np.fromiter((self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())), bool)
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.n_pieces = self.n_fallback = self.n_bytes = self.starts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def of(self, words: list[bytes]) -> np.ndarray:
        """The index of each word; new ones are measured."""
        if len(self.index) > self.LIMIT:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            text = [w.decode() for w in new]
            pieces = self.pieces.encode(text, num_threads=1)
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            ids = np.fromiter((i for p in pieces for i in p), np.int32, int(sizes.sum()))
            ends = np.cumsum(sizes)
            fallback = np.concatenate([[0], np.cumsum(self.is_byte[ids])])
            counts = np.fromiter((len(self.bytes.encode_ordinary(" " + t)) for t in text), np.int64, len(text))
            self.starts = np.concatenate([self.starts, len(self.ids) + ends - sizes])
            self.ids = np.concatenate([self.ids, ids])
            self.n_pieces = np.concatenate([self.n_pieces, sizes])
            self.n_fallback = np.concatenate([self.n_fallback, fallback[ends] - fallback[ends - sizes]])
            self.n_bytes = np.concatenate([self.n_bytes, counts])
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _entropy(words: Words, idx: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sizes = words.n_pieces[idx]
    ends = np.cumsum(sizes)
    ids = words.ids[np.repeat(words.starts[idx] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
    tokens = np.concatenate([[0], ends])[bounds]
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(tokens))
    key, n = np.unique(text * (1 << 32) + ids, return_counts=True)
    total = np.maximum(np.diff(tokens), 1)
    weighted = np.bincount(key >> 32, n * np.log2(n), len(bounds) - 1)
    return np.log2(total) - weighted / total


def _repeats(idx: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of each text inside 3-word windows that the text has twice or more."""
    if len(idx) < 3:
        return np.zeros(len(bounds) - 1, np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    w = idx.astype(np.uint64)
    key = mix(w[:-2] + np.uint64(0x9E3779B97F4A7C15) * mix(w[1:-1] + np.uint64(0x9E3779B97F4A7C15) * mix(w[2:] + (text[:-2].astype(np.uint64) << np.uint64(32)))))
    at = np.flatnonzero(text[:-2] == text[2:])
    key = key[at]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = at[order[twice]]
    return _per_text(spans_to_mask(len(idx), starts, starts + 3), bounds)


def measure(texts: list[bytes], words: Words) -> dict[str, np.ndarray]:
    """The base counts and fertility figures of some texts."""
    split = [t.split() for t in texts]  # divides at the six ASCII white space characters
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
    idx = words.of([w for s in split for w in s])
    sizes = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    dup = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        dup.append(len(lines) - len(set(lines)))
    n_words, chars = np.diff(bounds), _per_text((STARTS & ~SPACE)[data], sizes)
    pieces, byte_tokens = _per_text(words.n_pieces[idx], bounds), _per_text(words.n_bytes[idx], bounds)
    out = {"n_words": n_words, "word_chars": chars, "n_symbols": _per_text(SYMBOL[data], sizes), "n_dup_lines": np.array(dup, np.int64), "n_repeat_words": _repeats(idx, bounds)}
    out["piece_chars"] = chars / np.maximum(pieces, 1)
    out["byte_chars"] = chars / np.maximum(byte_tokens, 1)
    out["fallback"] = _per_text(words.n_fallback[idx], bounds) / np.maximum(pieces, 1)
    out["entropy"] = _entropy(words, idx, bounds)
    out["pieces"] = pieces
    out["latin"] = 2 * _per_text(LETTER[data], sizes) >= chars
    return out


def verdicts(m: dict[str, np.ndarray], langs: list, bands: Mapping) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """base_failed, kept and the name of the band of each text."""
    base_failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    names = [x if x in bands else "Latin" if latin else "other" for x, latin in zip(langs, m["latin"])]
    ok = np.ones(len(names), bool)
    for what in ("piece_chars", "byte_chars", "fallback", "entropy"):
        low, high = (np.array([bands[n][what][k] for n in names]) for k in (0, 1))
        if what.endswith("_chars"):
            low = low - SLACK / np.sqrt(np.maximum(m["pieces"], 1))
        inside = (m[what] >= low) & (m[what] <= high)
        ok &= inside | (m["pieces"] < ENTROPY_TOKENS) if what == "entropy" else inside
    return base_failed, ok & ~base_failed, names


def _vocabularies(piece_model: str | None, byte_ranks: str | None) -> tuple[str, str]:
    import public_tokenizers

    return piece_model or public_tokenizers.path("piece_bpe_32k.model"), byte_ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _in_parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Half-open ranges of rows that hold BATCH bytes or a little more."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        last = min(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BATCH)) + 1, len(sizes))
        yield first, last
        first = last


def good_documents(
    docs: DataFrame, bands: Mapping = BANDS, piece_model: str | None = None, byte_ranks: str | None = None,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """The rows of docs that fertility_rules keeps, with all their columns, in one pass without a shuffle.

    Rows are judged one by one, so null and repeated ids do not matter.  A null text counts as empty and goes, a null or unknown
    language is judged by script.  An empty table gives an empty result.  Columns may have any names.
    """
    model, ranks = _vocabularies(piece_model, byte_ranks)
    names, schema = docs.columns, docs.schema
    at, lang_at = (names.index(docs.select(c).columns[0]) for c in (text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, words = None, Words(model, ranks)  # not kept for later tasks: workers live longer than this stage
        for batch in batches:
            texts = pc.fill_null(batch.column(at).cast(pa.string()).cast(pa.binary()), b"")
            for i, j in _in_parts(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                m = measure(texts.slice(i, j - i).to_pylist(), words)
                kept = verdicts(m, batch.column(lang_at).slice(i, j - i).cast(pa.string()).to_pylist(), bands)[1]
                yield batch.slice(i, j - i).filter(pa.array(kept))
        del words, texts
        release()

    return docs.mapInArrow(run, schema)


def fertility_rules(
    docs: DataFrame, bands: Mapping = BANDS, piece_model: str | None = None, byte_ranks: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """One row per input row with the base counts, base_failed, kept, and the figures and band behind the verdict.  An empty table
    gives an empty result.

    A null text counts as empty: no words, base_failed, not kept.  A null or unknown language is judged by script (Latin where half
    of the characters are Latin letters, else other).  Null and repeated doc_ids are passed on.  Other columns are ignored.  The
    vocabularies are files that every executor can open.
    """
    model, ranks = _vocabularies(piece_model, byte_ranks)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(ids: list, texts: list[bytes], langs: list) -> pa.RecordBatch:
        m = measure(texts, words_of(model, ranks))
        base_failed, kept, band = verdicts(m, langs, bands)
        cols = [pa.array(ids, pa.int64()), *[pa.array(m[n], pa.int64()) for n in names], pa.array(base_failed), pa.array(kept), *[pa.array(m[n], pa.float64()) for n in ("piece_chars", "byte_chars", "fallback", "entropy")], pa.array(band, pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", *names, "base_failed", "kept", "piece_chars", "byte_chars", "fallback", "entropy", "band"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, langs, held = [], [], [], 0
        for batch in batches:
            for i, text, lang in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids.append(i), texts.append(text), langs.append(lang)
                held += len(text)
                if held >= BATCH:
                    yield judge(ids, texts, langs)
                    ids, texts, langs, held = [], [], [], 0
        if ids:
            yield judge(ids, texts, langs)
        release()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(run, SCHEMA)


def fit_bands(docs: DataFrame, labels: DataFrame, bands: Mapping = BANDS, margin: float = MARGIN, rows: int = FIT_ROWS, id_col: str = "doc_id", quality_col: str = "quality") -> dict:
    """bands with least values from labelled documents: of each language, margin times the least that a good document has.

    At most `rows` good documents of a language (those with the smallest hash of their id) are measured, so the fit costs the same for
    any corpus.  Languages without good documents keep their bands.
    """
    good = labels.where(F.col(quality_col) == 1).select(F.col(id_col).cast("bigint").alias("doc_id"))
    figures = fertility_rules(docs.join(good, docs[id_col].cast("bigint") == good["doc_id"], "left_semi"), bands).where(~F.col("base_failed"))
    place = F.row_number().over(Window.partitionBy("band").orderBy(F.xxhash64("doc_id")))
    slack = SLACK / F.sqrt(F.greatest(F.col("word_chars") / F.col("piece_chars"), F.lit(1.0)))
    least = [F.min(F.col("piece_chars") + slack), F.min(F.col("byte_chars") + slack), F.min(F.when(F.col("word_chars") / F.col("piece_chars") >= ENTROPY_TOKENS, F.col("entropy")))]
    fitted = figures.withColumn("place", place).where(F.col("place") <= rows).groupBy("band").agg(*(c.alias(n) for c, n in zip(least, ("piece_chars", "byte_chars", "entropy")))).collect()
    out = {name: dict(limits) for name, limits in bands.items()}
    for r in fitted:
        for what in ("piece_chars", "byte_chars", "entropy"):
            if r["band"] in ("Latin", "other") or r[what] is None:
                continue
            out[r["band"]][what] = (int(r[what] * margin * 100) / 100, out[r["band"]][what][1])
    return out
