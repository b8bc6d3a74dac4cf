"""Alignment of two tokenizers against whole-text tokenisation and plain loops."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import regex
import sentencepiece
from tokenizers import Tokenizer

from readlake.llm import cross_tokenizer as X

SCHEMA = "doc_id bigint, text string, sha string, copies int, uid string, pair int, n_a int"
TEXTS = [
    "The house of the sea", "The house of the sea", "the sea", "  two  spaces\nand\ta line\r\n\r\n  ends ", "naïve Straße œuvre 日本語の文章です", "a▁b has the other mark", "", None,
    "<|endoftext|> and <s> are plain", "\x00\x07", " ", "x" * 5000, "emoji 👩‍👩‍👧 family", "letters of late date \U0001df25 Ᲊ \U00031350 end", "it's I'll we've 12345678 !!??", "The house of the sea ",
    "l'île été　fin", "́combining first",
]


def plain(texts):
    """Per text: (n_a, n_b, n_groups, n_links, line), and its links, by whole texts and loops over tokens."""
    a, b = Tokenizer.from_file(X.default_vocabularies()[0]), sentencepiece.SentencePieceProcessor(model_file=X.default_vocabularies()[1])
    a.encode_special_tokens = True
    of_character = X.byte_characters()
    assert sorted(of_character.values()) == list(range(256))
    out = []
    for t in texts:
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids if t else [], b.encode(t) if t else []
        bytes_a = [bytes(of_character[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            out.append(((0, 0, 0, 0, ""), []))
            continue

        def spans(ids, parts):
            at = 0
            for i, p in zip(ids, parts):
                yield i, at, at + len(p)
                at += len(p)

        left, right = list(spans(ids_a, bytes_a)), list(spans(ids_b, bytes_b))
        links = [(x, y) for x, s, e in left for y, p, q in right if s < q and p < e] if len(left) < 500 else None
        common = sorted({e for *_, e in left} & {e for *_, e in right})
        groups, start = [], 0
        for end in common:
            groups.append(",".join(str(i) for i, s, e in left if start <= s and e <= end) + "|" + ",".join(str(i) for i, s, e in right if start <= s and e <= end))
            start = end
        if links is None:
            links = [(x, y) for x, s, e in left for y, p, q in right if s < q and p < e]
        line = ";".join(groups)
        out.append(((len(ids_a), len(ids_b), len(groups), len(links), hashlib.sha256(line.encode()).hexdigest()), links))
    return out


def expected(rows):
    found = plain([t for _, t in rows])
    counts = Counter(pair for _, links in found for pair in set(links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return sorted(((i, *m[:4], sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), m[4]) for (i, _), (m, links) in zip(rows, found)), key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("few", [X.FEW_KEYS, 0])
def test_measures(spark, monkeypatch, few):
    """Also with repeated and null ids, copies, and columns named like the operator's own; few = 0 joins the counts by a shuffle."""
    monkeypatch.setattr(X, "FEW_KEYS", few)
    monkeypatch.setattr(X, "BATCH", 100)
    rows = [*enumerate(TEXTS), (None, "The house of the sea"), (3, "the sea"), (3, "the sea")]
    docs = spark.createDataFrame([(i, t, "x", 1, "y", 2, 3) for i, t in rows], SCHEMA).repartition(3)
    got = X.alignment_measures(docs)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)


def test_no_documents(spark):
    assert X.alignment_measures(spark.createDataFrame([], SCHEMA)).collect() == []
    assert X.align_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 3000]
    got = X.alignment_measures(docs.where("length(coalesce(text, '')) < 3000"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)


def test_very_long_text(spark):
    """As the same text in parts: units are tokenised alone, and groups end with them."""
    text = " ".join(f"word{k} über {k % 97}" for k in range(150_000))
    row = X.alignment_measures(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    a = Tokenizer.from_file(X.default_vocabularies()[0])
    assert (row.n_a, row.n_b) == (len(a.encode(" " + text).ids), len(sentencepiece.SentencePieceProcessor(model_file=X.default_vocabularies()[1]).encode(text)))


def test_groups_cover_the_text(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    lines = {k: m[4] for k, (m, _) in enumerate(plain(TEXTS))}
    for r in X.align_documents(docs).collect():
        text = (TEXTS[r.doc_id] or "").encode()
        if r.groups:
            assert [g.start for g in r.groups] == [0, *[g.end for g in r.groups[:-1]]] and r.groups[-1].end == len(text)
        line = ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in r.groups)
        assert (hashlib.sha256(line.encode()).hexdigest() if line else "") == lines[r.doc_id]


def test_characters_that_engines_class_differently():
    by = X.aligner(*X.default_vocabularies())
    assert not any(by.unlike(chr(c)) for c in range(0x250)) and by.unlike("\u088f") and not by.unlike("日本語 русский ελληνικά")
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}! {chr(c)}b" for c in (*range(0x80, 0x3400, 7), *range(0xA000, 0x20000, 997)) if not 0xD800 <= c < 0xE000]
    assert [by.a.tokens([by.split_a(t)])[0].tolist() for t in texts if not by.unlike(t)] == [i for t, i in zip(texts, by.whole(texts)) if not by.unlike(t)]
    assert by.align(texts).ids_a.tolist() == [i for t in texts for i in by.whole([" " + t])[0] if "▁" not in t]
    assert regex.findall(public_tokenizers.PATTERN, "  a") == [" ", " a"]
