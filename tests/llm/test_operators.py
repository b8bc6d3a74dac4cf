"""Each operator against a plain computation, with nulls, empty and repeated rows, ties, and extra columns with clashing names."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from readlake.llm import bpe_tree, fertility, hidden_markov, jaccard, mixing, recompression, templates
from readlake.llm.exact_dedup import exact_dedup
from readlake.llm.jaccard import jaccard_classes
from readlake.llm.mixing import mix_sources, water_fill
from readlake.llm.recompression import substring_dedup
from readlake.llm.sharding import interleaved_shards
from readlake.llm.templates import extract_main_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, block bigint, n_words string, h int, keep_id int"


def corpus(seed=1, n=80):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randrange(1, 7))) for _ in range(400)]
    text = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passage = text(40)
    rows = []
    for i in range(n):
        kind = rnd.randrange(7)
        if kind == 0 and rows:
            t = rnd.choice(rows)[1]
        elif kind == 1 and rows and rows[-1][1]:
            words = (rnd.choice(rows)[1] or "a").split(" ")
            words[rnd.randrange(len(words))] = "Changed"
            t = " ".join(words)
        elif kind == 2:
            t = text(20) + "\n" + passage + " " + text(rnd.randrange(30))
        elif kind == 3:
            t = "la " * rnd.randrange(60) + text(5)
        else:
            t = text(rnd.randrange(120))
        rows.append((i, t, rnd.choice(["en", "de", None]), f"src{rnd.choice([0, 0, 0, 1, 2])}", 7, "x", 1, 2))
    extra = [(n, None), (n + 1, ""), (n + 2, "  \t\n"), (n + 3, "one"), (n + 4, "One"), (None, rows[2][1]), (3, rows[5][1]), (4, rows[4][1])]
    return rows + [(i, t, "en", None, 7, "x", 1, 2) for i, t in extra]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, nothing):
    for f in (exact_dedup, substring_dedup, jaccard_classes, interleaved_shards, mix_sources, bpe_tree.token_digests, fertility.fertility_rules, hidden_markov.score_documents):
        assert f(nothing).collect() == [], f.__name__
    assert extract_main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = []
    for t, ids in groups.items():
        first = min(ids, key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(t.encode()).hexdigest()
        want += [(i, first, len(ids), sha) for i in ids]
    got = exact_dedup(docs)
    assert rows_of(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr)
    assert got.where("kept").count() == len(groups)
    in_parts = exact_dedup(docs, max_bits=512)  # three fields
    assert rows_of(in_parts, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr) and in_parts.where("kept").count() == len(groups)


def test_substring_dedup(docs, monkeypatch):
    monkeypatch.setattr(recompression, "BLOCK_BYTES", 4000)
    for width in (13, 3):
        first = {}
        texts = [(i, WORD.findall(t or "")) for i, t, *_ in corpus()]
        for i, w in texts:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, math.inf), math.inf if i is None else i)
        want = []
        for i, w in texts:
            drop = set()
            for k in range(len(w) - width + 1):
                if first[tuple(w[k : k + width])] < (math.inf if i is None else i):
                    drop |= set(range(k, k + width))
            kept = " ".join(x for k, x in enumerate(w) if k not in drop)
            want.append((i, len(w), len(drop), hashlib.sha256(kept.encode()).hexdigest()))
        if width == 13:
            assert rows_of(substring_dedup(docs, width), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_classes(docs):
    rows = corpus()
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    members = defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(k)
    want = []
    for group in members.values():
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        want += [(rows[k][0], len(sets[k]), min(ids) if ids else None) for k in group]
    assert rows_of(jaccard_classes(docs), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


def test_bpe(docs, monkeypatch):
    c = bpe_tree.codec(bpe_tree.default_vocabulary())
    want = []
    for i, t, *_ in corpus():
        ids = c.library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows_of(bpe_tree.token_digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    tokens = bpe_tree.encode_documents(docs)
    assert rows_of(bpe_tree.decode_documents(tokens), "doc_id", "bytes") == sorted(((i, bytearray((t or "").encode())) for i, t, *_ in corpus()), key=repr)
    monkeypatch.setattr(bpe_tree, "LEAF", 7)
    monkeypatch.setattr(bpe_tree, "WINDOW", 2)
    rnd = random.Random(1)
    for _ in range(2000):
        x = "".join(rnd.choice("ab \n\t'sllreé　\x85\x1c​0 1.,!") for _ in range(rnd.randrange(90)))
        assert c.encode(x) == c.library.encode_ordinary(x), repr(x)
        assert c.decode(c.encode(x)) == x.encode()


def test_shards(docs):
    rows = interleaved_shards(docs, shards=8).collect()
    n = Counter(r["shard"] for r in rows)
    assert max(n.values()) - min(n.values()) <= 1 and set(n) == set(range(8))
    for s in n:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n[s]))
    by_source = Counter((r["source"], r["shard"]) for r in rows)
    for source, total in Counter(r["source"] for r in rows).items():
        assert all(abs(by_source[source, s] - total / 8) <= 2 for s in range(8))
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in corpus()), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == want
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)


def test_water_fill():
    assert water_fill(10, [1, 1], [100, 100]) == [5, 5]
    assert water_fill(10, [1, 1], [2, 100]) == [2, 8]
    assert water_fill(10, [3, 1, 1], [2, 3, 100]) == [2, 3, 5]
    assert water_fill(10, [1, 1], [2, 3]) == [2, 3]


def test_budgets_spread_shortages_among_siblings_first():
    leaves = {("a", "en", "s1"): 10, ("a", "en", "s2"): 1000, ("b", "en", "s3"): 1000}
    weights = {("a",): 1, ("b",): 1, ("a", "en", "s1"): 9}
    given = mixing.budgets(leaves, 400, weights, 1.0)
    assert given == {("a", "en", "s1"): 10, ("a", "en", "s2"): 190, ("b", "en", "s3"): 200}
    assert mixing.budgets({("a", "en", "s1"): 10, ("b", "en", "s3"): 1000}, 400, {}, 1.0) == {("a", "en", "s1"): 10, ("b", "en", "s3"): 390}


def test_mixing(docs):
    rows = [(i, len(WORD.findall(t or "")), "note" if len(t or "") < 100 else "article", lang, source) for i, t, lang, source, *_ in corpus()]
    how = {"domain": "CASE WHEN length(coalesce(text, '')) < 100 THEN 'note' ELSE 'article' END"}
    tokens = Counter()
    for _, n, *leaf in rows:
        tokens[tuple(leaf)] += n
    got = mix_sources(docs, **how).collect()
    read, budget = defaultdict(list), {}
    for r in got:
        read[r["domain"], r["lang"], r["source"]].append(r)
        budget[r["domain"], r["lang"], r["source"]] = r["leaf_budget"]
    assert 0.4 * sum(tokens.values()) <= sum(r["n_tokens"] for r in got) <= 0.6 * sum(tokens.values())
    longest = max(n for _, n, *_ in rows)
    for leaf, total in tokens.items():
        used = sum(r["n_tokens"] for r in read[leaf])
        assert used <= min(budget.get(leaf, 0), 2 * total) and budget.get(leaf, 0) - used <= longest, leaf
        epochs = Counter(r["epoch"] for r in read[leaf])
        own = [x for x in rows if tuple(x[2:]) == leaf]
        # epochs before the last are whole
        assert sorted(epochs.values(), reverse=True)[: max(0, len(epochs) - 1)] == [len(own)] * max(0, len(epochs) - 1), (leaf, epochs)
        for e in epochs:
            assert not Counter((r["doc_id"], r["n_tokens"]) for r in read[leaf] if r["epoch"] == e) - Counter((x[0], x[1]) for x in own)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix_sources(docs.repartition(7), **how).collect()), key=repr)
    other = mix_sources(docs, seed=12, **how).collect()
    assert sorted(map(tuple, got), key=repr) != sorted(map(tuple, other), key=repr)


def test_mixing_fills_weights(spark):
    """Budgets by hand: of 300 tokens, articles get 3 parts to 1 of notes; en has too little among the articles, so de takes the rest."""
    rows = [(k, "w " * 600, "en" if k < 2 else "de", "s") for k in range(40)] + [(100 + k, "w " * 10, "en", "s") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = mix_sources(docs, share=0.5, weights={("article",): 3.0, ("note",): 1.0}, max_epochs=1.0).groupBy("domain", "lang").agg(F.sum("n_tokens"), F.first("leaf_budget")).collect()
    assert {tuple(r[:2]): (r[2], r[3]) for r in got} == {("article", "en"): (1200, 1200), ("article", "de"): (10800, 11175), ("note", "en"): (4120, 4125)}


def test_fertility_base_counts(docs):
    want = []
    for i, t, *_ in corpus():
        t = t or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    got = fertility.fertility_rules(docs)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert got.where("base_failed and kept").count() == 0


def test_fertility_measures():
    import public_tokenizers as P
    import sentencepiece

    w = fertility.words_of(P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"))
    text = "the quick 🦙🦙 brown the\nfox ᚠᚢ the"
    m = fertility.measure([b"", text.encode(), "x".encode()], w)
    ids = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")).encode(text.split())
    flat = [i for x in ids for i in x]
    n = Counter(flat)
    entropy = -sum(c / len(flat) * math.log2(c / len(flat)) for c in n.values())
    assert m["pieces"][1] == len(flat) and math.isclose(m["entropy"][1], entropy) and m["entropy"][0] == 0 and m["fallback"][1] > 0
    assert math.isclose(m["piece_chars"][1], sum(map(len, text.split())) / len(flat))


def test_hidden_markov_lattice(monkeypatch):
    rng = np.random.default_rng(0)
    part = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    m = hidden_markov.Model(part(rng.random(3), 0), part(rng.random((3, 3)), 1), part(rng.random((7, 3)), 0))
    monkeypatch.setattr(hidden_markov, "LENGTH", 4)
    sizes = np.array([1, 3, 4, 5, 8, 9, 30, 2])
    symbols = rng.integers(0, 7, sizes.sum())
    initial, step, emit, scores, at = np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3)), [], 0
    for n in sizes:
        x = symbols[at : at + n]
        at += n
        alpha, beta = [m.initial * m.emit[x[0]]], [np.ones(3)]
        for t in range(1, n):
            alpha.append((alpha[-1] @ m.step) * m.emit[x[t]])
            beta.insert(0, m.step @ (m.emit[x[n - t]] * beta[0]))
        p = alpha[-1].sum()
        scores.append(np.log10(p))
        initial += alpha[0] * beta[0] / p
        for t in range(n):
            emit[x[t]] += alpha[t] * beta[t] / p
            if t:
                step += np.outer(alpha[t - 1], m.emit[x[t]] * beta[t]) * m.step / p
    lattice = hidden_markov.Lattice(m, symbols, sizes)
    a, b, c, total = lattice.counts()
    assert np.allclose(lattice.forward(), scores) and math.isclose(total, sum(scores))
    assert np.allclose(a, initial) and np.allclose(b, step) and np.allclose(c, emit)


def test_hidden_markov_scores(docs):
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False
    rows = [(i, WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t, *_ in corpus()]
    c = Counter()
    for i, w in rows:
        if not out(i):
            c.update([*w, None])
    total, v = sum(c.values()), len(c)
    want = sorted(((i, out(i), len(w) + 1, sum(c[x] > 0 for x in [*w, None]), total, round(sum(math.log10((c[x] + 1) / (total + v + 1)) for x in [*w, None]), 6)) for i, w in rows), key=repr)
    got = hidden_markov.score_documents(docs, rounds=1)
    assert rows_of(got.withColumn("base_score", F.round("base_score", 6)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score") == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got.collect())


PAGE = '<html><head><title>T {i}</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/{i}">menu {i}</a></li></ul></nav><div class="ad">buy {i}</div>{body}<footer>&copy; host {i}</footer></body></html>'


def test_main_text(spark):
    rows = []
    for i in range(12):
        rows.append((i, f"http://a.example/{i}", PAGE.format(i=i, body=f"<article><h1>Head {i}</h1><p>One  &amp;\n two{i}.<br><p><b>Three</b> four {i}<form>send</form></p><div class='share'>x</div></article>")))
        rows.append((100 + i, f"http://b.example/{i}", PAGE.format(i=i, body=f'<div id="content"><p>Text &lt;{i}&gt; of b, rather long so that it weighs.</p><p>Same for all</p></div><div class="sidebar">s</div>')))
    rows += [(300, None, None), (301, "http://c.example", "<p>only  page</p>"), (302, "http://c.example/x", "plain text")]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(12):
        assert got[i] == f"Head {i}\nOne & two{i}.\nThree four {i}"
        assert got[100 + i] == f"Text <{i}> of b, rather long so that it weighs."  # the line that every page has is template
    assert got[300] == "" and got[301] == "only page" and got[302] == "plain text"


RENAMED = '<html><body><div class="z1"><a href="/x">{a} go</a><a href="/y">there</a></div><div class="z2"><div class="q7"><p>{lead}</p><div class="k1">{same}</div><div class="k2"><a href="/u">see {a} also</a></div><p>{rest}</p></div></div><div class="z3"><p>{side}</p></div></body></html>'


def renamed_pages(n=14):
    rnd = random.Random(2)
    text = lambda k: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    out = []
    for i in range(n):
        lead, rest = text(60), text(40)
        side = text(300) if i == 3 else text(4)  # on one page the side says more than the article
        out.append((i, lead, rest, RENAMED.format(a=text(1), lead=lead, rest=rest, same="Sign up for our letters today", side=side)))
    return out


def test_slots_decide_where_names_say_nothing(spark):
    pages = renamed_pages()
    rows = [(i, f"https://h.example/{i}", html) for i, _, _, html in pages] + [(99, "https://h.example/none", None), (98, "https://h.example/odd", "<p>an odd page</p>")]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i, lead, rest, html in pages:
        assert got[i] == f"{lead}\n{rest}"
        assert templates.main_text(html) != got[i]  # without the template: the fixed slots too, and on page 3 the side
    assert got[99] == "" and got[98] == "an odd page"
    assert len(templates.main_text(pages[3][3])) > len(got[3])


def test_template_classes(spark):
    """Classes and slots against plain occurrence vectors over whole pages."""
    from readlake.llm._shared import Scratch

    pages = [("h", i, PAGE.format(i=i, body="<article><p>" + "x " * i + "</p></article>" + "<section>s</section>" * (i % 3))) for i in range(1, 7)]
    pages += [("r", 20 + i, html) for i, _, _, html in renamed_pages(6)] + [("r", 50, "")]
    found = {r.host: r for r in templates.host_templates(spark.createDataFrame(pages, "host string, uid bigint, html string"), Scratch(spark)).collect()}
    for host in "hr":
        own = [templates.page_counts(html) for h, _, html in pages if h == host and html]
        vectors = defaultdict(lambda: [0] * len(own))
        tags, chars = {}, Counter()
        for k, counts in enumerate(own):
            for token, (tag, n, _, size, _, _) in counts.items():
                vectors[token][k] = n
                tags[token] = tag
                chars[token] += size
        classes = defaultdict(set)
        for token, v in vectors.items():
            if token and tags[token] and set(v) <= {0, 1} and sum(v) >= max(2, len(own) / 2):
                classes[tuple(v)].add(token)
        want = {t for c in classes.values() for t in c if not tags[t].startswith("/") and "/" + tags[t] in {tags[x] for x in c}}
        assert {e.token for e in found[host].elements} == want and len(want) >= 4
        assert {e.token: e.chars for e in found[host].elements} == {t: chars[t] for t in want}
        assert [e.place for e in found[host].elements] == sorted(e.place for e in found[host].elements)
    assert found["r"].host_pages == 7 and found["r"].full_pages == 6
    assert [e.tag for e in found["r"].elements if e.same] == ["div.k1"]


@pytest.mark.parametrize("group", [2, 32])
def test_jaccard_classes_of_crowded_neighbours(spark, monkeypatch, group):
    """Edited copies around an original that is not there, near the threshold on both sides, and texts that share a passage."""
    monkeypatch.setattr(jaccard, "GROUP", group)
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(10**6)}"
    rows = []
    for length, copies in ((90, 160), (150, 120), (30, 40)):
        base = [word() for _ in range(length)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rnd.choice([1, 1, 2, 3, 4, 6])):
                t[rnd.randrange(0, length, 3)] = rnd.choice([word(), "same", "other"])
            rows.append((len(rows), " ".join(t[rnd.randrange(3) :])))
    passage = [word() for _ in range(80)]
    for _ in range(60):
        rows.append((len(rows), " ".join(passage + [word() for _ in range(rnd.randrange(2, 30))])))
    sets = [shingles(t) for _, t in rows]
    reach = list(range(len(rows)))

    def find(a):
        while reach[a] != a:
            a = reach[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                reach[y] = x
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert rows_of(got, "doc_id", "component_id") == sorted(((i, find(i)) for i in range(len(rows))), key=repr)
    assert 20 < len({find(i) for i in range(len(rows))}) < 300


@pytest.mark.parametrize("often", [1 << 15, 8])
def test_hidden_markov_score_is_the_plain_recursion(spark, docs, monkeypatch, often):
    """Scores from the fitted tables, word by word in plain Python; words of a class share out its probability whole."""
    from readlake.llm._shared import word_hashes

    monkeypatch.setattr(hidden_markov, "FREQUENT", often)
    monkeypatch.setattr(hidden_markov, "FAN_IN", 2)
    texts, words, m, v = hidden_markov.fit(docs, states=3, rounds=2)
    expected = {}
    blocks = {r.block: r for r in texts.collect()}
    for r in words.collect():
        keys = np.frombuffer(blocks[r.block]["keys"], np.uint64)
        of, bounds = hidden_markov.cut(keys, hidden_markov.bucket_count(spark))
        i, j = next((i, j) for b, i, j in zip(of.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()) if b == r.bucket)
        expected |= dict(zip(keys[i:j].tolist(), hidden_markov._sums(hidden_markov.unpack(r.word_sums), np.frombuffer(hidden_markov.unpack(blocks[r.block]["word_counts"]), np.int64)[i:j], 3).tolist()))
    rows = [(i, WORD.findall(re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))) for i, t, *_ in corpus()]
    count = Counter(w for i, ws in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    number = {w: int(word_hashes(w.encode(), np.array([len(w.encode())]))[0][0]) for _, ws in rows for w in ws}
    place = {k: n for n, k in enumerate(v.keys.tolist())}
    kind = lambda w: int(hidden_markov.Tokens(w.encode(), np.array([len(w.encode())])).classes[0])
    smooth, sums, shares = 7.0, defaultdict(lambda: np.zeros(3)), defaultdict(lambda: np.zeros(3))
    class_totals = Counter()
    for x in count:
        if number[x] not in place:
            class_totals[kind(x) if count[x] >= hidden_markov.LEAST else ("low", kind(x))] += count[x] + (count[x] < hidden_markov.LEAST)
    assert (len(place) == len(count)) == (often > 8)

    def emitted(w):
        if w is None:
            return m.emit[len(place)]
        if number[w] in place:
            return m.emit[place[number[w]]]
        c = kind(w)
        if count[w] < hidden_markov.LEAST:
            return m.emit[len(place) + 1 + 256 + c] * (count[w] + 1) / (class_totals["low", c] + 1)
        share = (np.array(expected.get(number[w], [0.0] * 3)) + smooth * count[w] / class_totals[c]) / (m.in_class[c] + smooth)
        if w not in seen:
            seen.add(w)
            sums[c] += expected[number[w]]
            shares[c] += share
        return m.emit[len(place) + 1 + c] * share

    seen, want = set(), []
    for i, ws in rows:
        p, log = None, 0.0
        for w in [*ws, None]:
            p = (m.initial if p is None else p @ m.step) * emitted(w)
            log += math.log10(p.sum())
            p = p / p.sum()
        want.append((i, round(log, 4)))
    got = hidden_markov.score_documents(docs, states=3, rounds=2, smooth=smooth)
    assert rows_of(got.withColumn("score", F.round("score", 4)), "doc_id", "score") == sorted(want, key=repr)
    for c in sums:
        assert np.allclose(sums[c], m.in_class[c], rtol=1e-6, atol=1e-5)
        if all(w in seen for w in count if count[w] >= hidden_markov.LEAST and number[w] not in place and kind(w) == c):
            assert np.allclose(shares[c], 1, rtol=1e-6)


SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_fertility_bands_are_the_fitted_ones_and_hold_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert fertility.fit_bands(docs, labels) == fertility.BANDS
    half = labels.where("doc_id % 2 = 0")
    bands = fertility.fit_bands(docs, half)
    judged = fertility.fertility_rules(docs, bands).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    share = {r.quality: r.share for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.99 and share[0] < 0.5


def test_fertility_verdicts_by_hand(spark):
    """kept against limits written out here: a text is kept when the base rules pass and each figure lies in its band."""
    rows = [(1, " ".join(f"the house of number{k}" for k in range(60)), "en"), (2, "xq zj vk " * 5 + " ".join(f"qx{k}jz wvq{k}" for k in range(60)), "en"), (3, " ".join("日本語の文章です" + chr(0x4E00 + k) for k in range(60)), None), (4, "short text", "en")]
    bands = {n: {"piece_chars": (1.9, 9.0), "byte_chars": (1.9, 9.0), "fallback": (0.0, 0.5), "entropy": (2.0, 16.0)} for n in ("en", "Latin", "other")} | {"other": {"piece_chars": (0.1, 9.0), "byte_chars": (0.1, 9.0), "fallback": (0.0, 0.9), "entropy": (1.0, 16.0)}}
    for r in fertility.fertility_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), bands).collect():
        text = dict((a, b) for a, b, _ in rows)[r.doc_id]
        words = text.split()
        repeats = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {k + d for k in range(len(words) - 2) if repeats[tuple(words[k : k + 3])] > 1 for d in range(3)}
        base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        limits = bands[r.band]
        pieces = r.word_chars / r.piece_chars
        inside = r.fallback <= limits["fallback"][1] and (pieces < 200 or limits["entropy"][0] <= r.entropy) and all(getattr(r, x) >= limits[x][0] - 3 / math.sqrt(pieces) and getattr(r, x) <= 9 for x in ("piece_chars", "byte_chars"))
        assert (r.base_failed, r.kept) == (base, inside and not base)
        assert r.band == {1: "en", 2: "en", 3: "other", 4: "en"}[r.doc_id]


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """Expected counts travel in 24 bits: other blocks move a score by rounding alone, and a word 70,000 times in a block is no special case."""
    monkeypatch.setattr(hidden_markov, "FREQUENT", 1)  # in the driver, which decides what is a symbol
    rnd = random.Random(12)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randrange(50)))) for k in range(60)] + [(100, "the " * 70_000), (101, "the w1 the w2")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [{r.doc_id: r.score for r in hidden_markov.score_documents(docs.repartition(n, "doc_id")).collect()} for n in (1, 3, 5)]
    assert all(math.isfinite(s) for f in found for s in f.values())
    for other in found[1:]:
        assert all(abs(other[i] - s) < 1e-5 + 1e-7 * len(dict(rows)[i].split()) for i, s in found[0].items())


def test_names_around_the_main_slot_do_not_empty_pages():
    """Sidebars, forms and logins in names of what is around the article, and the same pages with neutral tags."""
    import pyarrow.parquet as pq

    pages = [p for p in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist() if p]
    want = [templates.main_text(p) for p in pages]
    changes = [
        lambda p: p.replace("<body>", '<body class="has-sidebar">'), lambda p: p.replace("<body>", '<body class="page login">'),
        lambda p: p.replace("<body>", '<body><form id="aspnetForm">').replace("</body>", "</form></body>"),
        lambda p: p.replace("<article", '<div class="content side-by"><article').replace("</article>", "</article></div>"),
        lambda p: p.replace("<html", '<html class="no-js has-cookies-banner"'),
    ]
    for change in changes:
        assert [change(p) != p for p in pages].count(True) > len(pages) // 2
        assert [templates.main_text(change(p)) for p in pages] == want
    assert all(want)
    inside = '<body><article><p>Kept text of some length.</p><div class="related"><p>Other things</p></div><form><p>Name</p></form></article></body>'
    assert templates.main_text(inside) == "Kept text of some length."
