import hashlib
import random
from collections import Counter

import pytest

from readlake.llm import suffixes
from readlake.llm.suffixes import blind_trie, multikey_quicksort, ordered, repeated_bytes, shared_strings


def brute(rows, width):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        drop = [False] * len(b)
        for s in range(len(b) - width + 1):
            if seen[b[s : s + width]] > 1:
                drop[s : s + width] = [True] * width
        kept = bytes(x for x, d in zip(b, drop) if not d)
        spans = sum(d and not (k and drop[k - 1]) for k, d in enumerate(drop))
        out.append((i, len(b), sum(drop), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéo") for _ in range(rnd.randrange(1, 9)))
    common = [" ".join(word() for _ in range(rnd.randrange(10, 80))) for _ in range(5)]
    rows = []
    for i in range(n):
        kind = rnd.randrange(6)
        parts = [" ".join(word() for _ in range(rnd.randrange(0, 60))) for _ in range(3)]
        if kind < 3:
            p = rnd.choice(common)
            parts.insert(1, p[rnd.randrange(0, 40) : len(p) - rnd.randrange(0, 40)])
        if kind == 3:
            parts.append("xy " * rnd.randrange(0, 90))
        if kind == 4 and rows:
            t = rnd.choice(rows)[1] or ""
            k = rnd.randrange(0, max(1, len(t)))
            parts = [t[:k] + "Z" + t[k + 1 :]]
        rows.append((i, " ".join(parts)))
    return rows + [(n, None), (n + 1, ""), (None, rows[0][1]), (0, rows[1][1]), (n + 2, "a" * 1000)]


def got(spark, rows, width, **how):
    df = repeated_bytes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), width, **how)
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_matches_brute_force(spark):
    rows = passages(1, 120)
    assert got(spark, rows, 100) == brute(rows, 100)


def test_common_anchors_are_hashed(spark, monkeypatch):
    rows = passages(2, 80)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 3000)
    assert got(spark, rows, 100, many=2) == brute(rows, 100)


@pytest.mark.parametrize("many", [3, 4096])
def test_a_common_passage_in_many_surroundings(spark, monkeypatch, many):
    """One passage in texts of many blocks: whole, at the start, at the end, and in copies of such texts."""
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 1500)
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, rows = text(260), []
    for i in range(60):
        t = {0: passage + text(rnd.randrange(80)), 1: text(rnd.randrange(80)) + passage, 2: text(50) + passage[rnd.randrange(60) :] + text(9), 3: passage[: 260 - rnd.randrange(90)]}[i % 4]
        rows.append((i, t))
    rows += [(100 + i, rows[i][1]) for i in range(0, 60, 7)] + [(200, rows[0][1]), (201, rows[0][1])]
    assert got(spark, rows, 100, many=many) == brute(rows, 100)


def test_empty(spark):
    assert repeated_bytes(spark.createDataFrame([], "doc_id bigint, text string, n_bytes int")).collect() == []


def test_sorting():
    rnd = random.Random(3)
    items = list({bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 40))) for _ in range(300)})
    order, lcp = blind_trie(items)
    assert [items[i] for i in order] == sorted(items)
    for k in range(1, len(order)):
        a, b = items[order[k - 1]], items[order[k]]
        n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert lcp[k] == n
    groups = multikey_quicksort(items, 0, 16)
    flat = [i for g, _ in groups for i in sorted(g, key=items.__getitem__)]
    assert [items[i] for i in flat] == sorted(items)


def test_shared_strings_against_all_pairs():
    rnd = random.Random(7)
    width = 12
    for n in (2, 3, 5, 40, 150):
        contexts = set()
        while len(contexts) < n:
            k = rnd.randrange(0, width - 3)
            contexts.add((k, bytes(rnd.choice(b"ab") for _ in range(k)) + b"xyzz" + bytes(rnd.choice(b"aab") for _ in range(rnd.randrange(width - 3)))))
        contexts = list(contexts)
        prefix = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        want = []
        for i, (k, c) in enumerate(contexts):
            found = []
            for j, (m, d) in enumerate(contexts):
                left, right = prefix(c[:k][::-1], d[:m][::-1]), min(prefix(c[k:], d[m:]), width)
                if i != j and left + right >= width:
                    found.append((left, width - right))
            want.append((max(x for x, _ in found), min(y for _, y in found)) if found else (-1, -1))
        assert shared_strings(contexts, width) == want


def test_order_with_repeats():
    rnd = random.Random(8)
    items = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 30))) for _ in range(200)] + [b"", b"a" * 40, b"a" * 41]
    order, lcp = ordered(items)
    assert [items[i] for i in order] == sorted(items) and sorted(order) == list(range(len(items)))
    for k in range(1, len(order)):
        a, b = items[order[k - 1]], items[order[k]]
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
