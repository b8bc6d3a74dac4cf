"""The manifest against a plain tree of lists."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from readlake.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, tree int, rank string, place int"


def rows(seed=2, n=90):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        lang = rnd.choice(["en"] * 8 + ["de", "de", "日本", None, "", "é"])
        out.append((rnd.randrange(-5, 1000), rnd.choice(["s1", None]), lang, rnd.choice([k, None]), rnd.choice(["", None, "text ü 日本 " * k, "-", "1:a"])))
    out += [(5000, "s", "alone", 3, "x"), (None, "s", "en", 3, "x"), (None, None, None, None, None), out[0], out[0], out[1], (7, "s", "en", 1, "a"), (7, "s", "en", 1, "b")]
    return [(*r, "x", 1, "y", 2) for r in out]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r[:5]))


def tree(leaves, fanout):
    """The root of some leaves, and for each the siblings by level as (place, others)."""
    paths, level, owners = [[] for _ in leaves], leaves, [[k] for k in range(len(leaves))]
    while len(level) > 1:
        above, owned = [], []
        for k in range(0, len(level), fanout):
            run = level[k : k + fanout]
            for j in range(len(run)):
                for leaf_at in owners[k + j]:
                    paths[leaf_at].append((j, run[:j] + run[j + 1 :]))
            above.append(sha("".join(run)))
            owned.append(sum(owners[k : k + fanout], []))
        level, owners = above, owned
    return level[0], paths


def want(data, fanout):
    langs = sorted({r[2] for r in data}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in data if r[2] == lang), key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
        trees[lang] = (own, *tree([leaf(r) for r in own], fanout))
    root, tops = tree([trees[lang][1] for lang in langs], fanout)
    out = []
    for lang, top in zip(langs, tops):
        own, subroot, paths = trees[lang]
        for r, path in zip(own, paths):
            path = path + top
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for place, others in path:
                node = sha("".join(others[:place] + [node] + others[place:]))
            out.append((r[0], leaf(r), subroot, root, sha("".join(x for _, others in path for x in others)), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fanout, depth", [(2, 9), (2, 2), (3, 1), (3, 2)])
def test_every_leaf(spark, fanout, depth):
    data = rows()
    got = merkle.verified_documents(spark.createDataFrame(data, SCHEMA).repartition(5), fanout=fanout, depth=depth)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    expected = want(data, fanout)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected
    assert {True, False} == {r[6] for r in expected}


@pytest.mark.parametrize("few", [merkle.FEW_KEYS, 0])
def test_small_tables(spark, monkeypatch, few):
    monkeypatch.setattr(merkle, "FEW_KEYS", few)
    frame = lambda data: spark.createDataFrame(data, SCHEMA)
    assert merkle.verified_documents(frame([])).collect() == []
    data = rows()
    for part in ([data[0]], data[:2], [r for r in data if r[2] == "en"][:5], [data[0]] * 5):
        assert sorted((tuple(r) for r in merkle.verified_documents(frame(part), depth=1).collect()), key=repr) == want(part, 2)


def test_selected_leaves(spark):
    """Proofs of some leaves are those of all, in digests that a reader can fold alone."""
    m = merkle.build_manifest(spark.createDataFrame(rows(), SCHEMA), depth=2)
    everyone = {(r.id, bytes(r.leaf), bytes(r.proof)) for r in merkle.prove(m).collect()}  # equal rows have proofs of their own
    some = merkle.prove(m, "id > 500").collect()
    assert {r.id for r in some} == {i for i, *_ in everyone if i is not None and i > 500} and some
    assert all((r.id, bytes(r.leaf), bytes(r.proof)) in everyone and merkle.folded(bytes(r.leaf), bytes(r.proof)) == m.root for r in some)
    assert merkle.prove(m, "id > 500 and size = 1").where("false").collect() == []


def test_any_change_shows(spark):
    data = rows()
    root = merkle.build_manifest(spark.createDataFrame(data, SCHEMA)).root
    again = spark.createDataFrame(data[::-1], SCHEMA).repartition(7)
    assert merkle.build_manifest(again).root == root
    assert merkle.build_manifest(again.withColumn("text", F.when(F.col("doc_id") == 5000, "y").otherwise(F.col("text")))).root != root


def test_equal_subtrees_are_stored_once(spark):
    data = [rows()[0]] * 64
    m = merkle.build_manifest(spark.createDataFrame(data, SCHEMA).repartition(3), depth=2)
    assert m.store.count() == 3 and merkle.prove(m).count() == 64


def test_very_long_text(spark):
    data = [(1, "s", "en", 2, "é" * 4_000_000, "x", 1, "y", 2), rows()[0]]
    assert sorted((tuple(r) for r in merkle.verified_documents(spark.createDataFrame(data, SCHEMA)).collect()), key=repr) == want(data, 2)
