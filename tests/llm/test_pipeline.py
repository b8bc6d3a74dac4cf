"""The stages against plain computations on a small table."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline as P  # noqa: E402
from readlake.llm import bpe_tree, fertility  # noqa: E402
from readlake.llm._shared import ROW, keyed_rows  # noqa: E402
from readlake.llm.jaccard import jaccard_classes  # noqa: E402
from readlake.llm.mixing import mix_sources, mixed_documents  # noqa: E402


def test_each_stage_takes_effect(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in fertility.fertility_rules(docs).where("kept").collect()}
    out = []
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        out.append(docs.count())
        if k == 0:
            assert {r.doc_id for r in docs.collect()} == kept
        if k == 1:
            assert docs.selectExpr("regexp_replace(text, '[ \\t-\\r]+', ' ')").distinct().count() == out[-1] == before.selectExpr("regexp_replace(text, '[ \\t-\\r]+', ' ')").distinct().count()
        if k == 2:
            assert {r.doc_id for r in docs.collect()} == {r.component_id for r in jaccard_classes(before).collect()}
        if k == 3:
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in mix_sources(before, share=P.MIX_SHARE, max_epochs=1.0).collect()}
    assert out == sorted(out, reverse=True) and out[0] > out[-1] > 0
    last = P.STAGES[-1][1](spark, docs, str(tmp_path))
    c = bpe_tree.codec(bpe_tree.default_vocabulary())
    assert {(r.doc_id, r.n_tokens) for r in last.collect()} == {(r.doc_id, len(c.library.encode_ordinary(r.text or ""))) for r in docs.collect()}


@pytest.mark.parametrize("written", [False, True])
def test_null_and_repeated_ids_are_rows_like_any_other(spark, tmp_path, written):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    good = jaccard_classes(docs).where("doc_id = component_id").join(fertility.fertility_rules(docs).where("kept").select("doc_id"), "doc_id")
    a, b, c, d, e = docs.join(good.select("doc_id"), "doc_id").orderBy("doc_id").dropDuplicates(["text"]).limit(5).toPandas().text
    short = "far too short"
    made = [
        (1, a, "a"), (1, a, "a again"), (None, a, "a without id"), (2, b, "b"), (9, b, "copy of b"), (9, c, "c shares 9 with the copy of b"),
        (None, d, "d without id"), (None, d, "d without id again"), (None, short, "short without id"), (7, short, "short"), (7, e, "e shares 7 with short"),
        (None, b + " end", "near b without id"), (8, d + " end", "near d"), (8, d + " end of it", "near d again"), (7, e + " end", "near e, same id"),
    ]
    table = spark.createDataFrame([(i, t, "en", "source1", m) for i, t, m in made], "doc_id bigint, text string, lang string, source string, mark string")

    def stored(df, name):
        if written:
            df.repartition(3).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}") if written else df

    table = stored(table, "all")

    def marks(df):
        return sorted(r.mark for r in df.collect())

    kept = [fertility.verdicts(fertility.measure([t.encode()], fertility_words()), ["en"], fertility.BANDS)[1][0] for _, t, _ in made]
    clean = P.quality_rules(spark, table, str(tmp_path))
    assert marks(clean) == sorted(m for (_, _, m), ok in zip(made, kept) if ok)
    table = stored(table.where("text != 'far too short'"), "clean")
    assert clean.columns == table.columns
    once = marks(P.exact_copies(spark, table, str(tmp_path)))
    assert len(once) == len({t for _, t, _ in made} - {short})
    assert len({"a", "a again"} & set(once)) == 1 and len({"d without id", "d without id again"} & set(once)) == 1
    assert {"b", "c shares 9 with the copy of b", "e shares 7 with short"} <= set(once) and not {"a without id", "copy of b"} & set(once)
    near = marks(P.near_copies(spark, table, str(tmp_path)))
    assert len(near) == 5 and {"b", "c shares 9 with the copy of b"} <= set(near)
    assert [len(x & set(near)) for x in ({"a", "a again"}, {"near d", "near d again"}, {"e shares 7 with short", "near e, same id"})] == [1, 1, 1]
    assert marks(mixed_documents(table, share=1.0, max_epochs=1.0)) == marks(table)


def fertility_words():
    import public_tokenizers

    return fertility.words_of(public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_keys_of_rows_are_distinct_and_stay(spark, tmp_path):
    spark.range(1000).repartition(5).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    for docs, n in ((table, 1000), (table.crossJoin(spark.range(3).withColumnRenamed("id", "k")), 3000), (table.limit(0), 0)):
        rows = keyed_rows(docs)
        assert rows.columns == [*docs.columns, ROW]
        first = rows.collect()
        assert len({r[ROW] for r in first}) == len(first) == n
        assert sorted(first) == sorted(rows.collect())


def test_stages_take_any_columns_nulls_and_no_rows(spark, tmp_path):
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, __row string, __gone int, __read int, uid int, h int, class int, text_5 string, cell int"
    long = "a long text of words " * 30_000
    rows = [(1, "one " * 3, "en", "news", 1), (None, None, None, None, None), (1, None, "en", "s99999999999999999999", 2), (3, "", "xx", "src1", 3), (4, " ".join(f"word{i}" for i in range(90)), "en", "src2", 4), (5, long, "de", "src1", 5)]
    docs = spark.createDataFrame([(*r, f"r{k}", 1, 2, 3, 4, 5, "t", 7) for k, r in enumerate(rows)], names)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        got = out.collect()
        assert {r["__row"] for r in got} <= {f"r{k}" for k in range(len(rows))} and all(r["uid"] == 3 for r in got)
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert len(P.exact_copies(spark, docs, "").collect()) == 4  # two nulls and an empty text are one
    assert len(P.near_copies(spark, docs, "").collect()) == 6
    last = P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(last) == 6 and sum(r.n_tokens == 0 for r in last) == 3
