from pyspark.sql import functions as F

from readlake.functions import text as T
from readlake.operators import alignment as A
from readlake.operators import transcript
from readlake.operators import books as B
from readlake.operators import lookup as L


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_counted_text(spark):
    text = "가힣ㄱㆎ 한글 日本語 Aｚ9、! 𠮟🙂꯿힤㄰㆏가"
    assert one(spark, T.counted_text(F.lit(text))) == "가힣ㄱㆎ한글日本語Aｚ9𠮟"
    ruby = '<body>가 <ruby>漢<rp class="fallback">fallback</rp><rt>かん</rt><rp>한글</rp></ruby>、𠮟A</body>'
    assert one(spark, T.visible_text(F.lit(ruby))) == "<body>가 漢、𠮟A</body>".replace("<body>", "").replace("</body>", "")
    assert one(spark, T.matchable_text(F.lit("<html><body>𠮟&#12354;猫&#x3042;犬&#X2000B;A</body></html>"))) == "𠮟猫犬A"
    assert one(spark, T.visible_text(F.lit("a&amp;lt;b"))) == "a<b"


def test_titles_round_trip(spark):
    for title in ("a ", "a.", "50%: *x* / \\ | \"q\" <b>?", "plain", "%41"):
        name = T.escape_title(F.lit(title))
        assert one(spark, T.unescape_title(name)) == title
        assert not set(one(spark, name)) & set('/?<>\\:*|"')


def test_storage_name_is_bounded(spark):
    assert one(spark, F.octet_length(T.storage_name(F.lit("あ" * 200)))) <= 250
    assert one(spark, T.storage_name(F.lit("é"))) == "é"


def test_speech_and_kana(spark):
    assert one(spark, T.speech_text(F.lit("<p>５０％ ｶﾞ カタ、AB</p>"))) == "50ぱーせんとがかたab"
    assert one(spark, F.size(T.morae(F.lit("きょうと")))) == 3
    assert one(spark, T.pitch_pattern(F.lit("きょうと"), F.lit(0))) == "LHHH"
    assert one(spark, T.pitch_category(F.lit("きょうと"), F.lit(3), F.lit(False))) == "odaka"


def test_natural_order(spark):
    rows = spark.createDataFrame([("Vol 10",), ("vol 9",), ("Vol 09b",), ("Vol 2",)], "t string")
    assert [r.t for r in rows.orderBy(T.natural_key(F.col("t"))).collect()] == ["Vol 2", "vol 9", "Vol 09b", "Vol 10"]


CHAPTERS = [("b", 0, "text/chapter-1.xhtml", "<html><body><p>First</p></body></html>"), ("b", 1, "text/chapter-2.xhtml", "<html><body><p>Second</p></body></html>")]


def chapters(spark, rows=CHAPTERS):
    return spark.createDataFrame(rows, "book string, ord bigint, href string, html string")


def test_book_facts(spark):
    facts = B.book_facts(chapters(spark))
    assert [(r["count"], r.start, r.total) for r in facts.orderBy("ord").collect()] == [(5, 0, 11), (6, 5, 11)]
    assert B.facts_valid(facts).first().valid


def test_positions_past_the_end(spark):
    facts = B.book_facts(chapters(spark))
    at = spark.createDataFrame([("b", 0, 4), ("b", 1, 50)], "book string, id bigint, character bigint")
    assert [(r.chapter, round(r.progress, 3)) for r in B.resolve_position(at, facts).orderBy("id").collect()] == [(0, 0.8), (1, 0.833)]
    assert [(r.chapter, r.progress) for r in B.locate_or_last(at, facts).orderBy("id").collect()] == [(0, 0.8), (1, 1.0)]


def search(spark, html, query, most=100):
    q = spark.createDataFrame([(1, query)], "query_id bigint, query string")
    return B.search(B.paragraphs(chapters(spark, [("b", 0, "a", html)])), q, most).orderBy("start").collect()


def test_search(spark):
    assert len(search(spark, "<p>aaaa</p>", "aa")) == 2
    assert search(spark, "<p>aaaa</p>", "  ") == []
    assert len(search(spark, "<p>" + "ab " * 150 + "</p>", "AB")) == 100
    hit = search(spark, "<p>One. The 𠮟 Cat, sat! Two.</p>", "cat, sat")[0]
    assert (hit.snippet, hit.snippet_start, hit.snippet_end, hit.character, hit.match_length) == ("The 𠮟 Cat, sat!", 6, 14, 7, 6)


def test_harmonic_rank(spark):
    f = spark.createDataFrame([("x", "d1", 100, "", 0), ("x", "d2", 300, "", 1), ("y", "d1", 0, "", 2)], "expression string, dict string, value bigint, display string, ord bigint")
    assert {r.expression: r["rank"] for r in L.harmonic_rank(f).collect()} == {"x": 150, "y": 9999999}


def test_align_cues_is_monotone_and_skips_ambiguous(spark):
    text = "Alpha beta gamma delta. Epsilon zeta eta theta. Alpha beta gamma delta again iota kappa."
    ch = spark.createDataFrame([("b", 0, text), ("b", 1, "Lambda mu nu xi omicron.")], "book string, chapter bigint, text string")
    cues = spark.createDataFrame([("b", 0, "Alpha beta gamma"), ("b", 1, "Epsilon zeta"), ("b", 2, "again iota"), ("b", 3, "Lambda, mu"), ("b", 4, "zeta eta theta"), ("b", 5, "short")], "book string, ord bigint, text string")
    got = [(r.ord, r.chapter, r.start) for r in A.align_cues(cues, ch).orderBy("ord").collect()]
    assert got == [(0, 0, 0), (1, 0, 19), (2, 0, 57), (3, 1, 0)]


def test_align_tokens_finds_unique_seeds(spark):
    ch = spark.createDataFrame([("b", 0, "The quick brown fox jumps over the lazy dog")], "book string, chapter bigint, text string")
    said = "the quick brown xx jumps over the lazy dog".split()
    tokens = spark.createDataFrame([("b", i, w, float(i), i + 1.0) for i, w in enumerate(said)], "book string, ord bigint, text string, start double, end double")
    got = transcript.align_tokens(tokens, ch).orderBy("at").collect()
    assert [(r.at, r.start, r.end) for r in got] == [(0, 0.0, 3.0), (15, 3.5, 9.0)]  # from the second half of xx on


def test_srt_round_trip(spark):
    m = spark.createDataFrame([("b", 1.0, 2.5, "one\n\ntwo"), ("b", 0.5, 0.5, "no length"), ("b", 0.2, 0.9, "first"), ("b", 3.0, 4.0, "  ")], "book string, start double, end double, text string")
    srt = A.encode_srt(m)
    cues = A.parse_srt(srt.select("book", F.col("srt").alias("content"))).orderBy("start").collect()
    assert [(c.id, c.start, c.end, c.text) for c in cues] == [("0", 0.2, 0.9, "first"), ("1", 1.0, 2.5, "one\ntwo")]


def test_search_is_by_characters(spark):
    """Letters whose lower case is longer keep their line, and brackets without a partner leave the snippet."""
    from readlake.operators.books import search

    lines = [("b", 0, 0, "İstanbul has a cat. Cats!", 0), ("b", 1, 0, "「One (two three」. Four", 0), ("b", 2, 0, "ΟΔΟΣ and ὁδός", 0), ("b", 3, 0, "ab)c. d\\E.", 0)]
    queries = [(1, "CAT"), (2, "two"), (3, "οδοσ"), (4, "c"), (5, "d\\e"), (6, "  "), (7, "absent")]
    got = search(spark.createDataFrame(lines, "book string, ord int, line int, text string, character bigint"), spark.createDataFrame(queries, "query_id int, query string")).collect()
    assert sorted((r.query_id, r.ord, r.start) for r in got) == [(1, 0, 15), (1, 0, 20), (2, 1, 6), (3, 2, 0), (4, 0, 15), (4, 0, 20), (4, 3, 3), (5, 3, 6)]
    snippets = {(r.query_id, r.ord, r.start): r.snippet for r in got}
    assert snippets[1, 0, 15] == "İstanbul has a cat." and snippets[2, 1, 6] == "One (two three"
    assert snippets[4, 3, 3] == "ab)c."
