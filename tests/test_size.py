"""Plans stay within memory: what is exploded is joined by shuffles, whatever its size is taken for."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from readlake.functions import text as T
from readlake.operators import alignment as A
from readlake.operators import books as B
from readlake.operators import lookup as L
from readlake.operators import reading as R
from readlake.operators import tracks as K
from readlake.operators import transcript as S
from readlake.streaming import sessions as R2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def spoken(spark, text="one two three four five six seven eight nine ten"):
    words = text.split()
    tokens = spark.createDataFrame([(1, k, w, k * 0.5, k * 0.5 + 0.5) for k, w in enumerate(words)], "book bigint, ord bigint, text string, start double, end double")
    return tokens, spark.createDataFrame([(1, 0, text)], "book bigint, chapter bigint, text string")


@pytest.mark.parametrize("of", [S.align_tokens, S.repair_gaps, S.align_transcript])
def test_characters_are_not_broadcast(spark, of):
    df = of(*spoken(spark))
    assert "BroadcastHashJoin" not in plan_of(df)


def test_places_of_a_text_are_found_in_its_row(spark):
    texts = spark.createDataFrame([(1, "a, b. (c) d"), (2, "x")], "id bigint, text string")
    hits = spark.createDataFrame([(1, 5, 1, 2), (1, 6, 3, 2), (2, 5, 0, 1), (3, 5, 0, 1)], "id bigint, hit bigint, at bigint, length bigint")
    found, cues = R.search_raw_ranges(hits, texts), R.cue_raw_ranges(hits.withColumnRenamed("hit", "cue"), texts)
    nodes = spark.createDataFrame([(1, 0, True, "a「"), (1, 1, False, "b"), (1, 2, True, "c")], "id bigint, node bigint, boundary boolean, text string")
    for df in (found, cues, R.owned_ranges(texts)):
        assert "Window" not in plan_of(df)
    assert "Join" not in plan_of(R.owned_ranges_of_nodes(nodes))
    assert sorted(map(tuple, found.collect())) == [(1, 5, 3, 8), (2, 5, 0, 1)]
    assert sorted(map(tuple, cues.collect())) == [(1, 5, 3, 9), (2, 5, 0, 1)]
    assert sorted(map(tuple, R.owned_ranges_of_nodes(nodes).collect())) == [(1, 0, 0, 1), (1, 1, 1, 3), (1, 2, 3, 4)]


def test_boundaries_are_counted_in_the_row(spark):
    chapters = spark.createDataFrame([(1, 1, "<p>one。two、、three</p>"), (1, 2, "<p>。</p>")], "book bigint, ord bigint, html string")
    df = R.cue_boundaries(chapters)
    assert "Exchange" not in plan_of(df)
    assert sorted(map(tuple, df.collect())) == [(1, 1, 2), (1, 1, 5), (1, 1, 10)]
    text = spark.createDataFrame([("ab あ.　漢",)], "text string")
    assert tuple(text.select(R.scan_boundaries(F.col("text"), ".,"), R.scan_boundaries(F.col("text"), ".,", True), R.breaks(F.col("text"))).first()) == (3, 5, 3)


def test_a_books_cues_are_gone_through_once(spark):
    """No window frame that reaches to the end of a book, which is computed anew for each of its rows."""
    cues = spark.createDataFrame([("a", k, f"line number {k}") for k in range(4)], "book string, ord bigint, text string")
    found = A.align_cues(cues, spark.createDataFrame([("a", 0, "line number 0, line number 1, line number 2")], "book string, chapter bigint, text string"))
    assert "rowframe, 1, unboundedfollowing" not in plan_of(found).lower() and found.count() == 3


def test_only_places_by_index_and_by_search():
    text = "".join(random.Random(2).choices("abc\0", k=9000))
    cues = sorted({text[k : k + n].split("\0")[0] for k in range(0, 8990, 2) for n in (1, 3, 7, 8, 9, 20)} - {""}) + ["abcabcabcabcabcx"] * 3
    assert len(text) * len(cues) > 1 << 22 > len(text)  # by index; one by one they are searched for
    assert A._only_places(text, cues) == [A._only_places(text, [c])[0] for c in cues]


def test_characters_that_count(spark):
    rows = spark.createDataFrame([("".join(map(chr, range(k, k + 4096))),) for k in [*range(0, 0xD000, 4096), 0xE000, 0xF000, *range(0x10000, 0x32000, 4096)]], "t string")
    one = F.regexp_replace("t", T.COUNTED_ONE, "")
    assert rows.where((T.counted_text(F.col("t")) != F.regexp_replace("t", f"[^{T.COUNTED}]", "")) | (one != F.regexp_replace("t", f"[{T.COUNTED}]", ""))).count() == 0


def test_stretches_share_a_task(spark):
    """Many short recordings are stitched without a group, and so a call, for each."""
    token = "array<struct<text:string,start:double,end:double>>"
    rows = [(r, float(k), k + 1.5, [("a", float(k), k + 0.5), ("b", k + 1.0, k + 1.5)] if k else [("x", 0.0, 0.5), ("a", 1.0, 1.5)]) for r in range(3) for k in range(2)]
    found = R2.stitch_batches(spark.createDataFrame(rows, f"recording bigint, segment_start double, through double, tokens {token}"))
    assert "FlatMapGroupsInPandas" not in plan_of(found)
    assert sorted(map(tuple, found.where("recording = 1").collect())) == [(1, 0, "x", 0.0, 0.5), (1, 1, "a", 1.0, 1.5), (1, 2, "b", 2.0, 2.5)]


def test_pieces_are_made_once(spark):
    pieces = R.spoken_pieces(spark.createDataFrame([("b", 0, "<p>ab<ruby>cd<rt>xyz</rt></ruby>5%</p>")], "book string, ord bigint, html string"))
    found = R.spoken_characters(pieces, with_percent=True)
    assert "Union" not in plan_of(found)
    want = [(0, "a", 0, 1), (1, "b", 1, 2), (0, "x", 2, 3), (1, "y", 2, 4), (2, "z", 3, 4), (0, "5", 4, 5), *[(1 + k, c, 4, 5) for k, c in enumerate("ぱーせんと")]]
    assert [tuple(r)[3:] for r in found.orderBy("k", "i").collect()] == want


def test_tracks_are_kept_in_pieces(spark):
    """A query of whole tracks joins pieces: no shuffle has a row for each character, and no pattern is in the plan of the last step."""
    pieces = K.spoken_pieces(spark.createDataFrame([("b", 0, "<p>ab<ruby>cd<rt>xyz</rt></ruby>5%</p>")], "book string, ord bigint, html string"))
    assert "Generate posexplode" not in plan_of(pieces) and "regexp" not in plan_of(pieces)
    found = sorted((r.track, r.p, "".join(e.c for e in r.x)) for r in pieces.collect() if r.x)
    assert found == [(0, 0, "abcd5"), (1, 0, "ab"), (1, 2, "xyz"), (1, 5, "5"), (2, 0, "abcd5ぱーせんと"), (3, 0, "ab"), (3, 2, "xyz"), (3, 5, "5ぱーせんと")]


def test_all_audio_is_numbered_in_parts(spark):
    """No limit by rank sorts what the join makes in its own task, and no window holds all rows of a question."""
    kind = "source string, expression string, reading string, file string"
    rows = [("s1", "t", "r", "b.mp3"), ("s2", "t", "r", "a.mp3"), ("s1", "t", None, "b.mp3"), ("s1", "u", "r", "c.mp3"), ("s2", "u", "r", "a.mp3"), ("s3", "t", "x", "d.ogg"), ("s3", "t", "x", "c.ogg"), ("s1", "t", "r", "b.mp3")]
    asked = spark.createDataFrame([(1, "t", "r"), (2, "t", None), (3, "u", " ")], "request_id bigint, term string, reading string")
    found = L.rank_audio(asked, spark.createDataFrame(rows, kind), spark.createDataFrame([("s2", 1), ("s1", 2)], "source string, place bigint"), every=True)
    assert "WindowGroupLimit" not in plan_of(found)
    assert not re.search(r"row_number\(\) windowspecdefinition\(term#\d+, wanted#\d+, rank#\d+ ASC", plan_of(found))
    got = sorted((r.request_id, r.n, r.source, r.file, r["rank"]) for r in found.collect())
    assert got == [(1, 1, "s2", "a.mp3", 0), (1, 2, "s1", "b.mp3", 0), (1, 3, "s1", "c.mp3", 1), (1, 4, "s3", "c.ogg", 2), (1, 5, "s3", "d.ogg", 2), (2, 1, "s2", "a.mp3", 0), (2, 2, "s1", "b.mp3", 0), (2, 3, "s3", "c.ogg", 0), (2, 4, "s3", "d.ogg", 0), (3, 1, "s2", "a.mp3", 0), (3, 2, "s1", "c.mp3", 0)]


def test_runs_are_sorted_once(spark):
    timed = spark.createDataFrame([(1, k, float(k), k + 1.0) for k in (0, 1, 2, 5, 9)], "book bigint, at bigint, start double, end double")
    cues = spark.createDataFrame([(1, 0, 0, 20)], "book bigint, chapter bigint, cue_low bigint, cue_high bigint")
    found = S.cut_cues(timed, cues, timed)
    assert not re.search(r"Sort \[[^\]]*run#\d+L? ASC NULLS FIRST\]", plan_of(found))
    assert sorted(map(tuple, found.collect())) == [(1, 0, 0, 3, 0.0, 3.0), (1, 0, 5, 1, 5.0, 6.0), (1, 0, 9, 1, 9.0, 10.0)]


def test_sentences_are_found_in_steps(spark):
    """A sentence begins behind the carriage return right before its hit, and a long line without a sentence end is gone through once."""
    rows = spark.createDataFrame([("abc\rneedle here. x", 4, 10), ("a. b (c needle d) e! f", 8, 14), ("ab " * 60000 + "needle", 180000, 180006)], "text string, start int, end int")
    found = B.with_sentences(rows)
    assert [(r.text[r["first"] : r["last"]] if r.start < 100 else (r["first"], r["last"])) for r in found.orderBy("start").collect()] == ["needle here.", "b (c needle d) e!", (0, 180006)]


def test_grams_are_told_by_marks(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("abcdefgh", k=200)) for _ in range(50)]
    for size in B.GRAMS:
        some = np.unique(B.gram_hashes(texts[:3], size)[0])
        all_ = B.gram_hashes(texts, size)[0]
        near = B.marked(some)[B.places(all_)]
        assert near[np.isin(all_, some)].all() and (size < 8 or near.sum() < 1.1 * np.isin(all_, some).sum())
        rows = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
        got = sorted(map(tuple, B.gram_rows(rows, "k", "t", size, some).collect()))
        assert got == sorted({(k, int(g)) for k, t in enumerate(texts) for g in B.gram_hashes([t], size)[0] if g in some})


def test_marks_are_told_on_arrays_of_characters(spark):
    """No pattern goes through a text from each place where a mark might begin, whatever the text; slices of several texts are gone through at once."""
    plain = lambda x: re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), x)
    counted, o, t, h, white = plain(T.COUNTED), *map(re.escape, (R.OPENS, R.TRAILS, R.HANGS)), plain(R.WHITE)
    unit = re.compile(rf"(?:(?<![^{white}])[{o}{h}]+|[{o}][{o}{h}]*)?[{counted}][{t}{h}]*")
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab漢𠮟「（\"。、」…— \u3000\n\x0b&゛", k=rng.randrange(30))) for _ in range(3000)]
    want = sorted((k, i, m.start(), m.end()) for k, x in enumerate(texts) for i, m in enumerate(unit.finditer(x)))
    rows = spark.createDataFrame([*enumerate(texts), (-1, None)], "id bigint, text string")
    found = R.owned_ranges(rows)
    assert sorted(map(tuple, found.collect())) == want
    asked = spark.createDataFrame([(k, f"c{k}", k % 4, k % 5 + 1) for k in range(-1, 3001)], "id bigint, cue string, at bigint, length bigint")
    cues = R.cue_raw_ranges(asked, rows)
    ends = {x[:2]: x[2:] for x in want}
    assert sorted(map(tuple, cues.collect())) == [(k, f"c{k}", ends[k, k % 4][0], ends[k, k % 4 + k % 5][1]) for k in range(3000) if (k, k % 4 + k % 5) in ends]
    for df in (found, cues):
        assert "regexp" not in plan_of(df)
    assert all(x == bool(re.match(f"[{counted}]", chr(c))) for c, x in enumerate(T.in_class(T.COUNTED)[:0x33000].tolist()))


def test_tracks_are_made_in_the_row(spark):
    """A chapter's tracks are neither shuffled nor written on the way, and say what their characters stand for."""
    chapters = spark.createDataFrame([("b", 0, "<p>ab<ruby>cd<rt>xyz</rt></ruby>5%</p>"), ("b", 1, None)], "book string, ord bigint, html string")
    found, digests = K.spoken_lines(chapters.withColumn("base", F.lit(10))), K.track_digests(chapters)
    for df in (found, digests):
        assert "Exchange" not in plan_of(df) and "staged" not in plan_of(df)
    own = [*range(4), *[4] * 6]
    read = [(0, 1), (1, 2), (2, 3), (2, 4), (3, 4), *[(4, 5)] * 6]
    spans = {0: [(k, k + 1) for k in range(5)], 1: read[:6], 2: [(k, k + 1) for k in own], 3: read}
    text = {0: "abcd5", 1: "abxyz5", 2: "abcd5ぱーせんと", 3: "abxyz5ぱーせんと"}
    assert sorted((r.track, r.variant_of, r.text, list(zip(r.start, r.end))) for r in found.collect() if r.ord == 0) == [(k, k - 2 if k > 1 else None, text[k], [(a + 10, b + 10) for a, b in spans[k]]) for k in range(4)]
    want = {k: hashlib.md5(",".join(f"{a}-{b}" for a, b in x).encode()).hexdigest() for k, x in spans.items()}
    assert {r.track: r.spans_md5 for r in digests.collect()} == want and {r.n for r in digests.collect()} == {5, 6, 10, 11}


def test_pieces_and_their_characters_are_made_in_the_row(spark):
    """No shuffle of pieces, no window over a chapter; a sign behind a piece, markup in what is decoded, and marks that stand apart."""
    html = ["<p>か-゙<ruby>漢字<rt>カンジ％</rt></ruby>%。 &lt;b&gt;x5％<ruby>y<rt></rt></ruby></p>", "", None, "%<ruby 5% "]
    pieces = R.spoken_pieces(spark.createDataFrame([("b", k, x) for k, x in enumerate(html)], "book string, ord bigint, html string"))
    found = R.spoken_characters(pieces, with_percent=True)
    assert "Window" not in plan_of(found) and "Exchange" not in plan_of(found)
    want = [(0, 1, 0, 1, "が", False), (0, 2, 1, 2, "かんじ", True), (0, 3, 3, 3, "x5", True), (0, 4, 6, 1, "y", False), (3, 1, 0, 5, "ruby5", True)]
    assert sorted(tuple(r)[1:] for r in pieces.collect()) == want
    rows = sorted((r.ord, r.k, r.i, r.spoken, r.start, r.end) for r in found.collect())
    assert [x[2:] for x in rows if x[:2] == (0, 2)] == [(0, "か", 1, 2), (1, "ん", 1, 3), (2, "じ", 2, 3), *[(3 + k, c, 2, 3) for k, c in enumerate("ぱーせんと")]]
