"""Queries of the reading family (cue boundaries, spoken text, raw ranges, furigana, card lists and defaults) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.functions import text as T
from readlake.operators import reading as P
from readlake.operators import tracks as K
from readlake.plans.fixtures import table

QUERIES, ORACLES = {}, {}
COUNTED = T.COUNTED


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def marked_chapters(spark, sf_dir) -> DataFrame:
    """Documents as chapters: words in -ion with a reading, some percent signs, Japanese sentence marks."""
    plain = F.translate("text", "<>&%.,", "   %。、")
    ruby = F.regexp_replace(F.regexp_replace(plain, "([A-Za-z]+)ion", "<ruby>$1ion<rt>Yon$1</rt></ruby>"), "(ed|te) ", "$1% ")
    return table(spark, sf_dir, "documents").select(F.coalesce(F.col("source"), F.lit("none")).alias("book"), F.col("doc_id").alias("ord"), F.concat(F.lit("<html><body><p>"), ruby, F.lit("</p></body></html>")).alias("html"))


MARKED = r"""WITH c AS (SELECT coalesce(source, 'none') AS book, doc_id AS ord, regexp_replace(regexp_replace(translate(text, '<>&%.,', '   %。、'), '([A-Za-z]+)ion', '<ruby>\1ion<rt>Yon\1</rt></ruby>', 'g'), '(ed|te) ', '\1% ', 'g') AS html FROM documents WHERE text IS NOT NULL)"""


@query(MARKED + rf""", v AS (SELECT book, ord, regexp_replace(regexp_replace(html, '<rt>.*?</rt>', '', 'g'), '<[^>]*>', '', 'g') || chr(10) AS visible FROM c),
    ch AS (SELECT book, ord, unnest(range(len(xs))) AS i, unnest(xs) AS x FROM (SELECT *, string_split(visible, '') AS xs FROM v)),
    n AS (SELECT *, sum(CASE WHEN regexp_matches(x, '[{COUNTED}]') THEN 1 ELSE 0 END) OVER (PARTITION BY book, ord ORDER BY i) AS n FROM ch)
    SELECT DISTINCT book, ord, CAST(n - 1 AS BIGINT) AS "at" FROM n WHERE n > 0 AND contains('。！？!?…」』「『（、，,' || chr(10), x)""")
def t6_cue_boundaries(spark, sf_dir):
    return P.cue_boundaries(marked_chapters(spark, sf_dir))


_PIECES = MARKED + rf""", a AS (SELECT book, ord, unnest(range(len(xs))) AS a, unnest(xs) AS piece FROM (SELECT *, string_split(regexp_replace(html, '(<ruby>.*?</ruby>)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS xs FROM c)),
    b AS (SELECT book, ord, a, unnest(range(len(xs))) AS b, unnest(xs) AS piece FROM (SELECT *, string_split(replace(piece, '%', '%' || chr(1)), chr(1)) AS xs FROM a)),
    s AS (SELECT *, length(regexp_replace(regexp_replace(regexp_replace(piece, '<rt>.*?</rt>', '', 'g'), '<[^>]*>', '', 'g'), '[^{COUNTED}]', '', 'g')) AS base,
        lower(regexp_replace(CASE WHEN piece LIKE '<ruby%' THEN regexp_extract(piece, '<rt>(.*?)</rt>', 1) ELSE piece END, '[^{COUNTED}]', '', 'g')) AS spoken FROM b),
    o AS (SELECT *, CAST(sum(base) OVER w - base AS BIGINT) AS start, sum(CASE WHEN base > 0 THEN 1 ELSE 0 END) OVER w AS own FROM s WINDOW w AS (PARTITION BY book, ord ORDER BY a, b)),
    p AS (SELECT *, bool_or(regexp_matches(piece, '%\s*$')) OVER (PARTITION BY book, ord, own) AS percent FROM o),
    pieces AS (SELECT book, ord, row_number() OVER (PARTITION BY book, ord ORDER BY a, b) AS k, start, base, spoken, percent FROM p WHERE base > 0)"""


@query(_PIECES + " SELECT * FROM pieces")
def t5_spoken_pieces(spark, sf_dir):
    return P.spoken_pieces(marked_chapters(spark, sf_dir))


@query(_PIECES + """, own AS (SELECT book, ord, k, unnest(range(length(spoken))) AS i, unnest(string_split(spoken, '')) AS spoken, start AS s, base, length(spoken) AS n FROM pieces WHERE spoken != '')
    SELECT book, ord, k, i, spoken, s + i * base // n AS start, s + CAST(ceil((i + 1) * base / n) AS BIGINT) AS "end" FROM own
    UNION ALL SELECT book, ord, k, length(spoken) + i, 'ぱーせんと'[i + 1], start + base - 1, start + base FROM pieces, range(5) r(i) WHERE percent""")
def t5_spoken_characters(spark, sf_dir):
    return P.spoken_characters(P.spoken_pieces(marked_chapters(spark, sf_dir)), with_percent=True)


def broken_chapters(spark, sf_dir) -> DataFrame:
    """marked_chapters, every seventh with a ruby element inside a fallback, whose parts do not add up to the visible text."""
    extra = F.when(F.col("ord") % 7 == 0, "<rp><ruby>extra<rt>said</rt></ruby></rp></p>").otherwise("</p>")
    return marked_chapters(spark, sf_dir).withColumn("html", F.replace(F.col("html"), F.lit("</p>"), extra))


@query(MARKED + rf""", h AS (SELECT book, ord, html || CASE WHEN ord % 7 = 0 THEN '<rp><ruby>extra<rt>said</rt></ruby></rp>' ELSE '' END AS html, ord % 7 != 0 AND contains(html, '<ruby>') AS read FROM c),
    v AS (SELECT book, ord, read, regexp_replace(regexp_replace(html, '<rp>.*?</rp>|<rt>.*?</rt>', '', 'g'), '<[^>]*>', '', 'g') AS visible FROM h),
    ch AS (SELECT book, ord, read, unnest(range(len(xs))) AS i, unnest(xs) AS x FROM (SELECT *, string_split(visible, '') AS xs FROM v)),
    n AS (SELECT *, regexp_matches(x, '[{COUNTED}]') AS counted, CAST(sum(CASE WHEN regexp_matches(x, '[{COUNTED}]') THEN 1 ELSE 0 END) OVER (PARTITION BY book, ord ORDER BY i) AS BIGINT) AS n FROM ch),
    signs AS (SELECT DISTINCT book, ord, n AS "end" FROM n WHERE x = '%' AND n > 0),
    plain AS (SELECT book, ord, read, 0 AS track, n AS k, 0::BIGINT AS i, lower(x) AS c, n - 1 AS start, n AS "end" FROM n WHERE counted),
    a AS (SELECT book, ord, unnest(range(len(xs))) AS k, unnest(xs) AS piece FROM (SELECT *, string_split(regexp_replace(html, '(<ruby>.*?</ruby>)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS xs FROM h WHERE read)),
    s AS (SELECT *, length(regexp_replace(regexp_replace(regexp_replace(piece, '<rt>.*?</rt>', '', 'g'), '<[^>]*>', '', 'g'), '[^{COUNTED}]', '', 'g')) AS base,
        lower(regexp_replace(CASE WHEN piece LIKE '<ruby%' THEN regexp_extract(piece, '<rt>(.*?)</rt>', 1) ELSE piece END, '[^{COUNTED}]', '', 'g')) AS said FROM a),
    o AS (SELECT *, CAST(sum(base) OVER (PARTITION BY book, ord ORDER BY k) - base AS BIGINT) AS s FROM s),
    own AS (SELECT *, unnest(range(length(said))) AS i, unnest(string_split(said, '')) AS c, length(said) AS m FROM o WHERE base > 0),
    base AS (SELECT * FROM plain UNION ALL SELECT book, ord, true, 1, k, i, c, s + i * base // m, s + CAST(ceil((i + 1) * base / m) AS BIGINT) FROM own),
    after AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY book, ord, track ORDER BY k, i) >= "end", true) AS free FROM base),
    variants AS (SELECT b.book, b.ord, b.read, b.track, b.k, b.i, -1 AS j, b.c, b.start, b."end" FROM after b WHERE EXISTS (SELECT 1 FROM signs g WHERE g.book = b.book AND g.ord = b.ord)
        UNION ALL SELECT b.book, b.ord, b.read, b.track, b.k, b.i, j, 'ぱーせんと'[j + 1], "end" - 1, "end" FROM after b JOIN signs g USING (book, ord, "end"), range(5) r(j) WHERE free),
    lines AS (SELECT book, ord, track, CAST(NULL AS INTEGER) AS variant_of, k, i, -1 AS j, c, start, "end" FROM base UNION ALL SELECT book, ord, track + 1 + read::INTEGER, track, k, i, j, c, start, "end" FROM variants)
    SELECT book, ord, track, variant_of, count(*) AS n, string_agg(c, '' ORDER BY k, i, j) AS text, md5(string_agg(start || '-' || "end", ',' ORDER BY k, i, j)) AS spans_md5 FROM lines GROUP BY book, ord, track, variant_of""")
def t5_spoken_tracks(spark, sf_dir):
    """A row for each track of a chapter: its text, and a digest of the source characters of each of its own."""
    return K.track_digests(broken_chapters(spark, sf_dir))


#: White space in the SQL's pattern language.
_WHITE = r"\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: Ranges of the characters of t (id, text).
_OWNED = rf"""ch AS (SELECT id, unnest(range(len(xs))) AS pos, unnest(xs) AS x FROM (SELECT id, string_split(text, '') AS xs FROM t)),
    n AS (SELECT id, pos, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS i, coalesce(lag(pos) OVER (PARTITION BY id ORDER BY pos), -1) AS before, lead(pos) OVER (PARTITION BY id ORDER BY pos) AS next FROM ch WHERE regexp_matches(x, '[{COUNTED}]')),
    g AS (SELECT n.*, CASE WHEN before < 0 THEN ' ' ELSE '' END || substring(text, before + 2, pos - before - 1) AS gap, substring(text, pos + 2, coalesce(next, length(text)) - pos - 1) AS rest FROM n JOIN t USING (id)),
    f AS (SELECT *, regexp_extract(gap, '(?:[{_WHITE}][「『（〔［｛〈《【〖〘〚“‘｢(\[{{…‥—―–─〜～]+|[「『（〔［｛〈《【〖〘〚“‘｢(\[{{][「『（〔［｛〈《【〖〘〚“‘｢(\[{{…‥—―–─〜～]*)$') AS pre,
        regexp_extract(rest, '^[」』）〕］｝〉》】〗〙〛”’｣)\]}}。、，．！？!?‼⁇⁈⁉､｡・･：；:;…‥—―–─〜～]*') AS post FROM g)"""
_OWNED_ROWS = rf"""SELECT id, i, pos - CASE WHEN regexp_matches(pre, '^[{_WHITE}]') THEN length(pre) - 1 ELSE length(pre) END AS start, pos + 1 + length(post) AS "end" FROM f"""


def indented(text):
    """Punctuation of another script, and marks after white space that is not ASCII."""
    text = F.translate(text, ",.;:()-", "、…「—（）〜")
    return F.replace(F.replace(text, F.lit(" d"), F.lit("\u3000…d")), F.lit(" e"), F.lit("\xa0—e"))


_INDENTED = "replace(replace(translate(text, ',.;:()-', '、…「—（）〜'), ' d', chr(12288) || '…d'), ' e', chr(160) || '—e')"


@query(f"WITH t AS (SELECT doc_id AS id, {_INDENTED} AS text FROM documents WHERE text IS NOT NULL), " + _OWNED + " " + _OWNED_ROWS)
def t9_owned_ranges(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), indented(F.col("text")).alias("text"))
    return P.owned_ranges(d)


_NODES = f"""WITH s AS (SELECT conv_id, turn, turn // 3 AS section, {_INDENTED} || CASE turn % 3 WHEN 1 THEN '「' WHEN 2 THEN '…' ELSE '' END AS text FROM conversations WHERE text IS NOT NULL),
    j AS (SELECT conv_id, section, string_agg(text, '' ORDER BY turn) AS text FROM s GROUP BY 1, 2),
    base AS (SELECT *, conv_id * 1000 + section AS id, coalesce(sum(length(text)) OVER w, 0) AS base FROM j WINDOW w AS (PARTITION BY conv_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT id, text FROM base), """


@query(_NODES + _OWNED + ", own AS (" + _OWNED_ROWS + """) SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY section, i) - 1 AS i, CAST(base + start AS BIGINT) AS start, CAST(base + "end" AS BIGINT) AS "end" FROM own JOIN base USING (id)""")
def t9_node_ranges(spark, sf_dir):
    """Turns are text nodes, with a boundary before every third; some end in a mark that goes with the next node."""
    return P.owned_ranges_of_nodes(turns_as_nodes(spark, sf_dir))


def turns_as_nodes(spark, sf_dir) -> DataFrame:
    mark = F.when(F.col("turn") % 3 == 1, "「").when(F.col("turn") % 3 == 2, "…").otherwise("")
    return table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("id"), F.col("turn").alias("node"), (F.col("turn") % 3 == 0).alias("boundary"), F.concat(indented(F.col("text")), mark).alias("text"))


def spans(spark, sf_dir) -> DataFrame:
    """A stretch of counted characters of each document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 9).alias("cue"), (F.col("doc_id") % 40).alias("at"), (F.col("doc_id") % 30 + 1).alias("length"))


_SPANS = f"WITH t AS (SELECT doc_id AS id, {_INDENTED} AS text FROM documents WHERE text IS NOT NULL), d AS (SELECT doc_id AS id, doc_id % 9 AS cue, doc_id % 40 AS at_, doc_id % 30 + 1 AS n FROM documents), "


@query(_SPANS + _OWNED + ", own AS (" + _OWNED_ROWS + """) SELECT id, cue, a.start, b."end" FROM d JOIN own a USING (id) JOIN own b USING (id) WHERE a.i = at_ AND b.i = at_ + n - 1""")
def t9_cue_raw_ranges(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), indented(F.col("text")).alias("text"))
    return P.cue_raw_ranges(spans(spark, sf_dir), d)


@query(_SPANS + _OWNED + """ SELECT id, cue AS hit, a.pos AS start, b.pos + 1 AS "end" FROM d JOIN n a USING (id) JOIN n b USING (id) WHERE a.i = at_ AND b.i = at_ + n - 1""".replace("+ n - 1", "+ d.n - 1"))
def t9_search_ranges(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), indented(F.col("text")).alias("text"))
    return P.search_raw_ranges(spans(spark, sf_dir).withColumnRenamed("cue", "hit"), d)


@query(r"""WITH ch AS (SELECT doc_id AS id, unnest(range(len(xs))) AS i, unnest(xs) AS x FROM (SELECT doc_id, string_split(translate(text, 'aeiou-', 'あイう漢Ａー'), '') AS xs FROM documents WHERE text IS NOT NULL))
    SELECT id, count(*) FILTER (regexp_matches(x, '[\s\x0b\x{3000}\x{a0}]') OR contains('.,', x)) AS ends, count(*) FILTER (regexp_matches(x, '[\s\x0b\x{3000}\x{a0}]') OR contains('.,', x) OR NOT regexp_matches(x, '[\x{3040}-\x{30FF}\x{FF66}-\x{FF9D}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3005}-\x{3007}]')) AS foreign_ends,
    count(*) FILTER (regexp_matches(x, '[\x{3000}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]')) AS breaks FROM ch WHERE x != '' GROUP BY id""".replace("\\\\", "\\"))
def t10_scan_boundaries(spark, sf_dir):
    """How many characters of each document end a scan, of Japanese or of any text, and how many may begin a line."""
    d = table(spark, sf_dir, "documents").where("text != ''").select(F.col("doc_id").alias("id"), F.translate("text", "aeiou-", "あイう漢Ａー").alias("text"))
    n = d.select("id", P.scan_boundaries(F.col("text"), ".,").alias("a"), P.scan_boundaries(F.col("text"), ".,", True).alias("b"), P.breaks(F.col("text")).alias("k"))
    return n.groupBy("id").agg(F.sum("a").alias("ends"), F.sum("b").alias("foreign_ends"), F.sum("k").alias("breaks"))


@query(r"""WITH t AS (SELECT turn + conv_id * 1000 AS id, regexp_replace(text, 'e(n|s)', 'e''\1', 'g') || ' (x)-y z''' AS text FROM conversations WHERE text IS NOT NULL),
    ch AS (SELECT id, unnest(range(len(xs))) AS i, unnest(xs) AS x FROM (SELECT id, string_split(text, '') AS xs FROM t)),
    m AS (SELECT *, coalesce(regexp_matches(lag(x) OVER (PARTITION BY id ORDER BY i), '[A-Za-z0-9]') AND regexp_matches(lead(x) OVER (PARTITION BY id ORDER BY i), '[A-Za-z0-9]'), false) AS inside FROM ch),
    b AS (SELECT *, regexp_matches(x, '[\s　]') OR contains('().', x) OR (contains('"“”„‟''‘’‚‛«»‹›!?—–-‐‑‒/\|@#$%^&*_+=~`<>', x) AND NOT (contains('''’`-‐‑', x) AND inside)) AS stop FROM m),
    g AS (SELECT *, sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS word FROM b)
    SELECT id, word, md5(string_agg(x, '' ORDER BY i)) AS text FROM g WHERE NOT stop GROUP BY id, word""".replace("SELECT id, word, md5", "SELECT id, row_number() OVER (PARTITION BY id ORDER BY word) - 1 AS word, md5"))
def t10_english_words(spark, sf_dir):
    text = F.concat(F.regexp_replace("text", "e(n|s)", "e'$1"), F.lit(" (x)-y z'"))
    c = table(spark, sf_dir, "conversations").select((F.col("turn") + F.col("conv_id") * 1000).alias("id"), F.posexplode(P.english_words(text, "().")).alias("word", "text"))
    return c.select("id", F.col("word").cast("bigint").alias("word"), F.md5(F.col("text").cast("binary")).alias("text"))


@query()
def t11_furigana(spark, sf_dir):
    """Names of parts in made-up kanji and kana, with readings that spell every kanji as two kana."""
    p = table(spark, sf_dir, "part").select(F.translate(F.regexp_replace("p_name", "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "山きく川さし水たち木なに日はひ月まみ火やゆ土らり人わ").alias("expression"))
    reading = F.col("expression")
    for k, r in zip("山川水木日月火土人", ("やま", "かわ", "みず", "きき", "にち", "つき", "ひひ", "つち", "ひと")):
        reading = F.replace(reading, F.lit(k), F.lit(r))
    return P.furigana_segments(p.withColumn("reading", reading))


@query("""WITH f AS (SELECT p_size AS k, p_brand AS dict, list({v: p_partkey, d: CASE WHEN p_partkey % 3 = 0 THEN p_partkey || '位' END} ORDER BY p_partkey) AS fs FROM part GROUP BY 1, 2),
    l AS (SELECT k, '<ul style="text-align: left;">' || string_agg(array_to_string(list_transform(fs, lambda f: '<li>' || dict || ': ' || coalesce(f.d, CAST(f.v AS VARCHAR)) || '</li>'), ''), '' ORDER BY dict) || '</ul>' AS frequencies FROM f GROUP BY k),
    t AS (SELECT p_size AS k, string_agg('<li><span style="display:inline;"><span>[</span><span>' || p_partkey % 7 || '</span><span>]</span></span></li>', '' ORDER BY p_partkey) AS ps,
        string_agg(CASE WHEN p_partkey % 4 > 0 THEN '<li class="pronunciation" data-pronunciation-type="phonetic-transcription">' || replace(p_name, ' ', ' &lt;&amp;&#39;') || '</li>' END, '' ORDER BY p_partkey) AS ts FROM part GROUP BY 1)
    SELECT k, md5(frequencies) AS frequencies, md5('<ol>' || ps || '</ol>') AS positions, md5(CASE WHEN ts IS NULL THEN '' ELSE '<ul>' || ts || '</ul>' END) AS transcriptions FROM l JOIN t USING (k)""")
def t13_card_lists(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    one = F.struct("p_partkey", F.col("p_partkey").alias("value"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_partkey").cast("string"), F.lit("位"))).alias("display"))
    groups = p.groupBy("p_size", "p_brand").agg(F.array_sort(F.collect_list(one)).alias("fs"))
    groups = groups.groupBy("p_size").agg(F.array_sort(F.collect_list(F.struct(F.col("p_brand").alias("dictionary"), F.transform("fs", lambda f: F.struct(f["value"].alias("value"), f["display"].alias("display"))).alias("frequencies")))).alias("g"))
    rows = p.groupBy("p_size").agg(F.array_sort(F.collect_list(F.struct("p_partkey", (F.col("p_partkey") % 7).alias("p"), F.when(F.col("p_partkey") % 4 > 0, F.replace("p_name", F.lit(" "), F.lit(" <&'"))).alias("t")))).alias("x"))
    out = groups.join(rows, "p_size")
    h = lambda c: F.md5(c.cast("binary"))
    return out.select(F.col("p_size").alias("k"), h(P.frequency_list(F.col("g"))).alias("frequencies"), h(P.position_list(F.transform("x", lambda e: e["p"]))).alias("positions"), h(P.transcription_list(F.transform("x", lambda e: e["t"]))).alias("transcriptions"))


@query("""WITH n AS (SELECT o_custkey AS note_type, 'model ' || o_custkey % 5 AS name, 'f' || o_orderkey % 6 AS field FROM orders GROUP BY ALL), t AS (SELECT 'model ' || p_size % 4 AS name, 'f' || p_partkey % 7 AS field, min('{' || p_brand || '}') AS template FROM part GROUP BY 1, 2),
    m AS (SELECT c_custkey AS note_type, 'f' || c_custkey % 9 AS field, 'own' AS template FROM customer WHERE c_custkey % 3 = 0),
    own AS (SELECT DISTINCT note_type FROM n JOIN m USING (note_type, field)), fresh AS (SELECT DISTINCT note_type FROM n WHERE name IN (SELECT name FROM t) AND note_type NOT IN (SELECT note_type FROM own))
    SELECT note_type, field, template FROM m WHERE note_type NOT IN (SELECT note_type FROM fresh) UNION ALL SELECT n.note_type, n.field, t.template FROM n JOIN t USING (name, field) WHERE n.note_type IN (SELECT note_type FROM fresh)""")
def t22_default_mappings(spark, sf_dir):
    text = lambda a, c, k: F.concat(F.lit(a), (F.col(c) % k).cast("string"))
    n = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("note_type"), text("model ", "o_custkey", 5).alias("name"), text("f", "o_orderkey", 6).alias("field")).distinct()
    t = table(spark, sf_dir, "part").groupBy(text("model ", "p_size", 4).alias("name"), text("f", "p_partkey", 7).alias("field")).agg(F.min(F.concat(F.lit("{"), "p_brand", F.lit("}"))).alias("template"))
    m = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("note_type"), text("f", "c_custkey", 9).alias("field"), F.lit("own").alias("template"))
    return P.default_mappings(n, t, m)


@query("""WITH d AS (SELECT s_nationkey AS u, s_suppkey AS deck, CASE WHEN s_suppkey % 4 = 0 THEN 'DEFAULT' ELSE 'deck ' || s_suppkey % 7 END AS name FROM supplier), w AS (SELECT n_nationkey AS u, n_nationkey * 3 AS deck_id, CASE WHEN n_nationkey % 3 > 0 THEN 'deck ' || n_nationkey % 9 END AS deck_name FROM nation)
    SELECT u AS user, deck FROM d LEFT JOIN w USING (u) QUALIFY row_number() OVER (PARTITION BY u ORDER BY CASE WHEN deck = deck_id THEN 0 WHEN name = deck_name THEN 1 WHEN lower(name) != 'default' THEN 2 ELSE 3 END, deck) = 1""")
def t22_chosen_deck(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("user"), F.col("s_suppkey").alias("ord"), F.col("s_suppkey").alias("deck"), F.when(F.col("s_suppkey") % 4 == 0, "DEFAULT").otherwise(F.concat(F.lit("deck "), (F.col("s_suppkey") % 7).cast("string"))).alias("name"))
    w = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("user"), (F.col("n_nationkey") * 3).alias("deck_id"), F.when(F.col("n_nationkey") % 3 > 0, F.concat(F.lit("deck "), (F.col("n_nationkey") % 9).cast("string"))).alias("deck_name"))
    return P.chosen_deck(d, w)


@query("""SELECT l_orderkey AS book, CASE WHEN bool_and(l_linenumber != 5 OR l_partkey % 2 = 0) THEN 'transcription' ELSE 'subtitles' END AS source FROM lineitem GROUP BY l_orderkey""")
def t33_match_source(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    made = F.concat_ws("-", "l_linenumber", "l_suppkey")
    return P.match_source(l.select(F.col("l_orderkey").alias("book"), F.when((F.col("l_linenumber") == 5) & (F.col("l_partkey") % 2 == 1), F.lit("5")).otherwise(made).alias("id"), F.col("l_linenumber").alias("chapter"), F.col("l_suppkey").alias("start")))
