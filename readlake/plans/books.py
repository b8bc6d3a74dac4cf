"""Queries of the books family and their SQL.  Books are the hosts of pages (HTML) or (source, lang) of documents (text)."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.functions import text as T
from readlake.operators import books as B
from readlake.plans.fixtures import table

QUERIES, ORACLES = {}, {}
HOST = "regexp_extract(url, '//([^/]+)', 1)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def chapters(spark, sf_dir) -> DataFrame:
    """Pages as chapters: each host a book, in order of page_id."""
    p = table(spark, sf_dir, "pages")
    href = F.concat(F.lit("text/p"), F.col("page_id").cast("string"), F.lit(".xhtml"))
    return p.select(F.expr(HOST).alias("book"), F.col("page_id").alias("ord"), href.alias("href"), "html", (F.col("page_id") % 9 != 0).alias("linear"), (F.col("page_id") % 10 == 3).alias("is_guide_toc"), F.when(F.col("page_id") % 11 == 0, "svg NAV").alias("properties"))


def toc(spark, sf_dir) -> DataFrame:
    """Every third page has a contents entry with its title."""
    p = table(spark, sf_dir, "pages").where("page_id % 3 = 0")
    return p.select(F.expr(HOST).alias("book"), F.col("page_id").alias("ord"), F.concat(F.lit("Section "), F.col("page_id").cast("string")).alias("top_label"), F.concat(F.lit("/text/p"), F.col("page_id").cast("string"), F.lit(".xhtml#a")).alias("href"))


_COUNTED = T.COUNTED
#: The same text rules in SQL, with alternatives where Java has back references.
CTE = rf"""WITH raw AS (SELECT {HOST} AS book, page_id AS ord, html, CASE WHEN regexp_matches(html, '(?s)<body.*?</body>') THEN regexp_extract(html, '(?s)<body.*?</body>') ELSE html END AS b FROM pages),
r1 AS (SELECT *, regexp_replace(regexp_replace(b, '(?s)<rt[^>]*>.*?</rt>|<rp[^>]*>.*?</rp>', '', 'g'), '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g') AS c FROM raw),
vis AS (SELECT book, ord, replace(replace(replace(replace(regexp_replace(regexp_replace(c, '<[^>]+>', '', 'g'), '&#[xX]?[0-9A-Fa-f]+;', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') AS visible FROM r1),
par AS (SELECT book, ord, replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(c, '(?i)<br[^>]*>|</(?:p|div|h[1-6]|li|blockquote|section|td|tr)\s*>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&#[xX]?[0-9A-Fa-f]+;', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') AS visible FROM r1),
facts AS (SELECT book, ord, count, CAST(coalesce(sum(count) OVER (PARTITION BY book ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(count) OVER (PARTITION BY book) AS BIGINT) AS total
    FROM (SELECT book, ord, length(regexp_replace(visible, '[^{_COUNTED}]', '', 'g')) AS count FROM vis)),
pos AS (SELECT {HOST} AS book, page_id AS id, page_id * 37 % 40000 AS character FROM pages),
labels AS (SELECT f.book, f.ord, CASE WHEN f.ord % 3 = 0 THEN 'Section ' || f.ord END AS label FROM facts f)
"""


@query(CTE + "SELECT book, ord, md5(visible) AS visible, length(visible) AS n FROM vis")
def t1_visible_text(spark, sf_dir):
    v = T.visible_text(F.col("html"))
    return chapters(spark, sf_dir).select("book", "ord", F.md5(v.cast("binary")).alias("visible"), F.length(v).cast("bigint").alias("n"))


@query(CTE + f"SELECT book, ord, md5(regexp_replace(visible, '[^{_COUNTED}]', '', 'g')) AS counted FROM vis")
def t2_matchable_text(spark, sf_dir):
    return chapters(spark, sf_dir).select("book", "ord", F.md5(T.matchable_text(F.col("html")).cast("binary")).alias("counted"))


@query(CTE + "SELECT book, ord, count, start, total FROM facts")
def a12_book_facts(spark, sf_dir):
    return B.book_facts(chapters(spark, sf_dir)).select("book", "ord", "count", "start", "total")


@query(CTE + ", bad AS (SELECT book, ord, count, CASE WHEN ord % 97 = 0 THEN start + 1 ELSE start END AS start, total FROM facts) SELECT book, bool_and(ok) AND max(start + count) = max(total) AS valid FROM (SELECT *, start = coalesce(lag(start + count) OVER (PARTITION BY book ORDER BY ord), 0) AND count >= 0 AS ok FROM bad) GROUP BY book")
def a13_facts_valid(spark, sf_dir):
    facts = B.book_facts(chapters(spark, sf_dir)).withColumn("start", F.when(F.col("ord") % 97 == 0, F.col("start") + 1).otherwise(F.col("start")))
    return B.facts_valid(facts)


@query("SELECT " + HOST + " AS book, page_id AS ord FROM pages WHERE page_id % 9 != 0 AND page_id % 10 != 3 AND page_id % 11 != 0 AND NOT regexp_matches(lower('text/p' || page_id || '.xhtml'), 'toc|caution|colophon')")
def f4_narrative_chapters(spark, sf_dir):
    return B.narrative_chapters(chapters(spark, sf_dir)).select("book", "ord")


def positions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.expr(HOST).alias("book"), F.col("page_id").alias("id"), (F.col("page_id") * 37 % 40000).alias("character"))


@query(CTE + """SELECT p.book, id, character, ord AS chapter, round((greatest(0, least(character, total - 1)) - start) / count, 6) AS progress FROM pos p JOIN facts f ON p.book = f.book AND f.count > 0
    AND greatest(0, least(character, total - 1)) >= start AND greatest(0, least(character, total - 1)) < start + count""")
def j4_resolve_position(spark, sf_dir):
    return B.resolve_position(positions(spark, sf_dir), B.book_facts(chapters(spark, sf_dir))).select("book", "id", "character", "chapter", F.round("progress", 6).alias("progress"))


_LAST = """, located AS (SELECT p.book, id, character, coalesce(f.ord, l.ord) AS chapter, CASE WHEN coalesce(f.count, l.count) > 0 THEN round(least(greatest((character - coalesce(f.start, l.start)) / coalesce(f.count, l.count), 0.0), 1.0), 6) ELSE 0.0 END AS progress
    FROM pos p LEFT JOIN facts f ON p.book = f.book AND f.count > 0 AND character >= f.start AND character < f.start + f.count JOIN (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY book ORDER BY ord DESC) = 1) l ON l.book = p.book)"""


@query(CTE + _LAST + "SELECT * FROM located")
def j5_locate_or_last(spark, sf_dir):
    return B.locate_or_last(positions(spark, sf_dir), B.book_facts(chapters(spark, sf_dir))).withColumn("progress", F.round("progress", 6))


def highlights(spark, sf_dir) -> DataFrame:
    color = F.element_at(F.array(*map(F.lit, ("yellow", "green", "blue", "pink", "purple"))), (F.col("id") % 5 + 1).cast("int"))
    return positions(spark, sf_dir).withColumn("text", F.concat(F.lit("note "), F.col("id").cast("string"))).withColumn("color", color)


@query(CTE + _LAST + "SELECT book, chapter, string_agg(character || ':' || id, ',' ORDER BY character, id) AS highlights FROM located GROUP BY book, chapter")
def j6_chapter_highlights(spark, sf_dir):
    out = B.chapter_highlights(highlights(spark, sf_dir), B.book_facts(chapters(spark, sf_dir)))
    return out.withColumn("highlights", F.array_join(F.transform("highlights", lambda h: F.concat(h["character"].cast("string"), F.lit(":"), h["id"].cast("string"))), ","))


@query(CTE + _LAST + """, opened AS (SELECT book, ord, coalesce(last_value(CASE WHEN label IS NOT NULL THEN ord END IGNORE NULLS) OVER w, -1) AS opener, coalesce(last_value(label IGNORE NULLS) OVER w, '') AS section FROM labels WINDOW w AS (PARTITION BY book ORDER BY ord))
    SELECT l.book, opener, section, count(*) AS n, min(character) AS first FROM located l JOIN opened o ON l.book = o.book AND l.chapter = o.ord GROUP BY ALL""")
def j7_highlight_sections(spark, sf_dir):
    c = chapters(spark, sf_dir)
    return B.highlight_sections(highlights(spark, sf_dir), B.book_facts(c), B.chapter_labels(c, toc(spark, sf_dir)))


@query(CTE + "SELECT book, ord, label, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY book ORDER BY ord), '') AS section FROM labels")
def j8_chapter_labels(spark, sf_dir):
    return B.chapter_labels(chapters(spark, sf_dir), toc(spark, sf_dir))


@query(CTE + """, starts AS (SELECT book, start FROM facts WHERE ord % 3 = 0 UNION SELECT book, 0 FROM facts), tot AS (SELECT book, max(total) AS t FROM facts GROUP BY book),
    spans AS (SELECT book, start, coalesce(lead(start) OVER (PARTITION BY book ORDER BY start), t) AS e, t FROM starts JOIN tot USING (book) WHERE start = 0 OR start < t),
    own AS (SELECT book, ord AS chapter, start + (ord * 13) % 5000 AS character, CASE WHEN count > 0 THEN least(start + (ord * 13) % 5000, start + count - 1) ELSE start + (ord * 13) % 5000 END AS anchor FROM facts)
    SELECT o.book, chapter, character, s.start AS range_start, s.e AS range_end, least(greatest(character - s.start, 0), greatest(s.e - s.start, 0)) AS current, greatest(s.e - s.start, 0) - least(greatest(character - s.start, 0), greatest(s.e - s.start, 0)) AS remaining
    FROM own o JOIN spans s ON o.book = s.book AND anchor >= s.start AND (anchor < s.e OR s.e = s.t)""")
def j9_toc_range(spark, sf_dir):
    facts = B.book_facts(chapters(spark, sf_dir))
    at = facts.select("book", F.col("ord").alias("chapter"), (F.col("start") + F.col("ord") * 13 % 5000).alias("character"))
    return B.toc_range(at, facts, facts.where("ord % 3 = 0").select("book", "start"))


@query("""WITH l AS (SELECT """ + HOST + """ AS book, page_id AS id, CASE page_id % 4 WHEN 0 THEN '/text/p' || page_id || '.xhtml#x' WHEN 1 THEN 'p' || page_id || '.xhtml' WHEN 2 THEN 'OEBPS/text/p' || page_id || '.xhtml?q=1' ELSE 'other/p' || page_id || '.xhtml' END AS href FROM pages)
    SELECT book, id, href, id AS chapter FROM l WHERE id % 4 != 3""")
def j10_resolve_href(spark, sf_dir):
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".xhtml"))
    href = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/text/"), name, F.lit("#x"))).when(F.col("page_id") % 4 == 1, name).when(F.col("page_id") % 4 == 2, F.concat(F.lit("OEBPS/text/"), name, F.lit("?q=1"))).otherwise(F.concat(F.lit("other/"), name))
    links = table(spark, sf_dir, "pages").select(F.expr(HOST).alias("book"), F.col("page_id").alias("id"), href.alias("href"))
    return B.resolve_href(links, chapters(spark, sf_dir))


@query(CTE + """, o AS (SELECT f.*, label, row_number() OVER (PARTITION BY f.book ORDER BY f.ord) AS n FROM facts f LEFT JOIN labels l ON f.book = l.book AND f.ord = l.ord)
    SELECT book, ord, coalesce(label, 'Preface') AS label, start, greatest(count, 1) AS weight, coalesce(lead(start) OVER (PARTITION BY book ORDER BY ord), total) - start AS characters FROM o WHERE label IS NOT NULL OR n = 1""")
def s8_export_sections(spark, sf_dir):
    c = chapters(spark, sf_dir)
    return B.export_sections(B.book_facts(c), B.chapter_labels(c, toc(spark, sf_dir)))


_PARS = rf""", lines AS (SELECT book, ord, unnest(range(len(xs))) AS line, trim(unnest(xs)) AS text FROM (SELECT book, ord, regexp_split_to_array(visible, '[\n\r]') AS xs FROM par)),
    sized AS (SELECT *, length(regexp_replace(text, '[^{_COUNTED}]', '', 'g')) AS n FROM lines),
    placed AS (SELECT book, ord, line, text, CAST(coalesce(sum(n) OVER (PARTITION BY book ORDER BY ord, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS character FROM sized)"""


@query(CTE + _PARS + "SELECT book, ord, line, md5(text) AS text, character FROM placed WHERE text != ''")
def s29_paragraphs(spark, sf_dir):
    return B.paragraphs(chapters(spark, sf_dir)).select("book", "ord", F.col("line").cast("bigint").alias("line"), F.md5(F.col("text").cast("binary")).alias("text"), "character")


def documents_as_lines(spark, sf_dir) -> DataFrame:
    """Lines of documents as paragraphs of books (source, lang)."""
    d = table(spark, sf_dir, "documents").select(F.concat_ws("-", "source", "lang").alias("book"), F.col("doc_id").alias("ord"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return d.withColumn("text", F.trim("text")).where("text != ''").withColumn("character", F.lit(0).cast("bigint"))


def passages_as_queries(spark, sf_dir) -> DataFrame:
    """Every benchmark passage whole, six words a query; each fifth in capitals."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    b = table(spark, sf_dir, "benchmark").select("item_id", words.alias("ws")).where("size(ws) > 0")
    rows = b.select("item_id", "ws", F.explode(F.sequence(F.lit(0), F.expr("(size(ws) - 1) div 6").cast("int"))).alias("k"))
    text = F.array_join(F.slice("ws", F.col("k") * 6 + 1, 6), " ")
    return rows.select((F.col("item_id") * 1000 + F.col("k")).alias("query_id"), F.when(F.col("k") % 5 == 0, F.translate(text, ascii_lowercase, ascii_uppercase)).otherwise(text).alias("query"))


_HITS = r"""lines AS (SELECT source || '-' || lang AS book, doc_id AS ord, unnest(range(len(xs))) AS line, trim(unnest(xs)) AS text FROM (SELECT *, string_split(text, chr(10)) AS xs FROM documents)),
    b AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w != '') AS ws FROM benchmark),
    q AS (SELECT item_id * 1000 + k AS query_id, lower(array_to_string(ws[k * 6 + 1:k * 6 + 6], ' ')) AS needle FROM (SELECT item_id, ws, unnest(range(CAST(ceil(len(ws) / 6) AS BIGINT))) AS k FROM b WHERE len(ws) > 0)),
    hit AS (SELECT query_id, book, ord, line, text, needle, string_split(lower(text), needle) AS ps FROM lines JOIN q ON contains(lower(text), needle) WHERE text != '' AND needle != ''),
    pos AS (SELECT query_id, book, ord, line, text, needle, unnest(list_transform(range(1, len(ps)), lambda k: list_sum(list_transform(ps[1:k], lambda p: length(p))) + (k - 1) * length(needle))) AS start FROM hit),
    best AS (SELECT *, CAST(start AS BIGINT) AS s, CAST(start AS BIGINT) + length(needle) AS e FROM pos QUALIFY row_number() OVER (PARTITION BY query_id, book ORDER BY ord, line, start) <= 100)"""


@query("WITH " + _HITS + " SELECT query_id, book, ord, line, s AS start FROM best")
def s29_search(spark, sf_dir):
    out = B.search(documents_as_lines(spark, sf_dir), passages_as_queries(spark, sf_dir))
    return out.select("query_id", "book", "ord", F.col("line").cast("bigint").alias("line"), F.col("start").cast("bigint").alias("start"))


_OPEN, _CLOSE = "「『（(【〈《〔｛{［[", "」』）)】〉》〕｝}］]"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(12288) || chr(160)"


@query("WITH " + _HITS + rf""",
    cut AS (SELECT *, ltrim(regexp_extract(substring(text, 1, s), '([^。！？.!?\n\r]*)$', 1), {_WHITE}) AS pre, rtrim(regexp_extract(substring(text, e + 1), '^[^。！？.!?\n\r]*([。！？.!?\n\r][。、！？」』）)】〉》〕｝}}］\]]*)?'), {_WHITE}) AS post FROM best),
    br AS (SELECT *, list_reduce(list_filter(string_split(pre || substring(text, s + 1, e - s) || post, ''), lambda c: contains('{_OPEN}{_CLOSE}', c) AND c != ''),
        lambda a, c: CASE WHEN contains('{_OPEN}', c) THEN split_part(a, chr(0), 1) || c || chr(0) || split_part(a, chr(0), 2)
            WHEN split_part(a, chr(0), 1) != '' AND translate(right(split_part(a, chr(0), 1), 1), '{_OPEN}', '{_CLOSE}') = c THEN left(split_part(a, chr(0), 1), -1) || chr(0) || split_part(a, chr(0), 2)
            ELSE split_part(a, chr(0), 1) || chr(0) || split_part(a, chr(0), 2) || c END, chr(0)) AS loose FROM cut),
    fit AS (SELECT *, split_part(loose, chr(0), 1) AS op, split_part(loose, chr(0), 2) AS cl FROM br),
    led AS (SELECT *, ltrim(substring(pre, coalesce(list_max(list_filter(range(1, length(op) + 1), lambda i: left(pre, i) = left(op, i))), 0) + 1), {_WHITE}) AS lead FROM fit),
    bk AS (SELECT *, list_reduce(list_reverse(list_filter(string_split(post, ''), lambda c: c != '')), lambda a, c: CASE WHEN a.stop OR a.cl = '' THEN {{cl: a.cl, seen: a.seen + 1, gone: a.gone, stop: true}}
        WHEN right(a.cl, 1) = c THEN {{cl: left(a.cl, -1), seen: a.seen + 1, gone: a.seen + 1, stop: false}}
        ELSE {{cl: a.cl, seen: a.seen + 1, gone: a.gone, stop: NOT contains('。！？.!?' || chr(10) || chr(13), c)}} END, {{cl: cl, seen: 0, gone: 0, stop: false}}) AS z FROM led),
    done AS (SELECT *, rtrim(left(post, length(post) - z.gone), {_WHITE}) AS trail FROM bk)
    SELECT query_id, book, ord, line, s AS start, CAST(length(regexp_replace(substring(text, 1, s), '[^{_COUNTED}]', '', 'g')) AS BIGINT) AS character, lead || substring(text, s + 1, e - s) || trail AS snippet,
        length(lead) AS snippet_start, length(lead) + e - s AS snippet_end, length(regexp_replace(substring(text, s + 1, e - s), '[^{_COUNTED}]', '', 'g')) AS match_length FROM done""")
def s29_search_snippets(spark, sf_dir):
    out = B.search(documents_as_lines(spark, sf_dir), passages_as_queries(spark, sf_dir))
    return out.withColumns({"line": F.col("line").cast("bigint"), "start": F.col("start").cast("bigint")})


@query(CTE + "SELECT f.book, CASE WHEN max(total) > 0 THEN round(least(greatest(coalesce(max(character), 0) / max(total), 0.0), 1.0), 6) ELSE 0.0 END AS progress FROM facts f LEFT JOIN (SELECT book, max(character) AS character FROM pos GROUP BY book) p USING (book) GROUP BY f.book")
def a17_reading_progress(spark, sf_dir):
    marks = positions(spark, sf_dir).groupBy("book").agg(F.max("character").alias("character"))
    return B.reading_progress(marks, B.book_facts(chapters(spark, sf_dir))).withColumn("progress", F.round("progress", 6))


@query(CTE + "SELECT book, max(ord) AS chapter, 1.0 AS progress, max(total) AS character FROM facts GROUP BY book")
def u7_mark_read(spark, sf_dir):
    return B.mark_read(B.book_facts(chapters(spark, sf_dir)))


@query(CTE + "SELECT t.book, round(coalesce(m, 0) / total, 6) AS coverage, c - coalesce(n, 0) AS unmatched FROM (SELECT book, max(total) AS total FROM facts GROUP BY book) t JOIN (SELECT book, count(*) AS c FROM pos GROUP BY book) USING (book) LEFT JOIN (SELECT book, sum(id % 50) AS m, count(*) AS n FROM pos WHERE id % 4 = 0 GROUP BY book) USING (book)")
def a14_match_coverage(spark, sf_dir):
    cues = positions(spark, sf_dir)
    matches = cues.where("id % 4 = 0").select("book", (F.col("id") % 50).alias("length"))
    return B.match_coverage(matches, B.book_facts(chapters(spark, sf_dir)), cues).withColumn("coverage", F.round("coverage", 6))


@query("SELECT " + HOST + " AS book, href AS path, row_number() OVER (PARTITION BY " + HOST + " ORDER BY min(page_id), href) - 1 AS place FROM (SELECT url, page_id, 'img/' || (page_id % 20) || '.png' AS href FROM pages) GROUP BY 1, 2")
def a12_book_images(spark, sf_dir):
    c = chapters(spark, sf_dir).withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.lit('<img class="x" src="img/'), (F.col("ord") % 20).cast("string"), F.lit('.png?v=1"><img class="gaiji" src="g.png"><img src="//cdn/x.png">')))
    return B.book_images(c)


@query(CTE + f"""SELECT ord AS page_id, translate(lower(regexp_replace(regexp_replace(visible, '[%％]', 'パーセント', 'g'), '[^{_COUNTED}]', '', 'g')), 'パセント', 'ぱせんと') AS spoken FROM vis""")
def t4_speech_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.speech_text(F.col("html")).alias("spoken"))
