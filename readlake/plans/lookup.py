"""Queries of the lookup, sync and shelf families and their SQL.

Parts stand for dictionary terms and audio entries (brand = dictionary or source, the two words of the name = reading and expression),
suppliers for requests, orders for bookmarks and remote listings, customers for books.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.functions import dates as D
from readlake.functions import text as T
from readlake.operators import lookup as L
from readlake.operators import shelves as H
from readlake.operators import sync as Y
from readlake.plans.fixtures import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def entries(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    word = F.split("p_name", " ")
    extension = F.element_at(F.array(*map(F.lit, ("mp3", "OPUS", "ogg", "wav"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select(F.col("p_brand").alias("source"), word[1].alias("expression"), F.when(F.col("p_partkey") % 5 > 0, word[0]).alias("reading"), F.concat(F.col("p_partkey").cast("string"), F.lit("."), extension).alias("file"))


def requests(spark, sf_dir) -> DataFrame:
    """One request for each word, with and without its reading, of all parts."""
    word = F.split("p_name", " ")
    p = table(spark, sf_dir, "part").select("p_partkey", word[1].alias("term"), F.when(F.col("p_partkey") % 3 > 0, word[0]).alias("reading"))
    return p.groupBy("term", "reading").agg(F.min("p_partkey").alias("request_id")).select("request_id", "term", "reading")


def source_order(spark, sf_dir) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("source")).distinct()
    n = F.regexp_extract("source", "[0-9]+", 0).cast("bigint")
    return brands.select("source", n.alias("place")).where("place % 4 != 0")


AUDIO = """WITH entries AS (SELECT p_brand AS source, split_part(p_name, ' ', 2) AS expression, CASE WHEN p_partkey % 5 > 0 THEN split_part(p_name, ' ', 1) END AS reading, p_partkey || '.' || ['mp3', 'OPUS', 'ogg', 'wav'][p_partkey % 4 + 1] AS file FROM part),
    req AS (SELECT min(p_partkey) AS request_id, split_part(p_name, ' ', 2) AS term, coalesce(CASE WHEN p_partkey % 3 > 0 THEN split_part(p_name, ' ', 1) END, '') AS wanted FROM part GROUP BY 2, 3),
    sorder AS (SELECT DISTINCT p_brand AS source, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS place FROM part WHERE CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) % 4 != 0),
    ranked AS (SELECT *, CASE WHEN wanted = '' AND term = expression THEN 0 WHEN term = expression AND (reading IS NULL OR reading = wanted) THEN 0 WHEN reading = wanted THEN 1 ELSE 2 END AS rank
        FROM (SELECT DISTINCT r.*, e.* FROM req r JOIN entries e ON (e.expression = r.term OR (r.wanted != '' AND e.reading = r.wanted)) WHERE NOT regexp_matches(file, 'wav$')) LEFT JOIN sorder USING (source))
"""


@query(AUDIO + "SELECT request_id, source, expression, reading, file, CAST(rank AS INTEGER) AS rank FROM ranked QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY rank, coalesce(place, 2147483647), coalesce(reading, ''), source, file) = 1")
def j12_rank_audio(spark, sf_dir):
    return L.rank_audio(requests(spark, sf_dir), entries(spark, sf_dir), source_order(spark, sf_dir)).select("request_id", "source", "expression", "reading", "file", "rank")


@query(AUDIO + "SELECT request_id, source, file, row_number() OVER (PARTITION BY request_id ORDER BY rank, coalesce(place, 2147483647), coalesce(reading, ''), source, file) AS n FROM ranked")
def j12_rank_audio_all(spark, sf_dir):
    return L.rank_audio(requests(spark, sf_dir), entries(spark, sf_dir), source_order(spark, sf_dir), every=True).select("request_id", "source", "file", "n")


@query("SELECT p_brand AS source, count(*) AS n FROM part WHERE p_partkey % 4 != 3 AND p_brand NOT IN ('Brand#1', 'Brand#2') GROUP BY p_brand")
def f7_supported_audio(spark, sf_dir):
    off = table(spark, sf_dir, "part").select(F.col("p_brand").alias("source")).where("source in ('Brand#1', 'Brand#2')").distinct()
    return L.supported_audio(entries(spark, sf_dir), off).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT p_brand AS source FROM part WHERE p_partkey % 4 != 3")
def s9_audio_sources(spark, sf_dir):
    return L.supported_audio(entries(spark, sf_dir)).select("source").distinct()


@query("""WITH a AS (SELECT DISTINCT p_brand AS source, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS k FROM part)
    SELECT source, row_number() OVER (ORDER BY CASE WHEN k % 4 != 0 THEN 0 ELSE 1 END, CASE WHEN k % 4 != 0 THEN k WHEN k % 8 = 0 THEN k ELSE 1099511627776 END, source) - 1 AS place FROM a""")
def u4_repair_order(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("source")).distinct()
    k = F.regexp_extract("source", "[0-9]+", 0).cast("bigint")
    return L.repair_order(source_order(spark, sf_dir), brands, brands.select("source", k.alias("priority")).where("priority % 8 = 0"))


def terms(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    word = F.split("p_name", " ")
    return p.select(F.col("p_brand").alias("dict"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("bigint").alias("dict_order"), F.when(F.col("p_partkey") % 2 == 0, word[0]).otherwise(F.col("p_name")).alias("expression"), word[0].alias("reading"), F.col("p_partkey").cast("string").alias("glossary"))


def frequencies(spark, sf_dir) -> DataFrame:
    return terms(spark, sf_dir).groupBy("expression").agg(F.count("*").alias("value"))


@query("""WITH t AS (SELECT p_brand AS dict, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS dict_order, CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END AS expression, split_part(p_name, ' ', 1) AS reading, CAST(p_partkey AS VARCHAR) AS glossary FROM part),
    f AS (SELECT expression, count(*) AS frequency FROM t GROUP BY expression), x AS (SELECT p_partkey AS text_id, p_name || ' and more' AS text FROM part WHERE p_partkey % 50 = 0),
    pre AS (SELECT text_id, k AS length, text[1:k] AS expression FROM x, range(1, 17) r(k) WHERE k <= length(text))
    SELECT text_id, length, expression, glossary, place FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY length DESC, frequency, dict_order, expression, reading, glossary) AS place FROM pre JOIN t USING (expression) JOIN f USING (expression)) WHERE place <= 16""")
def j19_term_scan(spark, sf_dir):
    texts = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("text_id"), F.concat("p_name", F.lit(" and more")).alias("text"))
    return L.term_scan(texts, terms(spark, sf_dir), frequencies(spark, sf_dir)).select("text_id", F.col("length").cast("bigint").alias("length"), "expression", "glossary", "place")


@query("""SELECT p_type AS character, array_to_string(list(x ORDER BY x), ',') AS entries FROM (SELECT DISTINCT p_type, p_brand || '/' || split_part(p_name, ' ', 1) AS x FROM part WHERE p_partkey % 3 = 0) GROUP BY p_type""")
def j20_kanji_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kanji = p.where("p_partkey % 3 = 0").select(F.col("p_type").alias("character"), F.col("p_brand").alias("dict"), F.split("p_name", " ")[0].alias("onyomi"), F.lit("").alias("kunyomi"))
    out = L.kanji_lookup(p.select(F.col("p_type").alias("character")).distinct(), kanji)
    return out.select("character", F.array_join(F.array_sort(F.transform("entries", lambda e: F.concat(e["dict"], F.lit("/"), e["onyomi"]))), ",").alias("entries"))


@query("""WITH f AS (SELECT p_name AS expression, p_brand AS dict, p_size AS value, CASE WHEN p_partkey % 2 = 1 THEN (p_size + 3) || '位' ELSE 'x' END AS display, p_partkey AS ord FROM part),
    v AS (SELECT expression, dict, arg_min(CASE WHEN try_cast(regexp_extract(display, '^(\\d+)', 1) AS BIGINT) > 0 THEN try_cast(regexp_extract(display, '^(\\d+)', 1) AS BIGINT) WHEN value > 20 THEN value END, ord) FILTER (true) AS v0,
        first(CASE WHEN try_cast(regexp_extract(display, '^(\\d+)', 1) AS BIGINT) > 0 THEN try_cast(regexp_extract(display, '^(\\d+)', 1) AS BIGINT) WHEN value > 20 THEN value END ORDER BY ord) AS v FROM f GROUP BY expression, dict)
    SELECT expression, CASE WHEN count(v) > 0 THEN CAST(floor(round(count(v) / sum(1.0 / v), 6)) AS BIGINT) ELSE 9999999 END AS rank FROM v GROUP BY expression""".replace("\\\\", "\\"))
def a15_harmonic_rank(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    f = p.select(F.col("p_name").alias("expression"), F.col("p_brand").alias("dict"), F.when(F.col("p_size") > 20, F.col("p_size")).otherwise(0).cast("bigint").alias("value"), F.when(F.col("p_partkey") % 2 == 1, F.concat((F.col("p_size") + 3).cast("string"), F.lit("位"))).otherwise("x").alias("display"), F.col("p_partkey").alias("ord"))
    return L.harmonic_rank(f)


@query("""WITH p AS (SELECT p_name AS expression, p_partkey AS ord, p_size % 5 AS position, p_partkey % 7 = 0 AS inflected FROM part),
    c AS (SELECT expression, ord, CASE WHEN position = 0 THEN 'heiban' WHEN inflected THEN 'kifuku' WHEN position = 1 THEN 'atamadaka' WHEN position = 3 THEN 'odaka' WHEN position < 3 THEN 'nakadaka' END AS category FROM p),
    f AS (SELECT expression, category, min(ord) AS o FROM c WHERE category IS NOT NULL GROUP BY ALL) SELECT expression, string_agg(category, ',' ORDER BY o) AS categories FROM f GROUP BY expression""")
def a16_pitch_categories(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("expression"), F.lit("きょうと").alias("reading"), (F.col("p_size") % 5).alias("position"), (F.col("p_partkey") % 7 == 0).alias("inflected"), F.col("p_partkey").alias("ord"))
    return L.pitch_categories(p)


@query("""SELECT p_partkey, 3 AS n, CASE p_size % 5 WHEN 0 THEN 'LHHH' WHEN 1 THEN 'HLLL' WHEN 2 THEN 'LHLL' WHEN 3 THEN 'LHHL' ELSE 'LHHH' END AS pattern FROM part""")
def t12_pitch(spark, sf_dir):
    kana = F.lit("きょうと")
    return table(spark, sf_dir, "part").select("p_partkey", F.size(T.morae(kana)).alias("n"), T.pitch_pattern(kana, F.col("p_size") % 5).alias("pattern"))


@query("""WITH s AS (SELECT DISTINCT p_brand AS name FROM part), c AS (SELECT name, CAST(regexp_extract(name, '[0-9]+') AS BIGINT) AS place FROM s)
    SELECT name, CASE WHEN place % 3 = 0 THEN true ELSE place % 2 = 0 END AS enabled, row_number() OVER (ORDER BY CASE WHEN place % 3 = 0 THEN 1 ELSE 0 END, CASE WHEN place % 3 = 0 THEN 0 ELSE place END, name) - 1 AS place FROM c""")
def j17_effective_dictionaries(spark, sf_dir):
    stored = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    config = stored.withColumn("place", F.regexp_extract("name", "[0-9]+", 0).cast("bigint")).where("place % 3 != 0").withColumn("enabled", F.col("place") % 2 == 0)
    return L.effective_dictionaries(stored, config)


def dictionaries(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(F.col("s_name").alias("title"), k.alias("place"), (k % 2 == 0).alias("enabled"), F.when(k % 3 == 0, "exclude").when(k % 3 == 1, "terms").otherwise("names").alias("category"), (k % 5 > 0).alias("updatable"), F.when(k % 7 > 0, F.concat(F.lit("http://x/"), k.cast("string"))).otherwise(" ").alias("index_url"), F.lit("http://y").alias("download_url"), (k % 4).cast("string").alias("revision"))


@query("SELECT s_name AS title FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 != 0")
def f5_enabled_dictionaries(spark, sf_dir):
    return L.enabled_dictionaries(dictionaries(spark, sf_dir)).select("title")


@query("SELECT s_name AS title FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 7 > 0")
def f6_updatable(spark, sf_dir):
    return L.updatable(dictionaries(spark, sf_dir)).select("title")


@query("""SELECT s_name AS title, CASE WHEN s_suppkey % 7 > 0 THEN 'http://x/' || s_suppkey ELSE ' ' END AS index_url, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 11 = 0 THEN 'failed' WHEN s_suppkey % 4 = s_nationkey % 4 THEN 'current' WHEN s_suppkey % 13 = 0 THEN 'renamed' ELSE 'outdated' END AS state FROM supplier""")
def j18_outdated_dictionaries(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    remote = s.where("s_suppkey % 11 != 0 and s_suppkey % 7 > 0").select(F.concat(F.lit("http://x/"), k.cast("string")).alias("index_url"), F.when(k % 13 == 0, F.concat("s_name", F.lit(" 2"))).otherwise(F.col("s_name")).alias("title"), (F.col("s_nationkey") % 4).cast("string").alias("revision"))
    return L.outdated_dictionaries(dictionaries(spark, sf_dir), remote)


@query("""SELECT s_suppkey AS id, s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' [2024]' ELSE '' END AS name, CASE WHEN s_suppkey % 4 = 2 THEN 'noted ' || s_suppkey WHEN s_suppkey % 4 = 0 THEN 'plain ' || s_suppkey WHEN s_suppkey % 4 = 1 THEN 'plain ' || s_suppkey ELSE 'noted ' || s_suppkey END AS glossary FROM supplier""")
def j21_glossary_by_name(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    asked = s.select(k.alias("id"), F.concat("s_name", F.when(k % 2 == 0, " [2024]").otherwise("")).alias("name"))
    have = s.select(F.concat("s_name", F.when((k % 4 == 2) | (k % 4 == 3), " [2024]").otherwise("")).alias("dict"), F.concat(F.when((k % 4 == 2) | (k % 4 == 3), "noted ").otherwise("plain "), k.cast("string")).alias("glossary"))
    return L.glossary_by_name(asked, have)


@query("""WITH d AS (SELECT s_suppkey AS dict, s_suppkey * 7 % 101 AS place, CASE s_suppkey % 3 WHEN 0 THEN 'exclude' WHEN 1 THEN 'terms' ELSE 'names' END AS category FROM supplier),
    g AS (SELECT l_partkey AS term, l_suppkey AS dict, 'g' || l_orderkey || '-' || l_linenumber AS glossary FROM lineitem)
    SELECT term, glossary FROM (SELECT term, glossary, row_number() OVER (PARTITION BY term ORDER BY CASE category WHEN 'terms' THEN 0 ELSE 1 END, place, glossary) AS n FROM g JOIN d USING (dict) WHERE category != 'exclude') WHERE n = 1""")
def j22_first_glossary(spark, sf_dir):
    d = dictionaries(spark, sf_dir).select(F.col("place").alias("dict"), (F.col("place") * 7 % 101).alias("place"), "category")
    g = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("term"), F.col("l_suppkey").alias("dict"), F.concat(F.lit("g"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("glossary"))
    return L.first_glossary(g, d, "terms", "names")


@query("SELECT doc_id AS book, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE 'default' END AS profile FROM documents")
def j23_book_profile(spark, sf_dir):
    books = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), F.concat(F.upper("lang"), F.lit("-XX")).alias("language"))
    n = table(spark, sf_dir, "region").where("r_regionkey < 3")
    profiles = n.select(F.element_at(F.array(*map(F.lit, ("english", "german", "french"))), (F.col("r_regionkey") + 1).cast("int")).alias("profile"), F.element_at(F.array(*map(F.lit, ("en", "de", "fr"))), (F.col("r_regionkey") + 1).cast("int")).alias("language"), (F.col("r_regionkey") < 2).alias("is_primary"))
    return L.book_profile(books, profiles, "default")


@query("SELECT s_name AS dict, array_to_string(list_filter([CASE WHEN s_suppkey % 2 > 0 THEN 'terms' END, CASE WHEN s_suppkey % 3 > 0 THEN 'frequencies' END, CASE WHEN s_suppkey % 5 > 0 THEN 'pitches' END, CASE WHEN s_nationkey > 3 THEN 'kanji' END], lambda x: x IS NOT NULL), ',') AS types FROM supplier")
def a20_dictionary_types(spark, sf_dir):
    k = F.col("s_suppkey")
    return L.dictionary_types(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("dict"), (k % 2).alias("terms"), (k % 3).alias("frequencies"), (k % 5).alias("pitches"), F.greatest(F.col("s_nationkey") - 3, F.lit(0)).alias("kanji")))


def notes(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    field = F.concat(F.lit("<b>"), F.col("p_name"), F.lit(" "), (F.col("p_partkey") % 40).cast("string"), F.lit("</b>"))
    deck = F.col("p_size")
    have = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("note_id"), (F.col("p_partkey") % 3).alias("model"), deck.alias("deck"), T.note_checksum(field).alias("checksum"))
    asked = p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("candidate_id"), F.when(F.col("p_partkey") % 101 == 1, " ").otherwise(F.concat(F.col("p_name"), F.lit(" "), ((F.col("p_partkey") + 1) % 40).cast("string"))).alias("field"), (F.col("p_partkey") % 3).alias("model"), deck.alias("deck"))
    decks = p.select(deck.alias("deck")).distinct().withColumn("name", F.concat(F.lit("root"), (F.col("deck") % 3).cast("string"), F.lit("::"), F.col("deck").cast("string")))
    return asked, have, decks


_NOTES = """WITH n AS (SELECT p_partkey % 3 AS model, p_size AS deck, p_size % 3 AS root, p_name || ' ' || p_partkey % 40 AS f FROM part WHERE p_partkey % 2 = 0),
    c AS (SELECT p_partkey AS candidate_id, CASE WHEN p_partkey % 101 = 1 THEN ' ' ELSE p_name || ' ' || (p_partkey + 1) % 40 END AS f, p_partkey % 3 AS model, p_size AS deck, p_size % 3 AS root FROM part WHERE p_partkey % 2 = 1)
    SELECT candidate_id FROM c WHERE trim(f) != '' AND EXISTS (SELECT 1 FROM n WHERE n.f = c.f"""


@query(_NOTES + " AND n.model = c.model)")
def j16_duplicate_notes(spark, sf_dir):
    return L.duplicate_notes(*notes(spark, sf_dir))


@query(_NOTES + " AND n.root = c.root)")
def j16_duplicate_notes_deck_root(spark, sf_dir):
    return L.duplicate_notes(*notes(spark, sf_dir), scope="deck_root", all_models=True)


@query("SELECT p_partkey, CAST('0x' || substr(sha1(p_name || ' & ' || p_partkey || ' img.png '), 1, 8) AS BIGINT) AS checksum FROM part")
def t18_note_checksum(spark, sf_dir):
    field = F.concat(F.lit("<p>"), F.col("p_name"), F.lit(" &amp; "), F.col("p_partkey").cast("string"), F.lit('<style>x</style><img src="img.png"></p>'))
    return table(spark, sf_dir, "part").select("p_partkey", T.note_checksum(field).alias("checksum"))


@query("SELECT p_partkey AS id, CASE WHEN p_brand IN ('Brand#1', 'Brand#3') THEN 'New ' || p_brand ELSE p_brand END AS dict FROM part")
def u8_propagate_renames(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    renames = p.select(F.col("p_brand").alias("old")).distinct().where("old in ('Brand#1', 'Brand#3')").withColumn("new", F.concat(F.lit("New "), "old"))
    return L.propagate_renames(p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("dict")), renames)


@query("SELECT p_partkey, 'a=' || p_name || CASE WHEN p_size > 25 THEN ',c=' || p_brand ELSE '' END AS mappings FROM part")
def f10_active_mappings(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.create_map(F.lit("a"), "p_name", F.lit("b"), F.lit("x"), F.when(F.col("p_size") > 25, "c").otherwise("d"), "p_brand").alias("mappings"))
    out = L.active_mappings(p, ["a", "c"])
    return out.select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries("mappings")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("mappings"))


@query("SELECT p_partkey, 'Word: ' || split_part(p_name, ' ', 2) || ' (' || p_brand || ') ' AS rendered, 'the ' AS prefix, split_part(p_name, ' ', 2) AS body, ' and ' || split_part(p_name, ' ', 2) AS suffix FROM part")
def t19_render_template(spark, sf_dir):
    term = F.split("p_name", " ")[1]
    sentence = F.concat(F.lit("the "), term, F.lit(" and "), term)
    prefix, body, suffix = T.cloze(sentence, term, F.lit(1))
    return table(spark, sf_dir, "part").select("p_partkey", T.render_template("Word: {expression} ({dictionary}) {unknown}", {"expression": term, "dictionary": F.col("p_brand")}).alias("rendered"), prefix.alias("prefix"), body.alias("body"), suffix.alias("suffix"))


@query("""SELECT p_partkey, 'readlake ' || replace(p_name, ' ', '_') || CASE WHEN p_size > 25 THEN '  x' || p_brand ELSE '  x' END AS tags, '<ol><li data-dictionary="' || p_brand || '">one ' || p_name || '</li><li data-dictionary="' || p_brand || '">two</li></ol>' AS brief FROM part""")
def t19_tags_and_headers(spark, sf_dir):
    item = lambda text: F.concat(F.lit('<li data-dictionary="'), "p_brand", F.lit('"><i>('), "p_brand", F.lit(")</i> "), text, F.lit("</li>"))
    glossary = F.concat(F.lit("<ol>"), item(F.concat(F.lit("one "), "p_name")), item(F.lit("two")), F.lit("</ol>"))
    tags = T.render_tags("readlake {document-title} {missing} x{dictionary}", {"document-title": F.concat(F.lit(" "), "p_name"), "dictionary": F.when(F.col("p_size") > 25, F.col("p_brand"))})
    return table(spark, sf_dir, "part").select("p_partkey", tags.alias("tags"), T.without_headers(glossary).alias("brief"))


# sync ---------------------------------------------------------------------------------------------------------------------------


def listing(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ms = F.expr("unix_millis(cast(o_orderdate as timestamp))").cast("string")
    name = F.element_at(F.array(F.concat(F.lit("progress_1_6_"), ms, F.lit("_0.25.json")), F.concat(F.lit("statistics_1_6_"), ms, F.lit("_77_x.json")), F.concat(F.lit("bookdata_1_6_x_"), ms, F.lit("_"), ms, F.lit(".zip")), F.concat(F.lit("cover_"), ms), F.concat(F.lit("other_"), ms)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select(F.concat(F.lit("folder"), F.col("o_custkey").cast("string")).alias("folder"), F.col("o_orderkey").cast("string").alias("id"), name.alias("name"))


@query("""SELECT id, kind, CASE WHEN kind IN ('progress', 'statistics', 'bookdata') THEN ms END AS modified, CASE kind WHEN 'progress' THEN 0.25 WHEN 'statistics' THEN 77.0 WHEN 'bookdata' THEN CAST(ms AS DOUBLE) END AS value
    FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id, ['progress', 'statistics', 'bookdata', 'cover', NULL][o_orderkey % 5 + 1] AS kind, epoch_us(o_orderdate) // 1000 AS ms FROM orders)""")
def s10_file_facts(spark, sf_dir):
    return Y.file_facts(listing(spark, sf_dir)).select("id", "kind", "modified", "value")


@query("""WITH f AS (SELECT 'folder' || o_custkey AS folder, CAST(o_orderkey AS VARCHAR) AS id, ['progress', 'statistics', 'bookdata', 'cover', NULL][o_orderkey % 5 + 1] AS kind, CASE WHEN o_orderkey % 5 < 3 THEN epoch_us(o_orderdate) // 1000 END AS ms FROM orders),
    top AS (SELECT * FROM f WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY folder, kind ORDER BY ms DESC NULLS LAST, id) = 1)
    SELECT folder, max(id) FILTER (kind = 'progress') AS progress_id, max(id) FILTER (kind = 'statistics') AS statistics_id, max(id) FILTER (kind = 'audio') AS audio_id, max(id) FILTER (kind = 'bookdata') AS bookdata_id, max(id) FILTER (kind = 'cover') AS cover_id,
        coalesce(max(ms) FILTER (kind = 'progress'), max(ms) FILTER (kind = 'bookdata')) AS last_access FROM top GROUP BY folder""")
def a21_latest_files(spark, sf_dir):
    return Y.latest_files(listing(spark, sf_dir))


@query("""WITH l AS (SELECT o_custkey AS book, max(epoch_us(o_orderdate) // 1000) AS local_ms FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), r AS (SELECT o_custkey AS book, max(epoch_us(o_orderdate) // 1000) AS remote_ms FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
    SELECT book, local_ms, remote_ms, CASE WHEN local_ms IS NULL THEN 'import' WHEN remote_ms IS NULL THEN 'export' WHEN local_ms > remote_ms THEN 'export' WHEN remote_ms > local_ms THEN 'import' ELSE 'synced' END AS direction FROM l FULL OUTER JOIN r USING (book)""")
def j3_sync_direction(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), "o_orderkey", F.expr("unix_millis(cast(o_orderdate as timestamp))").alias("ms"))
    local = o.where("o_orderkey % 2 = 0").groupBy("book").agg(D.to_reference_seconds(F.max("ms")).alias("lastModified"))
    remote = o.where("o_orderkey % 3 = 0").groupBy("book").agg(F.max("ms").alias("modified"))
    return Y.sync_direction(local, remote)


_TITLE = "CASE WHEN p_partkey % 4 = 0 THEN p_name || ' ' WHEN p_partkey % 4 = 1 THEN p_name || '.' WHEN p_partkey % 4 = 2 THEN p_brand || ': 50% *' || p_name || '?' ELSE p_name END"


@query(f"""SELECT p_partkey, {_TITLE} AS title, CASE WHEN p_partkey % 4 = 0 THEN p_name || '~ttu-spc~' WHEN p_partkey % 4 = 1 THEN p_name || '~ttu-dend~' WHEN p_partkey % 4 = 2 THEN p_brand || '%3A 50%25 ~ttu-star~' || p_name || '%3F' ELSE p_name END AS name, {_TITLE} AS back FROM part""")
def t14_titles(spark, sf_dir):
    out = table(spark, sf_dir, "part").select("p_partkey", F.expr(_TITLE).alias("title"))
    return out.withColumn("name", T.escape_title(F.col("title"))).withColumn("back", T.unescape_title(F.col("name")))


@query("""SELECT o_orderkey, 'progress_1_6_' || (epoch_us(o_orderdate) // 1000) || '_' || o_custkey || '.json' AS name FROM orders""")
def t15_file_names(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", Y.progress_file_name(F.expr("unix_millis(cast(o_orderdate as timestamp))"), F.col("o_custkey")).alias("name"))


@query("""WITH f AS (SELECT DISTINCT 'folder' || o_custkey AS folder FROM orders WHERE o_orderkey % 5 = 2), b AS (SELECT folder, count(*) AS n FROM f GROUP BY folder)
    SELECT folder, folder AS title FROM b WHERE CAST(substr(folder, 7) AS BIGINT) % 2 = 1""")
def j13_remote_only(spark, sf_dir):
    local = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("folder"), F.col("c_custkey").cast("string")).alias("title"))
    return Y.remote_only(Y.latest_files(listing(spark, sf_dir)), local).select("folder", "title")


# shelves and storage ------------------------------------------------------------------------------------------------------------


def books(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    title = F.concat(F.lower("c_mktsegment"), F.lit(" vol. "), (F.col("c_custkey") % 120).cast("string"))
    return c.select(F.col("c_custkey").alias("book"), F.col("c_nationkey").alias("shelf"), title.alias("title"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("last_access"))


def shelves(spark, sf_dir) -> DataFrame:
    return books(spark, sf_dir).where("book % 3 != 0").groupBy("shelf").agg(F.array_sort(F.collect_list("book")).alias("books"))


@query("SELECT c_custkey AS book, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST, c_custkey) AS place FROM customer")
def o1_recent_books(spark, sf_dir):
    return H.order_books(books(spark, sf_dir)).select("book", "place")


@query("SELECT c_custkey AS book, row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(c_mktsegment), c_custkey % 120, c_custkey) AS place FROM customer")
def o2_natural_titles(spark, sf_dir):
    return H.order_books(books(spark, sf_dir), by="title").select("book", "place")


@query("SELECT c_custkey AS book, c_nationkey AS shelf FROM customer WHERE c_custkey % 3 = 0")
def j15_unshelved(spark, sf_dir):
    return H.unshelved(books(spark, sf_dir), shelves(spark, sf_dir)).select("book", "shelf")


@query("SELECT l_orderkey AS book, l_linenumber AS file, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 7 = l_linenumber) GROUP BY 1, 2")
def j14_orphan_files(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("file"))
    playback = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book"), (F.col("o_orderkey") % 7).cast("int").alias("file"))
    return H.orphan_files(files, playback).groupBy("book", "file").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT c_nationkey AS shelf, c_custkey AS book FROM customer WHERE c_custkey % 3 != 0), r AS (SELECT shelf, 0 AS g, book FROM s WHERE book % 10 != 1 UNION ALL SELECT CAST(book % 5 AS INTEGER), 1, book FROM s WHERE book % 10 = 1 AND book % 20 = 1)
    SELECT shelf, coalesce(string_agg(CAST(book AS VARCHAR), ',' ORDER BY g, book), '') AS books FROM (SELECT DISTINCT shelf FROM s) LEFT JOIN r USING (shelf) GROUP BY shelf""")
def u3_shelf_edits(spark, sf_dir):
    edits = books(spark, sf_dir).where("book % 3 != 0 and book % 10 = 1").select("book", F.when(F.col("book") % 20 == 1, (F.col("book") % 5).cast("int")).alias("target"))
    return H.apply_shelf_edits(shelves(spark, sf_dir), edits).select("shelf", F.array_join(F.transform("books", lambda b: b.cast("string")), ",").alias("books"))


@query("""SELECT 0 AS section, 'reading' AS name, c_custkey AS book FROM customer WHERE c_custkey % 100 / 100.0 > 0 AND c_custkey % 100 / 100.0 < 0.999 UNION ALL SELECT 1, CAST(c_nationkey AS VARCHAR), c_custkey FROM customer WHERE c_custkey % 3 != 0 UNION ALL SELECT 2, 'unshelved', c_custkey FROM customer WHERE c_custkey % 3 = 0""")
def u5_shelf_sections(spark, sf_dir):
    progress = books(spark, sf_dir).select("book", (F.col("book") % 100 / 100.0).alias("progress"))
    named = shelves(spark, sf_dir).withColumn("shelf", F.col("shelf").cast("string"))
    return H.shelf_sections(books(spark, sf_dir), named, progress)


@query("SELECT c_custkey AS book FROM customer WHERE c_custkey % 100 / 100.0 > 0 AND c_custkey % 100 / 100.0 < 0.999")
def f8_being_read(spark, sf_dir):
    return H.shelf_sections(books(spark, sf_dir), shelves(spark, sf_dir).withColumn("shelf", F.col("shelf").cast("string")), books(spark, sf_dir).select("book", (F.col("book") % 100 / 100.0).alias("progress"))).where("section = 0").select("book")


@query("SELECT c_custkey AS book, CASE WHEN c_custkey % 3 = 0 THEN 'Renamed' WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE c_name END AS title FROM customer")
def f9_display_title(spark, sf_dir):
    k = F.col("c_custkey") % 3
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book"), T.display_title(F.when(k == 0, "Renamed").otherwise(" "), F.when(k == 1, F.col("c_mktsegment")), F.col("c_name")).alias("title"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'blue' ELSE 'yellow' END AS color FROM labels WHERE doc_id % 5 != 0")
def u6_highlight_edits(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("yellow").alias("color"))  # noqa: E741
    edits = l.where("id % 4 = 0 or id % 5 = 0").select("id", F.when(F.col("id") % 4 == 0, "blue").alias("color"), (F.col("id") % 5 == 0).alias("remove"))
    return H.apply_highlight_edits(l, edits)


@query("SELECT coalesce(source, 'total') AS category, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) AS items FROM documents GROUP BY ROLLUP (source)")
def a18_cleanup_report(spark, sf_dir):
    return H.cleanup_report(table(spark, sf_dir, "documents").select(F.col("source").alias("category"), F.col("n_chars").alias("bytes")))


@query("""SELECT p_partkey, 'snd://' || replace(p_brand, '#', '%23') || '/' || replace(p_name, ' ', '%20') || '.mp3' AS url, p_brand AS source, p_name || '.mp3' AS file, 'mp3' AS extension, 'audio/mpeg' AS mime FROM part""")
def t17_audio_urls(spark, sf_dir):
    file = F.concat("p_name", F.lit(".mp3"))
    out = table(spark, sf_dir, "part").select("p_partkey", T.audio_url("snd", F.col("p_brand"), file).alias("url"))
    source, name = T.parse_audio_url(F.col("url"), "snd")
    return out.select("p_partkey", "url", source.alias("source"), name.alias("file"), T.audio_extension(name).alias("extension"), T.mime_type(name).alias("mime"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'ja' WHEN doc_id % 4 = 1 THEN 'ko' WHEN doc_id % 4 = 2 THEN 'zh' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE '' END AS language, 'てすと' AS kana FROM documents""")
def t10_language(spark, sf_dir):
    mark = F.element_at(F.array(*map(F.lit, ("漢字かな", "한글漢", "漢字", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.language_of(F.concat("text", mark)).alias("language"), T.hiragana(F.lit("テスト")).alias("kana"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 1000) AS BIGINT) / 1000.0 AS seconds FROM lineitem")
def t20_srt_times(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.srt_stamp(F.col("l_extendedprice")).alias("stamp"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round(T.srt_seconds(F.col("stamp")), 3).alias("seconds"))


@query("SELECT p_partkey, ['png', 'gif', 'bmp', 'webp', 'jpeg'][p_partkey % 5 + 1] AS kind FROM part")
def t23_image_type(spark, sf_dir):
    magic = F.element_at(F.array(*map(F.lit, ("89504E470D", "4749463839", "424D000000", "5249464600", "FFD8FFE000"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.image_type(F.unhex(magic)).alias("kind"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand || '_ ' || p_name END AS name FROM part")
def t16_storage_name(spark, sf_dir):
    title = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_brand", F.lit(": "), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.storage_name(title).alias("name"))
