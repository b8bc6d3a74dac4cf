"""Dictionary, frequency, pitch and word-audio lookups over tables of terms.

Ranking and matching by prefixes are ours to define (longest match, then frequency, dictionary order, expression); joins stay equi
joins: alternatives become unions of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readlake.functions import text as T

UNRANKED = 9999999


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


FEW_SOURCES = 10_000


def supported_audio(entries: DataFrame, disabled: DataFrame | None = None) -> DataFrame:
    """Entries of supported types from sources that are not disabled."""
    out = entries.where(T.audio_extension(F.col("file")).isin("mp3", "opus", "ogg"))
    return out if disabled is None else out.join(disabled.select("source"), "source", "left_anti")


def rank_audio(requests: DataFrame, entries: DataFrame, source_order: DataFrame, every: bool = False) -> DataFrame:
    """Word audio for requests (request_id, term, reading): rank 0 exact, 1 by reading, 2 by expression; then source order, reading, file.

    Best entry of each request, or all with distinct files.  source_order: (source, place).  Requests that ask the same are ranked
    once; for the best entry alone, entries of one expression and reading are first brought down to the best of them.
    """
    asked = requests.select("request_id", "term", T.hiragana(F.coalesce("reading", F.lit(""))).alias("wanted"))
    rows = supported_audio(entries).join(F.broadcast(source_order) if source_order.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES else source_order, "source", "left")
    place = F.coalesce(F.col("place").cast("bigint"), F.lit(2147483647))
    if not every:
        rows = top_n_per_key(rows, ["expression", "reading"], [place, F.col("source"), F.col("file")], 1)
    questions = asked.select("term", "wanted").distinct()
    by_term = questions.join(rows, F.col("term") == F.col("expression"))
    by_reading = questions.where("trim(wanted) != ''").join(rows, (F.col("wanted") == F.col("reading")) & (F.trim("reading") != "") & (F.col("term") != F.col("expression")))
    both = by_term.unionByName(by_reading)
    same, heard = F.col("expression") == F.col("term"), (F.trim("wanted") != "") & F.coalesce(F.col("reading") == F.col("wanted"), F.lit(False))
    rank = F.when((F.trim("wanted") == "") & same, 0).when(same & (F.col("reading").isNull() | heard), 0).when(heard, 1).when(same, 2).otherwise(3)
    order = [F.col("rank"), place, F.coalesce("reading", F.lit("")), F.col("source"), F.col("file")]
    ranked = both.withColumn("rank", rank)
    if every:
        best = _numbered(_first_of_file(ranked, order), place)
    else:
        best = top_n_per_key(ranked, ["term", "wanted"], order, 1)
    return asked.join(best, ["term", "wanted"])


def _first_of_file(ranked: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The first row of each file of a question; told by what stands before it, since a limit by rank would also sort what the join makes, in the join's task."""
    before = F.lag(F.lit(True)).over(Window.partitionBy("term", "wanted", "source", "file").orderBy(*order))
    return ranked.withColumn("again", before.isNotNull()).where("not again").drop("again")


def _numbered(first: DataFrame, place: Column) -> DataFrame:
    """n of each row of its question, by rank, place, reading, source and file: rows are sorted within one reading of a source, and readings by their counts."""
    rows = first.withColumn("__place", place).withColumn("__reading", F.coalesce("reading", F.lit("")))
    rows = rows.withColumn("__named", F.col("source").isNotNull()).withColumn("__source", F.coalesce("source", F.lit("")))
    key = ["term", "wanted", "rank", "__place", "__reading", "__named", "__source"]
    parts = rows.groupBy(*key).agg(F.count("*").alias("__size"))
    parts = parts.withColumn("__before", F.sum("__size").over(Window.partitionBy("term", "wanted").orderBy(*key[2:])) - F.col("__size")).drop("__size")
    within = F.row_number().over(Window.partitionBy(*key).orderBy("file")).cast("bigint")
    return rows.withColumn("__within", within).join(parts, key).withColumn("n", F.col("__before") + F.col("__within")).drop(*key[3:], "__before", "__within")


def repair_order(current: DataFrame, available: DataFrame, priority: DataFrame) -> DataFrame:
    """Source order after a change: known sources in their order, then new ones by built-in priority and name."""
    kept = available.join(current, "source").select("source", F.struct(F.lit(0).alias("g"), F.col("place").cast("bigint").alias("p"), F.col("source").alias("s")).alias("k"))
    new = available.join(current, "source", "left_anti").join(priority, "source", "left").select("source", F.struct(F.lit(1).alias("g"), F.coalesce(F.col("priority").cast("bigint"), F.lit(1 << 40)).alias("p"), F.col("source").alias("s")).alias("k"))
    return kept.unionByName(new).select("source", (F.row_number().over(Window.orderBy("k")) - 1).cast("bigint").alias("place"))


def term_scan(texts: DataFrame, terms: DataFrame, frequencies: DataFrame, scan_length: int = 16, max_results: int = 16) -> DataFrame:
    """Terms that are prefixes of texts (text_id, text): longest first, then frequency (least value), dictionary order and expression.

    terms: (dict, dict_order, expression, reading, glossary); frequencies: (expression, value).
    """
    # texts that begin alike are scanned once, and of one expression's terms no more than max_results can be among the results
    heads = texts.select("text_id", F.substring("text", 1, scan_length).alias("head")).where("head != ''")
    prefixes = heads.select("head").distinct().select("head", F.explode(F.sequence(F.lit(1), F.length("head"))).alias("length"))
    prefixes = prefixes.withColumn("expression", F.substring("head", F.lit(1), F.col("length")))
    best = frequencies.groupBy("expression").agg(F.min("value").alias("frequency"))
    within = [F.asc("dict_order"), F.asc("reading"), F.asc("glossary")]
    few = top_n_per_key(terms, ["expression"], within, max_results)
    found = prefixes.join(few, "expression").join(best, "expression", "left")
    order = [F.desc("length"), F.asc_nulls_last("frequency"), F.asc("dict_order"), F.asc("expression"), F.asc("reading"), F.asc("glossary")]
    place = F.row_number().over(Window.partitionBy("head").orderBy(*order)).cast("bigint")
    ranked = found.withColumn("place", place).where(F.col("place") <= max_results)
    return heads.join(ranked, "head").select("text_id", *[c for c in ranked.columns if c != "head"])


def kanji_lookup(characters: DataFrame, kanji: DataFrame) -> DataFrame:
    """Entries of each character by dictionary."""
    row = F.struct("dict", "onyomi", "kunyomi")
    return characters.join(kanji, "character").groupBy("character").agg(F.array_sort(F.collect_set(row)).alias("entries"))


def harmonic_rank(frequencies: DataFrame) -> DataFrame:
    """Harmonic mean rank of each expression over dictionaries: one value each (the first), shown digits before the number; 9999999 without any."""
    shown = F.regexp_extract("display", r"^(\d+)", 1).try_cast("bigint")
    value = F.when(shown > 0, shown).when(F.col("value") > 0, F.col("value"))
    first = frequencies.groupBy("expression", "dict").agg(F.min_by(F.struct("display", "value"), "ord").alias("f")).select("expression", "dict", "f.*")
    out = first.withColumn("v", value).groupBy("expression").agg(F.count("v").alias("n"), F.sum(1.0 / F.col("v")).alias("s"))
    return out.select("expression", F.when(F.col("n") > 0, F.floor(F.round(F.col("n") / F.col("s"), 6))).otherwise(UNRANKED).cast("bigint").alias("rank"))


def pitch_categories(pitches: DataFrame) -> DataFrame:
    """Distinct categories of each expression in order of first appearance, joined by commas."""
    rows = pitches.withColumn("category", T.pitch_category(F.col("reading"), F.col("position"), F.col("inflected"))).where("category is not null")
    ordered = rows.groupBy("expression").agg(F.array_sort(F.collect_list(F.struct("ord", "category"))).alias("c"))
    return ordered.select("expression", F.array_join(F.array_distinct(F.transform("c", lambda x: x["category"])), ",").alias("categories"))


def effective_dictionaries(stored: DataFrame, config: DataFrame) -> DataFrame:
    """Stored dictionaries in configured order, then those without configuration, enabled, by name."""
    known = stored.join(config, "name").select("name", "enabled", F.struct(F.lit(0).alias("g"), F.col("place").cast("bigint").alias("p"), F.col("name").alias("n")).alias("k"))
    new = stored.join(config, "name", "left_anti").select("name", F.lit(True).alias("enabled"), F.struct(F.lit(1).alias("g"), F.lit(0).cast("bigint").alias("p"), F.col("name").alias("n")).alias("k"))
    return known.unionByName(new).select("name", "enabled", (F.row_number().over(Window.orderBy("k")) - 1).cast("bigint").alias("place"))


def enabled_dictionaries(dictionaries: DataFrame, terms: bool = True) -> DataFrame:
    out = dictionaries.where("enabled")
    return out.where("category != 'exclude'") if terms else out


def updatable(index: DataFrame) -> DataFrame:
    """Dictionaries marked as updatable with both addresses."""
    return index.where(F.col("updatable") & (F.trim(F.coalesce("index_url", F.lit(""))) != "") & (F.trim(F.coalesce("download_url", F.lit(""))) != ""))


def outdated_dictionaries(installed: DataFrame, remote: DataFrame) -> DataFrame:
    """State of each installed dictionary against the remote index: current, outdated, renamed or failed (no answer)."""
    out = installed.join(remote.select("index_url", F.col("title").alias("remote_title"), F.col("revision").alias("remote_revision")), "index_url", "left")
    state = F.when(F.col("remote_revision").isNull(), "failed").when(F.col("remote_revision") == F.col("revision"), "current").when(F.col("remote_title") != F.col("title"), "renamed").otherwise("outdated")
    return out.select("title", "index_url", state.alias("state"))


def glossary_by_name(requests: DataFrame, glossaries: DataFrame) -> DataFrame:
    """The glossary of a dictionary by exact name, else by name without a trailing [...] note."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s*\[[^\]]*\]\s*$", ""))
    exact = glossaries.groupBy(F.col("dict").alias("name")).agg(F.min("glossary").alias("exact"))
    loose = glossaries.groupBy(plain(F.col("dict")).alias("plain")).agg(F.min("glossary").alias("loose"))
    out = requests.withColumn("plain", plain(F.col("name"))).join(exact, "name", "left").join(loose, "plain", "left")
    return out.select(*requests.columns, F.coalesce("exact", "loose").alias("glossary"))


def first_glossary(glossaries: DataFrame, dictionaries: DataFrame, category: str | None = None, fallback: str | None = None) -> DataFrame:
    """The first glossary of each term by dictionary order: of a category, else of the fallback; never of excluded dictionaries."""
    rows = glossaries.join(dictionaries.where("category != 'exclude'"), "dict")
    tier = F.lit(0) if category is None else F.when(F.col("category") == category, 0).when(F.lit(fallback is not None) & (F.col("category") == (fallback or "")), 1)
    rows = rows.withColumn("tier", tier).where("tier is not null")
    return rows.groupBy("term").agg(F.min_by("glossary", F.struct("tier", "place", "glossary")).alias("glossary"))


def dictionary_types(counts: DataFrame) -> DataFrame:
    """Kinds of content with a count above zero."""
    kinds = [F.when(F.col(c) > 0, F.lit(c)) for c in ("terms", "frequencies", "pitches", "kanji")]
    return counts.select("dict", F.array_join(F.array_compact(F.array(*kinds)), ",").alias("types"))


def book_profile(books: DataFrame, profiles: DataFrame, active: str) -> DataFrame:
    """The primary profile of a book's language, else the active one."""
    base = F.lower(F.split(F.coalesce("language", F.lit("")), "[-_]")[0])
    primary = profiles.where("is_primary").groupBy(F.col("language").alias("base")).agg(F.min("profile").alias("profile"))
    return books.withColumn("base", base).join(primary, "base", "left").select("book", F.coalesce("profile", F.lit(active)).alias("profile"))


def duplicate_notes(candidates: DataFrame, notes: DataFrame, decks: DataFrame, scope: str = "collection", all_models: bool = False) -> DataFrame:
    """Candidates (candidate_id, field, model, deck) whose first field a note in scope has: collection, deck, or deck_root.

    notes: (note_id, model, deck, checksum); decks: (deck, name).  Blank fields never are duplicates.
    """
    asked = candidates.withColumn("checksum", T.note_checksum(F.col("field"))).where((F.col("checksum") != 0) & (F.trim(T.note_text(F.col("field"))) != ""))
    root = lambda c: F.substring_index(c, "::", 1)
    have = notes
    keys = ["checksum"] + ([] if all_models else ["model"])
    if scope == "deck":
        keys.append("deck")
    elif scope == "deck_root":
        roots = decks.select("deck", root(F.col("name")).alias("root"))
        asked, have = asked.join(roots, "deck"), have.join(roots, "deck")
        keys.append("root")
    return asked.join(have.select(*keys).distinct(), keys, "left_semi").select("candidate_id")


def propagate_renames(settings: DataFrame, renames: DataFrame) -> DataFrame:
    """Settings rows (id, dict) with old dictionary titles replaced by new ones."""
    out = settings.join(renames.select(F.col("old").alias("dict"), "new"), "dict", "left")
    return out.select("id", F.coalesce("new", "dict").alias("dict"))


def active_mappings(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A map column `mappings` with the fields of the note type only."""
    return df.withColumn("mappings", F.map_filter("mappings", lambda k, _: k.isin(*fields)))
