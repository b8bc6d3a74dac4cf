"""Books: chapters with counted text, positions, labels, sections, highlights and search.

Tables are keyed by `book`.  Chapters have `ord` (spine order), `href`, `html`; facts have `start` and `count` in counted characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readlake.functions import text as T
from readlake.sources.staging import Staging

BEFORE = (Window.unboundedPreceding, -1)


def book_facts(chapters: DataFrame) -> DataFrame:
    """Counted characters, start and book total of each chapter."""
    order, whole = Window.partitionBy("book").orderBy("ord"), Window.partitionBy("book")
    counted = chapters.select("book", "ord", "href", F.length(T.matchable_text(F.col("html"))).cast("bigint").alias("count"))
    return counted.withColumn("start", F.coalesce(F.sum("count").over(order.rowsBetween(*BEFORE)), F.lit(0))).withColumn("total", F.sum("count").over(whole))


def book_images(chapters: DataFrame) -> DataFrame:
    """Distinct image paths of each book with the place where each is first seen."""
    seen = chapters.select("book", "ord", F.posexplode(T.image_paths(F.col("html"))).alias("at", "path"))
    first = seen.groupBy("book", "path").agg(F.min(F.struct("ord", "at")).alias("first"))
    return first.select("book", "path", (F.row_number().over(Window.partitionBy("book").orderBy("first")) - 1).cast("bigint").alias("place"))


def facts_valid(facts: DataFrame) -> DataFrame:
    """Whether each book's chapter starts follow from its counts and end at its total."""
    order = Window.partitionBy("book").orderBy("ord")
    expected = F.coalesce(F.lag("start").over(order) + F.lag("count").over(order), F.lit(0))
    checked = facts.withColumn("ok", (F.col("start") == expected) & (F.col("count") >= 0))
    return checked.groupBy("book").agg((F.every("ok") & (F.max(F.col("start") + F.col("count")) == F.max("total"))).alias("valid"))


def narrative_chapters(chapters: DataFrame) -> DataFrame:
    """Linear chapters that are not a table of contents, a caution or a colophon."""
    nav = F.array_contains(F.split(F.lower(F.coalesce("properties", F.lit(""))), r"\s+"), "nav")
    return chapters.where(F.col("linear") & ~F.col("is_guide_toc") & ~nav & ~F.lower("href").rlike("toc|caution|colophon"))


def resolve_position(positions: DataFrame, facts: DataFrame) -> DataFrame:
    """Chapter and progress of a book-wide character: held inside the book, chapters without characters skipped."""
    held = F.greatest(F.lit(0), F.least(F.col("character"), F.col("total") - 1))
    c = facts.where("count > 0").select("book", F.col("ord").alias("chapter"), "start", "count", "total")
    out = positions.join(c, "book").where((held >= F.col("start")) & (held < F.col("start") + F.col("count")))
    return out.withColumn("progress", (held - F.col("start")) / F.col("count")).drop("start", "count", "total")


def locate_or_last(positions: DataFrame, facts: DataFrame) -> DataFrame:
    """Chapter and progress of a character; past the end it is the last chapter, with progress held to 0..1."""
    last = facts.groupBy("book").agg(F.max_by(F.struct("ord", "start", "count"), "ord").alias("l"))
    c = facts.where("count > 0").select("book", F.col("ord").alias("chapter"), "start", "count")
    inside = (F.col("p.book") == F.col("c.book")) & (F.col("character") >= F.col("start")) & (F.col("character") < F.col("start") + F.col("count"))
    out = positions.alias("p").join(c.alias("c"), inside, "left").select("p.*", "chapter", "start", "count").join(last, "book")
    chapter, start, count = F.coalesce("chapter", "l.ord"), F.coalesce("start", "l.start"), F.coalesce("count", "l.count")
    progress = F.when(count > 0, F.least(F.greatest((F.col("character") - start) / count, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return out.select(*positions.columns, chapter.alias("chapter"), progress.alias("progress"))


def chapter_labels(chapters: DataFrame, toc: DataFrame) -> DataFrame:
    """(book, ord, label, section): the label of a chapter's first contents entry (its top-level heading), and that of the nearest labelled chapter before."""
    hits = toc.select("book", F.col("ord").alias("entry"), "top_label", T.href_base(F.col("href")).alias("base")).where("base != ''")
    own = chapters.select("book", "ord", T.href_base(F.col("href")).alias("base")).join(hits, ["book", "base"])
    first = own.groupBy("book", "ord").agg(F.min_by("top_label", "entry").alias("label"))
    order = Window.partitionBy("book").orderBy("ord")
    labelled = chapters.select("book", "ord").join(first, ["book", "ord"], "left")
    return labelled.withColumn("section", F.coalesce(F.last("label", ignorenulls=True).over(order), F.lit("")))


def resolve_href(links: DataFrame, chapters: DataFrame) -> DataFrame:
    """The first chapter whose path equals a link's or ends in it after a slash, or the other way round."""
    def suffixes(base: Column) -> Column:
        parts = F.split(base, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))

    a = links.withColumn("base", T.href_base(F.col("href"))).where("base != ''")
    b = chapters.select("book", F.col("ord").alias("chapter"), T.href_base(F.col("href")).alias("chapter_base"))
    down = a.withColumn("key", F.explode(suffixes(F.col("base")))).join(b.withColumnRenamed("chapter_base", "key"), ["book", "key"])
    up = a.withColumn("key", F.col("base")).join(b.select("book", "chapter", F.explode(suffixes(F.col("chapter_base"))).alias("key")), ["book", "key"])
    found = down.select(*links.columns, "chapter").unionByName(up.select(*links.columns, "chapter"))
    return found.groupBy(*links.columns).agg(F.min("chapter").alias("chapter"))


def toc_range(positions: DataFrame, facts: DataFrame, starts: DataFrame) -> DataFrame:
    """Contents range around a position (book, chapter, character): start and end, and characters read and left in it.

    starts: (book, start) of contents entries; 0 always counts as one.  The position is held before its chapter's end.
    """
    ends = facts.select("book", F.col("ord").alias("chapter"), (F.col("start") + F.col("count")).alias("chapter_end"), "count", "total")
    all_starts = starts.select("book", "start").unionByName(facts.select("book", F.lit(0).cast("bigint").alias("start"))).distinct()
    own = positions.join(ends, ["book", "chapter"]).withColumn("anchor", F.when(F.col("count") > 0, F.least("character", F.col("chapter_end") - 1)).otherwise(F.col("character")))
    total = facts.groupBy("book").agg(F.max("total").alias("book_total"))
    spans = all_starts.join(total, "book").where("start = 0 or start < book_total").withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy("book").orderBy("start")), "book_total"))
    out = own.join(spans, "book").where("anchor >= start and (anchor < end or end = book_total)")
    size = F.greatest(F.col("end") - F.col("start"), F.lit(0))
    current = F.least(F.greatest(F.col("character") - F.col("start"), F.lit(0)), size)
    return out.select(*positions.columns, F.col("start").alias("range_start"), F.col("end").alias("range_end"), current.alias("current"), (size - current).alias("remaining"))


def chapter_highlights(highlights: DataFrame, facts: DataFrame) -> DataFrame:
    """Highlights of each chapter in order of position."""
    placed = locate_or_last(highlights, facts)
    row = F.struct("character", "id", "text", "color")
    return placed.groupBy("book", "chapter").agg(F.array_sort(F.collect_list(row)).alias("highlights"))


def highlight_sections(highlights: DataFrame, facts: DataFrame, labels: DataFrame) -> DataFrame:
    """Highlights counted by section: the labelled chapter at or before theirs; sections in book order."""
    placed = locate_or_last(highlights, facts)
    opened = labels.withColumn("opener", F.coalesce(F.last(F.when(F.col("label").isNotNull(), F.col("ord")), ignorenulls=True).over(Window.partitionBy("book").orderBy("ord")), F.lit(-1)))
    out = placed.join(opened.select("book", F.col("ord").alias("chapter"), "opener", "section"), ["book", "chapter"])
    return out.groupBy("book", "opener", "section").agg(F.count("*").alias("n"), F.min("character").alias("first"))


def export_sections(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """Sections of a book: a labelled chapter opens one, others join the last, chapters before the first form 'Preface'.

    weight: counted characters of each section's opener, at least 1; characters: to the next opener, or the book's end.
    """
    order = Window.partitionBy("book").orderBy("ord")
    rows = facts.join(labels.select("book", "ord", "label"), ["book", "ord"], "left").withColumn("n", F.row_number().over(order))
    opener = F.col("label").isNotNull() | (F.col("n") == 1)
    openers = rows.where(opener).withColumn("label", F.coalesce("label", F.lit("Preface")))
    return openers.select("book", "ord", "label", "start", F.greatest("count", F.lit(1)).alias("weight"), (F.coalesce(F.lead("start").over(order), F.col("total")) - F.col("start")).alias("characters"))


def paragraphs(chapters: DataFrame) -> DataFrame:
    """(book, ord, line, text, character): trimmed paragraphs with text, and the counted characters of the book before each."""
    lines = chapters.select("book", "ord", F.posexplode(F.split(T.visible_text(F.col("html"), True), "[\n\r]")).alias("line", "text")).withColumn("text", F.trim("text"))
    lines = lines.withColumn("n", F.length(T.counted_text(F.col("text"))).cast("bigint"))
    sums = lines.groupBy("book", "ord").agg(F.sum("n").alias("in_chapter"))
    sums = sums.withColumn("before", F.coalesce(F.sum("in_chapter").over(Window.partitionBy("book").orderBy("ord").rowsBetween(*BEFORE)), F.lit(0))).drop("in_chapter")
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("book", "ord").orderBy("line").rowsBetween(*BEFORE)), F.lit(0))
    return lines.withColumn("inner", inner).join(sums, ["book", "ord"]).where("text != ''").select("book", "ord", "line", "text", (F.col("before") + F.col("inner")).alias("character"))


#: Sentence ends, what may follow them, and brackets that open and close in pairs.
SENTENCE_ENDS = "。！？.!?\n\r"
CLOSERS = "。、！？」』）)】〉》〕｝}］]"
BRACKETS = "「」『』（）()【】〈〉《》〔〕｛｝{}［］[]"
OPENING, CLOSING = BRACKETS[::2], BRACKETS[1::2]


def one_of(characters: str, but: bool = False) -> str:
    """A regular expression for one of some characters, or for any other."""
    return "[" + "^" * but + "".join(f"\\x{{{ord(c):x}}}" for c in characters) + "]"


def loose_brackets(text: Column) -> Column:
    """Brackets of a text that have no partner: a struct of open ones and closing ones, both in order."""
    only = F.regexp_replace(text, one_of(BRACKETS, but=True), "")

    def step(state: Column, c: Column) -> Column:
        inner = F.length(state["opened"]) - 1
        partner = F.translate(F.substring(state["opened"], inner + 1, F.lit(1)), OPENING, CLOSING)
        return (
            F.when(F.lit(OPENING).contains(c), F.struct(F.concat(state["opened"], c).alias("opened"), state["closed"].alias("closed")))
            .when(partner == c, F.struct(F.substring(state["opened"], F.lit(1), inner).alias("opened"), state["closed"].alias("closed")))
            .otherwise(F.struct(state["opened"].alias("opened"), F.concat(state["closed"], c).alias("closed")))
        )

    start = F.struct(F.lit("").alias("opened"), F.lit("").alias("closed"))
    return F.aggregate(F.filter(F.split(only, ""), lambda c: c != ""), start, step)


def with_sentences(rows: DataFrame) -> DataFrame:
    """Rows (text, start, end, ...) with first and last, bounds of the sentence around [start, end): back to a sentence end, on to the next with closers after it, trimmed.

    Brackets without a partner go where they stand at its very beginning, or at its end but for sentence ends; then it is trimmed again.
    Steps that are used more than once are columns, so that they are worked out once a row, and no pattern is tried from every place.
    """
    text, start, end = F.col("text"), F.col("start"), F.col("end")
    # what stands before is read backwards from the hit
    before = F.reverse(F.regexp_extract(F.reverse(F.substring(text, F.lit(1), start)), f"^{one_of(SENTENCE_ENDS, but=True)}*", 0))
    after = F.regexp_extract(F.substring(text, end + 1, F.length(text)), f"^{one_of(SENTENCE_ENDS, but=True)}*({one_of(SENTENCE_ENDS)}{one_of(CLOSERS)}*)?", 0)
    rows = rows.withColumns({"__lead": F.ltrim(before, F.lit(_BLANK)), "__trail": F.rtrim(after, F.lit(_BLANK))})
    lead, trail, loose = F.col("__lead"), F.col("__trail"), F.col("__loose")
    rows = rows.withColumn("__loose", loose_brackets(F.concat(lead, F.substring(text, start + 1, end - start), trail)))
    # the beginning goes as far as it spells the loose opening brackets
    spelled = F.transform(F.split(loose["opened"], ""), lambda c, i: F.substring(lead, i + 1, F.lit(1)) == c)
    rows = rows.withColumn("__wrong", F.array_position(spelled, F.lit(False)).cast("int"))
    wrong = F.col("__wrong")
    cut = F.when(loose["opened"] == "", 0).otherwise(F.when(wrong == 0, F.length(loose["opened"])).otherwise(wrong - 1))

    def back(state: Column, c: Column) -> Column:
        hit = c == F.substring(state["closed"], F.length(state["closed"]), F.lit(1))
        ok = ~state["over"] & (state["closed"] != "")
        seen = state["seen"] + 1
        return (
            F.when(ok & hit, F.struct(F.substring(state["closed"], F.lit(1), F.length(state["closed"]) - 1).alias("closed"), seen.alias("seen"), seen.alias("gone"), state["over"].alias("over")))
            .otherwise(F.struct(state["closed"].alias("closed"), seen.alias("seen"), state["gone"].alias("gone"), (~ok | ~F.lit(SENTENCE_ENDS).contains(c)).alias("over")))
        )

    at_end = F.struct(loose["closed"].alias("closed"), F.lit(0).alias("seen"), F.lit(0).alias("gone"), F.lit(False).alias("over"))
    # only brackets and sentence ends at the end can go
    tail = F.regexp_extract(trail, f"{one_of(SENTENCE_ENDS + CLOSING)}*$", 0)
    gone = F.aggregate(F.filter(F.split(F.reverse(tail), ""), lambda c: c != ""), at_end, back)["gone"]
    kept_lead = F.ltrim(F.substring(lead, cut + 1, F.length(lead)), F.lit(_BLANK))
    kept_trail = F.rtrim(F.substring(trail, F.lit(1), F.length(trail) - gone), F.lit(_BLANK))
    return rows.withColumn("first", start - F.length(kept_lead)).withColumn("last", end + F.length(kept_trail)).drop("__lead", "__trail", "__loose", "__wrong")


_BLANK = " \t\n\x0b\x0c\r\u3000\xa0"
GRAMS = (8, 3, 2, 1)  # sizes of the strings by which queries find paragraphs
FEW_GRAMS = 1_000_000  # 8 MB
PLACES = 21  # 2 MB of marks


def folded(text: Column) -> Column:
    """Lower case, character by character: the capital dotted I and the final sigma would else change with their surroundings."""
    return F.translate(F.lower(F.translate(text, "İ", "i")), "ς", "σ")


def gram_hashes(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all strings of size characters of some texts, and the text that each is of."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    hashes = np.zeros(max(len(points) - size + 1, 0), np.uint64)
    for k in range(size):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + points[k : k + len(hashes)] + np.uint64(1)
    text = np.repeat(np.arange(len(texts)), lengths)[: len(hashes)]
    inside = np.arange(len(hashes)) + size <= np.cumsum(lengths)[text]  # not across two texts
    return hashes[inside].view(np.int64), text[inside]


def places(grams: np.ndarray) -> np.ndarray:
    """Places of 64-bit hashes in a table of 2 ** PLACES marks."""
    return ((grams.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - PLACES)).view(np.int64)


def marked(grams: np.ndarray) -> np.ndarray:
    """The table with the places of some hashes marked: what is not marked is none of them."""
    table = np.zeros(1 << PLACES, bool)
    table[places(grams)] = True
    return table


def gram_rows(rows: DataFrame, key: str, text: str, size: int, among: np.ndarray | None = None) -> DataFrame:
    """(key, gram): distinct hashes of the strings of size characters of a text, those among some sorted ones if given.

    In Arrow batches, since built-in functions go through a text character by character in an interpreted lambda.
    """
    some = None if among is None or not len(among) else marked(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, of = gram_hashes(batch.column(1).to_pylist(), size)
            if some is not None:  # most grams are not even in a marked place
                near = np.flatnonzero(some[places(grams)])
                grams, of = grams[near], of[near]
            if among is not None:
                at = np.minimum(np.searchsorted(among, grams), len(among) - 1)
                grams, of = (x[among[at] == grams] for x in (grams, of))
            order = np.lexsort((grams, of))
            grams, of = grams[order], of[order]
            new = np.ones(len(grams), bool)
            new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[new])), pa.array(grams[new])], [key, "gram"])

    return rows.select(key, text).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, gram bigint")


def _candidates(rows: DataFrame, wanted: DataFrame, staging: Staging) -> DataFrame:
    """(query_id, needle, __line): lines that have the one of a query's grams that fewest lines have; rows of grams hold no text.

    While FEW_GRAMS holds the grams of all queries they go to every task, and only lines' grams among them leave it; beyond, both sides
    are shuffled.
    """
    found = None
    for k in sorted(r["size"] for r in wanted.select("size").distinct().collect()):  # GRAMS at most
        asked = staging.keep(gram_rows(wanted.where(F.col("size") == k), "query_id", "needle", k))
        known = asked.select("gram").distinct()
        some = [r.gram for r in known.limit(FEW_GRAMS + 1).collect()]
        if len(some) <= FEW_GRAMS:
            postings = gram_rows(rows, "__line", "low", k, np.sort(np.array(some, np.int64)))
        else:
            postings = gram_rows(rows, "__line", "low", k).join(known, "gram", "left_semi")
        postings = staging.keep(postings)
        often = postings.groupBy("gram").agg(F.count("*").alias("often"))
        rarest = asked.join(often, "gram", "left").groupBy("query_id").agg(F.min_by("gram", F.struct("often", "gram")).alias("gram"), F.min(F.coalesce("often", F.lit(0))).alias("least"))
        part = postings.join(rarest.where("least > 0").drop("least"), "gram").drop("gram")  # where some gram of a query is nowhere, so is the query
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = wanted.select(F.lit(0).cast("bigint").alias("__line"), "query_id").limit(0)
    return found.join(wanted.select("query_id", "needle"), "query_id")


def search(lines: DataFrame, queries: DataFrame, most: int = 100) -> DataFrame:
    """Literal, case-insensitive, non-overlapping hits of queries (query_id, query) in paragraphs, `most` for each query and book.

    Paragraphs are numbered and written once.  A paragraph and a query meet by the number and one of the query's grams, strings of the
    largest size in GRAMS that it has; then paragraphs are fetched by number and the whole query is looked for.  Blank queries have no
    hits.
    """
    staging = Staging(lines.sparkSession)
    needle = queries.select("query_id", folded(F.trim("query")).alias("needle")).where("needle != ''")
    length = F.length("needle")
    wanted = staging.keep(needle.withColumn("size", F.coalesce(*[F.when(length >= k, k) for k in GRAMS])))
    rows = staging.keep(lines.withColumn("low", folded(F.col("text"))).withColumn("__line", F.monotonically_increasing_id()))
    found = rows.join(_candidates(rows, wanted, staging), "__line").drop("__line")
    hits = found.where(F.col("low").contains(F.col("needle")))
    literal = F.concat(F.lit("\\Q"), F.replace("needle", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pieces = F.split("low", literal)
    sizes = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), F.length)
    hits = hits.select("*", F.posexplode(sizes).alias("k", "gap"), sizes.alias("sizes"))
    start = F.aggregate(F.slice("sizes", 1, F.col("k") + 1), F.lit(0), lambda a, x: a + x) + F.col("k") * F.length("needle")
    hits = hits.withColumn("start", start).withColumn("end", F.col("start") + F.length("needle"))
    place = F.row_number().over(Window.partitionBy("query_id", "book").orderBy("ord", "line", "start"))
    hits = hits.withColumn("place", place).where(F.col("place") <= min(most, 100)).drop("place")
    counted = lambda s: F.length(T.counted_text(s)).cast("bigint")
    hits = with_sentences(hits)
    return hits.select(
        "query_id", "book", "ord", "line", "start", (F.col("character") + counted(F.substring("text", F.lit(1), F.col("start")))).alias("character"), F.substring("text", F.col("first") + 1, F.col("last") - F.col("first")).alias("snippet"),
        (F.col("start") - F.col("first")).cast("bigint").alias("snippet_start"), (F.col("end") - F.col("first")).cast("bigint").alias("snippet_end"), counted(F.substring("text", F.col("start") + 1, F.length("needle"))).alias("match_length"),
    )


def reading_progress(bookmarks: DataFrame, facts: DataFrame) -> DataFrame:
    """Share of each book that is read, 0 where unknown."""
    totals = facts.groupBy("book").agg(F.max("total").alias("total"))
    out = totals.join(bookmarks.select("book", "character"), "book", "left")
    return out.select("book", F.when(F.col("total") > 0, F.least(F.greatest(F.coalesce("character", F.lit(0)) / F.col("total"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("progress"))


def mark_read(facts: DataFrame) -> DataFrame:
    """The bookmark of a read book: its last chapter, progress 1, all characters."""
    return facts.groupBy("book").agg(F.max("ord").alias("chapter"), F.lit(1.0).alias("progress"), F.max("total").alias("character"))


def match_coverage(matches: DataFrame, facts: DataFrame, cues: DataFrame) -> DataFrame:
    """Share of a book's characters under cue matches, and cues without one."""
    totals = facts.groupBy("book").agg(F.max("total").alias("total"))
    sums = matches.groupBy("book").agg(F.sum("length").alias("matched"), F.count("*").alias("n"))
    asked = cues.groupBy("book").agg(F.count("*").alias("cues"))
    out = totals.join(asked, "book").join(sums, "book", "left").fillna(0, ["matched", "n"])
    return out.select("book", F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(0.0).alias("coverage"), (F.col("cues") - F.col("n")).alias("unmatched"))
