"""Text of readers in detail: cue boundaries, spoken projections, raw ranges, furigana, lists for cards, defaults of card fields."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from pyspark.sql.window import Window

from readlake.functions import text as T
from readlake.operators.books import one_of

#: Characters after which a cue may end, and those of them that count as commas.
CUE_ENDS = "。！？!?…」』「『（\n、，,"
COMMAS = "、，,"
#: Punctuation that belongs to the character after it, to the one before it, or to the one it hangs on.
OPENS = "「『（〔［｛〈《【〖〘〚“‘｢([{"
TRAILS = "」』）〕］｝〉》】〗〙〛”’｣)]}。、，．！？!?‼⁇⁈⁉､｡・･：；:;"
HANGS = "…‥—―–─〜～"
#: White space of every script, after which a hanging mark goes with the next character.
WHITE = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: What ends a scan in English text, and which of these may stand inside a word.
ENGLISH_ENDS = "\"“”„‟'‘’‚‛«»‹›!?—–-‐‑‒/\\|@#$%^&*_+=~`<>"
IN_WORDS = "'’`-‐‑"
JAPANESE = r"\x{3040}-\x{30FF}\x{FF66}-\x{FF9D}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3005}-\x{3007}"
BREAKABLE = r"[\x{3000}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"
PERCENT = "ぱーせんと"
AT_ONCE = 1 << 19  # characters that a task works on at once


@F.pandas_udf(ArrayType(LongType()))
def running(steps: pd.Series) -> pd.Series:
    """Running sums of each row's array: a text's places are found in its own row, without a shuffle of its characters."""
    return steps.map(lambda x: None if x is None else np.cumsum(x))


def cue_boundaries(chapters: DataFrame, at_commas: bool = True) -> DataFrame:
    """(book, ord, at): counted characters of a chapter (book, ord, html) after which a cue may end; the last one always."""
    ends = one_of("".join(c for c in CUE_ENDS if at_commas or c not in COMMAS))
    visible = T.visible_text(F.col("html"), True)
    marked = F.regexp_replace(F.regexp_replace(visible, ends, "\n"), f"[^{T.COUNTED}\n]", "")
    parts = F.filter(F.split(marked, "\n+"), lambda x: x != "")
    to = running(F.transform(parts, lambda x: F.length(x).cast("bigint")))
    return chapters.select("book", "ord", F.explode(to).alias("to")).select("book", "ord", (F.col("to") - 1).alias("at"))


def spoken_pieces(chapters: DataFrame) -> DataFrame:
    """Pieces of chapters (book, ord, html) as they are spoken: (book, ord, k, start, base, spoken, percent).

    A piece is a ruby element, spoken as its reading, or text between two, spoken as it stands; start counts characters of the chapter
    before it, base those of its own.  percent: a percent sign follows the piece's last counted character and may be said too.
    """
    body = F.regexp_extract("html", "(?s)<body.*?</body>", 0)
    markup = F.regexp_replace(F.when(body != "", body).otherwise(F.col("html")), r"(?s)<(script|style)[^>]*>.*?</\1>", "")
    cut = F.split(F.regexp_replace(markup, r"(?s)(<ruby[^>]*>.*?</ruby>)", "\x00$1\x00"), "\x00")
    # a percent sign ends its piece, so that it follows a piece's last character
    parts = F.flatten(F.transform(cut, lambda p: F.when(p.startswith("<ruby"), F.array(p)).otherwise(F.split(p, "(?<=[%％])"))))
    marked = lambda p: p.contains("<") | p.contains("&")
    silent = lambda p: F.regexp_replace(p, "[%％]", "")
    shown = lambda p: F.when(marked(p), T.visible_text(p)).otherwise(p)
    reading = lambda p: shown(F.array_join(F.regexp_extract_all(p, F.lit("(?s)<rt[^>]*>(.*?)</rt>"), F.lit(1)), ""))
    rows = chapters.select("book", "ord", parts.alias("parts")).withColumn("seen", F.transform("parts", shown))
    # what is said is taken for markup once more, as in text.speech_text; null where there is none
    rows = rows.withColumn("plain", F.transform("seen", lambda p: F.when(marked(p), T.visible_text(silent(p))))).withColumn("read", F.transform("parts", lambda p: F.when(p.startswith("<ruby"), shown(silent(reading(p)))).otherwise("")))
    sign = lambda p: F.when(p.startswith("<ruby"), p.rlike("[%％]\\s*$")).otherwise(p.endswith("%") | p.endswith("％"))
    rows = rows.withColumn("sign", F.transform("parts", sign)).drop("parts")
    names = ["book", "ord", "k", "start", "base", "spoken", "percent"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                some = batch.slice(low, 64)
                found = [spoken_parts(*x) for x in zip(*(some[c].to_pylist() for c in ("seen", "plain", "read", "sign"))) if x[0] is not None]
                there = pa.array(np.repeat(np.flatnonzero(some["seen"].is_valid().to_numpy(zero_copy_only=False)), [len(x[0]) for x in found]))
                k, start, base, spoken, percent = zip(*found) if found else ((),) * 5
                numbers = [pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (k, start, base)]
                yield pa.RecordBatch.from_arrays([some["book"].take(there), some["ord"].take(there), *numbers, pa.array([y for x in spoken for y in x], pa.string()), pa.array(np.concatenate([np.zeros(0, bool), *percent]))], names)

    kinds = dict(chapters.dtypes)
    return rows.mapInArrow(run, f"book {kinds['book']}, ord {kinds['ord']}, k bigint, start bigint, base bigint, spoken string, percent boolean")


def spoken_parts(seen: list[str], plain: list[str | None], read: list[str], sign: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(k, start, base, spoken, percent) of the parts of a chapter in which something counts, from what is seen, said as it stands (if that is not what is seen) and read of each, and whether a percent sign ends it."""
    base = counts_of(seen)
    counts = np.flatnonzero(base)
    if not len(counts):
        return counts, counts, counts, [], np.zeros(0, bool)
    # a part without counted characters can still bring the sign of the part before it
    percent = np.logical_or.reduceat(np.array(sign), counts)
    said, plain = _said(read), _said([a if b is None else b for a, b in zip(seen, plain)])
    return np.arange(len(counts)) + 1, (np.cumsum(base) - base)[counts], base[counts], [said[k] or plain[k] for k in counts.tolist()], percent


def counts_of(texts: list[str]) -> np.ndarray:
    """How many characters of each text count."""
    stops = np.append(0, np.cumsum([*map(len, texts)]))
    return np.diff(np.append(0, np.cumsum(_classes()[T.points("".join(texts))] & 1, dtype=np.int64))[stops])


@cache
def _spoken_points() -> np.ndarray:
    """For each code point, whether it counts, is a voicing mark or is the line end between texts."""
    return T.in_class(T.COUNTED + T.VOICING + "\n")


def _said(texts: list[str]) -> list[str]:
    """What counts of texts, as it is spoken."""
    joined = "\n".join(x.replace("\n", "") for x in texts)
    points = T.points(joined)
    return T.levelled(points[_spoken_points()[points]].tobytes().decode("utf-32-le")).split("\n")


def spoken_characters(pieces: DataFrame, with_percent: bool = False) -> DataFrame:
    """(book, ord, k, i, spoken, start, end): each spoken character with the source characters that it stands for.

    The characters of a reading share its base in proportion; a spoken percent sign hangs on the last character before it.
    """
    names = ["book", "ord", "k", "i", "spoken", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, texts in _some_texts(batch, "spoken"):
                n = np.fromiter(map(len, texts), np.int64, len(texts))
                if with_percent:
                    texts = [x + PERCENT if sign else x for x, sign in zip(texts, some["percent"].to_pylist())]
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                row = np.repeat(np.arange(len(n)), sizes)
                i = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
                s, base, size = some["start"].to_numpy()[row], some["base"].to_numpy()[row], np.maximum(n, 1)[row]
                own = i < n[row]
                start, end = s + np.where(own, i * base // size, base - 1), s + np.where(own, ((i + 1) * base + size - 1) // size, base)
                for k in range(0, len(row), AT_ONCE):  # of a long piece
                    part = slice(k, k + AT_ONCE)
                    at = pa.array(row[part])
                    yield pa.RecordBatch.from_arrays([some["book"].take(at), some["ord"].take(at), some["k"].take(at), pa.array(i[part]), T.characters("".join(texts)[part]), pa.array(start[part]), pa.array(end[part])], names)

    kinds = dict(pieces.dtypes)
    return pieces.mapInArrow(run, f"book {kinds['book']}, ord {kinds['ord']}, k {kinds['k']}, i bigint, spoken string, start bigint, end bigint")


def owned_ranges(texts: DataFrame) -> DataFrame:
    """(id, i, start, end): raw range of each counted character of a text (id, text) with the punctuation that belongs to it.

    Opening marks go with the character after them, trailing ones with the one before; marks that hang go with what they hang on:
    after white space, an opening mark or nothing with the next character, else with the one before.
    """
    return _owned(texts.select("id", "text"))


@cache
def _classes() -> np.ndarray:
    """For each code point whether it counts, opens, trails, hangs or is white, as bits."""
    kinds = (T.in_class(T.COUNTED), *(np.isin(np.arange(0x110000), T.points(x)) for x in (OPENS, TRAILS, HANGS)), T.in_class(WHITE))
    return sum(k.astype(np.uint8) << np.uint8(n) for n, k in enumerate(kinds))


def owned_places(texts: list[str], marks: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how many characters count, start, end) of texts, and of their counted characters with the marks that belong to them, or without marks."""
    counted, open_, trail, hang, white = (1 << k for k in range(5))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    kinds = _classes()[T.points("\n" + "\n".join(texts) + "\n")]  # a line end, which is white, stands before each text
    at = np.flatnonzero(kinds & counted)
    begins = 1 + np.cumsum(lengths + 1) - (lengths + 1)
    n = np.searchsorted(at, begins + lengths) - np.searchsorted(at, begins)
    start, end = at.copy(), at + 1
    if marks:
        place = np.arange(len(kinds))
        there = np.flatnonzero(kinds[at + 1] & (trail | hang))  # of those with a mark behind them, the next place without
        beyond = np.minimum.accumulate(np.where(kinds & (trail | hang), len(kinds), place)[::-1])[::-1]
        end[there] = beyond[at[there] + 1]
        there = np.flatnonzero(kinds[at - 1] & (open_ | hang))  # of those with a mark before them, where the run of marks begins
        run = np.maximum.accumulate(np.where(kinds & (open_ | hang), -1, place))[at[there] - 1] + 1
        opening = np.minimum.accumulate(np.where(kinds & open_, place, len(kinds))[::-1])[::-1][run]
        start[there] = np.where(kinds[run - 1] & white, run, np.minimum(opening, at[there]))
    base = np.repeat(begins, n)
    return n, start - base, end - base


def _some_texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch that hold about AT_ONCE characters, with their texts."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[name]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.unique(np.append(np.searchsorted(sizes, np.arange(AT_ONCE, sizes[-1] if len(sizes) else 0, AT_ONCE)), batch.num_rows))
    low = 0
    for high in cuts.tolist():
        if high > low:
            some = batch.slice(low, high - low)
            yield some, [x or "" for x in some[name].to_pylist()]
        low = high


def _owned(texts: DataFrame) -> DataFrame:
    """(..., i, start, end): the raw range of each counted character of texts (..., text)."""
    names = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, found in _some_texts(batch):
                n, start, end = owned_places(found)
                row = np.repeat(np.arange(len(n)), n)
                i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                for k in range(0, len(row), AT_ONCE):  # of a long text
                    part = slice(k, k + AT_ONCE)
                    yield pa.RecordBatch.from_arrays([*(some[c].take(pa.array(row[part])) for c in names), *(pa.array(x[part]) for x in (i, start, end))], [*names, "i", "start", "end"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes if c != "text")
    return texts.mapInArrow(run, f"{kinds}, i bigint, start bigint, end bigint")


def _sections(nodes: DataFrame) -> DataFrame:
    """(id, section, base, first, text): text nodes (id, node, boundary, text) up to the next boundary as one text, with the raw and the counted characters before it."""
    before = Window.partitionBy("id").orderBy("node")
    rows = nodes.select("id", "node", F.coalesce("text", F.lit("")).alias("text"), F.sum(F.coalesce("boundary", F.lit(False)).cast("int")).over(before).alias("section"))
    joined = rows.groupBy("id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]), "").alias("text"))
    earlier = Window.partitionBy("id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    sum_of = lambda c: F.coalesce(F.sum(c.cast("bigint")).over(earlier), F.lit(0))
    return joined.select("id", "section", sum_of(F.length("text")).alias("base"), sum_of(F.length(T.counted_text(F.col("text")))).alias("first"), "text")


def owned_ranges_of_nodes(nodes: DataFrame) -> DataFrame:
    """(id, i, start, end): owned_ranges of texts in nodes (id, node, boundary, text), with places in all nodes of an id.

    Runs of marks go on from node to node; a node with a boundary before it begins anew.  A section between two boundaries (a
    paragraph) is one text, so no whole chapter is.
    """
    owned = _owned(_sections(nodes).select("id", "base", "first", "text"))
    return owned.select("id", (F.col("first") + F.col("i")).alias("i"), (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"))


def search_raw_ranges(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, hit, start, end) of hits (id, hit, at, length) in counted characters: the raw range from their first to their last one, without punctuation outside."""
    return _answered(_asked(hits, "hit", texts), "hit", False)


def _asked(wanted: DataFrame, name: str, texts: DataFrame) -> DataFrame:
    """texts (id, text) with all that is wanted of each (id, name, at, length) as an array: a text meets it once, before it has places."""
    rows = wanted.where("at >= 0 and length > 0").select("id", F.struct(F.col(name), F.col("at").cast("bigint").alias("at"), (F.col("at") + F.col("length") - 1).cast("bigint").alias("last")).alias("x"))
    return texts.select("id", "text").join(rows.groupBy("id").agg(F.collect_list("x").alias("asked")), "id")


def _answered(asked: DataFrame, name: str, marks: bool) -> DataFrame:
    """(id, name, start, end) of what is asked of each text; without those that end beyond it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, found in _some_texts(batch):
                n, start, end = owned_places(found, marks)
                wanted = some["asked"].flatten()
                row = np.repeat(np.arange(len(n)), pc.list_value_length(some["asked"]).to_numpy())
                at, last = (wanted.field(c).to_numpy() for c in ("at", "last"))
                there = np.flatnonzero(last < n[row])
                row, at, last = row[there], at[there], last[there]
                first = (np.cumsum(n) - n)[row]
                yield pa.RecordBatch.from_arrays([some["id"].take(pa.array(row)), wanted.field(name).take(pa.array(there)), pa.array(start[first + at]), pa.array(end[first + last])], ["id", name, "start", "end"])

    kind = asked.schema["asked"].dataType.elementType[name].dataType.simpleString()
    return asked.mapInArrow(run, f"id {asked.schema['id'].dataType.simpleString()}, `{name}` {kind}, start bigint, end bigint")


def cue_raw_ranges(cues: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, cue, start, end) of cues (id, cue, at, length) in counted characters: the raw range of their characters with their punctuation."""
    return _answered(_asked(cues, "cue", texts), "cue", True)


def scan_boundary(char: Column, delimiters: str = "", only_japanese: bool = False) -> Column:
    """Whether a scan of Japanese text ends at a character: white space, a delimiter, or (if asked) whatever is not Japanese."""
    out = char.rlike(r"^[\s\x{3000}\x{A0}]$")
    if delimiters:
        out = out | F.lit(delimiters).contains(char)
    return out | ~char.rlike(f"^[{JAPANESE}]") if only_japanese else out


def scan_boundaries(text: Column, delimiters: str = "", only_japanese: bool = False) -> Column:
    """How many characters of a text are such boundaries, in one pass over it."""
    marks = one_of(delimiters)[1:-1] if delimiters else ""
    return F.regexp_count(text, F.lit(rf"[\s\x{{3000}}\x{{A0}}{marks}" + (f"[^{JAPANESE}]]" if only_japanese else "]")))


def english_words(text: Column, delimiters: str = "") -> Column:
    """Words of English text: what lies between white space and scan ends, where marks between two letters or digits are part of a word."""
    inner, outer = one_of(IN_WORDS), one_of("".join(c for c in ENGLISH_ENDS if c not in IN_WORDS) + delimiters)
    ends = rf"[\s\x{{3000}}]|{outer}|(?<![A-Za-z0-9]){inner}|{inner}(?![A-Za-z0-9])"
    return F.filter(F.split(text, ends), lambda w: w != "")


def may_break(text: Column) -> Column:
    """Whether a line may break before a text: its first character is Japanese or full-width."""
    return F.substring(text, F.lit(1), F.lit(1)).rlike(BREAKABLE)


def breaks(text: Column) -> Column:
    """Before how many characters of a text a line may break."""
    return F.regexp_count(text, F.lit(BREAKABLE))


def _is_kanji(c: str) -> bool:
    return "㐀" <= c <= "䶿" or "一" <= c <= "鿿" or "豈" <= c <= "﫿" or c in "々〆ヶ〇" or ord(c) >= 0x20000


def _hiragana(text: str) -> str:
    return "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in text)


def furigana(expression: str, reading: str | None) -> list[tuple[str, str]]:
    """(text, reading) segments of an expression: its kana must stand in the reading, and each kanji group takes what lies between.

    The whole expression with the whole reading where there is no way, or more than one, to divide it.  From the end of the reading
    back, a table tells for every group and place how far the group goes if that is settled.
    """
    if not reading or reading == expression:
        return [(expression, "")]
    groups = [(kanji, "".join(g)) for kanji, g in groupby(expression, _is_kanji)]
    heard, n = _hiragana(reading), len(reading)
    ways = [[None] * (n + 1) for _ in groups] + [[None] * n + [n]]  # where group j that begins at a place ends
    for j in range(len(groups) - 1, -1, -1):
        kanji, text = groups[j]
        for at in range(n + 1):
            if not kanji:
                to = at + len(text)
                if heard[at:to] == _hiragana(text) and to <= n and ways[j + 1][to] is not None:
                    ways[j][at] = to
            else:
                ends = [to for to in range(at + len(text), n + 1) if ways[j + 1][to] is not None]
                if len(ends) == 1:
                    ways[j][at] = ends[0]
    if ways[0][0] is None:
        return [(expression, reading)]
    out, at = [], 0
    for j, (kanji, text) in enumerate(groups):
        to = ways[j][at]
        if kanji:
            out.append((text, reading[at:to]))
        else:  # only where katakana and hiragana differ does kana get a reading
            for same, part in groupby(range(len(text)), lambda k, at=at, text=text: reading[at + k] == text[k]):
                span = list(part)
                out.append((text[span[0] : span[-1] + 1], "" if same else reading[at + span[0] : at + span[-1] + 1]))
        at = to
    return out


def furigana_segments(words: DataFrame) -> DataFrame:
    """(expression, reading, segments array<struct<text, reading>>, plain) of each distinct pair; plain is written like 漢[かん] ."""
    out = "expression string, reading string, segments array<struct<text: string, reading: string>>, plain string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [furigana(e, r) for e, r in zip(pdf["expression"], pdf["reading"])]
            yield pdf.assign(segments=[[{"text": a, "reading": b} for a, b in x] for x in found], plain=["".join(f"{a}[{b}]" if b else f"{a} " for a, b in x) for x in found])

    return words.where("expression is not null").select("expression", "reading").distinct().mapInPandas(run, out)


def frequency_list(groups: Column) -> Column:
    """HTML list of frequencies (array<struct<dictionary, frequencies array<struct<value, display>>>>); empty without groups."""
    items = F.flatten(F.transform(groups, lambda g: F.transform(F.coalesce(g["frequencies"], F.array().cast("array<struct<value:bigint,display:string>>")), lambda f: F.concat(F.lit("<li>"), F.coalesce(g["dictionary"], F.lit("")), F.lit(": "), F.coalesce(F.nullif(f["display"], F.lit("")), f["value"].cast("string")), F.lit("</li>")))))
    return F.when(F.coalesce(F.size(groups), F.lit(0)) <= 0, "").otherwise(F.concat(F.lit('<ul style="text-align: left;">'), F.array_join(items, ""), F.lit("</ul>")))


def position_list(positions: Column) -> Column:
    """HTML list of pitch positions (array<int>); empty without any."""
    item = lambda p: F.concat(F.lit('<li><span style="display:inline;"><span>[</span><span>'), p.cast("string"), F.lit("</span><span>]</span></span></li>"))
    return F.when(F.coalesce(F.size(positions), F.lit(0)) <= 0, "").otherwise(F.concat(F.lit("<ol>"), F.array_join(F.transform(positions, item), ""), F.lit("</ol>")))


def transcription_list(transcriptions: Column) -> Column:
    """HTML list of phonetic transcriptions (array<string>), escaped; blank ones are left out, empty without any."""
    safe = lambda t: F.replace(F.replace(F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))
    items = F.transform(F.filter(transcriptions, lambda t: F.coalesce(t, F.lit("")) != ""), lambda t: F.concat(F.lit('<li class="pronunciation" data-pronunciation-type="phonetic-transcription">'), safe(t), F.lit("</li>")))
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, "").otherwise(F.concat(F.lit("<ul>"), F.array_join(items, ""), F.lit("</ul>")))


def default_mappings(note_types: DataFrame, templates: DataFrame, mappings: DataFrame) -> DataFrame:
    """(note_type, field, template): the mappings of note types (note_type, name, field), or their name's defaults where none is set.

    templates: (name, field, template); mappings: (note_type, field, template).  Mappings of fields that a note type lacks are kept
    where no defaults are taken.
    """
    own = note_types.join(mappings.select("note_type", "field"), ["note_type", "field"], "left_semi").select("note_type").distinct()
    fresh = note_types.join(templates.select("name").distinct(), "name", "left_semi").join(own, "note_type", "left_anti")
    defaults = fresh.join(templates, ["name", "field"]).select("note_type", "field", "template")
    return mappings.join(fresh.select("note_type").distinct(), "note_type", "left_anti").select("note_type", "field", "template").unionByName(defaults)


def chosen_deck(decks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(user, deck): of each user's decks (user, ord, deck, name) the wanted one (user, deck_id, deck_name) by id, else by name, else the first not called Default, else the first."""
    rows = decks.join(wanted, "user", "left")
    rank = F.when(F.col("deck") == F.col("deck_id"), 0).when(F.col("name") == F.col("deck_name"), 1).when(F.lower("name") != "default", 2).otherwise(3)
    return rows.groupBy("user").agg(F.min_by("deck", F.struct(rank, "ord")).alias("deck"))


def match_source(matches: DataFrame) -> DataFrame:
    """(book, source): matches (book, id, chapter, start) whose ids are all made of chapter and start are transcriptions, others subtitles."""
    made = F.col("id") == F.concat_ws("-", "chapter", "start")
    return matches.groupBy("book").agg(F.when(F.every(F.coalesce(made, F.lit(False))), "transcription").otherwise("subtitles").alias("source"))
