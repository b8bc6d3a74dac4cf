"""Scalar functions over text (columns in, columns out).  Offsets and lengths are code points throughout."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The characters that count as text (ASCII and full-width letters and digits, kana, Hangul, CJK and its extensions, and the marks between them).
COUNTED = (
    "0-9A-Za-z\\x{25CB}\\x{25EF}\\x{3005}-\\x{3007}\\x{303B}\\x{3041}-\\x{3096}\\x{309D}-\\x{309E}\\x{30A1}-\\x{30FA}\\x{30FC}\\x{FF10}-\\x{FF19}\\x{FF21}-\\x{FF3A}\\x{FF41}-\\x{FF5A}\\x{FF66}-\\x{FF9D}"
    "\\x{AC00}-\\x{D7A3}\\x{3131}-\\x{318E}\\x{2E80}-\\x{2FDF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2B73F}\\x{2B740}-\\x{2B81F}\\x{2B820}-\\x{2CEAF}\\x{2CEB0}-\\x{2EBEF}\\x{30000}-\\x{3134F}\\x{31350}-\\x{323AF}"
)
#: One counted character, and what does not count: the same sets, but ASCII, which is most of many texts, is settled by a few ranges.
COUNTED_ONE = f"(?:[0-9A-Za-z]|(?![\\x00-\\x7F])[{COUNTED}])"
UNCOUNTED = f"[\\x00-/:-@\\x5B-`\\x7B-\\x7F]+|(?![0-9A-Za-z])[^{COUNTED}]"
#: Marks that voice the character before them.
VOICING = r"\x{3099}\x{309A}\x{FF9E}\x{FF9F}"
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
_KATAKANA = {ord(c): ord(c) - 0x60 for c in KATAKANA}
SMALL_KANA = "ぁぃぅぇぉゃゅょゎァィゥェォャュョヮ"
#: Characters that file names of synchronised books carry escaped.
RESERVED = "/?<>\\:*|%\""


def points(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def in_class(members: str) -> np.ndarray:
    """For each code point, whether it is in a character class (single characters and ranges, also as \\x{...}, \\t and \\r)."""
    found = np.zeros(0x110000, bool)
    one = r"(\\x\{[0-9A-F]+\}|\\[tr]|[^\\])"
    code = lambda x: int(x[3:-1], 16) if x.startswith("\\x") else {"\\t": 9, "\\r": 13}[x] if len(x) > 1 else ord(x)
    for low, high in re.findall(rf"(?s){one}(?:-{one})?", members):
        found[code(low) : code(high or low) + 1] = True
    return found


def levelled(text: str) -> str:
    """A text as it is compared: compatibility forms composed, lower case, hiragana."""
    text = unicodedata.normalize("NFKC", text).lower()
    return text if text.isascii() else text.translate(_KATAKANA)


def characters(text: str) -> pa.Array:
    """The characters of a text, one a row."""
    codes = points(text)
    sizes = 1 + (codes >= 0x80).astype(np.int32) + (codes >= 0x800) + (codes >= 0x10000)
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(np.cumsum(np.append(0, sizes), dtype=np.int32)), pa.py_buffer(text.encode()))


def visible_text(html: Column, paragraphs: bool = False) -> Column:
    """Text of the body: ruby readings, scripts, styles and tags dropped, numeric references dropped, four named ones decoded in order."""
    body = F.regexp_extract(html, "(?s)<body.*?</body>", 0)
    out = F.when(body != "", body).otherwise(html)
    out = F.regexp_replace(out, r"(?s)<(rt|rp)[^>]*>.*?</\1>", "")
    out = F.regexp_replace(out, r"(?s)<(script|style)[^>]*>.*?</\1>", "")
    if paragraphs:
        out = F.regexp_replace(out, r"(?i)<br[^>]*>|</(p|div|h[1-6]|li|blockquote|section|td|tr)\s*>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, "<[^>]+>", ""), "&#[xX]?[0-9A-Fa-f]+;", "")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def counted_text(text: Column) -> Column:
    """Only the characters that count."""
    return F.regexp_replace(text, UNCOUNTED, "")


def matchable_text(html: Column) -> Column:
    return counted_text(visible_text(html))


def hiragana(text: Column) -> Column:
    """Katakana as hiragana."""
    return F.translate(text, KATAKANA, "".join(chr(ord(c) - 0x60) for c in KATAKANA))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def speech_text(html: Column) -> Column:
    """Text as it is spoken: counted characters, compatibility forms composed, lower case, hiragana, per cent signs as a word."""
    text = F.regexp_replace(visible_text(html), "[%％]", "パーセント")
    return hiragana(F.lower(nfkc(F.regexp_replace(text, f"{UNCOUNTED[:-1]}\\x{{3099}}\\x{{309A}}\\x{{FF9E}}\\x{{FF9F}}]", ""))))


def language_of(text: Column) -> Column:
    """'ja' with kana, 'ko' with Hangul, 'zh' with other CJK, 'en' with Latin letters, else ''."""
    has = lambda ranges: text.rlike(f"[{ranges}]")
    return F.when(has("\\x{3041}-\\x{309F}\\x{30A1}-\\x{30FF}"), "ja").when(has("\\x{AC00}-\\x{D7A3}\\x{3131}-\\x{318E}"), "ko").when(has("\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}"), "zh").when(has("A-Za-z"), "en").otherwise("")


def morae(kana: Column) -> Column:
    """Morae: a kana with the small kana after it."""
    return F.regexp_extract_all(kana, F.lit(f".[{SMALL_KANA}]*"), 0)


def pitch_pattern(kana: Column, position: Column) -> Column:
    """High (H) and low (L) of each mora and of the particle after it, for the mora after which pitch falls (0: never)."""
    n = F.size(morae(kana))
    high = lambda i: F.when(position == 0, i > 1).when(position == 1, i == 1).otherwise((i > 1) & (i <= position))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.when(high(i), "H").otherwise("L")), ""))


def pitch_category(kana: Column, position: Column, verb_or_adjective: Column) -> Column:
    n = F.size(morae(kana))
    return (
        F.when(position == 0, "heiban").when(verb_or_adjective & (position > 0), "kifuku").when(position == 1, "atamadaka").when((position > 1) & (position == n), "odaka").when((position > 1) & (position < n), "nakadaka")
    )


def escape_title(title: Column) -> Column:
    """A title as a file name: last space or full stop and stars by name, other reserved characters as %XX."""
    out = F.when(title.endswith(" "), F.regexp_replace(title, " $", "~ttu-spc~")).otherwise(title)
    out = F.when(out.endswith("."), F.regexp_replace(out, r"\.$", "~ttu-dend~")).otherwise(out)
    out = F.replace(out, F.lit("*"), F.lit("~ttu-star~"))
    out = F.replace(out, F.lit("%"), F.lit("%25"))
    for c in RESERVED.replace("%", "").replace("*", ""):
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def unescape_title(name: Column) -> Column:
    """The title that escape_title made a file name of."""
    out = F.replace(name, F.lit("~ttu-star~"), F.lit("*"))
    out = F.regexp_replace(F.regexp_replace(out, "~ttu-spc~$", " "), "~ttu-dend~$", ".")
    parts = F.split(F.regexp_replace(out, "%(?=[0-9A-Fa-f]{2})", "\x00%"), "\x00")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^%[0-9A-Fa-f]{2}"), F.concat(F.chr(F.conv(F.substring(p, 2, 2), 16, 10).cast("int")), F.substring(p, 4, 1 << 30))).otherwise(p)), "")


def file_fact(name: Column, prefix: str, place: int, kind: str = "bigint") -> Column:
    """A number from a file name such as progress_1_6_<ms>_<progress>.json; null for other names and for what is no number."""
    bare = F.regexp_replace(name, r"\.(json|zip)$", "")
    return F.when(name.startswith(prefix), F.try_element_at(F.split(bare, "_"), F.lit(place + 1)).try_cast(kind))


def storage_name(title: Column, most: int = 250) -> Column:
    """A folder name: composed form, reserved characters replaced, over `most` UTF-8 bytes cut and marked by a hash."""
    name = F.regexp_replace(nfc(title), r'[/\\:*?"<>|\x00-\x1F]', "_")
    room = most - 17
    cut = F.aggregate(F.split(name, ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), lambda acc, c: F.when(acc["n"] + F.octet_length(c) <= room, F.struct(F.concat(acc["s"], c).alias("s"), (acc["n"] + F.octet_length(c)).alias("n"))).otherwise(F.struct(acc["s"].alias("s"), F.lit(room).alias("n"))))["s"]
    return F.when(F.octet_length(name) <= most, name).otherwise(F.concat(cut, F.lit("-"), F.substring(F.sha2(name.cast("binary"), 256), 1, 16)))


def audio_url(scheme: str, source: Column, file: Column) -> Column:
    part = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit(f"{scheme}://"), part(source), F.lit("/"), part(file))


def parse_audio_url(url: Column, scheme: str) -> tuple[Column, Column]:
    """Source and file of an audio URL; null for others."""
    tail = F.when(url.rlike(f"^{scheme}://[^/]+/.+"), F.substring(url, len(scheme) + 4, 1 << 30))
    return F.try_url_decode(F.substring_index(tail, "/", 1)), F.try_url_decode(F.regexp_replace(tail, "^[^/]*/", ""))


def audio_extension(file: Column) -> Column:
    return F.when(file.contains("."), F.lower(F.substring_index(file, ".", -1))).otherwise("")


def mime_type(file: Column) -> Column:
    ext = audio_extension(file)
    return F.when(ext == "mp3", "audio/mpeg").when(ext.isin("opus", "ogg"), "audio/ogg").otherwise("application/octet-stream")


def note_text(field: Column) -> Column:
    """A note's field as text: images by name, styles, scripts and tags dropped, common references decoded."""
    out = F.regexp_replace(field, r"""(?i)<img[^>]*?src=["']?([^"'> ]+)["']?[^>]*>""", " $1 ")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "(?is)<style.*?</style>", ""), "(?is)<script.*?</script>", ""), "<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def note_checksum(field: Column) -> Column:
    """The first eight hex digits of the text's SHA-1 as a number."""
    return F.conv(F.substring(F.sha1(note_text(field).cast("binary")), 1, 8), 16, 10).cast("bigint")


def srt_seconds(stamp: Column) -> Column:
    """Seconds of h:m:s,ms; raises unless there are three parts."""
    parts = F.split(F.replace(F.trim(stamp), F.lit(","), F.lit(".")), ":")
    ok = F.size(parts) == 3
    return F.when(ok, parts[0].cast("double") * 3600 + parts[1].cast("double") * 60 + parts[2].cast("double")).otherwise(F.raise_error(F.concat(F.lit("bad timestamp: "), stamp)).cast("double"))


def srt_stamp(seconds: Column) -> Column:
    ms = F.floor(seconds * 1000 + 0.5).cast("bigint")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def image_type(data: Column) -> Column:
    """Extension by magic bytes."""
    starts = lambda h: F.hex(F.substring(data, 1, len(h) // 2)) == h
    return F.when(starts("89504E47"), "png").when(starts("47494638"), "gif").when(starts("424D"), "bmp").when(starts("52494646"), "webp").otherwise("jpeg")


def image_paths(html: Column) -> Column:
    """Relative paths of jpg, jpeg and png images in order of appearance, without gaiji and queries."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<(?:img|image)\b[^>]*>"), 0), lambda t: ~t.rlike(r"""(?i)class\s*=\s*["'][^"']*gaiji"""))
    paths = F.transform(tags, lambda t: F.regexp_replace(F.regexp_extract(t, r"""(?i)(?:src|href)\s*=\s*["']([^"']*)["']""", 1), r"[?#].*$", ""))
    return F.array_distinct(F.filter(paths, lambda p: p.rlike(r"(?i)\.(jpe?g|png)$") & ~p.rlike(r"(?i)^([a-z][a-z0-9+.-]*:|//)")))


def href_base(href: Column) -> Column:
    """Path of a link without fragment and query."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.trim(href), F.lit("\\"), F.lit("/")), "^/", ""), "[#?].*$", "")


def display_title(renamed: Column, title: Column, folder: Column) -> Column:
    """The new name if it is not blank, else the title, else the folder."""
    filled = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(filled(renamed), filled(title), folder)


def natural_key(title: Column) -> Column:
    """A sort key in which digit runs compare as numbers: leading zeros off, length before digits."""
    parts = F.regexp_extract_all(F.lower(title), F.lit("[0-9]+|[^0-9]+"), 0)
    bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(bare(p)).cast("string"), 3, "0"), bare(p))).otherwise(p)), "\x01")


def render_template(template: str, values: dict[str, Column]) -> Column:
    """A template with {handlebars} replaced by columns; unknown ones and nulls give nothing.  The template is cut once, here."""
    import re

    parts = []
    for k, piece in enumerate(re.split(r"\{([a-z0-9-]+)\}", template)):
        parts.append(F.lit(piece) if k % 2 == 0 else F.coalesce(values[piece].cast("string"), F.lit("")) if piece in values else F.lit(""))
    return F.concat(*parts)


def cloze(sentence: Column, term: Column, offset: Column) -> tuple[Column, Column, Column]:
    """Prefix, body and suffix around a term: at the offset if it stands there, else at its first occurrence, else all prefix."""
    there = F.substring(sentence, offset + 1, F.length(term)) == term
    at = F.when(there, offset).otherwise(F.instr(sentence, term) - 1)
    found = at >= 0
    return F.when(found, F.substring(sentence, F.lit(1), at)).otherwise(sentence), F.when(found, term).otherwise(""), F.when(found, F.substring(sentence, at + F.length(term) + 1, F.length(sentence))).otherwise("")


def render_tags(template: str, values: dict[str, Column]) -> Column:
    """A template of tags: each of its {handlebars} becomes one tag, with the white space inside it as _."""
    return render_template(template, {k: F.regexp_replace(F.trim(v.cast("string")), r"\s+", "_") for k, v in values.items()})


def without_headers(glossary: Column) -> Column:
    """Glossary HTML without the dictionary's name in italics at the beginning of its items."""
    return F.regexp_replace(glossary, r'(<li data-dictionary="[^"]*">)<i>[^<]*</i> ', "$1")
