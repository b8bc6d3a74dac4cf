"""Main text of web pages by deducing each host's template from equivalence classes of tokens.

1. occurrence vectors: every page is cut into markup tokens (a tag with its class and id inside its structural parents) and text
   blocks.  The occurrence vector of a token tells how often each page of the host has it; vectors are compared by a hash that is
   combined over pages with exclusive or, so no host is gathered anywhere.  With each opening tag goes what its element held: text,
   text inside links, and whether it held the same on all pages.
2. classes: tokens of a host with equal vectors and enough pages form an equivalence class.  An opening and closing tag in one class
   that occurs once a page is an element of the template, a slot for what pages put there.  Text blocks that nearly every page of a
   host with TEXT_PAGES pages has are template too.
3. slots: the main slot is the innermost element that holds at least half of the host's text outside links, or of what its article
   or main element holds.  Its text is extracted without the slots inside it that are the same on all pages or mostly links, and
   without elements that hold menus, adverts and the like by their tag or name.  A page that lacks its host's main slot, and hosts
   with a single page, are read by their own tags.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm._shared import Scratch, release

BATCH = 2 << 20
#: A tag is part of the template if this share of the host's pages with content has it; a text block needs more, and as many pages.
SUPPORT = 0.5
TEXT_SUPPORT = 0.9
TEXT_PAGES = 5

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|select|title)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
STRUCTURE = frozenset("html head body article main section div nav header footer aside form ul ol table dl figure fieldset dialog menu".split())
BLOCKS = STRUCTURE | frozenset("p h1 h2 h3 h4 h5 h6 li tr td th thead tbody tfoot caption dt dd blockquote pre hr br address figcaption details summary center option legend".split())
NOT_MAIN = frozenset("head nav aside form footer menu dialog button".split())
NOT_MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|menu|nav\w*|breadcrumbs?|sidebar|side|footer|masthead|notices?|cookies?|consent|comments?|disqus|replies|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|popup|modal|toolbar|widget)(?:$|[\s_-])", re.I)
MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|story|entry|body-text|article-body)(?:$|[\s_-])", re.I)


def label(name: str, attributes: str) -> str:
    """A structural tag with its class, id and role."""
    detail = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes)) if "=" in attributes else ""
    return f"{name}.{detail}" if detail else name


def scan(page: str) -> Iterator[tuple[str | None, str, list[str], int]]:
    """A page's structural tags and text blocks in order.

    Tags are (label, "/" for a closing one, labels of the elements around it, 0); blocks are (None, raw text, labels of the elements
    around it, characters inside links).  Elements left open close with the element around them.
    """
    names: list[str] = []
    own: list[str] = []
    parts: list[str] = []
    links = in_link = at = 0
    for m in MARKUP.finditer(page):
        start = m.start()
        if start > at:
            parts.append(page[at:start])
            links += (start - at) * in_link
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name, closing = name.lower(), bool(m["close"])
        if name == "a":
            in_link = int(not closing)
        elif name in BLOCKS:
            if parts:
                yield None, "".join(parts), own, links
                parts, links = [], 0
            if name in STRUCTURE:
                if not closing:
                    tag = label(name, m["attributes"])
                    yield tag, "", own, 0
                    names, own = [*names, name], [*own, tag]
                elif name in names:
                    k = len(names) - 1 - names[::-1].index(name)
                    tag = own[k]
                    names, own = names[:k], own[:k]
                    yield tag, "/", own, 0
    if at < len(page):
        parts.append(page[at:])
    if parts:
        yield None, "".join(parts), own, links


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def blocks(page: str) -> Iterator[tuple[str, str, list[str], int]]:
    """(text, raw text, labels of the structural elements around it, characters inside links) of each block with text."""
    for tag, raw, path, links in scan(page):
        if tag is None:
            text = clean(raw)
            if text:
                yield text, raw, path, links


def is_main(own: str) -> bool:
    name, _, detail = own.partition(".")
    return name in ("article", "main") or bool(detail and MAIN_NAME.search(detail) and not NOT_MAIN_NAME.search(detail))


def is_not_main(own: str) -> bool:
    name, _, detail = own.partition(".")
    return name in NOT_MAIN or bool(detail and NOT_MAIN_NAME.search(detail))


def _wrappers(found: list[tuple[str, str, list[str], int]]) -> set[tuple[str, ...]]:
    """Paths of the elements that hold at least half of a page's text, and of html and body."""
    weight: dict[tuple[str, ...], int] = {}
    for text, _, path, links in found:
        own = tuple(path)
        weight[own] = weight.get(own, 0) + max(0, len(text) - links)
    held: dict[tuple[str, ...], int] = {}
    for path, n in weight.items():
        for k in range(1, len(path) + 1):
            held[path[:k]] = held.get(path[:k], 0) + n
    total = sum(weight.values())
    return {p for p, n in held.items() if 2 * n >= total or p[-1].partition(".")[0] in ("html", "body")}


class Template(NamedTuple):
    main: frozenset[int] = frozenset()  # tokens of main slots
    labels: tuple[str, ...] = ()  # their labels
    fixed: frozenset[int] = frozenset()  # tokens of slots that are the same everywhere or mostly links
    texts: frozenset[int] = frozenset()  # ids of template text blocks


def main_text(page: str, template: Template = Template()) -> str:
    """The blocks of a page in its host's main slot, else in an element of that name, else in its own article, else in the densest."""
    found = list(blocks(page))
    around = _wrappers(found)

    def barred(path: list[str], upto: int) -> bool:
        """Whether one of the first elements of a path is not main by its name; what holds most of the page is no such part of it."""
        return any(is_not_main(x) and tuple(path[: i + 1]) not in around for i, x in enumerate(path[:upto]))

    at, trusted = None, False
    if template.main:
        held = [next((k for k, t in enumerate(tokens_of(tuple(path))) if t in template.main), None) for _, _, path, _ in found]
        if any(k is not None for k in held):
            at = held
    if at is None:
        chosen = next((m for m in template.labels if any(m in path for _, _, path, _ in found)), None)
        if chosen is None:
            chosen = next((x for _, _, path, _ in found for i, x in enumerate(path) if is_main(x) and not barred(path, i)), None)
        if chosen is None:  # an article in something with a name like an advert's: the longest
            inner: dict[tuple[str, ...], int] = {}
            for text, _, path, links in found:
                for i, x in enumerate(path):
                    if is_main(x) and not any(y.partition(".")[0] in NOT_MAIN for y in path[:i]):
                        inner[tuple(path[: i + 1])] = inner.get(tuple(path[: i + 1]), 0) + max(0, len(text) - 2 * links)
            if inner:
                slot, trusted = max(inner, key=inner.__getitem__), True
                at = [len(slot) - 1 if tuple(path[: len(slot)]) == slot else None for _, _, path, _ in found]
        if chosen is None and not trusted:
            weight: dict[str, int] = {}
            for text, _, path, links in found:
                if path and not barred(path, len(path)):
                    weight[path[-1]] = weight.get(path[-1], 0) + max(0, len(text) - 2 * links)
            chosen = max(weight, key=weight.__getitem__) if weight else None
        if not trusted:
            at = [path.index(chosen) if chosen is not None and chosen in path else None for _, _, path, _ in found]
        if chosen is None and not trusted:
            at = [-1 if not any(x.partition(".")[0] == "header" for x in path) else None for _, _, path, _ in found]
    out = []
    for (text, raw, path, _), k in zip(found, at):
        # names judge what lies inside the slot; around it only smaller parts of the page
        if k is None or (not trusted and barred(path, len(path) if k < 0 else k)) or (k >= 0 and any(map(is_not_main, path[k + 1 :]))):
            continue
        if template.fixed and any(t in template.fixed for t in tokens_of(tuple(path))[k + 1 :]):
            continue
        if not (template.texts and text_id(raw, path) in template.texts):
            out.append(text)
    return "\n".join(out)


def text_id(raw: str, path: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("/".join([*path, raw]).encode("utf-8", "surrogatepass")) >> 1


@lru_cache(maxsize=100_000)
def hash_of(tag: str, path: tuple[str, ...]) -> int:
    return xxhash.xxh3_64_intdigest(f"{tag} {'/'.join(path)}".encode("utf-8", "surrogatepass")) >> 1


@lru_cache(maxsize=100_000)
def tokens_of(path: tuple[str, ...]) -> tuple[int, ...]:
    """The tokens of the opening tags of the elements around a block."""
    return tuple(hash_of(tag, path[:k]) for k, tag in enumerate(path))


_VECTOR = pa.schema([("host", pa.string()), ("token", pa.int64()), ("tag", pa.string()), ("pages", pa.int64()), ("total", pa.int64()), ("vector", pa.int64()), ("place", pa.float64()), ("chars", pa.int64()), ("links", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
_VECTOR_DDL = "host string, token bigint, tag string, pages bigint, total bigint, vector bigint, place double, chars bigint, links bigint, low bigint, high bigint"


def page_counts(page: str) -> dict[int, list]:
    """Of each token of a page: tag (None for text), count, first place, characters held, those in links, and a hash of what is held.

    Token 0 stands for the page; a page without any text has no tokens but this one, with count 0.
    """
    counts: dict[int, list] = {0: [None, 0, 0.0, 0, 0, 0]}
    n = 1
    for tag, raw, path, links in scan(page):
        if tag is not None:
            n += 1
            counts.setdefault(hash_of(raw + tag, tuple(path)), [raw + tag, 0, n, 0, 0, 0])[1] += 1
        elif not raw.isspace():
            size, own = len(raw.strip()), text_id(raw, [])
            counts.setdefault(text_id(raw, path), [None, 0, 0.0, 0, 0, 0])[1] += 1
            for token in (0, *tokens_of(tuple(path))):
                entry = counts[token]
                entry[3] += size
                entry[4] += min(links, size)
                entry[5] = (entry[5] * 31 + own) & 0x7FFFFFFFFFFFFFFF
    if not counts[0][3]:
        return {0: counts[0]}
    counts[0][1] = 1
    for entry in counts.values():
        entry[2] /= n
    return counts


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial occurrence vectors, combined over some megabytes of pages."""
    held: dict[tuple[str, int], list] = {}
    size = 0

    def emit() -> pa.RecordBatch:
        cols = [[k[0] for k in held], [k[1] for k in held], *([x[i] for x in held.values()] for i in range(9))]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _VECTOR)], schema=_VECTOR)

    for batch in batches:
        for host, uid, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for token, (tag, count, place, chars, links, content) in page_counts(page).items():
                vector = xxhash.xxh3_64_intdigest(f"{uid} {count}") >> 1
                entry = held.get((host, token))
                if entry is None:
                    held[host, token] = [tag, min(count, 1) if token == 0 else 1, count, vector, place, chars, links, content, content]
                else:
                    entry[1] += min(count, 1) if token == 0 else 1
                    entry[2] += count
                    entry[3] ^= vector
                    entry[4] += place
                    entry[5] += chars
                    entry[6] += links
                    entry[7] = min(entry[7], content)
                    entry[8] = max(entry[8], content)
            size += len(page)
            if size >= BATCH:
                yield emit()
                size = 0
    if held:
        yield emit()


def host_templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """host, pages, elements (of the template, outermost first: tag, token, chars, links, same), chars and links of its pages, texts.

    pages has columns host, uid, html; host_pages counts all pages, the support is of those with content.
    """
    vectors = pages.mapInArrow(_vectors, _VECTOR_DDL)
    sums = [F.sum(c).alias(c) for c in ("pages", "total", "place", "chars", "links")]
    whole = vectors.groupBy("host", "token").agg(F.max("tag").alias("tag"), *sums, F.bit_xor("vector").alias("vector"), F.min("low").alias("low"), F.max("high").alias("high"))
    whole = scratch.table(whole, "vectors")
    counted = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    sizes = whole.where("token = 0").select("host", F.col("pages").alias("full_pages"), F.col("chars").alias("host_chars"), F.col("links").alias("host_links"))
    # at most 2 / SUPPORT tokens for each token of a mean page remain of a host
    often = whole.where("pages >= 2 and token != 0").join(sizes, "host").where(F.col("pages") >= F.col("full_pages") * SUPPORT)
    tag_rows = F.struct((F.col("place") / F.col("pages")).alias("place"), "tag", "token", "chars", "links", ((F.col("low") == F.col("high")) & (F.col("full_pages") >= TEXT_PAGES)).alias("same"))
    classes = often.where("tag is not null and pages = total").groupBy("host", "vector", "pages").agg(F.collect_list(tag_rows).alias("rows"))
    opened = classes.select("host", F.transform("rows", lambda x: x["tag"]).alias("tags"), F.explode(F.filter("rows", lambda x: ~x["tag"].startswith("/"))).alias("o"))
    main = opened.where(F.array_contains("tags", F.concat(F.lit("/"), F.col("o.tag")))).groupBy("host").agg(F.array_sort(F.collect_list("o")).alias("elements"))
    texts = often.where(F.col("tag").isNull() & (F.col("full_pages") >= TEXT_PAGES) & (F.col("pages") >= F.col("full_pages") * TEXT_SUPPORT))
    texts = texts.groupBy("host").agg(F.collect_list("token").alias("texts"))
    return counted.join(sizes, "host").join(main, "host", "left").join(texts, "host", "left")


def template_of(elements: list[dict] | None, host_chars: int, host_links: int, texts: list[int] | None) -> Template:
    """The main slot of a host's template, and the slots that are no content."""
    elements = elements or []
    mass = lambda e: max(0, e["chars"] - 2 * e["links"])
    articles = [e for e in elements if e["tag"].partition(".")[0] in ("article", "main")]
    whole = max((mass(e) for e in articles), default=max(0, host_chars - 2 * host_links))
    big = [e for e in elements if 2 * mass(e) >= whole > 0 and not is_not_main(e["tag"])]
    if articles:
        big = [e for e in articles if 2 * mass(e) >= whole]
    # inner elements come later in the page than those around them
    main = max(big, key=lambda e: (-mass(e), e["place"])) if big and not articles else next(iter(big), None)
    fixed = frozenset(e["token"] for e in elements if e["chars"] and (e["same"] or 2 * e["links"] > e["chars"]) and e is not main)
    return Template(frozenset([main["token"]] if main else []), (main["tag"],) if main else (), fixed, frozenset(texts or ()))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Template] = {}
    for batch in batches:
        texts = []
        hosts = batch.column("host").to_pylist()
        for k, (page, host) in enumerate(zip(batch.column("html").to_pylist(), hosts)):
            if host not in known:
                known.clear() if len(known) > 10_000 else None
                known[host] = template_of(*(batch.column(c)[k].as_py() for c in ("elements", "host_chars", "host_links", "texts")))
            texts.append(main_text(page, known[host]))
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(n)], ["page_id", "url", "text", "n_chars"])
    release()


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one newline.  Null html
    counts as empty and gives an empty text; pages with a null url form a host of their own; null and repeated page_ids are
    passed on.  An empty table gives an empty result.  Other columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host.alias("host"), F.monotonically_increasing_id().alias("uid"))
    templates = scratch.table(host_templates(rows.select("host", "uid", "html"), scratch), "templates")
    n = templates.agg(F.sum("host_pages")).first()[0] or 0
    heavy = F.col("host_pages") > n // 1000  # fewer than a thousand hosts
    columns = ["page_id", "url", "html", "host", "elements", "host_chars", "host_links", "texts"]
    in_heavy = rows.join(F.broadcast(templates.where(heavy)), "host").select(*columns)
    light = rows.join(F.broadcast(templates.where(heavy).select("host")), "host", "left_anti").join(templates.where(~heavy), "host").select(*columns)
    out = "page_id bigint, url string, text string, n_chars bigint"
    return in_heavy.mapInArrow(_extract, out).unionByName(light.mapInArrow(_extract, out))
