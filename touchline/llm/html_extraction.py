"""HTML extraction by two-pass block rules.

A small parser cuts each page into blocks with their features: words, stop words, characters inside links, and where
the block stands. Pass 1 classifies blocks by stop-word density, length and link density, in DataFrame expressions:
inside an article and out of it. What the mark-up says is evidence: parts that it names as menus, forms, notices and
the like are left out, and an article element lowers the densities asked of its blocks, if it holds most of the
text that reads well. Pass 2 gives ambiguous blocks the label of the nearest decided neighbour. A page is one row
throughout, so nothing is exchanged between tasks.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, unused

# Element names of HTML, words of class names, and frequent words of four languages.
RAW_TEXT = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
DROPPED = {"head", "nav", "header", "footer", "aside", "menu", "dialog", "noscript", "template", "svg", "math",
           "button", "select", "object", "audio", "video", "canvas", "datalist"}
FORMS = {"form", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
          "ins", "kbd", "label", "mark", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub",
          "sup", "time", "tt", "u", "var", "wbr"}
ZONES = {"article", "main"}
#: Start tags, the elements they end, and the elements beyond which they do not reach; others end a paragraph only.
P_BARRIERS = ("table", "td", "th", "caption", "button", "object", "blockquote")
IMPLIED = {
    "li": (("li", ("ul", "ol", "menu")), ("p", P_BARRIERS + ("li",))), "dt": (("dt", ("dl",)), ("dd", ("dl",))), "dd": (("dt", ("dl",)), ("dd", ("dl",))),
    "tr": (("tr", ("table",)),), "td": (("td", ("table", "tr")), ("th", ("table", "tr"))), "th": (("td", ("table", "tr")), ("th", ("table", "tr"))),
    "option": (("option", ("select",)),),
}
HINTS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer gdpr header login masthead menu "
    "modal nav navbar navigation newsletter notice overlay pagination pager popup promo promoted promotion related share sharing sidebar signup "
    "skip social sponsor sponsored subscribe teaser toolbar toc widget".split()
)
READERS = {"comment", "comments", "commentlist", "disqus", "replies", "reply", "respond"}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search"}
STOP_WORDS = set(
    "a about all an and are as at be been but by can for from had has have he his if in into is it more not of on or our she that the their they "
    "this to up was we were which who will with you "
    "au aux avec ce ces dans de des du elle en est et il ils la le les mais ne nous on ou par pas plus pour qu que qui sa se son sont sur un une vous "
    "al como con cuando del el ella era es esta este fue ha las lo los más muy no o para pero por sin su sus también una y "
    "als auch auf aus bei das dem den der die durch ein eine einem einen einer er für hat ich im ist mit nach nicht oder sich sie sind und von vor "
    "war wie wird zu zum zur".split()
)

STOP_LOW, STOP_HIGH = 0.1, 0.2
LENGTH_LOW, LENGTH_HIGH = 60, 160
LINKS_MOST = 0.3
#: In an article, links make a block bad only from this share on, and if it has few stop words.
LINKS_ARTICLE = 0.6
#: Least share of the words that read well which an article must hold.
ZONE_SHARE = 0.5
#: A part that a hint or a form names is left out unless it holds these shares of the page: of the words that read well, and
#: of the words of text blocks in any language. Readers' comments may be longer than the article, so they need nearly all.
HINT_SHARES = (2 / 3, 0.5)
#: The same for a part inside an article, which holds much else of the article or is no part of it.
INNER_SHARES = (0.8, 0.8)
READERS_SHARES = (0.95, 0.95)
BLOCK = T.ArrayType(
    T.StructType().add("text", "string").add("words", "integer").add("stops", "integer").add("linked", "integer").add("place", "integer").add("heading", "boolean")
)

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?+)*+)(?:>|\Z)""",  # a quote counts after = only
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW_TEXT}
_LETTERS = re.compile(r"[^\W\d_]+")


def container(name: str, rest: str) -> str:
    """What an element says about the blocks inside: drop, zone, hint (named as no part of the article), readers (their
    comments), a zone that is one of these, or nothing."""
    if name in DROPPED:
        return "drop"
    zone, kind = name in ZONES, "hint" if name in FORMS else ""
    if rest and name not in ("html", "body"):
        found = {k.lower(): html.unescape(v.strip("\"'")).lower() for k, v in _ATTRIBUTE.findall(rest)}
        if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
            return "drop"
        roles = set(found.get("role", "").split())
        if ROLES & roles - {"form"}:
            return "drop"
        words = set(re.split(r"[^a-z]+", f"{found.get('class', '')} {found.get('id', '')}"))
        zone = zone or found.get("role") in ("main", "article") or found.get("itemprop") == "articlebody"
        kind = "readers" if words & READERS else "hint" if words & HINTS or "form" in roles else kind
    return f"{kind} zone" if zone else kind


class Stack:
    """The open elements, with what is asked of them kept up to date: each start and end tag costs the same."""

    def __init__(self) -> None:
        self.open: list[tuple[str, str]] = []
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # by name, where it is open
        self.drops = 0
        self.zones: list[int] = []  # numbers of the outermost open zone, once for each open one
        self.numbers = 0
        self.doubted: list[int] = [0]  # numbers of the open parts that are hinted at or readers' comments
        self.parts: list[tuple[int, bool, bool]] = [(0, False, False)]  # of each, from 1 on: the one around it, whether it is readers', and in a zone

    def push(self, name: str, kind: str) -> None:
        self.at[name].append(len(self.open))
        if kind == "drop":
            self.drops += 1
        if "zone" in kind:
            if not self.zones:
                self.numbers += 1
            self.zones.append(self.numbers)
        if "hint" in kind or "readers" in kind:
            self.parts.append((self.doubted[-1], "readers" in kind, len(self.zones) > ("zone" in kind)))
            self.doubted.append(len(self.parts) - 1)
        self.open.append((name, kind))

    def pop_to(self, size: int) -> None:
        while len(self.open) > size:
            name, kind = self.open.pop()
            self.at[name].pop()
            if kind == "drop":
                self.drops -= 1
            if "zone" in kind:
                self.zones.pop()
            if "hint" in kind or "readers" in kind:
                self.doubted.pop()

    def end(self, name: str) -> None:
        if self.at[name]:
            self.pop_to(self.at[name][-1])

    def imply(self, name: str) -> None:
        """The end tags that may be left out before this start tag."""
        for closed, barriers in IMPLIED.get(name, ()) or (("p", P_BARRIERS),):
            inner = max((self.at[b][-1] for b in barriers if self.at[b]), default=-1)
            if self.at[closed] and self.at[closed][-1] > inner:
                self.pop_to(self.at[closed][-1])

    def place(self) -> tuple[int, int]:
        """The zone (-1 in a dropped part, 0 in none) and the innermost doubted part (0: none)."""
        return (-1 if self.drops else self.zones[-1] if self.zones else 0), self.doubted[-1]


def parse(page: str) -> tuple[list[tuple], list[tuple[int, bool, bool]]]:
    """(text, words, stop words, linked characters, zone, doubted part, heading) of a page's blocks, and its doubted parts; see ``Stack``."""
    blocks: list[tuple] = []
    stack = Stack()
    parts: list[str] = []
    linked = at = 0
    heading = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                words = _LETTERS.findall(text.lower())
                blocks.append((text, len(text.split()), sum(w in STOP_WORDS for w in words), min(linked, len(text)), *stack.place(), heading))
            parts.clear()
        linked = 0

    def text_to(stop: int) -> None:
        nonlocal linked
        if stop > at:
            parts.append(page[at:stop])
            if stack.at["a"]:
                linked += len(page[at:stop].strip())

    while m := _TOKEN.search(page, at):
        text_to(m.start())
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            if name not in INLINE:
                flush()
                heading = False
            stack.end(name)
            continue
        rest = m["rest"] or ""
        if name in RAW_TEXT:
            close = _RAW_END[name].search(page, at)
            at = close.end() if close else len(page)
            flush()
        elif name == "br":
            parts.append(" ")
        elif name not in INLINE:
            flush()
            stack.imply(name)
            if name == "body":
                stack.end("head")
            heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
            if name not in VOID and not rest.endswith("/"):
                stack.push(name, container(name, rest))
        elif name not in VOID:
            if name == "a":
                stack.end("a")
            stack.push(name, container(name, rest) if rest and name != "a" else "")
    text_to(len(page))
    flush()
    return blocks, stack.parts


def page_blocks(page: str) -> list[tuple]:
    return parse(page)[0]


def left_out(blocks: list[tuple], parts: list[tuple[int, bool, bool]]) -> list[bool]:
    """Of a page's doubted parts: whether the text rules agree that it is left out, with all inside it.

    Where an article that nothing casts doubt on has text, parts outside of articles are left out.
    """
    plain = any(zone > 0 and part == 0 for *_, zone, part, _ in blocks)
    well, text = [0] * len(parts), [0] * len(parts)
    for block, words, stops, linked, zone, part, _ in blocks:
        if zone >= 0 and len(block) >= LENGTH_LOW and linked <= LINKS_MOST * len(block):
            text[part] += words
            well[part] += words if stops >= STOP_LOW * words else 0
    for k in range(len(parts) - 1, 0, -1):  # a part comes after the one around it
        well[parts[k][0]] += well[k]
        text[parts[k][0]] += text[k]
    out = [False] * len(parts)
    for k in range(1, len(parts)):
        around, readers, inner = parts[k]
        w, t = READERS_SHARES if readers else INNER_SHARES if inner else HINT_SHARES
        out[k] = out[around] or (plain and not inner) or text[k] == 0 or well[k] < w * well[0] or text[k] < t * text[0]
    return out


def places(blocks: list[tuple], parts: list[tuple[int, bool, bool]]) -> list[int]:
    """Of a page's blocks: 1 in the article, -1 left out by the mark-up, 0 in a page without a clear article.

    Doubted parts are left out as ``left_out`` says; where no text is left then, they all count but for readers' comments. Where
    articles hold ``ZONE_SHARE`` of the words that read well, what stands outside is left out.
    """
    out = left_out(blocks, parts)
    if not any(not out[part] and (zone > 0 or (zone == 0 and len(text) >= LENGTH_LOW)) for text, _, _, _, zone, part, _ in blocks):
        out = [False]
        for around, readers, _ in parts[1:]:
            out.append(out[around] or readers)
    open_ = [zone >= 0 and not out[part] for *_, zone, part, _ in blocks]
    well = [n if o and len(text) >= LENGTH_LOW and stops >= STOP_LOW * n and linked <= LINKS_MOST * len(text) else 0 for (text, n, stops, linked, *_), o in zip(blocks, open_, strict=True)]
    zones = [zone for *_, zone, _, _ in blocks]
    inside = [n for n, zone, o in zip(well, zones, open_, strict=True) if o and zone > 0]
    if inside and sum(inside) >= ZONE_SHARE * sum(well):
        return [1 if o and zone > 0 else -1 for zone, o in zip(zones, open_, strict=True)]
    return [0 if o else -1 for o in open_]


@F.pandas_udf(BLOCK)
def blocks_of(pages: pd.Series) -> pd.Series:
    names = ("text", "words", "stops", "linked", "place", "heading")
    parsed = (parse(p or "") for p in pages)
    return pd.Series([[dict(zip(names, (*b[:4], place, b[6]), strict=True)) for b, place in zip(blocks, places(blocks, parts), strict=True)] for blocks, parts in parsed])


def first_labels(blocks: Column) -> Column:
    """Pass 1, block by block: 1 kept, -1 left out, 0 still ambiguous, -2 left out by the mark-up.

    Outside articles: a block mostly of links is left out; a short one is ambiguous; a longer one is kept with many
    stop words, or with some if it is long, left out with few, and else ambiguous. In an article: a block is left
    out if it is mostly links and has few stop words; kept if it is not short and has some stop words; the rest,
    such as headings and tables, is ambiguous.
    """

    def label(b: Column) -> Column:
        density = b["stops"] / F.greatest(b["words"], F.lit(1))
        length = F.length(b["text"])
        within = (
            F.when((b["linked"] > LINKS_ARTICLE * length) & (density < STOP_LOW), -1)
            .when((length >= LENGTH_LOW) & (density >= STOP_LOW), 1)
            .otherwise(0)
        )
        return (
            F.when(b["place"] < 0, -2)
            .when(b["place"] > 0, within)
            .when(b["linked"] > LINKS_MOST * length, -1)
            .when(length < LENGTH_LOW, 0)
            .when((density >= STOP_HIGH) | ((length >= LENGTH_HIGH) & (density >= STOP_LOW)), 1)
            .when(density < STOP_LOW, -1)
            .otherwise(0)
        )

    return F.transform(blocks, label)


@F.pandas_udf(T.StringType())
def inherited_text(texts: pd.Series, labels: pd.Series, places: pd.Series, headings: pd.Series) -> pd.Series:
    """Pass 2: ambiguous blocks take the label of the nearest decided neighbour; the kept blocks, joined.

    Blocks that the mark-up leaves out are no neighbours of those in an article. Without a decided neighbour a block
    is kept in an article and left out elsewhere. At equal distance a heading follows the next block, any other
    block the one before.
    """
    out = []
    for text, label, place, heading in zip(texts, labels, places, headings, strict=True):
        label, article = np.array(label, dtype=np.int32), 1 in place
        known = np.flatnonzero((label != 0) & (label >= (-1 if article else -2)))
        open_ = np.flatnonzero(label == 0)
        if len(known) == 0:
            label[open_] = 1 if article else -1
        elif len(open_):
            k = np.searchsorted(known, open_)
            before, after = known[np.maximum(k - 1, 0)], known[np.minimum(k, len(known) - 1)]
            near, far = np.abs(after - open_), np.abs(open_ - before)
            label[open_] = label[np.where((near < far) | ((near == far) & np.array(heading)[open_]), after, before)]
        out.append(" ".join(np.array(text, dtype=object)[label > 0]))
    return pd.Series(out, dtype=object)


def extract_text(pages: DataFrame) -> DataFrame:
    """pages with its blocks' labels joined into text, and n_chars.

    pages: html and any other columns, which are kept; those named text and n_chars are replaced. A null or empty
    page, and one without a kept block, gives an empty text. Repeated rows each get their text. An empty pages
    gives no rows. Character references are decoded, white space inside a block is one space.
    """
    blocks, labels = unused([*pages.columns, "text", "n_chars"], "blocks", "labels")
    b = F.col(blocks)
    row = pages.withColumn(blocks, blocks_of("html")).withColumn(labels, first_labels(b))
    row = row.withColumn("text", inherited_text(b["text"], labels, b["place"], b["heading"]))
    return row.withColumn("n_chars", F.length("text").cast("long")).drop(blocks, labels)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. Edges: see ``extract_text``."""
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
